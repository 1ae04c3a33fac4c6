import numpy as np
import pytest

from palimpsest.llm import ann, embed_dedup

BAD = [(900_001, None), (900_002, [0.0] * 16), (900_003, [float("nan")] + [1.0] * 15), (900_004, [float("inf")] * 16), (900_005, [None] + [1.0] * 15), (900_006, []),
       (900_007, [1.0, 2.0]), (None, [1.0] * 16)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, 1.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")


def clustered(n=3000, d=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(0, n, 3):
        x[i] = x[rng.integers(n)] + rng.standard_normal(d) * rng.choice([0.02, 0.1, 0.6])
    x[10] = x[11] = x[12] = x[13]
    return x * rng.uniform(0.5, 2, (n, 1))


@pytest.mark.parametrize("rows_per_bucket", [400, 40])
def test_neighbours_against_brute_force(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(ann, "BUCKET_ROWS", rows_per_bucket)
    monkeypatch.setattr(ann, "BLOCK_VECTORS", 500)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 20)
    x = clustered()
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)] + BAD)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), k=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = 0
    for q in range(0, len(x), 20):
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        want = sorted(zip(-s, range(len(x))))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        assert all(abs(m[2] - s[m[1]]) < 1e-12 for m in mine)
        hit += len({v for _, v in want} & {m[1] for m in mine})
    assert hit >= 0.9 * 20 * len(got) and len(got) == len(x) // 20


def test_few_vectors_find_all_others(spark):
    df = table(spark, [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0])])
    got = sorted(map(tuple, ann.search(df, df.where("vec_id % 20 = 0")).collect()))
    assert got == [(0, 1, 2, 1.0), (0, 2, 20, 1.0), (0, 3, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 2, 1.0), (20, 3, 1, 0.5)]
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [4000, 300])
def test_near_copies_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(embed_dedup, "SHARD_ROWS", shard)
    monkeypatch.setattr(embed_dedup, "AIM_ROWS", shard // 3)
    x = clustered()
    df = table(spark, [(i, v.tolist()) for i, v in enumerate(x)] + BAD)
    got = {r.vec_id: r for r in embed_dedup.near_copies(df).collect()}
    assert len(got) == len(x) + len(BAD)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    there = near.sum(1)
    mine = np.array([got[i].n_links for i in range(len(x))])
    assert (mine <= there).all() and mine.sum() >= 0.95 * there.sum()
    assert got[13].n_links >= 3 and got[13].component_id <= 10
    for i, _ in BAD:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    assert embed_dedup.near_copies(df.limit(0)).count() == 0
    found, all_links = embed_dedup.recall(df, embed_dedup.near_copies(df), share=10)
    assert found >= 0.9 * all_links


def grouped(sizes, d, noise, seed=1):
    """Unit vectors in groups of near copies, mixed."""
    rng = np.random.default_rng(seed)
    out = []
    for n in sizes:
        centre, off = rng.standard_normal(d), rng.standard_normal((n, d))
        out.append(centre / np.linalg.norm(centre) + noise * off / np.linalg.norm(off, axis=1, keepdims=True))
    x = np.concatenate(out)
    x = x[rng.permutation(len(x))]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links_against_all(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in embed_dedup.near_copies(df).collect()}
    there = np.concatenate([(x[i:i + 1000] @ x.T >= 0.95).sum(1) - 1 for i in range(0, len(x), 1000)])
    return np.array([got[i].n_links for i in range(len(x))]), there, got


@pytest.mark.parametrize("shard", [4000, 400])
def test_groups_of_near_copies_among_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(embed_dedup, "SHARD_ROWS", shard)
    monkeypatch.setattr(embed_dedup, "AIM_ROWS", shard // 2)
    mine, there, got = links_against_all(spark, grouped([60, 100, 600] + [2] * 500, 64, 0.12))
    assert (mine == there).all() and len({r.component_id for r in got.values()}) == 503


def test_group_larger_than_a_shard(spark):
    mine, there, got = links_against_all(spark, grouped([10_000] + [2] * 10_000, 16, 0.12))
    assert there.max() >= 9999 and (mine <= there).all() and mine.sum() >= 0.999 * there.sum()
    assert (mine[there >= 9000] >= 0.999 * there[there >= 9000]).all()


def test_equal_places_are_cut_by_hash(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "SPLITS", 0)
    monkeypatch.setattr(embed_dedup, "SHARD_ROWS", 300)
    monkeypatch.setattr(embed_dedup, "VISITORS", 200)
    mine, there, _ = links_against_all(spark, grouped([900] + [2] * 50, 16, 0.12))
    assert (mine == there).all()
