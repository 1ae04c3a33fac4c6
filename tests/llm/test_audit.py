import hashlib
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from palimpsest.llm import byte_bpe, centroids, filter_audit

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def audited(docs, labels):
    """Every order applied as the words say it, document by document."""
    space = " \t\n\x0b\x0c\r"
    rows = []
    for doc_id, text, lang in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in space else c for c in text).split(" ") if w]
        smaller = doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in docs)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
                 "D": any(c in "#$%&*|" for c in text), "E": smaller}
        own = [x for x in labels if doc_id is not None and x[0] == doc_id]
        rows.append((lang or "", fails, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out = {}
    for part in {r[0] for r in rows}:
        taken = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [r for r in alive if r[1][f]]
                out[part, order, step] = [
                    len(alive) - len(here), len(here), sum(r[1][f] for r in gone), sum(r[0] == part and r[1][f] and sum(r[1].values()) == 1 for r in rows),
                    sum(r[2] for r in here), sum(r[3] for r in here)]
                gone += here
                alive = [r for r in alive if not r[1][f]]
                taken[f] += len(here)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(taken[order[step - 1]])
    return out


def by_key(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_filter_audit_equals_brute_force(spark, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(filter_audit, "HOT_SHARE", 8)
    draw = random.Random(5)
    words = ["one", "Two", "three|", "four", "FIVE", "six#", *(f"w{i}" for i in range(300))]
    texts = ["", None, " x\x1cy", "ÄÖÜ ABC", *(" ".join(draw.choice(words[k:k + n]) for _ in range(draw.choice([5, 250]))) for k, n in itertools.product((0, 5), (6, 300)) for _ in range(5))]
    docs = [(draw.choice([None, i, i, i // 2]), draw.choice(texts), draw.choice(["en", "de", None, ""])) for i in range(120)]
    labels = [(draw.choice([None, i, i]), draw.choice([None, 0, 1]), draw.choice([None, 0, 1])) for i in range(100)] + [(3, 1, 1), (3, 0, 0)]
    schema = "doc_id long, text string, lang string"
    frame = spark.createDataFrame(docs, schema).selectExpr("*", "1 as rid", "'p' as part", "'f' as filter", "2 as n")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert by_key(filter_audit.audit(frame, marks)) == audited(docs, labels)
    edge = [(r.doc_id, r.text, r.lang) for r in edge_docs.collect()]
    assert by_key(filter_audit.audit(edge_docs, marks.limit(0))) == audited(edge, [])
    assert filter_audit.audit(no_docs, marks).count() == 0


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_byte_bpe_equals_library(spark, edge_docs, no_docs, library, monkeypatch, block):
    monkeypatch.setattr(byte_bpe, "BLOCK", block)
    monkeypatch.setattr(byte_bpe, "BUCKET_BYTES", block * 4)
    draw = random.Random(3)
    texts = ["it's we'll I'D 'sx ''s don''t", "  a   b\n\n\t c ", " ", "\n", "a" * 3000, "\x1c\x1d\x85 x", "٣ Ⅷ ½ x²", "é é 중文 👍🏽 \U0001d54f", "<|endoftext|>", "ab" * 5000 + " ab", None, ""]
    texts += ["".join(chr(draw.choice([draw.randrange(32, 127), draw.randrange(0x20, 0x3000), draw.randrange(0xE000, 0x110000)])) for _ in range(draw.randrange(200))) for _ in range(60)]
    docs = [(draw.choice([None, i, 7]), t) for i, t in enumerate(texts)] + [(7, "same"), (7, "same")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "'w' as bucket", "3 as ids", "4 as ends")
    tokens = byte_bpe.token_bytes(spark, RANKS)
    for df, rows in ((frame, docs), (edge_docs, [(r.doc_id, r.text) for r in edge_docs.collect()])):
        got = byte_bpe.decode(byte_bpe.encode(df, RANKS, public_tokenizers.PATTERN), tokens)
        want = sorted((repr(d), library.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows)
        assert sorted((repr(r.doc_id), r.ids, bytes(r.decoded)) for r in got.collect()) == want
        for r in byte_bpe.digests(got).where("doc_id is not null").collect():
            ids = next(w for w in want if w[0] == repr(r.doc_id) and hashlib.sha256(w[2]).hexdigest() == r.decoded_sha256)[1]
            assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    assert byte_bpe.decode(byte_bpe.encode(no_docs, RANKS, public_tokenizers.PATTERN), tokens).count() == 0


def test_pre_tokens_cut_where_the_library_cuts(library):
    """Every character beside letters, digits and white space: the same ids, so the same classes of characters."""
    find = byte_bpe._pattern(public_tokenizers.PATTERN).findall
    for first in range(0, 0x30000, 4096):
        text = "".join(f"a{chr(c)} {chr(c)}1{chr(c)}" for c in range(first, first + 4096) if not 0xD800 <= c < 0xE000)
        assert [i for w in find(text) for i in library._encode_single_piece(w)] == library.encode_ordinary(text)


def test_decoding_of_other_ids(spark):
    tokens = spark.createDataFrame([(0, bytearray(b"a")), (2, bytearray(b"")), (5, bytearray(b"\xff\xfe"))], "id int, token binary")
    rows = spark.createDataFrame([(1, [5, 0, 2, 0], "x"), (2, [], "x"), (3, None, "x"), (4, [0, 1], "x"), (5, [0, None], "x"), (6, [9], "x"), (7, [-1], "x"), (8, [0], "x")], "k int, ids array<int>, decoded string")
    got = {r.k: r.decoded if r.decoded is None else bytes(r.decoded) for r in byte_bpe.decode(rows, tokens).collect()}
    assert got == {1: b"\xff\xfeaa", 2: b"", 3: None, 4: None, 5: None, 6: None, 7: None, 8: b"a"}
    assert byte_bpe.decode(rows.limit(0), tokens.limit(0)).count() == 0


def test_documents_in_another_order_are_noticed(spark):
    texts = [(i, f"text {i}") for i in range(50)]
    blocks = byte_bpe.Block(texts, byte_bpe.cutter(public_tokenizers.PATTERN), 3), byte_bpe.Block(texts[::-1], byte_bpe.cutter(public_tokenizers.PATTERN), 3)
    assert blocks[0].check != blocks[1].check and sorted(blocks[0].words) == sorted(blocks[1].words)


def test_packed_rows():
    for values in ([], [0], [0, 1, 127, 255, 256, 65536, 2**40, 3]):
        assert byte_bpe.unsqueeze(byte_bpe.squeeze(np.array(values, np.int64))).tolist() == values
    for words in ([], [b""], [b"a", b"", b"\xff\x00 b", b"c" * 300]):
        assert byte_bpe.unpack_words(byte_bpe.pack_words(words)) == words


def test_latin_texts_are_cut_alike():
    draw = random.Random(1)
    every, cut = byte_bpe._pattern(public_tokenizers.PATTERN).findall, byte_bpe.cutter(public_tokenizers.PATTERN)
    assert byte_bpe._latin_pattern(public_tokenizers.PATTERN) is not None and byte_bpe._latin_pattern(r"\p{Lu}+|.") is None
    for _ in range(500):
        text = "".join(chr(draw.choice([draw.randrange(256), draw.choice([32, 39, 115, 116, 10])])) for _ in range(300))
        assert cut(text) == every(text)


def clustered(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) if abs(x) < 1e300 else int(x) * 64 for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centres = [q for _, q in start[:k]]
    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for c in set(own):
            mine = [q for (_, q), o in zip(kept, own) if o == c]
            centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *near(q)) for i, q in kept]
    total, out = sum(d for _, d, _ in found), []
    fits = lambda x: x if x < 2**63 else None
    for i, d, c in found:
        digest = hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()
        out.append((i, c, fits(d), fits(sum(x for _, x, o in found if o == c)), fits(total), digest))
    return sorted(out, key=repr)


def numbers(kind):
    draw = np.random.default_rng(7)
    if kind == "groups":
        centre = draw.normal(size=(9, 64))
        rows = [(i, (centre[i % 9] + 0.1 * draw.normal(size=64)).tolist()) for i in range(300)]
        return rows + rows[:40] + [(i, [0.0] * 64) for i in range(400, 430)] + [(None, [0.5] * 64), (None, None), (500, [1.0] * 63), (501, [1.0] * 65), (502, [math.nan] + [0.0] * 63), (503, [None] + [0.0] * 63), (504, [math.inf] + [0.0] * 63)]
    if kind == "large":
        scale = [1, 1, 1e3, 1e7, 3e5, 1e12, 1e30, 1e305]
        return [(i, (scale[i % 8] * draw.normal(size=64)).tolist()) for i in range(160)]
    if kind == "far":
        return [(i, [float(i % 3)] * 64) for i in range(12)] + [(99, [1e308] * 64), (98, [-1e308] * 64), (97, [2.0**22] * 64)]
    return [(1, [0.25] * 64), (2, [-0.01] * 64), (2, [-0.01] * 64)] if kind == "few" else []


@pytest.mark.parametrize("kind", ["groups", "large", "far", "few", "none"])
def test_clusters_equal_brute_force(spark, kind):
    rows = numbers(kind)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as cluster", "'x' as whole", "2 as rest").repartition(3)
    assert sorted(map(tuple, centroids.cluster(frame).collect()), key=repr) == clustered(rows)


def test_bounds_spare_measuring():
    draw = np.random.default_rng(1)
    centre = draw.normal(size=(16, 64)) * 100
    q = np.floor(centre[draw.integers(0, 16, 2000)] + 3 * draw.normal(size=(2000, 64))).astype(np.int64)
    axes = np.linalg.eigh(np.cov(q.T))[1][:, ::-1][:, :16]
    c = centroids.Centroids([[int(x) for x in np.floor(r)] for r in centre], axes)
    number, best, measured = c.nearest(q, *centroids.rotated(q.astype(float), axes))
    every = ((q[:, None, :] - c.q) ** 2).sum(2)
    assert (number == every.argmin(1)).all() and (best == every.min(1)).all() and measured < 3000
