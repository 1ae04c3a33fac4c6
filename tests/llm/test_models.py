import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from palimpsest.llm import lang_id, lm_score
from palimpsest.llm.bytescan import text_bytes
from palimpsest.llm.shared import new_folder

SF = "/root/testdata/sf0.01"


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = lang_id.fit(docs.where(fold != 0))
    got = docs.where(fold == 0).select("lang", lang_id.predicted(model).alias("p")).select("lang", "p.*").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    # A text is judged alike alone and among others.
    texts = [r.text for r in docs.limit(40).collect()]
    many = lang_id.predict_bytes(model, *text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        one = lang_id.predict_bytes(model, *text_bytes(pa.array([t])))
        assert (one[0][0], one[1][0]) == (many[0][i], many[1][i])


def test_languages_of_edge_cases(spark, edge_docs, no_docs):
    model = lang_id.fit(edge_docs.where("doc_id in (8, 9)"))
    got = [(r.text, r.p.lang_pred, r.p.score) for r in edge_docs.select("text", lang_id.predicted(model).alias("p")).collect()]
    for text, lang, score in got:
        letters = text is not None and any(c.isalpha() for c in text)
        assert lang == ("en" if letters else "und") and 0 <= score <= 1
    empty = lang_id.fit(no_docs)
    assert {r.p.lang_pred for r in edge_docs.select(lang_id.predicted(empty).alias("p")).collect()} == {"und"}
    kept = lang_id.in_known_language(edge_docs, model, "text", 0.2)
    assert kept.columns == edge_docs.columns and kept.exceptAll(edge_docs.where(lang_id.accepted(model, "text", 0.2))).count() == 0
    assert kept.count() == sum(1 for t, lang, s in got if lang == "en" and s >= 0.2)


def test_many_languages_fit_one_table():
    rng = np.random.default_rng(0)
    members = [np.unique(rng.integers(0, 2**40, 300, dtype=np.uint64)) for _ in range(130)]
    model = lang_id.build([f"l{i:03d}" for i in range(130)], members, 0)
    for i, own in enumerate(members):
        rows = None
        for row in lang_id._rows(own, model.table.shape[1]):
            rows = model.table[i // 64, row] if rows is None else rows & model.table[i // 64, row]
        assert (rows >> np.uint64(i % 64) & np.uint64(1)).all()


def test_gradients_are_right():
    rng = np.random.default_rng(4)
    p = {k: v.astype(np.float64) for k, v in lm_score.start_weights().items()}
    x, y = rng.integers(0, lm_score.SYMBOLS + 1, (40, 2 * lm_score.SIDE)), rng.integers(0, lm_score.SYMBOLS, 40)
    _, g = lm_score.gradients(p, x, y)
    for k in p:
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        h = 1e-5
        p[k][at] += h
        up = lm_score.gradients(p, x, y)[0]
        p[k][at] -= 2 * h
        down = lm_score.gradients(p, x, y)[0]
        p[k][at] += h
        assert abs((up - down) / (2 * h) - g[k][at]) < 1e-6


def plain_gradients(p, x, y):
    """Class by class, with an array for everything."""
    n, g = len(y), {k: np.zeros_like(v) for k, v in p.items()}
    kind, inner = y // lm_score.PER_CLASS, y % lm_score.PER_CLASS

    def less_own(z, own):
        z = z - z.max(1, keepdims=True)
        z = z - np.log(np.exp(z).sum(1, keepdims=True))
        d = np.exp(z)
        d[np.arange(len(z)), own] -= 1
        return d

    em = p["e"][x].reshape(n, -1)
    h = np.tanh(em @ p["w"] + p["v"])
    dc = less_own(h @ p["a"] + p["c"], kind)
    dh = dc @ p["a"].T
    for c in np.unique(kind):
        mine = np.flatnonzero(kind == c)
        dr = less_own(h[mine] @ p["b"][c] + p["d"][c], inner[mine])
        g["b"][c], g["d"][c] = h[mine].T @ dr / n, dr.sum(0) / n
        dh[mine] += dr @ p["b"][c].T
    g["a"], g["c"] = h.T @ dc / n, dc.sum(0) / n
    dz = dh * (1 - h * h) / n
    g["w"], g["v"] = em.T @ dz, dz.sum(0)
    np.add.at(g["e"], x, (dz @ p["w"].T).reshape(*x.shape, -1))
    return g


def test_steps_use_the_same_memory_again():
    """Steps of any size give what plain ones give, and none takes new memory for what an earlier one has left."""
    rng = np.random.default_rng(9)
    p, room = lm_score.start_weights(), lm_score.Room()
    adam, held = lm_score.Adam(p), None
    for n in (1024, 40, 1, 1024):
        x, y = rng.integers(0, lm_score.SYMBOLS + 1, (n, 2 * lm_score.SIDE)), rng.integers(0, lm_score.SYMBOLS, n) % rng.integers(1, lm_score.SYMBOLS + 1)
        want, (_, got) = plain_gradients(p, x, y), lm_score.gradients(p, x, y, room)
        assert all(np.allclose(got[k], want[k], rtol=1e-4, atol=1e-6) for k in p)
        adam.step(p, got, 0.004)
        places = {k: v.ctypes.data for r in (room, adam.room) for k, v in r.held.items()}
        assert held is None or places == held
        held = places


def test_windows_end_with_their_document():
    sym, doc = np.arange(10, 19), np.array([0, 0, 0, 0, 0, 2, 2, 2, 5])
    got = lm_score.contexts(sym, doc, np.array([0, 4, 5, 8]))
    end = lm_score.SYMBOLS
    assert got.tolist() == [[end, end, end, 11, 12, 13], [11, 12, 13, end, end, end], [end, end, end, 16, 17, end], [end] * 6]


def test_scores_prefer_real_order(spark, edge_docs, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = public_tokenizers.path("byte_bpe_50k.json")
    folder = new_folder(spark, "test")
    ids = lm_score.encoded(docs, path, folder)
    model = lm_score.train(ids, folder, 50257)
    total = {"real": 0.0, "mixed": 0.0}
    rng = np.random.default_rng(0)
    rows = [r for r in ids.orderBy("doc_id").limit(150).collect() if len(r.ids) > 80]
    got = {r.doc_id: r for r in lm_score.scored(ids, model).collect()}
    for r in rows:
        t = np.frombuffer(r.ids, "<u4").astype(np.int64)
        own = lm_score.log_probabilities(model, t, np.zeros(len(t), int))
        assert abs(own.sum() - got[r.doc_id].log_prob) < 1e-6 * abs(own.sum()) and got[r.doc_id].n_tokens == len(t)
        total["real"] += own.sum()
        total["mixed"] += lm_score.log_probabilities(model, rng.permutation(t), np.zeros(len(t), int)).sum()
    assert total["real"] > 0.98 * total["mixed"] and (own < 0).all()
    # All ids together have probability one, whatever the context.
    x = np.full((1, 2 * lm_score.SIDE), lm_score.SYMBOLS)
    probe = np.arange(50257)
    alone = np.array([np.exp(lm_score.log_probabilities(model, probe[i:i + 1], np.zeros(1, int)))[0] for i in range(0, 50257, 500)])
    whole = np.exp(lm_score.log_probabilities(model, probe, np.arange(len(probe))))
    assert abs(whole.sum() - 1) < 1e-3 and np.allclose(whole[::500], alone, rtol=1e-4) and x.shape == (1, 6)
    edge = {(r.doc_id, r.n_tokens): r for r in lm_score.score_documents(edge_docs, path).collect()}
    assert edge[(2, 0)].log_prob == 0 and edge[(2, 0)].mean_log_prob is None
    assert lm_score.score_documents(no_docs, path).count() == 0


def test_training_takes_every_token_once():
    """No document is sampled: the rounds share out all its tokens, however long it is."""
    doc = np.repeat([0, 2, 3, 5], [1, 5000, 2, 77])
    for rounds in (1, 3):
        got = [lm_score.places(doc, turn, rounds) for turn in range(rounds)]
        assert sorted(np.concatenate(got).tolist()) == list(range(len(doc)))
