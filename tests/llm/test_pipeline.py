import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from palimpsest.llm.shared import new_folder, written
from palimpsest.llm.tokens import encoder
from tests.llm.test_jaccard import brute
from tests.llm.test_native import shared_out

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def results(spark):
    docs, folder, out = spark.read.parquet(f"{SF}/documents.parquet"), new_folder(spark, "test"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = written(stage(spark, docs, SF), folder, name)
    return [*out, docs]


def test_stages_against_brute_force(spark, results):
    docs, known, single, mixed, packed = results
    assert known.columns == single.columns == mixed.columns == docs.columns
    letters = [r for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)]
    assert 0 < known.count() <= len(letters) and known.count() >= 0.98 * len(letters)
    kept = known.collect()
    component = {d: c for d, _, c in brute([(r.doc_id, r.text) for r in kept])}
    assert rows(single) == sorted((tuple(r) for r in kept if component[r.doc_id] == r.doc_id), key=repr)
    size = lambda t: len((t or "").split())
    sizes, taken, most = {}, {}, {}
    one = {r.doc_id: r for r in single.collect()}
    for r in one.values():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
        most[r.source] = max(most.get(r.source, 0), size(r.text))
    for r in mixed.collect():
        assert tuple(r) == tuple(one[r.doc_id])
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    names = sorted(sizes, key=lambda k: (k is None, k or ""))
    target = shared_out(sizes, {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}, sum(sizes.values()))
    assert all(abs(taken.get(k, 0) - target[k]) <= most[k] / 2 + 1e-6 for k in names)
    lib = encoder(public_tokenizers.path("word_bpe_49k.json")).library
    want = sum(-(-(len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1) // 2048) for r in mixed.collect())
    got = packed.collect()
    assert len(got) == want
    by = {}
    for g in got:
        by.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for places in by.values():
        ends = np.cumsum([0, *(n for _, n in sorted(places))])
        assert [o for o, _ in sorted(places)] == ends[:-1].tolist() and ends[-1] <= 2048


def test_stages_take_edge_cases(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert name == "packing" or out.columns == docs.columns
            assert out.count() >= 0 and (docs is edge_docs or out.count() == 0)


def test_run_is_the_stages(spark, results):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(corpus_pipeline.run(spark, SF).select(*key)) == rows(results[-1].select(*key))
