import pytest

from palimpsest.llm import licenses, mixing, shared, url_filter


def shared_out(sizes, weights, total):
    """Targets as the words say it: share by weight, cap, share the excess again."""
    target, free = dict.fromkeys(sizes, 0.0), {k for k in sizes if sizes[k]}
    left = float(total)
    while free and left > 1e-9:
        w = sum(weights[k] for k in free)
        more, left = {k: left * weights[k] / w for k in free}, 0.0
        for k, m in more.items():
            target[k] += m
            if target[k] >= 3 * sizes[k]:
                left += target[k] - 3 * sizes[k]
                target[k] = 3.0 * sizes[k]
                free.discard(k)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 7}, {"a": 0, "b": 0}, {"x": 100}, {"a": 1, "b": 2, "c": 3, "d": 4, "e": 5000, "f": 0, None: 1}])
def test_targets(spark, sizes):
    names = sorted(sizes, key=lambda k: (k is None, k or ""))
    weights = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = shared_out(sizes, weights, sum(sizes.values()))
    assert all(abs(got[k] - want[k]) < 1e-6 for k in sizes)


@pytest.mark.parametrize("rows", [50_000, 3])
def test_mix_comes_near_its_targets(spark, edge_docs, no_docs, monkeypatch, rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", rows)
    docs = spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 7 % 4}" if i % 5 else None) for i in range(400)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([(i, 0.25 + i % 2) for i in range(0, 400, 2)], "doc_id long, weight double")
    first, again = (sorted(mixing.mix(d, weights).collect(), key=repr) for d in (docs, docs.repartition(5)))
    assert first == again
    by = {}
    for r in first:
        by.setdefault(r.source, []).append(r)
        assert r.taken == r.copies * r.size <= 3 * r.size and r.size == r.doc_id % 9
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4.5 and sum(r.size for r in own) == own[0].source_size
    edge = mixing.mix(edge_docs)
    assert edge.count() == edge_docs.count() and edge.columns[:4] == edge_docs.columns[:4]
    assert mixing.mix(no_docs).count() == 0


@pytest.mark.parametrize("sent", [shared.SENT, 0])
def test_texts_are_not_shuffled_for_their_weights(spark, monkeypatch, sent):
    """Weights go to the texts, whatever the planner expects of their size, as long as they are few."""
    docs = spark.createDataFrame([(i % 90, f"w{i} " * (i % 9), f"s{i % 3}") for i in range(100)] + [(None, "x y", None)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([(i, 0.25 + i % 2) for i in range(0, 100, 3)], "doc_id long, weight double")
    plain = sorted(mixing.mix(docs, weights).collect(), key=repr)
    monkeypatch.setattr(shared, "SENT", sent)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = mixing.mix(docs, weights)
        assert sorted(got.collect(), key=repr) == plain
        assert ("Exchange hashpartitioning(doc_id" in got._jdf.queryExecution().executedPlan().toString()) == (sent == 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_licences(spark, edge_docs, no_docs):
    texts = [(1, "Released under the MIT License."), (2, "x y CC BY: licensed under CC BY-NC 4.0, cc-by!"), (3, "released the license mit under"), (4, None), (5, ""),
             (6, "This work is licensed under the GNU General Public License, version 3."), (7, "ALL RIGHTS reserved all rights RESERVED"), (8, "the of by all"),
             (8, "the of by all"), (9, "zz " * 50_000 + "mit license"), (10, "the mit license " * 3000)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].base_labels, got[1].n_base, got[1].first_word, got[1].score) == ("mit", "", 0, None, 1.0)
    assert (got[2].labels, got[2].base_labels, got[2].n_base, got[2].first_word, got[2].last_word) == ("cc-by,cc-by-nc-4.0", "cc-by", 3, 2, 11)
    assert got[3].labels == "" and got[3].score == 0
    assert got[4].n_words == got[5].n_words == 0 and got[4].labels == got[5].labels == ""
    assert got[6].labels == "gpl,gpl-3.0" and got[6].spans[0].first_word == 0
    assert (got[7].n_base, got[7].first_word, got[7].last_word, got[7].labels) == (2, 0, 3, "reserved")
    assert got[8].labels == "" and got[9].labels == "mit" and got[10].labels == "mit" and len(got[10].spans) == 3000
    assert licenses.scan(edge_docs).count() == edge_docs.count() and licenses.scan(no_docs).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def test_url_parts_and_rules(spark):
    urls = [("http://A.Example.ORG/es/1?x#y", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
            ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://org", "org", "", None, "allow"), ("http://x.com?a/b", "x.com", "", None, "allow"),
            ("x.com/de/", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"), ("http://y.com/de/#", "y.com", "/de/", "com/de/", "block"),
            ("a://b://c/d", "b:", "//c/d", None, "allow"), ("://org/", "org", "/", "org/", "allow"), ("http://" + "a." * 5000 + "com/fr/", "a." * 5000 + "com", "/fr/", "com/fr/", "allow")]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u[0], "mine", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, bad int")
    got = sorted(map(tuple, url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert got == [(i, *u[1:]) for i, u in enumerate(urls)]
    assert url_filter.judge(pages.limit(0), rules).count() == 0 and url_filter.judge(pages, rules.limit(0)).count() == len(urls)


def test_bad_hosts_are_blocked_and_lone_pages_forgiven(spark):
    rows = [(f"http://bad.one.net/{i}", 1) for i in range(60)] + [(f"http://good.two.net/{i}", int(i % 10 == 0)) for i in range(300)]
    rows += [("http://lone.two.net/x", 1), ("http://new.two.net/x", None), ("http://other.one.net/x", None)] + [(f"http://s{i}.three.net/", i % 2) for i in range(40)]
    pages = spark.createDataFrame(rows, "url string, outcome int")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    got = {r.host: r.verdict for r in url_filter.judge(pages, rules, outcome="outcome").collect()}
    assert got["bad.one.net"] == "block" and got["good.two.net"] == "allow" and got["lone.two.net"] == "allow" and got["new.two.net"] == "allow"


def test_text_of_all_notices_has_all_labels(spark):
    common = [(i, "license mit the under released") for i in range(50)]
    docs = spark.createDataFrame([(99, " x ".join(t for t, _ in licenses.TEMPLATES.values())), *common], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert set(licenses.TEMPLATES) <= set(got[99].labels.split(",")) and got[0].labels == ""
