"""Licence scan (method: positional rare-token index).

Licence notices are templates, sequences of words. The index lists the places of the rarest words of each template and of its key phrase (rarest by how
many documents hold them). A file looks up those of its indexed words with the highest IDF, and each of their places in the file names templates with a relative position.
Where two places agree on template and relative position, the template is a candidate there; it counts if its key phrase stands there word by word.
Base phrases are found besides, wherever their words stand consecutively. All of it works on the row of a file: no file is joined or shuffled.
"""

from __future__ import annotations

import string
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that always count, and their labels.
BASE = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices by label, and the phrase in each that must be there.
TEMPLATES = {
    "agpl-3.0": ("this program is licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd-3-clause": ("redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    "cc-by-4.0": ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa 4 0"),
    "cc0-1.0": ("dedicated to the public domain under cc0 1 0 universal", "cc0 1 0"),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "lgpl-3.0": ("licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    "mit": ("released under the mit license", "mit license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "proprietary": ("all rights reserved no part of this work may be reproduced without permission", "no part of this work may be reproduced"),
}

#: Rarest words of a template that are indexed, besides the AGREEING rarest of its key phrase.
INDEXED = 3
#: Words that the SQL looks up in a file, of its indexed words those with the highest IDF; ``scan`` looks up all.
LOOKED_UP = 16
#: Places that must agree on a template and its relative position.
AGREEING = 2


def words(text: str | Column) -> Column:
    """Runs of ASCII letters (lower-cased), digits and other characters beyond ASCII; none for null."""
    low = F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), 0)


def _texts(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def document_frequency(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """In how many documents each word of the templates stands; at most one number per word reaches the driver."""
    known = sorted({w for t, _ in TEMPLATES.values() for w in t.split()})
    found = docs.select(F.explode(F.array_intersect(_texts(known), words(text))).alias("word")).groupBy("word").count()
    return {r["word"]: r["count"] for r in found.collect()}


def _rarest(order: list[str], frequency: dict[str, int], n: int) -> list[str]:
    """The ``n`` words that fewest documents hold, of those that any holds."""
    return sorted({w for w in order if frequency.get(w)}, key=lambda w: (frequency[w], w))[:n]


def _at(phrase: list[str], place: Column) -> Column:
    """Whether the words of ``phrase`` stand in the file from ``place`` on."""
    same = F.lit(True)
    for i, w in enumerate(phrase):
        same = same & F.coalesce(F.get("words", place + i) == w, F.lit(False))
    return same


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Licence labels of every document: the columns of ``docs``, then n_words, n_base, first_word, last_word, base_labels, labels, spans, score.

    ``spans`` lists the templates found (label, first word, share of its words that stand in place); ``score`` is 1 with a base phrase, otherwise the
    largest share, 0 without any label. A null or empty text has no words and no labels (empty strings). Columns of these names are replaced.
    """
    frequency = document_frequency(docs, text)
    postings: dict[str, list[tuple[str, int]]] = {}
    for label, (template, phrase) in TEMPLATES.items():
        order = template.split()
        rarest = _rarest(order, frequency, INDEXED) + _rarest(phrase.split(), frequency, AGREEING)
        for place, w in enumerate(order):
            if w in rarest:
                postings.setdefault(w, []).append((label, place))
    by_idf = sorted(postings, key=lambda w: (frequency[w], w))

    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "score")
    own = {f"own{i}": c for i, c in enumerate(docs.columns) if c not in added}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in own.items()], words(text).alias("words")).withColumn("n_words", F.size("words").cast("long"))

    no_places = F.array().cast("array<int>")
    found = {}
    for i, phrase in enumerate(BASE):
        parts = phrase.split()
        here = F.lit(True)
        for w in parts:
            here = here & F.array_contains("words", w)
        places = F.filter(F.sequence(F.lit(0), F.size("words") - len(parts)), partial(_at, parts))
        found[f"base{i}"] = F.when(here & (F.size("words") >= len(parts)), places).otherwise(no_places)
    # All indexed words of the file, in order of IDF.
    found["chosen"] = F.array_intersect(_texts(by_idf), F.col("words"))
    rows = rows.withColumns(found)

    hit = "array<struct<label:string,place:int>>"
    if postings:
        lists = F.create_map(*[x for w, own_list in postings.items() for x in (
            F.lit(w), F.array(*[F.struct(F.lit(label).alias("label"), F.lit(place).alias("place")) for label, place in own_list]))])
        placed = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: F.array_contains("chosen", x["word"]))
        hits = F.flatten(F.transform(placed, lambda x: F.transform(
            F.element_at(lists, x["word"]), lambda t: F.struct(t["label"].alias("label"), (x["at"] - t["place"]).alias("place")))))
        rows = rows.withColumn("hits", F.when(F.size("chosen") > 0, F.array_sort(hits)).otherwise(F.array().cast(hit)))
    else:
        rows = rows.withColumn("hits", F.array().cast(hit))
    # Sorted, equal hits are neighbours.
    agreeing = F.array_distinct(F.filter("hits", lambda h, i: F.coalesce(h == F.get("hits", i + (AGREEING - 1)), F.lit(False))))
    rows = rows.withColumn("candidates", F.when(F.size("hits") >= AGREEING, agreeing).otherwise(F.array().cast(hit)))

    def share(c: Column) -> Column:
        value = F.lit(0.0)
        for label, (template, phrase) in TEMPLATES.items():
            order, key = template.split(), phrase.split()
            at = next(i for i in range(len(order)) if order[i:i + len(key)] == key)
            same = F.lit(0)
            for i, w in enumerate(order):
                same = same + F.when(F.get("words", c["place"] + i) == w, 1).otherwise(0)
            value = F.when(c["label"] == label, F.when(_at(key, c["place"] + at), same / F.lit(float(len(order)))).otherwise(0.0)).otherwise(value)
        return value

    spans = F.filter(F.transform("candidates", lambda c: F.struct(c["label"].alias("label"), c["place"].alias("first_word"), share(c).alias("share"))),
                     lambda s: s["share"] > 0)
    rows = rows.withColumn("spans", F.when(F.size("candidates") > 0, spans).otherwise(F.array().cast("array<struct<label:string,first_word:int,share:double>>")))

    all_places = F.concat(*[f"base{i}" for i in range(len(BASE))])
    base = F.filter(F.array(*[F.when(F.size(f"base{i}") > 0, label) for i, label in enumerate(BASE.values())]), lambda x: x.isNotNull())
    rows = rows.withColumns({"places": all_places, "base": F.array_sort(base)})
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("spans", lambda s: s["label"]))))
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)))
    return rows.select(
        *[F.col(n).alias(c) for n, c in own.items()], "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), "spans", score.alias("score"))
