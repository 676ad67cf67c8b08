import random
import re

from pyspark.sql import functions as F

from marginalia.llm import licenses
from tests.llm.helpers import docs_table, odd_rows

RULES = licenses.rules()


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def matches(words, pattern):
    text = f" {' '.join(words)} "
    for m in re.finditer(f" (?:{pattern})(?= )", text):
        start = text[: m.start()].count(" ")
        yield start, start + m[0].count(" ")


def plain(text, rules=RULES, base=licenses.BASE):
    """(start, stop, priority, label) of what stays, every match against every other one."""
    words = words_of(text)
    found = [(a, -b, -p, i, label) for i, (label, p, keys, x) in enumerate(rules) if set(keys) & set(words) for a, b in matches(words, x)]
    kept = [m for m in found if not any(o < m and o[2] <= m[2] and o[0] <= m[0] and o[1] <= m[1] for o in found)]
    kept += [(a, -b, 0, i, label) for i, (phrase, label) in enumerate(base) for a, b in matches(words, phrase)]
    return [(a, -b, -p, label) for a, b, p, _, label in sorted(kept)]


def spans(rows):
    return {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in rows.collect()}


def test_there_are_hundreds_of_rules():
    assert len(RULES) > 250 and {p for _, p, _, _ in RULES} == {1, 2, 3}
    for _, _, keywords, pattern in RULES:
        assert keywords and re.compile(pattern) and " ?" not in pattern


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3 or any later version",
    "CC BY CC BY-NC 4.0, cc-by cc by-sa/4.0; all rights reserved All Rights Reserved.",
    "MIT License MIT License mit license",
    "gnu general public license general public license version 2 gpl gplv2+ GPL-3.0-only",
    "Redistribution and use in source and binary forms, with or without modification, are permitted. See the LICENSE file for details.",
    "(c) Copyright (C) 2019 ünï, released under the BSD-3-Clause license",
    "no terms at all",
    "",
    None,
]


def test_known_texts(spark):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = licenses.scan(table, ["doc_id"])
    got = spans(found)
    for i, text in enumerate(TEXTS):
        assert got[i] == plain(text), text
    said = {r["doc_id"]: r for r in licenses.summary(found, ["doc_id"]).collect()}
    assert said[0]["labels"] == "apache-2.0,licensed-under" and said[0]["n_base"] == 0 and said[0]["first_word"] is None
    assert said[1]["labels"] == "gpl,gpl-3-or-later,licensed-under" and said[1]["base_labels"] == "gpl"
    assert (said[2]["n_base"], said[2]["first_word"], said[2]["last_word"], said[2]["base_labels"]) == (6, 0, 17, "cc-by,reserved")
    assert said[3]["labels"] == "mit" and len(got[3]) == 5
    assert said[7]["score"] == said[8]["score"] == said[9]["score"] == 0 and 0.9 < said[0]["score"] < 1
    assert said[8]["n_words"] == said[9]["n_words"] == 0


def test_suppression_equals_all_pairs(spark):
    """Nested and equal intervals of all priorities, over several blocks of matches."""
    rules = [("long", 1, ("a",), "a b(?: c)?(?: a b)?"), ("high", 3, ("b",), "b c"), ("same", 2, ("b",), "b c"), ("low", 1, ("c",), "c"), ("mid", 2, ("a",), "(?:a b c a|c a)"), ("none", 2, ("z",), "a")]
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abcd") for _ in range(n)) for n in (0, 1, 2, 5, 30, 63, 64, 65, 130, 700) for _ in range(6)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = spans(licenses.scan(table, ["doc_id"], base=(("a b", "base"),), signatures=rules))
    for i, text in enumerate(texts):
        assert got[i] == plain(text, rules, (("a b", "base"),)), text


def test_whole_table_equals_plain_scan(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = spans(licenses.scan(docs, ["doc_id"]))
    assert sum(map(bool, got.values())) >= 3
    for d in docs.collect():
        assert got[d["doc_id"]] == plain(d["text"])


def test_no_python_in_the_plan(spark, sf_dir):
    out = licenses.summary(licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"]), ["doc_id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


def test_odd_rows_and_clashing_columns(spark):
    rows = [*odd_rows(), (8, "MIT License " * 20_000, "en", "a"), (9, "\x01 mit \x02 license \x01", "en", "a")]
    table = docs_table(spark, rows).withColumn("words", F.lit("x")).withColumn("label", F.lit("x")).withColumn("spans2", F.lit(1))
    out = licenses.scan(table, ["doc_id", "lang", "label"]).collect()
    assert len(out) == len(rows)
    long = next(r for r in out if r["doc_id"] == 8)
    assert long["n_words"] == 40_000 and len(long["spans"]) == 39_999 and tuple(long["spans"][-1]) == (39_998, 40_000, 3, "mit")
    assert [tuple(s) for r in out if r["doc_id"] == 9 for s in r["spans"]] == [(0, 2, 3, "mit")]
    for r in out:
        if r["doc_id"] not in (5, 8):
            texts = [t for i, t, la, _ in rows if i == r["doc_id"] and la == r["lang"]]
            assert r["n_words"] in {len(words_of(t)) for t in texts}


def test_empty_table(spark):
    assert licenses.summary(licenses.scan(docs_table(spark, []), ["doc_id"]), ["doc_id"]).collect() == []
