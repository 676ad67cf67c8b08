"""License scans: ordered signature rules over normal words, all in the JVM.

A text's words are its stretches of ASCII letters, digits and characters beyond ASCII, A-Z
lower-cased. Rules (``license_rules``: label, priority, keywords, pattern) are regular
expressions over the words joined by one blank. One intersection of the text's words with all
keywords says which rules are tried, so a text without any keyword meets none of them. A tried rule's matches
are found from left to right, without overlap; each is an interval of words.

Suppression: a match goes if its interval lies within that of another one whose priority is
at least as high. Of equal intervals the one with the higher priority stays, then the earlier
rule. Intervals are sorted by start, the longer one first, so a match is covered if the
greatest end before it, among priorities that may suppress it, reaches its end. That maximum is
taken over blocks of the sorted array, so many matches in one text don't meet pair by pair. ``base``
phrases are found at all their places, are never suppressed and suppress nothing.

Everything is one expression per row: nothing is shuffled, and no key can be hot. A text of
any length is scanned whole.

score: 1 minus the product of what each label leaves, 0.5, 0.25 or 0.05 by its priority (base labels: 0.25);
0 without labels, rounded to 6 digits.

Nulls and ties: a null text is an empty one, which has no words, spans or labels and a score of 0. Rows with equal texts have equal
results. Columns besides the kept ones may have any names; kept ones must not have those of the result.
Empty tables give empty results.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let
from .license_rules import FRAGMENTS, RULES

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: What a label leaves of the doubt, by priority; base labels have priority 0.
LEAVES = {0: 0.25, 1: 0.5, 2: 0.25, 3: 0.05}
#: Marks around a match; no word holds them.
_FROM, _TO = "\x01", "\x02"
#: Matches of a block when the greatest end before each match is looked for.
BLOCK = 64


def rules(text: str = RULES) -> list[tuple[str, int, tuple[str, ...], str]]:
    """(label, priority, keywords, pattern) in order."""
    out = []
    for line in text.strip().splitlines():
        label, priority, keywords, pattern = (x.strip() for x in line.split(" | "))
        for name, said in FRAGMENTS.items():
            pattern = pattern.replace(f"{{{name}}}", said)
        out.append((label, int(priority), tuple(keywords.split(",")), pattern))
    return out


def normal(text: Column) -> Column:
    """The words of a text joined by single blanks."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.btrim(F.regexp_replace(lowered, SEPARATOR, " "))


def _places(words: Column, pattern: Column) -> Column:
    """(start, stop) in words of each match in words that have a blank on both sides."""
    marked = F.split(F.btrim(F.regexp_replace(words, F.concat(F.lit(" ("), pattern, F.lit(")(?= )")), F.lit(f" {_FROM} $1 {_TO}"))), " ")
    marks = F.filter(F.transform(marked, lambda w, i: F.when(w.isin(_FROM, _TO), i)), lambda i: i.isNotNull())
    pairs = lambda at: F.transform(F.sequence(F.lit(0), F.size(at) - 2, F.lit(2)), lambda k: F.struct((F.get(at, k) - k).alias("start"), (F.get(at, k + 1) - k - 1).alias("stop")))
    return let(marks, lambda at: F.when(F.size(at) > 0, pairs(at)).otherwise(F.array().cast("array<struct<start:int,stop:int>>")))


def _before(ends: Column) -> Column:
    """The greatest of all values before each place of an array; -1 for the first."""
    blocks = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda j: F.array_max(F.slice(v, j * BLOCK + 1, BLOCK)))
    sums = lambda b: F.transform(b, lambda _, j: F.when(j == 0, F.lit(-1)).otherwise(F.array_max(F.slice(b, F.lit(1), j))))
    own = lambda v, i: F.when(i % BLOCK == 0, F.lit(-1)).otherwise(F.array_max(F.slice(v, i - i % BLOCK + 1, i % BLOCK)))
    return let(ends, lambda v: let(blocks(v), lambda b: let(sums(b), lambda s: F.transform(v, lambda _, i: F.greatest(F.get(s, F.floor(i / BLOCK).cast("int")), own(v, i))))))


def _suppressed(found: Column) -> Column:
    """Sorted matches (start, back, low, order, ...) without those that lie in one of at least their priority."""
    ends = lambda m, p: _before(F.transform(m, lambda x: F.when(-x["low"] >= p, -x["back"]).otherwise(F.lit(-1))))
    covers = lambda m: F.array(*[ends(m, p) for p in (1, 2, 3)])
    kept = lambda m, c: F.filter(m, lambda x, i: F.get(F.get(c, -x["low"] - 1), i) < -x["back"])
    return F.when(F.size(found) == 0, found).otherwise(let(covers(found), lambda c: kept(found, c)))


_MATCH = "array<struct<start:int,back:int,low:int,order:int,label:string>>"


def scan(docs: DataFrame, keep: list[str], text: str = "text", base: tuple = BASE, signatures: list | None = None) -> DataFrame:
    """keep, n_words, spans array<struct<start,stop,priority,label>> in words (stop exclusive) by start, longer ones first. Base phrases have priority 0 and all their places."""
    signatures = rules() if signatures is None else signatures
    known = F.array(*[F.struct(F.array(*map(F.lit, k)).alias("keywords"), F.lit(p).alias("pattern"), F.lit(-n).alias("low"), F.lit(i).alias("order"), F.lit(label).alias("label")) for i, (label, n, k, p) in enumerate(signatures)])
    first = F.array(*[F.struct(F.array(F.lit(p.split()[-1])).alias("keywords"), F.lit(p).alias("pattern"), F.lit(0).alias("low"), F.lit(i).alias("order"), F.lit(label).alias("label")) for i, (p, label) in enumerate(base)])
    gates = sorted({k for _, _, ks, _ in signatures for k in ks} | {p.split()[-1] for p, _ in base})

    def found(table: Column, words: Column, seen: Column) -> Column:
        tried = F.filter(table, lambda r: F.arrays_overlap(r["keywords"], seen))
        said = F.filter(tried, lambda r: F.rlike(words, F.concat(F.lit(" (?:"), r["pattern"], F.lit(") "))))
        each = lambda r: F.transform(_places(words, r["pattern"]), lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("back"), r["low"].alias("low"), r["order"].alias("order"), r["label"].alias("label")))
        return F.flatten(F.transform(said, each))

    def spans(words: Column, seen: Column) -> Column:
        own = let(F.array_sort(found(known, words, seen)), _suppressed)
        return F.array_sort(F.concat(found(first, words, seen), own))

    rows = docs.select(*keep, normal(F.col(text)).alias("__words"))
    rows = rows.withColumn("__seen", F.array_intersect(F.split("__words", " "), F.array(*map(F.lit, gates))))
    n_words = F.when(F.col("__words") == "", 0).otherwise(F.length("__words") - F.length(F.replace(F.col("__words"), F.lit(" "), F.lit(""))) + 1)
    padded = F.concat(F.lit(" "), "__words", F.lit(" "))
    all_spans = F.when(F.size("__seen") == 0, F.array().cast(_MATCH)).otherwise(let(F.struct(padded.alias("words"), F.col("__seen").alias("seen")), lambda x: spans(x["words"], x["seen"])))
    rows = rows.select(*keep, n_words.cast("long").alias("n_words"), all_spans.alias("__spans"))
    said = F.transform("__spans", lambda x: F.struct(x["start"].cast("long").alias("start"), (-x["back"]).cast("long").alias("stop"), (-x["low"]).alias("priority"), x["label"].alias("label")))
    return rows.select(*keep, "n_words", said.alias("spans"))


def summary(found: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_words, n_base, first_word, last_word (of base phrases), base_labels, labels, score, of what scan() gives."""
    base = F.filter("spans", lambda x: x["priority"] == 0)
    starts = F.transform(base, lambda x: x["start"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["label"]))), ",")
    leaves = lambda p: F.when(p == 3, LEAVES[3]).when(p == 1, LEAVES[1]).otherwise(LEAVES[2])
    said = F.array_sort(F.array_distinct(F.transform("spans", lambda x: F.struct(x["label"].alias("label"), x["priority"].alias("priority")))))
    score = 1 - F.aggregate(said, F.lit(1.0), lambda a, x: a * leaves(x["priority"]))
    return found.select(*keep, "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), names(base).alias("base_labels"), names(F.col("spans")).alias("labels"), F.round(score, 6).alias("score"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _wide(pattern: str) -> str:
    """A pattern over words with two blanks between them, so that neighbouring matches don't share one."""
    return f" (?:{pattern}) ".replace(" ", "  ")[1:-1]


def _values() -> str:
    listed = lambda ks: "[" + ", ".join(map(_quoted, ks)) + "]"
    own = [f"({i}, {p}, {_quoted(label)}, {listed(ks)}, {_quoted(_wide(x))})" for i, (label, p, ks, x) in enumerate(rules())]
    base = [f"({i}, 0, {_quoted(label)}, {listed([p.split()[-1]])}, {_quoted(_wide(p))})" for i, (p, label) in enumerate(BASE)]
    return ", ".join(base + own)


_COUNT = "list_sum([(length(x) - length(replace(x, ' ', ''))) // 2 for x in {0}])"

#: What summary(scan(documents)) gives.
SQL = f"""
WITH rules(ord, priority, label, keywords, pattern) AS (VALUES {_values()}),
docs AS (
  SELECT row_number() OVER () AS rn, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{SEPARATOR}'), lambda w: w <> '') AS words FROM documents),
wide AS (SELECT rn, words, ' ' || array_to_string(words, '  ') || ' ' AS s FROM docs),
tried AS (
  SELECT rn, ord, priority, label, string_split_regex(s, pattern) AS rest, regexp_extract_all(s, pattern) AS hits
  FROM wide JOIN rules ON list_has_any(words, keywords) AND regexp_matches(s, pattern)),
each AS (SELECT *, unnest(range(1, len(hits) + 1)) AS k FROM tried),
placed AS (
  SELECT rn, ord, priority, label, (coalesce({_COUNT.format("rest[1:k]")}, 0) + coalesce({_COUNT.format("hits[1:k-1]")}, 0))::BIGINT AS start, {_COUNT.format("hits[k:k]")}::BIGINT AS n FROM each),
kept AS (
  SELECT * FROM placed a WHERE priority = 0 OR NOT EXISTS (
    SELECT 1 FROM placed b WHERE b.rn = a.rn AND b.priority >= a.priority AND b.start <= a.start AND b.start + b.n >= a.start + a.n
      AND (b.start, -b.n, -b.priority, b.ord) < (a.start, -a.n, -a.priority, a.ord))),
marks AS (
  SELECT rn, count(*) FILTER (WHERE priority = 0) AS n_base, min(start) FILTER (WHERE priority = 0) AS first_word, max(start) FILTER (WHERE priority = 0) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE priority = 0) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM kept GROUP BY rn),
scores AS (SELECT rn, round(1 - product(CASE priority WHEN 0 THEN {LEAVES[0]} WHEN 1 THEN {LEAVES[1]} WHEN 2 THEN {LEAVES[2]} ELSE {LEAVES[3]} END), 6) AS score FROM (SELECT DISTINCT rn, label, priority FROM kept) GROUP BY rn)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM docs LEFT JOIN marks USING (rn) LEFT JOIN scores USING (rn)
"""
