"""Secret scans with an incremental ledger of blobs.

A blob is a text, named by its SHA-256. The ledger is a folder in shared storage with one row per
blob and run that scanned it: the (rule, version) pairs and what they found. A run takes any number of paths with historical
versions. It first shuffles digests alone to see which pairs the ledger lacks, then scans texts where they
lie, just for these pairs, appends the ledger's rows in one commit, and joins findings back to every path whose
text has that blob. A rule whose version is raised is scanned again; a run over the same rows scans nothing. A run
that is broken off has no row in the ledger and is done again.

Copies are left out within each task by a bounded memory of digests; a copy that two tasks scan has equal
rows in the ledger, which count once. A hot blob so never makes a hot task: digests are combined
before they are shuffled, and findings are sent to all tasks after a count, or dealt with salts.

Rules are regular expressions over whole texts; offsets are code points, end exclusive.
Matches are leftmost and don't overlap within a rule; those that are too short are dropped.

Nulls and ties: a null text is an empty blob, ids may be null or repeated, rows may repeat; each row has its result. Very long
texts are scanned whole. Columns of docs with names that are used here (blob, spans, rule) don't clash, but kept columns must not be
named blob or spans. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

from .common import join_table, lean, new_path, slices, text_or_empty, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. group: whose length is held against ``least``; needles: one of these, lower-cased, stands in any text with a match."""

    name: str
    version: int
    pattern: str
    least: int = 0
    group: int = 0
    needles: tuple[str, ...] = ()

    def find(self, text: str, lower: str) -> list[tuple[int, int]]:
        if self.needles and not any(n in lower for n in self.needles):
            return []
        return [m.span() for m in _compiled(self.pattern).finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


_patterns: dict[str, re.Pattern] = {}


def _compiled(pattern: str) -> re.Pattern:
    return _patterns.get(pattern) or _patterns.setdefault(pattern, re.compile(pattern, re.A))


#: The base rules, in the order in which findings at one place are listed. A run of hex digits is
#: maximal as it stands, so its least length can be part of the pattern.
BASE = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, 0, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
#: Further rules: private key blocks, JSON web tokens, prefixed access tokens.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]|-(?!----))*-----END [A-Z ]*PRIVATE KEY-----", needles=("-----begin",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needles=("eyj",)),
    Rule("prefixed", 1, r"\b(?:ghp|gho|ghs|glpat|xoxb|xoxp|sk_live)[_-][A-Za-z0-9_-]{16,}", needles=("ghp", "gho", "ghs", "glpat", "xox", "sk_live")),
)
RULES = BASE + MORE


LEDGER = "blob binary, done array<string>, found array<struct<pair: string, start: bigint, stop: bigint>>"
#: Digests that a task remembers.
SEEN = 200_000


def blob_of(text: str) -> Column:
    return F.unhex(F.sha2(text_or_empty(text), 256))


def ledger_rows(spark: SparkSession, ledger: str) -> DataFrame:
    """blob, done, found: what runs have added; empty where there is no ledger yet."""
    kind = StructType.fromDDL(LEDGER)
    try:
        spark.read.parquet(ledger).limit(0).collect()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(ledger)


def scanned_pairs(spark: SparkSession, ledger: str) -> DataFrame:
    """blob, pair (rule:version) of all that has been scanned."""
    return ledger_rows(spark, ledger).select("blob", F.explode("done").alias("pair")).distinct()


def names_of(rules: tuple[Rule, ...]) -> list[str]:
    return [f"{r.name}:{r.version}" for r in rules]


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, text: str = "text") -> None:
    """Brings the ledger up to date with the texts of docs."""
    names = names_of(rules)
    everything = F.array(*[F.lit(n) for n in names])
    known = ledger_rows(docs.sparkSession, ledger)
    texts = docs.select(blob_of(text).alias("blob"), text_or_empty(text).alias("text"))
    if known.limit(1).count():
        mine = docs.select(blob_of(text).alias("blob")).distinct()
        done = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("done"))).alias("done"))
        lacks = mine.join(done, "blob", "left").select("blob", F.array_except(everything, F.coalesce("done", F.array().cast("array<string>"))).alias("todo"))
        lacks = written(lacks.where(F.size("todo") > 0), "secret-lacks")
        texts = join_table(texts, lacks, ["blob"], "inner")  # only what is unseen goes on
    else:
        texts = texts.withColumn("todo", everything)
    by_name = dict(zip(names, rules, strict=True))
    arrow = pa.schema([("blob", pa.binary()), ("done", pa.list_(pa.string())), ("found", pa.list_(pa.struct([("pair", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))])

    def run(batches):
        lean()
        seen: set[bytes] = set()
        for batch in (part for whole in batches for part in slices(whole)):
            out = {"blob": [], "done": [], "found": []}
            for name, value, pairs in zip(batch.column("blob").to_pylist(), batch.column("text"), batch.column("todo").to_pylist(), strict=True):
                if name[:16] in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(name[:16])
                body = value.as_py()
                lower = body.lower()
                out["blob"].append(name)
                out["done"].append(pairs)
                out["found"].append([{"pair": p, "start": a, "stop": b} for p in pairs for a, b in by_name[p].find(body, lower)])
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    texts.select("blob", "text", "todo").mapInArrow(run, LEDGER).write.mode("append").parquet(ledger)


def spans_by_blob(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob, spans: array of (start, place, rule, stop) in order, of the given rule versions; blobs without findings are left out."""
    names = names_of(rules)
    place = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    rule = F.create_map(*[x for n, r in zip(names, rules, strict=True) for x in (F.lit(n), F.lit(r.name))])
    found = ledger_rows(spark, ledger).where(F.size("found") > 0).select("blob", F.explode("found").alias("f")).where(F.col("f.pair").isin(*names))
    span = F.struct(F.col("f.start").alias("start"), place[F.col("f.pair")].alias("place"), rule[F.col("f.pair")].alias("rule"), F.col("f.stop").alias("stop"))
    return found.groupBy("blob").agg(F.sort_array(F.collect_set(span)).alias("spans"))


def scan_rows(docs: DataFrame, keep: list[str], ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """keep, blob, spans of every row, after its texts are in the ledger; spans is empty where nothing was found."""
    ledger = ledger or new_path(docs.sparkSession, "secret-ledger")
    scan(docs, ledger, rules, text)
    found = written(spans_by_blob(docs.sparkSession, ledger, rules), "secret-spans")
    kind = found.schema["spans"].dataType.simpleString()
    out = join_table(docs.select(*keep, blob_of(text).alias("blob")), found, ["blob"], weight=F.size("spans"))
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(kind)))


#: What stands in place of a secret.
REDACTED = "[REDACTED]"


def redact(docs: DataFrame, ledger: str | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """docs with every span of a secret replaced; overlapping spans become one. length: column with the text's length, if there is one."""
    ledger = ledger or new_path(docs.sparkSession, "secret-ledger")
    scan(docs, ledger, rules, text)
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["stop"].alias("b")))
    found = written(spans_by_blob(docs.sparkSession, ledger, rules).select(F.col("blob").alias("__blob"), spans.alias("__spans")), "secret-spans")
    joined = join_table(docs.withColumn("__blob", blob_of(text)), found, ["__blob"], weight=F.size("__spans")).drop("__blob")
    schema = StructType([f for f in joined.schema.fields if f.name != "__spans"])

    def clean(body: str, spans) -> str:
        out, at = [], 0
        for s in spans:
            if s["a"] >= at:
                out += [body[at : s["a"]], REDACTED]
            at = max(at, s["b"])
        return "".join([*out, body[at:]])

    def run(batches):
        lean()
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [clean(t.as_py(), s.as_py()) if s.is_valid else t.as_py() for t, s in zip(batch.column(text), batch.column("__spans"), strict=True)]
            columns = {n: batch.column(n) for n in schema.names}
            columns[text] = pa.array(texts, columns[text].type)
            if length in columns:
                columns[length] = pa.array([old if not s.is_valid else len(t) for old, t, s in zip(columns[length].to_pylist(), texts, batch.column("__spans"), strict=True)], columns[length].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return joined.mapInArrow(run, schema)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
