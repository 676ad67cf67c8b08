"""Quality classifier: an interpolated modified Kneser-Ney model of character n-grams.

The model is trained on all trusted texts (those labelled good, but for a fifth of them by
hash, which calibrate the thresholds). Counts are sums by n-gram, made in the tasks by
block and added up in a shuffle by n-gram; lower orders are continuation counts, that is,
numbers of distinct longer n-grams. Each order's probabilities come from a join with its
contexts' weights and one with the next lower order, both sharded by n-gram. The result is a table of
log probabilities and back-off weights, written in shards by a hash of the two characters before the last
one, since all that a position needs beyond bigrams lies in the shard of its two previous characters. Bigrams, and contexts of one
character, are a shard of their own that every task holds; their number is that of pairs of characters that occur, so it hardly grows
with the corpus. No single character, as the space, so fills a shard; the rows of one pair of characters do stay together.

Texts meet the trusted ids for training only, without those held back; the held-back ones meet them when they are scored, as narrow rows.
Scoring reads the documents once. Tasks hold the shards they have read, up to HELD_BYTES or one shard (some 24 bytes a row, SHARD_ROWS rows
on average), ask those first, and read the others again for each slice of texts. It is no join of the documents' n-grams
with the model: that would shuffle some 1,900 rows per document (README). A document's
perplexity is exp of the mean negative log probability of its characters. A document is
kept if that is at most the threshold of its language: the QUANTILE quantile of the held-back
trusted texts in it, times SLACK; languages with fewer than LEAST of them share the quantile of all.

Nulls and ties: a null text is an empty one; empty texts have no perplexity and are not kept. A
null language is a language of its own. Repeated labels count once, repeated rows as often as they
stand there. Very long texts are counted and scored whole, in blocks. Columns besides doc_id, text and lang may have any names.
Without trusted texts nothing has a perplexity. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import OrderedDict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hold, join_table, map_rows, new_path, open_fs, with_fields, written

ORDER, PAD = 5, "\x02"
#: Characters that are counted or scored at once.
BLOCK = 1 << 20
SHARD_ROWS, HELD_BYTES = 2_000_000, 256 << 20
QUANTILE, SLACK, LEAST = 0.99, 1.1, 50
_MUL = np.uint64(0x9E3779B97F4A7C15)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, ORDER - 1 pads before each, and which of them are characters of a text."""
    joined = "".join(PAD * (ORDER - 1) + t for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    real = np.ones(len(points), bool)
    starts = np.cumsum([0, *(len(t) + ORDER - 1 for t in texts)])[:-1]
    real[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return points, real


def hashes(points: np.ndarray, n: int) -> np.ndarray:
    """Key of the n-gram that ends at each position; the first n - 1 positions are meaningless."""
    h = np.full(len(points), n, np.uint64)
    wide = points.astype(np.uint64)
    with np.errstate(over="ignore"):
        for back in range(n - 1, -1, -1):
            c = wide if not back else np.concatenate([np.zeros(min(back, len(wide)), np.uint64), wide[:-back]])
            h = (h + c + np.uint64(1)) * _MUL
            h ^= h >> np.uint64(29)
    return h


def keys_of(grams: list[str]) -> np.ndarray:
    """Keys of n-grams of any lengths, the same as hashes() gives; 0 for an empty one."""
    size, out = np.array([len(g) for g in grams]), np.zeros(len(grams), np.uint64)
    for n in set(size.tolist()) - {0}:
        own = np.flatnonzero(size == n)
        points = np.frombuffer("".join(grams[i] for i in own).encode("utf-32-le", "replace"), np.uint32)
        out[own] = hashes(points, n)[n - 1 :: n]
    return out.view(np.int64)


def gram_counts(docs: DataFrame, text: str) -> DataFrame:
    """gram, n: all n-grams of the highest order."""

    def run(batches):
        schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

        def counted(texts):
            joined = "".join(PAD * (ORDER - 1) + t for t in texts)
            points, real = codes(texts)
            at = np.flatnonzero(real)
            _, first, n = np.unique(hashes(points, ORDER)[at], return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array([joined[i - ORDER + 1 : i + 1] for i in at[first].tolist()], pa.string()), pa.array(n, pa.int64())], schema=schema)

        for batch in batches:
            held, size = [], 0
            for value in batch.column(text):
                body = value.as_py() or ""
                held.append(body[:BLOCK])
                size += len(held[-1])
                for i in range(BLOCK, len(body), BLOCK):  # a long text goes on with its own last characters
                    yield counted_inside(body[i - ORDER + 1 : i + BLOCK], schema)
                if size >= BLOCK:
                    yield counted(held)
                    held, size = [], 0
            if held:
                yield counted(held)

    return docs.select(text).mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def counted_inside(part: str, schema: pa.Schema) -> pa.RecordBatch:
    """The n-grams that lie wholly in a block."""
    points = np.frombuffer(part.encode("utf-32-le", "replace"), np.uint32)
    at = np.arange(ORDER - 1, len(points))
    _, first, n = np.unique(hashes(points, ORDER)[at], return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array([part[i - ORDER + 1 : i + 1] for i in at[first].tolist()], pa.string()), pa.array(n, pa.int64())], schema=schema)


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and 3 or more."""
    ones = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n = [ones[f"n{i}"] for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.1), i - 0.1) if n[i - 1] else i / 2 for i in (1, 2, 3)]


def model_table(grams: DataFrame) -> DataFrame:
    """gram, value, kind: log probabilities (kind 0) and log back-off weights of contexts (kind 1)."""
    order = {ORDER: written(grams, "kn-counts")}
    for n in range(ORDER - 1, 0, -1):
        tail = order[n + 1].groupBy(F.right("gram", F.lit(n)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        order[n] = written(tail, "kn-counts")
    parts, below = [], None
    for n in range(1, ORDER + 1):
        d = discounts(order[n])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = order[n].withColumn("off", off).withColumn("context", F.left("gram", F.lit(n - 1)))
        weights = rows.groupBy("context").agg(F.sum("n").alias("all"), F.sum("off").alias("freed"))
        weights = written(weights.select("context", "all", (F.col("freed") / F.col("all")).alias("gamma")), "kn-contexts")
        rows = rows.join(weights, "context")
        if below is None:
            lower = F.lit(1.0) / F.lit(float(order[1].count() + 1))
        else:
            rows = rows.join(below, F.right(F.col("gram"), F.lit(n - 1)) == F.col("shorter"))
            lower = F.col("lower")
        p = (F.col("n") - F.col("off")) / F.col("all") + F.col("gamma") * lower
        table = written(rows.select("gram", p.alias("p")), "kn-order")
        below = table.select(F.col("gram").alias("shorter"), F.col("p").alias("lower"))
        parts += [table.select("gram", F.log("p").alias("value"), F.lit(0).alias("kind")), weights.select(F.col("context").alias("gram"), F.log("gamma").alias("value"), F.lit(1).alias("kind"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def publish(table: DataFrame, shard_rows: int = SHARD_ROWS) -> dict:
    """Writes the model in shards; gives what readers need: path, number of shards, unigram floor."""
    n_rows = table.count()
    shards = max(1, math.ceil(n_rows / shard_rows))
    path = new_path(table.sparkSession, "kn-model")

    def run(batches):
        for batch in batches:
            grams, kinds = batch.column("gram").to_pylist(), batch.column("kind").to_pylist()
            previous = [(g[-3:-1] if k == 0 else g[-2:]) for g, k in zip(grams, kinds, strict=True)]
            pairs = np.array([len(p) == 2 for p in previous], bool)
            shard = np.full(len(grams), -1, np.int32)
            shard[pairs] = keys_of([p for p in previous if len(p) == 2]).view(np.uint64) % np.uint64(shards)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(shard, pa.int32()), "kind": pa.array(kinds, pa.int32()), "key": pa.array(keys_of(grams), pa.int64()), "value": batch.column("value").cast(pa.float64())})

    keyed = table.mapInArrow(run, "shard int, kind int, key long, value double")
    # rows of shard -1 (bigrams, single characters, contexts of one or none) are needed everywhere
    keyed.repartition("shard", F.pmod("key", F.lit(16))).sortWithinPartitions("shard").write.partitionBy("shard").parquet(path)
    vocabulary = table.where((F.col("kind") == 0) & (F.length("gram") == 1)).count()
    floor = table.where((F.col("kind") == 1) & (F.col("gram") == "")).first()
    unknown = -math.log(vocabulary + 1) + (floor["value"] if floor else 0.0)
    return {"path": path, "shards": shards, "unknown": unknown, "rows": n_rows}


class Lookup:
    """Exact look-up of 64-bit keys: sorted, with a directory on their first bits."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        keys = keys.view(np.uint64)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length() + 1))
        slots = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.uint64)
        self.start = np.searchsorted(self.keys >> self.shift, slots).astype(np.int64)
        self.bytes = self.keys.nbytes + self.values.nbytes + self.start.nbytes

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Values, nan where a key isn't there."""
        out = np.full(len(wanted), np.nan)
        if not len(self.keys):
            return out
        slot = (wanted >> self.shift).astype(np.int64)
        at, end = self.start[slot], self.start[slot + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        while len(left):
            hit = self.keys[at] == wanted[left]
            out[left[hit]] = self.values[at[hit]]
            go = ~hit & (at + 1 < end)
            left, at, end = left[go], at[go] + 1, end[go]
        return out


class Reader:
    """Shards of a published model, held up to HELD_BYTES or one of them, and the one that is needed everywhere."""

    def __init__(self, info: dict):
        self.info, self.held = info, OrderedDict()
        self.fs, self.path = open_fs(info["path"])
        self.short = self._read(-1)

    def shard(self, i: int) -> tuple[Lookup, Lookup]:
        if i in self.held:
            self.held.move_to_end(i)
        else:
            self.held[i] = self._read(i)
            while len(self.held) > 1 and sum(x.bytes for pair in self.held.values() for x in pair) > HELD_BYTES:
                self.held.popitem(last=False)
        return self.held[i]

    def _read(self, i: int) -> tuple[Lookup, Lookup]:
        folder = f"{self.path}/shard={i}"
        rows = []
        if self.fs.get_file_info(folder).type != pafs.FileType.NotFound:
            for f in self.fs.get_file_info(pafs.FileSelector(folder)):
                if f.base_name.endswith(".parquet"):
                    with self.fs.open_input_file(f.path) as file:
                        rows.append(pq.ParquetFile(file).read(columns=["kind", "key", "value"]))
        table = pa.concat_tables(rows) if rows else pa.table({"kind": pa.array([], pa.int32()), "key": pa.array([], pa.int64()), "value": pa.array([], pa.float64())})
        kind, key, value = (table[c].to_numpy() for c in ("kind", "key", "value"))
        return tuple(Lookup(key[kind == k].astype(np.int64), value[kind == k]) for k in (0, 1))

    def log_probs(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log probability of the character at each of the given positions."""
        out = np.full(len(at), np.nan)
        keys: dict[int, np.ndarray] = {}

        def key(n: int) -> np.ndarray:
            if n not in keys:
                keys[n] = hashes(points, n)
            return keys[n]

        shard_of = (key(2)[at - 1] % np.uint64(self.info["shards"])).astype(np.int64)
        for i in sorted(set(shard_of.tolist()), key=lambda i: (i not in self.held, i)):
            own = np.flatnonzero(shard_of == i)
            long = self.shard(i)
            backed = np.zeros(len(own))
            for n in range(ORDER, 1, -1):
                found = (long if n > 2 else self.short)[0](key(n)[at[own]])
                hit = ~np.isnan(found)
                out[own[hit]] = found[hit] + backed[hit]
                own, backed = own[~hit], backed[~hit]
                if not len(own):
                    break
                backed = backed + np.nan_to_num((long if n > 2 else self.short)[1](key(n - 1)[at[own] - 1]))
            else:
                found = self.short[0](key(1)[at[own]])
                out[own] = np.where(np.isnan(found), self.info["unknown"], found) + backed
        return out

    def totals(self, texts: list[str]) -> list[float]:
        """Sum of log probabilities of each text."""
        sums, held, size = [0.0] * len(texts), [], 0

        def flush() -> None:
            if not held:
                return
            points, real = codes([t for _, t in held])
            at = np.flatnonzero(real)
            lp = self.log_probs(points, at) if len(at) else np.empty(0)
            ends = np.cumsum([len(t) for _, t in held])
            done = np.concatenate([[0.0], np.cumsum(lp)])
            for (i, t), end in zip(held, ends, strict=True):
                sums[i] += done[end] - done[end - len(t)]
            held.clear()

        for i, text in enumerate(texts):
            if len(text) > BLOCK:
                flush()
                size = 0
                points, real = codes([text])
                at = np.flatnonzero(real)
                sums[i] = float(sum(self.log_probs(points[max(0, a - ORDER) : a + BLOCK], np.arange(min(a, ORDER), min(a, ORDER) + len(at[a - ORDER + 1 : a - ORDER + 1 + BLOCK]))).sum() for a in range(ORDER - 1, len(points), BLOCK)))
                continue
            held.append((i, text))
            size += len(text)
            if size >= BLOCK:
                flush()
                size = 0
        flush()
        return sums


def reader_of(info: dict) -> Reader:
    return hold(("kn", info["path"]), lambda: Reader(info))


def with_perplexity(docs: DataFrame, info: dict, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_chars_scored, perplexity (null for an empty text)."""

    def make():
        reader = reader_of(info)

        def step(batch):
            texts = [t.as_py() or "" for t in batch.column(text)]
            sums = reader.totals(texts)
            return {"n_chars_scored": [len(t) for t in texts], "perplexity": [math.exp(min(-s / len(t), 700)) if t else None for s, t in zip(sums, texts, strict=True)]}

        return step

    return map_rows(docs.select(*dict.fromkeys([*keep, text])), with_fields(docs, keep, "n_chars_scored long, perplexity double"), make)


def held_back(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(5)) == 0


def classify(docs: DataFrame, trusted: DataFrame, text: str = "text", lang: str = "lang", quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """doc_id, lang, n_chars_scored, perplexity, threshold, keep of every row. trusted: doc_id of trusted texts."""
    names = written(trusted.select("doc_id").where("doc_id is not null").distinct(), "kn-trusted")
    rows = docs.select("doc_id", F.col(lang).alias("lang"), F.col(text).alias("text"))
    train = join_table(rows.where(F.col("doc_id").isNotNull() & ~held_back()).select("doc_id", "text"), names, ["doc_id"], "left_semi")
    info = publish(model_table(gram_counts(train, "text")))
    scored = written(with_perplexity(rows, info, ["doc_id", "lang"]), "kn-scored")
    if not info["rows"]:
        return scored.select("doc_id", "lang", "n_chars_scored", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("keep"))
    of_trusted = lambda some: join_table(some.where("perplexity is not null"), names, ["doc_id"], "left_semi")
    held = written(of_trusted(scored.where(held_back())), "kn-held")
    level = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    overall = held.agg(level.alias("t")).first()["t"]
    if overall is None:
        overall = of_trusted(scored).agg(level.alias("t")).first()["t"]
    by_lang = held.groupBy("lang").agg(level.alias("__t"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= LEAST).select("lang", "__t")
    out = join_table(scored, written(by_lang, "kn-thresholds"), ["lang"])
    out = out.withColumn("threshold", F.coalesce("__t", F.lit(overall).cast("double")) * slack)
    keep = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return out.select("doc_id", "lang", "n_chars_scored", "perplexity", "threshold", keep.alias("keep"))
