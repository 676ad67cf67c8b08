"""Points of a collection: ids, vectors and payloads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import CollectionConfig, EmbedConfig
from ..shared import written

#: Narrow rows (key and number of a document) that may be sent to all tasks.
SENT_KEYS = 500_000


def _running(counted: DataFrame, order: list[Column], sums: list[str], seen: Observation | None = None) -> DataFrame:
    """Adds ``before_<c>`` for each c of sums: its total over all rows before, in the given order.

    Rows are sorted by ranges and written with their range and place. Sums within a range and the totals of the
    ranges, a row per shuffle partition, give each row its own. seen observes the totals on that write, whose tasks count once
    however often they run.
    """
    row = F.monotonically_increasing_id()  # its upper bits number the ranges, its lower 33 the rows of one
    placed = counted.orderBy(*order).withColumns({"__range": F.shiftright(row, 33), "__place": row})
    if seen is not None:
        placed = placed.observe(seen, F.sum("copies").alias("n_documents"), F.sum("ids").alias("n_chunks"))
    placed = written(placed, "numbered")
    totals = placed.groupBy("__range").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    firsts = totals.select("__range", *[(F.sum(f"__{c}").over(Window.orderBy("__range")) - F.col(f"__{c}")).alias(f"__{c}") for c in sums])
    inside = Window.partitionBy("__range").orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    added = {f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__{c}") for c in sums}
    return placed.join(F.broadcast(firsts), "__range").withColumns(added).drop("__range", "__place", *[f"__{c}" for c in sums])


def _with_first_ids(rows: DataFrame, counted: DataFrame, keys: list[str], seen: Observation | None = None) -> DataFrame:
    """rows with ``__first``, the first of each row's ids, which are dense over all rows in the order of keys.

    counted: keys, n (ids of one row), copies (rows with these keys). The numbers, a narrow row per key, are sent to the rows if they are
    at most SENT_KEYS, by a count; with more of them rows are shuffled once, by key. Rows with equal keys are told apart by sorting these rows alone.
    """
    order = [F.col(k).asc_nulls_last() for k in keys]
    counted = counted.withColumn("ids", F.col("n") * F.col("copies")).withColumn("again", F.when(F.col("copies") > 1, F.col("copies")).otherwise(0))
    numbers = written(_running(counted, order, ["ids", "again"], seen), "first-ids")
    named = numbers.select(*[F.col(k).alias(f"__k_{k}") for k in keys], "n", "again", "before_ids", "before_again")
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    few = numbers.limit(SENT_KEYS + 1).count() <= SENT_KEYS
    found = rows.join(F.broadcast(named) if few else named, on).drop(*[f"__k_{k}" for k in keys])
    left = ("n", "again", "before_ids", "before_again")
    if not numbers.where("again > 0").limit(1).count():
        return found.withColumn("__first", F.col("before_ids")).drop(*left)
    once = found.where("again = 0").withColumn("__first", F.col("before_ids"))
    repeated = _running(found.where("again > 0").withColumn("one", F.lit(1)), order, ["one"])
    copy = F.col("before_one") - F.col("before_again")
    repeated = repeated.withColumn("__first", F.col("before_ids") + copy * F.col("n")).drop("one", "before_one")
    return once.unionByName(repeated).drop(*left)


def number_chunks(documents: DataFrame, chunker: Callable[[DataFrame], DataFrame], seen: Observation | None = None) -> DataFrame:
    """doc_id, source, chunk_idx, text, id of the chunks of documents: ids 0, 1, ... in order of doc_id (null last), source, text and chunk.

    Documents are chunked twice, where they lie: once to be counted, once when each knows the first of its ids. Between these
    only a narrow row per document is shuffled (see _with_first_ids), so no chunk is. A chunker keeps further columns of documents.
    seen observes n_documents and n_chunks.
    """
    docs = documents.select("doc_id", "source", "text", F.md5("text").alias("__doc"))
    keys = ["doc_id", "source", "__doc"]
    marks = lambda rows, ids, copies: rows.select(*keys, F.lit(ids).cast("long").alias("ids"), F.lit(copies).cast("long").alias("copies"))
    counted = marks(docs, 0, 1).unionByName(marks(chunker(docs), 1, 0)).groupBy(*keys).agg(F.sum("ids").alias("ids"), F.sum("copies").alias("copies"))
    numbered = chunker(_with_first_ids(docs, counted.select(*keys, F.expr("ids div copies").alias("n"), "copies"), keys, seen))
    return numbered.select("doc_id", "source", "chunk_idx", "text", (F.col("__first") + F.col("chunk_idx")).alias("id"))


def assign_point_ids(chunks: DataFrame) -> DataFrame:
    """Adds id to any chunks: 0, 1, ... in order of doc_id (null last), source, chunk_idx and the text's MD5, whatever repeats among these.

    Where the documents are at hand, number_chunks() does with a row per document what this does with one per chunk.
    """
    keys = ["doc_id", "source", "chunk_idx", "__text"]
    rows = chunks.withColumn("__text", F.md5("text"))
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).withColumn("n", F.lit(1).cast("long"))
    return _with_first_ids(rows, counted, keys).withColumn("id", F.col("__first")).drop("__first", "__text")


def build_points(embedded: DataFrame) -> DataFrame:
    """id, vector, payload{text, source}."""
    return embedded.select("id", "vector", F.struct("text", "source").alias("payload"))


def batch_plan(points: DataFrame, per_batch: int = EmbedConfig.batch_size * CollectionConfig.upload_multiplier, per_wire: int = CollectionConfig.wire_batch) -> DataFrame:
    """batch, n_points, n_wire, first_id, last_id: contiguous upload batches, none of them empty."""
    batch = F.floor(F.col("id") / F.lit(per_batch)).alias("batch")
    sizes = points.groupBy(batch).agg(F.count(F.lit(1)).alias("n_points"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return sizes.withColumn("n_wire", F.ceil(F.col("n_points") / F.lit(per_wire)))


def one_per_id(points: DataFrame) -> DataFrame:
    """Of points with one id the one that is greatest by its other columns, compared in order."""
    others = [c for c in points.columns if c != "id"]
    return points.groupBy("id").agg(F.max(F.struct(*others)).alias("p")).select("id", "p.*").select(points.columns)


def upsert_points(old: DataFrame, new: DataFrame, group: Column | None = None, gone: DataFrame | None = None) -> DataFrame:
    """New points, one per id (see one_per_id), and old ones whose id isn't among them.

    gone: a table with one column; old points whose group is in it go too, whatever the new ones are.
    """
    left = old.join(new.select("id"), "id", "left_anti")
    if gone is not None:
        left = left.withColumn("__group", group).join(gone.toDF("__group"), "__group", "left_anti").drop("__group")
    return left.unionByName(one_per_id(new))


def invalid_vectors(points: DataFrame, dim: int) -> DataFrame:
    """id, size of the vectors that don't have dim entries (null: size -1)."""
    size = F.coalesce(F.size("vector"), F.lit(-1))
    return points.select("id", size.alias("size")).where(F.col("size") != dim)


def validate_vectors(points: DataFrame, dim: int) -> DataFrame:
    """The points; reading one with a wrong vector fails the job."""
    right = F.coalesce(F.size("vector"), F.lit(-1)) == dim
    return points.where(F.when(right, True).otherwise(F.raise_error(F.concat(F.lit("wrong vector of point "), F.col("id").cast("string"))).cast("boolean")))
