"""Mixing sources to target weights, with DataFrame functions only.

Each row has a 40-bit key, a hash of its id and text. A source with ``size`` words and a target
of ``whole * size + rest`` words takes each row ``whole`` times, and the rows with keys
below a threshold once more. The threshold comes from nested histograms: words by source
and the first 10 bits of the key show in which bucket the running sum passes ``rest``;
only the rows of that bucket are counted again by the next 10 bits, and so on. No rows
are sorted and none are collected: a level shuffles at most 1,024 sums per source and
task, as partial sums come first.

Nulls and ties: a null text has size 0, a null source is a source of its own (last), a
null id or text counts as an empty string in the key. Repeated rows with the same id and text have the same key
and so share their fate; the last cell is taken if that brings the source nearer to its
target. Words of texts of any length are counted in the JVM. An empty table gives an empty result. Columns named like the results (``size``,
``source_size``, ``target``, ``taken``) are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_table, written

#: Bits of the key, and bits that one level of the histograms looks at.
KEY_BITS, LEVEL_BITS = 40, 10
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """One row per source: source_size, target, whole, rest.

    sizes: source, size. Sources in code-point order, null last, take the weights in
    turn and share ``share`` of all words; a target stops at ``cap`` times its source,
    and what is over is shared again by weight. In order of cap / weight the sources that
    stop come first, so running sums say which they are. These windows see one row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = by_source.select("source", "source_size", rank.alias("rank"), weight.cast("long").alias("weight"), (F.col("source_size") * cap).alias("most"))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    ranked = ranked.withColumn("stopped", F.coalesce(F.sum("most").over(before), F.lit(0))).withColumn("open", F.sum("weight").over(after))
    ranked = ranked.withColumn("stops", (F.col("total") - F.col("stopped")) / F.col("open") * F.col("weight") >= F.col("most"))
    ranked = ranked.withColumn("taken_up", F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(everything), F.lit(0)))
    ranked = ranked.withColumn("left", F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything))
    target = F.when(F.col("stops"), F.col("most").cast("double")).otherwise(F.col("weight") * (F.col("total") - F.col("taken_up")) / F.col("left"))
    whole = F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long")
    ranked = ranked.withColumn("target", target).withColumn("whole", whole)
    return ranked.select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def thresholds(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds ``below`` to the plan: rows with keys below it are taken once more.

    sizes: source, key, size; both tables written already.
    """
    state = plan.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(KEY_BITS // LEVEL_BITS):
        rows = join_table(sizes, state, ["source"], "inner")
        if level:
            rows = rows.where(F.shiftright("key", KEY_BITS - LEVEL_BITS * level) == F.col("prefix"))
        cell = F.shiftright("key", KEY_BITS - LEVEL_BITS * (level + 1))
        bars = rows.groupBy("source", "rest", "before", cell.alias("cell")).agg(F.sum("size").alias("bar"))
        upto = F.col("before") + F.sum("bar").over(Window.partitionBy("source").orderBy("cell"))
        bars = bars.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("bar") <= F.col("rest")))
        state = written(bars.select("source", "rest", F.col("cell").alias("prefix"), (F.col("upto") - F.col("bar")).alias("before"), "bar"), "mix-level")
        if level < KEY_BITS // LEVEL_BITS - 1:
            state = state.drop("bar")
    over = F.col("before") + F.col("bar") - F.col("rest")
    takes = (F.col("before") < F.col("rest")) & (over <= F.col("rest") - F.col("before"))
    edges = state.select("source", (F.col("prefix") + takes.cast("long")).alias("below"))
    return written(join_table(plan, edges, ["source"]).withColumn("below", F.coalesce("below", F.lit(0))), "mix-plan")


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, size, key) of all rows, and the plan with thresholds by source."""
    sizes = written(docs.select("doc_id", "source", words().alias("size"), key_of().alias("key")), "mix-sizes")
    plan = written(targets(sizes, weights, share, cap), "mix-targets")
    return sizes, thresholds(sizes, plan)


def copies() -> Column:
    return F.col("whole") + (F.col("key") < F.col("below")).cast("long")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies."""
    sizes, plan = plan_mix(docs, **options)
    out = join_table(sizes, plan, ["source"]).withColumn("copies", copies())
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows: every row as often as the mix takes it, with the columns of docs."""
    _, plan = plan_mix(docs, **options)
    edge = plan.select("source", F.col("whole").alias("__whole"), F.col("below").alias("__below"))
    out = join_table(docs, edge, ["source"])
    n = F.col("__whole") + (key_of() < F.col("__below")).cast("long")
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*docs.columns)


#: DuckDB: the same targets, and per source the rows in key order until the running sum
#: passes the rest; the cell at the edge is taken if that is nearer.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 10))::BIGINT AS key
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2 * source_size AS most, (sum(source_size) OVER ())::DOUBLE * 1.5 AS total,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
  FROM by_source),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM ranked),
running AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS stopped,
         (sum(weight) OVER (ORDER BY most::DOUBLE / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS open_weight
  FROM weighed),
stops AS (SELECT *, (total - stopped) / open_weight * weight >= most AS stop FROM running),
shared AS (
  SELECT *, coalesce(sum(CASE WHEN stop THEN most END) OVER (), 0)::DOUBLE AS taken_up,
         (sum(CASE WHEN NOT stop THEN weight END) OVER ())::DOUBLE AS left_weight
  FROM stops),
plan AS (
  SELECT source, source_size, CASE WHEN stop THEN most::DOUBLE ELSE weight * (total - taken_up) / left_weight END AS target FROM shared),
rests AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM plan),
placed AS (
  SELECT s.doc_id, s.size, s.source, s.key, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.key) AS cell
  FROM sized s JOIN rests p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN upto <= rest OR (upto - cell < rest AND upto - rest <= rest - (upto - cell)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
