"""An inverted file that is stored with a collection, and searches that read only the cells they visit.

``index/i/centres`` holds a row per k-means cell; ``index/i/cells/version=v/cell=c`` the ids and vectors of a
cell, with the partition and the version of the collection that they come from. A write to the collection adds the
entries of its new version; entries whose partition has a newer one are left out when cells are read, by the manifest
that the collection's pointer names, so index and points change in one step. build_index() fits anew and drops them.

A search fits nothing: it reads the centres (at most FIT_ROWS / 40, so a few MB), finds each question's cells, and
reads those cells alone, as the cell is a partition column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SearchConfig
from . import search
from .collections import _new, commit, live_parts, live_points, own_properties

ENTRIES = "id BIGINT, vector ARRAY<FLOAT>, part BIGINT, made STRING, version STRING, cell INT"


def _write_cells(points: DataFrame, centres: np.ndarray, path: str) -> None:
    """points: id, vector, part, made. A large cell becomes several files, small ones share a task."""
    found = search.with_cells(points, centres, 1)
    found.hint("rebalance", F.col("cell")).write.partitionBy("cell").parquet(path)


def build_index(spark: SparkSession, name: str, config: SearchConfig = SearchConfig(), centres: np.ndarray | None = None) -> None:
    """Fits cells (unless centres are given) and the number of probes on samples, stores all points by cell, and swaps the collection's pointer."""
    held = own_properties(spark, name)
    points = live_points(spark, name).where("vector is not null")
    if centres is None:
        centres = search.fit_cells(points, config.nlist)
    if not centres.shape[1]:
        return  # no points; searches stay exact
    nprobe = config.nprobe or search.fit_probes(points, centres, config.top_k + config.overfetch_k, held["distance"], config.recall)
    index = _new("i")
    path = f"{held['root']}/index/{index}"
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{path}/centres")
    _write_cells(points.select("id", "vector", "part", F.col("version").alias("made")), centres, f"{path}/cells/version={index}")
    commit(spark, name, held, {"index": index, "nprobe": str(nprobe)})


def read_centres(spark: SparkSession, held: dict[str, str]) -> np.ndarray:
    rows = spark.read.schema("cell int, centre array<double>").parquet(f"{held['root']}/index/{held['index']}/centres").orderBy("cell").collect()
    return np.array([r["centre"] for r in rows], np.float64)


def add_version(spark: SparkSession, held: dict[str, str], version: str, points: DataFrame) -> None:
    """Entries of a version that the collection's next manifest will name."""
    rows = points.where("vector is not null").select("id", "vector", "part", F.lit(version).alias("made"))
    _write_cells(rows, read_centres(spark, held), f"{held['root']}/index/{held['index']}/cells/version={version}")


def entries(spark: SparkSession, held: dict[str, str], cells: list[int]) -> DataFrame:
    """id, vector, cell of the live points in some cells."""
    stored = spark.read.schema(ENTRIES).parquet(f"{held['root']}/index/{held['index']}/cells").where(F.col("cell").isin(cells))
    live = live_parts(spark, held).select(F.col("part").alias("__part"), F.col("version").alias("__version"))  # a row per partition
    same = (F.col("part") == F.col("__part")) & (F.col("made") == F.col("__version"))
    return stored.join(F.broadcast(live), same, "left_semi").select("id", "vector", "cell")


def knn_stored(queries: DataFrame, name: str, k: int = 5, nprobe: int | None = None) -> DataFrame:
    """As knn_exact over the points of a collection: by its inverted file if it has one, else exactly."""
    spark = queries.sparkSession
    held = own_properties(spark, name)
    if "index" not in held:
        return search.knn_exact(queries, live_points(spark, name).select("id", "vector"), k, held["distance"])
    centres = read_centres(spark, held)
    asked = search.written(search.with_cells(queries.select("query_id", "vector"), centres, min(nprobe or int(held["nprobe"]), len(centres))), "asked-cells")
    visited = sorted(r["cell"] for r in asked.select("cell").distinct().collect())  # at most all cells
    return search.meet_in_cells(entries(spark, held, visited), asked, k, held["distance"])


def _of_hits(spark: SparkSession, name: str, hits: DataFrame) -> DataFrame:
    """The live points of the partitions that hold hits; hits must be written."""
    held = own_properties(spark, name)
    parts = hits.select(F.floor(F.col("id") / F.lit(int(held["part_ids"]))).cast("long").alias("part")).distinct().collect()  # at most all partitions
    return live_points(spark, name).where(F.col("part").isin([r["part"] for r in parts]))


def overfetch_stored(queries: DataFrame, name: str, config: SearchConfig = SearchConfig()) -> DataFrame:
    """Takes overfetch_k hits more from a collection's cells, scores them by the vectors that its partitions hold, and keeps top_k."""
    spark = queries.sparkSession
    found = search.written(knn_stored(queries, name, config.top_k + config.overfetch_k, config.nprobe), "stored-hits")
    return search.rescore(found, queries, _of_hits(spark, name, found), config.top_k, own_properties(spark, name)["distance"])


def payloads(spark: SparkSession, name: str, hits: DataFrame) -> DataFrame:
    """query_id, rank, id, score, text, source of hits, read from the partitions that hold them."""
    hits = search.written(hits, "stored-hits")
    return search.project_payload(hits, _of_hits(spark, name, hits))
