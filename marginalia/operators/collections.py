"""Collections of points in versions behind one pointer.

A collection is a view of the catalog. Its folder, beside the tables of the database, holds

- ``points/version=v/part=p``: the points of one partition (``part_ids`` consecutive ids) as one write left them,
- ``manifests/c``: which version of each partition is live, a row per partition,
- ``index/i``: an inverted file, see ``index``.

A write makes a version of the partitions that it touches and a manifest, both under names that
nothing refers to, and then replaces the view, which names the manifest: that is the one step that readers
see. A write that breaks off anywhere leaves the old state and some files without a reference, which the
next write removes. Versions that a manifest before the last one named are removed too, so a reader that
began before a write can end. One writer at a time; one that finds another manifest than it began with fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import CollectionConfig, Config
from ..shared import discard, hadoop_fs, written
from .chunk import chunk_recursive
from .embed import embed_dense
from .points import build_points, number_chunks, one_per_id, upsert_points, validate_vectors

SCHEMA = "id BIGINT, vector ARRAY<FLOAT>, payload STRUCT<text: STRING, source: STRING>"
MANIFEST = "part BIGINT, version STRING, n_points BIGINT"
#: Nothing has this partition; its file says the schema of a collection without points.
NO_PART = -(1 << 62)


def _new(prefix: str) -> str:
    return prefix + uuid.uuid4().hex


def collection_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r["key"]: r["value"] for r in spark.sql(f"SHOW TBLPROPERTIES `{name}`").collect()}


def list_collections(spark: SparkSession) -> list[str]:
    """Names of the collections among the views of the current database."""
    views = [t.name for t in spark.catalog.listTables() if t.tableType == "VIEW" and not t.isTemporary]
    return sorted(v for v in views if "root" in (p := properties(spark, v)) and "dim" in p)


def drop_collection(spark: SparkSession, config: CollectionConfig) -> bool:
    """Drops an existing collection if rebuilding is on; tells whether it did."""
    if not config.rebuild or not collection_exists(spark, config.name):
        return False
    root = properties(spark, config.name)["root"]
    spark.sql(f"DROP VIEW `{config.name}`")
    fs, at = hadoop_fs(spark, root)
    fs.delete(at, True)
    return True


def _live_sql(held: dict[str, str], columns: str) -> str:
    return (
        f"SELECT {columns} FROM parquet.`{held['root']}/points` p LEFT SEMI JOIN parquet.`{held['root']}/manifests/{held['manifest']}` m "
        "ON p.part = m.part AND p.version = m.version AND m.n_points > 0"
    )


def _publish(spark: SparkSession, name: str, held: dict[str, str]) -> None:
    """Swaps the pointer."""
    said = ", ".join(f"'{k}' = '{v}'" for k, v in sorted(held.items()))
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` TBLPROPERTIES ({said}) AS {_live_sql(held, 'p.id, p.vector, p.payload, p.part')}")


def live_points(spark: SparkSession, name: str) -> DataFrame:
    """id, vector, payload, part, version of a collection."""
    return spark.sql(_live_sql(properties(spark, name), "p.id, p.vector, p.payload, p.part, p.version"))


def live_parts(spark: SparkSession, held: dict[str, str]) -> DataFrame:
    """part, version, n_points of the live partitions."""
    return spark.read.schema(MANIFEST).parquet(f"{held['root']}/manifests/{held['manifest']}")


def create_collection(spark: SparkSession, config: CollectionConfig) -> bool:
    """Creates the collection where there is none; tells whether it did."""
    if collection_exists(spark, config.name):
        return False
    base = spark.catalog.getDatabase(spark.catalog.currentDatabase()).locationUri.rstrip("/")
    held = {"dim": str(config.dim), "distance": config.distance, "part_ids": str(config.part_ids), "root": f"{base}/{_new(config.name + '-')}", "manifest": _new("c")}
    spark.createDataFrame([], SCHEMA).write.parquet(f"{held['root']}/points/version=v/part={NO_PART}")
    spark.createDataFrame([], MANIFEST).write.parquet(f"{held['root']}/manifests/{held['manifest']}")
    _publish(spark, config.name, held)
    return True


def own_properties(spark: SparkSession, name: str) -> dict[str, str]:
    """The properties that this library set."""
    names = ("dim", "distance", "part_ids", "root", "manifest", "before", "index", "nprobe")
    return {k: v for k, v in properties(spark, name).items() if k in names}


def commit(spark: SparkSession, name: str, before: dict[str, str], changes: dict[str, str], live: DataFrame | None = None) -> None:
    """Writes the manifest (live, or as it was), swaps the pointer, and removes what no reader can need."""
    held = before | changes
    if live is not None:
        held |= {"manifest": _new("c"), "before": before["manifest"]}
        live.coalesce(1).write.parquet(f"{held['root']}/manifests/{held['manifest']}")
    if own_properties(spark, name) != before:
        raise RuntimeError(f"another write to {name} came in between")
    _publish(spark, name, held)
    _clean(spark, held, before.get("index"))


def _children(fs, at) -> list:
    return [s.getPath() for s in fs.listStatus(at)] if fs.exists(at) else []


def _clean(spark: SparkSession, held: dict[str, str], index_before: str | None) -> None:
    """Removes partitions that neither the live manifest nor the one before names, and other manifests and indexes."""
    fs, root = hadoop_fs(spark, held["root"])
    path = lambda *x: hadoop_fs(spark, "/".join([held["root"], *x]))[1]
    manifests = {held["manifest"], held.get("before", held["manifest"])}
    pairs = {(r["version"], r["part"]) for m in manifests for r in live_parts(spark, held | {"manifest": m}).collect()} | {("v", NO_PART)}  # a row per partition
    versions = {v for v, _ in pairs}
    for at in _children(fs, path("points")):
        version = at.getName().removeprefix("version=")
        if version not in versions:
            fs.delete(at, True)
            continue
        for part in _children(fs, at):
            if part.getName().startswith("part=") and (version, int(part.getName()[5:])) not in pairs:
                fs.delete(part, True)
    for folder, kept in (("manifests", manifests), ("index", {held.get("index"), index_before})):
        for at in _children(fs, path(folder)):
            if at.getName() not in kept:
                fs.delete(at, True)


def write_points(spark: SparkSession, config: CollectionConfig, points: DataFrame, per_file: int, group: Column | None = None, gone: DataFrame | None = None, unique: bool = False, seen: Observation | None = None) -> None:
    """Upserts points, and takes out old ones whose group is in gone, in the partitions that this touches.

    A group's ids must lie between group * g and (group + 1) * g for one g that divides part_ids. unique: no id comes twice. Into an
    empty collection the points are written as they come; else they are written once beside it, as they are asked for their partitions
    first. The numbers of partitions touched pass the driver, never ids. seen observes n_points, the points written.
    """
    held = own_properties(spark, config.name)
    part = lambda x: F.floor(x / F.lit(int(held["part_ids"]))).cast("long")
    new = validate_vectors(points, config.dim).select("id", F.col("vector").cast("array<float>").alias("vector"), F.col("payload").cast("struct<text:string,source:string>").alias("payload"))
    live, beside, touched = live_parts(spark, held), None, set()
    if live.limit(1).count():
        new = beside = written(new, "upsert")
        parts = new.select(part(F.col("id")).alias("part"))
        if gone is not None:
            stored = live_points(spark, config.name).select("part", group.alias("__group"))
            parts = parts.unionByName(stored.join(gone.toDF("__group"), "__group", "left_semi").select("part"))
        touched = {r["part"] for r in parts.where("part is not null").distinct().collect()}
        old = live_points(spark, config.name).where(F.col("part").isin(touched)).select("id", "vector", "payload")
        rows = upsert_points(old, new, group, gone)
    else:
        rows = new if unique else one_per_id(new)
    version = _new("v")
    if not unique or beside is not None:  # else they were dealt by their files' ids before they had vectors
        rows = rows.repartition(part(F.col("id")), F.floor(F.col("id") / per_file))
    path = f"{held['root']}/points/version={version}"
    if seen is not None:
        rows = rows.observe(seen, F.count(F.lit(1)).alias("n_points"))
    rows.withColumn("part", part(F.col("id"))).write.option("maxRecordsPerFile", per_file).partitionBy("part").parquet(path)
    made = spark.read.schema(f"{SCHEMA}, part BIGINT").parquet(path).groupBy("part").agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("n_points"))
    commit(spark, config.name, held, _indexed(spark, config.name, held, version, path), live.where(~F.col("part").isin(touched)).unionByName(made))
    if beside is not None:
        discard(beside)


def _indexed(spark: SparkSession, name: str, held: dict[str, str], version: str, path: str) -> dict[str, str]:
    """Adds a version's points to the inverted file, if the collection has one."""
    if "index" in held:
        from .index import add_version

        add_version(spark, held, version, spark.read.schema(f"{SCHEMA}, part BIGINT").parquet(path))
    return {}


def setup_index(documents: DataFrame, config: Config = Config(), chunker: Callable[[DataFrame], DataFrame] | None = None, make_model: Callable | None = None, counts: dict[str, int] | None = None) -> bool:
    """Builds the collection from documents (doc_id, source, text); without rebuilding it does nothing at all.

    Chunks are dealt to the tasks that write their files and become vectors there, so no vector is shuffled. A collection whose vectors take
    ``exact_below_bytes`` or more gets an inverted file. counts is given n_documents, n_chunks and n_points, observed on the writes that
    the index needs anyway, in tasks that count once however often they run.
    """
    from .index import build_index

    spark, own = documents.sparkSession, config.collection
    if not own.rebuild:
        return False
    drop_collection(spark, own)
    create_collection(spark, own)
    per_file = config.embed.batch_size * own.upload_multiplier
    numbering, writing = Observation("numbering"), Observation("writing")
    chunks = number_chunks(documents, chunker or (lambda docs: chunk_recursive(docs, config.chunk)), numbering)
    dealt = chunks.select("id", "source", "text").repartition(F.floor(F.col("id") / own.part_ids), F.floor(F.col("id") / per_file))
    write_points(spark, own, build_points(embed_dense(dealt, config.embed, make_model)), per_file, unique=True, seen=writing)
    if counts is not None:
        counts |= {k: v or 0 for k, v in (numbering.get | writing.get).items()}
    n = live_parts(spark, own_properties(spark, own.name)).agg(F.sum("n_points")).first()[0] or 0
    if n * own.dim * 4 >= config.search.exact_below_bytes:
        build_index(spark, own.name, replace(config.search))
    return True
