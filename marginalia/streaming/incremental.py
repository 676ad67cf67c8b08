"""Incremental indexing: new document files reach a collection as they come.

The blueprint has no streaming operator; this carries the batch operators over to a file
stream, so that a collection follows a folder that grows. A document that comes again replaces all
chunks of its earlier version, however many these were; of several versions in one micro-batch the one from
the newest file stays (then the one with the greatest source and text). A document without an id, or with more
chunks than ids, fails the batch with a message, as it couldn't be found again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.chunk import chunk_window
from ..operators.collections import create_collection, write_points
from ..operators.embed import embed_dense
from ..operators.points import build_points
from ..shared import discard, written

DOCUMENTS = "doc_id long, source string, text string"
#: Ids that one document has, for ids that don't depend on other documents, and documents that share a partition.
PER_DOCUMENT, PER_PART = 1 << 20, 1 << 10


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Documents of the Parquet files in a folder, new files included, with the time of their file as version."""
    found = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return found.select("*", F.col("_metadata.file_modification_time").alias("version"))


def newest(documents: DataFrame) -> DataFrame:
    """One row per doc_id: doc_id, source, text of its newest version."""
    version = F.col("version") if "version" in documents.columns else F.lit(0).alias("version")
    last = F.max(F.struct(version, "source", "text")).alias("last")
    return documents.groupBy("doc_id").agg(last).select("doc_id", "last.source", "last.text")


def _checked(value: Column, right: Column, message: str) -> Column:
    return F.when(right, value).otherwise(F.raise_error(F.lit(message)).cast("long"))


def stream_ids(chunks: DataFrame) -> DataFrame:
    """Ids from document and chunk alone: a document that comes again takes its own ids."""
    doc = _checked(F.col("doc_id"), F.col("doc_id").isNotNull() & (F.abs("doc_id") < F.lit((1 << 63) // PER_DOCUMENT)), "a document without an id, or with one out of range")
    place = _checked(F.col("chunk_idx").cast("long"), F.col("chunk_idx") < PER_DOCUMENT, "a document with more chunks than ids")
    return chunks.withColumn("id", doc * PER_DOCUMENT + place)


def index_stream(documents: DataFrame, checkpoint: str, config: Config = Config(), chunker: Callable[[DataFrame], DataFrame] = chunk_window, make_model: Callable | None = None) -> StreamingQuery:
    """Upserts the chunks of each micro-batch into the collection and ends when no file is left.

    A batch that is run again after a failure writes the same points under the same ids.
    """
    own = replace(config.collection, part_ids=PER_DOCUMENT * PER_PART)
    create_collection(documents.sparkSession, own)

    def upsert(batch: DataFrame, _: int) -> None:
        docs = written(newest(batch), "stream-batch")
        points = build_points(embed_dense(stream_ids(chunker(docs)), config.embed, make_model))
        group = F.floor(F.col("id") / F.lit(PER_DOCUMENT))
        write_points(batch.sparkSession, own, points, config.embed.batch_size * own.upload_multiplier, group, docs.select("doc_id"))
        discard(docs)

    return documents.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
