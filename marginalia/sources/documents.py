"""Reading documents: tables, or directories of files whose text an extractor gives."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import sanitized
from ..shared import open_fs, written


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan_documents(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """source, content: one row per file below path, subdirectories included."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("source"), "content")


def write_files(rows: DataFrame, path: str, keep: list[str], content: str = "content", suffix: str = ".txt") -> DataFrame:
    """Writes each row's content (bytes) to a file of its own below path; keep, file (the last two parts of its name) and bytes of every row.

    A task writes to a folder that only it has, so names don't depend on the rows, and rows may agree in all columns. What this
    returns is written when all files are: a task that is run again leaves files that no row of it names. Null contents make no file.
    """
    schema = StructType([*(rows.schema[k] for k in keep), StructField("file", StringType()), StructField("bytes", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, root = open_fs(path)
        folder, n, arrow = uuid.uuid4().hex, 0, to_arrow_schema(schema)
        fs.create_dir(f"{root}/{folder}")
        for batch in batches:
            names = [f"{folder}/{n + i}{suffix}" for i in range(batch.num_rows)]
            n += len(names)
            for name, raw in zip(names, batch.column(content), strict=True):
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(raw.as_buffer())
            sizes = pc.binary_length(batch.column(content)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name).cast(f.type) for f in list(arrow)[:-2]), pa.array(names), sizes], schema=arrow)

    return written(rows.where(F.col(content).isNotNull()).select(*keep, content).mapInArrow(run, schema), "files")


def of_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """source, content and what write_files() kept of each row whose file was scanned; files that it doesn't name are left out.

    Scans pass over empty files; their rows are told by the manifest, and have the file's short name as source.
    """
    named = files.withColumn("file", F.regexp_extract("source", r"([^/]+/[^/]+)$", 1))
    empty = F.col("bytes") == 0
    found = manifest.join(named, "file", "left").withColumns({"source": F.when(empty, F.col("file")).otherwise(F.col("source")), "content": F.when(empty, F.lit(b"")).otherwise(F.col("content"))})
    return found.where("content is not null").drop("file", "bytes")


def utf8_text(content: bytes) -> str:
    """The default extractor: what isn't UTF-8 is dropped."""
    return content.decode("utf-8", "ignore")


def strict_utf8_text(content: bytes) -> str:
    return content.decode("utf-8")


def extract_text(files: DataFrame, extractor: Callable[[bytes], str] = utf8_text, content: str = "content") -> DataFrame:
    """Replaces content by text and error; a file that the extractor can't read has a null text and the reason.

    The default extractor has the same meaning as sanitized(), which takes its place in the JVM.
    """
    if extractor is utf8_text:
        return files.withColumns({"text": sanitized(F.col(content).cast("string")), "error": F.lit(None).cast("string")}).drop(*{content} - {"text"})
    keep = [c for c in files.columns if c != content]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts, errors = [], []
            for raw in pdf[content]:
                try:
                    texts.append(extractor(bytes(raw)))
                    errors.append(None)
                except Exception as e:  # any file may be broken in any way; the row says how
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf[keep].assign(text=pd.Series(texts, index=pdf.index, dtype=object), error=pd.Series(errors, index=pdf.index, dtype=object))

    ddl = [f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != content]
    return files.mapInPandas(run, ", ".join([*ddl, "text string", "error string"]))


def reject_bad_documents(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that could be read, rejected ones with their error)."""
    return extracted.where("error is null").drop("error"), extracted.where("error is not null").drop("text")
