"""Embeddings. The default model is a hashed bag of words; any function from texts to vectors can take its place.

The default model's vectors are made and searched as (bucket, count) entries; they become dense where they are stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..config import EmbedConfig
from ..functions.text import tokens

#: Rows that become vectors at once.
ROWS = 1_024
ENTRIES = "array<struct<bucket:int,n:int>>"
_ENTRIES = pa.list_(pa.struct([("bucket", pa.int32()), ("n", pa.int32())]))


def words(text: Column, config: EmbedConfig = EmbedConfig()) -> Column:
    """The tokens that count, an empty array for a null text."""
    return F.coalesce(tokens(text, config.max_tokens), F.array().cast("array<string>"))


def counted(found: pa.Array, dim: int) -> pa.Array:
    """(bucket, n) entries of lists of tokens. Each token of a batch is hashed once, however often it stands there."""
    parts = [_counted(found.slice(at, ROWS), dim) for at in range(0, len(found), ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], _ENTRIES)


def _counted(found: pa.Array, dim: int) -> pa.Array:
    sizes = np.diff(found.offsets.to_numpy())
    coded = found.flatten().view(pa.binary()).dictionary_encode()
    heads = b"".join(hashlib.md5(w, usedforsecurity=False).digest()[:4] for w in coded.dictionary.to_pylist())
    bucket = (np.frombuffer(heads, ">u4") % dim).astype(np.int64)  # see functions.text.bucket
    key, n = np.unique(bucket[coded.indices.to_numpy()] + np.repeat(np.arange(len(sizes)) * dim, sizes), return_counts=True)
    offsets = np.searchsorted(key, np.arange(len(sizes) + 1) * dim)
    values = pa.StructArray.from_arrays([pa.array(key % dim, pa.int32()), pa.array(n, pa.int32())], fields=list(_ENTRIES.value_type))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values, type=_ENTRIES)


def of_words(found: Column, config: EmbedConfig = EmbedConfig()) -> Column:
    """Entries of arrays of tokens."""
    dim = config.dim
    # deterministic, but not to be computed twice where a filter on the entries is pushed down
    return F.arrow_udf(lambda found: counted(found, dim), ENTRIES).asNondeterministic()(found)


def sparse_bag(text: Column, config: EmbedConfig = EmbedConfig()) -> Column:
    """Token counts by hash bucket, those that aren't zero, by bucket. Texts are split in the JVM, a batch of their tokens is hashed and counted at once."""
    return of_words(words(text, config), config)


def matrix(entries: pa.Array, dim: int, kind: type = np.float32) -> np.ndarray:
    """One dense row per list of (bucket, n)."""
    sizes, flat = np.diff(entries.offsets.to_numpy()), entries.flatten()
    out = np.zeros((len(sizes), dim), kind)
    out[np.repeat(np.arange(len(sizes)), sizes), flat.field("bucket").to_numpy()] = flat.field("n").to_numpy()
    return out


def dense(entries: Column, config: EmbedConfig = EmbedConfig()) -> Column:
    """Vectors of dim floats from sparse ones."""
    dim = config.dim

    @F.arrow_udf("array<float>")
    def filled(found: pa.Array) -> pa.Array:
        values = [matrix(found.slice(at, ROWS), dim).ravel() for at in range(0, len(found), ROWS)]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * dim, pa.int32()), pa.array(np.concatenate([np.empty(0, np.float32), *values])))

    return filled(entries)


def embed_sparse(rows: DataFrame, config: EmbedConfig = EmbedConfig(), text: str = "text") -> DataFrame:
    """Adds entries: the default model's vector without its zeros, some 100 of dim numbers."""
    return rows.withColumn("entries", sparse_bag(F.col(text), config))


def with_words(rows: DataFrame, config: EmbedConfig = EmbedConfig(), text: str = "text") -> DataFrame:
    """Adds tokens, from which a search makes the default model's vectors itself."""
    return rows.withColumn("tokens", words(F.col(text), config))


def hashed_bag(text: Column, config: EmbedConfig = EmbedConfig()) -> Column:
    """Token counts by hash bucket."""
    return dense(sparse_bag(text, config), config)


def embed_dense(rows: DataFrame, config: EmbedConfig = EmbedConfig(), make_model: Callable | None = None, text: str = "text") -> DataFrame:
    """Adds vector. make_model() is called once per worker and gives a function from an array of texts to a matrix."""
    if make_model is None:
        return rows.withColumn("vector", hashed_bag(F.col(text), config))
    model = predict_batch_udf(make_model, return_type=ArrayType(FloatType()), batch_size=config.batch_size)
    return rows.withColumn("vector", model(F.col(text)))


def embed_query(questions: DataFrame, config: EmbedConfig = EmbedConfig(), make_model: Callable | None = None) -> DataFrame:
    """The same model over (query_id, query), all questions in one job."""
    return embed_dense(questions, config, make_model, "query")
