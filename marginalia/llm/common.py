"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import discard, lean, lean_driver, new_path, open_fs, written  # noqa: F401  used by the operators

#: A table of at most so many rows (of a few short columns) may be broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of a batch that a Python step looks at at once.
SLICE_BYTES = 4 << 20
#: Beyond BROADCAST_ROWS, hot keys of the large side are dealt over so many salts.
SALTS = 32


def join_table(big: DataFrame, table: DataFrame, keys: list[str], how: str = "left", hot: bool = True, weight: Column | None = None) -> DataFrame:
    """Joins a table that has one row per key, null keys matching null keys.

    The table is broadcast if a count shows at most BROADCAST_ROWS rows. A larger one
    is repeated once per salt, and each row of the big side takes one salt by a hash of its columns (a task that runs again deals its rows as before), so that a
    hot key is dealt over SALTS tasks; not so with hot=False, for keys that few rows of the big
    side share. A larger table is always merged: by the size of its files Spark would still broadcast it, as ids take
    a few bytes each there, some hundred in a broadcast, and salts aren't counted. The table must already be written (it is counted).
    weight: how many short rows a row with arrays stands for.
    """
    names = {k: f"__t_{k}" for k in keys}
    small = table.select(*[F.col(k).alias(names[k]) if k in names else F.col(k) for k in table.columns])
    on = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    rows = table.limit(BROADCAST_ROWS + 1).count() if weight is None else table.agg(F.sum(weight + 1).alias("n")).first()["n"] or 0
    if rows <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how).drop(*names.values())
    if not hot:
        return big.join(small.hint("merge"), on, how).drop(*names.values())
    small = small.withColumn("__t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    hashed = [f.name for f in big.schema.fields if "map<" not in f.dataType.simpleString()]
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in hashed]), F.lit(SALTS)).cast("int"))
    return salted.join(small, [*on, F.col("__salt") == F.col("__t_salt")], how).drop("__salt", "__t_salt", *names.values())


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


_held: dict = {}


def hold(key: tuple, make: Callable):
    """A large state that outlives a task in its worker process; a worker holds one of them at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of about SLICE_BYTES, so that what Python makes of one stays small."""
    rows = max(1, batch.num_rows * SLICE_BYTES // max(batch.nbytes, 1))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def map_rows(df: DataFrame, schema: StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]]) -> DataFrame:
    """mapInArrow whose state is built once per task.

    make() runs in the task and returns a function from a slice of a batch to columns by name;
    columns of the schema that it doesn't return are taken from the batch as they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        lean()
        arrow = to_arrow_schema(schema)
        step = make()
        for batch in (part for whole in batches for part in slices(whole)):
            new = step(batch)
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[f.name], type=f.type) if f.name in new else batch.column(f.name).cast(f.type) for f in arrow], schema=arrow
            )
            del new, batch
        lean()

    return df.mapInArrow(run, schema)


def with_fields(df: DataFrame, keep: list[str], extra: str) -> StructType:
    """Schema of kept columns of df and further ones in DDL."""
    return StructType([df.schema[k] for k in keep] + StructType.fromDDL(extra).fields)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used, in other lambdas too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
