"""Every registered query against its SQL, on the smallest tables."""

import duckdb
import pytest

from marginalia.plans.registry import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations"


def tidy(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = QUERIES[name](spark, sf_dir)
    columns = ", ".join(got.columns)
    want = con.sql(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall()
    assert tidy(map(tuple, got.collect())) == tidy(want)
