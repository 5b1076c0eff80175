"""Run a query in Spark and its SQL in DuckDB and compare rows, names and types."""

from __future__ import annotations

import collections
import os

import duckdb

DATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(DATA, sf, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if hasattr(value, "tzinfo") and getattr(value, "tzinfo", None) is not None:
        return value.replace(tzinfo=None)
    return value


def spark_rows(df):
    names = sorted(df.columns)
    rows = df.select(*(f"`{n}`" for n in names)).collect()
    return names, collections.Counter(tuple(_plain(v) for v in r) for r in rows)


def duck_rows(con, sql):
    result = con.execute(sql)
    described = [d[0] for d in result.description]
    names = sorted(described)
    order = [described.index(n) for n in names]
    return names, collections.Counter(tuple(_plain(r[i]) for i in order) for r in result.fetchall())


def duck_types(con, sql):
    return {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}


SPARK_TO_DUCK = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "date": "DATE",
    "timestamp": "TIMESTAMP",
    "boolean": "BOOLEAN",
    "double": "DOUBLE",
}


def type_mismatches(df, types):
    found = {}
    for field in df.schema:
        kind = field.dataType.simpleString()
        want = SPARK_TO_DUCK.get(kind, kind.upper())
        if types.get(field.name) != want:
            found[field.name] = (kind, types.get(field.name))
    return found
