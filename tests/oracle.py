"""Run a registered query on both engines and compare rows."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


SAME_TYPE = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(rows):
    return sorted(rows, key=lambda row: [(v is None, str(type(v)), v if v is not None else 0) for v in row])


def difference(spark, con, sf_dir, name, run, sql) -> str | None:
    """None where both engines agree, otherwise what differs."""
    frame = run(spark, sf_dir)
    columns = sorted(frame.columns)
    mine = _sorted([tuple(_plain(r[c]) for c in columns) for r in frame.collect()])
    types = {f.name: f.dataType.simpleString() for f in frame.schema}
    described = {r[0]: SAME_TYPE.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if types != described:
        return f"{name}: types {types} against {described}"
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    if sorted(names) != columns:
        return f"{name}: columns {columns} against {sorted(names)}"
    at = [names.index(c) for c in columns]
    theirs = _sorted([tuple(_plain(r[i]) for i in at) for r in answer.fetchall()])
    if len(mine) != len(theirs):
        return f"{name}: {len(mine)} rows against {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{name}: {columns}\n  spark  {a}\n  oracle {b}"
    return None if mine else f"{name}: no rows"
