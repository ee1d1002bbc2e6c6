"""Compare a catalogue query with its SQL on the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb

DUCK_TYPES = {
    "BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DATE": "date", "DOUBLE": "double", "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp_ntz", "SMALLINT": "smallint",
}


def duck(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')").fetchall()
    return con


def _plain(value):
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def compare(con, frame, sql: str) -> list[str]:
    """Differences as text; empty if schema, row count and values agree."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    theirs = result.fetchall()
    problems = []
    if sorted(names) != sorted(frame.columns):
        return [f"columns {sorted(frame.columns)} != {sorted(names)}"]
    for field in frame.schema.fields:
        expected = DUCK_TYPES.get(types[field.name], types[field.name])
        if field.dataType.simpleString() != expected:
            problems.append(f"type of {field.name}: {field.dataType.simpleString()} != {expected}")
    order = sorted(names)
    ours = [tuple(_plain(r[c]) for c in order) for r in frame.collect()]
    index = [names.index(c) for c in order]
    theirs = [tuple(_plain(r[i]) for i in index) for r in theirs]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    ours, theirs = sorted(ours, key=key), sorted(theirs, key=key)
    if not ours:
        problems.append("no rows")
    if len(ours) != len(theirs):
        problems.append(f"rows {len(ours)} != {len(theirs)}")
    if ours != theirs:
        mine, other = set(map(str, ours)), set(map(str, theirs))
        problems.append(f"values differ: ours only {sorted(mine - other)[:3]} sql only {sorted(other - mine)[:3]}")
    return problems
