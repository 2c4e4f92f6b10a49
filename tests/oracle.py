"""Compares a query with its SQL in DuckDB as the driver does: rows, column names and values, whatever the order."""

import math
from pathlib import Path

import duckdb


def connect(d: str):
    c = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else p
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return c


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return bytes(v) if isinstance(v, bytearray) else v


KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "SMALLINT": "smallint", "FLOAT": "float", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "HUGEINT": "hugeint"}


def kind(t):
    """One name for a type of either engine; nested types by their leaves."""
    t = str(t)
    if t.endswith("[]"):
        return f"array<{kind(t[:-2])}>"
    if "STRUCT" in t or t.startswith(("struct", "MAP", "map")):
        return "nested"
    return KINDS.get(t, t) if not t.startswith("array<") else f"array<{kind(t[6:-1])}>"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


def compare(spark, d, query, sql):
    df = query(spark, d)
    with connect(d) as c:
        r = c.execute(sql)
        names, kinds = [x[0] for x in r.description], {x[0]: str(x[1]) for x in r.description}
        want = r.fetchall()
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    of = dict(df.dtypes)
    odd = {n: (of[n], k) for n, k in kinds.items() if kind(of[n]) != kind(k)}
    assert not odd, odd
    got, want = rows(df.columns, [tuple(x) for x in df.collect()]), rows(names, want)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    assert not bad, bad[:3]
    return len(got)
