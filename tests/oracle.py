"""Runs registered queries in Spark and their SQL in DuckDB, and compares rows."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(v):  # noqa: ANN001, ANN201
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(tidy(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, tidy(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def differences(spark, sf_dir, run, sql) -> list[str]:  # noqa: ANN001
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = run(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(tidy(v) for v in r) for r in df.select(cols).collect()), key=str)
    rel = con.sql(sql)
    out = []
    if sorted(rel.columns) != cols:
        return [f"columns {cols} and {sorted(rel.columns)}"]
    want = sorted((tuple(tidy(v) for v in r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall()), key=str)
    if len(got) != len(want):
        out.append(f"{len(got)} rows and {len(want)}")
    out += [f"{a} and {b}" for a, b in zip(got, want, strict=False) if a != b][:3]
    return out
