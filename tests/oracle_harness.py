"""Run a Spark query and its DuckDB oracle on the same parquet tables and
compare row count, column names/types and order-insensitive values."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import types as T

from codelens.sources.tables import TABLES

_SPARK_TO_DUCK = {
    T.LongType: "BIGINT",
    T.IntegerType: "INTEGER",
    T.ShortType: "SMALLINT",
    T.DoubleType: "DOUBLE",
    T.FloatType: "FLOAT",
    T.StringType: "VARCHAR",
    T.BooleanType: "BOOLEAN",
    T.TimestampNTZType: "TIMESTAMP",
    T.DateType: "DATE",
}


def spark_type_name(dt) -> str:
    if isinstance(dt, T.ArrayType):
        return spark_type_name(dt.elementType) + "[]"
    if isinstance(dt, T.StructType):
        return "STRUCT"
    return _SPARK_TO_DUCK.get(type(dt), dt.simpleString().upper())


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


# Floats are compared exactly by default; ORACLE_DIGITS=n rounds them first.
DIGITS = int(os.environ.get("ORACLE_DIGITS", "-1"))


def _norm(v, digits=DIGITS):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, digits) if digits >= 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist(), digits)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x, digits)) for k, x in v.items()))
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark, fn, sql: str, sf_dir: str, con=None) -> dict:
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_types = [spark_type_name(f.dataType) for f in sdf.schema.fields]
    s_rows = [tuple(r) for r in sdf.collect()]
    con = con or duck_connect(sf_dir)
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    d_types = [str(t) for t in con.execute(f"DESCRIBE {sql}").fetchall() and
               [r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()]]
    out = {
        "rows_spark": len(s_rows),
        "rows_oracle": len(d_rows),
        "cols_match": sorted(s_cols) == sorted(d_cols),
        "types_match": sorted(zip(s_cols, s_types)) == sorted(zip(d_cols, d_types)),
        "spark_schema": dict(zip(s_cols, s_types)),
        "oracle_schema": dict(zip(d_cols, d_types)),
    }
    out["values_match"] = out["cols_match"] and _rows(s_cols, s_rows) == _rows(d_cols, d_rows)
    out["ok"] = out["values_match"] and out["types_match"] and len(s_rows) == len(d_rows)
    out["plan"] = sdf._jdf.queryExecution().executedPlan().toString()
    if not out["values_match"] and out["cols_match"]:
        a, b = _rows(s_cols, s_rows), _rows(d_cols, d_rows)
        sa, sb = set(a), set(b)
        out["only_spark"] = [x for x in a if x not in sb][:3]
        out["only_oracle"] = [x for x in b if x not in sa][:3]
    return out
