"""Side-by-side check of a Spark query against its DuckDB oracle SQL.

Compares row count, column names and an order-insensitive multiset of rows.
Doubles are compared after rounding to 9 significant digits.
"""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

RAW_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
              "pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in RAW_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        if f == 0:
            return 0.0
        return float(f"{f:.9g}")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def rows_multiset(cols: list[str], rows) -> Counter:
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in rows)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "date": "DATE", "string": "VARCHAR",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def compare(spark_df, con, sql: str) -> dict:
    s_cols = spark_df.columns
    s_types = {f.name: f.dataType.simpleString() for f in spark_df.schema.fields}
    s_rows = [tuple(r) for r in spark_df.collect()]
    rel = con.sql(sql)
    d_cols = list(rel.columns)
    d_types = dict(zip(d_cols, [str(t) for t in rel.types]))
    d_rows = rel.fetchall()
    type_diffs = {c: (s_types[c], d_types.get(c)) for c in s_cols
                  if SPARK_TO_DUCK.get(s_types[c], s_types[c].upper()) != d_types.get(c)}
    out = {
        "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "spark_cols": s_cols, "oracle_cols": d_cols,
        "types_match": not type_diffs, "type_diffs": type_diffs,
    }
    if out["columns_match"]:
        a, b = rows_multiset(s_cols, s_rows), rows_multiset(d_cols, d_rows)
        out["values_match"] = a == b
        if a != b:
            out["only_spark"] = list((a - b).elements())[:5]
            out["only_oracle"] = list((b - a).elements())[:5]
    else:
        out["values_match"] = False
    out["ok"] = out["columns_match"] and out["values_match"] and out["types_match"] and len(s_rows) == len(d_rows)
    return out
