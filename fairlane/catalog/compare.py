"""Order-insensitive comparison of a Spark result with its DuckDB oracle
(row count, column names, values with doubles at 6 places)."""

from __future__ import annotations

import datetime as dt
import decimal
import math

from fairlane.sources.tables import TABLES


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"f:{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"f:{round(float(v), 6):.6f}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, (dt.datetime, dt.date)):
        return f"t:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    return f"s:{v}"


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def duck_connect(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con
