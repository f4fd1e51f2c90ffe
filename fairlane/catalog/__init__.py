"""Registry of checkable queries: one Spark plan and, where SQL can say it,
the same query as DuckDB text over the driver's tables.

Doubles are rounded to 6 places on both sides so that summation order (which
differs between engines and between partitionings) cannot change a hash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fairlane.sources.tables import APPLICATIONS_SQL, PREDICTIONS_SQL

SparkFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Entry:
    name: str
    fn: SparkFn
    sql: str | None = None          # final SELECT (may use `applications`, `predictions`)
    ctes: str = ""                  # extra CTEs, comma separated, no leading WITH
    dbl: list[str] = field(default_factory=list)   # double columns rounded in SQL


REGISTRY: dict[str, Entry] = {}


def round_doubles(df: DataFrame, places: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # round(x * 10^p) / 10^p on both sides: the same double always
            # lands on the same value (Spark's round(x, p) rounds the decimal
            # string half-up, DuckDB the binary value, so ties would differ).
            scale = F.lit(float(10 ** places))
            cols.append((F.round(F.col(f"`{f.name}`") * scale, 0) / scale).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(cols)


def register(name: str, sql: str | None = None, ctes: str = "", dbl: list[str] | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn: SparkFn) -> SparkFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, ctes, list(dbl or []))
        return fn
    return deco


def full_sql(e: Entry) -> str:
    parts = [APPLICATIONS_SQL, PREDICTIONS_SQL]
    if e.ctes.strip():
        parts.append(e.ctes.strip().rstrip(","))
    body = e.sql.strip().rstrip(";")
    if e.dbl:
        repl = ", ".join(f'round("{c}" * 1e6) / 1e6 AS "{c}"' for c in e.dbl)
        body = f"SELECT * REPLACE ({repl}) FROM (\n{body}\n) _q"
    else:
        body = f"SELECT * FROM (\n{body}\n) _q"
    return "WITH " + ",\n".join(parts) + "\n" + body


def _load_all() -> None:
    # Import side effect: each ``q_*`` module registers its entries.
    import importlib
    import pkgutil

    import fairlane.catalog as pkg
    for m in sorted(pkgutil.iter_modules(pkg.__path__), key=lambda m: m.name):
        if m.name.startswith("q_"):
            importlib.import_module(f"fairlane.catalog.{m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()

    def wrap(fn: SparkFn) -> SparkFn:
        return lambda spark, sf_dir: round_doubles(fn(spark, sf_dir))

    return {k: wrap(e.fn) for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: full_sql(e) for k, e in REGISTRY.items() if e.sql}
