"""Run every registered query in Spark and its oracle SQL in DuckDB, compare.

Usage: python scripts/check_oracle.py [sf_dir] [name-substring ...]
Mirrors the driver's check: row count, column names, order-insensitive values.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fairlane import catalog  # noqa: E402
from fairlane.catalog.compare import canon, duck_connect  # noqa: E402
from fairlane.session import get_session  # noqa: E402


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    spark = get_session(os.environ.get("ORACLE_MASTER", "local[8]"), 8)
    qs = catalog.queries()
    sqls = catalog.oracle_sql()
    con = duck_connect(sf_dir)
    bad = 0
    for name in sorted(qs):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            scols = df.columns
            srows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS {name}: {len(srows)} rows ({ts:.1f}s, no oracle)")
            continue
        try:
            cur = con.execute(sqls[name])
            dcols = [d[0] for d in cur.description]
            drows = cur.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:600]}")
            bad += 1
            continue
        if sorted(scols) != sorted(dcols):
            print(f"FAIL {name}: columns spark={scols} duck={dcols}")
            bad += 1
            continue
        a, b = canon(scols, srows), canon(dcols, drows)
        if a != b:
            bad += 1
            diff = [x for x in a if x not in set(b)][:3]
            diff2 = [x for x in b if x not in set(a)][:3]
            print(f"FAIL {name}: values differ ({len(a)} vs {len(b)} rows)\n  spark-only {diff}\n  duck-only  {diff2}")
            continue
        print(f"OK   {name}: {len(a)} rows ({ts:.1f}s)")
    print(f"done, {bad} failing")
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
