"""Run every registered query in Spark and its oracle in DuckDB; compare.

Usage: python scripts/check_oracle.py [sf_dir] [name ...]
Prints one line per query: rows, column names and an order-insensitive
value comparison (exact, plus the largest numeric difference).
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.plans import oracle, registry  # noqa: E402
from tillroll.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "nan")
        return (1, round(v, 6))
    if hasattr(v, "item"):
        v = v.item()
    return (2, str(v))


def rows_of(cols, records):
    return sorted(tuple(norm(r[c]) for c in cols) for r in records)


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", 8, driver_memory="8g")
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, sql = registry.build(), oracle.build()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        df = fn(spark, sf_dir)
        srows = [r.asDict() for r in df.collect()]
        st = time.time() - t0
        scols = sorted(df.columns)
        if name not in sql:
            print(f"{name:28s} spark rows={len(srows):6d} ({st:.1f}s) [no oracle]")
            continue
        t0 = time.time()
        rel = con.sql(sql[name])
        dcols = sorted(rel.columns)
        drows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
        dt = time.time() - t0
        ok_cols = scols == dcols
        msg = ""
        if ok_cols:
            a, b = rows_of(scols, srows), rows_of(dcols, drows)
            ok = a == b
            if not ok and len(a) == len(b):
                diffs = [(x, y) for x, y in zip(a, b) if x != y]
                msg = f" first diff: {diffs[0]}" if diffs else ""
        else:
            ok = False
            msg = f" cols spark={scols} duck={dcols}"
        stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
        status = "OK " if ok and len(srows) == len(drows) else "BAD"
        bad += status == "BAD"
        print(f"{status} {name:28s} rows={len(srows)}/{len(drows)} spark {st:.1f}s duck {dt:.1f}s{msg}")
        if status == "BAD" or "-v" in os.environ.get("CHECK_FLAGS", ""):
            print("    types spark:", stypes)
            print("    types duck :", dtypes)
    spark.stop()
    sys.exit(1 if bad else 0)


if __name__ == "__main__":
    main()
