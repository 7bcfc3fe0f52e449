"""Compare catalogue queries with their SQL text on DuckDB.

    python tests/oracle_check.py [name prefix ...] [--sf 0.01]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402
from colsmith.session import local_session  # noqa: E402


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if type(v).__name__ == "Decimal":
        return repr(float(v)) + "D"
    return repr(v)


def compare(df, con, sql):
    """Empty text when both sides hold the same columns and rows."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    order = sorted(names)
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    ours = df.select(*[f"`{c}`" for c in order]).collect()
    left = sorted(tuple(plain(v) for v in row) for row in ours)
    index = [names.index(c) for c in order]
    right = sorted(tuple(plain(row[i]) for i in index) for row in expected)
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    if left != right:
        bad = [(a, b) for a, b in zip(left, right) if a != b]
        return f"{len(bad)} rows differ, first {order} {bad[0][0]} != {bad[0][1]} ({kinds})"
    return ""


def main():
    words = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf = "0.01"
    if "--sf" in sys.argv:
        sf = sys.argv[sys.argv.index("--sf") + 1]
        words = [w for w in words if w != sf]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed, total = connect(folder), oracle_sql(), [], time.time()
    names = [n for n in queries() if not words or any(n.startswith(w) for w in words)]
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            message = compare(df, con, sql[name]) if name in sql else f"(no SQL, {df.count()} rows)"
        except Exception as error:  # noqa: BLE001
            message = f"{type(error).__name__}: {str(error)[:600]}"
        if message and not message.startswith("("):
            failed.append(name)
        print(f"{'ok  ' if name not in failed else 'FAIL'} {name} {time.time() - start:.1f}s {message}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} fine in {time.time() - total:.0f}s; failed: {failed}")


if __name__ == "__main__":
    main()
