"""Run registered queries next to their SQL in DuckDB: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else float(v))
    if isinstance(v, bool) or v is None or isinstance(v, (int, str, datetime.datetime, datetime.date)):
        return v
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if hasattr(v, "__float__") else v


def oracle_rows(sql: str, sf: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def counted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, sql: str, sf: str) -> str:
    """'' when the results agree, else what differs."""
    got = [tuple(r) for r in df.collect()]
    names, want = oracle_rows(sql, sf)
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = counted(df.columns, got), counted(names, want)
    if a == b:
        return "" if a else "both empty"
    left, right = list((a - b).elements()), list((b - a).elements())
    return f"{len(got)} vs {len(want)} rows; only spark {len(left)}: {sorted(left, key=str)[:3]}; only sql {len(right)}: {sorted(right, key=str)[:3]}"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="compare-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            note = compare(df, sqls[name], sf) if name in sqls else f"rows only: {len(df.collect())}"
        except Exception as e:  # noqa: BLE001
            note = f"ERROR {type(e).__name__} {str(e)[:600]}"
        ok = note == "" or note.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {note}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
