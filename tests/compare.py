"""Registered queries against their SQL in DuckDB: python tests/compare.py FOLDER NAME..."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.10g}") + 0.0
    if isinstance(x, list):
        return tuple(plain(y) for y in x)
    return x


def duck_rows(folder: str, sql: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"create view {p.stem} as select * from read_parquet('{at}')")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(x) for x in r) for r in df.select(*(f"`{n}`" for n in names)).collect())


def differs(spark, folder: str, query, sql: str) -> str:
    a, b = spark_rows(query(spark, folder)), duck_rows(folder, sql)
    if a == b:
        return ""
    return f"columns {a[0]} {b[0]}; rows {a[1].total()} {b[1].total()}; only Spark {list((a[1] - b[1]).items())[:3]}; only SQL {list((b[1] - a[1]).items())[:3]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:] or entry.queries():
        t = time.time()
        try:
            if name in entry.oracle_sql():
                said = differs(spark, sys.argv[1], entry.queries()[name], entry.oracle_sql()[name]) or "equal"
            else:
                said = f"{entry.queries()[name](spark, sys.argv[1]).count()} rows, no SQL"
        except Exception as e:
            said = f"FAILED {type(e).__name__}: {str(e)[:1500]}"
        print(f"{name}: {said} ({time.time() - t:.1f} s)", flush=True)
