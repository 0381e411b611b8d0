"""``python tests/check_queries.py sf0.01 [name part ...]``: compare all queries with DuckDB."""

from __future__ import annotations

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from oracle import compare, connect  # noqa: E402


def main() -> int:
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    parts = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            verdict, rows = compare(spark, con, sf_dir, run, sqls.get(name))
        except Exception as error:  # shown for each query, the others still run
            verdict, rows = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0
        bad += verdict not in ("same", "rows only")
        print(f"{name:40s} {time.time() - start:6.2f}s {rows:7d} {verdict}", flush=True)
    print("not the same:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main() > 0)
