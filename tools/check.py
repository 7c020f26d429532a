"""Run every registered query and its SQL twin side by side.

Usage: python tools/check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import registry  # noqa: E402


def normal(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [
        tuple(None if pd.isna(value) else value for value in row)
        for row in frame.astype(object).itertuples(index=False)
    ]
    return sorted(rows, key=repr)


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in registry.TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    failed = 0
    for name in names:
        started = time.time()
        found = normal(registry.QUERIES[name](spark, sf_dir).toPandas())
        took = time.time() - started
        if name not in registry.ORACLE_SQL:
            print(f"rows  {name} {len(found)} rows {took:.1f}s", flush=True)
            continue
        frame = db.execute(registry.ORACLE_SQL[name]).df()
        wanted = normal(frame)
        same = found == wanted and len(found) > 0
        failed += not same
        print(f"{'ok   ' if same else 'FAIL '} {name} {len(found)} rows {took:.1f}s", flush=True)
        if not same:
            extra, lacking = set(found) - set(wanted), set(wanted) - set(found)
            print("  rows", len(found), len(wanted), sorted(frame.columns))
            print("  only spark ", [str(row)[:300] for row in list(extra)[:3]])
            print("  only duckdb", [str(row)[:300] for row in list(lacking)[:3]])
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
