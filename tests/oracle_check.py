"""Compare registered queries with their SQL, as bags of rows. Also a command: oracle_check.py DIR [query ...]."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and value.is_integer() and math.isfinite(value):
        return int(value)
    return value


def bag(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def spark_bag(df) -> tuple[list[str], Counter]:
    return bag(df.columns, df.collect())


def sql_bag(con, sql: str) -> tuple[list[str], Counter]:
    cursor = con.execute(sql)
    return bag([d[0] for d in cursor.description], cursor.fetchall())


def difference(left, right) -> str | None:
    if left[0] != right[0]:
        return f"columns {left[0]} and {right[0]}"
    only_left, only_right = left[1] - right[1], right[1] - left[1]
    if only_left or only_right:
        return (
            f"rows {sum(left[1].values())} and {sum(right[1].values())}; only spark {sum(only_left.values())}: "
            f"{list(only_left)[:2]}; only sql {sum(only_right.values())}: {list(only_right)[:2]}"
        )
    return None


def main() -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import time

    from pyspark.sql import SparkSession

    from __spark_entry__ import oracle_sql, queries

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for name, run in queries().items():
        if wanted and name not in wanted or name not in sqls:
            continue
        started = time.time()
        try:
            left = spark_bag(run(spark, sf_dir))
            message = difference(left, sql_bag(con, sqls[name]))
            n = sum(left[1].values())
        except Exception as error:  # noqa: BLE001 - report and go on
            message, n = f"{type(error).__name__}: {str(error)[:600]}", -1
        bad += message is not None
        print(f"{'ok ' if message is None else 'BAD'} {name} {n} rows {time.time() - started:.1f}s {message or ''}", flush=True)
    print("different:", bad)


if __name__ == "__main__":
    main()
