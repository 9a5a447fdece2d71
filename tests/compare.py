"""Every registered query with SQL gives on one set of tables what DuckDB gives."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


def rows(columns: list[str], found: list) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr([_plain(r[i]) for i in order]) for r in found)


def expected(folder: str, sql: str, tables: list[str] = TABLES) -> tuple[list[str], list[str]]:
    with duckdb.connect() as db:
        db.execute("set TimeZone = 'UTC'")
        for name in tables:
            path = f"{folder}/{name}.parquet"
            db.execute(f"create view {name} as from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
        answer = db.execute(sql)
        columns = [c[0] for c in answer.description]
        return sorted(columns), rows(columns, answer.fetchall())


def given(df: DataFrame) -> tuple[list[str], list[str]]:
    return sorted(df.columns), rows(df.columns, df.collect())


if __name__ == "__main__":
    import __spark_entry__

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sql, folder = __spark_entry__.oracle_sql(), sys.argv[1]
    for name, query in __spark_entry__.queries().items():
        if name in sql and (len(sys.argv) < 3 or name in sys.argv[2:]):
            start = time.time()
            try:
                ours, theirs = given(query(spark, folder)), expected(folder, sql[name])
                print("ok  " if ours == theirs else "DIFF", name, len(ours[1]), len(theirs[1]), round(time.time() - start, 1), flush=True)
                if ours != theirs:
                    print("   ", ours[0], theirs[0], [x for x in ours[1] if x not in set(theirs[1])][:2], [x for x in theirs[1] if x not in set(ours[1])][:2])
            except Exception as error:
                print("FAIL", name, str(error)[:300], flush=True)
