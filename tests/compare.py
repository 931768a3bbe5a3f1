"""Run registered queries beside their SQL in DuckDB: python -m tests.compare sf_dir [name ...]."""

import math
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return db


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def difference(df, db, sql):
    """None if the query's rows equal the SQL's, else what differs."""
    found = db.execute(sql)
    names, want = [d[0] for d in found.description], found.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} {names}"
    a, b = rows_of(df.columns, map(tuple, df.collect())), rows_of(names, want)
    if a == b:
        return None
    return f"{len(a)} {len(b)} rows; first: {next(((x, y) for x, y in zip(a, b, strict=False) if x != y), 'end')}"[:700]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", "/tmp/compare").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    queries, sql = e.queries(), e.oracle_sql()
    db = connect(sf)
    for name in names or sorted(set(queries) - {n for n in queries if n.startswith("op") or n == "pipeline"}):
        began = time.time()
        try:
            said = difference(queries[name](spark, sf), db, sql[name]) if name in sql else f"{queries[name](spark, sf).count()} rows, no SQL"
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}" if "-v" not in sys.argv else traceback.format_exc()
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
