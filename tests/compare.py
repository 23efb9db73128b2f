"""Run every query at a scale factor in Spark and in DuckDB and compare."""

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_normal(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir, name, query, sql, con):
    start = time.time()
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - start
    relation = con.sql(sql)
    theirs = rows_of(relation.columns, relation.fetchall())
    return sorted(df.columns) == sorted(relation.columns), mine, theirs, seconds


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    connection, sqls = oracle(sf), entry.oracle_sql()
    for name, query in entry.queries().items():
        if name not in sqls:
            continue
        if len(sys.argv) > 2 and name not in sys.argv[2:]:
            continue
        try:
            same, mine, theirs, seconds = compare(spark, sf, name, query, sqls[name], connection)
            verdict = "ok" if same and mine == theirs else "DIFFERENT"
            print(f"{name:24} {verdict:10} {len(mine):7} {len(theirs):7} {seconds:6.2f}s", flush=True)
            if verdict != "ok":
                print("   spark only:", [r for r in mine if r not in theirs][:2])
                print("   sql only:  ", [r for r in theirs if r not in mine][:2])
        except Exception as e:
            print(f"{name:24} FAILED {str(e)[:600]}", flush=True)
