"""Runs queries against their SQL in DuckDB: python tests/parity.py [sf] [name...]"""

import hashlib
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(list(map(str, v))) if isinstance(v, list) else repr(v) if not isinstance(v, (bytes, bytearray)) else bytes(v).hex()
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


def compare(spark, sf, name, query, sql):
    """(rows, equal, note)"""
    import duckdb

    df = query(spark, f"{DATA}/{sf}")
    mine = canonical([tuple(r) for r in df.collect()], df.columns)
    if sql is None:
        return len(mine), None, ""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{sf}/{t}.parquet'")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    theirs = canonical(cur.fetchall(), columns)
    if sorted(columns) != sorted(df.columns):
        return len(mine), False, f"columns {sorted(df.columns)} and {sorted(columns)}"
    odd = [(a, b) for a, b in zip(mine, theirs) if a != b][:2]
    return len(mine), mine == theirs, f"{len(mine)} and {len(theirs)} rows {str(odd)[:400]}" if mine != theirs else hashlib.md5(str(mine).encode()).hexdigest()[:8]


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "sf0.01"), sys.argv[2:]
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names or not names and (name.startswith("op") and name[2].isdigit() or name == "pipeline"):
            continue
        start = time.time()
        try:
            n, same, note = compare(spark, sf, name, query, oracles.get(name))
            print("RESULT", name, n, {True: "equal", False: "DIFFERENT", None: "rows only"}[same], round(time.time() - start, 1), note, flush=True)
        except Exception as e:
            print("RESULT", name, "ERROR", str(e)[:500].replace("\n", " "), flush=True)
