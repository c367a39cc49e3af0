"""Run queries in Spark and their SQL in DuckDB, and compare the rows: ``python -m tests.compare [--sf DIR] [NAME...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

#: Compare floating-point numbers to the last bit instead of nine digits.
EXACT = os.environ.get("COMPARE_EXACT") == "1"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v if EXACT else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "as_tuple"):  # decimal
        return plain(float(v))
    if hasattr(v, "tzinfo") and v.tzinfo:
        return v.replace(tzinfo=None)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


#: Names of types as both engines give them.
KINDS = {"bigint": "long", "int": "int", "integer": "int", "double": "double", "string": "text", "varchar": "text", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time", "date": "date", "float": "float", "hugeint": "hugeint"}


def kind(name: str) -> str:
    name = str(name).lower().split("(")[0]
    return "array" if name.endswith("[]") or name.startswith("array") else KINDS.get(name, name)


def compare(spark, name: str, query, sql: str, sf_dir: str) -> str:
    """'' if both give the same rows, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = database(sf_dir).execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows(columns, cur.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} / {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows / {len(want)}: {got[:2]} / {want[:2]}"
    kinds = {c: kind(k) for c, k in df.dtypes}
    other = {d[0]: kind(d[1]) for d in cur.description}
    if kinds != other:
        return f"types {[(c, kinds[c], other[c]) for c in kinds if kinds[c] != other[c]]}"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(bad)} of {len(got)} rows differ, such as {bad[:2]}" if bad else ""


def session():
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def main(args: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in args or sorted(queries):
        began = time.time()
        try:
            if name in oracles:
                said = compare(spark, name, queries[name], oracles[name], sf_dir)
            else:
                n = len(queries[name](spark, sf_dir).collect())
                said = ""
                name += f" (no SQL, {n} rows)"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:900]}"
        failed += bool(said)
        print(f"{'FAIL' if said else 'ok'} {name} {time.time() - began:.1f} s {said}"[:1500], flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
