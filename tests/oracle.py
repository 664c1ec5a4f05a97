"""Compare queries with their SQL in DuckDB on the same tables: ``python tests/oracle.py [--sf DIR] [NAME ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def tables_of(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(spark, query, sql: str, sf_dir: str) -> list[str]:
    """What differs between a query's rows and those of its SQL; nothing if they are equal."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    con = tables_of(sf_dir)
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    theirs = rows_of(list(kinds), con.execute(sql).fetchall())
    out = []
    own = {c: TYPES.get(t, t) for c, t in df.dtypes}
    if own != kinds:
        out.append(f"types {own} and {kinds}")
    if len(mine) != len(theirs):
        out.append(f"{len(mine)} and {len(theirs)} rows")
    bad = [(a, b) for a, b in zip(mine, theirs, strict=False) if a != b]
    if bad:
        out.append(f"{len(bad)} rows differ, first {str(bad[0][0])[:300]} and {str(bad[0][1])[:300]}")
    if not mine:
        out.append("no rows")
    return out


def main(args: list[str]) -> None:
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = "/root/testdata/sf0.001"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[3]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sqls, queries = entry.oracle_sql(), entry.queries()
    for name in args or queries:
        began = time.time()
        try:
            if name in sqls:
                said = differences(spark, queries[name], sqls[name], sf_dir)
            else:
                said = [f"no SQL; {len(queries[name](spark, sf_dir).collect())} rows"]
        except Exception as e:
            said = [f"{type(e).__name__}: {str(e)[:700]}"]
        print(f"{name}: {'; '.join(said) or 'equal'} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
