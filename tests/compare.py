"""Run registered queries against their SQL and compare rows and types."""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat()
    return value


def _sorted(rows, order):
    return sorted(
        (tuple(_plain(row[i]) for i in order) for row in rows),
        key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r),
    )


def difference(spark, con, build, sql: str, folder: str) -> str | None:
    """None if both sides agree, else what differs."""
    df = build(spark, folder)
    rel = con.sql(sql)
    names, want = sorted(df.columns), sorted(rel.columns)
    if names != want:
        return f"columns {names} != {want}"
    got_types = [TYPES.get(dict(df.dtypes)[n], dict(df.dtypes)[n]) for n in names]
    sql_types = [str(dict(zip(rel.columns, rel.types))[n]) for n in names]
    left = _sorted(df.collect(), [df.columns.index(n) for n in names])
    right = _sorted(rel.fetchall(), [rel.columns.index(n) for n in names])
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    off = [(a, b) for a, b in zip(left, right) if a != b]
    if off:
        return f"{len(off)} of {len(left)} rows differ, first {str(off[0][0])[:300]} != {str(off[0][1])[:300]}"
    if got_types != sql_types:
        return f"types {list(zip(names, got_types, sql_types))}"
    return None if left else "no rows"


if __name__ == "__main__":
    import tempfile

    from maskloom.plans import QUERIES, SQL
    from maskloom.session import build_session

    scale = sys.argv[1]
    # names, or module names of maskloom.plans
    chosen = [
        name
        for name, build in QUERIES.items()
        if not sys.argv[2:] or name in sys.argv[2:] or build.__module__.split(".")[-1] in sys.argv[2:]
    ]
    folder = f"{DATA}/{scale}"
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": os.environ.get("PARTITIONS", "8"),
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
            "spark.maskloom.inputPartitions": os.environ.get("PARTITIONS", "8"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-", dir="/tmp"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in chosen:
        began = time.time()
        try:
            if name in SQL:
                found = difference(spark, con, QUERIES[name], SQL[name], folder)
                state = "ok" if found is None else "DIFF " + found
            else:
                state = f"rows {len(QUERIES[name](spark, folder).collect())}"
        except Exception as error:
            state = "FAIL " + str(error)[:600]
        bad += state.startswith(("DIFF", "FAIL"))
        print(f"{name:24s} {time.time() - began:6.2f}s {state}", flush=True)
    print("bad:", bad)
