"""Run registered queries against their SQL and print what differs: python tests/check_oracles.py [names…]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name, query, oracle, sf_dir) -> str | None:
    """None if both give the same columns, types of values and rows; else what is wrong."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(oracle)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = rows_of(columns, cursor.fetchall())
    if got != want:
        extra, lacking = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"rows {sum(got.values())} vs {sum(want.values())}; only Spark {extra}; only SQL {lacking}"
    types = [{type(v) for row in side for v in row} for side in (got, want)]
    if types[0] != types[1]:
        return f"types {types}"
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from loomlog.session import local_session

    sf = "/root/testdata/sf0.01"
    spark, con = local_session(), duck(sf)
    oracles = oracle_sql()
    names = sys.argv[1:] or list(queries())
    bad = 0
    for name in names:
        started = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, name, queries()[name], oracles[name], sf)
            else:
                problem = f"(no SQL) {queries()[name](spark, sf).count()} rows"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += problem is not None
        print(f"{name:22s} {time.time() - started:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{len(names) - bad} of {len(names)} ok")
