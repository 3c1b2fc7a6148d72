"""Run registered queries in Spark and DuckDB and compare the rows.

``python -m checks.compare <sf folder> [query ...]``
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def difference(spark, con, query, sql: str, folder: str) -> str | None:
    """None when equal, else what differs."""
    result = query(spark, folder)
    rows = result.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    other = cursor.fetchall()
    if sorted(names) != sorted(result.columns):
        return f"columns {sorted(result.columns)} vs {sorted(names)}"
    kinds = dict(zip(names, [str(d[1]) for d in cursor.description]))
    known = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    for name, kind in result.dtypes:
        if known.get(kind, kind) != kinds[name]:
            return f"type of {name}: {kind} vs {kinds[name]}"
    mine, theirs = _bag(result.columns, rows), _bag(names, other)
    if mine != theirs:
        return (
            f"{len(rows)} vs {len(other)} rows; only here {list((mine - theirs).items())[:3]}; "
            f"only there {list((theirs - mine).items())[:3]}"
        )
    return None


def main() -> None:
    from access_engine.session import local_session
    from checks import ORACLE, QUERIES

    folder, *names = sys.argv[1:]
    spark = local_session()
    con = connect(folder)
    for name in names or QUERIES:
        start = time.time()
        if name in ORACLE:
            found = difference(spark, con, QUERIES[name], ORACLE[name], folder)
            note = "equal" if found is None else f"DIFFERS {found}"
        else:
            note = f"{QUERIES[name](spark, folder).count()} rows, no SQL"
        print(f"{name}: {note} ({time.time() - start:.1f}s)", flush=True)


if __name__ == "__main__":
    main()
