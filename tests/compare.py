"""Compare registered queries with their SQL, value by value.

    python -m tests.compare /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r),
    )


_KINDS = {
    "string": "VARCHAR",
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
}


def differences(df, con, sql: str) -> list[str]:
    """What differs: column names, types, row count, or the first unequal rows."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    theirs = cur.fetchall()
    ours = df.collect()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    out = []
    for name, kind in df.dtypes:
        if _KINDS.get(kind, kind) != types[name]:
            out.append(f"type of {name}: {kind} vs {types[name]}")
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    if len(a) != len(b):
        out.append(f"rows {len(a)} vs {len(b)}")
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        out.append(f"{len(bad)} rows differ: {str(bad[:1])[:600]}")
    return out


def main() -> None:
    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from tests.session import session

    sf, wanted = sys.argv[1], sys.argv[2:]
    spark, con, failed = session(), connect(sf), []
    sql = oracle_sql()
    for name, query in queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            found = differences(query(spark, sf), con, sql[name]) if name in sql else ["no SQL"]
        except Exception as problem:  # noqa: BLE001
            found = [f"{type(problem).__name__}: {str(problem)[:1500]}"]
        print(f"{name:32s} {time.time() - start:6.2f}s  {'ok' if not found else found}", flush=True)
        failed += [name] if found else []
    print("failed:", failed)


if __name__ == "__main__":
    main()
