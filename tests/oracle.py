"""Compare a query's result with its SQL run by DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def rows(names, records) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in records)


TYPES = {
    "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
}


def compare(df, con, sql: str) -> list[str]:
    """Differences in columns, types and values; none where the results agree."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = {c[0]: TYPES.get(str(c[1]), str(c[1])) for c in result.description}
    want = rows(names, result.fetchall())
    problems = []
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    if types != dict(df.dtypes):
        problems.append(f"types {sorted(df.dtypes)} != {sorted(types.items())}")
    have = rows(df.columns, df.collect())
    if have != want:
        problems.append(
            f"rows {sum(have.values())} vs {sum(want.values())};"
            f" only here {list((have - want).items())[:3]}; missing {list((want - have).items())[:3]}"
        )
    return problems
