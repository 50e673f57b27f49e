"""Registered queries against their SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return "null" if math.isnan(x) else repr(round(x, 9))
    return "null" if x is None else str(x)


def rows(table, columns: list[str]) -> list[tuple]:
    data = table.select(columns).to_pydict()
    return sorted(zip(*[map(_plain, data[c]) for c in columns], strict=True))


def differences(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if the query and the SQL give the same columns and rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want, got = result.to_arrow_table(), query(spark, sf_dir).toArrow()
    columns = sorted(names)
    if sorted(got.column_names) != columns:
        return f"{name}: columns {sorted(got.column_names)}, SQL {columns}"
    kinds = [(c, str(got.schema.field(c).type).replace("large_", ""), str(want.schema.field(c).type)) for c in columns if str(got.schema.field(c).type).replace("large_", "") != str(want.schema.field(c).type)]
    a, b = rows(got, columns), rows(want, columns)
    if a != b:
        only = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{name}: {len(a)} rows, SQL {len(b)}; {only}"
    return f"{name}: types {kinds}" if kinds else ""
