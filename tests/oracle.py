"""Holding a query's rows against its DuckDB SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb

#: DuckDB types that a Spark type may come back as.
SAME = {
    "bigint": {"BIGINT"}, "string": {"VARCHAR"}, "double": {"DOUBLE"}, "boolean": {"BOOLEAN"}, "int": {"INTEGER"},
}


def connect(folder: str):
    con = duckdb.connect()
    for f in Path(folder).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    return round(v, 9) if isinstance(v, float) else bytes(v) if isinstance(v, bytearray) else v


def assert_same(df, con, sql: str) -> int:
    columns = sorted(df.columns)
    kinds = dict(df.dtypes)
    got = Counter(tuple(_plain(v) for v in r) for r in df.select(*columns).collect())
    res = con.execute(sql)
    names = [x[0] for x in res.description]
    types = {x[0]: str(x[1]) for x in res.description}
    assert sorted(names) == columns
    assert all(types[c] in SAME[kinds[c]] for c in columns), ({c: (kinds[c], types[c]) for c in columns if types[c] not in SAME[kinds[c]]})
    want = Counter(tuple(_plain(r[names.index(c)]) for c in columns) for r in res.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
    return sum(got.values())
