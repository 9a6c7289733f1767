"""Run a registered query and its SQL on the same tables and compare whole results."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _family(values: pd.Series) -> str:
    kind = values.dropna()
    if kind.empty:
        return "empty"
    first = kind.iloc[0]
    if isinstance(first, bool) or kind.dtype == bool:
        return "bool"
    return {"i": "int", "u": "int", "f": "float"}.get(kind.dtype.kind, type(first).__name__)


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
        return "~"
    return v.item() if hasattr(v, "item") else v


def differences(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    cols = sorted(got.columns)
    for c in cols:
        a, b = _family(got[c]), _family(want[c])
        if a != b and "empty" not in (a, b):
            return f"column {c}: {a} != {b}"
    order = lambda df: sorted(map(repr, (tuple(_cell(x) for x in r) for r in df[cols].itertuples(index=False))))
    left, right = order(got), order(want)
    for a, b in zip(left, right):
        if a != b:
            return f"row {a[:300]} != {b[:300]}"
    return None
