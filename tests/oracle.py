"""Compare a query's rows with those of its SQL in DuckDB, regardless of order."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{source}'")
    return con


def canonical(df: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].dt.strftime("%Y-%m-%d %H:%M:%S")
        elif df[c].dtype == object and len(df) and hasattr(df[c].dropna().iloc[0] if df[c].notna().any() else None, "isoformat"):
            df[c] = df[c].map(lambda v: v.strftime("%Y-%m-%d 00:00:00") if pd.notna(v) else v)
    return df.sort_values(keys + [c for c in df.columns if c not in keys], kind="stable", na_position="last").reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame, close: float = 1e-9) -> str:
    """Empty where both hold the same rows."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    keys = [c for c in sorted(ours.columns) if not (pd.api.types.is_float_dtype(ours[c]) or pd.api.types.is_float_dtype(theirs[c]))]
    a, b = canonical(ours, keys), canonical(theirs, keys)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            x, y = a[c].astype(float), b[c].astype(float)
            bad = ~((x == y) | ((x - y).abs() <= close * (1 + y.abs())) | (x.isna() & y.isna()))
        else:
            bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            return f"{bad.sum()} of {len(a)} rows differ in {c}: {a.loc[i].to_dict()} and {b.loc[i].to_dict()}"
    return ""
