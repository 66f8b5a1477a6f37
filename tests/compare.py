"""Runs a query and its SQL and compares the rows."""

import glob
import os

import numpy as np
import pandas as pd


def connect(folder):
    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def rows(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if not pd.api.types.is_numeric_dtype(frame[c]):
            frame[c] = frame[c].map(lambda v: "null" if v is None or v != v else str(v))
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


def assert_same(ours, theirs):
    assert sorted(ours.columns) == sorted(theirs.columns)
    a, b = rows(ours), rows(theirs)
    assert len(a) == len(b)
    for c in a.columns:
        if pd.api.types.is_numeric_dtype(a[c]) and pd.api.types.is_numeric_dtype(b[c]):
            assert np.allclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-9, equal_nan=True), c
        else:
            assert (a[c].astype(str) == b[c].astype(str)).all(), c
