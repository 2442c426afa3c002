"""Comparison of Spark results with DuckDB's over the same files."""

import glob
import os

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].copy()
    for k in frame:
        frame[k] = frame[k].map(lambda v: None if v is None or v != v else str(v))
    return sorted(map(tuple, frame.itertuples(index=False)), key=str)
