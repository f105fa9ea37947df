"""Compares a query with its SQL on the same parquet files, columns by name, rows in any order."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    clean = lambda v: "" if v is None or str(v) == "<NA>" or (isinstance(v, float) and math.isnan(v)) else str(v)
    return sorted(tuple(map(clean, r)) for r in pdf.itertuples(index=False))
