"""Run every query next to its SQL and compare: `python -m checks.compare [sf] [name ...]`."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

from checks.catalog import QUERIES
from checks.oracles import ORACLES

DATA = os.environ.get("TESTDATA_DIR", "/root/testdata")


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def tidy(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in a fixed order, values as text."""
    frame = frame[sorted(frame.columns)]
    text = frame.apply(lambda c: c.map(lambda v: "NULL" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)))
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """What differs between the query and its SQL, or None."""
    ours = QUERIES[name](spark, sf_dir).toPandas()
    theirs = con.execute(ORACLES[name]).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    if len(ours) == 0:
        return None
    kinds = {c: (ours[c].dtype, theirs[c].dtype) for c in ours if ours[c].dtype.kind != theirs[c].dtype.kind}
    a, b = tidy(ours), tidy(theirs)
    off = (a != b).any(axis=1)
    if off.any():
        return f"{off.sum()} of {len(a)} rows differ\n{a[off].head(3)}\n{b[off].head(3)}\n{kinds}"
    return f"kinds {kinds}" if kinds else None


def main() -> None:
    from muralog.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"{DATA}/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        begin = time.perf_counter()
        try:
            found = difference(spark, con, name, sf_dir) if name in ORACLES else f"rows only: {QUERIES[name](spark, sf_dir).count()}"
        except Exception as e:  # report and go on
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(found) and name in ORACLES
        print(f"{name:32s} {time.perf_counter() - begin:6.2f}s {found or 'ok'}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main()
