"""Run registered queries next to their checking SQL and compare the rows.

python tests/compare.py [sf] [name-part ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, values in one form, rows sorted."""
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        s = frame[c]
        if pd.api.types.is_bool_dtype(s):
            frame[c] = s.astype(str)
        elif pd.api.types.is_numeric_dtype(s):
            frame[c] = s.astype(float)
        else:
            frame[c] = s.map(lambda v: "<null>" if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
    return frame.sort_values(list(frame.columns), kind="stable").reset_index(drop=True)


def difference(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None when equal, else the first difference."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)} rows"
    a, b = normal(left), normal(right)
    for c in a.columns:
        if a[c].dtype != b[c].dtype:
            return f"type of {c}: {left[c].dtype} != {right[c].dtype}"
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{c}: {(~same).sum()} differ, first {a[c][i]!r} != {b[c][i]!r}"
    return None


def main() -> int:
    import __spark_entry__ as e
    from steadycast.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            got = run(spark, sf_dir).toPandas()
            took = time.time() - start
            verdict = "rows only"
            if name in oracles:
                want = con.execute(oracles[name]).df()
                verdict = difference(got, want) or "ok"
                if verdict == "ok" and any(str(got[c].dtype) != str(want[c].dtype) for c in got):
                    verdict = "ok, types " + str(
                        {c: (str(got[c].dtype), str(want[c].dtype)) for c in got if str(got[c].dtype) != str(want[c].dtype)}
                    )
        except Exception as error:  # report and go on
            took, got = time.time() - start, []
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        if not verdict.startswith(("ok", "rows")):
            bad += 1
        print(f"{name:34s} {took:6.2f}s {len(got):8d} rows  {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))
