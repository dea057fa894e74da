"""Run registered queries against their SQL check in DuckDB and report differences.

usage: python tests/oracle_check.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def normalise(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        column = frame[name]
        if pd.api.types.is_bool_dtype(column):
            frame[name] = column.astype(object)
        elif pd.api.types.is_numeric_dtype(column):
            frame[name] = column.astype(float)
        elif pd.api.types.is_datetime64_any_dtype(column):
            frame[name] = column.astype(str)
        else:
            frame[name] = column.map(lambda v: None if v is None or (isinstance(v, float) and np.isnan(v)) else str(v)[:40])
    return frame.sort_values(list(frame.columns), na_position="last", ignore_index=True)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} vs {sorted(sql_frame.columns)}"
    if len(spark_frame) != len(sql_frame):
        return f"rows {len(spark_frame)} vs {len(sql_frame)}"
    a, b = normalise(spark_frame), normalise(sql_frame)
    for name in a.columns:
        x, y = a[name], b[name]
        if x.dtype != y.dtype and not (x.isna().all() and y.isna().all()):
            return f"{name}: dtype {x.dtype} vs {y.dtype}"
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            k = int(np.argmin(same.to_numpy()))
            return f"{name}: {(~same).sum()} differ, first {a.iloc[k].to_dict()} vs {b.iloc[k].to_dict()}"
    return None


def main() -> None:
    from mosarea.plans import catalog
    from mosarea.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(8)
    connection = connect(sf_dir)
    bad = 0
    for name, function in catalog.QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        try:
            start = time.time()
            ours = function(spark, sf_dir).toPandas()
            seconds = time.time() - start
            if name not in catalog.ORACLES:
                print(f"ROWS {name}: {len(ours)} rows {seconds:.1f}s", flush=True)
                continue
            start = time.time()
            theirs = connection.execute(catalog.ORACLES[name]).df()
            problem = differences(ours, theirs)
            took = f"{len(ours)} rows {seconds:.1f}s / sql {time.time() - start:.1f}s"
            print(f"{'OK  ' if problem is None else 'BAD '} {name}: {took} {problem or ''}", flush=True)
            bad += problem is not None
        except Exception as error:  # report and go on with the next query
            bad += 1
            text = str(error).strip().splitlines()
            print(f"FAIL {name}: {type(error).__name__} {' | '.join(text[:4])[:600]}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()
