"""Runs the registered queries against DuckDB on one scale folder and prints the differences.

usage: python tools/check.py SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barriometrics.plans.catalog import ORACLES, QUERIES  # noqa: E402
from barriometrics.session import build_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            f = float(v)
            return "nan" if math.isnan(f) else repr(f)
        return str(v)

    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def kinds(rows, names):
    """The Python types each column holds, to catch a DECIMAL or BIGINT where the other side has DOUBLE."""
    return {n: {type(row[i]).__name__ for row in rows if row[i] is not None} for i, n in enumerate(names)}


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name, function in QUERIES.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            df = function(spark, folder)
            rows = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            if name not in ORACLES:
                print(f"rows {name:34s} {len(rows):7d} {spent:6.1f}s", flush=True)
                continue
            start = time.time()
            result = db.execute(ORACLES[name])
            names = [d[0] for d in result.description]
            expected = result.fetchall()
            sql_spent = time.time() - start
            ours, theirs = canonical(rows, df.columns), canonical(expected, names)
            if sorted(df.columns) != sorted(names):
                verdict = f"COLUMNS {sorted(df.columns)} / {sorted(names)}"
            elif ours != theirs:
                diff = [(a, b) for a, b in zip(ours, theirs) if a != b][:2]
                verdict = f"DIFF {len(ours)}/{len(theirs)} {diff}"
            elif kinds(rows, df.columns) != kinds(expected, names):
                a, b = kinds(rows, df.columns), kinds(expected, names)
                verdict = f"TYPES { {n: (a[n], b[n]) for n in a if a[n] != b[n]} }"
            else:
                verdict = "" if rows else "EMPTY"
            bad += bool(verdict)
            print(f"{'BAD ' if verdict else 'ok  '} {name:34s} {len(rows):7d} {spent:6.1f}s sql {sql_spent:5.1f}s {verdict}", flush=True)
        except Exception as problem:  # noqa: BLE001 - a failing query must not hide the others
            bad += 1
            print(f"BAD  {name:34s} {type(problem).__name__}: {str(problem)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
