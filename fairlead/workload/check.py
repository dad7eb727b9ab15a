"""Compares registered queries with their SQL on one data directory.

    python -m fairlead.workload.check SF_DIR [name ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def normal(pdf):
    pdf = pdf[sorted(pdf.columns)]
    pdf = pdf.where(pdf.notna(), None)
    rows = []
    for r in pdf.itertuples(index=False):
        rows.append(tuple(None if v is None or v != v else (float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v) for v in r))
    return sorted(rows, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


def compare(spark, con, name: str, sf_dir: str, queries, oracles) -> tuple[str, int, float]:
    start = time.time()
    got = queries[name](spark, sf_dir).toPandas().astype(object)
    took = time.time() - start
    if name not in oracles:
        return ("rows-only", len(got), took)
    want = con.execute(oracles[name]).df().astype(object)
    if sorted(got.columns) != sorted(want.columns):
        return (f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}", len(got), took)
    a, b = normal(got), normal(want)
    if len(a) != len(b):
        return (f"ROWS {len(a)} != {len(b)}", len(got), took)
    for x, y in zip(a, b):
        if x != y:
            return (f"VALUES {sorted(got.columns)} {x} != {y}", len(got), took)
    return ("ok", len(got), took)


def main() -> None:
    from fairlead.workload import all_queries
    from fairlead.workload.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    queries, oracles = all_queries()
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in queries:
        if names and not any(name.startswith(n) for n in names):
            continue
        try:
            verdict, rows, took = compare(spark, con, name, sf_dir, queries, oracles)
        except Exception as exc:  # noqa: BLE001 - report and go on with the next query
            verdict, rows, took = f"ERROR {type(exc).__name__}: {str(exc)[:700]}", -1, 0.0
        bad += verdict not in ("ok", "rows-only")
        print(f"{name:36s} {rows:7d} {took:7.2f}s  {verdict[:900]}", flush=True)
    print(f"{bad} not ok")


if __name__ == "__main__":
    main()
