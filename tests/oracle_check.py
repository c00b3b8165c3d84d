"""Run registered queries and their SQL side by side: ``python tests/oracle_check.py [sf] [key ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_rows(sf_dir: str, sql: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    frame = con.execute(sql)
    names = [c[0] for c in frame.description]
    return names, frame.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(row[i] for i in order) for row in rows]
    return [names[i] for i in order], sorted(cells, key=lambda r: tuple((v is not None, str(v)) for v in r))


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-12)
    return type(a) is type(b) and a == b


def compare(spark, sf_dir: str, key: str, queries, sql) -> tuple[str, int, float]:
    start = time.time()
    frame = queries[key](spark, sf_dir)
    rows = [tuple(r) for r in frame.collect()]
    took = time.time() - start
    if key not in sql:
        return "rows-only", len(rows), took
    got_names, got = canonical(frame.columns, rows)
    want_names, want = canonical(*oracle_rows(sf_dir, sql[key]))
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(rows), took
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} != {len(want)}: {extra}", len(rows), took
    for g, w in zip(got, want):
        if not all(same(x, y) for x, y in zip(g, w)):
            return f"value {g} != {w}", len(rows), took
    return "ok", len(rows), took


def main() -> None:
    sys.path.insert(0, ROOT)
    import __spark_entry__ as entry
    from rosterline.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.001"
    queries, sql = entry.queries(), entry.oracle_sql()
    spark = build_session("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    for key in sys.argv[2:] or queries:
        try:
            verdict, n, took = compare(spark, f"{DATA}/{sf}", key, queries, sql)
        except Exception as e:  # noqa: BLE001
            verdict, n, took = f"ERROR {type(e).__name__}: {str(e)[:300]}", -1, 0.0
        print(f"{key:28s} {n:8d} {took:6.1f}s  {verdict[:600]}", flush=True)


if __name__ == "__main__":
    main()
