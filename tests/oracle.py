"""Compare registered queries with their SQL counterpart in DuckDB."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return 0.0 if value == 0 else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> tuple[str, str]:
    df = fn(spark, sf_dir)
    rows = [tuple(plain(v) for v in r) for r in df.collect()]
    if sql is None:
        return ("rows", f"{len(rows)} rows")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    expected = [tuple(plain(v) for v in r) for r in cur.fetchall()]
    if sorted(names) != sorted(df.columns):
        return ("FAIL", f"columns {sorted(df.columns)} vs {sorted(names)}")
    a_order = [df.columns.index(c) for c in sorted(names)]
    b_order = [names.index(c) for c in sorted(names)]
    key = repr
    a = sorted((tuple(r[i] for i in a_order) for r in rows), key=key)
    b = sorted((tuple(r[i] for i in b_order) for r in expected), key=key)
    if len(a) != len(b):
        return ("FAIL", f"{len(a)} rows vs {len(b)}; first {a[:2]} vs {b[:2]}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return ("FAIL", f"{len(bad)} of {len(a)} rows differ in {sorted(names)}: {bad[0][0]} vs {bad[0][1]}")
    kinds = [(type(x).__name__, type(y).__name__) for r, s in zip(a[:50], b[:50]) for x, y in zip(r, s) if x is not None]
    mixed = {k for k in kinds if k[0] != k[1]}
    return ("ok" if a else "EMPTY", f"{len(a)} rows{' types ' + str(mixed) if mixed else ''}")


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    from kinloom.session import build_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            state, text = compare(spark, con, fn, oracle.get(name), sf_dir)
        except Exception as error:  # report every query
            state, text = "ERROR", str(error)[:700]
        failed += state not in ("ok", "rows")
        print(f"{state:6} {name:34} {time.time() - start:6.2f}s {text}", flush=True)
    print("failed:", failed, "of", len(queries), "with SQL:", len(oracle))
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv))
