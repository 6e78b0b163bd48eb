"""Run registered queries beside their SQL and report differences.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_cell(v) for v in value)
    return value


def table_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def compare(spark, con, name: str, fn, text: str, sf: str) -> str | None:
    df = fn(spark, sf)
    got_names, got = table_rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(text)
    want_names, want = table_rows([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns differ: {got_names} / {want_names}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return f"row count {len(got)} / {len(want)}; ours {extra}; sql {lack}"
    if not got:
        return "both empty"
    bad = [(g, w) for g, w in zip(got, want) if g != w or list(map(type, g)) != list(map(type, w))]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ {got_names}\n   ours {bad[0][0]}\n   sql  {bad[0][1]}"
    return None


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf, argv = argv[1], argv[2:]
    spark, con = session(), duck(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = [n for n in queries if not argv or n in argv or any(a.endswith("*") and n.startswith(a[:-1]) for a in argv)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, name, queries[name], oracle[name], sf)
                kind = "ok"
            else:
                n = len(queries[name](spark, sf).collect())
                problem, kind = (None if n else "no rows"), f"rows-only {n}"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        took = time.time() - start
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {took:.1f}s {problem or kind}", flush=True)
    print(f"{len(names) - failed}/{len(names)} pass")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
