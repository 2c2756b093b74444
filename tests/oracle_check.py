"""Runs a query and its SQL twin and compares columns, types and rows."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from quern.plans.inputs import TABLES  # noqa: E402

TYPE_NAMES = {
    "string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def _rows(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, sf_dir: str, queries, oracles) -> tuple[list[str], int, float, float]:
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    rel = con.execute(oracles[name])
    kinds = {d[0]: str(d[1]) for d in rel.description}
    want = rel.fetchall()
    t2 = time.time()
    problems = []
    if sorted(df.columns) != sorted(kinds):
        return [f"columns {sorted(df.columns)} against {sorted(kinds)}"], len(got), t1 - t0, t2 - t1
    for f in df.schema.fields:
        expected = TYPE_NAMES.get(f.dataType.simpleString())
        if expected != kinds[f.name]:
            problems.append(f"type of {f.name}: {f.dataType.simpleString()} against {kinds[f.name]}")
    a, b = _rows(df.columns, got), _rows([d[0] for d in rel.description], want)
    if a != b:
        problems.append(f"{len(got)} against {len(want)} rows")
        problems += [f"  ours   {str(r)[:300]}" for r in list((a - b).elements())[:3]]
        problems += [f"  theirs {str(r)[:300]}" for r in list((b - a).elements())[:3]]
    return problems, len(got), t1 - t0, t2 - t1


if __name__ == "__main__":
    import __spark_entry__ as entry
    from quern.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    session = build_session(
        master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in wanted or queries:
        if name not in oracles:
            t0 = time.time()
            n = len(queries[name](session, sf_dir).collect())
            print(f"rows  {name}: {n} rows, {time.time() - t0:.2f}s", flush=True)
            continue
        try:
            problems, n, ours, theirs = differences(session, con, name, sf_dir, queries, oracles)
        except Exception as error:  # report and go on
            problems, n, ours, theirs = [str(error)[:600]], 0, 0, 0
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '}  {name}: {n} rows, spark {ours:.2f}s, sql {theirs:.2f}s", flush=True)
        for p in problems:
            print("     ", p)
    print("missing oracles:", sorted(set(queries) - set(oracles)), "unused:", sorted(set(oracles) - set(queries)))
    print("bad:", bad)
