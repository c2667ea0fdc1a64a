"""Runs a query on Spark and its SQL twin on DuckDB and compares the two results."""

from __future__ import annotations

import math
import time

import duckdb

TIMES: dict[str, float] = {}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(folder: str):
    connection = duckdb.connect()
    connection.execute("SET threads = 8")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return connection


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, int):
        return repr(float(value))
    return str(value)


def rows(columns: list[str], records) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted((tuple(plain(r[at]) for at in order) for r in records), key=lambda r: tuple((v is None, v or "") for v in r))


def compare(spark, connection, name: str, folder: str) -> str | None:
    """None where both agree, else what differs."""
    from probita.plans import registry
    df = registry.queries()[name](spark, folder)
    start = time.time()
    mine = [tuple(r) for r in df.collect()]
    TIMES[name] = time.time() - start
    result = connection.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    theirs = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")]
    if nested:
        return f"nested columns {nested}"
    left, right = rows(df.columns, mine), rows(columns, theirs)
    if len(left) != len(right):
        only = list(set(left) - set(right))[:2], list(set(right) - set(left))[:2]
        return f"rows {len(left)} vs {len(right)} {only}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ, e.g.\n  {sorted(columns)}\n  spark {wrong[0][0]}\n  sql   {wrong[0][1]}"
    if not left:
        return "both empty"
    return None


def main() -> None:
    import sys

    from probita.plans import registry
    from probita.session import build_session
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", partitions=8)
    spark.sparkContext.setLogLevel("OFF")
    connection = duck(folder)
    names = [n for n in registry.queries() if not wanted or any(n.startswith(w) for w in wanted)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in registry.oracle_sql():
                problem = compare(spark, connection, name, folder)
            else:
                problem = f"(no SQL) rows={registry.queries()[name](spark, folder).count()}"
        except Exception as error:
            problem = f"ERROR {type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem and not problem.startswith("(no SQL)"))
        print(f"{name:36s} {time.time() - start:6.2f}s (collect {TIMES.get(name, 0):.2f}s) {problem or 'ok'}", flush=True)
    print(f"{bad} bad of {len(names)}")


if __name__ == "__main__":
    main()
