"""Run queries on Spark and their SQL twins on DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import sys
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float)):
        if isinstance(value, float) and value != value:
            return "nan"
        return round(float(value), 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(item) for item in value)
    return value


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    values = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(values, key=repr)


def spark_rows(frame):
    return normalized(frame.columns, [tuple(row) for row in frame.collect()])


def duck_rows(con, sql):
    cursor = con.execute(sql)
    return normalized([item[0] for item in cursor.description], cursor.fetchall())


def difference(left, right):
    """None when equal, else a short description."""
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if left[1] == right[1]:
        return None
    only_left = sorted(set(map(repr, left[1])) - set(map(repr, right[1])))
    only_right = sorted(set(map(repr, right[1])) - set(map(repr, left[1])))
    return (
        f"rows {len(left[1])} vs {len(right[1])}; spark only {len(only_left)}: "
        f"{only_left[:3]}; sql only {len(only_right)}: {only_right[:3]}"
    )


def main(names, folder="/root/testdata/sf0.01"):
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as contract
    from tests.conftest import build_session

    spark = build_session()
    con = connect(folder)
    queries, oracles = contract.queries(), contract.oracle_sql()
    bad = []
    for name in names or list(queries):
        try:
            started = time.time()
            mine = spark_rows(queries[name](spark, folder))
            spark_time = time.time() - started
            if name not in oracles:
                print(f"ROWS {name} rows={len(mine[1])} spark={spark_time:.1f}s", flush=True)
                continue
            started = time.time()
            theirs = duck_rows(con, oracles[name])
            note = difference(mine, theirs)
            print(
                f"{'OK' if note is None else 'DIFF'} {name} rows={len(mine[1])} "
                f"spark={spark_time:.1f}s duck={time.time() - started:.1f}s {note or ''}",
                flush=True,
            )
            if note:
                bad.append(name)
        except Exception as problem:  # keep going, report at the end
            text = "".join(traceback.format_exception_only(problem))
            lines = traceback.format_exc().splitlines()
            spots = [line.strip() for line in lines if "lumenmart" in line]
            print(f"FAIL {name} {spots[-1:]} {text[:900]}", flush=True)
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    arguments = sys.argv[1:]
    target = "/root/testdata/sf0.01"
    if arguments and arguments[0].startswith("/"):
        target = arguments.pop(0)
    main(arguments, target)
