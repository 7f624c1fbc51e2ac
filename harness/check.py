"""Compares every registered job with its oracle: python -m harness.check SF_DIR [key ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value.is_integer() else round(value, 9)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([canonical(row[i]) for i in order]) for row in rows)


def oracle_rows(sf_dir, sql, threads=None):
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return columns, result.fetchall()


def compare(df, sf_dir, sql):
    """None if equal, else a short description of the difference."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    columns, rows = oracle_rows(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    want = rows_of(columns, rows)
    if got == want:
        return None if got else "equal but empty"
    only_got, only_want = sorted(set(got) - set(want)), sorted(set(want) - set(got))
    return (f"{len(got)} vs {len(want)} rows; {sorted(df.columns)}\n   spark  {only_got[:2]}\n"
            f"   oracle {only_want[:2]}")


def main(argv):
    from harness import registry
    from mediaops.session import build_session

    registry.load_catalog()
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    sf_dir, keys = argv[0], argv[1:] or list(registry.QUERIES)
    bad = 0
    for key in keys:
        began = time.time()
        try:
            problem = compare(registry.QUERIES[key](spark, sf_dir), sf_dir, registry.ORACLES.get(key))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        mark = "ok" if problem is None else "BAD"
        note = "" if key in registry.ORACLES else " (no oracle)"
        print(f"{mark} {key} {time.time() - began:.1f}s{note} {problem or ''}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
