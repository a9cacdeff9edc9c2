"""Compare registered queries with their SQL on the supplied tables.

    python tests/oracle.py SF_DIR [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, (datetime, date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a short text."""
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want_cols, want = rows_of(cols, res.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got != want:
        a, b = list((got - want).items())[:3], list((want - got).items())[:3]
        return f"rows {sum(got.values())} vs {sum(want.values())}; only here {a}; only there {b}; {got_cols}"
    # types
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
             "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}
    types = dict(df.dtypes)
    diff = [
        (c, types[c], str(t)) for c, t in zip(cols, [str(x[1]) for x in con.execute("DESCRIBE " + sql).fetchall()])
        if kinds.get(types[c], t) != t
    ]
    return f"TYPES {diff}" if diff else None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if names and not any(n == name or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                why = compare(df, con, oracles[name])
            else:
                why = f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            why = f"{type(e).__name__}: {str(e)[:600]}"
        ok = why is None or why.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t:.1f}s {why or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
