"""Run the named queries in Spark and DuckDB and compare all rows: python tests/differential.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(names: list[str], rows) -> list[tuple]:
    """Rows with columns in name order, sorted as text, so that only values matter."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str) -> tuple[int, str]:
    """(rows, problem); the problem is empty when both engines agree in names, types of numbers and values."""
    df = fn(spark, sf_dir)
    ours = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = canonical(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return len(ours), f"columns {sorted(df.columns)} / {sorted(names)}"
    if repr(ours) == repr(theirs):
        return len(ours), ""
    gone = [(a, b) for a, b in zip(ours, theirs) if repr(a) != repr(b)][:2]
    return len(ours), f"rows {len(ours)} / {len(theirs)}; {gone}"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from catalens.session import local_session

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = oracle_connection(sf_dir), oracle_sql(), []
    for name, fn in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t0 = time.time()
        try:
            if name in sql:
                n, problem = compare(spark, con, sf_dir, fn, sql[name])
            else:
                n, problem = fn(spark, sf_dir).count(), ""
        except Exception as e:  # report and go on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += [name] if problem else []
        print(f"{name:26s} {n:8d} {time.time() - t0:6.1f}s {'' if name in sql else '(rows only) '}{problem or 'ok'}"[:900],
              flush=True)
    print("DIFFERENT:", bad)


if __name__ == "__main__":
    main()
