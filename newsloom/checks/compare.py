"""Run registered queries beside their SQL twins in DuckDB: ``python -m newsloom.checks.compare DIR [NAME...]``."""

import sys
import time
from collections import Counter
from decimal import Decimal

import duckdb

from newsloom.checks.oracle import ORACLE
from newsloom.checks.queries import REGISTERED
from newsloom.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _plain(value):
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.9g}"
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def _bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(frame, db: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same columns and the same rows, else what differs."""
    result = db.sql(sql)
    theirs_columns = result.columns
    if sorted(frame.columns) != sorted(theirs_columns):
        return f"columns {sorted(frame.columns)} / {sorted(theirs_columns)}"
    ours = _bag(frame.columns, frame.collect())
    theirs = _bag(theirs_columns, result.fetchall())
    if ours == theirs:
        return None
    only_ours, only_theirs = list((ours - theirs).elements()), list((theirs - ours).elements())
    return (
        f"rows {sum(ours.values())} / {sum(theirs.values())}, differing {len(only_ours)} / {len(only_theirs)}\n"
        f"    columns {sorted(frame.columns)}\n    spark  {only_ours[:2]}\n    duckdb {only_theirs[:2]}"
    )


def main(sf_dir: str, names: list[str]) -> int:
    spark, db, bad = local_session(), connect(sf_dir), 0
    for name in names or REGISTERED:
        started = time.time()
        try:
            frame = REGISTERED[name](spark, sf_dir)
            if name in ORACLE:
                found = difference(frame, db, ORACLE[name])
                verdict = "same" if found is None else found
            else:
                verdict = f"no SQL, {frame.count()} rows"
        except Exception as problem:
            verdict = f"{type(problem).__name__}: {str(problem)[:1500]}"
        bad += verdict != "same" and not verdict.startswith("no SQL")
        print(f"{name:28s} {time.time() - started:6.2f}s  {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
