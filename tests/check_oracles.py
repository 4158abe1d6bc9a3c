"""Compare every query with its oracle SQL: ``python tests/check_oracles.py SF_DIR [name ...]``."""

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
from askframe.cluster import session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float):
        return f"{value:.6f}"
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(row[i]) for i in order) for row in rows)


def connect(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def compare(spark, con, sf, name, build, sql):
    """One line saying whether the two engines agree."""
    df = build(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    crossed = [j for j in ("CartesianProduct", "BroadcastNestedLoopJoin") if j in plan]
    if crossed:
        return False, f"plan holds {crossed}"
    ours = rows_of(df.columns, df.collect())
    if sql is None:
        return True, f"rows only ({len(ours)})"
    rel = con.sql(sql)
    theirs = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(rel.columns)}"
    if ours != theirs:
        only = [r for r in ours if r not in set(theirs)][:2]
        missing = [r for r in theirs if r not in set(ours)][:2]
        return False, f"{len(ours)} vs {len(theirs)} rows; ours {str(only)[:600]} oracle {str(missing)[:600]}"
    kinds = dict(zip(rel.columns, map(str, rel.types)))
    return True, f"{len(ours)} rows {[(f.name, f.dataType.simpleString(), kinds[f.name]) for f in df.schema]}"


if __name__ == "__main__":
    sf, names = sys.argv[1], sys.argv[2:]
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf), []
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, sf, name, build, entry.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__} {str(e)[:700]}"
        print("ok  " if ok else "FAIL", name, f"{time.time() - start:.1f}s", note, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
