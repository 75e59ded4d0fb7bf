"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from graphloom import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(rows):
    one = lambda x: round(x, 6) if isinstance(x, float) else x.isoformat() if hasattr(x, "isoformat") else x
    return sorted((tuple(map(one, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(engine.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = engine.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = plain(df.select(*[f"`{c}`" for c in columns]).collect())
    want = plain(duck.execute(f"select {', '.join(f'"{c}"' for c in columns)} from ({engine.oracle_sql()[name]})").fetchall())
    assert got == want


def test_flow_queries_equal_plain_scans(spark):
    events = sorted(spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts", "event_id").collect(), key=lambda r: (r.user_id, r.ts, r.event_id))
    kept, batches, windows = set(), {}, {}
    users = {}
    for r in events:
        users.setdefault(r.user_id, []).append(r)
    for rows in users.values():
        last, start, held, n, w, ws = rows[0].ts, None, 0, 0, -1, None
        for r in rows:
            if (r.ts - last).total_seconds() >= 6 * 3600:
                kept.add(r.event_id)
                last = r.ts
            start, held = start or r.ts, held + 1
            batches[r.event_id] = n
            if held >= 5 or (r.ts - start).total_seconds() >= 3600:
                start, held, n = None, 0, n + 1
            if ws is None or (r.ts - ws).total_seconds() >= 3600:
                ws, w = r.ts, w + 1
            windows[r.event_id] = w
        kept.add(rows[-1].event_id)
    run = lambda n: engine.queries()[n](spark, SF).collect()
    assert {r.event_id for r in run("t5_sampled")} == kept
    assert {r.event_id: r.batch for r in run("t2_batches")} == batches
    assert {r.event_id: r.window for r in run("t1_anchored_windows")} == windows
