"""Streams over a table of several files that overlap in time."""

from pathlib import Path

import duckdb
import pytest

from kinetra.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def overlapping(spark, tmp_path_factory):
    """``events`` in three files, each over the whole time."""
    out = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(f"{SF}/events.parquet")
    for i in range(3):
        rows.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{out}/events.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["ingest", "rate_limit", "beats", "amplify", "flow_position", "pose_ema", "quiet_runs", "metronome"])
def test_stream_equals_batch(spark, overlapping, name):
    rows = lambda q: sorted(map(tuple, catalog.QUERIES[q](spark, overlapping).select("series_id", "t", "seq", "out").collect()))
    got = rows(f"stream_{name}")
    assert got and got == rows(f"batch_{name}")


@pytest.mark.parametrize("name", ["stream_rate", "stream_problem_windows", "stream_sessions"])
def test_windows_match_sql(spark, overlapping, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    want = con.execute(catalog.ORACLES[name])
    cols = [d[0] for d in want.description]
    got = catalog.QUERIES[name](spark, overlapping).select(*cols).collect()
    plain = lambda rows: sorted(str([round(v, 5) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(map(tuple, got)) == plain(want.fetchall())


def test_rolling_filter_against_plain_batches(spark):
    """The windows of the touched series are tuned after each part; what they have left never changes again."""
    import numpy as np

    from kinetra.operators import kernels
    from kinetra.plans.q_derived import rolling_parts

    closed, open_ = {}, {}
    for part in rolling_parts(spark, SF):
        new = {}
        for r in part.collect():
            new.setdefault(r.series_id, []).append((r.at, r.seq, r.pos))
        for s, rows in new.items():
            rows = sorted(open_.get(s, []) + rows)
            since = max(r[0] for r in rows) - 20_000
            closed.setdefault(s, []).extend(r for r in rows if r[0] < since)
            tail = [r for r in rows if r[0] >= since]
            place, pos = kernels.tuned(np.array([r[0] for r in tail]), np.array([r[2] for r in tail]), 1.2, 50, 800, 15, 10, 15)
            open_[s] = [(tail[i][0], tail[i][1], int(p)) for i, p in zip(place.tolist(), pos.tolist())]
    want = sorted((s, at, p) for rows in (closed, open_) for s, own in rows.items() for at, _, p in own)
    got = sorted((r.series_id, r.at, r.pos) for r in catalog.QUERIES["stream_rolling_filter"](spark, SF).collect())
    assert got == want


def test_idle_series_lose_their_state(spark, tmp_path):
    """A series that is silent for ``idle_ms`` starts anew; one that goes on keeps its state."""
    from kinetra.plans.q_streaming import state_store
    from kinetra.streaming import jobs

    rows = [(1, t, t, 50.0, t) for t in (5, 100)] + [(2, t, t, 50.0, t) for t in range(10, 100_000, 5000)] + [(1, 100_000, 99, 50.0, 100_000), (3, 300_000, 1, 1.0, 300_000)]
    schema = "series_id long, t long, seq long, v double, ms long"
    for i, part in enumerate((rows[:2] + rows[2:4], rows[4:15], rows[15:22], rows[22:], [(3, 400_000, 2, 1.0, 400_000)])):
        if part:
            spark.createDataFrame(part, schema).selectExpr("*", "timestamp_millis(ms) ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with state_store(spark):
        out = jobs.stream(live, "ema", 1000, 20_000)
        jobs.run_to_table(out, f"{tmp_path}/out", "append", f"{tmp_path}/state")
    got = spark.read.parquet(f"{tmp_path}/out").where("series_id = 1").collect()
    assert {r.t for r in got} == {5, 100, 100_000}


def plain_points(rows, gap, fps, tolerance):
    """A list of points that arrivals in time order extend, update and thin, as a whole list."""
    points = []
    for t, v in rows:
        at, pos = round(round(t * fps / 1000) / fps * 1000) if fps else t, min(100, max(0, round(v)))
        if points and at == points[-1][0]:
            points[-1] = (at, pos)
        elif not points or at - points[-1][0] >= gap:
            points.append((at, pos))
            if len(points) > 2:
                (t1, p1), (t2, p2), (t3, p3) = points[-3:]
                peak = p1 < p2 > p3 or p1 > p2 < p3
                if not peak and abs((t2 - t1) * (p3 - p1) - (t3 - t1) * (p2 - p1)) <= tolerance * (t3 - t1):
                    del points[-2]
    return points


@pytest.mark.parametrize("params", [{}, {"gap": 300, "fps": 7}, {"gap": 1000, "fps": 0.5, "tolerance": 15}])
def test_late_rows_take_their_place(spark, tmp_path, params):
    """Files that overlap in time by less than the lateness; state keeps nothing that the watermark has passed."""
    import random
    import time

    from kinetra.plans.q_streaming import state_store
    from kinetra.streaming import jobs

    r = random.Random(len(params))
    rows = [(s, t, i, float(r.choice([r.randint(-20, 120), t // 100 % 100, 50])), t) for s in range(4) for i, t in enumerate(sorted(r.choices(range(60_000), k=300)))]
    schema = "series_id long, t long, seq long, v double, ms long"
    late = [min(6, (x[4] + r.choice([0, 4_000])) // 10_000) for x in rows]
    parts = [[x for x, k in zip(rows, late, strict=True) if k == at] for at in range(7)]
    for k, part in enumerate([p for p in parts if p]):
        spark.createDataFrame(part, schema).selectExpr("*", "timestamp_millis(ms) ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)  # files are read in the order of their times, in seconds
    every = sorted(rows)
    live = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with state_store(spark):
        out = jobs.stream(live, "ingest", 20_000, 5_000_000, **params)
        jobs.run_to_table(out, f"{tmp_path}/out", "append", f"{tmp_path}/state")
        got = {}
        for x in spark.read.parquet(f"{tmp_path}/out").collect():
            got.setdefault(x.series_id, []).append((x.t, int(x.out)))
        passed = max(x[4] for x in every) - 20_000
        waiting = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", "waiting").load().select("key.series_id", "list_element.ts").collect()
    full = {"gap": 10, "fps": 0, "tolerance": 2, **params}
    for s in range(4):
        want = plain_points([(x[1], x[3]) for x in every if x[0] == s and x[4] <= passed], **full)
        assert sorted(got[s]) == want[:-1]  # the last point may still change
    assert sorted((x.series_id, x.ts) for x in waiting) == sorted((x[0], x[4]) for x in every if x[4] > passed)


def test_lateness_is_what_files_reach_back(spark, tmp_path):
    import os

    from kinetra.plans.q_streaming import lateness

    for k, (low, high) in enumerate([(0, 100), (90, 200), (150, 300), (120, 310)]):
        df = spark.createDataFrame([(low,), (high,)], "s long").selectExpr("CAST(timestamp_seconds(s) AS TIMESTAMP_NTZ) AS ts").coalesce(1)
        df.write.mode("append").parquet(f"{tmp_path}/events.parquet")
        new = max((f for f in Path(f"{tmp_path}/events.parquet").glob("*.parquet")), key=lambda f: f.stat().st_ctime_ns)
        os.utime(new, (1_000 + min(k, 2), 1_000 + min(k, 2)))
    assert lateness(spark, str(tmp_path)) == 180_000 + 1_000  # the last two files have one time: 300 may come before 120


def test_blocks_of_series_share_a_key(spark, tmp_path):
    """Series that share a key of the state give what each gives alone, rows that come late and ends of series included."""
    import random
    import time

    from kinetra.plans.q_streaming import state_store
    from kinetra.streaming import jobs

    r = random.Random(5)
    rows = [(s, t, i, r.random() * 100, t) for s in range(-5, 35) for i, t in enumerate(sorted(r.choices(range(s * 500 + 2500, 60_000), k=30)))]
    rows += [(1000, 10_000_000, 99, 7.0, 10_000_000)]  # lets the watermark pass all others
    schema = "series_id long, t long, seq long, v double, ms long"
    for part in ([x for x in rows if x[4] < 40_000 and x[2] % 7], [x for x in rows if x[4] < 60_000 and not (x[4] < 40_000 and x[2] % 7)], rows[-1:]):
        spark.createDataFrame(part, schema).selectExpr("*", "timestamp_millis(ms) ts").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(1.1)
    got = {}
    for together in (1, 8):
        live = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with state_store(spark):
            out = jobs.stream(live, "quiet_runs", 60_000, 5_000_000, together, min_move=60, min_ms=500)
            jobs.run_to_table(out, f"{tmp_path}/out{together}", "append", f"{tmp_path}/state{together}")
            left = spark.read.format("statestore").option("path", f"{tmp_path}/state{together}").option("stateVarName", "waiting").option("batchId", 1).load()
            assert left.select("key").distinct().count() == {1: 40, 8: 6}[together]
        got[together] = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out{together}").select("series_id", "t", "seq", "out").collect()))
    plain = jobs.batch(spark.createDataFrame(rows[:-1], schema), "quiet_runs", min_move=60, min_ms=500)
    assert got[8] and got[8] == got[1] == sorted(map(tuple, plain.select("series_id", "t", "seq", "out").collect()))


def test_rolling_filter_is_fed_by_many_tasks(spark, tmp_path, monkeypatch):
    """Each of the three arrivals is one micro-batch of several files, none written by a single task."""
    from kinetra.plans import q_derived

    monkeypatch.setattr(q_derived, "_shared", lambda spark: str(tmp_path / "job"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert catalog.QUERIES["stream_rolling_filter"](spark, SF).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "job/in").glob("*.parquet"))) > 6
    assert len(list((tmp_path / "job/out/open").glob("batch=*"))) == 3
