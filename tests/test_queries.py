"""Every query with SQL gives DuckDB's rows on the smallest tables; streams give what their batch twins give."""

import math
from pathlib import Path

import duckdb
import pytest

from kinetra.operators import compound, sequential
from kinetra.plans import catalog
from kinetra.plans.registry import PRESETS, Param, Step, filters, get, register_filter, run_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the test tables are not here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("name", ["ingest", "beats", "amplify", "flow_position", "pose_ema", "rate_limit"])
def test_stream_equals_batch(spark, name):
    rows = lambda q: sorted(map(tuple, catalog.QUERIES[q](spark, SF).select("series_id", "t", "seq", "out").collect()))
    assert rows(f"stream_{name}") == rows(f"batch_{name}")


def test_rows_do_not_depend_on_partitions(spark):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return [sorted(map(str, catalog.QUERIES[q](spark, SF).collect())) for q in ("keyframes", "ultimate_autotune", "track_boxes", "match_peaks", "smooth_tracks")]

    one, seven = rows(1), rows(7)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert one == seven


def points(spark, rows):
    return spark.createDataFrame(rows, "series_id long, axis string, at long, pos int, seq long")


def test_small_series(spark):
    df = points(spark, [(1, "stroke", 0, 50, 1), (2, "stroke", 0, 50, 1), (2, "stroke", 100, 60, 2), (3, "roll", 0, 10, 1), (3, "roll", 0, 20, 2), (3, "roll", 50, 20, 3)])
    for name in filters():
        for rows in (df, df.limit(0)):
            out = get(name)(rows).collect()
            assert all(0 <= r.pos <= 100 for r in out), name
    assert compound.match_peaks(df, df.limit(0)).where("kind = 'main'").count() > 0


def test_registry(spark):
    df = points(spark, [(1, "stroke", i * 100, i * 10 % 100, i) for i in range(20)] + [(1, "roll", 0, 30, 1)])
    register_filter("flip_in_test", lambda rows, by: rows.assign(pos=(by - rows["pos"]).astype("int32")), by=Param(int, 100, 0, 100))
    out, errors = run_pipeline(df, [Step("flip_in_test"), Step("flip_in_test", {"by": 101}), Step("nothing"), Step("invert", enabled=False)], "stroke")
    assert len(errors) == 2 and "nothing" in errors[1]
    assert sorted(map(tuple, out.collect())) == sorted((s, a, t, 100 - p if a == "stroke" else p, q) for s, a, t, p, q in map(tuple, df.collect()))
    with pytest.raises(ValueError):
        register_filter("invert", lambda rows: rows)
    with pytest.raises(ValueError):
        get("amplify")(df, size=1)
    assert all(not run_pipeline(df, steps)[1] for steps in PRESETS.values())


def test_speed_of_limited_series(spark):
    from kinetra.operators.windows import segment_speeds

    from kinetra.plans.base import points as of

    out = segment_speeds(sequential.speed_limit(of(spark, SF), 60, 0, 30)).where("speed > 30 + 500 / (end - start)")
    assert out.count() == 0


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_peak_classes_add_up(spark):
    """Counts by series and by chapter, from the matches one by one."""
    from kinetra.operators import comparison
    from kinetra.plans.base import points
    from kinetra.plans.q_joins import chapters

    p = points(spark, SF)
    peaks = comparison.classified_peaks(p.where("seq % 2 = 0"), p.where("seq % 2 = 1"), window=2000)
    rows = peaks.collect()

    def kind(r):
        gap = abs(r.pos - r.ref_pos)
        return next((c for c, t, d in (("gold", 1000 / 30, 3), ("green", 66, 7), ("yellow", 133, 15)) if r.offset < t and gap < d), "red")

    want = {}
    for r in rows:
        own = want.setdefault((r.series_id, r.axis), {})
        for k in (r.kind, kind(r) if r.kind == "matched" else None):
            own[k] = own.get(k, 0) + 1
    for r in comparison.peak_classes(peaks).collect():
        own = want[r.series_id, r.axis]
        assert (r.matched, r.unmatched_main, r.unmatched_ref) == tuple(own.get(k, 0) for k in ("matched", "main", "ref"))
        assert [r[c] for c in comparison.CLASSES] == [own.get(c, 0) for c in comparison.CLASSES] and r.total == r.matched + r.unmatched_main + r.unmatched_ref
    spans = chapters(spark, SF).collect()
    total, good = {}, {}
    for r in rows:
        at = r.ref_at if r.at is None else r.at
        for c in spans:
            if c.series_id == r.series_id and c.start_ms <= at <= c.end_ms:
                key = (r.axis, c.chapter_id)
                total[key] = total.get(key, 0) + 1
                good[key] = good.get(key, 0) + (r["class"] in ("gold", "green"))
    found = comparison.peaks_by_chapter(peaks, chapters(spark, SF)).collect()
    assert {(r.axis, r.chapter_id): r.peaks_total for r in found} == total and {(r.axis, r.chapter_id): r.peaks_good for r in found} == good


def test_signal_gate_frame_by_frame(spark):
    from statistics import fmean, pstdev

    from kinetra.operators import tracks
    from kinetra.plans.q_tracks import moving

    series = {}
    for r in tracks.signal_gate(moving(spark, SF)).collect():
        series.setdefault(r.series_id, []).append((r.frame_id, r.value, r.motion, r.dy, r.out))
    clip = lambda x: min(100, max(0, x))
    for rows in series.values():
        rows.sort()
        seen, out = [], []
        for i, (_, v, motion, dy, got) in enumerate(rows):
            value = v
            if i:
                mean, spread = (fmean(seen[-10:]), max(1.0, pstdev(seen[-10:]))) if seen else (0.0, 1.0)
                low, high, was = max(15.0, mean - 0.5 * spread), max(35.0, mean + 1.5 * spread), rows[i - 1][1]
                change = abs(v - was)
                if change > 8 and motion < low:
                    value = int(was + (v - was) * (1.0 - 0.3))
                elif motion > high and change < 8:
                    value = clip(v + (1 if dy > 0 else -1) * int(0.3 * min(motion / high, 2.0) * 20))
                elif change > 8 and motion > low:
                    value = clip(was + int((v - was) * (1.0 + 0.3 * 0.5)))
                seen.append(motion)
                if len(out) >= 3 and abs(out[-1] - out[-2]) > 8 and abs(out[-2] - out[-3]) > 8:
                    value = clip(int(value * 0.7 + out[-2] * (1 - 0.7)))
            out.append(value)
            assert got == value
