"""Files written and read again, lenient parsing, derived series by hand, late rows of a stream."""

import json

import numpy as np
import pytest

from kinetra.operators import derived as D
from kinetra.sources import scripts as R


def points(spark, rows):
    return spark.createDataFrame(rows, "series_id long, axis string, at long, pos int, seq long")


def test_write_and_read_files(spark, tmp_path):
    df = points(spark, [(1, "stroke", 10, 5, 1), (1, "stroke", 0, 7, 0), (1, "roll", 3, 9, 0), (2, "stroke", 1, 2, 0)])
    R.write_documents(R.unified_documents(df), str(tmp_path / "all"))
    docs = [json.loads(line) for p in (tmp_path / "all").glob("*.txt") for line in p.read_text().splitlines()]
    assert sorted(len(d["actions"]) for d in docs) == [1, 2] and {a["name"] for d in docs for a in d["axes"]} == {"roll"}
    R.write_documents(R.single_documents(df), str(tmp_path / "axes"), per_axis=True)
    assert {p.name for p in (tmp_path / "axes").iterdir() if p.is_dir()} == {"axis=stroke", "axis=roll"}
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "v.script").write_text(json.dumps({"actions": [{"at": 5, "pos": 50}], "metadata": {"chapters": [{"name": "a", "startTime": "00:00:01.000", "endTime": "00:00:02.000"}]}}))
    parsed = R.parse(R.read_documents(spark, str(tmp_path / "one")))
    assert [tuple(r)[2:4] for r in R.read_scripts(parsed, ["path"]).collect()] == [(5, 50)]
    chapter = R.read_script_chapters(parsed, ["path"]).collect()[0]
    assert (chapter.label, chapter.start_frame, chapter.end_frame) == ("a", 30, 59)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("", []), ("[]", []), ("{", []), ('{"actions": 7}', []), ('{"actions": []}', []), ('{"actions": [{"at": "12.7", "pos": -5}, {"at": 3}, {"at": -1, "pos": 4}, null]}', [(12, 0)]),
        ('{"actions": [{"at": 9, "pos": 150}, {"at": 1, "pos": 3.9}]}', [(1, 3), (9, 100)]),
    ],
)
def test_lenient_parse(spark, text, found):
    docs = spark.createDataFrame([("p", text)], "path string, value string")
    assert sorted((r.at, r.pos) for r in R.read_scripts(R.parse(docs), ["path"]).collect()) == found


def test_axis_files(spark):
    names = ["/a/x.script", "/a/x.roll.script", "/a/x_t2.script", "/a/x_t1.script", "/a/x_t5.script", "/a/x.mp4", "/a/y.twist.script"]
    got = {(r.base, r.axis): r.path for r in R.discover_axis_files(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert got == {("x", "stroke"): names[0], ("x", "roll"): names[1], ("x", "axis_5"): names[4], ("y", "twist"): names[6]}


def test_moving_average():
    x = np.array([1.0, 2.0, 4.0, 8.0])
    assert D.moving_average(x, 3).tolist() == pytest.approx([4 / 3, 7 / 3, 14 / 3, 20 / 3])
    assert D.moving_average(x, 4).tolist() == pytest.approx([(2 + 1 + 1 + 2) / 4, (1 + 1 + 2 + 4) / 4, 15 / 4, (2 + 4 + 8 + 8) / 4])
    assert len(D.moving_average(np.array([5.0]), 7)) == 1


def test_generated_axes():
    at, pos = np.arange(50) * 100, (50 + 50 * np.sin(np.arange(50) / 3)).astype(int)
    for axis in ("roll", "pitch", "sway", "surge", "twist"):
        y = D.generated_axis(at, pos, axis)
        assert len(y) == 50 and np.isfinite(y).all() and y.min() >= 0 and y.max() <= 100
    assert (D.generated_axis(at, pos, "twist") == D.generated_axis(at, pos, "twist")).all()
    with pytest.raises(ValueError):
        D.generated_axis(at, pos, "none")


def test_repeated_by_hand():
    at = np.arange(9) * 100
    pos = np.array([90, 40, 10, 90, 20, 80, 30, 70, 10])
    out = D.repeated(at, pos, at >= 300, False)
    # the cycle 90 40 10 90 replaces the valley between the peaks at 300 and 500
    assert (400, 20) not in out and (300, 90) in out and (500, 80) in out and {p for t, p in out if 300 < t < 500} == {40, 10}
    assert D.repeated(at, pos, at < 0, False) == list(zip(at.tolist(), pos.tolist(), strict=True))


def test_built_by_hand():
    assert D.built([[0, 100, "a"], [101, 110, "b"], [111, 200, "a"]], 1, ("idle",)) == [[0, 200, "a"]]
    assert D.built([[0, 100, "a"], [101, 125, "idle"], [126, 300, "b"]], 1, ("idle",)) == [[0, 100, "a"], [101, 300, "b"]]
    assert D.built([[0, 5, "idle"]], 1, ("idle",)) == [[0, 5, "idle"]]


def test_onsets():
    x = np.zeros(4000)
    x[1000:1100] = x[3000:3100] = np.sin(np.arange(100))
    t = D.onsets(x, 1000, 128, 32, gap_s=0.3)
    assert len(t) == 2 and abs(t[0] - 1) < 0.2 and abs(t[1] - 3) < 0.2
    assert len(D.onsets(np.zeros(4000), 1000, 128, 32)) == 0 and len(D.onsets(x[:10], 1000)) == 0


def test_label_persistence(spark):
    """Keypoints move together; 3 of them must be known, and the area is 100, so a move of d is a difference of 10 d."""
    pose = lambda d, conf=1.0: [(float(k + d), float(k), conf) for k in range(3)]
    rows = [(1, 1, "a", pose(0), 100.0), (1, 2, "idle", pose(0.2), 100.0), (1, 3, "idle", None, None), (1, 4, "idle", pose(9), 100.0), (2, 1, "idle", pose(0), 100.0)]
    rows += [(3, 1, "b", pose(0), 100.0), (3, 2, "idle", pose(0), 100.0), (4, 1, "a", pose(0), 100.0), (4, 2, "idle", pose(0, 0.1), 100.0)]
    df = spark.createDataFrame(rows, "series_id long, frame_id long, label string, pose array<struct<x: double, y: double, conf: double>>, area double")
    got = [r.label for r in D.label_persistence(df, "idle", {"a": [0, 1, 2]}).orderBy("series_id", "frame_id").collect()]
    assert got == ["a", "a", "a", "idle", "idle", "b", "idle", "a", "idle"]


def plain_axis(at, pos, axis, smoothing):
    """A derived axis from its description, a point at a time."""
    n = len(at)
    v = [(pos[i + 1] - pos[i]) / ((at[i + 1] - at[i]) or 1) for i in range(n - 1)]
    v.append(v[-1])

    def mean(x, i, size):
        places = range(i - size // 2, i + size - size // 2)
        mirror = lambda k: (k % (2 * n)) if k % (2 * n) < n else 2 * n - 1 - k % (2 * n)
        return sum(x[mirror(k)] for k in places) / size

    def around(x, k):
        return [mean(x, i, max(3, int(smoothing * k))) for i in range(n)]

    if axis == "roll":
        return [50 + 40 * y for y in around([(s > 0) - (s < 0) for s in v], 2)]
    if axis == "pitch":
        a = [v[i + 1] - v[i] for i in range(n - 1)]
        a = around([*a, a[-1]], 3)
        spread = 3 * (sum((x - sum(a) / n) ** 2 for x in a) / n) ** 0.5
        return [50 + 40 * min(1, max(-1, x / spread if spread > 0 else x)) for x in a]
    if axis == "sway":
        x = around(pos, 5)
        x = [y - sum(x) / n for y in x]
        most = max(map(abs, x))
        return [50 + 30 * (y / most if most > 0 else y) for y in x]
    reach = max(3, int(smoothing * 3))
    top = around([max(abs(s) for s in v[max(0, i - reach) : i + 1]) for i in range(n)], 2)
    return [50 + 60 * ((y / max(top) if max(top) > 0 else y) - 0.5) for y in top]


@pytest.mark.parametrize("axis", ["roll", "pitch", "sway", "surge"])
def test_generated_axes_point_by_point(axis):
    r = np.random.default_rng(7)
    for n, smoothing in ((4, 5), (9, 1), (60, 3.5), (150, 5)):
        at, pos = np.cumsum(r.integers(0, 200, n)), r.integers(0, 101, n)
        assert D.generated_axis(at, pos, axis, smoothing=smoothing).tolist() == pytest.approx(plain_axis(at.tolist(), pos.tolist(), axis, smoothing))
    assert D.generated_axis(np.arange(5) * 100, np.full(5, 40), axis).tolist() == pytest.approx(plain_axis([0, 100, 200, 300, 400], [40] * 5, axis, 5))
