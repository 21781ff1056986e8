"""Projection on a track, passages, speeds and estimates against plain loops."""

import math
import random

from headway.constants import DEGREE_M
from headway.functions.geo import Track
from headway.operators import passages as ops

LATS, LONS = [53.0, 53.02, 53.02, 53.05, 53.06], [-2.2, -2.2, -2.17, -2.17, -2.16]


def metres(a, b):
    return math.hypot((b[0] - a[0]) * DEGREE_M, (b[1] - a[1]) * DEGREE_M * math.cos(math.radians(a[0])))


def test_projection_by_a_plain_loop():
    rng = random.Random(1)
    track = Track(LATS, LONS)
    points = list(zip(LATS, LONS, strict=True))
    for _ in range(200):
        p = (53 + rng.random() * 0.07, -2.21 + rng.random() * 0.06)
        best, along = None, 0.0
        for a, b in zip(points, points[1:], strict=False):
            c = math.cos(math.radians(a[0]))
            bx, by, px, py = ((b[1] - a[1]) * DEGREE_M * c, (b[0] - a[0]) * DEGREE_M, (p[1] - a[1]) * DEGREE_M * c, (p[0] - a[0]) * DEGREE_M)
            t = max(0.0, min(1.0, (px * bx + py * by) / (bx * bx + by * by)))
            off = math.hypot(px - t * bx, py - t * by)
            if best is None or off < best[1]:
                best = (along + t * metres(a, b), off)
            along += metres(a, b)
        assert math.isclose(track.project(*p)[0], best[0], abs_tol=1e-6) and math.isclose(track.project(*p)[1], best[1], abs_tol=1e-6)
    for s in (0.0, 500.0, track.length[-1]):
        assert math.isclose(track.project(*track.point_at(s))[0], s, abs_tol=0.01)
    assert track.heading_at(10) == 0.0 and abs(track.heading_at(track.length[1] + 5) - 90) < 1e-9


def test_placed_reports_chain_and_leave_out_short_journeys(spark):
    track = Track(LATS, LONS)
    reports = [("j", "p", 1000 * k, *track.point_at(400.0 * k)) for k in range(12)] + [("j", "p", 4500, 53.9, -2.9)] + [("short", "p", 1000 * k, *track.point_at(300.0 * k)) for k in range(5)]
    df = spark.createDataFrame(reports, "journey_id string, pattern_id string, t long, lat double, lon double")
    tracks = spark.createDataFrame([("p", LATS, LONS)], "pattern_id string, lats array<double>, lons array<double>")
    got = sorted((r["t"], r["s"], r["on_road"]) for r in ops.placed(df, tracks).collect())
    assert len(got) == 13 and [r[0] for r in got if not r[2]] == [4500]
    assert all(math.isclose(s, 0.4 * t, abs_tol=0.05) for t, s, on in got if on)


def test_passages_by_a_plain_loop(spark):
    rng = random.Random(3)
    stops = [(0, "a", 100.0), (1, "b", 260.0), (2, "c", None), (3, "d", 700.0)]
    along, want = [], []
    for j in range(20):
        s, t, rows = 0.0, 0, []
        for _ in range(15):
            rows.append((f"j{j}", "p", t, s))
            t += rng.choice([10, 30, 90]) * 1000
            s = max(0.0, s + rng.uniform(-60, 130))
        along += rows
        visits = {}
        for (_, _, t0, s0), (_, _, t1, s1) in zip(rows, rows[1:], strict=False):
            if s1 < s0 - 5:
                continue
            for k, name, at in stops:
                if at is not None and s0 < at <= s1:
                    visits[k] = visits.get(k, 0) + 1
                    want.append((f"j{j}", name, int(t0 + (at - s0) / (s1 - s0) * (t1 - t0)), visits[k], (t1 - t0) / 1000 <= 60 and visits[k] == 1))
    df = spark.createDataFrame(along, "journey_id string, pattern_id string, t long, s double")
    held = spark.createDataFrame([("p", *x) for x in stops], "pattern_id string, stop_index int, stop string, offset_m double")
    got = [(r["journey_id"], r["stop"], r["passed_ms"], r["visit"], r["scoreable"]) for r in ops.passages(df, held).collect()]
    assert sorted(got) == sorted(want) and any(not x[4] for x in want)


def test_speed_by_a_plain_loop(spark):
    rng = random.Random(4)
    rows, s, t = [], 0.0, 0
    for _ in range(150):
        t += rng.choice([0, 8, 15, 40]) * 1000
        s += rng.choice([0, 5, 60, 200, -10, -40, 900])
        rows.append(("j", t, s))
    rows.sort(key=lambda r: (r[1], r[2]))
    want = []
    for i in range(len(rows)):
        start = i
        while start > 0 and rows[i][1] - rows[start - 1][1] <= 180_000:
            dt, ds = (rows[start][1] - rows[start - 1][1]) / 1000, rows[start][2] - rows[start - 1][2]
            if dt <= 0 or ds < -25 or ds / dt > 30:
                break
            start -= 1
        span = (rows[i][1] - rows[start][1]) / 1000
        want.append((rows[i][1], rows[i][2], round(max(0.0, min(20.0, (rows[i][2] - rows[start][2]) / span)), 6) if span >= 20 else None))
    df = spark.createDataFrame(rows, "journey_id string, t long, s double")
    got = [(r["t"], r["s"], None if r["speed"] is None else round(r["speed"], 6)) for r in ops.with_speed(df, ["journey_id"]).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
