"""The motion estimate on a straight road against a plain reading of its rules, and what is chosen from its errors."""

import math
import random

import pytest

from headway.operators import motion
from headway.operators.motion import Settings

SF = "/root/testdata/sf0.001"


def naive_advance(stops, s, speed, seconds, p, step=0.001):
    """A vehicle moved on in small steps of time."""
    waits, at = {x: p.dwell for x in stops if x > s + p.stop_tolerance} if p.dwell else {}, s
    left = seconds
    while left > step / 2:
        due = next((x for x in sorted(waits) if abs(x - at) <= speed * step / 2 and waits[x] > step / 2), None)
        if due is not None:
            waits[due] -= step
        else:
            at += speed * step
        left -= step
    return at


@pytest.mark.parametrize("dwell", [0.0, 3.0])
def test_advance_in_small_steps(dwell):
    p = Settings(dwell=dwell)
    for s, speed, seconds in ((0.0, 7.0, 20.0), (25.0, 4.0, 11.0), (90.0, 10.0, 30.0), (5.0, 0.0, 9.0), (5.0, 3.0, 0.0)):
        assert motion.advance([30.0, 50.0, 120.0], s, speed, seconds, p) == pytest.approx(naive_advance([30.0, 50.0, 120.0], s, speed, seconds, p), abs=0.2)


def test_speeds_and_refusals():
    p = Settings()
    ask = lambda pairs, **kw: motion.speed_of([t * 1000 for t, _ in pairs], [float(s) for _, s in pairs], Settings(**kw) if kw else p)[:2]
    assert ask([(0, 0)]) == (None, "one_report")
    assert ask([(0, 0), (5, 30)]) == (None, "too_close")
    assert ask([(0, 0), (20, 100)]) == (5.0, None)
    assert ask([(0, 0), (20, 1000)]) == (None, "jumped")
    assert ask([(0, 0), (20, 1000), (24, 1002), (30, 1010)]) == (None, "too_few_since_jump")
    assert ask([(0, 0), (20, 1000), (40, 1100)]) == (5.0, None)
    assert ask([(0, 0), (200, 600)]) == (None, "too_far_apart")
    assert ask([(0, 100), (20, 60)]) == (None, "went_backwards")
    assert ask([(0, 100), (20, 90)]) == (0.0, None)
    assert ask([(0, 0), (20, 400), (40, 410)]) == (410 / 40, None)
    assert ask([(0, 0), (20, 400), (40, 402)], cruise=True) == (min(17.0, 400 / 20), None)
    assert motion.speed_of([0, 20_000, 40_000], [0.0, 200.0, 203.0], p)[2]
    assert motion.estimate([0, 20_000, 40_000], [0.0, 200.0, 203.0], 0.0, 50_000, 1e4, [], p) == (None, "standing")
    held = Settings(hold=15.0)
    assert motion.estimate([0, 20_000, 40_000], [0.0, 200.0, 203.0], 0.0, 50_000, 1e4, [], held) == (203.0, None)
    assert motion.estimate([0, 20_000, 40_000], [0.0, 200.0, 203.0], 0.0, 60_000, 1e4, [], held) == (203 + 5 * 203 / 40, None)
    assert motion.estimate([0, 20_000], [0.0, 100.0], 41.0, 25_000, 1e4, [], p) == (None, "off_the_road")
    assert motion.estimate([0, 20_000], [0.0, 100.0], 0.0, 171_000, 1e4, [], p) == (None, "too_old")
    assert motion.estimate([0, 20_000], [0.0, 100.0], 0.0, 100_000, 1e4, [], p) == (100 + 5 * 30, None)
    assert motion.estimate([0, 20_000], [0.0, 100.0], 0.0, 40_000, 150.0, [], p) == (150.0, None)
    assert motion.estimate([0, 20_000], [0.0, 100.0], 0.0, 40_000, 1e4, [], Settings(decay=10.0))[0] == pytest.approx(100 + 5 * 10 * (1 - math.exp(-2)))


def straight(rng, n):
    """Reports on a road along a parallel: (at s, available s, metres), one of them late and one doubled."""
    t, s, out = 0, 0.0, []
    for _ in range(n):
        t, s = t + rng.randrange(8, 40), s + rng.choice([0, 60, 150, 260])
        out.append((t, t + rng.randrange(1, 12), s))
    out[3] = (out[3][0], out[3][1] + 90, out[3][2])
    return [*out, (out[5][0], out[5][1] + 3, out[5][2] + 40)]


def test_only_what_was_known_counts(spark):
    rng = random.Random(4)
    lat, per = 53.0, math.cos(math.radians(53.0)) * 111_320.0
    lon = lambda s: -2.0 + s / per
    journeys = {j: straight(rng, 25) for j in range(6)}
    rows = [(j, j % 3, a * 1000, v * 1000, lat, lon(s)) for j, x in journeys.items() for a, v, s in x]
    reports = spark.createDataFrame(rows, "journey long, pattern_id long, at long, available long, lat double, lon double")
    roads = spark.createDataFrame([(k, [lat, lat], [lon(0), lon(20_000)], [300.0, 900.0, 1500.0]) for k in range(2)], "pattern_id long, lats array<double>, lons array<double>, stops array<double>")
    p = Settings(horizon=60.0, dwell=5.0, hold=10.0)
    want = []
    for j, x in journeys.items():
        once = {}
        for a, v, s in sorted(x):
            once.setdefault(a, (a, v, s))
        fixes = [once[a] for a in sorted(once)]
        for k, (a, v, s) in enumerate(fixes):
            known = [f for f in fixes if f[1] <= v]
            if known[-1][0] != a:
                continue
            for b, _, there in fixes[k + 1 :]:
                if b - a <= 120:
                    est, why = motion.estimate([f[0] * 1000 for f in known[-12:]], [f[2] for f in known[-12:]], 0.0, b * 1000, 20_000.0, [300.0, 900.0, 1500.0], p) if j % 3 < 2 else (None, "no_road")
                    want.append((j, a * 1000, b * 1000, None if est is None else round(abs(est - there), 0), round(abs(there - s), 0), why))
    got = motion.scores(reports, roads, p).collect()
    near = sorted(want, key=repr)
    mine = sorted(((r["journey"], r["basis_at"], r["target_at"], None if r["error_m"] is None else r["error_m"], r["baseline_m"], r["reason"]) for r in got), key=lambda r: repr((r[0], r[1], r[2])))
    near.sort(key=lambda r: repr((r[0], r[1], r[2])))
    assert len(mine) == len(near) > 100
    for a, b in zip(mine, near, strict=True):
        assert a[:3] == b[:3] and a[5] == b[5] and (a[3] is None) == (b[3] is None)
        assert a[4] == pytest.approx(b[4], abs=0.02 * b[4] + 1) and (a[3] is None or a[3] == pytest.approx(b[3], abs=0.02 * b[3] + 2))
    table = motion.compared(reports, roads, motion.grid()[:3])
    sums = {r["setting"]: r["n"] for r in table.collect()}
    assert set(sums) == {0, 1, 2} and motion.chosen(table).count() == 1


def test_choice_among_settings_and_horizon(spark):
    table = spark.createDataFrame([(0, 9, 100.0, 5, 30.0), (1, 9, 101.0, 5, 20.0), (2, 9, 103.0, 5, 1.0), (3, 9, 101.5, 5, 20.0), (4, 0, 0.0, 0, 0.0)], "setting int, n long, mean_m double, moves long, mean_move_m double")
    assert motion.chosen(table).first()["setting"] == 1
    bins = [(10, 50, 5.0, 1.0, 9.0, 0.6), (20, 50, 8.0, 1.0, 9.0, 0.6), (30, 19, 1.0, 1.0, 9.0, 0.6), (45, 50, 1.0, 1.0, 9.0, 0.6)]
    make = lambda rows: spark.createDataFrame(rows, "up_to int, n long, p50 double, p80 double, baseline_p50 double, better double")
    assert motion.supported_horizon(make(bins)).first()["horizon_s"] == 20
    assert motion.supported_horizon(make([(a, 50, 1.0, 1.0, 2.0, 0.5) for a in motion.AGES])).first()["horizon_s"] == 120
    assert motion.supported_horizon(make([])).first()["horizon_s"] == 0


def test_a_report_is_sought_on_the_road_once(monkeypatch):
    """A journey's work grows with its reports, not with reports times those known, and speeds are worked out once for settings that read them alike."""
    rng = random.Random(8)
    lats, lons = [53.0 + rng.uniform(0, 0.05) for _ in range(30)], [-2.0 + k * 0.01 for k in range(30)]
    road, reports, t = motion.Track(lats, lons), [], 0
    for k in range(400):
        t += rng.randrange(8_000, 40_000)
        lat, lon = road.point_at(100.0 * k)
        reports.append({"at": t, "available": t + rng.choice([0, 4_000, 90_000]), "lat": lat + rng.uniform(0, 0.0002), "lon": lon})
    j = motion.Journey(reports, lats, lons, [500.0 * k for k in range(40)])
    calls, speeds = [], []
    whole = motion.Track.project
    monkeypatch.setattr(motion.Track, "project", lambda self, lat, lon, first=0, last=None: calls.append(last) or whole(self, lat, lon, first, last))
    speed_of = motion.speed_of
    monkeypatch.setattr(motion, "speed_of", lambda *a: speeds.append(1) or speed_of(*a))
    settings = motion.grid(Settings(horizon=120.0))[:50]
    pairs = [sum(1 for _ in j.errors(p)) for p in settings]
    moves = [sum(1 for _ in j.moves(p)) for p in settings]
    assert min(pairs) == max(pairs) > 400 and max(moves) > 10
    assert None not in calls  # only stretches of the road, where the nearest point of the whole lies outside
    assert len(speeds) <= 3 * len(reports)  # with each report, before it, and not once for each of 50 settings
    for (segment, s, off), (lat, lon) in zip(j.on_road, j.points, strict=True):
        assert (s, off) == whole(j.track, lat, lon) and j.track.ends[segment] <= s <= j.track.ends[segment + 1]
    for k in range(len(reports)):
        upto = [f for f in sorted(reports, key=lambda r: r["at"]) if f["available"] <= j.available[k]]
        assert j.newest(k) == (upto[-1]["at"] == j.at[k])
        if j.newest(k):
            assert [j.at[i] for i in reversed(j.known(k, j.available[k]))] == [f["at"] for f in upto[-12:]]


def test_every_setting_of_the_family_is_compared(spark, tmp_path):
    """motion_settings tries the whole family, and asking all settings at once gives what each of them gives by itself."""
    from pyspark.sql import functions as F

    from headway.plans import registry
    from headway.plans.motion import world

    x = spark.range(500).select("id", (F.col("id") % 7).alias("user_id"), (F.timestamp_seconds(1_704_067_200 + F.col("id") * 4_000 + F.col("id") * F.col("id") % 9_000)).alias("ts"), (F.col("id") * 37 % 11 * F.col("id") % 90 * 1.0).alias("value"))
    x.withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["setting"]: r for r in registry.QUERIES["motion_settings"](spark, str(tmp_path)).collect()}
    settings = motion.grid(Settings(horizon=120.0))
    assert sorted(got) == list(range(len(settings))) and len(settings) == 100
    reports, roads = (rows.collect() for rows in world(spark, str(tmp_path)))
    road = {r["pattern_id"]: (r["lats"], r["lons"], r["stops"]) for r in roads}
    journeys = [motion.Journey([r.asDict() for r in reports if r["journey"] == j], *road.get(j % 5, (None,) * 3)) for j in range(7)]
    for k, p in enumerate(settings):
        errors = [e for j in journeys for _, _, _, e, _ in j.errors(p, 60) if e is not None]
        moves = [abs(m) for j in journeys for m in j.moves(p)]
        assert (got[k]["n"], got[k]["moves"]) == (len(errors), len(moves)) and len(errors) > 50 and len(moves) > 50
        assert got[k]["mean_m"] == pytest.approx(sum(errors) / len(errors), rel=1e-9) and got[k]["mean_move_m"] == pytest.approx(sum(moves) / len(moves), rel=1e-9)
    assert len({round(r["mean_m"], 6) for r in got.values()}) > 20
