"""Stop mapping, assembled roads and the segment index against loops."""

import math
import random

from pyspark.sql import functions as F

from headway.operators import shapes

TOLERANCE = 1.5e-5


def loop_mapping(stops, routed, offsets):
    if len(routed) != len(offsets):
        return "counts_differ"
    out, j = [], 0
    for (lat, lon), offset in zip(routed, offsets, strict=True):
        while j < len(stops) and (stops[j][1] is None or abs(stops[j][1] - lat) > TOLERANCE or abs(stops[j][2] - lon) > TOLERANCE):
            j += 1
        if j == len(stops):
            return "no_stop_of_the_pattern"
        out.append((j, stops[j][0], offset))
        j += 1
    return out


def test_ordered_alignment(spark):
    rng = random.Random(1)
    places = {s: (53 + rng.random(), -2 + rng.random()) for s in "abcdefg"} | {"twin": None, "lost": (None, None)}
    places["twin"] = places["a"]
    rows, want = [], {}
    for k in range(120):
        stops = [(s, *places[s]) for s in (rng.choice([*places]) for _ in range(rng.randrange(0, 9)))]
        kept = [s for s in stops if s[1] is not None and rng.random() < 0.8]
        routed = [(s[1] + 1e-6, s[2] - 1e-6) for s in kept]
        if k % 7 == 0:
            routed.append((1.0, 1.0))
        if k % 5 == 0:
            routed = routed[::-1]
        offsets = [float(i * 10) for i in range(len(routed) + (k % 11 == 0))]
        rows.append((k, stops, routed, offsets))
        want[k] = loop_mapping(stops, routed, offsets)
    df = spark.createDataFrame(rows, "pattern_id long, stops array<struct<stop:string,lat:double,lon:double>>, routed array<struct<lat:double,lon:double>>, offsets array<double>")
    got = {r["pattern_id"]: r["refused"] or [tuple(o) for o in r["occurrences"]] for r in shapes.mapped(df).collect()}
    assert got == want and {type(v) for v in want.values()} == {str, list}


def test_windows_of_stops(spark):
    for n, size in ((0, 10), (1, 10), (2, 10), (10, 10), (11, 10), (19, 10), (20, 10), (7, 3)):
        stops = [str(k) for k in range(n)]
        want, start = [], 0
        while start < n - 1:
            want.append(stops[start : start + size])
            start = min(start + size, n) - 1
        df = spark.createDataFrame([(stops,)], "s array<string>")
        assert df.select(shapes.windows(F.col("s"), size)).first()[0] == want


def metres(a, b):
    return math.hypot(math.radians(b[1] - a[1]) * math.cos(math.radians((a[0] + b[0]) / 2)), math.radians(b[0] - a[0])) * 6_371_008.8


def test_legs_to_one_road(spark):
    legs = [(0, 0, [(53.0, -2.0), (53.001, -2.0)]), (0, 1, [(53.001, -2.0), (53.001, -2.002), (53.002, -2.002)]), (0, 2, [(53.002, -2.002)]), (0, 3, [(53.003, -2.002), (53.004, -2.003)]), (1, 0, [(10.0, 10.0), (10.0, 10.0)])]
    points, total, offsets, held = {}, {}, {}, {}
    for p, _, leg in legs:
        for k, x in enumerate(leg):
            if k == 0 and held.get(p) == x:
                continue
            total[p] = total.get(p, 0.0) + (metres(held[p], x) if p in held else 0.0)
            held[p] = x
            points.setdefault(p, []).append((x, total[p]))
        offsets.setdefault(p, [0.0]).append(round(total.get(p, 0.0), 1))
    road, at = shapes.assembled(spark.createDataFrame(legs, "pattern_id long, leg int, points array<struct<lat:double,lon:double>>"))
    for p in (0, 1):
        got = road.filter(F.col("pattern_id") == p).orderBy("vertex").collect()
        assert [(r["lat"], r["lon"]) for r in got] == [x for x, _ in points[p]] and all(abs(r["along"] - d) < 1e-6 for r, (_, d) in zip(got, points[p], strict=True))
        assert [r["offset"] for r in at.filter(F.col("pattern_id") == p).orderBy("stop_at").collect()] == offsets[p]


def test_nearest_segment_near_and_far(spark):
    rng = random.Random(7)
    roads = {p: [(53 + p + rng.uniform(-0.01, 0.01), -2 + rng.uniform(-0.02, 0.02)) for _ in range(12)] for p in range(4)} | {9: [(50.0, 0.0)], 8: [(60.0, 179.0), (60.0, 179.0)]}
    reports = [(p, k, 53 + p + rng.uniform(-0.02, 0.02), -2 + rng.uniform(-0.04, 0.04)) for p in range(4) for k in range(60)] + [(8, 0, 60.001, 179.0), (9, 0, 50.0, 0.0), (0, 99, None, 1.0), (7, 0, 1.0, 1.0)]
    reports += reports[:5]

    def off(p, lat, lon):
        kx, best = math.cos(math.radians(lat)) * 111_195.0, math.inf
        for (ay, ax), (by, bx) in zip(roads.get(p, [])[:-1], roads.get(p, [])[1:], strict=True):
            dx, dy, px, py = (bx - ax) * kx, (by - ay) * 111_195.0, (lon - ax) * kx, (lat - ay) * 111_195.0
            t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx * dx + dy * dy else 0.0
            best = min(best, math.hypot(px - t * dx, py - t * dy))
        return None if best == math.inf else round(best, 6)

    v = spark.createDataFrame([(p, k, *xy) for p, xs in roads.items() for k, xy in enumerate(xs)], "pattern_id long, vertex int, lat double, lon double")
    got = shapes.offsets_from(spark.createDataFrame(reports, "pattern_id long, report long, lat double, lon double"), v).collect()
    assert sorted(((r["pattern_id"], r["report"], None if r["off_m"] is None else round(r["off_m"], 6)) for r in got), key=repr) == sorted(((p, k, None if lat is None else off(p, lat, lon)) for p, k, lat, lon in reports), key=repr)


def test_shared_stretches_and_how_they_are_found(spark):
    rng = random.Random(21)
    roads = {p: [(53 + (rng.random() < 0.2) * 0.001 + rng.uniform(0, 1e-4), -2 + 0.0005 * k) for k in range(rng.randrange(20, 40))] for p in range(6)} | {7: [(53.0, -2.0)]}
    sets = [(s, p, p == s) for s in range(5) for p in (s, s + 1, (s + 3) % 6)] + [(5, 5, True), (6, 0, True), (6, 7, False), (8, 1, True), (8, 99, False)]

    def off(p, lat, lon):
        kx, best = math.cos(math.radians(lat)) * 111_195.0, math.inf
        for (ay, ax), (by, bx) in zip(roads.get(p, [])[:-1], roads.get(p, [])[1:], strict=True):
            dx, dy, px, py = (bx - ax) * kx, (by - ay) * 111_195.0, (lon - ax) * kx, (lat - ay) * 111_195.0
            t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy)))
            best = min(best, math.hypot(px - t * dx, py - t * dy))
        return best

    want = []
    for s in {x[0] for x in sets}:
        road, others = roads[next(p for t, p, c in sets if t == s and c)], [p for t, p, c in sets if t == s and not c]
        along, runs, last = 0.0, [], False
        for k, at in enumerate(road):
            along += metres(road[k - 1], at) if k else 0.0
            shared = all(off(p, *at) <= 10 for p in others)
            if shared:
                runs = [*runs[:-1], (runs[-1][0], along)] if last else [*runs, (along, along)]
            last = shared
        want += [(s, k + 1, round(a, 3), round(z, 3)) for k, (a, z) in enumerate(r for r in runs if r[1] > r[0])]
    v = spark.createDataFrame([(p, k, *xy) for p, xs in roads.items() for k, xy in enumerate(xs)], "pattern_id long, vertex int, lat double, lon double")
    got = shapes.shared_roads(spark.createDataFrame(sets, "set_id long, pattern_id long, checked boolean"), v)
    assert sorted((r["set_id"], r["piece"], round(r["from_m"], 3), round(r["to_m"], 3)) for r in got.collect()) == sorted(want) and len(want) > 12
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistenceJoin" in plan and "LeftAnti" not in plan  # no vertex meets a whole road


def test_verdicts(spark):
    v = spark.createDataFrame([(p, k, 53.0, -2.0 + k * 0.01) for p in (1, 2, 3) for k in range(2)] + [(4, 0, 53.0, -2.0)], "pattern_id long, vertex int, lat double, lon double")
    reports = [(1, 53.0 + k * 1e-6, -1.995) for k in range(30)] + [(2, 53.0 + k * 1e-4, -1.995) for k in range(40)] + [(3, 53.0, -1.99)]
    got = {r["pattern_id"]: (r["reports"], r["status"], r["reason"]) for r in shapes.validated(spark.createDataFrame(reports, "pattern_id long, lat double, lon double"), v).collect()}
    assert got == {1: (30, "accepted", None), 2: (40, "rejected", "too_far"), 3: (1, "rejected", "too_few_reports"), 4: (0, "rejected", "no_path")}


def test_repeated_reports_are_measured_once(spark):
    v = spark.createDataFrame([(1, k, 53.0, -2.0 + k * 0.01) for k in range(3)], "pattern_id long, vertex int, lat double, lon double")
    at = [(1e-6, 20), (2e-4, 12), (4e-4, 5), (0.03, 3)]  # degrees off the road, reports there; the last is beyond any cell's reach
    found = shapes.validated(spark.createDataFrame([(1, 53.0 + d, -1.995) for d, n in at for _ in range(n)] + [(1, None, -1.995)], "pattern_id long, lat double, lon double"), v)
    off = sorted(d * 111_195.0 for d, n in at for _ in range(n))
    linear = lambda q: off[int(39 * q)] + (off[min(int(39 * q) + 1, 39)] - off[int(39 * q)]) * (39 * q % 1)
    r = found.first()
    assert (r["reports"], r["within30"], r["reason"]) == (40, 32 / 40, "too_far") and abs(r["p50"] - linear(0.5)) < 1e-4 and abs(r["p95"] - linear(0.95)) < 1e-4
    assert "HYPOT" not in found._jdf.queryExecution().optimizedPlan().toString()  # what is asked of the distances does not measure them again


def test_encoded_roads(spark):
    from headway.functions.geo import encode_polyline

    rng = random.Random(3)
    roads = {k: [(round(rng.uniform(-80, 80), 6), round(rng.uniform(-179, 179), 6)) for _ in range(rng.randrange(0, 30))] for k in range(10)}
    assert encode_polyline([(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)], 5) == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"  # the format's own published example
    df = spark.createDataFrame([(k, encode_polyline(v) if v else "") for k, v in roads.items()] + [(99, None)], "pattern_id long, polyline6 string")
    got = {}
    for r in shapes.vertices_of(df).orderBy("pattern_id", "vertex").collect():
        got.setdefault(r["pattern_id"], []).append((round(r["lat"], 6), round(r["lon"], 6)))
    assert got == {k: v for k, v in roads.items() if v}


def test_a_schema_that_only_grows(spark):
    import pytest

    from headway.operators.ledger import migrated

    old = spark.createDataFrame([(1, "a")], "id long, name string")
    wider = spark.createDataFrame([], "id long, added date, name string").schema
    assert [tuple(r) for r in migrated(old, wider).collect()] == [(1, None, "a")]
    for kinds in ("id long", "id string, name string"):
        with pytest.raises(ValueError, match="lost or change"):
            migrated(old, spark.createDataFrame([], kinds).schema)
