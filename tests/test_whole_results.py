"""Queries that leave nothing out, against brute force on a small fixture whose ids lie beyond any fixed subset."""

import re
from datetime import datetime

import pytest

from headway.operators import planner
from headway.plans import registry

#: Stops in the order of call by pattern.
PATTERNS = {5: [7, 101, 102, 103], 10: [103, 101, 104], 11: [102, 104, 7], 13: [104, 101], 17: [101, 103, 104, 7, 102], 23: [105]}


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("small"))
    calls = [(p, s, k + 1, datetime(1996, 1, 1)) for p, stops in PATTERNS.items() for k, s in enumerate(stops)]
    spark.createDataFrame(calls, "l_orderkey long, l_suppkey long, l_linenumber int, l_shipdate timestamp").write.parquet(f"{path}/lineitem.parquet")
    return path


def legs():
    return [(p, a, b, j - i) for p, stops in PATTERNS.items() for i, a in enumerate(stops) for j, b in enumerate(stops) if i < j]


def test_direct_journeys_of_all_stops(spark, small):
    want = {}
    for _, a, b, ride in legs():
        n, fewest = want.get((a, b), (0, ride))
        want[a, b] = (n + 1, min(fewest, ride))
    got = {(r["board"], r["alight"]): (r["patterns"], r["fewest"]) for r in registry.QUERIES["direct_journeys"](spark, small).collect()}
    assert got == want


def test_one_change_journeys_of_all_stops(spark, small):
    want = {}
    for p, a, c, r1 in legs():
        for q, d, z, r2 in legs():
            if c == d and p != q and a != z:
                want[a, z, c] = min(want.get((a, z, c), (99, 0, 0)), (r1 + r2, p, q))
    got = {(r["origin"], r["alight"], r["change"]): (r["score"], r["first_id"], r["second_id"]) for r in registry.QUERIES["one_change_journeys"](spark, small).collect()}
    assert got == want


def test_relations_of_all_patterns(spark, small):
    got = {r["pattern_id"]: r["relation"] for r in registry.QUERIES["stop_relation"](spark, small).collect()}
    assert got == {5: "beyond", 10: "does_not_call", 11: "near", 13: "does_not_call", 17: "approaching", 23: "does_not_call"}


def test_places_of_all_names(spark, tmp_path):
    names = [f"Brand#{n}" for n in (100, 9, 10, 1, *range(20, 40))]
    spark.createDataFrame([(n,) for n in names + names[:3]], "p_brand string").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["p_brand"]: r["place"] for r in registry.QUERIES["natural_order"](spark, str(tmp_path)).collect()}
    assert got == {n: k + 1 for k, n in enumerate(sorted(names, key=lambda n: int(n[6:])))}


def test_legs_of_one_change_journeys_are_not_shuffled(spark, small):
    """Lines are dealt by pattern and each call once by its place, with its pattern's calls; legs are made there."""
    plan = registry.QUERIES["one_change_journeys"](spark, small)._jdf.queryExecution().executedPlan().toString()
    keys = {re.sub(r"#\w+", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", plan)}
    assert keys == {"l_orderkey", "change"} and "Broadcast" not in plan
    sent = re.findall(r"Exchange hashpartitioning\(change.*?\n.*?Project (\[.*?\])\n", plan)
    assert len(sent) == 2 and re.sub(r"#\w+", "", sent[0]) == re.sub(r"#\w+", "", sent[1])  # alike, so that it is done once


def test_one_change_between_chosen_stops(spark):
    """Two patterns of a place may be one with several origins, which leaves room for another beside it."""
    calls = [(1, 1, 0), (1, 2, 1), (1, 3, 2), (1, 4, 3), (2, 1, 0), (2, 3, 3), (3, 3, 0), (3, 4, 9), (4, 2, 0), (4, 3, 5), (4, 2, 6), (4, 4, 17), (None, 1, 0), (None, 3, 1)]
    frame = lambda stops: spark.createDataFrame([c for c in calls if c[1] in stops], "pattern_id long, stop long, position int")
    pairs = lambda a, b: [(p, s, e, y - x) for p, s, x in calls for q, e, y in calls if p is not None and p == q and x < y and s in a and e in b]
    for origins, every, targets in (({1, 2}, {1, 2, 3, 4}, {4}), ({1, 2, 3, 4},) * 3):
        o, s, t = (frame(x) for x in (origins, every, targets))
        if origins == every:
            o = t = s
        for by_origin in (True, False):
            want = {}
            for p, a, c, r1 in pairs(origins, every):
                for q, d, z, r2 in pairs(every, targets):
                    if c == d and p != q and (a != z or not by_origin):
                        key = (a, c, z) if by_origin else (c, z)
                        want[key] = min(want.get(key, (99,)), (r1 + r2, p, q))
            rows = planner.one_change(o, s, t, by_origin).collect()
            got = {((r["origin"],) if by_origin else ()) + (r["change"], r["alight"]): (r["score"], r["first_id"], r["second_id"]) for r in rows}
            assert got == want and len(rows) == len(want) > 1
