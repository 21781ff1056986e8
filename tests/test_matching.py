"""Each reason of the ladder, what ambiguous vehicles keep, and scheduled journeys, on a timetable made by hand."""

from datetime import date

import pytest

from headway.functions.rules import RULE
from headway.operators import matching

MONDAY, SUNDAY = date(2026, 9, 28), date(2026, 9, 27)
DAYS = {"weekdays": [0, 1, 2, 3, 4], "sunday": [6]}
#: Stops a kilometre or so apart on a line north; p and q share c, d and part after it; far is a branch of its own.
PLACES = {s: (53.40 + 0.01 * k, -2.2) for k, s in enumerate("abcde")} | {"p": (53.44, -2.20), "q": (53.44, -2.21)}
PATTERNS = [
    # id, line, operator, direction, destination, loop, valid_from, valid_to, days, calls
    ("one", "1", "X", "outbound", "Stockport_Interchange", False, None, None, "weekdays", "abcde"),
    ("loop", "2", "X", "", "Town", True, None, None, None, "abca"),
    ("old", "3", "X", "", "Town", False, None, date(2026, 1, 1), None, "abc"),
    ("sunday", "4", "X", "", "Town", False, None, None, "sunday", "abc"),
    ("in", "5", "X", "inbound", "Town", False, None, None, "sunday", "abc"),
    ("out", "5", "X", "outbound", "Town", False, None, None, "weekdays", "abc"),
    ("unplaced", "6", "X", "", "Town", False, None, None, None, "yz"),
    ("left", "7", "X", "", "North Park", False, None, None, None, "abcdp"),
    ("right", "7", "X", "", "South Park", False, None, None, None, "abcdq"),
    ("again", "7", "X", "", "North Park", False, None, None, None, "abcdp"),
    ("any", "8", None, "", "Town", False, None, None, None, "abc"),
]


@pytest.fixture(scope="module")
def lines(spark):
    rule = lambda days: None if days is None else [(DAYS[days], None, None, None, None, None)]
    rows = [(*p[:8], rule(p[8]), len(p[9])) for p in PATTERNS]
    kinds = f"pattern_id string, line string, operator string, direction string, destination string, loop boolean, valid_from date, valid_to date, rules array<{RULE}>, stop_count int"
    calls = [(p[0], k, s) for p in PATTERNS for k, s in enumerate(p[9])]
    places = spark.createDataFrame([(s, *at) for s, at in PLACES.items()], "stop string, lat double, lon double")
    return matching.by_line(matching.with_calls(spark.createDataFrame(rows, kinds), spark.createDataFrame(calls, "pattern_id string, position int, stop string"), places))


def matched(spark, lines, *vehicles):
    kinds = "id string, route string, operator string, direction string, destination string, lat double, lon double, day date"
    return {r["id"]: r for r in matching.match(spark.createDataFrame(vehicles, kinds), lines).collect()}


def test_every_reason(spark, lines):
    at = PLACES["b"]
    got = matched(
        spark, lines,
        ("no_pattern_for_route", "99", "X", "", None, *at, MONDAY), ("no_pattern_for_operator", "1", "Y", "", None, *at, MONDAY), ("no_pattern_valid_on_date", "3", "X", "", None, *at, MONDAY),
        ("no_pattern_operating_today", "4", "X", "", None, *at, MONDAY), ("no_pattern_for_direction_today", "5", "X", "INBOUND", None, *at, MONDAY), ("no_pattern_for_direction", "1", "X", "inbound", None, *at, MONDAY),
        ("no_stop_coordinates", "6", "X", "", None, *at, MONDAY), ("too_far_from_pattern", "1", "X", "", None, 53.5, -2.2, MONDAY), ("ambiguous_branch", "7", "X", "", None, *at, MONDAY), ("loop_pattern", "2", "X", "", None, *at, MONDAY),
    )
    assert {k: r["reason"] for k, r in got.items()} == {r: r for r in matching.REASONS}
    assert not any(r["matched"] or r["pattern_id"] for r in got.values())


def test_what_is_matched_and_why(spark, lines):
    b, p = PLACES["b"], PLACES["p"]
    got = matched(
        spark, lines, ("plain", " 1 ", "X", "Outbound", "Stockport", b[0] + 0.001, b[1], MONDAY), ("no_day", "4", "", "", None, *b, None), ("any operator", "8", "Y", "", "Elsewhere", *b, MONDAY),
        ("by words", "7", "X", "", "south_park bus station", *b, MONDAY), ("by place", "7", "X", "", None, *p, MONDAY), ("torn", "7", "X", "", "Park", *b, MONDAY),
    )
    plain = got["plain"]
    assert (plain["pattern_id"], plain["pattern_index"], plain["nearest_stop"], plain["metres"], plain["resolved_by"], plain["destination_agrees"]) == ("one", 1, "b", 111, "position", True)
    assert plain["operating_day_checked"] and got["any operator"]["operating_day_checked"] is False and got["no_day"]["operating_day_checked"] is None
    assert got["no_day"]["matched"] and got["any operator"]["destination_agrees"] is False
    assert (got["by words"]["pattern_id"], got["by words"]["resolved_by"], got["by words"]["plausible_paths"]) == ("right", "reported_destination", 2)
    assert got["by place"]["pattern_id"] in ("left", "again") and got["by place"]["resolved_by"] == "position"
    torn = got["torn"]
    assert torn["reason"] == "ambiguous_branch" and torn["nearest_stop"] == "b" and torn["shared_next"] == ["c", "d"] and torn["shared_onward"] is False
    assert len(torn["candidates"]) == 2 and {c["pattern_index"] for c in torn["candidates"]} == {1}


def test_filters_on_results_do_not_repeat_the_ladder(spark, lines):
    v = spark.createDataFrame([("x", "1", "X", "", None, *PLACES["b"], MONDAY)], "id string, route string, operator string, direction string, destination string, lat double, lon double, day date")
    found = matching.match(v, lines)
    for kept in ("matched", "reason IS NULL", "reason = 'loop_pattern'", "pattern_id = 'one'", "metres > 100"):
        assert found.filter(kept)._jdf.queryExecution().optimizedPlan().toString().count("HYPOT") == 1, kept  # distances to a vehicle's candidates stand there once
    assert [r["pattern_id"] for r in found.filter("matched").collect()] == ["one"] and not found.filter("NOT matched").collect()


def test_scheduled_journeys_and_their_reasons(spark):
    departures = spark.createDataFrame([("one", "08:00:00", 0), ("one", "08:00:00", 0), ("one", "09:00:00", 0), ("one", "09:00:00", 1)], "pattern_id string, departure string, timing int")
    rows = [("shared", "one", "2026-09-28T07:00:00Z"), ("differ", "one", "2026-09-28T08:00:00+00:00"), ("none", "one", None), ("unread", "one", "tomorrow"), ("other", "one", "2026-09-28T11:00:00Z"), ("bare", "two", "2026-09-28T07:00:00Z")]
    got = {r["id"]: r for r in matching.scheduled_journey(spark.createDataFrame(rows, "id string, pattern_id string, aimed string"), departures).collect()}
    assert {k: r["withheld"] for k, r in got.items()} == {
        "shared": None, "differ": "journeys_at_this_time_differ_in_timing", "none": "no_aimed_departure_reported", "unread": "aimed_departure_unreadable",
        "other": "aimed_departure_not_in_timetable", "bare": "pattern_has_no_departure_times",
    }
    shared = got["shared"]
    assert (shared["departure"], shared["journeys"], shared["timing"], shared["scheduled_day"]) == ("08:00:00", 2, 0, MONDAY)


def test_empty_tables(spark, lines):
    assert matched(spark, lines.limit(0), ("x", "1", "X", "", None, 53.4, -2.2, MONDAY))["x"]["reason"] == "no_pattern_for_route"
