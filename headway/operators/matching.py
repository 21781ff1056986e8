"""Naming the timetable pattern, and the scheduled journey, that a reported vehicle runs on.

The patterns of a line are one row, an array of all of them, so a vehicle meets its line's patterns in one equi-join without
multiplying; every step after it is an array expression inside the vehicle's own row, and nothing else is shuffled. A line
has tens of patterns and a pattern tens of stops, which bounds such a row. A hot line is a hot key on the vehicles' side
only, which adaptive execution splits.

Refused vehicles keep the first reason of the ladder that holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.constants import AMBIGUITY_M, LONDON, MATCH_MAX_M
from headway.functions.geo import metres
from headway.functions.rules import runs_on, valid_on
from headway.functions.text import same_place
from headway.functions.time import instant, service_day

#: The ladder's reasons, in its order. Fixed values.
REASONS = (
    "no_pattern_for_route",
    "no_pattern_for_operator",
    "no_pattern_valid_on_date",
    "no_pattern_operating_today",
    "no_pattern_for_direction_today",
    "no_pattern_for_direction",
    "no_stop_coordinates",
    "too_far_from_pattern",
    "ambiguous_branch",
    "loop_pattern",
)


def with_calls(patterns: DataFrame, calls: DataFrame, places: DataFrame) -> DataFrame:
    """``patterns`` with ``sequence``, its stops in order, and ``placed``, those with a known place and their index.

    calls: pattern_id, position, stop. places: stop, lat, lon. The index counts all calls, placed or not.
    """
    at = calls.join(places.select("stop", "lat", "lon"), "stop", "left").groupBy("pattern_id")
    at = at.agg(F.sort_array(F.collect_list(F.struct("position", "stop", "lat", "lon"))).alias("calls"))
    indexed = F.transform("calls", lambda c, i: F.struct(i.alias("index"), c["stop"].alias("stop"), c["lat"].alias("lat"), c["lon"].alias("lon")))
    placed = F.filter(indexed, lambda c: c["lat"].isNotNull() & c["lon"].isNotNull())
    return patterns.join(at.select("pattern_id", F.col("calls.stop").alias("sequence"), placed.alias("placed")), "pattern_id", "left")


def by_line(patterns: DataFrame) -> DataFrame:
    """One row per line: ``patterns``, an array of all its patterns."""
    held = ("pattern_id", "operator", "direction", "destination", "loop", "stop_count", "valid_from", "valid_to", "rules", "sequence", "placed")
    return patterns.groupBy("line").agg(F.collect_list(F.struct(*held)).alias("patterns"))


def _blank(x: Column) -> Column:
    return F.coalesce(F.trim(x), F.lit("")) == ""


def common_prefix(lists: Column) -> Column:
    """What all arrays of an array begin with."""
    first = F.get(lists, F.lit(0))
    agreed = F.filter(F.sequence(F.lit(0), F.size(first)), lambda n: F.forall(lists, lambda x: F.slice(x, F.lit(1), n) == F.slice(first, F.lit(1), n)))
    return F.slice(first, F.lit(1), F.array_max(agreed))


def match(vehicles: DataFrame, lines: DataFrame) -> DataFrame:
    """``vehicles`` with ``matched``, ``reason``, the pattern and its nearest stop, or what the candidates agree on.

    vehicles: route, operator, direction, destination, lat, lon, day (null: neither validity nor operating day is tested).
    lines: as ``by_line`` gives them. Equal distances go to the pattern with more stops, then to the smaller id.
    """
    names = vehicles.columns
    right = lines.select(F.col("line").alias("__line"), "patterns")
    v = vehicles.join(right, F.trim(vehicles["route"]) == F.col("__line"), "left").drop("__line")
    day, direction = F.col("day"), F.lower(F.trim(F.coalesce("direction", F.lit(""))))
    fits = lambda p: (direction == "") | _blank(p["direction"]) | (F.lower(p["direction"]) == direction)
    v = v.withColumn("__same", F.filter("patterns", lambda p: _blank(F.col("operator")) | _blank(p["operator"]) | (p["operator"] == F.trim("operator"))))
    v = v.withColumn("__valid", F.filter("__same", lambda p: day.isNull() | valid_on(p["valid_from"], p["valid_to"], day)))
    v = v.withColumn("__running", F.filter("__valid", lambda p: day.isNull() | F.coalesce(runs_on(p["rules"], day), F.lit(True))))
    v = v.withColumn("__candidates", F.filter("__running", fits))

    def met(p):  # in a step of its own, so that distances are not measured for each use of the nearest
        near = F.array_min(F.transform(p["placed"], lambda s: F.struct(metres(F.col("lat"), F.col("lon"), s["lat"], s["lon"]).alias("d"), s["index"].alias("index"), s["stop"].alias("stop"))))
        return F.struct(near.alias("near"), p.alias("p"))

    def scored(x):
        near, p = x["near"], x["p"]
        return F.struct(near["d"].alias("d"), (-p["stop_count"]).alias("fewer"), p["pattern_id"].alias("pattern_id"), near["index"].alias("index"), near["stop"].alias("stop"), p.alias("p"))

    v = v.withColumn("__scored", F.sort_array(F.filter(F.transform(F.transform("__candidates", met), scored), lambda x: x["d"].isNotNull())))
    v = v.withColumn("__best", F.get("__scored", F.lit(0))["d"])
    v = v.withColumn("__near", F.filter("__scored", lambda x: x["d"] - F.col("__best") < AMBIGUITY_M))
    new = lambda x, i: ~F.exists(F.slice("__near", F.lit(1), i), lambda y: y["p"]["sequence"] == x["p"]["sequence"])
    v = v.withColumn("__paths", F.filter("__near", new))
    agrees = lambda x: same_place(F.col("destination"), x["p"]["destination"])
    v = v.withColumn("__agreeing", F.filter("__paths", agrees))
    one, named = F.size("__paths") == 1, (F.size("__paths") > 1) & (F.size("__agreeing") == 1)
    v = v.withColumn("__chosen", F.when(one, F.get("__paths", F.lit(0))).when(named, F.get("__agreeing", F.lit(0))))
    tests = (
        F.col("patterns").isNull(), F.size("__same") == 0, F.size("__valid") == 0, F.size("__running") == 0,
        (F.size("__candidates") == 0) & day.isNotNull() & F.exists("__valid", fits), F.size("__candidates") == 0,
        F.size("__scored") == 0, F.col("__best") > MATCH_MAX_M, F.col("__chosen").isNull(), F.col("__chosen.p.loop"),
    )
    reason = F.lit(None).cast("string")
    for test, name in reversed(list(zip(tests, REASONS, strict=True))):
        reason = F.when(test, F.lit(name)).otherwise(reason)
    # the one element of an array, since a caller's filter on a column is moved below what makes it, and the ladder would be worked out anew for each mention of it
    v = v.withColumn("reason", F.explode(F.array(reason)))
    matched, torn = F.col("reason").isNull(), F.col("reason") == "ambiguous_branch"
    onward = F.transform("__paths", lambda x: F.slice(x["p"]["sequence"], x["index"] + 2, F.size(x["p"]["sequence"])))
    one_stop = torn & (F.size(F.array_distinct(F.transform("__paths", lambda x: x["stop"]))) == 1)
    checked = F.when(day.isNotNull() & (F.size("__running") > 0), F.forall("__running", lambda p: p["rules"].isNotNull()))
    return v.select(
        *names,
        matched.alias("matched"),
        "reason",
        F.when(matched, F.col("__chosen.pattern_id")).alias("pattern_id"),
        F.when(matched, F.col("__chosen.index")).alias("pattern_index"),
        F.when(matched, F.col("__chosen.stop")).when(one_stop, F.get("__paths", F.lit(0))["stop"]).alias("nearest_stop"),
        F.when(matched, F.round("__chosen.d")).when(torn | (F.col("reason") == "too_far_from_pattern"), F.round("__best")).cast("long").alias("metres"),
        F.when(matched | (F.col("reason") == "loop_pattern"), F.when(one, "position").otherwise("reported_destination")).alias("resolved_by"),
        F.when(matched & ~_blank(F.col("destination")) & ~_blank(F.col("__chosen.p.destination")), agrees(F.col("__chosen"))).alias("destination_agrees"),
        checked.alias("operating_day_checked"),
        F.when(torn | matched | (F.col("reason") == "loop_pattern"), F.size("__paths")).alias("plausible_paths"),
        F.when(torn, F.transform("__paths", lambda x: F.struct(x["pattern_id"].alias("pattern_id"), x["index"].alias("pattern_index")))).alias("candidates"),
        F.when(one_stop, common_prefix(onward)).alias("shared_next"),
        F.when(one_stop, F.size(F.array_distinct(onward)) == 1).alias("shared_onward"),
    )


def scheduled_journey(matched: DataFrame, departures: DataFrame) -> DataFrame:
    """``matched`` (pattern_id, aimed: ISO text of the origin departure) with ``departure``, ``journeys``, ``timing``, ``scheduled_day`` or ``withheld``.

    departures: pattern_id, departure (HH:MM:SS, local), timing. Several journeys at one departure are one answer only if they share a timing.
    """
    when = instant(F.replace(F.col("aimed"), F.lit("Z"), F.lit("+00:00")))
    local = F.date_format(F.from_utc_timestamp(when, LONDON), "HH:mm:ss")
    rows = matched.withColumns({"__when": when, "__local": local})
    at = departures.groupBy(F.col("pattern_id").alias("__id"), F.col("departure").alias("__at"))
    at = at.agg(F.count(F.lit(1)).alias("__n"), F.min("timing").alias("__timing"), (F.min("timing") == F.max("timing")).alias("__one"))
    held = departures.select(F.col("pattern_id").alias("__held")).distinct()
    rows = rows.join(held, rows["pattern_id"] == held["__held"], "left")
    rows = rows.join(at, (F.col("pattern_id") == F.col("__id")) & (F.col("__local") == F.col("__at")), "left")
    withheld = (
        F.when(F.coalesce(F.col("aimed"), F.lit("")) == "", "no_aimed_departure_reported")
        .when(F.col("__when").isNull(), "aimed_departure_unreadable")
        .when(F.col("__held").isNull(), "pattern_has_no_departure_times")
        .when(F.col("__n").isNull(), "aimed_departure_not_in_timetable")
        .when(~F.coalesce("__one", F.lit(True)), "journeys_at_this_time_differ_in_timing")
    )
    named = withheld.isNull()
    return rows.select(
        *matched.columns,
        withheld.alias("withheld"),
        F.when(named, F.col("__local")).alias("departure"),
        F.col("__n").alias("journeys"),
        F.when(named, F.col("__timing")).alias("timing"),
        F.when(named, service_day(F.col("__when"))).alias("scheduled_day"),
    )


def summary(matched: DataFrame) -> DataFrame:
    """How many vehicles were matched, and how many not, by reason."""
    return matched.groupBy(F.coalesce("reason", F.lit("matched")).alias("outcome")).agg(F.count(F.lit(1)).alias("vehicles"))


def gained_and_lost(before: DataFrame, after: DataFrame, key: str, groups: list[str]) -> DataFrame:
    """Of two rules on the same vehicles (key, groups, named): by group how many both name, and how many only one does."""
    both = before.select(key, *groups, F.col("named").alias("was")).join(after.select(key, F.col("named").alias("now")), key)
    count = lambda c: F.count(F.when(c, 1))
    return both.groupBy(*groups).agg(count(F.col("was") & F.col("now")).alias("kept"), count(~F.col("was") & F.col("now")).alias("gained"), count(F.col("was") & ~F.col("now")).alias("lost"))
