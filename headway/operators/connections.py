"""Journeys with one change for a table of requests: a first bus, a walk of at most 350 m between stops, a second bus.

Staged, so that no step forms pairs that a later one only throws away:

1. stops near each request's ends, by a grid join; the nearest ``STOPS_NEAR`` within ``WALK_M`` are where a journey may begin or end;
2. a first leg per (request, pattern), from the stop nearest the start; a pattern that goes on to within reach of the destination is a direct bus and no first leg;
3. second legs per (request, pattern, stop of boarding): the best stop to leave at is a minimum over the calls after it, and how near the pattern has come to the
   start by then a minimum over the calls up to there (a pattern that has passed the start is a loop);
4. first legs are reduced to the best way to each stop of boarding (ride and walk) before they meet second legs there.

Of all pairs the best of each family stays (first pattern and its stop, second operator and destination), then the best of each pair of services, by
score, then ids. A leg's family is every usable pattern between its two stops, without the other leg's line and without loops. Options that a better one of
the request covers are dropped: one whose second leg's buses that one carries, from the same stops, and whose first leg's it
carries as well, or shares a bus with and leaves at the same stop.

Metres are whole, as the distances between stops are published. A request's options are one row while they are compared: as many as there are pairs of services
near it. Where a scan of a catalogue would keep what it meets first, score and ids decide here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.constants import CHANGE_CANDIDATES, CHANGE_PENALTY_M, DETOUR, DIRECT_REACH_M, NEARER_M, RIDE_M_PER_STOP, STOPS_NEAR, TRANSFER_M, WALK_M
from headway.functions.geo import metres
from headway.operators.spatial import cell_of, near_join
from headway.session import settled

SERVICE = ("operator", "line", "direction", "destination")


def whole_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return F.floor(metres(lat1, lon1, lat2, lon2) + 0.5)


def stops_near(places: DataFrame, stops: DataFrame, radius_m: float, keys: list[str]) -> DataFrame:
    """(keys, stop, near_m) of the stops within ``radius_m`` of each place (keys, lat, lon)."""
    right = stops.select("stop", F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    met = near_join(places.select(*keys, "lat", "lon"), right, radius_m + 0.5, *cell_of(radius_m + 0.5))
    return met.select(*keys, "stop", F.floor(F.col("metres") + 0.5).alias("near_m")).filter(F.col("near_m") <= radius_m)


def _ends(near: DataFrame, limit: int = STOPS_NEAR) -> DataFrame:
    order = W.partitionBy("request").orderBy("near_m", "stop")
    return near.filter(F.col("near_m") <= WALK_M).withColumn("k", F.row_number().over(order)).filter(F.col("k") <= limit).drop("k")


def _ride(a: Column, b: Column, calls: Column) -> Column:
    far = (b - a).cast("double")
    return F.when(far.isNull(), calls * RIDE_M_PER_STOP).otherwise(F.greatest(F.lit(0.0), far))


def connections(requests: DataFrame, patterns: DataFrame, calls: DataFrame, stops: DataFrame, limit: int = CHANGE_CANDIDATES) -> DataFrame:
    """One row per option: request, place, score and the two legs (first_*, second_*), their families as arrays of pattern ids, and the walks.

    requests: request, from_lat, from_lon, to_lat, to_lon; patterns: pattern_id, operator, line, direction, destination, only those that can be used;
    calls: pattern_id, position (0, 1, ...), stop, metres (from the first stop, or null); stops: stop, lat, lon.
    """
    end = lambda name: requests.select("request", F.col(f"{name}_lat").alias("lat"), F.col(f"{name}_lon").alias("lon"))
    known = patterns.select("pattern_id", *[F.coalesce(c, F.lit("")).alias(c) for c in SERVICE])
    calls = calls.join(known.select("pattern_id"), "pattern_id").select("pattern_id", "position", "stop", F.col("metres").alias("along"), F.max("position").over(W.partitionBy("pattern_id")).alias("last"))
    calls = settled(calls)
    by_start, by_end = stops_near(end("from"), stops, WALK_M + NEARER_M, ["request"]), stops_near(end("to"), stops, WALK_M, ["request"])
    straight = requests.select("request", whole_metres(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon")).alias("straight_m"))

    first = _first_legs(_ends(by_start), by_end, calls)
    second = _second_legs(_ends(by_end), by_start, calls)
    on = _boarded(first, calls, stops)
    one, two = ([F.col(c).alias(f"{c}_{k}") for c in SERVICE] for k in (1, 2))
    pairs = on.join(second, ["request", "change"]).filter("first_id <> second_id")
    pairs = pairs.join(known.select(F.col("pattern_id").alias("first_id"), *one), "first_id").join(known.select(F.col("pattern_id").alias("second_id"), *two), "second_id").join(straight, "request")
    pairs = pairs.filter(((F.col("line_1") != F.col("line_2")) | (F.col("operator_1") != F.col("operator_2"))) & (F.col("walk_1") + F.col("walk_2") < F.col("straight_m")))
    pairs = pairs.filter(F.col("start_m").isNull() | (F.col("start_m") > F.greatest(F.col("walk_1") + NEARER_M, F.lit(DIRECT_REACH_M))))
    pairs = pairs.withColumn("score", F.col("cost_1") + F.col("cost_2") + CHANGE_PENALTY_M)
    legs = ["first_id", "board", "board_at", "leave", "leave_at", "second_id", "change", "change_at", "alight", "alight_at", "walk_1", "walk_2", "transfer_m", "operator_1", "line_1", "operator_2", "line_2"]
    order = F.struct("score", *legs)
    best = pairs.groupBy("request", "first_id", "board", "operator_2", "destination_2").agg(F.min(F.struct(order.alias("o"), *[F.col(c) for c in (*[f"{s}_1" for s in SERVICE], *[f"{s}_2" for s in SERVICE])])).alias("x"))
    best = best.select("request", "x.*").groupBy("request", *[f"{s}_{k}" for k in (1, 2) for s in SERVICE]).agg(F.min("o").alias("o")).select("request", "o.*")
    best = settled(best)
    return _uncovered(_with_families(best, calls, known, stops), limit)


def _first_legs(ends: DataFrame, by_end: DataFrame, calls: DataFrame) -> DataFrame:
    """(request, first_id, board, board_at, walk_1) of patterns that do not themselves go on to the destination."""
    met = calls.filter("position < last").join(ends, "stop")
    rows = met.groupBy("request", "pattern_id").agg(F.min(F.struct("near_m", "position", "stop", "along")).alias("x"))
    passed = calls.join(by_end.filter(F.col("near_m") <= DIRECT_REACH_M), "stop").groupBy("request", "pattern_id").agg(F.max("position").alias("reaches"))
    rows = rows.join(passed, ["request", "pattern_id"], "left").filter("reaches IS NULL OR reaches <= x.position")
    return rows.select("request", F.col("pattern_id").alias("first_id"), F.col("x.stop").alias("board"), F.col("x.position").alias("board_at"), F.col("x.near_m").alias("walk_1"), F.col("x.along").alias("board_along"))


def _second_legs(ends: DataFrame, by_start: DataFrame, calls: DataFrame) -> DataFrame:
    """(request, second_id, change, change_at, alight, alight_at, walk_2, start_m, cost_2) of every stop at which a pattern that reaches the destination can be boarded."""
    reached = calls.join(ends, "stop").select("request", "pattern_id").distinct()
    rows = calls.join(reached, "pattern_id").join(ends.withColumnRenamed("near_m", "end_m"), ["request", "stop"], "left").join(by_start.withColumnRenamed("near_m", "start_m"), ["request", "stop"], "left")
    one = W.partitionBy("request", "pattern_id").orderBy("position")
    upto, after = one.rowsBetween(W.unboundedPreceding, 0), one.rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumn("passed_m", F.min("start_m").over(upto))
    target = F.when(F.col("end_m").isNotNull(), F.struct("end_m", F.col("position").alias("at"), F.col("stop").alias("name"), F.col("along").alias("to_along"), F.col("passed_m").alias("by_then")))
    rows = rows.withColumn("t", F.min(target).over(after)).filter("t IS NOT NULL")
    cost = F.col("t.end_m") + _ride(F.col("along"), F.col("t.to_along"), F.col("t.at") - F.col("position"))
    rows = rows.select("request", F.col("pattern_id").alias("second_id"), F.col("stop").alias("change"), F.col("position").alias("change_at"), F.col("t.name").alias("alight"), F.col("t.at").alias("alight_at"), F.col("t.end_m").alias("walk_2"), F.col("t.by_then").alias("start_m"), cost.alias("cost_2"))
    return rows


def _boarded(first: DataFrame, calls: DataFrame, stops: DataFrame) -> DataFrame:
    """(request, change, first_id, ...) of the best way with each first leg to each stop within a walk of one where it can be left."""
    off = first.join(calls.select(F.col("pattern_id").alias("first_id"), F.col("position").alias("leave_at"), F.col("stop").alias("leave"), F.col("along").alias("leave_along")), "first_id").filter("leave_at > board_at")
    off = off.withColumn("cost", F.col("walk_1") + _ride(F.col("board_along"), F.col("leave_along"), F.col("leave_at") - F.col("board_at")))
    off = off.groupBy("request", "first_id", "board", "board_at", "walk_1", "leave").agg(F.min(F.struct("cost", "leave_at")).alias("x"))
    walks = stops_near(stops.select(F.col("stop").alias("leave"), "lat", "lon"), stops, TRANSFER_M, ["leave"]).select("leave", F.col("stop").alias("change"), F.col("near_m").alias("transfer_m"))
    way = F.struct((F.col("x.cost") + F.col("transfer_m") * (2 * DETOUR)).alias("cost_1"), F.col("x.leave_at").alias("leave_at"), "leave", "transfer_m")
    rows = off.join(walks, "leave").groupBy("request", "change", "first_id", "board", "board_at", "walk_1").agg(F.min(way).alias("w"))
    return rows.select("request", "change", "first_id", "board", "board_at", "walk_1", "w.*")


def _with_families(options: DataFrame, calls: DataFrame, known: DataFrame, stops: DataFrame) -> DataFrame:
    """``options`` with first_family and second_family: the usable patterns between a leg's stops, its own among them."""
    near = stops_near(stops.select(F.col("stop").alias("place"), "lat", "lon"), stops, DIRECT_REACH_M, ["place"]).select("place", "stop")
    firsts = calls.groupBy("pattern_id", "stop", "last").agg(F.min("position").alias("position"))
    every = calls.select("pattern_id", F.col("stop").alias("off"), F.col("position").alias("off_at"))

    def family(name: str, own: str, board: str, alight: str, other: str, line: str, operator: str) -> DataFrame:
        asked = options.select(own, board, alight, F.col(other).alias("place"), F.col(line).alias("other_line"), F.col(operator).alias("other_operator")).distinct()
        legs = asked.select(board, alight).distinct().join(firsts.filter("position < last").withColumnRenamed("stop", board), board).join(every.withColumnRenamed("off", alight), ["pattern_id", alight]).filter("off_at > position")
        legs = legs.groupBy("pattern_id", board, alight, "position").agg(F.min("off_at").alias("off_at"))
        rows = asked.join(legs, [board, alight]).filter(F.col("pattern_id") != F.col(own)).join(known.select("pattern_id", "line", "operator"), "pattern_id")
        rows = rows.filter((F.col("line") != F.col("other_line")) | (F.col("operator") != F.col("other_operator")))
        passing = rows.select("pattern_id", "place").distinct().join(near, "place").join(calls.select("pattern_id", "stop", F.col("position").alias("at")), ["pattern_id", "stop"])
        passing = passing.groupBy("pattern_id", "place").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"))
        loops = F.col("last_at") > F.col("off_at") if name == "first_family" else F.col("first_at") < F.col("position")
        rows = rows.join(passing, ["pattern_id", "place"], "left").filter(~F.coalesce(loops, F.lit(False)))
        keys = [own, board, alight, "place", "other_line", "other_operator"]
        return rows.groupBy(*keys).agg(F.sort_array(F.collect_set("pattern_id")).alias(name)).withColumnsRenamed({"place": other, "other_line": line, "other_operator": operator})

    out = options
    for name, own, board, alight, other, line, operator in (("first_family", "first_id", "board", "leave", "alight", "line_2", "operator_2"), ("second_family", "second_id", "change", "alight", "board", "line_1", "operator_1")):
        found = family(name, own, board, alight, other, line, operator)
        out = out.join(found, [own, board, alight, other, line, operator], "left").withColumn(name, F.concat(F.array(own), F.coalesce(name, F.array().cast(f"array<{dict(options.dtypes)[own]}>"))))
    return out


def _uncovered(options: DataFrame, limit: int) -> DataFrame:
    """Options in order of score without those that a better one kept covers, ``limit`` of each request at most."""
    columns = [c for c in options.columns if c not in ("request", "score")]
    rows = options.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("score", *columns))).alias("all"))
    kind = rows.schema["all"].dataType.simpleString()

    def covers(k: Column, o: Column) -> Column:
        second = (k["change"] == o["change"]) & (k["alight"] == o["alight"]) & F.array_contains(k["second_family"], o["second_id"])
        first = (k["board"] == o["board"]) & (k["leave"] == o["leave"]) & F.array_contains(k["first_family"], o["first_id"])
        return second & (first | ((k["leave"] == o["leave"]) & F.arrays_overlap(k["first_family"], o["first_family"])))

    kept = F.aggregate("all", F.array().cast(kind), lambda held, o: F.when(F.exists(held, lambda k: covers(k, o)), held).otherwise(F.concat(held, F.array(o))))
    return rows.select("request", F.posexplode(F.slice(kept, 1, limit)).alias("place", "o")).select("request", (F.col("place") + 1).alias("place"), "o.*")
