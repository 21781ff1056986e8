"""What a passenger asks at a stop: searching it, which vehicles come to it, which services leave it, what stands there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions.geo import metres, turn
from headway.functions.rules import runs_on, valid_on

#: Points of a typed word: at the start of the name, of a word in it, of a word in the rest, or within any word.
NAME_START, NAME_WORD, OTHER_WORD, WITHIN, NEAR_POINTS = 6, 4, 2, 1, 3.0
#: What a passenger types for a route. A fixed value.
ROUTE = r"(?i)^(\d{1,3}[a-z]?|[a-z]{1,2}\d{1,3})$"
#: Metres within which a vehicle is listed as nearby, as passed or old, as elsewhere; and how many of the last.
NEARBY_M, SEEN_M, ELSEWHERE_M, ELSEWHERE = 150.0, 3000.0, 1500.0, 12
#: Standing at a stop: metres to it, metres and seconds among its own reports, ages, and how far headings may differ.
NEAR_STOP_M, STAND_M, JITTER_M, STAND_S, CURRENT_S, STANDING_FRESH_S, HEADING_OFF = 60.0, 40.0, 15.0, 20, 150, 60, 60.0


def normalised(text: Column) -> Column:
    """Lower-case words of letters and digits, single spaces between."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def search(stops: DataFrame, words: list[str], name: str, others: list[str], limit: int, near_m: Column | None = None) -> DataFrame:
    """Stops that every typed word hits, by points, then name. ``near_m``: metres to where the passenger is, worth up to three points."""
    own, rest = normalised(F.col(name)), normalised(F.concat_ws(" ", name, *others))
    points, hit = F.lit(0.0), F.lit(True)
    for word in words:
        begins = lambda text, w=word: F.concat(F.lit(" "), text).contains(f" {w}")
        one = F.when(own.startswith(word), NAME_START).when(begins(own), NAME_WORD).when(begins(rest), OTHER_WORD).when(rest.contains(word), WITHIN)
        points, hit = points + one, hit & one.isNotNull()
    if near_m is not None:
        points = points + F.greatest(F.lit(0.0), NEAR_POINTS - near_m / 1000)
    return stops.filter(hit).withColumn("score", points).orderBy(F.desc("score"), name, *stops.columns[:1]).limit(limit)


def search_routes(lines: DataFrame, typed: str, line: str, limit: int = 6) -> DataFrame:
    """Lines that are what was typed, then those that begin with it; none where it doesn't look like a route."""
    asked = F.regexp_replace(F.upper(F.trim(F.lit(typed))), r"\s+", "")
    found = lines.filter(asked.rlike(ROUTE) & F.upper(line).startswith(asked)).withColumn("exact", F.upper(line) == asked)
    return found.orderBy(F.desc("exact"), F.length(line), line).limit(limit)


def longest_pattern(patterns: DataFrame, keys: list[str]) -> DataFrame:
    """The pattern with the most stops of each direction; of equals the smallest id."""
    best = patterns.groupBy(*keys).agg(F.max(F.struct("stop_count", (-F.col("pattern_id")).alias("least"))).alias("x"))
    return best.select(*keys, (-F.col("x.least")).alias("pattern_id"), F.col("x.stop_count").alias("stop_count"))


def branch_relation(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of vehicles on one of several branches (keys, stop_at, vehicle_at): how many bring them to the stop, and the fewest and most stops away."""
    ahead = F.when(F.col("stop_at") >= F.col("vehicle_at"), F.col("stop_at") - F.col("vehicle_at"))
    rows = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), F.count(ahead).alias("calling"), F.min(ahead).alias("least"), F.max(ahead).alias("most"))
    kind = F.when(F.col("total") < 2, "unresolved").when(F.col("calling") == F.col("total"), "branch_all_call").when(F.col("calling") > 0, "branch_some_call").otherwise("branch_none_call")
    return rows.withColumn("relation", kind)


def standing(kind: Column) -> Column:
    """What a relation means to someone waiting."""
    return F.when(kind.isin("approaching", "near", "branch_all_call"), "coming").when(kind.isin("branch_some_call"), "maybe").when(kind == "beyond", "passed").otherwise("not_here")


def stop_board(vehicles: DataFrame, keys: list[str]) -> DataFrame:
    """``vehicles`` (relation, stops_away, metres, age_s, old, chosen) in seven buckets, ordered in each; the rest is not listed.

    An old report is only ever listed as old; a chosen service narrows what is coming and never reclassifies it.
    """
    stands, m = standing(F.col("relation")), F.col("metres")
    bucket = (
        F.when(F.col("old"), F.when(m <= SEEN_M, "old"))
        .when(stands.isin("coming", "maybe"), F.when(F.col("chosen"), stands).otherwise("hidden"))
        .when(m <= NEARBY_M, "nearby")
        .when((stands == "passed") & (m <= SEEN_M), "passed")
        .when(m <= ELSEWHERE_M, "elsewhere")
    )
    rows = vehicles.withColumn("bucket", bucket).filter("bucket IS NOT NULL")
    first = F.when(F.col("bucket") == "coming", F.coalesce("stops_away", F.lit(0)).cast("double")).when(F.col("bucket") == "passed", -F.coalesce("stops_away", F.lit(0)).cast("double"))
    first = F.coalesce(first, F.when(F.col("bucket") == "old", F.col("age_s").cast("double")), m)
    order = W.partitionBy(*keys, "bucket").orderBy(first, "age_s", "vehicle_id")
    return rows.withColumn("place", F.row_number().over(order)).filter((F.col("bucket") != "elsewhere") | (F.col("place") <= ELSEWHERE))


def services(calls: DataFrame, day: Column) -> DataFrame:
    """Services that can be boarded (stop, operator, line, direction, destination): whether they run today, and on how many patterns.

    calls: stop, index, last_index, and a pattern's operator, line, direction, destination, valid_from, valid_to, rules. Where a
    pattern ends nobody boards. One pattern that runs is enough; none running is only said where every pattern says so.
    """
    rows = calls.filter((F.col("index") < F.col("last_index")) & valid_on(F.col("valid_from"), F.col("valid_to"), day))
    runs = runs_on(F.col("rules"), day)
    some, none = F.coalesce(F.bool_or(runs), F.lit(False)), F.coalesce(F.bool_and(F.coalesce(~runs, F.lit(False))), F.lit(False))
    rows = rows.groupBy("stop", "operator", "line", "direction", "destination").agg(F.count(F.lit(1)).alias("patterns"), some.alias("__some"), none.alias("__none"))
    return rows.withColumn("runs_today", F.when(F.col("__some"), True).when(F.col("__none"), False)).drop("__some", "__none")


def stop_activity(reports: DataFrame, keys: list[str]) -> DataFrame:
    """``stopped``, ``near`` or ``none`` of every vehicle, with how many of its newest reports stand at the stop.

    reports: keys, at (s), lat, lon, and per vehicle stop_lat, stop_lon, heading, stop_heading, age_s. Reports count back from the newest
    while they stay by the stop and within what scatters about it.
    """
    w = W.partitionBy(*keys).orderBy(F.desc("at"))
    one = F.row_number().over(W.partitionBy(*keys, "at").orderBy("lat", "lon"))  # of several reports of one instant the southernmost, then westernmost
    rows = reports.withColumn("__one", one).filter("__one = 1").drop("__one")
    lat, lon = F.first("lat").over(w), F.first("lon").over(w)
    rows = rows.withColumns({"metres": metres(F.col("lat"), F.col("lon"), F.col("stop_lat"), F.col("stop_lon")), "moved": metres(F.col("lat"), F.col("lon"), lat, lon), "k": F.row_number().over(w)})
    away = (F.col("metres") > STAND_M) | (F.col("moved") > JITTER_M)
    rows = rows.withColumn("run", F.sum(away.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)) == 0)
    fixed = [F.first(c).alias(c) for c in ("heading", "stop_heading", "age_s")]
    per = rows.groupBy(*keys).agg(
        F.count(F.when(F.col("run"), 1)).alias("reports"), (F.max("at") - F.min(F.when(F.col("run"), F.col("at")))).alias("span_s"), F.max(F.when(F.col("k") == 1, F.col("metres"))).alias("metres"), *fixed
    )
    stands = (F.col("reports") >= 2) & (F.col("span_s") >= STAND_S) & (F.col("age_s") <= STANDING_FRESH_S)
    other_way = F.coalesce(turn(F.col("heading"), F.col("stop_heading")) > HEADING_OFF, F.lit(False))
    kind = F.when((F.col("age_s") > CURRENT_S) | F.col("metres").isNull() | (F.col("metres") > NEAR_STOP_M) | other_way, "none").when(stands, "stopped").otherwise("near")
    return per.withColumn("activity", kind)
