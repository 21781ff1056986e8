"""Vehicles named by the timetable: customers stand for vehicles, orders for patterns, line items for their calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions.rules import RULE
from headway.operators import matching
from headway.plans.base import lineitem, orders, registering
from headway.session import table

QUERIES, ORACLES, query = registering()

#: Vehicles (route, operator, direction, destination, place, day) and patterns with rules and placed calls, made from keys.
_MADE = """
v AS (SELECT c_custkey AS vehicle_id, 'L' || (c_custkey // 10) AS route, 'O' || (c_custkey % 4) AS operator, CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'O' WHEN 2 THEN 'f' ELSE 'x' END AS direction,
   'Place_' || (c_custkey % 7) || ' Station' AS destination, 53.4001 + (c_custkey * 7919 % 1000) / 9000.0 AS lat, -2.2999 + (c_custkey * 104729 % 1000) / 9000.0 AS lon, DATE '1996-06-01' + CAST(c_nationkey AS INTEGER) AS day FROM customer),
p AS (SELECT o_orderkey AS pattern_id, 'L' || (o_custkey // 12) AS line, 'O' || (o_orderkey % 3) AS operator, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE lower(o_orderstatus) END AS direction, 'place ' || (o_orderkey % 9) AS destination,
   CAST(o_orderdate AS DATE) AS valid_from, CAST(o_orderdate AS DATE) + 400 AS valid_to, o_orderkey % 7 AS first_day, o_orderkey % 13 = 0 AS loop FROM orders),
c AS (SELECT l_orderkey AS pattern_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) - 1 AS index, l_suppkey AS stop FROM lineitem),
s AS (SELECT pattern_id, count(*) AS stop_count, string_agg(CAST(stop AS VARCHAR), ',' ORDER BY index) AS seq FROM c GROUP BY 1),
q AS (SELECT c.*, 53.4 + (stop % 10) / 90.0 AS plat, -2.3 + (stop // 10 % 10) / 90.0 AS plon FROM c WHERE stop % 17 <> 0),
j AS (SELECT v.*, p.*  EXCLUDE (operator, direction, destination), p.destination AS p_destination, p.operator = v.operator AS same, p.valid_from <= day AND day <= p.valid_to AS valid,
   (isodow(day) - 1 - first_day + 7) % 7 < 5 AS runs, v.direction = '' OR p.direction = '' OR lower(v.direction) = p.direction AS fits FROM v JOIN p ON v.route = p.line),
l AS (SELECT vehicle_id, bool_or(same) AS same, bool_or(same AND valid) AS valid, bool_or(same AND valid AND runs) AS runs, bool_or(same AND valid AND fits) AS other_day, bool_or(same AND valid AND runs AND fits) AS fits FROM j GROUP BY 1),
d AS (SELECT vehicle_id, j.pattern_id, min(sqrt(pow(radians(plon - lon) * cos(radians((lat + plat) / 2)), 2) + pow(radians(plat - lat), 2)) * 6371000.0) AS d,
   arg_min(q.index, (sqrt(pow(radians(plon - lon) * cos(radians((lat + plat) / 2)), 2) + pow(radians(plat - lat), 2)), q.index)) AS index, arg_min(q.stop, (sqrt(pow(radians(plon - lon) * cos(radians((lat + plat) / 2)), 2) + pow(radians(plat - lat), 2)), q.index)) AS stop,
   any_value(j.loop) AS loop, any_value(j.p_destination) AS p_destination, any_value(j.destination) AS destination FROM j JOIN q USING (pattern_id) WHERE same AND valid AND runs AND fits GROUP BY 1, 2),
n AS (SELECT *, min(d) OVER (PARTITION BY vehicle_id) AS best FROM d JOIN s USING (pattern_id)),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY d, stop_count DESC, pattern_id) AS k FROM n WHERE d - best < 60) WHERE k = 1),
w AS (SELECT *, right(p_destination, 1) = substring(destination, 7, 1) AS agrees, row_number() OVER (PARTITION BY vehicle_id ORDER BY d, stop_count DESC, pattern_id) AS place FROM u),
x AS (SELECT vehicle_id, min(best) AS best, count(*) AS paths, count(*) FILTER (WHERE agrees) AS agreeing, max(pattern_id) FILTER (WHERE place = 1) AS first_id, max(pattern_id) FILTER (WHERE agrees) AS agreed_id FROM w GROUP BY 1),
y AS (SELECT v.vehicle_id, l.vehicle_id IS NOT NULL AS held, l.* EXCLUDE (vehicle_id), x.* EXCLUDE (vehicle_id), CASE WHEN paths = 1 THEN first_id WHEN agreeing = 1 THEN agreed_id END AS chosen
   FROM v LEFT JOIN l USING (vehicle_id) LEFT JOIN x USING (vehicle_id)),
m AS (SELECT y.vehicle_id, CASE WHEN NOT held THEN 'no_pattern_for_route' WHEN NOT y.same THEN 'no_pattern_for_operator' WHEN NOT y.valid THEN 'no_pattern_valid_on_date' WHEN NOT runs THEN 'no_pattern_operating_today'
   WHEN NOT fits AND other_day THEN 'no_pattern_for_direction_today' WHEN NOT fits THEN 'no_pattern_for_direction' WHEN y.best IS NULL THEN 'no_stop_coordinates' WHEN y.best > 500 THEN 'too_far_from_pattern'
   WHEN chosen IS NULL THEN 'ambiguous_branch' WHEN w.loop THEN 'loop_pattern' END AS reason, chosen, w.index, w.stop, w.d, paths, y.best FROM y LEFT JOIN w ON w.vehicle_id = y.vehicle_id AND w.pattern_id = y.chosen)
"""


def _vehicles(spark, sf_dir):
    key = F.col("c_custkey")
    direction = F.when(key % 5 == 0, "").when(key % 5 == 1, "O").when(key % 5 == 2, "f").otherwise("x")
    place = [(F.lit(start) + key * prime % 1000 / 9000.0).alias(name) for name, start, prime in (("lat", 53.4001, 7919), ("lon", -2.2999, 104729))]
    day = F.date_add(F.lit("1996-06-01").cast("date"), F.col("c_nationkey").cast("int"))
    words = F.concat(F.lit("Place_"), key % 7, F.lit(" Station")).alias("destination")
    return table(spark, sf_dir, "customer").select(
        key.alias("vehicle_id"), F.concat(F.lit("L"), F.floor(key / 10)).alias("route"), F.concat(F.lit("O"), key % 4).alias("operator"), direction.alias("direction"), words, *place, day.alias("day")
    )


def _lines(spark, sf_dir):
    key = F.col("o_orderkey")
    empty = F.lit(None).cast(RULE)
    days = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: ((key + k) % 7).cast("int"))
    rules = F.array(F.struct(days.alias("days"), *[empty[name].alias(name) for name in ("holidaysOnly", "alsoOn", "notOn", "serviced", "bankHolidays")]))
    calls = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("pattern_id"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("stop"))
    stop = F.col("s_suppkey")
    places = table(spark, sf_dir, "supplier").filter(stop % 17 != 0).select(stop.alias("stop"), (53.4 + stop % 10 / 90.0).alias("lat"), (-2.3 + F.floor(stop / 10) % 10 / 90.0).alias("lon"))
    o = orders(spark, sf_dir)
    patterns = o.select(
        key.alias("pattern_id"), F.concat(F.lit("L"), F.floor(F.col("o_custkey") / 12)).alias("line"), F.concat(F.lit("O"), key % 3).alias("operator"),
        F.when(key % 11 == 0, "").otherwise(F.lower("o_orderstatus")).alias("direction"), F.concat(F.lit("place "), key % 9).alias("destination"), (key % 13 == 0).alias("loop"),
        F.col("o_orderdate").alias("valid_from"), F.date_add("o_orderdate", 400).alias("valid_to"), rules.alias("rules"),
    )
    patterns = matching.with_calls(patterns, calls, places)
    return matching.by_line(patterns.withColumn("stop_count", F.size("sequence")))


def _matched(spark, sf_dir):
    return matching.match(_vehicles(spark, sf_dir), _lines(spark, sf_dir))


@query(
    "WITH" + _MADE + """SELECT vehicle_id, reason, CASE WHEN reason IS NULL THEN chosen END AS pattern_id, CAST(CASE WHEN reason IS NULL THEN index END AS INTEGER) AS pattern_index, CASE WHEN reason IS NULL THEN stop END AS stop,
  CAST(round(CASE WHEN reason IS NULL THEN d WHEN reason IN ('ambiguous_branch', 'too_far_from_pattern') THEN best END) AS BIGINT) AS metres,
  CAST(CASE WHEN reason IS NULL OR reason IN ('ambiguous_branch', 'loop_pattern') THEN paths END AS INTEGER) AS plausible_paths FROM m"""
)
def matched_vehicles(spark, sf_dir):
    """Every vehicle's pattern and nearest stop, or the first of ten reasons why there is none."""
    m = _matched(spark, sf_dir)
    return m.select("vehicle_id", "reason", "pattern_id", "pattern_index", F.when(F.col("matched"), F.col("nearest_stop")).alias("stop"), "metres", "plausible_paths")


@query("WITH" + _MADE + "SELECT coalesce(reason, 'matched') AS outcome, count(*) AS vehicles FROM m GROUP BY 1")
def matching_summary(spark, sf_dir):
    """Vehicles matched, and not, by reason."""
    return matching.summary(_matched(spark, sf_dir))


@query(
    "WITH" + _MADE + """, e AS (SELECT l_orderkey AS pattern_id, printf('%02d:%02d:00', CAST(l_quantity AS INTEGER) % 24, (l_linenumber * 7) % 60) AS departure, l_suppkey % 3 AS timing FROM lineitem WHERE l_orderkey % 5 <> 0),
a AS (SELECT vehicle_id, chosen AS pattern_id, CASE vehicle_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '1996-06-03T25:00:00Z' ELSE printf('1996-06-03T%02d:%02d:00Z', vehicle_id % 24, (vehicle_id % 7 + 1) * 7) END AS aimed FROM m WHERE reason IS NULL),
b AS (SELECT a.*, printf('%02d:%s', (CAST(substring(aimed, 12, 2) AS INTEGER) + 1) % 24, substring(aimed, 15, 5)) AS local FROM a),
g AS (SELECT pattern_id, departure, count(*) AS journeys, count(DISTINCT timing) AS timings, min(timing) AS timing FROM e GROUP BY 1, 2)
SELECT vehicle_id, CASE WHEN aimed IS NULL THEN 'no_aimed_departure_reported' WHEN vehicle_id % 6 = 1 THEN 'aimed_departure_unreadable' WHEN b.pattern_id NOT IN (SELECT pattern_id FROM e) THEN 'pattern_has_no_departure_times'
  WHEN journeys IS NULL THEN 'aimed_departure_not_in_timetable' WHEN timings > 1 THEN 'journeys_at_this_time_differ_in_timing' END AS withheld, CASE WHEN vehicle_id % 6 > 1 THEN journeys END AS journeys,
  CASE WHEN vehicle_id % 6 > 1 AND timings = 1 THEN timing END AS timing FROM b LEFT JOIN g ON g.pattern_id = b.pattern_id AND g.departure = b.local"""
)
def scheduled_journeys(spark, sf_dir):
    """The timetabled journey of every matched vehicle, by the departure it reports, or why none can be named."""
    x = lineitem(spark, sf_dir).filter("l_orderkey % 5 <> 0")
    at = F.format_string("%02d:%02d:00", F.col("l_quantity").cast("int") % 24, F.col("l_linenumber").cast("int") * 7 % 60)
    departures = x.select(F.col("l_orderkey").alias("pattern_id"), at.alias("departure"), (F.col("l_suppkey") % 3).alias("timing"))
    key = F.col("vehicle_id")
    aimed = F.format_string("1996-06-03T%02d:%02d:00Z", (key % 24).cast("int"), ((key % 7 + 1) * 7).cast("int"))
    m = _matched(spark, sf_dir).filter("matched").withColumn("aimed", F.when(key % 6 == 1, "1996-06-03T25:00:00Z").when(key % 6 > 1, aimed))
    return matching.scheduled_journey(m, departures).select("vehicle_id", "withheld", "journeys", "timing")


@query(
    "WITH" + _MADE + """SELECT route, count(*) FILTER (WHERE was AND now) AS kept, count(*) FILTER (WHERE NOT was AND now) AS gained, count(*) FILTER (WHERE was AND NOT now) AS lost FROM (
  SELECT v.route, reason IS NULL AS was, reason IS NULL OR reason = 'ambiguous_branch' AS now FROM m JOIN v USING (vehicle_id)) GROUP BY 1"""
)
def naming_rules_compared(spark, sf_dir):
    """Two rules of naming on the same vehicles: how many more, or fewer, the second names, by route."""
    m = _matched(spark, sf_dir)
    before = m.select("vehicle_id", "route", F.col("matched").alias("named"))
    after = m.select("vehicle_id", (F.col("matched") | (F.col("reason") == "ambiguous_branch")).alias("named"))
    return matching.gained_and_lost(before, after, "vehicle_id", ["route"])
