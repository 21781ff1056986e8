"""Publications as of their own time, and the named checks they must pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.operators import quality, replay
from headway.plans.base import events, lineitem, orders, registering
from headway.session import table

QUERIES, ORACLES, query = registering()


@query(
    """WITH r AS (SELECT user_id AS vehicle, event_id, epoch_us(ts) // 1500000 + CASE WHEN event_id % 31 = 0 THEN 40000 ELSE 0 END AS observed, epoch_us(ts) // 1500000 + event_id % 5 * 7000 AS retrieved, CASE WHEN event_id % 23 = 0 THEN epoch_us(ts) // 1500000 + event_id % 5 * 7000 + 60000 END AS withdrawn FROM events),
p AS (SELECT DISTINCT observed // 20000 * 20000 AS published FROM r), m AS (SELECT published, r.*, row_number() OVER (PARTITION BY published, vehicle ORDER BY observed DESC, retrieved, event_id) AS k
  FROM p JOIN r ON retrieved <= published AND published - observed <= 900000 AND (withdrawn IS NULL OR published < withdrawn))
SELECT published, vehicle, event_id, observed, CASE WHEN published - observed <= 60000 THEN 'fresh' WHEN published - observed <= 150000 THEN 'ageing' ELSE 'stale' END AS freshness FROM m WHERE k = 1 AND published >= observed"""
)
def replayed_publications(spark, sf_dir):
    """What every publication showed, from what was known at its own time; reports withdrawn later still count until then."""
    at, k = F.floor(F.unix_micros("ts") / 1_500_000).cast("long"), F.col("event_id")
    retrieved = at + k % 5 * 7000
    r = events(spark, sf_dir).select(F.col("user_id").alias("vehicle"), "event_id", (at + F.when(k % 31 == 0, 40_000).otherwise(0)).alias("observed"), retrieved.alias("retrieved"), F.when(k % 23 == 0, retrieved + 60_000).alias("withdrawn"))
    p = r.select((F.floor(F.col("observed") / 20_000) * 20_000).alias("published"))
    return replay.replayed(r, p, ["vehicle"], ["event_id"]).select("published", "vehicle", "event_id", "observed", "freshness")


@query(
    """WITH p AS (SELECT o_orderkey AS publication, CASE o_orderkey % 9 WHEN 0 THEN 'stale' WHEN 1 THEN 'odd' ELSE 'live' END AS state, o_orderkey * 1000 + 500000 AS published, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 1000 + 500000 - 10 + o_orderkey % 3 * 6 END AS previous FROM orders),
v AS (SELECT l_orderkey AS publication, l_linenumber, l_suppkey AS vehicle, CASE WHEN l_partkey % 40 > 0 THEN l_orderkey * 1000 + 500000 - CAST(l_quantity AS BIGINT) * 1000 + 2500 END AS observed, 53.45 + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS lat, -2.25 AS lon, CAST(l_quantity AS BIGINT) * 20 - 50 AS age_s, CASE WHEN l_partkey % 60 = 0 THEN 'estimated' ELSE 'observed' END AS kind,
  CASE l_partkey % 4 WHEN 0 THEN 'reported' WHEN 1 THEN 'absent' WHEN 2 THEN 'invalid' ELSE 'not_captured' END AS status, CASE WHEN l_partkey % 4 = 0 THEN l_partkey % 365 WHEN l_partkey % 45 = 1 THEN 10 END AS bearing, CAST(l_discount * 100 AS BIGINT) * 26000 AS before_ms, l_partkey % 55 > 0 AS known FROM lineitem),
g AS (SELECT publication, count(*) AS n, bool_and(observed IS NOT NULL) AS timed, bool_and(lat BETWEEN 53.40 AND 53.53) AS inside, bool_and(age_s <= 900) AS young, bool_and(kind = 'observed') AS obs, bool_and((bearing IS NOT NULL) = (status = 'reported') AND coalesce(bearing BETWEEN 0 AND 360, true)) AS bear, bool_and(coalesce(observed <= publication * 1000 + 500000, false)) AS past FROM v GROUP BY 1),
t AS (SELECT publication, bool_and(ok) AS trails FROM (SELECT publication, vehicle, bool_and(before_ms > 0 AND before_ms <= 240000 AND known) AND count(*) <= 6 AS ok FROM v GROUP BY 1, 2) GROUP BY 1),
f AS (SELECT p.*, g.* EXCLUDE (publication), trails FROM p LEFT JOIN g USING (publication) LEFT JOIN t USING (publication))
SELECT publication, unnest(['state_is_known', 'positions_have_observation_times', 'positions_inside_declared_area', 'no_expired_position_published', 'every_position_is_an_observed_fix', 'trail_is_earlier_observed_history', 'bearings_reported_or_explicitly_absent', 'live_state_requires_positions', 'publication_time_not_before_newest_observation', 'publication_time_not_going_backwards']) AS check_name,
  unnest([state <> 'odd', coalesce(timed, true), coalesce(inside, true), coalesce(young, true), coalesce(obs, true), coalesce(trails, true), coalesce(bear, true), state <> 'live' OR coalesce(n, 0) > 0, coalesce(past, true), previous IS NULL OR published >= previous]) AS passed FROM f"""
)
def live_checks(spark, sf_dir):
    """The ten named checks of live publications: orders publish, their line items are vehicles and trail points."""
    k, q, key = F.col("l_partkey"), F.col("l_quantity").cast("long"), F.col("o_orderkey")
    published = key * 1000 + 500_000
    p = orders(spark, sf_dir).select(key.alias("publication"), F.when(key % 9 == 0, "stale").when(key % 9 == 1, "odd").otherwise("live").alias("state"), published.alias("published"), F.when(key % 4 > 0, published - 10 + key % 3 * 6).alias("previous"))
    x = lineitem(spark, sf_dir)
    v = x.select(
        F.col("l_orderkey").alias("publication"), F.col("l_suppkey").alias("vehicle"), F.when(k % 40 > 0, F.col("l_orderkey") * 1000 + 500_000 - q * 1000 + 2500).alias("observed"), (F.lit(53.45) + F.when(k % 50 == 0, 1).otherwise(0)).alias("lat"), F.lit(-2.25).alias("lon"),
        (q * 20 - 50).alias("age_s"), F.when(k % 60 == 0, "estimated").otherwise("observed").alias("kind"), F.when(k % 4 == 0, k % 365).when(k % 45 == 1, 10).cast("double").alias("bearing"),
        F.element_at(F.array(*map(F.lit, quality.BEARING_STATUSES)), (k % 4 + 1).cast("int")).alias("bearing_status"),
    )
    trail = x.select(F.col("l_orderkey").alias("publication"), F.col("l_suppkey").alias("vehicle"), ((F.col("l_discount") * 100).cast("long") * 26_000).alias("before_ms"), (k % 55 > 0).alias("source_known"))
    return quality.live_checks(v, trail, p)


@query(
    """WITH s AS (SELECT s_suppkey AS snapshot, 1 + CASE WHEN s_suppkey % 13 = 0 THEN 1 ELSE 0 END AS version, epoch_ms(TIMESTAMP '1994-01-01') + s_suppkey % 100 * 86400000 AS a, epoch_ms(TIMESTAMP '1994-01-01') + s_suppkey % 100 * 86400000 + (s_suppkey % 17 - 1) * 86400000 AS z, CASE WHEN s_suppkey % 6 > 0 THEN epoch_ms(TIMESTAMP '1994-02-01') END AS served_end FROM supplier),
x AS (SELECT l_suppkey AS snapshot, l_orderkey % 50 AS journey, l_partkey % 7 AS source, 53.45 + CASE WHEN l_partkey = 77 THEN 1 ELSE 0 END AS lat FROM lineitem), g AS (SELECT snapshot, count(*) AS points, count(DISTINCT journey) AS wp, count(*) FILTER (WHERE snapshot % 5 = 0 AND source = 6) AS unresolved, count(*) FILTER (WHERE lat > 54) AS outside FROM x GROUP BY 1),
w AS (SELECT snapshot, count(*) AS n FROM s JOIN orders ON epoch_ms(CAST(o_orderdate AS TIMESTAMP)) BETWEEN a - 120000 AND z + 30000 GROUP BY 1), f AS (SELECT s.*, coalesce(points, 0) AS points, coalesce(wp, 0) AS wp, coalesce(unresolved, 0) AS unresolved, coalesce(outside, 0) AS outside, coalesce(n, 0) AS n FROM s LEFT JOIN g USING (snapshot) LEFT JOIN w USING (snapshot))
SELECT snapshot, unnest(['schema_shape', 'window_ordered', 'journeys_non_empty', 'points_reconcile_with_quality', 'every_point_resolves_to_a_source', 'coordinates_inside_declared_bounds', 'no_unvalidated_timetable_claim', 'built_from_full_warehouse', 'window_end_not_earlier_than_served', 'observations_not_lost_without_suppression']) AS check_name,
  unnest([version = 1, z > a, wp = 50, points = 600, unresolved = 0, outside = 0, snapshot % 8 > 0, points = n, served_end IS NULL OR z >= served_end, served_end IS NULL OR points + snapshot % 3 >= 580]) AS passed FROM f"""
)
def snapshot_checks(spark, sf_dir):
    """The ten named checks of archive snapshots: suppliers are snapshots of their line items."""
    k = F.col("s_suppkey")
    begin = F.unix_millis(F.lit("1994-01-01").cast("timestamp"))
    served = F.when(k % 6 > 0, F.unix_millis(F.lit("1994-02-01").cast("timestamp")))
    start = begin + k % 100 * 86_400_000
    s = table(spark, sf_dir, "supplier").select(
        k.alias("snapshot"), (F.lit(1) + F.when(k % 13 == 0, 1).otherwise(0)).alias("version"), F.lit("archive").alias("mode"), start.alias("start"), (start + (k % 17 - 1) * 86_400_000).alias("end"),
        F.lit(-3.0).alias("west"), F.lit(53.0).alias("south"), F.lit(-2.0).alias("east"), F.lit(54.0).alias("north"), F.lit(50).alias("journeys"), F.lit(600).alias("unique_observations"), (k % 8 == 0).alias("timetable_matched"),
        F.lit(None).cast("double").alias("scheduled_coverage"), served.alias("served_end"), F.when(served.isNotNull(), 580).alias("served_count"), (k % 3).alias("newly_suppressed"),
    )
    x = lineitem(spark, sf_dir)
    points = x.select(F.col("l_suppkey").alias("snapshot"), (F.col("l_orderkey") % 50).alias("journey"), (F.lit(53.45) + F.when(F.col("l_partkey") == 77, 1).otherwise(0)).alias("lat"), F.lit(-2.5).alias("lon"), (F.col("l_partkey") % 7).alias("source"))
    sources = s.select("snapshot", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("snapshot") % 5 == 0, 5).otherwise(6).cast("long"))).alias("source"))
    warehouse = orders(spark, sf_dir).select(F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("observed"))
    return quality.snapshot_checks(points, sources, s, warehouse)
