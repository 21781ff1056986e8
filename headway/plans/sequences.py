"""Ordered operators: trails, gaps, islands, dominance, as-of joins, tracks."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions import stats
from headway.operators import sequences
from headway.plans.base import events, orders, registering

QUERIES, ORACLES, query = registering()


@query(
    """WITH n AS (SELECT user_id, event_type, max(ts) AS newest FROM events GROUP BY 1, 2),
k AS (SELECT e.event_id, e.user_id, e.event_type, row_number() OVER (PARTITION BY e.user_id, e.event_type ORDER BY e.ts DESC, e.event_id DESC) AS k
      FROM events e JOIN n ON e.user_id = n.user_id AND e.event_type = n.event_type AND e.ts >= n.newest - INTERVAL 432000 SECOND)
SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY k DESC) AS step FROM k WHERE k <= 6"""
)
def trail(spark, sf_dir):
    """At most six points of the last five days of each journey, oldest first."""
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    return sequences.trail(e, ["user_id", "event_type"], "ts", "event_id", 6, 432000).drop("ts")


@query(
    """SELECT event_type, count(*) AS n, round(quantile_cont(gap, 0.5), 3) AS p50_s, round(quantile_cont(gap, 0.95), 3) AS p95_s, round(min(gap), 3) AS min_s, round(max(gap), 3) AS max_s
FROM (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) / 1e6 AS gap FROM events)
WHERE gap > 0 GROUP BY 1"""
)
def report_interval(spark, sf_dir):
    """Gaps between a vehicle's reports, exact percentiles."""
    g = sequences.gaps(events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id")
    at = stats.quantiles(g, ["event_type"], "gap_s", {"p50_s": ("linear", 0.5), "p95_s": ("linear", 0.95), "min_s": ("floor", 0.0), "max_s": ("floor", 1.0)})
    return at.select("event_type", "n", *[F.round(c, 3).alias(c) for c in ("p50_s", "p95_s", "min_s", "max_s")])


@query(
    """WITH f AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(changed) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM f)
SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM g GROUP BY 1, 2"""
)
def runs_of_equal_state(spark, sf_dir):
    """Gaps and islands."""
    i = sequences.islands(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], ["event_type"])
    return i.groupBy("user_id", "island").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@query(
    """SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice,
         min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_totalprice DESC, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS least
  FROM orders) WHERE least IS NULL OR o_totalprice < least"""
)
def undominated_choices(spark, sf_dir):
    """Orders that no later order of the customer undercuts."""
    o = orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return sequences.undominated(o, ["o_custkey"], "o_orderdate", "o_totalprice", "o_orderkey")


@query(
    """WITH p AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, p.purchase_id AS hit_purchase_id FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts <= p.ts WHERE e.event_type = 'view'"""
)
def first_publication_after(spark, sf_dir):
    """As-of forward, the next purchase of the user."""
    e = events(spark, sf_dir)
    p = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"))
    views = e.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    return sequences.asof(views, p, ["user_id"], "ts", ["purchase_id"], forward=True).select("event_id", "hit_purchase_id")


@query(
    """WITH p AS (SELECT user_id, ts, max(event_id) AS purchase_id, max(value) AS paid FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, p.purchase_id AS hit_purchase_id, p.paid AS hit_paid FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'error'"""
)
def latest_known_before(spark, sf_dir):
    """As-of backward, the last purchase known by then."""
    e = events(spark, sf_dir)
    p = e.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("purchase_id"), F.max("value").alias("paid"))
    errors = e.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return sequences.asof(errors, p, ["user_id"], "ts", ["purchase_id", "paid"]).select("event_id", "hit_purchase_id", "hit_paid")


@query(
    """SELECT event_id, user_id, CASE WHEN max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w = 0 THEN round(sum(value) OVER w, 4) END AS running
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""
)
def poisoned_running_sum(spark, sf_dir):
    """A running distance that is unknown from the first unknown link on."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    link = F.when(F.col("event_type") != "error", F.col("value"))
    return events(spark, sf_dir).select("event_id", "user_id", F.round(sequences.poisoned_sum(link, w), 4).alias("running"))


@query(
    """SELECT event_id, user_id FROM (SELECT event_id, user_id, max(CASE WHEN value >= 5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS broken
       FROM events) WHERE broken = 0"""
)
def trailing_stand(spark, sf_dir):
    """The newest reports back to the first that breaks the run."""
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    return sequences.trailing_run(e, ["user_id"], ["ts", "event_id"], F.col("value") >= 5).select("event_id", "user_id")


@query(
    """SELECT event_id, user_id FROM (SELECT event_id, user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM events)
       WHERE value > most"""
)
def new_reports(spark, sf_dir):
    """Values above everything that the vehicle had before; its first counts as nothing."""
    e = events(spark, sf_dir).select("event_id", "user_id", "ts", "value")
    return sequences.new_reports(e, ["user_id"], "value", ["ts", "event_id"]).select("event_id", "user_id")


@query(
    """SELECT user_id, CAST(ts AS DATE) AS day, substring(sha256(CAST(user_id AS VARCHAR) || '|' || strftime(CAST(ts AS DATE), '%Y-%m-%d')), 1, 16) AS track_id, count(*) AS n_points,
              string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS points FROM events GROUP BY 1, 2 HAVING count(*) >= 2"""
)
def replay_tracks(spark, sf_dir):
    """Session-like tracks: a vehicle's ordered points of a day with a derived id; single points are dropped."""
    e = events(spark, sf_dir).withColumn("day", F.to_date("ts"))
    t = e.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n_points"), F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("p")).filter("n_points >= 2")
    track = F.substring(F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), F.date_format("day", "yyyy-MM-dd")), 256), 1, 16)
    return t.select("user_id", "day", track.alias("track_id"), "n_points", F.array_join(F.transform("p", lambda x: x["event_id"].cast("string")), ",").alias("points"))


@query(
    """WITH f AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN ts END) AS ok FROM events GROUP BY 1)
SELECT f.user_id, count(e.event_id) AS streak FROM f LEFT JOIN events e ON e.user_id = f.user_id AND e.event_type = 'error' AND e.ts > coalesce(f.ok, TIMESTAMP '0001-01-01') GROUP BY 1"""
)
def failure_streak(spark, sf_dir):
    """A10: failures since the last success, in one pass: an anti-monotone count needs the last success first."""
    w = W.partitionBy("user_id")
    e = events(spark, sf_dir).withColumn("ok", F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).over(w))
    since = (F.col("event_type") == "error") & (F.col("ok").isNull() | (F.col("ts") > F.col("ok")))
    return e.groupBy("user_id").agg(F.count(F.when(since, 1)).alias("streak"))
