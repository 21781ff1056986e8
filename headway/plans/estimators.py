"""Estimators and their evaluation over event series."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions import stats
from headway.plans.base import events, registering

QUERIES, ORACLES, query = registering()


@query(
    """WITH s AS (SELECT user_id, event_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS dt, value - lag(value) OVER w AS ds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
v AS (SELECT user_id, CASE WHEN dt <= 0 OR ds < -25 OR ds / dt * 1000 > 30 THEN NULL ELSE least(20.0, greatest(0.0, ds / dt * 1000)) END AS speed FROM s WHERE dt >= 20)
SELECT user_id, count(speed) AS n, round(quantile_cont(speed, 0.5), 4) AS cruise FROM v GROUP BY 1"""
)
def cruise_speed(spark, sf_dir):
    """Steps between consecutive reports, jumps left out, the median of what is left."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = events(spark, sf_dir).select("user_id", ((F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6).alias("dt"), (F.col("value") - F.lag("value").over(w)).alias("ds")).filter("dt >= 20")
    v = F.col("ds") / F.col("dt") * 1000
    speed = F.when(~((F.col("dt") <= 0) | (F.col("ds") < -25) | (v > 30)), F.least(F.lit(20.0), F.greatest(F.lit(0.0), v)))
    return s.withColumn("speed", speed).groupBy("user_id").agg(F.count("speed").alias("n"), F.round(stats.linear(F.col("speed"), 0.5), 4).alias("cruise"))


@query(
    """WITH e AS (SELECT event_type, value - 30 AS err, CASE WHEN value <= 10 THEN 10 WHEN value <= 20 THEN 20 WHEN value <= 45 THEN 45 WHEN value <= 120 THEN 120 END AS bin FROM events)
SELECT event_type, CAST(bin AS INTEGER) AS bin, count(*) AS n, round(quantile_cont(abs(err), 0.5), 4) AS p50, round(quantile_cont(abs(err), 0.8), 4) AS p80, round(avg(CASE WHEN abs(err) <= 25 THEN 1.0 ELSE 0.0 END), 6) AS covered
FROM e WHERE bin IS NOT NULL GROUP BY 1, 2"""
)
def error_profile(spark, sf_dir):
    """Error by age bin, each bin open below and closed above, with interval coverage."""
    v, err = F.col("value"), F.abs(F.col("value") - 30)
    bins = F.when(v <= 10, 10).when(v <= 20, 20).when(v <= 45, 45).when(v <= 120, 120)
    e = events(spark, sf_dir).select("event_type", bins.alias("bin"), err.alias("err")).filter("bin IS NOT NULL")
    at = stats.quantiles(e, ["event_type", "bin"], "err", {"p50": ("linear", 0.5), "p80": ("linear", 0.8)}).drop("n")
    per = e.groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("err") <= 25).cast("double")), 6).alias("covered"))
    return per.join(at, ["event_type", "bin"]).select("event_type", "bin", "n", F.round("p50", 4).alias("p50"), F.round("p80", 4).alias("p80"), "covered")


@query(
    """WITH h AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS a, lead(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
i AS (SELECT user_id, event_id, a, least(coalesce(b, a + 150), a + 150) AS z FROM h)
SELECT user_id, CAST(sum(CASE WHEN z > a THEN (z - a + 4) // 5 ELSE 0 END) AS BIGINT) AS moments, count(*) AS holds FROM i GROUP BY 1"""
)
def display_moments(spark, sf_dir):
    """E5: how many five-second moments each held estimate is shown, a hold ending with the next or after 150 s."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.floor(F.unix_micros("ts") / 1_000_000)
    h = events(spark, sf_dir).select("user_id", at.alias("a"), F.lead(at).over(w).alias("b"))
    end = F.least(F.coalesce("b", F.col("a") + 150), F.col("a") + 150)
    moments = F.when(end > F.col("a"), F.floor((end - F.col("a") + 4) / 5)).otherwise(0)
    return h.groupBy("user_id").agg(F.sum(moments).cast("long").alias("moments"), F.count(F.lit(1)).alias("holds"))


@query(
    """WITH m AS (SELECT user_id, event_type, quantile_cont(abs(value - 30), 0.5) AS own FROM events GROUP BY 1, 2)
SELECT event_type, count(*) AS journeys, round(quantile_cont(own, 0.5), 4) AS median_of_medians FROM m GROUP BY 1"""
)
def median_of_medians(spark, sf_dir):
    """Per-journey medians and the median of those."""
    e = events(spark, sf_dir).withColumn("off", F.abs(F.col("value") - 30))
    m = stats.quantiles(e, ["user_id", "event_type"], "off", {"own": ("linear", 0.5)})
    at = stats.quantiles(m, ["event_type"], "own", {"median": ("linear", 0.5)})
    return at.select("event_type", F.col("n").alias("journeys"), F.round("median", 4).alias("median_of_medians"))
