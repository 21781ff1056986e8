"""Aggregations: conditional counts, percentile conventions, histograms, modes, merges, ledgers, text search, pivots."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions import stats, text
from headway.plans.base import events, lineitem, orders, registering
from headway.session import table

QUERIES, ORACLES, query = registering()


@query(
    """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_large, max(ts) FILTER (WHERE value > 50) AS last_large,
              count(DISTINCT CAST(user_id AS VARCHAR) || '|' || CAST(CAST(ts AS DATE) AS VARCHAR)) AS user_days FROM events GROUP BY 1"""
)
def conditional_counts(spark, sf_dir):
    """A2, A3: filtered aggregates and distinct pairs."""
    large = F.col("value") > 50
    return events(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(large, 1)).alias("n_large"), F.max(F.when(large, F.col("ts"))).alias("last_large"), F.countDistinct("user_id", F.to_date("ts")).alias("user_days")
    )


@query(
    """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (WHERE i = least(CAST(floor(n * 0.8) AS BIGINT), n - 1)) AS p80_index, max(value) FILTER (WHERE i = CAST(floor((n - 1) * 0.8) AS BIGINT)) AS p80_floor,
       max(value) FILTER (WHERE i = CAST(floor(n / 2) AS BIGINT)) AS upper_median FROM s GROUP BY 1"""
)
def percentile_conventions(spark, sf_dir):
    """Index, floor and upper-median conventions. Values are counted, dealt by ranges and ranked; no group lands in one task."""
    wanted = {"p80_index": ("index", 0.8), "p80_floor": ("floor", 0.8), "upper_median": ("upper", 0.5)}
    return stats.quantiles(events(spark, sf_dir), ["event_type"], "value", wanted).drop("n")


@query("SELECT event_type, CAST(floor(value / 10.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def error_histogram(spark, sf_dir):
    """Binned values."""
    return stats.histogram(events(spark, sf_dir), ["event_type"], "value", 10.0)


@query(
    """WITH h AS (SELECT event_type, CAST(floor(value / 10.0) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY event_type) AS total FROM h)
SELECT event_type, CAST(min(bin) FILTER (WHERE cum >= total * 0.9) * 10.0 AS DOUBLE) AS p90 FROM c GROUP BY 1"""
)
def pooled_quantile(spark, sf_dir):
    """Lower quantile of a pooled histogram."""
    bins = stats.histogram(events(spark, sf_dir), ["event_type"], "value", 10.0)
    return stats.histogram_quantile(bins, ["event_type"], 0.9, 10.0, "p90")


@query(
    """SELECT l_suppkey, l_returnflag AS dominant, n FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS rn FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE rn = 1"""
)
def dominant_operator(spark, sf_dir):
    """The most frequent value of each dataset."""
    n = lineitem(spark, sf_dir).groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    order = W.partitionBy("l_suppkey").orderBy(F.desc("n"), "l_returnflag")
    return n.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("l_suppkey", F.col("l_returnflag").alias("dominant"), "n")


@query(
    """SELECT p_brand, p_type, count(*) AS n, min(p_size) AS min_size, CASE WHEN bool_or(p_size > 40) THEN true WHEN bool_and(p_size <= 20) THEN false END AS public_use,
              string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes FROM part GROUP BY 1, 2"""
)
def merged_patterns(spark, sf_dir):
    """Rows merged by key with a three-valued flag and the union of their sets."""
    p = table(spark, sf_dir, "part")
    flag = F.when(F.bool_or(F.col("p_size") > 40), True).when(F.bool_and(F.col("p_size") <= 20), False)
    sizes = F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ",")
    return p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("min_size"), flag.alias("public_use"), sizes.alias("sizes"))


@query(
    """SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS placed, count(DISTINCT c_custkey) FILTER (WHERE o_orderkey IS NULL) AS without,
              count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS filled, round(100.0 * count(o_orderkey) FILTER (WHERE o_orderstatus = 'F') / nullif(count(o_orderkey), 0), 4) AS share
       FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1"""
)
def coverage_ledger(spark, sf_dir):
    """What each group has, what it lacks and why, with shares."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    per = orders(spark, sf_dir).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("placed"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("filled"))
    rows = c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    total = lambda x: F.coalesce(F.sum(x), F.lit(0)).alias(x)
    out = rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("customers"), total("placed"), F.count(F.when(F.col("placed").isNull(), 1)).alias("without"), total("filled"))
    return out.withColumn("share", F.round(F.try_divide(F.col("filled") * 100.0, F.col("placed")), 4))


@query(
    """SELECT o_orderpriority, n_orders, total FROM (SELECT o_orderpriority, count(*) AS n_orders, CAST(round(sum(o_totalprice), 0) AS BIGINT) AS total FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01' GROUP BY 1)
       ORDER BY n_orders DESC, o_orderpriority LIMIT 3"""
)
def top_services(spark, sf_dir):
    """Services by observations, the first three."""
    o = orders(spark, sf_dir).filter(F.col("o_orderdate") < "1997-01-01")
    per = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 0).cast("long").alias("total"))
    return per.orderBy(F.desc("n_orders"), "o_orderpriority").limit(3)


@query(
    """SELECT s_nationkey, string_agg(b, ',' ORDER BY b) AS towards FROM (
  SELECT s_nationkey, b, row_number() OVER (PARTITION BY s_nationkey ORDER BY b) AS k FROM (
    SELECT DISTINCT s_nationkey, replace(p_type, '_', ' ') AS b FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)) WHERE k <= 4 GROUP BY 1"""
)
def destinations_at_stop(spark, sf_dir):
    """Distinct destinations, sorted, the first four."""
    s, p = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part").select("p_partkey", F.translate("p_type", "_", " ").alias("b"))
    rows = lineitem(spark, sf_dir).select("l_suppkey", "l_partkey").join(p, F.col("l_partkey") == F.col("p_partkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.groupBy("s_nationkey").agg(F.array_join(F.slice(F.sort_array(F.collect_set("b")), 1, 4), ",").alias("towards"))


@query(
    """WITH d AS (SELECT user_id, event_type, ts, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events WHERE value > 100)
SELECT event_id, user_id FROM (SELECT d.*, row_number() OVER (ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, ts, event_id) AS place FROM d) WHERE place <= 150"""
)
def greedy_distinct(spark, sf_dir):
    """The first of each vehicle while places last, later ones fill what is left."""
    w = W.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    e = events(spark, sf_dir).filter("value > 100").withColumn("k", F.row_number().over(w))
    return e.orderBy(F.col("k") > 1, "ts", "event_id").limit(150).select("event_id", "user_id")


@query(
    """SELECT p_brand, row_number() OVER (ORDER BY CAST(substring(p_brand, 7) AS INTEGER), p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)"""
)
def natural_order(spark, sf_dir):
    """Every line name with its place in the numeric-aware order. Distinct names are few, so one window ranks them."""
    p = table(spark, sf_dir, "part").select("p_brand").distinct()
    return p.withColumn("place", F.row_number().over(W.orderBy(text.natural_key(F.substring("p_brand", 7, 9)), "p_brand")).cast("long"))


@query(
    """SELECT event_type, round(median(value), 4) AS median_value, round(quantile_cont(abs(value - 50), 0.8), 4) AS p80_off, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days,
              median(value) BETWEEN 0 AND 60 AND count(*) >= 20 AS verified FROM events GROUP BY 1"""
)
def anchor_verdicts(spark, sf_dir):
    """Median signed error, 80th percentile of absolute error, support and verdict per pattern."""
    e = events(spark, sf_dir).select("event_type", "value", F.to_date("ts").alias("day"), F.abs(F.col("value") - 50).alias("off"))
    value = stats.quantiles(e, ["event_type"], "value", {"median": ("linear", 0.5)}).drop("n")
    off = stats.quantiles(e, ["event_type"], "off", {"off": ("linear", 0.8)}).drop("n")
    per = e.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("n")).groupBy("event_type").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"))
    rows = per.join(value, "event_type").join(off, "event_type")
    verified = F.col("median").between(0, 60) & (F.col("n") >= 20)
    return rows.select("event_type", F.round("median", 4).alias("median_value"), F.round("off", 4).alias("p80_off"), "n", "days", verified.alias("verified"))


@query(
    """WITH p AS (SELECT unnest([0.5, 0.8, 1.0, 1.2, 1.5]) AS f),
x AS (SELECT event_type, f, round(quantile_cont(abs(value * f - 30), 0.5), 6) AS err FROM events, p GROUP BY 1, 2)
SELECT event_type, CAST(f AS DOUBLE) AS best FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY err, f) AS k FROM x) WHERE k = 1"""
)
def grid_search(spark, sf_dir):
    """The parameter with the smallest median error. The grid is five literals, exploded per row."""
    e = events(spark, sf_dir).select("event_type", "value", F.explode(F.array(*[F.lit(f) for f in (0.5, 0.8, 1.0, 1.2, 1.5)])).alias("f"))
    e = e.withColumn("off", F.abs(F.col("value") * F.col("f") - 30))
    err = stats.quantiles(e, ["event_type", "f"], "off", {"err": ("linear", 0.5)}).withColumn("err", F.round("err", 6))
    return err.groupBy("event_type").agg(F.min(F.struct("err", "f")).alias("x")).select("event_type", F.col("x.f").alias("best"))


@query(
    """SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1"""
)
def json_fields(spark, sf_dir):
    """Fields of JSON text, parsed once with a declared schema."""
    e = events(spark, sf_dir).select(F.from_json("props", "k long")["k"].alias("k"), "value")
    return e.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    """WITH s AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01'), t AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' AND l_returnflag = 'R')
SELECT coalesce(s.k, t.k) AS l_suppkey, CASE WHEN t.k IS NULL THEN 'held_only' WHEN s.k IS NULL THEN 'observed_only' ELSE 'both' END AS side FROM s FULL JOIN t ON s.k = t.k"""
)
def held_and_observed(spark, sf_dir):
    """Set logic: held and observed, only held, only observed, in one aggregation."""
    x = lineitem(spark, sf_dir)
    held = F.max((F.col("l_shipdate") < "1996-01-01").cast("int")) == 1
    seen = F.max(((F.col("l_shipdate") >= "1998-06-01") & (F.col("l_returnflag") == "R")).cast("int")) == 1
    per = x.groupBy("l_suppkey").agg(held.alias("h"), seen.alias("o")).filter("h OR o")
    return per.select("l_suppkey", F.when(~F.col("o"), "held_only").when(~F.col("h"), "observed_only").otherwise("both").alias("side"))


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, CAST(round(sum(l_extendedprice * (1 - l_discount)), 0) AS BIGINT) AS revenue, round(avg(l_discount), 6) AS mean_discount
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def totals(spark, sf_dir):
    """A1: sums and counts by group."""
    x = lineitem(spark, sf_dir).filter(F.col("l_shipdate") <= "1998-09-02")
    return x.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 0).cast("long").alias("revenue"), F.round(F.avg("l_discount"), 6).alias("mean_discount"),
    )
