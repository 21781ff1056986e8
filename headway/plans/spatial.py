"""Nearness over suppliers and customers placed on a deterministic map."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.operators import spatial
from headway.plans.base import registering
from headway.session import table

QUERIES, ORACLES, query = registering()

_PLACES = """
s AS (SELECT s_suppkey, 53.40 + (s_suppkey * 7919 % 1000) / 10000.0 AS lat, -2.30 + (s_suppkey * 104729 % 1000) / 8000.0 AS lon FROM supplier),
c AS (SELECT c_custkey, 53.40 + (c_custkey * 6101 % 1000) / 10000.0 AS to_lat, -2.30 + (c_custkey * 3571 % 1000) / 8000.0 AS to_lon FROM customer),
m AS (SELECT *, sqrt(power(radians(to_lon - lon) * cos(radians((lat + to_lat) / 2)), 2) + power(radians(to_lat - lat), 2)) * 6371000.0 AS metres FROM s, c)"""


def _places(spark, sf_dir):
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    k, q = F.col("s_suppkey"), F.col("c_custkey")
    s = s.select(k, (F.lit(53.40) + (k * 7919 % 1000) / 10000.0).alias("lat"), (F.lit(-2.30) + (k * 104729 % 1000) / 8000.0).alias("lon"))
    return s, c.select(q, (F.lit(53.40) + (q * 6101 % 1000) / 10000.0).alias("to_lat"), (F.lit(-2.30) + (q * 3571 % 1000) / 8000.0).alias("to_lon"))


@query("WITH" + _PLACES + " SELECT s_suppkey, c_custkey, round(metres, 3) AS metres FROM m WHERE metres <= 350")
def walkable_transfers(spark, sf_dir):
    """Pairs within 350 m through a grid of neighbouring cells."""
    s, c = _places(spark, sf_dir)
    return spatial.near_places(s, c, 350.0, 0.004, 0.006, 3).select("s_suppkey", "c_custkey", "metres")


@query(
    "WITH" + _PLACES + """ SELECT s_suppkey, c_custkey, k AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY metres, c_custkey) AS k FROM m WHERE metres <= 900) WHERE k <= 3"""
)
def nearest_stops(spark, sf_dir):
    """The three nearest within 900 m."""
    s, c = _places(spark, sf_dir)
    return spatial.nearest_within(s, c, 900.0, 0.009, 0.015, "s_suppkey", "c_custkey", 3).select("s_suppkey", "c_custkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT a.s_suppkey, c.c_custkey FROM supplier a JOIN customer c ON a.s_nationkey = c.c_nationkey AND abs(a.s_acctbal - c.c_acctbal) <= 25")
def band_matches(spark, sf_dir):
    """Equality plus a band on a number."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("nation"), "s_acctbal")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), "c_acctbal")
    return spatial.band_join(s, c, "s_acctbal", "c_acctbal", 25.0, ("nation",)).select("s_suppkey", "c_custkey")
