"""Cycles of a feed: events stand for reports as they arrive, users for vehicles and feeds."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.plans.base import events, registering
from headway.streaming import cycle

QUERIES, ORACLES, query = registering()

#: A report's own time in ms: ten-minute steps, some late and some repeated; the payload that brings it is its event.
_AT = "(epoch_us(ts) // 600000000 - event_id % 4) * 600000"


def _reports(spark, sf_dir):
    at = (F.floor(F.unix_micros("ts") / 600_000_000) - F.col("event_id") % 4) * 600_000
    day = F.when(F.col("event_id") % 13 == 0, 9).otherwise(F.floor(F.unix_micros("ts") / 86_400_000_000) % 3)
    return events(spark, sf_dir).select(
        F.concat(F.lit("O"), F.col("user_id") % 3).alias("operator"), F.col("user_id").cast("string").alias("vehicle"), F.col("event_id").alias("seq"),
        at.cast("long").alias("at"), F.concat(F.lit("S"), day).alias("service"), F.floor(F.unix_micros("ts") / 1000).alias("received"), (F.col("user_id") % 7).alias("run"),
    )


@query()
def journey_reports(spark, sf_dir):
    """2.12: which of six kinds every report of a vehicle is, and how many of its newest are held; checked by brute force in the tests."""
    return cycle.journey_fixes(_reports(spark, sf_dir))


@query(
    f"""WITH r AS (SELECT 'O' || user_id % 3 AS operator, user_id, event_id AS seq, {_AT} AS at_ms, epoch_us(ts) // 1000 AS received, user_id % 7 AS run FROM events),
n AS (SELECT *, coalesce(at_ms > max(at_ms) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new, min(seq) OVER (PARTITION BY run) AS first_seq FROM r)
SELECT run, seq, CASE WHEN (received - at_ms) / 1000.0 > 900 THEN '>900' ELSE CAST(CAST(floor((received - at_ms) / 1000.0) AS BIGINT) AS VARCHAR) END AS bucket, count(*) AS reports FROM n WHERE is_new AND seq > first_seq GROUP BY 1, 2, 3"""
)
def arrival_ages(spark, sf_dir):
    """How old the reports were that each payload brought for the first time, by whole seconds; a run's first payload counts nothing."""
    r = _reports(spark, sf_dir)
    return cycle.arrival_ages(cycle.journey_fixes(r), r.select("run", "seq", "received"))


@query(
    """WITH p AS (SELECT event_type AS feed, event_id AS seq, CAST(event_id // 7 % 3 AS VARCHAR) AS digest, event_id % 11 = 0 AS refused FROM events),
l AS (SELECT *, last_value(CASE WHEN NOT refused THEN digest END IGNORE NULLS) OVER (PARTITION BY feed ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM p)
SELECT feed, seq, digest, CASE WHEN digest = last THEN 'repeat_payload' WHEN refused THEN 'malformed' ELSE 'succeeded' END AS outcome FROM l"""
)
def payload_outcomes(spark, sf_dir):
    """2.12: payloads that repeat the one before them, are refused, or bring something."""
    k = F.col("event_id")
    p = events(spark, sf_dir).select(F.col("event_type").alias("feed"), k.alias("seq"), (F.floor(k / 7) % 3).cast("string").alias("digest"), (k % 11 == 0).alias("refused"))
    return cycle.classified_payloads(p)


def publications(spark, sf_dir):
    """vehicle, seq, journey, latest, trail: each event publishes its user's up to six reports of the last 240 s of the same day, time running a hundred times as fast."""
    at = F.floor(F.unix_micros("ts") / 100_000).cast("long")
    e = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("vehicle"), "event_id", at.alias("latest"), F.floor(F.unix_micros("ts") / 86_400_000_000).cast("string").alias("journey"))
    w = W.partitionBy("vehicle", "journey").orderBy("latest", "event_id")
    before = F.filter(F.collect_list("latest").over(w.rowsBetween(-6, -1)), lambda t: (t < F.col("latest")) & (t >= F.col("latest") - 240_000))
    seq = F.row_number().over(W.partitionBy("vehicle").orderBy("latest", "event_id")).cast("long")
    return e.withColumns({"trail": before, "seq": seq})


@query()
def reports_held_back_to(spark, sf_dir):
    """2.12: from when on every report of a vehicle's journey is held; checked by brute force in the tests."""
    return cycle.held_back_to(publications(spark, sf_dir))
