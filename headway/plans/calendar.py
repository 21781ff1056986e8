"""Service days, operating rules and clock times over order dates and event instants."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions import rules, text, time
from headway.plans.base import events, orders, registering

QUERIES, ORACLES, query = registering()

#: One rule: weekdays Monday to Friday in both of two terms' listed dates, never in two closed weeks nor on a day that is a range without an end, and on one Saturday besides.
RULE = """named_struct('days', array(0, 1, 2, 3, 4), 'holidaysOnly', false,
 'alsoOn', array(named_struct('start', date'1996-05-04', 'end', cast(null as date))),
 'notOn', array(named_struct('start', date'1996-08-05', 'end', date'1996-08-18'), named_struct('start', date'1996-12-25', 'end', cast(null as date))),
 'serviced', array(named_struct('mode', 'except', 'kind', 'Holidays', 'organisations', array('schools'), 'ranges', array(named_struct('start', date'1997-02-10', 'end', date'1997-02-14'))),
  named_struct('mode', 'only', 'kind', 'WorkingDays', 'organisations', array('schools'), 'ranges', array(named_struct('start', date'1995-01-09', 'end', date'1997-07-18'))),
  named_struct('mode', 'only', 'kind', 'WorkingDays', 'organisations', array('colleges'), 'ranges', array(named_struct('start', date'1996-01-08', 'end', date'1998-06-26'), named_struct('start', date'1995-06-01', 'end', cast(null as date))))),
 'bankHolidays', cast(null as string))"""


@query(
    """SELECT o_orderkey, CASE WHEN d BETWEEN DATE '1996-08-05' AND DATE '1996-08-18' OR d = DATE '1996-12-25' THEN false WHEN d = DATE '1996-05-04' THEN true
              ELSE isodow(d) <= 5 AND NOT d BETWEEN DATE '1997-02-10' AND DATE '1997-02-14' AND d BETWEEN DATE '1995-01-09' AND DATE '1997-07-18'
               AND (d BETWEEN DATE '1996-01-08' AND DATE '1998-06-26' OR d = DATE '1995-06-01') END AS runs
       FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)"""
)
def operating_rules(spark, sf_dir):
    """Whether a rule applies on a day."""
    return orders(spark, sf_dir).select("o_orderkey", rules.runs_on(F.array(F.expr(RULE)), F.col("o_orderdate")).alias("runs"))


@query("SELECT event_id, CAST(timezone('Europe/London', timezone('UTC', ts)) AS DATE) AS service_day, CAST(isodow(timezone('Europe/London', timezone('UTC', ts))) - 1 AS INTEGER) AS weekday FROM events")
def service_days(spark, sf_dir):
    """The London date of an instant, and its weekday (Monday is 0)."""
    day = time.service_day(F.col("ts"))
    return events(spark, sf_dir).select("event_id", day.alias("service_day"), F.weekday(day).cast("int").alias("weekday"))


@query(
    """SELECT o_orderkey, epoch(timezone('Europe/London', CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + to_seconds(43200 + (o_orderkey % 80000)))) AS at_s FROM orders"""
)
def clock_to_instant(spark, sf_dir):
    """So many seconds after midnight on the wall clock of a service day, hours past 24 included."""
    o = orders(spark, sf_dir)
    at = time.wall_clock(F.col("o_orderdate"), F.col("o_orderkey") % 80000 + 43200)
    return o.select("o_orderkey", F.unix_seconds(at).cast("double").alias("at_s"))


@query(
    """SELECT event_id, CASE WHEN s < 60 THEN CAST(s AS VARCHAR) || ' s' WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || ' min'
              ELSE CAST(s // 3600 AS VARCHAR) || ' h ' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ' min' END AS words
       FROM (SELECT event_id, CAST(floor(value * 40) AS BIGINT) AS s FROM events)"""
)
def duration_words(spark, sf_dir):
    """Durations in words."""
    s = F.floor(F.col("value") * 40)
    return events(spark, sf_dir).select("event_id", text.duration_words(s).alias("words"))


@query(
    """SELECT o_custkey, CAST(sum(CASE WHEN isodow(o_orderdate) >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS weekend, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders GROUP BY 1"""
)
def touched_days(spark, sf_dir):
    """Distinct days and weekend days by key."""
    o = orders(spark, sf_dir)
    return o.groupBy("o_custkey").agg(F.sum((F.weekday("o_orderdate") >= 5).cast("long")).alias("weekend"), F.countDistinct("o_orderdate").alias("days"))
