"""Journeys with one change: customers ask, suppliers in pairs of stops on a grid of places, orders of one month are the patterns that can be used."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.functions.rules import RULE
from headway.operators import connections as search
from headway.operators import planner
from headway.plans.base import orders, registering
from headway.plans.journeys import _calls
from headway.session import table

QUERIES, ORACLES, query = registering()


def _place(k, east=0.0, north=0.0):
    """Stops 2j and 2j + 1 stand 200 m apart, the next places 1,100 m away."""
    at = F.floor(k / 2)
    return (F.lit(53.0) + (F.floor(at / 40) * 1100 + north) / 111_194.9).alias("lat"), (F.lit(-2.0) + (at % 40 * 1100 + k % 2 * 200 + east) / 66_918.0).alias("lon")


def _world(spark, sf_dir):
    stop = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stop"))
    n = stop.agg(F.max("stop").alias("n"))  # one row
    key, empty = F.col("o_orderkey"), F.lit(None).cast(RULE)
    rules = F.array(F.struct(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: ((key + k) % 7).cast("int")).alias("days"), *[empty[c].alias(c) for c in ("holidaysOnly", "alsoOn", "notOn", "serviced", "bankHolidays")]))
    o = orders(spark, sf_dir).select(
        key.alias("pattern_id"), F.concat(F.lit("OP"), F.col("o_custkey") % 5).alias("operator"), F.concat(F.lit("L"), F.col("o_custkey") % 30).alias("line"), F.col("o_orderstatus").alias("direction"), F.col("o_orderpriority").alias("destination"),
        F.when(key % 9 == 0, False).when(key % 9 == 1, True).alias("public_use"), F.col("o_orderdate").alias("valid_from"), F.date_add("o_orderdate", 30).alias("valid_to"), rules.alias("rules"),
    )
    usable = planner.usable_patterns(o, F.array(F.lit("1997-03-05").cast("date")), [])
    c = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n))
    (from_lat, from_lon), (to_lat, to_lon) = _place(c * 7 % F.col("n") + 1, 150.0, 80.0), _place(c * 31 % F.col("n") + 1, -60.0, 250.0)
    requests = customers.select(c.alias("request"), from_lat.alias("from_lat"), from_lon.alias("from_lon"), to_lat.alias("to_lat"), to_lon.alias("to_lon"))
    calls = _calls(spark, sf_dir).select("pattern_id", "position", "stop", F.when(F.col("seconds").isNotNull(), F.col("position") * 900).alias("metres"))
    return requests, usable, calls, stop.select("stop", *_place(F.col("stop")))


@query()
def connection_options(spark, sf_dir):
    """Journeys with one change for every customer, each with the families of both legs; checked by brute force in the tests."""
    ids = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ",").alias(name)
    found = search.connections(*_world(spark, sf_dir))
    return found.select("request", "place", "first_id", "board", "leave", "second_id", "change", "alight", F.round("score", 6).alias("score"), "walk_1", "walk_2", "transfer_m", ids("first_family"), ids("second_family"))
