"""Registering queries, and the driver's tables with instants as timestamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.session import table


def registering():
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))


def lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("l_shipdate", F.to_date("l_shipdate"))
