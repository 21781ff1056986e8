"""Observation history: identity, conflicts, incremental loads, upserts, freshness, reconciliation.

The identity of an event is (user, type, day) and its reading is its value, so identities repeat and conflict.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from headway.operators import identity, quality, sequences
from headway.plans.base import events, orders, registering

QUERIES, ORACLES, query = registering()

KEYS = ["user_id", "event_type", "day"]
SPLIT, NOW = "2024-01-16", "2024-01-31 00:00:00"

_BATCH = """
b AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(value) AS value, count(*) AS copies,
             count(DISTINCT value) > 1 AS differs FROM events WHERE {where} GROUP BY 1, 2, 3)"""


def _dated(spark, sf_dir):
    e = events(spark, sf_dir)
    return e.withColumn("day", F.to_date("ts")).select(*KEYS, "value", "event_id", "ts")


@query(
    """SELECT user_id, event_id, event_type, ts FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"""
)
def current_state(spark, sf_dir):
    """The newest report of each vehicle, ties by id."""
    return sequences.latest(events(spark, sf_dir).select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"])


@query(
    "WITH" + _BATCH.format(where="true") + """
SELECT user_id, event_type, day, value, copies, CASE WHEN differs THEN 'conflict_in_batch' ELSE 'new' END AS outcome FROM b"""
)
def identity_first_load(spark, sf_dir):
    """A batch against an empty store."""
    e = _dated(spark, sf_dir)
    return identity.classify(e, e.select(*KEYS, "value").limit(0), KEYS, ["value"])


@query(
    "WITH" + _BATCH.format(where="true") + """,
s AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(value) AS value FROM events GROUP BY 1, 2, 3 HAVING count(DISTINCT value) = 1)
SELECT user_id, event_type, day, b.value, copies,
       CASE WHEN differs THEN 'conflict_in_batch' WHEN s.value IS NULL THEN 'new' WHEN s.value = b.value THEN 'repeat' ELSE 'conflict_with_stored' END AS outcome
FROM b LEFT JOIN s USING (user_id, event_type, day)"""
)
def identity_repeat_load(spark, sf_dir):
    """The same batch again, against what the first load stored; nothing is new."""
    e = _dated(spark, sf_dir)
    first = identity.classify(e, e.select(*KEYS, "value").limit(0), KEYS, ["value"])
    stored = first.filter("outcome = 'new'").select(*KEYS, "value")
    return identity.classify(e, stored, KEYS, ["value"])


_MONTHLY = """
WITH n AS (SELECT user_id, event_type, dayofmonth(ts) % 5 AS slot, ts >= TIMESTAMP '{split}' AS late, value FROM events),
b AS (SELECT user_id, event_type, slot, min(value) AS value, count(*) AS copies, count(DISTINCT value) > 1 AS differs FROM n WHERE late GROUP BY 1, 2, 3),
s AS (SELECT user_id, event_type, slot, min(value) AS value FROM n WHERE NOT late GROUP BY 1, 2, 3 HAVING count(DISTINCT value) = 1),
c AS (SELECT b.*, CASE WHEN differs THEN 'conflict_in_batch' WHEN s.value IS NULL THEN 'new' WHEN s.value = b.value THEN 'repeat'
                       ELSE 'conflict_with_stored' END AS outcome FROM b LEFT JOIN s USING (user_id, event_type, slot))
""".format(split=SPLIT)


def _slots(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("slot", F.dayofmonth("ts") % 5).select("user_id", "event_type", "slot", "value", "ts")
    keys = ["user_id", "event_type", "slot"]
    old, new = e.filter(F.col("ts") < SPLIT), e.filter(F.col("ts") >= SPLIT)
    stored = identity.classify(old, old.select(*keys, "value").limit(0), keys, ["value"]).filter("outcome = 'new'").select(*keys, "value")
    return keys, stored, identity.classify(new, stored, keys, ["value"])


@query(_MONTHLY + "SELECT user_id, event_type, CAST(slot AS INTEGER) AS slot, value, copies, outcome FROM c")
def identity_later_batch(spark, sf_dir):
    """A later batch against the stored history, all four outcomes."""
    return _slots(spark, sf_dir)[2]


@query(
    _MONTHLY + """SELECT s.user_id, s.event_type, CAST(s.slot AS INTEGER) AS slot, s.value FROM s
ANTI JOIN (SELECT * FROM c WHERE outcome LIKE 'conflict%') x ON s.user_id = x.user_id AND s.event_type = x.event_type AND s.slot = x.slot"""
)
def publishable_history(spark, sf_dir):
    """Stored observations that no conflict names."""
    keys, stored, classified = _slots(spark, sf_dir)
    return identity.publishable(stored, classified.filter("outcome LIKE 'conflict%'"), keys)


@query(
    _MONTHLY + """SELECT s.user_id, s.event_type, CAST(s.slot AS INTEGER) AS slot, s.value FROM s
SEMI JOIN (SELECT * FROM c WHERE outcome LIKE 'conflict%') x ON s.user_id = x.user_id AND s.event_type = x.event_type AND s.slot = x.slot"""
)
def suppressed_history(spark, sf_dir):
    """Stored observations that a conflict suppresses."""
    keys, stored, classified = _slots(spark, sf_dir)
    return identity.suppressed(stored, classified.filter("outcome LIKE 'conflict%'"), keys)


@query(
    f"""WITH a AS (SELECT * FROM events WHERE ts < TIMESTAMP '{SPLIT}'), b AS (SELECT * FROM events WHERE ts >= TIMESTAMP '2024-01-10')
SELECT event_id, user_id, value FROM a UNION ALL SELECT event_id, user_id, value FROM b ANTI JOIN (SELECT event_id FROM a) k USING (event_id)"""
)
def incremental_load(spark, sf_dir):
    """An overlapping second batch adds only what is absent."""
    e = events(spark, sf_dir).select("event_id", "user_id", "value", "ts")
    stored, batch = (x.select("event_id", "user_id", "value") for x in (e.filter(F.col("ts") < SPLIT), e.filter(F.col("ts") >= "2024-01-10")))
    return stored.unionByName(identity.insert_absent(stored, batch, ["event_id"]))


@query(
    """WITH s AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey, upper(c_name) AS c_name, c_acctbal + 1 AS c_acctbal, 'NEW' AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0)
SELECT c_custkey, CASE WHEN n.c_custkey IS NULL THEN s.c_name ELSE n.c_name END AS c_name,
       CASE WHEN n.c_custkey IS NULL THEN s.c_acctbal ELSE n.c_acctbal END AS c_acctbal,
       CASE WHEN s.c_custkey IS NULL THEN n.c_mktsegment ELSE s.c_mktsegment END AS c_mktsegment
FROM s FULL JOIN n USING (c_custkey)"""
)
def partial_upsert(spark, sf_dir):
    """Known rows get new names and balances but keep their segment; new rows come whole."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    new = c.filter("c_custkey % 2 = 0").select("c_custkey", F.upper("c_name").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit("NEW").alias("c_mktsegment"))
    return identity.upsert(c.filter("c_custkey % 3 <> 0"), new, ["c_custkey"], ["c_name", "c_acctbal"])


@query(
    """WITH s AS (SELECT user_id, event_type, CASE WHEN user_id % 4 = 0 THEN NULL ELSE min(value) END AS value FROM events GROUP BY 1, 2),
r AS (SELECT user_id, event_type, min(value) AS given FROM events WHERE value > 10 GROUP BY 1, 2)
SELECT user_id, event_type, coalesce(value, given) AS value FROM s LEFT JOIN r USING (user_id, event_type)"""
)
def fill_once(spark, sf_dir):
    """D3: only what is unknown is filled."""
    e = events(spark, sf_dir)
    stored = e.groupBy("user_id", "event_type").agg(F.min("value").alias("value")).withColumn("value", F.when(F.col("user_id") % 4 != 0, F.col("value")))
    return identity.fill_once(stored, e.filter("value > 10").select("user_id", "event_type", "value"), ["user_id", "event_type"], "value")


@query(
    f"""SELECT label, count(*) AS n FROM (SELECT CASE WHEN age < 0 THEN 'ahead_of_clock' WHEN age <= 60 THEN 'fresh' WHEN age <= 150 THEN 'ageing'
            WHEN age <= 900 THEN 'stale' ELSE 'expired' END AS label
     FROM (SELECT (epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 1e6 / 60 AS age FROM events GROUP BY user_id)) GROUP BY 1"""
)
def freshness_bands(spark, sf_dir):
    """freshness of the newest report, with minutes standing for seconds."""
    newest = events(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("ts"))
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros("ts")) / 1e6 / 60
    return newest.groupBy(quality.freshness(age).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderpriority, count(*) AS n_orders, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_filled,
              count(*) FILTER (WHERE o_orderstatus = 'O') AS n_open, count(*) FILTER (WHERE o_orderstatus = 'P') AS n_partial,
              count(*) = count(*) FILTER (WHERE o_orderstatus IN ('F', 'O', 'P')) AS balances
       FROM orders GROUP BY 1"""
)
def reconciliation_ledger(spark, sf_dir):
    """Counts by outcome and the identity that must balance."""
    n = lambda s: F.sum((F.col("o_orderstatus") == s).cast("int"))
    known = F.sum(F.col("o_orderstatus").isin("F", "O", "P").cast("int"))
    return orders(spark, sf_dir).groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"), n("F").alias("n_filled"), n("O").alias("n_open"), n("P").alias("n_partial"), (F.count(F.lit(1)) == known).alias("balances")
    )


@query(
    """WITH f AS (SELECT count(*) AS n, count(DISTINCT event_id) AS ids, min(ts) AS a, max(ts) AS b, sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS neg FROM events)
SELECT 'ids_unique' AS check_name, n = ids AS passed FROM f UNION ALL SELECT 'window_ordered', a <= b FROM f
UNION ALL SELECT 'no_negative_value', neg = 0 FROM f UNION ALL SELECT 'has_rows', n > 0 FROM f"""
)
def publication_checks(spark, sf_dir):
    """Named checks stored with a publication."""
    facts = events(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"), F.min("ts").alias("a"), F.max("ts").alias("b"), F.sum((F.col("value") < 0).cast("int")).alias("neg")
    )
    c = F.col
    return quality.checks(facts, {"ids_unique": c("n") == c("ids"), "window_ordered": c("a") <= c("b"), "no_negative_value": c("neg") == 0, "has_rows": c("n") > 0})


@query(
    """SELECT event_id, substring(sha256(coalesce(event_type, '') || '|' || coalesce(CAST(user_id AS VARCHAR), '') || '|' || coalesce(props, '')), 1, 32) AS quarantine_id
       FROM events WHERE value > 100"""
)
def quarantine_rows(spark, sf_dir):
    """F8: stable ids of set-aside rows."""
    e = events(spark, sf_dir).filter("value > 100")
    return e.select("event_id", quality.quarantine_id(F.col("event_type"), F.col("user_id").cast("string"), F.col("props")).alias("quarantine_id"))
