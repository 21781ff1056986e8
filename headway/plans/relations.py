"""Stops, services, runs and feeds: suppliers and parts stand for stops and routes, orders for runs, line items for what they did."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.functions.rules import RULE
from headway.operators import ledger, stops
from headway.plans.base import events, lineitem, orders, registering
from headway.session import table

QUERIES, ORACLES, query = registering()


@query(
    """WITH n AS (SELECT *, lower(p_name) AS own, lower(p_name || ' ' || p_type || ' ' || p_brand) AS rest, abs(p_size - 25) * 100.0 AS near FROM part),
s AS (SELECT *, CASE WHEN starts_with(own, 're') THEN 6 WHEN contains(' ' || own, ' re') THEN 4 WHEN contains(' ' || rest, ' re') THEN 2 WHEN contains(rest, 're') THEN 1 END AS a,
  CASE WHEN starts_with(own, 'wi') THEN 6 WHEN contains(' ' || own, ' wi') THEN 4 WHEN contains(' ' || rest, ' wi') THEN 2 WHEN contains(rest, 'wi') THEN 1 END AS b FROM n)
SELECT p_partkey, p_name, round(score, 6) AS score FROM (SELECT p_partkey, p_name, a + b + greatest(0.0, 3 - near / 1000) AS score FROM s WHERE a IS NOT NULL AND b IS NOT NULL) ORDER BY score DESC, p_name, p_partkey LIMIT 20"""
)
def text_search(spark, sf_dir):
    """Every typed word has to hit; 6, 4, 2 or 1 points, and up to 3 for nearness. Names are letters and spaces, brands end in a digit."""
    p = table(spark, sf_dir, "part").withColumn("kind", F.concat_ws(" ", "p_type", "p_brand"))
    return stops.search(p, ["re", "wi"], "p_name", ["kind"], 20, F.abs(F.col("p_size") - 25) * 100.0).select("p_partkey", "p_name", F.round("score", 6).alias("score"))


@query(
    """SELECT line, line = '2' AS exact FROM (SELECT DISTINCT substring(p_brand, 7) AS line FROM part) WHERE starts_with(line, '2') ORDER BY exact DESC, length(line), line LIMIT 6"""
)
def route_search(spark, sf_dir):
    """The line that was typed, then lines that begin with it."""
    lines = table(spark, sf_dir, "part").select(F.substring("p_brand", 7, 9).alias("line")).distinct()
    return stops.search_routes(lines, " 2 ", "line").select("line", "exact")


_PATTERNS = "p AS (SELECT l_orderkey AS pattern_id, count(*) AS stop_count FROM lineitem GROUP BY 1)"


@query(f"WITH {_PATTERNS} SELECT o_custkey AS line, o_orderstatus AS direction, arg_max(pattern_id, (stop_count, -pattern_id)) AS pattern_id, max(stop_count) AS stop_count FROM p JOIN orders ON pattern_id = o_orderkey GROUP BY 1, 2")
def longest_patterns(spark, sf_dir):
    """The stop sequence that a direction is browsed by."""
    p = lineitem(spark, sf_dir).groupBy(F.col("l_orderkey").alias("pattern_id")).agg(F.count(F.lit(1)).alias("stop_count"))
    o = orders(spark, sf_dir).select(F.col("o_orderkey").alias("pattern_id"), F.col("o_custkey").alias("line"), F.col("o_orderstatus").alias("direction"))
    return stops.longest_pattern(p.join(o, "pattern_id"), ["line", "direction"])


_CANDIDATES = """c AS (SELECT o_custkey AS vehicle_id, l_orderkey, min(l_linenumber) FILTER (WHERE l_suppkey % 10 = 3) AS stop_at, o_custkey % 5 + 1 AS vehicle_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
b AS (SELECT vehicle_id, count(*) AS total, count(*) FILTER (WHERE stop_at >= vehicle_at) AS calling, min(stop_at - vehicle_at) FILTER (WHERE stop_at >= vehicle_at) AS least, max(stop_at - vehicle_at) FILTER (WHERE stop_at >= vehicle_at) AS most FROM c GROUP BY 1),
r AS (SELECT *, CASE WHEN total < 2 THEN 'unresolved' WHEN calling = total THEN 'branch_all_call' WHEN calling > 0 THEN 'branch_some_call' ELSE 'branch_none_call' END AS relation FROM b)"""


def _branches(spark, sf_dir):
    o = orders(spark, sf_dir).select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("vehicle_id"))
    at = F.min(F.when(F.col("l_suppkey") % 10 == 3, F.col("l_linenumber"))).alias("stop_at")
    c = lineitem(spark, sf_dir).join(o, "l_orderkey").groupBy("vehicle_id", "l_orderkey").agg(at).withColumn("vehicle_at", F.col("vehicle_id") % 5 + 1)
    return stops.branch_relation(c, ["vehicle_id"])


@query(f"WITH {_CANDIDATES} SELECT vehicle_id, total, calling, least, most, relation FROM r")
def branch_relations(spark, sf_dir):
    """Whether all, some or none of the branches a vehicle may be on bring it to a stop."""
    return _branches(spark, sf_dir).select("vehicle_id", "total", "calling", "least", "most", "relation")


@query(
    f"""WITH {_CANDIDATES}, v AS (SELECT r.*, c_nationkey AS stop, abs(c_acctbal) AS metres, vehicle_id % 400 AS age_s, vehicle_id % 400 > 350 AS old, vehicle_id % 3 > 0 AS chosen FROM r JOIN customer ON vehicle_id = c_custkey),
k AS (SELECT *, CASE WHEN relation = 'branch_all_call' THEN 'coming' WHEN relation = 'branch_some_call' THEN 'maybe' ELSE 'not_here' END AS stands FROM v),
u AS (SELECT *, CASE WHEN old THEN CASE WHEN metres <= 3000 THEN 'old' END WHEN stands IN ('coming', 'maybe') THEN CASE WHEN chosen THEN stands ELSE 'hidden' END WHEN metres <= 150 THEN 'nearby'
  WHEN metres <= 1500 THEN 'elsewhere' END AS bucket FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY stop, bucket ORDER BY CASE WHEN bucket = 'coming' THEN coalesce(least, 0) WHEN bucket = 'old' THEN age_s ELSE metres END, age_s, vehicle_id) AS place FROM u WHERE bucket IS NOT NULL)
SELECT stop, vehicle_id, bucket, CAST(place AS INTEGER) AS place FROM p WHERE bucket <> 'elsewhere' OR place <= 12"""
)
def stop_boards(spark, sf_dir):
    """Every vehicle near a stop in one of seven buckets, with its place in it."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vehicle_id"), F.col("c_nationkey").alias("stop"), F.abs("c_acctbal").alias("metres"))
    k = F.col("vehicle_id")
    v = _branches(spark, sf_dir).join(c, "vehicle_id").withColumns({"stops_away": F.col("least"), "age_s": k % 400, "old": k % 400 > 350, "chosen": k % 3 > 0})
    return stops.stop_board(v, ["stop"]).select("stop", "vehicle_id", "bucket", "place")


@query(
    """WITH n AS (SELECT l_orderkey, l_suppkey AS stop, l_linenumber AS index, max(l_linenumber) OVER (PARTITION BY l_orderkey) AS last_index FROM lineitem),
r AS (SELECT stop, o_orderpriority AS operator, 'L' || (o_custkey % 20) AS line, o_orderstatus AS direction, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (isodow(DATE '1997-03-05') - 1 - o_orderkey % 7 + 7) % 7 < 3 END AS runs
  FROM n JOIN orders ON l_orderkey = o_orderkey WHERE index < last_index AND CAST(o_orderdate AS DATE) <= DATE '1997-03-05' AND DATE '1997-03-05' <= CAST(o_orderdate AS DATE) + 365)
SELECT stop, operator, line, direction, count(*) AS patterns, CASE WHEN bool_or(runs) THEN true WHEN count(*) = count(*) FILTER (WHERE NOT runs) THEN false END AS runs_today FROM r GROUP BY 1, 2, 3, 4"""
)
def services_at_stops(spark, sf_dir):
    """The services that can be boarded at every stop, and whether they run on a day."""
    w = W.partitionBy("l_orderkey")
    calls = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("stop"), F.col("l_linenumber").alias("index"), F.max("l_linenumber").over(w).alias("last_index"))
    key, empty = F.col("o_orderkey"), F.lit(None).cast(RULE)
    days = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: ((key + k) % 7).cast("int"))
    rules = F.array(F.struct(days.alias("days"), *[empty[n].alias(n) for n in ("holidaysOnly", "alsoOn", "notOn", "serviced", "bankHolidays")]))
    o = orders(spark, sf_dir).select(
        key, F.col("o_orderpriority").alias("operator"), F.concat(F.lit("L"), F.col("o_custkey") % 20).alias("line"), F.col("o_orderstatus").alias("direction"), F.lit("").alias("destination"),
        F.col("o_orderdate").alias("valid_from"), F.date_add("o_orderdate", 365).alias("valid_to"), F.when(key % 5 != 0, rules).alias("rules"),
    )
    return stops.services(calls.join(o, "o_orderkey"), F.lit("1997-03-05").cast("date")).drop("destination")


@query(
    """WITH e AS (SELECT user_id, epoch_us(ts) / 1e6 AS at_s, 53.4 + value / 400000 AS lat, -2.2 AS lon, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS k FROM events),
l AS (SELECT user_id, max(lat) FILTER (WHERE k = 1) AS last_lat FROM e GROUP BY 1), d AS (SELECT e.*, radians(abs(lat - 53.4)) * 6371000.0 AS metres, radians(abs(lat - last_lat)) * 6371000.0 AS moved FROM e JOIN l USING (user_id)),
r AS (SELECT *, sum(CASE WHEN metres > 40 OR moved > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_s DESC ROWS UNBOUNDED PRECEDING) = 0 AS run FROM d),
p AS (SELECT user_id, count(*) FILTER (WHERE run) AS reports, max(at_s) - min(at_s) FILTER (WHERE run) AS span, max(metres) FILTER (WHERE k = 1) AS metres, user_id % 200 AS age, (user_id * 37) % 360 AS heading FROM r GROUP BY 1)
SELECT user_id, reports, CASE WHEN age > 150 OR metres > 60 OR least((heading - 90 + 360) % 360, 360 - (heading - 90 + 360) % 360) > 60 THEN 'none' WHEN reports >= 2 AND span >= 20 AND age <= 60 THEN 'stopped' ELSE 'near' END AS activity FROM p"""
)
def stop_activities(spark, sf_dir):
    """Vehicles standing at, or near, a stop by their newest reports."""
    k = F.col("user_id")
    e = events(spark, sf_dir).select("user_id", (F.unix_micros("ts") / 1e6).alias("at"), (F.lit(53.4) + F.col("value") / 400000).alias("lat"), F.lit(-2.2).alias("lon"))
    e = e.withColumns({"stop_lat": F.lit(53.4), "stop_lon": F.lit(-2.2), "heading": ((k * 37) % 360).cast("double"), "stop_heading": F.lit(90.0), "age_s": k % 200})
    return stops.stop_activity(e, ["user_id"]).select("user_id", "reports", "activity")


@query(
    """SELECT o_orderkey AS run_id, count(l_orderkey) AS sources, count(*) FILTER (WHERE l_returnflag = 'A') AS succeeded, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS activities
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""
)
def runs_with_processing(spark, sf_dir):
    """Every run with what it processed, also runs that processed nothing."""
    x = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") == "A", "succeeded").otherwise("failed").alias("outcome"), F.col("l_quantity").cast("long").alias("activities"))
    return ledger.with_processing(orders(spark, sf_dir).select(F.col("o_orderkey").alias("run_id")), x, "run_id", "outcome", ["activities"])


@query("SELECT o_orderkey AS run_id, l_linenumber AS publication, l_suppkey AS publisher FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey ORDER BY o_orderdate DESC, o_orderkey, l_linenumber DESC NULLS LAST, l_suppkey LIMIT 25")
def runs_with_publications(spark, sf_dir):
    """The newest runs, once for each of their publications."""
    x = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("publication"), F.col("l_suppkey").alias("publisher"))
    o = orders(spark, sf_dir).select(F.col("o_orderkey").alias("run_id"), "o_orderdate")
    return ledger.with_publications(o, x, "run_id", [F.desc("o_orderdate"), F.col("run_id"), F.desc_nulls_last("publication"), F.col("publisher")], 25).drop("o_orderdate")


_PASSES = """f AS (SELECT * FROM (SELECT l_partkey AS source, l_shipdate, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS inputs, CAST(l_discount * 100 AS BIGINT) AS conflicting, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_quantity, l_discount) AS k
  FROM lineitem WHERE l_returnflag <> 'R') WHERE k = 1)"""


def _passes(spark, sf_dir):
    x = lineitem(spark, sf_dir)
    p = x.select(
        F.col("l_partkey").alias("source"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("inputs"), F.round(F.col("l_discount") * 100).cast("long").alias("conflicting"),
        F.when(F.col("l_returnflag") != "R", "succeeded").otherwise("failed").alias("outcome"),
    )
    return ledger.first_passes(p, "source", "outcome", ["l_shipdate", "l_orderkey", "l_linenumber"])


@query(f"WITH {_PASSES} SELECT source, l_orderkey, l_linenumber, inputs FROM f")
def first_passes(spark, sf_dir):
    """The first successful pass over each source."""
    return _passes(spark, sf_dir).select("source", "l_orderkey", "l_linenumber", "inputs")


@query(
    f"""WITH {_PASSES} SELECT count(*) AS sources, CAST(sum(inputs) AS BIGINT) AS inputs, CAST(sum(conflicting) AS BIGINT) AS conflicting, (SELECT count(*) FROM orders) AS stored, (SELECT count(DISTINCT o_custkey) FROM orders) AS identities,
  CAST(sum(inputs) - (SELECT count(*) FROM orders) - sum(conflicting) AS BIGINT) AS repeats FROM f"""
)
def warehouse_totals(spark, sf_dir):
    """Totals from first passes; repeats are what is left of the inputs."""
    o = orders(spark, sf_dir)
    return ledger.totals(_passes(spark, sf_dir), o, o.select("o_custkey").distinct(), "inputs", "conflicting")


@query(
    """WITH c AS (SELECT l_orderkey, max(CAST(l_shipdate AS DATE)) AS last, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT o_orderkey AS run_id, coalesce(n, 0) AS cycles, CASE WHEN o_orderstatus = 'O' THEN coalesce(last, CAST(o_orderdate AS DATE)) END AS finished_at, CASE WHEN o_orderstatus = 'O' THEN 'interrupted' ELSE o_orderstatus END AS status_now
FROM orders LEFT JOIN c ON o_orderkey = l_orderkey"""
)
def abandoned_runs(spark, sf_dir):
    """Runs still marked running are closed at their last recorded cycle."""
    r = orders(spark, sf_dir).select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").alias("started_at"))
    c = lineitem(spark, sf_dir).filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("run_id"), F.col("l_shipdate").alias("completed_at"))
    return ledger.closed_runs(r, c, "run_id", "status", "started_at", "completed_at").select("run_id", "cycles", "finished_at", "status_now")


@query(
    """WITH r AS (SELECT user_id AS publication, min(epoch_ms(ts)) AS first_at FROM events WHERE event_type <> 'error' AND user_id % 4 <> 0 GROUP BY 1),
w AS (SELECT min(epoch_ms(ts)) AS since, max(epoch_ms(ts)) AS until FROM events WHERE event_type <> 'error' AND user_id % 4 <> 0), p AS (SELECT user_id AS publication, min(epoch_ms(ts)) AS written FROM events GROUP BY 1)
SELECT publication, first_at - written AS delay, first_at IS NULL AND written BETWEEN since AND until AS never_received FROM p LEFT JOIN r USING (publication), w"""
)
def publication_receipts(spark, sf_dir):
    """How long after it was written each publication was first received, and which never were."""
    at = F.floor(F.unix_micros("ts") / 1000 + 0.5).alias("at")
    e = events(spark, sf_dir).select(F.col("user_id").alias("publication"), "event_type", at)
    got = e.filter((F.col("event_type") != "error") & (F.col("publication") % 4 != 0))
    written = e.groupBy("publication").agg(F.min("at").alias("written"))
    return ledger.receipts(got, written, "publication", "at", "written").select("publication", "delay", "never_received")


@query(
    """SELECT c_custkey AS job_id, CASE WHEN c_custkey % 5 = 0 THEN 'never' WHEN c_custkey % 5 = 1 THEN CASE WHEN c_acctbal >= 4800 THEN 'running' ELSE 'unrecorded' END WHEN c_custkey % 5 = 2 THEN 'failed' ELSE 'succeeded' END AS state,
  CASE WHEN c_custkey % 7 = 0 THEN true ELSE 10000 - abs(c_acctbal) > 6000 END AS overdue FROM customer"""
)
def job_states(spark, sf_dir):
    """What the last attempt of a nightly job says, and whether the next is overdue. Now is second 10,000."""
    k = F.col("c_custkey")
    result = F.when(k % 5 == 1, "running").when(k % 5 == 2, "failed").when(k % 5 > 2, "succeeded")
    jobs = table(spark, sf_dir, "customer").select(
        k.alias("job_id"), result.alias("result"), F.col("c_acctbal").alias("started_at"), F.when(k % 7 != 0, F.abs("c_acctbal")).alias("last_scheduled_at"),
        F.lit(5000).alias("every_s"), F.lit(1000).alias("grace_s"), F.lit(4600).alias("timeout_s"),
    )
    return ledger.job_state(jobs, F.lit(10000)).select("job_id", "state", "overdue")


@query(
    """WITH x AS (SELECT o_orderkey AS id, o_orderkey % 500 + 1000 AS published, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 450 + 1020 END AS header, o_orderkey % 40 - 10 AS held, 1300 AS device, CASE o_orderstatus WHEN 'O' THEN 'ok' WHEN 'F' THEN 'stale' ELSE 'ok' END AS state FROM orders),
r AS (SELECT *, CASE WHEN header + greatest(held, 0) >= published THEN header + greatest(held, 0) ELSE greatest(published, device) END AS reference FROM x), a AS (SELECT *, greatest(reference - published, 0) + 7 AS age FROM r)
SELECT id, reference, age, CASE WHEN id % 11 = 0 OR id % 13 = 0 THEN 'offline' WHEN id % 17 = 0 THEN 'unavailable' WHEN state = 'stale' OR age > 120 THEN 'stale' ELSE 'live' END AS mode, CASE WHEN age > 60 THEN age END AS quiet FROM a"""
)
def feed_modes(spark, sf_dir):
    """The reference clock, a publication's age, what a reader may call the feed, and what has gone quiet."""
    k = F.col("o_orderkey")
    x = orders(spark, sf_dir).select(k.alias("id"), (k % 500 + 1000).alias("published"), F.when(k % 3 > 0, k % 450 + 1020).alias("header"), (k % 40 - 10).alias("held"), F.when(k % 17 != 0, F.when(F.col("o_orderstatus") == "F", "stale").otherwise("ok")).alias("state"))
    x = x.withColumn("reference", ledger.reference_clock(F.col("header"), F.col("held"), F.col("published"), F.lit(1300)))
    x = x.withColumn("age", ledger.age(F.col("reference"), F.col("published"), F.lit(1300), F.lit(1307), floor=True))
    mode = ledger.feed_mode(F.col("id") % 11 != 0, F.col("id") % 13 == 0, F.col("state"), F.col("age"))
    return x.select("id", "reference", "age", mode.alias("mode"), ledger.gone_quiet(F.col("age"), F.col("age"), 60).alias("quiet"))


@query(
    """WITH e AS (SELECT user_id % 40 AS vehicle, user_id AS journey, epoch_us(ts) / 1e6 AS at_s FROM events), n AS (SELECT vehicle, journey, max(at_s) AS at_s FROM e WHERE at_s <= 1704500000 AND at_s >= 1704500000 - 20000 GROUP BY 1, 2)
SELECT vehicle, arg_max(journey, (at_s, journey)) AS journey, max(at_s) AS at_s FROM n GROUP BY 1"""
)
def tracks_visible_at(spark, sf_dir):
    """Each vehicle's last reported journey at a replay's time."""
    e = events(spark, sf_dir).select((F.col("user_id") % 40).alias("vehicle"), F.col("user_id").alias("journey"), (F.unix_micros("ts") / 1e6).alias("at"))
    return ledger.visible_tracks(e, ["journey"], ["vehicle"], "at", F.lit(1704500000.0), 20000).withColumnRenamed("at", "at_s")


@query(
    """WITH e AS (SELECT event_id, value, CASE WHEN value <= 10 THEN 10 WHEN value <= 30 THEN 30 WHEN value <= 60 THEN 60 WHEN value <= 400 THEN 400 END AS up_to FROM events),
b AS (SELECT CASE WHEN c_nationkey < 10 THEN 10 WHEN c_nationkey < 14 THEN 30 WHEN c_nationkey < 15 THEN 60 ELSE 400 END AS up_to, count(*) AS n, max(c_acctbal) AS p80 FROM customer GROUP BY 1)
SELECT event_id, CASE WHEN n >= 80 THEN p80 END AS p80 FROM e LEFT JOIN b USING (up_to)"""
)
def errors_by_age(spark, sf_dir):
    """How far a report of some age may be off, where enough cases say so."""
    nation = F.col("c_nationkey")
    up_to = F.when(nation < 10, 10).when(nation < 14, 30).when(nation < 15, 60).otherwise(400)
    bins = table(spark, sf_dir, "customer").groupBy(up_to.alias("up_to")).agg(F.count(F.lit(1)).alias("n"), F.max("c_acctbal").alias("p80"))
    return ledger.uncertainty(events(spark, sf_dir).select("event_id", "value"), bins, "value", 80).select("event_id", "p80")


@query(
    """WITH w AS (SELECT event_id, user_id, value, epoch_us(ts) / 1e6 AS at_s FROM events), n AS (SELECT *, lag(value) OVER o AS b, lead(value) OVER o AS a, lead(at_s) OVER o - lag(at_s) OVER o AS dt FROM w WINDOW o AS (PARTITION BY user_id ORDER BY at_s))
SELECT event_id, b IS NOT NULL AND b - value > 50 AND (a IS NULL OR coalesce(a - b >= -10 AND dt > 0 AND (a - b) / dt <= 20, false)) AS held FROM n"""
)
def reports_held_back(spark, sf_dir):
    """Reports that lie back and that the reports beside them contradict."""
    e = events(spark, sf_dir).select("event_id", "user_id", "value", (F.unix_micros("ts") / 1e6).alias("at"))
    return ledger.supported(e, ["user_id"], "at", "value", 50.0, 10.0, 20.0).select("event_id", "held")


@query(
    """WITH f AS (SELECT c_custkey AS id, c_nationkey AS scope, 'fresh' AS said FROM customer WHERE c_nationkey IN (3, 4) AND c_custkey % 2 = 0)
SELECT c_custkey AS id, c_nationkey AS scope, c_mktsegment AS said FROM customer WHERE c_nationkey NOT IN (SELECT scope FROM f) UNION ALL SELECT * FROM f"""
)
def merged_verdicts(spark, sf_dir):
    """What was read again replaces all of its scope; other scopes keep what they had."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("scope"), F.col("c_mktsegment").alias("said"))
    fresh = c.filter("scope IN (3, 4) AND id % 2 = 0").withColumn("said", F.lit("fresh"))
    return ledger.replaced(c, fresh, ["scope"])


@query("SELECT event_type AS route, count(*) AS n, epoch_us(max(ts)) AS newest FROM events GROUP BY 1")
def routes_by_recency(spark, sf_dir):
    """Routes with how many reports they have and their newest."""
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("route")).agg(F.count(F.lit(1)).alias("n"), F.unix_micros(F.max("ts")).alias("newest")).orderBy(F.desc("newest"))


@query(
    """WITH s AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS move FROM events)
SELECT user_id, count(move) AS n, round(avg(CASE WHEN abs(move) > 60 THEN 1.0 ELSE 0.0 END), 6) AS snapped, round(avg(CASE WHEN move < -12 THEN 1.0 ELSE 0.0 END), 6) AS back, round(avg(CASE WHEN move > 12 THEN 1.0 ELSE 0.0 END), 6) AS forward
FROM s WHERE move IS NOT NULL GROUP BY 1"""
)
def visible_corrections(spark, sf_dir):
    """How often a new report moves what is shown far, back, or forward."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    s = events(spark, sf_dir).withColumn("move", F.col("value") - F.lag("value").over(w)).filter("move IS NOT NULL")
    share = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    m = F.col("move")
    return s.groupBy("user_id").agg(F.count("move").alias("n"), share(F.abs(m) > 60).alias("snapped"), share(m < -12).alias("back"), share(m > 12).alias("forward"))


@query(
    """WITH n AS (SELECT l_orderkey AS pattern_id, l_suppkey AS stop, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) - 1 AS index FROM lineitem)
SELECT pattern_id, CAST(index AS INTEGER) AS index, stop FROM n JOIN supplier ON stop = s_suppkey WHERE s_nationkey <> 7"""
)
def placed_stops(spark, sf_dir):
    """Placed stops keep the index they have among all stops of their pattern."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey")
    n = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("pattern_id"), F.col("l_suppkey").alias("stop"), (F.row_number().over(w) - 1).alias("index"))
    s = table(spark, sf_dir, "supplier").filter("s_nationkey <> 7").select(F.col("s_suppkey").alias("stop"), "s_nationkey")
    return n.join(s, "stop", "left").filter("s_nationkey IS NOT NULL").select("pattern_id", "index", "stop")


@query(
    """SELECT l_orderkey AS pattern_id, l_linenumber AS position, l_suppkey AS stop, min(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity DESC ROWS UNBOUNDED PRECEDING) AS nearest FROM lineitem"""
)
def nearest_so_far(spark, sf_dir):
    """How near a pattern has come to a place up to each of its stops."""
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", F.desc("l_quantity")).rowsBetween(W.unboundedPreceding, 0)
    x = lineitem(spark, sf_dir)
    return x.select(F.col("l_orderkey").alias("pattern_id"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("stop"), F.min(F.col("l_quantity").cast("long")).over(w).alias("nearest"))
