"""Release records and checks, tracked vehicles on legs, keys of journeys, gaps and windows over time, shared roads."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.operators import planner, release, sequences, shapes
from headway.plans.base import events, lineitem, orders, registering
from headway.session import table

QUERIES, ORACLES, query = registering()


@query(
    """WITH r AS (SELECT s_suppkey AS id, 'OP' || s_nationkey % 3 AS operator, 'L' || s_suppkey % 10 AS line, 'in' AS direction, 'm' || s_suppkey % 2 AS model, 'd1' AS protocol, CAST(s_suppkey AS VARCHAR) AS digest, s_suppkey % 7 > 0 AS complete, abs(s_acctbal) / 4000 AS med, abs(s_acctbal) / 2500 AS p80,
  CASE WHEN s_suppkey % 11 > 0 THEN abs(s_acctbal) / 4000 + s_suppkey % 5 / 4.0 END AS tt, s_suppkey % 13 / 10.0 AS cov, s_suppkey % 50 AS journeys, s_suppkey % 400 * 3 AS passages, s_suppkey % 3 AS weekdays, 0.7 + s_suppkey % 4 / 10.0 AS ic FROM supplier),
k AS (SELECT *, list_filter([CASE WHEN NOT coalesce(med <= 1.5, false) THEN 'median_abs' END, CASE WHEN NOT coalesce(p80 <= 3.0, false) THEN 'p80_abs' END, CASE WHEN NOT coalesce(tt - med >= 0.5, false) THEN 'better_than_timetable' END, CASE WHEN cov < 0.5 THEN 'coverage' END, CASE WHEN journeys < 20 THEN 'journeys' END, CASE WHEN passages < 150 THEN 'passages' END, CASE WHEN weekdays < 1 THEN 'weekdays' END, CASE WHEN NOT ic >= 0.8 THEN 'interval_coverage' END], lambda x: x IS NOT NULL) AS failed,
  list_filter([CASE WHEN med - 0.2 <= 1.5 AND 1.5 < med + 0.2 THEN 'median_abs' END, CASE WHEN p80 - 0.3 <= 3 AND 3 < p80 + 0.3 THEN 'p80_abs' END, CASE WHEN ic - 0.05 < 0.8 AND 0.8 <= ic + 0.05 THEN 'interval_coverage' END], lambda x: x IS NOT NULL) AS fragile FROM r)
SELECT id, array_to_string(failed, ',') AS failed, array_to_string(fragile, ',') AS fragile, CASE WHEN NOT complete THEN 'collecting' WHEN len(failed) > 0 THEN 'not_met' WHEN id % 4 < 2 THEN 'released' ELSE 'awaiting_approval' END AS status, CASE WHEN complete AND len(failed) = 0 AND id % 4 < 2 THEN 'p' || id END AS patterns FROM k"""
)
def release_checks(spark, sf_dir):
    """Thresholds, fragile results, and what an approval releases; each supplier is a scope."""
    k, bal = F.col("s_suppkey"), F.abs("s_acctbal")
    s = table(spark, sf_dir, "supplier")
    scope = [F.concat(F.lit("OP"), F.col("s_nationkey") % 3).alias("operator"), F.concat(F.lit("L"), k % 10).alias("line"), F.lit("in").alias("direction"), F.concat(F.lit("m"), k % 2).alias("model"), F.lit("d1").alias("protocol"), k.cast("string").alias("digest")]
    med, p80, ic = bal / 4000, bal / 2500, F.lit(0.7) + k % 4 / 10.0
    r = s.select(
        k.alias("id"), *scope, F.array(F.concat(F.lit("p"), k), F.concat(F.lit("q"), k)).alias("pattern_ids"), (k % 7 > 0).alias("complete"), med.alias("median_abs"), p80.alias("p80_abs"), med.alias("median_abs_where_paired"), F.when(k % 11 > 0, med + k % 5 / 4.0).alias("timetable_median_abs"),
        (k % 13 / 10.0).alias("coverage"), (k % 50).alias("journeys"), (k % 400 * 3).alias("passages"), (k % 3).alias("weekdays"), ic.alias("interval_coverage"), (med - 0.2).alias("median_low"), (med + 0.2).alias("median_high"), (p80 - 0.3).alias("p80_low"), (p80 + 0.3).alias("p80_high"), (ic - 0.05).alias("coverage_low"), (ic + 0.05).alias("coverage_high"),
    )
    approvals = s.withColumn("digest_", F.when(k % 4 < 2, k).otherwise(-k)).select(*scope[:-1], F.col("digest_").cast("string").alias("digest"), F.array(F.concat(F.lit("p"), k), F.lit("other")).alias("pattern_ids"))
    found = release.verdicts(r, approvals)
    return found.select("id", F.array_join("failed", ",").alias("failed"), F.array_join("fragile", ",").alias("fragile"), "status", F.array_join("released_patterns", ",").alias("patterns"))


@query(
    """WITH r AS (SELECT CAST(o_orderdate AS DATE) AS day, 'd' || o_orderkey % 2 AS protocol, o_orderkey % 3 AS mapping, o_custkey % 4 AS digest FROM orders), s AS (SELECT DISTINCT * FROM r WHERE digest = 0)
SELECT DISTINCT CAST(day AS VARCHAR) AS day, protocol, mapping, digest FROM r WHERE digest > 0"""
)
def day_records(spark, sf_dir):
    """The day records that a rerun adds to those of the first digest: none of what is stored, one for each other digest."""
    r = orders(spark, sf_dir).select(F.col("o_orderdate").alias("day"), F.concat(F.lit("d"), F.col("o_orderkey") % 2).alias("protocol"), F.lit("m").alias("model"), (F.col("o_orderkey") % 3).alias("mapping"), (F.col("o_custkey") % 4).alias("digest"))
    return release.new_versions(r.filter("digest = 0"), r).select(F.col("day").cast("string").alias("day"), "protocol", "mapping", "digest")


_LEGS = "m AS (SELECT l_orderkey AS leg, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_quantity, l_discount, l_tax) - 1 AS member, l_suppkey AS pattern_id, l_partkey % 6 AS board_at, l_partkey % 6 + 1 + CAST(l_quantity AS BIGINT) % 5 AS alight_at FROM lineitem)"


@query(
    f"""WITH {_LEGS}, f AS (SELECT *, row_number() OVER (PARTITION BY leg, pattern_id ORDER BY member) AS k FROM m), v AS (SELECT c_custkey AS vehicle, c_custkey % (SELECT max(s_suppkey) FROM supplier) + 1 AS pattern_id, c_custkey * 7 % 13 AS at_index FROM customer),
j AS (SELECT leg, vehicle, CASE WHEN at_index < board_at THEN 'before' ELSE 'between' END AS standing, CASE WHEN at_index < board_at THEN board_at - at_index ELSE alight_at - at_index END AS stops, CASE WHEN at_index < board_at THEN board_at - at_index ELSE -1 END AS r FROM f JOIN v ON f.pattern_id = v.pattern_id WHERE k = 1 AND at_index < alight_at)
SELECT leg, vehicle, standing, stops, CAST(row_number() OVER (PARTITION BY leg ORDER BY r, vehicle) AS INTEGER) AS place FROM j"""
)
def buses_on_legs(spark, sf_dir):
    """Tracked vehicles that someone waiting for a leg can see coming."""
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount", "l_tax")
    at = F.col("l_partkey") % 6
    m = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("leg"), (F.row_number().over(order) - 1).alias("member"), F.col("l_suppkey").alias("pattern_id"), at.alias("board_at"), (at + 1 + F.col("l_quantity").cast("long") % 5).alias("alight_at"))
    n = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey").alias("n"))  # one row
    c = F.col("c_custkey")
    v = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n)).select(c.alias("vehicle"), (c % F.col("n") + 1).alias("pattern_id"), (c * 7 % 13).alias("pattern_index"))
    return planner.buses_on_legs(m, v)


_CALLS = "c AS (SELECT l_orderkey AS pattern_id, CAST(l_suppkey AS VARCHAR) AS stop, min(l_linenumber) AS at_index FROM lineitem GROUP BY 1, 2)"


@query(
    f"""WITH {_CALLS}, o AS (SELECT l_orderkey AS id, CAST(arg_min(l_suppkey, (l_linenumber, l_suppkey)) AS VARCHAR) AS a, CAST(arg_max(l_suppkey, (l_linenumber, l_suppkey)) AS VARCHAR) AS z FROM lineitem GROUP BY 1), n AS (SELECT *, lead(id) OVER (ORDER BY id) AS next FROM o),
k AS (SELECT n.id, n.a, n.z, m.id AS id2, m.a AS a2, m.z AS z2 FROM n LEFT JOIN o m ON n.next = m.id),
v AS (SELECT k.*, coalesce(p.at_index < q.at_index, false) AS one, coalesce(r.at_index < s.at_index, false) AS two FROM k LEFT JOIN c p ON p.pattern_id = id AND p.stop = a LEFT JOIN c q ON q.pattern_id = id AND q.stop = z LEFT JOIN c r ON r.pattern_id = id2 AND r.stop = a2 LEFT JOIN c s ON s.pattern_id = id2 AND s.stop = z2)
SELECT CASE WHEN id % 3 = 0 THEN 'd:' || id || '|' || a || '|' || z WHEN id % 3 = 1 OR id2 IS NULL THEN 'x:' || id ELSE 'c:' || id || '|' || a || '|' || z || '|' || id2 || '|' || a2 || '|' || z2 END AS key, CASE WHEN id % 3 = 0 THEN one WHEN id % 3 = 1 OR id2 IS NULL THEN false ELSE one AND two END AS valid FROM v"""
)
def restored_keys(spark, sf_dir):
    """Journeys from their keys, let go where the timetable no longer has them so."""
    place = F.struct("l_linenumber", "l_suppkey")
    x = lineitem(spark, sf_dir)
    o = x.groupBy(F.col("l_orderkey").alias("id")).agg(F.min_by("l_suppkey", place).cast("string").alias("a"), F.max_by("l_suppkey", place).cast("string").alias("z"))
    ids = orders(spark, sf_dir).select(F.col("o_orderkey").alias("id")).join(o, "id", "left_semi")
    following = ids.select("id", F.lead("id").over(W.orderBy("id")).alias("id2"))
    k = o.join(following, "id").join(o.select(F.col("id").alias("id2"), F.col("a").alias("a2"), F.col("z").alias("z2")), "id2", "left")
    text = lambda c: F.col(c).cast("string")
    key = F.when(F.col("id") % 3 == 0, planner.direct_key(text("id"), F.col("a"), F.col("z"))).when((F.col("id") % 3 == 1) | F.col("id2").isNull(), F.concat(F.lit("x:"), text("id")))
    keys = k.select(key.otherwise(planner.connection_key(text("id"), F.col("a"), F.col("z"), text("id2"), F.col("a2"), F.col("z2"))).alias("key"))
    calls = x.select(F.col("l_orderkey").alias("pattern_id"), F.col("l_linenumber").alias("position"), text("l_suppkey").alias("stop"))
    return planner.restored(keys, calls).select("key", "valid")


@query("SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) / 1e6 AS gap_s FROM events QUALIFY row_number() OVER (PARTITION BY ts ORDER BY event_id) = 1")
def capture_gaps(spark, sf_dir):
    """Seconds since the capture before, over the whole table; of events of one instant the first."""
    e = events(spark, sf_dir).groupBy("ts").agg(F.min("event_id").alias("event_id"))
    return sequences.global_gaps(e, "ts").select("event_id", "gap_s")


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS stamp, r_name AS source FROM events JOIN region ON user_id % 5 = r_regionkey WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:00:00' AND TIMESTAMP '2024-01-11 06:00:00'")
def observations_with_source(spark, sf_dir):
    """A day's observations with what their source is called, instants as text with the UTC offset."""
    start, end = (F.lit(t).cast("timestamp") for t in ("2024-01-10 06:00:00", "2024-01-11 06:00:00"))
    e = sequences.in_window(events(spark, sf_dir), "ts", start, end).withColumn("r_regionkey", (F.col("user_id") % 5).cast("int"))
    sources = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("int").alias("r_regionkey"), F.col("r_name").alias("source"))
    return e.join(sources, "r_regionkey").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("stamp"), "source")


@query("SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) ORDER BY n DESC, event_type, user_id")
def journeys_in_order(spark, sf_dir):
    """O1: journeys by their number of points, then route, then vehicle."""
    e = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return e.orderBy(F.desc("n"), "event_type", "user_id")


@query(
    """WITH v AS (SELECT l_suppkey AS pattern_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax) - 1 AS vertex, 53.4 + CASE WHEN (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax) - 1) // (20 + l_suppkey % 7) % 3 = l_suppkey % 3 THEN 60 ELSE 0 END / 111195.0 AS lat,
  -2.3 + (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_discount, l_tax) - 1) * 30 / 66000.0 AS lon FROM lineitem),
st AS (SELECT a.*, coalesce(sqrt(power(radians(a.lon - b.lon) * cos(radians((a.lat + b.lat) / 2)), 2) + power(radians(a.lat - b.lat), 2)) * 6371008.8, 0) AS step, b.lat AS p_lat, b.lon AS p_lon FROM v a LEFT JOIN v b ON a.pattern_id = b.pattern_id AND a.vertex = b.vertex + 1),
l AS (SELECT *, sum(step) OVER (PARTITION BY pattern_id ORDER BY vertex) AS along FROM st), o AS (SELECT a.s_suppkey AS set_id, b.s_suppkey AS other FROM supplier a JOIN supplier b ON b.s_suppkey IN (a.s_suppkey + 1, a.s_suppkey + 2)),
d AS (SELECT set_id, other, l.vertex, (s.lon - s.p_lon) * cos(radians(l.lat)) * 111195.0 AS dx, (s.lat - s.p_lat) * 111195.0 AS dy, (l.lon - s.p_lon) * cos(radians(l.lat)) * 111195.0 AS px, (l.lat - s.p_lat) * 111195.0 AS py FROM o JOIN l ON l.pattern_id = set_id JOIN st s ON s.pattern_id = other WHERE s.p_lat IS NOT NULL),
t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE greatest(0, least(1, (px * dx + py * dy) / (dx * dx + dy * dy))) END AS u FROM d), n AS (SELECT set_id, other, vertex, min(sqrt(power(px - u * dx, 2) + power(py - u * dy, 2))) AS off FROM t GROUP BY 1, 2, 3),
h AS (SELECT l.pattern_id AS set_id, l.vertex, along, coalesce(ok, true) AS shared FROM l LEFT JOIN (SELECT set_id, vertex, bool_and(off <= 10) AS ok FROM n GROUP BY 1, 2) x ON x.set_id = l.pattern_id AND x.vertex = l.vertex),
i AS (SELECT *, vertex - row_number() OVER (PARTITION BY set_id, shared ORDER BY vertex) AS run FROM h), r AS (SELECT set_id, min(along) AS a, max(along) AS z FROM i WHERE shared GROUP BY set_id, run HAVING max(along) > min(along))
SELECT set_id, CAST(row_number() OVER (PARTITION BY set_id ORDER BY a) AS INTEGER) AS piece, round(a, 3) AS from_m, round(z, 3) AS to_m FROM r"""
)
def shared_roads(spark, sf_dir):
    """Where a supplier's road runs together with those of the next two."""
    at = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax")) - 1
    x = lineitem(spark, sf_dir).withColumn("vertex", at)
    k = F.col("l_suppkey")
    away = F.when(F.floor(F.col("vertex") / (k % 7 + 20)) % 3 == k % 3, 60).otherwise(0)
    v = x.select(k.alias("pattern_id"), "vertex", (F.lit(53.4) + away / 111195.0).alias("lat"), (F.lit(-2.3) + F.col("vertex") * 30 / 66000.0).alias("lon"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("set_id"))
    ids = s.select(F.col("set_id").alias("pattern_id"))
    near = s.select("set_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.col("set_id") + i)).alias("i", "pattern_id")).join(ids, "pattern_id", "left_semi")
    return shapes.shared_roads(near.select("set_id", "pattern_id", (F.col("i") == 0).alias("checked")), v).select("set_id", "piece", F.round("from_m", 3).alias("from_m"), F.round("to_m", 3).alias("to_m"))
