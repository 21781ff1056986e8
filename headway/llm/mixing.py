"""Mixing sources to target weights by entropy balancing.

Each document d of source s gets a rate r_d, its expected number of copies. Among all rates at most ``MOST`` that give the
source its target of words, the ones nearest to one copy each in relative entropy are r_d = min(MOST, exp(lambda_s * x_d)),
x_d being its words over the source's mean. lambda_s solves the convex dual, one constraint per source, by Newton steps
kept inside a bracket. Rates depend on (source, words) alone, so every step aggregates the counts of documents by
(source, words), which is an exact summary of the corpus.

Rates become copies by floor(r_d + u_d + shift_s) with u_d in [0, 1) from a hash of doc_id. shift_s is found by dividing its
range again and again, each time with one aggregation for all the trial values, until the words taken meet the target as
nearly as one document allows; then single documents whose size is nearest to what is left gain or lose one copy, and at
last one gains and another loses a copy, their sizes differing by what is left.

All sums that decide anything are of integers or decimals, so the order of tasks cannot change a result.

Defined results: a null text has size 0 and is never copied more than its rate says; null is a source of its own and the
last; rows that repeat a doc_id are mixed alike; sources whose target is 3 times their size take every document 3 times;
an empty table, or one without words, gives targets of 0; columns besides doc_id, text and source are only passed on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.llm.common import WORD, removed, written

#: Weights of the sources in code-point order, repeating; the most copies of a document and of a source's words.
WEIGHTS = (5, 2, 1)
MOST = 3
NEWTON_STEPS = 40
TOLERANCE = 1e-9
TRIALS = 15
DIVISIONS = 5
CORRECTIONS = 2
#: How far from what is left the difference of two swapped sizes may be.
SWAP = 8


def with_size(docs: DataFrame, name: str = "size") -> DataFrame:
    return docs.withColumn(name, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(counts: DataFrame) -> DataFrame:
    """From (source, size, n): source, source_size, documents (with words) and target. One row per source, so the windows are small."""
    n, size = F.col("n"), F.col("size")
    per = counts.groupBy("source").agg(F.sum(n * size).alias("source_size"), F.sum(F.when(size > 0, n).otherwise(0)).alias("documents"))
    rank = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (rank % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(MOST))
    by_need = W.orderBy(F.col("most") / F.col("weight"), F.asc_nulls_last("source"))
    before, onward = by_need.rowsBetween(W.unboundedPreceding, -1), by_need.rowsBetween(0, W.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(W.partitionBy()))
    # What one unit of weight gets if all sources before this one are full; the first source that this doesn't fill sets it for all after.
    level = (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level)
    per = per.withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))).over(W.partitionBy()))
    target = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("weight"), F.col("most")))
    return per.select("source", "source_size", "documents", target.alias("target"))


def rate(tilt: Column, mean: Column, size: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(F.least(tilt * size / mean, F.lit(math.log(MOST) + 1e-9))))


def _exact(x: Column) -> Column:
    return F.sum(x.cast("decimal(30,8)")).cast("double")


def tilts(counts: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with lambda and mean: the dual's solution, each Newton step one aggregation of (source, size, n)."""
    mean = F.greatest(F.lit(1.0), F.col("source_size") / F.greatest(F.col("documents"), F.lit(1)))
    edge = mean * (math.log(MOST) + 1)
    full = F.col("target") >= F.col("source_size") * (MOST * (1 - 1e-12))
    keys = ("source", "source_size", "target", "mean", "tilt", "low", "high", "full")
    start = F.least(F.lit(1.0), F.greatest(F.lit(-20.0), F.log(F.col("target") / F.col("source_size"))))
    state = goals.withColumns({"mean": mean, "low": mean * -60.0, "high": edge, "full": full})
    state = state.withColumn("tilt", F.when(F.col("full"), F.col("high")).otherwise(F.coalesce(start, F.lit(0.0))))
    state = written(state.select(*keys), "tilts")
    for _ in range(NEWTON_STEPS):
        r = rate(F.col("tilt"), F.col("mean"), F.col("size"))
        words = F.col("n") * F.col("size") * r
        slope = F.when(r < MOST, words * F.col("size") / F.col("mean")).otherwise(0.0)
        right = state.withColumnRenamed("source", "of")
        seen = counts.join(right, counts["source"].eqNullSafe(right["of"])).groupBy(*keys).agg(_exact(words).alias("sum"), _exact(slope).alias("slope"))
        short = F.col("sum") < F.col("target")
        low, high = F.when(short, F.col("tilt")).otherwise(F.col("low")), F.when(short, F.col("high")).otherwise(F.col("tilt"))
        step = F.col("tilt") - (F.col("sum") - F.col("target")) / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (step > low) & (step < high)
        off = F.abs(F.col("sum") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0))
        done = F.col("full") | (off <= TOLERANCE)
        after = seen.withColumns({"a": low, "b": high, "off": F.when(F.col("full"), 0.0).otherwise(off)})
        after = after.withColumn("c", F.when(done, F.col("tilt")).when(inside, step).otherwise((low + high) / 2))
        fresh = written(
            after.select("source", "source_size", "target", "mean", F.col("c").alias("tilt"), F.col("a").alias("low"), F.col("b").alias("high"), "full", "off"), "tilts"
        )
        removed(state)
        worst = fresh.agg(F.max("off")).first()[0]
        state = fresh
        if worst is None or worst <= TOLERANCE:
            break
    return state.select("source", "source_size", "target", "mean", "tilt")


def dither() -> Column:
    """In [0, 1), by doc_id alone."""
    return (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("mix")), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def copies(shift: Column) -> Column:
    r = rate(F.col("tilt"), F.col("mean"), F.col("size"))
    return F.greatest(F.lit(0), F.least(F.lit(MOST), F.floor(r + dither() + shift))).cast("int")


def _meet(rows: DataFrame, state: DataFrame) -> DataFrame:
    right = state.withColumnRenamed("source", "of")
    return rows.join(right, rows["source"].eqNullSafe(right["of"]), "left").drop("of")


def fit(sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (doc_id, source, size): the sources' parameters, and (doc_id, size, gain) for the few documents corrected by hand."""
    counts = written(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    goals = written(targets(counts), "goals")
    state = written(tilts(counts, goals).withColumns({"low": F.lit(-1.0), "high": F.lit(1.0)}), "shifts")
    keys = ("source", "source_size", "target", "mean", "tilt", "low", "high")
    for _ in range(DIVISIONS):
        at = [F.col("low") + (F.col("high") - F.col("low")) * (j / (TRIALS + 1)) for j in range(TRIALS + 2)]
        sums = [F.sum(F.col("size") * copies(at[j])).alias(f"s{j}") for j in range(1, TRIALS + 1)]
        seen = _meet(sizes, state).groupBy(*keys).agg(*sums)
        low, high = at[0], at[TRIALS + 1]
        for j in range(1, TRIALS + 1):
            low = F.when(F.col(f"s{j}") <= F.col("target"), at[j]).otherwise(low)
        for j in range(TRIALS, 0, -1):
            high = F.when(F.col(f"s{j}") > F.col("target"), at[j]).otherwise(high)
        fresh = seen.select("source", "source_size", "target", "mean", "tilt", low.alias("a"), high.alias("b"))
        fresh = written(fresh.withColumnsRenamed({"a": "low", "b": "high"}), "shifts")
        removed(state)
        state = fresh
    ends = _meet(sizes, state).groupBy(*keys).agg(*[F.sum(F.col("size") * copies(F.col(c))).alias(f"at_{c}") for c in ("low", "high")])
    nearer = F.abs(F.col("at_high") - F.col("target")) < F.abs(F.col("at_low") - F.col("target"))
    state = ends.select("source", "source_size", "target", "mean", "tilt", F.when(nearer, F.col("high")).otherwise(F.col("low")).alias("shift"))
    state = written(state, "state")
    gains = written(sizes.select("doc_id", "source", "size", F.lit(0).alias("gain")).limit(0), "gains")
    for change in (*[_single] * CORRECTIONS, _swap):
        rows = apply(sizes, state, gains)
        left = written(rows.groupBy(F.col("source").alias("of")).agg((F.max("target") - F.sum("taken")).alias("left")), "left")
        may = rows.join(left, rows["source"].eqNullSafe(left["of"]) & (F.col("size") > 0) & (F.abs(F.col("left")) >= 1.0))
        more = written(gains.unionByName(change(may)), "gains")
        removed(gains)
        gains = more
    return state, gains


def _single(may: DataFrame) -> DataFrame:
    """Of each source the document whose one copy more or less comes nearest to what is left, if that is nearer than before."""
    may = may.filter(F.when(F.col("left") > 0, F.col("copies") < MOST).otherwise(F.col("copies") > 0))
    off = F.abs(F.abs(F.col("left")) - F.col("size"))
    best = F.min(F.struct(off.alias("off"), F.xxhash64("doc_id").alias("by"), "doc_id", "size", F.signum("left").cast("int").alias("gain")))
    may = may.filter(off < F.abs(F.col("left"))).groupBy("source").agg(best.alias("x"))
    return may.select("x.doc_id", "source", "x.size", "x.gain")


def _swap(may: DataFrame) -> DataFrame:
    """Of each source one document that gains a copy and one that loses one. They are found by size: one of each size is enough."""
    one = F.min(F.struct(F.xxhash64("doc_id").alias("by"), "doc_id"))["doc_id"]
    up = may.filter(F.col("copies") < MOST).groupBy("source", "size", "left").agg(one.alias("more_id")).withColumnRenamed("size", "more")
    down = may.filter("copies > 0").groupBy(F.col("source").alias("from"), F.col("size").alias("less")).agg(one.alias("less_id"))
    want = F.col("more") - F.round("left").cast("long")
    up = up.withColumn("want", F.explode(F.sequence(want - SWAP, want + SWAP)))
    both = up.join(down, up["source"].eqNullSafe(down["from"]) & (up["want"] == down["less"]) & ~F.col("more_id").eqNullSafe(F.col("less_id")))
    off = F.abs(F.col("left") - (F.col("more") - F.col("less")))
    both = both.filter(off < F.abs(F.col("left"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "more", "more_id", "less", "less_id")).alias("x"))
    pair = F.array(*[F.struct(F.col(f"x.{k}_id").alias("doc_id"), F.col(f"x.{k}").alias("size"), F.lit(g).alias("gain")) for k, g in (("more", 1), ("less", -1))])
    return both.select("source", F.explode(pair).alias("y")).select("y.doc_id", "source", "y.size", "y.gain")


def apply(sized: DataFrame, state: DataFrame, gains: DataFrame) -> DataFrame:
    """``sized`` with its source's source_size and target, and its own copies and taken."""
    rows = _meet(sized, state)
    change = gains.groupBy(F.col("doc_id").alias("g_id"), F.col("source").alias("g_source"), F.col("size").alias("g_size")).agg(F.sum("gain").alias("gain"))
    same = rows["doc_id"].eqNullSafe(change["g_id"]) & rows["source"].eqNullSafe(change["g_source"]) & (rows["size"] == change["g_size"])
    rows = rows.withColumn("copies", copies(F.col("shift"))).join(change, same, "left")
    rows = rows.withColumn("copies", F.greatest(F.lit(0), F.least(F.lit(MOST), F.col("copies") + F.coalesce("gain", F.lit(0)))).cast("int"))
    rows = rows.withColumn("taken", F.col("size") * F.col("copies"))
    return rows.drop("g_id", "g_source", "g_size", "gain", "mean", "tilt", "shift")


def mix(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, copies."""
    sizes = written(with_size(docs.select("doc_id", "source", "text")).drop("text"), "sizes")
    return apply(sizes, *fit(sizes)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. Texts stay where they are read: only parameters are joined."""
    needed = {"doc_id": "doc_id", "source": "source"}
    sizes = written(with_size(docs.select(*needed, "text")).drop("text"), "sizes")
    state, gains = fit(sizes)
    packed = with_size(docs.select(*needed, "text", F.struct(*docs.columns).alias("row"))).drop("text")
    rows = apply(packed, state, gains).filter("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
