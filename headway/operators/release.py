"""What an evaluation releases: versioned day records that a rerun does not double, thresholds with fragile results marked, and scopes that an approval names field for field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.operators.identity import insert_absent

#: What a direction must reach. Fixed values.
THRESHOLDS = {"median_abs": 1.5, "p80_abs": 3.0, "better": 0.5, "coverage": 0.5, "journeys": 20, "passages": 150, "weekdays": 1, "interval_coverage": 0.8}
VERSION = ["day", "protocol", "model", "mapping", "digest"]
SCOPE = ["operator", "line", "direction", "model", "protocol", "digest"]


def content_digest(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, digest) of what each key's rows say, whatever their order: their number, and the sum and the exclusive or of their hashes. Rows are hashed where they are, so a large key costs one row a task."""
    h = F.xxhash64(*columns)
    agg = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return agg.select(*keys, F.substring(F.sha2(F.concat_ws("|", "n", "s", "x"), 256), 1, 12).alias("digest"))


def new_versions(stored: DataFrame, scored: DataFrame) -> DataFrame:
    """The day records (``VERSION`` and what else) to append: a rerun of what is stored adds nothing, a changed digest adds a version."""
    return insert_absent(stored, scored.dropDuplicates(VERSION), VERSION)


def current_versions(records: DataFrame, protocol: str, model: str, mapping: int) -> DataFrame:
    """The newest record of each day under one protocol, model and mapping; ``versions``: how many there are. records: ``VERSION``, scored_at."""
    own = records.filter((F.col("protocol") == protocol) & (F.col("model") == model) & (F.col("mapping") == mapping))
    newest = W.partitionBy("day").orderBy(F.desc("scored_at"), "digest")
    return own.withColumns({"k": F.row_number().over(newest), "versions": F.count(F.lit(1)).over(W.partitionBy("day"))}).filter("k = 1").drop("k")


def touched_days(records: DataFrame, window: DataFrame, protocol: str, model: str, mapping: int) -> DataFrame:
    """Days of a confirmation window (day) that were scored under anything else: the window is then no longer untouched."""
    other = ~((F.col("protocol") == protocol) & (F.col("model") == model) & (F.col("mapping") == mapping))
    return records.join(window, "day", "left_semi").filter(other).select("day").distinct()


def verdicts(results: DataFrame, approvals: DataFrame) -> DataFrame:
    """``results`` with each check, ``failed`` and ``fragile`` (arrays of names), ``status`` (collecting, not_met, awaiting_approval, released) and ``released_patterns``.

    results: ``SCOPE``, pattern_ids, complete, median_abs, p80_abs, median_abs_where_paired, timetable_median_abs, coverage, journeys, passages, weekdays, interval_coverage, and the ends of the
    intervals by whole journeys: median_low, median_high, p80_low, p80_high, coverage_low, coverage_high (null: none). approvals: ``SCOPE``, pattern_ids. A passing result is released for
    the patterns that an approval with the very same fields names.
    """
    c, t = F.col, THRESHOLDS
    reached = lambda x: F.coalesce(x, F.lit(False))
    checks = {
        "median_abs": reached(c("median_abs") <= t["median_abs"]), "p80_abs": reached(c("p80_abs") <= t["p80_abs"]), "better_than_timetable": reached(c("timetable_median_abs") - c("median_abs_where_paired") >= t["better"]),
        "coverage": reached(c("coverage") >= t["coverage"]), "journeys": reached(c("journeys") >= t["journeys"]), "passages": reached(c("passages") >= t["passages"]), "weekdays": reached(c("weekdays") >= t["weekdays"]),
        "interval_coverage": reached(c("interval_coverage") >= t["interval_coverage"]),
    }
    crosses = lambda low, limit, high: reached((c(low) <= limit) & (limit < c(high)))
    fragile = {"median_abs": crosses("median_low", F.lit(t["median_abs"]), "median_high"), "p80_abs": crosses("p80_low", F.lit(t["p80_abs"]), "p80_high"), "interval_coverage": reached((c("coverage_low") < t["interval_coverage"]) & (F.lit(t["interval_coverage"]) <= c("coverage_high")))}
    names = lambda which: F.array_compact(F.array(*[F.when(x, n) for n, x in which.items()]))
    named = approvals.groupBy(*SCOPE).agg(F.flatten(F.collect_list("pattern_ids")).alias("__named"))
    rows = results.join(named, SCOPE, "left").withColumns({"failed": names({n: ~x for n, x in checks.items()}), "fragile": names(fragile)})
    patterns: Column = F.array_intersect(F.coalesce("__named", F.array().cast("array<string>")), "pattern_ids")
    status = F.when(~c("complete"), "collecting").when(F.size("failed") > 0, "not_met").when(F.size(patterns) > 0, "released").otherwise("awaiting_approval")
    return rows.withColumn("status", status).withColumn("released_patterns", F.when(c("status") == "released", F.array_sort(patterns))).drop("__named")
