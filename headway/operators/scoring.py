"""Scoring arrival estimates: at every moment that a page would show one (display), and at every report (each method against the timetable).

A report meets the passages of its own journey within ``HORIZON_S`` of it, in time buckets of that length. What a page shows between two
reports is not expanded into its five-second moments: how many of a hold's moments lie where the vehicle is in fact two to ten minutes away, and at how many
the estimate says so, are counts of whole steps in an interval. Errors go into bins, so what is kept of a journey is a few hundred counts.

The timetable corrected by the journey's delay takes, at each report, the furthest passage before the target that was known by then, of the
journey's own passages in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.constants import BIN_MIN, HOLD_STALE_S, HORIZON_S, LEAST_LEAD_S, MIN_REPORTS, POLL_WAIT_S, SAMPLE_S, SHOWN_MIN
from headway.functions import stats
from headway.operators.sequences import asof
from headway.operators.spatial import band_join
from headway.session import settled

METHODS = ("progress", "scheduled", "adjusted", "remaining", "blended")


def error_bin(minutes: Column) -> Column:
    """The nearest bin, halves to the even one."""
    return F.rint(minutes / BIN_MIN).cast("int")


def with_holds(reports: DataFrame, publications: DataFrame, keys: list[str]) -> DataFrame:
    """``reports`` (journey, at, retrieved) with held_from and held_to: when a page first holds a report, and until when, in ms.

    It holds the first publication at or after a report was retrieved, ten seconds later on average, and lets go when the journey's next report is held or this one is
    too old. publications: keys (what publishes them together), published (ms).
    """
    pub = publications.select(*keys, F.col("published").alias("retrieved")).distinct()
    rows = asof(reports, pub, keys, "retrieved", [], forward=True)
    rows = rows.withColumn("held_from", F.col("hit_retrieved") + POLL_WAIT_S * 1000).drop("hit_retrieved")
    after = W.partitionBy("journey").orderBy("at", "retrieved").rowsBetween(1, W.unboundedFollowing)
    following = F.first("held_from", ignorenulls=True).over(after)
    return rows.withColumn("held_to", F.least(F.coalesce(following, F.col("at") + HOLD_STALE_S * 1000), F.col("at") + HOLD_STALE_S * 1000))


def _steps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """How many of start, start + SAMPLE_S, ... before end lie in [low, high]; all in ms."""
    step = SAMPLE_S * 1000
    last = F.ceil((end - start) / step) - 1
    first, final = F.greatest(F.lit(0), F.ceil((low - start) / step)), F.least(last, F.floor((high - start) / step))
    return F.greatest(F.lit(0), final - first + 1).cast("long")


def display_spells(reports: DataFrame, passages: DataFrame, estimates: DataFrame) -> DataFrame:
    """One row per report and passage of its journey that it can be shown for: eligible, eligible_shown and shown moments, and the errors in minutes.

    reports: journey, at, along (metres, null off the road), held_from, held_to; passages: journey, stop_index, offset_m, passed_ms, timetable_ms (or null);
    estimates: journey, at, stop_index, eta_ms, only where the card is up. Journeys with fewer than ``MIN_REPORTS`` reports on the road are left out.
    """
    on = reports.withColumn("__placed", F.count("along").over(W.partitionBy("journey"))).filter(F.col("__placed") >= MIN_REPORTS)
    on = on.filter("along IS NOT NULL AND held_from IS NOT NULL AND held_to > held_from").select("journey", "at", "along", "held_from", "held_to")
    met = band_join(on, passages.select("journey", "stop_index", "offset_m", "passed_ms", "timetable_ms"), "at", "passed_ms", HORIZON_S * 1000.0, ("journey",))
    met = met.filter((F.col("at") < F.col("passed_ms")) & (F.col("along") < F.col("offset_m")))
    rows = met.join(estimates.select("journey", "at", "stop_index", "eta_ms"), ["journey", "at", "stop_index"], "left")
    low, high = (m * 60_000 for m in SHOWN_MIN)
    start, end = F.col("held_from"), F.col("held_to")
    truly, said = [(F.col("passed_ms") - high, F.col("passed_ms") - low), (F.col("eta_ms") - high, F.col("eta_ms") - low)]
    both = (F.greatest(truly[0], said[0]), F.least(truly[1], said[1]))
    shown = F.when(F.col("eta_ms").isNull(), F.lit(0)).otherwise(_steps(start, end, *said)).cast("long")
    return rows.select(
        "journey", "at", "stop_index", _steps(start, end, *truly).alias("eligible"), F.when(F.col("eta_ms").isNull(), F.lit(0)).otherwise(_steps(start, end, *both)).cast("long").alias("eligible_shown"), shown.alias("shown"),
        ((F.col("passed_ms") - F.col("eta_ms")) / 60_000).alias("error_min"), ((F.col("passed_ms") - F.col("timetable_ms")) / 60_000).alias("timetable_min"),
    )


def journey_histograms(spells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, bin, n): ``signed`` errors of all shown moments; ``candidate`` and ``timetable``, absolute ones of those where the timetable names a time."""
    kinds = F.array(F.struct(F.lit("signed").alias("kind"), error_bin(F.col("error_min")).alias("bin")), F.struct(F.lit("candidate").alias("kind"), F.abs(error_bin(F.col("error_min"))).alias("bin")), F.struct(F.lit("timetable").alias("kind"), F.abs(error_bin(F.col("timetable_min"))).alias("bin")))
    rows = spells.filter("shown > 0").select(*keys, "shown", "timetable_min", F.explode(kinds).alias("k"))
    return rows.filter("k.kind = 'signed' OR timetable_min IS NOT NULL").groupBy(*keys, "k.kind", "k.bin").agg(F.sum("shown").alias("n"))


def journey_coverage(spells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, eligible, eligible_shown, passages): moments at which the vehicle was two to ten minutes away, those of them with minutes shown, and passages shown at all."""
    return spells.groupBy(*keys).agg(F.sum("eligible").alias("eligible"), F.sum("eligible_shown").alias("eligible_shown"), F.countDistinct(F.when(F.col("shown") > 0, F.col("stop_index"))).alias("passages"))


def journey_counts(spells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, kind, bin, n): the rows of ``journey_histograms`` and, by the kinds ``eligible`` and ``eligible_shown`` (bin 0), the moments that ``journey_coverage`` counts; one pass for both."""
    count = lambda kind, bin, n: F.struct(F.lit(kind).alias("kind"), bin.alias("bin"), F.col(n).alias("n"))
    rows = spells.select(*keys, "shown", "eligible", "eligible_shown", error_bin(F.col("error_min")).alias("signed"), F.abs(error_bin(F.col("timetable_min"))).alias("late"))
    kinds = F.array(count("signed", F.col("signed"), "shown"), count("candidate", F.abs("signed"), "shown"), count("timetable", F.col("late"), "shown"), count("eligible", F.lit(0), "eligible"), count("eligible_shown", F.lit(0), "eligible_shown"))
    rows = rows.select(*keys, "late", F.explode(kinds).alias("k")).filter("k.n > 0 AND (late IS NOT NULL OR k.kind NOT IN ('candidate', 'timetable'))")
    return rows.groupBy(*keys, "k.kind", "k.bin").agg(F.sum("k.n").alias("n"))


def evaluated(spells: DataFrame, keys: list[str], interval: tuple[float, float]) -> DataFrame:
    """``pooled`` of spells (keys, journey and what ``display_spells`` gives), which are made once."""
    counts = settled(journey_counts(spells, [*keys, "journey"]))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).alias(kind)
    coverage = counts.groupBy(*keys, "journey").agg(of("eligible"), of("eligible_shown"))
    return _pooled(counts.filter("kind IN ('signed', 'candidate', 'timetable')"), coverage, keys, interval)


def _quantile(bins: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """Minutes of the first bin at which a histogram (keys, bin, n) has come to each share."""
    upto = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    rows = bins.withColumns({"__upto": F.sum("n").over(upto), "__all": F.sum("n").over(W.partitionBy(*keys))})
    return rows.groupBy(*keys).agg(*[(F.min(F.when(F.col("__upto") >= F.col("__all") * q, F.col("bin"))) * BIN_MIN).alias(name) for name, q in wanted.items()])


def pooled(histograms: DataFrame, coverage: DataFrame, keys: list[str], interval: tuple[float, float]) -> DataFrame:
    """What the journeys of each group say together, and how many journeys say it by themselves.

    histograms: keys, journey, kind, bin, n; coverage: keys, journey, eligible, eligible_shown, passages. ``interval``: minutes of signed error, whose share of moments is given.
    """
    return _pooled(settled(histograms), coverage, keys, interval)


def _pooled(histograms: DataFrame, coverage: DataFrame, keys: list[str], interval: tuple[float, float]) -> DataFrame:
    add = lambda rows, by: rows.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    signed, folded = histograms.filter("kind = 'signed'"), histograms.filter("kind = 'signed'").withColumn("bin", F.abs("bin"))
    minutes = F.col("bin") * BIN_MIN
    inside = minutes.between(interval[0] - 1e-9, interval[1] + 1e-9)
    share = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)) / F.sum("n")
    out = signed.groupBy(*keys).agg(F.sum("n").alias("moments"), F.countDistinct("journey").alias("journeys"), share(F.col("bin") > 0).alias("share_later"), share(inside).alias("interval_coverage"))
    parts = [
        _quantile(add(folded, keys), keys, {"median_abs": 0.5, "p80_abs": 0.8}), _quantile(add(signed, keys), keys, {"signed_p10": 0.1, "signed_median": 0.5, "signed_p90": 0.9}),
        _quantile(add(histograms.filter("kind = 'candidate'"), keys), keys, {"median_abs_where_paired": 0.5}), _quantile(add(histograms.filter("kind = 'timetable'"), keys), keys, {"timetable_median_abs": 0.5}),
        coverage.groupBy(*keys).agg(F.sum("eligible").alias("eligible"), (F.sum("eligible_shown") / F.nullif(F.sum("eligible"), F.lit(0))).alias("coverage")),
    ]
    own = _quantile(add(folded, [*keys, "journey"]), [*keys, "journey"], {"own": 0.5})
    parts.append(stats.quantiles(own, keys, "own", {"median_of_medians": ("upper", 0.5), "p20_of_medians": ("floor", 0.2), "p80_of_medians": ("floor", 0.8)}).drop("n"))
    for part in parts:
        out = out.join(part, keys, "left")
    return out


def known_delay(reports: DataFrame, passages: DataFrame) -> DataFrame:
    """(journey, at, stop_index, delay_ms): by how much the journey was late at the furthest stop before each target that was known to be passed at a report.

    reports: journey, at; passages: journey, stop_index, passed_ms, known_ms (when the report after it came), timetable_ms (null: the timetable names none). Two
    orders of time: where a passage lies along the journey, and from when it is known.
    """
    asked = reports.select("journey", "at").distinct().join(passages.select("journey", "stop_index").distinct(), "journey")
    return _with_delay(asked, passages).filter("delay_ms IS NOT NULL")


def _with_delay(asked: DataFrame, passages: DataFrame) -> DataFrame:
    """``asked`` (journey, at, stop_index and what else) with ``delay_ms``. A journey's passages, its stops' count, stand beside each of its rows, so nothing is sorted by time."""
    held = passages.groupBy("journey").agg(F.collect_list(F.struct(F.col("stop_index").alias("before"), (F.col("passed_ms") - F.col("timetable_ms")).alias("delay_ms"), "known_ms")).alias("__held"))
    known = F.filter("__held", lambda x: (x["before"] < F.col("stop_index")) & (x["known_ms"] <= F.col("at")))
    furthest = F.array_max(F.transform(known, lambda x: F.struct(x["before"].alias("before"), x["delay_ms"].alias("delay_ms"))))
    return asked.join(held, "journey", "left").withColumn("delay_ms", furthest["delay_ms"]).drop("__held")


def scored(reports: DataFrame, passages: DataFrame, estimates: DataFrame) -> DataFrame:
    """Every report at least a minute and at most ``HORIZON_S`` before a passage, with horizon_min and the error in minutes of each of ``METHODS`` (null: it gives no time).

    reports: journey, at, along (on the road); passages: journey, stop_index, offset_m, passed_ms, known_ms, timetable_ms, uncertainty_s; estimates: journey, at, stop_index, progress_ms, remaining_ms, blended_ms.
    """
    on = reports.withColumn("__placed", F.count(F.lit(1)).over(W.partitionBy("journey"))).filter(F.col("__placed") >= MIN_REPORTS).select("journey", "at", "along")
    met = band_join(on, passages, "at", "passed_ms", HORIZON_S * 1000.0, ("journey",))
    lead = (F.col("passed_ms") - F.col("at")) / 1000
    met = met.filter((lead >= LEAST_LEAD_S) & (F.col("along") < F.col("offset_m"))).withColumn("horizon_min", lead / 60)
    one = ["journey", "at", "stop_index"]
    rows = _with_delay(met, passages).join(estimates, one, "left")
    error = lambda eta: (F.col("passed_ms") - eta) / 60_000
    etas = {"progress": F.col("progress_ms"), "scheduled": F.col("timetable_ms"), "adjusted": F.col("timetable_ms") + F.col("delay_ms"), "remaining": F.col("remaining_ms"), "blended": F.col("blended_ms")}
    return rows.select(*one, "horizon_min", "uncertainty_s", *[error(etas[m]).alias(m) for m in METHODS])


def methods_compared(rows: DataFrame, keys: list[str], band: tuple[int, int] = SHOWN_MIN) -> DataFrame:
    """(keys, subset, method, moments, available, coverage, median_abs, p80_abs, journeys, median_of_medians) within a band of horizons.

    Subset ``all`` takes each method where it gives a time, ``identical`` only moments where progress, remaining and blended all do.
    """
    inside = rows.filter((F.col("horizon_min") >= band[0]) & (F.col("horizon_min") < band[1]))
    same = F.col("progress").isNotNull() & F.col("remaining").isNotNull() & F.col("blended").isNotNull()
    inside = inside.withColumn("subset", F.explode(F.when(same, F.array(F.lit("all"), F.lit("identical"))).otherwise(F.array(F.lit("all")))))
    inside = settled(inside)
    by = [*keys, "subset"]
    moments = inside.groupBy(*by).agg(F.count(F.lit(1)).alias("moments"))
    each = inside.select(*by, "journey", F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.abs(m).alias("off")) for m in METHODS])).alias("x")).select(*by, "journey", "x.*").filter("off IS NOT NULL")
    at = stats.quantiles(each, [*by, "method"], "off", {"median_abs": ("linear", 0.5), "p80_abs": ("index", 0.8)}).withColumnRenamed("n", "available")
    own = stats.small_quantile(each, [*by, "method", "journey"], "off", 0.5, "own")
    journeys = stats.quantiles(own, [*by, "method"], "own", {"median_of_medians": ("linear", 0.5)}).withColumnRenamed("n", "journeys")
    out = moments.join(at, by).join(journeys, [*by, "method"])
    return out.withColumn("coverage", F.col("available") / F.col("moments"))
