"""Runs, their sources and publications, totals that reprocessing can't move, jobs, and what a reader can say of a feed's age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.constants import PUBLICATION_STALE_S


def with_processing(runs: DataFrame, processing: DataFrame, key: str, outcome: str, amounts: list[str]) -> DataFrame:
    """Each run with how many sources it processed, how many succeeded, and the sums of ``amounts``; runs without any stay, with zeros."""
    per = processing.groupBy(key).agg(F.count(F.lit(1)).alias("sources"), F.count(F.when(F.col(outcome) == "succeeded", 1)).alias("succeeded"), *[F.sum(a).alias(a) for a in amounts])
    return runs.join(per, key, "left").fillna(0, ["sources", "succeeded", *amounts])


def with_publications(runs: DataFrame, publications: DataFrame, key: str, newest: list[Column], limit: int) -> DataFrame:
    """Runs with each of their publications, newest first; a run with many repeats, one without stays once. The limit counts these rows."""
    return runs.join(publications, key, "left").orderBy(*newest).limit(limit)


def first_passes(processing: DataFrame, source: str, outcome: str, order: list[str]) -> DataFrame:
    """The first successful pass over each source: parsing is deterministic, so later passes add nothing."""
    done = processing.filter(F.col(outcome) == "succeeded")
    rest = [c for c in done.columns if c != source and c not in order]
    return done.groupBy(source).agg(F.min(F.struct(*order, *rest)).alias("x")).select(source, "x.*")


def totals(passes: DataFrame, stored: DataFrame, conflicts: DataFrame, in_area: str, conflicting: str) -> DataFrame:
    """One row: sources, inputs in the area, stored, conflicting, and repeats, which are what is left: inputs less stored less conflicting."""
    a = passes.agg(F.count(F.lit(1)).alias("sources"), F.coalesce(F.sum(in_area), F.lit(0)).alias("inputs"), F.coalesce(F.sum(conflicting), F.lit(0)).alias("conflicting"))
    one = a.crossJoin(stored.agg(F.count(F.lit(1)).alias("stored"))).crossJoin(conflicts.agg(F.count(F.lit(1)).alias("identities")))  # single rows
    return one.withColumn("repeats", F.col("inputs") - F.col("stored") - F.col("conflicting"))


def closed_runs(runs: DataFrame, cycles: DataFrame, key: str, status: str, started: str, finished: str) -> DataFrame:
    """Runs still marked running become ``interrupted`` at their last recorded cycle, or at their start where there is none. No cause is guessed."""
    last = cycles.groupBy(key).agg(F.max(finished).alias("__last"), F.count(F.lit(1)).alias("__n"))
    rows = runs.join(last, key, "left").withColumn("cycles", F.coalesce("__n", F.lit(0)))
    abandoned = F.col(status) == "running"
    return rows.withColumns({"finished_at": F.when(abandoned, F.coalesce("__last", F.col(started))), "status_now": F.when(abandoned, "interrupted").otherwise(F.col(status))}).drop("__last", "__n")


def receipts(received: DataFrame, published: DataFrame, key: str, at: str, written: str) -> DataFrame:
    """Each publication with the delay of its first receipt, and whether it was written while someone watched but never received."""
    first = received.groupBy(key).agg(F.min(at).alias("first_at"))
    watched = received.agg(F.min(at).alias("since"), F.max(at).alias("until"))
    rows = published.join(first, key, "left").crossJoin(F.broadcast(watched))  # one row
    missed = F.col("first_at").isNull() & F.col(written).between(F.col("since"), F.col("until"))
    return rows.withColumns({"delay": F.col("first_at") - F.col(written), "never_received": F.coalesce(missed, F.lit(False))}).drop("since", "until")


def job_state(last: DataFrame, now: Column) -> DataFrame:
    """``state`` and ``overdue`` of jobs: result, started_at, last_scheduled_at, every_s, grace_s, timeout_s (instants in seconds).

    A start with no stop, past the job's own time and ten minutes more, is ``unrecorded``.
    """
    open_until = F.col("started_at") + F.coalesce("timeout_s", F.lit(3600)) + 600
    state = F.when(F.col("result").isNull(), "never").when(F.col("result") == "running", F.when(now <= open_until, "running").otherwise("unrecorded")).when(F.col("result") == "succeeded", "succeeded").otherwise("failed")
    overdue = F.coalesce(now - F.col("last_scheduled_at") > F.col("every_s") + F.col("grace_s"), F.lit(True))
    return last.withColumns({"state": state, "overdue": overdue})


def reference_clock(header_s: Column, held_s: Column, published_s: Column, device_s: Column) -> Column:
    """The server's own time where its header gives one no earlier than the publication, else the later of publication and device."""
    server = header_s + F.greatest(F.coalesce(held_s, F.lit(0)), F.lit(0))
    return F.when(server >= published_s, server).otherwise(F.greatest(published_s, device_s))


def age(reference_s: Column, at_s: Column, fetched_s: Column, now_s: Column, floor: bool = False) -> Column:
    """Age by the server's clock at the fetch, and what has gone by here since. Publications are never younger than nothing (``floor``)."""
    then = reference_s - at_s
    return (F.greatest(then, F.lit(0)) if floor else then) + F.greatest(now_s - fetched_s, F.lit(0))


def feed_mode(online: Column, cached: Column, state: Column, age_s: Column, limit_s: int = PUBLICATION_STALE_S) -> Column:
    return (
        F.when(~online | cached, "offline")
        .when(state.isNull() | (state == "unavailable"), "unavailable")
        .when((state == "stale") | F.coalesce(age_s > limit_s, F.lit(False)), "stale")
        .otherwise("live")
    )


def gone_quiet(at_publication_s: Column, now_s: Column, fresh_s: int) -> Column:
    """Whole seconds of silence: judged by the age at publication, told as the age now; null where it was fresh."""
    return F.when(at_publication_s > fresh_s, F.round(F.greatest(F.coalesce(now_s, at_publication_s), at_publication_s)).cast("long"))


def visible_tracks(points: DataFrame, journey: list[str], vehicle: list[str], at: str, now: Column, most_s: int = 120) -> DataFrame:
    """At a replay's time: each vehicle's journey that was reported last, no longer ago than ``most_s``."""
    newest = points.filter((F.col(at) <= now) & (F.col(at) >= now - most_s)).groupBy(*vehicle, *[j for j in journey if j not in vehicle]).agg(F.max(at).alias(at))
    rest = [c for c in newest.columns if c not in vehicle and c != at]
    return newest.groupBy(*vehicle).agg(F.max(F.struct(at, *rest)).alias("x")).select(*vehicle, "x.*")


def supported(points: DataFrame, keys: list[str], at: str, s: str, far_m: float, back_m: float, most_m_s: float) -> DataFrame:
    """``points`` with ``held``: a report behind the one before it by more than scatter, that the reports beside it contradict, or the newest such.

    One pass with the neighbours in order: a report is held where it lies back, and the next joins the one before it.
    """
    w = W.partitionBy(*keys).orderBy(at)
    before, after = F.lag(s).over(w), F.lead(s).over(w)
    seconds = F.lead(at).over(w) - F.lag(at).over(w)
    back = before.isNotNull() & (before - F.col(s) > F.greatest(F.lit(back_m), F.lit(far_m)))
    joins = (after - before >= -back_m) & (seconds > 0) & ((after - before) / seconds <= most_m_s)
    return points.withColumn("held", back & (after.isNull() | F.coalesce(joins, F.lit(False))))


def uncertainty(reports: DataFrame, bins: DataFrame, age_s: str, least: int = 30) -> DataFrame:
    """``reports`` with the error of the first bin that reaches their age; none where it has fewer than ``least`` cases.

    The profile is one row, an array of its bins in order, so reports are not multiplied.
    """
    profile = bins.agg(F.array_sort(F.collect_list(F.struct("up_to", "n", "p80"))).alias("bins"))
    rows = reports.crossJoin(F.broadcast(profile))  # one row
    hit = F.get(F.filter("bins", lambda b: F.col(age_s) <= b["up_to"]), F.lit(0))
    return rows.withColumn("__hit", hit).withColumn("p80", F.when(F.col("__hit.n") >= least, F.col("__hit.p80"))).drop("bins", "__hit")


def replaced(old: DataFrame, fresh: DataFrame, scope: list[str]) -> DataFrame:
    """``old`` with everything of the scopes that were read again replaced by ``fresh``; other scopes stay as they are."""
    return old.join(fresh.select(*scope).distinct(), scope, "left_anti").unionByName(fresh)


def migrated(old: DataFrame, schema) -> DataFrame:
    """``old`` under a schema that only adds columns: new ones are null; a column that is gone or of another kind is refused."""
    held = dict(old.dtypes)
    wanted = {f.name: f.dataType.simpleString() for f in schema}
    lost = [c for c in held if wanted.get(c) != held[c]]
    if lost:
        raise ValueError(f"columns would be lost or change their kind: {lost}")
    return old.select(*[F.col(f.name) if f.name in held else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
