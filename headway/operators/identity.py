"""Observation identity: what a batch adds to the stored history, what it repeats and what contradicts it.

An identity is a set of key columns; its reading is a set of value columns. Conflicts within a batch are decided before the
store is looked at, so such an identity is never stored; a batch that contradicts the store leaves the first reading there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _reading(values: list[str]):
    return F.concat_ws(",", *[F.coalesce(F.col(v).cast("string"), F.lit("")) for v in values])


def classify(batch: DataFrame, stored: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per identity of the batch: its smallest reading, copies, and ``outcome`` (new, repeat, conflict_in_batch,
    conflict_with_stored). Readings are compared as text within the batch and by value with the store.

    Two partial aggregations on the same keys; the store is reduced to the batch's identities by the join itself.
    """
    first = F.min(F.struct(*values))
    per = batch.groupBy(*keys).agg(first.alias("reading"), F.count(F.lit(1)).alias("copies"), F.min(_reading(values)).alias("a"), F.max(_reading(values)).alias("b"))
    per = per.select(*keys, *[F.col("reading")[v].alias(v) for v in values], "copies", (F.col("a") != F.col("b")).alias("differs"))
    held = stored.select(*keys, *[F.col(v).alias(f"stored_{v}") for v in values], F.lit(True).alias("held"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"stored_{v}"))
    outcome = F.when(F.col("differs"), "conflict_in_batch").when(F.col("held").isNull(), "new").when(same, "repeat").otherwise("conflict_with_stored")
    return per.join(held, keys, "left").withColumn("outcome", outcome).drop("held", "differs", *[f"stored_{v}" for v in values])


def publishable(observations: DataFrame, conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """Observations that no conflict names."""
    return observations.join(conflicts.select(*keys).distinct(), keys, "left_anti")


def suppressed(observations: DataFrame, conflicts: DataFrame, keys: list[str]) -> DataFrame:
    return observations.join(conflicts.select(*keys).distinct(), keys, "left_semi")


def insert_absent(stored: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose identity the store lacks: what to append."""
    return rows.join(stored.select(*keys), keys, "left_anti")


def upsert(stored: DataFrame, rows: DataFrame, keys: list[str], updated: list[str]) -> DataFrame:
    """The whole table after a partial update: only ``updated`` columns of known keys change, new keys come with all."""
    new = rows.select(*keys, *[F.col(c).alias(f"new_{c}") for c in rows.columns if c not in keys], F.lit(True).alias("given"))
    both = stored.withColumn("held", F.lit(True)).join(new, keys, "full")
    rest = [c for c in stored.columns if c not in keys]
    pick = lambda c: F.when(F.col("held").isNull() | (F.col("given") & F.lit(c in updated)), F.col(f"new_{c}")).otherwise(F.col(c))
    return both.select(*keys, *[pick(c).alias(c) for c in rest])


def fill_once(stored: DataFrame, rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Set ``column`` where the store has null and a repeat carries a value; what is set never changes."""
    given = rows.filter(F.col(column).isNotNull()).groupBy(*keys).agg(F.min(column).alias("__given"))
    return stored.join(given, keys, "left").withColumn(column, F.coalesce(column, "__given")).select(*stored.columns)
