"""Operators over ordered rows: newest, trails, gaps, islands, dominance, as-of joins, cumulative sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row per key as an aggregation: partial maxima before the shuffle, so a hot key costs one row per task."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("x"))
    return best.select(*keys, *[F.col("x")[c].alias(c) for c in (*order, *rest)]).select(*df.columns)


def trail(df: DataFrame, keys: list[str], at: str, tie: str, points: int, seconds: int) -> DataFrame:
    """Up to ``points`` newest rows per key that are no older than ``seconds`` before the key's newest; ``step`` counts from the oldest."""
    down = W.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    # one order gives the newest (the first row), the rank and, from the oldest kept, the step
    rows = df.withColumns({"__newest": F.first(at).over(down), "__k": F.row_number().over(down)})
    kept = rows.filter((F.col("__k") <= points) & (F.col(at) >= F.col("__newest") - F.expr(f"interval {seconds} seconds")))
    return kept.withColumn("step", (F.count(F.lit(1)).over(W.partitionBy(*keys)) - F.col("__k") + 1).cast("long")).drop("__k", "__newest")


def gaps(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """Seconds since the key's previous row, where they are positive."""
    order = W.partitionBy(*keys).orderBy(at, tie)
    gap = (F.unix_micros(at) - F.lag(F.unix_micros(at)).over(order)) / 1e6
    return df.withColumn("gap_s", gap).filter("gap_s > 0")


def islands(df: DataFrame, keys: list[str], order: list[str], value: list[str]) -> DataFrame:
    """Runs of equal ``value`` in order, numbered from 1 within each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    changed = F.lit(False)
    for v in value:
        changed = changed | ~F.col(v).eqNullSafe(F.lag(v).over(w))
    first = F.row_number().over(w) == 1
    return df.withColumn("island", F.sum(F.when(first | changed, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def undominated(df: DataFrame, keys: list[str], depart: str, arrive: str, tie: str) -> DataFrame:
    """Rows that no later departure of their key beats or equals in arrival."""
    after = W.partitionBy(*keys).orderBy(depart, F.desc(arrive), tie).rowsBetween(1, W.unboundedFollowing)
    return df.withColumn("__least", F.min(arrive).over(after)).filter(F.col("__least").isNull() | (F.col(arrive) < F.col("__least"))).drop("__least")


def asof(left: DataFrame, right: DataFrame, keys: list[str], at: str, values: list[str], forward: bool = False) -> DataFrame:
    """``left`` with the nearest ``right`` row of its key at or before (or at or after) its time, one sort of the union.

    Both sides are tagged and united, so no pair of rows is formed; a right row at the same instant counts.
    """
    time = F.col(at)
    a = left.select(*left.columns, F.lit(None).cast("struct<" + ",".join(f"{v}:{dict(right.dtypes)[v]}" for v in [at, *values]) + ">").alias("hit"), F.lit(1).alias("side"))
    b = right.select(*[F.col(c) if c in (*keys, at) else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in left.columns], F.struct(at, *values).alias("hit"), F.lit(0).alias("side"))
    order = W.partitionBy(*keys).orderBy(time.desc() if forward else time.asc(), "side").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("hit", F.last("hit", ignorenulls=True).over(order)).filter("side = 1")
    return both.select(*left.columns, F.col("hit")[at].alias(f"hit_{at}"), *[F.col("hit")[v].alias(f"hit_{v}") for v in values])


def poisoned_sum(value: Column, order) -> Column:
    """Running sum that is unknown from the first unknown value on."""
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return F.when(F.max(F.when(value.isNull(), 1).otherwise(0)).over(upto) == 0, F.sum(value).over(upto))


def trailing_run(df: DataFrame, keys: list[str], order: list[str], holds: Column) -> DataFrame:
    """The newest rows of each key back to the first at which ``holds`` is false."""
    back = W.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("__broken", F.max(F.when(holds, 0).otherwise(1)).over(back)).filter("__broken = 0").drop("__broken")


def new_reports(df: DataFrame, keys: list[str], at: str, order: list[str]) -> DataFrame:
    """Rows later than everything that their key had before, by arrival order; the first row of a key counts as nothing."""
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("__most", F.max(at).over(before)).filter(F.col(at) > F.col("__most")).drop("__most")


def global_gaps(df: DataFrame, at: str) -> DataFrame:
    """``df`` with ``gap_s``, seconds since the row before in time over the whole table. Rows are ordered within their day; a day's first row meets the last of the day before in a table of days."""
    day = F.to_date(at)
    within = W.partitionBy("__day").orderBy(at)
    rows = df.withColumn("__day", day).withColumn("__before", F.lag(at).over(within))
    days = df.groupBy(day.alias("__day")).agg(F.max(at).alias("__last"))
    days = days.select("__day", F.lag("__last").over(W.orderBy("__day")).alias("__carried"))  # one row a day
    met = rows.join(days, "__day")
    return met.withColumn("gap_s", (F.unix_micros(at) - F.unix_micros(F.coalesce("__before", "__carried"))) / 1e6).drop("__day", "__before", "__carried")


def in_window(df: DataFrame, at: str, start: Column, end: Column, day: str | None = None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included. ``day``: the date column that the files are laid out by, so that other days are not read."""
    kept = df.filter(F.col(at).between(start, end))
    return kept.filter(F.col(day).between(F.to_date(start), F.to_date(end))) if day else kept
