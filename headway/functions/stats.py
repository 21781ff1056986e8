"""Percentile conventions, each where its results are compared with figures made by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linear(x: Column, q: float) -> Column:
    """Linear interpolation, exact; for groups of a bounded size, since one task holds a group's distinct values. ``quantiles`` splits them."""
    return F.percentile(x, q)


#: Pieces into which the distinct values of one group are dealt for ranking.
PIECES = 64


def ranked_values(df: DataFrame, keys: list[str], value: str, rows: str | None = None) -> DataFrame:
    """keys, value, n, first (0-based rank of its first row), total: the distinct values of each group with their ranks. Nulls of ``value`` are left out.

    rows: the column that says how many rows each row stands for, where they are counted already.

    Rows are counted by value before anything is ordered, so a frequent value is one row. A hot group is dealt to ``PIECES`` ranges
    at approximate quantiles; ranks within a range and the counts of the ranges before it add up to exact ranks, wherever the
    cuts lie. No group is sorted, or held, by one task.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.sum(rows) if rows else F.count(F.lit(1))).alias("n"))
    cuts = F.array(*[F.lit(k / PIECES) for k in range(1, PIECES)])
    bounds = counted.groupBy(*keys).agg(F.percentile_approx(value, cuts, 1000).alias("__cuts"))
    dealt = _joined(counted, bounds, keys).withColumn("__piece", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    before = W.partitionBy(*keys).orderBy("__piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = dealt.groupBy(*keys, "__piece").agg(F.sum("n").alias("__n"))
    pieces = pieces.select(*keys, "__piece", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(W.partitionBy(*keys)).alias("total"))
    within = F.sum("n").over(W.partitionBy(*keys, "__piece").orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    ranked = _joined(dealt.withColumn("__within", within), pieces, [*keys, "__piece"])
    return ranked.select(*keys, value, "n", (F.col("__before") + F.col("__within") - F.col("n")).alias("first"), "total")


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys that may be null."""
    right = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(right, on).drop(*[f"__r_{k}" for k in keys])


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[str, float]], rows: str | None = None) -> DataFrame:
    """keys and one column for each of ``wanted``: name to (convention, fraction), exact, and ``n``, how many values there are. rows: as for ``ranked_values``.

    Conventions: ``index``, the value at int(q * n), the last at most; ``floor``, at floor((n - 1) * q); ``upper``, at floor(n / 2);
    ``linear``, between the two values about (n - 1) * q.
    """
    first, n = F.col("first"), F.col("total")
    holds = lambda rank: F.max(F.when((first <= rank) & (rank < first + F.col("n")), F.col(value)))
    out = []
    for name, (convention, q) in wanted.items():
        if convention == "linear":
            low = F.floor((n - 1) * q)
            part = F.max((n - 1) * q - low)
            a, b = holds(low), holds(F.ceil((n - 1) * q))
            out.append((a + (b - a) * part).alias(name))
        else:
            rank = {"index": F.least(F.floor(n * q), n - 1), "floor": F.floor((n - 1) * q), "upper": F.floor(n / 2)}[convention]
            out.append(holds(rank).alias(name))
    return ranked_values(df, keys, value, rows).groupBy(*keys).agg(*out, F.max("total").alias("n"))


def small_quantile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """keys and ``name``, as ``quantiles`` gives by the convention ``linear``; for groups of a bounded size, each of which is one row."""
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("__all"))
    at = (F.size("__all") - 1) * F.lit(q)
    a, b = F.get("__all", F.floor(at).cast("int")), F.get("__all", F.ceil(at).cast("int"))
    return rows.select(*keys, (a + (b - a) * (at - F.floor(at))).alias(name))


def histogram(df: DataFrame, keys: list[str], value: str, width: float) -> DataFrame:
    """Counts by bin; bin k covers [k, k + 1) widths."""
    return df.groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantile(bins: DataFrame, keys: list[str], q: float, width: float, name: str) -> DataFrame:
    """Lower edge of the first bin at which the cumulative count reaches q of all. One row per key and bin, so windows are small."""
    total, cum = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("bin")
    rows = bins.withColumn("cum", F.sum("n").over(cum)).withColumn("total", F.sum("n").over(total))
    return rows.filter(F.col("cum") >= F.col("total") * q).groupBy(*keys).agg((F.min("bin") * width).alias(name))
