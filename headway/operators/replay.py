"""Past publications, each rebuilt from what was known at its own time.

A report has two times: when it was observed and when it was retrieved. A vehicle's newest report changes only when a later one is retrieved, so the state between two changes is one
segment of known time, and a publication meets the segments that hold at its moment: one row for each vehicle that it shows, however many reports there are.
A report that a conflict withdraws later counts until the conflict was detected and not after; only the vehicles of such reports are read report by report.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from headway.constants import EXPIRY_S
from headway.operators.quality import freshness
from headway.operators.spatial import meets

#: Width in ms of the cells of time through which states meet publications.
CELL_MS = 60_000
#: Shares into which the states are dealt by key: all keys meet the same publications, which a cell of time alone would bring to one task. Each publication is as many rows.
SHARES = 64


def known_states(reports: DataFrame, keys: list[str], values: list[str], expiry_ms: int = EXPIRY_S * 1000) -> DataFrame:
    """(keys, observed, retrieved, values, known_from, known_to) of the newest report of each key while it is the newest known and no older than ``expiry_ms``.

    reports: keys, observed, retrieved, values, withdrawn (ms, or null). Of reports observed at one time the first retrieved counts, then the smallest values.
    """
    held = F.max("withdrawn").over(W.partitionBy(*keys)).isNotNull()
    rows = reports.select(*keys, "observed", "retrieved", *values, "withdrawn").withColumn("__held", held)
    order = W.partitionBy(*keys).orderBy("retrieved", "observed", *values)
    rank = F.struct("observed", (-F.col("retrieved")).alias("first"))
    calm = rows.filter(~F.col("__held")).withColumn("__before", F.max(rank).over(order.rowsBetween(W.unboundedPreceding, -1)))
    calm = calm.filter(F.col("__before").isNull() | (rank > F.col("__before")))
    calm = calm.withColumn("known_to", F.least(F.coalesce(F.lead("retrieved").over(order), F.col("observed") + expiry_ms + 1), F.col("observed") + expiry_ms + 1))
    out = calm.select(*keys, "observed", "retrieved", *values, F.col("retrieved").alias("known_from"), "known_to", F.lit(False).alias("several"))
    # a report that is not withdrawn outlives all that were observed before it, which end when it is known
    later = W.partitionBy(*keys).orderBy(F.desc("observed")).rangeBetween(W.unboundedPreceding, -1)
    torn = rows.filter("__held").withColumn("__after", F.min(F.when(F.col("withdrawn").isNull(), F.col("retrieved"))).over(later))
    torn = torn.withColumn("known_to", F.least("withdrawn", F.col("observed") + expiry_ms + 1, "__after"))
    torn = torn.select(*keys, "observed", "retrieved", *values, F.col("retrieved").alias("known_from"), "known_to", F.lit(True).alias("several"))
    return out.unionByName(torn).filter("known_from < known_to")


def replayed(reports: DataFrame, publications: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(published, keys, observed, retrieved, values, age_s, freshness): what each publication (published, ms) shows, with no later knowledge. Reports of later than the publication are withheld."""
    states = known_states(reports, keys, values)
    dealt = states.withColumn("__share", F.pmod(F.xxhash64(*keys), F.lit(SHARES)))
    each = publications.select("published").distinct().withColumn("__share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    met = meets(dealt, each, "known_from", "known_to", "published", CELL_MS, ("__share",)).drop("__share")
    newest = F.row_number().over(W.partitionBy("published", *keys).orderBy(F.desc("observed"), "retrieved", *values))
    one = met.filter("NOT several").unionByName(met.filter("several").withColumn("__k", newest).filter("__k = 1").drop("__k"))
    age: Column = (F.col("published") - F.col("observed")) / 1000
    shown = one.withColumn("age_s", age).filter("age_s >= 0")
    return shown.select("published", *keys, "observed", "retrieved", *values, "age_s", freshness(F.col("age_s")).alias("freshness"))

