"""Publications as of their own time: a withdrawn report does not keep the others of its key from ending."""

import random

from pyspark.sql import functions as F

from headway.constants import EXPIRY_S
from headway.operators import replay


def reports(n_keys):
    rng = random.Random(12)
    rows = []
    for vehicle in range(n_keys):
        for k in range(12):
            observed = rng.randrange(0, 1_500_000, 10_000)
            retrieved = observed + rng.randrange(-5_000, 40_000, 5_000)
            rows.append((vehicle, 100 * vehicle + k, observed, retrieved, retrieved + rng.randrange(1, 300_000) if rng.random() < 0.3 else None))
    return rows


def brute(rows, published):
    out = set()
    for p in published:
        for vehicle in {r[0] for r in rows}:
            known = [(-r[2], r[3], r[1]) for r in rows if r[0] == vehicle and r[3] <= p and p - r[2] <= EXPIRY_S * 1000 and (r[4] is None or p < r[4])]
            if known and -min(known)[0] <= p:
                out.add((p, vehicle, min(known)[2]))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vehicle long, event_id long, observed long, retrieved long, withdrawn long")


def test_replayed_as_by_brute_force(spark):
    rows, published = reports(30), list(range(0, 1_600_000, 20_000))
    got = replay.replayed(frame(spark, rows), spark.createDataFrame([(p,) for p in published], "published long"), ["vehicle"], ["event_id"])
    assert {(r["published"], r["vehicle"], r["event_id"]) for r in got.collect()} == brute(rows, published)


def test_states_beside_withdrawn_reports_end_at_the_next(spark):
    rows = [(1, k, 20_000 * k, 20_000 * k, 30_000 if k == 1 else None) for k in range(40)]
    spans = replay.known_states(frame(spark, rows), ["vehicle"], ["event_id"]).select((F.col("known_to") - F.col("known_from")).alias("ms"))
    assert spans.orderBy(F.desc("ms")).collect()[1]["ms"] == 40_000  # all but the last report; the first passes over the withdrawn one
