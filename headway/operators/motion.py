"""Where a vehicle is between its reports: an estimate along its road, and a backtest that gives it only what was known at each moment.

A journey's reports are one row (a few hundred at most) and meet their pattern's road in one join, as where passages are inferred. Inside the row each report is a basis once: the reports that
had been fetched by then, the newest ``KEPT_FIXES`` of them, are placed along the road from the newest back, and every setting of the estimator is asked where
the vehicle is at each later report of the next ``AHEAD_S`` seconds. What leaves the row are errors, or, for a grid of settings, sums for each setting; choosing among them, the
error by report's age and how far ahead an estimate is worth anything are aggregates.

The estimate: the speed since the latest jump, over up to ``window`` seconds; a standing vehicle is not moved (or moved on after ``hold`` seconds); with ``dwell`` it pauses at each stop that it
reaches, with ``decay`` its speed eases off as the report ages. Where it declines, the reason is kept.
"""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.constants import KEPT_FIXES, MEAN_RADIUS_M
from headway.functions import stats
from headway.functions.geo import Track
from headway.session import settled

#: Seconds ahead that are scored; ages of reports by which errors are told, (lower, upper]; least errors of an age that count.
AHEAD_S, AGES, LEAST = 120, (10, 20, 30, 45, 60, 90, 120), 20
#: Share above the best mean error within which the least visible moves decide.
WITHIN = 1.02
REASONS = ("no_road", "off_the_road", "too_old", "one_report", "jumped", "too_few_since_jump", "too_close", "too_far_apart", "went_backwards", "standing")


@dataclass(frozen=True)
class Settings:
    """Speeds in m/s, times in s, lengths in m."""

    max_speed: float = 17.0
    still: float = 0.6
    least_span: float = 8.0
    window: float = 45.0
    gap: float = 120.0
    horizon: float = 30.0
    decay: float = 0.0
    stale: float = 150.0
    off_track: float = 40.0
    back: float = 25.0
    dwell: float = 0.0
    stop_tolerance: float = 20.0
    cruise: bool = False
    standing_m: float = 8.0
    hold: float = 0.0


def advance(stops: list[float], s0: float, speed: float, seconds: float, p: Settings) -> float:
    """Where a vehicle at ``s0`` gets to, pausing at each stop that it reaches; one within the tolerance ahead it is at already."""
    if speed <= 0 or seconds <= 0:
        return s0
    s, left = s0, seconds
    if p.dwell > 0:
        for k in range(bisect.bisect_right(stops, s0 + p.stop_tolerance), len(stops)):
            stop = stops[k]
            need = (stop - s) / speed
            if left <= need:
                break
            s, left = stop, left - need
            if left <= p.dwell:
                return s
            left -= p.dwell
    return s + speed * left


def speed_of(at: list[int], along: list[float], p: Settings) -> tuple[float | None, str | None, bool]:
    """(speed, why there is none, whether the last stretch shows it standing) from reports in order of time (ms) and their metres along the road."""
    last, span = len(at) - 1, p.least_span * 1000
    if last < 1:
        return None, "one_report", False

    def readable(j: int) -> int:
        return bisect.bisect_right(at, at[j] - span, 0, j) - 1

    start = 0
    for j in range(last, 0, -1):
        i = readable(j)
        dt = (at[j] - at[i]) / 1000
        if i >= 0 and dt <= p.gap and abs(along[j] - along[i]) / dt > p.max_speed * 1.5:
            start = j
            break
    if start == last:
        return None, "jumped", False
    earlier = [i for i in range(start, last) if at[last] - at[i] >= span]
    if not earlier:
        return None, "too_few_since_jump" if start else "too_close", False
    first = next((i for i in earlier if at[last] - at[i] <= p.window * 1000), earlier[-1])
    dt, ds = (at[last] - at[first]) / 1000, along[last] - along[first]
    if dt > p.gap:
        return None, "too_far_apart", False
    if ds < -p.back:
        return None, "went_backwards", False
    chain, i = [last], readable(last)
    while i >= first:
        chain.append(i)
        i = readable(i)
    steps = [(along[j] - along[i], (at[j] - at[i]) / 1000) for j, i in itertools.pairwise(chain)]
    moving = [(d, t) for d, t in steps if d >= p.standing_m]
    metres, seconds = sum(d for d, _ in moving), sum(t for _, t in moving)
    standing = bool(steps) and steps[0][0] < p.standing_m
    speed = max(0.0, ds) / dt
    if speed < p.still:
        return 0.0, None, standing
    if p.cruise and seconds >= p.least_span:
        return min(p.max_speed, metres / seconds), None, standing
    return min(speed, p.max_speed), None, standing


def estimate(at: list[int], along: list[float], off: float, when: int, length: float, stops: list[float], p: Settings) -> tuple[float | None, str | None]:
    """(metres along the road, why there is none) of a vehicle at ``when``, from reports known by then; ``off``: how far the newest lies from the road."""
    return _estimate(Placed(at, along, off), when, length, stops, p)


def _estimate(known: Placed, when: int, length: float, stops: list[float], p: Settings) -> tuple[float | None, str | None]:
    age = max(0.0, (when - known.at[-1]) / 1000)
    if known.off > p.off_track:
        return None, "off_the_road"
    if age > p.stale:
        return None, "too_old"
    speed, reason, standing = known.speed(p)
    if speed is None:
        return None, reason
    if standing and speed > 0 and p.hold == 0:
        return None, "standing"
    ahead, s = min(age, p.horizon), known.along[-1]
    if standing and speed > 0:
        s = advance(stops, s, speed, ahead - p.hold, p)
    elif speed > 0:
        s = advance(stops, s, speed, p.decay * (1 - math.exp(-ahead / p.decay)) if p.decay > 0 else ahead, p)
    return min(length, max(0.0, s)), None


def metres_between(a: tuple[float, float], b: tuple[float, float]) -> float:
    return math.hypot(math.radians(b[1] - a[1]) * math.cos(math.radians((a[0] + b[0]) / 2)), math.radians(b[0] - a[0])) * MEAN_RADIUS_M


class Placed:
    """Reports known at a moment along the road; a speed is worked out once for all settings that read it alike."""

    def __init__(self, at: list[int], along: list[float], off: float):
        self.at, self.along, self.off = at, along, off
        self.speeds: dict[tuple, tuple] = {}

    @staticmethod
    def reads(p: Settings) -> tuple:
        """What a speed depends on."""
        return p.max_speed, p.still, p.least_span, p.window, p.gap, p.back, p.standing_m, p.cruise

    def speed(self, p: Settings) -> tuple[float | None, str | None, bool]:
        key = self.reads(p)
        if key not in self.speeds:
            self.speeds[key] = speed_of(self.at, self.along, p)
        return self.speeds[key]


#: Moments of a journey at which all settings are asked at once.
CASES = 1 << 11


class Family:
    """Settings as columns, so that all of them are asked at once what ``_estimate`` asks one."""

    def __init__(self, settings: list[Settings]):
        self.settings = settings
        self.horizon, self.decay, self.stale, self.off_track, self.dwell, self.tolerance, self.hold = (
            np.array([float(getattr(p, name)) for p in settings]) for name in ("horizon", "decay", "stale", "off_track", "dwell", "stop_tolerance", "hold")
        )
        #: Settings that read speeds differently, and which of them each setting reads as.
        readers = {Placed.reads(p): p for p in settings}
        self.readers, places = list(readers.values()), {key: i for i, key in enumerate(readers)}
        self.reader = np.array([places[Placed.reads(p)] for p in settings], int)

    def estimates(self, cases: list[Placed], when: list[int], length: float, stops: list[float]) -> np.ndarray:
        """Metres along the road by case and setting, NaN where there is no estimate."""
        read = [[known.speed(p) for p in self.readers] for known in cases]
        speed = np.array([[math.nan if v is None else v for v, _, _ in row] for row in read])[:, self.reader]
        held = np.array([[standing for _, _, standing in row] for row in read])[:, self.reader] & (speed > 0)
        age = np.array([max(0.0, (w - known.at[-1]) / 1000) for known, w in zip(cases, when, strict=True)])[:, None]
        off, s0 = np.array([known.off for known in cases])[:, None], np.array([known.along[-1] for known in cases])[:, None]
        none = np.isnan(speed) | (off > self.off_track) | (age > self.stale) | (held & (self.hold == 0))
        ahead = np.minimum(age, self.horizon)
        eased = np.where(self.decay > 0, self.decay * (1 - np.exp(-ahead / np.where(self.decay > 0, self.decay, 1))), ahead)
        s = self.advance(np.array(stops, float), s0, np.where(none, 0, speed), np.where(held, ahead - self.hold, eased))
        return np.where(none, np.nan, np.minimum(length, np.maximum(0.0, s)))

    def advance(self, stops: np.ndarray, s0: np.ndarray, speed: np.ndarray, seconds: np.ndarray) -> np.ndarray:
        """As ``advance`` one stop at a time, for those that still move."""
        going = (speed > 0) & (seconds > 0)
        s, left = np.broadcast_to(s0, speed.shape).copy(), np.where(going, seconds, 0)
        row, column = np.nonzero(going & (self.dwell > 0))
        k = np.searchsorted(stops, s0[row, 0] + self.tolerance[column], "right")
        while len(row):
            ends = k < len(stops)
            row, column, k = row[ends], column[ends], k[ends]
            here, rest, stop = s[row, column], left[row, column], stops[k]
            need = (stop - here) / speed[row, column]
            reached = rest > need
            row, column, k, rest = row[reached], column[reached], k[reached] + 1, (rest - need)[reached]
            s[row, column] = stop[reached]
            pausing = rest <= self.dwell[column]
            left[row, column] = np.where(pausing, 0, rest - self.dwell[column])
            row, column, k = row[~pausing], column[~pausing], k[~pausing]
        return s + speed * left


class Journey:
    """A journey's reports (at, available, lat, lon) in order of their own time, one for each, and its road if it has one.

    Every report is sought on the whole road once. Which reports were known is read backwards from a report, and what was later but known before it from the
    earliest ``available`` after it, so a journey takes time by its reports and the pairs it is asked for.
    """

    def __init__(self, reports: list[dict], lats: list[float] | None, lons: list[float] | None, stops: list[float] | None):
        once: dict[int, dict] = {}
        for r in reports:
            once.setdefault(r["at"], r)
        fixes = [once[t] for t in sorted(once)]
        self.at, self.available = [f["at"] for f in fixes], [f["available"] for f in fixes]
        self.points = [(f["lat"], f["lon"]) for f in fixes]
        #: Of each report: when the first of those after it had been fetched.
        self.next_known: list[float] = [math.inf] * len(fixes)
        for k in range(len(fixes) - 2, -1, -1):
            self.next_known[k] = min(self.next_known[k + 1], self.available[k + 1])
        self.track = Track(lats, lons) if lats is not None and len(lats) > 1 else None
        self.stops = sorted(stops or [])
        self.length = float(self.track.length[-1]) if self.track else 0.0
        self.cases: dict[int, Placed] = {}

    @cached_property
    def on_road(self) -> list[tuple[int, float, float]]:
        """(segment, metres along, metres off) of the nearest point of the whole road to each report."""
        return self.track.project_all(self.points)

    def newest(self, k: int) -> bool:
        """Whether report ``k`` was the newest when it was fetched."""
        return self.next_known[k] > self.available[k]

    def known(self, k: int, by: int, before: bool = False) -> list[int]:
        """The newest reports up to ``k`` fetched by a moment, newest first."""
        out = []
        while k >= 0 and len(out) < KEPT_FIXES:
            if self.available[k] < by or (self.available[k] == by and not before):
                out.append(k)
            k -= 1
        return out

    def placed(self, known: list[int]) -> Placed:
        """Times, metres along, and how far the newest is off the road; each report is sought near the one after it."""
        _, s, off = self.on_road[known[0]]
        along = [s]
        for k in known[1:]:
            near = along[-1] - 50
            segment, s, here = self.on_road[k]
            first, last = self.track.segment(max(0.0, near - 400)), self.track.segment(min(self.length, near + 3000)) + 1
            if not first <= segment < last:
                local = self.track.project(*self.points[k], first, last)
                s = local[0] if local[1] <= here + 25 else s
            along.append(s)
        return Placed([self.at[k] for k in reversed(known)], along[::-1], off)

    def case(self, k: int) -> Placed:
        """What was known when report ``k``, the newest then, was fetched."""
        if k not in self.cases:
            self.cases[k] = self.placed(self.known(k, self.available[k]))
        return self.cases[k]

    @cached_property
    def arrivals(self) -> list[tuple[int, Placed, Placed]]:
        """(when, reports placed before, and with it) of every report that was the newest when it was fetched."""
        out = []
        for k in range(1, len(self.at)) if self.track else ():
            if self.newest(k) and (before := self.known(k - 1, self.available[k], before=True)):
                out.append((self.available[k], self.placed(before), self.case(k)))
        return out

    def pairs(self, ahead_s: int) -> Iterator[tuple[int, int]]:
        """(basis, target) of every report that was the newest when it was fetched and each later one of the next ``ahead_s`` seconds."""
        for k, at in enumerate(self.at):
            end = bisect.bisect_right(self.at, at + ahead_s * 1000)
            if end > k + 1 and self.newest(k):
                for t in range(k + 1, end):
                    yield k, t

    def errors(self, p: Settings, ahead_s: int = AHEAD_S) -> Iterator[tuple[int, int, float, float | None, str | None]]:
        """(basis, target, metres from basis to target, metres from the estimate to the target, why there is none) of reports by their places."""
        for k, t in self.pairs(ahead_s):
            there = self.points[t]
            stay = metres_between(self.points[k], there)
            if not self.track:
                yield k, t, stay, None, "no_road"
                continue
            s, reason = _estimate(self.case(k), self.at[t], self.length, self.stops, p)
            yield k, t, stay, None if s is None else metres_between(self.track.point_at(s), there), reason

    def moves(self, p: Settings) -> Iterator[float]:
        """How far the estimate moves along the road whenever a newest report is fetched."""
        for when, before, after in self.arrivals:
            (a, _), (b, _) = (_estimate(known, when, self.length, self.stops, p) for known in (before, after))
            if a is not None and b is not None:
                yield b - a

    def totals(self, family: Family, ahead_s: int) -> np.ndarray:
        """(estimates, sum of their errors, moves, sum of their sizes) by setting: what ``errors`` and ``moves`` give, for the whole family at once."""
        out = np.zeros((4, len(family.settings)))
        pairs = self.pairs(ahead_s) if self.track else iter(())
        while part := list(itertools.islice(pairs, CASES)):
            s = family.estimates([self.case(k) for k, _ in part], [self.at[t] for _, t in part], self.length, self.stops)
            lat, lon = self.track.points_at(np.nan_to_num(s))
            there = np.array([self.points[t] for _, t in part])[:, :, None]
            east = np.radians(there[:, 1] - lon) * np.cos(np.radians((lat + there[:, 0]) / 2))
            error = np.hypot(east, np.radians(there[:, 0] - lat)) * MEAN_RADIUS_M
            held = ~np.isnan(s)
            out[:2] += held.sum(0), np.where(held, error, 0).sum(0)
        for first in range(0, len(self.arrivals), CASES):
            part = self.arrivals[first : first + CASES]
            before, after = (family.estimates([a[i] for a in part], [a[0] for a in part], self.length, self.stops) for i in (1, 2))
            out[2:] += (~np.isnan(after - before)).sum(0), np.nansum(np.abs(after - before), 0)
        return out


def _journeys(batch: pa.RecordBatch) -> Iterator[tuple[int, Journey]]:
    columns = [batch.column(c) for c in ("reports", "lats", "lons", "stops")]
    for k in range(len(batch)):  # a row at a time, so that only one journey's reports are Python objects
        yield k, Journey(*(c[k].as_py() for c in columns))


def _with_roads(reports: DataFrame, roads: DataFrame) -> DataFrame:
    rows = reports.groupBy("journey", "pattern_id").agg(F.array_sort(F.collect_list(F.struct("at", "available", "lat", "lon"))).alias("reports"))
    rows = rows.join(roads.select("pattern_id", "lats", "lons", "stops"), "pattern_id", "left").select("journey", "pattern_id", "reports", "lats", "lons", "stops")
    # by count, since rows of few bytes would be put together into few tasks, and their work is long
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "journey", "pattern_id")


#: Rows that leave a task at a time.
PORTION = 1 << 16


def scores(reports: DataFrame, roads: DataFrame, p: Settings) -> DataFrame:
    """(journey, basis_at, target_at, horizon_s, error_m, baseline_m, reason): every later report within ``AHEAD_S`` of a report, as foretold from what was known.

    reports: journey, pattern_id, at, available (ms), lat, lon; roads: pattern_id, lats, lons, stops (metres along). The baseline is the distance from the last report itself.
    """
    kind = dict(reports.dtypes)["journey"]
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string())

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = ((k, j.at[b], j.at[t], (j.at[t] - j.at[b]) / 1000, e, stay, why) for k, j in _journeys(batch) for b, t, stay, e, why in j.errors(p))
            while out := list(itertools.islice(found, PORTION)):
                columns = list(zip(*out, strict=True))
                arrays = [batch.column("journey").take(pa.array(columns[0], pa.int64()))] + [pa.array(c, t) for c, t in zip(columns[1:], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["journey", "basis_at", "target_at", "horizon_s", "error_m", "baseline_m", "reason"])

    return _with_roads(reports, roads).mapInArrow(of, f"journey {kind}, basis_at long, target_at long, horizon_s double, error_m double, baseline_m double, reason string")


def grid(base: Settings = Settings()) -> list[Settings]:
    """The family of settings that is tried."""
    return [replace(base, cruise=c, hold=h, decay=e, dwell=d) for c in (False, True) for h in (0.0, 15.0) for e in (0.0, 45.0, 60.0, 90.0, 120.0) for d in (0.0, 6.0, 10.0, 15.0, 20.0)]


def compared(reports: DataFrame, roads: DataFrame, settings: list[Settings]) -> DataFrame:
    """(setting, n, mean_m, moves, mean_move_m): mean error up to a minute ahead and the mean size of visible moves of each setting, by its place in the list."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, sums = Family(settings), np.zeros((4, len(settings)))
        for batch in batches:
            for _, j in _journeys(batch):
                sums += j.totals(family, 60)
        kinds = (np.int64, np.float64, np.int64, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(settings)), pa.int32()), *(pa.array(s.astype(t)) for s, t in zip(sums, kinds, strict=True))], names=["setting", "n", "e", "moves", "m"])

    parts = _with_roads(reports, roads).mapInArrow(of, "setting int, n long, e double, moves long, m double").groupBy("setting").agg(*[F.sum(c).alias(c) for c in ("n", "e", "moves", "m")])
    return parts.select("setting", "n", (F.col("e") / F.greatest("n", F.lit(1))).alias("mean_m"), "moves", (F.col("m") / F.greatest("moves", F.lit(1))).alias("mean_move_m"))


def chosen(table: DataFrame) -> DataFrame:
    """The row of ``compared`` that is taken: of those within ``WITHIN`` of the best mean error, the one whose estimates move least when a report arrives, then the first."""
    best = table.filter("n > 0").agg((F.min("mean_m") * WITHIN).alias("most"))
    return table.crossJoin(best).filter("n > 0 AND mean_m <= most").drop("most").orderBy("mean_move_m", "setting").limit(1)  # one row for each setting


def age_bin(horizon_s: Column) -> Column:
    out = F.lit(None).cast("int")
    for upper in reversed(AGES):
        out = F.when(horizon_s <= upper, upper).otherwise(out)
    return out


def profile(rows: DataFrame) -> DataFrame:
    """(up_to, n, p50, p80, baseline_p50, better) by the report's age; ``rows`` as ``scores`` gives them."""
    held = rows.filter("error_m IS NOT NULL").withColumn("up_to", age_bin(F.col("horizon_s"))).filter("up_to IS NOT NULL AND horizon_s > 0")
    held = settled(held.select("up_to", "error_m", "baseline_m"))  # six aggregates read what the journeys are asked once for
    model = stats.quantiles(held, ["up_to"], "error_m", {"p50": ("linear", 0.5), "p80": ("linear", 0.8)})
    base = stats.quantiles(held, ["up_to"], "baseline_m", {"baseline_p50": ("linear", 0.5)}).drop("n")
    better = held.groupBy("up_to").agg(F.avg((F.col("error_m") < F.col("baseline_m")).cast("double")).alias("better"))
    return model.join(base, "up_to").join(better, "up_to")


def supported_horizon(bins: DataFrame) -> DataFrame:
    """(horizon_s): the longest run of ages, from the first, at which the estimate's median error beats the last report's; 0 where there is none. One row."""
    table = bins.sparkSession.createDataFrame([(b,) for b in AGES], "up_to int").join(bins, "up_to", "left")
    good = F.coalesce((F.col("n") >= LEAST) & (F.col("p50") < F.col("baseline_p50")), F.lit(False))
    first_bad = table.agg(F.min(F.when(~good, F.col("up_to"))).alias("bad"))
    return table.crossJoin(first_bad).agg(F.coalesce(F.max(F.when(F.col("bad").isNull() | (F.col("up_to") < F.col("bad")), F.col("up_to"))), F.lit(0)).alias("horizon_s"))  # seven rows
