"""Distances and headings as column expressions; polylines as Arrow functions."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headway.constants import DEGREE_M, RADIUS_M


def metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_M) -> Column:
    """Equirectangular distance with the cosine at the middle latitude."""
    x = F.radians(lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(x, F.radians(lat2 - lat1)) * radius


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north)


def heading(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2((lon2 - lon1) * F.cos(F.radians((lat1 + lat2) / 2)), lat2 - lat1)), F.lit(360.0))


def turn(a: Column, b: Column) -> Column:
    """The smallest angle between two headings."""
    d = F.pmod(a - b, F.lit(360.0))
    return F.least(d, F.lit(360.0) - d)


def decode_polyline(text: str, precision: int = 6) -> np.ndarray:
    """Points (lat, lon) of an encoded polyline."""
    values, value, shift = [], 0, 0
    for c in text.encode():
        c -= 63
        value |= (c & 31) << shift
        shift += 5
        if c < 32:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            value = shift = 0
    return np.cumsum(np.array(values, np.int64).reshape(-1, 2), axis=0) / 10**precision


def encode_polyline(points: np.ndarray, precision: int = 6) -> str:
    whole = np.floor(np.asarray(points) * 10**precision + 0.5).astype(np.int64)
    steps = np.diff(whole, axis=0, prepend=np.zeros((1, 2), np.int64)).ravel()
    out = []
    for step in steps:
        value = ~(int(step) << 1) if step < 0 else int(step) << 1
        while value >= 32:
            out.append(chr((value & 31 | 32) + 63))
            value >>= 5
        out.append(chr(value + 63))
    return "".join(out)


class Track:
    """A polyline with cumulative metres. A segment's metres to a degree of longitude are those at its start."""

    def __init__(self, lats, lons, degree: float = DEGREE_M):
        self.at = np.stack([np.asarray(lats, np.float64), np.asarray(lons, np.float64)], axis=1)
        self.scale = np.stack([np.full(len(self.at) - 1, degree), degree * np.cos(np.radians(self.at[:-1, 0]))], axis=1)
        self.steps = np.diff(self.at, axis=0) * self.scale
        self.square = (self.steps**2).sum(1)
        self.length = np.concatenate([[0.0], np.cumsum(np.sqrt(self.square))])

        self.points, self.ends = self.at.tolist(), self.length.tolist()

    def segment(self, s: float) -> int:
        return max(0, min(bisect.bisect_right(self.ends, s) - 1, len(self.ends) - 2))

    def project(self, lat: float, lon: float, first: int = 0, last: int | None = None) -> tuple[float, float]:
        """Metres along and off the track of its point nearest to (lat, lon), among the segments from ``first`` up to ``last``."""
        part = slice(first, last)
        p = (np.array([lat, lon]) - self.at[:-1][part]) * self.scale[part]
        d, square = self.steps[part], self.square[part]
        t = np.clip(np.where(square > 0, (p * d).sum(1) / np.where(square > 0, square, 1), 0), 0, 1)
        off = np.hypot(*(p - d * t[:, None]).T)
        k = int(np.argmin(off))
        return float(self.length[first + k] + t[k] * math.sqrt(square[k])), float(off[k])

    def project_all(self, points: list[tuple[float, float]], rows: int = 256) -> list[tuple[int, float, float]]:
        """Segment, metres along and metres off of every point, as ``project`` gives them; ``rows`` points at a time."""
        out = []
        root = np.sqrt(self.square)
        for k in range(0, len(points), rows):
            p = np.asarray(points[k : k + rows], np.float64)[:, None, :] - self.at[:-1]
            y, x = p[..., 0] * self.scale[:, 0], p[..., 1] * self.scale[:, 1]
            along = y * self.steps[:, 0] + x * self.steps[:, 1]
            t = np.clip(np.where(self.square > 0, along / np.where(self.square > 0, self.square, 1), 0), 0, 1)
            off = np.hypot(y - self.steps[:, 0] * t, x - self.steps[:, 1] * t)
            best = off.argmin(1)
            here = np.arange(len(best))
            out += zip(best.tolist(), (self.length[best] + t[here, best] * root[best]).tolist(), off[here, best].tolist(), strict=True)
        return out

    def project_near(self, lat: float, lon: float, near: float | None, back: float = 600.0, ahead: float = 3000.0, accept: float = 25.0) -> tuple[float, float]:
        """As ``project``, first about where the last point was; the whole track where nothing there is close enough."""
        if near is not None:
            found = self.project(lat, lon, max(0, self.segment(near - back) - 1), self.segment(near + ahead) + 1)
            if found[1] <= accept:
                return found
        return self.project(lat, lon)

    def point_at(self, s: float) -> tuple[float, float]:
        k = self.segment(s)
        part = self.ends[k + 1] - self.ends[k]
        t = min(1.0, max(0.0, (s - self.ends[k]) / part)) if part else 0.0
        (y, x), (north, east) = self.points[k], self.points[k + 1]
        return y + t * (north - y), x + t * (east - x)

    def points_at(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``point_at``, of many places: (lats, lons)."""
        k = np.clip(np.searchsorted(self.length, s, "right") - 1, 0, len(self.length) - 2)
        part = self.length[k + 1] - self.length[k]
        t = np.clip(np.where(part > 0, (s - self.length[k]) / np.where(part > 0, part, 1), 0), 0, 1)
        (y, x), (north, east) = (np.moveaxis(self.at[i], -1, 0) for i in (k, k + 1))
        return y + t * (north - y), x + t * (east - x)

    def heading_at(self, s: float) -> float:
        """Degrees clockwise from north of the segment at ``s``."""
        north, east = self.steps[self.segment(s)]
        return math.degrees(math.atan2(east, north)) % 360


POINTS = T.ArrayType(T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())]))


@F.pandas_udf(POINTS)
def polyline_points(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [{"lat": float(a), "lon": float(b)} for a, b in decode_polyline(t)])
