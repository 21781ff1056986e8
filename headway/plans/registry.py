"""Every query of the engine's own operators over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from headway.plans import aggregates, boards, calendar, changes, cycles, estimators, histories, journeys, matching, motion, passages, publishing, relations, release, roads, scoring, sequences, spatial, timetables

QUERIES: dict = {}
ORACLES: dict = {}
for part in (histories, sequences, aggregates, calendar, spatial, boards, estimators, journeys, matching, passages, relations, timetables, cycles, changes, roads, scoring, publishing, motion, release):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
