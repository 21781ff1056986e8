"""Operating rules: on which service days a journey runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RULE = (
    "struct<days:array<int>,holidaysOnly:boolean,alsoOn:array<struct<start:date,end:date>>,notOn:array<struct<start:date,end:date>>,"
    "serviced:array<struct<mode:string,kind:string,organisations:array<string>,ranges:array<struct<start:date,end:date>>>>,bankHolidays:string>"
)


def within(day: Column, ranges: Column) -> Column:
    """Whether a day lies in one of the ranges; a range without an end is its one day."""
    return F.coalesce(F.exists(ranges, lambda r: (day >= r["start"]) & (day <= F.coalesce(r["end"], r["start"]))), F.lit(False))


def rule_applies(rule: Column, day: Column) -> Column:
    """Exclusions first, then added days, then weekdays (Monday is 0), and of those only what every serviced organisation allows."""
    only = F.filter(rule["serviced"], lambda s: s["mode"] == "only")
    barred = F.coalesce(F.exists(F.filter(rule["serviced"], lambda s: s["mode"] == "except"), lambda s: within(day, s["ranges"])), F.lit(False))
    allowed = F.coalesce(F.forall(only, lambda s: within(day, s["ranges"])), F.lit(True))
    weekly = F.coalesce(F.array_contains(rule["days"], F.weekday(day)), F.lit(False))
    return F.when(within(day, rule["notOn"]), False).when(within(day, rule["alsoOn"]), True).otherwise(weekly & allowed & ~barred)


def runs_on(rules: Column, day: Column) -> Column:
    """Whether any rule applies; unknown where there are no rules at all."""
    return F.when(rules.isNotNull(), F.coalesce(F.exists(rules, lambda r: rule_applies(r, day)), F.lit(False)))


def valid_on(start: Column, end: Column, day: Column) -> Column:
    """An open end does not limit."""
    return F.coalesce(day >= start, F.lit(True)) & F.coalesce(day <= end, F.lit(True))
