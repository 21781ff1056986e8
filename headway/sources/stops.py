"""The national stop register: its CSV columns, which stops are kept, and why others are refused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.constants import SERVICE_BOX
from headway.functions.geo import in_box

COLUMNS = (
    "ATCOCode", "NaptanCode", "CommonName", "Indicator", "Street", "Landmark", "Bearing", "LocalityName",
    "ParentLocalityName", "Longitude", "Latitude", "StopType", "BusStopType", "Status", "ModificationDateTime",
)
BUS_STOP_TYPES = ("BCT", "BCS", "BCQ")


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; what is a number is judged by ``judged``."""
    return spark.read.option("header", True).option("enforceSchema", False).csv(path).select(*COLUMNS)


def judged(stops: DataFrame, box=SERVICE_BOX) -> DataFrame:
    """Every stop with lat, lon and ``reason``: the first rule it fails, or null where it is kept."""
    lat, lon = F.col("Latitude").try_cast("double"), F.col("Longitude").try_cast("double")
    reason = (
        F.when(~F.coalesce(F.col("StopType").isin(*BUS_STOP_TYPES), F.lit(False)), "not_a_bus_stop")
        .when(F.coalesce(F.lower(F.trim("Status")), F.lit("")) != "active", "not_active")
        .when(lat.isNull() | lon.isNull(), "unreadable_coordinate")
        .when(~in_box(lat, lon, box), "outside_collected_area")
        .when(F.coalesce(F.trim("CommonName"), F.lit("")) == "", "missing_name")
    )
    return stops.withColumns({"lat": lat, "lon": lon, "reason": reason})


def refusals(stops: DataFrame) -> DataFrame:
    return stops.filter("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
