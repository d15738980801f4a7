"""Which modes a stop is served by, and stations as clusters of stops."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classify as K
from ..functions import text as X
from . import graph


def stop_route_types(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Distinct (stop_id, route_type). Routes are few and trips many, so trips meet routes
    first and only two columns of the long table travel."""
    typed = trips.select("trip_id", "route_id").join(routes.select("route_id", "route_type"), "route_id").select("trip_id", "route_type")
    return stop_times.select("trip_id", "stop_id").join(typed, "trip_id").select("stop_id", "route_type").distinct()


def stop_modes(types: DataFrame) -> DataFrame:
    """Distinct (stop_id, mode) of the kept route types."""
    return types.withColumn("mode", K.lookup("route_type", K.ROUTE_MODES)).filter(F.col("mode").isNotNull()).select("stop_id", "mode").distinct()


def excluded_stops(types: DataFrame) -> DataFrame:
    """Stops of the route types left out on purpose, counted apart."""
    t = types.withColumn("label", K.lookup("route_type", K.EXCLUDED_ROUTES)).filter(F.col("label").isNotNull())
    return t.groupBy("route_type", "label").agg(F.count(F.lit(1)).alias("stops"))


def stations(stops: DataFrame, modes: DataFrame, radius_by_mode: dict[str, float], default_radius: float) -> DataFrame:
    """Clusters of stops with the same name key and mode; every mode has its own radius."""
    named = X.with_unicode_form(stops, "stop_name", "_nfc").withColumn("key", X.stop_name_key(F.col("_nfc"))).drop("_nfc")
    pts = named.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).join(modes, "stop_id").select(
        F.col("stop_id").alias("id"), "key", "mode", "lat", "lon", X.display_name(F.col("stop_name")).alias("shown")
    )
    radius = F.coalesce(K.lookup("mode", radius_by_mode), F.lit(default_radius))
    return graph.single_linkage(pts, ["key", "mode"], radius)


def station_points(clustered: DataFrame) -> DataFrame:
    return graph.cluster_summary(clustered, ["key", "mode"], "shown")


def stop_counts(modes: DataFrame, station_rows: DataFrame) -> DataFrame:
    """Stops and stations per mode, and how many of the stops serve several modes."""
    several = modes.groupBy("stop_id").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 1)
    flagged = modes.join(several.select("stop_id", F.lit(1).alias("multi")), "stop_id", "left")
    before = flagged.groupBy("mode").agg(F.count(F.lit(1)).alias("stops_before"), F.count("multi").alias("multi_mode_stops"))
    after = station_rows.groupBy("mode").agg(F.count(F.lit(1)).alias("points_after"))
    return before.join(after, "mode", "left").withColumn("points_after", F.coalesce("points_after", F.lit(0).cast("long")))
