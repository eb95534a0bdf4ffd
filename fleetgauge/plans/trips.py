"""Example workload queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.operators import trips as ops
from fleetgauge.plans.registry import query
from fleetgauge.session import new_folder
from fleetgauge.sources import fixtures, landing

TRIPS_SQL = """
    SELECT strftime(ts, '%-m/%-d/%Y %-H:%M:%S') AS date_time, value AS lat,
           -value - 1.0 AS lon, event_type AS base
    FROM events
"""


def _landed(spark, sf_dir):
    """Write the trips as CSV files, as the example reads them."""
    folder = new_folder(spark, "trips")
    fixtures.trip_texts(spark, sf_dir).write.csv(folder, header=True)
    return folder


def _named(df):
    return df.select(
        F.col("`Date/Time`").alias("date_time"), F.col("Lat").alias("lat"),
        F.col("Lon").alias("lon"), F.col("Base").alias("base"),
    )


@query("csv_scan_infer", TRIPS_SQL)
def csv_scan_infer(spark, sf_dir):
    return _named(landing.read_trips(spark, _landed(spark, sf_dir)))


@query("csv_scan_schema", TRIPS_SQL)
def csv_scan_schema(spark, sf_dir):
    return _named(landing.read_trips(spark, _landed(spark, sf_dir), schemas.TRIPS))


@query("trip_time_parts", """
    SELECT strftime(ts, '%Y-%m-%d') AS trip_date, strftime(ts, '%H:%M:%S') AS trip_time,
           CAST(hour(ts) AS BIGINT) AS pickup_hour, event_type AS base
    FROM events
""")
def trip_time_parts(spark, sf_dir):
    parts = ops.trip_time_parts(fixtures.trip_texts(spark, sf_dir))
    return parts.select(
        F.col("Date").cast("string").alias("trip_date"),
        F.col("Time").alias("trip_time"),
        F.col("pickup_hour").cast("bigint").alias("pickup_hour"),
        F.col("Base").alias("base"),
    )


def _parts(spark, sf_dir):
    return ops.trip_time_parts(fixtures.trips(spark, sf_dir))


@query("row_count", "SELECT CAST(count(*) AS BIGINT) AS total_rows FROM events")
def row_count(spark, sf_dir):
    return ops.row_count(fixtures.trips(spark, sf_dir))


@query("trips_per_day", """
    SELECT strftime(ts, '%Y-%m-%d') AS trip_date, CAST(count(*) AS BIGINT) AS total_trips
    FROM events GROUP BY 1 ORDER BY total_trips DESC, trip_date
""")
def trips_per_day(spark, sf_dir):
    return ops.trips_per_day(_parts(spark, sf_dir)).select(
        F.col("Date").cast("string").alias("trip_date"), "total_trips"
    )


@query("trips_per_base", """
    SELECT event_type AS base, CAST(count(*) AS BIGINT) AS total_trips
    FROM events GROUP BY 1 ORDER BY total_trips DESC, base
""")
def trips_per_base(spark, sf_dir):
    return ops.trips_per_base(_parts(spark, sf_dir)).select(
        F.col("Base").alias("base"), "total_trips"
    )


@query("trips_per_hour", """
    SELECT CAST(hour(ts) AS BIGINT) AS pickup_hour, CAST(count(*) AS BIGINT) AS trips
    FROM events GROUP BY 1 ORDER BY 1
""")
def trips_per_hour(spark, sf_dir):
    return ops.trips_per_hour(_parts(spark, sf_dir)).select(
        F.col("pickup_hour").cast("bigint").alias("pickup_hour"), "trips"
    )


CENTS = "CAST(round(value * 100) AS BIGINT) % 50"


@query("csv_scan_faults", f"""
    SELECT CASE WHEN {CENTS} = 7 THEN 'number' WHEN {CENTS} = 9 THEN 'fields' END AS fault,
           CAST(dayofweek(ts) + 1 AS BIGINT) AS day, CAST(count(*) AS BIGINT) AS lines,
           CAST(count(*) FILTER (WHERE {CENTS} <> 7) AS BIGINT) AS with_lat,
           CAST(count(*) FILTER (WHERE {CENTS} <> 9) AS BIGINT) AS with_base
    FROM events GROUP BY 1, 2
""")
def csv_scan_faults(spark, sf_dir):
    """Lines per file and fault, and which fields can still be read."""
    folder = new_folder(spark, "trip-files")
    fixtures.write_trip_files(spark, sf_dir, folder)
    lines = landing.trip_lines(spark, folder)
    kind = F.when(F.col("fault").contains("unknown"), "number").when(F.col("fault").isNotNull(), "fields")
    day = F.regexp_extract("file", "day=([0-9]+)", 1).cast("bigint")
    return lines.groupBy(kind.alias("fault"), day.alias("day")).agg(
        F.count("*").alias("lines"), F.count("Lat").alias("with_lat"), F.count("Base").alias("with_base"),
    )
