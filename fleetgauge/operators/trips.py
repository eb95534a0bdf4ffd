"""The example workload: trips per day, base and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: how the files write a trip's time.
TRIP_TIME = "M/d/yyyy H:mm:ss"


def trip_time_parts(trips: DataFrame, column: str = "Date/Time") -> DataFrame:
    """Parse the trip's time and add its date, time of day and hour.

    A text that is no time gives nulls. A column that is a time already is taken
    as it is.
    """
    when = F.col(f"`{column}`")
    if dict(trips.dtypes)[column] == "string":
        when = F.try_to_timestamp(when, F.lit(TRIP_TIME))
    return trips.withColumn(column, when).withColumns({
        "Date": F.to_date(F.col(f"`{column}`")),
        "Time": F.date_format(F.col(f"`{column}`"), "HH:mm:ss"),
        "pickup_hour": F.hour(F.col(f"`{column}`")),
    })


def row_count(trips: DataFrame) -> DataFrame:
    return trips.agg(F.count(F.lit(1)).alias("total_rows"))


def _trips(df: DataFrame, by: str, name: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias(name))


def trips_per_day(trips: DataFrame) -> DataFrame:
    """Busiest days first."""
    return _trips(trips, "Date", "total_trips").orderBy(F.desc("total_trips"), "Date")


def trips_per_base(trips: DataFrame) -> DataFrame:
    """Busiest bases first."""
    return _trips(trips, "Base", "total_trips").orderBy(F.desc("total_trips"), "Base")


def trips_per_hour(trips: DataFrame) -> DataFrame:
    """Hours of the day in order."""
    return _trips(trips, "pickup_hour", "trips").orderBy("pickup_hour")
