"""The example workload."""

from fleetgauge import schemas
from fleetgauge.operators import trips as ops
from fleetgauge.sources import landing

CSV = '''Date/Time,Lat,Lon,Base
4/1/2014 0:11:00,40.769,-73.9549,B02512
4/1/2014 13:17:59,40.7267,-74.0345,B02512
12/31/2014 9:05:00,40.7316,-73.9873,B02598
nonsense,1.0,2.0,B02598
'''


def folder(tmp_path):
    (tmp_path / "a.csv").write_text(CSV)
    (tmp_path / "b.csv").write_text(CSV.splitlines()[0] + "\n4/1/2014 0:59:59,1.5,2.5,B1\n")
    return str(tmp_path)


def test_inferred_and_given_schema(spark, tmp_path):
    inferred = landing.read_trips(spark, folder(tmp_path))
    assert inferred.dtypes == [
        ("Date/Time", "string"), ("Lat", "double"), ("Lon", "double"), ("Base", "string"),
    ]
    given = landing.read_trips(spark, str(tmp_path), schemas.TRIPS)
    assert sorted(given.collect()) == sorted(inferred.collect())


def test_workload(spark, tmp_path):
    trips = ops.trip_time_parts(landing.read_trips(spark, folder(tmp_path)))
    parts = {(str(r["Date"]), r["Time"], r["pickup_hour"]) for r in trips.collect()}
    assert parts == {
        ("2014-04-01", "00:11:00", 0), ("2014-04-01", "13:17:59", 13), ("2014-12-31", "09:05:00", 9),
        ("2014-04-01", "00:59:59", 0), ("None", None, None),
    }
    assert ops.row_count(trips).first()[0] == 5
    assert [r["total_trips"] for r in ops.trips_per_day(trips).collect()] == [3, 1, 1]
    assert [tuple(r) for r in ops.trips_per_base(trips).collect()] == [("B02512", 2), ("B02598", 2), ("B1", 1)]
    assert [tuple(r) for r in ops.trips_per_hour(trips).collect()] == [(None, 1), (0, 2), (9, 1), (13, 1)]
