"""Session settings and the shared folder."""

import os

import pytest
from pyspark.sql import functions as F

from fleetgauge import session as ops


class Conf(dict):
    def set(self, key, value):
        self[key] = value


class Session:
    """The two attributes of a session that the folder depends on."""

    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app-1"})


def test_named_folder_is_used():
    named = Session("spark://host:7077", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    assert ops.shared_dir(named) == "hdfs:///shared"
    assert ops.new_folder(named, "x").startswith("hdfs:///shared/fleetgauge-app-1/x-")


def test_cluster_without_folder_is_refused():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ops.shared_dir(Session("spark://host:7077"))


def test_local_folder_is_made_once():
    first, second = ops.shared_dir(Session("local[2]")), ops.shared_dir(Session("local[*]"))
    assert first == second and os.path.isdir(first)


def test_configure_pins_what_results_depend_on():
    other = Session("local[2]", **{"spark.sql.session.timeZone": "Asia/Tokyo"})
    ops.configure(other)
    assert {key: other.conf[key] for key in ops.REQUIRED} == ops.REQUIRED


def test_session_reads_the_setting(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert ops.new_folder(spark, "a") != ops.new_folder(spark, "a")


@pytest.mark.parametrize("master", ["local-cluster[2,1,512]", "yarn", "k8s://host"])
def test_only_one_process_may_use_its_own_folder(master):
    with pytest.raises(RuntimeError):
        ops.shared_dir(Session(master))


def test_stored_table_is_read_back(spark):
    df = spark.range(3).select(F.col("id"), (F.col("id") * 2).alias("double"))
    kept = ops.stored(df, "kept")
    assert sorted(kept.collect()) == sorted(df.collect())
    assert "Parquet" in kept._jdf.queryExecution().executedPlan().toString()
