"""A consumer gets whole batches, once, or nothing of them."""

import os

import pytest
from pyspark.sql import functions as F

from fleetgauge.session import new_folder
from fleetgauge.streaming import push
from fleetgauge.streaming.ingest import run_available, stream_files


@pytest.fixture
def box(spark):
    push.register(spark)
    return new_folder(spark, "mailbox")


def files(box, kind):
    at = f"{box}/{kind}"
    return sorted(f for f in os.listdir(at) if not f.startswith(".")) if os.path.exists(at) else []


def send(rows, box, batch):
    rows.write.format(push.NAME).option("path", box).option("batch", batch).mode("append").save()


def failing_at_seven():
    return F.when(F.col("id") == 7, F.raise_error(F.lit("seven")).cast("bigint")).otherwise(F.col("id"))


def test_rows_of_many_tasks_arrive_once(spark, box):
    rows = spark.range(100).withColumns({
        "text": F.concat(F.lit("ü\n"), "id"), "at": F.timestamp_seconds("id"),
        "amount": (F.col("id") / 4).cast("decimal(9,2)"), "gone": F.lit(None).cast("double"),
    }).repartition(5)
    send(rows, box, "a")
    got = push.delivered(spark, box, rows.schema)
    assert sorted(map(tuple, got.drop("batch").collect())) == sorted(map(tuple, rows.collect()))
    assert sum(r.rows for r in push.notes(spark, box).collect()) == 100
    assert push.undelivered(spark, box).collect() == []


def test_a_failed_task_leaves_no_part_of_its_batch(spark, box):
    send(spark.range(5), box, "good")
    bad = spark.range(0, 40, 1, 8).select(failing_at_seven().alias("id"))
    with pytest.raises(Exception, match="seven"):
        send(bad, box, "bad")
    assert sorted(r.id for r in push.delivered(spark, box, "id bigint").collect()) == [0, 1, 2, 3, 4]
    assert files(box, "delivered") == ["good.json"]


def test_files_of_tasks_that_no_note_names_are_not_read(spark, box):
    send(spark.range(3), box, "a")
    send(spark.range(10, 12), box, "b")
    for name in os.listdir(f"{box}/delivered"):
        if name.endswith("b.json"):
            os.rename(f"{box}/delivered/{name}", f"{box}/{name}.lost")
    assert sorted(r.id for r in push.delivered(spark, box, "id bigint").collect()) == [0, 1, 2]
    assert 1 <= push.undelivered(spark, box).count() <= 2


def test_a_batch_sent_again_is_not_delivered_twice(spark, box):
    for _ in range(3):
        send(spark.range(4), box, "same")
    assert push.delivered(spark, box, "id bigint").count() == 4
    assert len(files(box, "staged")) == len(push.notes(spark, box).collect())


def test_empty_batches_and_missing_paths(spark, box):
    send(spark.range(0), box, "none")
    assert push.notes(spark, box).collect() == []
    with pytest.raises(Exception, match="path"):
        spark.range(1).write.format(push.NAME).mode("append").save()


def test_stream_over_batches(spark, box):
    folder = new_folder(spark, "landed")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(folder)
    stream = stream_files(spark, folder, "id bigint", files_per_batch=1)
    run_available(spark, stream.writeStream.format(push.NAME).option("path", box))
    got = push.delivered(spark, box, "id bigint")
    assert sorted(r.id for r in got.collect()) == [*range(30)]
    assert got.select("batch").distinct().count() == 3
