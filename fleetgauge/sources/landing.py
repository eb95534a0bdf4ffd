"""Readers for landed metric records.

``raw`` frames hold one landed page per row: key columns, ``endpoint``, ``page``,
``ok`` and the JSON text ``payload``. A listing may land in several pages; the place
of a record in it is its ``position``, made of the page and the place in the page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from fleetgauge import schemas
from fleetgauge.functions import payloads, rows

Names = Sequence[str]

# Why a landed file cannot be used.
UNREADABLE, NO_JOBS, EMPTY_FILE = "unreadable document", "no list of jobs", "empty file"
NAMELESS_JOB = "job without an id"

# In no JSON document: texts are UTF-8 and have no bare control characters.
NO_LINE_END = "\x00"


def write_raw_polls(raw: DataFrame, path: str) -> None:
    """Land pages by endpoint and day, so that a reader opens only the files it needs."""
    days = raw.withColumn("poll_date", F.to_date("poll_ts"))
    days.write.partitionBy("endpoint", "poll_date").parquet(path)


def read_raw_polls(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages; filters on ``endpoint`` and ``poll_date`` prune folders."""
    return spark.read.schema(schemas.RAW_POLLS + ", poll_date DATE").parquet(path)


def read_trips(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """A folder of CSV files with a header.

    Without a schema Spark reads the files once more to infer the types, so give
    ``schemas.TRIPS`` for large folders.
    """
    reader = spark.read.option("header", True)
    if schema:
        return reader.schema(schema).csv(folder)
    return reader.option("inferSchema", True).csv(folder)


def _position() -> Column:
    return F.struct("page", F.col("_place").alias("place")).alias("position")


def spark_records(raw: DataFrame, endpoint: str, keys: Names) -> DataFrame:
    """One row per record of an application endpoint, with its place in the page."""
    record = schemas.SPARK_ENDPOINTS[endpoint]
    pages = raw.filter((F.col("endpoint") == endpoint) & F.col("ok"))
    records = payloads.record_list(F.col("payload"), record)
    return rows.positions(pages, [*keys, "page"], records, "_place", "_r").select(
        *keys, _position(), "_r.*"
    )


def flink_objects(raw: DataFrame, endpoint: str, keys: Names) -> DataFrame:
    """One row per object of a cluster endpoint; pages that hold none are left out."""
    page = payloads.page_object(F.col("payload"), schemas.FLINK_ENDPOINTS[endpoint])
    return (
        raw.filter((F.col("endpoint") == endpoint) & F.col("ok"))
        .select(*keys, page.alias("_r"))
        .filter(payloads.readable(F.col("_r")))
        .select(*keys, "_r.*")
        .drop("_bad")
    )


def unreadable_pages(raw: DataFrame, keys: Names, lists: bool) -> DataFrame:
    """Pages that arrived without an error but hold no whole JSON document.

    ``lists`` tells whether the pages are application listings or cluster objects.
    """
    payload, broken = F.col("payload"), F.lit(False)
    for endpoint, schema in (schemas.SPARK_ENDPOINTS if lists else schemas.FLINK_ENDPOINTS).items():
        found = (
            payloads.record_list(payload, schema).isNotNull() if lists
            else F.coalesce(payloads.readable(payloads.page_object(payload, schema)), F.lit(False))
        )
        broken = broken | ((F.col("endpoint") == endpoint) & ~found)
    return raw.filter(F.col("ok") & broken).select(*keys, "endpoint", "page")


def flink_jobs(raw: DataFrame, keys: Names) -> DataFrame:
    """One row per job of the cluster job listings."""
    keep = [*keys, "page"]
    listings = flink_objects(raw, "jobs", keep)
    return rows.positions(listings, keep, F.col("jobs"), "_place", "_j").select(
        *keys, _position(), F.col("_j.id").alias("job_id"), F.col("_j.status")
    )


def timeline_polls(raw: DataFrame, external: bool | None = None) -> DataFrame:
    """Timeline documents, of one of the two timeline endpoints or of both."""
    wanted = {None: ["timeline", "timeline_extern"], False: ["timeline"], True: ["timeline_extern"]}
    return raw.filter(F.col("endpoint").isin(wanted[external]) & F.col("ok"))


def job_details(raw: DataFrame, keys: Names) -> DataFrame:
    """Members of the job detail documents, empty for documents that hold none."""
    return raw.select(*keys, payloads.job_detail(F.col("payload")).alias("detail"))


def process_samples(raw: DataFrame, keys: Names) -> DataFrame:
    """One row per landed process sample; documents that hold none are left out."""
    page = payloads.page_object(F.col("payload"), schemas.PROCESS)
    samples = raw.select(*keys, page.alias("_p")).filter(payloads.readable(F.col("_p")))
    return samples.select(*keys, "_p.*").drop("_bad")


def slurm_jobs(raw: DataFrame, keys: Names = (), fields: Names | None = None) -> DataFrame:
    """One row per scheduler job of landed job or queue documents.

    ``fields`` limits what is parsed, because Spark cannot prune what it unnests;
    it must include ``job_id``.
    """
    parsed = raw.select(*keys, F.from_json("payload", schemas.slurm_jobs(fields)).alias("_doc"))
    return rows.structs(parsed, keys, F.col("_doc.jobs"), always="job_id")


def slurm_errors(raw: DataFrame, keys: Names) -> DataFrame:
    """Documents that ``slurm_jobs`` cannot read, or that hold jobs without an id."""
    page = payloads.page_object(F.col("payload"), f"STRUCT<{schemas.slurm_jobs(['job_id'])}>")
    unread = ~F.coalesce(payloads.readable(page), F.lit(False))
    nameless = F.exists(page["jobs"], lambda job: job["job_id"].isNull())
    reason = F.when(unread, UNREADABLE).when(nameless, NAMELESS_JOB)
    return raw.select(*keys, reason.alias("reason")).filter(F.col("reason").isNotNull())


def _whole_documents(spark: SparkSession, schema: str) -> DataFrameReader:
    """Reads each file as one JSON document, whatever lines it is written over.

    With ``multiLine`` Spark goes back to the file for every number that is read as a
    string, job ids among them, and each time reads some kilobytes around it. A document
    that is one line is parsed in memory. One in UTF-16 or UTF-32 falls apart into lines
    that cannot be read.
    """
    return spark.read.schema(schema).option("lineSep", NO_LINE_END)


def read_slurm_files(spark: SparkSession, path: str) -> DataFrame:
    """Scheduler jobs from files that each hold one JSON document."""
    return (
        _whole_documents(spark, schemas.slurm_jobs())
        .json(path)
        .transform(lambda docs: rows.structs(docs, [], F.col("jobs"), always="job_id"))
    )


def _all_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below a path, whatever is in it; contents are not read.

    Spark's readers pass over files of no bytes at all, so those are not among them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("_metadata.file_path").alias("file"))


def slurm_file_documents(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``jobs`` and ``fault`` of files that each hold one JSON document.

    A document may be written over many lines. Every file has a row: one that is no
    whole document, holds no list of jobs, or only blanks, has its ``fault`` told.
    """
    read = (
        _whole_documents(spark, schemas.slurm_jobs() + ", _bad STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad").option("recursiveFileLookup", True)
        .json(path)
        .select("jobs", "_bad", F.col("_metadata.file_path").alias("file"))
    )
    fault = F.when(F.col("_bad").isNotNull(), UNREADABLE).when(F.col("jobs").isNull(), NO_JOBS)
    told = read.select("file", "jobs", fault.alias("fault"))
    blank = _all_files(spark, path).join(told.select("file"), "file", "left_anti")
    return told.unionByName(
        blank.withColumn("fault", F.lit(EMPTY_FILE)), allowMissingColumns=True
    )


def slurm_file_jobs(documents: DataFrame) -> DataFrame:
    """One row per job with an id, and the ``file`` it stands in."""
    return rows.structs(documents, ["file"], F.col("jobs"), always="job_id")


def slurm_file_faults(documents: DataFrame) -> DataFrame:
    """``file`` and ``reason`` of files that cannot be read or whose jobs have no id."""
    nameless = F.exists("jobs", lambda job: job["job_id"].isNull())
    reason = F.coalesce("fault", F.when(nameless, NAMELESS_JOB))
    told = documents.select("file", reason.alias("reason")).filter(F.col("reason").isNotNull())
    return told.distinct()


def trip_lines(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Every line of CSV files with its ``file``; ``fault`` is the text of a faulty one.

    A faulty line keeps the fields that can be read, the others are null. Fields are read
    whether a query wants them or not, since a line's faults may lie in any of them.
    """
    return (
        spark.read.schema((schema or schemas.TRIPS) + ", fault STRING")
        .option("header", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "fault").option("recursiveFileLookup", True)
        .option("columnPruning", False)
        .csv(folder).select("*", F.col("_metadata.file_path").alias("file"))
    )


def worker_listing(raw: DataFrame, keys: Names) -> DataFrame:
    """Workers with state and host, or task managers with neither, per cluster."""
    page = payloads.page_object(F.col("payload"), schemas.WORKER_LISTING)
    parsed = raw.filter("ok").select(*keys, page.alias("_doc")).filter(
        payloads.readable(F.col("_doc"))
    )
    workers = "array<struct<state:string,host:string>>"
    nameless = F.struct(
        F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("host")
    )
    listed = F.concat(
        F.coalesce("_doc.workers", F.array().cast(workers)),
        F.coalesce(
            F.transform("_doc.taskmanagers", lambda tm: nameless), F.array().cast(workers)
        ),
    )
    return rows.positions(parsed, keys, listed, "_position", "_w").select(*keys, "_w.*")


def listing_errors(raw: DataFrame, keys: Names) -> DataFrame:
    """Why worker listings cannot be used: the error of the request, or of the page."""
    page = payloads.page_object(F.col("payload"), schemas.WORKER_LISTING)
    usable = F.coalesce(F.col("ok") & payloads.readable(page), F.lit(False))
    message = F.coalesce(F.col("message"), F.lit("unreadable listing"))
    return raw.filter(~usable).select(*keys, message.alias("message"))
