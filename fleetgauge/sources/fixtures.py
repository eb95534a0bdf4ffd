"""Metric records derived from the given tables.

The tables hold no cluster metrics, so each adapter computes the fields of one kind
of record from the columns of a row. All adapters but the cluster overview are plain
projections: they move no rows and their output grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.sources.tables import table

# Reads a table as a batch or as a stream.
Reader = Callable[[SparkSession, str, str], DataFrame]

# Start of the polls: 2024-01-01 00:00:00 UTC.
EPOCH = 1704067200

ORDER_APP = "concat('app-', o_orderkey % 20)"
LINE_APP = "concat('app-', l_orderkey % 20)"
ORDER_POLL = "o_orderkey div 200"
LINE_POLL = "l_orderkey div 200"


def _poll_ts(poll: str):
    return F.timestamp_seconds(F.lit(EPOCH) + 5 * F.expr(poll)).alias("poll_ts")


# ---------------------------------------------------------------- samples, trips


def samples_of(events: DataFrame) -> DataFrame:
    """One sample per event; values are exact, so sums do not depend on their order."""
    return events.select(
        F.expr("concat('u', user_id)").alias("entity_id"),
        F.col("event_type").alias("metric"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").cast("decimal(9,2)").alias("value"),
        F.col("event_id").alias("sample_id"),
    )


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return samples_of(table(spark, folder, "events"))


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """One trip per event, with the time as a timestamp."""
    return table(spark, folder, "events").select(
        F.col("ts").alias("Date/Time"),
        F.col("value").alias("Lat"),
        F.expr("-value - 1.0D").alias("Lon"),
        F.col("event_type").alias("Base"),
    )


def trip_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The same trips with the time written as in the trip files."""
    return trips(spark, folder).withColumn(
        "Date/Time", F.date_format("`Date/Time`", "M/d/yyyy H:mm:ss")
    )


# ------------------------------------------------------------ application records


def spark_jobs(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    return read(spark, folder, "orders").select(
        F.expr(ORDER_APP).alias("entity_id"),
        F.expr(ORDER_POLL).alias("poll_id"),
        F.col("o_orderkey").alias("page"),
        F.expr(
            "CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'F' THEN 'SUCCEEDED'"
            " ELSE 'FAILED' END"
        ).alias("status"),
        F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 5 END").alias("numActiveTasks"),
        F.expr("o_orderkey % 11").alias("numCompletedTasks"),
        F.expr("CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 3 END").alias("numFailedTasks"),
    )


def spark_stages(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        F.expr(LINE_APP).alias("entity_id"),
        F.expr(LINE_POLL).alias("poll_id"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("page"),
        F.expr(
            "CASE WHEN l_linestatus = 'O' THEN 'ACTIVE' WHEN l_returnflag = 'R' THEN 'FAILED'"
            " ELSE 'COMPLETE' END"
        ).alias("status"),
    )


EXECUTOR_FIELDS = {
    "totalCores": "CAST(l_linenumber AS BIGINT)",
    "memoryUsed": "CAST(round(l_extendedprice * 100) AS BIGINT)",
    "diskUsed": "CASE WHEN l_linenumber <> 4 THEN l_suppkey * 1024 END",
    "totalInputBytes": "l_partkey * 4096",
    "totalShuffleRead": "l_orderkey * 512",
    "totalShuffleWrite": "CAST(l_quantity AS BIGINT) * 65536",
    "totalGCTime": "l_partkey % 1000",
    "totalDuration": "l_orderkey % 10000",
    # Reported with the heap, with something else only, empty, or not at all.
    "peakMemoryMetrics": (
        "CASE l_linenumber WHEN 1 THEN map('JVMHeapMemory', l_partkey * 8192)"
        " WHEN 2 THEN map('JVMOffHeapMemory', l_partkey)"
        " WHEN 3 THEN CAST(map() AS MAP<STRING, BIGINT>)"
        " WHEN 4 THEN CAST(map() AS MAP<STRING, BIGINT>) END"
    ),
    "memoryMetrics": (
        "CASE WHEN l_linenumber IN (1, 3, 5) THEN map('usedOnHeapStorageMemory', l_suppkey * 2048)"
        " WHEN l_linenumber = 4 THEN map('usedOffHeapStorageMemory', l_suppkey) END"
    ),
}


def spark_executors(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    return read(spark, folder, "lineitem").select(
        F.expr(LINE_APP).alias("entity_id"),
        F.expr(LINE_POLL).alias("poll_id"),
        F.expr("l_orderkey * 10 + l_linenumber").alias("page"),
        "l_linenumber",
        *[F.expr(sql).alias(name) for name, sql in EXECUTOR_FIELDS.items()],
    )


def cluster_polls(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages of clusters polled as a whole, the application listing included."""
    orders = table(spark, folder, "orders")
    attempt = "array(named_struct('completed', %s))"
    records = {
        "applications": "named_struct('id', concat('app-', o_orderkey), 'attempts',"
        f" CASE WHEN o_custkey % 40 = 0 THEN {attempt % 'false'}"
        f" WHEN o_orderstatus = 'F' THEN {attempt % 'true'} END)",
        "jobs": "named_struct('status', CASE o_orderstatus WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END,"
        " 'numActiveTasks', o_orderkey % 5)",
        "stages": "named_struct('status', 'ACTIVE')",
        "executors": "named_struct('totalCores', 2, 'memoryUsed', o_custkey * 1024,"
        " 'totalShuffleRead', o_orderkey * 512, 'totalGCTime', o_orderkey % 100,"
        " 'totalDuration', o_custkey)",
    }
    pages = None
    for endpoint, record in records.items():
        some = orders.select(
            F.col("o_orderpriority").alias("cluster_id"),
            F.expr(ORDER_POLL).alias("poll_id"),
            _poll_ts(ORDER_POLL),
            F.lit(endpoint).alias("endpoint"),
            F.col("o_orderkey").alias("page"),
            F.to_json(F.expr(f"array({record})")).alias("payload"),
        )
        pages = some if pages is None else pages.unionByName(some)
    failed = "endpoint = 'stages' AND poll_id % 8 = 3"
    return pages.withColumns({
        "ok": F.expr(f"NOT ({failed})"),
        "payload": F.expr(
            f"CASE WHEN {failed} THEN NULL"
            " WHEN endpoint = 'applications' AND poll_id % 11 = 6 THEN '{\"error\":\"x\"}'"
            " ELSE payload END"
        ),
    })


def _page(df: DataFrame, endpoint: str, fields: list[str], poll_no: str) -> DataFrame:
    """Land each record as a page of its own; some polls fail, or arrive empty or broken."""
    failed = f"endpoint = 'stages' AND {poll_no} % 9 = 0"
    empty = f"endpoint = 'executors' AND {poll_no} % 13 = 4"
    return df.select(
        "entity_id",
        "poll_id",
        "page",
        F.lit(endpoint).alias("endpoint"),
        F.to_json(F.array(F.struct(*fields))).alias("payload"),
    ).select(
        "entity_id",
        "endpoint",
        "poll_id",
        _poll_ts("poll_id"),
        "page",
        F.expr(f"NOT ({failed})").alias("ok"),
        F.expr(
            f"CASE WHEN {failed} THEN NULL WHEN {empty} THEN '[]'"
            f" WHEN endpoint = 'jobs' AND {poll_no} % 17 = 5 THEN '<html>502</html>'"
            f" WHEN endpoint = 'stages' AND {poll_no} % 19 = 7 THEN '{{\"error\":\"x\"}}'"
            f" WHEN endpoint = 'executors' AND {poll_no} % 23 = 11"
            " THEN left(payload, length(payload) - 2) ELSE payload END"
        ).alias("payload"),
    )


# Number that decides which polls of which applications fail or arrive empty.
POLL_NO = "(poll_id + CAST(substring(entity_id, 5) AS BIGINT))"


def spark_raw_polls(spark: SparkSession, folder: str, read: Reader = table) -> DataFrame:
    """Landed pages of the three application endpoints."""
    jobs = ["status", "numActiveTasks", "numCompletedTasks", "numFailedTasks"]
    return (
        _page(spark_jobs(spark, folder, read), "jobs", jobs, POLL_NO)
        .unionByName(_page(spark_stages(spark, folder, read), "stages", ["status"], POLL_NO))
        .unionByName(
            _page(spark_executors(spark, folder, read), "executors", [*EXECUTOR_FIELDS], POLL_NO)
        )
    )


# ---------------------------------------------------------------- cluster records

FLINK_STATUS = (
    "CASE o_orderkey % 7 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'FINISHED'"
    " WHEN 3 THEN 'CANCELLED' WHEN 4 THEN 'CANCELED' WHEN 5 THEN 'CREATED' END"
)


def flink_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster job listings; a cluster is an order priority."""
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("cluster_id"),
        F.expr(ORDER_POLL).alias("poll_id"),
        F.col("o_orderkey").alias("position"),
        F.expr("concat('job-', o_orderkey)").alias("job_id"),
        F.expr(FLINK_STATUS).alias("status"),
    )


def flink_raw_polls(spark: SparkSession, folder: str) -> DataFrame:
    """Landed pages of the three cluster endpoints."""
    keys = [F.col("o_orderpriority").alias("cluster_id"), F.expr(ORDER_POLL).alias("poll_id")]
    orders = table(spark, folder, "orders")
    jobs = orders.select(
        *keys,
        F.lit("jobs").alias("endpoint"),
        F.col("o_orderkey").alias("page"),
        F.to_json(F.expr(
            "named_struct('jobs', array(named_struct("
            f"'id', concat('job-', o_orderkey), 'status', {FLINK_STATUS})))"
        )).alias("payload"),
    )
    managers = orders.select(
        *keys,
        F.lit("taskmanagers").alias("endpoint"),
        F.col("o_orderkey").alias("page"),
        F.expr(
            "CASE WHEN o_orderstatus = 'F'"
            " THEN concat('{\"taskmanagers\":[{\"id\":\"tm-', o_custkey, '\"}]}')"
            " ELSE '{\"taskmanagers\":[]}' END"
        ).alias("payload"),
    )
    # One overview per poll, its figures from the poll's first order. One in five
    # has no tasks object.
    overview = (
        orders.groupBy(*keys)
        .agg(F.min("o_orderkey").alias("k"))
        .select(
            "cluster_id",
            "poll_id",
            F.lit("overview").alias("endpoint"),
            F.lit(0).cast("bigint").alias("page"),
            F.to_json(F.expr(
                "named_struct('tasks', CASE WHEN k % 5 <> 0 THEN named_struct("
                "'total', k % 100, 'running', k % 10, 'failed', k % 3, 'finished', k % 7,"
                " 'canceled', k % 2) END,"
                " 'slots-total', k % 50 + 10, 'slots-used', k % 10, 'total-memory', k * 1048576,"
                " 'total-network-memory', k * 4096, 'total-jvm-memory', k * 1000)"
            )).alias("payload"),
        )
    )
    failed = "endpoint = 'overview' AND poll_id % 8 = 3"
    return (
        jobs.unionByName(managers)
        .unionByName(overview)
        .select(
            "cluster_id",
            "endpoint",
            "poll_id",
            _poll_ts("poll_id"),
            "page",
            F.expr(f"NOT ({failed})").alias("ok"),
            F.expr(
                f"CASE WHEN {failed} THEN NULL"
                " WHEN endpoint = 'overview' AND poll_id % 11 = 6 THEN '{\"slots-total\":4'"
                " WHEN endpoint = 'jobs' AND poll_id % 13 = 2 THEN '<html>502</html>'"
                " WHEN endpoint = 'taskmanagers' AND poll_id % 17 = 9 THEN '[]' ELSE payload END"
            ).alias("payload"),
        )
    )


def poll_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Polls of a cluster in order, with a candidate entity that may be missing."""
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("cluster_id"),
        F.col("o_orderkey").alias("poll_id"),
        F.expr("o_orderstatus <> 'P'").alias("ok"),
        F.expr("CASE WHEN o_custkey % 3 <> 0 THEN concat('app-', o_custkey) END").alias("candidate"),
        F.expr(
            "concat(o_orderpriority, ': HTTPError: ', repeat('x', CAST(o_custkey % 200 AS INT)))"
        ).alias("message"),
    )


# ---------------------------------------------------------------------- timelines

# Six shapes of documents around the value v of an event on a five-minute grid g.
TIMELINE_SHAPES = [
    # Of two racks, the second reports more.
    """{"unit":"kW","rack1":[[null,null,%v,null],{"mean":4}],"timestamps":[%g,%g3,%g6,%g9],"""
    """"rack2":[[%v2,null,%v,%v1],{"lowest_node":"low%j","mean":%v1,"best_node":"top%j"}]}""",
    # Two racks that report equally much.
    """{"timestamps":[%g,%g3,%g6,%g9],"zone":[[null,null,%v1,%v],{"mean":"7.25"}],"unit":"kW","""
    """"area":[[%v,%v2,null,null],{"best_node":"q"}]}""",
    # A value and a mean in words.
    """{"unit":"rpm","timestamps":[%g,%g3,%g6,%g9],"fan":[[null,%v3,"stalled",%v],"""
    """{"best_node":"top%j","mean":"none yet"}]}""",
    # No block at all.
    """{"timestamps":[%g,%g9],"unit":"rpm"}""",
    # Times in words.
    """{"unit":"rpm","timestamps":"later","fan":[[%v],{"mean":8}]}""",
    # Two values for four times, no meta, and members that are no blocks.
    """{"note":"-","timestamps":[%g,%g3,%g6,%g9],"gap":[],"pair":[8,3],"probe":[["%v1",%v]]}""",
]


def _timeline_document(shape: str):
    grid = "(unix_seconds(CAST(ts AS TIMESTAMP)) div 300 * 300)"
    value = "CAST(round(value * 100) AS BIGINT)"
    names = {
        "%g3": f"{grid} + 300", "%g6": f"{grid} + 600", "%g9": f"{grid} + 900", "%g": grid,
        "%v1": f"{value} + 1", "%v2": f"{value} + 2", "%v3": f"{value} + 3", "%v": value,
        "%j": "user_id % 9",
    }
    out = f"'{shape}'"
    for name, sql in names.items():
        out = out.replace(name, f"', {sql}, '")
    return f"concat({out})"


def timeline_polls_of(events: DataFrame) -> DataFrame:
    """One landed timeline document per event; documents of a series overlap."""
    cases = " ".join(
        f"WHEN {i} THEN {_timeline_document(shape)}" for i, shape in enumerate(TIMELINE_SHAPES)
    )
    return events.select(
        F.expr("user_id % 5").alias("job_id"),
        F.col("event_type").alias("metric"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'timeline' ELSE 'timeline_extern' END").alias("endpoint"),
        F.col("event_id").alias("poll_id"),
        F.lit(True).alias("ok"),
        F.expr(f"CASE event_id % 6 {cases} END").alias("payload"),
    )


def timeline_polls(spark: SparkSession, folder: str) -> DataFrame:
    return timeline_polls_of(table(spark, folder, "events"))


def job_detail_polls(spark: SparkSession, folder: str) -> DataFrame:
    """Job detail documents in all shapes they may land in."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("poll_id"),
        F.expr("""
            CASE o_orderkey % 8
              WHEN 0 THEN concat('{"job_name":"j', o_custkey, '","nodes":', o_orderkey % 4, '}')
              WHEN 1 THEN concat('[{"job_name":"j', o_custkey, '"},{"job_name":"other"}]')
              WHEN 2 THEN '[]'
              WHEN 3 THEN '"text"'
              WHEN 4 THEN '42'
              WHEN 5 THEN '[1,2]'
              WHEN 6 THEN concat('{"job_name":null,"nodes":"', o_custkey, '"}')
            END
        """).alias("payload"),
    )


# ---------------------------------------------------------------------- processes

PATTERNS = [
    "",
    {"title": "Gears", "pattern": "gear"},
    "ring",
    {"pattern": "ECONOMY"},
    {"title": "Eco again", "pattern": "ECON"},
    {"title": "Never", "pattern": "economy"},
    {"title": "Red", "pattern": "red "},
]


def processes(spark: SparkSession, folder: str) -> DataFrame:
    """One process sample per part; every other one belongs to another user."""
    return table(spark, folder, "part").select(
        F.expr("concat('cluster-', p_partkey % 3)").alias("cluster_id"),
        F.expr("concat('host-', p_partkey % 7)").alias("host"),
        F.expr("p_partkey div 50").alias("poll_id"),
        _poll_ts("p_partkey div 50"),
        F.col("p_partkey").alias("pid"),
        F.col("p_brand").alias("username"),
        F.expr("CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE 'root' END").alias("owner"),
        F.expr(
            "CASE p_size % 10 WHEN 0 THEN 'zombie' WHEN 1 THEN 'dead' WHEN 2 THEN 'running'"
            " ELSE 'sleeping' END"
        ).alias("status"),
        F.expr(
            "CASE WHEN p_size % 13 = 0 THEN CAST(array() AS ARRAY<STRING>)"
            " ELSE concat(split(p_name, ' '), array(p_type)) END"
        ).alias("cmdline"),
        F.expr("p_size * 0.25D").alias("cpu_percent"),
        F.expr("CAST(p_size AS DOUBLE)").alias("memory_percent"),
        F.expr("p_partkey * 123456").alias("rss"),
        F.expr("p_partkey * 234567").alias("vms"),
        F.expr("CAST(p_size AS BIGINT)").alias("num_threads"),
        F.expr("p_partkey * 1000").alias("read_bytes"),
        F.expr("p_partkey * 3000").alias("write_bytes"),
    )


def process_polls(spark: SparkSession, folder: str) -> DataFrame:
    """The same samples as landed JSON; a few are cut off."""
    df = processes(spark, folder)
    keys = ["owner", "cluster_id", "host", "poll_id", "poll_ts"]
    payload = F.to_json(F.struct(*df.drop(*keys).columns))
    return df.select(
        *keys,
        F.when(F.col("pid") % 31 == 5, F.substring(payload, 1, 40)).otherwise(payload).alias("payload"),
    )


def pattern_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Patterns as landed: a title and pattern, a pattern, a title, or a plain text."""
    return table(spark, folder, "part").select(
        F.col("p_partkey").alias("priority"),
        F.expr("CASE WHEN p_size % 4 IN (0, 2) THEN p_type END").alias("title"),
        F.expr("CASE WHEN p_size % 4 IN (0, 1) THEN p_name END").alias("pattern"),
        F.expr("CASE WHEN p_size % 4 = 3 AND p_size % 8 = 3 THEN p_brand END").alias("plain"),
    )


def part_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct part name as a pattern, numbered by its first part."""
    return (
        table(spark, folder, "part")
        .groupBy(F.col("p_name").alias("pattern"))
        .agg(F.min("p_partkey").alias("priority"))
        .select("priority", F.expr("concat('t-', pattern)").alias("title"), "pattern")
    )


# ----------------------------------------------------------------- scheduler jobs

# Compact lists with padded, growing, single, descending and double groups.
NODE_LISTS = [
    "concat('n[', o_custkey, '-', o_custkey + o_orderkey % 4, ']')",
    "concat('node[0', o_custkey % 9, '-', 10 + o_custkey % 5, ',', o_orderkey, ']')",
    "concat('host', o_custkey)",
    "'n[98-101]'",
    "'n[5-3]'",
    "'a[1-2],b[3-4]'",
    "concat('{\"count\":2,\"list\":\"n[1-2]\",\"allocation\":[{\"name\":\"x', o_custkey, '\"},{\"name\":\"\"}]}')",
    "concat('{\"count\":1,\"list\":\"c[', o_custkey, ']\",\"allocation\":[]}')",
    "concat('[\"p', o_custkey, '\",\"p1\",\"p', o_custkey, '\"]')",
    "''",
    "CAST(NULL AS STRING)",
    "'{\"list\":[\"l1\",\"l2\"]}'",
]


def node_texts(spark: SparkSession, folder: str) -> DataFrame:
    cases = " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(NODE_LISTS))
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.expr(f"CASE o_orderkey % {len(NODE_LISTS)} {cases} END").alias("nodes"),
    )


def node_range_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Node lists of one range and one padded number each; some ranges are very wide."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.expr("o_custkey % 50").alias("cluster_id"),
        (F.col("o_orderstatus") == "F").alias("drained"),
        F.expr(
            "concat('n[', o_orderkey * 10, '-', o_orderkey * 10 + CASE WHEN o_orderkey % 5000 = 0"
            " THEN 3000000000 ELSE o_custkey % 7 - 1 END, ',0', o_custkey % 10, ']')"
        ).alias("nodes"),
    )


def node_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.expr("concat('n', c_custkey * 10 + c_custkey % 3)").alias("name")
    )


def write_slurm_files(spark: SparkSession, folder: str, path: str) -> None:
    """Queue documents over several lines, a file each; some files are faulty.

    Of 40 files number 3 is cut off, 7 a page of HTML, 11 blank, 13 without jobs, and in
    17 a job has no id. Faulty files hold no jobs that can be read, but for number 17.
    """
    orders = table(spark, folder, "orders")
    job = F.expr(
        "concat('{\"job_id\": ', CASE WHEN o_orderkey % 40 = 17 AND o_orderkey % 3 = 0 THEN 'null'"
        " ELSE CAST(o_orderkey AS STRING) END, ',\n \"user_name\": \"u', o_custkey, '\"}')"
    )
    whole = F.concat(F.lit('{"jobs": [\n'), F.array_join(F.collect_list(job), ",\n"), F.lit("\n]}"))
    documents = orders.groupBy((F.col("o_orderkey") % 40).alias("file")).agg(whole.alias("text"))
    faulty = (
        F.when(F.col("file") == 3, F.expr("left(text, length(text) - 5)"))
        .when(F.col("file") == 7, F.lit("<html>502</html>"))
        .when(F.col("file") == 11, F.lit(" \n "))
        .when(F.col("file") == 13, F.lit('{"errors": []}'))
        .otherwise(F.col("text"))
    )
    documents.select("file", faulty.alias("text")).repartition("file").write.partitionBy("file").text(path)


def write_trip_files(spark: SparkSession, folder: str, path: str) -> None:
    """Trips as CSV files by weekday; some lines have a word for a number or a field less."""
    trips = trip_texts(spark, folder)
    lines = F.expr(
        "CASE WHEN CAST(round(Lat * 100) AS BIGINT) % 50 = 7"
        " THEN concat_ws(',', concat('\"', `Date/Time`, '\"'), 'unknown', Lon, Base)"
        " WHEN CAST(round(Lat * 100) AS BIGINT) % 50 = 9 THEN concat_ws(',', `Date/Time`, Lat)"
        " ELSE concat_ws(',', `Date/Time`, Lat, Lon, Base) END"
    )
    day = F.dayofweek(F.to_timestamp("Date/Time", "M/d/yyyy H:mm:ss"))
    header = spark.range(1, 8).select(F.lit("Date/Time,Lat,Lon,Base").alias("line"), F.col("id").alias("day"), F.lit(0).alias("place"))
    rows = trips.select(lines.alias("line"), day.cast("bigint").alias("day"), F.lit(1).alias("place"))
    header.unionByName(rows).repartition("day").sortWithinPartitions("day", "place").select(
        "line", "day"
    ).write.partitionBy("day").text(path)


def slurm_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Queue documents of two jobs each, one document per order."""

    def triple(number: str, given: str = "true") -> str:
        return f"'{{\"set\":', {given}, ',\"infinite\":false,\"number\":', {number}, '}}'"

    def job(job_id: str, nodes: str) -> str:
        return (
            f"'{{\"job_id\":', {job_id}, ',\"name\":\"j', o_custkey, '\",\"partition\":\"', o_orderstatus,"
            f" '\",\"user_name\":\"u', o_custkey % 50, '\",\"cpus_per_task\":', {triple('o_custkey % 16 + 1')},"
            f" ',\"tasks\":', {triple('o_orderkey % 4 + 1')}, ',\"memory_per_cpu\":', {triple('512')},"
            f" ',\"memory_per_node\":', {triple('o_orderkey % 3 * 4000', 'o_orderkey % 5 < 2')},"
            f" ',\"start_time\":', {triple('o_orderkey + 1700000000')},"
            f" ',\"job_resources\":{{\"nodes\":', {nodes}, '}}}}'"
        )

    first = job("o_orderkey * 2", "'[\"a', o_custkey % 7, '\",\"b\"]'")
    second = job("o_orderkey * 2 + 1", "'\"n[1-', o_orderkey % 3 + 1, ']\"'")
    return table(spark, folder, "orders").select(
        F.expr(f"concat('{{\"jobs\":[', {first}, ',', {second}, ']}}')").alias("payload")
    )


def job_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Scheduler jobs of an order each; several orders share a job id."""
    return table(spark, folder, "orders").select(
        F.expr("CASE WHEN o_orderkey % 10 = 9 THEN 'localhost' ELSE CAST(o_custkey AS STRING) END").alias("job_id"),
        F.col("o_orderkey").alias("position"),
        F.expr("concat('u', o_orderkey % 50)").alias("user_name"),
        F.col("o_orderstatus").alias("partition"),
    )


def job_identity_rows(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.expr(
            "CASE o_orderkey % 6 WHEN 0 THEN '0' WHEN 1 THEN 'localhost' WHEN 2 THEN NULL"
            " ELSE CAST(o_custkey AS STRING) END"
        ).alias("job_id"),
        F.expr(
            "CASE o_custkey % 5 WHEN 0 THEN '2024-01-01T00:00:00' WHEN 1 THEN '0'"
            " ELSE CAST(1700000000 + o_orderkey AS STRING) END"
        ).alias("start_time"),
        F.expr(
            "CASE o_orderstatus WHEN 'O' THEN 'batch' WHEN 'F' THEN '' END"
        ).alias("partition"),
    )


def job_resource_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Job resources with plain numbers and a node list."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.expr(
            "CASE WHEN o_orderkey % 9 = 8 THEN CAST(array() AS ARRAY<STRING>)"
            " ELSE transform(sequence(1, CAST(o_orderkey % 4 AS INT) + 1),"
            " i -> concat('n', o_custkey % 10 + i)) END"
        ).alias("node_list"),
        F.expr("o_custkey % 16 + 1").alias("cpus_per_task"),
        F.expr("o_orderkey % 3 + 1").alias("tasks_per_node"),
        F.expr("512L * (o_custkey % 3)").alias("memory_per_cpu"),
        F.expr("CASE WHEN o_orderkey % 5 < 2 THEN o_orderkey % 5 * 8000L END").alias("memory_per_node"),
    )


def plans(spark: SparkSession, folder: str) -> DataFrame:
    """Resource plans, one per line item, each on the node of its supplier."""
    size = "CAST(l_quantity AS BIGINT)"
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("plan_id"),
        F.col("l_suppkey").alias("node_id"),
        F.expr(f"{size} % 9").alias("driver_cpu"),
        F.expr(f"{size} % 14").alias("worker_cpu"),
        F.expr(f"{size} % 8").alias("executor_cpu"),
        F.expr("872 + l_orderkey % 4 * 128 + l_linenumber div 7 * 28").alias("driver_memory"),
        F.expr(f"1000 + {size} * 128").alias("worker_memory"),
        F.expr(f"1000 + {size} % 25 * 192").alias("executor_memory"),
    )
    nodes = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("node_id"),
        F.expr("s_suppkey % 12 + 2").alias("node_cpus"),
        F.expr("2000 + s_suppkey % 10 * 700").alias("node_mem"),
    )
    return lines.join(nodes, "node_id")


def tree_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """Jobs with resources and a plan; some name a master or workers of their own."""
    from fleetgauge.operators.jobs import job_resources

    jobs = job_resources(job_resource_rows(spark, folder))
    first, last = "get(node_list, 0)", "get(node_list, size(node_list) - 1)"
    return jobs.select(
        "job_id", "node_list", "cpus_per_node", "memory_per_node_effective",
        "total_cpus", "total_memory",
        F.expr(f"CASE job_id % 3 WHEN 0 THEN {last} WHEN 1 THEN 'elsewhere' END").alias("master_node"),
        F.expr(f"CASE job_id % 4 WHEN 0 THEN array({last}, {first}, {last}) END").alias("worker_nodes"),
        F.expr("job_id % 4 + 1").alias("driver_cpu"),
        F.expr("job_id % 8 + 1").alias("worker_cpu"),
        F.expr("job_id % 2 + 1").alias("executor_cpu"),
        F.expr("1000 + job_id % 5 * 128").alias("driver_memory"),
        F.expr("2000 + job_id % 7 * 128").alias("worker_memory"),
        F.expr("1000 + job_id % 3 * 128").alias("executor_memory"),
    )


# ----------------------------------------------------------------------- clusters

CUSTOMER_CLUSTER = "c_custkey div 10"
FRAMEWORK = "CASE %s % 4 WHEN 3 THEN 'storm' WHEN 2 THEN 'FLINK' ELSE 'Spark' END"


def _framework(cluster: str) -> str:
    return FRAMEWORK.replace("%s", f"({cluster})")


def expected_workers(spark: SparkSession, folder: str) -> DataFrame:
    """Configured hosts; every seventh cluster has none."""
    return table(spark, folder, "customer").select(
        F.expr(CUSTOMER_CLUSTER).alias("cluster_id"),
        F.expr(_framework(CUSTOMER_CLUSTER)).alias("framework"),
        F.expr(
            f"CASE WHEN ({CUSTOMER_CLUSTER}) % 7 <> 6 THEN concat('host-', c_custkey % 10 div 3) END"
        ).alias("host"),
    )


def worker_polls(spark: SparkSession, folder: str) -> DataFrame:
    """Landed worker or task manager listings, one page per customer; a few are broken."""
    return table(spark, folder, "customer").select(
        F.expr(CUSTOMER_CLUSTER).alias("cluster_id"),
        F.expr("c_custkey % 50 <> 7").alias("ok"),
        F.expr("CASE WHEN c_custkey % 50 = 7 THEN 'HTTPError: 503' END").alias("message"),
        F.expr(
            "CASE WHEN c_custkey % 50 = 7 THEN NULL WHEN c_custkey % 50 = 23 THEN '<html>'"
            f" WHEN ({CUSTOMER_CLUSTER}) % 4 = 2"
            " THEN CASE WHEN c_acctbal > 4000"
            " THEN concat('{\"taskmanagers\":[{\"id\":\"tm', c_custkey, '\"}]}')"
            " ELSE '{\"taskmanagers\":[]}' END"
            " ELSE concat('{\"workers\":[{\"state\":\"', CASE WHEN c_acctbal > 0 THEN 'ALIVE' ELSE 'DEAD' END,"
            " '\",\"host\":\" host-', c_custkey % 10 div 3, ' \"}]}') END"
        ).alias("payload"),
    )


def cluster_reports(spark: SparkSession, folder: str) -> DataFrame:
    """Worker listings of clusters over time, one per event; some fail or list too few."""
    worker = "concat('{\"state\":\"', CASE WHEN i = 3 AND event_id % 4 = 1 THEN 'DEAD' ELSE 'ALIVE' END, '\",\"host\":\" h', i, ' \"}')"
    return table(spark, folder, "events").select(
        F.expr("concat('u', user_id)").alias("cluster_id"),
        F.col("event_id").alias("number"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("seconds"),
        F.expr("CASE WHEN user_id % 2 = 0 THEN 'Spark' ELSE 'flink' END").alias("framework"),
        F.expr("array('h1', 'h2', 'h3', 'h2')").alias("expected"),
        F.expr("event_id % 5 <> 3").alias("ok"),
        F.expr("event_id % 7 <> 2").alias("master_found"),
        F.expr(
            "CASE WHEN event_id % 5 = 3 THEN NULL WHEN user_id % 2 = 0 THEN"
            f" concat('{{\"workers\":[', array_join(transform(sequence(1, 3), i -> {worker}), ','), ']}}')"
            " ELSE concat('{\"taskmanagers\":[', array_join(array_repeat('{\"id\":\"t\"}',"
            " CASE WHEN event_id % 4 = 1 THEN 2 ELSE 3 END), ','), ']}') END"
        ).alias("payload"),
    )


def cluster_processes(spark: SparkSession, folder: str) -> DataFrame:
    """Processes of the clusters, one per order; few are masters of the right owner."""
    cluster = "o_custkey div 10"
    return table(spark, folder, "orders").select(
        F.expr(cluster).alias("cluster_id"),
        F.expr(_framework(cluster)).alias("framework"),
        F.expr("CASE WHEN o_orderkey % 3 = 0 THEN 'root' ELSE 'ops' END").alias("username"),
        F.lit("ops").alias("owner"),
        F.expr(
            "CASE o_orderkey % 40"
            " WHEN 1 THEN array('java', '-cp', 'x', 'org.apache.spark.deploy.master.Master', '--host', 'h')"
            " WHEN 2 THEN array('java', 'org.apache.flink.runtime.entrypoint.StandaloneSessionClusterEntrypoint')"
            " ELSE array('python', o_orderpriority) END"
        ).alias("cmdline"),
    )
