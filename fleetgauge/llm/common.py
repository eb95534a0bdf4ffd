"""What the operators of this folder share: columns in, batches through Python."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetgauge.session import configure

#: UTF-8 bytes of text a task works on at once; a longer text is a slice by itself.
SLICE_BYTES = 2 << 20

#: Rows that go to a Python worker at a time.
BATCH_ROWS = 2048


def column(name: str) -> Column:
    """A column by its exact name, dots and other signs included."""
    return F.col("`" + name.replace("`", "``") + "`")


def by_place(
    df: DataFrame, *names: str
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Rows whose columns all have plain names but the named ones, and the way back.

    A name goes to the column that has it exactly, else to the first that has it in other
    capitals. The way back takes a frame with the same columns in the same order.
    """
    columns = df.columns
    lower = [c.lower() for c in columns]
    places = {
        columns.index(n) if n in columns else lower.index(n): n
        for n in names if n in columns or n in lower
    }
    renamed = df.toDF(*(places.get(i, f"column_{i}_") for i in range(len(columns))))
    return renamed, lambda out: out.toDF(*columns)


def unused(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column has it, in capitals or not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Pieces of the batches with a bounded amount of text each, in order."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        start, held = 0, 0
        for i, size in enumerate(sizes.to_pylist()):
            if held and held + size > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < batch.num_rows:
            yield batch.slice(start)


def arrow_schema(schema: str | StructType) -> pa.Schema:
    """The Arrow form of a schema; only the driver can work it out."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def sliced(
    df: DataFrame, text: str, work: Callable[[pa.RecordBatch], dict],
    schema: str | StructType,
    keep: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]] = iter,
) -> DataFrame:
    """``work`` on slices of those rows of ``df`` that ``keep`` leaves, as new columns by name."""
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(keep(batches), text):
            made = work(part)
            yield pa.RecordBatch.from_arrays(
                [
                    made[f.name].cast(f.type) if isinstance(made[f.name], pa.Array)
                    else pa.array(made[f.name], f.type)
                    for f in arrow
                ],
                schema=arrow,
            )

    return df.mapInArrow(run, schema)


def kept_rows(df: DataFrame, text: str, keep: Callable[[list[str | None]], list[bool]]) -> DataFrame:
    """Rows of ``df`` whose text ``keep`` accepts, with all columns, where they are read."""
    packed = df.select(F.struct("*").alias("row"), column(text).alias("text"))

    def work(part: pa.RecordBatch) -> dict:
        chosen = pa.array(keep(part.column("text").to_pylist()), pa.bool_())
        return {"row": part.column("row").filter(chosen)}

    kept = sliced(packed, "text", work, StructType([packed.schema["row"]]))
    return kept.select(*(F.col("row").getField(name).alias(name) for name in df.columns))


@cache
def _ship(application: str) -> None:
    from pyspark import SparkContext

    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="fleetgauge-")  # Spark serves the file from here
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    file = Path(folder) / "fleetgauge_workers.zip"
    with zipfile.ZipFile(file, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    SparkContext.getOrCreate().addPyFile(str(file))


def shipped(spark: SparkSession) -> SparkSession:
    """A session whose Python workers can import this package, wherever they run.

    Spark hands the source to each worker once, from the driver's file server.
    """
    _ship(spark.sparkContext.applicationId)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return configure(spark)
