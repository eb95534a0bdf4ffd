"""Folders of batches that stay small: a log-structured merge with a manifest.

A stream writes each micro-batch as a segment. Segments of one level that have become
``fanout`` many are merged to one of the next level, by the same function that folds
batches on reading, so a reader meets about ``fanout`` segments per level, and levels grow
with the logarithm of the number of batches. A row is rewritten once per level.

Which segments count is told by a manifest, a small numbered file. A new number is
published by renaming a finished file, so a reader sees the state before a batch or after
it, never between:

- A batch, or a merge, that ends before its manifest leaves files that nothing names. It
  is repeated and replaces them.
- A batch that is sent again after its manifest is known by its number and left alone.
- Segments go only when ``kept`` newer manifests no longer name them, so that readers that
  have taken up a manifest can finish.

One stream writes to a folder at a time, as Spark's checkpoints demand anyway.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Takes rows of any number of segments to the rows that a reader needs of them.
Fold = Callable[[DataFrame], DataFrame]


class MergedFolder:
    """Segments below a folder, and the manifests that name them."""

    def __init__(
        self, spark: SparkSession, folder: str, fold: Fold, fanout: int = 4, kept: int = 2
    ) -> None:
        if fanout < 2 or kept < 1:
            raise ValueError("a level holds two segments at least, and one manifest is kept")
        self.spark, self.folder, self.fold = spark, folder.rstrip("/"), fold
        self.fanout, self.kept = fanout, kept
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration()
        )
        self._io = jvm.org.apache.commons.io.IOUtils

    # ------------------------------------------------------------------ manifests

    def _versions(self) -> list[int]:
        at = self._path(f"{self.folder}/manifests")
        if not self._files.exists(at):
            return []
        names = [status.getPath().getName() for status in self._files.listStatus(at)]
        return sorted(int(n[: -len(".json")]) for n in names if n.endswith(".json"))

    def _manifest(self, version: int) -> dict:
        stream = self._files.open(self._path(f"{self.folder}/manifests/{version:020d}.json"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def current(self) -> dict:
        """``version``, the last ``batch`` taken in, and the ``segments`` that count."""
        versions = self._versions()
        if not versions:
            return {"version": 0, "batch": -1, "segments": []}
        return self._manifest(versions[-1])

    def _publish(self, manifest: dict) -> dict:
        manifest = manifest | {"version": manifest["version"] + 1}
        name = f"{self.folder}/manifests/{manifest['version']:020d}.json"
        draft = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self._files.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if not self._files.rename(draft, self._path(name)):
            self._files.delete(draft, False)
            raise RuntimeError(f"another writer has published {name}")
        self._forget(manifest["version"])
        return manifest

    def _forget(self, version: int) -> None:
        """Remove manifests that are no longer kept, then what they alone named."""
        versions = self._versions()
        old = [v for v in versions if v <= version - self.kept]
        if not old:
            return
        named = {s["name"] for v in versions if v not in old for s in self._manifest(v)["segments"]}
        gone = {s["name"] for v in old for s in self._manifest(v)["segments"]} - named
        for name in gone:
            self._files.delete(self._path(f"{self.folder}/segments/{name}"), True)
        for v in old:  # last, so that an interrupted removal is taken up again
            self._files.delete(self._path(f"{self.folder}/manifests/{v:020d}.json"), False)

    # ------------------------------------------------------------------- segments

    def _read(self, segments: list[dict]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.folder}/segments/{s['name']}" for s in segments))

    def _write(self, rows: DataFrame, level: int, first: int, last: int) -> dict:
        name = f"level={level}-batches={first}-{last}"
        rows.write.mode("overwrite").parquet(f"{self.folder}/segments/{name}")
        return {"name": name, "level": level, "first": first, "last": last}

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Take in a micro-batch, for ``foreachBatch``; merge what has become many.

        The rows are such as ``fold`` takes and gives.
        """
        manifest = self.current()
        if batch_id > manifest["batch"]:
            made = self._write(batch, 0, batch_id, batch_id)
            manifest = self._publish(
                manifest | {"batch": batch_id, "segments": [*manifest["segments"], made]}
            )
        self.merge(manifest)

    def merge(self, manifest: dict | None = None) -> None:
        """Merge full levels, the lowest first; an interrupted merge is taken up here."""
        manifest = manifest or self.current()
        while True:
            levels: dict[int, list[dict]] = {}
            for segment in manifest["segments"]:
                levels.setdefault(segment["level"], []).append(segment)
            full = [level for level, some in sorted(levels.items()) if len(some) >= self.fanout]
            if not full:
                return
            some = levels[full[0]]
            made = self._write(
                self.fold(self._read(some)), full[0] + 1,
                min(s["first"] for s in some), max(s["last"] for s in some),
            )
            rest = [s for s in manifest["segments"] if s not in some]
            manifest = self._publish(manifest | {"segments": [made, *rest]})

    def read(self) -> DataFrame:
        """The folded rows of all batches taken in so far."""
        segments = self.current()["segments"]
        if not segments:
            raise FileNotFoundError(f"no batch has been written to {self.folder}")
        return self.fold(self._read(segments))
