"""A keyed table that batches append to: immutable runs, a manifest that names them, merges of equal runs.

A batch writes one run of its own rows and never reads the table. When `fan` runs of one level stand at
the end of the list they merge into one of the next level, so a row is rewritten a logarithmic number of
times and a read folds a logarithmic number of runs. A manifest file, moved in place when complete,
names the current runs: readers see whole versions, a job may read the table it writes, and a batch that
is replayed after a failure finds itself listed and does nothing. Folders that neither the newest nor
the previous manifest names are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: Runs of one level that merge.
FAN = 4
#: Number of the batch a row came in with; fold functions see it and keep the column.
BATCH = "batch"


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[str] = (BATCH,)) -> DataFrame:
    """Per key the row of the last batch, or the last by other columns: folds change logs."""
    columns = [name for name in rows.columns if name not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(*keys, "row.*")


class KeyedTable:
    """Rows folded per key. ``fold`` maps rows with a ``batch`` column to one row per key and keeps that column.

    It must not matter in which groups rows are folded: fold(a + b) = fold(fold(a) + fold(b)).
    """

    def __init__(self, spark: SparkSession, path: str, fold: Callable[[DataFrame], DataFrame], fan: int = FAN) -> None:
        self.spark, self.path, self.fold, self.fan = spark, path.rstrip("/"), fold, fan

    @classmethod
    def of_changes(cls, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = (BATCH,)) -> "KeyedTable":
        """A table of change rows: the newest per key holds."""
        return cls(spark, path, partial(newest, keys=keys, order=order))

    def commit(self, rows: DataFrame, number: int) -> None:
        """Append a batch. Numbers grow; one that is already listed is left as it is."""
        listed = self._manifests()[:1]
        known = self._load(listed[0]) if listed else {"runs": [], "number": -1}
        if number <= known["number"]:
            return
        stored = self.fold(rows.withColumn(BATCH, F.lit(number).cast("long")))
        runs = [*known["runs"], {"name": self._write(stored), "level": 0}]
        while len(runs) >= self.fan and len({run["level"] for run in runs[-self.fan :]}) == 1:
            last = runs[-self.fan :]
            merged = self.fold(self._scan(last, stored.schema))
            runs = [*runs[: -self.fan], {"name": self._write(merged), "level": last[0]["level"] + 1}]
        self._publish({"runs": runs, "number": number, "schema": json.loads(stored.schema.json())})
        self._clean()

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        """The folded table, with ``batch``; ``schema`` serves a table no batch was written to."""
        listed = self._manifests()
        if not listed:
            if schema is None:
                raise ValueError(f"no batch was written to {self.path}")
            return self.spark.createDataFrame([], schema)
        known = self._load(listed[0])
        return self.fold(self._scan(known["runs"], T.StructType.fromJson(known["schema"])))

    def runs(self) -> list[dict]:
        """Name and level of the current runs, oldest first."""
        listed = self._manifests()
        return self._load(listed[0])["runs"] if listed else []

    def _scan(self, runs: list[dict], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/runs/{run['name']}" for run in runs])

    def _write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/runs/{name}")
        return name

    def _files(self, folder: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, store = self._files(folder)
        return sorted(status.getPath().getName() for status in store.listStatus(path)) if store.exists(path) else []

    def _manifests(self) -> list[str]:
        """Names of the manifests, newest first."""
        return [name for name in reversed(self._names("manifest")) if name.endswith(".json")]

    def _load(self, name: str) -> dict:
        path, store = self._files(f"manifest/{name}")
        stream = store.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> None:
        name = f"{manifest['number']:020d}.json"
        draft, store = self._files(f"manifest/{name}.{uuid.uuid4().hex}.part")
        stream = store.create(draft, True)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        if not store.rename(draft, self._files(f"manifest/{name}")[0]):
            raise OSError(f"manifest {name} of {self.path} could not be put in place")

    def _clean(self) -> None:
        kept = self._manifests()
        named = {run["name"] for name in kept[:2] for run in self._load(name)["runs"]}
        old = [f"manifest/{name}" for name in kept[2:]] + [f"runs/{name}" for name in self._names("runs") if name not in named]
        for folder in old:
            path, store = self._files(folder)
            store.delete(path, True)
