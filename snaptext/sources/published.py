"""Tables that are published as a set: written with observed metrics, and visible all at once.

Below the path, each part of a table lies in a folder of the run that wrote it, ``<table>/<partition>/run=<id>``, and
manifests say which runs are valid. A run writes new folders only; its manifest is written under another name and
renamed last. A reader takes the manifest of the highest number, so that it sees all of a rebuild or nothing, and a
killed run leaves files that nobody reads. There is one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

_MANIFESTS, _DIGITS = "manifests", 9


class Folder:
    """The few operations on folders that manifests need, on whatever file system Spark reads the path from."""

    def __init__(self, spark: SparkSession, path: str):
        self._files = spark._jvm.org.apache.hadoop.fs
        self.path = path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = spark._jvm.org.apache.commons.io.IOUtils

    def _at(self, *names: str):
        return self._files.Path("/".join([self.path, *filter(None, names)]))

    def names(self, *below: str) -> list[str]:
        at = self._at(*below)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def read(self, *names: str) -> str:
        stream = self._fs.open(self._at(*names))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_whole(self, text: str, *names: str) -> None:
        """Write a file under another name and rename it; a file of that name must not be there."""
        *above, name = names
        draft = self._at(*above, f".{uuid.uuid4().hex}")
        stream = self._fs.create(draft)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self._fs.exists(self._at(*names)) or not self._fs.rename(draft, self._at(*names)):
            raise FileExistsError(f"{name} was published by another writer")


@dataclass
class Table:
    """What to publish: the metrics are aggregates that the write itself observes."""

    rows: DataFrame
    by: str | None = None
    metrics: dict[str, Column] | None = None
    #: Whether parts that ``rows`` has nothing of are dropped; else they stay as they were.
    replace: bool = False


def manifest(spark: SparkSession, path: str) -> dict:
    """The valid manifest: ``number`` and ``tables`` by name, each with ``by``, ``schema``, ``parts`` (folder to run) and ``metrics``."""
    folder = Folder(spark, path)
    written = [n for n in folder.names(_MANIFESTS) if n.endswith(".json") and not n.startswith(".")]
    return json.loads(folder.read(_MANIFESTS, written[-1])) if written else {"number": 0, "tables": {}}


def publish(spark: SparkSession, path: str, tables: dict[str, Table]) -> dict:
    """Write all tables, then make them valid together; returns the new manifest."""
    folder, run = Folder(spark, path), uuid.uuid4().hex
    before = manifest(spark, path)
    valid = dict(before["tables"])
    for name, table in tables.items():
        seen = Observation(f"{name}-{run}")
        metrics = {"n_rows": F.count(F.lit(1)), **(table.metrics or {})}
        rows = table.rows.observe(seen, *[value.alias(m) for m, value in metrics.items()])
        target = f"{folder.path}/{name}"
        writer = rows.withColumn("run", F.lit(run)).write.mode("append")
        writer.partitionBy(*filter(None, [table.by, "run"])).parquet(target)
        made = [p for p in folder.names(name) if f"run={run}" in folder.names(name, p)] if table.by else [""] * (f"run={run}" in folder.names(name))
        old = {} if table.replace or not table.by else valid.get(name, {}).get("parts", {})
        valid[name] = {
            "by": table.by,
            "schema": json.loads(table.rows.schema.json()),
            "parts": {**old, **dict.fromkeys(made, run)},
            "metrics": seen.get,
        }
    after = {"number": before["number"] + 1, "tables": valid}
    folder.write_whole(json.dumps(after, default=str), _MANIFESTS, f"{after['number']:0{_DIGITS}d}.json")
    return after


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The valid rows of a table, with the schema that it was written with; filters on its partition column prune folders."""
    known = manifest(spark, path)["tables"][name]
    schema = T.StructType.fromJson(known["schema"])
    top = f"{path.rstrip('/')}/{name}"
    folders = ["/".join(filter(None, [top, part, f"run={run}"])) for part, run in known["parts"].items()]
    if not folders:
        return spark.createDataFrame([], schema)
    # Rows written by an earlier run under other columns read as null where they lack one.
    return spark.read.schema(schema).option("basePath", top).parquet(*folders).select(*schema.names)
