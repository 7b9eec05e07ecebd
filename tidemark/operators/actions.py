"""Outside effects as a sink: each row is an action, and what came of it is told in files.

A task acts on its rows one after another and writes what each came to, also of those that failed, to a file of its own; its
commit message names the file and its counts. The driver publishes the names of all files, so it never holds the
rows. Spark may run a task again, after a lost executor say, so an action is looked up before it is done (`find`): what
a former attempt did is found by its mark and not done twice.

Actions are named as `module:function`, importable on the executors, and get a row as a dictionary.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: What an action came to: done by this run, found as done before, or failed.
DONE, KNOWN, FAILED = "done", "known", "failed"
_OUTCOME = "key string, status string, value string, error string"


def named(function: str) -> Callable:
    module, _, name = function.partition(":")
    return getattr(importlib.import_module(module), name)


def _folder(path: str):
    from pyarrow import fs

    system, folder = fs.FileSystem.from_uri(path)
    system.create_dir(folder, recursive=True)
    return system, folder


@dataclass
class Told(WriterCommitMessage):
    """What a task did: its file, and how many rows it holds."""

    file: str
    rows: int


class ActionWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.key = options["path"], options["key"]
        self.act, self.find = options["act"], options.get("find")

    def _one(self, act: Callable, find: Callable | None, row: dict) -> dict:
        out = {"key": str(row[self.key]), "status": DONE, "value": None, "error": None}
        try:
            value = find(row) if find else None
            if value is not None:
                out["status"] = KNOWN
            else:
                value = act(row)
            out["value"] = None if value is None else str(value)
        except Exception as error:  # an action's errors are its own and stop no other
            out |= {"status": FAILED, "error": f"{type(error).__name__}: {error}"}
        return out

    def write(self, iterator: Iterator[Row]) -> Told:
        act, find = named(self.act), named(self.find) if self.find else None
        system, folder = _folder(self.path)
        name, rows, out = f"{uuid.uuid4().hex}.jsonl", 0, None
        for row in iterator:
            out = out or system.open_output_stream(f"{folder}/{name}", compression=None)
            out.write((json.dumps(self._one(act, find, row.asDict(recursive=True))) + "\n").encode())
            rows += 1
        if out:
            out.close()
        return Told(name if rows else "", rows)

    def _publish(self, messages: list[Told | None], whole: bool) -> None:
        system, folder = _folder(f"{self.path}/commits")
        files = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]
        with system.open_output_stream(f"{folder}/{uuid.uuid4().hex}.json", compression=None) as out:
            out.write(json.dumps({"whole": whole, "files": files}).encode())

    def commit(self, messages: list[Told | None]) -> None:
        self._publish(messages, True)

    def abort(self, messages: list[Told | None]) -> None:
        """What was done before the run broke off was done, and is told as well."""
        self._publish(messages, False)


class ActionSink(DataSource):
    """`spark.dataSource.register(ActionSink)`, then `df.write.format("actions")` with `path`, `key`, `act` and perhaps `find`."""

    @classmethod
    def name(cls) -> str:
        return "actions"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ActionWriter(self.options)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """`(key, status, value, error)` of all published runs under `path`; none before the first."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _OUTCOME)
    commits = spark.read.schema("whole boolean, files array<struct<file: string, rows: long>>").json(f"{path}/commits")
    files = commits.select(F.explode("files.file").alias("file"))
    if not files.limit(1).count():
        return spark.createDataFrame([], _OUTCOME)
    told = spark.read.schema(_OUTCOME).json(f"{path}/*.jsonl").withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return told.join(files, "file", "left_semi").drop("file")


def perform(rows: DataFrame, act: str, path: str, key: str, find: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Act on every row; `(key, status, value, error)`, the key as text.

    order: columns by which actions follow each other, one at a time in one task; for few rows, as alerts are. Without
    it rows stay where they are, and tasks act side by side.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ActionSink)
    own = f"{path.rstrip('/')}/{uuid.uuid4().hex}"
    dealt = rows.coalesce(1).sortWithinPartitions(*order) if order else rows
    options = {"path": own, "key": key, "act": act} | ({"find": find} if find else {})
    dealt.write.format("actions").options(**options).mode("append").save()
    return outcomes(spark, own)
