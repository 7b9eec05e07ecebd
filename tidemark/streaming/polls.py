"""Polls as a stream: each run is one micro-batch, folded into stored memberships."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import lifecycle

_STATE = "canonical_id string, source_id string, first_seen int, last_seen int, inactive_at int, active boolean"


def _shared(spark: SparkSession) -> str:
    """A folder that all executors see; a local one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that driver and executors share")
    root = root or f"file://{tempfile.mkdtemp(prefix='tidemark-')}"
    return f"{root.rstrip('/')}/polls-{uuid.uuid4().hex}"


def run_stream(observed: DataFrame, polls: DataFrame) -> DataFrame:
    """Memberships after the last run, by Structured Streaming over one folder for each run.

    A run's rows stay in as many files as they have partitions; its trigger takes them all as one batch. Every state is written as a folder of its own, named by its run, so a batch that is repeated after a failure
    starts from the same state.
    """
    spark = observed.sparkSession
    base = _shared(spark)
    sources = {r["run_id"]: r["s"] for r in polls.where("ok").groupBy("run_id").agg(F.collect_list("source_id").alias("s")).collect()}
    runs = sorted(r["run_id"] for r in polls.select("run_id").distinct().collect())
    rows = observed.select("run_id", "canonical_id", "source_id", lifecycle.meaning(observed).alias("meaning"))
    cached = rows.persist()
    for run in runs:
        cached.where(F.col("run_id") == run).write.parquet(f"{base}/in-{run}")
    cached.unpersist()
    empty = spark.createDataFrame([], f"{_STATE}, v {rows.schema['meaning'].dataType.simpleString()}")

    state = empty
    for run in runs:

        def step(batch: DataFrame, number: int, state: DataFrame = state, run: int = run) -> None:
            if number:
                raise ValueError(f"run {run} came in more than one batch")
            lifecycle.fold(state, batch, run, sources.get(run, [])).write.mode("overwrite").parquet(f"{base}/state-{run}")

        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in-{run}")
        query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/progress-{run}").trigger(availableNow=True).start()
        query.awaitTermination()
        state = spark.read.schema(empty.schema).parquet(f"{base}/state-{run}")
    return state.drop("v")
