"""Memberships as the state of one stream: what each entry of each source is known by meets the next polls' rows.

A row says which poll of its source answered before it (`prior`), so whether the source was without the entry in between
follows from the key's own state, and a key that a poll doesn't list keeps it: its end is the first answer behind its
last row, which is worked out when memberships are read. The state is a table with one row for each key, however many polls
there were; a batch of the stream is joined to it by one shuffle, natively, as a call of Python for each key takes
milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import lifecycle

ROW = "run_id int, canonical_id string, source_id string, prior int, meaning string"
_KEY = ["canonical_id", "source_id"]
_STATE = "canonical_id string, source_id string, first_seen int, last_seen int, last_run int, meaning string"


def fold(state: DataFrame, rows: DataFrame) -> DataFrame:
    """`state` after `rows`: first and last change of a key, its last row's poll, and what that row said.

    Rows of polls that came before, or come again, change nothing.
    """
    none = F.lit(None).cast("int")
    old = state.select(*_KEY, F.col("last_run").alias("run_id"), none.alias("prior"), "meaning", "first_seen", "last_seen", F.lit(0).alias("new"))
    new = rows.select(*_KEY, "run_id", "prior", "meaning", none.alias("first_seen"), none.alias("last_seen"), F.lit(1).alias("new"))
    key, order = Window.partitionBy(*_KEY), Window.partitionBy(*_KEY).orderBy("run_id", "new")
    known = F.max(F.when(F.col("new") == 0, F.col("run_id"))).over(key)
    told = old.unionByName(new).withColumns({"known": known, "again": F.lag("run_id").over(order).eqNullSafe(F.col("run_id"))})
    told = told.where("not again and (known is null or run_id >= known)").withColumns({"before": F.lag("run_id").over(order), "said": F.lag("meaning").over(order)})
    changed = F.col("before").isNull() | (F.col("meaning") != F.col("said")) | F.coalesce(F.col("prior") > F.col("before"), F.lit(False))
    last = F.when(F.col("new") == 0, F.col("last_seen")).when(changed, F.col("run_id"))
    return told.groupBy(*_KEY).agg(
        F.min(F.coalesce("first_seen", "run_id")).alias("first_seen"), F.max(last).alias("last_seen"), F.max("run_id").alias("last_run"), F.max_by("meaning", "run_id").alias("meaning")
    )


def rows_of(observed: DataFrame, polls: DataFrame) -> DataFrame:
    """The stream's rows of observations (one for each run, entity and source, of polls that answered)."""
    order = Window.partitionBy("source_id").orderBy("run_id")
    answers = polls.where("ok").select("run_id", "source_id", F.lag("run_id").over(order).alias("prior"))
    said = F.sha2(F.to_json(F.struct(lifecycle.meaning(observed).alias("m")), {"ignoreNullFields": "false"}), 256)
    rows = observed.select(F.col("run_id").cast("int").alias("run_id"), "canonical_id", "source_id", said.alias("meaning")).join(answers, ["run_id", "source_id"])
    return rows.select("run_id", "canonical_id", "source_id", F.col("prior").cast("int").alias("prior"), "meaning")


def _version(spark: SparkSession, checkpoint: str) -> int:
    """The batch whose state was written last; -1 before the first."""
    spark.createDataFrame([], "batch long").write.mode("append").parquet(f"{checkpoint}/versions")  # so that there is a folder
    return spark.read.schema("batch long").parquet(f"{checkpoint}/versions").agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def _state(spark: SparkSession, checkpoint: str, version: int) -> DataFrame:
    """The state behind a batch. Two folders take turns, so that a batch never writes what it reads."""
    return spark.read.schema(_STATE).parquet(f"{checkpoint}/state-{version % 2}") if version >= 0 else spark.createDataFrame([], _STATE)


def advance(spark: SparkSession, folder: str, checkpoint: str) -> None:
    """Take all that has come to `folder` since the last call into the state under `checkpoint`, and stop.

    A call that is broken off goes on from its last finished batch; a batch whose state was written isn't folded again.
    """

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        version = _version(session, checkpoint)
        if version < number:
            fold(_state(session, checkpoint, version), batch).write.mode("overwrite").parquet(f"{checkpoint}/state-{number % 2}")
            session.createDataFrame([(number,)], "batch long").write.mode("append").parquet(f"{checkpoint}/versions")

    rows = spark.readStream.schema(ROW).option("recursiveFileLookup", "true").parquet(folder)
    rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/progress").trigger(availableNow=True).start().awaitTermination()


def read(spark: SparkSession, checkpoint: str, polls: DataFrame) -> DataFrame:
    """`(canonical_id, source_id, first_seen, last_seen, inactive_at, active)`, from the state and the polls that answered."""
    state = _state(spark, checkpoint, _version(spark, checkpoint))
    order = Window.partitionBy("source_id").orderBy("run_id")
    after = polls.where("ok").select("source_id", F.col("run_id").cast("int").alias("last_run"), F.lead("run_id").over(order).cast("int").alias("inactive_at"))
    ended = state.join(after, ["source_id", "last_run"], "left")
    return ended.select("canonical_id", "source_id", "first_seen", "last_seen", "inactive_at", F.col("inactive_at").isNull().alias("active"))


def run(observed: DataFrame, polls: DataFrame, base: str, stops: list[int] = ()) -> DataFrame:
    """Memberships after all polls, each of which is a folder under `base`; the stream ends behind the polls in `stops`, and a
    new one goes on from its state."""
    spark = observed.sparkSession
    rows = rows_of(observed, polls).persist()
    runs = sorted(r["run_id"] for r in polls.select("run_id").distinct().collect())
    for number in runs:
        rows.where(F.col("run_id") == number).write.parquet(f"{base}/rows/run={number}")
        if number in stops or number == runs[-1]:
            advance(spark, f"{base}/rows", f"{base}/state")
    rows.unpersist()
    return read(spark, f"{base}/state", polls)
