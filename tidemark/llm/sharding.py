"""Two-pass external shuffle into shards.

Pass 1 scatters rows into memory-sized buckets by a seeded hash of their id and text, so every bucket is a uniform
sample of the input. Pass 2 orders each bucket by a hash of whole rows, shuffles it with Fisher-Yates under a seed of
its own and places it behind the buckets before it. Cutting that one sequence into contiguous ranges gives shards
whose row counts differ by one at most (law `rows`), each in uniformly random order.

There are as many buckets as the input needs. Rows before a bucket are summed in two levels: within ranges of
`RANGE` buckets by Spark, and over the ranges' totals (one row for 64 GB of text) on the driver.

Defined cases: a null text counts as empty; a null id is hashed like any value; rows that share an id spread by
their texts; copies of one text under one id share a bucket, unless they fill more than one: then they are dealt
over as many by their place in a written table; equal rows may change places with each other, which no reader can
tell; a very long text is a row like any other, in a bucket that it may fill alone; an empty table gives empty shards;
other columns are carried along, and those named like a result (`shard`, `slot`) give way to it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, materialize, scratch_path

LAW = "rows"
#: Text bytes that a bucket holds on average, and buckets in a range.
BUCKET_BYTES, RANGE = 16 << 20, 4096


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + F.lit(16).cast("long"))


def scattered(docs: DataFrame, seed: int, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Pass 1: `docs` with `bucket`, a seeded hash of id and text.

    Equal ids with equal texts that are more than a bucket are dealt in turn over several; they are written first, so
    that every later reading finds each row in the same place.
    """
    spread = docs.withColumn("spread", F.xxhash64(F.lit(seed), "doc_id", "text"))
    keys = materialize(sized(spread).groupBy("spread").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).where(f"bytes > {bucket_bytes} and n > 1").select("spread"), "heavy")
    total = sized(docs).agg(F.sum("size")).first()[0] or 0
    buckets = max(1, -(-total // bucket_bytes))
    bucket = lambda *salt: F.pmod(F.xxhash64("spread", *salt), F.lit(buckets))
    if not keys.limit(1).count():
        return spread.withColumn("bucket", bucket()).drop("spread")
    heavy = materialize(spread.join(F.broadcast(keys), "spread").withColumn("turn", F.monotonically_increasing_id()), "dealt")  # at most a key for each bucket
    light = spread.join(F.broadcast(keys), "spread", "left_anti").withColumn("bucket", bucket())
    return light.unionByName(heavy.withColumn("bucket", bucket("turn")).drop("turn")).drop("spread")


def bucket_starts(rows: DataFrame) -> tuple[DataFrame, int]:
    """`(bucket, start)`: the rows before each bucket, and the rows in all."""
    counts = materialize(rows.groupBy("bucket").agg(F.count("*").alias("n")), "counts").withColumn("range", F.floor(F.col("bucket") / RANGE).cast("long"))
    ranges = [tuple(r) for r in counts.groupBy("range").agg(F.sum("n")).orderBy("range").collect()]
    before = np.concatenate([[0], np.cumsum([n for _, n in ranges])]).tolist()
    firsts = rows.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(ranges, before, strict=False)], "range long, first long")
    own = F.sum("n").over(Window.partitionBy("range").orderBy("bucket")) - F.col("n")
    return counts.withColumn("own", own).join(F.broadcast(firsts), "range").select("bucket", (F.col("first") + F.col("own")).alias("start")), int(before[-1])


def shard_bounds(rows: int, shards: int) -> np.ndarray:
    """First row of each shard, and the number of rows: the first `rows % shards` shards hold one more."""
    return np.concatenate([[0], np.cumsum(np.full(shards, rows // shards) + (np.arange(shards) < rows % shards))])


def external_shuffle(docs: DataFrame, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of `docs` with `shard` (int) and `slot` (long, gapless from 0 in each shard)."""
    import pyarrow as pa

    narrow, restored = carried(docs, "doc_id", "text")
    kinds = narrow.schema["carried"].dataType.simpleString()
    others = F.lit(0) if "map<" in kinds or "variant" in kinds else F.col("carried")  # Spark hashes neither
    narrow = narrow.withColumn("place", F.xxhash64(F.lit(seed + 1), "doc_id", "text", others))
    rows = scattered(narrow, seed, bucket_bytes)
    starts, total = bucket_starts(rows)
    bounds = shard_bounds(total, shards)
    schema = T.StructType([*narrow.drop("place").schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def place(tables: pa.Table, start: pa.Table) -> pa.Table:
        bucket, first = tables.column("bucket")[0].as_py(), start.column("start")[0].as_py()
        rows = tables.sort_by([("place", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]).drop_columns(["bucket", "place"])
        rows = rows.take(np.random.default_rng([seed, bucket]).permutation(rows.num_rows))  # Fisher-Yates
        at = first + np.arange(rows.num_rows)
        shard = np.searchsorted(bounds, at, side="right") - 1
        return rows.append_column("shard", pa.array(shard, pa.int32())).append_column("slot", pa.array(at - bounds[shard], pa.int64()))

    found = rows.groupBy("bucket").cogroup(starts.groupBy("bucket")).applyInArrow(place, schema)
    return restored(found, "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the shuffled rows as Parquet under `path`, one folder for each shard; a reader orders it by `slot`."""
    external_shuffle(docs, shards, seed, bucket_bytes).write.partitionBy("shard").option("compression", "zstd").parquet(path)


def op10_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_shards(docs, path)
    written = T.StructType([*docs.schema.fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    rows = sized(spark.read.schema(written).parquet(path))
    return rows.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
