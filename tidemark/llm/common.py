"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of the bitmap that `prefilter` broadcasts: 65,536 rows of 16 bytes at most, whatever the input.
BITMAP_BITS = 22
#: A key is hot if it has such a part of all rows, and more rows than a task could mind.
HOT, FEW = 1000, 32
#: Bytes of an Arrow batch, about; a row isn't cut. Workers hold a few times a batch, and outlive a stage.
BATCH_BYTES = 4 << 20
#: Whether Spark removes shuffle files as soon as the query that wrote them ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        root = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: it is computed once and outlives lost executors.

    What it shuffled is removed when it is written, as the table is read in its place.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    given = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, given)
    return spark.read.schema(df.schema).parquet(path)


def bounded(spark: SparkSession) -> None:
    """Bound batches by their bytes, in the session as stages are lazy; a smaller bound of the caller's stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting))
    if given > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def drop_table(df: DataFrame) -> None:
    """Remove a table made by `materialize` once nothing will read it again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as it takes not to be a column of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def carried(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """`docs` as the columns `own` and a struct `carried` of all others, so that no column of the caller's can clash
    with an operator's; and what makes of its result the caller's columns again, with the named ones behind them.

    A column of the caller's that is named like a result gives way to it.
    """
    mine = {c.lower() for c in own}
    others = [c for c in docs.columns if c.lower() not in mine]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    narrow = docs.select(*own, (F.struct(*map(quoted, others)) if others else F.lit(True)).alias("carried"))

    def restored(found: DataFrame, *results: str) -> DataFrame:
        new = {c.lower() for c in results}
        kept = [F.col(c) if c.lower() in mine else F.col("carried").getField(c).alias(c) for c in docs.columns if c.lower() not in new]
        return found.select(*kept, *results)

    return narrow, restored


def first_by_hash(rows: DataFrame, n: int, size: int, seed: int, *key: str, wide: bool = False) -> DataFrame:
    """The `n` of `size` rows with the smallest hashes of `key`, in this order.

    Only rows below a bound go further, about four times as many as are asked for; the bound is a 64-bit hash, so it
    is as fine as any size needs. Where few keys have most rows, fewer than `n` rows may lie below: `wide` takes all.
    """
    place = F.xxhash64(F.lit(seed), *key)
    share = (4 * n + 100) / max(1, size)
    few = rows if wide or share >= 1 else rows.where(place < F.lit(int(share * 2**64) - 2**63))
    return few.orderBy(place, *key).limit(n)


def sampled(rows: DataFrame, n: int, size: int, seed: int, *key: str) -> list:
    """`first_by_hash` collected: `n` rows, or all where there are fewer."""
    found = first_by_hash(rows, n, size, seed, *key).collect()
    return found if len(found) >= min(n, size) else first_by_hash(rows, n, size, seed, *key, wide=True).collect()


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str = "n", how: str = "inner", hashed: bool = False) -> DataFrame:
    """`rows` joined (inner or left) with `counted`: one row for each key, and in `n` the number of `rows` with it.

    hashed: `counted` is narrow, so a task holds its part of it, a row for each key, and `rows` aren't sorted.

    A key with a `HOT`-th of all rows is hot; there are `HOT` of them at most, whatever the input, so they are
    broadcast, and no task gets all rows of one. `rows` and `counted` are read twice where there are hot keys.
    """
    total = counted.agg(F.sum(n)).first()[0] or 0
    is_hot = (F.col(n) * HOT >= total) & (F.col(n) > FEW)
    hot = counted.where(is_hot)
    held = lambda df: df.drop(n).hint("shuffle_hash") if hashed else df.drop(n)
    if not hot.limit(1).count():
        return rows.join(held(counted), keys, how)
    warm = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(held(counted.where(~is_hot)), keys, how)
    return warm.unionByName(rows.join(F.broadcast(hot.drop(n)), keys))


class Bitmap:
    """A set of 64-bit hashes by their last `bits` bits: of fixed size, and never without one that is in the set."""

    def __init__(self, hashes: DataFrame, bits: int):
        """hashes: one column of longs."""
        (name,) = hashes.columns
        self.mask, self.words = np.uint64((1 << bits) - 1), np.zeros(1 << (bits - 6), dtype=np.uint64)
        bit = hashes.select(F.pmod(name, F.lit(1 << bits)).alias("b"))
        for word, value in bit.groupBy((F.col("b") / 64).cast("int")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))")).collect():
            self.words[word] = np.int64(value).view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _bit_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS))


def _marked(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, str]:
    """`df` and the name of a new column: whether the key may be in `ids`; false only where it isn't, or is null.

    A one-hash bitmap of fixed size is broadcast, so its bound doesn't depend on the data.
    """
    word, bits, maybe = unused(df, "word", "bits", "maybe")
    bit = _bit_of(F.col(key))
    words = ids.select(_bit_of(F.col(key)).alias("b")).groupBy((F.col("b") / 64).cast("int").alias(word))
    bitmap = words.agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias(bits))
    marked = df.withColumn(word, (bit / 64).cast("int")).join(F.broadcast(bitmap), word, "left")
    there = F.getbit(F.coalesce(bits, F.lit(0).cast("long")), F.pmod(bit, F.lit(64)).cast("int")) == 1
    return marked.withColumn(maybe, there & F.col(key).isNotNull()).drop(word, bits), maybe


def prefilter(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key may be in `ids` (all that are, few others), without shuffling `df`.

    Where `ids` fill the bitmap, it lets more rows through; an inner join on the key has to follow in any case.
    """
    marked, maybe = _marked(df, ids, key)
    return marked.where(maybe).drop(maybe)


def split_by(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """`df` in two: rows whose key may be in `ids`, and rows whose key isn't (nor is a null); neither is shuffled."""
    marked, maybe = _marked(df, ids, key)
    return marked.where(maybe).drop(maybe), marked.where(~F.col(maybe)).drop(maybe)


def without(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of `df` whose key isn't in `ids`; only those that may be are shuffled."""
    maybe, rest = split_by(df, ids, key)
    return rest.unionByName(maybe.join(ids.select(key), key, "left_anti"))


# ---- 64-bit hashing in numpy ------------------------------------------------------------------

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
#: An odd multiplier: a tuple of word hashes is a polynomial in it.
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> _S33)
    x = x * _M1
    x ^= x >> _S33
    x = x * _M2
    x ^= x >> _S33
    return x


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, from the words' hashes; all words as one where there are fewer."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    acc = words[:m].copy()
    for j in range(1, n):
        acc = acc * BASE + words[j : j + m]
    return mix64(acc + np.uint64(n))


class WordHasher:
    """64-bit hashes of byte words, remembered for the frequent ones up to a fixed number."""

    def __init__(self, limit: int = 400_000):
        import xxhash

        self.digest, self.limit, self.known = xxhash.xxh3_64_intdigest, limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self.known, self.digest
        if len(known) > self.limit:
            known.clear()
        out = []
        for w in words:
            h = known.get(w)
            if h is None:
                h = known[w] = digest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def utf8(column) -> list:
    """The values of an Arrow string column as bytes (None stays), without decoding them."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


# ---- places in a sorted whole -----------------------------------------------------------------

#: Rows of a table that may be broadcast.
SMALL = 100_000


def small(df: DataFrame) -> DataFrame:
    """`df`, to be broadcast if it has `SMALL` rows at most; otherwise Spark joins it by shuffling."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def placed(rows: DataFrame, group: list[str], order: list[str | Column], place: str) -> DataFrame:
    """`rows` sorted by `group` (nulls first) and `order`, with their place in the group, a long from 0.

    The sort is a distributed one, written once; what is before a row is its place in its partition, and the rows that
    earlier partitions have of its group, of which there is one count for each partition and group. A group may have
    any number of rows: equal keys are split over partitions too.
    """
    mid, part, first, before, n, tie = unused(rows, "mid", "part", "first", "before", "n", "tie")
    keyed = rows.withColumn(tie, F.monotonically_increasing_id()).orderBy(*(F.col(g).asc_nulls_first() for g in group), *order, tie).drop(tie)
    rows = materialize(keyed.withColumn(mid, F.monotonically_increasing_id()), "sorted")
    found = rows.withColumn(part, F.shiftright(mid, 33))
    runs = found.groupBy(part, *group).agg(F.min(mid).alias(first), F.count("*").alias(n))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    runs = materialize(runs.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n), "runs").alias("runs")
    same = F.col(f"rows.{part}") == F.col(f"runs.{part}")
    for g in group:
        same &= F.col(f"rows.{g}").eqNullSafe(F.col(f"runs.{g}"))
    joined = found.alias("rows").join(small(runs), same)
    return joined.select(*(F.col(f"rows.`{c}`") for c in rows.columns if c != mid), (F.col(before) + F.col(mid) - F.col(first)).alias(place))
