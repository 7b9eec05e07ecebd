"""Token ids in binary shards, with a minimal perfect hash index from document keys to places in them.

The format, under one folder:

- `payload/*.ids`: little-endian ids of 16 or 32 bits and nothing else, documents one behind the other, in ascending order of
  document ids over all files;
- `shards` (Parquet): number, file, and the ids and documents before it, of each payload file;
- `index/*.mph`: for a bucket of keys, a minimal perfect hash, and for each of its values a fingerprint, shard, first id
  and length, in columns of fixed width;
- `buckets` (Parquet): number and file of each bucket; `keys` (Parquet): the keys; `about` (Parquet): width, counts.

A key is a document id and a copy number, as rows may share an id: 0 for the first, and so on. The hash is built level by level:
keys that meet no other in a level's bits stay there, the others go on, and a key's value is the number of bits set
before its own. A look-up reads a few words, one count and one record, whatever the size, and a fingerprint
of 32 bits tells keys that were never stored (one in four billions passes).

Texts are sorted by Spark and tokenized where they are written, so each task writes its stretch. Files are named anew
by each attempt and only those that a finished task told are listed, so a lost executor leaves nothing that is read.

Defined cases: a null or empty text is its end id alone; a null id is a key of its own, before the others; rows of one id stand
in order of their hashes; equal rows are copies, spread over files and buckets; a very long text is held by the task that
writes or reads it; an empty table gives a store without files; other columns aren't read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, join_counted, materialize, mix64, scratch_path, small, split_by, table
from .tokens import byte_encoder

END = 0
#: Bytes of a payload file after which the next one begins, and keys of an index file.
SHARD_BYTES, BUCKET_KEYS = 256 << 20, 1 << 17
#: Bits of a level for each key that goes through it, and files whose ids are summed together.
ROOM, RANGE = 2, 4096
MAGIC = b"TMMPH001"
_PLACED = "doc_id long, shard long, file string, at long, n long"


# ---- minimal perfect hash ---------------------------------------------------------------------


def _bits(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
    return mix64(low ^ mix64(high + np.uint64(level * int(BASE) & (1 << 64) - 1))) % np.uint64(size)


class PerfectHash:
    """Maps n keys (pairs of 64-bit hashes) onto 0 to n - 1; other keys onto anything there, or -1."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, low: np.ndarray, high: np.ndarray) -> PerfectHash:
        """low, high: distinct as pairs."""
        sizes, levels = [], []
        while len(low):
            if len(sizes) == 64:
                raise ValueError("keys aren't distinct")
            size = -(-ROOM * len(low) // 64) * 64
            at = _bits(low, high, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[at]
            low, high = low[left], high[left]
        return cls(sizes, np.concatenate([np.zeros(0, dtype="<u8"), *levels]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out, left, base = np.full(len(low), -1, dtype=np.int64), np.arange(len(low)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _bits(low[left], high[left], level, size).astype(np.int64) + base
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            there = (self.words[word] >> bit) & np.uint64(1) == 1
            found = left[there]
            rank = np.bitwise_count(self.words[word[there]] & ((np.uint64(1) << bit[there]) - np.uint64(1)))
            out[found] = self.before[word[there]] + rank
            left, base = left[~there], base + size
        return out


def index_bytes(low: np.ndarray, high: np.ndarray, shard: np.ndarray, at: np.ndarray, n: np.ndarray) -> bytes:
    """An index file: head, levels, words, bits set before each word, fingerprints, shards, first ids, lengths."""
    hashed = PerfectHash.build(low, high)
    order = np.empty(len(low), dtype=np.int64)
    order[hashed(low, high)] = np.arange(len(low))
    head = MAGIC + struct.pack(f"<QQ{len(hashed.sizes)}Q", len(low), len(hashed.sizes), *hashed.sizes)
    parts = [hashed.words.astype("<u8"), hashed.before[:-1].astype("<u4"), fingerprint(high)[order].astype("<u4"), shard[order].astype("<u8"), at[order].astype("<u8"), n[order].astype("<u8")]
    return head + b"".join(x.tobytes() for x in parts)


def fingerprint(high: np.ndarray) -> np.ndarray:
    return (mix64(high) >> np.uint64(32)).astype(np.uint32)


class Index:
    """An index file, whole, for many look-ups at once."""

    def __init__(self, data: bytes, name: str = ""):
        if data[:8] != MAGIC:
            raise ValueError(f"{name} isn't an index")
        n, levels = struct.unpack_from("<QQ", data, 8)
        sizes = struct.unpack_from(f"<{levels}Q", data, 24)
        at, columns = 24 + 8 * levels, []
        for kind, count in (("<u8", sum(sizes) // 64), ("<u4", sum(sizes) // 64), ("<u4", n), ("<u8", n), ("<u8", n), ("<u8", n)):
            columns.append(np.frombuffer(data, kind, count, at))
            at += columns[-1].nbytes
        if at != len(data):
            raise ValueError(f"{name} has another length than its head says")
        words, _, self.prints, self.shard, self.first, self.length = columns
        self.hash = PerfectHash(list(sizes), words.astype(np.uint64))

    def find(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The record of each key, and whether its fingerprint is the key's."""
        if not len(self.prints):
            return np.zeros(len(low), dtype=np.int64), np.zeros(len(low), dtype=bool)
        value = self.hash(low, high)
        record = np.maximum(value, 0)
        return record, (value >= 0) & (self.prints[record] == fingerprint(high))


# ---- writing ----------------------------------------------------------------------------------


def key_text(doc_id: Column, copy: Column) -> Column:
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), copy.cast("string"))


def _hashes(rows: DataFrame, buckets: int) -> DataFrame:
    """`rows(doc_id, copy)` with `low`, `high` and `bucket`."""
    keyed = rows.withColumn("key", key_text(F.col("doc_id"), F.col("copy")))
    return keyed.withColumns({"low": F.xxhash64("key"), "high": F.xxhash64(F.concat("key", F.lit("#")))}).withColumn("bucket", F.pmod("high", F.lit(buckets))).drop("key")


def _payload(docs: DataFrame, path: str, tokenizer: str, end: int, shard_bytes: int) -> DataFrame:
    """Write the payload; `(doc_id, shard, file, at, n)`: shards are numbered in order of documents, at: the ids before it there."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(f"{path}/payload")
        encode, shard, out, name, at = byte_encoder(tokenizer), TaskContext.get().partitionId() << 20, None, "", 0
        last, width = np.array([end], dtype=encode.kind).tobytes(), np.dtype(encode.kind).itemsize
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                rows, told = batch.slice(first, 512), []
                for doc_id, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if out is None:
                        system.create_dir(folder, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.ids", 0
                        out = system.open_output_stream(f"{folder}/{name}", compression=None)
                    ids = encode(text) + last
                    out.write(ids)
                    told.append((doc_id, shard, name, at, len(ids) // width))
                    at += len(ids) // width
                    if at * width >= shard_bytes:
                        out.close()
                        out, shard = None, shard + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*told, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "shard", "file", "at", "n"])
        if out is not None:
            out.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tied = rows.withColumns({"hash": F.xxhash64("text"), "tie": F.monotonically_increasing_id()})  # so that rows of one id, however many, are dealt over tasks
    return materialize(tied.orderBy(F.asc_nulls_first("doc_id"), "hash", "tie").select("doc_id", "text").mapInArrow(run, _PLACED), "payload")


def _shards(rows: DataFrame) -> DataFrame:
    """`(shard, file, first, first_doc)`: the ids and documents before each shard, summed in ranges of shards."""
    each = rows.groupBy("shard", "file").agg(F.sum("n").alias("ids"), F.count("*").alias("docs"))
    each = materialize(each.withColumn("range", F.shiftright("shard", 20 + RANGE.bit_length() - 1)), "shards")
    told = each.groupBy("range").agg(F.sum("ids").alias("ids"), F.sum("docs").alias("docs")).orderBy("range").collect()  # a row for RANGE tasks
    before, ids, docs = [], 0, 0
    for r in told:
        before.append((r["range"], ids, docs))
        ids, docs = ids + r["ids"], docs + r["docs"]
    ranges = rows.sparkSession.createDataFrame(before, "range long, ids_before long, docs_before long")
    earlier = Window.partitionBy("range").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = each.withColumns({"own_ids": own("ids"), "own_docs": own("docs")}).join(F.broadcast(ranges), "range")
    return sums.select("shard", "file", (F.col("ids_before") + F.col("own_ids")).alias("first"), (F.col("docs_before") + F.col("own_docs")).alias("first_doc"), "ids", "docs")


def _copies(rows: DataFrame, shards: DataFrame) -> DataFrame:
    """`rows` with `copy`: the number of its row among those of its id, in order."""
    number = F.row_number().over(Window.partitionBy("shard").orderBy("at"))
    placed = rows.withColumn("own", number).join(small(shards.select("shard", "first_doc")), "shard")
    placed = placed.select("doc_id", "shard", "at", "n", (F.col("first_doc") + F.col("own")).alias("number"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    again = materialize(placed.groupBy("id").agg(F.min("number").alias("low"), F.count("*").alias("rows")).where("rows > 1"), "repeated")
    maybe, once = split_by(placed, again, "id")
    both = join_counted(maybe, again, ["id"], n="rows", how="left").unionByName(once, allowMissingColumns=True)
    return both.select("doc_id", (F.col("number") - F.coalesce("low", "number")).alias("copy"), "shard", "at", "n")


def write_store(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard_bytes: int = SHARD_BYTES, bucket_keys: int = BUCKET_KEYS) -> None:
    """Tokenize `docs(doc_id, text)` and write them under `path`, a folder that all executors reach."""
    import pyarrow as pa

    spark = docs.sparkSession
    rows = _payload(docs, path, tokenizer, end, shard_bytes)
    _shards(rows).write.parquet(f"{path}/shards")
    shards = spark.read.parquet(f"{path}/shards")
    keyed = materialize(_copies(rows, shards), "placed")
    keyed.select("doc_id", "copy").write.parquet(f"{path}/keys")
    count = keyed.count()
    buckets = max(1, -(-count // bucket_keys))

    def build(bucket: pa.Table) -> pa.Table:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(f"{path}/index")
        system.create_dir(folder, recursive=True)
        name = f"{uuid.uuid4().hex}.mph"
        column = lambda c: bucket.column(c).to_numpy()
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            out.write(index_bytes(column("low").view(np.uint64), column("high").view(np.uint64), column("shard"), column("at"), column("n")))
        return pa.table({"bucket": pa.array([bucket.column("bucket")[0].as_py()], pa.int64()), "file": pa.array([name]), "keys": pa.array([bucket.num_rows], pa.int64())})

    built = _hashes(keyed, buckets).drop("doc_id", "copy").groupBy("bucket").applyInArrow(build, "bucket long, file string, keys long")
    built.write.parquet(f"{path}/buckets")
    width = np.dtype(byte_encoder(tokenizer).kind).itemsize
    spark.createDataFrame([(1, width, buckets, count)], "version int, width int, buckets long, documents long").coalesce(1).write.parquet(f"{path}/about")


# ---- reading ----------------------------------------------------------------------------------


def _about(spark: SparkSession, path: str):
    about = spark.read.parquet(f"{path}/about").first()
    if about["version"] != 1:
        raise ValueError(f"version {about['version']} of the format isn't known")
    return about


def look_up(keys: DataFrame, path: str) -> DataFrame:
    """`(doc_id, copy, found, shard, at, n)` of `keys(doc_id, copy)`, by the index of each key's bucket."""
    import pyarrow as pa

    spark = keys.sparkSession
    about = _about(spark, path)

    def find(asked: pa.Table, own: pa.Table) -> pa.Table:
        from pyarrow import fs

        low, high = (asked.column(c).to_numpy().view(np.uint64) for c in ("low", "high"))
        n = len(low)
        record, found, columns = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), [np.zeros(n, dtype=np.int64)] * 3
        if own.num_rows and n:
            system, folder = fs.FileSystem.from_uri(f"{path}/index")
            name = own.column("file")[0].as_py()
            with system.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                index = Index(stream.read(), name)
            record, found = index.find(low, high)
            columns = [c[record].astype(np.int64) for c in (index.shard, index.first, index.length)]
        places = [pa.array(c, mask=~found) for c in columns]
        return pa.Table.from_arrays([asked.column("doc_id").cast(pa.int64()), asked.column("copy").cast(pa.int64()), pa.array(found), *places], names=["doc_id", "copy", "found", "shard", "at", "n"])

    files = spark.read.parquet(f"{path}/buckets").select("bucket", "file")
    return _hashes(keys, about["buckets"]).groupBy("bucket").cogroup(files.groupBy("bucket")).applyInArrow(find, "doc_id long, copy long, found boolean, shard long, at long, n long")


def read_ids(places: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """`(doc_id, copy, start, n_tokens, ids)` of `look_up`'s places: ids little-endian of 32 bits, or with `digest` their crc32.

    The documents of a payload file are read in order of their places; start: the ids before it in the whole store.
    """
    import pyarrow as pa

    spark = places.sparkSession
    width = _about(spark, path)["width"]
    kind = pa.int64() if digest else pa.binary()

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), kind), strict=True)], names=["doc_id", "copy", "start", "n_tokens", "ids"])

    def read(asked: Iterator[pa.RecordBatch], own: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        asked, own = pa.Table.from_batches(asked).sort_by("at"), pa.Table.from_batches(own)
        if not asked.num_rows:
            return
        system, folder = fs.FileSystem.from_uri(f"{path}/payload")
        first = own.column("first")[0].as_py()
        with system.open_input_file(f"{folder}/{own.column('file')[0].as_py()}") as stream:
            rows, size = [], 0
            for doc_id, copy, at, n in zip(*(asked.column(c).to_pylist() for c in ("doc_id", "copy", "at", "n")), strict=True):
                if stream.tell() != at * width:
                    stream.seek(at * width)
                data = stream.read(n * width)
                if len(data) != n * width:
                    raise ValueError(f"document {doc_id} ends behind its file")
                ids = np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()
                rows.append((doc_id, copy, first + at, n, zlib.crc32(ids) if digest else ids))
                size += 64 if digest else len(ids)
                if size > 4 << 20:
                    yield told(rows)
                    rows, size = [], 0
            if rows:
                yield told(rows)

    def whole(asked: pa.Table, own: pa.Table) -> pa.Table:
        schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "copy", "start", "n_tokens")] + [("ids", kind)])
        return pa.Table.from_batches(read(iter(asked.to_batches()), iter(own.to_batches())), schema)

    files = spark.read.parquet(f"{path}/shards").select("shard", "file", "first")
    found = places.where("found").select("doc_id", "copy", "shard", "at", "n")
    return found.groupBy("shard").cogroup(files.groupBy("shard")).applyInArrow(whole, f"doc_id long, copy long, start long, n_tokens long, ids {'long' if digest else 'binary'}")


class TokenStore:
    """A store for look-ups of single documents: each reads a few places of an index file, and the document's ids."""

    def __init__(self, spark: SparkSession, path: str):
        about = _about(spark, path)
        self.path, self.width, self.buckets = path, about["width"], about["buckets"]
        self.spark = spark

    def _open(self, name: str):
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(self.path)
        return system.open_input_file(f"{folder}/{name}")

    def ids(self, doc_id: int | None, copy: int = 0) -> np.ndarray | None:
        """The ids of a document, its end id included; None if there is none of this key."""
        import xxhash

        key = f"{'' if doc_id is None else doc_id}:{copy}".encode()
        low, high = (np.array([xxhash.xxh64_intdigest(k, seed=42)], dtype=np.uint64) for k in (key, key + b"#"))
        bucket = int(high.view(np.int64)[0]) % self.buckets
        files = self.spark.read.parquet(f"{self.path}/buckets").where(F.col("bucket") == bucket).collect()
        if not files:
            return None
        with self._open(f"index/{files[0]['file']}") as f:
            take = lambda at, kind, count=1: (f.seek(at), np.frombuffer(f.read(np.dtype(kind).itemsize * count), kind))[1]
            n, levels = (int(x) for x in take(8, "<u8", 2))
            sizes = [int(x) for x in take(24, "<u8", levels)]
            words, base = 24 + 8 * levels, 0
            counts = words + sum(sizes) // 8
            prints = counts + sum(sizes) // 16
            for level, size in enumerate(sizes):
                at = base + int(_bits(low, high, level, size)[0])
                word, bit = int(take(words + at // 64 * 8, "<u8")[0]), at % 64
                if word >> bit & 1:
                    value = int(take(counts + at // 64 * 4, "<u4")[0]) + (word & ((1 << bit) - 1)).bit_count()
                    break
                base += size
            else:
                return None
            if take(prints + 4 * value, "<u4")[0] != fingerprint(high)[0]:
                return None
            shard, first, length = (int(take(prints + 4 * n + 8 * (k * n + value), "<u8")[0]) for k in range(3))
        (payload,) = self.spark.read.parquet(f"{self.path}/shards").where(F.col("shard") == shard).collect()
        with self._open(f"payload/{payload['file']}") as f:
            f.seek(first * self.width)
            return np.frombuffer(f.read(length * self.width), f"<u{self.width}")


def op12_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    keys = spark.read.parquet(f"{path}/keys")
    found = read_ids(look_up(keys, path), path, digest=True)
    return found.select("doc_id", "start", "n_tokens", F.col("ids").alias("ids_crc32"))
