"""Benchmark decontamination by a prefix-filtered set join.

A window of an item is the set of its word shingles, and a document contains a window only if it contains all
of them; so of a window's shingles, ordered by rarity in the corpus, the first one alone is a necessary prefix
(containment 1 leaves a prefix of |shingles| - |shingles| + 1 = 1).

Windows are a table, and so are their shingles. A pass over the corpus counts in how many documents each of these
occurs; windows with a shingle that none has are gone, the others keep their rarest. A second pass gives the places
of these prefixes in documents, which Spark joins with the windows' prefixes. A candidate is bound by position (the
window has to start at or after the first word) and by length (and to end in the document). What is left is
verified exactly: the words at the candidate's place are joined with the windows' words.

Both passes leave out shingles that the benchmark can't have by a bitmap of `BITS` bits, the only thing that is
broadcast by hand; with a benchmark that fills it they let more through, and joins drop that again. Texts aren't
shuffled but for those with candidates, once each, however many copies there are.

Defined cases: null texts and texts without words have no words and no hits; an item without words takes no
part; items with equal ids count once; an item without id counts under the empty id; repeated rows are judged
one by one; an empty benchmark hits nothing; a very long text or item is split into words whole, and its windows
are rows of their own; other columns are carried along, and those named like a result give way to it.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Bitmap, WordHasher, carried, join_counted, materialize, ngram_hashes, prefilter, split_by, table, utf8

WINDOW = 10
#: Words in a shingle, and bits of the bitmaps (2 MB).
SHINGLE, BITS = 3, 24
#: Rows of one Arrow batch that a task gives.
BATCH_ROWS = 20_000
#: A-Z to a-z; ASCII other than letters and digits separates words.
_FOLD = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256)).lower()


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """`(item_id, window, length, shingles)`: a row for each window of each item, its words joined by spaces."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                words = words_of(text)
                n = min(window, len(words))
                k = min(SHINGLE, n)
                keys = ngram_hashes(hasher(words), k).view(np.int64)
                for first in range(0, len(words) - n + 1 if n else 0, BATCH_ROWS):
                    at = range(first, min(first + BATCH_ROWS, len(words) - n + 1))
                    columns = [[item_id] * len(at), [b" ".join(words[i : i + n]).decode() for i in at], [n] * len(at), [keys[i : i + n - k + 1] for i in at]]
                    types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item_id", "window", "length", "shingles"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").where("text is not null")
    return rows.mapInArrow(run, "item_id string, window string, length int, shingles array<long>")


def _places(hasher: WordHasher, known: Bitmap, sizes: list[int], text: bytes) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of words, and hashes and places of the shingles that may be in the bitmap."""
    words = words_of(text)
    hashes, found, places = hasher(words), [], []
    for k in sizes:
        if len(words) >= k:
            keys = ngram_hashes(hashes, k)
            at = np.flatnonzero(known.has(keys))
            found.append(keys[at])
            places.append(at)
    empty = [np.empty(0, dtype=np.uint64)]
    return len(words), np.concatenate(found or empty), np.concatenate(places or [np.empty(0, dtype=np.int64)])


def shingle_frequencies(texts: DataFrame, shingles: DataFrame, sizes: list[int]) -> DataFrame:
    """`(shingle, docs)`: for each of the benchmark's shingles that the corpus has, the number of rows with it."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(Bitmap(shingles.select("shingle"), BITS))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = WordHasher(), shared.value
        for batch in batches:
            each = [np.unique(_places(hasher, known, sizes, t)[1]) for t in utf8(batch.column(0))]
            keys, n = np.unique(np.concatenate(each), return_counts=True) if each else (np.empty(0, np.uint64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], names=["shingle", "docs"])

    return texts.select("text").mapInArrow(count, "shingle long, docs long").groupBy("shingle").agg(F.sum("docs").alias("docs"))


def prefixes_of(windows: DataFrame, frequencies: DataFrame) -> DataFrame:
    """`(shingle, spots)`: the rarest shingle of each window, and where in windows of which lengths it is.

    A window with a shingle that no document has is nowhere to be found and has no prefix.
    """
    each = windows.select("window", "length", F.posexplode("shingles").alias("offset", "shingle"), F.size("shingles").alias("n"))
    seen = each.join(frequencies, "shingle").groupBy("window", "length", "n").agg(F.min(F.struct("docs", "offset", "shingle")).alias("rarest"), F.count("*").alias("found"))
    prefixes = seen.where("found = n").select("rarest.shingle", "rarest.offset", "length").distinct()
    return prefixes.groupBy("shingle").agg(F.collect_list(F.struct("offset", "length")).alias("spots"))


def candidates_of(texts: DataFrame, prefixes: DataFrame, sizes: list[int]) -> DataFrame:
    """`(text_key, starts)`: where (start, length) windows may be in texts, within their bounds."""
    import pyarrow as pa

    shared = texts.sparkSession.sparkContext.broadcast(Bitmap(prefixes.select("shingle"), BITS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, known = WordHasher(), shared.value
        for batch in batches:
            found = [_places(hasher, known, sizes, t) for t in utf8(batch.column(1))]
            at = [i for i, f in enumerate(found) if len(f[1])]
            if at:
                lists = [pa.array([found[i][c].view(np.int64) for i in at], pa.list_(pa.int64())) for c in (1, 2)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([found[i][0] for i in at], pa.int64()), *lists], names=["text_key", "n_words", "shingles", "places"])

    rows = texts.select("text_key", "text").mapInArrow(scan, "text_key binary, n_words long, shingles array<long>, places array<long>")
    each = rows.select("text_key", "n_words", F.explode(F.arrays_zip("shingles", "places")).alias("p")).select("text_key", "n_words", F.col("p.shingles").alias("shingle"), F.col("p.places").alias("place"))
    near = each.join(prefixes, "shingle").select("text_key", "n_words", "place", F.explode("spots").alias("s"))
    starts = near.select("text_key", "n_words", (F.col("place") - F.col("s.offset")).alias("start"), "s.length").where("start >= 0 and start + length <= n_words")
    return starts.groupBy("text_key").agg(F.collect_set(F.struct("start", "length")).alias("starts"))


def candidate_windows(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """`(text_key, window, length, starts)`: the words at the candidates' places."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.binary(), pa.string(), pa.int32(), pa.list_(pa.int64())]
        for batch in batches:
            for key, text, starts in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words, at = words_of(text), defaultdict(list)
                for s in starts:
                    at[b" ".join(words[s["start"] : s["start"] + s["length"]]), s["length"]].append(s["start"])
                rows = [(key, w.decode(), n, places) for (w, n), places in at.items()]
                for first in range(0, len(rows), BATCH_ROWS):
                    part = zip(*rows[first : first + BATCH_ROWS], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, types, strict=True)], names=["text_key", "window", "length", "starts"])

    chosen = prefilter(texts, candidates, "text_key").dropDuplicates(["text_key"]).join(candidates, "text_key")
    return chosen.select("text_key", "text", "starts").mapInArrow(run, "text_key binary, window string, length int, starts array<long>")


def _text_key():
    return F.unhex(F.md5("text"))


def contaminated_texts(texts: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """`(text_key, hit_words, items)` of the texts in `(text_key, text)` that hold a window."""
    rows = materialize(windows_of(benchmark, window), "windows")
    windows = rows.groupBy("window", "length").agg(F.first("shingles").alias("shingles"))  # equal windows have equal ones
    sizes = sorted({min(SHINGLE, r["length"]) for r in rows.select("length").distinct().collect()})
    shingles = rows.select(F.explode("shingles").alias("shingle")).distinct()
    prefixes = materialize(prefixes_of(windows, shingle_frequencies(texts, shingles, sizes)), "prefixes")
    candidates = materialize(candidates_of(texts, prefixes, sizes), "candidates")
    places = materialize(candidate_windows(texts, candidates), "places")
    counted = places.groupBy("window").agg(F.count("*").alias("n")).join(rows.select("window").distinct(), "window")
    hits = materialize(join_counted(places, materialize(counted, "counted"), ["window"]), "hits")
    spread = F.flatten(F.transform("starts", lambda s: F.sequence(s, s + F.col("length") - 1)))
    words = hits.select("text_key", spread.alias("w")).groupBy("text_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("w")))).alias("hit_words"))
    items = hits.select("text_key", "window").join(rows.select("window", "item_id").distinct(), "window").groupBy("text_key").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return words.join(items, "text_key")


def _with_counts(docs: DataFrame, keep_text: bool) -> DataFrame:
    """`docs` with `n_words`, and without the text unless it is to be kept."""
    import pyarrow as pa

    kept = [i for i, c in enumerate(docs.columns) if keep_text or c != "text"]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField("n_words", T.LongType())])
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = pa.array([len(words_of(t)) for t in utf8(batch.column(text_at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), n], names=schema.names)

    return docs.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """`docs` (with null texts, unless `keep_text`) and `n_words`, `hit_words` (positions of the hit words) and `items` (sorted ids of the items found)."""
    narrow, restored = carried(docs, "text")
    keyed = narrow.withColumn("text_key", _text_key())
    found = materialize(contaminated_texts(keyed.where("text is not null").select("text_key", "text"), benchmark, window), "contaminated")
    maybe, rest = split_by(keyed, found, "text_key")
    counted = found.join(maybe.groupBy("text_key").agg(F.count("*").alias("n")), "text_key")
    hit = join_counted(maybe, materialize(counted, "counted"), ["text_key"], how="left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    out = _with_counts(hit.unionByName(rest, allowMissingColumns=True), keep_text)
    out = out.withColumns({"hit_words": F.coalesce("hit_words", none("long")), "items": F.coalesce("items", none("string"))})
    return restored(out if keep_text else out.withColumn("text", F.lit(None).cast("string")), "n_words", "hit_words", "items")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], benchmark: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract restated word by word, for tests."""
    import re

    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = {i: i + 32 for i in range(65, 91)}
    split = lambda t: pattern.findall((t or "").translate(fold))
    out = []
    for doc_id, text in docs:
        words, hit, items = split(text), set(), set()
        for item_id, item in benchmark:
            own = split(item)
            n = min(window, len(own))
            for at in range(len(own) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == own[at : at + n]:
                        hit.update(range(p, p + n))
                        items.add("" if item_id is None else str(item_id))
        out.append((doc_id, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out
