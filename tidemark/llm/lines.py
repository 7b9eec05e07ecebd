"""Line dedup by a deletion-neighbourhood join.

A line is the sequence of its words, A-Z in lower case. An occurrence goes if the corpus has an earlier one (by
document id, then line number) of an equal line, or of a line within an edit of one word (replaced, missing or
added), where both have at least `MIN_WORDS` words.

Each line emits its variants, itself and what is left without each of its words, as hashed keys. Two lines are
one replacement apart if they leave the same variant at the same place, and one word longer and shorter if the
one's variant is the other itself; so the earliest line of each key is the one to compare with, each key names
one, and no pairs within a key are formed. The pair is then verified on the words.

Emitting variants is dear (about 50 a line), so lines do it only if another line shares a half with them: an
edit leaves the first or the second half of a line as it was, a necessary condition for any link.

Defined cases: a null text stays null and an empty one empty; blank lines are neither compared nor removed; a row
without id is neither compared nor changed; rows equal in id and text keep the same lines; a very long text is cut
into lines whole, and a very long line has as many variants as words, in rows of their own; an empty table gives
an empty result; other columns are carried along, and those named like a result give way to it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, WordHasher, carried, drop_table, join_counted, materialize, mix64, prefilter, split_by, table, utf8

MIN_WORDS = 8


def words_of(line: bytes) -> list[bytes]:
    return line.lower().split()


def half_keys(words: list[bytes], line: bytes) -> list[int]:
    """Hashes of the first and the last half of a line (its words, and these joined), in both roundings, so that
    lines one word apart have one in common."""
    import xxhash

    n, digest = len(words), xxhash.xxh3_64_intdigest
    k = n // 2
    middle = sum(map(len, words[:k])) + k  # where word k begins
    behind = middle + len(words[k]) + 1
    if n % 2:
        return [digest(line[: middle - 1], 2 * k), digest(line[behind:], 2 * k + 1)]
    before = middle - len(words[k - 1]) - 1
    return [digest(line[: middle - 1], 2 * k), digest(line[middle:], 2 * k + 1), digest(line[: before - 1], 2 * k - 2), digest(line[behind:], 2 * k - 1)]


def variants(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the line without each word and of the line itself, and where the word was (-1: itself)."""
    n = len(words)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, BASE)]))
    before = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:n], dtype=np.uint64)])
    later = (before[n] - before[1:]) * np.uint64(pow(int(BASE), -1, 1 << 64))  # one place earlier
    length = np.array([n - 1, n], dtype=np.uint64) * power[n - 1 : n + 1]
    keys = np.append(before[:n] + later + length[0], before[n:] + length[1:])
    return mix64(keys).view(np.int64), np.append(np.arange(n), -1)


def within_one_word(x: list[bytes], y: list[bytes]) -> bool:
    """Whether one word replaced, missing or added at most makes x of y."""
    if abs(len(x) - len(y)) > 1:
        return False
    i = 0
    while i < min(len(x), len(y)) and x[i] == y[i]:
        i += 1
    return x[i + (len(x) >= len(y)) :] == y[i + (len(y) >= len(x)) :]


def _key(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def occurrences(docs: DataFrame) -> DataFrame:
    """`(doc_id, text_id, line, key, halves)`: every line that isn't blank; halves only where edits count."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                ids, text_ids, numbers, keys, halves, ends = [], [], [], [], [], [0]
                for doc_id, text, text_id in zip(part.column(0).to_pylist(), utf8(part.column(1)), part.column(2).to_pylist(), strict=True):
                    for number, low in enumerate(text.lower().split(b"\n")):
                        if words := low.split():
                            line = b" ".join(words)
                            ids.append(doc_id)
                            text_ids.append(text_id)
                            numbers.append(number)
                            keys.append(xxhash.xxh3_128_digest(line))
                            if len(words) >= MIN_WORDS:
                                halves += half_keys(words, line)
                            ends.append(len(halves))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(halves, dtype=np.uint64).view(np.int64)))
                columns = [pa.array(ids, pa.int64()), pa.array(text_ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(keys, pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_id", "line", "key", "halves"])

    return docs.select("doc_id", "text", "text_id").mapInArrow(run, "doc_id long, text_id long, line int, key binary, halves array<long>")


def candidate_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """`(lid, doc_id, line, words)` of the distinct lines that share a half with another, where they come first."""
    import pyarrow as pa

    halves = lines.select(F.xxhash64("key").alias("lid"), F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.min("lid").alias("a"), F.max("lid").alias("b"), F.count("*").alias("n")).where("a <> b").select("half", "n")
    shared = materialize(shared, "halves")
    wanted = materialize(join_counted(prefilter(halves, shared, "half").distinct(), shared, ["half"]).select("lid").distinct(), "wanted")
    spots = prefilter(firsts.select(F.xxhash64("key").alias("lid"), "at.*"), wanted, "lid").join(wanted, "lid")
    spots = materialize(spots.groupBy("doc_id", "text_id").agg(F.collect_list("line").alias("lines")), "spots")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], []]
            for doc_id, text, lines in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                parts = text.split(b"\n")
                for number in lines:
                    words = words_of(parts[number])
                    for column, value in zip(out, (_key(words), doc_id, number, b" ".join(words)), strict=True):
                        column.append(value)
            kinds = [pa.binary(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["key", "doc_id", "line", "words"])

    texts = prefilter(docs, spots, "doc_id").join(spots, ["doc_id", "text_id"]).select("doc_id", "text", "lines")
    found = texts.mapInArrow(run, "key binary, doc_id long, line int, words binary").dropDuplicates(["key"])
    return found.select(F.xxhash64("key").alias("lid"), "key", "doc_id", "line", "words")


def _variant_rows(candidates: DataFrame) -> DataFrame:
    """`(variant, place, lid, doc_id, line)`."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first in range(0, batch.num_rows, 2048):
                part = batch.slice(first, 2048)
                each = [variants(hasher(x.split())) for x in part.column(3).to_pylist()]
                if not each:
                    continue
                source = pa.array(np.repeat(np.arange(len(each)), [len(k) for k, _ in each]))
                columns = [pa.array(np.concatenate([k for k, _ in each]), pa.int64()), pa.array(np.concatenate([p for _, p in each]).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays([*columns, *(part.column(i).take(source) for i in range(3))], names=["variant", "place", "lid", "doc_id", "line"])

    return candidates.select("lid", "doc_id", "line", "words").mapInArrow(run, "variant long, place int, lid long, doc_id long, line int")


def near_lines(candidates: DataFrame) -> DataFrame:
    """Keys of the candidate lines of which an earlier one is within the edit, verified.

    Keys are aggregated before they are shuffled, and only the few rows whose key names two lines are joined back.
    """
    import pyarrow as pa

    rows = materialize(_variant_rows(candidates), "variants")
    at, earliest = F.struct("doc_id", "line", "lid"), F.min(F.struct("doc_id", "line", "lid")).alias("e")
    replaced = materialize(rows.where("place >= 0").groupBy("variant", "place").agg(earliest, F.count("*").alias("n")).where("n > 1"), "replaced")
    again = join_counted(prefilter(rows.where("place >= 0").withColumn("at", at), replaced, "variant"), replaced, ["variant", "place"])
    pairs = again.where("e < at").select("lid", F.col("e.lid").alias("other"))
    whole = materialize(rows.where("place < 0").select("variant", at.alias("w")), "whole")
    longer = materialize(prefilter(rows.where("place >= 0"), whole, "variant").join(whole, "variant").select("variant", at.alias("at"), "w"), "longer")
    pairs = pairs.union(longer.where("w < at").select("at.lid", "w.lid"))
    first = longer.groupBy("variant", "w").agg(F.min("at").alias("at"))
    pairs = materialize(pairs.union(first.where("at < w").select("w.lid", "at.lid")).where("lid <> other").distinct(), "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one_word(x.split(b" "), y.split(b" ")) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield batch.select([0]).filter(pa.array(good, pa.bool_()))

    texts = candidates.select("lid", "key", "words")
    both = pairs.join(texts, "lid").join(texts.select(F.col("lid").alias("other"), F.col("words").alias("other_words")), "other")
    near = materialize(both.select("key", "words", "other_words").mapInArrow(verify, "key binary").distinct(), "near")
    for t in (rows, replaced, whole, longer, pairs):
        drop_table(t)
    return near


def dedup_lines(docs: DataFrame) -> DataFrame:
    """`docs` with what is left of `text`, and `n_lines` (that aren't blank) and `n_removed`."""
    import pyarrow as pa

    docs, restored = carried(docs, "doc_id", "text")
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "text_id").where("doc_id is not null and text is not null")
    lines = materialize(occurrences(known), "lines")
    firsts = lines.groupBy("key").agg(F.min(F.struct("doc_id", "line", "text_id")).alias("at"), F.count("*").alias("n"))
    firsts = materialize(firsts, "firsts")
    candidates = materialize(candidate_lines(known, lines, firsts), "candidates")
    near = near_lines(candidates).withColumn("near", F.lit(True))
    verdicts = firsts.join(near, "key", "left").where("n > 1 or near").select("key", F.col("at").alias("kept_at"), F.coalesce("near", F.lit(False)).alias("near"), "n")
    verdicts = materialize(verdicts, "verdicts")
    gone = join_counted(prefilter(lines.select("key", "doc_id", "text_id", "line"), verdicts, "key"), verdicts, ["key"]).where("near or doc_id <> kept_at.doc_id or line <> kept_at.line")
    spots = materialize(gone.groupBy("doc_id", "text_id").agg(F.collect_list("line").alias("spots")), "gone")
    for t in (lines, firsts, candidates, verdicts):
        drop_table(t)

    own = ["doc_id", "text", "carried"]
    schema = T.StructType([*docs.select(own).schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, removed = [], [], []
            for text, spots in zip(utf8(batch.column(1)), batch.column(3).to_pylist(), strict=True):
                parts = text.split(b"\n") if text is not None else []
                drop = set(spots or [])
                texts.append(text if not drop else b"\n".join(p for i, p in enumerate(parts) if i not in drop))
                counts.append(sum(not p.isspace() and p != b"" for p in parts))
                removed.append(len(drop))
            columns = [batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), batch.column(2), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    changed, same = split_by(docs, spots, "doc_id")
    changed = changed.join(spots, ["doc_id", "text_id"], "left")
    same = same.withColumn("spots", F.lit(None).cast("array<int>"))
    return restored(changed.unionByName(same).select(*own, "spots").mapInArrow(cut, schema), "n_lines", "n_removed")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The definition restated over all pairs of lines, for tests."""
    seen: list[list[bytes]] = []
    out = []
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        parts, kept, lines = (text or "").encode().split(b"\n"), [], 0
        for line in parts:
            words = words_of(line)
            lines += bool(words)
            again = words and any(words == s or min(len(words), len(s)) >= MIN_WORDS and within_one_word(words, s) for s in seen)
            if words:
                seen.append(words)
            if not again:
                kept.append(line)
        out.append((doc_id, lines, len(parts) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out
