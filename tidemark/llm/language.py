"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 characters of the case-folded text, in which all but letters is one space, are hashed to
`FEATURES` features. Document frequencies cover all documents that may be learnt from; the weights are trained
with FTRL (elastic net) on a bounded sample of them, `TRAIN_ROWS` in all and as many for each language: those with
the smallest hashes, in this order, so the model doesn't depend on how rows are dealt. One in five of these is kept
back for the temperature that calibrates the scores.

A fifth of the documents by a hash of their id is held out and never learnt from.

Defined cases: a text that is null or has no letter is `und` with score 0; a row without language is predicted
but not learnt from; a row without id isn't held out; without a row to learn from all is `und`; repeated rows
are rows, and a language of fewer rows than its part of the sample gives them all; very long texts are counted
whole, in memory of their own size; columns other than the text, the id and the language are carried along, and
those named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, table
from .linear import FtrlProximal, scores, softmax, temperature

FEATURES, LONGEST = 1 << 15, 3
TRAIN_ROWS, EPOCHS = 2000, 2
UNKNOWN = "und"
_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])
_FACTORS = np.array([1, 0x9E3779B1, 0x85EBCA6B], dtype=np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs in the whole text."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _LETTER[np.minimum(code, 0xFFFF)] | (code > 0xFFFF)
    code = np.where(letter, code, 32)
    code = code[letter | np.concatenate([[True], letter[:-1]])] if len(code) else code  # one space for several
    counts = np.zeros(FEATURES, dtype=np.int64)
    acc = np.zeros(len(code), dtype=np.uint32)
    for n in range(1, LONGEST + 1):
        if len(code) < n:
            break
        acc = (acc[: len(code) - n + 1] * np.uint32(0x01000193)) ^ (code[n - 1 :] * _FACTORS[n - 1])
        mixed = (acc ^ (acc >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        counts += np.bincount((mixed >> np.uint32(17)).astype(np.int64), minlength=FEATURES)
    return counts


def tf_idf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    values = (1.0 + np.log(counts)) * idf[at]
    return values / max(float(np.sqrt((values * values).sum())), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str) -> np.ndarray:
        counts = ngram_counts(text)
        at = np.flatnonzero(counts)
        return scores(self.weights, at, tf_idf(at, counts[at], self.idf))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text).astype(np.float64) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def document_frequencies(learnable: DataFrame) -> tuple[int, np.ndarray]:
    """The number of texts, and how many of them have each feature, over all rows."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FEATURES + 1, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen[:-1] += ngram_counts(text) > 0
                seen[-1] += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], names=["feature", "n"])

    rows = learnable.select("text").mapInArrow(count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(FEATURES + 1, dtype=np.int64)
    for feature, n in rows:
        out[feature] = n
    return int(out[-1]), out[:-1]


def train(docs: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> LanguageModel:
    """Learn from rows of `(doc_id, text, lang)` that aren't held out."""
    learnable = docs.where(~held_out(F.col("doc_id"))).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in learnable.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()}
    if not sizes:
        return LanguageModel([], np.zeros(FEATURES), np.zeros((FEATURES + 1, 0), np.float32))
    n, seen = document_frequencies(learnable)
    idf = np.log((1.0 + n) / (1.0 + seen)) + 1.0
    languages, rows = list(sizes), []
    for wide in (False, True):
        rows = sorted(_features(_sample(learnable, sizes, -(-train_rows // len(sizes)), wide)).collect())
        if len(rows) >= sum(min(s, -(-train_rows // len(sizes))) for s in sizes.values()):
            break
    examples = []
    for r in rows:
        at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
        examples.append((at, tf_idf(at, np.frombuffer(r["counts"], np.float32), idf)))
    labels = np.array([languages.index(r["lang"]) for r in rows], dtype=np.int64)
    back = np.array([r["back"] for r in rows], dtype=bool)
    order = [i for i in range(len(rows)) if not back[i]] or list(range(len(rows)))
    model = FtrlProximal(FEATURES, len(languages), alpha=1.0, l1=0.05, l2=0.01).fit([examples[i] for i in order], labels[order].tolist(), epochs)
    weights = model.weights()
    kept = np.flatnonzero(back)
    logits = np.array([scores(weights, *examples[i]) for i in kept], dtype=np.float64).reshape(len(kept), len(languages))
    return LanguageModel(languages, idf, weights, temperature(logits, labels[kept]))


def _sample(learnable: DataFrame, sizes: dict[str, int], most: int, wide: bool) -> DataFrame:
    """`(place, text, lang, back)`: of each language the `most` rows with the smallest hashes of id and text.

    Rows go on only below a bound on their hash, about four times as many as are taken; `wide`: all.
    """
    place = F.xxhash64(F.lit(5), "doc_id", "text")
    bound = lambda size: 2**63 - 1 if wide or 4 * most + 100 >= size else int((4 * most + 100) / size * 2**64) - 2**63
    bounds = learnable.sparkSession.createDataFrame([(lang, bound(size)) for lang, size in sizes.items()], "lang string, bound long")
    few = learnable.select(place.alias("place"), "text", "lang").join(F.broadcast(bounds), "lang").where("place <= bound")
    order = Window.partitionBy("lang").orderBy("place", "text")
    chosen = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return chosen.select("place", "text", "lang", (F.pmod("place", F.lit(5)) == 0).alias("back"))


def _features(sample: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [ngram_counts(t) for t in batch.column(1).to_pylist()]
            at = [np.flatnonzero(c) for c in counts]
            columns = [pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([c[a].astype(np.float32).tobytes() for c, a in zip(counts, at, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, batch.column(2), batch.column(3)], names=["place", "at", "counts", "lang", "back"])

    return sample.mapInArrow(run, "place long, at binary, counts binary, lang string, back boolean")


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with `lang_pred` and `score`, from the text alone."""
    import pyarrow as pa

    docs, restored = carried(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=schema.names)

    return restored(docs.mapInArrow(run, schema), "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
