"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes.

Two linear models (low quality, toxicity), trained with FTRL on a bounded sample of labelled rows, give each
document a log likelihood ratio. Grouped sums of all documents' probabilities give each host and path a rate.
A host's rate is shrunk to the global one and a path's to its host's, by as many pseudo-documents as the spread
between sites supports (method of moments); a document's own probability is left out of its site's. The path's
posterior is the prior that the document's evidence updates.

Defined cases: a null or empty text has only the features of its length; a null host or path is a site of its
own; labels that are null or without document are left out, and of repeated ones the strictest holds; without
labels, or with one kind only, the evidence is 0 and every document is kept; repeated rows are rows; very long
texts count whole, in memory of their own size; an empty table gives an empty result; other columns are carried
along, and those named like a result give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, materialize, sampled, table, utf8
from .linear import FtrlProximal, scores

FEATURES = 1 << 18
#: Labelled rows that are learnt from, at most.
TRAIN_ROWS, EPOCHS = 5000, 3
#: Step and L1 penalty, the best of a grid on labelled rows held out of the fit.
ALPHA, L1 = 1.0, 4.0
THRESHOLD, CLIP = 0.5, 15.0
HEADS = ("low_quality", "toxic")
_MARKS = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
#: Upper ends of the steps of a share.
_STEPS = np.array([0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9])


def features(text: bytes | None) -> np.ndarray:
    """The distinct features of a text: its words, their beginnings and marks, and steps of some shares."""
    data = text or b""
    words = data.lower().split()
    n, distinct = len(words), set(words)
    found = set()
    for w in distinct:
        stem = w.strip(_MARKS)
        found.add(crc32(stem))
        found.add(crc32(stem[:5], 7))
        if len(stem) != len(w):
            found.add(crc32(w.replace(stem, b" ", 1) if stem else w, 11))
    size = max(1, len(data))
    shares = [
        (size - len(data.translate(None, _UPPER))) / size,
        (size - len(data.translate(None, _MARKS))) / size,
        (size - len(data.translate(None, _DIGITS))) / size,
        sum(map(eq, words, words[1:])) / max(1, n),
        len(distinct) / max(1, n),
        min(1.0, size / max(1, n) / 40),
    ]
    for i, s in enumerate(np.searchsorted(_STEPS, shares).tolist()):
        found.add(crc32(b"share %d %d" % (i, s)))
    found.add(crc32(b"words %d" % n.bit_length()))
    return np.unique(np.fromiter(found, dtype=np.int64, count=len(found)) & (FEATURES - 1))


def labelled_sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """`(place, at, <heads>)` of the labelled ids with the smallest hashes, `train_rows` at most; an id with several
    texts is its first text."""
    import pyarrow as pa

    clean = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    clean = materialize(clean, "labels")
    chosen = clean.sparkSession.createDataFrame(sampled(clean, train_rows, clean.count(), 8, "doc_id"), clean.schema)  # the bound of the broadcast
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"), F.first("toxic").alias("toxic"))
    rows = texts.select(F.xxhash64(F.lit(8), "doc_id").alias("place"), "text", (F.col("quality") == 0).cast("int").alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = pa.array([features(t).astype(np.int32).tobytes() for t in utf8(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), at, batch.column(2), batch.column(3)], names=["place", "at", *HEADS])

    return rows.mapInArrow(run, "place long, at binary, low_quality int, toxic int")


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> dict[str, tuple[np.ndarray, float]]:
    """For each head with labels of both kinds: the weights and the log odds among what it learnt from."""
    rows = sorted(labelled_sample(docs, labels, train_rows).collect())  # in the order of hashes, however rows are dealt
    at = [np.frombuffer(r["at"], np.int32).astype(np.int64) for r in rows]
    examples = [(a, np.ones(len(a))) for a in at]
    out = {}
    for head in HEADS:
        y = [int(r[head] > 0) for r in rows]
        if 0 < sum(y) < len(y):
            model = FtrlProximal(FEATURES, 2, alpha=ALPHA, l1=L1, l2=0.1).fit(examples, y, epochs)
            out[head] = model.weights(), float(np.log(sum(y) / (len(y) - sum(y))))
    return out


def with_evidence(docs: DataFrame, models: dict[str, tuple[np.ndarray, float]], keep_text: bool = True) -> DataFrame:
    """`docs` with the log likelihood ratio of each head (`llr_<head>`) and its probability (`p_<head>`)."""
    import pyarrow as pa

    names = [f"{k}_{h}" for h in HEADS for k in ("llr", "p")]
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kept = [i for i, c in enumerate(docs.columns) if keep_text or c != "text"]
    schema = T.StructType([*(docs.schema.fields[i] for i in kept), *(T.StructField(n, T.DoubleType()) for n in names)])
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [features(t) for t in utf8(batch.column(text_at))]
            columns = []
            for head in HEADS:
                if head in own:
                    weights, prior = own[head]
                    x = np.array([scores(weights, at, np.ones(len(at), np.float32)) for at in found], dtype=np.float64).reshape(len(found), 2)
                    logit = np.clip(x[:, 1] - x[:, 0], -CLIP, CLIP)
                    columns += [logit - prior, 1 / (1 + np.exp(-logit))]
                else:
                    columns += [np.zeros(len(found)), np.zeros(len(found))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *(pa.array(c, pa.float64()) for c in columns)], names=schema.names)

    return docs.mapInArrow(run, schema)


def _strength(sites: DataFrame, n: str, rate: Column, parent: Column) -> float:
    """Pseudo-documents of the prior: how little the sites' rates stray from the rate above them."""
    spread = (rate - parent) * (rate - parent)
    noise = parent * (1 - parent)
    r = sites.agg(F.sum(F.col(n) * spread).alias("a"), F.sum(noise).alias("b"), F.sum(F.col(n) * noise).alias("c"), F.sum(n).alias("n")).first()
    if not r["n"] or not r["c"]:
        return 1.0
    between = (r["a"] - r["b"]) / r["n"]
    return float(np.clip(r["c"] / r["n"] / max(between, 1e-9) - 1, 1.0, 1e5))


def site_rates(scored: DataFrame) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """Counts and sums by (host, path); and for each head the global rate and the strengths of both priors."""
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n_path"), *(F.sum(f"p_{h}").alias(f"path_{h}") for h in HEADS))
    hosts = paths.groupBy("host").agg(F.sum("n_path").alias("n_host"), *(F.sum(f"path_{h}").alias(f"host_{h}") for h in HEADS))
    sites = materialize(_with_hosts(paths, hosts), "sites")
    hosts = sites.groupBy("host").agg(F.first("n_host").alias("n_host"), *(F.first(f"host_{h}").alias(f"host_{h}") for h in HEADS))
    whole = sites.agg(F.sum("n_path").alias("n"), *(F.sum(f"path_{h}").alias(h) for h in HEADS)).first()
    priors = {}
    for h in HEADS:
        rate = min(max((whole[h] or 0.0) / max(1, whole["n"] or 0), 1e-4), 1 - 1e-4)
        by_host = _strength(hosts, "n_host", F.col(f"host_{h}") / F.col("n_host"), F.lit(rate))
        shrunk = (F.col(f"host_{h}") + by_host * rate) / (F.col("n_host") + by_host)
        by_path = _strength(sites, "n_path", F.col(f"path_{h}") / F.col("n_path"), shrunk)
        priors[h] = rate, by_host, by_path
    return sites, priors


def _with_hosts(paths: DataFrame, hosts: DataFrame) -> DataFrame:
    other = hosts.withColumnRenamed("host", "of_host")
    return paths.join(other, paths["host"].eqNullSafe(other["of_host"])).drop("of_host")


def with_posteriors(scored: DataFrame, sites: DataFrame, priors: dict[str, tuple[float, float, float]]) -> DataFrame:
    """`scored` with `<head>` (posterior probability) and `keep`.

    Sites are broadcast as long as they are small (Spark decides by their size); beyond that rows are shuffled by
    site, and adaptive execution splits a site that has most of them.
    """
    other = sites.withColumnsRenamed({"host": "of_host", "path": "of_path"})
    out = scored.join(other, scored["host"].eqNullSafe(other["of_host"]) & scored["path"].eqNullSafe(other["of_path"]), "left")
    for h in HEADS:
        rate, by_host, by_path = priors[h]
        own = F.col(f"p_{h}")
        host = (F.col(f"host_{h}") - own + by_host * rate) / (F.col("n_host") - 1 + by_host)
        path = (F.col(f"path_{h}") - own + by_path * host) / (F.col("n_path") - 1 + by_path)
        path = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), path))
        logit = F.col(f"llr_{h}") + F.log(path / (1 - path))
        out = out.withColumn(h, 1 / (1 + F.exp(-logit)))
    keep = F.lit(True)
    for h in HEADS:
        keep = keep & (F.col(h) < THRESHOLD)
    used = ["of_host", "of_path", "n_host", "n_path", *(f"{k}_{h}" for h in HEADS for k in ("host", "path", "llr", "p"))]
    return out.withColumn("keep", keep).drop(*used)


def sited(docs: DataFrame) -> DataFrame:
    """A document's host is its source; its path is the language section there."""
    return docs.withColumn("host", F.col("source").cast("string")).withColumn("path", F.col("lang").cast("string"))


def classify(docs: DataFrame, labels: DataFrame, keep_text: bool = True) -> DataFrame:
    """`docs` (with `host` and `path`) and `low_quality`, `toxic`, `keep`.

    Features of a text are computed once: rows are written with their evidence (without the texts, and a column of
    texts left out of the result, unless `keep_text`), from which both the sites' rates and the posteriors are read.
    """
    models = train(docs, labels)
    own = ["text", "host", "path"]
    narrow, restored = carried(docs, *own)
    scored = materialize(with_evidence(narrow, models, keep_text), "evidence")
    sites, priors = site_rates(scored)
    found = with_posteriors(scored, sites, priors)
    found = found if len(models) else found.withColumn("keep", F.lit(True))
    found = found if keep_text else found.withColumn("text", F.lit(None).cast("string"))
    return restored(found, *HEADS, "keep") if keep_text else restored(found, *HEADS, "keep").drop("text")


def op8_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sited(table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    found = classify(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return found.select("doc_id", "host", "path", "low_quality", "toxic", "keep")
