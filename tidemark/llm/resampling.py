"""Importance resampling towards a target distribution, by hashed n-grams, in native Spark SQL.

Every word n-gram of a text falls into one of `BUCKETS` buckets. What a bucket is worth, its gain, is the logarithm of how
much more often the target has it than the source, with one added to each count. A document's weight is the mean gain of its
n-grams; Gumbel noise from a hash of its id makes the highest scores a sample without replacement in proportion to
the weights' exponentials. So drawing is a sort.

The n-grams of a text are exploded, counted by bucket before the shuffle (one row for each bucket and task goes on),
and joined with the gain table, which has `BUCKETS` rows whatever the input and is broadcast. Ranks are places in a
distributed sort, behind the rows of the partitions before.

Defined cases: a null or empty text has no n-grams, weight 0 and is never drawn if `least_words` is positive; a null
id is scored as the empty one; rows of one id are scored on their own, with equal noise; equal rows rank next to each
other; an empty target or source counts 0 everywhere; an empty table gives no rows; other columns aren't read; a very
long text is one row until it is exploded.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, placed, table

#: Buckets, words of the longest n-gram, and the noise's seed.
BUCKETS, LONGEST, SEED = 10_000, 2, 7
#: Per cent of the documents with at least so many words that are drawn.
PERCENT, LEAST_WORDS = 25, 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed value: what is a word


def _bucket(ngram: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(ngram.cast("binary")), F.lit(buckets)).cast("int")


def ngram_buckets(words: Column, longest: int = LONGEST, buckets: int = BUCKETS) -> Column:
    """The bucket of each run of 1 to `longest` words."""

    def run(n: int) -> Column:
        starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - F.lit(n - 1), F.lit(0)))
        joined = lambda first, i: F.concat(first, *(x for k in range(1, n) for x in (F.lit(" "), F.get(words, i + k))))
        return F.transform(starts, (lambda first, i: _bucket(joined(first, i), buckets)) if n > 1 else (lambda first: _bucket(first, buckets)))

    return F.concat(*map(run, range(1, longest + 1)))


def hashed(texts: DataFrame, *keep: str, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """`(row, <keep>, n_words, buckets)` of `texts`, written once; row: a number of its own."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = texts.select(*keep, F.regexp_extract_all(low, F.lit(WORD), F.lit(0)).alias("words"))
    found = words.select(F.monotonically_increasing_id().alias("row"), *keep, F.size("words").cast("long").alias("n_words"), ngram_buckets(F.col("words"), longest, buckets).alias("buckets"))
    return materialize(found, "ngrams")


def bucket_counts(found: DataFrame) -> DataFrame:
    """`(bucket, n)` of `hashed` texts."""
    return materialize(found.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")), "counts")


def gain_table(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """`(bucket, gain)` for every bucket, from counts of both sides; gains are thousandths of natural logarithms, floored."""
    spark = source.sparkSession
    in_source, in_target = (float(x.agg(F.sum("n")).first()[0] or 0) for x in (source, target))
    every = spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    count = lambda side, name: side.select("bucket", F.col("n").cast("double").alias(name))
    both = every.join(count(source, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0.0, ["s", "t"])
    one, all_buckets = F.lit(1.0), float(buckets)
    ratio = (F.col("t") + one) * F.lit(in_source + all_buckets) / ((F.col("s") + one) * F.lit(in_target + all_buckets))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, floored; it depends on seed and id alone."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(uniform))).cast("long")


def weighed(docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """`(doc_id, n_words, n_features, weight)` of every row of `docs(doc_id, text)`; target: its `text`."""
    found = hashed(docs, "doc_id", longest=longest, buckets=buckets)
    gains = gain_table(bucket_counts(found), bucket_counts(hashed(target, longest=longest, buckets=buckets)), buckets)
    each = found.select("row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket"))
    worth = each.join(F.broadcast(gains), "bucket", "left")  # `buckets` rows, whatever the input
    sums = worth.groupBy("row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    down = (F.col("gain") - F.pmod("gain", "n_features")) / F.col("n_features")  # whole, so no rounding below 2 ** 53
    return sums.select("doc_id", "n_words", "n_features", F.when(F.col("n_features") > 0, down.cast("long")).otherwise(F.lit(0).cast("long")).alias("weight"))


def importance_ranks(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """`(doc_id, n_words, n_features, weight, score, rank)`: rank is null for what isn't drawn, else the place from 1.

    Of the documents with at least `least_words` words, `percent` in a hundred (rounded down) with the highest scores
    are drawn; ties go to the smaller id.
    """
    scores = weighed(docs, target, longest, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scores = materialize(scores, "scores")
    fits = F.col("n_words") >= least_words
    drawn = scores.where(fits).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), "n_features", "weight"]
    ranked = placed(scores.where(fits), [], order, "rank").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    return ranked.unionByName(scores.where(~fits).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """The rows of `docs`, whole, whose id is drawn; a null id never is. Settings as of `importance_ranks`."""
    drawn = importance_ranks(docs, target, **settings).where("rank is not null").select("doc_id").distinct()
    return docs.join(drawn, "doc_id", "left_semi")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranks.select(F.col("doc_id").cast("long").alias("doc_id"), "n_features", "weight", "score", "rank")


def _crc32(text: str) -> str:
    """DuckDB SQL of a text's unsigned crc32, half a byte at a time: its table of 16 follows from the polynomial."""
    steps = []
    for x in range(16):
        for _ in range(4):
            x = x >> 1 ^ (0xEDB88320 if x & 1 else 0)
        steps.append(x)
    halves = f"list_transform(range(0, 2 * strlen({text})), lambda i: instr('0123456789ABCDEF', hex({text})[i + 2 - 2 * (i % 2)]) - 1)"
    return f"xor(4294967295, list_reduce({halves}, lambda c, x: xor((c >> 4), {steps}[(xor(c, x::bigint) & 15) + 1]), 4294967295::bigint))"


def oracle(percent: int = PERCENT, least: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> str:
    """DuckDB SQL for the query."""
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}')"
    ngrams = "w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""
with w as (select doc_id, {words} as w from documents),
f as (select doc_id, len(w) as n_words, {ngrams} as f from w),
b as (select unnest({ngrams}) as x from (select {words} as w from benchmark)),
e as (select doc_id, unnest(f) as x from f),
k as (select x, ({_crc32('x')} % {buckets})::bigint as bucket from (select x from e union select x from b)),
s as (select bucket, count(*)::double as s from e join k using (x) group by bucket),
t as (select bucket, count(*)::double as t from b join k using (x) group by bucket),
z as (select (select count(*) from e)::double as s_all, (select count(*) from b)::double as t_all),
g as (select bucket, floor(1000.0::double * ln((coalesce(t, 0) + 1) * (s_all + {buckets}) / ((coalesce(s, 0) + 1) * (t_all + {buckets}))))::bigint as gain from s full join t using (bucket), z),
m as (select doc_id, floor(sum(gain)::double / count(*))::bigint as weight from e join k using (x) join g using (bucket) group by doc_id),
c as (select doc_id, n_words, len(f)::bigint as n_features, coalesce(weight, 0) as weight, ('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::bigint as h from f left join m using (doc_id)),
r as (select *, weight + floor(-1000.0::double * ln(-ln((h + 0.5::double) / 4294967296.0::double)))::bigint as score from c),
p as (select *, row_number() over (partition by n_words >= {least} order by score desc, doc_id) as place, count(*) over (partition by n_words >= {least}) as n from r)
select doc_id, n_features, weight::bigint as weight, score::bigint as score, case when n_words >= {least} and place <= n * {percent} // 100 then place end as rank from p
"""


ORACLE = oracle()
