"""Near-duplicate detection with circulant MinHash.

Two permutations make all signature coordinates: sigma scatters a shingle over the universe once, and pi,
shifted by one place per coordinate, ranks it. Coordinates in bands of equal value propose candidates, and a
link holds only if the exact Jaccard similarity of the full shingle sets reaches the threshold.

Documents with equal sets form a class, and only its representative (the row with the smallest id) goes on, so copies
cost nothing more. A class is a node of its own, with a number that is no document's id, until components are told. In a band bucket, members are compared with a few probes (at first the most common member) and
what is linked by then is taken together; only pairs that are still in different components are left, and
their members with the most links probe next, until no bucket has such a pair untested. A pair whose symmetric
difference is too large by a lower bound (shingles that no other set of the crowded buckets has, and what one
lacks of the bucket's center beyond the other) can't be linked and isn't formed. No link between components is
lost, and a bucket of near-copies costs about its size.

Defined cases: a text without words, a null text and a row without id have no links (component: the own id);
fewer words than a shingle has make one shingle; rows with equal id and text are one document, rows of one id with
different texts are linked each on their own, and their component has the smallest id that the row's links reach; an
empty table gives an empty result; a very long text has all its shingles (beyond some 100,000 its coordinates say less, as the
permutations are over 2^18 places, which only adds candidates); columns of the input other than the id and the text
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordHasher, bounded, drop_table, join_counted, materialize, mix64, ngram_hashes, prefilter, table, utf8
from .graph import connected_components

SHINGLE_WORDS, PERCENT = 5, 85
#: At a similarity of 0.85 all bands miss with a probability of 8e-7, at 0.8 of 7e-5.
BANDS, ROWS = 25, 5
UNIVERSE_BITS, SEED = 18, 20_240_607
#: Members of a bucket that probe it in the second round, and how many times as many in each later one.
PROBES, MORE = 32, 8
#: Members from which on a bucket's lonely shingles are counted.
CROWD = 4


class Circulant:
    """sigma, and pi repeated so that a shift is an offset."""

    def __init__(self, coordinates: int):
        rng, size = np.random.default_rng(SEED), 1 << UNIVERSE_BITS
        self.sigma = rng.permutation(size).astype(np.int32)
        pi = rng.permutation(size).astype(np.uint32)
        self.pi, self.coordinates = np.concatenate([pi, pi[:coordinates]]), coordinates

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """[coordinate, set] of the sets, none of them empty."""
        place = self.sigma[(np.concatenate(sets) & np.uint64((1 << UNIVERSE_BITS) - 1)).astype(np.int64)]
        starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
        out = np.empty((self.coordinates, len(sets)), dtype=np.uint64)
        for k in range(self.coordinates):
            out[k] = np.minimum.reduceat(self.pi[k:][place], starts)
        return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[set, band]: the hash of a band's coordinates and number."""
    out = np.empty((signatures.shape[1], bands), dtype=np.uint64)
    for b in range(bands):
        acc = np.full(signatures.shape[1], b + 1, dtype=np.uint64)
        for r in range(rows):
            acc = mix64(acc + signatures[b * rows + r])
        out[:, b] = acc
    return out.view(np.int64)


def shingle_set(text: bytes | None, hasher: WordHasher, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a text."""
    words = text.lower().split() if text else []  # of bytes: A-Z, and white space \x09-\x0D and \x20
    return np.unique(ngram_hashes(hasher(words), n)) if words else np.empty(0, dtype=np.uint64)


def sketch(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """`(doc_id, text_hash, n_shingles, set_key binary, bands array<long>)`, the latter two null for empty sets."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hasher, circulant = WordHasher(), Circulant(bands * rows)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = [shingle_set(t, hasher, n) for t in utf8(part.column(1))]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(circulant.signatures(full), bands, rows).tolist() if full else [])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).cast(pa.int64()),
                        part.column(2).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_hash", "n_shingles", "set_key", "bands"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>")


def full_sets(docs: DataFrame, n: int) -> DataFrame:
    """`(doc_id, shingles binary)`: the sorted 64-bit shingle hashes."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                sets = pa.array([shingle_set(t, hasher, n).tobytes() for t in utf8(part.column(1))], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), sets], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """`pairs(a, b)` with `shared` and `joint`, the sizes of intersection and union of their full sets."""
    import pyarrow as pa

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, joint = [], []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                shared.append(int((both[1:] == both[:-1]).sum()))
                joint.append(len(both) - shared[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.int64()), pa.array(joint, pa.int64())], names=["a", "b", "shared", "joint"])

    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(count, "a long, b long, shared long, joint long")


def _links(facts: DataFrame, percent: int) -> DataFrame:
    return facts.where(100 * F.col("shared") >= percent * F.col("joint")).select("a", "b")


def lonely_shingles(sets: DataFrame) -> DataFrame:
    """`(rep, lonely)`: how many shingles of a set are in no other set."""
    import pyarrow as pa

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                each = [np.frombuffer(x, np.int64) for x in part.column(1).to_pylist()]
                owner = np.repeat(part.column(0).to_numpy(), [len(x) for x in each])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(each), pa.int64()), pa.array(owner, pa.int64())], names=["shingle", "rep"])

    rows = sets.select("doc_id", "shingles").mapInArrow(spread, "shingle long, rep long")
    alone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("rep").alias("rep")).where("n = 1")
    return alone.groupBy("rep").agg(F.count("*").alias("lonely"))


def _may_link(percent: int):
    """What two linked sets fulfil: close sizes, and a symmetric difference that leaves the similarity possible.

    In it are the lonely shingles of both, and of the shingles of their bucket's center at least as many as one
    of them misses more than the other.
    """
    sizes = F.col("size") + F.col("p_size")
    apart = F.when(F.col("n") >= CROWD, F.col("lonely") + F.col("p_lonely") + F.coalesce(F.abs(F.col("missing") - F.col("p_missing")), F.lit(0))).otherwise(0)
    close = 100 * F.least("size", "p_size") >= percent * F.greatest("size", "p_size")
    return close & ((100 + percent) * apart <= (100 - percent) * sizes)


def _pairs(members: DataFrame, probes: DataFrame, percent: int, once: bool = True) -> DataFrame:
    """Distinct `(a, b)`: a bucket's probes with those of its members that are apart from them and may be linked.

    once: in crowded buckets a pair is left to the first bucket that it shares; each bucket goes on until all its
    open pairs have had a probe, so none is left out.
    """
    columns = ["rep", "size", "lonely", "missing", "component", "bands"]
    other = probes.select("bucket", *(F.col(c).alias(f"p_{c}") for c in columns))
    test = (members["bucket"] == other["bucket"]) & (F.col("component") != F.col("p_component")) & _may_link(percent)
    if once:
        common = F.filter(F.zip_with("bands", "p_bands", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
        test = test & F.coalesce(F.try_element_at(common, F.lit(1)) == members["bucket"], F.lit(True))
    found = members.join(other, test)
    return found.select(F.least("rep", "p_rep").alias("a"), F.greatest("rep", "p_rep").alias("b")).distinct()


def _with_missing(members: DataFrame, center: DataFrame, facts: DataFrame) -> DataFrame:
    """`missing`: how many shingles of the bucket's center a member lacks, where they were compared."""
    own = center.select("bucket", F.col("rep").alias("c"), F.col("size").alias("c_size"))
    out = members.drop("missing").join(own, "bucket").withColumns({"a": F.least("rep", "c"), "b": F.greatest("rep", "c")})
    out = out.join(facts.select("a", "b", "shared"), ["a", "b"], "left")
    missing = F.when(F.col("rep") == F.col("c"), 0).otherwise(F.col("c_size") - F.col("shared")).cast("long")
    return out.withColumn("missing", missing).drop("a", "b", "c", "c_size", "shared")


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with several components, with theirs, and whether it's the bucket's largest (`main`)."""
    out = members.drop("component", "main").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    parts = out.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    split = parts.groupBy("bucket").agg(F.count("*").alias("parts"), F.max(F.struct("k", "component")).alias("top")).where("parts > 1")
    return out.join(split.select("bucket", F.col("top.component").alias("main")), "bucket").withColumn("main", F.col("component") == F.col("main"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle_words: int = SHINGLE_WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: `doc_id, n_shingles, component_id, kept`."""
    bounded(docs.sparkSession)
    sketches = materialize(sketch(docs, shingle_words, bands, rows), "sketches")
    full = sketches.where("doc_id is not null and set_key is not null")
    first = F.min(F.struct("doc_id", "text_hash"))  # a row of the class, of which no other class can be
    classes = full.groupBy("set_key").agg(first.alias("first"), F.min_by("bands", "doc_id").alias("bands"), F.count("*").alias("n"))
    classes = materialize(classes.select("set_key", "first.*", "bands", "n", F.monotonically_increasing_id().alias("rep")), "classes")
    buckets = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(buckets.join(shared, "bucket"), "members")

    involved = materialize(classes.select("rep", "doc_id", "text_hash").join(members.select("rep").distinct(), "rep"), "involved")
    texts = prefilter(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"), involved, "doc_id").withColumn("text_hash", F.xxhash64("text"))
    own = texts.join(involved, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    sets = materialize(full_sets(own.select(F.col("rep").alias("doc_id"), "text"), shingle_words), "sets")
    members = materialize(_sized(members, sets, classes.select("rep", "bands"), percent), "members")
    labels = _components(members, sets, percent)
    drop_table(sets)

    linked = labels.withColumnRenamed("node", "rep").join(classes.select("rep", "doc_id"), "rep")
    low = materialize(linked.groupBy("component").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "lowest")
    told = join_counted(labels.withColumnRenamed("node", "rep"), low, ["component"]).select("rep", "low")
    of_class = classes.select("set_key", "rep", "doc_id", "n").join(told, "rep", "left")
    moved = materialize(of_class.select("set_key", F.coalesce("low", "doc_id").alias("component_id"), "n"), "moved")
    keyed = join_counted(full.select("doc_id", "n_shingles", "set_key"), moved, ["set_key"]).drop("set_key")
    rest = sketches.where("doc_id is null or set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return keyed.union(rest).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _sized(members: DataFrame, sets: DataFrame, bands: DataFrame, percent: int) -> DataFrame:
    """Members with the `size` of their sets and, in buckets of `CROWD` or more, their `lonely` shingles and all `bands`.

    A set with more lonely shingles than a link leaves room for has no link there, and is left out.
    """
    crowd = members.where(F.col("n") >= CROWD).select(F.col("rep").alias("doc_id")).distinct()
    lonely = lonely_shingles(sets.join(crowd, "doc_id", "left_semi"))
    known = bands.join(crowd.withColumnRenamed("doc_id", "rep"), "rep").join(lonely, "rep", "left")
    facts = sets.select(F.col("doc_id").alias("rep"), (F.octet_length("shingles") / 8).cast("long").alias("size")).join(known, "rep", "left")
    out = members.join(facts.select("rep", "size", F.coalesce("lonely", F.lit(0)).alias("lonely"), "bands"), "rep")
    out = out.withColumn("bands", F.when(F.col("n") >= CROWD, F.col("bands")))
    return out.where((F.col("n") < CROWD) | (100 * F.col("lonely") <= (100 - percent) * F.col("size"))).withColumns({"component": F.col("rep"), "missing": F.lit(None).cast("long")})


def _components(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """`(node, component)` of what is linked: members are compared with their bucket's most common one, then with probes."""
    center = members.groupBy("bucket").agg(F.min(F.struct("lonely", "rep", "size", "missing", "component", "bands")).alias("c")).select("bucket", "c.*")
    facts = materialize(compared(_pairs(members, center, percent, once=False), sets), "facts")
    tested, links = facts.select("a", "b"), materialize(_links(facts, percent), "links")
    labels = connected_components(links)
    probed, probes = center.select("bucket", "rep"), PROBES
    members = _with_missing(members.where("n > 2"), center, facts)
    while True:
        members = materialize(_labelled(members, labels), "open")
        chosen = materialize(_probes(members.join(probed, ["bucket", "rep"], "left_anti"), links, probes), "probes")
        if not chosen.limit(1).count():
            return labels
        facts = materialize(compared(_pairs(members, chosen, percent).join(tested, ["a", "b"], "left_anti"), sets), "facts")
        tested, probed = tested.union(facts.select("a", "b")), probed.union(chosen.select("bucket", "rep"))
        new = _links(facts, percent)
        if new.limit(1).count():
            links = materialize(links.union(new), "links")
            labels = connected_components(links)
        probes *= MORE


def _probes(unprobed: DataFrame, links: DataFrame, probes: int) -> DataFrame:
    """The members that probe next, of every bucket with an unprobed member outside its largest component.

    Where those are few, all of them probe, as every open pair has one of them; else the members with the most
    links, who are likeliest to join what is apart.
    """
    waiting = unprobed.where("not main").groupBy("bucket").agg((F.count("*") <= probes).alias("few"))
    ends = links.select(F.col("a").alias("rep")).union(links.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("degree"))
    order = Window.partitionBy("bucket").orderBy(F.coalesce("degree", F.lit(0)).desc(), F.xxhash64("rep"), "rep")
    ranked = unprobed.join(waiting, "bucket").where("not few or not main").join(degree, "rep", "left").withColumn("place", F.row_number().over(order))
    return ranked.where(F.col("place") <= probes).select("bucket", "rep", "size", "lonely", "missing", "component", "bands")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple], percent: int = PERCENT, n: int = SHINGLE_WORDS) -> list[tuple]:
    """The contract restated over all pairs, for tests."""
    import re

    fold = {i: i + 32 for i in range(65, 91)}
    sets = []
    for _, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(fold))
        k = min(n, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    low: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(docs):
        low[find(i)] = min(doc_id, low.get(find(i), doc_id))
    return [(d, len(sets[i]), low[find(i)], low[find(i)] == d) for i, (d, _) in enumerate(docs)]
