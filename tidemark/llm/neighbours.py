"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted to a bounded sample (`SAMPLE` distinct vectors, those with the smallest hashes); every row is indexed, in the leaf that a
descent to the nearest child reaches. A query goes through the tree best bin first: a priority queue holds the
nodes not yet visited by the distance to their centre, and the order in which leaves come out is the order of
visits. How many leaves to visit is calibrated: for some queries the exact neighbours are found over all rows,
and visits widen leaf by leaf until `RECALL` of these lie in visited leaves.

Equal vectors are one entry with their k + 1 smallest ids, which are all that a result of k can name; so a vector
that a third of the rows have costs one entry. Leaves are joined with their queries in blocks of bounded size on
both sides. Visits are made in rounds, each of `WIDEN` times as many leaves as all before it; a leaf gives only what
is no farther than the k nearest that earlier rounds found, so what the rounds give grows with the queries and not
with the leaves visited. Distances are computed in double precision from the original vectors.

Defined cases: a vector that is null, zero, of another length than most, or has a null or non-finite component,
takes no part; ties go to the smaller id; a row without id takes no part; of rows with one id and several
vectors each vector stands for itself; a query finds all candidates where these are fewer than asked for;
without candidates or queries the result is empty; other columns aren't read.

Leaves hold `LEAF_ROWS` vectors about up to 160,000 distinct ones, and grow beyond, as a leaf needs `LEAF_SAMPLE`
of the sample; the visits are calibrated to whatever the leaves are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_counted, materialize, sampled, table

#: Vectors that the tree is fitted to and queries it is calibrated on, at most.
SAMPLE, CALIBRATION = 20_000, 100
#: Rows that a leaf should hold, sampled vectors it needs at least, children of a node.
LEAF_ROWS, LEAF_SAMPLE, CHILDREN = 64, 8, 8
RECALL = 0.95
#: Vectors or queries of a leaf that are compared in one task.
BLOCK = 4096
#: Leaves of the first round of visits, and how many times as many are visited by the end of each later one.
FIRST, WIDEN = 4, 4


class Tree:
    """Centres by node; children of a node, none for a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 3):
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []
        self.leaf_of: dict[int, int] = {}
        self.rng = np.random.default_rng(seed)
        self.most = max(LEAF_SAMPLE, -(-len(sample) // max(1, leaves)))
        self._grow(sample.astype(np.float64))
        self.centres = np.array(self.centres)
        self.leaves = len(self.leaf_of)

    def _grow(self, points: np.ndarray) -> int:
        node = len(self.children)
        self.centres.append(points.mean(axis=0))
        self.children.append([])
        group = self._split(points) if len(points) > self.most else None
        if group is None:
            self.leaf_of[node] = len(self.leaf_of)
        else:
            self.children[node] = [self._grow(points[group == g]) for g in np.unique(group)]
        return node

    def _split(self, points: np.ndarray) -> np.ndarray | None:
        """k-means into `CHILDREN` groups or fewer; None if they don't part."""
        k = min(CHILDREN, -(-len(points) // self.most))
        centres = points[self.rng.choice(len(points), k, replace=False)]
        for _ in range(12):
            group = distances(points, centres).argmin(axis=1)
            centres = np.array([points[group == g].mean(axis=0) if (group == g).any() else centres[g] for g in range(k)])
        group = distances(points, centres).argmin(axis=1)
        return group if len(np.unique(group)) > 1 else None

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point."""
        out, waiting = np.zeros(len(points), dtype=np.int32), [(0, np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            if not self.children[node]:
                out[rows] = self.leaf_of[node]
                continue
            nearest = distances(points[rows], self.centres[self.children[node]]).argmin(axis=1)
            waiting += [(child, rows[nearest == i]) for i, child in enumerate(self.children[node]) if (nearest == i).any()]
        return out

    def best_bins(self, query: np.ndarray, visits: int | None = None) -> list[int]:
        """Leaves in the order of visits, best bin first."""
        queue, order = [(0.0, 0)], []
        while queue and (visits is None or len(order) < visits):
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                order.append(self.leaf_of[node])
                continue
            below = self.children[node]
            for child, d in zip(below, distances(query[None, :], self.centres[below])[0].tolist(), strict=True):
                heapq.heappush(queue, (d, child))
        return order


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared, up to rounding; for ordering candidates only."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T), 0)


def nearest(queries: np.ndarray, vectors: np.ndarray, low: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: (its number, vectors, exact distances) of all that may be among the k nearest by (distance, id)."""
    for start in range(0, len(queries), 256):
        part = queries[start : start + 256]
        rough = distances(part, vectors)
        k_th = np.partition(rough, min(k, len(vectors)) - 1, axis=1)[:, min(k, len(vectors)) - 1]
        slack = 1e-9 * ((part * part).sum(axis=1) + (vectors * vectors).sum(axis=1).max())
        for i in range(len(part)):
            at = np.flatnonzero(rough[i] <= k_th[i] + slack[i])
            exact = np.sqrt(((vectors[at] - part[i]) ** 2).sum(axis=1))
            order = np.lexsort((low[at], exact))
            last = exact[order[min(k, len(order)) - 1]]
            order = order[exact[order] <= last]
            yield start + i, at[order], exact[order]


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """`(vec_id, embedding)` of the rows that take part, and their dimension."""
    good = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # floats take half the room, and are as exact
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).where(good)
    size = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = size[0]["d"] if size else 0
    return rows.where(F.size("embedding") == d), d


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """`(embedding, ids)`: each vector with its k + 1 smallest ids."""
    order = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column) -> np.ndarray:
    """Vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def index(entries: DataFrame, tree) -> DataFrame:
    """`entries` with the leaf of each."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(tree.value.assign(_matrix(batch.column(0))), pa.int32()), *batch.columns], names=["leaf", "embedding", "ids"])

    return entries.mapInArrow(run, f"leaf int, embedding {_kind(entries)}, ids array<long>")


def _kind(df: DataFrame) -> str:
    return df.schema["embedding"].dataType.simpleString()


def exact_leaves(indexed: DataFrame, queries: np.ndarray, keys: np.ndarray, k: int) -> dict[int, list[int]]:
    """For a few queries, the leaves of their k nearest over all rows (each part sends its k nearest)."""
    import pyarrow as pa

    shared = indexed.sparkSession.sparkContext.broadcast((queries, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, keys = shared.value
        for batch in batches:
            ids = batch.column(2).to_pylist()
            low, leaf, out = np.array([i[0] for i in ids], dtype=np.int64), batch.column(0).to_numpy(), [[], [], [], []]
            if not len(low):
                continue
            for q, at, exact in nearest(queries, _matrix(batch.column(1)), low, k + 1):
                for a, e in zip(at.tolist(), exact.tolist(), strict=True):
                    for i in ids[a]:
                        if i != keys[q]:
                            for column, value in zip(out, (q, e, i, int(leaf[a])), strict=True):
                                column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.float64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32())], names=["q", "score", "vec_id", "leaf"])

    found = indexed.mapInArrow(run, "q int, score double, vec_id long, leaf int")
    order = Window.partitionBy("q").orderBy("score", "vec_id")
    best: dict[int, list[int]] = {}
    for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "leaf").collect():
        best.setdefault(r["q"], []).append(r["leaf"])
    return best


def calibrate(tree: Tree, indexed: DataFrame, queries: list, k: int, recall: float = RECALL) -> tuple[int, float]:
    """Leaves to visit, widened until the recall over the calibration queries is reached; and that recall."""
    if not queries:
        return tree.leaves, 1.0
    vectors, keys = np.array([q["embedding"] for q in queries]), np.array([q["low"] for q in queries])
    truth = exact_leaves(indexed, vectors, keys, k)
    order = {q: tree.best_bins(vectors[q]) for q in truth}
    place = np.array([order[q].index(leaf) for q, leaves in truth.items() for leaf in leaves])
    visits, reached = 1, float((place < 1).mean()) if len(place) else 1.0
    while reached < recall and visits < tree.leaves:
        visits += 1
        reached = float((place < visits).mean())
    return visits, reached


def _compared(visiting: DataFrame, indexed: DataFrame, blocks: dict[int, int], k: int) -> DataFrame:
    """`(low, vec_id, score)` of `visiting(leaf, embedding, low, far)`: the k + 1 nearest in each leaf, within `far`."""
    import pyarrow as pa

    parts = {r["leaf"]: -(-r["count"] // BLOCK) for r in visiting.groupBy("leaf").count().collect()}
    several = lambda of: {leaf: n for leaf, n in of.items() if n > 1}
    number = lambda of: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in of.items() for x in kv)), F.col("leaf")), F.lit(1)) if of else F.lit(1)
    block, part = number(several(blocks)), number(several(parts))
    own = indexed.select("leaf", F.pmod(F.xxhash64("embedding"), block).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), part - 1)).alias("part"), "embedding", "ids")
    from_queries = visiting.select("leaf", F.explode(F.sequence(F.lit(0), block - 1)).alias("block"), F.pmod(F.xxhash64("embedding"), part).cast("int").alias("part"), "embedding", "low", "far")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = right.column("ids").to_pylist()
            smallest = np.array([i[0] for i in ids], dtype=np.int64)
            low, far = left.column("low").to_pylist(), left.column("far").to_pylist()
            for q, at, exact in nearest(_matrix(left.column("embedding").combine_chunks()), _matrix(right.column("embedding").combine_chunks()), smallest, k + 1):
                found = sorted((e, i) for a, e in zip(at.tolist(), exact.tolist(), strict=True) if e <= far[q] for i in ids[a])[: k + 1]
                out[0] += [low[q]] * len(found)
                out[1] += [i for _, i in found]
                out[2] += [e for e, _ in found]
        return pa.table({"low": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = ["leaf", "block", "part"]
    return from_queries.groupBy(*keys).cogroup(own.groupBy(*keys)).applyInArrow(compare, "low long, vec_id long, score double")


def search(vectors: DataFrame, is_query: Column, k: int = 10, recall: float = RECALL) -> DataFrame:
    """`(query_id, rank, vec_id, score, visited, recall)`: the k nearest found for each row that `is_query`, its own id
    left out; the share of leaves visited for each query, and the recall of that in calibration."""
    import pyarrow as pa

    spark = vectors.sparkSession
    rows, _ = usable(vectors)
    entries = materialize(distinct_vectors(rows, k), "vectors")
    n = entries.count()
    asked = rows.where(is_query).groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"))
    asked = materialize(asked, "asked")
    queries = asked.count()
    if not n or not queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, visited double, recall double")
    sample = np.array([r["embedding"] for r in sampled(entries.select("embedding"), SAMPLE, n, 4, "embedding")], dtype=np.float64)
    tree = Tree(sample, -(-n // LEAF_ROWS))
    shared = spark.sparkContext.broadcast(tree)
    indexed = materialize(index(entries, shared), "index")
    visits, reached = calibrate(tree, indexed, sampled(asked, CALIBRATION, queries, 4, "embedding"), k, recall)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            orders = [shared.value.best_bins(q, visits) for q in _matrix(batch.column(0))]
            source = pa.array(np.repeat(np.arange(len(orders)), [len(o) for o in orders]))
            leaves = np.array([x for o in orders for x in o], dtype=np.int32)
            turns = np.array([t for o in orders for t in range(len(o))], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(leaves, pa.int32()), pa.array(turns, pa.int32()), batch.column(0).take(source), batch.column(1).take(source)], names=["leaf", "turn", "embedding", "low"])

    visiting = materialize(asked.select("embedding", "low").mapInArrow(visit, f"leaf int, turn int, embedding {_kind(asked)}, low long"), "visits")
    blocks = {r["leaf"]: -(-r["count"] // BLOCK) for r in indexed.groupBy("leaf").count().collect()}
    order = Window.partitionBy("low").orderBy("score", "vec_id")
    best, begin, end = spark.createDataFrame([], "low long, vec_id long, score double"), 0, FIRST
    while begin < visits:
        bound = best.groupBy("low").agg(F.max("score").alias("far"), F.count("*").alias("n")).where(F.col("n") > k).select("low", "far")
        turn = visiting.where((F.col("turn") >= begin) & (F.col("turn") < end)).join(bound, "low", "left")
        near = _compared(turn.withColumn("far", F.coalesce("far", F.lit(float("inf")))), indexed, blocks, k)
        merged = best.unionByName(near).withColumn("n", F.row_number().over(order))
        best = materialize(merged.where(F.col("n") <= k + 1).drop("n"), "best")
        begin, end = end, end * WIDEN
    named = join_counted(rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding").distinct(), asked, ["embedding"]).select("query_id", "low")
    lists = best.groupBy("low").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k + 1 each
    results = join_counted(named, lists.join(asked.select("low", "n"), "low"), ["low"])
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = results.select("query_id", F.posexplode(others).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score", F.lit(visits / tree.leaves).alias("visited"), F.lit(reached).alias("recall"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def brute_force(rows: list[tuple], every: int = 100, k: int = 10) -> list[tuple]:
    """The contract restated over all pairs, for tests."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = []
    for q, v in good:
        if q % every == 0:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in good if i != q)[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found)]
    return out
