"""Merkle manifest of a data set: a tree of hashes over its rows for each partition value, and one over these trees.

A row is a leaf, the hash of its fields. Leaves of a tree stand in order of their key; every `FAN` consecutive nodes (the last
run may have fewer, even one) become the hash of their concatenation, until one is left. The trees' roots, in order of their
names, make the last tree in the same way.

Leaves are hashed where their rows are read, so texts aren't shuffled. Places come from a distributed sort. Blocks of
`FAN ** DEPTH` consecutive nodes are aligned with the tree, so what happens in one depends on nothing else: a task takes a block
as an Arrow table and has DuckDB work out its levels, each an ordered `string_agg` under `sha256`. Spark combines the blocks'
roots: they are the nodes of the next round, in which they stand in blocks again, so no task ever holds more than a block,
however large a tree is. On the way back each block's siblings are joined to the blocks below, and in the last
round DuckDB folds every leaf's own path up to the root.

Defined cases: a null field is `-`; a null name is a tree of its own, before the others; null keys come first; rows with equal
keys stand in order of their hashes; equal rows are leaves of their own; a lone leaf is its tree's root, and without siblings
the proof is the hash of nothing; an empty table has no rows and no root; a very long text is hashed where it is read; other
columns aren't read.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, placed, small, table

#: Nodes of a run, and levels of a block.
FAN, DEPTH = 8, 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_NODE = "tree string, n long, pos long, h string"
_PATH = "tree string, pos long, lefts array<string>, rights array<string>, subroot string, root string"


def field_text(value: Column) -> Column:
    """A field as it goes into a leaf: its bytes counted, or `-`."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def levels_of(n: int, fan: int, depth: int) -> int:
    """Levels that a block of a tree with `n` nodes goes up."""
    if n > fan**depth:
        return depth
    levels = 0
    while fan**levels < n:
        levels += 1
    return levels


def _duck():
    """One small DuckDB in each Python worker; blocks fit in its memory."""
    import duckdb

    if not hasattr(_duck, "connection"):
        _duck.connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
    return _duck.connection


def _climbed(nodes, fan: int, depth: int) -> int:
    """Tables `l0` (the nodes) to the last level of the block: pos, run (the hashes that became one) and h; how many levels."""
    connection = _duck()
    connection.register("nodes", nodes)
    connection.execute(f"create or replace temp table l0 as select pos % {fan**depth} as pos, h from nodes").fetchall()
    levels = levels_of(nodes.column("n")[0].as_py(), fan, depth)
    for k in range(levels):
        connection.execute(f"create or replace temp table l{k + 1} as select pos, run, sha256(run) as h from (select pos // {fan} as pos, string_agg(h, '' order by pos) as run from l{k} group by all)").fetchall()
    return levels


def climb(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """The next round's `(tree, n, pos, h)`: the root of each block of `nodes(tree, n, pos, h)`; n: the tree's nodes."""
    import pyarrow as pa

    size = fan**depth

    def root(block: pa.Table) -> pa.Table:
        levels = _climbed(block, fan, depth)
        n, ((h,),) = block.column("n")[0].as_py(), _duck().execute(f"select h from l{levels}").fetchall()
        return pa.table({"tree": pa.array([block.column("tree")[0].as_py()], pa.string()), "n": pa.array([-(-n // size)], pa.int64()), "pos": pa.array([block.column("pos")[0].as_py() // size], pa.int64()), "h": pa.array([h], pa.string())})

    blocks = nodes.select("tree", "n", "pos", "h", F.floor(F.col("pos") / size).cast("long").alias("block"))
    return materialize(blocks.groupBy("tree", "block").applyInArrow(root, _NODE), "nodes")


def rounds(nodes: DataFrame, fan: int = FAN, depth: int = DEPTH) -> list[DataFrame]:
    """`nodes` and the nodes of each round, until each tree is one."""
    found = [nodes]
    while len(found) == 1 or found[-1].where("n > 1").limit(1).count():
        found.append(climb(found[-1], fan, depth))
    return found


def _steps(levels: int, fan: int, outer: int) -> str:
    """DuckDB SQL that takes `s0(.., spot, f, p)` up all levels: f is hashed with its siblings, p gathers these."""
    parts = []
    for k in range(levels):
        place = f"64 * ((s{k}.spot // {fan**k}) % {fan})::int"
        left, right = f"left(run, {place})", f"substr(run, {place} + 65)"
        parts.append(f"s{k + 1} as (select s{k}.* replace (sha256({left} || f || {right}) as f, p || {left} || {right} as p) from s{k} join l{k + 1} on l{k + 1}.pos = s{k}.spot // {fan ** (k + 1)})")
    for k in range(levels, levels + outer):
        a, b = 2 * (k - levels) + 1, 2 * (k - levels) + 2
        parts.append(f"s{k + 1} as (select * replace (sha256(${a} || f || ${b}) as f, p || ${a} || ${b} as p) from s{k})")
    return ", ".join(parts)


def paths(nodes: DataFrame, above: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """`(tree, pos, lefts, rights, subroot, root)` of each node: its siblings, level by level, with those of its block.

    above: the same for the blocks' roots, `pos` being the block. For rounds of blocks, of which there are few.
    """
    import pyarrow as pa

    size = fan**depth

    def told(block: pa.Table, up: pa.Table) -> pa.Table:
        levels, (over,) = _climbed(block, fan, depth), up.to_pylist()
        place = lambda k: f"64 * ((l0.pos // {fan**k}) % {fan})::int"
        runs = " ".join(f"join l{k + 1} on l{k + 1}.pos = l0.pos // {fan ** (k + 1)}" for k in range(levels))
        lefts = ", ".join(f"left(l{k + 1}.run, {place(k)})" for k in range(levels))
        rights = ", ".join(f"substr(l{k + 1}.run, {place(k)} + 65)" for k in range(levels))
        first = block.column("pos")[0].as_py() // size * size
        rows = _duck().execute(f"select l0.pos, [{lefts}]::varchar[], [{rights}]::varchar[] from l0 {runs}").fetchall()
        text, many = pa.string(), pa.list_(pa.string())
        return pa.table({
            "tree": pa.array([over["tree"]] * len(rows), text), "pos": pa.array([first + r[0] for r in rows], pa.int64()), "lefts": pa.array([r[1] + over["lefts"] for r in rows], many),
            "rights": pa.array([r[2] + over["rights"] for r in rows], many), "subroot": pa.array([over["subroot"]] * len(rows), text), "root": pa.array([over["root"]] * len(rows), text),
        })

    blocks = nodes.select("tree", "n", "pos", "h", F.floor(F.col("pos") / size).cast("long").alias("block"))
    found = blocks.groupBy("tree", "block").cogroup(above.withColumn("block", F.col("pos")).groupBy("tree", "block")).applyInArrow(told, _PATH)
    return materialize(found, "paths")


def proven(leaves: DataFrame, above: DataFrame, fan: int = FAN, depth: int = DEPTH) -> DataFrame:
    """`(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)` of `leaves(doc_id, tree, n, pos, h, claimed)`.

    Each claimed hash is folded with the leaf's siblings up to the root; above: as of `paths`.
    """
    import pyarrow as pa

    size = fan**depth

    def told(block: pa.Table, up: pa.Table) -> pa.Table:
        levels, (over,) = _climbed(block, fan, depth), up.to_pylist()
        outer = [x for pair in zip(over["lefts"], over["rights"], strict=True) for x in pair]
        steps = _steps(levels, fan, len(outer) // 2)
        last = f"s{levels + len(outer) // 2}"
        query = f"with s0 as (select doc_id, h as leaf, pos % {size} as spot, claimed as f, '' as p from nodes)" + (f", {steps}" if steps else "")
        found = _duck().sql(f"{query} select doc_id, leaf, sha256(p) as proof_sha256, f as folded_root from {last}", params=outer).to_arrow_table()
        same = lambda x: pa.array([x] * found.num_rows, pa.string())
        folded = found.column("folded_root").cast(pa.string())
        return pa.table({
            "doc_id": found.column("doc_id").cast(pa.int64()), "leaf": found.column("leaf").cast(pa.string()), "subroot": same(over["subroot"]), "root": same(over["root"]),
            "proof_sha256": found.column("proof_sha256").cast(pa.string()), "folded_root": folded, "verified": pa.array([x == over["root"] for x in folded.to_pylist()], pa.bool_()),
        })

    blocks = leaves.withColumn("block", F.floor(F.col("pos") / size).cast("long"))
    result = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.groupBy("tree", "block").cogroup(above.withColumn("block", F.col("pos")).select("tree", "block", "lefts", "rights", "subroot", "root").groupBy("tree", "block")).applyInArrow(told, result)


@dataclass
class Manifest:
    """leaves: `(doc_id, tree, h, claimed, pos, n)`; inner: nodes by round, from the leaves to the trees' roots; outer: the
    same of the tree over trees, whose nodes are places of `trees(tree, n, place)`."""

    leaves: DataFrame
    inner: list[DataFrame]
    trees: DataFrame
    outer: list[DataFrame]
    fan: int
    depth: int

    def root(self) -> str | None:
        found = self.outer[-1].select("h").first()
        return found[0] if found else None

    def subroots(self) -> DataFrame:
        """`(tree, h)`: the root of each tree."""
        return self.inner[-1].select("tree", "h")

    def proofs(self) -> DataFrame:
        """As of `proven`, for all leaves."""
        spark, none = self.leaves.sparkSession, F.array().cast("array<string>")
        top = self.outer[-1].select("tree", "pos", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
        for nodes in reversed(self.outer[:-1]):
            top = paths(nodes, top, self.fan, self.depth)
        named = self.trees.select("tree", "place").alias("t").join(self.subroots().alias("s"), F.col("t.tree").eqNullSafe(F.col("s.tree"))).select("t.tree", "place", F.col("s.h").alias("subroot"))
        above = named.join(top.select(F.col("pos").alias("place"), "lefts", "rights", "root"), "place").select("tree", F.lit(0).cast("long").alias("pos"), "lefts", "rights", "subroot", "root")
        above = spark.createDataFrame([], _PATH).unionByName(above)
        for nodes in reversed(self.inner[1:-1]):
            above = paths(nodes, above, self.fan, self.depth)
        return proven(self.leaves, above, self.fan, self.depth)


def build(docs: DataFrame, tree: str, key: str, fields: list[str], altered: dict[str, Column] | None = None, where: Column | None = None, fan: int = FAN, depth: int = DEPTH) -> Manifest:
    """The manifest of `docs`: a tree for each value of `tree`, its leaves by `key`.

    altered: columns as somebody claims they are, for the rows `where`; their hashes are folded by `proofs`.
    """
    own = leaf_hash([F.col(f) for f in fields])
    other = leaf_hash([(altered or {}).get(f, F.col(f)) for f in fields])
    claimed = F.when(F.coalesce(where, F.lit(False)), other) if altered and where is not None else F.lit(None).cast("string")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(tree).cast("string").alias("tree"), own.alias("h"), claimed.alias("claimed"))
    at = placed(rows, ["tree"], [F.asc_nulls_first("doc_id"), "h"], "pos")
    trees = placed(at.groupBy("tree").agg(F.count("*").alias("n")), [], [F.asc_nulls_first("tree")], "place")
    trees = materialize(trees, "trees")
    counted = at.alias("a").join(small(trees).alias("t"), F.col("a.tree").eqNullSafe(F.col("t.tree"))).select("a.doc_id", "a.tree", "a.pos", "a.h", F.coalesce("a.claimed", "a.h").alias("claimed"), "t.n")
    leaves = materialize(counted, "leaves")
    inner = rounds(leaves.select("tree", "n", "pos", "h"), fan, depth)
    roots = trees.alias("t").join(inner[-1].alias("r"), F.col("t.tree").eqNullSafe(F.col("r.tree"))).select(F.lit("").alias("tree"), F.lit(trees.count()).cast("long").alias("n"), F.col("t.place").alias("pos"), F.col("r.h").alias("h"))
    return Manifest(leaves, inner, trees, rounds(materialize(roots, "roots"), fan, depth), fan, depth)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lowered = {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0
    return build(docs, "lang", "doc_id", FIELDS, lowered, tampered).proofs()


def oracle() -> str:
    """DuckDB SQL for the query: each level of all trees is a step of a recursion."""
    from .resampling import _crc32

    shown = lambda f: f"coalesce(strlen({f}::varchar) || ':' || {f}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(shown(text if f == "text" else f) for f in FIELDS) + ")"
    low = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    up = lambda t: f"select {t}.tree, lvl + 1, pos // {FAN}, sha256(string_agg(h, '' order by pos)), any_value((n + {FAN - 1}) // {FAN}) from {t} where n > 1 group by {t}.tree, lvl, pos // {FAN}"
    return f"""
with recursive d as (select doc_id, lang as tree, {leaf('text')} as leaf, case when {_crc32('doc_id::varchar')} % 3 = 0 then {leaf('x')} else {leaf('text')} end as claimed from (select *, {low} as x from documents)),
l as (select *, row_number() over (partition by tree order by doc_id) - 1 as pos, count(*) over (partition by tree) as n from d),
t as (select tree, 0 as lvl, pos::bigint as pos, leaf as h, n::bigint as n from l union all {up('t')}),
r as (select tree, h as subroot, row_number() over (order by tree nulls first) - 1 as place, count(*) over () as k from t where n = 1),
o as (select 0 as tree, 0 as lvl, place::bigint as pos, subroot as h, k::bigint as n from r union all {up('o')}),
q as (select l.doc_id, l.tree, l.leaf, l.claimed as f, ''::varchar as p, l.pos, 0 as lvl, 0 as above, r.subroot, r.place, (select h from o where n = 1) as root from l join r on r.tree is not distinct from l.tree),
s as (select t.tree, 0 as above, t.lvl, t.pos // {FAN} as run, list(h order by pos) as h from t where n > 1 group by 1, 3, 4 union all select null, 1, lvl, pos // {FAN}, list(h order by pos) from o where n > 1 group by 3, 4),
w as (
  select * from q
  union all
  select doc_id, w.tree, leaf, case when h is null then f else sha256(array_to_string(h[:(w.pos % {FAN})::int] || [f] || h[(w.pos % {FAN})::int + 2:], '')) end,
    case when h is null then p else p || array_to_string(h[:(w.pos % {FAN})::int] || h[(w.pos % {FAN})::int + 2:], '') end,
    case when h is null then place else w.pos // {FAN} end, case when h is null then 0 else w.lvl + 1 end, case when h is null then w.above + 1 else w.above end, subroot, place, root
  from w left join s on w.above = s.above and w.lvl = s.lvl and s.run = w.pos // {FAN} and (w.above = 1 or s.tree is not distinct from w.tree) where w.above < 2)
select doc_id, leaf, subroot, root, sha256(p) as proof_sha256, f as folded_root, f = root as verified from w where above = 2
"""


ORACLE = oracle()
