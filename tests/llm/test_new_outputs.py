"""Manifest, token store and resampling against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, merkle, queries, resampling, token_store, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def odd_rows(n=90):
    """Nulls in any column, empties, repeated rows and ids, clashing names, one very long text."""
    rng = random.Random(4)
    words = ["The", "café", "Élan", "x1", "don't", "a b", "　", "日本語", "end.", "a,b", "😀", "İz"]
    text = lambda k: "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\n\n", "\t", " \n", "\r\n"]) for _ in range(k))
    rows = [(i * 7 % 61 - 3, text(rng.randint(0, 60)), rng.choice(["en", "de", "é", "", None]), rng.choice(["s", None]), rng.choice([i, None])) for i in range(n)]
    rows += [(None, None, None, None, None), (None, "a", None, None, 1), (500, "", "en", "s", 0), (501, "word " * 60_000, "en", "s", 1), rows[3], rows[3], (502, "  ", "solo", None, None)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "own", 5, 6, 7) for r in rows], f"{DOCS}, tree string, rank int, n int, bucket int").repartition(5)


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture
def sf_dir(spark, rows, tmp_path):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", "The Élan x1 x1 end"), ("b2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.fixture
def empty_dir(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    return f"{tmp_path}/e"


def same(found, expected):
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


# ---- manifest ---------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows, fan=8):
    """As the contract says, tree by tree."""
    show = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda r, text: sha("".join(map(show, (r[0], r[3], r[2], r[4], text))))
    low = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def levels(nodes):
        found = [nodes]
        while len(found[-1]) > 1:
            found.append([sha("".join(found[-1][i : i + fan])) for i in range(0, len(found[-1]), fan)])
        return found

    def path(found, at):
        for nodes in found[:-1]:
            run = nodes[at // fan * fan : at // fan * fan + fan]
            yield run[: at % fan], run[at % fan + 1 :]
            at //= fan

    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: levels([x[2] for x in sorted(trees[t], key=lambda x: x[:3])]) for t in names}
    top = levels([built[t][-1][0] for t in names])
    for at, t in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(trees[t], key=lambda x: x[:3])):
            f = leaf(r, low(r[1])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else own
            told = ""
            for left, right in [*path(built[t], i), *path(top, at)]:
                f, told = sha("".join([*left, f, *right])), told + "".join(left + right)
            yield r[0], own, built[t][-1][0], top[-1][0], sha(told), f, f == top[-1][0]


def test_manifest_query(spark, rows, sf_dir, empty_dir):
    same(queries.QUERIES["op11_merkle_manifest"](spark, sf_dir).collect(), brute_manifest(rows))
    found = queries.QUERIES["op11_merkle_manifest"](spark, empty_dir)
    assert found.count() == 0 and found.columns[:2] == ["doc_id", "leaf"]


@pytest.mark.parametrize("fan, depth, n", [(8, 1, 90), (2, 1, 33), (2, 2, 17), (3, 2, 1)])
def test_manifest_over_many_rounds(spark, rows, fan, depth, n):
    """Blocks much smaller than a tree give what one pass over it gives."""
    kept = [r for r in rows if r[0] is not None and r[0] < 400][:n]
    lowered = {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}
    found = merkle.build(frame(spark, kept), "lang", "doc_id", merkle.FIELDS, lowered, F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0, fan, depth)
    same(found.proofs().collect(), brute_manifest(kept, fan))
    assert found.root() == next(brute_manifest(kept, fan))[3]
    assert {r["tree"] for r in found.subroots().collect()} == {r[2] for r in kept}


def test_any_change_is_found(spark, rows):
    kept = [r for r in rows if r[0] is not None]
    for column, change in (("text", F.concat("text", F.lit(" "))), ("n_chars", F.col("n_chars") + 1), ("source", F.lit(None).cast("string"))):
        told = merkle.build(frame(spark, kept), "lang", "doc_id", merkle.FIELDS, {column: change}, F.col("doc_id") == 5).proofs()
        assert {r["doc_id"] for r in told.where("not verified").collect()} <= {5}
    assert told.where("not verified").count() or all(r[3] is None for r in kept if r[0] == 5)


def test_places_of_a_group_larger_than_a_partition(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "b").when(F.col("id") % 500 == 1, F.lit(None)).otherwise("a").alias("g"), F.lit(1).alias("k"), "id").repartition(7)
    found = common.placed(rows, ["g"], ["k", "id"], "at").collect()
    for g in ("a", "b", None):
        own = sorted((r for r in found if r["g"] == g), key=lambda r: r["id"])
        assert [r["at"] for r in own] == list(range(len(own)))


# ---- token store ------------------------------------------------------------------------------


def plain_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(plain_ids, "t"):
        plain_ids.t = Tokenizer.from_file(BYTES)
    return [*plain_ids.t.encode(text or "", add_special_tokens=False).ids, 0]


def brute_store(rows):
    start = 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = plain_ids(r[1])
        yield r[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)


def test_token_query(spark, rows, sf_dir, empty_dir):
    found = [tuple(r) for r in queries.QUERIES["op12_token_index"](spark, sf_dir).collect()]
    single = {r[0] for r in rows if sum(x[0] == r[0] for x in rows) == 1}
    same([r for r in found if r[0] in single], [r for r in brute_store(rows) if r[0] in single])
    same([(r[0], *r[2:]) for r in found], [(r[0], *r[2:]) for r in brute_store(rows)])  # rows of one id stand in an order of their own
    spans = sorted((r[1], r[1] + r[2]) for r in found)
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert [r[0] for r in sorted(found, key=lambda r: r[1])] == [r[0] for r in brute_store(rows)]
    assert queries.QUERIES["op12_token_index"](spark, empty_dir).count() == 0


def test_store_in_small_files(spark, rows, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(frame(spark, rows), path, BYTES, shard_bytes=500, bucket_keys=9)
    assert spark.read.parquet(f"{path}/shards").count() > 5 and spark.read.parquet(f"{path}/buckets").count() > 5
    store = token_store.TokenStore(spark, path)
    for r in rows[:12]:
        if sum(x[0] == r[0] for x in rows) == 1:
            assert store.ids(r[0]).tolist() == plain_ids(r[1])
    copies = [x[1] for x in rows if x[0] == rows[3][0]]
    held = [store.ids(rows[3][0], k).tolist() for k in range(len(copies))]
    assert sorted(held) == sorted(map(plain_ids, copies)) and store.ids(rows[3][0], len(copies)) is None
    assert store.ids(None, 1) is not None and store.ids(None, 2) is None
    assert all(store.ids(k) is None for k in range(10_000, 10_020))
    missing = spark.range(10_000, 12_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("copy"))
    assert token_store.look_up(missing, path).where("found").count() == 0
    found = token_store.read_ids(token_store.look_up(spark.read.parquet(f"{path}/keys"), path), path)
    same([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in found.collect()], [(r[0], plain_ids(r[1])) for r in rows])


def test_copies_of_one_id_are_numbered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "FEW", 1)  # so that the id is a hot key
    docs = spark.range(300).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("same text").alias("text")).repartition(5)
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs, path, BYTES, shard_bytes=100, bucket_keys=40)
    keys = spark.read.parquet(f"{path}/keys").where("doc_id = 7")
    assert sorted(r["copy"] for r in keys.collect()) == list(range(201 if 7 % 3 == 0 else 200))


def test_perfect_hash_is_minimal():
    for n in (0, 1, 2, 1000, 50_000):
        low, high = np.random.default_rng(n).integers(0, 1 << 63, (2, n)).astype(np.uint64)
        hashed = token_store.PerfectHash.build(low, high)
        assert sorted(hashed(low, high).tolist()) == list(range(n))
        assert sum(hashed.sizes) <= 6 * n + 1024
        index = token_store.Index(token_store.index_bytes(low, high, np.arange(n), np.arange(n) * 2, np.arange(n) * 3))
        record, found = index.find(low, high)
        assert found.all() and (index.shard[record] == np.arange(n)).all() and (index.length[record] == np.arange(n) * 3).all()
        assert index.find(low + np.uint64(1), high + np.uint64(1))[1].sum() == 0
    with pytest.raises(ValueError, match="distinct"):
        token_store.PerfectHash.build(np.ones(2, np.uint64), np.ones(2, np.uint64))
    with pytest.raises(ValueError, match="isn't an index"):
        token_store.Index(b"something else")


def test_remembered_bytes_are_the_tokenizers():
    encode, rng = tokens.ByteEncoder(BYTES), random.Random(1)
    texts = [r[1] for r in odd_rows() if r[1]] + ["<|endoftext|> a", "I'll don't we've 'S", "a\u0085b  c", " x ", " lead", "trail ", "x  y", "1,000.50 $5", "ß.", "ǅ. x", "\n\n\na", "\x1cz \x1f", "don't.", "'s 's", " 's", "a\n'll"]
    texts += ["".join(rng.choice("ab'1.,! \n\té 　日s") for _ in range(200)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(encode(text.encode()), encode.kind).tolist() == plain_ids(text)[:-1], text


# ---- resampling -------------------------------------------------------------------------------


def brute_ranks(rows, target):
    def features(text):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [zlib.crc32(" ".join(g).encode()) % 10_000 for n in (1, 2) for g in zip(*(words[k:] for k in range(n)), strict=False)]

    found = [(r[0], *features(r[1])) for r in rows]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for _, _, f in found:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, features(x)[1], 1)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.sum() + 10_000) / ((s[b] + 1) * (t.sum() + 10_000)))) for b in range(10_000)]
    scored = []
    for doc_id, words, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if doc_id is None else doc_id}")[:8], 16)
        scored.append((doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= 20))
    order = sorted((x for x in scored if x[4]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0, x[1], x[2]))
    for place, x in enumerate(order, start=1):
        yield *x[:4], place if place <= 25 * len(order) // 100 else None
    yield from ((*x[:4], None) for x in scored if not x[4])


def test_resampling_query(spark, rows, sf_dir, empty_dir):
    same(queries.QUERIES["op13_importance_resampling"](spark, sf_dir).collect(), brute_ranks(rows, ["The Élan x1 x1 end", None]))
    assert queries.QUERIES["op13_importance_resampling"](spark, empty_dir).count() == 0


def test_resampling_draws_what_is_like_the_target(spark):
    """A quarter of the rows is like the target; of those drawn more than half are."""
    rng = random.Random(3)
    own = [(i, " ".join(rng.choices([f"k{j}" for j in range(50)], k=40))) for i in range(100)]
    other = [(i, " ".join(rng.choices([f"z{j}" for j in range(50)], k=40))) for i in range(100, 400)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in own + other], "doc_id long, text string, score string, weight int")
    target = spark.createDataFrame([(" ".join(f"k{j}" for j in range(50)),)] * 30, "text string")
    drawn = resampling.resample(docs, target)
    ids = {r["doc_id"] for r in drawn.collect()}
    assert len(ids) == 100 and sum(i < 100 for i in ids) > 50 and drawn.columns == docs.columns
    assert resampling.resample(docs, target, percent=0).count() == 0
    assert resampling.importance_ranks(docs, target, percent=100, longest=3).where("rank is null").count() == 0


def test_resampling_stays_native(spark, sf_dir):
    found = queries.QUERIES["op13_importance_resampling"](spark, sf_dir)
    assert not re.search("Python|Pandas|Arrow", found._jdf.queryExecution().toString())


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_importance_resampling"])
def test_new_oracles(spark, name):
    data = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    told = c.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in told.description]
    same(queries.QUERIES[name](spark, data).select(columns).collect(), told.fetchall())
