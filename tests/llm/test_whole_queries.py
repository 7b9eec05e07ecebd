"""Registered queries, with their last columns, against brute force."""

import hashlib
import os
import random
import re
import zlib

import pytest

from tidemark.llm import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
DATA = "/root/testdata/sf0.001"


def test_shards_hold_every_row_with_its_size_and_crc(spark, tmp_path):
    """Nulls in any column, empties, repeated rows, one id with several texts, a very long text; and an empty table."""
    rng = random.Random(10)
    rows = [(i, "é😀 word" * rng.randint(0, 9), "en", rng.choice(["s", None]), i) for i in range(130)]
    rows += [(None, None, None, None, None), (7, "another", None, None, 1), (200, "", "de", "s", 0), (201, "long " * 120_000, "en", "s", 1), rows[3], rows[3]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/d/documents.parquet")
    found = queries.QUERIES["op10_external_shuffle"](spark, f"{tmp_path}/d").collect()
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    some = lambda t: (t[0] is not None, t)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in found), key=some) == sorted(((i, len(d) + 16, zlib.crc32(d)) for i, d in data), key=some)
    slots = {}
    for r in found:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < 40
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(slots) == 40 and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/e/documents.parquet")
    assert queries.QUERIES["op10_external_shuffle"](spark, f"{tmp_path}/e").count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_near_duplicates_are_those_of_all_pairs(spark):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, t in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    of = {i: i for i in sets}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                of[high] = low
    found = queries.QUERIES["op7_minhash_near_dedup"](spark, DATA).collect()
    assert len(set(map(top, ids))) < len(ids)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in found} == {(i, len(sets[i]), top(i), top(i) == i) for i in ids} and len(found) == len(ids)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_benchmark_words_are_those_of_every_window(spark):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    items = {}
    for i, t in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect():
        w = words(t)
        for k in range(max(1, len(w) - 9)) if w else ():
            items.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    want = set()
    for i, t in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect():
        w, hit, of = words(t), set(), set()
        for n in {len(x) for x in items}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in items:
                    hit |= set(range(k, k + n))
                    of |= items[tuple(w[k : k + n])]
        want.add((i, len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    found = queries.QUERIES["op5_decontamination"](spark, DATA).collect()
    assert any(x[5] for x in want) and len(found) == len(want)
    assert {(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_removed_words_are_those_of_windows_that_start_before(spark):
    docs = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    first = {}
    for i in sorted(docs):
        for k in range(len(docs[i]) - 49):
            first.setdefault(hash(tuple(docs[i][k : k + 50])), i)
    want = set()
    for i, w in docs.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[hash(tuple(w[k : k + 50]))] < i:
                gone |= set(range(k, k + 50))
        want.add((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    found = queries.QUERIES["op9_substring_dedup"](spark, DATA).collect()
    assert any(x[2] for x in want) and len(found) == len(want)
    assert {(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found} == want
