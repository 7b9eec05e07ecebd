"""What the third check found: files and memory that operators take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import minhash, packing, substrings, tokens
from tidemark.llm.common import CLEANUP, materialize


def shuffled(spark) -> int:
    """Shuffle files that are there."""
    return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")


def test_tables_leave_no_shuffle_files(spark):
    given = spark.conf.get(CLEANUP)
    before = shuffled(spark)
    kept = spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 977).alias("k")).count()
    table = materialize(kept, "kept")
    assert shuffled(spark) <= before and spark.conf.get(CLEANUP) == given
    assert table.agg(F.sum("count")).first()[0] == 5000 and kept.count() == 977


def test_near_duplicates_bound_their_batches(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(setting)
    try:
        spark.conf.set(setting, str(64 << 20))
        docs = spark.createDataFrame([(i, f"a b c d e f g h i j k l m n o p q r s {i // 2}") for i in range(4)], "doc_id long, text string")
        assert sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()) == [(i, 0) for i in range(4)]
        assert int(spark.conf.get(setting)) <= 4 << 20
    finally:
        spark.conf.set(setting, given)


def test_profile_goes_after_the_first_round(spark, monkeypatch):
    """Texts' symbols are written once, and removed before the later rounds; copies are one text, rows of one id two."""
    words = [f"w{i}" for i in range(200)]
    rows = [(1, " ".join(words[:120])), (2, " ".join(words[60:])), (3, " ".join(words[:120])), (4, " ".join(reversed(words))), (5, None)]
    written, dropped = [], []
    write, drop = substrings.materialize, substrings.drop_table
    monkeypatch.setattr(substrings, "materialize", lambda df, name: (written.append(name), write(df, name))[1])
    monkeypatch.setattr(substrings, "drop_table", lambda df: (dropped.extend(f.rsplit("/", 1)[0].rsplit("/", 1)[1].split("-")[0] for f in df.inputFiles()), drop(df))[1])
    found = substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "profile" in dropped and written.count("state") == 1 + len(substrings.SPARK_ROUNDS)
    assert sorted(tuple(r) for r in found.collect()) == sorted(substrings.brute_force(rows))


def test_latin_words_spare_the_whole_tokenizer(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    plain, encode, whole = tokens.Encoder(path)._tokens, tokens.Encoder(path), []
    monkeypatch.setattr(encode, "_tokens", lambda text: whole.append(text) or plain(text))
    latin = [chr(c) for c in range(0x21, 0x250) if chr(c).isprintable() and len(chr(c).lower()) == 1 and chr(c).lower() < "\u0250"]
    texts = ["Ère ciónosares, éouchtion.%%% l'été 'S AKIA7zé²½ x's", *(f"a{c} {c}b 1{c}2 '{c}" for c in latin)]
    for text in texts:
        assert encode(text.encode()) == plain(text), text
    assert not whole
    for text in ["e\u0301 \u0130x", "é\u0301", "中文é", "a\u00a0b"]:
        assert encode(text.encode()) == plain(text), text
    assert np.frombuffer(encode(b"word"), "<u4").size and whole == ["e\u0301", "\u0130x", "é\u0301", "中文é", "a\u00a0b"]


def test_frequent_words_outlive_a_full_memory(monkeypatch):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    monkeypatch.setattr(tokens, "CACHE_WORDS", 8)
    encode, asked = tokens.Encoder(path), []
    tokenize = encode.model.tokenize

    class Model:
        def tokenize(self, piece: str):
            asked.append(piece)
            return tokenize(piece)

    encode.model = Model()
    rare = ["".join("abcdefghij"[int(d)] for d in str(1000 + i)) for i in range(100)]
    for word in rare:
        assert encode(f"often {word}".encode()) == encode._tokens(f"often {word}")
    assert asked.count("often") == 1 and len(asked) == 101
    assert len(encode.known) <= 8


def test_documents_that_follow_one_another_are_placed_together(monkeypatch):
    totals, rng = np.array([300_000, 5_000, 70_001]), np.random.default_rng(7)
    phases, turns = packing.schedule(totals, totals.astype(float), 512), packing.Turns()
    place, calls = packing.pieces_of, []
    monkeypatch.setattr(packing, "pieces_of", lambda *a: calls.append(a[2:4]) or place(*a))
    for queue, total in enumerate(totals.tolist()):
        cuts = [0, 1, 2, *sorted(rng.choice(np.arange(3, total), 60, replace=False).tolist()), total]
        spans = list(zip(cuts, cuts[1:]))
        del spans[20]  # a gap
        spans.append(spans.pop(5))  # and one out of order
        calls.clear()
        found = list(packing.pieces_by_document(phases, queue, spans, turns))
        assert len(calls) == 4
        assert found == [(i, *p) for i, (a, b) in enumerate(spans) for p in place(phases, queue, a, b, turns)]
    assert not list(packing.pieces_by_document(phases, 0, [], turns))
