"""The pipeline's stages, each on its own input, against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import decontamination, lines, minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(500)]
    text = lambda k: " ".join(rng.choices(words, k=k))
    items = [(i, text(30)) for i in range(3)]
    rows, labels = [], []
    for i in range(240):
        kind = i % 6
        t = "\n".join(text(rng.randint(9, 40)) for _ in range(4))
        if kind == 1:
            t = t.upper().replace(" ", "!! ") + "!!"
        elif kind == 2:
            t = t.replace(" ", " idiot ", 2)
        elif kind == 3:
            ws = rows[i - 3][1].split(" ")
            for j in range(0, len(ws), 12):  # every line differs by more than a word
                ws[j] = ws[j] + "x"
            t = " ".join(ws)
        elif kind == 4 and i % 4 == 0:
            t += "\n" + items[i % 3][1]
        rows.append((i, t, "en", f"s{i % 4}", len(t)))
        if i < 200:
            labels.append((i, int(kind != 1), int(kind == 2)))
    rows.append((900, None, None, None, None))
    base = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def _texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, sf_dir):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_dedup", "decontamination", "packing"]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    kept = corpus_pipeline.materialize(stages["quality"](spark, docs, sf_dir), "t")
    assert kept.columns == docs.columns
    bad = {i for i in range(240) if i % 6 in (1, 2)}
    assert len(bad & set(_texts(kept))) <= 3 and len(set(_texts(docs)) - bad - set(_texts(kept))) <= 3

    before = _texts(kept)
    cut = corpus_pipeline.materialize(stages["lines"](spark, kept, sf_dir), "t")
    expected = {r[0]: r for r in lines.brute_force(list(before.items()))}
    after = _texts(cut)
    assert cut.columns == docs.columns
    for i, t in after.items():
        assert (t or "").count("\n") + 1 == (before[i] or "").count("\n") + 1 - expected[i][2]
    assert all(expected[i][2] for i in set(before) - set(after))

    one = corpus_pipeline.materialize(stages["near_dedup"](spark, cut, sf_dir), "t")
    assert set(_texts(one)) == {r[0] for r in minhash.brute_force(list(after.items()), corpus_pipeline.NEAR_PERCENT) if r[3]}

    clean = corpus_pipeline.materialize(stages["decontamination"](spark, one, sf_dir), "t")
    assert set(_texts(clean)) == {r[0] for r in decontamination.brute_force(list(_texts(one).items()), items) if not r[5]} and clean.count() < one.count()

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = stages["packing"](spark, clean, sf_dir).collect()
    sizes = {}
    for p in pieces:
        sizes[p["doc_id"]] = sizes.get(p["doc_id"], 0) + p["length"]
    assert sizes == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in _texts(clean).items()}
    ends = np.bincount([p["sequence_id"] for p in pieces], weights=[p["length"] for p in pieces])
    assert all(e == 4096 or int(e) & (int(e) - 1) == 0 for e in ends)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
