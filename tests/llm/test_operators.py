"""Each operator against its brute-force version, with odd rows: nulls, empties, repeats, clashing columns."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, language, linear, lines, minhash, neighbours, packing, quality, sharding, substrings, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed: int = 0, n: int = 60):
    """Texts with copies, near copies, shared passages, empties and nulls."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "a,b", "The", "|", "|"]
    text = lambda k: "\n".join(" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(k))
    passage = " ".join(rng.choices(words, k=70))
    rows = []
    for i in range(n):
        kind = i % 8
        if kind == 1 and rows:
            t = rng.choice(rows)[1]
        elif kind == 2 and rows and (old := rng.choice(rows)[1]):
            ws = old.split(" ")
            ws[rng.randrange(len(ws))] = "changed"
            t = " ".join(ws)
        elif kind == 3:
            t = f"{text(2)} {passage} {text(2)}"
        elif kind == 4:
            t = rng.choice([None, "", " \n ", "one", "| " * 130, "x " * 49 + "x"])
        else:
            t = text(rng.randint(1, 12))
        rows.append((i * 3 - 5, t, rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", None]), 0))
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def collected(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_minhash(docs, rows, none):
    found = collected(minhash.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted(minhash.brute_force([r[:2] for r in rows]), key=repr)
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_group_of_near_copies(spark):
    """A star: copies link with their original only, which isn't the smallest id."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(90):
        ws = list(base)
        for j in rng.sample(range(150), rng.choice([1, 2, 3, 4, 6])):
            ws[j] = f"e{i}_{j}"
        rows.append((i, " ".join(ws)))
    found = collected(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted(minhash.brute_force(rows), key=repr)


def test_minhash_rows_without_id(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F")]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash")))
    assert collected(found, "doc_id", "component_id", "kept") == sorted([(None, None, True), (1, 1, True), (1, 1, True), (2, 1, False)], key=repr)


def test_minhash_rows_of_one_id_with_several_texts(spark):
    rng = random.Random(6)
    text = lambda: [rng.choice("abcdefghij") + str(rng.randrange(200)) for _ in range(60)]
    a, b, c, d = text(), text(), text(), text()
    near = lambda ws: " ".join([*ws, "more"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (3, near(b)), (4, near(a)), (7, " ".join(c)), (7, " ".join(d)), (2, near(c)), (9, near(d)), (7, " ".join(c)), (7, " ".join(c).upper()), (8, ""), (8, "x")]
    found = collected(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)), "doc_id", "n_shingles", "component_id", "kept")
    assert found == sorted(minhash.brute_force(rows), key=repr)
    assert {(r[0], r[2]) for r in found} == {(1, 1), (3, 1), (4, 1), (7, 2), (7, 7), (2, 2), (9, 7), (8, 8)}


def test_substrings(docs, rows, none):
    found = collected(substrings.dedup_substrings(docs), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == sorted(substrings.brute_force([r[:2] for r in rows]), key=repr)
    assert substrings.dedup_substrings(none).count() == 0
    assert any(r[2] for r in found)


def test_anchors_depend_on_the_window_alone():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 40, 90)
    shared[30:50] = 7  # a run
    a = np.concatenate([rng.integers(0, 40, 200), shared, rng.integers(0, 40, 77)]).astype(np.uint64)
    b = np.concatenate([rng.integers(0, 40, 13), shared]).astype(np.uint64)
    x, y = (substrings.Windows([len(w)], common.mix64(w)) for w in (a, b))
    n = 90 - substrings.WINDOW + 1
    assert (x.hash[200 : 200 + n] == y.hash[13 : 13 + n]).all() and (x.anchor[200 : 200 + n] == y.anchor[13 : 13 + n]).all()


def test_names_are_of_the_whole_corpus(spark):
    """Spark's rounds name the windows two texts share alike, and leave what is in one text only."""
    shared = [f"s{i}" for i in range(55)] + ["again"] * 5 + [f"t{i}" for i in range(15)]
    rows = [(7, [f"a{i}" for i in range(90)] + shared), (3, shared + [f"b{i}" for i in range(60)]), (5, [f"c{i}" for i in range(120)]), (9, ["few", "words"])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    first = substrings._first_texts(substrings._profile(df).where("size(starts) > 0"))
    state = substrings.name_globally(common.materialize(first.select(F.monotonically_increasing_id().alias("row"), *first.columns), "state"))
    anchors = {r["doc_id"]: {s + i: a for a, s, n in zip(r["anchors"], r["starts"], r["sizes"], strict=True) for i in range(n)} for r in state.collect()}
    n = len(shared) - substrings.WINDOW + 1
    assert set(anchors) == {7, 3}
    assert [anchors[7][90 + i] for i in range(n)] == [anchors[3][i] for i in range(n)]
    assert not any(p < 40 for p in anchors[7]) and len(set(anchors[3].values())) < n


def test_kept_text(spark):
    long = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, long), (2, f"before {long} after"), (3, long), (None, long)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in substrings.dedup_substrings(df, keep_text=True).collect()}
    assert found[2]["kept_text"] == "before after" and found[3]["kept_text"] == "" and found[1]["n_removed"] == 0 and found[None]["n_removed"] == 0


def test_lines(docs, rows, none):
    found = collected(lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("s")), "doc_id", "n_lines", "n_removed", "s")
    assert found == sorted(lines.brute_force([r[:2] for r in rows]), key=repr)
    assert lines.dedup_lines(none).count() == 0


def test_line_edits(spark):
    base = "one two three four five six seven eight nine"
    rows = [(1, base), (2, base.replace("five", "5")), (3, base.replace("five ", "")), (4, base + " ten"), (5, base.replace("five six", "six five")), (6, "a b"), (7, "a c"), (8, None), (9, "")]
    found = {r["doc_id"]: r for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))).collect()}
    assert {i for i in found if found[i]["n_removed"]} == {2, 3, 4, 5}  # 5 is 3 and a word
    assert found[8]["text"] is None and found[9]["text"] == "" and found[2]["text"] == ""


def test_decontamination(spark, docs, rows, none, monkeypatch):
    texts = [t for _, t, *_ in rows if t]
    items = [(1, " ".join(texts[0].split()[:25])), (2, "w1 w2 w3 w4"), (3, "one"), (4, None), (5, "!!"), (1, "the | w5"), (None, " ".join(texts[4 if len(texts) > 4 else 0].split()[:12]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(decontamination.brute_force([r[:2] for r in rows], items), key=repr)
    for bits in (decontamination.BITS, 8):  # a bitmap that leaves most out, and one that is full
        monkeypatch.setattr(decontamination, "BITS", bits)
        found = decontamination.decontaminate(docs.withColumn("items", F.lit("clash")).withColumn("text_key", F.lit("clash")), bench)
        assert {r["text_key"] for r in found.select("text_key").collect()} == {"clash"}
        shown = found.select("doc_id", "n_words", F.size("hit_words").alias("n_hit"), F.size("items").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("sha"), (F.size("hit_words") > 0).alias("c"))
        assert collected(shown, "doc_id", "n_words", "n_hit", "n_items", "sha", "c") == expected
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where(F.size("hit_words") > 0).count() == 0


def test_sharding(docs, rows, none, tmp_path):
    found = sharding.external_shuffle(docs.withColumn("slot", F.lit("clash")), shards=7, bucket_bytes=2000).collect()
    assert sorted(r["doc_id"] for r in found) == sorted(r[0] for r in rows)
    sizes = [sorted(r["slot"] for r in found if r["shard"] == s) for s in range(7)]
    assert all(x == list(range(len(x))) for x in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert [(r["shard"], r["slot"]) for r in sorted(found, key=lambda r: r["doc_id"])] != sorted((r["shard"], r["slot"]) for r in found)
    assert sharding.external_shuffle(none).count() == 0


def _pieces_are_whole(pieces, texts, tokenizer):
    ids = {k: np.array(tokenizer.encode(v or "", add_special_tokens=False).ids + [2], "<u4") for k, v in texts.items()}
    at, filled = dict.fromkeys(ids, 0), {}
    for p in sorted(pieces, key=lambda p: (p["doc_id"], p["start"])):
        own = ids[p["doc_id"]]
        assert p["start"] == at[p["doc_id"]] and p["doc_tokens"] == len(own)
        assert bytes(p["ids"]) == own[p["start"] : p["start"] + p["length"]].tobytes()
        at[p["doc_id"]] += p["length"]
        filled.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    assert all(at[k] == len(ids[k]) for k in ids)
    ends = {}
    for s, parts in filled.items():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        ends[s] = end
    return ends


def test_packing(docs, rows, none):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = {r[0]: r[1] for r in rows}
    for length in (4096, 64):
        pieces = packing.pack(docs, path, length=length).collect()
        ends = _pieces_are_whole(pieces, texts, tokenizer)
        assert all(e == length or e & (e - 1) == 0 for e in ends.values()) and sorted(ends) == list(range(len(ends)))
    shares = {}
    for p in pieces:
        shares[p["sequence_id"], p["queue"]] = shares.get((p["sequence_id"], p["queue"]), 0) + p["length"]
    total = {q: sum(v for (_, x), v in shares.items() if x == q) for q in {k[1] for k in shares}}
    for q, t in total.items():  # every full window of the first rounds is near the target
        assert abs(shares.get((0, q), 0) - 64 * t / sum(total.values())) <= 2
    assert packing.pack(none, path).count() == 0


def test_packing_targets():
    totals = np.array([100_000, 30_000, 500])
    phases = packing.schedule(totals, np.array([0.25, 0.25, 0.5]))
    assert (sum(p.rounds * p.per_round for p in phases) == totals).all()
    first = phases[0]
    assert abs(first.quota[1] - np.array([1024, 1024, 2048])).max() <= 1 or first.per_round[2] == 500


def test_packing_keeps_a_queue_for_each_of_many_sources(spark):
    P = pytest.importorskip("public_tokenizers")

    docs = spark.range(280).selectExpr("id as doc_id", "repeat('alpha beta gamma ', 40) as text", "concat('s', id % 70) as source")
    targets = {"s0": 0.5, **{f"s{i}": 0.5 / 69 for i in range(1, 70)}}
    pieces = packing.pack(docs, P.path("word_bpe_49k.json"), targets, length=512).collect()
    assert {p["queue"] for p in pieces} == set(targets)
    first = {q: sum(p["length"] for p in pieces if p["queue"] == q and p["sequence_id"] == 0) for q in targets}
    total = sum(p["doc_tokens"] for p in pieces if p["start"] == 0 and p["queue"] == "s0")
    windows = min(64, sum(p["length"] for p in pieces) // 512)
    assert abs(first["s0"] - min(256, total / windows)) <= 1
    assert sum(first.values()) == 512 and min(first.values()) > 0
    taken = {}
    for p in pieces:
        taken.setdefault(p["sequence_id"], []).append((p["offset"], p["offset"] + p["length"]))
    for spans in taken.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sum(p["length"] for p in pieces) == sum(p["doc_tokens"] for p in pieces if p["start"] == 0)


def test_deficits_end_at_zero():
    rng = np.random.default_rng(0)
    for _ in range(50):
        share = packing.apportion(64 * 4096, rng.random(9) ** 4, np.full(9, 10**9))
        sent = packing.deficit_round(share, 64, 4096)
        assert (sent.sum(axis=1) == 4096).all() and (sent >= 0).all() and (sent.sum(axis=0) == share).all()
        assert (abs(np.cumsum(sent, axis=0) - np.arange(1, 65)[:, None] * share / 64) < 1).all()


def test_remembered_tokens_are_the_tokenizers():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tokenizer, encode = Tokenizer.from_file(path), tokens.Encoder(path)
    rng = random.Random(3)
    alphabet = "abcXYZ .,!?'’\n\t\r éÄßİ́ſﬁ½0123中文😀<|>-_ \x0b"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)] + ["a<|endoftext|>b", "A <|ENDOFTEXT|> x", "don't. we'll,", "é é. ́x"]
    for t in texts:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_warc(spark, tmp_path):
    rows = [(3, "http://a/ä\r\nX: y", "<p>é</p>", "x"), (1, None, "<p>é</p>", "x"), (2, "http://b", None, "x"), (5, "http://c", "", "x"), (4, "http://d", "big " * 50_000, "x"), (None, "u", "<p>é</p>", "x"), (1, None, "<p>é</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    path = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(pages, path, archive_bytes=600)
    found = warc.read_archives(manifest, path).collect()
    assert len(found) == 7 and manifest.count() > 1
    by = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found}
    assert by == {(1, "response", None, 9), (3, "revisit", 1, 9), (None, "revisit", 1, 9), (2, "response", None, 0), (5, "revisit", 2, 0), (4, "response", None, 200_000)}
    assert {bytes(r["payload"]).decode() for r in found if r["page_id"] == 4} == {"big " * 50_000}
    assert warc.read_archives(warc.write_archives(pages.limit(0), path), path).count() == 0


def test_warc_reader_verifies(tmp_path):
    good = warc.compress(warc.make_record(1, "u", b"x" * 100_000, None))
    import io

    assert [h["x-page-id"] for h, _ in warc.RecordStream(io.BytesIO(good * 3))] == ["1"] * 3
    raw = zlib.decompress(good, 31)
    for broken in (good[:-20], warc.compress(raw.replace(b"xxx", b"xyx", 1)), warc.compress(raw[:-4]), warc.compress(raw + raw)):
        with pytest.raises(ValueError):
            list(warc.RecordStream(io.BytesIO(broken)))


def test_warc_oracle(spark):
    rows = [(i, f"u{i}", f"<p>{i % 7}</p>") for i in range(40)] + [(99, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    c = duckdb.connect()
    c.execute("create table pages (page_id bigint, url varchar, html varchar)")
    c.executemany("insert into pages values (?, ?, ?)", rows)
    path = common.scratch_path(spark, "warc")
    found = warc.read_archives(warc.write_archives(pages, path), path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(tuple(r) for r in found.collect()) == sorted(c.execute(warc.ORACLE).fetchall())


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[i % 12] + rng.normal(size=16) * 0.5).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(60)] + [(3000, None), (3100, [0.0] * 16), (3200, [float("nan")] * 16), (3300, [1.0] * 15), (3400, [None] + [1.0] * 15), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [tuple(r) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect()]
    good = [(i, v) for i, v in rows if i is not None and i not in (3300,)]
    truth = neighbours.brute_force(good)
    score = {(q, v): s for q, _, v, s in truth}
    hits = [r for r in found if (r[0], r[2]) in score]
    assert len(found) == len(truth) and len(hits) / len(truth) >= 0.9
    assert all(score[r[0], r[2]] == r[3] for r in hits)
    copies = [r[2] for r in sorted(found) if r[0] == 2000]
    assert copies == [0, *range(2001, 2010)]
    few = neighbours.search(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 100 == 0)
    assert few.count() == 2 and neighbours.search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_language(spark):
    rng = random.Random(0)
    syllables = {"en": ["the", "ing", "tion", "and"], "de": ["der", "schen", "ung", "über"], "fr": ["eau", "que", "ment", "été"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[lang], k=2)) for _ in range(30)), lang) for i in range(300) for lang in [rng.choice([*syllables])]]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    found = {r["doc_id"]: r for r in language.predict(df.withColumn("score", F.lit("clash")), model).withColumn("h", language.held_out(F.col("doc_id"))).collect()}
    held = [r for r in found.values() if r["h"] and r["doc_id"] < 1000]
    assert len(held) > 30 and sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)
    assert found[1000]["lang_pred"] == found[1001]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in found.values())
    assert found[5]["h"] == (zlib.crc32(b"5") % 5 == 0)
    empty = language.train(df.limit(0))
    assert {r["lang_pred"] for r in language.predict(df, empty).collect()} == {"und"}


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(2)
    examples, labels = [], []
    for _ in range(600):
        y = int(rng.random() < 0.5)
        at = np.unique(np.concatenate([[y], rng.integers(10, 200, 8)]))
        examples.append((at, np.ones(len(at))))
        labels.append(y)
    model = linear.FtrlProximal(200, 2, l1=2.0).fit(examples, labels, 2)
    w = model.weights()
    assert (w[10:200] == 0).mean() > 0.5 and w[0, 0] > 0 > w[0, 1]
    logits = np.array([[4.0, 0.0]] * 10)
    assert linear.temperature(logits, np.array([0] * 6 + [1] * 4)) > 5


def test_quality(spark, rows):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choices([f"v{i}" for i in range(400)], k=60))
    kinds = {0: good, 1: lambda: good().upper() + "!!! " * 20, 2: lambda: good() + " idiot " + good()}
    docs = [(i, kinds[i % 3 if i % 4 else 0](), "en" if i % 2 else None, f"s{i % 5}" if i % 11 else None, 0) for i in range(600)]
    kind = {i: (i % 3 if i % 4 else 0) for i in range(600)}
    labels = [(i, int(kind[i] != 1), int(kind[i] == 2)) for i in range(400)] + [(401, None, 1), (None, 0, 0), (2, 1, 1), (9999, 0, 1)]
    df = spark.createDataFrame([*docs, (700, None, None, None, 0), (701, "", "en", "s0", 0)], DOCS).withColumn("keep", F.lit("clash"))
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.classify(quality.sited(df), given).collect()}
    assert len(found) == 602
    wrong = [i for i in range(400, 600) if found[i]["keep"] != (kind[i] == 0)]
    assert len(wrong) <= 4
    assert all(r["keep"] for r in quality.classify(quality.sited(df), given.limit(0)).collect())
    assert quality.classify(quality.sited(df.limit(0)), given).count() == 0


def test_site_priors_shrink(spark):
    scored = spark.createDataFrame([("a", "x", 0.9, 0.0, 0.9, 0.0)] * 50 + [("b", "x", 0.1, 0.0, 0.1, 0.0)] * 50 + [("c", "x", 0.9, 0.0, 0.9, 0.0)], "host string, path string, llr_low_quality double, llr_toxic double, p_low_quality double, p_toxic double")
    scored = scored.withColumn("llr_low_quality", F.lit(0.0))
    sites, priors = quality.site_rates(scored)
    found = {r["host"]: r["low_quality"] for r in quality.with_posteriors(scored, sites, priors).collect()}
    assert found["a"] > found["c"] > found["b"]  # one document says little of its host


def test_prefilter_keeps_all(spark):
    df, ids = spark.range(5000).withColumnRenamed("id", "k"), spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    assert common.prefilter(df, ids, "k").join(ids, "k").count() == ids.count()
    assert common.without(df, ids, "k").count() == 5000 - ids.count()
    assert common.without(df, ids.limit(0), "k").count() == 5000


def test_hash_of_ngrams():
    words = np.arange(10, dtype=np.uint64)
    assert len(common.ngram_hashes(words, 5)) == 6 and len(common.ngram_hashes(words[:3], 5)) == 1 and len(common.ngram_hashes(words[:0], 5)) == 0


def test_digest():
    assert warc.digest(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ" and hashlib.sha1(b"").hexdigest().startswith("da39")


def test_rows_of_one_id_spread_over_buckets(spark):
    rows = spark.range(3000).selectExpr("case when id % 3 = 0 then id when id % 3 = 1 then 7 end as doc_id", "concat('text ', id) as text")
    starts, total = sharding.bucket_starts(sharding.scattered(rows, seed=17, bucket_bytes=3000))
    at = sorted(r["start"] for r in starts.collect()) + [total]
    assert total == 3000 and len(at) > 10 and max(b - a for a, b in zip(at, at[1:], strict=False)) < 3 * 3000 / (len(at) - 1)
    found = sharding.external_shuffle(rows, shards=4, bucket_bytes=3000).select("text", "shard", "slot").collect()
    assert len({r["text"] for r in found}) == len(found) == 3000 and len({(r["shard"], r["slot"]) for r in found}) == 3000


def test_equal_rows_spread_over_buckets(spark):
    rows = spark.range(3000).selectExpr("case when id % 2 = 0 then id end as doc_id", "case when id % 2 = 0 then concat('text ', id) else '' end as text")
    starts, total = sharding.bucket_starts(sharding.scattered(rows, seed=17, bucket_bytes=3000))
    at = sorted(r["start"] for r in starts.collect()) + [total]
    assert max(b - a for a, b in zip(at, at[1:], strict=False)) < 4 * 3000 / (len(at) - 1)  # half of the rows are equal
    found = sharding.external_shuffle(rows, shards=3, bucket_bytes=3000).select("doc_id", "shard", "slot").collect()
    assert len({(r["shard"], r["slot"]) for r in found}) == 3000 and sum(r["doc_id"] is None for r in found) == 1500


def test_sharding_does_not_depend_on_the_order_of_rows(spark, monkeypatch):
    rows = [(i % 5, f"text {i}", i) for i in range(200)]  # few ids, many texts
    one = spark.createDataFrame(rows, "doc_id long, text string, place long").repartition(3)
    other = spark.createDataFrame(rows[::-1], "doc_id long, text string, place long").repartition(2)
    monkeypatch.setattr(sharding, "RANGE", 2)
    run = lambda d: collected(sharding.external_shuffle(d, shards=3, bucket_bytes=600), "place", "shard", "slot")
    assert run(one) == run(other)


CLASHES = ["_id", "_word", "_bits", "_maybe", "n_host", "n_path", "host_toxic", "keep", "host", "path", "n_lines", "items", "carried", "text_key", "text_id", "spots", "bucket", "place", "shard", "queue", "score", "kept"]


@pytest.fixture(scope="module")
def clashing(docs):
    """Every name that an operator uses as a column of the caller's."""
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def _same(found, results):
    kept = [c for c in CLASHES if c not in results and c in found.columns]
    assert set(CLASHES) - set(results) <= set(found.columns)
    assert {tuple(r) for r in found.select(*kept).distinct().collect()} == {tuple(f"own {c}" for c in kept)}


def test_columns_of_the_caller_stay(spark, clashing):
    bench = spark.createDataFrame([(1, "w1 w2 w3")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1)], "doc_id long, quality int, toxic int")
    _same(lines.dedup_lines(clashing), ["n_lines", "n_removed"])
    _same(decontamination.decontaminate(clashing, bench), ["n_words", "hit_words", "items"])
    _same(quality.classify(clashing, labels), ["keep", *quality.HEADS])
    _same(sharding.external_shuffle(clashing, shards=2), ["shard", "slot"])
    _same(language.predict(clashing, language.train(clashing)), ["lang_pred", "score"])
    assert minhash.near_duplicates(clashing).count() == clashing.count() == substrings.dedup_substrings(clashing).count()
    assert packing.pack(clashing, pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")).count() >= clashing.count()
    common.prefilter(clashing, clashing.select("doc_id"), "doc_id").count()


def test_samples_are_the_smallest_hashes(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"))
    all_of = common.sampled(rows, 5000, 5000, 1, "k")
    assert common.sampled(rows, 100, 5000, 1, "k") == all_of[:100] and len(set(all_of)) == 5000
    assert common.sampled(rows, 10, 10**15, 1, "k") == all_of[:10]  # below the bound there are too few: all are looked at
    same = rows.select(F.lit(3).alias("k"))
    assert len(common.sampled(same, 100, 5000, 1, "k")) == 100


def test_a_language_is_sampled_however_large(spark, monkeypatch):
    """The share of a sample of 10^12 rows isn't 0."""
    learnable = spark.createDataFrame([(i, f"t{i}", "en") for i in range(50)], "doc_id long, text string, lang string")
    few = language._sample(learnable, {"en": 50}, 7, False)
    assert few.count() == 7 and [r["text"] for r in few.orderBy("place").collect()] == [r["text"] for r in language._sample(learnable, {"en": 50}, 50, True).orderBy("place").limit(7).collect()]


def test_language_model_does_not_depend_on_how_rows_are_dealt(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["der", "und", "nicht"] if i % 2 else ["the", "and", "not"], k=8)), "de" if i % 2 else "en") for i in range(80)]
    models = [language.train(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(n)) for r, n in ((rows, 3), (rows[::-1], 2))]
    assert (models[0].weights == models[1].weights).all() and models[0].temperature == models[1].temperature


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 4)
    monkeypatch.setattr(common, "FEW", 1)
    rows = spark.range(400).selectExpr("case when id < 200 then 1 when id < 390 then id end as k", "id")
    counted = rows.where("k is not null and k % 2 = 1").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    for how in ("inner", "left"):
        assert collected(common.join_counted(rows, counted, ["k"], how=how), "k", "id", "low") == collected(rows.join(counted.drop("n"), ["k"], how), "k", "id", "low")


def test_spans_are_verified_on_words(spark):
    """A span whose words differ, as after a collision of hashes, is not removed."""
    words = [f"w{i}" for i in range(60)]
    key = substrings._text_key([w.encode() for w in words])
    spans = [{"start": 0, "windows": 1, "words": " ".join(words[:50]).encode()}, {"start": 5, "windows": 1, "words": " ".join(words[:50]).encode()}]
    df = spark.createDataFrame([(1, " ".join(words), key, spans)], "doc_id long, text string, text_key binary, spans array<struct<start int, windows int, words binary>>")
    assert substrings._removed(df).first()["n_removed"] == 50


def test_decontamination_of_repetitive_and_long_texts(spark):
    rows = [(1, "a " * 3000), (2, "b a a a a a a a a a a c"), (3, "x " * 50_000), (None, "a " * 12), (4, "a " * 3000)]
    items = [(1, "a " * 40), (2, "q r s t u v w x y z a b"), (3, "c")]
    found = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    shown = found.select("doc_id", "n_words", F.size("hit_words").alias("n_hit"), F.array_join("items", ",").alias("i"))
    assert collected(shown, "doc_id", "n_words", "n_hit", "i") == sorted([(1, 3000, 3000, "1"), (2, 12, 11, "1,3"), (3, 50_000, 0, ""), (None, 12, 12, "1"), (4, 3000, 3000, "1")], key=repr)
