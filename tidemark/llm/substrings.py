"""Substring dedup by recompression.

A text starts as the names of its words. Rounds rename it: a round of runs turns a run of one symbol into a
symbol for (symbol, length), a round of pairs splits the symbols in two halves by a coin of their names and
turns each left symbol with a right one behind it into a symbol for the pair. What becomes of a symbol depends on
itself and at most one neighbour on each side, so each symbol knows the stretch of words that determines it; wherever
that stretch occurs, so does the symbol. Texts shrink by about a quarter each round.

In the first `LOCAL_ROUNDS` rounds a name is the hash of what it stands for, so tasks name alike with no table between
them. Each later round is a round of Spark's: the symbols and pairs of all texts are grouped, those of two texts or
more get a name of their own, the table of names is written, and joined back to the texts. What has no name is in one
text only; windows that hold it are in no other text and are left, as are symbols that are in no window any more. So
rounds get small where little is repeated.

The anchor of a window (50 words) is the leftmost symbol, of the latest round that has one, whose stretch lies
in the window; it depends on the window's words alone, so equal windows have equal anchors, one for about a
dozen windows. Anchors are counted over the corpus; only windows with an anchor of two or more documents go on.
Neighbouring windows with one anchor are a run: a run that a smaller document has whole is settled at once, and
the first of its kind is compared window by window, by anchor and window hash (128 bits), with what other
runs of its anchor hold. What agrees by hash is then verified on the words: those of the smaller document are laid
beside the other's, and only where all are equal are they removed. Symbols, anchors, runs and windows that very many
documents share are hot keys, whose few rows of the smaller side are broadcast.

Exact copies are settled before that by the SHA-256 of their words: they lose all words if they fill a window.

Defined cases: a null text has no words; a text with fewer words than a window loses none; a row without id is
neither compared nor changed; rows with equal ids are compared with smaller ids only; a very long text is renamed
whole, by one task in memory of some 100 bytes a word; an empty table gives an empty result; columns other than the
id and the text aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, WordHasher, bounded, drop_table, join_counted, materialize, mix64, prefilter, split_by, table, utf8

WINDOW = 50
#: Rounds that name by hash, each within its task; a window without a symbol of the last one is its own anchor.
LOCAL_ROUNDS = 6
#: Rounds that name by a table, in this order.
SPARK_ROUNDS = ("runs", "pairs", "pairs", "pairs", "pairs", "pairs", "pairs")
BATCH_WORDS = 150_000
STATE = "row long, doc_id long, text_key binary, n_words int, sym array<long>, lo array<int>, hi array<int>, anchors array<long>, starts array<int>, sizes array<int>"


def name_runs(sym, lo, hi, doc, first, last):
    """One round of runs. lo, hi: the stretch that determines a symbol; first, last: the document's bounds."""
    if not len(sym):
        return sym, lo, hi, doc
    change = np.ones(len(sym), dtype=bool)
    change[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(change)
    length = np.diff(np.append(at, len(sym))).astype(np.uint64)
    d, before, after = doc[at], at - 1, np.append(at[1:], len(sym) - 1)
    new_lo = np.where((before >= 0) & (doc[before] == d), lo[before], first[d] - 1)  # the start of a text is in no window
    new_hi = np.where((np.append(at[1:], len(sym)) < len(sym)) & (doc[after] == d), hi[after], last[d] + 1)
    return np.where(length > 1, mix64(sym[at] * BASE + length), sym[at]), new_lo, new_hi, d


def name_pairs(sym, lo, hi, doc, first, last, number: int):
    """One round of pairs."""
    if len(sym) < 2:
        return sym, lo, hi, doc
    salt = mix64(np.array([number + 1], dtype=np.uint64))[0]
    right = (mix64(sym ^ salt) >> np.uint64(63)).astype(bool)
    follows = doc[1:] == doc[:-1]
    pair = np.zeros(len(sym) + 1, dtype=bool)
    pair[:-2] = ~right[:-1] & right[1:] & follows
    at = np.flatnonzero(~np.concatenate([[False], pair[:-2]]))
    after, before = np.minimum(at + 1, len(sym) - 1), np.maximum(at - 1, 0)
    has_next = np.append(follows, False)[at]
    has_last = np.concatenate([[False], follows])[at]
    paired, r, d = pair[at], right[at], doc[at]
    name = np.where(paired, mix64(sym[at] * BASE + sym[after] + salt), sym[at])
    new_lo = np.where(r, np.where(has_last, lo[before], first[d] - 1), lo[at])
    new_hi = np.where(r, hi[at], np.where(has_next, hi[after], last[d] + 1))
    return name, new_lo, new_hi, d


def window_hashes(words: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Of each window of the words' hashes, a hash of its own."""
    if len(words) < window:
        return np.empty(0, dtype=np.uint64)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words) - 1, BASE)]))
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(words) - window, inverse)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power, dtype=np.uint64)])
    return mix64((sums[window:] - sums[:-window]) * back)


class Windows:
    """The windows of some documents at once: their hashes, the anchor of each, and the symbols after `LOCAL_ROUNDS`."""

    def __init__(self, sizes: list[int], words: np.ndarray, window: int = WINDOW):
        self.window, self.last = window, np.cumsum(sizes)
        self.first = self.last - np.asarray(sizes)
        n = len(words)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.hash = window_hashes(words, window)
        self.anchor = mix64(self.hash + BASE)
        sym, lo, hi = words, np.arange(n), np.arange(1, n + 1)
        for number in range(LOCAL_ROUNDS):
            if number == 0:
                sym, lo, hi, doc = name_runs(sym, lo, hi, doc, self.first, self.last)
            sym, lo, hi, doc = name_pairs(sym, lo, hi, doc, self.first, self.last, number)
        at, inside = first_inside(lo, hi, np.arange(len(self.hash)), window)
        self.anchor[inside] = mix64(sym[at[inside]])
        self.sym, self.lo, self.hi, self.doc = sym, lo, hi, doc

    def of(self, i: int) -> slice:
        """Positions of the windows of document i."""
        return slice(self.first[i], max(self.first[i], self.last[i] - self.window + 1))


def first_inside(lo: np.ndarray, hi: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For each window the first symbol that begins in it, and whether that one's stretch ends in it too."""
    at = np.searchsorted(lo, starts, "left")
    inside = at < len(lo)
    if len(lo):
        at = np.minimum(at, len(lo) - 1)
        inside &= hi[at] <= starts + window
    return at, inside


def run_lengths(row: np.ndarray, starts: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of neighbouring windows with one anchor begin, and how many windows each has."""
    if not len(starts):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    cuts = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (row[1:] != row[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    return cuts, np.diff(np.append(cuts, len(starts)))


# ---- rounds of Spark's ------------------------------------------------------------------------
#
# A state is, of each text, its symbols with their stretches, and the runs of windows that may yet be repeated. Symbol 0
# is a barrier: the edge of a text, or where nothing that is left to find passes through.


def grouped(sym, lo, hi, kind: str, salt: int):
    """What this round names: `(left, right, lo, hi, at)`; right is 0 for a symbol that stays alone, left for a barrier."""
    if kind == "runs":
        at = np.flatnonzero(np.concatenate([[True], (sym[1:] != sym[:-1]) | (sym[1:] == 0)]))
        length = np.diff(np.append(at, len(sym)))
        wall = sym[at] == 0
        new_lo = np.where(wall, lo[at], lo[np.maximum(at - 1, 0)])
        new_hi = np.where(wall, hi[at], hi[np.minimum(at + length, len(sym) - 1)])
        return sym[at], np.where(length > 1, length, 0), new_lo, new_hi, at
    live = sym != 0
    coin = (mix64(sym.view(np.uint64) ^ mix64(np.array([salt], dtype=np.uint64))[0]) >> np.uint64(63)).astype(bool)
    is_right, is_left = live & coin, live & ~coin
    pair = np.append(is_left[:-1] & is_right[1:], False)
    at = np.flatnonzero(~np.concatenate([[False], pair[:-1]]))
    after, before = np.minimum(at + 1, len(sym) - 1), np.maximum(at - 1, 0)
    return sym[at], np.where(pair[at], sym[after], 0), np.where(is_right[at], lo[before], lo[at]), np.where(is_left[at], hi[after], hi[at]), at


def _loaded(batch):
    """The texts of a batch of states beside each other: symbols, stretches, the text of each symbol, and bases."""
    flat = lambda i: batch.column(i).flatten().to_numpy(zero_copy_only=False)
    names = batch.schema.names
    sym, lo, hi = (flat(names.index(c)) for c in ("sym", "lo", "hi"))
    sizes = batch.column(names.index("sym")).value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(batch.num_rows), sizes)
    extent = batch.column(names.index("n_words")).to_numpy(zero_copy_only=False).astype(np.int64) + WINDOW + 2
    base = np.cumsum(extent) - extent + 1
    return sym, lo + base[row], hi + base[row], row, base


def _grouped_of(state: DataFrame, kind: str, salt: int) -> DataFrame:
    """`(row, at, left, right)`: all that this round may name."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sym, lo, hi, row, _ = _loaded(batch)
            left, right, _, _, at = grouped(sym, lo, hi, kind, salt)
            mine = row[at]
            place = np.arange(len(at)) - np.searchsorted(mine, np.arange(batch.num_rows))[mine]
            live = left != 0
            columns = [batch.column(0).take(pa.array(mine[live])), pa.array(place[live].astype(np.int32)), pa.array(left[live]), pa.array(right[live].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "at", "left", "right"])

    return state.select("row", "n_words", "sym", "lo", "hi").mapInArrow(run, "row long, at int, left long, right long")


def _renamed(state: DataFrame, kind: str, salt: int) -> DataFrame:
    """Of a state and `told`, the names of each text: the state after this round."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sym, lo, hi, row, base = _loaded(batch)
            left, _, lo, hi, at = grouped(sym, lo, hi, kind, salt)
            row = row[at]
            names = np.zeros(len(at), dtype=np.int64)
            told = batch.column(batch.schema.names.index("told"))
            each = told.flatten()
            owner = np.repeat(np.arange(batch.num_rows), told.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            names[np.searchsorted(row, owner) + each.field(0).to_numpy(zero_copy_only=False)] = each.field(1).to_numpy(zero_copy_only=False)

            sizes = batch.column(9).flatten().to_numpy(zero_copy_only=False)
            run_row = np.repeat(np.arange(batch.num_rows), batch.column(9).value_lengths().to_numpy(zero_copy_only=False))
            run_start = batch.column(8).flatten().to_numpy(zero_copy_only=False) + base[run_row]
            starts = np.repeat(run_start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            anchors, window_row = np.repeat(batch.column(7).flatten().to_numpy(zero_copy_only=False), sizes), np.repeat(run_row, sizes)
            alone = (left != 0) & (names == 0)
            open_ = ~first_inside(lo[alone], hi[alone], starts)[1]
            starts, anchors, window_row = starts[open_], anchors[open_], window_row[open_]
            named = names != 0
            where, inside = first_inside(lo[named], hi[named], starts)
            anchors[inside] = names[named][where[inside]]

            names[np.searchsorted(starts, lo, "right") <= np.searchsorted(starts, hi - WINDOW, "left")] = 0  # in no window
            keep = np.concatenate([[True], (names[1:] != 0) | (names[:-1] != 0) | (row[1:] != row[:-1])])
            names, lo, hi, row = names[keep], lo[keep] - base[row[keep]], hi[keep] - base[row[keep]], row[keep]
            cuts, lengths = run_lengths(window_row, starts, anchors)
            every = np.arange(batch.num_rows + 1)
            by_symbol, by_run = (pa.array(np.searchsorted(r, every).astype(np.int32)) for r in (row, window_row[cuts]))
            out = pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:4],
                    pa.ListArray.from_arrays(by_symbol, pa.array(names)),
                    pa.ListArray.from_arrays(by_symbol, pa.array(lo.astype(np.int32))),
                    pa.ListArray.from_arrays(by_symbol, pa.array(hi.astype(np.int32))),
                    pa.ListArray.from_arrays(by_run, pa.array(anchors[cuts])),
                    pa.ListArray.from_arrays(by_run, pa.array((starts[cuts] - base[window_row[cuts]]).astype(np.int32))),
                    pa.ListArray.from_arrays(by_run, pa.array(lengths.astype(np.int32))),
                ],
                names=batch.schema.names[:10],
            )
            yield out.filter(pa.array(np.diff(np.searchsorted(window_row, every)) > 0))

    columns = [c.split()[0] for c in STATE.split(", ")]
    return state.select(*columns, "told").mapInArrow(run, STATE)


def name_globally(state: DataFrame) -> DataFrame:
    """The state after `SPARK_ROUNDS`: each names, in a table of the whole corpus, what two texts or more have."""
    for number, kind in enumerate(SPARK_ROUNDS):
        groups = _grouped_of(state, kind, number + LOCAL_ROUNDS + 1)
        shared = groups.groupBy("left", "right").agg(F.min("row").alias("low"), F.max("row").alias("high"), F.count("*").alias("n")).where("low < high")
        name = F.monotonically_increasing_id() * 16 + (number + 1)  # no two rounds give one name twice
        names = materialize(shared.select("left", "right", "n", name.alias("name")), "names")
        told = join_counted(groups, names, ["left", "right"], hashed=True).groupBy("row").agg(F.collect_list(F.struct("at", "name")).alias("told"))
        old, state = state, materialize(_renamed(state.join(told, "row", "left"), kind, number + LOCAL_ROUNDS + 1), "state")
        drop_table(old)
        drop_table(names)
    return state


def words_of(text: bytes | None) -> list[bytes]:
    return text.split() if text else []  # of bytes: white space is \x09-\x0D and \x20


def _batched(batches, text_at: int) -> Iterator[tuple]:
    """(rows, words of each text, the hashes of all words)."""
    hasher = WordHasher()
    for batch in batches:
        start, size, words = 0, 0, []
        for i, text in enumerate(utf8(batch.column(text_at))):
            words.append(words_of(text))
            size += len(words[-1])
            if size >= BATCH_WORDS or i + 1 == batch.num_rows:
                yield batch.slice(start, i + 1 - start), words, hasher([w for ws in words for w in ws])
                start, size, words = i + 1, 0, []


def _text_key(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def _profile(docs: DataFrame) -> DataFrame:
    """`(doc_id, n_words, text_key, words_sha)` of every row, and its state after `LOCAL_ROUNDS`."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "text_key", "words_sha", "sym", "lo", "hi", "anchors", "starts", "sizes"]
        for rows, words, flat in _batched(batches, 1):
            windows = Windows([len(w) for w in words], flat)
            every, first, last = np.arange(len(words)), windows.first, windows.last
            edges = np.stack([np.searchsorted(windows.doc, every), np.searchsorted(windows.doc, every, "right")], axis=1).ravel()
            walls = np.stack([np.full(len(words), -1), last - first], axis=1).ravel()
            doc = np.insert(windows.doc, edges, np.repeat(every, 2))
            sym = np.insert(windows.sym, edges, np.uint64(0))
            lo = np.insert(windows.lo - first[windows.doc], edges, walls)
            hi = np.insert(windows.hi - first[windows.doc], edges, walls + 1)
            spans = [windows.of(i) for i in every]
            at, owner = np.concatenate([np.arange(s.start, s.stop) for s in spans]), np.repeat(every, [s.stop - s.start for s in spans])
            anchor = windows.anchor[at]
            cuts, sizes = run_lengths(owner, at, anchor)
            by_symbol, by_run = (pa.array(np.searchsorted(d, np.arange(len(words) + 1)).astype(np.int32)) for d in (doc, owner[cuts]))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(w) for w in words], pa.int64()),
                    pa.array([_text_key(w) for w in words], pa.binary()),
                    pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words], pa.string()),
                    pa.ListArray.from_arrays(by_symbol, pa.array(sym.view(np.int64))),
                    pa.ListArray.from_arrays(by_symbol, pa.array(lo.astype(np.int32))),
                    pa.ListArray.from_arrays(by_symbol, pa.array(hi.astype(np.int32))),
                    pa.ListArray.from_arrays(by_run, pa.array(anchor[cuts].view(np.int64))),
                    pa.ListArray.from_arrays(by_run, pa.array((at[cuts] - first[owner[cuts]]).astype(np.int32))),
                    pa.ListArray.from_arrays(by_run, pa.array(sizes.astype(np.int32))),
                ],
                names=names,
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, text_key binary, words_sha string, " + STATE.split(", ", 4)[4])


def _runs(texts: DataFrame) -> DataFrame:
    """Of `(doc_id, text, text_key, spans)`: these runs of windows, with the hashes of the windows."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "kind", "doc_id", "text_key", "start", "windows", "hashes"]
        for rows, words, flat in _batched(batches, 1):
            keys = rows.column(2).to_pylist()
            right = np.array([_text_key(w) == k for w, k in zip(words, keys, strict=True)])  # two texts may have one id
            lists = rows.column(3)
            each = lists.flatten()
            owner = np.repeat(np.arange(len(words)), lists.value_lengths().to_numpy(zero_copy_only=False))
            good = right[owner]
            if not good.any():
                continue
            anchor, start, size = (each.field(i).to_numpy(zero_copy_only=False)[good] for i in range(3))
            owner = owner[good]
            last = np.cumsum([len(w) for w in words])
            base = last - [len(w) for w in words]
            first = np.cumsum(size) - size
            at = np.repeat(start + base[owner] - first, size) + np.arange(size.sum())
            hashes = window_hashes(flat)[at]
            place = (np.arange(len(at)) - np.repeat(first, size) + 1).astype(np.uint64)
            kind = np.add.reduceat(mix64(hashes ^ (place * BASE)), first)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor),
                    pa.array(kind.view(np.int64)),
                    rows.column(0).take(pa.array(owner)),
                    rows.column(2).take(pa.array(owner)),
                    pa.array(start.astype(np.int32)),
                    pa.array(size.astype(np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.append(first, len(at)).astype(np.int32)), pa.array(hashes.view(np.int64))),
                ],
                names=names,
            )

    return texts.mapInArrow(run, "anchor long, kind long, doc_id long, text_key binary, start int, windows int, hashes array<long>")


def _words_at(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of `(doc_id, text, text_key, spans)`: the words of each span, `(low_id, low_key, low_start, windows, words)`."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
        names = ["low_id", "low_key", "low_start", "windows", "words"]
        for batch in batches:
            for doc_id, text, key, spans in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = words_of(text)
                if _text_key(words) == key:
                    rows = [(doc_id, key, s["low_start"], s["windows"], b" ".join(words[s["low_start"] : s["low_start"] + s["windows"] - 1 + window])) for s in spans]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return texts.mapInArrow(run, "low_id long, low_key binary, low_start int, windows int, words binary")


def _removed(texts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of `(doc_id, text, text_key, spans)`: the result for rows with this key; spans whose words aren't there don't count."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], [], [], []]
            for doc_id, text, key, spans in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = words_of(text)
                if _text_key(words) != key:
                    continue
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                for s in spans:
                    end = s["start"] + s["windows"] - 1 + window
                    if b" ".join(words[s["start"] : end]) == s["words"]:
                        cover[s["start"]] += 1
                        cover[end] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                for column, value in zip(out, (doc_id, key, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns[:4], columns[4].cast(pa.string())], names=["doc_id", "text_key", "n_removed", "kept_sha256", "kept_text"])

    return texts.mapInArrow(run, "doc_id long, text_key binary, n_removed long, kept_sha256 string, kept_text string")


def repeated_spans(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """`(doc_id, text_key, start, windows, low_id, low_key, low_start)`: windows of a document that hash like windows of
    a smaller one, and where these are."""
    state = name_globally(_first_texts(profile.where("doc_id is not null and size(starts) > 0")))
    anchors = state.select("doc_id", "text_key", F.explode(F.arrays_zip("anchors", "starts", "sizes")).alias("r")).select("doc_id", "text_key", F.col("r.anchors").alias("anchor"), "r.starts", "r.sizes")
    shared = materialize(anchors.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("anchor", "n"), "shared")
    told = join_counted(prefilter(anchors, shared, "anchor"), shared, ["anchor"], hashed=True)
    wanted = materialize(told.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "starts", "sizes")).alias("spans")), "wanted")
    drop_table(shared)
    runs = materialize(_runs(prefilter(docs, wanted, "doc_id").join(wanted, "doc_id").select("doc_id", "text", "text_key", "spans")), "runs")
    drop_table(wanted)
    drop_table(state)

    spot = F.struct("doc_id", "text_key", "start")
    told = ["doc_id", "text_key", "start", "windows", F.col("low.doc_id").alias("low_id"), F.col("low.text_key").alias("low_key"), F.col("low.start").alias("low_start")]
    kinds = materialize(runs.groupBy("anchor", "kind").agg(F.min(spot).alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")), "kinds")
    whole = materialize(join_counted(runs.drop("hashes"), kinds.where("low.doc_id < high").drop("high"), ["anchor", "kind"]).where("low.doc_id < doc_id").select(*told), "spans")

    mixed = materialize(kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("n").alias("n")).where("kinds > 1").select("anchor", "n"), "mixed")
    firsts = join_counted(kinds.drop("high", "n"), mixed, ["anchor"]).select("anchor", "kind", F.col("low.doc_id").alias("doc_id"))
    novel = runs.join(firsts, ["anchor", "kind", "doc_id"])
    single = materialize(novel.select("anchor", "doc_id", "text_key", "start", F.posexplode("hashes").alias("at", "hash")).select("anchor", "hash", "doc_id", "text_key", (F.col("start") + F.col("at")).alias("start")), "windows")
    for t in (runs, kinds, mixed):
        drop_table(t)
    lowest = materialize(single.groupBy("anchor", "hash").agg(F.min(spot).alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low.doc_id < high").drop("high"), "lowest")
    alone = materialize(join_counted(single, lowest, ["anchor", "hash"]).where("low.doc_id < doc_id").withColumn("windows", F.lit(1)).select(*told), "spans")
    for t in (single, lowest):
        drop_table(t)
    return whole.union(alone)


def _first_texts(profile: DataFrame) -> DataFrame:
    """The state of each distinct text, under its smallest id; only copies are shuffled, and only their firsts written again."""
    columns = [c for c in (c.split()[0] for c in STATE.split(", ")) if c in profile.columns]
    others = [c for c in columns if c not in ("doc_id", "text_key")]
    profile = profile.withColumn("n_words", F.col("n_words").cast("int")).select(*columns)
    copies = materialize(profile.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1").select("text_key"), "copies")
    maybe, single = split_by(profile, copies, "text_key")
    firsts = maybe.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first(F.struct(*others)).alias("s")).select("doc_id", "text_key", "s.*")
    return single.unionByName(materialize(firsts.select(*columns), "state"))


def verifiable_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """`(doc_id, text_key, spans)`: starts and windows, with the words that are in the smaller document."""
    low = ["low_id", "low_key", "low_start", "windows"]
    counted = materialize(spans.groupBy(*low).agg(F.count("*").alias("n")), "low")
    wanted = materialize(counted.groupBy("low_id", "low_key").agg(F.collect_list(F.struct("low_start", "windows")).alias("spans")), "wanted")
    texts = prefilter(docs.withColumnRenamed("doc_id", "low_id"), wanted, "low_id").join(wanted, "low_id").select("low_id", "text", "low_key", "spans")
    words = materialize(_words_at(texts).dropDuplicates(low).join(counted, low), "words")
    told = join_counted(spans, words, low)
    return told.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "windows", "words")).alias("spans"))


def dedup_substrings(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Per document: `doc_id, n_words, n_removed, kept_sha256`, and the kept words with `keep_text`.

    `kept_text` is null where nothing is removed: the text is as it was.
    """
    bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = materialize(_profile(docs).withColumn("row", F.monotonically_increasing_id()), "profile")
    texts = materialize(profile.select("doc_id", "n_words", "text_key", "words_sha"), "texts")  # the profile goes after the first round
    known = docs.where("doc_id is not null")
    found = repeated_spans(known, profile)
    spans = materialize(verifiable_spans(known, found), "verifiable")
    drop_table(found)
    changed = _removed(prefilter(known, spans, "doc_id").join(spans, "doc_id").select("doc_id", "text", "text_key", "spans"))
    if not keep_text:
        changed = changed.drop("kept_text")
    changed = changed.dropDuplicates(["doc_id", "text_key"])
    low = texts.where("doc_id is not null").groupBy("words_sha").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")).where("n > 1")
    out = join_counted(texts, materialize(low, "copies"), ["words_sha"], how="left").join(changed, ["doc_id", "text_key"], "left")
    copy = (F.col("low") < F.col("doc_id")) & (F.col("n_words") >= WINDOW)
    columns = [
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "words_sha")).alias("kept_sha256"),
    ]
    if keep_text:
        columns.append(F.when(copy, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"))
    return out.select(*columns)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract restated window by window, for tests."""
    import re

    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    lowest: dict[tuple, int] = {}
    for d in sorted(words):
        for p in range(len(words[d]) - window + 1):
            lowest.setdefault(tuple(words[d][p : p + window]), d)
    out = []
    for d, w in words.items():
        gone = set()
        for p in range(len(w) - window + 1):
            if lowest[tuple(w[p : p + window])] < d:
                gone.update(range(p, p + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out
