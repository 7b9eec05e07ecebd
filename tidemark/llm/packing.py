"""Mixture-controlled packing by deficit round-robin over source queues.

The documents of a source, one after another, are its queue. Each window of 4096 tokens visits all queues: a
queue's deficit counter gains its target share of the window, the queue sends that many whole tokens, the few
tokens still free go to the largest deficits, and what a queue got too little (or too much) stays in its counter
for the next window. Documents are cut where a queue's turn ends.

Carrying counters from window to window would be one long sequence. Shares are therefore whole tokens over a
round of `ROUND` windows: as no counter ever strays by a whole token, all are exactly 0 after a round, and the
state at any window follows from its place in the round. So each task places its documents on its own, from
their position in their queue, and deficits carry over between partitions without a message. Positions are sums
over (queue, partition) totals. When queues run dry, a new phase shares the windows among the rest; the last
tokens, less than a window, fill sequences of falling powers of two, so no sequence has padding.

Each source has a queue of its own, however many there are. What all tasks share is the tokens of each queue in a
round of each phase; the turns within a round are worked out where they are needed, and the last ones are kept.

Defined cases: a null or empty text is its end token alone; a null source is the queue of the empty name; rows with
equal ids are separate documents; an empty table gives no pieces; other columns aren't read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .tokens import encoder

LENGTH, END = 4096, 2
ROUND = 64
#: Bytes of turns that a process keeps (those in use are kept in any case).
TURNS_KEPT = 64 << 20


@dataclass
class Phase:
    """`rounds` rounds of `windows` windows of `size` tokens with the same shares."""

    first_window: int
    first_token: np.ndarray
    rounds: int
    per_round: np.ndarray
    windows: int
    size: int

    def turns(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queues with a share in order, and for each [window of the round, queue] the tokens sent before it and the place in the window."""
        queues = np.flatnonzero(self.per_round)
        sent = deficit_round(self.per_round[queues].astype(np.int64), self.windows, self.size)
        quota = np.zeros((self.windows + 1, len(queues)), dtype=np.int32)
        np.cumsum(sent, axis=0, out=quota[1:])
        return queues, quota, (np.cumsum(sent, axis=1) - sent).astype(np.int32)

    @property
    def quota(self) -> np.ndarray:
        """[window of the round, queue]: tokens sent before it, of all queues."""
        queues, quota, _ = self.turns()
        out = np.zeros((self.windows + 1, len(self.per_round)), dtype=np.int64)
        out[:, queues] = quota
        return out


class Turns:
    """The turns of phases, worked out once as long as they are kept."""

    def __init__(self, most: int = TURNS_KEPT):
        self.most, self.bytes, self.kept = most, 0, OrderedDict()

    def of(self, p: Phase) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if p.first_window in self.kept:
            self.kept.move_to_end(p.first_window)
        else:
            self.kept[p.first_window] = found = p.turns()
            self.bytes += sum(x.nbytes for x in found)
            while self.bytes > self.most and len(self.kept) > 1:
                self.bytes -= sum(x.nbytes for x in self.kept.popitem(last=False)[1])
        return self.kept[p.first_window]


def deficit_round(per_round: np.ndarray, windows: int, length: int) -> np.ndarray:
    """[window, queue]: tokens that each queue sends in each window of a round; `per_round` sums to windows * length."""
    sent = np.zeros((windows, len(per_round)), dtype=np.int64)
    deficit = np.zeros(len(per_round), dtype=np.int64)  # in parts of 1 / windows of a token
    for w in range(windows):
        deficit += per_round
        turn = np.maximum(deficit // windows, 0)
        deficit -= turn * windows
        free = length - int(turn.sum())
        largest = np.lexsort((np.arange(len(deficit)), -deficit))[:free]
        turn[largest] += 1
        deficit[largest] -= windows
        sent[w] = turn
    assert not deficit.any()
    return sent


def apportion(total: int, weights: np.ndarray, most: np.ndarray) -> np.ndarray:
    """`total` whole tokens in proportion to `weights`, at most `most` each: largest remainders."""
    out = np.zeros(len(weights), dtype=np.int64)
    while (left := total - int(out.sum())) > 0:
        w = np.where(out < most, weights, 0.0)
        if not w.sum():
            w = (out < most).astype(float)
        exact = left * (w / w.sum())
        add = np.minimum(np.floor(exact).astype(np.int64), most - out)
        out += add
        left -= int(add.sum())
        if not add.any():
            rest = np.lexsort((np.arange(len(w)), -np.where(out < most, exact, -1.0)))[:left]
            out[rest] += (out < most)[rest]
    return out


def schedule(totals: np.ndarray, weights: np.ndarray, length: int = LENGTH) -> list[Phase]:
    """Phases that send all tokens of all queues, in shares as near to `weights` as what is left allows."""
    left, sent, window, phases = totals.astype(np.int64).copy(), np.zeros(len(totals), dtype=np.int64), 0, []
    while (total := int(left.sum())) > 0:
        size = length if total >= length else 1 << (total.bit_length() - 1)
        windows = max(1, min(ROUND, total // size))
        share = np.where(left > 0, weights, 0.0)
        per_round = apportion(windows * size, share, left)
        active = per_round > 0
        rounds = max(1, min(int((left[active] // per_round[active]).min()), total // (windows * size)))
        phases.append(Phase(window, sent.copy(), rounds, per_round.astype(np.int32), windows, size))
        sent, left, window = sent + rounds * per_round, left - rounds * per_round, window + rounds * windows
    return phases


def pieces_of(phases: list[Phase], queue: int, start: int, stop: int, turns: Turns | None = None) -> Iterator[tuple[int, int, int, int]]:
    """Where tokens [start, stop) of a queue go: (first token, behind the last, sequence, offset there)."""
    turns = turns or Turns()
    for p in phases[max(0, bisect_right(phases, start, key=lambda p: p.first_token[queue]) - 1) :]:
        base = int(p.first_token[queue])
        if base >= stop:
            break
        size = int(p.per_round[queue])
        a, b = max(start, base) - base, min(stop, base + p.rounds * size) - base
        if a >= b:
            continue
        queues, quotas, offsets = turns.of(p)
        at = int(np.searchsorted(queues, queue))
        quota = quotas[:, at].astype(np.int64)
        rounds = np.arange(a // size, (b - 1) // size + 1)
        cuts = (rounds[:, None] * size + quota[None, :-1]).ravel()
        cuts = np.unique(np.concatenate([[a], cuts[(cuts > a) & (cuts < b)]]))
        number = cuts // size
        in_round = cuts - number * size
        w = np.searchsorted(quota, in_round, side="right") - 1
        sequence = p.first_window + number * p.windows + w
        offset = offsets[w, at] + in_round - quota[w]
        yield from zip((cuts + base).tolist(), [*(cuts[1:] + base).tolist(), b + base], sequence.tolist(), offset.tolist(), strict=True)


def pieces_by_document(phases: list[Phase], queue: int, spans: list[tuple[int, int]], turns: Turns) -> Iterator[tuple[int, int, int, int, int]]:
    """Where documents `(first token, behind the last)` of a queue go: (number of the document, and as `pieces_of`).

    Documents that follow one another are placed together, and cut apart then.
    """
    first = 0
    while first < len(spans):
        last = first + 1
        while last < len(spans) and spans[last][0] == spans[last - 1][1]:
            last += 1
        doc = first
        for a, b, sequence, offset in pieces_of(phases, queue, spans[first][0], spans[last - 1][1], turns):
            at = a
            while at < b:
                end = min(b, spans[doc][1])
                yield doc, at, end, sequence, offset + at - a
                doc, at = doc + (end == spans[doc][1]), end
        first = last


def _queued(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"))


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """`(doc_id, queue, part, at, tokens, ids)`: at is the position in the queue within the task's part."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, sent = encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([END], dtype="<u4").tobytes()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows = batch.slice(first, 256)
                ids = [encode(t) + end for t in rows.column(1).cast(pa.binary()).to_pylist()]
                at = []
                for q, i in zip(rows.column(2).to_pylist(), ids, strict=True):
                    at.append(sent.get(q, 0))
                    sent[q] = at[-1] + len(i) // 4
                narrow = [np.frombuffer(i, "<u4").astype("<u2" if path_fits else "<u4").tobytes() for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(2), pa.array([part] * len(ids), pa.int32()), pa.array(at, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(narrow, pa.binary())],
                    names=["doc_id", "queue", "part", "at", "tokens", "ids"],
                )

    path_fits = _narrow(path)
    return docs.mapInArrow(run, "doc_id long, queue string, part int, at long, tokens long, ids binary")


def _narrow(path: str) -> bool:
    """Whether all ids fit in 16 bits, as they are then stored."""
    return max(encoder(path).tokenizer.get_vocab_size(), END + 1) <= 1 << 16


def pack(docs: DataFrame, tokenizer: str, targets: dict[str, float] | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces `(doc_id, queue, start, length, doc_tokens, sequence_id, offset, ids)`; ids: little-endian 32-bit.

    targets: the share of tokens for each source, by default what it has of all tokens.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    tokens = materialize(tokenize(_queued(docs), tokenizer), "tokens")
    parts = tokens.groupBy("queue", "part").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).orderBy("queue").collect()}
    number = {q: i for i, q in enumerate(totals)}
    weights = np.array([n if targets is None else max(0.0, targets.get(q, 0.0)) for q, n in totals.items()], dtype=float)
    plan = spark.sparkContext.broadcast((schedule(np.array([*totals.values()], dtype=np.int64), weights, length), number, "<u2" if _narrow(tokenizer) else "<u4"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (phases, number, kind), turns = plan.value, Turns()
        names = ["doc_id", "queue", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        types = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                rows, queues = [], {}
                for doc_id, queue, at, n, ids in zip(*(c.to_pylist() for c in batch.slice(first, 256).columns), strict=True):
                    queues.setdefault(queue, []).append((doc_id, at, n, ids))
                for queue, own in queues.items():
                    seen = -1
                    for i, a, b, sequence, offset in pieces_by_document(phases, number[queue], [(at, at + n) for _, at, n, _ in own], turns):
                        if i != seen:
                            seen, (doc_id, at, n, ids) = i, own[i]
                            wide = np.frombuffer(ids, kind).astype("<u4").tobytes()
                        rows.append((doc_id, queue, a - at, b - a, n, sequence, offset, wide[4 * (a - at) : 4 * (b - at)]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    placed = tokens.join(parts.select("queue", "part", "before"), ["queue", "part"]).select("doc_id", "queue", (F.col("before") + F.col("at")).alias("at"), "tokens", "ids")
    return placed.mapInArrow(place, "doc_id long, queue string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def packed_pieces(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_pieces(table(spark, sf_dir, "documents"))
