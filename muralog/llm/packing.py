"""Mixture-controlled packing: deficit round-robin over one token queue per source.

Each round every queue is credited its share of a window; it is served in whole turns of `TURN`
tokens, and what is left of its credit is its deficit, carried to the next round. So after `r` rounds
a queue with share `w` has sent `TURN * floor(r * w * window / TURN)` tokens, whatever happened in
between. That closed form lets any task place any document: it needs the totals of the queues and the
document's place in its own queue, not the rounds before. Deficits thus carry across windows and
partitions with no task walking over the corpus.

The sent tokens fill windows end to end, so only the last sequence is short. A queue that runs out
sends what it has left, and the others keep their proportions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralog.llm.token_output import ids_of, runs_of_bytes, token_table
from muralog.llm.words import expand
from muralog.sources.scratch import sized

TURN = 64
# The totals of the queues are one row each at the driver. More sources than this share queues.
MOST_QUEUES = 10_000
# Documents whose pieces are made in one go, which bounds a worker's memory.
ROWS_AT_ONCE = 500

PIECES = ("doc_id long, start long, length long, doc_tokens long, source string, sequence_id long, offset long, "
          "pad_to long, ids binary")


class Schedule:
    """Where the tokens of each queue go. `totals` and `shares` are by queue, in serving order."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, window: int, turn: int) -> None:
        self.totals, self.window, self.turn = totals, window, turn
        self._turns = shares / shares.sum() * window / turn  # turns credited per round

    def sent(self, rounds: np.ndarray, queue: int | None = None) -> np.ndarray:
        """Tokens sent after so many rounds: of one queue, or by (round, queue)."""
        if queue is not None:
            return np.minimum(self.totals[queue], self.turn * np.floor(rounds * self._turns[queue]).astype(np.int64))
        return np.minimum(self.totals, self.turn * np.floor(rounds[:, None] * self._turns).astype(np.int64))

    def _rounds(self, queue: int, begin: int, end: int) -> np.ndarray:
        """The rounds that send these tokens of the queue, counted from 0."""
        per_round = self._turns[queue]
        due = np.arange(begin // self.turn, (end - 1) // self.turn + 1) + 1
        sends = np.ceil(due / per_round)
        sends -= np.floor((sends - 1) * per_round) >= due  # the division may be off by one step
        sends += np.floor(sends * per_round) < due
        return np.unique(sends.astype(np.int64)) - 1

    def place(self, queue: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the queue's tokens [begin, end): first token, length, place in the whole output."""
        rounds = self._rounds(queue, begin, end)
        own_from = self.sent(rounds, queue)
        own_to = self.sent(rounds + 1, queue)
        before = np.empty(len(rounds), np.int64)
        step = max(1, 1_000_000 // len(self.totals))
        for i in range(0, len(rounds), step):
            at = rounds[i:i + step]
            sent = self.sent(at, None)
            turn_before = self.sent(at + 1, None)[:, :queue].sum(axis=1) - sent[:, :queue].sum(axis=1)
            before[i:i + step] = sent.sum(axis=1) + turn_before
        first, last = np.maximum(own_from, begin), np.minimum(own_to, end)
        where, length = before + first - own_from, last - first
        return self._merged(*self._cut(first, length, where))

    def _cut(self, first: np.ndarray, length: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cut pieces where a window ends."""
        windows = (where + length - 1) // self.window - where // self.window + 1
        piece = np.repeat(np.arange(len(first)), windows)
        nth = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        lower = np.where(nth == 0, where[piece], (where[piece] // self.window + nth) * self.window)
        upper = np.minimum(where[piece] + length[piece], (where[piece] // self.window + nth + 1) * self.window)
        return first[piece] + lower - where[piece], upper - lower, lower

    def _merged(self, first: np.ndarray, length: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Join pieces that follow each other in one window."""
        new = np.ones(len(first), bool)
        new[1:] = (where[1:] != where[:-1] + length[:-1]) | (where[1:] % self.window == 0)
        heads = np.flatnonzero(new)
        return first[heads], np.add.reduceat(length, heads), where[heads]


def padded_to(filled: int, window: int) -> int:
    """A sequence is padded to the window unless it already ends at a power of two."""
    return filled if filled & (filled - 1) == 0 else window


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096,
         shares: dict[str | None, float] | None = None, turn: int = TURN) -> DataFrame:
    """Pieces of all documents, placed in sequences of `window` tokens.

    `shares` gives the target proportion of each source, which must be positive; by default it is the
    source's share of all tokens, so that the queues run out together. NULL is a source of its own. With more
    than `MOST_QUEUES` sources each is dealt by its hash to one of that many queues, whose share is that of
    its sources together. A
    NULL or empty text has one token, its end id. Repeated rows are packed as often as they occur. An
    empty table gives no pieces. Columns: `doc_id, start, length, doc_tokens, source, sequence_id,
    offset, pad_to` and the piece's `ids` (little-endian, four bytes each).
    """
    docs = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    shared = docs.select("source").distinct().limit(MOST_QUEUES + 1).count() > MOST_QUEUES
    queue = F.pmod(F.xxhash64("source"), F.lit(MOST_QUEUES)).cast("string") if shared else F.col("source")
    tokens = token_table(docs.withColumn("queue", queue), tokenizer, end_id, queue="queue", keep="source")

    # A queue is the rows of its sources, task after task as they were written; within a task in row order.
    by_part = tokens.groupBy("part", "queue").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_part.select("part", "queue", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("begin"))
    queues = tokens.groupBy("queue").agg(F.sum("n_tokens").alias("n")).orderBy("queue").collect()
    totals = np.array([q.n for q in queues], np.int64)
    wanted = _wanted(docs, queue, queues, shares) if shares else totals.astype(float)
    if (wanted <= 0).any():
        raise ValueError("every source needs a positive share")
    index = {q.queue: i for i, q in enumerate(queues)}
    total = int(totals.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schedule = Schedule(totals, wanted, window, turn)
        for batch in (b.slice(i, ROWS_AT_ONCE) for b in batches for i in range(0, b.num_rows, ROWS_AT_ONCE)):
            found = []
            lengths, begins = np.asarray(batch.column("n_tokens")), batch.column("begin").to_pylist()
            for i, (queue, n, begin) in enumerate(zip(batch.column("queue").to_pylist(), lengths.tolist(), begins)):
                first, length, where = schedule.place(index[queue], begin, begin + n)
                found.append((np.full(len(first), i), first - begin, length, where))
            row, start, length, where = (np.concatenate(x) for x in zip(*found))
            ids = expand((np.cumsum(lengths) - lengths)[row] + start, length, ids_of(batch.column("ids"), lengths)).astype("<u4")
            sequence = where // window
            last = total // window
            pad_to = np.where(sequence == last, padded_to(total - last * window, window), window)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length),
                pa.array(lengths[row]), batch.column("source").take(pa.array(row)),
                pa.array(sequence), pa.array(where % window), pa.array(pad_to.astype(np.int64)),
                runs_of_bytes(ids, np.cumsum(length)),
            ], ["doc_id", "start", "length", "doc_tokens", "source", "sequence_id", "offset", "pad_to", "ids"])

    small = sized(begins.select(F.col("part").alias("_part"), F.col("queue").alias("_queue"), "begin"), "queue-begins")
    placed = tokens.join(small, (F.col("part") == F.col("_part")) & F.col("queue").eqNullSafe(F.col("_queue")))
    return placed.select("doc_id", "source", "queue", "n_tokens", (F.col("begin") + F.col("before")).alias("begin"), "ids").mapInArrow(run, PIECES)


def _wanted(docs: DataFrame, queue: Column, queues: list, shares: dict[str | None, float]) -> np.ndarray:
    """The share of each queue: the sum over its sources. A source without a positive share is an error."""
    if min(shares.values()) <= 0:
        raise ValueError("every source needs a positive share")
    of_source = docs.sparkSession.createDataFrame([(s, float(w)) for s, w in shares.items()], "_source string, share double")
    dealt = docs.select("source", queue.alias("queue")).distinct().join(of_source, F.col("source").eqNullSafe(F.col("_source")), "left")
    sums = {r.queue: r.share for r in dealt.groupBy("queue").agg(F.when(F.count("share") == F.count(F.lit(1)), F.sum("share")).otherwise(0.0).alias("share")).collect()}
    return np.array([sums[q.queue] for q in queues], float)


def piece_digests(docs: DataFrame, tokenizer: str, end_id: int, window: int = 4096) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pack(docs, tokenizer, end_id, window).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        "source", "pad_to")
