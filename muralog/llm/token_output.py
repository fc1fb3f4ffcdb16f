"""Token ids in files: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

The most frequent id of the corpus gets rank 0, the next rank 1, and so on. A rank takes one to four
bytes; a control byte holds the lengths of four ranks, two bits each. A document's control bytes and
its data bytes are two columns, so that a reader turns control bytes into lengths with one table
lookup and then gathers the data, with no branch per value.

The files are Parquet, one per range of documents, in ascending order of their ids; `ranks` beside them
lists the ids by rank and `starts` the tokens before each file.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muralog.llm.words import Encoder, slices
from muralog.sources.scratch import scratch_path, stage

# Lengths of the four values of each control byte, first value in the lowest bits.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1
TOKENS_PER_FILE = 1 << 22
MOST_FILES = 20_000
# Tokens that are coded at once.
PART_TOKENS = 1 << 20
# Texts that are encoded at once, in bytes: the words, places and ids of a slice take many times its own length.
TEXT_BYTES = 3 << 20

FILE_SCHEMA = "doc_id long, file int, before long, n_tokens long, control binary, data binary"


def encode_ranks(ranks: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control and data bytes of the runs of ranks that end at `ends`, all runs at once."""
    ranks = ranks.astype("<u4")
    lengths = (1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)).astype(np.uint8)
    slots, control_ends = _slots(np.diff(ends, prepend=0))
    padded = np.zeros(int(control_ends[-1]) * 4 if len(ends) else 0, np.uint8)
    padded[slots] = lengths - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    data_ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[ends]
    return runs_of_bytes(control, control_ends), runs_of_bytes(data, data_ends)


def decode_ranks(control: pa.Array, data: pa.Array, n: np.ndarray) -> np.ndarray:
    """The ranks that runs of control and data bytes hold, `n` of each run, one run after another."""
    lengths = LENGTHS[bytes_of(control)].reshape(-1)[_slots(n)[0]]
    out = np.zeros((len(lengths), 4), np.uint8)
    out[np.arange(4) < lengths[:, None]] = bytes_of(data)
    return out.reshape(-1).view("<u4")


def _slots(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of runs lie if each run begins with a control byte of its own, and the ends of the control bytes."""
    control_ends = np.cumsum(-(-n // 4))
    begins = 4 * (control_ends - -(-n // 4)) - (np.cumsum(n) - n)
    return np.repeat(begins, n) + np.arange(int(n.sum())), control_ends


def bytes_of(runs: pa.Array) -> np.ndarray:
    """The bytes of binary values one after another."""
    _, offsets, data = runs.buffers()
    offsets = np.frombuffer(offsets, np.int32)[runs.offset:runs.offset + len(runs) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)


def token_table(docs: DataFrame, tokenizer: str, end_id: int, queue: str | None = None, keep: str | None = None) -> DataFrame:
    """Whole texts as little-endian id runs of two bytes, or four for larger vocabularies, staged once.

    Columns: `doc_id`, `n_tokens`, `ids`; with `queue`, the name of a string column, also that column,
    `part` (the writing task) and `before` (tokens of the same queue that the task wrote earlier); with
    `keep`, that string column as it is. A NULL text is empty and still has its end id.
    """
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer, end_id), TaskContext.get().partitionId()
        written: dict[str | None, int] = defaultdict(int)
        for batch in batches:
            for rows in slices(batch, limit=TEXT_BYTES):
                ids, ends = encoder.encode(rows.column("text"))
                n_tokens = np.diff(ends, prepend=0)
                out = [rows.column("doc_id"), pa.array(n_tokens), runs_of_bytes(ids.astype(f"<u{width}"), ends)]
                if queue:
                    before = []
                    for name, n in zip(rows.column(queue).to_pylist(), n_tokens.tolist()):
                        before.append(written[name])
                        written[name] += n
                    out += [rows.column(queue), pa.array(np.full(len(ends), part, np.int32)), pa.array(before, pa.int64())]
                if keep:
                    out.append(rows.column(keep))
                yield pa.RecordBatch.from_arrays(out, names)
            pa.default_memory_pool().release_unused()  # Arrow else keeps the most that a worker ever used

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *([queue] if queue else []), *([keep] if keep else []), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids binary" + (f", {queue} string, part int, before long" if queue else "") + (f", {keep} string" if keep else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return stage(columns.mapInArrow(run, schema), "tokens")


def runs_of_bytes(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive runs of `values`, which end at `ends`, as binary values without copying each."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])


def ids_of(runs: pa.Array, n: np.ndarray) -> np.ndarray:
    """The ids of `token_table` rows one after another."""
    data, total = bytes_of(runs), int(n.sum())
    return data.view(f"<u{len(data) // total}") if total else np.zeros(0, "<u4")


def parts_of(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Consecutive parts of a batch with at most `PART_TOKENS` tokens each, or a single row, and their `n_tokens`."""
    n = np.asarray(batch.column("n_tokens"))
    ends, begin = np.cumsum(n), 0
    while begin < len(n):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + PART_TOKENS, side="right")))
        yield batch.slice(begin, end - begin), n[begin:end]
        begin = end


def token_counts(tokens: DataFrame) -> DataFrame:
    """How often each id occurs, over all rows: `token_id`, `n`. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(0, np.int64)
        for batch in batches:
            for rows, n in parts_of(batch):
                more = np.bincount(ids_of(rows.column("ids"), n))
                if len(more) > len(counts):
                    counts, more = more.astype(np.int64), counts
                counts[:len(more)] += more
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(counts[met])], ["token_id", "n"])

    return (tokens.select("ids", "n_tokens").mapInArrow(run, "token_id long, n long")
            .groupBy("token_id").agg(F.sum("n").alias("n")))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text and write the token files in ascending order of `doc_id`.

    NULL ids come first; rows with the same id follow each other by length and checksum, and may fill
    several files. An empty table gives no token rows. Ids of the corpus at the driver are those of the
    vocabulary (`ranks`), and one total per file (`starts`).
    """
    tokens = token_table(docs, tokenizer, end_id)
    ranked = token_counts(tokens).orderBy(F.desc("n"), "token_id").select(
        (F.row_number().over(_by_count()) - 1).alias("rank"), "token_id", "n")
    ranked.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    ids_by_rank = _ids_by_rank(docs.sparkSession, path)
    rank_of = np.zeros(int(ids_by_rank.max(initial=0)) + 1, np.uint32)
    rank_of[ids_by_rank] = np.arange(len(ids_by_rank))

    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    n_files = max(1, min(MOST_FILES, -(-total // TOKENS_PER_FILE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, n in parts_of(batch):
                control, data = encode_ranks(rank_of[ids_of(rows.column("ids"), n)], np.cumsum(n))
                begins = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.full(len(n), file, np.int32)), pa.array(begins), rows.column("n_tokens"), control, data],
                                                 ["doc_id", "file", "before", "n_tokens", "control", "data"])

    # Repeated rows are told apart by where they lie, so that no id makes a file longer than others.
    order = [F.asc_nulls_first("doc_id"), F.asc("n_tokens"), F.asc("_crc"), F.asc("_at")]
    placed = tokens.withColumns({"_crc": F.crc32("ids"), "_at": F.monotonically_increasing_id()}).repartitionByRange(n_files, *order)
    (placed.sortWithinPartitions(*order).select("doc_id", "n_tokens", "ids").mapInArrow(run, FILE_SCHEMA)
     .write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/tokens"))

    spark = docs.sparkSession
    totals = sorted(spark.read.schema(FILE_SCHEMA).parquet(f"{path}/tokens").groupBy("file").agg(F.sum("n_tokens").alias("n")).collect())
    starts = np.cumsum([0, *[r.n for r in totals]]).tolist()
    spark.createDataFrame([(r.file, start) for r, start in zip(totals, starts)], "file int, start long").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/starts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files as `doc_id`, `start`, `n_tokens`, `ids` (little-endian, four bytes per id)."""
    ids_by_rank = _ids_by_rank(spark, path)
    starts = dict(spark.read.schema("file int, start long").parquet(f"{path}/starts").collect())
    start_of = np.zeros(max(starts, default=0) + 1, np.int64)
    for file, start in starts.items():
        start_of[file] = start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, n in parts_of(batch):
                ids = ids_by_rank[decode_ranks(rows.column("control"), rows.column("data"), n)].astype("<u4")
                start = start_of[np.asarray(rows.column("file"))] + np.asarray(rows.column("before"))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(start), rows.column("n_tokens"), runs_of_bytes(ids, np.cumsum(n))],
                                                 ["doc_id", "start", "n_tokens", "ids"])

    return spark.read.schema(FILE_SCHEMA).parquet(f"{path}/tokens").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")


def token_digests(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the files, read them back, and give each document's place, length and checksum."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, end_id)
    return read_tokens(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def _by_count():
    from pyspark.sql import Window

    return Window.orderBy(F.desc("n"), "token_id")


def _ids_by_rank(spark: SparkSession, path: str) -> np.ndarray:
    """One row per id of the vocabulary, at most."""
    rows = spark.read.schema("rank int, token_id long, n long").parquet(f"{path}/ranks").orderBy("rank").select("token_id").collect()
    return np.array([r.token_id for r in rows], np.uint32)
