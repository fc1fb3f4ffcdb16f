"""Importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

A text is drawn as independent Poisson counts of hashed unigrams and bigrams; words and runs of
punctuation are tokens of their own. The target model holds each bucket's rate per text over the texts
labelled as wanted, the raw model over all texts, both smoothed by the same `SMOOTHING` occurrences per
target corpus, so that a bucket met a few times says little whatever its shares are. Rates per text, not
shares of all tokens: where wanted and other texts speak alike a bucket counts nothing, and a long text
does not gain by its length. A text's log weight is the log of the ratio of its probabilities under both
models: the sum of `count * log(target rate / raw rate)`, less the difference of the rates' sums. The `k`
texts with the largest `log weight + Gumbel noise` are a sample without replacement with
probabilities in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralog.llm.hashing import WORDS_AND_MARKS, shingle_hashes, words_of
from muralog.llm.words import slices
from muralog.sources.scratch import broadcast_if_small, stage

BITS = 20
BUCKETS = 1 << BITS
SMOOTHING = 16.0
# The share of the rows that is sampled.
SHARE = 0.75
SEED = 11
# The k-th largest value is looked for in at most this many values at the driver.
FEW = 10_000


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and bucket of every unigram and bigram, as often as they occur."""
    words, _, _, ends = words_of(texts, WORDS_AND_MARKS)
    row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    pairs = shingle_hashes(words, 2)
    inside = row[1:] == row[:-1]
    bucket = np.concatenate([words, pairs[inside] if len(pairs) else pairs]) & np.uint64(BUCKETS - 1)
    return np.concatenate([row, row[1:][inside]]), bucket.astype(np.int64)


def bucket_counts(docs: DataFrame) -> DataFrame:
    """`bucket`, `raw`, `target`: how often each bucket occurs in all texts and in wanted ones. Column `wanted` tells them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)  # of one task's rows
        for batch in batches:
            for rows in slices(batch, limit=1 << 21):
                row, bucket = features(rows.column("text"))
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[np.asarray(rows.column("wanted"))[row]], minlength=BUCKETS)
        met = np.flatnonzero(raw)
        for i in range(0, len(met), 1 << 16):
            at = met[i:i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    return (docs.select("text", "wanted").mapInArrow(run, "bucket long, raw long, target long")
            .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts with `wanted` (quality 1 and not toxic). An id with differing labels is not wanted."""
    by_id = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))).alias("wanted"))
    wanted = broadcast_if_small(stage(by_id.where("wanted"), "wanted-ids"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        wanted, F.col("doc_id") == F.col("_id"), "left").select("text", F.coalesce("wanted", F.lit(False)).alias("wanted"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """Log ratio of target and raw rate of each bucket, and the difference of the rates' sums per text; None without a wanted text."""
    texts = marked(docs, labels)
    n_raw, n_target = texts.agg(F.count("*"), F.count_if("wanted")).first()
    if not n_target:
        return None
    ratios = np.zeros(BUCKETS)
    table = bucket_counts(texts).toArrow()  # BUCKETS rows at most
    target, due = np.asarray(table.column("target")), np.asarray(table.column("raw")) * (n_target / n_raw)
    ratios[np.asarray(table.column("bucket"))] = np.log(target + SMOOTHING) - np.log(due + SMOOTHING)
    return ratios, float(target.sum() - due.sum()) / n_target


def log_weights(docs: DataFrame, ratios: np.ndarray, surplus: float) -> DataFrame:
    """`doc_id`, `log_weight` of every whole text; a NULL text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, limit=1 << 21):
                row, bucket = features(rows.column("text"))
                weight = np.bincount(row, ratios[bucket], minlength=rows.num_rows) - surplus
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(weight)], ["doc_id", "log_weight"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, log_weight double")


def kth_largest(values: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, exactly, by counting in ever narrower ranges."""
    low, high = values.agg(F.min(column), F.max(column)).first()
    while True:
        inside = values.where(F.col(column).between(low, high))
        n = inside.count()
        if n <= FEW or low == high:
            largest = [r[0] for r in inside.orderBy(F.desc(column)).select(column).limit(min(k, FEW)).collect()]
            return largest[-1] if low != high else low
        width = (high - low) / 1024
        bins = sorted(inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(1023)).alias("bin")).agg(
            F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect(), key=lambda b: -b.bin)
        for b in bins:
            if k <= b.n:
                low, high = b.low, b.high
                break
            k -= b.n


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """`doc_id`, `log_weight`, `kept` for every row: a sample of the `share` of all rows by importance.

    Noise depends on `doc_id` alone, so runs agree and repeated rows are kept or rejected together; rows
    tied with the last one are all kept. Without a text labelled as wanted there is no target and nothing
    is rejected. An empty table gives no rows. Extra columns are not read.
    """
    model = log_ratios(docs, labels)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("log_weight"), F.lit(True).alias("kept"))
    scored = stage(with_noise(log_weights(docs, *model), seed), "log-weights")
    n = scored.count()
    k = round(share * n)
    kept = F.col("key") >= kth_largest(scored, "key", k) if k > 0 else F.lit(False)
    return scored.select("doc_id", "log_weight", kept.alias("kept"))


def with_noise(weights: DataFrame, seed: int) -> DataFrame:
    """`key`, the log weight with Gumbel noise."""
    uniform = (F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return weights.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform)))


def kept_documents(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """The documents that the sample keeps. Rows that share an id stay if one of them is kept; without an id, all stay."""
    rejected = resample(docs, labels, share).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(broadcast_if_small(stage(rejected, "rejected")), "doc_id", "left_anti")
