"""SimHash near-duplicates with covering locality-sensitive hashing.

Each of the 64 bit positions gets a non-zero vector of `radius + 1` bits. For every non-zero vector
`v` there is one table whose mask holds the positions with an odd inner product with `v`. The
positions in which two fingerprints within the radius differ span at most `radius` dimensions, so
some `v` is orthogonal to all of them: that table's mask avoids every differing position and the two
fingerprints collide in it, always. There are `2 ** (radius + 1) - 1` tables (7 for radius 2).

Equal fingerprints are one vertex throughout, so a group of copies costs one row per table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralog.llm.graph import components
from muralog.llm.words import slices
from muralog.sources.scratch import broadcast_if_small, stage

BITS = 64
SEED = 42
# Members of a bucket are compared pairwise up to this number, and linked through flipped bits beyond it.
PAIRED = 32


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of the lower-cased (A-Z) text's word shingles; 0 if there is no word."""
    words = text.lower().split()  # bytes: A-Z only; splits at space and \t to \r
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    begins = np.cumsum(lengths + 1) - lengths - 1
    ends = (begins + lengths)[min(shingle, len(words)) - 1:]
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins[:n].tolist(), ends.tolist())), np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i:i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def text_hash() -> Column:
    """Tells the rows of one id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = 3, hashed: bool = False) -> DataFrame:
    """`doc_id` and `fp`, the fingerprint as a signed long, of every whole text, and its `text_hash` if asked for. A NULL text has no word."""
    carried = ["doc_id", *["text_hash"] * hashed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                texts = rows.column("text").cast(pa.large_binary()).to_numpy(zero_copy_only=False)
                fps = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in carried], pa.array(fps.view(np.int64))], [*carried, "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[text_hash().alias("text_hash")] * hashed).mapInArrow(
        run, ", ".join(f"{c} long" for c in [*carried, "fp"]))


def covering_masks(radius: int, bits: int = BITS, seed: int = 7) -> list[int]:
    """One mask per table, as signed longs. The vectors are dealt evenly and then shuffled."""
    n = 2 ** (radius + 1) - 1
    vectors = np.random.default_rng(seed).permutation(np.arange(bits) % n + 1)
    masks = [sum(1 << i for i in range(bits) if bin(int(vectors[i]) & v).count("1") % 2) for v in range(1, n + 1)]
    return [signed(m) for m in masks]


def signed(value: int) -> int:
    """64 unsigned bits as Spark's long."""
    return value - (1 << BITS) if value >> (BITS - 1) else value


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Edges `a`, `b` between distinct fingerprints: as components, all that are within the radius.

    Members of a small bucket are paired. In a large one they share their masked bits, so they differ
    only in the others; up to radius 2 two members are within the radius exactly if they have a common
    neighbour at distance one, or are one another's. Each member lists itself and its neighbours in
    those bits, and all that list the same value are tied to the smallest of them. That is linear in
    the members and leaves no link out.
    """
    if radius not in (1, 2):
        raise ValueError("buckets of any size are linked exactly for radius 1 and 2")
    masks = covering_masks(radius)
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)]))
    members = distinct.select("fp", tables.alias("at")).select("fp", "at.t", "at.key")
    crowded = members.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(members.join(crowded, ["t", "key"]), "simhash-buckets")

    small = shared.where(F.col("n") <= PAIRED).groupBy("t", "key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
    pairs = small.select(F.explode(F.flatten(F.transform("fps", lambda a, i: F.transform(
        F.slice("fps", i + 2, F.size("fps")), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p")).select("p.a", "p.b")
    near = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()

    flips = [[0, *(signed(1 << i) for i in range(BITS) if not m >> i & 1)] for m in masks]
    neighbours = F.element_at(F.array(*[F.array(*[F.lit(f).cast("long") for f in own]) for own in flips]), F.col("t") + 1)
    listed = shared.where(F.col("n") > PAIRED).select("t", "fp", F.explode(neighbours).alias("f")).select(
        "t", "fp", F.col("fp").bitwiseXOR(F.col("f")).alias("value"))
    if radius == 1:
        # A member ties itself to the members it lists.
        there = distinct.select(F.col("fp").alias("value"))
        ties = listed.join(there, "value", "left_semi").select(F.least("fp", "value").alias("a"), F.greatest("fp", "value").alias("b"))
    else:
        smallest = listed.groupBy("t", "value").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a < last")
        ties = listed.join(smallest.select("t", "value", "a"), ["t", "value"]).select("a", F.col("fp").alias("b"))
    return near.union(ties.where("a < b").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, hashed: bool = False) -> DataFrame:
    """`doc_id`, `fp`, and `component_id`, the smallest id reachable over links within the radius.

    Texts without a word (NULL, empty, white space) have fingerprint zero and are linked like any
    other. Rows with the same id share a component if their fingerprints do, and are returned as often
    as they occur; a NULL id is never a component's name unless no other id is in it. An empty table
    gives an empty result. With `hashed`, each row also has its `text_hash`.
    """
    marked = stage(fingerprints(docs, shingle, hashed), "fingerprints")
    distinct = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    named = components(links(distinct.select("fp"), radius))  # vertex, root
    classes = distinct.join(named, distinct.fp == named.vertex, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fingerprint = stage(classes.join(smallest, "root").select("fp", "component_id"), "classes")
    return marked.join(of_fingerprint, "fp").select("doc_id", "fp", "component_id", *["text_hash"] * hashed)


def first_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """The documents without near-duplicates: of each component, the one with the smallest id stays.

    Rows that share an id are one document: of those that would stay, the row with the smallest text
    does; a row that is a near copy in another component goes. A document without an id cannot be named
    and stays.
    """
    found = stage(near_duplicates(docs, shingle, radius, hashed=True).where("doc_id = component_id").groupBy("doc_id", "text_hash").agg(
        F.count("*").alias("n")), "first-of-each")
    rows = stage(found.join(found.groupBy("doc_id").agg(F.sum("n").alias("all")), "doc_id").select(
        F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash"), (F.col("all") == 1).alias("_once")), "kept-rows")
    same = (F.col("doc_id") == F.col("_kept_id")) & (text_hash() == F.col("_kept_hash"))
    once = docs.join(broadcast_if_small(rows.where("_once")), same, "left_semi")
    more = docs.join(broadcast_if_small(rows.where("not _once")), same, "left_semi")
    one = more.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return once.select(docs.columns).union(one.select(docs.columns)).union(docs.where("doc_id is null"))
