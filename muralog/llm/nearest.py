"""Approximate nearest neighbours: low-dimensional stable projections in a kd-tree, verified until a chi-square test holds.

Vectors are scaled to unit length, so the largest cosine is the least distance. `DIMENSIONS` Gaussian
projections keep distances in the way that is known exactly: the squared projected distance of two
vectors over their squared distance follows chi-square with `DIMENSIONS` degrees of freedom. A vector
that is nearer than the k-th found so far therefore lies within projected distance
`sqrt(quantile) * d_k` with the quantile's probability, and the search stops there.

The upper levels of a kd-tree over the projections are medians of a bounded sample; its cells hold every
vector, and their boxes are those of all their vectors. A query first visits its own cell, which gives a
first `d_k`, and then the cells whose boxes the test does not rule out. Within a cell, vectors are
verified in the order of their projected distance until the test holds for the next one. A cell with
more than `BLOCK_ROWS` vectors is visited in blocks, and a block with many visitors is visited by
groups of them, so no task holds more than a block.

Equal vectors are one entry with their least ids, so that a vector that a third of the rows share is
looked at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralog.sources.scratch import broadcast_if_small, stage

DIMENSIONS = 10
CONFIDENCE = 0.95
SEED = 5
# The tree is fitted on at most about this many vectors, and has at most so many cells.
SAMPLE_ROWS = 50_000
MOST_CELLS = 4096
CELL_ROWS = 4096
BLOCK_ROWS = 16_384
VISITORS = 20_000
VERIFIED_AT_ONCE = 256


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile of chi-square with an even number of degrees, from its closed form."""
    if degrees % 2:
        raise ValueError("an even number of dimensions")

    def above(x: float) -> float:
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return exp(-x / 2) * total

    low, high = 0.0, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if above(middle) > 1 - p else (low, middle)
    return high


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows; shorter ones are padded with zeros."""
    lengths = np.asarray(column.value_lengths())
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = np.asarray(column.flatten(), dtype=float)
    return out


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row by the power of two that brings its largest component near one: exact, and no square overflows."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1))[1][:, None])


def norms(vectors: np.ndarray) -> np.ndarray:
    return np.sqrt((vectors * vectors).sum(axis=1))


def projected(vectors: np.ndarray, seed: int, dimensions: int) -> np.ndarray:
    directions = np.random.default_rng(seed).standard_normal((vectors.shape[1], dimensions))
    return (vectors / norms(vectors)[:, None]) @ directions


def split_tree(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """A complete binary tree: for each inner node the coordinate of the widest spread and its median."""
    axes, values = np.zeros(max(cells - 1, 0), np.int64), np.zeros(max(cells - 1, 0))
    parts = [sample]
    for node in range(cells - 1):
        part = parts[node]
        if len(part):
            axes[node] = int(np.argmax(part.var(axis=0)))
            values[node] = float(np.median(part[:, axes[node]]))
        right = part[:, axes[node]] > values[node]
        parts += [part[~right], part[right]]
        parts[node] = part[:0]
    return axes, values


def cells_of(points: np.ndarray, axes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Each point's leaf."""
    node = np.zeros(len(points), np.int64)
    while len(axes) and len(node) and node[0] < len(axes):  # all leaves have the same depth
        node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] > values[node])
    return node - len(axes)


def box_distances(point: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of a point from each box."""
    off = np.maximum(np.maximum(low - point, point - high), 0)
    return (off * off).sum(axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """`vec_id`, `vec` of the rows that take part: one vector for each id, the smallest if there are several."""
    finite = F.forall("vec", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)).groupBy("vec_id").agg(F.min("vec").alias("vec"))


def search(vectors: DataFrame, is_query: Column, k: int = 5, confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS,
           cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS, visitors: int = VISITORS, seed: int = SEED) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score`: the `k` nearest found of each query, nearest first, ties to smaller ids.

    Queries are the rows for which `is_query`, an expression over `vec_id`, holds; all other rows are
    their candidates, and with fewer than `k` all are given. Rows whose id or vector is NULL, and vectors
    that are empty, zero or hold a NULL or non-finite component take no part. Repeated rows count once; of
    different vectors under one id the smallest counts; shorter vectors count as padded with zeros.
    Extra columns are not read. An empty table gives no rows.
    """
    quantile = chi_square_quantile(confidence, dimensions)
    ids = stage(usable(vectors), "vectors")
    least = Window.partitionBy("vec").orderBy("vec_id")
    entries = ids.withColumn("at", F.row_number().over(least)).where(F.col("at") <= k + 1)
    entries = stage(entries.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    n, width = entries.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(1))).first()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = projected(scaled(matrix(batch.column("vec"), width)), seed, dimensions)
            yield pa.RecordBatch.from_arrays([pa.array(list(points), pa.list_(pa.float64()))], ["point"])

    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    sampled = entries.where(F.pmod(F.xxhash64(F.get("ids", 0), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20))).select("vec")
    rows = sampled.mapInArrow(project, "point array<double>").collect()
    sample = np.array([r.point for r in rows]).reshape(len(rows), dimensions)
    cells = min(MOST_CELLS, 1 << max(0, int(np.ceil(np.log2(max(n, 1) / cell_rows)))))
    axes, values = split_tree(sample, cells)

    def placed(df: DataFrame, keep: str, kind: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = projected(scaled(matrix(batch.column("vec"), width)), seed, dimensions)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(keep), batch.column("vec"), pa.array(list(points), pa.list_(pa.float64())), pa.array(cells_of(points, axes, values))],
                    [keep, "vec", "point", "cell"])

        return df.select(keep, "vec").mapInArrow(run, f"{keep} {kind}, vec {dict(df.dtypes)['vec']}, point array<double>, cell long")

    points = stage(placed(entries, "ids", "array<bigint>"), "projected-vectors")
    edges = sorted(points.groupBy("cell").agg(
        F.count("*").alias("n"), F.array(*[F.min(F.get("point", i)) for i in range(dimensions)]).alias("low"),
        F.array(*[F.max(F.get("point", i)) for i in range(dimensions)]).alias("high")).collect(), key=lambda r: r.cell)  # MOST_CELLS rows at most
    low, high = (np.array([r[c] for r in edges]).reshape(len(edges), dimensions) for c in ("low", "high"))
    blocks, first = [], 0
    for r in edges:
        blocks.append((r.cell, first, -(-r.n // block_rows)))
        first += blocks[-1][2]
    numbers = np.array([b[0] for b in blocks], np.int64)
    of_cell = F.broadcast(vectors.sparkSession.createDataFrame(blocks, "cell long, first long, blocks long"))
    points = points.join(of_cell, "cell").select(
        (F.col("first") + F.pmod(F.xxhash64(F.get("ids", 0)), F.col("blocks"))).alias("block"), "ids", "vec", "point")

    queries = stage(placed(ids.where(is_query), "vec_id", "long").withColumnRenamed("vec_id", "query_id"), "queries")
    home = queries.join(of_cell, "cell").select(
        (F.col("first") + F.pmod(F.xxhash64("query_id"), F.col("blocks"))).alias("block"), "query_id", "vec", "point", F.lit(float("inf")).alias("bound"))
    found = stage(visit(points, home, k, width, quantile, visitors), "found-at-home")

    # The distance of the k-th candidate found at home bounds the rest of the search.
    kth = ranked(found, k).where(F.col("rank") == k).select("query_id", F.greatest(2 - 2 * F.col("score"), F.lit(0.0)).alias("bound"))
    bounded = stage(home.drop("bound").join(kth, "query_id", "left").select(
        "query_id", "vec", "point", F.col("block").alias("home"), F.coalesce("bound", F.lit(float("inf"))).alias("bound")), "bounded-queries")

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = np.asarray(batch.column("bound"))
            met = [numbers[box_distances(p, low, high) <= radius(b, quantile)] for p, b in zip(matrix(batch.column("point"), dimensions), bounds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(met, pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

    schema = f"query_id long, vec {dict(bounded.dtypes)['vec']}, point array<double>, home long, bound double, cells array<bigint>"
    away = bounded.mapInArrow(reach, schema).withColumn("cell", F.explode("cells")).join(of_cell, "cell").withColumn(
        "block", F.explode(F.sequence("first", F.col("first") + F.col("blocks") - 1))).where("block <> home")
    more = visit(points, away.select("block", "query_id", "vec", "point", "bound"), k, width, quantile, visitors)
    return ranked(found.unionByName(more), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def radius(bound: float, quantile: float) -> float:
    """Squared projected distance up to which the test lets the search go on; a little above nothing for rounding."""
    return quantile * max(bound, 1e-12)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best `k` ids of each query from the found entries."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    listed = found.select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    return listed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def visit(points: DataFrame, visits: DataFrame, k: int, width: int, quantile: float, visitors: int) -> DataFrame:
    """`query_id`, `score`, `ids`: the best entries of each visited block for each of its visitors.

    A block goes to one task for every `visitors` of its visitors; there its points are held and the
    visitors pass by.
    """
    visits = stage(visits, "visits")
    groups = stage(visits.groupBy("block").agg(F.ceil(F.count("*") / visitors).alias("groups")), "visited-blocks")
    vec = dict(points.dtypes)["vec"]
    there = points.join(broadcast_if_small(groups), "block").select(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("part"), F.lit(0).alias("kind"), "ids", "vec", "point",
        F.lit(None).cast("long").alias("query_id"), F.lit(0.0).alias("bound"))
    coming = visits.join(broadcast_if_small(groups), "block").select(
        "block", F.pmod(F.xxhash64("query_id"), F.col("groups")).alias("part"), F.lit(1).alias("kind"), F.lit(None).cast("array<bigint>").alias("ids"), "vec", "point",
        "query_id", "bound")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            place = np.stack([np.asarray(batch.column("block")), np.asarray(batch.column("part"))])
            cuts = np.flatnonzero((np.diff(place) != 0).any(axis=0)) + 1
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if at != tuple(place[:, begin]):
                    at, held, block = tuple(place[:, begin]), [], None
                rows = batch.slice(begin, end - begin)
                n_points = int((np.asarray(rows.column("kind")) == 0).sum())  # points sort before visitors
                if n_points:
                    held.append(rows.slice(0, n_points))
                if n_points < rows.num_rows:
                    if block is None:
                        block, held = _block(held, width), []
                    yield _verified(block, rows.slice(n_points), k, width, quantile)

    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return there.unionByName(coming).repartition(n, "block", "part").sortWithinPartitions("block", "part", "kind").select(
        "block", "part", "kind", "ids", F.col("vec").cast(vec).alias("vec"), "point", "query_id", "bound").mapInArrow(
        run, "query_id long, score double, ids array<bigint>")


def _block(held: list[pa.RecordBatch], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    rows = pa.Table.from_batches(held).combine_chunks()
    vectors = scaled(matrix(rows.column("vec").chunk(0), width))
    points = rows.column("point").chunk(0)
    ids = rows.column("ids").chunk(0)
    return vectors, norms(vectors), matrix(points, len(points[0])), np.asarray(pc.list_element(ids, 0)), ids


def _verified(block, rows: pa.RecordBatch, k: int, width: int, quantile: float) -> pa.RecordBatch:
    """Entries of a block in the order of their projected distance, until the test holds for the next one."""
    vectors, lengths, points, least_ids, ids = block
    asked = scaled(matrix(rows.column("vec"), width))
    asked_lengths = norms(asked)
    places = matrix(rows.column("point"), points.shape[1])
    query, score, entry = [], [], []
    for i, (own, bound) in enumerate(zip(rows.column("query_id").to_pylist(), np.asarray(rows.column("bound")))):
        apart = ((points - places[i]) ** 2).sum(axis=1)
        near = np.flatnonzero(apart <= radius(bound, quantile))
        near = near[np.argsort(apart[near], kind="stable")]
        best, best_scores, done = np.zeros(0, np.int64), np.zeros(0), 0
        while done < len(near) and apart[near[done]] <= radius(bound, quantile):
            some = near[done:done + VERIFIED_AT_ONCE]
            done += len(some)
            cosine = (vectors[some] * asked[i]).sum(axis=1) / (lengths[some] * asked_lengths[i])
            best, best_scores = np.concatenate([best, some]), np.concatenate([best_scores, cosine])
            order = np.lexsort((least_ids[best], -best_scores))[:k + 1]  # one of them may be the query itself
            best, best_scores = best[order], best_scores[order]
            if len(best) > k:
                bound = min(bound, max(0.0, 2 - 2 * best_scores[k]))
        query += [own] * len(best)
        score.append(best_scores)
        entry.append(best)
    entry = np.concatenate(entry) if entry else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(np.concatenate(score) if score else np.zeros(0)), ids.take(pa.array(entry))],
                                      ["query_id", "score", "ids"])
