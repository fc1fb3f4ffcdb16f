"""Nearest neighbours against comparing every query with every row."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from muralog.llm import nearest
from muralog.llm.queries import op12_nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>, label int"


def usable(rows):
    found = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            found[i] = min(found.get(i, v), v)
    return found


def plain_search(rows, is_query, k=5):
    vectors = usable(rows)
    width = max(map(len, vectors.values()), default=1)
    padded = {i: np.array(v + [0.0] * (width - len(v))) for i, v in vectors.items()}
    padded = {i: v / np.abs(v).max() for i, v in padded.items()}
    out = {}
    for q, a in padded.items():
        if is_query(q):
            scores = [(-float(a @ b) / (np.linalg.norm(a) * np.linalg.norm(b)), i) for i, b in padded.items() if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def found_by(df):
    assert df.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(ours, theirs):
    assert set(ours) == {q for q, near in theirs.items() if near}
    # A neighbour as near as the last one counts, whichever of the equal ones it is.
    hits = sum(sum(s >= near[-1][1] - 1e-12 for _, s in ours[q]) for q, near in theirs.items() if near)
    return hits / max(1, sum(map(len, theirs.values())))


def clustered(seed, n, width=24):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, width))
    return [(i, [float(x) for x in centres[rng.integers(12)] + 0.6 * rng.standard_normal(width)]) for i in range(n)]


@pytest.mark.parametrize("cell_rows, block_rows, visitors", [(4096, 16_384, 20_000), (64, 40, 7)])
def test_recall(spark, cell_rows, block_rows, visitors):
    """Also with a third of the rows on one vector, many cells, blocks and groups of visitors."""
    rows = clustered(1, 1500)
    rows += [(2000 + i, rows[7][1]) for i in range(700)]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({c: F.lit("extra") for c in ("query_id", "rank", "cell", "block", "vec", "ids", "n")})
    ours = found_by(nearest.search(table, F.col("vec_id") % 20 == 0, 5, cell_rows=cell_rows, block_rows=block_rows, visitors=visitors))
    theirs = plain_search(rows, lambda q: q % 20 == 0)
    assert recall(ours, theirs) >= 0.95
    by_id = dict(rows)
    for q, near in ours.items():
        assert len(near) == 5 and near == sorted(near, key=lambda x: (-x[1], x[0]))
        for i, s in near:
            a, b = np.array(by_id[q]), np.array(by_id[i])
            assert s == pytest.approx(a @ b / np.sqrt((a @ a) * (b @ b)), abs=1e-12)
    assert [i for i, _ in ours[2000]] == [7, 2001, 2002, 2003, 2004]


def test_everything_is_verified_with_certainty(spark):
    rows = clustered(2, 400)
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    ours = found_by(nearest.search(table, F.col("vec_id") % 10 == 0, 3, confidence=1 - 1e-12, cell_rows=32, block_rows=32))
    theirs = plain_search(rows, lambda q: q % 10 == 0, 3)
    assert {q: [i for i, _ in near] for q, near in ours.items()} == {q: [i for i, _ in near] for q, near in theirs.items()}


def test_the_test_stops_the_search(spark):
    """Most vectors of other clusters are never verified, and the quantile is that of chi-square."""
    assert nearest.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3) and nearest.chi_square_quantile(0.5, 2) == pytest.approx(1.38629, abs=1e-4)
    vectors = np.array([v for _, v in clustered(3, 2000)])
    places = nearest.projected(vectors, 5, 10)
    unit = vectors / nearest.norms(vectors)[:, None]
    apart, real = ((places - places[0]) ** 2).sum(axis=1)[1:], ((unit - unit[0]) ** 2).sum(axis=1)[1:]
    assert abs((apart / real).mean() - 10) < 1.5
    assert (apart <= nearest.chi_square_quantile(0.95, 10) * np.sort(real)[4]).mean() < 0.5


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, []), (150, [0.0, 0.0]), (200, [1.0, None]), (250, [float("nan"), 1.0]), (300, [float("inf"), 1.0]),
            (None, [1.0, 2.0]), (1, [2.0, 4.0]), (2, [1.0, 2.0]), (3, [-1.0, -2.0]), (4, [1.0]), (350, [2.0**900, 2.0**901]), (5, [1e-300, 3e-300]), (6, [4.0, 1.0]), (6, [0.0, 1.0])]
    table = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    ours = found_by(nearest.search(table, F.col("vec_id") % 50 == 0))
    theirs = plain_search(rows, lambda q: q % 50 == 0)
    assert {q: [i for i, _ in near] for q, near in ours.items()} == {0: [1, 2, 350, 5, 6], 350: [0, 1, 2, 5, 6]} and set(theirs) == set(ours)
    for q, near in ours.items():
        assert [s for _, s in near] == pytest.approx([s for _, s in theirs[q]], abs=1e-12)
    few = found_by(nearest.search(table.where("vec_id in (0, 1, 3)"), F.col("vec_id") == 0))
    assert [i for i, _ in few[0]] == [1, 3]
    for none in (table.where("false"), table.where("vec_id = 50"), table.where("vec_id = 0")):
        assert nearest.search(none, F.col("vec_id") % 50 == 0).collect() == []


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    ours = found_by(op12_nearest_neighbours(spark, sf_dir))
    assert recall(ours, plain_search(rows, lambda q: q % 50 == 0)) >= 0.9 and all(len(near) == 5 for near in ours.values())
