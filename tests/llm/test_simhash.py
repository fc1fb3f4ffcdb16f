"""Near-duplicates by fingerprint against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from muralog.llm import graph, simhash_dedup
from texts import words


def plain_fingerprint(text):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(found[i:i + 3]), 42) for i in range(max(1, len(found) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, names):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 2:
                root[find(i)] = find(j)
    of = [find(i) for i in range(len(prints))]
    return {i: min((names[j] for j in range(len(prints)) if of[j] == of[i] and names[j] is not None), default=None) for i in range(len(prints))}


def test_every_pair_within_the_radius_meets_in_a_table():
    for radius in (1, 2, 3):
        masks = simhash_dedup.covering_masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        rng = random.Random(radius)
        for _ in range(2000):
            difference = sum(1 << b for b in rng.sample(range(64), radius))
            assert any(m & difference == 0 for m in masks)


def test_odd_rows_and_near_copies(docs_of, odd_rows):
    near = words(9, 400)
    rows = odd_rows + [(20, near), (21, near + " end"), (22, near.upper()), (23, near + " another end here"), (24, words(10, 300))]
    got = simhash_dedup.near_duplicates(docs_of(rows), 3, 2).collect()
    prints, names = [plain_fingerprint(r[1]) for r in rows], [r[0] for r in rows]
    want = plain_components(prints, names)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == sorted(
        ((names[i], prints[i], want[i]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("radius", [1, 2])
def test_crowded_buckets_are_linked_exactly(spark, radius):
    """Hundreds of fingerprints around a few centres: far more than are compared pairwise."""
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for c in centres for _ in range(150)})
    signed = [simhash_dedup.signed(p) for p in prints]
    edges = simhash_dedup.links(spark.createDataFrame([(s,) for s in signed], "fp long"), radius)
    root = {r.vertex: r.root for r in graph.components(edges).collect()}
    plain = list(range(len(prints)))

    def find(i):
        while plain[i] != i:
            i = plain[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                plain[find(i)] = find(j)
    ours = [root.get(s, s) for s in signed]
    assert all((ours[i] == ours[j]) == (find(i) == find(j)) for i in range(len(prints)) for j in range(i))


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200), (301, 300), (300, 301)]
    got = {r.vertex: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}, 301: 300}


def test_one_of_each_group_stays(docs_of, no_docs):
    text = words(11, 200)
    rows = [(3, text), (1, text), (1, text), (2, words(12, 200)), (None, text), (None, text)]
    assert sorted(simhash_dedup.first_of_each(docs_of(rows)).select("doc_id").toPandas().doc_id.fillna(-1)) == [-1, -1, 1, 2]
    assert simhash_dedup.first_of_each(no_docs).count() == 0
    assert simhash_dedup.first_of_each(docs_of(rows)).columns == docs_of(rows).columns
    assert np.array_equal(simhash_dedup.near_duplicates(no_docs).columns, ["doc_id", "fp", "component_id"])


def test_rows_of_one_id_in_several_components(docs_of):
    """Of an id's rows only one of its own component stays, though another is a near copy of a smaller id."""
    a, b, c = f"a {words(50, 60)}", f"b {words(51, 60)}", f"c {words(52, 60)}"
    rows = [(1, a), (5, a), (5, b), (6, a), (6, c), (6, c), (7, b)]
    kept = simhash_dedup.first_of_each(docs_of(rows)).select("doc_id", "text").collect()
    assert sorted(map(tuple, kept)) == [(1, a), (5, b), (6, c)]
