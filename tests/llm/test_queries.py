"""Queries without SQL, and the rows of the pipeline, against plain versions on the smallest tables."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from test_decontamination_and_licenses import plain_best
from test_simhash import plain_components, plain_fingerprint
from test_tokens_and_packing import whole_text_ids

import corpus_pipeline
from muralog.llm import decontamination
from muralog.llm.queries import QUERIES


@pytest.fixture(scope="module")
def smallest(sf_dir):
    return sf_dir.replace("sf0.01", "sf0.001")


@pytest.fixture(scope="module")
def rows(spark, smallest):
    return [tuple(r) for r in spark.read.parquet(f"{smallest}/documents.parquet").select("doc_id", "text", "lang").collect()]


def test_language_query(spark, sf_dir):
    """On the next larger table, whose training part knows all languages well: held-out rows, and the fold of every row."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()}
    got = {r.doc_id: r for r in QUERIES["op3_language_id"](spark, sf_dir).collect()}
    assert set(got) == set(docs)
    right = []
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in docs[i].text or ""):
            assert r.lang_pred == "und"
        elif r.held_out and docs[i].lang is not None:
            right.append(r.lang_pred == docs[i].lang)
    assert len(right) > 100 and sum(right) / len(right) >= 0.99


def test_decontamination_query(spark, smallest, rows):
    items = [tuple(r) for r in spark.read.parquet(f"{smallest}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id): r.similarity for r in QUERIES["op6_decontamination"](spark, smallest).collect()}
    want = {}
    for i, text, _ in rows:
        said = set(decontamination.shingles_of(decontamination.split_words(text)))
        for j, item in items:
            if said & set(decontamination.shingles_of(decontamination.split_words(item))) and (s := plain_best(item, text)) >= decontamination.SIMILARITY:
                want[i, j] = s
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and want


def test_simhash_query(spark, smallest, rows):
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    names = [i for i, *_ in rows]
    components = plain_components(prints, names)
    want = sorted((i, f"{p:016x}", components[k]) for k, (i, p) in enumerate(zip(names, prints)))
    assert sorted(tuple(r)[:3] for r in QUERIES["op8_simhash_dedup"](spark, smallest).collect()) == want


def test_pipeline_rows(spark, smallest):
    """Each stage keeps what its query keeps of its own input; the packed pieces hold each id of what is left once."""
    docs = spark.read.parquet(f"{smallest}/documents.parquet")
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = corpus_pipeline.stage(function(spark, docs, smallest), "test-stage")
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
    left = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    items = [r.text for r in spark.read.parquet(f"{smallest}/benchmark.parquet").collect()]
    assert len(left) > 50 and not any(item in (text or "") for item in items for text in left.values())

    whole = dict(zip(left, whole_text_ids(list(left.values()))))
    total = sum(map(len, whole.values()))
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in corpus_pipeline.run(spark, smallest).collect():
        assert p.doc_tokens == len(whole[p.doc_id]) and p.ids_crc32 == zlib.crc32(whole[p.doc_id][p.start:p.start + p.length].tobytes())
        of_doc[p.doc_id].append((p.start, p.length))
        of_sequence[p.sequence_id].append((p.offset, p.length))
    lengths = {k: min(4096, total - 4096 * k) for k in range(-(-total // 4096))}
    for runs, ends in ((of_doc, {i: len(x) for i, x in whole.items()}), (of_sequence, lengths)):
        assert set(runs) == set(ends)
        for key, found in runs.items():
            found.sort()
            assert [a for a, _ in found] == np.cumsum([0, *[n for _, n in found[:-1]]]).tolist() and sum(n for _, n in found) == ends[key]
