"""Passages against a plain search, licence notices against a plain search."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from texts import words

from muralog.llm import decontamination, license_scan
from muralog.llm.queries import LICENSE_NOTICES


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({"doc_id": F.lit(1), "similarity": F.lit("x")})


def test_index_finds_every_window_within_the_radius():
    """Fingerprints at all distances from an item's: exactly those within the radius come out."""
    item = words(1, 40)
    index = decontamination.Index([(7, item)])
    (size, (_, offset, prints, tables)), = index.sizes.items()
    assert size <= 33 and offset.tolist() == [0, (40 - size) // 2, 40 - size]
    rng = random.Random(4)
    for distance in range(0, 16):
        window = int(prints[0]) ^ sum(1 << b for b in rng.sample(range(64), distance))
        found = any(bin(int(prints[p]) ^ window).count("1") <= decontamination.RADIUS
                    for block, (starts, lengths, parts) in enumerate(tables)
                    for v in [window >> 16 * block & 0xFFFF] for p in parts[starts[v]:starts[v] + lengths[v]] if p == 0)
        assert found == (distance <= decontamination.RADIUS)


def test_window_fingerprints_are_simhashes():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 2**64, 300, np.uint64)
    got = decontamination.window_fingerprints(decontamination.running_bits(hashes), 37)
    for at in (0, 5, 263):
        want = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[at:at + 37]) > 37)
        assert int(got[at]) == want
    assert len(got) == 264


def similarity(a, b):
    """Weighted Jaccard similarity of the five-word shingles of two word lists."""
    x, y = (Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in (a, b))
    return (x & y).total() / either if (either := (x | y).total()) else 0.0


def plain_best(item, text):
    """The largest similarity of the item with any run of the text's words."""
    a, b = decontamination.split_words(item), decontamination.split_words(text)
    own, n, best = Counter(tuple(a[i:i + 5]) for i in range(len(a) - 4)), len(a) - 4, 0.0
    said = [tuple(b[i:i + 5]) for i in range(len(b) - 4)]
    for i in range(len(said)):
        if said[i] not in own:  # no best run begins so
            continue
        met, shared = Counter(), 0
        for k in range(i, min(len(said), i + n * 5 // 4)):
            met[said[k]] += 1
            shared += met[said[k]] <= own[said[k]]
            best = max(best, shared / (n + k + 1 - i - shared))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_best_run_is_the_best_of_all(seed):
    rng = random.Random(seed)
    for _ in range(60):
        item = [rng.choice([b"a", b"b", b"%d" % rng.randrange(40)]) for _ in range(rng.randrange(5, 25))]
        text = [rng.choice([b"a", b"b", b"x"]) for _ in range(rng.randrange(4))] + item * rng.randrange(1, 3) + [b"y"] * rng.randrange(3)
        text = [w if rng.random() > 0.05 else b"z" for w in text][rng.randrange(3):]
        every = [(similarity(item, text[i:j]), -i) for i in range(len(text)) for j in range(i + 5, len(text) + 1)]
        want = max(every, default=(0.0, 0))
        got, first = decontamination.best_run(item, text)
        assert abs(got - want[0]) < 1e-12 or want[0] < decontamination.SIMILARITY
        assert got < decontamination.SIMILARITY or abs(plain_best(b" ".join(item).decode(), b" ".join(text).decode()) - got) < 1e-12


def test_passages_in_odd_rows(spark, docs_of, odd_rows, no_docs):
    bench = [(i, words(100 + i, 15 + 3 * i, 3000)) for i in range(14)] + [(50, None), (51, ""), (52, "too few words"), (53, words(7, 5, 3000)), (54, words(8, 500, 3000)), (54, words(8, 500, 3000))]
    one = dict(bench[:14])
    rows = odd_rows + [(100 + i, f"{words(i, 50)}\n{t.upper()} {words(i + 1, 20)}") for i, t in one.items()]
    rows += [(200, one[3]), (201, one[9].replace("x ", "x  ", 4)), (202, " ".join(one[13].split()[:-2]) + " changed end"), (203, words(8, 500, 3000)), (204, bench[17][1])]
    rows += [(300, " ".join(one[12].split()[:20])), (301, words(77, 400, 3000)), (302, one[5] + " " + one[5] + " " + one[6])]
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs_of(rows), items_of(spark, bench)).collect()}
    want = {}
    for i, t, *_ in rows:
        for j, item in bench:
            if len(decontamination.split_words(item)) >= 5 and plain_best(item, t if i != 4 else None) >= decontamination.SIMILARITY:
                want[i, j] = plain_best(item, t)
    assert set(got) == set(want)
    assert all(abs(got[k].similarity - want[k]) < 1e-12 for k in want if want[k] == 1.0)
    assert got[200, 3].first_word == 0 and got[100, 0].first_word == 50 and got[302, 5].first_word == 0
    clean = decontamination.clean_documents(docs_of(rows), items_of(spark, bench))
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {i for i, _ in want}
    assert decontamination.contaminated(no_docs, items_of(spark, bench)).count() == 0
    assert decontamination.contaminated(docs_of(rows), items_of(spark, bench).where("false")).count() == 0


def test_blocks_of_items_give_the_same(spark, docs_of, monkeypatch):
    bench = [(i, words(100 + i, 30, 3000)) for i in range(7)]
    rows = [(i, f"{words(i, 40)} {bench[i % 7][1]} {words(i, 9)}") for i in range(20)]
    whole = decontamination.contaminated(docs_of(rows), items_of(spark, bench)).collect()
    monkeypatch.setattr(decontamination, "ITEMS_PER_PASS", 3)
    assert sorted(decontamination.contaminated(docs_of(rows), items_of(spark, bench)).collect()) == sorted(whole) and len(whole) == 20


def edited_copies(length, edits, n):
    """Items and texts that hold a copy of them with changed words, at the text's end in every other one, alike by the plain search."""
    rng = random.Random(length)
    items, texts = [], []
    while len(items) < n:
        item = words(rng.randrange(2**40), length, 3000)
        copy = item.split()
        for at in rng.sample(range(length), edits):
            copy[at] = f"edited{rng.randrange(10**6)}"
        text = f"{words(len(items), 15, 3000)} {' '.join(copy)} {words(len(items) + 1, 15 * (len(items) % 2), 3000)}"
        if plain_best(item, text) >= decontamination.SIMILARITY:
            items.append((len(items), item))
            texts.append(text)
    return items, texts


def test_edited_copies_are_found():
    """Recall against the plain search, at item lengths that are a window's size (51, 97, 200) and others."""
    sizes = decontamination.window_sizes()
    assert {51, 97, 200} <= set(sizes) and not {30, 49, 59} & set(sizes)
    for length, edits in ((30, 1), (49, 1), (51, 1), (59, 1), (97, 2), (200, 4)):
        items, texts = edited_copies(length, edits, 200 if length < 97 else 60)
        found = {(t, i): s for t, i, _, s in decontamination.find_passages(pa.array(texts, pa.large_string()), decontamination.Index(items))}
        assert sum((i, i) in found for i, _ in items) >= 0.95 * len(items), length
        assert all(s >= plain_best(items[i][1], texts[t]) - 1e-12 for (t, i), s in found.items())


def shortened_recall(length, where, n=40):
    """Share of copies without their first or last tenth that are found, of those alike by the plain search."""
    items = [(i, words(7000 * length + i, length, 3000)) for i in range(n)]
    texts = []
    for i, item in items:
        w, cut = item.split(), length // 10
        copy = " ".join(w[cut:] if i % 2 else w[:-cut])
        texts.append({"alone": copy, "start": f"{copy} {words(i, 60, 3000)}", "end": f"{words(i, 60, 3000)} {copy}", "middle": f"{words(i, 60, 3000)} {copy} {words(i + 1, 60, 3000)}"}[where])
    alike = [i for i, item in items if plain_best(item, texts[i]) >= decontamination.SIMILARITY]
    found = {(t, i) for t, i, *_ in decontamination.find_passages(pa.array(texts, pa.large_string()), decontamination.Index(items))}
    return sum((i, i) in found for i in alike) / len(alike), len(alike)


@pytest.mark.parametrize("where", ["alone", "start", "middle", "end"])
def test_shortened_copies_are_found(where):
    for length in (20, 51, 63, 80, 97, 121, 151, 200, 260):
        share, n = shortened_recall(length, where)
        assert n == 40 and share >= 0.9, (length, share, n)


def test_precheck_lets_every_alike_passage_through():
    rng = random.Random(3)
    items = [(i, words(i, 12 + 5 * i, 30)) for i in range(8)]  # few words, so shingles repeat
    index = decontamination.Index(items)
    for at, (_, item) in enumerate(index.items):
        for _ in range(40):
            copy = [w if rng.random() > 0.03 else b"other" for w in item]
            text = b" ".join([b"before", *copy, b"after"]).decode()
            hashes, *_ = decontamination.words_of(pa.array([text], pa.large_string()))
            passed = decontamination.may_be_alike(index, at, np.array([1]), np.array([1 + len(item)]), decontamination.shingle_hashes(hashes, 5))[0]
            assert passed or similarity(item, copy) < decontamination.SIMILARITY


def test_long_items_fill_a_block_sooner(monkeypatch):
    monkeypatch.setattr(decontamination, "ITEMS_PER_PASS", 4)
    rows = [Row(item_id=i, text=words(i, n)) for i, n in enumerate((30, 30, 500, 2000, 30, 30))]
    assert [[i for i, _ in b] for b in decontamination._blocks(iter(rows))] == [[0, 1, 2], [3], [4, 5]]


def notices(spark, rows):
    return spark.createDataFrame(rows, "template_id long, text string").withColumn("size", F.lit("clash"))


def plain_contained(template, text):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    t, d = split(template), split(text)
    k = min(5, len(t))
    own = {tuple(t[i:i + k]) for i in range(len(t) - k + 1)}
    step = max(1, len(t) // 2)
    best = 0.0
    for at in range(0, max(0, len(d) - len(t)) + 1, step):
        w = d[at:at + len(t) + step - 1]
        best = max(best, len(own & {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}) / len(own))
    return best


def test_notices_in_odd_rows(spark, docs_of, odd_rows, no_docs):
    templates = LICENSE_NOTICES + [(20, None), (21, " ... "), (22, "Copyright")]
    rng = random.Random(6)
    rows = list(odd_rows)
    for i, t in LICENSE_NOTICES:
        rows.append((100 + i, f"{words(i, rng.randrange(60))} {t.upper()} {words(i, 30)}"))
        rows.append((120 + i, t))
        changed = t.split()
        changed[len(changed) // 2] = "else"
        rows.append((140 + i, words(i, 9) + " " + " ".join(changed)))
    rows += [(200, "COPYRIGHT 2020, licence"), (201, "the license of all reserved rights"), (202, "All rights reserved. " * 3)]
    got = {(r.doc_id, r.template_id): r.contained for r in license_scan.scan(docs_of(rows), notices(spark, templates)).collect()}
    want = {}
    for i, t, *_ in rows:
        for j, template in templates:
            if re.search(r"[^\W_]", template or "") and i != 4 and (c := plain_contained(template, t)) >= license_scan.CONTAINED:
                want[i, j] = c
    assert got == want and len(want) > 20
    assert license_scan.scan(no_docs, notices(spark, templates)).count() == 0
    assert license_scan.scan(docs_of(rows), notices(spark, templates).where("false")).count() == 0


def test_short_texts_and_blocks_of_templates(spark, docs_of, monkeypatch):
    """Texts shorter than their template, rows that share an id, many templates in blocks, and no search for the needed words."""
    templates = LICENSE_NOTICES + [(100 + i, words(i, 40, 5000)) for i in range(60)]
    rows = []
    for j, (i, t) in enumerate(templates):
        t = t.split()
        cut = max(1, len(t) // 12)
        rows += [(4 * j, " ".join(t[cut:])), (4 * j, words(j, 30, 5000)), (4 * j + 1, " ".join(t[:-cut])), (4 * j + 2, f"{words(j, 30)} {' '.join(t[:-cut])}"), (4 * j + 3, f"{' '.join(t[cut:])} {words(j, 9)}")]
    want = {}
    for i, t in rows:
        for j, template in templates:
            if (c := plain_contained(template, t)) >= license_scan.CONTAINED:
                want[i, j] = max(want.get((i, j), 0), c)
    assert len(want) > 200
    for block, searched in ((5000, 200), (5000, 0), (300, 200), (1, 200)):
        monkeypatch.setattr(license_scan, "BLOCK_WORDS", block)
        monkeypatch.setattr(license_scan, "SEARCHED_WORDS", searched)
        if block == 1:
            templates = templates[:8]
            want = {k: v for k, v in want.items() if k[1] in dict(templates)}
        got = {(r.doc_id, r.template_id): r.contained for r in license_scan.scan(docs_of(rows), notices(spark, templates)).collect()}
        assert got == want


def test_anchors_are_in_every_text_that_can_match():
    rng = random.Random(8)
    for _, template in LICENSE_NOTICES:
        t = re.findall(r"[^\W_]+", template.lower())
        k = min(5, len(t))
        chosen = license_scan.anchors(t, k, dict.fromkeys(t, 1))
        own = sorted({tuple(t[i:i + k]) for i in range(len(t) - k + 1)})
        for _ in range(50):
            held = rng.sample(own, -(-len(own) * 4 // 5))
            assert any(chosen & set(s) for s in held)


def test_no_python_in_the_license_plan(spark, docs_of):
    plan = license_scan.scan(docs_of([(1, "x")]).select("doc_id", "text"), spark.range(1).selectExpr("id as template_id", "'All rights reserved' as text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
