"""Spelling variants against pairing every word with every other."""

from __future__ import annotations

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from muralog.llm import spelling
from muralog.llm.queries import op11_spelling_variants

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, least_chars, least_n, slip):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(UPPER)
            if slip:
                h = crc32(f"{'' if doc is None else doc}:{word}".encode())
                if h % slip == 0:
                    word = word[:h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_chars and n >= least_n}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(rows, least_chars=7, least_n=2, ratio=10, slip=None):
    words = plain_counts(rows, least_chars, least_n, slip)
    shares = {}  # only words that share a text with one letter replaced by a blank or left out can be near
    for w in words:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w))), *(w[:i] + " " + w[i + 1:] for i in range(len(w)))}:
            shares.setdefault(key, []).append(w)
    keys = {w: {w, *(w[:i] + w[i + 1:] for i in range(len(w))), *(w[:i] + " " + w[i + 1:] for i in range(len(w)))} for w in words}
    near = {w: {o for key in keys[w] for o in shares[key] if one_edit(w, o)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def rows_of(df):
    assert df.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    found = [tuple(r)[:6] for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def misspelled(rng, word):
    at = rng.randrange(len(word)) if len(word) > 1 else 0
    letter = rng.choice("abcxyzéÿ")
    return rng.choice([word[:at] + word[at + 1:] or word, word[:at] + letter + word[at:], word[:at] + letter + word[at + 1:], word + letter, letter + word])


def corpus(seed, least=7):
    """Words of few syllables, so that many are near, and chains of ever rarer misspellings."""
    rng = random.Random(seed)
    syllables = ["an", "ti", "on", "the", "er", "é", "ing", "ou", "a"]
    rows = []
    for doc in range(60):
        rows.append((doc, " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(2, 6))) for _ in range(200))))
    for k in range(20):
        word = "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(least, least + 6)))
        for n in (300, 30, 3):
            rows.append((100 + k, f"{word}, " * n))
            word = misspelled(rng, word)
    return rows


@pytest.mark.parametrize("least, slip", [(7, None), (7, 31), (2, 5), (4, 3)])
def test_matches_pairing(docs_of, least, slip):
    rows = corpus(least, least)
    ours = rows_of(spelling.variants(docs_of(rows), least_chars=least, slip=slip))
    theirs = plain_variants(rows, least_chars=least, slip=slip)
    assert ours == theirs and any(r[2] != r[1] and r[1] for r in theirs)


@pytest.mark.parametrize("most, least, longest", [(10, 1, 8), (1000, 3, 2), (100_000, 100_000, 8), (100_000, 1, 30)])
def test_pairs_do_not_depend_on_the_dictionary(spark, most, least, longest):
    """Whatever grams are held, no pair is lost; the dictionary stays within its bound."""
    words = random.Random(2).sample(sorted(plain_counts(corpus(3), 5, 1, None)), 1200)
    table = spark.createDataFrame([(w,) for w in words], "word string")
    held, frequent = spelling.gram_dictionary(table, most, least, longest)
    assert len(held) <= most and all(n > frequent for n in held.values())
    ours = {(r.word, r.other) for r in spelling.near_pairs(table, most, least, longest).collect()}
    assert ours == {(a, b) for a in words for b in words if a != b and abs(len(a) - len(b)) < 2 and one_edit(a, b)}


def test_probes_are_apart_and_listed():
    """The two grams share no letter, and what an edit leaves alone is a gram of the edited word."""
    rng = random.Random(1)
    held = {g: 50 for g in ("a", "b", "ab", "ba", "aa", "aba", "abab")}
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(2, 12)))
        (a, b), (c, d) = spelling.probes(word, held, 20)
        assert b <= c
        other = misspelled(rng, word)
        if len(other) < len(word) or other == word:
            continue
        grams = {gram for caps in (spelling.caps(len(other)), spelling.caps(len(other) - 1)) for gram in spelling.decompose(other, held, *caps)}
        assert (other[:b] == word[:b] and any(y == b for _, y in grams)) or (other[len(other) - len(word) + c:] == word[c:] and any(
            x == len(other) - len(word) + c for x, _ in grams))


def test_no_join_is_broadcast(docs_of, monkeypatch):
    """Spark sizes the tables of words by their compressed files; a join that went by that would collect the index at the driver."""
    plans, write = [], spelling.stage

    def seen(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(spelling, "stage", seen)
    rows = corpus(5)
    out = spelling.variants(docs_of(rows), slip=31)
    assert rows_of(out) == plain_variants(rows, slip=31)
    plans.append(out._jdf.queryExecution().executedPlan().toString())  # as it was run, joins may be changed until then
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def test_odd_rows(docs_of, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows] + [(50, "Änderung, änderung ÄNDERUNG ×÷×÷×÷× ×÷×÷×÷× Überlänge überlänge"), (None, "wörtlich " * 12 + "worttlich wortlich wortlich")]
    assert rows_of(spelling.variants(docs_of(odd_rows + rows[len(odd_rows):]), least_chars=2, slip=3)) == plain_variants(rows, least_chars=2, slip=3)
    assert spelling.variants(no_docs).collect() == []
    with pytest.raises(ValueError):
        spelling.variants(no_docs, least_chars=1)


def test_query(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.01", "sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(op11_spelling_variants(spark, sf_dir)) == plain_variants(rows, slip=31)
