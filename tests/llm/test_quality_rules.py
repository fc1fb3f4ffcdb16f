"""Base statistics and outlier verdicts against plain versions."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from texts import words

from muralog.llm import quality_rules


def plain_statistics(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i:i + 3]) for i in range(len(found) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_statistics(docs_of, odd_rows):
    rng = random.Random(2)
    rows = odd_rows + [(100 + i, "".join(rng.choice(["a ", "b ", "c", "\n", "é# ", "\x0b", "a b c ", "😀", "\x85", "<|>"]) for _ in range(rng.randrange(80)))) for i in range(60)]
    rows += [(300, "x " * 3000), (301, "one two three one two three"), (302, "one two three four one two three")]
    got = quality_rules.base_table(docs_of(rows)).collect()
    want = sorted(((r[0], *plain_statistics(r[1])) for r in rows), key=str)
    assert sorted(((r.doc_id, *[r[c] for c in COLUMNS]) for r in got), key=str) == want


def more_statistics(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return sum(c.isalpha() for c in text or ""), len(set(found))


# Chi-square with four degrees: median, 97.5 %, and what is exceeded with a chance of 10^-12.
MEDIAN, MOST, CUT = 3.35669398, 11.14328678, 62.2003


def lower_median(values):
    return np.sort(values, axis=0)[-(-len(values) // 2) - 1]


def plain_verdicts(texts):
    """The same estimate with numpy, for one group with four live coordinates."""
    table = np.array([(*plain_statistics(t), *more_statistics(t)) for t in texts], float)
    n, chars, _, _, repeats, letters, new = table.T
    failed = (n < 50) | (100 * repeats > 50 * n)
    n = np.maximum(n, 1)
    z = np.column_stack([np.log((chars + 1) / n), np.log((chars - letters + 1) / (letters + 1)), np.log((new + 1) / (n - new + 1)), np.log(n)])
    off = (z - lower_median(z[~failed])) * np.sqrt(n / (n + 400))[:, None]
    t = off / (1.4826 * lower_median(np.abs(off[~failed])))
    inside = t[~failed]
    distance = lambda rows, mean, cov: np.einsum("ij,jk,ik->i", rows - mean, np.linalg.inv(cov), rows - mean)
    best = None
    shapes = [np.eye(4), np.cov(np.tanh(inside).T, bias=True), np.cov((inside / np.linalg.norm(inside, axis=1)[:, None]).T, bias=True)]
    for shape in shapes:
        mean, cov = np.zeros(4), shape
        for _ in range(quality_rules.STEPS):
            bins = np.floor(np.log(distance(inside, mean, cov) + 1e-3) / quality_rules.BIN)
            core = inside[bins <= np.sort(bins)[int(np.ceil(len(bins) * quality_rules.CORE)) - 1]]
            mean, cov = core.mean(axis=0), np.cov(core.T, bias=True)
        if best is None or np.linalg.det(cov) < np.linalg.det(best[1]):
            best = mean, cov
    mean, cov = best
    near = inside[distance(inside, mean, cov) * MEDIAN / lower_median(distance(inside, mean, cov)) <= MOST]
    mean, cov = near.mean(axis=0), np.cov(near.T, bias=True)
    return ~failed & (distance(t, mean, cov) * MEDIAN / lower_median(distance(inside, mean, cov)) <= CUT)


def test_verdicts_are_those_of_a_plain_estimate(docs_of):
    rows = [(i, words(i, 60 + i % 200, 3000) + (" ### %%% ***" * 40 if i % 11 == 0 else " #" if i % 5 == 0 else "")) for i in range(220)]
    rows += [(500 + i, "\n".join(["a line that is said again and again"] * i + [words(i, 100, 3000)])) for i in range(12)]
    got = {r.doc_id: r for r in quality_rules.judge(docs_of(rows)).collect()}
    want = plain_verdicts([t for _, t in rows])
    assert [got[i].kept for i, _ in rows] == want.tolist()
    assert not any(got[i].kept for i in range(0, 220, 11)) and sum(r.kept for r in got.values()) > 190


def test_chi_square_quantiles():
    assert [quality_rules.chi_square(0.5, k) for k in (1, 2, 3, 4)] == pytest.approx([0.454936, 1.386294, 2.365974, 3.356694], abs=1e-5)
    assert quality_rules.chi_square(0.025, 4) == pytest.approx(MOST, abs=1e-6) and quality_rules.chi_square(1e-12, 4) == pytest.approx(CUT, abs=1e-3)


def prose(seed, n, vocabulary, marks):
    """Words from a vocabulary with stops: both of them differ between the groups."""
    rng = random.Random(seed)
    return " ".join(f"{'ab' * rng.randrange(1, 4)}{'cdefghij'[rng.randrange(8)]}{rng.randrange(vocabulary):x}".translate(str.maketrans("0123456789", "klmnopqrst")) + ("," if rng.random() < marks else "") for _ in range(n))


def test_groups_judge_alike_texts_differently(docs_of):
    """One source writes with many stops and of widely differing kinds, another hardly uses any: one text is ordinary in one of them only."""
    rows = [(i, prose(i, 100 + i % 90, 3000, 0.1 * 9 ** (i % 7 / 6)), "en", "wide") for i in range(150)]
    rows += [(1000 + i, prose(i + 500, 100 + i % 90, 3000, 0.3), "en", "narrow") for i in range(150)]
    asked = prose(7777, 170, 3000, 0.95)
    got = {r.doc_id: r.kept for r in quality_rules.judge(docs_of(rows + [(5000, asked, "en", "wide"), (5001, asked, "en", "narrow")])).collect()}
    assert got[5000] and not got[5001]
    assert sum(got[i] for i in range(150)) >= 130 and sum(got[1000 + i] for i in range(150)) >= 145


def test_the_estimate_is_not_drawn_by_outliers(spark):
    """A fifth of the members lies together elsewhere; a coordinate without spread is left out; no group changes another's."""
    rng = np.random.default_rng(3)
    shape = np.array([[2.0, 0.5, 0, 0], [0, 1.0, 0.3, 0], [0, 0, 0.5, 0], [0.2, 0, 0, 1.5]])
    clean, far = rng.standard_normal((400, 4)) @ shape, rng.standard_normal((100, 4)) * 0.1 + 30
    flat = rng.standard_normal((300, 4)) * [1, 2, 0, 1]
    rows = [("a", *map(float, x)) for x in [*clean, *far]] + [("b", *map(float, x)) for x in flat] + [("c", 1.0, 2.0, 3.0, 4.0)] * 60
    members = spark.createDataFrame(rows, "group string, t0 double, t1 double, t2 double, t3 double")
    found = {r.group: r for r in quality_rules.robust_estimates(members).collect()}
    assert [found[g].dims for g in "abc"] == [4, 3, 0]
    precision = np.array([[found["a"][f"p{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)])
    covariance = np.linalg.inv(precision)
    truth = shape.T @ shape
    assert np.abs(covariance - truth).max() < 0.35 * np.abs(truth).max() and max(abs(found["a"][f"m{i}"]) for i in range(4)) < 0.5
    assert found["b"].p22 == found["b"].p02 == 0 and abs(1 / found["b"].p11 - 4) < 1.5


def test_groups_nulls_and_small_groups(docs_of, odd_rows, no_docs):
    rows = odd_rows + [(100 + i, prose(i, 60 + i % 50, 3000, 0.2), "en", f"s{i % 40}") for i in range(120)] + [(900, prose(1, 80, 3000, 0.2) + " ###" * 60, "en", "s1")]
    rows += [(1000 + i, prose(2000 + i, 60 + i % 50, 3000, 0.2), f"l{i}", "rare") for i in range(60)] + [(1900, prose(1, 80, 3000, 0.2) + " ###" * 60, "l7", "rare")]
    got = quality_rules.judge(docs_of(rows)).collect()
    assert len(got) == len(rows)
    verdict = {}
    for r in got:
        verdict.setdefault(r.doc_id, []).append((r.base_failed, r.kept))
    assert verdict[1] == verdict[2] == verdict[3] == [(True, False)]
    assert verdict[5][0] == verdict[5][1]
    assert sum(verdict[100 + i] == [(False, True)] for i in range(120)) >= 117
    assert verdict[900] == [(False, False)]  # found by the language's small sources together
    # And by small languages together.
    assert sum(verdict[1000 + i] == [(False, True)] for i in range(60)) >= 57 and verdict[1900] == [(False, False)]
    assert quality_rules.judge(no_docs).count() == 0
    kept = quality_rules.kept_documents(docs_of(rows))
    assert kept.columns == docs_of(rows).columns and kept.where("doc_id is null").count() == 1
    assert kept.where("doc_id in (1, 2, 3, 900)").count() == 0


def test_inverse_of_a_matrix(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(0)
    a = rng.normal(size=(6, 4))
    matrix = a.T @ a
    columns, determinant = quality_rules._inverse({(i, j): F.lit(float(matrix[i, j])) for i, j in quality_rules.PAIRS})
    row = spark.range(1).select(*[c.alias(f"p{i}{j}") for (i, j), c in columns.items()], determinant.alias("det")).first()
    assert row["det"] == pytest.approx(np.linalg.det(matrix))
    for i, j in quality_rules.PAIRS:
        assert row[f"p{i}{j}"] == pytest.approx(np.linalg.inv(matrix)[i, j])


def test_no_python_in_the_plan(docs_of):
    base = quality_rules.base_table(docs_of([(1, "x")]).drop("n"))
    plan = base._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
