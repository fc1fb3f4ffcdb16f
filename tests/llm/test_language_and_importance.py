"""Language models against plain probabilities, importance weights against plain counting."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from texts import words

from muralog.llm import hashing, importance, language_id

SYLLABLES = {"aa": ["ka", "ru", "mi", "to"], "bb": ["sch", "ung", "heit", "ö"], "cc": ["ka", "ung", "que", "é"]}


def prose(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def plain_bits(counts, word):
    """Code length of one word by PPM with escape method C, straight from the definition."""

    def probability(context, byte):
        seen = {k[-1]: n for k, n in counts.items() if len(k) == len(context) + 1 and k[:-1] == context}
        total = sum(seen.values())
        if byte in seen:
            return seen[byte] / (total + len(seen))
        escape = len(seen) / (total + len(seen)) if seen else 1.0
        return escape * (probability(context[1:], byte) if context else 1 / 256)

    spelled = b" " + word.encode() + b" "
    return sum(-math.log2(probability(spelled[max(0, i - language_id.DEPTH):i], spelled[i])) for i in range(1, len(spelled)))


def test_code_lengths_are_exact(docs_of):
    rows = [(i, prose(lang, i, 12), lang, "s") for i in range(8) for lang in SYLLABLES]
    trees = language_id.train(docs_of(rows))
    counts = {lang: Counter() for lang in SYLLABLES}
    for _, text, lang, _ in rows:
        for word in text.split(" "):
            spelled = b" " + word.encode() + b" "
            for i in range(1, len(spelled)):
                for length in range(1, min(i, language_id.DEPTH) + 2):
                    counts[lang][spelled[i + 1 - length:i + 1]] += 1
    kept = {lang: dict(c) for lang, c in counts.items()}
    # The trees keep a sequence's first bytes too where a language has seen them.
    tried = ["karu", "schung", "unggque", "zzz", "é", "", "ka-ru", "heitheitq"]
    got = trees.code_lengths(tried)
    for word, bits in zip(tried, got):
        for j, lang in enumerate(trees.languages):
            assert bits[j] == pytest.approx(plain_bits(kept[lang], word), abs=1e-6), (word, lang)


def test_languages_of_odd_and_held_out_rows(docs_of, odd_rows, no_docs):
    rows = [(i, prose(lang, i), lang, "s") for lang, at in zip(SYLLABLES, (0, 200, 400)) for i in range(at, at + 120)]
    odd = [(1000 + (r[0] or 0) if r[0] is not None else None, *r[1:]) for r in odd_rows] + [(2000, "12 34 !?", None, None)]
    got = defaultdict(list)
    for r in language_id.identify(docs_of([*rows, *[(r[0], r[1], None, None) for r in odd]])).collect():
        got[r.doc_id].append(r)
        assert 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    held = [(r, lang) for i, _, lang, _ in rows for r in got[i] if r.held_out]
    assert len(held) > 40 and np.mean([r.lang_pred == lang for r, lang in held]) >= 0.97
    for doc_id in (1001, 1002, 1003, 2000):
        assert [(r.lang_pred, r.score) for r in got[doc_id]] == [("und", 0.0)]
    assert len(got[1005]) == 2 and len(set(got[1005])) == 1
    assert language_id.identify(no_docs).count() == 0
    unlabelled = language_id.identify(docs_of([(1, "text", None, None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    texts = pa.array(["a Bc  a\n", "", "bC a", "x" * 5000 + " a", "a", "ü,ü"], pa.large_string())
    wanted = [t.lower().encode().split() for t in texts.to_pylist()]
    for block in (1 << 21, 3):
        monkeypatch.setattr(hashing, "BLOCK_BYTES", block)
        hashes, starts, stops, ends = hashing.words_of(texts)
        assert ends.tolist() == np.cumsum([len(w) for w in wanted]).tolist()
        flat = [w for ws in wanted for w in ws]
        assert all((hashes[i] == hashes[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def plain_tokens(text):
    import re

    # ASCII punctuation apart from words; other bytes are letters.
    return re.findall(rb"[!-/:-@\[-`{-~]+|[^\s!-/:-@\[-`{-~]+", (text or "").encode().lower())


def plain_weights(rows, labels):
    """Log weights by counting the n-grams themselves."""
    counts = []
    for _, text, *_ in rows:
        tokens = plain_tokens(text)
        counts.append(Counter((t,) for t in tokens) + Counter(zip(tokens, tokens[1:])))
    marks = defaultdict(list)
    for i, q, t in labels:
        marks[i].append(q == 1 and t in (0, None))
    good = {i for i, m in marks.items() if i is not None and all(m)}
    raw, target = Counter(), Counter()
    for (i, *_), c in zip(rows, counts):
        raw.update(c)
        if i in good:
            target.update(c)
    n_target = sum(r[0] in good for r in rows)
    scale = n_target / len(rows)
    surplus = (target.total() - raw.total() * scale) / n_target
    return [sum(n * (math.log(target[f] + importance.SMOOTHING) - math.log(raw[f] * scale + importance.SMOOTHING)) for f, n in c.items()) - surplus for c in counts]


def test_weights_are_those_of_plain_counting(spark, docs_of, odd_rows):
    rng = random.Random(3)
    rows = [(100 + i, words(i, 40, 60) + (" badword !!" if i % 4 == 0 else "")) for i in range(160)]
    rows += [(i, t and t[:9000], *rest) for i, t, *rest in odd_rows]
    labels = [(100 + i, int(i % 4 != 0), 0) for i in range(160) if rng.random() < 0.6] + [(None, 1, 0), (7, 1, None), (5, 1, 1), (5, 1, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    got = defaultdict(list)
    for r in importance.resample(docs_of(rows), frame).collect():
        got[r.doc_id].append(r)
    want = plain_weights(rows, labels)
    off = [min(abs(r.log_weight - weight) for r in got[doc_id]) / max(1, abs(weight)) for (doc_id, *_), weight in zip(rows, want)]
    # Two n-grams may share one of the million buckets, which moves the weights of the texts that hold them.
    assert sum(x < 1e-9 for x in off) >= 0.7 * len(rows) and max(off) < 0.2
    assert sum(r.kept for rs in got.values() for r in rs) >= round(importance.SHARE * len(rows)) and sum(map(len, got.values())) == len(rows)
    assert max(r.log_weight for i in range(0, 160, 4) for r in got[100 + i]) < max(r.log_weight for i in range(1, 160, 4) for r in got[100 + i])


def test_inclusion_follows_the_weights(spark):
    """Over many seeds the sample of one is drawn in proportion to the weights, and of two without replacement."""
    weights = [0.5, 1.0, 2.0, 4.0, 2.5]
    frame = spark.createDataFrame([(i, math.log(w)) for i, w in enumerate(weights)], "doc_id long, log_weight double")
    seeds = 3000
    keyed = [r for r in frame.crossJoin(spark.range(seeds).withColumnRenamed("id", "seed")).select("doc_id", "log_weight", "seed").collect()]
    noisy = spark.createDataFrame([(r.doc_id, r.log_weight, r.seed) for r in keyed], "doc_id long, log_weight double, seed long")
    # The operator's noise, with the seed as a column.
    uniform = (F.pmod(F.xxhash64("doc_id", F.col("seed").cast("int")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    one = importance.with_noise(noisy.where("seed = 7"), 7).select("doc_id", "key").collect()
    same = noisy.where("seed = 7").select("doc_id", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key")).collect()
    assert sorted(one) == sorted(same)
    ranks = defaultdict(list)
    for r in noisy.select("doc_id", "seed", (F.col("log_weight") - F.log(-F.log(uniform))).alias("key")).collect():
        ranks[r.seed].append((-r.key, r.doc_id))
    first, second = Counter(), Counter()
    for keys in ranks.values():
        keys.sort()
        first[keys[0][1]] += 1
        second[keys[0][1]] += 1
        second[keys[1][1]] += 1
    total = sum(weights)
    for i, w in enumerate(weights):
        p = w / total
        both = p + sum(v / total * w / (total - v) for j, v in enumerate(weights) if j != i)
        for got, want in ((first[i] / seeds, p), (second[i] / seeds, both)):
            assert abs(got - want) < 4 * math.sqrt(want * (1 - want) / seeds)


def test_sample_sizes_and_empty_tables(spark, docs_of, no_docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    docs = docs_of([(i, words(i, 30)) for i in range(50)])
    for share, n in ((0.4, 20), (0.0, 0), (1.0, 50)):
        assert importance.resample(docs, labels, share).where("kept").count() == n
    assert importance.resample(docs, labels.where("false"), 0.4).where("not kept").count() == 0
    assert importance.resample(no_docs, labels).count() == 0
    assert importance.kept_documents(docs, labels.where("false")).count() == 50
    # All texts are wanted: nothing but noise decides, and the sample still has its size.
    assert importance.resample(docs.where("doc_id < 9"), labels, 0.5).where("kept").count() == 4


def test_importance_query(spark, sf_dir):
    from muralog.llm.queries import op9_importance_resampling

    sf_dir = sf_dir.replace("sf0.01", "sf0.001")
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    got = {r.doc_id: r for r in op9_importance_resampling(spark, sf_dir).collect()}
    want = plain_weights(rows, labels)
    # Of a million buckets some are shared by two n-grams; each such one moves a weight a little.
    off = [abs(got[i].log_weight - w) / max(10, abs(w)) for (i, _), w in zip(rows, want)]
    assert len(got) == len(rows) and sorted(off)[len(off) // 2] < 0.05 and max(off) < 0.6
    least = min(r.log_weight for r in got.values() if r.kept)
    assert sum(r.kept for r in got.values()) == round(importance.SHARE * len(rows)) and least > sorted(want)[len(rows) // 20]


@pytest.mark.parametrize("few", [10_000, 7])
def test_kth_largest(spark, monkeypatch, few):
    monkeypatch.setattr(importance, "FEW", few)
    rng = random.Random(1)
    values = [rng.choice([1.5, 2.5, rng.gauss(0, 1e-3), rng.gauss(0, 1e6)]) for _ in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 77, 250, 500):
        assert importance.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]
