"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to `DEPTH` bytes. The probability of a byte after a
context is that of PPM with escape method C: `n / (total + distinct)` if it was seen there, and
otherwise the escape probability `distinct / (total + distinct)` times its probability after the
context that is one byte shorter; below the empty context all 256 bytes are alike. The statistics are
frozen after training, so the code length of a text is exact and does not depend on other texts. A
context begins at the blank before a word at the earliest: a word's code length is then the same
wherever it stands and is worked out once per distinct word. The language with the shortest code wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muralog.llm.words import Memo, slices

DEPTH = 3
# Documents per language, about, that the trees are grown from: chosen by a hash of the id.
TRAIN_DOCS = 4000
UNKNOWN = "und"


def word_array(texts: pa.Array) -> pa.Array:
    """Lists of lower-cased words, each with a blank before it (and, as the last symbol, after it)."""
    return pc.split_pattern(pc.utf8_lower(pc.replace_substring(texts, "\n", " ")), " ")


def symbols(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol of each word: the number of its word, its place in it from 1, and the last DEPTH+1 bytes."""
    spelled = [b" %b " % w.encode() for w in words]
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    data = np.frombuffer(b"".join(spelled), np.uint8).astype(np.int64)
    word = np.repeat(np.arange(len(spelled)), lengths)
    place = np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    recent = np.zeros(len(data), np.int64)
    for back in range(DEPTH + 1):
        there = place >= back
        recent[there] |= data[np.flatnonzero(there) - back] << (8 * back)
    return word, place, recent


def key_of(recent: np.ndarray, length: int) -> np.ndarray:
    """One number for the last `length` bytes."""
    return recent & ((1 << (8 * length)) - 1) | length << 40


def sequence_counts(docs: DataFrame) -> DataFrame:
    """`lang`, `key`, `n`: how often each byte sequence of up to DEPTH+1 bytes occurs in words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                langs = rows.column("lang").dictionary_encode()
                for i, lang in enumerate(langs.dictionary.to_pylist()):
                    texts = rows.column("text").filter(pc.equal(langs.indices, i))
                    counted = word_array(texts).flatten().value_counts()
                    times = np.asarray(counted.field("counts"))
                    word, place, recent = symbols(counted.field("values").to_pylist())
                    for length in range(1, DEPTH + 2):
                        at = place >= max(1, length - 1)  # the first blank is context only
                        keys, which = np.unique(key_of(recent[at], length), return_inverse=True)
                        n = np.bincount(which, times[word[at]], minlength=len(keys)).astype(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)], ["lang", "key", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Trees:
    """The context trees of all languages over the union of their byte sequences."""

    def __init__(self, languages: list[str], keys: np.ndarray, counts: np.ndarray) -> None:
        """`keys` ascending; `counts` by key and language."""
        self.name, self.languages, self.keys = uuid.uuid4().hex, languages, keys
        length, tail = keys >> 40, keys & ((1 << 40) - 1)
        shorter = [self._find(tail & ((1 << (8 * k)) - 1) | k << 40) for k in range(DEPTH + 1)]
        # Totals of a context are those of its own continuations.
        total, distinct = np.zeros_like(counts, dtype=float), np.zeros_like(counts, dtype=float)
        root_total, root_distinct = counts[length == 1].sum(axis=0), (counts[length == 1] > 0).sum(axis=0)
        for k in range(2, DEPTH + 2):
            own = np.flatnonzero(length == k)
            context = self._find((tail[own] >> 8) | (k - 1) << 40)
            there = context >= 0
            np.add.at(total, context[there], counts[own[there]])
            np.add.at(distinct, context[there], counts[own[there]] > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.escape = np.where(total > 0, np.log2((total + distinct) / np.maximum(distinct, 1)), 0.0)
            self.root_escape = np.log2((root_total + root_distinct) / np.maximum(root_distinct, 1)) + 8.0
        self.cost = np.empty(counts.shape)
        for k in range(1, DEPTH + 2):
            own = np.flatnonzero(length == k)
            if k == 1:
                whole, kinds, below, leave = root_total, root_distinct, self.root_escape, 0.0
            else:
                context = self._find((tail[own] >> 8) | (k - 1) << 40)
                there = (context >= 0)[:, None]
                whole, kinds = np.where(there, total[context], 0), np.where(there, distinct[context], 0)
                below, leave = self.cost[shorter[k - 1][own]], np.where(there, self.escape[context], 0.0)
            with np.errstate(divide="ignore", invalid="ignore"):
                seen = np.log2((whole + kinds) / counts[own])
            self.cost[own] = np.where(counts[own] > 0, seen, leave + below)

    def _find(self, wanted: np.ndarray) -> np.ndarray:
        """Where the keys are, or -1."""
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, at, -1)

    def code_lengths(self, words: list[str]) -> np.ndarray:
        """Bits of each word by language: all its bytes and the blank that ends it."""
        out = np.zeros((len(words), len(self.languages)))
        for i in range(0, len(words), 20_000):
            part = words[i:i + 20_000]
            word, place, recent = symbols(part)
            found = {k: self._find(key_of(recent, k)) for k in range(1, DEPTH + 2)}
            bits = np.zeros((len(word), len(self.languages)))
            open_ = place >= 1
            for k in range(DEPTH + 1, 0, -1):
                own = open_ & (place >= k - 1)
                hit = own & (found[k] >= 0)
                bits[hit] += self.cost[found[k][hit]]
                open_ = open_ & ~hit
                if k > 1:  # leave the context of k - 1 bytes, where a language knows it
                    missed = np.flatnonzero(own & ~hit)
                    context = found[k - 1][missed - 1]
                    known = context >= 0
                    bits[missed[known]] += self.escape[context[known]]
            bits[open_] += self.root_escape
            first = np.flatnonzero(place == 0)
            if len(first):
                out[i:i + len(part)] = np.add.reduceat(bits, first, axis=0)
        return out


class Speller:
    """Code lengths of distinct words, kept by the worker from task to task for one set of trees."""

    _per_worker: dict[str, Speller] = {}

    @classmethod
    def of(cls, trees: Trees) -> Speller:
        if trees.name not in cls._per_worker:
            cls._per_worker.clear()
            cls._per_worker[trees.name] = cls(trees)
        return cls._per_worker[trees.name]

    def __init__(self, trees: Trees) -> None:
        self._width = len(trees.languages)
        self._memo = Memo(lambda words: (np.full(len(words), self._width), trees.code_lengths(words).ravel()), np.float64)

    def bits(self, texts: pa.Array) -> np.ndarray:
        """Code length of each text by language."""
        lists = word_array(texts)
        starts, _, flat = self._memo.lookup(lists.flatten())
        ends = np.cumsum(np.asarray(pc.list_value_length(lists)), dtype=np.int64)
        out = np.zeros((len(texts), self._width))
        for j in range(self._width):
            running = np.concatenate([[0.0], np.cumsum(flat[starts + j], dtype=float)])
            out[:, j] = np.diff(running[np.concatenate([[0], ends])])
        return out


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, by remainder 0. No id: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Trees | None:
    """Trees from about `train_docs` documents per language, all bytes of their texts; None without a labelled text."""
    known = docs.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()  # one row per language
    if not sizes:
        return None
    share = F.create_map(*[x for r in sizes for x in (F.lit(r.lang), F.lit(min(1.0, train_docs / r.n)))])
    chosen = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 40)) < F.element_at(share, F.col("lang")) * float(1 << 40)
    rows = sequence_counts(known.where(chosen)).toArrow()
    languages = [r.lang for r in sizes]
    keys, at = np.unique(np.asarray(rows.column("key")), return_inverse=True)
    if not len(keys):
        return None
    counts = np.zeros((len(keys), len(languages)), np.int64)
    column = np.array([languages.index(x) for x in rows.column("lang").combine_chunks().dictionary_encode().dictionary.to_pylist()])
    counts[at, column[np.asarray(rows.column("lang").combine_chunks().dictionary_encode().indices)]] = np.asarray(rows.column("n"))
    return Trees(languages, keys, counts)


def predict(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """`doc_id`, `held_out`, `lang_pred`, `score` of every whole text.

    `score` is the share of the predicted language in `2 ** -bits` over all languages. A NULL text, one
    without a letter, and any text if there are no trees gives `und` with score 0. Between equally short
    codes the language that comes first in the alphabet wins. Repeated rows are predicted alike.
    """
    languages = [*(trees.languages if trees else []), UNKNOWN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, limit=4 << 20):
                texts = rows.column("text")
                best, score = np.full(len(texts), len(languages) - 1), np.zeros(len(texts))
                if trees:
                    lettered = np.asarray(pc.match_substring_regex(texts, r"\p{L}"))
                    bits = Speller.of(trees).bits(texts)
                    winner = bits.argmin(axis=1)
                    shares = np.exp2(np.maximum(-1000.0, bits.min(axis=1, keepdims=True) - bits))
                    best[lettered] = winner[lettered]
                    score[lettered] = (1 / shares.sum(axis=1))[lettered]
                yield pa.RecordBatch.from_arrays([
                    *[rows.column(c) for c in ("doc_id", "held_out")], pa.array([languages[i] for i in best], pa.string()), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learn from the documents that are not held out and have a language; predict all."""
    return predict(docs, train(docs.where(~held_out(F.col("doc_id"))), train_docs))
