"""Benchmark passages in documents: SimHash windows of item size, Hamming blocks, exact check.

Texts are lower-cased (A-Z) words. A window's SimHash is the majority, bit by bit, over the hashes of
its five-word shingles. Window sizes are a geometric grid; an item is looked for with the largest size
that every passage alike to it can fill, so that a copy without its first or last words is found too, by
the fingerprints of its first, its middle and its last so many words. Every position of every document
is a window, so a copy of an item is always a window of distance 0.

A fingerprint has `BLOCKS` blocks. If two of them differ in at most `RADIUS` bits, they differ in at
most `RADIUS // BLOCKS` bits of some block, so looking up each block's value among the values near an
item's block finds every window within the radius. What is found is checked on the words themselves:
the sum of the smaller over the sum of the larger counts of each five-word shingle in item and passage,
for the run of words around the window, of whatever length, for which that is largest. A weighted
similarity of 0.8 is an expected distance of about 9.7 bits with a deviation of 2.9, so the radius
leaves nearly two deviations of room. A lossless filter comes first: a window is only looked up where
the words around it hold so many shingles of any items that a passage there can be alike.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from muralog.llm.hashing import shingle_hashes, text_bytes, words_of
from muralog.llm.words import expand, slices
from muralog.sources.scratch import broadcast_if_small, stage

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, RADIUS = 4, 15
STEP = 1.25
# Words in a window at most; counts of bits must fit in one byte. A longer item is looked for in parts.
LONGEST = 200
# Items that are searched for in one pass over the documents; a long one counts once per `LONGEST` words.
ITEMS_PER_PASS = 5_000
WINDOWS_AT_ONCE = 1 << 16


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles_of(words: list[bytes]) -> list[tuple[bytes, ...]]:
    return [tuple(words[i:i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def best_run(item: list[bytes], words: list[bytes]) -> tuple[float, int]:
    """The largest weighted Jaccard similarity of the item's shingles with those of a run of `words`, and where the run begins.

    The best run begins and ends with a shingle of the item. Where no shingle of the item repeats and none
    of the places that hold them is longer than the item, it begins where such a place does.
    """
    own, there = Counter(shingles_of(item)), shingles_of(words)
    known = [s in own for s in there]
    begins = [i for i, k in enumerate(known) if k and not (i and known[i - 1])]
    total = own.total()
    ends = [i for i, k in enumerate(known) if k and not (i + 1 < len(known) and known[i + 1])]
    if len(own) < total or any(e - b >= total for b, e in zip(begins, ends)):
        begins = [i for i, k in enumerate(known) if k]
    best = (0.0, 0)
    for begin in begins:
        met: Counter[tuple[bytes, ...]] = Counter()
        shared = 0
        for length, shingle in enumerate(there[begin:begin + int(total / SIMILARITY + 1e-9)], 1):
            if shingle in own:
                met[shingle] += 1
                shared += met[shingle] <= own[shingle]
                best = max(best, (shared / (total + length - shared), -begin))
    return best[0], -best[1]


def window_sizes() -> list[int]:
    sizes = [SHINGLE]
    while sizes[-1] < LONGEST:
        sizes.append(min(LONGEST, max(sizes[-1] + 1, int(sizes[-1] * STEP))))
    return sizes


def window_fingerprints(bits: np.ndarray, shingles: int) -> np.ndarray:
    """SimHash of each run of `shingles` rows, from running bit counts modulo 256."""
    counts = bits[shingles:] - bits[:-shingles]
    return np.packbits(counts > shingles // 2, axis=1, bitorder="little").view("<u8").reshape(-1)


def running_bits(hashes: np.ndarray) -> np.ndarray:
    """Running counts, modulo 256, of the set bits of consecutive hashes; one row more than hashes."""
    out = np.zeros((len(hashes) + 1, 64), np.uint8)
    np.cumsum(np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8, out=out[1:])
    return out


def reach(words: int) -> int:
    """How far an alike passage may begin from where the window puts the item: shared are at least `SIMILARITY` of its shingles."""
    return int((1 - SIMILARITY) * (words - SHINGLE + 1) + 1e-9)


def least_words(words: int) -> int:
    """The words that a passage alike to an item of so many words has at least."""
    return int(np.ceil(SIMILARITY * (words - SHINGLE + 1) - 1e-9)) + SHINGLE - 1


class Index:
    """Fingerprints of item parts by window size, with lists of the parts near each block value."""

    _per_worker: dict[str, Index] = {}

    @classmethod
    def of(cls, name: str, items: list[tuple[int, str | None]]) -> Index:
        """The worker's own index over these items, kept from task to task."""
        if name not in cls._per_worker:
            cls._per_worker.clear()
            cls._per_worker[name] = cls(items)
        return cls._per_worker[name]

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.items = [(i, w) for i, w in ((i, split_words(t)) for i, t in items) if len(w) >= SHINGLE]
        self.shingles: list[np.ndarray] = []  # distinct hashes of each item, in order
        parts: dict[int, list[tuple[int, int, int]]] = {}  # size: (item, offset of the window in it, fingerprint)
        sizes = np.array(window_sizes())
        for at, (_, words) in enumerate(self.items):
            hashes, *_ = words_of(pa.array([b" ".join(words).decode()], pa.large_string()))
            shingles = shingle_hashes(hashes, SHINGLE)
            self.shingles.append(np.unique(shingles))
            size = int(sizes[np.searchsorted(sizes, least_words(len(words)), side="right") - 1])
            fingerprints = window_fingerprints(running_bits(shingles), size - SHINGLE + 1)
            for offset in sorted({*range(0, len(words) - size + 1, LONGEST // 2), (len(words) - size) // 2, len(words) - size}):
                parts.setdefault(size, []).append((at, offset, int(fingerprints[offset])))
        self.sizes = {size: self._near(found) for size, found in sorted(parts.items())}
        self.widest = {size: max(len(self.items[at][1]) for at, *_ in found) for size, found in parts.items()}
        self.least = {size: min(len(self.items[at][1]) for at, *_ in found) for size, found in parts.items()}
        self._all = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.shingles]))
        self._tops = np.zeros(1 << 20, bool)
        self._tops[self._all >> np.uint64(44)] = True

    def known(self, shingles: np.ndarray) -> np.ndarray:
        """Which shingle hashes are those of any item."""
        out = self._tops[shingles >> np.uint64(44)]
        at = np.flatnonzero(out)
        out[at] = np.isin(shingles[at], self._all)
        return out

    def worth(self, shingles: np.ndarray) -> dict[int, np.ndarray]:
        """By window size: the windows with enough known shingles around for any passage that they can lead to."""
        shared = np.concatenate([[0], np.cumsum(self.known(shingles))])
        at, out = np.arange(len(shingles)), {}
        for size, widest in self.widest.items():
            around = widest + reach(widest)
            out[size] = shared[np.minimum(at + around, len(shingles))] - shared[np.maximum(at - around, 0)] >= SIMILARITY * (self.least[size] - SHINGLE + 1) - 1e-9
        return out

    def _near(self, found: list[tuple[int, int, int]]):
        item, offset = np.array([f[0] for f in found]), np.array([f[1] for f in found])
        prints = np.array([f[2] for f in found], np.uint64)
        width = 64 // BLOCKS
        flips = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), r)], np.uint32)
        tables = []
        for block in range(BLOCKS):
            own = (prints >> np.uint64(block * width)).astype(np.uint32) & ((1 << width) - 1)
            values = (own[:, None] ^ flips).reshape(-1)
            order = np.argsort(values, kind="stable")
            lengths = np.bincount(values, minlength=1 << width)
            tables.append((np.cumsum(lengths) - lengths, lengths, (order // len(flips)).astype(np.int32)))
        return item, offset, prints, tables

    def candidates(self, hashes: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, item, and the word at which the item would begin, for windows within the radius.

        `hashes` are the shingles at each word and `ends` the words up to each text's end.
        """
        width = 64 // BLOCKS
        worth = self.worth(hashes)
        any_size = np.zeros(len(hashes) + 2, np.int8)
        for mask in worth.values():
            any_size[1:-1] |= mask
        edges = np.flatnonzero(np.diff(any_size))
        runs = [(b, min(stop, b + WINDOWS_AT_ONCE)) for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist()) for b in range(start, stop, WINDOWS_AT_ONCE)]
        for begin, stop in runs:
            bits = running_bits(hashes[begin:stop + LONGEST])
            for size, (item, offset, prints, tables) in self.sizes.items():
                windows = window_fingerprints(bits, size - SHINGLE + 1)[:stop - begin] if len(bits) > size - SHINGLE + 1 else prints[:0]
                first = begin + np.arange(len(windows))
                text = np.searchsorted(ends, first, side="right")
                inside = (first + size <= ends[np.minimum(text, len(ends) - 1)]) & worth[size][begin:begin + len(windows)]
                windows, first, text = windows[inside], first[inside], text[inside]
                for block, (starts, lengths, parts) in enumerate(tables):
                    value = (windows >> np.uint64(block * width)).astype(np.uint32) & ((1 << width) - 1)
                    n = lengths[value]
                    met = np.flatnonzero(n)
                    window = np.repeat(met, n[met])
                    part = expand(starts[value[met]], n[met], parts)
                    close = np.bitwise_count(windows[window] ^ prints[part]) <= RADIUS
                    window, part = window[close], part[close]
                    yield text[window], item[part], first[window] - offset[part]


def may_be_alike(index: Index, item: int, low: np.ndarray, high: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether so many shingles of the words [low, high) are the item's that a passage in there can be alike.

    The shared shingles of alike texts are at least `SIMILARITY` of the item's, and equal words hash alike.
    """
    own, length = index.shingles[item], len(index.items[item][1])
    most = int((high - low).max(initial=SHINGLE))
    out = np.zeros(len(low), bool)
    step = max(1, (1 << 20) // most)
    for i in range(0, len(low), step):
        at = low[i:i + step, None] + np.arange(most - SHINGLE + 1)
        inside = at + SHINGLE <= high[i:i + step, None]
        found = hashes[np.where(inside, at, 0)]
        known = own[np.minimum(np.searchsorted(own, found), len(own) - 1)] == found
        out[i:i + step] = (known & inside).sum(axis=1) >= SIMILARITY * (length - SHINGLE + 1) - 1e-9
    return out


def find_passages(texts: pa.Array, index: Index) -> list[tuple[int, int, int, float]]:
    """(text, item, first word, similarity) of each item's best passage in each text; of equal ones the first."""
    hashes, starts, stops, ends = words_of(texts)
    shingles = shingle_hashes(hashes, SHINGLE)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    found: dict[tuple[int, int], set[int]] = {}
    for text, item, first in index.candidates(shingles, ends):
        for one in np.unique(item):
            at, begin = text[item == one], first[item == one]
            length = len(index.items[one][1])
            far = reach(length)
            low, high = np.maximum(begins[at], begin - far), np.minimum(ends[at], begin + length + far)
            alike = may_be_alike(index, one, low, high, shingles)
            for t, f in zip(at[alike].tolist(), begin[alike].tolist()):
                found.setdefault((t, int(one)), set()).add(f)
    data, _ = text_bytes(texts)
    best: dict[tuple[int, int], tuple[float, int]] = {}
    for (text, item), firsts in sorted(found.items()):
        begin, end = int(begins[text]), int(ends[text])
        number, words = index.items[item]
        far = reach(len(words))
        for low, high in _regions(sorted(firsts), far, len(words) + far):
            low, high = max(begin, low), min(end, high)
            alike, first = best_run(words, [data[a:b].tobytes().lower() for a, b in zip(starts[low:high], stops[low:high])])
            if alike >= SIMILARITY and alike > best.get((text, number), (0.0, 0))[0]:
                best[text, number] = (alike, low + first - begin)
    return [(t, i, first, s) for (t, i), (s, first) in best.items()]


def _regions(firsts: list[int], before: int, behind: int) -> Iterator[tuple[int, int]]:
    """The words from `before` each place to `behind` it, those of neighbouring places in one."""
    begin = last = firsts[0]
    for f in firsts[1:]:
        if f - last > before + behind:
            yield begin - before, last + behind
            begin = f
        last = f
    yield begin - before, last + behind


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`doc_id`, `item_id`, `first_word`, `similarity`: items that a document holds a passage of.

    One row per document id and item, for the most similar passage. Items of fewer than five words,
    NULL or empty ones among them, match nothing, and so do NULL and empty texts. Repeated rows
    give one row. Items are searched for in blocks, each in one pass over all documents.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    result = None
    for block in _blocks(items.orderBy("item_id", "text").toLocalIterator()):
        found = _search(texts, block)
        result = found if result is None else result.union(found)
    if result is None:
        return _search(texts.limit(0), [])
    # Items of the same number are one item.
    return result.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("back"))).alias("best")).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("first_word"), "best.similarity")


def _blocks(rows: Iterator[Row]) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of `ITEMS_PER_PASS`, and fewer if they are long, which bounds the lists of an index."""
    block, size = [], 0
    for r in rows:
        weight = max(1, len(split_words(r.text)) // LONGEST)
        if block and size + weight > ITEMS_PER_PASS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += weight
    if block:
        yield block


def _search(texts: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(name, items)
        for batch in batches:
            for rows in slices(batch):
                ids = rows.column("doc_id").to_pylist()
                found = find_passages(rows.column("text"), index)
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[f[0]] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.float64())],
                    ["doc_id", "item_id", "first_word", "similarity"])

    return texts.mapInArrow(run, "doc_id long, item_id long, first_word long, similarity double")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage. Rows that share an id go together; without an id, all stay."""
    found = stage(contaminated(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "contaminated")
    return docs.join(broadcast_if_small(found), "doc_id", "left_anti")
