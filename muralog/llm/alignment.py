"""Cross-tokenizer alignment: fragments of byte ranges that compose associatively.

Two vocabularies cut the same bytes. Where a token of both ends, a group of tokens is closed; two tokens
are linked where their bytes overlap. A byte range of a text, taken alone, yields a fragment: an open
prefix (the tokens up to its first common end, whose group may have begun before it), closed groups, and
an open suffix (the tokens after its last common end). Two neighbouring fragments compose to one: the
suffix of the left and the prefix of the right close a group, or, if one of them has no common end, all
of it joins the open part of the other. Composition is associative, so the fragments of a long text are
reduced as a tree over Spark tasks, `FAN` neighbours at a time. Only open parts travel up the tree; groups
stay where they were closed, and carry the byte at which they begin.

A text of one chunk is the one fragment that its own ends close.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralog.llm.token_output import bytes_of, runs_of_bytes
from muralog.llm.words import Memo, expand, joined, slices, sums
from muralog.sources.scratch import broadcast_if_small, stage

# Texts beyond so many bytes are cut at blanks and tokenized in pieces by several tasks.
PIECE_BYTES = 1 << 18
# The byte ranges whose fragments are composed.
CHUNK_BYTES = 1 << 15
FAN = 16
# Counts of so many id pairs go to every task; links of rarer pairs find theirs through a join.
HEAD_PAIRS = 2_000_000
# A task hands on its counts when it holds this many.
HELD_PAIRS = 1_000_000
# Links that are looked up, or counted, at once.
LINKS_AT_ONCE = 1 << 20

BLANKS = r"\s\x0b\x1c-\x1f\x{85}\pZ"
# Marks of parts of words that don't begin with a blank: a comma or full stop behind a letter, and what follows a line's end.
STOP, LINE = "\ue000", "\ue001"
# Texts in which every blank stands alone between other characters are the sum of their words.
NOT_BY_WORD = f"^ | $|[{BLANKS}] | [{BLANKS}]|[{STOP}{LINE}]"
LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
PLAIN = "".join(map(chr, [*range(33, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
IS_PLAIN = re.compile(f"[{re.escape(PLAIN)}]+").fullmatch
ALONE = re.compile(r"(?<=\S) (?=\S)")

PARTS = "row long, doc_id long, valid boolean, at long, n_a long, n_b long, n_groups long, n_links long, sha string, groups binary, links binary"
OPEN = ("closes boolean, prefix_a array<long>, prefix_a_end array<long>, prefix_b array<long>, prefix_b_end array<long>, "
        "suffix_from long, suffix_a array<long>, suffix_a_end array<long>, suffix_b array<long>, suffix_b_end array<long>")


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of each id of the two vocabularies, and how many ids the second one has."""

    a: list[bytes]
    b: list[bytes]

    @classmethod
    def of(cls, byte_level: str, pieces: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        # The byte-level alphabet: printable bytes are themselves, the others follow from 256 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        alphabet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
        known = Tokenizer.from_file(byte_level).get_vocab()
        a = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        processor = SentencePieceProcessor(model_file=pieces)
        b = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace("▁", " ").encode()
             for i, p in ((i, processor.id_to_piece(i)) for i in range(processor.get_piece_size()))]
        return cls(a, b)


class Pair:
    """Both tokenizers over whole texts. Words that occur again are looked up; results do not depend on it."""

    _per_worker: dict[tuple[str, str], Pair] = {}

    @classmethod
    def of(cls, byte_level: str, pieces: str) -> Pair:
        if (byte_level, pieces) not in cls._per_worker:
            cls._per_worker[byte_level, pieces] = cls(byte_level, pieces)
        return cls._per_worker[byte_level, pieces]

    def __init__(self, byte_level: str, pieces: str) -> None:
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self._a, self._b = Tokenizer.from_file(byte_level), SentencePieceProcessor(model_file=pieces)
        self._a.encode_special_tokens = True
        self.vocabulary = Vocabulary.of(byte_level, pieces)
        self.bytes_a = np.array([len(x) for x in self.vocabulary.a])
        self.bytes_b = np.array([len(x) for x in self.vocabulary.b])
        self._memo = Memo(self._runs, np.uint32)
        # A piece that went on after a blank within it would join words, one with a letter and a stop or a line's end parts of words.
        self._by_word = not any(b" " in x.lstrip(b" ") for x in self.vocabulary.b)
        stop = re.compile(f"{LETTER}[.,]")
        self._stops = not any(stop.search(x.decode(errors="replace")) or len(x) > 1 and b"\n" in x for x in self.vocabulary.b)
        # Words of characters that are spelled by themselves need not be compared byte for byte.
        self._plain = all(self._spelled(*self._whole(f"x{c}{c}x")) == f" x{c}{c}x".encode() for c in PLAIN)
        # Decimal ids followed by nothing or one of the marks, for one lookup per token.
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.written = pa.array([f"{i}{mark}" for mark in ("", ",", "|", ";") for i in range(n)], pa.large_string())
        self.n_written = n

    def _whole(self, text: str) -> tuple[list[int], list[int]]:
        return self._a.encode(f" {text}", add_special_tokens=False).ids, self._b.encode(text)

    def _spelled(self, first: list[int], second: list[int]) -> bytes | None:
        """The bytes that both runs of ids spell; None if they differ."""
        spelled = b"".join([self.vocabulary.a[i] for i in first])
        return spelled if spelled == b"".join([self.vocabulary.b[i] for i in second]) else None

    def _runs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each word, or marked part of one: the number of ids of the first, whether both spell it, and the ids of both."""
        plain = [self._plain and IS_PLAIN(w) is not None for w in words]
        texts = [w if p else w.replace(LINE, "\n") for w, p in zip(words, plain)]
        parts = [i for i, (w, p) in enumerate(zip(words, plain)) if not p and w[:1] in (STOP, LINE)]
        asked = [f" {t}" for t in texts]
        for i in parts:
            asked[i] = texts[i][texts[i][0] == STOP:]
        first = [x.ids for x in self._a.encode_batch_fast(asked, add_special_tokens=False)]
        # Behind the letter that stands in for the one before a stop, or the blank that is added before a line's end.
        for i in parts:
            texts[i] = texts[i].replace(STOP, "x")
        second = self._b.encode(texts, num_threads=1)
        for i in parts:
            second[i] = second[i][1:]
        good = np.array([p or self._spelled(x, y) == t.encode() for p, x, y, t in zip(plain, first, second, asked)])
        n_a, ids_a = joined(first, np.uint32)
        n_b, ids_b = joined(second, np.uint32)
        lengths = 2 + n_a + n_b
        begins = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.uint32)
        flat[begins], flat[begins + 1] = n_a, good
        flat[np.repeat(begins + 2 - (np.cumsum(n_a) - n_a), n_a) + np.arange(len(ids_a))] = ids_a
        flat[np.repeat(begins + 2 + n_a - (np.cumsum(n_b) - n_b), n_b) + np.arange(len(ids_b))] = ids_b
        return lengths, flat

    def encode(self, texts: pa.Array) -> list[tuple[np.ndarray, ...]]:
        """`(ids_a, n_a, ids_b, n_b, valid)` of the texts; an invalid or empty text has no ids and is not valid."""
        whole = pc.match_substring_regex(texts, NOT_BY_WORD)
        if not self._by_word or pc.any(whole).as_py():
            # Texts that can't be put together from words are encoded one by one.
            whole = np.asarray(whole) | (not self._by_word)
            parts = [self._of_text(t) if w and t else self._words(pa.array([t], pa.large_string())) for t, w in zip(texts.to_pylist(), whole)]
            return tuple(np.concatenate(x) for x in zip(*parts))
        return self._words(texts)

    def _of_text(self, text: str) -> tuple[np.ndarray, ...]:
        first, second = self._whole(text)
        if self._spelled(first, second) != f" {text}".encode():
            first, second = [], []
        return (np.array(first, np.int64), np.array([len(first)]), np.array(second, np.int64), np.array([len(second)]), np.array([bool(first)]))

    def _words(self, texts: pa.Array) -> tuple[np.ndarray, ...]:
        valid = np.asarray(pc.binary_length(texts)) > 0
        if self._stops:
            texts = pc.replace_substring_regex(texts, f"([^{BLANKS}])\n([^{BLANKS}])", rf"\1 {LINE}\2")
            texts = pc.replace_substring_regex(texts, f"({LETTER})([.,]) ", rf"\1 {STOP}\2 ")
        words = pc.split_pattern(texts, " ")
        starts, lengths, flat = self._memo.lookup(words.flatten())
        ends = np.cumsum(np.asarray(pc.list_value_length(words)), dtype=np.int64)
        n_a, good = flat[starts].astype(np.int64), flat[starts + 1]
        valid &= sums(1 - good.astype(np.int64), ends) == 0
        held = np.repeat(valid, np.diff(ends, prepend=0))
        n_a, n_b = np.where(held, n_a, 0), np.where(held, lengths - 2 - n_a, 0)
        return (expand(starts + 2, n_a, flat).astype(np.int64), sums(n_a, ends), expand(starts + 2 + flat[starts], n_b, flat).astype(np.int64), sums(n_b, ends), valid)


@dataclass
class Tokens:
    """A run of tokens: their ids and the bytes at which they end."""

    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    ends: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, other.ends]))

    def cut(self, begin: int, end: int) -> Tokens:
        """The tokens that end after byte `begin`, up to byte `end`."""
        i, j = np.searchsorted(self.ends, [begin, end], side="right")
        return Tokens(self.ids[i:j], self.ends[i:j])


@dataclass
class Closed:
    """Closed groups, one or more, that begin at byte `at`."""

    at: int
    a: Tokens
    b: Tokens


@dataclass
class Fragment:
    """What a byte range knows of its groups without its neighbours. Without a common end all is prefix."""

    closes: bool
    prefix_a: Tokens
    prefix_b: Tokens
    suffix_from: int
    suffix_a: Tokens
    suffix_b: Tokens


def fragment(a: Tokens, b: Tokens) -> tuple[Fragment, list[Closed]]:
    """The fragment of a byte range and the groups closed within it."""
    common = np.intersect1d(a.ends, b.ends)
    if not len(common):
        return Fragment(False, a, b, -1, Tokens(), Tokens()), []
    first, last, beyond = int(common[0]), int(common[-1]), np.iinfo(np.int64).max
    inner = [Closed(first, a.cut(first, last), b.cut(first, last))] if last > first else []
    return Fragment(True, a.cut(-1, first), b.cut(-1, first), last, a.cut(last, beyond), b.cut(last, beyond)), inner


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, list[Closed]]:
    """Both fragments as one, and the group that closes between them, if one does."""
    if not left.closes:
        return Fragment(right.closes, left.prefix_a + right.prefix_a, left.prefix_b + right.prefix_b, right.suffix_from, right.suffix_a, right.suffix_b), []
    if not right.closes:
        return Fragment(True, left.prefix_a, left.prefix_b, left.suffix_from, left.suffix_a + right.prefix_a, left.suffix_b + right.prefix_b), []
    between = Closed(left.suffix_from, left.suffix_a + right.prefix_a, left.suffix_b + right.prefix_b)
    return Fragment(True, left.prefix_a, left.prefix_b, right.suffix_from, right.suffix_a, right.suffix_b), [between]


@dataclass
class Overlay:
    """Two runs of tokens over the same bytes, laid on each other. Both end at the same byte."""

    ends: np.ndarray    # of the byte ranges between neighbouring ends of either kind: each is one link
    of_a: np.ndarray    # the tokens of each range
    of_b: np.ndarray
    common: np.ndarray  # where both end, that is, the ends of the groups
    upto_a: np.ndarray  # tokens up to each group's end
    upto_b: np.ndarray

    @classmethod
    def of(cls, a: Tokens, b: Tokens) -> Overlay:
        keys = np.sort(np.concatenate([2 * a.ends, 2 * b.ends + 1]), kind="stable")
        ends, is_b = keys >> 1, keys & 1
        upto_b = np.cumsum(is_b)
        upto_a = np.arange(1, len(keys) + 1) - upto_b
        new = np.ones(len(keys), bool)
        new[1:] = ends[1:] != ends[:-1]
        first, both = np.flatnonzero(new), np.flatnonzero(~new)
        return cls(ends[first], (upto_a - (1 - is_b))[first], (upto_b - is_b)[first], ends[both], upto_a[both], upto_b[both])

    def links(self, a: Tokens, b: Tokens, n_b: int) -> np.ndarray:
        """Each link as one number, `id_a * n_b + id_b`."""
        return a.ids[self.of_a] * n_b + b.ids[self.of_b]

    def written(self, a: Tokens, b: Tokens, last_of_text: np.ndarray, pair: Pair) -> tuple[np.ndarray, np.ndarray]:
        """The groups as `a1,a2|b1;a3|b2,b3`, and where each of them ends in it; no mark after the groups `last_of_text`."""
        marks_a, marks_b = np.ones(len(a.ids), np.int64), np.ones(len(b.ids), np.int64)
        marks_a[self.upto_a - 1], marks_b[self.upto_b - 1] = 2, np.where(last_of_text, 0, 3)
        codes = np.empty(len(a.ids) + len(b.ids), np.int64)
        # Before a token of the first kind lie the other kind's tokens of earlier groups, before one of the second kind all of the group's first kind.
        before_a, before_b = np.concatenate([[0], self.upto_b])[:-1], self.upto_a
        codes[np.arange(len(a.ids)) + np.repeat(before_a, np.diff(self.upto_a, prepend=0))] = marks_a * pair.n_written + a.ids
        codes[np.arange(len(b.ids)) + np.repeat(before_b, np.diff(self.upto_b, prepend=0))] = marks_b * pair.n_written + b.ids
        text = pair.written.take(pa.array(codes))
        _, offsets, data = text.buffers()
        offsets = np.frombuffer(offsets, np.int64)[:len(codes) + 1]
        return np.frombuffer(data, np.uint8)[:offsets[-1]] if data else np.zeros(0, np.uint8), offsets[self.upto_a + self.upto_b]


def _closed_rows(closed: list[Closed], row: int, doc_id: int | None, pair: Pair) -> list[tuple]:
    out = []
    for c in closed:
        over = Overlay.of(c.a, c.b)
        links = over.links(c.a, c.b, len(pair.bytes_b))
        text, _ = over.written(c.a, c.b, np.arange(len(over.common)) == len(over.common) - 1, pair)
        out.append((row, doc_id, True, c.at, 0, 0, len(over.common), len(links), None, text.tobytes(), links.astype("<u4").tobytes()))
    return out


def _open_row(f: Fragment) -> tuple:
    return (f.closes, f.prefix_a.ids.tolist(), f.prefix_a.ends.tolist(), f.prefix_b.ids.tolist(), f.prefix_b.ends.tolist(),
            f.suffix_from, f.suffix_a.ids.tolist(), f.suffix_a.ends.tolist(), f.suffix_b.ids.tolist(), f.suffix_b.ends.tolist())


def _open_of(r: dict) -> Fragment:
    t = lambda name: Tokens(np.array(r[name], np.int64), np.array(r[f"{name}_end"], np.int64))
    return Fragment(r["closes"], t("prefix_a"), t("prefix_b"), r["suffix_from"], t("suffix_a"), t("suffix_b"))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ([] for _ in schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def parts(docs: DataFrame, byte_level: str, pieces: str, chunk_bytes: int, piece_bytes: int) -> DataFrame:
    """Staged: a row with digest and links for each text of one chunk, and rows of closed groups and of open ends for longer ones."""
    schema = _schema(f"{PARTS}, {OPEN}")
    no_open = (None,) * len(OPEN.split(", "))

    def of_pieces(batches: Iterator[pa.RecordBatch], branch: int) -> Iterator[pa.RecordBatch]:
        pair = Pair.of(byte_level, pieces)
        done = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows in slices(batch, limit=1 << 20):
                texts = rows.column("text")
                ids_a, n_a, ids_b, n_b, valid = pair.encode(texts)
                n_bytes = np.asarray(pc.binary_length(texts)).astype(np.int64) + 1
                if branch:
                    keys, starts = (np.asarray(rows.column(c)) for c in ("row", "start"))
                else:
                    keys = 2 * (done + np.arange(rows.num_rows))
                    starts = np.zeros(rows.num_rows, np.int64)
                    done += rows.num_rows
                doc_ids = rows.column("doc_id")
                ends_of_a, ends_of_b = np.cumsum(n_a), np.cumsum(n_b)
                long = valid & ((n_bytes > chunk_bytes) | bool(branch))
                short = np.flatnonzero(~long)
                yield _whole(pair, keys, doc_ids, valid, n_bytes, short, ids_a, n_a, ids_b, n_b, schema)
                for i in np.flatnonzero(long).tolist():
                    a, b = (Tokens(ids[e[i] - n[i]:e[i]], starts[i] + np.cumsum(size[ids[e[i] - n[i]:e[i]]]))
                            for ids, n, e, size in ((ids_a, n_a, ends_of_a, pair.bytes_a), (ids_b, n_b, ends_of_b, pair.bytes_b)))
                    out, key, doc_id = [], int(keys[i]), doc_ids[i].as_py()
                    begin, end = int(starts[i]), int(starts[i] + n_bytes[i])
                    for at in range(begin - begin % chunk_bytes, end, chunk_bytes):
                        own_a, own_b = a.cut(at, at + chunk_bytes), b.cut(at, at + chunk_bytes)
                        if not len(own_a.ids) and not len(own_b.ids):
                            continue
                        f, closed = fragment(own_a, own_b)
                        out.append((key, doc_id, True, max(at, begin), len(own_a.ids), len(own_b.ids), 0, 0, None, None, b"", *_open_row(f)))
                        out += [(*r, *no_open) for r in _closed_rows(closed, key, doc_id, pair)]
                    yield _rows(out, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 40
        cut_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("text", pa.string())])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                text, begin, start = text.as_py(), 0, 0
                while begin <= len(text):
                    blank = ALONE.search(text, begin + piece_bytes)
                    piece = text[begin:blank.start() if blank else len(text)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((2 * done + 1, doc_id.as_py(), start, piece), cut_schema)], schema=cut_schema)
                    if not blank:
                        break
                    begin, start = blank.end(), start + len(piece.encode()) + 1
                done += 1

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_long = F.coalesce(F.octet_length("text") > piece_bytes, F.lit(False))
    ordinary = texts.where(~is_long).mapInArrow(lambda b: of_pieces(b, 0), f"{PARTS}, {OPEN}")
    longer = texts.where(is_long).mapInArrow(cut, "row long, doc_id long, start long, text string").repartition(
        int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "row", "start").mapInArrow(lambda b: of_pieces(b, 1), f"{PARTS}, {OPEN}")
    return stage(ordinary.unionByName(longer), "alignment-parts")


def _whole(pair: Pair, keys, doc_ids, valid, n_bytes, rows, ids_a, n_a, ids_b, n_b, schema: pa.Schema) -> pa.RecordBatch:
    """Texts of one chunk (`rows`), all of a slice at once: their own ends close all groups."""
    mine = np.zeros(len(keys), bool)
    mine[rows] = True
    held = np.where(valid & mine, n_bytes, 0)
    a, b = (Tokens(ids[np.repeat(mine, n)], np.cumsum(size[ids[np.repeat(mine, n)]])) for ids, n, size in ((ids_a, n_a, pair.bytes_a), (ids_b, n_b, pair.bytes_b)))
    over = Overlay.of(a, b)
    links, text_ends = over.links(a, b, len(pair.bytes_b)), np.cumsum(held)
    upto_links, upto_groups = np.searchsorted(over.ends, text_ends, side="right"), np.searchsorted(over.common, text_ends, side="right")
    last = np.zeros(len(over.common), bool)
    last[upto_groups[held > 0] - 1] = True
    text, group_ends = over.written(a, b, last, pair)
    stops = np.concatenate([[0], group_ends])[upto_groups]
    view = memoryview(np.ascontiguousarray(text))
    begins = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    shas = [hashlib.sha256(view[i:j]).hexdigest() if j > i else "" for i, j in zip(begins[rows].tolist(), stops[rows].tolist())]
    take = pa.array(rows)
    nothing = pa.nulls(len(rows))
    values = {
        "row": pa.array(keys[rows]), "doc_id": doc_ids.take(take), "valid": pa.array(valid[rows]), "at": pa.array(np.zeros(len(rows), np.int64)),
        "n_a": pa.array(n_a[rows]), "n_b": pa.array(n_b[rows]), "n_groups": pa.array(np.diff(upto_groups, prepend=0)[rows]), "n_links": pa.array(np.diff(upto_links, prepend=0)[rows]),
        "sha": pa.array(shas, pa.string()), "links": runs_of_bytes(links.astype("<u4"), upto_links).take(take),
    }
    return pa.RecordBatch.from_arrays([values[f.name].cast(f.type) if f.name in values else nothing.cast(f.type) for f in schema], schema=schema)


def reduced(fragments: DataFrame, byte_level: str, pieces: str, chunk_bytes: int) -> DataFrame:
    """The closed groups (`PARTS`) between the fragments of each text, by a tree of compositions."""
    schema, no_open = _schema(f"{PARTS}, {OPEN}"), (None,) * len(OPEN.split(", "))
    closed, level = None, fragments
    reach = (fragments.agg(F.max("at")).first()[0] or 0) // chunk_bytes
    width = 1

    def compose_all(last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, at, whole, head, found = Pair.of(byte_level, pieces), None, None, None, []

            def done() -> list[tuple]:
                if last:  # the text's own ends close what is left
                    found.append(Closed(0, whole.prefix_a, whole.prefix_b))
                out = [(*r, *no_open) for r in _closed_rows(found, *head[:2], pair)]
                return out if last else [*out, (*head[:2], True, head[2], 0, 0, 0, 0, None, None, None, *_open_row(whole))]

            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    if (r["row"], r["_range"]) != at:
                        out += done() if whole else []
                        at, head, whole, found = (r["row"], r["_range"]), (r["row"], r["doc_id"], r["at"]), _open_of(r), []
                    else:
                        whole, more = compose(whole, _open_of(r))
                        found += more
                yield _rows(out, schema)
            yield _rows(done() if whole else [], schema)
        return run

    n = int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        width *= FAN
        last = reach < width
        ranges = level.withColumn("_range", F.floor(F.col("at") / (chunk_bytes * width)))
        level = stage(ranges.repartition(n, "row", "_range").sortWithinPartitions("row", "_range", "at").mapInArrow(compose_all(last), f"{PARTS}, {OPEN}"), "fragments")
        here = level.where("closes is null").select(*[c.split()[0] for c in PARTS.split(", ")])
        closed = here if closed is None else closed.unionByName(here)
        if last:
            return closed
        level = level.where("closes is not null")


def pair_counts(links: DataFrame, n_b: int) -> DataFrame:
    """`pair`, `n`, `best`: links of each id pair over all texts, and whether no pair with the same second id has more. Staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for some in batch.column("links"):
                waiting.append(np.frombuffer(some.as_buffer() or b"", "<u4"))
                size += len(waiting[-1])
                if size > LINKS_AT_ONCE:
                    keys, counts = _merged(keys, counts, waiting)
                    waiting, size = [], 0
                    if len(keys) > HELD_PAIRS:
                        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                        keys, counts = keys[:0], counts[:0]
        keys, counts = _merged(keys, counts, waiting)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    counted = stage(links.where(F.octet_length("links") > 0).select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")), "pairs")
    most = stage(counted.groupBy((F.col("pair") % n_b).alias("_b")).agg(F.max("n").alias("most")), "most-linked")
    return stage(counted.join(broadcast_if_small(most), F.col("pair") % n_b == F.col("_b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _merged(keys: np.ndarray, counts: np.ndarray, more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    new, n = np.unique(np.concatenate([*more, np.zeros(0, "<u4")]), return_counts=True)
    both = np.concatenate([keys, new.astype(np.int64)])
    found, at = np.unique(both, return_inverse=True)
    return found, np.bincount(at, np.concatenate([counts, n]), len(found)).astype(np.int64)


def frequent_pairs(counted: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The pairs from a frequency on, a power of two, from which on there are at most `most`, and the rest."""
    by_size = counted.groupBy(F.floor(F.log2("n")).alias("size")).agg(F.count("*").alias("pairs")).orderBy(F.desc("size")).collect()  # 63 rows at most
    least, sum_of = 1 << 62, 0
    for r in by_size:
        sum_of += r.pairs
        if sum_of > most:
            break
        least = 1 << r["size"]
    return counted.where(F.col("n") >= least), counted.where(F.col("n") < least)


def align(docs: DataFrame, byte_level: str, pieces: str, chunk_bytes: int = CHUNK_BYTES, piece_bytes: int = PIECE_BYTES, head_pairs: int = HEAD_PAIRS) -> DataFrame:
    """`doc_id`, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256` of every row.

    The first vocabulary encodes a blank and the text, the second one adds the blank itself. Texts that
    are NULL or empty, or that one of them does not spell byte for byte, have no tokens: all numbers are 0
    and the digest is ''. Repeated rows each give a row and count as often as they occur. An empty table
    gives no rows. Extra columns are not read.
    """
    n_b = len(Vocabulary.of(byte_level, pieces).b)
    found = parts(docs, byte_level, pieces, chunk_bytes, piece_bytes)
    columns = [c.split()[0] for c in PARTS.split(", ")]

    # Longer texts: all of their pieces must be valid.
    of_long = found.where("sha is null")
    invalid = broadcast_if_small(stage(found.where("not valid and row % 2 = 1").select("row").distinct(), "invalid-texts"))
    in_pieces = of_long.join(invalid, "row", "left_anti")
    between = reduced(in_pieces.where("closes is not null"), byte_level, pieces, chunk_bytes)
    closed = stage(in_pieces.select(*columns).unionByName(between), "closed-groups")
    whole = found.where("sha is not null and (valid or row % 2 = 0)").select(*columns)
    void = invalid.join(found.where("not valid").groupBy("row").agg(F.first("doc_id").alias("doc_id")), "row").select(
        "doc_id", *[F.lit(0).cast("long").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], F.lit("").alias("groups_sha256"))

    everything = whole.unionByName(closed)
    counted = pair_counts(everything, n_b)
    head, tail = frequent_pairs(counted, head_pairs)
    has_tail = not tail.isEmpty()
    table = head.toArrow().combine_chunks().sort_by("pair")
    keys, numbers, bests = (np.asarray(table.column(c)) for c in ("pair", "n", "best"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = np.append(keys, 1 << 62), np.append(numbers, 0), np.append(bests, False)
        for batch in batches:
            lengths = np.asarray(pc.binary_length(batch.column("links")), dtype=np.int64) // 4
            for begin, end in runs_of_at_most(lengths, LINKS_AT_ONCE):
                rows, ends = batch.slice(begin, end - begin), np.cumsum(lengths[begin:end])
                pairs = bytes_of(rows.column("links")).view("<u4").astype(np.int64)
                at = np.searchsorted(known, pairs)
                met = known[at] == pairs
                at[~met] = len(keys)
                missed = runs_of_longs(pairs[~met], sums(~met, ends))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], pa.array(sums(best[at].astype(np.int64), ends)), pa.array(sums(n[at], ends)), missed],
                                                 [*kept, "n_best", "count_sum", "missed"])

    kept = ["row", "doc_id", "at", "n_a", "n_b", "n_groups", "n_links", "sha"]
    scored = everything.select(*kept, F.coalesce("links", F.lit(b"")).alias("links")).mapInArrow(
        run, "row long, doc_id long, at long, n_a long, n_b long, n_groups long, n_links long, sha string, n_best long, count_sum long, missed array<long>")
    scored = stage(scored, "scored-links")
    numbers_of = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    digests = closed.where("groups is not null").select("row", "at", "groups").repartition("row").sortWithinPartitions("row", "at").mapInArrow(_digests, "row long, groups_sha256 string")
    longer = scored.where("sha is null").groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in numbers_of]).join(digests, "row")
    out = scored.where("sha is not null").select("row", "doc_id", *numbers_of, F.col("sha").alias("groups_sha256")).unionByName(longer)
    if has_tail:
        rest = scored.select("row", F.explode("missed").alias("pair")).join(tail, "pair").groupBy("row").agg(
            F.sum(F.col("best").cast("long")).alias("more_best"), F.sum("n").alias("more"))
        out = out.join(rest, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("more_best", F.lit(0))).withColumn(
            "count_sum", F.col("count_sum") + F.coalesce("more", F.lit(0)))
    return out.select("doc_id", *numbers_of, "groups_sha256").unionByName(void)


def runs_of_at_most(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows with at most `most` in all, or a single row."""
    ends, begin = np.cumsum(lengths), 0
    while begin < len(lengths):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, end
        begin = end


def runs_of_longs(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(values))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a text, fed group run by group run in their order."""
    at, digest = None, None
    for batch in batches:
        out = []
        for row, groups in zip(batch.column("row").to_pylist(), batch.column("groups")):
            if row != at:
                out += [(at, digest.hexdigest())] if digest else []
                at, digest = row, hashlib.sha256()
            else:
                digest.update(b";")
            digest.update(groups.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([d for _, d in out], pa.string())], ["row", "groups_sha256"])
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], ["row", "groups_sha256"])
