"""Arrow and numpy helpers that run inside tasks: bounded slices of texts, memoised words, token ids."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are worked on in slices of about this many bytes, whatever the size of an Arrow batch.
SLICE_BYTES = 8 << 20
# Letters that are their own lower case and composed form.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
PLAIN = re.compile(f"[{LETTERS}]+").fullmatch
# What a memo holds at most, in words and in numbers; results do not depend on it.
MEMO_WORDS = 700_000
MEMO_NUMBERS = 16_000_000
# Words that go through a tokenizer at once.
WORDS_AT_ONCE = 8_000


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most `limit` bytes of `column` each, or a single row.

    A NULL text counts as empty.
    """
    at = batch.schema.get_field_index(column)
    texts = pc.fill_null(batch.column(at).cast(pa.large_string()), "")
    batch = batch.set_column(at, pa.field(column, pa.large_string()), texts)
    ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


class _Runs:
    """A run of numbers for each of some words, which are one Arrow array: Python strings in a dict take several times the memory."""

    def __init__(self, dtype) -> None:
        self.slot = pa.array([], pa.large_string())
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)
        self.flat = np.zeros(0, dtype)

    def add(self, words: pa.Array, lengths: np.ndarray, flat: np.ndarray) -> None:
        self.slot = pa.concat_arrays([self.slot, words])
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.flat = np.concatenate([self.flat, flat])

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word here, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.slot), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Memo:
    """Values of distinct words, computed once per worker as long as they stay in use: each word has a run of numbers.

    `values` gives the lengths of the runs of some words and the runs one after another.

    Half of what is held is new; when it is full it becomes the old half, from which words that come again
    are taken over. Words that come again within that time, so all frequent ones, are never computed anew.
    """

    def __init__(self, values: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, most_numbers: int = MEMO_NUMBERS) -> None:
        self._values, self._dtype, self._most = values, dtype, most_numbers
        self._new, self._old = _Runs(dtype), _Runs(dtype)

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of each word's run, and the numbers the runs point into."""
        coded = words.cast(pa.large_string()).dictionary_encode()
        distinct = coded.dictionary
        slots = self._new.find(distinct)
        missing = np.flatnonzero(slots < 0)
        if len(self._new.slot) + len(missing) > MEMO_WORDS // 2 or len(self._new.flat) > self._most // 2:
            self._new, self._old, missing = _Runs(self._dtype), self._new, np.arange(len(distinct))
        new, old = self._new, self._old
        if len(missing):
            before = old.find(distinct.take(pa.array(missing)))
            known, unknown = missing[before >= 0], missing[before < 0]
            before = before[before >= 0]
            slots[known] = len(new.slot) + np.arange(len(known))
            if len(known):
                new.add(distinct.take(pa.array(known)), old.lengths[before], expand(old.starts[before], old.lengths[before], old.flat))
            slots[unknown] = len(new.slot) + np.arange(len(unknown))
            if len(unknown):
                words = distinct.take(pa.array(unknown))
                new.add(words, *self._values(words.to_pylist()))
        slots = slots[np.asarray(coded.indices)]
        return new.starts[slots], new.lengths[slots], new.flat


def joined(runs: list[list[int]], dtype) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the runs, and the runs one after another."""
    return np.fromiter(map(len, runs), np.int64, len(runs)), np.fromiter(chain.from_iterable(runs), dtype)


def expand(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The runs one after another."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


def sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of `values` within the consecutive ranges that end at `ends`; an empty range gives 0."""
    running = np.concatenate([[0], np.cumsum(values)])
    return np.diff(running[np.concatenate([[0], ends])])


def tokenizer_spells(tokenizer) -> bool:
    """Whether merging the pre-tokenised spelling of a word gives the word's ids."""
    word = "".join(LETTERS)
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str(word)
    spelled = "".join(tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in word)
    return (len(pieces) == 1 and pieces[0][0] == spelled
            and [t.id for t in tokenizer.model.tokenize(spelled)] == tokenizer.encode(word, add_special_tokens=False).ids)


class Encoder:
    """Token ids of whole texts with a public tokenizer.

    Where the vocabulary never merges across white space, a text's ids are those of its words one
    after another, and each distinct word goes through the tokenizer once. This is tried out on the
    vocabulary; any other one gets whole texts.
    """

    _per_worker: dict[tuple[str, int], Encoder] = {}

    @classmethod
    def of(cls, path: str, end_id: int) -> Encoder:
        """The worker's own encoder, kept from task to task with what it has memoised."""
        if (path, end_id) not in cls._per_worker:
            cls._per_worker[path, end_id] = cls(path, end_id)
        return cls._per_worker[path, end_id]

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self._tokenizer, self._end = Tokenizer.from_file(path), end_id
        self._memo = Memo(self._of_words, np.uint32)
        one, two = "probing", "words"
        self._by_word = self._ids(f" {one}\n {two}.") == [*self._ids(one), *self._ids(two), *self._ids(".")]
        self._lower = self._by_word and self._ids("PROBING") == self._ids(one)
        # Lower-case letters as the vocabulary spells them, for words that need no normalising.
        self._letters = {}
        if self._lower and tokenizer_spells(self._tokenizer):
            self._letters = {ord(c): self._tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS}

    def _ids(self, text: str) -> list[int]:
        return self._tokenizer.encode(text, add_special_tokens=False).ids

    def _of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Some words at a time, since lists of ids take many times the memory of the ids."""
        some = [self._of_some(words[i:i + WORDS_AT_ONCE]) for i in range(0, len(words), WORDS_AT_ONCE)]
        lengths, flat = zip(*some)
        return np.concatenate(lengths), np.concatenate(flat)

    def _of_some(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of plain lower-case letters go to the vocabulary's merges directly."""
        plain = [self._letters and PLAIN(w) is not None for w in words]
        merge, letters = self._tokenizer.model.tokenize, self._letters
        rest = iter(self._tokenizer.encode_batch_fast([w for w, p in zip(words, plain) if not p], add_special_tokens=False))
        return joined([[t.id for t in merge(w.translate(letters))] if p else next(rest).ids for w, p in zip(words, plain)], np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, with the end id after each text, and where each text's ids end."""
        if self._by_word:
            texts = pc.replace_substring(texts, "\n", " ")
            # Special tokens are spelled "<|...|>" in either case and are left alone.
            if self._lower and not pc.any(pc.match_substring(texts, "<|")).as_py():
                texts = pc.replace_substring_regex(pc.ascii_lower(texts), "([a-zß-öø-ÿ])([,.]) ", r"\1 \2 ")
            words = pc.split_pattern(texts, " ")
            starts, lengths, flat = self._memo.lookup(words.flatten())
            per_text = sums(lengths, np.cumsum(np.asarray(pc.list_value_length(words)), dtype=np.int64))
            inner = expand(starts, lengths, flat)
        else:
            runs = [self._ids(t) for t in texts.to_numpy(zero_copy_only=False)]
            per_text = np.fromiter(map(len, runs), np.int64, len(runs))
            inner = np.array([x for r in runs for x in r], np.uint32)
        ends = np.cumsum(per_text + 1)
        ids = np.full(int(ends[-1]) if len(ends) else 0, self._end, np.uint32)
        inside = np.ones(len(ids), bool)
        inside[ends - 1] = False
        ids[inside] = inner
        return ids, ends
