"""Spelling variants: words one edit apart, found through an index of variable-length grams.

The gram dictionary holds the grams that are frequent among the distinct words. A word is decomposed by
reading from every position on to the first gram that the dictionary does not hold, and likewise
backwards from every end. Such a gram ends where it gets rare (or at about half of the word), so common
beginnings give long grams and rare ones short grams, and whether it is a gram of a word depends on its
own letters alone.

One edit touches the grams that span its place. Of a set of grams it can touch all only if all of them
span one place, so the least set of which an edit always leaves one alone is a pair of grams that do not
overlap: an edit behind the left one leaves it and all letters before it alone, any other edit leaves
the right one and all letters behind it alone. The list of a gram is therefore kept by those letters
too, which makes it short. For each word the pair with the shortest lists is chosen, its lists are
merged, and every word on them, of the same length or one letter longer, is compared exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralog.llm.words import slices
from muralog.sources.scratch import stage

LETTERS = "A-Za-zÀ-ÿ"
# The dictionary goes to every task; the frequency from which a gram is held follows from this bound.
MOST_GRAMS = 200_000
LEAST_FREQUENCY = 20
LONGEST_GRAM = 8
# About how much of a list one more letter leaves; only the choice between a word's grams depends on it.
SHARE = 0.25
# A task hands on its counts when it holds this many.
HELD_COUNTS = 400_000


def word_counts(docs: DataFrame, least_chars: int = 7, least_n: int = 2, slip: int | None = None) -> DataFrame:
    """`word`, `n`: maximal runs of letters of whole texts with A-Z lower-cased, and how often they occur.

    With `slip`, a run loses a letter in those documents in which that divides the checksum of
    `<doc_id>:<run>`, so that the corpus holds known misspellings. A NULL text has no word.
    """
    find = re.compile(f"[{LETTERS}]{{{least_chars},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for rows in slices(batch):
                texts = pc.ascii_lower(rows.column("text")).to_pylist()
                for doc, text in zip(rows.column("doc").to_pylist(), texts):
                    found = find(text)
                    if not slip:
                        counts.update(found)
                    else:
                        begun = crc32(f"{doc}:".encode())
                        for word, n in Counter(found).items():
                            h = crc32(word.encode(), begun)
                            if h % slip == 0:
                                at = h % len(word)
                                word = word[:at] + word[at + 1:]
                                if len(word) < least_chars:
                                    continue
                            counts[word] += n
                    if len(counts) > HELD_COUNTS:
                        yield _counted(counts)
                        counts.clear()
        yield _counted(counts)

    texts = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    return (texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= least_n))


def _counted(counts: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])


def gram_dictionary(words: DataFrame, most_grams: int = MOST_GRAMS, least: int = LEAST_FREQUENCY, longest: int = LONGEST_GRAM) -> tuple[dict[str, int], int]:
    """The frequent grams with their frequencies, and the frequency above which a gram is held.

    Letter by letter: only a held gram is made longer. The words have at most `letters * longest` grams,
    so with a frequency over that divided by `most_grams` there are at most `most_grams` of them.
    """
    letters = words.agg(F.coalesce(F.sum(F.length("word")), F.lit(0))).first()[0]
    frequent = max(least, letters * longest // most_grams)
    held: dict[str, int] = {}
    for size in range(1, longest + 1):
        shorter = {g for g in held if len(g) == size - 1} if size > 1 else {""}
        if not shorter:
            break

        def run(batches: Iterator[pa.RecordBatch], size: int = size, shorter: set[str] = shorter) -> Iterator[pa.RecordBatch]:
            counts: Counter[str] = Counter()
            for batch in batches:
                for w in batch.column("word").to_pylist():
                    counts.update([w[i:i + size] for i in range(len(w) - size + 1) if w[i:i + size - 1] in shorter])
                if len(counts) > HELD_COUNTS:
                    yield _counted(counts)
                    counts.clear()
            yield _counted(counts)

        counted = words.select("word").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
        held.update((r.word, r.n) for r in counted.where(F.col("n") > frequent).collect())
    return held, frequent


def caps(length: int, longest: int = LONGEST_GRAM) -> tuple[int, int]:
    """The longest gram forwards and backwards in a word: together they never overlap."""
    return min(longest, (length + 1) // 2), min(longest, length // 2)


def decompose(word: str, held: dict[str, int], forwards: int, backwards: int) -> set[tuple[int, int]]:
    """The grams of a word as (begin, end): from each begin, and to each end, the shortest that is not held.

    A gram that the word's edge cuts off before it gets rare is none, as another word may go on there.
    """
    n, grams = len(word), set()
    for a in range(n):
        for b in range(a + 1, min(n, a + forwards) + 1):
            if b - a == forwards or word[a:b] not in held:
                grams.add((a, b))
                break
    for b in range(n, 0, -1):
        for a in range(b - 1, max(0, b - backwards) - 1, -1):
            if b - a == backwards or word[a:b] not in held:
                grams.add((a, b))
                break
    return grams


def probes(word: str, held: dict[str, int], frequent: int, longest: int = LONGEST_GRAM) -> tuple[tuple[int, int], tuple[int, int]]:
    """The two grams without a common letter whose lists are shortest together, the left one first.

    A list is about as long as the gram is frequent, and each letter kept with it divides it further.
    """
    n = len(word)
    left: list = [None] * (n + 1)   # by an end that is not passed: (cost, gram)
    right: list = [None] * (n + 1)  # by a begin that is kept to
    for a, b in sorted(decompose(word, held, *caps(n, longest))):
        cost = held.get(word[a:b], frequent / 2)
        before, behind = (cost * SHARE ** a, a, b), (cost * SHARE ** (n - b), a, b)
        if left[b] is None or before < left[b]:
            left[b] = before
        if right[a] is None or behind < right[a]:
            right[a] = behind
    for i in range(1, n + 1):
        if left[i - 1] is not None and (left[i] is None or left[i - 1] < left[i]):
            left[i] = left[i - 1]
    for i in range(n - 1, -1, -1):
        if right[i + 1] is not None and (right[i] is None or right[i + 1] < right[i]):
            right[i] = right[i + 1]
    _, x, y = min((left[m][0] + right[m][0], left[m], right[m]) for m in range(1, n) if left[m] is not None and right[m] is not None)
    return x[1:], y[1:]


def letter_marks(word: str) -> int:
    """Two bits for each of 32 classes of letters: whether the word has one, and more than one, of the class.

    A letter that comes or goes changes one bit at most, so one edit changes two at most.
    """
    marks = 0
    for c in word:
        bit = 1 << 2 * (ord(c) & 31)
        marks |= bit << 1 if marks & bit else bit
    return marks


def merge_join(left: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    """A join that sorts both sides and broadcasts neither, whatever size Spark takes them for.

    Spark goes by the compressed files, in which a million words are a few megabytes, even for the index, which has
    a dozen rows a word. By that size the whole index would be collected at the driver.
    """
    return left.join(right.hint("merge"), column, how)


def near_pairs(words: DataFrame, most_grams: int = MOST_GRAMS, least: int = LEAST_FREQUENCY, longest: int = LONGEST_GRAM) -> DataFrame:
    """`word`, `other`: all pairs of the given distinct words (two letters at least) that differ by one edit, in both directions."""
    held, frequent = gram_dictionary(words, most_grams, least, longest)

    def rows(of: list[str], found: list[tuple[int, int, str, int]]) -> pa.RecordBatch:
        at, side, letters, length = zip(*found) if found else ((), (), (), ())
        at = pa.array(at, pa.int64())
        marks = pa.array(np.array([letter_marks(w) for w in of], np.uint64).view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(of, pa.string()).take(at), marks.take(at), pa.array(side, pa.int32()), pa.array(letters, pa.string()), pa.array(length, pa.int32())],
                                          ["word", "marks", "side", "letters", "length"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("word").to_pylist()
            found = []
            for i, w in enumerate(of):
                # Words of the same length, and those one letter shorter, decompose it by their own caps.
                n, own, shorter = len(w), caps(len(w), longest), caps(len(w) - 1, longest)
                grams = decompose(w, held, *own)
                if shorter != own:
                    grams |= decompose(w, held, *shorter)
                found += [(i, 0, w[:b], n) for b in {b for _, b in grams}] + [(i, 1, w[a:], n) for a in {a for a, _ in grams}]
            yield rows(of, found)

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column("word").to_pylist()
            found = []
            for i, w in enumerate(of):
                (_, b), (a, _) = probes(w, held, frequent, longest)
                found += [(i, side, letters, len(w) + more) for side, letters in ((0, w[:b]), (1, w[a:])) for more in (0, 1)]
            yield rows(of, found)

    schema = "word string, marks long, side int, letters string, length int"
    key = F.xxhash64("side", "letters", "length").alias("key")
    words = words.select("word").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    index = words.mapInArrow(listed, schema).select(F.col("word").alias("other"), F.col("marks").alias("other_marks"), key)
    lists = words.mapInArrow(probed, schema).select("word", "marks", key)
    # Most words of a list differ in more letters than one edit explains, which the marks tell at once.
    alike = merge_join(lists, index, "key").where(F.bit_count(F.col("marks").bitwiseXOR(F.col("other_marks"))) <= 2)
    met = alike.where((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    once = met.select("word", "other").distinct()
    both = F.when(F.length("word") == F.length("other"), F.array(F.struct("word", "other"))).otherwise(
        F.array(F.struct("word", "other"), F.struct(F.col("other").alias("word"), F.col("word").alias("other"))))
    return once.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """`word`, `root`: the ends of the chains of `word`, `form`. Each round doubles what is followed."""
    found = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onwards = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        followed = stage(merge_join(found, onwards, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = followed.select("word", "root")
        if followed.where("moved").isEmpty():
            return found


def variants(docs: DataFrame, least_chars: int = 7, least_n: int = 2, ratio: int = 10, slip: int | None = None) -> DataFrame:
    """`word`, `form`, `root`, `n`, `n_near`, `form_n` for every word of the texts.

    `form` is the most frequent of the words one inserted, deleted or replaced letter away (ties: the
    smallest), if it is at least `ratio` times as frequent as the word; `root` is the last form. As a form
    is more frequent, chains end. Texts that are NULL, empty or without letters have no words, repeated
    rows count as often as they occur, an empty table gives no rows. Extra columns are not read.
    """
    if least_chars < 2:
        raise ValueError("words of one letter are all one edit apart")
    words = stage(word_counts(docs, least_chars, least_n, slip), "words")
    pairs = stage(near_pairs(words), "near-words")
    others = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = merge_join(pairs, others, "other").groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("back"), "other")).alias("best"))
    frequent = -F.col("best.back")
    formed = F.when(frequent >= ratio * F.col("n"), F.col("best.other"))
    known = stage(merge_join(words, best, "word", "left").select(
        "word", formed.alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed.isNotNull(), frequent).alias("form_n")), "word-forms")
    ends = roots(known.where("form is not null"))
    return merge_join(known, ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
