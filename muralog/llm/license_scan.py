"""License scans: MinHash bands over overlapping windows find templates, word shingles confirm them.

A text is lower-cased words of letters and digits. A template of `L` words is looked for in windows of
`L + S - 1` words that start every `S = max(1, L // 2)` words, so each run of `L` words lies whole in
some window; a text with fewer words than the template is one window. Shingles have five words, or the
whole template if it is shorter. Where a template occurs whole, its shingles are at least half of its
window's (`L` against `L + S - 1` words), and with `CONTAINED` of them still over a third. Each of `BANDS`
bands is the least hash of a window's shingles under its own permutation, and agrees with chance at least
one third: all bands miss with probability under (2/3)^BANDS, 3 in 10 000. What agrees in a band is
confirmed on the words: the share of the template's distinct shingles that the window contains.

Each template has a few words without which nothing can hold `CONTAINED` of its shingles. Only texts with
such a word are split into words, and only windows with one are looked up, which loses nothing.

All of it is DataFrame expressions. Templates are scanned for in blocks of `BLOCK_WORDS` words, one pass
over the texts each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from muralog.sources.scratch import broadcast_if_small, stage

SHINGLE = 5
CONTAINED = 0.8
BANDS = 20
BLOCK_WORDS = 5_000
# A text is searched for the needed words as it is if they are no more than this, and split at once otherwise.
SEARCHED_WORDS = 200


def words(text: Column) -> Column:
    """Lower-cased words; none for NULL."""
    split = F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(split, lambda w: w != "")


def shingles(of: Column, length: Column) -> Column:
    """Shingles of `length` words in order; none if there are fewer words."""
    n = F.size(of) - length + 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(of, i, length), " ")))


def bands(of: Column) -> Column:
    """`(band, value)` of a set of shingles: each is hashed once, and a band permutes the hashes and takes the least."""
    least = lambda hashes, band: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, F.lit(band))))
    hashed = F.transform(of, lambda s: F.xxhash64(s))
    return F.get(F.transform(F.array(hashed), lambda hashes: F.array(*[
        F.struct(F.lit(b).alias("band"), least(hashes, b).alias("value")) for b in range(BANDS)])), 0)


def anchors(template_words: list[str], shingle: int, common: dict[str, int]) -> set[str]:
    """Words of which a text must have at least one to contain `CONTAINED` of the template's shingles.

    Taken by how few templates share them, longest first, until the shingles without any are too few.
    """
    own = {tuple(template_words[i:i + shingle]) for i in range(len(template_words) - shingle + 1)}
    chosen: set[str] = set()
    for word in sorted(set(template_words), key=lambda w: (-len(w), common[w], w)):
        if sum(not chosen & set(s) for s in own) < CONTAINED * len(own):
            break
        chosen.add(word)
    return chosen


def blocks(templates: Iterator[Row]) -> Iterator[list[Row]]:
    """Templates in blocks of about `BLOCK_WORDS` words; a longer one is a block of its own."""
    block, size = [], 0
    for t in templates:
        if block and size + len(t.words) > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t.words)
    if block:
        yield block


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """`doc_id`, `template_id`, `first_word`, `contained`: the templates found in each document.

    One row per document id and template, for the window that contains most of it, of equal ones the
    first. NULL and empty texts contain nothing; a template without a word is never found, and a text
    shorter than a template is found in if it holds enough of it. Repeated rows give one row. Extra
    columns are not read.
    """
    known = stage(templates.select(F.col("template_id").cast("long").alias("template_id"), words(F.col("text")).alias("words")).where(F.size("words") > 0).distinct(), "templates")
    # The driver holds one block at a time.
    found = [_scan_block(docs, block) for block in blocks(known.toLocalIterator())]
    if not found:
        return docs.sparkSession.createDataFrame([], "doc_id long, template_id long, first_word int, contained double")
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "template_id").agg(
        F.max(F.struct("contained", (-F.col("first_word")).alias("back"))).alias("best")).select(
        "doc_id", "template_id", (-F.col("best.back")).alias("first_word"), "best.contained")


def _scan_block(docs: DataFrame, known: list[Row]) -> DataFrame:
    """Every window that contains enough of a template of the block."""
    common: dict[str, int] = {}
    for t in known:
        for w in set(t.words):
            common[w] = common.get(w, 0) + 1
    # For each needed word the kinds of windows that it calls for: length of the template, of its shingles, step.
    kinds: dict[str, set[tuple[int, int, int]]] = {}
    for t in known:
        n = len(t.words)
        for w in anchors(t.words, min(SHINGLE, n), common):
            kinds.setdefault(w, set()).add((n, min(SHINGLE, n), max(1, n // 2)))

    listed = docs.sparkSession.createDataFrame([(t.template_id, t.words) for t in known], "template_id long, words array<string>")
    listed = listed.select("template_id", F.size("words").alias("_size"), F.array_distinct(shingles(F.col("words"), F.least(F.lit(SHINGLE), F.size("words")))).alias("wanted"))
    listed = stage(listed, "template-shingles")
    banded = stage(listed.select("template_id", "_size", F.explode(bands(F.col("wanted"))).alias("b")).select("template_id", "_size", "b.band", "b.value"), "template-bands")

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if len(kinds) <= SEARCHED_WORDS:
        texts = texts.where(F.exists(F.array(F.lower("text")), lambda t: reduce(or_, [t.contains(w) for w in sorted(kinds)])))
    split = texts.select("doc_id", words(F.col("text")).alias("words"))
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda p: p["word"].isin(sorted(kinds)))
    placed = split.select("doc_id", "words", places.alias("places")).where(F.size("places") > 0)

    kinds_of = F.create_map(*[x for w in sorted(kinds) for x in (F.lit(w), F.array(*[
        F.struct(F.lit(n).alias("size"), F.lit(k).alias("shingle"), F.lit(s).alias("step")) for n, k, s in sorted(kinds[w])]))])
    met_at = lambda at, kind: F.greatest(F.lit(0), F.ceil((at - kind["size"] - kind["step"] + 2) / kind["step"]).cast("int"))
    up_to = lambda at, kind: F.floor(F.least(at, F.greatest(F.lit(0), F.size("words") - kind["size"])) / kind["step"]).cast("int")
    starts = lambda at, kind: F.when(met_at(at, kind) <= up_to(at, kind), F.transform(
        F.sequence(met_at(at, kind), F.greatest(met_at(at, kind), up_to(at, kind))),
        lambda i: F.struct(kind["size"].alias("size"), kind["shingle"].alias("shingle"), kind["step"].alias("step"), (i * kind["step"]).alias("first_word")))).otherwise(
        F.array().cast("array<struct<size:int,shingle:int,step:int,first_word:int>>"))
    windows = F.array_distinct(F.flatten(F.flatten(F.transform("places", lambda p: F.transform(F.element_at(kinds_of, p["word"]), lambda kind: starts(p["at"], kind))))))
    called = placed.select("doc_id", "words", F.explode(windows).alias("w"))
    held = called.select("doc_id", "w.size", "w.first_word", F.array_distinct(shingles(
        F.slice("words", F.col("w.first_word") + 1, F.col("w.size") + F.col("w.step") - 1), F.col("w.shingle"))).alias("held")).where(F.size("held") > 0)
    met = held.select("doc_id", "size", "first_word", "held", F.explode(bands(F.col("held"))).alias("b")).join(
        broadcast_if_small(banded), (F.col("b.band") == F.col("band")) & (F.col("b.value") == F.col("value")) & (F.col("size") == F.col("_size")))
    contained = met.select("doc_id", "template_id", "first_word", "held").join(listed, "template_id").select(
        "doc_id", "template_id", "first_word", (F.size(F.array_intersect("held", "wanted")) / F.size("wanted")).alias("contained"))
    return contained.where(F.col("contained") >= CONTAINED)
