"""Chat formatting in windows of a token budget.

Prefix sums of the turns' tokens cut a conversation into turn-aligned spans of new turns. Each window
starts with the conversation's system turn, repeats as much of the span before as the history limit
allows, and then has its new turns. Only new assistant turns are targets: repeated ones are masked, so
each assistant text is under the loss exactly once.

A turn is written as `<turn ROLE>TEXT</turn>` and a newline. In texts and roles a backslash becomes
`\\b`, `<turn` becomes `\\o`, `</turn` becomes `\\c`, and `>` in a role becomes `\\g`. So neither mark can
occur inside a text, and since every backslash left starts one of these codes, undoing them in turn
restores the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralog.llm.words import Encoder, slices
from muralog.sources.scratch import broadcast_if_small, stage

BUDGET = 1024
HISTORY = 192
# Turns whose tokens are summed in one go; the sums of such blocks are summed after that.
BLOCK_TURNS = 256
# Characters of a turn that its place in a range partitioning goes by; the bounds are held by the driver.
PREFIX = 256

CODES = (("\\", "\\b"), ("</turn", "\\c"), ("<turn", "\\o"))
END = "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    for plain, code in CODES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return F.replace(text, F.lit(">"), F.lit("\\g")) if role else text


def restored(text: Column, role: bool = False) -> Column:
    text = F.replace(text, F.lit("\\g"), F.lit(">")) if role else text
    for plain, code in reversed(CODES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def counted_turns(turns: DataFrame, tokenizer: str) -> DataFrame:
    """Turns as they are written, with their tokens: `conv_id, turn, role, piece, n_tokens`, and `at`, which grows in their order.

    NULL roles and texts are empty. Turns follow each other by `turn` (NULL first), then role and text.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    pieces = in_order(turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.concat(F.lit("<turn "), escaped(role, role=True), F.lit(">"), escaped(text), F.lit(END)).alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, 0)
        for batch in batches:
            for rows in slices(batch):
                _, ends = encoder.encode(rows.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(c) for c in ("conv_id", "turn", "role")], rows.column("text").cast(pa.string()), pa.array(np.diff(ends, prepend=0) - 1), rows.column("at")],
                    ["conv_id", "turn", "role", "piece", "n_tokens", "at"])

    return pieces.mapInArrow(run, "conv_id long, turn long, role string, piece string, n_tokens long, at long")


def in_order(pieces: DataFrame) -> DataFrame:
    """Rows with `at`, which grows with (conv_id, turn, role, text): the number of an even range in its upper bits, the place in it in the lower 33.

    A conversation of any size is cut, also where its turns are NULL or repeat: ranges go by the first
    characters of a text, and rows with no more than those are equal and are cut anywhere. Only longer
    texts of one turn and role that begin alike stay in one range.
    """
    short = F.length("text") <= PREFIX
    keyed = pieces.withColumns({"_prefix": F.substring("text", 1, PREFIX), "_any": F.when(short, F.monotonically_increasing_id()).otherwise(F.lit(2**63 - 1))})
    ranges = keyed.repartitionByRange("conv_id", "turn", "role", "_prefix", "_any").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ranges.drop("_prefix", "_any").withColumn("at", F.monotonically_increasing_id())


def numbered(counted: DataFrame) -> DataFrame:
    """Turns with `place` (from 0) in their conversation, from the first `at` and the number of its turns in each range."""
    by_range = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranged = counted.withColumn("range", F.shiftright("at", 33))
    begins = stage(ranged.groupBy("conv_id", "range").agg(F.count("*").alias("n"), F.min("at").alias("low")).select(
        F.col("conv_id").alias("_conv"), F.col("range").alias("_range"), (F.coalesce(F.sum("n").over(by_range), F.lit(0)) - F.col("low")).alias("shift")), "turn-ranges")
    return ranged.join(broadcast_if_small(begins), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range"))).select(
        *[c for c in counted.columns if c != "at"], (F.col("at") + F.col("shift")).alias("place"))


def running(df: DataFrame, value: str, name: str) -> DataFrame:
    """`name`: the sum of `value` over the conversation's turns up to each one, blocks first."""
    block = F.floor(F.col("place") / BLOCK_TURNS)
    blocked = df.withColumn("block", block)
    by_block = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("conv_id", "block").orderBy("place")
    begins = blocked.groupBy("conv_id", "block").agg(F.sum(value).alias("n")).select(
        F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("begin"))
    return blocked.withColumn("part", F.sum(value).over(within)).join(
        begins, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))).select(
        *df.columns, (F.col("begin") + F.col("part")).alias(name))


def spans(turns: DataFrame, budget: int, history: int, system_tokens: DataFrame) -> DataFrame:
    """Turns with the `window` in which they are new and `repeats`: whether the next window repeats them.

    The room for new turns is what system turn and history leave of the budget. A turn longer than half of
    it is a span of its own. Prefix sums of the other turns' tokens make the spans, in cells of the room less
    the conversation's longest such turn: a turn belongs to the cell in which it ends, so a span is at most
    that turn longer than its cell, and exceeds the room only if it is one long turn.
    """
    room = F.greatest(F.lit(2), budget - history - F.coalesce("system_tokens", F.lit(0)))
    left = turns.join(system_tokens, F.col("conv_id").eqNullSafe(F.col("_sys_conv")), "left").withColumn("room", room)
    long_turn = F.col("n_tokens") > F.floor(F.col("room") / 2)
    longest = stage(left.groupBy("conv_id").agg(F.coalesce(F.max(F.when(~long_turn, F.col("n_tokens"))), F.lit(1)).alias("longest")).select(
        F.col("conv_id").alias("_long_conv"), "longest"), "longest-turns")
    left = left.join(broadcast_if_small(longest), F.col("conv_id").eqNullSafe(F.col("_long_conv"))).withColumn("cell", F.greatest(F.lit(1), F.col("room") - F.col("longest")))
    sized = left.withColumns({"short": F.when(long_turn, 0).otherwise(F.col("n_tokens")), "long": F.when(long_turn, 1).otherwise(0)})
    sized = running(running(sized, "short", "short_end"), "long", "long_before")
    key = F.struct(
        F.floor((F.greatest(F.col("short_end"), F.lit(1)) - 1) / F.col("cell")).alias("cell_no"),
        (2 * F.col("long_before") - F.col("long")).alias("after_long"))
    keyed = sized.withColumn("key", key)
    # Windows are numbered by their first turns.
    firsts = keyed.groupBy("conv_id", "key").agg(F.min("place").alias("place"))
    order = running(firsts.withColumn("one", F.lit(1)), "one", "nth").select(
        F.col("conv_id").alias("_conv"), F.col("key").alias("_key"), (F.col("nth") - 1).alias("window"))
    placed = keyed.join(order, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("key") == F.col("_key")))
    to_end = Window.partitionBy("conv_id", "window").orderBy(F.desc("place"))
    return placed.withColumn("repeats", F.sum("n_tokens").over(to_end) <= history)


def format_windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Windows of all conversations, from rows by turn (`conv_id, turn, role, text`).

    Columns: `conv_id`, `window` (from 0), `text`, `repeated` (how many turns at its start were new in an
    earlier window), `targets` (start and length in code points of what is under the loss) and
    `n_tokens`. The system turn is the first one, if its role is `system`; it is new in window 0. A turn
    that does not fit the budget is a window's only new turn and is never cut. Repeated rows are turns
    of their own. An empty table gives no windows.
    """
    counted = stage(counted_turns(turns, tokenizer), "counted-turns")  # tokenized once, read twice
    written = stage(numbered(counted), "turns")
    is_system = (F.col("place") == 0) & (F.col("role") == "system")
    systems = stage(written.where(is_system).select(F.col("conv_id").alias("_sys_conv"), F.col("n_tokens").alias("system_tokens")), "system-turns")
    # Texts stay behind until every turn has its windows.
    spread = stage(spans(written.where(~is_system).drop("piece", "turn"), budget, history, systems).select(
        "conv_id", "window", "place", "role", "n_tokens", "repeats"), "spans")

    new = spread.select("conv_id", "window", F.lit(2).alias("part"), "place", "n_tokens", (F.col("role") == "assistant").alias("target"))
    next_windows = spread.select(F.col("conv_id").alias("_c"), F.col("window").alias("_w")).distinct()
    again = spread.where("repeats").select("conv_id", (F.col("window") + 1).alias("window"), F.lit(1).alias("part"), "place", "n_tokens", F.lit(False).alias("target")).join(
        next_windows, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("window") == F.col("_w")), "left_semi")
    lone = systems.select(F.col("_sys_conv").alias("conv_id"), F.lit(0).cast("long").alias("window"))  # a system turn and no other
    heads = spread.select("conv_id", "window").union(lone).distinct().join(systems, F.col("conv_id").eqNullSafe(F.col("_sys_conv"))).select(
        "conv_id", "window", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), F.col("system_tokens").alias("n_tokens"), F.lit(False).alias("target"))
    pieces = written.select(F.col("conv_id").alias("_c"), F.col("place").alias("_p"), "piece")
    entries = new.union(again).union(heads).join(pieces, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("place") == F.col("_p"))).drop("_c", "_p")
    # One window's turns: as many as the budget holds.
    windows = entries.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(
        F.struct("part", "place", "piece", "n_tokens", "target"))).alias("turns"))
    ends = F.aggregate("turns", F.array().cast("array<int>"), lambda s, t: F.concat(s, F.array(
        F.coalesce(F.get(s, F.size(s) - 1), F.lit(0)) + F.length(t["piece"]))))
    laid = windows.withColumn("ends", ends)
    target = F.filter(F.transform("turns", lambda t, i: F.struct(
        t["target"].alias("target"),
        (F.get("ends", i) - F.length(t["piece"]) + F.instr(t["piece"], ">")).cast("int").alias("start"),
        (F.length(t["piece"]) - F.instr(t["piece"], ">") - len(END)).cast("int").alias("length"))), lambda t: t["target"])
    return laid.select(
        "conv_id", "window", F.array_join("turns.piece", "").alias("text"),
        F.size(F.filter("turns", lambda t: (t["part"] == 1) | ((t["part"] == 0) & (F.col("window") > 0)))).alias("repeated"),
        F.transform(target, lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("targets"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["n_tokens"]).alias("n_tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """The turns that are new in each window: `conv_id, window, turns array<struct<role, text>>`, and `loss`, the texts under the mask."""
    pieces = F.slice(F.split("text", END), F.lit(1), F.size(F.split("text", END)) - 1)
    new = F.slice(pieces, F.col("repeated") + 1, F.size(pieces))
    return windows.select(
        "conv_id", "window",
        F.transform(new, lambda p: F.struct(
            restored(F.substring(p, F.lit(len("<turn ") + 1), F.instr(p, ">") - len("<turn ") - 1), role=True).alias("role"),
            restored(F.substring(p, F.instr(p, ">") + 1, F.length(p))).alias("text"))).alias("turns"),
        F.transform("targets", lambda t: restored(F.substring("text", t["start"] + 1, t["length"]))).alias("loss"),
        F.length("text").cast("long").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows: number and hash of its turns, length and hash of the text under the loss.

    A task goes through its conversations' windows in order and feeds the hashes window by window, so
    a conversation's text is never gathered, whatever its size.
    """
    read = read_back(windows).select(
        "conv_id", "window", "chars", F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("text"),
        F.array_join("loss", "").alias("loss"))
    sized = read.withColumn("loss_chars", F.length("loss").cast("long"))
    return sized.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(
        _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    done, conv, sums, hashes = [], None, None, None  # no conversation has begun
    for batch in batches:
        ids, *numbers = (batch.column(c).to_pylist() for c in ("conv_id", "n", "loss_chars", "chars"))
        texts, losses = batch.column("text"), batch.column("loss")
        for i, (one, *counts) in enumerate(zip(ids, *numbers)):
            if sums is None or one != conv:
                if sums is not None:
                    done.append((conv, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2]))
                conv, sums, hashes = one, [0, 0, 0], (hashlib.sha256(), hashlib.sha256())
            sums = [a + b for a, b in zip(sums, counts)]
            hashes[0].update(texts[i].as_buffer())
            hashes[1].update(losses[i].as_buffer())
        if done:
            yield made(done)
            done = []
    if sums is not None:
        yield made([(conv, sums[0], hashes[0].hexdigest(), sums[1], hashes[1].hexdigest(), sums[2])])
