"""Time bins, repeatable samples and the split by time."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralog.functions.bins import left_closed_bin
from muralog.functions.clock import epoch_seconds, micros
from muralog.functions.keys import key_mark, key_up_to, sample_key
from muralog.operators.charts import extent
from muralog.sources.placements import in_window
from muralog.sources.scratch import stage


# How often the band around a sample's last key is made four times wider. It is needed with ids that repeat.
WIDENED = 6


def with_time_bin(df: DataFrame, n_bins: int = 24, span: tuple | None = None) -> DataFrame:
    """Add `time_bin`, the equal-width bin of `ts` over the whole span; rows without `ts` are left out.

    `span` gives the first and last instant where they are already known; otherwise the plan looks
    them up.
    """
    timed = df.filter(F.col("ts").isNotNull())
    if span is None:
        ends = extent(timed, ["ts"])
        low, high = epoch_seconds(ends["lo_ts"]), epoch_seconds(ends["hi_ts"])
    else:
        low, high = (F.lit(t).cast("long") / F.lit(1e6) for t in span)
    return timed.withColumn("time_bin", left_closed_bin(epoch_seconds("ts"), low, high, n_bins))


def stratified_time_sample(df: DataFrame, n_bins: int = 24, n_total: int = 720_000, seed: int = 42) -> DataFrame:
    """Up to `n_total // n_bins` pseudo-random rows from each time bin, all columns kept.

    The same rows are chosen on every run. Reads the table three times: for the span, for the sizes
    of the bins, and for the rows.
    """
    span = df.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    binned = with_time_bin(df, n_bins, tuple(span))
    return lowest_keys(binned, _sizes(binned, "time_bin"), n_total // n_bins, seed, "time_bin").drop("time_bin")


def uniform_sample(df: DataFrame, n: int = 150_000, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) pseudo-random rows without replacement; the same rows on every run."""
    whole = df.withColumn("_all", F.lit(0))
    return lowest_keys(whole, _sizes(whole, "_all"), n, seed, "_all").drop("_all")


def _sizes(df: DataFrame, stratum: str) -> dict[int, int]:
    """Rows of each stratum, one row per stratum at the driver. Rows without an id cannot be drawn."""
    counted = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), F.count("event_id").alias("ids")).collect()
    if any(r.n != r.ids for r in counted):
        raise ValueError("event_id must not be null")
    return {r[stratum]: r.n for r in counted}


def lowest_keys(df: DataFrame, sizes: dict[int, int], n: int, seed: int, stratum: str) -> DataFrame:
    """The n rows with the lowest sampling keys from each stratum, or all rows of a smaller one.

    Ranking every row would send whole strata to single tasks. Since the keys are uniform, the n
    lowest end near the share n / size of the key space: rows well below it are in, rows well above
    it are out, and only the band around it is ranked, for the places that are left. The counts of
    both parts are checked, and the band is widened until they add up, so the result is exact.
    Ids that repeat so often that one key fills the band are refused.
    """
    if all(size <= n for size in sizes.values()):
        return df
    keyed = df.withColumn("_key", sample_key("event_id", seed))
    margin = _margin(n)
    for _ in range(WIDENED):
        high = {s: key_mark(min(1.0, (n + margin) / size)) for s, size in sizes.items()}
        low = {s: key_mark(1.0 if size <= n else max(0.0, (n - margin) / size)) for s, size in sizes.items()}
        near = stage(
            keyed.filter(key_up_to(F.col("_key"), _lookup(F.col(stratum), high)))
            .withColumn("_sure", key_up_to(F.col("_key"), _lookup(F.col(stratum), low))),
            "sample",
        )
        counts = {(r[stratum], r["_sure"]): r["count"] for r in near.groupBy(stratum, "_sure").count().collect()}
        sure = {s: counts.get((s, True), 0) for s in sizes}
        large = [s for s, size in sizes.items() if size > n]
        band = {s: counts.get((s, False), 0) for s in large}
        if any(band[s] > 4 * (2 * margin + 100) for s in large):
            raise ValueError("event_id repeats too often to draw a sample by it")
        if all(sure[s] <= n <= sure[s] + band[s] for s in large):
            break
        margin *= 4
    else:
        raise ValueError("event_id is not spread enough to draw a sample by it")

    order = Window.partitionBy(stratum).orderBy("_key", "event_id")
    places = _lookup(F.col(stratum), {s: n - taken for s, taken in sure.items()})
    ranked = near.filter(~F.col("_sure")).withColumn("_rank", F.row_number().over(order))
    chosen = near.filter("_sure").unionByName(ranked.filter(F.col("_rank") <= places).drop("_rank"))
    return chosen.drop("_key", "_sure")


def _margin(n: int) -> float:
    """Ten deviations of the number of keys below a mark."""
    return 10 * math.sqrt(n) + 100


def _lookup(key: Column, values: dict) -> Column:
    pairs = [F.lit(v) for item in sorted(values.items()) for v in item]
    return F.try_element_at(F.create_map(*pairs), key)


def midpoint_slice(df: DataFrame, minutes: float = 180) -> DataFrame:
    """Rows in the `minutes` after the middle of the time span; the bounds are pushed to the scan."""
    low, high = df.agg(F.min(micros("ts")), F.max(micros("ts"))).first()
    if low is None:
        return df.limit(0)
    start = (low + high + 1) // 2
    return in_window(df, *(F.timestamp_micros(F.lit(t)) for t in (start, start + round(minutes * 60_000_000))))


def temporal_split(df: DataFrame, folds: int = 5, train_folds: int = 4) -> tuple[DataFrame, DataFrame]:
    """Split rows ordered by (ts, event_id) into the first `train_folds` of `folds` even folds and the rest.

    When the rows do not divide evenly the earlier folds are one longer. Only the
    cut has to be found, not the rank of each row: train and test are then plain
    range filters, with no sort, no shuffle and no single-task window. Rows that share the time and
    id at the cut could not be told apart, so they are refused.
    """
    rows, ids, times = df.agg(F.count(F.lit(1)), F.count("event_id"), F.count("ts")).first()
    if rows != ids or rows != times:
        raise ValueError("ts and event_id must not be null")
    each, longer = divmod(rows, folds)
    train_rows = each * train_folds + min(longer, train_folds)
    if train_rows == 0:
        return df.limit(0), df
    if train_rows == rows:
        return df, df.limit(0)
    at, row_id = key_at(df, train_rows, rows)
    cut = F.timestamp_micros(F.lit(at))
    is_train = (F.col("ts") <= cut) & ((F.col("ts") < cut) | (F.col("event_id") <= row_id))
    return df.filter(is_train), df.filter(~is_train)


def key_at(df: DataFrame, position: int, rows: int, buckets: int = 1024, enough: int = 100_000) -> tuple[int, int]:
    """The (ts in microseconds, event_id) of the row at a 1-based position in that order.

    Narrows a range by counting rows in `buckets` slices of it and stepping into
    the slice that holds the position, first on time and then, among rows of one
    instant, on the row id, until few enough rows are left to sort. Each step
    returns at most `buckets` rows and reads only the slice found before.
    """
    scope = df.select("ts", "event_id")
    for value, limits in ((micros("ts"), _instants), (F.col("event_id"), _ids)):
        if rows <= enough:
            break
        low, high = scope.agg(F.min(value), F.max(value)).first()
        while rows > enough and low < high:
            width = -(-(high - low + 1) // buckets)
            slice_no = F.floor((value - F.lit(low)) / F.lit(width)).cast("long")
            sizes = dict(scope.groupBy(slice_no.alias("s")).count().collect())
            for number in sorted(sizes):
                rows = sizes[number]
                if position <= rows:
                    break
                position -= rows
            low, high = low + number * width, min(high, low + (number + 1) * width - 1)
            scope = scope.filter(limits(low, high))
    last = scope.orderBy("ts", "event_id").offset(position - 1).limit(1).select(micros("ts"), "event_id").first()
    if scope.filter(_instants(last[0], last[0]) & (F.col("event_id") == last[1])).count() > 1:
        raise ValueError(f"event_id {last[1]} repeats")
    return last[0], last[1]


def _instants(low: int, high: int) -> Column:
    return F.col("ts").between(F.timestamp_micros(F.lit(low)), F.timestamp_micros(F.lit(high)))


def _ids(low: int, high: int) -> Column:
    return F.col("event_id").between(low, high)
