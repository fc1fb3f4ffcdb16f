"""Survival label and leak-free features of sampled placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muralog.functions.clock import MICROS, epoch_seconds, micros, seconds_between
from muralog.operators.neighbours import TARGET_ROWS, with_neighbours
from muralog.operators.sessions import activity_slots
from muralog.sources.scratch import broadcast_if_small, stage

# Time since the last change where the pixel has no earlier change.
NEVER_CHANGED_SEC = 1e9


def grid_cell(df: DataFrame, size: int = 20) -> DataFrame:
    """Add the grid cell `gx, gy` of each pixel."""
    return df.withColumns({f"g{c}": F.floor(F.col(c) / F.lit(size)).cast("int") for c in ("x", "y")})


def pixel_timeline(full: DataFrame, sample: DataFrame | None = None, target_rows: int = TARGET_ROWS, piece_rows: int | None = None) -> DataFrame:
    """Sampled rows with `next_ts, prior_changes_at_pixel, time_since_last_change_sec`.

    One ordering of the placements by pixel serves the label and the history.
    Placements on pixels that were not sampled are dropped before the shuffle, and
    sampled rows are picked by row id afterwards, so two placements on a pixel at
    the same instant do not multiply. Without a sample every placement is kept.
    """
    history = [
        F.col("next_ts"),
        F.col("earlier_rows").alias("prior_changes_at_pixel"),
        F.coalesce(seconds_between("prev_ts", "ts"), F.lit(NEVER_CHANGED_SEC)).alias("time_since_last_change_sec"),
    ]
    if sample is None:
        return with_neighbours(full, ["x", "y"], target_rows, piece_rows).select(*full.columns, *history)
    pixels = stage(sample.select("x", "y").distinct(), "sampled-pixels")
    ids = stage(sample.select("event_id"), "sampled-ids")
    events = full.select("event_id", "ts", "x", "y").join(broadcast_if_small(pixels), ["x", "y"], "left_semi")
    lines = with_neighbours(events, ["x", "y"], target_rows, piece_rows).select("event_id", *history)
    return sample.join(lines.join(broadcast_if_small(ids), "event_id", "left_semi"), "event_id")


def survives(minutes: float) -> Column:
    """1 where the pixel kept its colour for `minutes`, or was never changed again."""
    kept = seconds_between("ts", "next_ts") / F.lit(60.0)
    return F.when(F.col("next_ts").isNull() | (kept >= minutes), 1).otherwise(0)


def survival_label(full: DataFrame, sample: DataFrame | None = None, minutes: float = 30) -> DataFrame:
    """Sampled rows with `next_ts` and the label `y_survives_<minutes>m`."""
    return (
        pixel_timeline(full, sample).withColumn(f"y_survives_{minutes}m", survives(minutes))
        .drop("prior_changes_at_pixel", "time_since_last_change_sec")
    )


def pixel_history(full: DataFrame, sample: DataFrame | None = None, target_rows: int = TARGET_ROWS, piece_rows: int | None = None) -> DataFrame:
    """Sampled rows with the changes made before them at the same pixel and the time since the last one."""
    return pixel_timeline(full, sample, target_rows, piece_rows).drop("next_ts")


def neighborhood_activity(full: DataFrame, sample: DataFrame, size: int = 20, lookback_minutes: float = 10,
                          slices: int = 8) -> DataFrame:
    """Placements, distinct users and distinct colours in the same cell over `[t - lookback, t)`.

    Returns `event_id, local_event_count, local_unique_users, local_unique_colors`
    for every sampled row. The sample is read several times, so pass a written table.

    Pairing each sampled row with its neighbours grows with the square of a busy
    cell. Counting needs no pairs: a placement at e is in view for t in
    (e, e + lookback], which is +1 after e and -1 after e + lookback, and a user is
    in view over the union of such spans, whose ends are the first and last
    placement of a run without a pause longer than the lookback. All three numbers
    at t are then sums of the steps before t in the cell. The sums are taken in
    two levels, per slice of time and inside the slices that hold sampled rows, so
    no task sees more than one slice of one cell.
    """
    span = int(lookback_minutes * 60 * MICROS)
    width = max(1, span // slices)
    asked = grid_cell(sample.select("event_id", "ts", "x", "y"), size).select(
        "event_id", "gx", "gy", micros("ts").alias("at"))

    # Placements that any sampled row can see: same cell, in its own or the preceding lookback slot.
    slot = F.col("at") - F.pmod(F.col("at"), F.lit(span).cast("long"))
    seen = asked.select("gx", "gy", F.explode(F.array(slot, slot - span)).alias("slot")).distinct()
    near = (
        grid_cell(full.select("ts", "user_id", "pc", "x", "y"), size)
        .select("gx", "gy", "ts", "user_id", "pc", micros("ts").alias("at"))
        .withColumn("slot", slot)
        .join(broadcast_if_small(stage(seen, "sampled-slots")), ["gx", "gy", "slot"], "left_semi")
    )
    # Read for events and for presence. Said once that cells are not NULL, both reads of the steps stay alike.
    near = stage(near, "near-placements").filter("gx IS NOT NULL AND gy IS NOT NULL")

    # Sampled rows take part with steps of zero, so that their piece always has a sum.
    numbers = ["events", "users", "colors"]
    zeros = [F.lit(0).cast("long").alias(n) for n in numbers]
    piece = (F.col("at") - F.pmod(F.col("at"), F.lit(width).cast("long"))).alias("piece")
    steps = (
        _event_steps(near, span).unionByName(_presence_steps(near, span))
        .unionByName(asked.filter("gx IS NOT NULL AND gy IS NOT NULL").select("gx", "gy", "at", *zeros))
    )
    asked = asked.select("event_id", "gx", "gy", piece, "at")

    # Steps are added up per piece, and per instant only in pieces with sampled rows.
    # Both levels read the result of this one shuffle.
    pieces = asked.select("gx", "gy", "piece").distinct().withColumn("is_asked", F.lit(True))
    steps = (
        steps.select("gx", "gy", piece, "at", *numbers)
        .join(broadcast_if_small(stage(pieces, "sampled-pieces")), ["gx", "gy", "piece"], "left")
        .groupBy("gx", "gy", "piece", F.when(F.col("is_asked"), F.col("at")).alias("at"))
        .agg(*[F.sum(n).alias(n) for n in numbers])
    )

    # Level 1: what all earlier pieces of the cell add up to.
    whole = steps.groupBy("gx", "gy", "piece").agg(*[F.sum(n).alias(n) for n in numbers])
    earlier = Window.partitionBy("gx", "gy").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select("gx", "gy", "piece", *[F.sum(n).over(earlier).alias(f"c_{n}") for n in numbers])

    # Level 2: the steps inside the piece, strictly before the sampled instant. There
    # is one row of steps per instant, and sampled rows sort ahead of it.
    inside = (
        steps.withColumn("event_id", F.lit(None).cast("long"))
        .unionByName(asked.select("*", *zeros))
    )
    so_far = (
        Window.partitionBy("gx", "gy", "piece").orderBy("at", F.asc_nulls_last("event_id"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    within = inside.select("gx", "gy", "piece", "event_id", *[F.sum(n).over(so_far).alias(f"w_{n}") for n in numbers])
    total = {n: F.coalesce(f"c_{n}", F.lit(0)) + F.coalesce(f"w_{n}", F.lit(0)) for n in numbers}
    return within.filter(F.col("event_id").isNotNull()).join(carried, ["gx", "gy", "piece"], "left").select(
        "event_id",
        total["events"].alias("local_event_count"),
        total["users"].alias("local_unique_users"),
        total["colors"].alias("local_unique_colors"),
    )


def _event_steps(near: DataFrame, span: int) -> DataFrame:
    """+1 at each placement and -1 a lookback later."""
    zero = F.lit(0).cast("long")
    return _changes(near, (F.col("at"), F.lit(1)), (F.col("at") + span, F.lit(-1))).select(
        "gx", "gy", "at", F.col("step").alias("events"), zero.alias("users"), zero.alias("colors"))


def _presence_steps(near: DataFrame, span: int) -> DataFrame:
    """+1 where a user or colour comes into view in a cell, -1 where it leaves; NULL is neither."""
    no_user, no_color = F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("pc")
    members = near.select("gx", "gy", "ts", F.inline(F.array(
        F.struct(F.col("user_id"), no_color), F.struct(no_user, F.col("pc")),
    ))).filter(F.col("user_id").isNotNull() | F.col("pc").isNotNull())
    member = ["gx", "gy", "user_id", "pc"]
    order = Window.partitionBy(*member).orderBy("first")
    runs = activity_slots(members, member, span / MICROS).select(
        *member, micros("first_ts").alias("first"), micros("last_ts").alias("last"),
    ).select(
        "*", F.lag("last").over(order).alias("previous"), F.lead("first").over(order).alias("following"),
    )
    comes = F.when(F.col("first") - F.col("previous") <= span, 0).otherwise(1)
    leaves = F.when(F.col("following") - F.col("last") <= span, 0).otherwise(-1)
    zero = F.lit(0).cast("long")
    return _changes(runs, (F.col("first"), comes), (F.col("last") + span, leaves)).filter("step <> 0").select(
        "gx", "gy", "at", zero.alias("events"),
        F.when(F.col("user_id").isNotNull(), F.col("step")).otherwise(zero).alias("users"),
        F.when(F.col("pc").isNotNull(), F.col("step")).otherwise(zero).alias("colors"),
    )


def _changes(df: DataFrame, *changes: tuple[Column, Column]) -> DataFrame:
    """The rows of `df` once for each change, with where it happens (`at`) and by how much (`step`)."""
    both = F.array(*[F.struct(at.alias("at"), step.cast("long").alias("step")) for at, step in changes])
    return df.select(*[c for c in df.columns if c != "at"], F.inline(both))


def survival_features(full: DataFrame, sample: DataFrame, minutes: float = 30, size: int = 20,
                      lookback_minutes: float = 10) -> DataFrame:
    """The model table: one row per sampled placement with its label and six features.

    Everything a feature uses lies before the placement. The joins are between
    tables of the sample's length, on the row id.
    """
    label, back = f"y_survives_{minutes}m", f"{lookback_minutes}m"
    local = neighborhood_activity(full, sample, size, lookback_minutes)
    start = full.agg(F.min("ts").alias("start")).scalar()
    return (
        pixel_timeline(full, sample).join(local, "event_id", "left")
        .select(
            "event_id", "ts", "user_id", "pc", "x", "y",
            survives(minutes).alias(label),
            ((epoch_seconds("ts") - epoch_seconds(start)) / F.lit(60.0)).alias("minutes_since_start"),
            "prior_changes_at_pixel", "time_since_last_change_sec",
            *[F.coalesce(c, F.lit(0)).alias(f"{c}_{back}")
              for c in ("local_event_count", "local_unique_users", "local_unique_colors")],
        )
    )


def feature_names(lookback_minutes: float = 10) -> list[str]:
    """The model inputs. Coordinates are left out, so that no pixel is learnt by heart."""
    back = f"{lookback_minutes}m"
    return ["minutes_since_start", "prior_changes_at_pixel", "time_since_last_change_sec",
            f"local_event_count_{back}", f"local_unique_users_{back}", f"local_unique_colors_{back}"]
