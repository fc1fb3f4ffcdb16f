"""The baseline report and the three irregular-activity reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from muralog.operators import activity, baseline, charts, churn, diversity, newcomers, sessions
from muralog.operators.cohorts import placements_of
from muralog.sources.scratch import stage


def baseline_report(df: DataFrame, start, end, gap_seconds: float = 15 * 60) -> dict[str, DataFrame]:
    """Colour rank, session length, percentiles and first-time users of one window."""
    if datetime.fromisoformat(str(end)) <= datetime.fromisoformat(str(start)):
        raise ValueError("the window must end after it starts")
    return {
        "color_rank": baseline.color_rank(df, start, end),
        "avg_session_length": sessions.avg_session_length(df, start, end, gap_seconds),
        "placement_percentiles": baseline.placement_percentiles(df, start, end),
        "first_time_users": baseline.first_time_users(df, start, end),
    }


def contested_pixels_report(df: DataFrame, churn_edits: int = 50, hot_edits: int = 100, focus_edits: int = 1000,
                            users: int = 50, gap_seconds: float = 30 * 60) -> dict[str, DataFrame]:
    """Contested pixels, their users, and how those users behave.

    Edits per pixel are counted once and staged; every threshold reads that table.
    """
    pixels = stage(churn.pixel_churn(df), "pixel-churn")
    hot = pixels.filter(f"edits > {hot_edits}")
    hottest = pixels.filter(f"edits > {focus_edits}")
    ranked = stage(churn.hot_pixel_users(df, hot), "hot-pixel-users")
    top = stage(churn.top_users(ranked, users), "top-users")
    of_top = stage(placements_of(df, top), "top-placements")  # their deltas and sessions need no other rows
    deltas = stage(sessions.inter_placement_deltas(of_top), "deltas")
    all_sessions = stage(sessions.user_sessions(df, None, gap_seconds), "sessions")
    top_sessions = placements_of(all_sessions, top)
    focus = stage(churn.hot_edit_focus(of_top, top, hottest), "focus")
    return {
        "pixel_churn": pixels,
        "high_churn_pixels": pixels.filter(f"edits > {churn_edits}").orderBy("edits", ascending=False),
        "hot_pixel_users": ranked,
        "inter_placement_deltas": deltas,
        "user_cadence": sessions.user_cadence(deltas),
        "delta_histogram": charts.histogram(deltas, "delta_seconds", 100, log10=True),
        "user_sessions": top_sessions,
        "session_histogram": charts.histogram(top_sessions, "session_length_min", 50, log10=True),
        "user_sessions_overall": all_sessions,
        "session_histogram_overall": charts.histogram(all_sessions, "session_length_min", 50, log10=True),
        "hot_edit_focus": focus,
        "focus_histogram": charts.histogram(focus, "hot_edit_ratio", 30),
    }


def low_diversity_report(df: DataFrame, min_edits: int = 200, max_colors: int = 2, top: int = 5) -> dict[str, DataFrame]:
    """Users of very few colours and where they place them."""
    use = stage(diversity.color_use(df), "color-use")
    users = stage(diversity.low_diversity_users(df, min_edits, max_colors, use), "low-diversity-users")
    cohort = stage(placements_of(df.select("user_id", "x", "y"), users), "low-diversity-placements")
    extreme = diversity.top_cohort_placements(cohort, users, top)
    return {
        "low_diversity_users": users,
        "placement_map": charts.bin2d(cohort, 120),
        "top_user_maps": charts.bin2d(extreme, 80, facet="user_id"),
        "user_spread": diversity.user_spread(cohort, users),
        "dominant_color_share": diversity.dominant_color_share(df, use),
        "diversity_histogram": diversity.color_diversity_distribution(df, use=use),
    }


def newcomer_spike_report(df: DataFrame, minute, around: tuple | None = None, unit: str = "minute",
                          short_minutes: int = 5, long_minutes: int = 1000) -> dict[str, DataFrame]:
    """A surge of first-time users: how unusual it is, where they place and how long they stay."""
    bounds = stage(newcomers.user_bounds(df), "user-bounds")
    spans = stage(newcomers.spike_lifespans(df, minute, unit, bounds), "spike-lifespans")
    short = newcomers.lifespan_cohort_placements(df, spans, max_minutes=short_minutes)
    long = newcomers.lifespan_cohort_placements(df, spans, min_minutes=long_minutes)
    report = {
        "activity_per_minute": activity.activity_per_minute(df, unit),
        "top_minutes": activity.top_minutes(df, unit=unit),
        "minute_heatmap": activity.minute_heatmap(df, minute, unit),
        "active_users_per_minute": activity.active_users_per_minute(df, unit),
        "newcomers_per_minute": newcomers.newcomers_per_minute(df, unit, bounds),
        "spike_summary": newcomers.spike_summary(df, minute, unit, bounds),
        "new_user_spikes": newcomers.new_user_spikes(df, unit=unit, bounds=bounds),
        "spike_lifespans": spans,
        "spike_lifespan_summary": newcomers.spike_lifespan_summary(df, minute, unit, bounds),
        "lifespan_histogram": charts.histogram(spans, "lifespan_minutes", 50),
        "short_lived_map": charts.bin2d(short, 100),
        "long_lived_map": charts.bin2d(long, 100),
    }
    if around:
        report["activity_in_range"] = activity.activity_in_range(df, *around, unit)
    return report
