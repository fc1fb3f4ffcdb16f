"""The queries of the catalog as SQL over the given tables."""

from __future__ import annotations

from checks import fixture as fx

_COLORS = " ".join(f"WHEN '{kind}' THEN '{code}'" for kind, code in fx.COLORS.items())
_GAP = f"INTERVAL {fx.SESSION_GAP // 60} MINUTE"
_W0, _W1 = (f"TIMESTAMP '{t}'" for t in fx.WINDOW)
_F0, _F1 = (f"TIMESTAMP '{t}'" for t in fx.FIRST_WINDOW)
_SPIKE = f"TIMESTAMP '{fx.SPIKE}'"
_LABEL = f"y_survives_{fx.SURVIVE_MINUTES}m"
_BACK = f"{fx.LOOKBACK_MINUTES}m"
_FEATURES = ["minutes_since_start", "prior_changes_at_pixel", "time_since_last_change_sec",
             *[f"local_{c}_{_BACK}" for c in ("event_count", "unique_users", "unique_colors")]]

# Named steps; a query lists the ones it starts from.
STEPS = {
    "p": ([], f"""
        SELECT event_id, ts, user_id, CASE event_type {_COLORS} END AS pc,
               CAST(least(floor(value / 4), 39) AS INTEGER) AS x,
               CAST(json_extract_string(props, '$.k') AS INTEGER) % 40 AS y
        FROM events"""),
    "pixels": (["p"], "SELECT x, y, count(*) AS edits FROM p GROUP BY x, y"),
    "hot_users": (["pixels"], f"""
        SELECT user_id, count(*) AS edits_on_hot_pixels
        FROM p JOIN pixels USING (x, y) WHERE edits > {fx.HOT} GROUP BY user_id"""),
    "top": (["hot_users"], f"""
        SELECT * FROM hot_users ORDER BY edits_on_hot_pixels DESC, user_id LIMIT {fx.TOP_USERS}"""),
    "deltas": (["top"], """
        SELECT event_id, user_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6 AS delta_seconds
        FROM p WHERE user_id IN (SELECT user_id FROM top)"""),
    "marked": (["p"], f"""
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= {_GAP} THEN 0 ELSE 1 END AS opens FROM p"""),
    "numbered": (["marked"], "SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session_id FROM marked"),
    "all_sessions": (["numbered"], """
        SELECT user_id, CAST(session_id AS BIGINT) AS session_id, min(ts) AS start_ts, max(ts) AS end_ts,
               date_diff('minute', min(ts), max(ts)) AS session_length_min
        FROM numbered GROUP BY user_id, session_id"""),
    "top_sessions": (["all_sessions", "top"], "SELECT * FROM all_sessions WHERE user_id IN (SELECT user_id FROM top)"),
    "focus": (["top"], f"""
        SELECT user_id, count(*) AS total_edits, count(*) FILTER (edits > {fx.HOTTEST}) AS hot_edits,
               count(*) FILTER (edits > {fx.HOTTEST}) * 1.0 / count(*) AS hot_edit_ratio
        FROM p JOIN pixels USING (x, y) WHERE user_id IN (SELECT user_id FROM top) GROUP BY user_id"""),
    "color_use": (["p"], """
        SELECT user_id, count(DISTINCT pc) AS total_colors, count(*) AS total_edits,
               count(DISTINCT pc) * 1.0 / count(*) AS color_diversity_ratio
        FROM p GROUP BY user_id"""),
    "low": (["color_use"], f"""
        SELECT * FROM color_use WHERE total_edits > {fx.LOW_DIVERSITY['min_edits']}
        AND total_colors <= {fx.LOW_DIVERSITY['max_colors']}"""),
    "low_xy": (["low"], "SELECT user_id, x, y FROM p WHERE user_id IN (SELECT user_id FROM low)"),
    "extreme_xy": (["low"], """
        SELECT user_id, x, y FROM p WHERE user_id IN (
            SELECT user_id FROM low ORDER BY color_diversity_ratio, total_edits DESC, user_id LIMIT 5)"""),
    "bounds": (["p"], "SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts FROM p GROUP BY user_id"),
    "new_per_unit": (["bounds"], f"""
        SELECT date_trunc('{fx.UNIT}', first_ts) AS minute, count(*) AS first_time_users FROM bounds GROUP BY 1"""),
    "spans": (["bounds"], f"""
        SELECT user_id, first_ts, last_ts, date_diff('minute', first_ts, last_ts) AS lifespan_minutes,
               date_diff('second', first_ts, last_ts) AS lifespan_seconds
        FROM bounds WHERE date_trunc('{fx.UNIT}', first_ts) = {_SPIKE}"""),
    "short_xy": (["spans"], f"""
        SELECT x, y FROM p WHERE user_id IN (SELECT user_id FROM spans WHERE lifespan_minutes <= {fx.SHORT})"""),
    "long_xy": (["spans"], f"""
        SELECT x, y FROM p WHERE user_id IN (SELECT user_id FROM spans WHERE lifespan_minutes >= {fx.LONG})"""),
    "binned": (["p"], f"""
        SELECT p.*, least({fx.N_BINS - 1}, greatest(0, CAST(floor(
            {fx.N_BINS} * (epoch(ts) - epoch(t0)) / nullif(epoch(t1) - epoch(t0), 0)) AS INTEGER))) AS time_bin
        FROM p, (SELECT min(ts) AS t0, max(ts) AS t1 FROM p)"""),
    "sampled": (["binned"], f"""
        SELECT event_id, ts, user_id, pc, x, y FROM (
            SELECT *, row_number() OVER (PARTITION BY time_bin
                ORDER BY md5(concat_ws('|', event_id, '{fx.SEED}')), event_id) AS r FROM binned)
        WHERE r <= {fx.N_TOTAL // fx.N_BINS}"""),
    "timeline": (["p"], f"""
        SELECT *, lead(ts) OVER w AS next_ts, row_number() OVER w - 1 AS prior_changes_at_pixel,
               coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 1e9) AS time_since_last_change_sec,
               CAST(floor(x / {fx.GRID}) AS INTEGER) AS gx, CAST(floor(y / {fx.GRID}) AS INTEGER) AS gy
        FROM p WINDOW w AS (PARTITION BY x, y ORDER BY ts, event_id)"""),
    "asked": (["timeline"], f"""
        SELECT * FROM timeline ORDER BY md5(concat_ws('|', event_id, '{fx.SEED}')), event_id LIMIT {fx.N_ASKED}"""),
    "near_pairs": (["asked"], f"""
        SELECT s.event_id, s.ts, f.event_id AS near_event_id FROM asked s JOIN timeline f ON f.gx = s.gx AND f.gy = s.gy
             AND f.ts >= s.ts - INTERVAL {fx.LOOKBACK_MINUTES} MINUTE AND f.ts < s.ts"""),
    "labeled": (["timeline"], f"""
        SELECT *, CASE WHEN next_ts IS NULL OR (epoch_us(next_ts) - epoch_us(ts)) / 6e7 >= {fx.SURVIVE_MINUTES}
                       THEN 1 ELSE 0 END AS {_LABEL} FROM timeline"""),
    "local": (["labeled"], f"""
        SELECT s.event_id, count(f.ts) AS local_event_count, count(DISTINCT f.user_id) AS local_unique_users,
               count(DISTINCT f.pc) AS local_unique_colors
        FROM labeled s LEFT JOIN labeled f ON f.gx = s.gx AND f.gy = s.gy
             AND f.ts >= s.ts - INTERVAL {fx.LOOKBACK_MINUTES} MINUTE AND f.ts < s.ts
        GROUP BY s.event_id"""),
    "features": (["local"], f"""
        SELECT event_id, ts, user_id, pc, x, y, {_LABEL},
               round((epoch(ts) - epoch((SELECT min(ts) FROM p))) / 60.0, 6) AS minutes_since_start,
               prior_changes_at_pixel, round(time_since_last_change_sec, 6) AS time_since_last_change_sec,
               local_event_count AS local_event_count_{_BACK}, local_unique_users AS local_unique_users_{_BACK},
               local_unique_colors AS local_unique_colors_{_BACK}
        FROM labeled JOIN local USING (event_id)"""),
    "folds": (["labeled", "sampled"], f"""
        SELECT event_id, {_LABEL}, CASE WHEN ntile(5) OVER (ORDER BY ts, event_id) <= 4 THEN 'train' ELSE 'test' END AS part
        FROM labeled WHERE event_id IN (SELECT event_id FROM sampled)"""),
    "guessed": (["labeled"], f"""
        SELECT *, {_LABEL} AS label, CASE WHEN prior_changes_at_pixel <= 3 THEN 1 ELSE 0 END AS guess FROM labeled"""),
    "by_class": (["guessed"], """
        SELECT c AS class, count(*) FILTER (label = c) AS support, count(*) FILTER (guess = c) AS guessed,
               count(*) FILTER (label = c AND guess = c) AS hit
        FROM guessed, (VALUES (0), (1)) AS classes(c) GROUP BY c"""),
    "scores": (["by_class"], """
        SELECT *, coalesce(hit * 1.0 / nullif(guessed, 0), 0) AS precision, coalesce(hit * 1.0 / nullif(support, 0), 0) AS recall,
               coalesce(2.0 * hit / nullif(guessed + support, 0), 0) AS f1_score FROM by_class"""),
    "attribution": (["labeled"], f"""
        SELECT 'prior_changes_at_pixel' AS feature, CAST(prior_changes_at_pixel AS DOUBLE) AS value,
               ({_LABEL} - 0.5) * prior_changes_at_pixel::DOUBLE AS contribution FROM labeled
        UNION ALL
        SELECT 'log_time_since_last_change', ln(1 + time_since_last_change_sec),
               ({_LABEL} - 0.5)::DOUBLE / (ln(1 + time_since_last_change_sec) + 1) FROM labeled"""),
}


def _sql(body: str, *steps: str) -> str:
    """Put the steps a query needs, in order, in front of it."""
    needed: list[str] = []

    def add(name: str) -> None:
        for earlier in STEPS[name][0]:
            add(earlier)
        if name not in needed:
            needed.append(name)

    for step in steps:
        add(step)
    return "WITH " + ",\n".join(f"{n} AS ({STEPS[n][1]})" for n in needed) + "\n" + body


def _grid(source: str, bins: int, facet: str = "") -> str:
    facet = f"{facet}, " if facet else ""
    place = "least({b}, greatest(0, coalesce(CAST(floor(({c} - {c}0)::DOUBLE * {n} / nullif({c}1 - {c}0, 0)) AS INTEGER), 0))) AS {c}_bin"
    x, y = (place.format(c=c, b=bins - 1, n=bins) for c in "xy")
    return f"""
        SELECT {facet}x_bin, y_bin, count(*) AS n FROM (
            SELECT {facet}{x}, {y}
            FROM {source}, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {source}))
        GROUP BY ALL"""


def _histogram(source: str, column: str, bins: int, log10: bool = False) -> str:
    axis = f"CASE WHEN {column} > 0 THEN log10({column}) END" if log10 else f"CAST({column} AS DOUBLE)"
    low, high = "a0 + bin * (a1 - a0) / {n}", "a0 + (bin + 1) * ((a1 - a0) / {n})"
    low = "a0 + bin * ((a1 - a0) / {n})"
    low, high = low.format(n=bins), high.format(n=bins)
    if log10:
        low, high = f"pow(10.0, {low})", f"pow(10.0, {high})"
    return f"""
        , axis AS (SELECT {axis} AS a FROM {source} WHERE {column} IS NOT NULL)
        , ends AS (SELECT min(a) AS a0, max(a) AS a1 FROM axis)
        , placed AS (
            SELECT CASE WHEN a IS NULL THEN -1 ELSE least({bins - 1}, greatest(0,
                   coalesce(CAST(floor((a - a0) * {bins} / nullif(a1 - a0, 0)) AS INTEGER), 0))) END AS bin FROM axis, ends)
        SELECT bin, CASE WHEN bin >= 0 THEN round({low}, 6) END AS bin_low,
               CASE WHEN bin >= 0 THEN round({high}, 6) END AS bin_high, count(*) AS n
        FROM placed, ends GROUP BY bin, a0, a1"""


ORACLES = {
    "ingest_placements": _sql("SELECT ts, pc, x, y FROM p", "p"),
    "ingest_csv_to_parquet": _sql("""
        SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, min(ts) AS first_ts,
               CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y
        FROM p GROUP BY CAST(ts AS DATE), user_id""", "p"),
    "color_rank": _sql(f"""
        , named AS (
            SELECT user_id, CASE pc WHEN '#000000' THEN 'Black' WHEN '#FF4500' THEN 'Orange' WHEN '#FFFFFF' THEN 'White'
                                    WHEN '#2450A4' THEN 'Dark Blue' END AS color
            FROM p WHERE ts >= {_W0} AND ts < {_W1})
        , counted AS (SELECT color, count(DISTINCT user_id) AS user_count FROM named GROUP BY color)
        SELECT CAST(row_number() OVER (ORDER BY user_count DESC, color NULLS LAST) AS INTEGER) AS position, color, user_count
        FROM counted""", "p"),
    "avg_session_length": _sql(f"""
        , base AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM p WHERE ts >= {_W0} AND ts < {_W1})
        , flags AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= {_GAP} THEN 0 ELSE 1 END AS opens
                    FROM base WHERE n > 1)
        , ids AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM flags)
        , lengths AS (SELECT date_diff('second', min(ts), max(ts)) AS len FROM ids GROUP BY user_id, s)
        SELECT round(avg(len), 6) AS avg_session_seconds FROM lengths""", "p"),
    "placement_percentiles": _sql(f"""
        , counts AS (SELECT count(*) AS n FROM p WHERE ts >= {_W0} AND ts < {_W1} GROUP BY user_id)
        SELECT quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.75) AS p75, quantile_disc(n, 0.9) AS p90,
               quantile_disc(n, 0.99) AS p99 FROM counts""", "p"),
    "first_time_users": _sql(f"""
        SELECT count(*) AS first_time_users FROM bounds WHERE first_ts >= {_F0} AND first_ts < {_F1}""", "bounds"),
    "pixel_churn": _sql("SELECT * FROM pixels", "pixels"),
    "high_churn_pixels": _sql(f"SELECT * FROM pixels WHERE edits > {fx.CHURN}", "pixels"),
    "hot_pixels": _sql(f"SELECT x, y FROM pixels WHERE edits > {fx.HOT}", "pixels"),
    "hottest_pixels": _sql(f"SELECT x, y FROM pixels WHERE edits > {fx.HOTTEST}", "pixels"),
    "hot_pixel_users": _sql("SELECT * FROM hot_users", "hot_users"),
    "top_users": _sql("SELECT * FROM top", "top"),
    "inter_placement_deltas": _sql("""
        SELECT event_id, user_id, ts, round(delta_seconds, 6) AS delta_seconds FROM deltas
        WHERE delta_seconds IS NOT NULL""", "deltas"),
    "user_sessions": _sql("SELECT * FROM top_sessions", "top_sessions"),
    "user_sessions_overall": _sql("SELECT * FROM all_sessions", "all_sessions"),
    "hot_edit_focus": _sql("""
        SELECT user_id, total_edits, hot_edits, round(hot_edit_ratio, 6) AS hot_edit_ratio FROM focus""", "focus"),
    "low_diversity_users": _sql("""
        SELECT user_id, total_colors, total_edits, round(color_diversity_ratio, 6) AS color_diversity_ratio FROM low""", "low"),
    "cohort_placements": _sql("SELECT x, y FROM low_xy", "low_xy"),
    "top_cohort_placements": _sql("SELECT user_id, x, y FROM extreme_xy", "extreme_xy"),
    "dominant_color_share": _sql("""
        , per_color AS (SELECT user_id, count(*) AS n FROM p GROUP BY user_id, pc)
        SELECT user_id, round(max(n) * 1.0 / sum(n), 6) AS dominant_color_share FROM per_color GROUP BY user_id""", "p"),
    "color_diversity_distribution": _sql(_histogram("color_use", "color_diversity_ratio", 50), "color_use"),
    "activity_per_minute": _sql("""
        SELECT date_trunc('minute', ts) AS minute, count(*) AS placements FROM p GROUP BY 1""", "p"),
    "top_minutes": _sql("""
        SELECT date_trunc('minute', ts) AS minute, count(*) AS placements FROM p GROUP BY 1
        ORDER BY placements DESC, minute LIMIT 10""", "p"),
    "activity_in_range": _sql(f"""
        SELECT date_trunc('minute', ts) AS minute, count(*) AS placements FROM p
        WHERE ts BETWEEN TIMESTAMP '{fx.RANGE[0]}' AND TIMESTAMP '{fx.RANGE[1]}' GROUP BY 1""", "p"),
    "minute_heatmap": _sql(f"""
        SELECT x, y, count(*) AS edits FROM p WHERE date_trunc('{fx.UNIT}', ts) = {_SPIKE} GROUP BY x, y""", "p"),
    "active_users_per_minute": _sql("""
        SELECT date_trunc('minute', ts) AS minute, count(DISTINCT user_id) AS active_users FROM p GROUP BY 1""", "p"),
    "spike_first_time_users": _sql("SELECT count(*) AS first_time_users FROM spans", "spans"),
    "first_time_user_baseline": _sql("""
        SELECT round(avg(first_time_users), 6) AS mean_first_users_per_minute,
               round(stddev_samp(first_time_users), 6) AS std_first_users_per_min FROM new_per_unit""", "new_per_unit"),
    "spike_summary": _sql(f"""
        , stats AS (
            SELECT coalesce(max(first_time_users) FILTER (minute = {_SPIKE}), 0) AS spike_count,
                   avg(first_time_users) AS mean_count, stddev_samp(first_time_users) AS std_count FROM new_per_unit)
        SELECT {_SPIKE} AS spike_minute, spike_count, round(mean_count, 6) AS mean_count, round(std_count, 6) AS std_count,
               round((spike_count - mean_count) / std_count, 6) AS z_score FROM stats""", "new_per_unit"),
    "spike_lifespans": _sql("SELECT * FROM spans", "spans"),
    "spike_lifespan_summary": _sql("""
        SELECT count(*) AS spike_new_users, round(avg(lifespan_minutes), 6) AS avg_lifespan_min,
               round(stddev_samp(lifespan_minutes), 6) AS std_lifespan_min,
               round(quantile_cont(lifespan_minutes, 0.5), 6) AS median_lifespan_min,
               round(quantile_cont(lifespan_minutes, 0.9), 6) AS p90_lifespan_min FROM spans""", "spans"),
    "short_lived_placements": _sql("SELECT x, y FROM short_xy", "short_xy"),
    "long_lived_placements": _sql("SELECT x, y FROM long_xy", "long_xy"),
    "new_user_spikes": _sql("""
        , b AS (SELECT avg(first_time_users) AS m, stddev_samp(first_time_users) AS s FROM new_per_unit)
        SELECT minute, first_time_users, round((first_time_users - m) / s, 6) AS z_score
        FROM new_per_unit, b WHERE (first_time_users - m) / s >= 1.0""", "new_per_unit"),
    "time_bin": _sql("SELECT event_id, time_bin FROM binned", "binned"),
    "stratified_time_sample": _sql("SELECT * FROM sampled", "sampled"),
    "uniform_sample": _sql(f"""
        SELECT * FROM p ORDER BY md5(concat_ws('|', event_id, '{fx.SEED}')), event_id LIMIT 1500""", "p"),
    "midpoint_slice": _sql("""
        , mid AS (SELECT make_timestamp(CAST((min(epoch_us(ts)) + max(epoch_us(ts)) + 1) // 2 AS BIGINT)) AS t FROM p)
        SELECT p.* FROM p, mid WHERE ts >= t AND ts < t + INTERVAL 180 MINUTE""", "p"),
    "temporal_split": _sql("""
        SELECT event_id, CASE WHEN ntile(5) OVER (ORDER BY ts, event_id) <= 4 THEN 'train' ELSE 'test' END AS part FROM p""", "p"),
    "survival_label": _sql(f"SELECT event_id, ts, next_ts, {_LABEL} FROM labeled", "labeled"),
    "pixel_history": _sql("""
        SELECT event_id, prior_changes_at_pixel, round(time_since_last_change_sec, 6) AS time_since_last_change_sec
        FROM timeline""", "timeline"),
    "grid_cell": _sql("SELECT event_id, gx, gy FROM timeline", "timeline"),
    "neighborhood_activity": _sql("SELECT * FROM local", "local"),
    "survival_features": _sql("SELECT * FROM features", "features"),
    "sampled_survival_features": _sql(
        "SELECT * FROM features WHERE event_id IN (SELECT event_id FROM sampled)", "features", "sampled"),
    "classification_report": _sql("""
        SELECT CAST(class AS VARCHAR) AS class, round(precision, 6) AS precision, round(recall, 6) AS recall,
               round(f1_score, 6) AS f1_score, support FROM scores
        UNION ALL
        SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scores
        UNION ALL
        SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
               CAST(sum(support) AS BIGINT) FROM scores
        UNION ALL
        SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
               round(sum(f1_score * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scores""", "scores"),
    "confusion_matrix": _sql("""
        SELECT label, count(*) FILTER (guess = 0) AS predicted_0, count(*) FILTER (guess = 1) AS predicted_1
        FROM guessed GROUP BY label""", "guessed"),
    "feature_importance": _sql("""
        SELECT feature, round(avg(abs(contribution)), 6) AS importance FROM attribution GROUP BY feature""", "attribution"),
    "attribution_direction": _sql("""
        SELECT feature, round(corr(value, contribution), 6) AS correlation,
               CAST(sign(corr(value, contribution)) AS INTEGER) AS direction FROM attribution GROUP BY feature""", "attribution"),
    "binned_mean_map": _sql(f"""
        , ends AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM labeled)
        SELECT CAST(greatest(0, ceil((x - x0)::DOUBLE * 12 / (x1 - x0)) - 1) AS INTEGER) AS x_bin,
               CAST(greatest(0, ceil((y - y0)::DOUBLE * 12 / (y1 - y0)) - 1) AS INTEGER) AS y_bin,
               round(avg({_LABEL}), 6) AS avg_survival_prob
        FROM labeled, ends GROUP BY 1, 2""", "labeled"),
    "delta_histogram": _sql(_histogram("deltas", "delta_seconds", 100, log10=True), "deltas"),
    "session_histogram": _sql(_histogram("top_sessions", "session_length_min", 50, log10=True), "top_sessions"),
    "session_histogram_overall": _sql(_histogram("all_sessions", "session_length_min", 50, log10=True), "all_sessions"),
    "focus_histogram": _sql(_histogram("focus", "hot_edit_ratio", 30), "focus"),
    "lifespan_histogram": _sql(_histogram("spans", "lifespan_minutes", 50), "spans"),
    "cohort_map": _sql(_grid("low_xy", 120), "low_xy"),
    "top_cohort_maps": _sql(_grid("extreme_xy", 80, "user_id"), "extreme_xy"),
    "short_lived_map": _sql(_grid("short_xy", 100), "short_xy"),
    "long_lived_map": _sql(_grid("long_xy", 100), "long_xy"),
    "fit_survival_model": _sql(f"""
        SELECT {_LABEL} AS label, count(*) AS n, round((SELECT count(*) FROM folds WHERE part = 'train') / 2.0, 6) AS weight,
               CAST(150 AS BIGINT) AS trees, CAST(1.0 AS DOUBLE) AS total_importance
        FROM folds WHERE part = 'train' GROUP BY 1""", "folds"),
    "score_survival": _sql(f"""
        SELECT event_id, {_LABEL}, true AS is_probability, true AS prediction_follows FROM folds WHERE part = 'test'""", "folds"),
    "path_attribution": _sql(f"""
        , test AS (SELECT * FROM features JOIN folds USING (event_id) WHERE part = 'test')
        {" UNION ALL ".join(f"SELECT event_id, '{c}' AS feature, round({c}::DOUBLE, 6) AS value, true AS adds_up FROM test" for c in _FEATURES)}""",
        "features", "folds"),
    "survival_round_trip": _sql(f"""
        SELECT part, {_LABEL} AS label, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (
            SELECT part, {_LABEL}, event_id FROM folds UNION ALL SELECT 'features', {_LABEL}, event_id FROM folds)
        GROUP BY 1, 2""", "folds"),
    "class_balance": _sql(f"""
        SELECT {_LABEL} AS label, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM folds WHERE part = 'train'), 6) AS share
        FROM folds WHERE part = 'train' GROUP BY 1""", "folds"),
    "appended_pixel_history": _sql("""
        SELECT ts, x, y, prior_changes_at_pixel, round(time_since_last_change_sec, 6) AS time_since_last_change_sec
        FROM timeline""", "timeline"),
    "cut_pixel_history": _sql("""
        SELECT event_id, prior_changes_at_pixel, round(time_since_last_change_sec, 6) AS time_since_last_change_sec
        FROM timeline""", "timeline"),
    "newcomers_per_minute": _sql("SELECT * FROM new_per_unit", "new_per_unit"),
    "newcomers_per_quarter": _sql("""
        SELECT count(*) AS first_time_users FROM bounds WHERE date_trunc('quarter', first_ts) = TIMESTAMP '2024-01-01'""", "bounds"),
    "user_cadence": _sql("""
        , counts AS (SELECT user_id, CAST(floor(delta_seconds / 3600) AS BIGINT) AS i, count(*) AS n
                     FROM deltas WHERE delta_seconds IS NOT NULL GROUP BY 1, 2),
          ranked AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS deltas,
                            row_number() OVER (PARTITION BY user_id ORDER BY n DESC, i) AS r FROM counts)
        SELECT user_id, CAST(deltas AS BIGINT) AS deltas, CAST(i * 3600 AS DOUBLE) AS common_interval_sec,
               round(n * 1.0 / deltas, 6) AS common_share FROM ranked WHERE r = 1""", "deltas"),
    "user_spread": _sql("""
        SELECT user_id, count(*) AS placements, round(avg(x), 6) AS center_x, round(avg(y), 6) AS center_y,
               round(sqrt(var_pop(x) + var_pop(y)), 6) AS spread FROM low_xy GROUP BY user_id""", "low_xy"),
    "time_rank": _sql("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS time_rank FROM p", "p"),
    "time_fold": _sql("SELECT event_id, CAST(ntile(5) OVER (ORDER BY ts, event_id) AS INTEGER) AS fold FROM p", "p"),
    "uneven_time_fold": _sql("""
        , f AS (SELECT ts, CAST(ntile(7) OVER (ORDER BY ts, event_id) AS INTEGER) AS fold FROM p)
        SELECT fold, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM f GROUP BY fold""", "p"),
    "forward_chaining": _sql("""
        , f AS (SELECT ts, ntile(5) OVER (ORDER BY ts, event_id) AS fold FROM p)
        SELECT CAST(r AS INTEGER) AS round, CASE WHEN fold < r THEN 'train' ELSE 'test' END AS part,
               count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts
        FROM f, range(2, 6) AS rounds(r) WHERE fold <= r GROUP BY 1, 2""", "p"),
    "neighbors_before": _sql("""
        SELECT s.event_id, f.event_id AS near_event_id, f.user_id AS near_user_id, f.pc AS near_pc,
               round((epoch_us(s.ts) - epoch_us(f.ts)) / 1e6, 6) AS seconds_before FROM near_pairs s JOIN timeline f ON f.event_id = s.near_event_id""",
        "near_pairs"),
    "neighborhood_profile": _sql("""
        SELECT a.event_id, count(f.event_id) AS n_near, coalesce(max_by(f.event_id, {'t': f.ts, 'i': f.event_id}), -1) AS last_near_event_id,
               round(CAST(sum(epoch_us(a.ts) - epoch_us(f.ts)) AS DOUBLE) / nullif(count(f.event_id), 0) / 1e6, 6) AS mean_seconds_before,
               round(avg(CASE WHEN f.event_id IS NULL THEN NULL WHEN a.pc IS NOT DISTINCT FROM f.pc THEN 1 ELSE 0 END), 6) AS same_color_share
        FROM asked a LEFT JOIN near_pairs n USING (event_id) LEFT JOIN timeline f ON f.event_id = n.near_event_id
        GROUP BY a.event_id""", "near_pairs"),
    "appended_sessions": _sql("SELECT * FROM all_sessions", "all_sessions"),
    "appended_user_bounds": _sql("""
        SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS events FROM p GROUP BY user_id""", "p"),
    "rollup_users": _sql(f"""
        SELECT pc, count(*) AS placements, count(DISTINCT user_id) AS users, true AS within_error
        FROM p WHERE ts >= TIMESTAMP '{fx.HOURS[0]}' AND ts < TIMESTAMP '{fx.HOURS[1]}' GROUP BY pc""", "p"),
    "rollup_percentiles": _sql(f"""
        SELECT s AS percentile, n, CAST(v[i] AS INTEGER) AS exact, true AS within_error FROM (
            SELECT count(*) AS n, quantile_disc(x * 40 + y, [0.25, 0.5, 0.75, 0.99]) AS v
            FROM p WHERE ts >= TIMESTAMP '{fx.HOURS[0]}' AND ts < TIMESTAMP '{fx.HOURS[1]}'),
            (VALUES (1, 0.25::DOUBLE), (2, 0.5::DOUBLE), (3, 0.75::DOUBLE), (4, 0.99::DOUBLE)) AS shares(i, s)""", "p"),
    "heavy_pixels": _sql(f"SELECT x, y, edits FROM pixels WHERE edits > {fx.HOT}", "pixels"),
    "heavy_users": _sql("""
        SELECT user_id, count(*) AS edits FROM p GROUP BY user_id
        HAVING count(*) > greatest(1, (SELECT count(*) FROM p) // 500)""", "p"),
    "tile_pyramid": _sql("""
        SELECT CAST(l AS INTEGER) AS level, CAST(x // (1 << l) AS INTEGER) AS x_tile, CAST(y // (1 << l) AS INTEGER) AS y_tile,
               count(*) AS n, CAST(sum(hour(ts)) AS BIGINT) AS total
        FROM p, range(0, 7) AS levels(l) GROUP BY 1, 2, 3""", "p"),
    "running_baseline": _sql("""
        , c AS (SELECT date_trunc('hour', ts) AS minute, count(*) AS n FROM p GROUP BY 1),
          s AS (SELECT *, list(n::DOUBLE) OVER (PARTITION BY hour(minute) ORDER BY minute ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS seen FROM c),
          m AS (SELECT *, CASE WHEN len(seen) >= 4 THEN list_aggregate(seen, 'median') END AS median FROM s),
          d AS (SELECT *, CASE WHEN median IS NOT NULL THEN list_aggregate(list_transform(seen, lambda v: abs(v - median)), 'median') END AS mad FROM m)
        SELECT minute, n, round(median, 6) AS median, round(mad, 6) AS mad,
               round((n - median) / (CASE WHEN mad = 0 THEN 1 ELSE mad END * 1.4826::DOUBLE), 6) AS score FROM d""", "p"),
    "running_spikes": _sql(f"""
        , c AS (SELECT minute, first_time_users FROM new_per_unit),
          s AS (SELECT *, list(first_time_users::DOUBLE) OVER (PARTITION BY hour(minute) ORDER BY minute ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS seen FROM c),
          m AS (SELECT *, CASE WHEN len(seen) >= 2 THEN list_aggregate(seen, 'median') END AS median FROM s),
          d AS (SELECT *, CASE WHEN median IS NOT NULL THEN list_aggregate(list_transform(seen, lambda v: abs(v - median)), 'median') END AS mad FROM m),
          e AS (SELECT minute, first_time_users, median, mad, (first_time_users - median) / (CASE WHEN mad = 0 THEN 1 ELSE mad END * 1.4826::DOUBLE) AS score FROM d)
        SELECT minute, first_time_users, round(median, 6) AS median, round(mad, 6) AS mad, round(score, 6) AS score FROM e WHERE score >= 2.0""", "new_per_unit"),
}

# A report's table is the operator's.
ORACLES |= {f"report_{name}": ORACLES[name] for name in ("color_rank", "hot_edit_focus", "user_spread", "spike_summary")}
