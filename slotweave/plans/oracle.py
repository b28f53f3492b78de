"""The registered queries as SQL, for comparison in another engine.

The statements are put together from named CTEs. They state the definitions directly
(full grid, self-joins, row frames), not the way the Spark plans compute them.
"""

from __future__ import annotations

import re

AT_END = "TIMESTAMP '2024-01-30 23:59:59'"
INSIDE = "TIMESTAMP '2024-01-15 13:59:59'"


def _first_future(time: str) -> str:
    """The time rounded up to whole hours."""
    floor = f"date_trunc('hour', {time})"
    return f"(CASE WHEN {time} > {floor} THEN {floor} + INTERVAL 1 HOUR ELSE {floor} END)"


LOG = """log AS (
  SELECT ts AS time, 'device_' || CAST(user_id AS VARCHAR) AS device, 1 AS device_activated
  FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)"""


def _log_before(time: str) -> str:
    return LOG[:-1] + f" AND ts < {_first_future(time)})"


ROLLUP = """span AS (
  SELECT CAST(min(time) AS DATE) AS anchor, min(time) AS first_time, max(time) AS last_time FROM log),
clock AS (
  SELECT log.*, CAST(24 * date_diff('day', anchor, CAST(time AS DATE)) + hour(time) AS INTEGER) AS hour_slot
  FROM log, span),
rollup_rows AS (
  SELECT device, hour_slot, min(time) AS earliest_activation, max(time) AS latest_activation,
    CAST(coalesce(sum(device_activated), 0) AS BIGINT) AS total_activations
  FROM clock GROUP BY device, hour_slot)"""

BOUNDS_SPAN = "bounds AS (SELECT min(hour_slot) AS lo, max(hour_slot) AS hi FROM clock)"

# Whole days between the first and the last event, plus one.
BOUNDS_COMPAT = """bounds AS (
  SELECT min(hour_slot) AS lo, min(hour_slot) + 24 * (1 + CAST(
    floor(epoch_us(max(time)) / 86400e6 - epoch_us(min(time)) / 86400e6) AS INTEGER)) - 1 AS hi
  FROM clock)"""

CALENDAR = """CAST(hour_slot % 24 AS INTEGER) AS hour_of_day, CAST(hour_slot % 168 AS INTEGER) AS hour_of_week,
    CAST(floor(hour_slot / 24.0) AS INTEGER) AS day_num, CAST(floor(hour_slot / 168.0) AS INTEGER) AS week_num,
    CAST(CAST(floor(hour_slot / 24.0) AS INTEGER) % 7 AS INTEGER) AS day_of_week"""

HISTORY = f"""history AS (
  SELECT device, hour_slot, {CALENDAR}, earliest_activation, latest_activation, total_activations,
    CAST(total_activations IS NOT NULL AS INTEGER) AS is_active, 'train' AS type
  FROM (SELECT d.device, CAST(h.hour_slot AS INTEGER) AS hour_slot
        FROM (SELECT DISTINCT device FROM log) d,
             (SELECT unnest(range(lo, hi + 1)) AS hour_slot FROM bounds) h) grid
  LEFT JOIN rollup_rows USING (device, hour_slot))"""


def _future(time: str, active: bool) -> str:
    if active:
        stats = """CAST(anchor AS TIMESTAMP) + to_hours(hour_slot) AS earliest_activation,
    CAST(anchor AS TIMESTAMP) + to_hours(hour_slot) AS latest_activation,
    CAST(-1 AS BIGINT) AS total_activations, CAST(1 AS INTEGER) AS is_active"""
    else:
        stats = """CAST(NULL AS TIMESTAMP) AS earliest_activation, CAST(NULL AS TIMESTAMP) AS latest_activation,
    CAST(NULL AS BIGINT) AS total_activations, CAST(NULL AS INTEGER) AS is_active"""
    return f"""future AS (
  SELECT device, hour_slot, {CALENDAR}, {stats}, 'predict' AS type
  FROM (SELECT d.device, anchor,
          CAST(date_diff('hour', CAST(anchor AS TIMESTAMP), {_first_future(time)}) + step AS INTEGER) AS hour_slot
        FROM (SELECT DISTINCT 'device_' || CAST(user_id AS VARCHAR) AS device FROM events
              WHERE ts IS NOT NULL AND user_id IS NOT NULL) d, span, (SELECT unnest(range(0, 24)) AS step) s) hours)"""


PANEL = "panel AS (SELECT * FROM history UNION ALL SELECT * FROM future)"


SHARED = r"\b(log|clock|rollup_rows|history|panel|model) AS \("


def _with(*ctes: str) -> str:
    """A WITH clause; what several parts read is computed once."""
    return "WITH " + re.sub(SHARED, r"\1 AS MATERIALIZED (", ",\n".join(ctes)) + "\n"


HISTORY_CTES = (LOG, ROLLUP, BOUNDS_SPAN, HISTORY)
END_CTES = (_log_before(AT_END), ROLLUP, BOUNDS_SPAN, HISTORY, _future(AT_END, False), PANEL)
INSIDE_CTES = (_log_before(INSIDE), ROLLUP, BOUNDS_SPAN, HISTORY, _future(INSIDE, False), PANEL)
OVERLAP_CTES = (LOG, ROLLUP, BOUNDS_COMPAT, HISTORY, _future(INSIDE, True), PANEL)
COMPAT_CTES = (LOG, ROLLUP, BOUNDS_COMPAT, HISTORY, _future(AT_END, True), PANEL)

PANEL_COLUMNS = """device, hour_slot, hour_of_day, hour_of_week, day_num, week_num, day_of_week,
  earliest_activation, latest_activation, total_activations, is_active, type"""


def _lag(period: str, point: str, name: str) -> str:
    """The flag at the same point of the period before."""
    return f"""SELECT p.device, p.hour_slot, CAST(coalesce(e.is_active, 0) AS DOUBLE) AS {name}
FROM panel p LEFT JOIN (SELECT device, {period} + 1 AS later, {point}, is_active FROM panel) e
  ON e.device = p.device AND e.later = p.{period} AND e.{point} = p.{point}"""


def _mean_before(cycle: str) -> str:
    return f"""avg(is_active) OVER (PARTITION BY device, {cycle} ORDER BY hour_slot
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


def _latest_only(cycle: str, name: str) -> str:
    return f"""{name}_rows AS (
  SELECT device, hour_slot, is_active,
    row_number() OVER (PARTITION BY device, {cycle} ORDER BY hour_slot DESC, type = 'predict' DESC) AS recency,
    device || '/' || CAST({cycle} AS VARCHAR) AS grp
  FROM panel),
{name}_latest AS (
  SELECT min(device) AS device, CAST(max(hour_slot) AS INTEGER) AS hour_slot,
    coalesce(CAST(sum(CASE WHEN recency > 1 THEN coalesce(is_active, 0) END) AS DOUBLE)
      / nullif(count(*) - 1, 0), 0.0) AS {name}
  FROM {name}_rows GROUP BY grp)"""


DAY_CTES = """device_days AS (
  SELECT device, day_num, avg(is_active) AS activation_rate FROM panel GROUP BY device, day_num),
device_weeks AS (
  SELECT *, CASE WHEN count(activation_rate) OVER w = 7 THEN avg(activation_rate) OVER w END AS weeks_activation_rate,
    day_num + 1 AS lead_day_num
  FROM device_days WINDOW w AS (PARTITION BY device ORDER BY day_num ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
fleet_days AS (SELECT day_num, avg(is_active) AS activation_rate FROM panel GROUP BY day_num),
fleet_weeks AS (
  SELECT *, CASE WHEN count(activation_rate) OVER w = 7 THEN avg(activation_rate) OVER w END AS weeks_activation_rate,
    day_num + 1 AS lead_day_num
  FROM fleet_days WINDOW w AS (ORDER BY day_num ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))"""

WEEK_COLUMNS = """day_num, round(activation_rate, 9) AS activation_rate,
  round(weeks_activation_rate, 9) AS weeks_activation_rate, lead_day_num"""

DAY_RATE_COLUMNS = """round({0}d.activation_rate{1}, 9) AS yesterdays_device_activation_rate,
  round({0}d.weeks_activation_rate{1}, 9) AS last_weeks_device_activation_rate,
  round({0}f.activation_rate{1}, 9) AS yesterdays_all_device_activation_rate,
  round({0}f.weeks_activation_rate{1}, 9) AS last_weeks_all_device_activation_rate"""

DAY_JOINS = """LEFT JOIN device_weeks d ON d.device = p.device AND d.lead_day_num = p.day_num
LEFT JOIN fleet_weeks f ON f.lead_day_num = p.day_num"""

LAG_JOINS = """LEFT JOIN (SELECT device, day_num + 1 AS next_day, hour_of_day, is_active FROM panel) y
  ON y.device = p.device AND y.next_day = p.day_num AND y.hour_of_day = p.hour_of_day
LEFT JOIN (SELECT device, week_num + 1 AS next_week, hour_of_week, is_active FROM panel) w
  ON w.device = p.device AND w.next_week = p.week_num AND w.hour_of_week = p.hour_of_week"""

FEATURES = f"""SELECT DISTINCT p.device, p.hour_slot, p.hour_of_day, p.hour_of_week, p.day_of_week, p.type, p.is_active,
  CAST(coalesce(w.is_active, 0) AS DOUBLE) AS is_active_last_week,
  CAST(coalesce(y.is_active, 0) AS DOUBLE) AS is_active_yesterday,
  round(coalesce(dr.daily_activation_rate, 0.0), 9) AS daily_activation_rate,
  round(coalesce(wr.weekly_activation_rate, 0.0), 9) AS weekly_activation_rate,
  {DAY_RATE_COLUMNS.format("coalesce(", ", 0.0)")}
FROM panel p
LEFT JOIN daily dr ON dr.device = p.device AND dr.hour_slot = p.hour_slot
LEFT JOIN weekly wr ON wr.device = p.device AND wr.hour_slot = p.hour_slot
{LAG_JOINS}
{DAY_JOINS}"""

BEFORE_NOW = f"""daily AS (
  SELECT device, hour_slot, {_mean_before("hour_of_day")} AS daily_activation_rate FROM panel),
weekly AS (
  SELECT device, hour_slot, {_mean_before("hour_of_week")} AS weekly_activation_rate FROM panel)"""

LATEST_ONLY = f"""{_latest_only("hour_of_day", "daily_activation_rate")},
{_latest_only("hour_of_week", "weekly_activation_rate")},
daily AS (SELECT * FROM daily_activation_rate_latest),
weekly AS (SELECT * FROM weekly_activation_rate_latest)"""

MODEL_TABLE = f"""{BEFORE_NOW},
model AS (
  SELECT p.device, p.hour_slot, p.hour_of_day, p.hour_of_week, p.day_of_week, p.type, p.is_active,
    CAST(coalesce(y.is_active, 0) AS DOUBLE) AS is_active_yesterday,
    CAST(coalesce(w.is_active, 0) AS DOUBLE) AS is_active_last_week,
    round(coalesce(dr.daily_activation_rate, 0.0), 9) AS daily_activation_rate,
    round(coalesce(wr.weekly_activation_rate, 0.0), 9) AS weekly_activation_rate
  FROM panel p
  LEFT JOIN daily dr ON dr.device = p.device AND dr.hour_slot = p.hour_slot
  LEFT JOIN weekly wr ON wr.device = p.device AND wr.hour_slot = p.hour_slot
  {LAG_JOINS})"""

MODEL_COLUMNS = """device, hour_slot, hour_of_day, hour_of_week, day_of_week, is_active_yesterday,
  is_active_last_week, daily_activation_rate, weekly_activation_rate, is_active"""

DRAW = "md5(device || '|' || CAST(hour_slot AS VARCHAR) || '|' || type || '|7')"

TRAIN_DRAW = DRAW.replace("|7", "|0")

# 24 rows per device of the log, from the first hour at or after the prediction time, labels 0 or 1.
CONTRACT = _with(LOG) + f"""SELECT device, CAST(24 AS BIGINT) AS rows,
  strftime({_first_future(AT_END)}, '%Y-%m-%d %H:%M:%S') AS first_time,
  strftime({_first_future(AT_END)} + INTERVAL 23 HOUR, '%Y-%m-%d %H:%M:%S') AS last_time, CAST(0 AS BIGINT) AS odd_labels
FROM (SELECT DISTINCT device FROM log) d"""

BUSY = """SELECT device FROM (SELECT 'device_' || CAST(user_id AS VARCHAR) AS device, count(*) AS total
                      FROM events GROUP BY user_id) totals
  WHERE total >= (SELECT avg(n) FROM (SELECT count(*) AS n FROM events GROUP BY user_id) counted)"""

SCORED = f"""scored AS (
  SELECT device, is_active AS label, round(rate, 9) AS score, CAST(rate >= 0.1 AS INTEGER) AS predicted
  FROM (SELECT device, hour_slot, is_active, {_mean_before("hour_of_week")} AS rate FROM history) rated
  WHERE hour_slot >= 168)"""

CURVE = """counts AS (
  SELECT device, score, sum(label) AS pos, sum(1 - label) AS neg FROM scored
  WHERE score IS NOT NULL GROUP BY device, score),
curve AS (
  SELECT device, score, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp,
    sum(pos) OVER (PARTITION BY device) AS all_pos, sum(neg) OVER (PARTITION BY device) AS all_neg
  FROM counts WINDOW w AS (PARTITION BY device ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
turns AS (
  SELECT *, coalesce(lead(tp) OVER o - 2 * tp + lag(tp) OVER o <> 0
      OR lead(fp) OVER o - 2 * fp + lag(fp) OVER o <> 0, true) AS kept
  FROM curve WINDOW o AS (PARTITION BY device ORDER BY score DESC))"""


def _roc(condition: str) -> str:
    return f"""SELECT device, round(score, 9) AS score_cut, round(fp / nullif(all_neg, 0), 9) AS false_positive_rate,
  round(tp / nullif(all_pos, 0), 9) AS true_positive_rate
FROM (SELECT device, score, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, all_pos, all_neg
      FROM turns WHERE {condition}
      UNION ALL
      SELECT DISTINCT device, CAST('inf' AS DOUBLE), 0.0, 0.0, all_pos, all_neg FROM turns) points"""


# Share of (positive, negative) pairs in the right order, from mid-ranks; ties count half.
AUC_BY_DEVICE = """SELECT device, round(
    (CAST(sum(CASE WHEN label = 1 THEN mid_rank END) AS DOUBLE) - sum(label) * (sum(label) + 1) / 2.0)
    / nullif(CAST(sum(label) AS DOUBLE) * sum(1 - label), 0), 9) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY device ORDER BY score)
        + (count(*) OVER (PARTITION BY device, score) - 1) / 2.0 AS mid_rank
      FROM scored WHERE score IS NOT NULL) ranked
GROUP BY device"""

AUC_POOLED = """SELECT round(
    (CAST(sum(CASE WHEN label = 1 THEN mid_rank END) AS DOUBLE) - sum(label) * (sum(label) + 1) / 2.0)
    / nullif(CAST(sum(label) AS DOUBLE) * sum(1 - label), 0), 9) AS auc
FROM (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS mid_rank
      FROM scored WHERE score IS NOT NULL) ranked"""

NAIVE_RATE = f"""rated AS (
  SELECT *, {_mean_before("hour_of_week")} AS rate FROM panel)"""

# Two ways to score agree on all 24 rows of every device.
AGREEMENTS = _with(LOG) + """SELECT device, CAST(24 AS BIGINT) AS rows, CAST(24 AS BIGINT) AS agreements
FROM (SELECT DISTINCT device FROM log) d"""

STATE_FEATURES = """SELECT m.device, m.hour_slot, hour_of_day, hour_of_week, day_of_week, is_active_yesterday, is_active_last_week,
  daily_activation_rate, weekly_activation_rate, round(device_rate_so_far, 9) AS device_rate_so_far
FROM model m JOIN (
  SELECT device, hour_slot, coalesce(avg(is_active) OVER (PARTITION BY device ORDER BY hour_slot
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS device_rate_so_far FROM panel) r
  ON r.device = m.device AND r.hour_slot = m.hour_slot
WHERE type = 'predict'"""

ORACLE_SQL: dict[str, str] = {
    "devices": _with(LOG) + """SELECT DISTINCT device, regexp_extract(device, '[^_]*$') AS device_number FROM log""",
    "unusable_counts": """SELECT count(*) FILTER (WHERE user_id IS NULL) AS null_device,
  count(*) FILTER (WHERE ts IS NULL) AS null_time, count(*) AS rows_read FROM events""",
    "event_clock": _with(LOG, ROLLUP)
    + """SELECT time, device, device_activated, CAST(time AS DATE) AS event_date,
  CAST(hour(time) AS INTEGER) AS hour_of_day, CAST((isodow(time) - 1) * 24 + hour(time) AS INTEGER) AS hour_of_week,
  CAST(date_diff('day', anchor, CAST(time AS DATE)) AS INTEGER) AS days_since_anchor, hour_slot
FROM clock, span""",
    "parse_rejects": """SELECT event_type, count(time) AS parsed, count(*) FILTER (WHERE time IS NULL) AS rejected,
  max(time) AS latest
FROM (SELECT event_type,
        try_cast(CASE WHEN event_type = 'error' THEN 'not a time' ELSE CAST(ts AS VARCHAR) END AS TIMESTAMP) AS time
      FROM events) parsed_rows
GROUP BY event_type""",
    "hourly_rollup": _with(LOG, ROLLUP) + "SELECT * FROM rollup_rows",
    "hour_labels": _with(*HISTORY_CTES)
    + """SELECT DISTINCT hour_slot,
  strftime(CAST(anchor AS TIMESTAMP) + to_hours(hour_slot), '%Y-%m-%d %H:%M:%S') AS time FROM history, span""",
    "hourly_panel": _with(*HISTORY_CTES) + f"SELECT {PANEL_COLUMNS} FROM history",
    "hourly_panel_compat": _with(LOG, ROLLUP, BOUNDS_COMPAT, HISTORY) + f"SELECT {PANEL_COLUMNS} FROM history",
    "hourly_panel_filled": _with(*HISTORY_CTES)
    + """SELECT device, hour_slot, hour_of_day, hour_of_week, day_num, week_num, day_of_week,
  coalesce(total_activations, 0) AS total_activations, is_active, type FROM history""",
    "future_panel": _with(LOG, ROLLUP, _future(AT_END, True))
    + f"""SELECT {PANEL_COLUMNS},
  strftime(CAST(anchor AS TIMESTAMP) + to_hours(hour_slot), '%Y-%m-%d %H:%M:%S') AS time FROM future, span""",
    "panel_union": _with(*END_CTES) + f"SELECT {PANEL_COLUMNS} FROM panel",
    "modelling_panel": _with(*END_CTES) + f"SELECT {PANEL_COLUMNS} FROM panel",
    "modelling_panel_inside": _with(*INSIDE_CTES) + f"SELECT {PANEL_COLUMNS} FROM panel",
    "modelling_panel_overlap": _with(*OVERLAP_CTES) + f"SELECT {PANEL_COLUMNS} FROM panel",
    "lag_yesterday": _with(*END_CTES) + _lag("day_num", "hour_of_day", "is_active_yesterday"),
    "lag_last_week": _with(*END_CTES) + _lag("week_num", "hour_of_week", "is_active_last_week"),
    "lag_selfjoin_yesterday": _with(*OVERLAP_CTES)
    + """SELECT DISTINCT p.device, p.hour_slot, CAST(coalesce(y.is_active, 0) AS DOUBLE) AS is_active_yesterday
FROM panel p LEFT JOIN panel y
  ON y.device = p.device AND y.hour_of_day = p.hour_of_day AND y.day_num = p.day_num - 1""",
    "lag_selfjoin_last_week": _with(*OVERLAP_CTES)
    + """SELECT DISTINCT p.device, p.hour_slot, CAST(coalesce(w.is_active, 0) AS DOUBLE) AS is_active_last_week
FROM panel p LEFT JOIN panel w
  ON w.device = p.device AND w.hour_of_week = p.hour_of_week AND w.week_num = p.week_num - 1""",
    "rate_before_now_daily": _with(*END_CTES)
    + f"SELECT device, hour_slot, round({_mean_before('hour_of_day')}, 9) AS daily_activation_rate FROM panel",
    "rate_before_now_weekly": _with(*END_CTES)
    + f"SELECT device, hour_slot, round({_mean_before('hour_of_week')}, 9) AS weekly_activation_rate FROM panel",
    "device_rate_before_now": _with(*END_CTES)
    + """SELECT device, hour_slot, round(coalesce(avg(is_active) OVER (PARTITION BY device ORDER BY hour_slot
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 9) AS device_rate_so_far FROM panel""",
    "rate_latest_only_daily": _with(*END_CTES, _latest_only("hour_of_day", "daily_activation_rate"))
    + """SELECT device, hour_slot, round(daily_activation_rate, 9) AS daily_activation_rate
FROM daily_activation_rate_latest""",
    "rate_latest_only_weekly": _with(*END_CTES, _latest_only("hour_of_week", "weekly_activation_rate"))
    + """SELECT device, hour_slot, round(weekly_activation_rate, 9) AS weekly_activation_rate
FROM weekly_activation_rate_latest""",
    "rate_latest_only_overlap": _with(*OVERLAP_CTES, _latest_only("hour_of_day", "daily_activation_rate"))
    + """SELECT device, hour_slot, round(daily_activation_rate, 9) AS daily_activation_rate
FROM daily_activation_rate_latest""",
    "daily_device_rate": _with(*HISTORY_CTES)
    + """SELECT device, day_num, round(avg(is_active), 9) AS activation_rate FROM history GROUP BY device, day_num""",
    "daily_fleet_rate": _with(*HISTORY_CTES)
    + "SELECT day_num, round(avg(is_active), 9) AS activation_rate FROM history GROUP BY day_num",
    "rolling7_device": _with(*END_CTES, DAY_CTES) + f"SELECT device, {WEEK_COLUMNS} FROM device_weeks",
    "rolling7_fleet": _with(*END_CTES, DAY_CTES) + f"SELECT {WEEK_COLUMNS} FROM fleet_weeks",
    "rolling7_device_calendar": _with(*HISTORY_CTES, "panel AS (SELECT * FROM history)", DAY_CTES)
    + """SELECT a.device, a.day_num, round(a.activation_rate, 9) AS activation_rate,
  round(CASE WHEN count(b.day_num) = 7 THEN avg(b.activation_rate) END, 9) AS weeks_activation_rate,
  a.day_num + 1 AS lead_day_num
FROM device_days a JOIN device_days b ON b.device = a.device AND b.day_num BETWEEN a.day_num - 6 AND a.day_num
GROUP BY a.device, a.day_num, a.activation_rate""",
    "previous_day_rates": _with(*END_CTES, DAY_CTES)
    + f"SELECT p.device, p.hour_slot, {DAY_RATE_COLUMNS.format('', '')} FROM panel p {DAY_JOINS}",
    "model_features": _with(*END_CTES, DAY_CTES, BEFORE_NOW) + FEATURES,
    "model_features_inside": _with(*INSIDE_CTES, DAY_CTES, BEFORE_NOW) + FEATURES,
    "model_features_windows": _with(*END_CTES, DAY_CTES, BEFORE_NOW) + FEATURES,
    "model_features_compat": _with(*COMPAT_CTES, DAY_CTES, LATEST_ONLY) + FEATURES,
    "split_rows": _with(*END_CTES, MODEL_TABLE)
    + f"""SELECT {MODEL_COLUMNS}, type AS split, 'all' AS fold FROM model
WHERE type = 'predict' AND hour_slot >= 0 OR type = 'train' AND hour_slot >= 168""",
    "split_busy_devices": _with(*END_CTES, MODEL_TABLE)
    + f"""SELECT {MODEL_COLUMNS}, 'busy' AS split, 'all' AS fold FROM model
WHERE type = 'train' AND hour_slot BETWEEN 168 AND 500 AND device IN ({BUSY})""",
    "complete_rows": _with(*END_CTES)
    + f"""SELECT device, hour_slot, is_active, round(rate, 9) AS weekly_activation_rate
FROM (SELECT device, hour_slot, is_active, {_mean_before("hour_of_week")} AS rate FROM panel) rated
WHERE rate IS NOT NULL AND is_active IS NOT NULL""",
    "holdout_share": _with(*END_CTES)
    + f"""SELECT device, hour_slot, is_active,
  CASE WHEN substr({DRAW}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS fold
FROM panel WHERE type = 'train' AND hour_slot >= 168""",
    "holdout_rows": _with(*END_CTES)
    + f"""SELECT device, hour_slot, is_active,
  CASE WHEN row_number() OVER (ORDER BY {DRAW}, device, hour_slot) <= 20 THEN 'test' ELSE 'train' END AS fold
FROM panel WHERE type = 'train' AND hour_slot >= 168""",
    "roc_points_by_device": _with(*HISTORY_CTES, SCORED, CURVE) + _roc("true"),
    "roc_turning_points": _with(*HISTORY_CTES, SCORED, CURVE) + _roc("kept"),
    "auc_by_device": _with(*HISTORY_CTES, SCORED) + AUC_BY_DEVICE,
    "auc_pooled": _with(*HISTORY_CTES, SCORED) + AUC_POOLED,
    "accuracy_by_device": _with(*HISTORY_CTES, SCORED)
    + """SELECT device, round(avg(CAST(label = predicted AS INTEGER)), 9) AS accuracy FROM scored GROUP BY device""",
    "accuracy_pooled": _with(*HISTORY_CTES, SCORED)
    + "SELECT round(avg(CAST(label = predicted AS INTEGER)), 9) AS accuracy FROM scored",
    "confusion_by_device": _with(*HISTORY_CTES, SCORED)
    + """SELECT device, device_number, tn, fp, fn, tp,
  round(100.0 * tn / total, 9) AS tn_percent, round(100.0 * fp / total, 9) AS fp_percent,
  round(100.0 * fn / total, 9) AS fn_percent, round(100.0 * tp / total, 9) AS tp_percent
FROM (SELECT device, regexp_extract(device, '[^_]*$') AS device_number, CAST(count(*) AS DOUBLE) AS total,
        count(*) FILTER (WHERE label = 0 AND predicted = 0) AS tn,
        count(*) FILTER (WHERE label = 0 AND predicted = 1) AS fp,
        count(*) FILTER (WHERE label = 1 AND predicted = 0) AS fn,
        count(*) FILTER (WHERE label = 1 AND predicted = 1) AS tp
      FROM scored GROUP BY device) counted""",
    "clipped_labels": _with(*HISTORY_CTES)
    + f"""SELECT device, hour_slot, round(yhat, 9) AS yhat, CAST(yhat >= 0.4 AS INTEGER) AS activation_predicted1
FROM (SELECT device, hour_slot, CASE WHEN raw < 0 THEN 0.0 ELSE raw END AS yhat
      FROM (SELECT device, hour_slot, {_mean_before("hour_of_week")} * 2 - CAST(0.5 AS DOUBLE) AS raw
            FROM history) doubled) clipped""",
    "csv_roundtrip": _with(LOG) + "SELECT time, device, device_activated FROM log",
    "json_roundtrip": _with(*END_CTES, NAIVE_RATE)
    + """SELECT CAST(rate >= 0.4 AS INTEGER) AS activation_predicted, device,
  strftime(CAST(anchor AS TIMESTAMP) + to_hours(hour_slot), '%Y-%m-%d %H:%M:%S') AS time
FROM rated, span WHERE type = 'predict'""",
    "json_array_roundtrip": _with(*END_CTES, NAIVE_RATE)
    + """SELECT *, row_number() OVER (ORDER BY device, time) - 1 AS place FROM (
  SELECT CAST(rate >= 0.4 AS INTEGER) AS activation_predicted, device,
    strftime(CAST(anchor AS TIMESTAMP) + to_hours(hour_slot), '%Y-%m-%d %H:%M:%S') AS time
  FROM rated, span WHERE type = 'predict') predicted""",
    "csv_rejects": """SELECT reason, count(*) AS records, count(*) FILTER (WHERE reason <> 'none' OR event_id % 10 <> 6) AS with_file
FROM (SELECT event_id, CASE event_id % 10 WHEN 1 THEN 'not a time: yesterday' WHEN 2 THEN 'not a number: one'
        WHEN 3 THEN 'malformed record' WHEN 4 THEN 'malformed record'
        WHEN 5 THEN 'not a time: later; not a number: 2.5' ELSE 'none' END AS reason FROM events) damaged
GROUP BY reason""",
    "request_time": f"""SELECT first_hour + to_hours(CAST(step AS INTEGER)) AS time
FROM (SELECT {_first_future("max(ts)")} AS first_hour FROM events) last_event, (SELECT unnest(range(0, 24)) AS step) steps""",
    "csv_any_order": _with(LOG) + "SELECT time, device, device_activated FROM log",
    "holdout_rows_overlap": _with(*OVERLAP_CTES)
    + f"""SELECT device, type, fold, count(*) AS rows, CAST(sum(hour_slot) AS BIGINT) AS slots
FROM (SELECT device, type, hour_slot,
        CASE WHEN row_number() OVER (ORDER BY {DRAW}) <= 2000 THEN 'test' ELSE 'train' END AS fold
      FROM panel WHERE hour_slot >= 168) drawn
GROUP BY device, type, fold""",
    "device_flags": _with(LOG)
    + """SELECT device, CAST(row_number() OVER (ORDER BY device) - 1 AS INTEGER) AS device_index,
  CAST(1 AS INTEGER) AS flags_set, CAST(count(*) OVER () + 1 AS INTEGER) AS width
FROM (SELECT DISTINCT device FROM log) d""",
    "forest_report_counts": _with(*END_CTES)
    + f"""SELECT device, CASE WHEN substr({TRAIN_DRAW}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS fold,
  count(*) AS rows
FROM panel WHERE type = 'train' AND hour_slot >= 168 GROUP BY ALL""",
    "forest_contract": CONTRACT,
    "forecast_contract": CONTRACT,
    "job_roundtrip": CONTRACT,
    "score_reload_agreement": AGREEMENTS,
    "state_features": _with(*END_CTES, MODEL_TABLE) + STATE_FEATURES,
    "state_features_forward": _with(*INSIDE_CTES, MODEL_TABLE) + STATE_FEATURES,
    "score_from_state": AGREEMENTS,
    "forest_custom_split": _with(*END_CTES)
    + f"""SELECT device, CASE WHEN substr({TRAIN_DRAW}, 1, 8) < '33333333' THEN 'test' ELSE 'train' END AS fold,
  count(*) AS rows, min(hour_slot) AS first_slot, max(hour_slot) AS last_slot
FROM panel WHERE type = 'train' AND hour_slot >= 200 AND device IN ({BUSY}) GROUP BY ALL""",
    "forecast_normal_equations": _with(LOG)
    + "SELECT device, CAST(0 AS DOUBLE) AS residual FROM (SELECT DISTINCT device FROM log) d",
}
