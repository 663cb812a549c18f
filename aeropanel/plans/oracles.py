"""SQL for the registered queries, over the raw tables: one chain of common tables, and a statement for each query."""

from __future__ import annotations

import re

_CHAIN = """
raw AS (SELECT date_trunc('hour', ts) AS ts, event_type, event_id, user_id, value, ts AS moment, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS k FROM events),
obs AS (SELECT event_type AS station, ts, round(avg(value), 4) AS no2, round(max(value), 4) AS pm25 FROM raw GROUP BY 1, 2),
met0 AS (SELECT ts, min(value) AS t2m_c, CAST(count(*) + 1000 AS DOUBLE) AS sp_hpa, CAST(count(*) FILTER (event_type = 'error') AS DOUBLE) AS tp_mm, round(sum(value), 4) AS blh, round(avg(k) / 10, 4) AS ws10, CAST((sum(user_id) * 37) % 360 AS DOUBLE) AS wd10 FROM raw GROUP BY 1),
met AS (SELECT *, round(-ws10 * sin(radians(wd10)), 6) AS u10, round(-ws10 * cos(radians(wd10)), 6) AS v10 FROM met0),
place(station, city, env_type) AS (VALUES ('click', 'A', 'urban_traffic'), ('error', 'C', 'suburban_industrial'), ('purchase', 'B', 'urban_background'), ('signup', 'B', 'urban_background'), ('view', 'A', 'urban_traffic')),
slot AS (SELECT place.*, CAST(pos AS BIGINT) AS pos, TIMESTAMP '2024-01-01' + to_hours(pos) AS ts FROM place, range(0, 720) g(pos)),
panel AS (
  SELECT s.station, city, env_type, pos, s.ts, no2, pm25, t2m_c, sp_hpa, tp_mm, blh, ws10, wd10, u10, v10,
    CASE WHEN pos < 360 THEN 'train' WHEN pos < 480 THEN 'cal' ELSE 'test' END AS split
  FROM slot s LEFT JOIN obs o ON s.station = o.station AND s.ts = o.ts LEFT JOIN met m ON s.ts = m.ts),
series AS (SELECT station, 'no2' AS pollutant, pos, ts, split, no2 AS v FROM panel UNION ALL SELECT station, 'pm25', pos, ts, split, pm25 FROM panel),
fill AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY station, pollutant ORDER BY pos) AS ff, min(CASE WHEN v IS NOT NULL THEN pos END) OVER (PARTITION BY station, pollutant) AS first_obs FROM series),
cand AS (SELECT station, pollutant, pos AS origin_pos, split AS phase, first_obs FROM fill WHERE (split = 'test' AND (pos - 480) % 24 = 0) OR (split = 'cal' AND (pos - 360) % 24 = 0)),
origin AS (SELECT station, pollutant, phase, origin_pos FROM cand WHERE origin_pos - 71 >= 0 AND origin_pos + 24 < 720 AND origin_pos - 71 >= first_obs),
lead AS (SELECT CAST(l AS BIGINT) AS lead FROM range(1, 25) g(l)),
target AS (SELECT o.*, lead, origin_pos + lead AS target_pos FROM origin o, lead),
actual AS (SELECT t.*, s.v AS y FROM target t JOIN series s ON t.station = s.station AND t.pollutant = s.pollutant AND t.target_pos = s.pos WHERE s.v IS NOT NULL),
pred AS (
  SELECT t.station, t.pollutant, m.model, t.phase, t.origin_pos, t.lead, f.ff AS yhat
  FROM target t, (VALUES ('persistence', 0), ('seasonal_naive_24', 24), ('seasonal_naive_72', 72)) m(model, period), fill f
  WHERE f.station = t.station AND f.pollutant = t.pollutant AND f.pos = CASE WHEN period = 0 THEN t.origin_pos ELSE t.origin_pos - period + 1 + (t.lead - 1) % greatest(period, 1) END),
err AS (SELECT p.*, a.y, abs(a.y - p.yhat) AS ae FROM pred p JOIN actual a USING (station, pollutant, phase, origin_pos, lead) WHERE p.yhat IS NOT NULL),
q90 AS (SELECT station, pollutant, quantile_cont(y, 0.9::DOUBLE) AS q90 FROM actual WHERE phase = 'test' GROUP BY 1, 2),
terr AS (SELECT e.*, q90, y >= q90 AS is_tail FROM err e JOIN q90 USING (station, pollutant) WHERE phase = 'test'),
board AS (
  SELECT station, pollutant, CAST(h AS BIGINT) AS horizon, model, avg(ae) AS mae, avg(CASE WHEN is_tail THEN ae END) AS mae_topdecile, first(q90) AS q90, count(ae) AS n, count(DISTINCT origin_pos) AS n_origins
  FROM terr, (VALUES (6), (12), (24)) v(h) WHERE lead <= h GROUP BY 1, 2, 3, 4),
unit AS (SELECT pollutant, station, origin_pos, dense_rank() OVER (PARTITION BY pollutant ORDER BY station, origin_pos) - 1 AS unit_id FROM origin WHERE phase = 'test'),
usum AS (SELECT pollutant, model, unit_id, coalesce(sum(ae), 0) AS s, count(ae) AS n, coalesce(sum(CASE WHEN is_tail THEN ae END), 0) AS ts, count(CASE WHEN is_tail THEN ae END) AS tn FROM terr JOIN unit USING (pollutant, station, origin_pos) GROUP BY 1, 2, 3),
draw AS (
  SELECT pollutant, CAST(b AS BIGINT) AS boot_id, CAST('0x' || substr(md5(b || '-' || k), 1, 8) AS BIGINT) % n_unit AS unit_id, count(*) AS mult
  FROM (SELECT pollutant, count(*) AS n_unit FROM unit GROUP BY 1) u, range(0, 2000) x(b), range(0, 10000) y(k) WHERE k < n_unit GROUP BY 1, 2, 3),
dist AS (SELECT pollutant, model, boot_id, sum(mult * s) / nullif(sum(mult * n), 0) AS d, sum(mult * ts) / nullif(sum(mult * tn), 0) AS td FROM draw JOIN usum USING (pollutant, unit_id) GROUP BY 1, 2, 3),
pair(pollutant, a, b) AS (SELECT p, a, b FROM (VALUES ('no2'), ('pm25')) x(p), (VALUES ('persistence', 'seasonal_naive_24'), ('persistence', 'seasonal_naive_72'), ('seasonal_naive_24', 'seasonal_naive_72')) y(a, b)),
loss AS (SELECT pollutant, model, station, origin_pos, avg(ae) AS loss FROM err WHERE phase = 'test' GROUP BY 1, 2, 3, 4),
diff AS (SELECT p.pollutant, p.a, p.b, x.station, x.origin_pos, x.loss - y.loss AS d FROM pair p JOIN loss x ON x.pollutant = p.pollutant AND x.model = p.a JOIN loss y ON y.pollutant = p.pollutant AND y.model = p.b AND y.station = x.station AND y.origin_pos = x.origin_pos),
dev AS (SELECT *, d - avg(d) OVER (PARTITION BY pollutant, a, b) AS dev FROM diff),
dev1 AS (SELECT *, lag(dev) OVER (PARTITION BY pollutant, a, b ORDER BY station, origin_pos) AS dev_1 FROM dev),
dm AS (SELECT pollutant, a, b, count(d) AS n, avg(d) AS mean_diff, avg(dev * dev) AS g0, coalesce(avg(dev * dev_1), 0) AS g1 FROM dev1 GROUP BY 1, 2, 3),
means AS (SELECT station, pollutant, pos AS origin_pos, avg(ff) OVER (PARTITION BY station, pollutant ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS cbar FROM fill),
back AS (SELECT o.station, o.pollutant, o.phase, o.origin_pos, p.blh, p.ws10 FROM origin o JOIN panel p ON p.station = o.station AND p.pos BETWEEN o.origin_pos - 23 AND o.origin_pos),
cut AS (
  SELECT * FROM (SELECT pollutant, quantile_cont(cbar, (2::DOUBLE / 3)) AS c3 FROM origin JOIN means USING (station, pollutant, origin_pos) WHERE phase = 'cal' GROUP BY 1)
  JOIN (SELECT pollutant, quantile_cont(blh, (1::DOUBLE / 3)) AS blh_lo, quantile_cont(ws10, (1::DOUBLE / 3)) AS ws_lo FROM back WHERE phase = 'cal' GROUP BY 1) USING (pollutant)),
still AS (SELECT station, pollutant, phase, origin_pos, count(*) FILTER (blh < blh_lo AND ws10 < ws_lo) AS nstag FROM back JOIN cut USING (pollutant) GROUP BY 1, 2, 3, 4),
regime AS (SELECT s.station, s.pollutant, s.phase, s.origin_pos, cbar, nstag, CAST(cbar >= c3 OR nstag >= 6 AS BIGINT) AS r FROM still s JOIN cut USING (pollutant) JOIN means USING (station, pollutant, origin_pos)),
strata AS (
  SELECT t.station, t.pollutant, t.phase, t.origin_pos, t.lead, p.model, p.yhat, a.y, a.y - p.yhat AS res, m.ws10, m.blh, CAST(hour(m.ts) AS BIGINT) AS hour, g.r
  FROM target t JOIN panel m ON m.station = t.station AND m.pos = t.target_pos
  LEFT JOIN actual a ON a.station = t.station AND a.pollutant = t.pollutant AND a.phase = t.phase AND a.origin_pos = t.origin_pos AND a.lead = t.lead
  JOIN pred p ON p.station = t.station AND p.pollutant = t.pollutant AND p.phase = t.phase AND p.origin_pos = t.origin_pos AND p.lead = t.lead
  JOIN regime g ON g.station = t.station AND g.pollutant = t.pollutant AND g.phase = t.phase AND g.origin_pos = t.origin_pos),
edge AS (SELECT pollutant, model, quantile_cont(ws10, (1::DOUBLE / 3)) AS w1, quantile_cont(ws10, (2::DOUBLE / 3)) AS w2, quantile_cont(blh, (1::DOUBLE / 3)) AS b1, quantile_cont(blh, (2::DOUBLE / 3)) AS b2 FROM strata WHERE phase = 'cal' GROUP BY 1, 2),
bin AS (
  SELECT s.*, coalesce(CAST(ws10 >= w1 AS BIGINT) + CAST(ws10 >= w2 AS BIGINT), 2) AS w, coalesce(CAST(blh >= b1 AS BIGINT) + CAST(blh >= b2 AS BIGINT), 2) AS b,
    least(hour // 6, 3) AS h4, CASE WHEN hour >= 6 AND hour < 18 THEN 0 ELSE 1 END AS h2
  FROM strata s JOIN edge USING (pollutant, model)),
copy AS (
  SELECT pollutant, model, level, CASE WHEN level <> 'global' THEN w END AS w, CASE WHEN level <> 'global' THEN b END AS b, CASE WHEN level = 'cell' THEN h4 END AS h4,
    CASE WHEN level IN ('cell4', 'cell3') THEN h2 END AS h2, CASE WHEN level = 'cell4' THEN r END AS r, abs(res) AS size
  FROM bin, (VALUES ('cell'), ('cell4'), ('cell3'), ('wsblh'), ('global')) l(level) WHERE phase = 'cal' AND res IS NOT NULL),
ranked AS (SELECT *, count(*) OVER p AS n, row_number() OVER (PARTITION BY pollutant, model, level, w, b, h4, h2, r ORDER BY size) AS i FROM copy WINDOW p AS (PARTITION BY pollutant, model, level, w, b, h4, h2, r)),
quant AS (SELECT * FROM ranked WHERE i = ceil(least(1.0::DOUBLE, ceil((n + 1) * (1 - 0.1::DOUBLE)) / n) * (n - 1)) + 1 AND (level = 'global' OR n >= 10)),
inter AS (
  SELECT x.*, coalesce(c.size, wb.size, g.size) AS q3, coalesce(c4.size, c3.size, wb.size, g.size) AS q4, g.size AS q1
  FROM bin x LEFT JOIN quant c ON c.level = 'cell' AND c.pollutant = x.pollutant AND c.model = x.model AND c.w = x.w AND c.b = x.b AND c.h4 = x.h4
  LEFT JOIN quant c4 ON c4.level = 'cell4' AND c4.pollutant = x.pollutant AND c4.model = x.model AND c4.w = x.w AND c4.b = x.b AND c4.h2 = x.h2 AND c4.r = x.r
  LEFT JOIN quant c3 ON c3.level = 'cell3' AND c3.pollutant = x.pollutant AND c3.model = x.model AND c3.w = x.w AND c3.b = x.b AND c3.h2 = x.h2
  LEFT JOIN quant wb ON wb.level = 'wsblh' AND wb.pollutant = x.pollutant AND wb.model = x.model AND wb.w = x.w AND wb.b = x.b
  JOIN quant g ON g.level = 'global' AND g.pollutant = x.pollutant AND g.model = x.model WHERE x.phase = 'test'),
tint AS (SELECT i.*, abs(res) <= q1 AS in1, abs(res) <= q3 AS in3, abs(res) <= q4 AS in4 FROM inter i JOIN q90 USING (station, pollutant) WHERE y >= q90),
cvu AS (SELECT pollutant, model, unit_id, sum(CAST(in4 AS BIGINT)) AS sa, sum(CAST(in1 AS BIGINT)) AS sb, count(*) AS n, dense_rank() OVER (PARTITION BY pollutant, model ORDER BY unit_id) - 1 AS u FROM tint JOIN unit USING (pollutant, station, origin_pos) GROUP BY 1, 2, 3),
cvd AS (
  SELECT c.pollutant, c.model, CAST(x.b AS BIGINT) AS boot_id, sum(sa) / sum(n) - sum(sb) / sum(n) AS d
  FROM (SELECT pollutant, model, count(*) AS n_unit FROM cvu GROUP BY 1, 2) c, range(0, 2000) x(b), range(0, 10000) y(k), cvu v
  WHERE k < n_unit AND v.pollutant = c.pollutant AND v.model = c.model AND v.u = CAST('0x' || substr(md5(x.b || '-' || k), 1, 8) AS BIGINT) % n_unit GROUP BY 1, 2, 3)
"""

_EVAL = "SELECT station, pollutant, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round(avg(2 * abs(yhat - y) / nullif(abs(y) + abs(yhat), 0)) * 100, 6) AS smape, round(avg(yhat - y), 6) AS bias, count(*) AS n FROM err WHERE phase = 'test' AND model = '{}' GROUP BY 1, 2"
_ROLL = "PARTITION BY station, pollutant ORDER BY pos ROWS BETWEEN {} PRECEDING AND CURRENT ROW"
_CAL = "round(sin(6.283185307179586 * {0} / {1}), 6) AS {2}sin, round(cos(6.283185307179586 * {0} / {1}), 6) AS {2}cos"
_CALENDAR = ", ".join(_CAL.format(x, p, n) for x, p, n in (("hour({t})", 24, "h"), ("(isodow({t}) - 1)", 7, "d"), ("month({t})", 12, "m"))) + ", CAST(isodow({t}) >= 6 AS DOUBLE) AS wknd"
_WEATHER = ["t2m_c", "blh", "ws10", "u10", "v10", "sp_hpa", "tp_mm"]
_LAGS = [1, 3, 6, 24, 168]
_STATS = f"CASE WHEN count(v) OVER ({_ROLL.format(2)}) = 3 THEN avg(v) OVER ({_ROLL.format(2)}) END AS rm3, CASE WHEN count(v) OVER ({_ROLL.format(23)}) = 24 THEN avg(v) OVER ({_ROLL.format(23)}) END AS rm24, CASE WHEN count(v) OVER ({_ROLL.format(23)}) = 24 THEN stddev_samp(v) OVER ({_ROLL.format(23)}) END AS rs24"
_LAGGED = ", ".join(f"lag(v, {k}) OVER (PARTITION BY station, pollutant ORDER BY pos) AS lag{k}" for k in _LAGS)


def _features(future: bool) -> str:
    at = f"SELECT station, pollutant, pos, v AS y0, {_LAGGED}, {_STATS} FROM series"
    columns = ["y0", *[f"lag{k}" for k in _LAGS], "rm3", "rm24", "rs24"]
    met = ", ".join([f"round(o.{c}, 6) AS {c}_o" for c in _WEATHER] + ([f"round(t.{c}, 6) AS {c}_t" for c in _WEATHER] if future else []))
    return f"SELECT x.station, x.pollutant, x.origin_pos, x.lead, round(s.v, 6) AS y, {', '.join(f'round({c}, 6) AS {c}' for c in columns)}, {_CALENDAR.format(t='t.ts')}, {met} FROM target x JOIN ({at}) f ON f.station = x.station AND f.pollutant = x.pollutant AND f.pos = x.origin_pos JOIN panel o ON o.station = x.station AND o.pos = x.origin_pos JOIN panel t ON t.station = x.station AND t.pos = x.target_pos JOIN series s ON s.station = x.station AND s.pollutant = x.pollutant AND s.pos = x.target_pos WHERE x.phase = 'test'"


def _dm(lag: int) -> str:
    s, h = ("g0 + 2 * g1", 2) if lag else ("g0", 1)
    return f"SELECT pollutant, a, b, n, round(mean_diff, 6) AS mean_diff, round(mean_diff / sqrt(({s}) / n) * sqrt(greatest((n + 1 - {2 * h} + {float(h * (h - 1))}::DOUBLE / n) / n, 1e-12)), 6) AS dm FROM dm"


def _fit(levels: list[tuple[str, str]], cells: str) -> str:
    name = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in levels)
    return f"SELECT pollutant, model, CASE level {name} END AS level, {cells}, n, round(size, 6) AS q FROM quant WHERE level IN ({', '.join(repr(a) for a, _ in levels)})"


# Student's t, both tails, by its finite series for whole degrees of freedom
_SERIES = "list_sum(list_transform(range(0, {m}), lambda k: pow(c, 2 * k) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: {r})), 1)))"
_ODD, _EVEN = _SERIES.format(m="(df - 1) // 2", r="2 * j::DOUBLE / (2 * j + 1)"), _SERIES.format(m="df // 2", r="(2 * j - 1)::DOUBLE / (2 * j)")
_PVALUES = f""", stat AS (SELECT pollutant, a, b, n, mean_diff, mean_diff / sqrt(g0 / n) * sqrt((n - 1) / n) AS dm FROM dm),
angle AS (SELECT *, n - 1 AS df, atan(abs(dm) / sqrt(n - 1)) AS w, cos(atan(abs(dm) / sqrt(n - 1))) AS c, sin(atan(abs(dm) / sqrt(n - 1))) AS s FROM stat),
pval AS (SELECT pollutant, a, b, n, mean_diff, dm, CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (w + coalesce(s * c * {_ODD}, 0)) ELSE 1 - s * {_EVEN} END AS p FROM angle)
"""
_PCT = "quantile_cont({0}, 0.025::DOUBLE) AS lo, quantile_cont({0}, 0.975::DOUBLE) AS hi"


def _ci(d: str, s: str, n: str) -> str:
    return f"SELECT pollutant, model, round(point, 6) AS point, round(lo, 6) AS lo, round(hi, 6) AS hi FROM (SELECT pollutant, model, {_PCT.format(d)} FROM dist GROUP BY 1, 2) JOIN (SELECT pollutant, model, sum({s}) / nullif(sum({n}), 0) AS point FROM usum GROUP BY 1, 2) USING (pollutant, model)"


_BOTH = "coalesce(last_value({0} IGNORE NULLS) OVER (PARTITION BY station ORDER BY pos), first_value({0} IGNORE NULLS) OVER (PARTITION BY station ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {0}"

_SELECTS = {
    "hourly_grid_reindex": "SELECT station, pos, ts, no2, pm25 FROM panel",
    "panel_build": "SELECT station, city, env_type, pos, ts, split, no2, pm25, t2m_c, blh, ws10, u10, v10, sp_hpa, tp_mm, wd10 FROM panel",
    "dedup_keep_first": "SELECT event_type, ts AS hour, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, ts ORDER BY moment, event_id) AS n FROM raw) WHERE n = 1",
    "split_labels": "SELECT station, split, count(*) AS n FROM panel GROUP BY 1, 2",
    "split_completeness": "SELECT station, pollutant, split, round(count(v) / count(*), 6) AS completeness FROM series GROUP BY 1, 2, 3",
    "completeness_gate": "SELECT station, pollutant, round(count(v) / count(*), 6) AS completeness, CASE WHEN count(v) / count(*) >= 0.75 THEN 'OK' ELSE 'LOW' END AS gate FROM series GROUP BY 1, 2",
    "station_summary": "SELECT * FROM (SELECT station, pollutant, round(min(v), 6) AS lo, round(max(v), 6) AS hi, round(avg(v), 6) AS mean, count(v) AS n FROM series GROUP BY 1, 2) JOIN (SELECT station, round(avg(CAST(blh IS NULL AS DOUBLE)), 6) AS blh_missing FROM panel GROUP BY 1) USING (station)",
    "wind_components": "SELECT ts, ws10, wd10, u10 AS u, v10 AS v FROM met",
    "epoch_to_ts": "SELECT event_id, CAST(floor(epoch(moment)) AS BIGINT) AS epoch, date_trunc('second', moment) AS second FROM raw",
    "json_column_unpack": "SELECT CAST(ts AS DATE) AS day, ts, " + ", ".join(f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 3) AS {c}" for c, x in {"t2m_c": "t2m_c", "sp_hpa": "sp_hpa", "tp_mm": "tp_mm", "ws10": "ws10", "wd10": "wd10", "u10": "-ws10 * sin(radians(wd10))", "v10": "-ws10 * cos(radians(wd10))"}.items()) + " FROM met",
    "ffill_series": "SELECT station, pollutant, pos, ff FROM fill",
    "ffill_bfill_covariates": "SELECT station, pos, " + ", ".join(_BOTH.format(c) for c in _WEATHER) + " FROM panel",
    "rolling_stats_strict": f"SELECT station, pollutant, pos, round(rm3, 6) AS rm3, round(rm24, 6) AS rm24, round(rs24, 6) AS rs24 FROM (SELECT station, pollutant, pos, {_STATS} FROM series)",
    "lag_features": f"SELECT station, pollutant, pos, {_LAGGED} FROM series",
    "calendar_features": f"SELECT station, pos, {_CALENDAR.format(t='ts')} FROM panel",
    "test_origins": "SELECT station, pollutant, phase, origin_pos FROM origin",
    "train_origins": "SELECT station, pollutant, 'train' AS phase, pos AS origin_pos FROM series WHERE split = 'train' AND pos % 6 = 0 AND pos >= 168 AND pos < 336",
    "context_arrays": "SELECT o.station, o.pollutant, o.origin_pos, count(f.ff) AS n, round(sum(f.ff), 6) AS total, round(max(CASE WHEN f.pos = o.origin_pos THEN f.ff END), 6) AS last FROM origin o JOIN fill f ON f.station = o.station AND f.pollutant = o.pollutant AND f.pos BETWEEN o.origin_pos - 71 AND o.origin_pos WHERE phase = 'test' GROUP BY 1, 2, 3",
    "future_slices": "SELECT t.station, t.pollutant, t.origin_pos, count(ws10) AS n_ws, round(sum(ws10), 6) AS ws, round(sum(blh), 6) AS blh, CAST(sum(hour(p.ts)) AS BIGINT) AS hours FROM target t JOIN panel p ON p.station = t.station AND p.pos = t.target_pos WHERE phase = 'test' GROUP BY 1, 2, 3",
    "covariate_slices": "SELECT o.station, o.pollutant, o.origin_pos, count(*) AS n, round(sum(coalesce(ws10, 0)), 6) AS ws, round(sum(coalesce(blh, 0)), 6) AS blh, round(max(CASE WHEN p.pos = o.origin_pos - 71 THEN ws10 END), 6) AS first, round(max(CASE WHEN p.pos = o.origin_pos + 24 THEN ws10 END), 6) AS last FROM origin o JOIN panel p ON p.station = o.station AND p.pos BETWEEN o.origin_pos - 71 AND o.origin_pos + 24 WHERE phase = 'test' GROUP BY 1, 2, 3",
    "origins_by_horizon": "SELECT station, pollutant, CAST(h AS BIGINT) AS horizon, count(*) AS n FROM cand, (VALUES (6), (12), (24)) v(h) WHERE phase = 'test' AND origin_pos - 71 >= 0 AND origin_pos + h < 720 AND origin_pos - 71 >= first_obs GROUP BY 1, 2, 3",
    "first_complete_day": "SELECT station, pollutant, coalesce(min(CASE WHEN k = 24 THEN pos END), min(pos)) AS pos FROM (SELECT station, pollutant, pos, count(v) OVER (PARTITION BY station, pollutant ORDER BY pos ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING) AS k FROM series) GROUP BY 1, 2",
    "direct_features_oracle": _features(True),
    "direct_features_no_oracle": _features(False),
    "persistence_eval": _EVAL.format("persistence"),
    "seasonal_naive_eval_24": _EVAL.format("seasonal_naive_24"),
    "seasonal_naive_eval_72": _EVAL.format("seasonal_naive_72"),
    "rolling_origin_info": "SELECT station, pollutant, count(u.origin_pos) AS n_origins, count(*) - count(u.origin_pos) AS n_skipped FROM (SELECT * FROM cand WHERE phase = 'test') c LEFT JOIN (SELECT DISTINCT station, pollutant, origin_pos FROM err WHERE phase = 'test' AND model = 'persistence') u USING (station, pollutant, origin_pos) GROUP BY 1, 2",
    "tail_threshold_q90": "SELECT station, pollutant, round(q90, 6) AS q90 FROM q90",
    "tail_metrics": "SELECT pollutant, model, round(avg(ae), 6) AS mae, count(ae) AS n, count(DISTINCT station || '/' || origin_pos) AS units FROM terr WHERE is_tail GROUP BY 1, 2",
    "leaderboard_cells": "SELECT station, pollutant, horizon, model, round(mae, 3) AS mae, round(mae_topdecile, 3) AS mae_topdecile, round(q90, 3) AS q90, n, n_origins FROM board",
    "leaderboard_pivot_median": "SELECT model, " + ", ".join(f"round(median(CASE WHEN horizon = {h} THEN mae END), 6) AS h{h}" for h in (6, 12, 24)) + " FROM board WHERE pollutant = 'no2' GROUP BY 1",
    "best_per_horizon": "SELECT horizon, model, round(m, 6) AS mae FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY m, model) AS i FROM (SELECT horizon, model, median(mae) AS m FROM board WHERE pollutant = 'pm25' GROUP BY 1, 2)) WHERE i = 1",
    "leaderboard_sorted": "SELECT model, round(mae, 6) AS mae, row_number() OVER (ORDER BY mae, model) AS place, CASE model WHEN 'persistence' THEN 1 WHEN 'seasonal_naive_24' THEN 2 ELSE 3 END AS fixed, CASE WHEN model = 'persistence' THEN 'Persistence' ELSE 'Seasonal naive, ' || split_part(model, '_', 3) || ' steps' END AS label, 'baseline' AS kind FROM (SELECT model, median(mae) AS mae FROM board WHERE pollutant = 'pm25' AND horizon = 24 GROUP BY 1)",
    "single_station_metrics": "SELECT model, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round(avg(2 * abs(yhat - y) / nullif(abs(y) + abs(yhat), 0)) * 100, 6) AS smape, round(avg(yhat - y), 6) AS bias, count(*) AS n FROM err WHERE phase = 'test' AND station = 'click' AND pollutant = 'no2' GROUP BY 1",
    "merged_leaderboard": "SELECT pollutant, model, round(median(mae), 6) AS mae, count(mae) AS n FROM (SELECT pollutant, model, mae FROM board WHERE horizon = 24 UNION ALL SELECT pollutant, 'external', mae FROM board WHERE horizon = 24 AND model = 'seasonal_naive_24') GROUP BY 1, 2",
    "prediction_join": "SELECT pollutant, count(*) AS n, round(avg(ae), 6) AS mae FROM err WHERE phase = 'test' AND model = 'persistence' AND lead % 2 = 0 GROUP BY 1",
    "eda_monthly_completeness": "SELECT station, strftime(ts, '%Y-%m') AS month, round(count(no2) / count(*) * 100, 6) AS percent FROM panel GROUP BY 1, 2",
    "eda_diurnal": "SELECT env_type, hour, round(avg(m), 6) AS mean FROM (SELECT station, env_type, CAST(hour(ts) AS BIGINT) AS hour, avg(no2) AS m FROM panel GROUP BY 1, 2, 3) GROUP BY 1, 2",
    "eda_seasonal": "SELECT env_type, part, round(mean, 6) AS mean, round(rate, 6) AS rate FROM (SELECT env_type, part, avg(m) AS mean FROM (SELECT station, env_type, CAST(isodow(ts) - 1 AS BIGINT) AS part, avg(no2) AS m FROM panel GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN (SELECT part, avg(r) AS rate FROM (SELECT p.station, CAST(isodow(ts) - 1 AS BIGINT) AS part, avg(CAST(coalesce(no2 >= q, false) AS INT)) * 100 AS r FROM panel p JOIN (SELECT station, quantile_cont(no2, 0.9::DOUBLE) AS q FROM panel GROUP BY 1) USING (station) GROUP BY 1, 2) GROUP BY 1) USING (part)",
    "eda_monthly_climatology": "SELECT env_type, month, round(mean, 6) AS mean, round(rate, 6) AS rate FROM (SELECT env_type, month, avg(m) AS mean FROM (SELECT station, env_type, month(ts) AS month, avg(no2) AS m FROM panel GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN (SELECT month, avg(r) AS rate FROM (SELECT p.station, month(ts) AS month, avg(CAST(coalesce(no2 >= q, false) AS INT)) * 100 AS r FROM panel p JOIN (SELECT station, quantile_cont(no2, 0.9::DOUBLE) AS q FROM panel GROUP BY 1) USING (station) GROUP BY 1, 2) GROUP BY 1) USING (month)",
    "pooled_q90": "SELECT pollutant, round(quantile_cont(v, 0.9::DOUBLE), 6) AS q90, count(v) AS n FROM series WHERE v > 0 GROUP BY 1",
    "eda_ventilation_deciles": "SELECT CAST(bin AS BIGINT) AS bin, round((e[bin + 1] + e[bin + 2]) / 2, 6) AS centre, round(quantile_cont(y, 0.25::DOUBLE), 6) AS q25, round(quantile_cont(y, 0.5::DOUBLE), 6) AS median, round(quantile_cont(y, 0.75::DOUBLE), 6) AS q75, count(*) AS n FROM (SELECT x, y, e, len(list_filter(e[2:len(e) - 1], lambda v: x >= v)) AS bin FROM (SELECT blh AS x, pm25 AS y FROM panel WHERE blh IS NOT NULL AND pm25 IS NOT NULL), (SELECT list_sort(list_distinct(quantile_cont(blh, [0.0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 0.6::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE, 1.0::DOUBLE]))) AS e FROM panel WHERE blh IS NOT NULL AND pm25 IS NOT NULL)) GROUP BY bin, e",
    "eda_corr": "SELECT station, round(corr(no2, ws10), 6) AS r_ws, round(corr(pm25, blh), 6) AS r_blh FROM panel GROUP BY 1",
    "eda_log_hist": "SELECT CAST(least(floor((log10(pm25) - lo) / ((hi - lo) / 59)), 58) AS BIGINT) AS bin, count(*) AS n FROM panel, (SELECT log10(greatest(min(pm25), 0.1)) AS lo, log10(max(pm25)) AS hi FROM panel WHERE pm25 > 0) WHERE pm25 > 0 AND log10(pm25) >= lo GROUP BY 1",
    "unit_sums": "SELECT pollutant, model, unit_id, round(s, 6) AS s, n FROM usum",
    "per_origin_loss": "SELECT pollutant, model, station, origin_pos, round(loss, 6) AS loss FROM loss",
    "bootstrap_count_matrix": "SELECT pollutant, boot_id, unit_id, mult FROM draw",
    "bootstrap_mae_ci": _ci("d", "s", "n"),
    "bootstrap_tail_ci": _ci("td", "ts", "tn"),
    "bootstrap_dmae_ci": f"SELECT pollutant, a, b, round(p.diff, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS significant FROM (SELECT q.pollutant, a, b, {_PCT.format('x.d - y.d')} FROM pair q JOIN dist x ON x.pollutant = q.pollutant AND x.model = a JOIN dist y ON y.pollutant = q.pollutant AND y.model = b AND y.boot_id = x.boot_id GROUP BY 1, 2, 3) JOIN (SELECT q.pollutant, a, b, x.p - y.p AS diff FROM pair q JOIN (SELECT pollutant, model, sum(s) / sum(n) AS p FROM usum GROUP BY 1, 2) x ON x.pollutant = q.pollutant AND x.model = a JOIN (SELECT pollutant, model, sum(s) / sum(n) AS p FROM usum GROUP BY 1, 2) y ON y.pollutant = q.pollutant AND y.model = b) p USING (pollutant, a, b)",
    "dm_statistic_lag0": _dm(0),
    "dm_statistic_lag1": _dm(1),
    "bh_qvalues": "SELECT pollutant, a, b, round(p, 6) AS p, rank, round(q, 6) AS q, q <= 0.05 AS reject FROM (SELECT *, least(1.0, min(p * m / rank) OVER (PARTITION BY pollutant ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY pollutant ORDER BY p, a, b) AS rank, count(*) OVER (PARTITION BY pollutant) AS m FROM (SELECT pollutant, a, b, round(1 / (1 + power(mean_diff / sqrt(g0 / n) * sqrt((n - 1) / n), 2)), 9) AS p FROM dm)))",
    "dm_pvalues": _PVALUES + "SELECT pollutant, a, b, n, round(mean_diff, 6) AS mean_diff, round(dm, 6) AS dm, round(p, 6) AS p FROM pval",
    "dm_bootstrap_agreement": _PVALUES + f"SELECT t.pollutant, count(*) FILTER ((q <= 0.05) = (lo > 0 OR hi < 0)) AS agree, count(*) AS total FROM (SELECT *, least(1.0, min(p * m / rank) OVER (PARTITION BY pollutant ORDER BY rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT *, row_number() OVER (PARTITION BY pollutant ORDER BY p, a, b) AS rank, count(*) OVER (PARTITION BY pollutant) AS m FROM pval)) t JOIN (SELECT q.pollutant, a, b, {_PCT.format('x.d - y.d')} FROM pair q JOIN dist x ON x.pollutant = q.pollutant AND x.model = a JOIN dist y ON y.pollutant = q.pollutant AND y.model = b AND y.boot_id = x.boot_id GROUP BY 1, 2, 3) c USING (pollutant, a, b) GROUP BY 1",
    "bootstrap_tail_dmae_ci": f"SELECT pollutant, a, b, round(p.diff, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, coalesce(lo > 0 OR hi < 0, false) AS significant FROM (SELECT q.pollutant, a, b, {_PCT.format('x.td - y.td')} FROM pair q JOIN dist x ON x.pollutant = q.pollutant AND x.model = a JOIN dist y ON y.pollutant = q.pollutant AND y.model = b AND y.boot_id = x.boot_id GROUP BY 1, 2, 3) JOIN (SELECT q.pollutant, a, b, x.p - y.p AS diff FROM pair q JOIN (SELECT pollutant, model, sum(ts) / nullif(sum(tn), 0) AS p FROM usum GROUP BY 1, 2) x ON x.pollutant = q.pollutant AND x.model = a JOIN (SELECT pollutant, model, sum(ts) / nullif(sum(tn), 0) AS p FROM usum GROUP BY 1, 2) y ON y.pollutant = q.pollutant AND y.model = b) p USING (pollutant, a, b)",
    "tail_replication": f""", f_unit AS (SELECT station, origin_pos, dense_rank() OVER (ORDER BY station, origin_pos) - 1 AS u FROM (SELECT DISTINCT station, origin_pos FROM terr WHERE is_tail AND pollutant = 'pm25')),
f_sum AS (SELECT model, u, sum(ae) AS s, count(ae) AS n FROM terr JOIN f_unit USING (station, origin_pos) WHERE is_tail AND pollutant = 'pm25' GROUP BY 1, 2),
f_dist AS (SELECT model, b, sum(s) / sum(n) AS d FROM (SELECT b, CAST('0x' || substr(md5(b || '-' || k), 1, 8) AS BIGINT) % n_unit AS u FROM (SELECT count(*) AS n_unit FROM f_unit), range(0, 2000) x(b), range(0, 10000) y(k) WHERE k < n_unit) JOIN f_sum USING (u) GROUP BY 1, 2),
f_point AS (SELECT model, sum(s) / sum(n) AS p FROM f_sum GROUP BY 1)
SELECT 'pm25' AS pollutant, 'persistence' AS a, y.model AS b, round(first(px.p - py.p), 6) AS diff, round(quantile_cont(x.d - y.d, 0.025::DOUBLE), 6) AS lo, round(quantile_cont(x.d - y.d, 0.975::DOUBLE), 6) AS hi, quantile_cont(x.d - y.d, 0.025::DOUBLE) > 0 OR quantile_cont(x.d - y.d, 0.975::DOUBLE) < 0 AS significant
FROM f_dist x JOIN f_dist y ON x.b = y.b JOIN f_point px ON px.model = x.model JOIN f_point py ON py.model = y.model WHERE x.model = 'persistence' AND y.model <> 'persistence' GROUP BY y.model""",
    "conformal_quantile": "SELECT pollutant, model, lead, n, round(size, 6) AS q FROM (SELECT pollutant, model, lead, ae AS size, count(*) OVER (PARTITION BY pollutant, model, lead) AS n, row_number() OVER (PARTITION BY pollutant, model, lead ORDER BY ae) AS i FROM err WHERE phase = 'cal') WHERE i = ceil(least(1.0::DOUBLE, ceil((n + 1) * (1 - 0.1::DOUBLE)) / n) * (n - 1)) + 1",
    "split_cp_intervals": "SELECT e.station, e.pollutant, e.model, e.origin_pos, e.lead, round(yhat - size, 6) AS lo, round(yhat + size, 6) AS hi FROM err e JOIN quant q ON q.level = 'global' AND q.pollutant = e.pollutant AND q.model = e.model WHERE e.phase = 'test'",
    "mmcp_edges": "SELECT pollutant, model, round(w1, 6) AS ws_edges_0, round(w2, 6) AS ws_edges_1, round(b1, 6) AS blh_edges_0, round(b2, 6) AS blh_edges_1 FROM edge",
    "mmcp3d_fit": _fit([("cell", "cell"), ("wsblh", "wsblh"), ("global", "global")], "w, b, h4"),
    "mmcp4d_fit": _fit([("cell4", "cell"), ("cell3", "cell3"), ("wsblh", "wsblh"), ("global", "global")], "w, b, h2, r"),
    "mmcp3d_apply": "SELECT station, pollutant, model, origin_pos, lead, round(yhat - q3, 6) AS lo, round(yhat + q3, 6) AS hi FROM inter",
    "mmcp4d_apply": "SELECT station, pollutant, model, origin_pos, lead, round(yhat - q4, 6) AS lo, round(yhat + q4, 6) AS hi FROM inter",
    "mmcp_cell_counts": "SELECT f.pollutant, f.w, f.b, f.h2, f.r, count(x.res) AS n FROM (SELECT pollutant, CAST(w AS BIGINT) AS w, CAST(b AS BIGINT) AS b, CAST(h2 AS BIGINT) AS h2, CAST(r AS BIGINT) AS r FROM (VALUES ('no2'), ('pm25')) p(pollutant), range(0, 3) w(w), range(0, 3) b(b), range(0, 2) h(h2), range(0, 2) r(r)) f LEFT JOIN (SELECT * FROM bin WHERE phase = 'cal' AND model = 'persistence') x ON x.pollutant = f.pollutant AND x.w = f.w AND x.b = f.b AND x.h2 = f.h2 AND x.r = f.r GROUP BY 1, 2, 3, 4, 5",
    "mmcp_cell_summary": "SELECT pollutant, count(*) AS cells, min(n) AS lo, round(median(n), 6) AS median, count(*) FILTER (n >= 10) AS enough FROM (SELECT f.pollutant, f.w, f.b, f.h2, f.r, count(x.res) AS n FROM (SELECT pollutant, w, b, h2, r FROM (VALUES ('no2'), ('pm25')) p(pollutant), range(0, 3) w(w), range(0, 3) b(b), range(0, 2) h(h2), range(0, 2) r(r)) f LEFT JOIN (SELECT * FROM bin WHERE phase = 'cal' AND model = 'persistence') x ON x.pollutant = f.pollutant AND x.w = f.w AND x.b = f.b AND x.h2 = f.h2 AND x.r = f.r GROUP BY 1, 2, 3, 4, 5) GROUP BY 1",
    "episode_cuts": "SELECT pollutant, round(c3, 6) AS c3, round(blh_lo, 6) AS blh_lo, round(ws_lo, 6) AS ws_lo FROM cut",
    "episode_regime": "SELECT station, pollutant, phase, origin_pos, round(cbar, 6) AS cbar, nstag, r FROM regime",
    "leakage_audit": "SELECT pollutant, round(corr(r, ahead), 6) AS r, round(avg(r), 6) AS rate FROM regime LEFT JOIN (SELECT station, pollutant, origin_pos, avg(y) AS ahead FROM actual WHERE phase = 'test' GROUP BY 1, 2, 3) USING (station, pollutant, origin_pos) WHERE phase = 'test' GROUP BY 1",
    "coverage_by_method": "SELECT pollutant, model, round(avg(CAST(in1 AS INT)), 6) AS split, round(avg(CAST(in3 AS INT)), 6) AS mmcp3d, round(avg(CAST(in4 AS INT)), 6) AS mmcp4d, count(y) AS n FROM tint GROUP BY 1, 2",
    "winkler_width": "SELECT pollutant, model, round(avg((yhat + q4) - (yhat - q4)), 6) AS width, round(avg((yhat + q4) - (yhat - q4) + 20 * greatest((yhat - q4) - y, 0) + 20 * greatest(y - (yhat + q4), 0)), 6) AS winkler FROM inter WHERE y IS NOT NULL GROUP BY 1, 2",
    "paired_coverage_bootstrap": f"SELECT pollutant, model, round(coverage_a, 6) AS coverage_a, round(coverage_b, 6) AS coverage_b, round(coverage_a - coverage_b, 6) AS diff, round(lo, 6) AS lo, round(hi, 6) AS hi, lo > 0 OR hi < 0 AS significant FROM (SELECT pollutant, model, {_PCT.format('d')} FROM cvd GROUP BY 1, 2) JOIN (SELECT pollutant, model, sum(sa) / sum(n) AS coverage_a, sum(sb) / sum(n) AS coverage_b FROM cvu GROUP BY 1, 2) USING (pollutant, model)",
    "trained_counts": "SELECT station, pollutant, model, count(y) AS n, count(DISTINCT origin_pos) AS n_origins FROM (SELECT station, pollutant, m AS model, y, origin_pos FROM actual a, (VALUES ('ridge'), ('ridge_nowx')) v(m) WHERE phase = 'test' AND EXISTS (SELECT 1 FROM series t JOIN series g ON g.station = t.station AND g.pollutant = t.pollutant AND g.pos BETWEEN t.pos + 1 AND t.pos + 24 WHERE t.split = 'train' AND t.pos % 6 = 0 AND t.pos >= 168 AND t.pos < 336 AND g.v IS NOT NULL AND t.station = a.station AND t.pollutant = a.pollutant)) GROUP BY 1, 2, 3",
    "panel_round_trip": "SELECT station, pos, split, no2, pm25 FROM panel",
    "losses_round_trip": "SELECT pollutant, model, station, origin_pos, round(loss, 6) AS loss FROM loss WHERE pollutant = 'no2'",
    "results_round_trip": "SELECT station, pollutant, model, round(mae, 3) AS mae, n FROM board WHERE horizon = 24",
    "predictions_round_trip": "SELECT station, pollutant, model, phase, origin_pos, lead, round(yhat, 6) AS yhat FROM pred WHERE phase = 'test' AND model = 'persistence'",
    "cache_by_content": "SELECT c AS \"case\", c NOT IN ('other order', 'first again') AS made, station, round(sum(yhat * CASE WHEN c = 'other values' AND station = 'view' THEN 2 ELSE 1 END), 6) AS total, count(yhat) AS n FROM pred, (VALUES ('first'), ('other order'), ('other values'), ('a row more'), ('first again')) v(c) WHERE phase = 'test' AND model = 'persistence' AND pollutant = 'no2' GROUP BY 1, 2, 3",
    "error_totals": "SELECT pollutant, model, quarter, CAST(grouping(pollutant, model, quarter) AS BIGINT) AS grouping, round(avg(ae), 6) AS mae, round(sqrt(avg(ae * ae)), 6) AS rmse, round(avg(yhat - y), 6) AS bias, count(ae) AS n FROM (SELECT *, (lead - 1) // 6 AS quarter FROM err WHERE phase = 'test') GROUP BY CUBE (pollutant, model, quarter)",
    "refined_quantiles": "SELECT pollutant, round(quantile_cont(v, 0.25::DOUBLE), 6) AS q25, round(quantile_cont(v, 0.5::DOUBLE), 6) AS median, round(quantile_cont(v, 0.75::DOUBLE), 6) AS q75, round(quantile_cont(v, 0.9::DOUBLE), 6) AS q90 FROM series GROUP BY 1",
    "stream_sliding_windows": "SELECT event_type AS station, time_bucket(INTERVAL 6 HOURS, moment, TIMESTAMP '1970-01-01') - to_hours(6 * b) AS since, time_bucket(INTERVAL 6 HOURS, moment, TIMESTAMP '1970-01-01') - to_hours(6 * b) + INTERVAL 24 HOURS AS until, count(*) AS n, round(avg(value), 6) AS mean FROM raw, range(0, 4) g(b) GROUP BY 1, 2, 3",
    "stream_sessions": "SELECT user_id, min(moment) AS since, max(moment) + INTERVAL 2 HOURS AS until, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY moment, event_id) AS run FROM (SELECT *, CASE WHEN moment < lag(moment) OVER (PARTITION BY user_id ORDER BY moment, event_id) + INTERVAL 2 HOURS THEN 0 ELSE 1 END AS begins FROM raw)) GROUP BY user_id, run",
    "stream_filled_means": "SELECT station, ts, round(v, 6) AS v, round(ff, 6) AS ff, round(mean, 6) AS mean FROM (SELECT station, ts, v, ff, avg(ff) OVER (PARTITION BY station ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS mean FROM fill WHERE pollutant = 'no2' AND pos >= first_obs) WHERE ts <= (SELECT max(ts) FROM obs) - INTERVAL 4 HOURS",
    "drift_forecast": """, d_ctx AS (SELECT o.station, o.pollutant, o.origin_pos, f.pos - o.origin_pos + 71 AS i, ff, ff - lag(ff) OVER (PARTITION BY o.station, o.pollutant, o.origin_pos ORDER BY f.pos) AS step, ws10 FROM origin o JOIN fill f ON f.station = o.station AND f.pollutant = o.pollutant AND f.pos BETWEEN o.origin_pos - 71 AND o.origin_pos JOIN panel p ON p.station = o.station AND p.pos = f.pos WHERE phase = 'test'),
d_one AS (SELECT station, pollutant, origin_pos, max(CASE WHEN i = 71 THEN ff END) AS a, (max(CASE WHEN i = 71 THEN ff END) - max(CASE WHEN i = 0 THEN ff END)) / 71 AS slope, stddev_pop(step) AS sd, avg(ws10) AS wind FROM d_ctx GROUP BY 1, 2, 3),
d_all AS (SELECT t.station, t.pollutant, 'drift' AS model, t.origin_pos, t.lead, a + t.lead * slope - 0.1::DOUBLE * coalesce(p.ws10 - wind, 0) AS yhat, sd * sqrt(t.lead) AS w FROM target t JOIN d_one USING (station, pollutant, origin_pos) JOIN panel p ON p.station = t.station AND p.pos = t.target_pos WHERE phase = 'test')
SELECT station, pollutant, model, origin_pos, lead, round(yhat, 6) AS yhat, round(yhat - 1.2815515655446004::DOUBLE * w, 6) AS q10, round(yhat, 6) AS q50, round(yhat + 1.2815515655446004::DOUBLE * w, 6) AS q90 FROM d_all""",
    "resumed_cells": "SELECT station, pollutant, horizon, model, round(mae, 3) AS mae, round(mae_topdecile, 3) AS mae_topdecile, round(q90, 3) AS q90, n, n_origins FROM board",
    "metrics_round_trip": "SELECT model, round(avg(abs(yhat - y)), 6) AS mae, round(sqrt(avg((yhat - y) * (yhat - y))), 6) AS rmse, round(avg(2 * abs(yhat - y) / nullif(abs(y) + abs(yhat), 0)) * 100, 6) AS smape, round(avg(yhat - y), 6) AS bias, count(*) AS n FROM err WHERE phase = 'test' AND station = 'view' AND pollutant = 'pm25' GROUP BY 1",
    "kept_columns": "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, value, CAST(NULL AS DOUBLE) AS absent FROM events",
    "site_coordinates": "SELECT DISTINCT event_type AS site_id, CAST(length(event_type) AS DOUBLE) AS latitude, CAST(ascii(event_type) AS DOUBLE) AS longitude FROM events WHERE event_type IN ('click', 'view')",
    "registered_series": "SELECT CASE station WHEN 'click' THEN 'KC1' WHEN 'purchase' THEN 'SHDG' WHEN 'signup' THEN 'MAN3' ELSE 'MY1' END AS code, pos, pm25 AS v FROM panel WHERE station <> 'error'",
    "sql_functions": _PVALUES + "SELECT pollutant, a, b, n, round(dm, 6) AS dm, round(p, 6) AS p FROM pval",
    "ridge_of_two_features": """, r_raw AS (
  SELECT o.station, o.pollutant, s.pos, lead, s.v AS y0, t.v AS y, o.phase FROM (SELECT station, pollutant, pos AS origin_pos, 'train' AS phase FROM series WHERE split = 'train' AND pos % 6 = 0 AND pos >= 168 AND pos < 336 UNION ALL SELECT station, pollutant, origin_pos, 'test' FROM origin WHERE phase = 'test') o, lead
  JOIN series s ON s.station = o.station AND s.pollutant = o.pollutant AND s.pos = o.origin_pos JOIN series t ON t.station = o.station AND t.pollutant = o.pollutant AND t.pos = o.origin_pos + lead),
r_med AS (SELECT station, pollutant, median(y0) AS med FROM r_raw WHERE phase = 'train' AND y IS NOT NULL GROUP BY 1, 2),
r_x AS (SELECT r.station, r.pollutant, pos, lead, phase, y, coalesce(y0, med) AS a, CAST(lead AS DOUBLE) AS b FROM r_raw r JOIN r_med USING (station, pollutant)),
r_s AS (SELECT station, pollutant, count(*) AS n, avg(y) AS my, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM r_x WHERE phase = 'train' AND y IS NOT NULL GROUP BY 1, 2),
r_f AS (SELECT station, pollutant, n, my, ma, sa, mb, sb, sum((a - ma) / sa * (b - mb) / sb) AS ab, sum((a - ma) / sa * (y - my)) AS ay, sum((b - mb) / sb * (y - my)) AS sy FROM r_x JOIN r_s USING (station, pollutant) WHERE phase = 'train' AND y IS NOT NULL GROUP BY ALL),
r_c AS (SELECT *, ((n + 1) * ay - ab * sy) / ((n + 1) * (n + 1) - ab * ab) AS ca, ((n + 1) * sy - ab * ay) / ((n + 1) * (n + 1) - ab * ab) AS cb FROM r_f)
SELECT x.station, x.pollutant, 'ridge_two' AS model, x.pos AS origin_pos, x.lead, round((x.a - ma) / sa * ca + (x.b - mb) / sb * cb + my, 6) AS yhat FROM r_x x JOIN r_c USING (station, pollutant) WHERE phase = 'test'""",
    "manifest_append": "SELECT 'events' AS source, '' AS city, event_type AS station, '2024' AS year, '' AS pull_date_utc, '' AS sha256, CAST(count(*) AS VARCHAR) AS n_rows, '' AS notes FROM raw GROUP BY event_type",
    "stream_tumbling_hourly": "SELECT event_type AS station, ts, count(*) AS n, round(sum(value), 6) AS total FROM raw GROUP BY 1, 2",
}


def _nudged(select: str) -> str:
    """Means of values of 4 places can lie half-way between two of 6: both engines add 1e-9 before they round."""
    return re.sub(r", ([36])\) AS ", r" + 1e-9, \1) AS ", select)


def oracle_sql() -> dict[str, str]:
    plain = {"json_column_unpack"}
    return {name: f"WITH {_CHAIN.strip()}\n{select if name in plain else _nudged(select)}" for name, select in _SELECTS.items()}
