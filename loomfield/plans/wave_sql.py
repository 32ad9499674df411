"""SQL views for wave detection, peaks and matches: rows, windows and recursion in place of arrays and folds.

Averages are taken over whole cents, and of quantiles over whole fractions of them, so that
days of equal averages compare as equal in whatever order they are added.
"""

from __future__ import annotations

from loomfield.operators.detection import LEVEL, PRESETS, QUIET, Preset


def smooth_views(source: str, t: str) -> dict[str, str]:
    """Days of a series by number, with the average of seven."""
    return {
        f"{t}_c": f"SELECT unit, date, value, round(value * 100000)::BIGINT AS cents, row_number() OVER (PARTITION BY unit ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY unit) AS n FROM {source}",
        f"{t}_s": f"SELECT unit, date, value, k, n, CASE WHEN k >= 3 AND k < n - 3 THEN w ELSE 0 END AS w, CASE WHEN k >= 3 AND k < n - 3 THEN w::DOUBLE / 100000 / 7 ELSE 0 END AS s "
        f"FROM (SELECT *, sum(cents) OVER (PARTITION BY unit ORDER BY k ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS w FROM {t}_c)",
        f"{t}_fall": f"SELECT unit, k FROM (SELECT unit, k, w, lead(w) OVER (PARTITION BY unit ORDER BY k) AS next FROM {t}_s) WHERE next <= w",
    }


def wave_views(t: str, tag: str, p: Preset) -> dict[str, str]:
    """Candidates and waves of a smoothed series under a preset; names begin with tag."""
    half, before, after, side = p.window // 2, p.smooth - 1 - (p.smooth - 1) // 2, (p.smooth - 1) // 2, max(p.min_days // 2, 3)
    v = {
        "low": f"SELECT *, quantile_cont(s, {p.percentile / 100}) OVER (PARTITION BY unit ORDER BY k ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS low FROM {t}_s",
        "b": f"SELECT *, round(greatest(sum(round(low * 1e12)::HUGEINT) OVER (PARTITION BY unit ORDER BY k ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)::DOUBLE / 1e12 / {p.smooth}, 0), 9) AS b FROM @low",
        "over": f"SELECT unit, k FROM @b WHERE s > b + (b * {p.rel} + {p.floor})",
        "isle": "SELECT unit, min(k) AS a, max(k) AS z FROM (SELECT unit, k, k - row_number() OVER (PARTITION BY unit ORDER BY k) AS g FROM @over) GROUP BY unit, g",
        "join": f"SELECT *, sum(CASE WHEN a - q <= {p.gap} THEN 0 ELSE 1 END) OVER (PARTITION BY unit ORDER BY a ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, lag(z) OVER (PARTITION BY unit ORDER BY a) AS q FROM @isle)",
        "reg": f"SELECT unit, min(a) AS a, max(z) AS z, max(z) - min(a) + 1 AS len FROM @join GROUP BY unit, m HAVING max(z) - min(a) + 1 >= {p.min_days}",
        "e": "SELECT r.unit, r.a, r.len, x.k - r.a AS i, x.s - x.b AS e FROM @reg r JOIN @b x ON x.unit = r.unit AND x.k BETWEEN r.a AND r.z",
        "high": f"SELECT unit, a, i FROM (SELECT *, max(e) OVER (PARTITION BY unit, a) AS most, max(e) OVER (PARTITION BY unit, a ORDER BY i ROWS BETWEEN {side} PRECEDING AND {side} FOLLOWING) AS near FROM @e) WHERE len > {2 * p.min_days} AND i >= {side} AND i < len - {side} AND e >= near AND e > greatest(0.1 * most, {3 * p.floor})",
        "top": f"SELECT unit, a, min(i) AS i FROM @high GROUP BY unit, a UNION ALL SELECT t.unit, t.a, x.i FROM @top t JOIN LATERAL (SELECT min(h.i) AS i FROM @high h WHERE h.unit = t.unit AND h.a = t.a AND h.i >= t.i + {p.min_days}) x ON x.i IS NOT NULL",
        "pair": "SELECT unit, a, i AS o, lead(i) OVER w AS t, least(e, lead(e) OVER w) AS lower FROM @top JOIN @e USING (unit, a, i) WINDOW w AS (PARTITION BY unit, a ORDER BY i)",
        "seg": "SELECT q.unit, q.a, q.o, x.i, x.e, q.lower FROM @pair q JOIN @e x ON x.unit = q.unit AND x.a = q.a AND x.i BETWEEN q.o AND q.t",
        "deep": f"SELECT unit, a, o, max(n) AS longest FROM (SELECT unit, a, o, count(*) AS n FROM (SELECT unit, a, o, i - row_number() OVER (PARTITION BY unit, a, o ORDER BY i) AS g FROM @seg WHERE e < {1 - p.split} * lower) GROUP BY unit, a, o, g) GROUP BY unit, a, o",
        "val": f"SELECT unit, a, i FROM (SELECT unit, a, o, arg_min(i, (e, i)) AS i, min(e) AS e, any_value(lower) AS lower FROM @seg GROUP BY unit, a, o) JOIN @deep USING (unit, a, o) WHERE e < {1 - p.split} * lower AND lower - e >= {2 * p.floor} AND longest >= {max(p.min_days, 10)}",
        "head": f"SELECT unit, a, 0::BIGINT AS h FROM @reg UNION ALL SELECT t.unit, t.a, x.i + 1 FROM @head t JOIN LATERAL (SELECT min(v.i) AS i FROM @val v WHERE v.unit = t.unit AND v.a = t.a AND v.i - t.h >= {p.min_days}) x ON x.i IS NOT NULL",
        "kept": f"SELECT unit, a, h, len FROM (SELECT *, max(h) OVER (PARTITION BY unit, a) AS most FROM @head JOIN (SELECT unit, a, len FROM @reg) USING (unit, a)) WHERE h = 0 OR h < most OR len - h >= {p.min_days}",
        "part": "SELECT unit, pa, pz, coalesce(lag(pz) OVER (PARTITION BY unit ORDER BY pa) + 1, 0) AS since FROM (SELECT unit, a + h AS pa, a + coalesce(lead(h) OVER (PARTITION BY unit, a ORDER BY h), len) - 1 AS pz FROM @kept)",
        "start": f"SELECT p.unit, p.pa, p.pz, greatest(coalesce(max(f.k) + 1, greatest(p.pa - {p.lookback}, 0)), p.since) AS f0 FROM @part p LEFT JOIN {t}_fall f ON f.unit = p.unit AND f.k >= p.pa - {p.lookback} AND f.k < p.pa GROUP BY p.unit, p.pa, p.pz, p.since",
        "peak": f"SELECT p.unit, p.pa, p.pz, p.f0, arg_max(x.k, (x.s, -x.k)) AS pk, max(x.s) AS ps, min(x.b) AS low FROM @start p JOIN @b x ON x.unit = p.unit AND x.k BETWEEN p.f0 AND p.pz GROUP BY ALL",
        "quiet": f"SELECT unit, pa, pk, min(k) AS qa, max(k) AS qz FROM (SELECT p.unit, p.pa, p.pk, x.k, x.k - row_number() OVER (PARTITION BY p.unit, p.pa ORDER BY x.k) AS g FROM @peak p JOIN {t}_s x ON x.unit = p.unit AND x.k BETWEEN p.f0 AND p.pz WHERE p.ps > p.low AND x.s < p.low + {LEVEL} * (p.ps - p.low)) GROUP BY unit, pa, pk, g HAVING count(*) >= {QUIET}",
        "cand": f"SELECT p.unit, p.pa, p.pk, coalesce(max(q.qz) FILTER (q.qz < p.pk) + 1, p.f0) AS f1, coalesce(min(q.qa) FILTER (q.qa > p.pk) - 1, p.pz) AS l1, any_value(CASE WHEN x.value > 0 THEN x.value ELSE x.s END) AS peak_value, any_value(x.s) AS s, any_value(x.date) AS peak_date, any_value(x.s - x.b >= {p.significance} * (x.b * {p.rel} + {p.floor})) AS kept FROM @peak p JOIN @b x ON x.unit = p.unit AND x.k = p.pk LEFT JOIN @quiet q ON q.unit = p.unit AND q.pa = p.pa GROUP BY p.unit, p.pa, p.pk, p.f0, p.pz",
        "wave": f"SELECT c.unit, row_number() OVER (PARTITION BY c.unit ORDER BY c.pa) AS wave_number, min(x.date) AS start_date, c.peak_date, max(x.date) AS end_date, c.peak_value, greatest(max(x.date) - min(x.date), 1)::BIGINT AS duration_days, sum(x.value) AS wave_burden FROM @cand c JOIN {t}_s x ON x.unit = c.unit AND x.k BETWEEN c.f1 AND c.l1 WHERE c.kept GROUP BY c.unit, c.pa, c.peak_date, c.peak_value",
    }
    return {f"{tag}_{k}": q.replace("@", f"{tag}_") for k, q in v.items()}


def peak_views(source: str, tag: str, value: str, prominence: float, distance: int) -> dict[str, str]:
    """Peaks of a column of numbered days by prominence; of those nearer than distance the highest, one after the other."""
    v = {
        "run": f"SELECT unit, min(k) AS a, max(k) AS z, any_value({value}) AS v FROM (SELECT *, sum(new) OVER (PARTITION BY unit ORDER BY k ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT unit, k, {value}, CASE WHEN {value} = lag({value}) OVER (PARTITION BY unit ORDER BY k) THEN 0 ELSE 1 END AS new FROM {source})) GROUP BY unit, g",
        "top": "SELECT unit, (a + z) // 2 AS k, v, row_number() OVER (PARTITION BY unit ORDER BY v DESC, a DESC) AS r FROM (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS h FROM @run WINDOW w AS (PARTITION BY unit ORDER BY a)) WHERE v > l AND v > h",
        "held": f"SELECT unit, 0::BIGINT AS r, []::BIGINT[] AS kept FROM (SELECT DISTINCT unit FROM @top) UNION ALL SELECT h.unit, t.r, CASE WHEN len(list_filter(h.kept, lambda x: abs(x - t.k) < {distance})) = 0 THEN list_append(h.kept, t.k) ELSE h.kept END FROM @held h JOIN @top t ON t.unit = h.unit AND t.r = h.r + 1",
        "place": "SELECT unit, unnest(kept) AS k FROM (SELECT unit, arg_max(kept, r) AS kept FROM @held GROUP BY unit)" if distance > 1 else "SELECT unit, k FROM @top",
        "far": f"SELECT p.unit, p.k, t.v, max(x.k) FILTER (x.k < p.k) AS l, min(x.k) FILTER (x.k > p.k) AS h FROM @place p JOIN @top t ON t.unit = p.unit AND t.k = p.k LEFT JOIN {source} x ON x.unit = p.unit AND x.{value} > t.v GROUP BY ALL",
        "peak": f"SELECT * FROM (SELECT f.unit, f.k, f.v, f.v - greatest(min(x.{value}) FILTER (x.k <= f.k AND x.k > coalesce(f.l, -1)), min(x.{value}) FILTER (x.k >= f.k AND x.k < coalesce(f.h, 1000000000))) AS rise FROM @far f JOIN {source} x ON x.unit = f.unit GROUP BY f.unit, f.k, f.v) WHERE rise >= {prominence}",
    }
    if distance <= 1:
        del v["held"]
    return {f"{tag}_{k}": q.replace("@", f"{tag}_") for k, q in v.items()}


def match_views(tag: str, cases: str, deaths: str, max_lag: int) -> dict[str, str]:
    """Pairs of peaks (unit, k, v): each case with the nearest later death that none before it took."""
    v = {
        "num": f"SELECT *, row_number() OVER (PARTITION BY unit ORDER BY k) AS i FROM {cases}",
        "walk": f"SELECT unit, 0::BIGINT AS i, -1::BIGINT AS used, NULL::BIGINT AS c, NULL::BIGINT AS m FROM @num WHERE i = 1 UNION ALL SELECT n.unit, n.i, coalesce(x.k, w.used), n.k, x.k FROM @walk w JOIN @num n ON n.unit = w.unit AND n.i = w.i + 1 LEFT JOIN LATERAL (SELECT min(q.k) AS k FROM {deaths} q WHERE q.unit = n.unit AND q.k >= n.k AND q.k > w.used AND q.k - n.k <= {max_lag}) x ON true",
        "pair": f"SELECT w.unit, DATE '1995-01-01' + w.c::INTEGER AS case_peak_date, DATE '1995-01-01' + w.m::INTEGER AS death_peak_date, w.m - w.c AS lag_days, a.v AS case_peak_value, b.v AS death_peak_value, b.v / nullif(a.v, 0) AS severity_ratio FROM @walk w JOIN {cases} a ON a.unit = w.unit AND a.k = w.c JOIN {deaths} b ON b.unit = w.unit AND b.k = w.m",
    }
    return {f"{tag}_{k}": q.replace("@", f"{tag}_") for k, q in v.items()}


VIEWS = {
    **smooth_views("series", "ws"), **smooth_views("second", "wt"), **{k: q for name, p in PRESETS.items() for k, q in wave_views("ws", f"w{name}", p).items()}, **wave_views("wt", "wsecond", PRESETS["standard"]),
    "ws_tot": "SELECT unit, sum(value) AS total FROM series GROUP BY unit", "wt_tot": "SELECT unit, sum(value) AS total FROM second GROUP BY unit",
    **{f"{t}_scored": f"SELECT w.*, total, round_even(100 * (0.3 * peak_value / max(peak_value) OVER p + 0.3 * wave_burden / {'sum(wave_burden) OVER p' if t == 'wstandard' else 'total'} + 0.2 * least(duration_days / 180, 1) + 0.2 * (wave_burden / duration_days) / max(wave_burden / duration_days) OVER p), 1) AS wave_significance FROM {w} w JOIN {x}_tot USING (unit) WINDOW p AS (PARTITION BY unit)"
       for t, w, x in (("wstandard", "wstandard_wave", "ws"), ("wcases", "wstandard_wave", "ws"), ("wdeaths", "wsecond_wave", "wt"))},
    **{f"{t}_metric": f"SELECT t.unit, coalesce(n, 0) AS waves, coalesce(top, 0) AS largest_wave, h AS avg_wave_height, d AS avg_wave_duration, g AS avg_interwave_days, k AS peak_wave_date, total AS total_burden FROM {x}_tot t LEFT JOIN (SELECT unit, count(*) AS n, arg_max(peak_value, (wave_significance, -wave_number)) AS top, avg(peak_value) AS h, avg(duration_days) AS d, (max(peak_date) - min(peak_date)) / nullif(count(*) - 1, 0) AS g, arg_max(peak_date, (wave_significance, -wave_number)) AS k FROM {t}_scored GROUP BY unit) USING (unit)"
       for t, x in (("wcases", "ws"), ("wdeaths", "wt"))},
    **peak_views("ws_c", "lp", "value", 20.0, 14), **peak_views("wt_c", "lq", "value", 20.0, 14), **match_views("lm", "lp_peak", "lq_peak", 90),
    **peak_views("ws_s", "pw", "w", 30.0 * 700_000, 1),
    "pw_one": "SELECT p.unit, p.k, x.value AS v, coalesce(max(u.k) FILTER (u.k < p.k), p.k) AS f, coalesce(min(u.k) FILTER (u.k > p.k), p.k) AS l, row_number() OVER (PARTITION BY p.unit ORDER BY p.k) AS i FROM pw_peak p JOIN ws_c x ON x.unit = p.unit AND x.k = p.k LEFT JOIN ws_c u ON u.unit = p.unit AND u.value < 0.1 * x.value GROUP BY p.unit, p.k, x.value",
    "pw_walk": "SELECT unit, i, 1::BIGINT AS g, f, k, l, v FROM pw_one WHERE i = 1 UNION ALL SELECT o.unit, o.i, CASE WHEN o.k - w.k <= 30 THEN w.g ELSE w.g + 1 END, CASE WHEN o.k - w.k <= 30 THEN w.f ELSE o.f END, CASE WHEN o.k - w.k <= 30 AND o.v <= w.v THEN w.k ELSE o.k END, CASE WHEN o.k - w.k <= 30 AND o.v <= w.v THEN greatest(w.l, o.l) ELSE o.l END, CASE WHEN o.k - w.k <= 30 AND o.v <= w.v THEN w.v ELSE o.v END FROM pw_walk w JOIN pw_one o ON o.unit = w.unit AND o.i = w.i + 1",
    "pw_wave": "SELECT unit, g, arg_max(f, i) AS f, arg_max(k, i) AS k, arg_max(l, i) AS l, arg_max(v, i) AS v FROM pw_walk GROUP BY unit, g",
    # Daily cases and average rates of the panel's units, their peaks and matches.
    "plc": "SELECT fips AS unit, date, row_number() OVER (PARTITION BY fips ORDER BY date) - 1 AS k, cases_daily AS daily, CASE WHEN population > 0 THEN avg(cases_daily) OVER (PARTITION BY fips ORDER BY date ROWS 6 PRECEDING) / population * 100000 END AS value FROM daily WHERE fips <> '00000'",
    "pld": "SELECT fips AS unit, row_number() OVER (PARTITION BY fips ORDER BY date) - 1 AS k, avg(deaths_daily) OVER (PARTITION BY fips ORDER BY date ROWS 6 PRECEDING) / population * 100000 AS value FROM daily WHERE fips <> '00000' AND population > 0",
    "plp": "SELECT unit, k, value FROM plc WHERE value IS NOT NULL",
    **peak_views("plp", "pc", "value", 1.0, 14), **peak_views("pld", "pd", "value", 0.05, 14), **match_views("pm", "pc_peak", "pd_peak", 90), **peak_views("plc", "ps", "daily", 1.0, 1),
    "ws_var": "SELECT unit, n, count(*) FILTER (value > 0) AS up, " + ", ".join(f"var_pop(c{w}) AS v{w}" for w in (3, 5, 7, 14)) + " FROM (SELECT unit, n, value, " + ", ".join(f"sum(cents) OVER (PARTITION BY unit ORDER BY k ROWS BETWEEN {w - 1 - (w - 1) // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING)::DOUBLE / {w} AS c{w}" for w in (3, 5, 7, 14)) + " FROM ws_c) GROUP BY unit, n",
    "ws_auto": "SELECT unit, (CASE WHEN up < 28 THEN 3 WHEN v3 > 0 AND (v3 - v5) / v3 < 0.15 THEN 3 WHEN v5 > 0 AND (v5 - v7) / v5 < 0.15 THEN 5 WHEN v7 > 0 AND (v7 - v14) / v7 < 0.15 THEN 7 ELSE 14 END)::BIGINT AS \"window\" FROM ws_var",
    # Averages over each series' own window.
    "wa_s": "SELECT unit, date, value, k, n, CASE WHEN k >= d // 2 AND k < n - d // 2 THEN w ELSE 0 END AS w, CASE WHEN k >= d // 2 AND k < n - d // 2 THEN w::DOUBLE / 100000 / d ELSE 0 END AS s FROM (SELECT c.*, a.\"window\" AS d, CASE a.\"window\" " + " ".join(f"WHEN {w} THEN sum(cents) OVER (PARTITION BY unit ORDER BY k ROWS BETWEEN {w - 1 - (w - 1) // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING)" for w in (3, 5, 7, 14)) + " END AS w FROM ws_c c JOIN ws_auto a USING (unit))",
    "wa_fall": "SELECT unit, k FROM (SELECT unit, k, w, lead(w) OVER (PARTITION BY unit ORDER BY k) AS next FROM wa_s) WHERE next <= w",
    **wave_views("wa", "wauto", PRESETS["standard"]),
    **{k: v for name, p in PRESETS.items() if name != "standard" for k, v in wave_views("wa", f"wauto{name}", p).items()},
}

_WAVE = "unit, wave_number, start_date, peak_date, end_date, round(peak_value, 6) AS peak_value, duration_days, round(wave_burden, 6) AS wave_burden"
_WINDOWS = "CASE WHEN peak_date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' THEN 'Early' WHEN peak_date BETWEEN DATE '1996-06-30' AND DATE '1999-01-01' THEN 'Middle' WHEN peak_date BETWEEN DATE '1999-01-02' AND DATE '2001-12-31' THEN 'Late' ELSE 'Outside national windows' END"
_METRICS = ("largest_wave", "avg_wave_height", "avg_wave_duration", "avg_interwave_days", "total_burden")

BODIES = {
    "wave_report": f"SELECT {_WAVE} FROM wstandard_wave",
    "wave_report_presets": " UNION ALL ".join(f"SELECT '{k}' AS preset, {_WAVE} FROM w{k}_wave" for k in PRESETS),
    "wave_windows": f'SELECT unit, wave_number, peak_date, {_WINDOWS} AS "window" FROM wstandard_wave',
    "wave_scores": "SELECT unit, wave_number, wave_significance FROM wstandard_scored",
    "wave_presets": " UNION ALL ".join(f"SELECT '{k}' AS preset, count(*) AS waves FROM w{k}_wave" for k in PRESETS),
    "wave_audit_log": "SELECT unit, peak_date, round(s, 2) AS smoothed_value, round(least(s / top, 1) * 100, 1) AS pct_of_max, l1 - f1 AS span_days, CASE WHEN NOT kept THEN 'significance_filter' END AS removed_by FROM wstandard_cand JOIN (SELECT unit, max(s) AS top FROM ws_s GROUP BY unit) USING (unit)",
    "wave_metrics": "SELECT unit, " + ", ".join(f"{x}.waves AS {t}_waves, {x}.peak_wave_date AS {t}_peak_wave_date, " + ", ".join(f"round({x}.{m}, 6) AS {t}_{m}" for m in _METRICS) for x, t in (("a", "case"), ("b", "death"))) + ", (b.peak_wave_date - a.peak_wave_date)::INTEGER AS peak_lag_days FROM wcases_metric a FULL JOIN wdeaths_metric b USING (unit)",
    "lag_peaks": "SELECT unit, DATE '1995-01-01' + k::INTEGER AS peak_date, round(v, 6) AS peak_value, round(rise, 6) AS prominence FROM lp_peak",
    "lag_matches": "SELECT unit, case_peak_date, death_peak_date, lag_days, round(case_peak_value, 6) AS case_peak_value, round(death_peak_value, 6) AS death_peak_value, round(severity_ratio, 6) AS severity_ratio FROM lm_pair",
    "lag_summary": "SELECT count(*) AS n, round(avg(lag_days), 6) AS mean_lag, median(lag_days) AS median_lag, min(lag_days) AS min_lag, max(lag_days) AS max_lag, round(avg(severity_ratio), 6) AS mean_severity, round(max(case_peak_value), 6) AS largest_case_peak, round(max(death_peak_value), 6) AS largest_death_peak FROM lm_pair",
    "prominent_waves": "SELECT w.unit, w.g AS wave_number, min(x.date) AS start_date, DATE '1995-01-01' + w.k::INTEGER AS peak_date, max(x.date) AS end_date, round(w.v, 6) AS peak_value, greatest(max(x.date) - min(x.date), 1)::BIGINT AS duration_days, round(sum(x.value), 6) AS wave_burden FROM pw_wave w JOIN ws_c x ON x.unit = w.unit AND x.k BETWEEN w.f AND w.l GROUP BY w.unit, w.g, w.k, w.v",
    "smoothing_windows": 'SELECT unit, "window" FROM ws_auto',
    "wave_report_auto": f"SELECT {_WAVE} FROM wauto_wave",
    "wave_report_grid": " UNION ALL ".join(f"SELECT 'case' AS metric, '{w}' AS \"window\", '{k}' AS preset, {_WAVE} FROM {t}_wave" for k in PRESETS for w, t in (("7", f"w{k}"), ("auto", "wauto" if k == "standard" else f"wauto{k}"))),
}
