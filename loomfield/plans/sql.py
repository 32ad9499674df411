"""SQL for DuckDB that gives the rows of the registered queries."""

from __future__ import annotations

import re

from loomfield.plans import wave_sql

_VIEWS = {
    "population": "SELECT lpad(c_custkey::VARCHAR, 5, '0') AS fips, n_name AS state, c_name AS county_name, c_acctbal AS population FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "spine": "SELECT fips, d::DATE AS date FROM (SELECT DISTINCT lpad(user_id::VARCHAR, 5, '0') AS fips FROM events), generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY) t(d)",
    "days": "SELECT lpad(user_id::VARCHAR, 5, '0') AS fips, ts::DATE AS date, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS dc, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS dd FROM events GROUP BY 1, 2",
    "counts": "SELECT fips, date, (sum(coalesce(dc, 0)) OVER w)::DOUBLE AS cases, (sum(coalesce(dd, 0)) OVER w)::DOUBLE AS deaths FROM spine LEFT JOIN days USING (fips, date) WINDOW w AS (PARTITION BY fips ORDER BY date ROWS UNBOUNDED PRECEDING)",
    "panel": "SELECT counts.*, state, county_name, population FROM counts LEFT JOIN population USING (fips)",
    "daily": "SELECT *, coalesce(greatest(cases - lag(cases) OVER w, 0), 0)::DOUBLE AS cases_daily, coalesce(greatest(deaths - lag(deaths) OVER w, 0), 0)::DOUBLE AS deaths_daily FROM panel WINDOW w AS (PARTITION BY fips, state ORDER BY date)",
    "vax": "SELECT lpad(user_id::VARCHAR, 5, '0') AS fips, date, CASE WHEN NOT (user_id % 7 = 0 AND day(date) % 2 = 0) THEN least(greatest(v / 5, 0), 100) END AS vax FROM (SELECT user_id, ts::DATE AS date, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2)",
    "master": "SELECT lpad(c_custkey::VARCHAR, 5, '0') AS fips, c_acctbal AS population, n_orders, avg_price, total_price, c_custkey % 10 AS rucc_code FROM customer LEFT JOIN (SELECT o_custkey AS k, count(*)::DOUBLE AS n_orders, avg(o_totalprice) AS avg_price, sum(o_totalprice) AS total_price FROM orders GROUP BY 1) ON k = c_custkey",
    "resid": "SELECT fips, total_price - b * n_orders - a AS residual FROM master, (SELECT regr_slope(total_price, n_orders) AS b, regr_intercept(total_price, n_orders) AS a FROM master) WHERE total_price IS NOT NULL",
    "logged": "SELECT fips, log10(greatest(population, 1)) AS a, n_orders AS b, avg_price AS c FROM master WHERE n_orders IS NOT NULL AND population IS NOT NULL AND avg_price IS NOT NULL",
    "zscores": "SELECT fips, (a - avg(a) OVER ()) / stddev_samp(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_samp(b) OVER () AS b, (c - avg(c) OVER ()) / stddev_samp(c) OVER () AS c FROM logged",
    "grid": "SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 5, '0') AS fips, c_custkey % 50 AS i, c_custkey // 50 AS j, c_acctbal AS v FROM customer",
    "edges": "SELECT a.fips AS src, b.fips AS dst FROM grid a JOIN grid b ON abs(a.i - b.i) + abs(a.j - b.j) = 1",
    "centred": "SELECT fips, v - avg(v) OVER () AS z, v FROM grid",
    "local": "SELECT fips, sum(x) AS sx, count(*) AS w FROM (SELECT fips, v AS x FROM grid UNION ALL SELECT src, v FROM edges JOIN grid ON dst = fips) GROUP BY fips",
    "gi": "SELECT fips, (sx - m * w) / (s * sqrt((n * w - w * w) / (n - 1))) AS z FROM local, (SELECT avg(v) AS m, stddev_pop(v) AS s, count(*)::DOUBLE AS n FROM grid)",
    "ordered": "SELECT c_nationkey::VARCHAR AS unit, o_orderdate::DATE AS date, sum(o_totalprice) / 1000 AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
    "series": "SELECT u.unit, u.date, coalesce(o.value, 0) AS value FROM (SELECT unit, d::DATE AS date FROM (SELECT DISTINCT unit FROM ordered), generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY) t(d)) u LEFT JOIN ordered o ON u.unit = o.unit AND u.date = o.date",
    "smooth": "SELECT unit, date, row_number() OVER (PARTITION BY unit ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY unit) AS n, sum(value) OVER (PARTITION BY unit ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS s FROM series",
    "above": "SELECT unit, date, k FROM smooth WHERE k >= 3 AND k < n - 3 AND s > 45",
    "runs": "SELECT unit, min(k) AS a, max(k) AS b, min(date) AS start_date, max(date) AS end_date FROM (SELECT *, k - row_number() OVER (PARTITION BY unit ORDER BY k) AS g FROM above) GROUP BY unit, g",
    "merged": "SELECT *, sum(CASE WHEN a - p > 35 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY a ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, lag(b) OVER (PARTITION BY unit ORDER BY a) AS p FROM runs)",
    "shipped": "SELECT s_nationkey::VARCHAR AS unit, l_shipdate::DATE AS date, sum(l_extendedprice) / 1000 AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2",
    "second": "SELECT u.unit, u.date, coalesce(o.value, 0) AS value FROM (SELECT unit, d::DATE AS date FROM (SELECT DISTINCT unit FROM shipped), generate_series(DATE '1995-01-01', DATE '2001-08-01', INTERVAL 1 DAY) t(d)) u LEFT JOIN shipped o ON u.unit = o.unit AND u.date = o.date",
    "spans": "SELECT unit, min(start_date) AS start_date, max(end_date) AS end_date, max(b) - min(a) + 1 AS days FROM merged GROUP BY unit, m HAVING max(b) - min(a) + 1 >= 14",
    "waves": "SELECT r.unit, row_number() OVER (PARTITION BY r.unit ORDER BY start_date) AS wave_number, start_date, peak_date, end_date, peak_value, greatest(end_date - start_date, 1)::BIGINT AS duration_days, wave_burden, days FROM spans r JOIN (SELECT r.unit, r.start_date AS s, arg_max(date, (value, -epoch(date))) AS peak_date, max(value) AS peak_value, sum(value) AS wave_burden FROM spans r JOIN series x ON x.unit = r.unit AND x.date BETWEEN r.start_date AND r.end_date GROUP BY 1, 2) p ON p.unit = r.unit AND p.s = r.start_date",
    "totals": "SELECT unit, sum(value) AS total FROM series GROUP BY unit",
    "scored": "SELECT w.*, total, round_even(100 * (0.3 * peak_value / max(peak_value) OVER p + 0.3 * wave_burden / total + 0.2 * least(duration_days / 180, 1) + 0.2 * (wave_burden / duration_days) / max(wave_burden / duration_days) OVER p), 1) AS wave_significance FROM waves w JOIN totals USING (unit) WINDOW p AS (PARTITION BY unit)",
    "smooth2": "SELECT unit, date, row_number() OVER (PARTITION BY unit ORDER BY date) - 1 AS k, count(*) OVER (PARTITION BY unit) AS n, sum(value) OVER (PARTITION BY unit ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7 AS s FROM second",
    "runs2": "SELECT unit, min(k) AS a, max(k) AS b, min(date) AS start_date, max(date) AS end_date FROM (SELECT *, k - row_number() OVER (PARTITION BY unit ORDER BY k) AS g FROM smooth2 WHERE k >= 3 AND k < n - 3 AND s > 45) GROUP BY unit, g",
    "spans2": "SELECT unit, min(start_date) AS start_date, max(end_date) AS end_date FROM (SELECT *, sum(CASE WHEN a - p > 35 OR p IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY unit ORDER BY a ROWS UNBOUNDED PRECEDING) AS m FROM (SELECT *, lag(b) OVER (PARTITION BY unit ORDER BY a) AS p FROM runs2)) GROUP BY unit, m HAVING max(b) - min(a) + 1 >= 14",
    "waves2": "SELECT r.unit, row_number() OVER (PARTITION BY r.unit ORDER BY r.start_date) AS wave_number, arg_max(date, (value, -epoch(date))) AS peak_date, max(value) AS peak_value, greatest(r.end_date - r.start_date, 1)::BIGINT AS duration_days FROM spans2 r JOIN second x ON x.unit = r.unit AND x.date BETWEEN r.start_date AND r.end_date GROUP BY r.unit, r.start_date, r.end_date",
    "casepeaks": "SELECT unit, arg_max(date, (value, -epoch(date))) AS d, max(value) AS v FROM series GROUP BY unit, date_trunc('month', date)",
    "deathpeaks": "SELECT unit, arg_max(date, (value, -epoch(date))) AS d, max(value) AS v FROM second GROUP BY unit, date_trunc('month', date)",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY unit ORDER BY d) AS i FROM casepeaks",
    "walk": "SELECT unit, 0::BIGINT AS i, DATE '1900-01-01' AS used, NULL::DATE AS c, NULL::DATE AS m FROM numbered WHERE i = 1 UNION ALL SELECT n.unit, n.i, coalesce(x.d, w.used), n.d, x.d FROM walk w JOIN numbered n ON n.unit = w.unit AND n.i = w.i + 1 LEFT JOIN LATERAL (SELECT min(q.d) AS d FROM deathpeaks q WHERE q.unit = n.unit AND q.d >= n.d AND q.d > w.used AND q.d - n.d <= 20) x ON true",
    "paired": "SELECT w.unit, w.c AS case_peak_date, w.m AS death_peak_date, (w.m - w.c)::BIGINT AS lag_days, a.v AS case_peak_value, b.v AS death_peak_value FROM walk w JOIN casepeaks a ON a.unit = w.unit AND a.d = w.c JOIN deathpeaks b ON b.unit = w.unit AND b.d = w.m",
    "lastday": "SELECT * FROM daily WHERE date = DATE '2024-01-30' AND fips <> '00000'",
    "maall": "SELECT * FROM (SELECT *, " + ", ".join(f"avg({c}_daily) OVER (PARTITION BY fips, state ORDER BY date ROWS {k - 1} PRECEDING) AS {c}_ma{k}" for c in ("cases", "deaths") for k in (3, 5, 7)) + " FROM daily WHERE fips <> '00000') WHERE date = DATE '2024-01-30'",
    "vaxlast": "SELECT fips, arg_max(vax, date) FILTER (vax IS NOT NULL) AS vax FROM vax GROUP BY fips",
    "national": "SELECT date, sum(cases) AS cases, sum(cases_daily) AS cd FROM daily WHERE fips <> '00000' GROUP BY date",
    "feat": "SELECT fips, population AS population_2020, n_orders AS hospital_beds, avg_price AS pop_65plus, CASE WHEN rucc_code > 0 THEN rucc_code::DOUBLE END AS rucc_code FROM master",
    "slice": "SELECT *, avg(cases_daily) OVER (PARTITION BY fips, state ORDER BY date ROWS 6 PRECEDING) AS ma FROM daily WHERE fips <> '00000'",
    "map": "SELECT fips, state, county_name, round(population, 6) AS population, round(cases, 6) AS cases, round(deaths, 6) AS deaths, round(ma / population * 100000, 6) AS value, round(cases / population * 100000, 6) AS cases_pc, round(deaths / population * 100000, 6) AS deaths_pc, CASE WHEN population >= 5000 THEN 'Urban' ELSE 'Rural' END AS county_type FROM slice WHERE date = DATE '2024-01-30' AND population > 0",
    "windowed": "SELECT fips, population, greatest(max(cases) FILTER (date = DATE '2024-01-30') - max(cases) FILTER (date = DATE '2024-01-05'), 0)::DOUBLE AS cases, greatest(max(deaths) FILTER (date = DATE '2024-01-30') - max(deaths) FILTER (date = DATE '2024-01-05'), 0)::DOUBLE AS deaths FROM panel WHERE fips <> '00000' GROUP BY ALL",
    "explored": "SELECT fips, m.population, n_orders, avg_price, CASE WHEN w.population > 0 THEN cases / w.population * 100000 END AS cases_per_100k, CASE WHEN w.population > 0 THEN deaths / w.population * 100000 END AS deaths_per_100k FROM windowed w JOIN master m USING (fips) WHERE m.population > 1000",
    "thin": "SELECT p.fips, p.state, p.county_name, p.population, p.date, CASE WHEN d.fips IS NOT NULL THEN cases END AS cases, CASE WHEN d.fips IS NOT NULL THEN deaths END AS deaths FROM panel p LEFT JOIN days d ON d.fips = p.fips AND d.date = p.date",
    "thindaily": "SELECT *, coalesce(greatest(cases - lag(cases) OVER w, 0), 0)::DOUBLE AS cases_daily, coalesce(greatest(deaths - lag(deaths) OVER w, 0), 0)::DOUBLE AS deaths_daily FROM thin WINDOW w AS (PARTITION BY fips, state ORDER BY date)",
    "thinmap": "SELECT *, avg(cases_daily) OVER (PARTITION BY fips, state ORDER BY date ROWS 6 PRECEDING) AS ma, avg(deaths_daily) OVER (PARTITION BY fips, state ORDER BY date ROWS 2 PRECEDING) AS da FROM thindaily WHERE fips <> '00000'",
    **wave_sql.VIEWS,
}


def _with(body: str) -> str:
    """body after the views that it needs, in order."""
    need, todo = set(), [body]
    while todo:
        text = todo.pop()
        for v in _VIEWS:
            if v not in need and re.search(rf"\b{v}\b(?!\()", text):
                need.add(v)
                todo.append(_VIEWS[v])
    walks = {v for v in need if v.endswith(("walk", "_top", "_head", "_held")) and re.search(rf"UNION ALL .*\b{v}\b", _VIEWS[v])}
    views = ", ".join(f"{v} AS {'MATERIALIZED ' * (v in wave_sql.VIEWS and v not in walks)}({q})" for v, q in _VIEWS.items() if v in need)
    if body.startswith("WITH "):  # its own views come after these
        views, body = f"{views}, {body[5:]}", ""
    return f"WITH {'RECURSIVE ' * bool(walks)}{views} {body}" if views else body


def _area(height: str, top: str) -> str:
    """The integral of height, in u, from 0 to top by Simpson's rule."""
    return f"(SELECT sum(CASE WHEN j = 0 OR j = 2000 THEN 1 WHEN j % 2 = 1 THEN 4 ELSE 2 END * {height}) FROM (SELECT j, {top} * j / 2000 AS u FROM generate_series(0, 2000) g(j))) * {top} / 6000"


def _p_of_t(t: str, df: str) -> str:
    """Two-sided, of Student's t; beyond 40 it is 0 to all places shown."""
    top = f"least(abs({t}), 40)"
    return f"greatest(1 - 2 * {_area(f'exp(-({df} + 1) / 2.0 * ln(1 + u * u / {df}))', top)} * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt({df} * pi()), 0)"


def _p_of_r(r: str) -> str:
    return f"CASE WHEN abs({r}) > 1 - 1e-12 THEN 0 ELSE {_p_of_t(f'({r} * sqrt((n - 2) / (1 - {r} * {r})))', '(n - 2)')} END"


def _pair(o: str, f: str, table: str = "master") -> str:
    """The statistics of one outcome and factor."""
    rank = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
    r = "1.0" if o == f else "covar_pop(f, o) / (stddev_pop(f) * stddev_pop(o))"
    return f"SELECT '{o}' AS outcome, '{f}' AS factor, count(*) AS n, {r} AS r, covar_pop(rf, ro) / (stddev_pop(rf) * stddev_pop(ro)) AS rho, avg(f) AS fm, avg(o) AS om, stddev_samp(f) AS fs, stddev_samp(o) AS os FROM (SELECT {f} AS f, {o} AS o, {rank.format(f)} AS rf, {rank.format(o)} AS ro FROM {table} WHERE {f} IS NOT NULL AND {o} IS NOT NULL)"


def _associations(outcomes: tuple, table: str) -> str:
    """All statistics of outcomes and the three factors of a table, ranked within each outcome."""
    pairs = " UNION ALL ".join(_pair(o, f, table) for o in outcomes for f in ("population", "n_orders", "avg_price"))
    shown = "SELECT outcome, factor, n, round(r, 3) AS pearson_r, round(rho, 3) AS spearman_r, round({p}, 3) AS pearson_p, round({q}, 3) AS spearman_p, round(r * r, 3) AS r_squared, round(CASE WHEN outcome <> factor THEN tanh(atanh(r) - 1.96 / sqrt(n - 3)) END, 3) AS ci_low, round(CASE WHEN outcome <> factor THEN tanh(atanh(r) + 1.96 / sqrt(n - 3)) END, 3) AS ci_high, CASE WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength, round(fm, 3) AS factor_mean, round(om, 3) AS outcome_mean, round(fs, 3) AS factor_std, round(os, 3) AS outcome_std, (row_number() OVER (PARTITION BY outcome ORDER BY abs(r) DESC, factor))::INTEGER AS rank FROM ({pairs}) WHERE n >= 10"
    return shown.format(p=_p_of_r("r"), q=_p_of_r("rho"), pairs=pairs)


def _facts(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS metric, {value} AS value" for name, value in rows)


_OVER = "(PARTITION BY fips, state ORDER BY date"
_BODIES = {
    "map_slice": "SELECT * FROM map",
    "map_slice_state": "SELECT * FROM map WHERE state = 'NATION_7'",
    "map_slice_type": "SELECT * FROM map WHERE county_type = 'Urban'",
    "daily_changes": "SELECT fips, date, cases_daily, deaths_daily FROM daily",
    "moving_averages": "SELECT fips, date, " + ", ".join(f"round(avg(cases_daily) OVER {_OVER} ROWS {n - 1} PRECEDING), 6) AS ma{n}" for n in (3, 5, 7)) + " FROM daily",
    "centered_average": f"SELECT fips, date, round(sum(cases_daily) OVER {_OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7, 6) AS ca7 FROM daily",
    "per_capita": "SELECT fips, date, " + ", ".join(f"CASE WHEN population > 0 THEN round({c} / population * 100000, 6) END AS {c}_pc" for c in ("cases", "deaths")) + " FROM panel",
    "data_corrections": f"SELECT * FROM (SELECT fips, state, date, cases - lag(cases) OVER {_OVER}) AS change FROM panel) WHERE change < 0",
    "available_dates": "SELECT DISTINCT date FROM panel",
    "normalize_metadata": "SELECT s_suppkey, lpad(s_suppkey::VARCHAR, 5, '0') AS fips, lpad(s_nationkey::VARCHAR, 2, '0') AS state_fips, trim(s_name) || ', ' || s_nationkey AS location FROM supplier",
    "split_location": "SELECT fips, county_name AS name, state AS st FROM population",
    "county_type_threshold": "SELECT fips, CASE WHEN population >= 5000 THEN 'Urban' ELSE 'Rural' END AS county_type FROM population WHERE fips <> '00000'",
    "county_type_rucc": "SELECT fips, CASE WHEN rucc_code <= 3 THEN 'Metro' ELSE 'Nonmetro' END AS county_type FROM master WHERE rucc_code BETWEEN 1 AND 9",
    "national_series": "SELECT date, sum(cases) AS cases_total, sum(deaths) AS deaths_total, sum(cases_daily) AS cases_daily_total, sum(deaths_daily) AS deaths_daily_total, round(sum(cases) / sum(CASE WHEN population > 0 THEN population END) * 100000, 6) AS cases_per_100k FROM daily WHERE fips <> '00000' GROUP BY date",
    "kpi_totals": "SELECT sum(cases) AS cases, sum(deaths) AS deaths, count(DISTINCT fips) AS units, CASE WHEN sum(cases) > 0 THEN round(sum(deaths) / sum(cases) * 100, 2) END AS cfr FROM panel WHERE fips <> '00000' AND date = (SELECT max(date) FROM panel)",
    "monthly_snapshot": "SELECT fips, state, strftime(date, '%Y-%m') AS month, cases AS value FROM panel WHERE fips <> '00000' AND date IN (SELECT min(date) FROM panel GROUP BY date_trunc('month', date))",
    "window_outcomes": "SELECT fips, state, cases, deaths, CASE WHEN population > 0 THEN round(cases / population * 100000, 6) END AS cases_per_100k, CASE WHEN population > 0 THEN round(deaths / population * 100000, 6) END AS deaths_per_100k, CASE WHEN cases > 0 THEN round(deaths / cases * 100, 6) END AS case_fatality_rate FROM (SELECT fips, state, population, greatest(max(cases) FILTER (date = DATE '2024-01-30') - max(cases) FILTER (date = DATE '2024-01-05'), 0)::DOUBLE AS cases, greatest(max(deaths) FILTER (date = DATE '2024-01-30') - max(deaths) FILTER (date = DATE '2024-01-05'), 0)::DOUBLE AS deaths FROM panel WHERE fips <> '00000' GROUP BY ALL)",
    "map_slice_sparse": "SELECT fips, state, county_name, round(population, 6) AS population, round(cases, 6) AS cases, round(deaths, 6) AS deaths, round(ma / population * 100000, 6) AS value, round(cases / population * 100000, 6) AS cases_pc, round(deaths / population * 100000, 6) AS deaths_pc, CASE WHEN population >= 5000 THEN 'Urban' ELSE 'Rural' END AS county_type FROM thinmap WHERE date = DATE '2024-01-30' AND population > 0",
    "map_metric_sparse": "SELECT fips, round(da, 6) AS value, round(cases, 6) AS cases, CASE WHEN population > 0 THEN round(deaths / population * 100000, 6) END AS deaths_pc, CASE WHEN population > 0 AND population >= 5000 THEN 'Urban' ELSE 'Rural' END AS county_type FROM thinmap WHERE date = DATE '2024-01-30'",
    "rolling_cfr_sparse": f"SELECT fips, state, date, CASE WHEN b >= 2 THEN round(d / b * 100, 6) END AS cfr FROM (SELECT *, lag(c, 3) OVER {_OVER}) AS b FROM (SELECT *, CASE WHEN count(*) OVER w = 7 THEN sum(cases_daily) OVER w END AS c, CASE WHEN count(*) OVER w = 7 THEN sum(deaths_daily) OVER w END AS d FROM thindaily WINDOW w AS {_OVER} ROWS 6 PRECEDING)))",
    "rolling_cfr": f"SELECT fips, state, date, CASE WHEN b >= 2 THEN round(d / b * 100, 6) END AS cfr FROM (SELECT *, lag(c, 3) OVER {_OVER}) AS b FROM (SELECT *, CASE WHEN count(*) OVER w = 7 THEN sum(cases_daily) OVER w END AS c, CASE WHEN count(*) OVER w = 7 THEN sum(deaths_daily) OVER w END AS d FROM daily WINDOW w AS {_OVER} ROWS 6 PRECEDING)))",
    "index100": "SELECT fips, state, date, round(cases / f * 100, 6) + 0.0 AS index100 FROM panel LEFT JOIN (SELECT fips AS k, arg_min(cases, date) AS f FROM panel WHERE cases <> 0 GROUP BY 1) ON k = fips",
    "first_latest_change": "SELECT fips, state, a AS first, b AS latest, CASE WHEN a <> 0 THEN round((b - a) / abs(a) * 100, 6) END AS change_pct FROM (SELECT fips, state, arg_min(cases, date) AS a, arg_max(cases, date) AS b FROM panel GROUP BY ALL)",
    "vax_latest": "SELECT fips, round(arg_max(vax, date) FILTER (vax IS NOT NULL), 6) AS vax, max(date) AS last_date FROM vax GROUP BY fips",
    "forward_fill": "SELECT fips, date, round(coalesce(last_value(vax IGNORE NULLS) OVER (PARTITION BY fips ORDER BY date ROWS UNBOUNDED PRECEDING), 0), 6) AS vax FROM vax",
    "as_of_filled": "SELECT q.fips, q.date, round(v.vax, 6) AS vax FROM (SELECT fips, date FROM panel ) q ASOF LEFT JOIN (SELECT * FROM vax WHERE vax IS NOT NULL) v ON q.fips = v.fips AND q.date >= v.date",
    "as_of_last_row": "SELECT q.fips, q.date, round(v.vax, 6) AS vax FROM (SELECT fips, date FROM panel ) q ASOF LEFT JOIN vax v ON q.fips = v.fips AND q.date >= v.date",
    "unmatched_keys": "SELECT fips FROM population EXCEPT SELECT fips FROM panel",
    "key_intersection": "SELECT fips FROM population INTERSECT SELECT fips FROM panel",
    "peer_median_series": "SELECT date, round(median(cases / population * 100000), 6) AS median FROM panel WHERE fips <> '00000' AND population > 0 AND fips IN (SELECT fips FROM master WHERE rucc_code = 3) GROUP BY date HAVING count(DISTINCT fips) >= 3",
    "correlations": "SELECT outcome, factor, n, round(r, 6) AS r, round(r * r, 6) AS r2, round(tanh(atanh(r) - 1.96 / sqrt(n - 3)), 6) AS ci_low, round(tanh(atanh(r) + 1.96 / sqrt(n - 3)), 6) AS ci_high FROM (" + " UNION ALL ".join(f"SELECT 'total_price' AS outcome, '{f}' AS factor, count(*) AS n, covar_pop(total_price, {f}) / (stddev_pop(total_price) * stddev_pop({f})) AS r FROM master WHERE total_price IS NOT NULL AND {f} IS NOT NULL" for f in ("population", "n_orders", "avg_price")) + ") WHERE n >= 10",
    "spearman": "SELECT count(*) AS n, round(covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)), 6) AS rho FROM (SELECT rank() OVER (ORDER BY population) + (count(*) OVER (PARTITION BY population) - 1) / 2.0 AS a, rank() OVER (ORDER BY total_price) + (count(*) OVER (PARTITION BY total_price) - 1) / 2.0 AS b FROM master WHERE population IS NOT NULL AND total_price IS NOT NULL)",
    "ols_trend": "SELECT round(regr_slope(total_price, n_orders), 6) AS slope, round(regr_intercept(total_price, n_orders), 6) AS intercept, round(regr_r2(total_price, n_orders), 6) AS r2, count(*) AS n, min(n_orders) AS x_min, max(n_orders) AS x_max FROM master WHERE n_orders IS NOT NULL AND total_price IS NOT NULL",
    "residual_topk": "(SELECT fips, round(residual, 3) AS residual, 'resilient' AS side FROM resid ORDER BY resid.residual, fips LIMIT 20) UNION ALL (SELECT fips, round(residual, 3), 'fragile' FROM resid ORDER BY resid.residual DESC, fips LIMIT 20)",
    "scaled_features": "SELECT fips, " + ", ".join(f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 6) AS {c}_norm, round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}_z" for c in ("population", "n_orders")) + " FROM master",
    "similar_units": "SELECT z.fips, round(sqrt(pow(z.a - o.a, 2) + pow(z.b - o.b, 2) + pow(z.c - o.c, 2)), 6) AS distance FROM zscores z, zscores o WHERE o.fips = '00005' AND z.fips <> '00005' ORDER BY 2, 1 LIMIT 10",
    "wave_regions": "SELECT unit, min(start_date) AS start_date, max(end_date) AS end_date, max(b) - min(a) + 1 AS days FROM merged GROUP BY unit, m HAVING max(b) - min(a) + 1 >= 14",
    "adjacency": "SELECT src, dst FROM edges",
    "morans_i": "SELECT n, s0 // 2 AS n_edges, round(n / s0 * num / den, 6) AS i, round(-1.0 / (n - 1), 6) AS expected FROM (SELECT count(*)::DOUBLE AS n, sum(z * z) AS den FROM centred), (SELECT count(*) AS s0, sum(a.z * b.z) AS num FROM edges JOIN centred a ON src = a.fips JOIN centred b ON dst = b.fips)",
    "getis_ord": "SELECT fips, round(z, 6) AS z, w - 1 AS neighbours, CASE WHEN z >= 1.96 THEN 'Hotspot' WHEN z <= -1.96 THEN 'Coldspot' ELSE 'Not significant' END AS category FROM gi JOIN local USING (fips)",
    "hotspot_counts": "SELECT CASE WHEN z >= 1.96 THEN 'Hotspot' WHEN z <= -1.96 THEN 'Coldspot' ELSE 'Not significant' END AS category, count(*) AS n FROM gi GROUP BY 1",
    "national_medians": "SELECT " + ", ".join(f"round(median({c}), 6) AS {c}" for c in ("population", "n_orders", "avg_price", "total_price")) + " FROM master",
    "national_percentile": "SELECT count(*) AS n, round((count(*) FILTER (total_price < v) + count(*) FILTER (total_price <= v) + CASE WHEN count(*) FILTER (total_price <= v) > count(*) FILTER (total_price < v) THEN 1 ELSE 0 END) * 50 / count(*), 6) AS percentile FROM master, (SELECT total_price AS v FROM master WHERE fips = '00005') WHERE total_price IS NOT NULL",
    "poisson_ci": "SELECT fips, CASE WHEN population > 0 THEN round(CASE WHEN deaths = 0 THEN 0 ELSE deaths * pow(1 - 1 / (9 * deaths) - 1.959964 / (3 * sqrt(deaths)), 3) END / population * 100000, 6) END AS low, CASE WHEN population > 0 THEN round((deaths + 1) * pow(1 - 1 / (9 * (deaths + 1)) + 1.959964 / (3 * sqrt(deaths + 1)), 3) / population * 100000, 6) END AS high FROM panel WHERE date = DATE '2024-01-30'",
    "stream_daily_totals": "SELECT ts::DATE AS date, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2",
    "imputed": "SELECT fips, round(coalesce(n_orders, mn), 6) AS n_orders, round(coalesce(avg_price, ma), 6) AS avg_price FROM master, (SELECT median(n_orders) AS mn, median(avg_price) AS ma FROM master)",
    "low_percentile": "SELECT unit, date, round(quantile_cont(value, 0.1) OVER (PARTITION BY unit ORDER BY date ROWS BETWEEN 21 PRECEDING AND 21 FOLLOWING), 6) AS low FROM series",
    "join_diagnostics": "SELECT count(*) AS units, count(n_orders) AS matched, count(*) - count(n_orders) AS unmatched, round(count(n_orders) / count(*), 6) AS match_rate FROM (SELECT DISTINCT fips FROM panel WHERE fips <> '00000') LEFT JOIN master USING (fips)",
    "map_all_metrics": " UNION ALL ".join(
        f"SELECT fips, round({v}, 6) AS value, '{m}' AS metric FROM maall WHERE ({v}) IS NOT NULL"
        for c in ("cases", "deaths")
        for m, v in ((f"cumulative_{c}", c), (f"daily_{c}", f"{c}_daily"), *((f"daily_{c}_ma{k}", f"{c}_ma{k}") for k in (3, 5, 7)), (f"{c}_per_100k", f"CASE WHEN population > 0 THEN {c} / population * 100000 END"))
    ),
    "map_metric": "SELECT fips, state, county_name, round(CASE WHEN population > 0 THEN population END, 6) AS population, round(deaths_ma5, 6) AS value, cases, deaths, CASE WHEN population > 0 THEN round(cases / population * 100000, 6) END AS cases_pc, CASE WHEN population > 0 THEN round(deaths / population * 100000, 6) END AS deaths_pc, CASE WHEN population > 0 AND population >= 5000 THEN 'Urban' ELSE 'Rural' END AS county_type FROM maall",
    "map_filtered": "SELECT fips, state, county_name, round(population, 6) AS population, cases AS value, cases, deaths, round(cases / population * 100000, 6) AS cases_pc, round(deaths / population * 100000, 6) AS deaths_pc, 'Urban' AS county_type FROM maall WHERE state IN ('NATION_7', 'NATION_3', 'NATION_12') AND population >= 5000 AND cases > 0",
    "vaccination_map": "SELECT l.fips, l.state, round(coalesce(population, 0), 6) AS population, coalesce(cases, 0) AS cases, coalesce(deaths, 0) AS deaths, round(vax, 6) AS value FROM lastday l LEFT JOIN vaxlast USING (fips)",
    "comparison_daily": "SELECT date, round(max(v) FILTER (fips = '00005'), 6) AS \"00005\", round(max(v) FILTER (fips = '00010'), 6) AS \"00010\", round(max(v) FILTER (fips = 'national'), 6) AS national FROM (SELECT fips, date, avg(x) OVER (PARTITION BY fips ORDER BY date ROWS 2 PRECEDING) AS v FROM (SELECT fips, date, CASE WHEN population > 0 THEN cases_daily / population * 100000 END AS x FROM daily WHERE fips IN ('00005', '00010') UNION ALL SELECT 'national', date, cd / (SELECT sum(population) FROM lastday WHERE population > 0) * 100000 FROM national)) GROUP BY date",
    "comparison_indexed": "SELECT date, round(max(v) FILTER (fips = '00005'), 6) AS \"00005\", round(max(v) FILTER (fips = '00010'), 6) AS \"00010\" FROM (SELECT fips, date, deaths / b * 100 AS v FROM panel LEFT JOIN (SELECT fips AS k, arg_min(deaths, date) AS b FROM panel WHERE deaths <> 0 GROUP BY 1) ON k = fips WHERE fips IN ('00005', '00010')) GROUP BY date",
    "outer_on_date": "SELECT date, cases, round(m, 6) AS vax FROM national FULL JOIN (SELECT date, median(vax) AS m FROM vax GROUP BY date) USING (date)",
    "latest_ratio": "SELECT max(cases) FILTER (fips = '00005') AS latest_a, max(cases) FILTER (fips = '00010') AS latest_b, round(max(cases) FILTER (fips = '00005') / nullif(max(cases) FILTER (fips = '00010'), 0), 6) AS ratio FROM lastday",
    "kpi_by_type": "SELECT CASE WHEN population >= 5000 THEN 'Urban' ELSE 'Rural' END AS county_type, sum(cases) AS cases, sum(deaths) AS deaths, count(DISTINCT fips) AS units, CASE WHEN sum(cases) > 0 THEN round(sum(deaths) / sum(cases) * 100, 2) END AS cfr FROM lastday GROUP BY 1",
    "smoothed_edges": f"SELECT fips, date, CASE WHEN k > 3 AND k <= n - 3 THEN round(s / 7, 6) ELSE 0.0 END AS s7 FROM (SELECT fips, date, row_number() OVER {_OVER}) AS k, count(*) OVER (PARTITION BY fips, state) AS n, sum(cases_daily) OVER {_OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS s FROM daily)",
    "unit_series": "SELECT date, cases AS value FROM panel WHERE county_name = 'Customer#000000005' AND state = 'NATION_21'",
    "unit_rows": "SELECT fips, date, round(vax, 6) AS vax FROM vax WHERE fips = '00005'",
    "unit_population": "SELECT min(population) AS population FROM population WHERE county_name = 'Customer#000000005' AND state = 'NATION_21'",
    "overridden": "SELECT fips, n_orders, round(p.population * 2, 6) AS population FROM master LEFT JOIN population p USING (fips)",
    "external_dataset": "SELECT fips, state, p.population, m.population AS population_external, n_orders FROM population p LEFT JOIN master m USING (fips)",
    "neighbours": "SELECT fips, population FROM master WHERE fips IN (SELECT dst FROM edges WHERE src = '00155')",
    "neighbour_medians": "SELECT round(CASE WHEN count(population) >= 3 THEN median(population) END, 6) AS population, round(CASE WHEN count(n_orders) >= 3 THEN median(n_orders) END, 6) AS n_orders FROM master WHERE fips IN (SELECT dst FROM edges WHERE src = '00155')",
    "vax_median_by_date": "SELECT date, round(median(vax), 6) AS median FROM vax GROUP BY date",
    "colour_scale": "SELECT round(max(population), 4) AS max, round(quantile_cont(population, 0.99), 4) AS p99, round(ln(1 + greatest(max(population), 0)), 4) AS log_max, round(quantile_cont(abs(population), 0.98), 4) AS p98_abs, round(quantile_cont(population, 0.99) - quantile_cont(population, 0.01), 4) AS span FROM master",
    "unit_against_rest": " UNION ALL ".join(f"SELECT '{f}' AS metric, round(u, 4) AS unit_value, round(m, 4) AS median, round((u - m) / abs(m) * 100, 4) AS diff_pct, CASE WHEN u > m THEN 'above' WHEN u < m THEN 'below' ELSE 'equal' END AS status FROM (SELECT max({f}) FILTER (fips = '00005') AS u, median({f}) AS m FROM master)" for f in ("population", "n_orders", "avg_price")),
    "strict_percentile": "SELECT round(avg(CASE WHEN total_price < v THEN 1 ELSE 0 END) * 100, 6) AS percentile FROM master, (SELECT total_price AS v FROM master WHERE fips = '00005') WHERE total_price IS NOT NULL",
    "ranked": "SELECT fips, rank::INTEGER AS rank FROM (SELECT fips, row_number() OVER (ORDER BY total_price DESC, fips) AS rank FROM master WHERE total_price IS NOT NULL) WHERE rank <= 25",
    "union_of_dates": "SELECT date FROM panel UNION SELECT date FROM vax",
    "first_rows": "SELECT state, fips, county_name, population FROM population WHERE (state, fips) IN (SELECT state, min(fips) FROM population GROUP BY state)",
    "derived_features": "SELECT fips, round(population_2020, 6) AS population_2020, round(hospital_beds, 6) AS hospital_beds, round(pop_65plus, 6) AS pop_65plus, rucc_code, CASE WHEN population_2020 > 0 THEN round(hospital_beds / population_2020 * 100000, 6) END AS hospital_beds_per_100k, CASE WHEN population_2020 > 0 THEN round(pop_65plus / population_2020 * 100, 6) END AS pct_pop_65plus, coalesce(rucc_code BETWEEN 1 AND 3, false) AS is_metro, CASE WHEN rucc_code BETWEEN 1 AND 3 THEN 'Metro' WHEN rucc_code IS NOT NULL THEN 'Nonmetro' END AS rucc_group FROM feat",
    "rucc_groups": "SELECT fips, rucc_code, CASE WHEN rucc_code BETWEEN 1 AND 3 THEN 'Metro' WHEN rucc_code BETWEEN 4 AND 9 THEN 'Nonmetro' END AS rucc_group FROM feat",
    "load_diagnostics": "SELECT (SELECT count(*) FROM master) AS rows, (SELECT round(avg(CASE WHEN n_orders IS NULL THEN 1 ELSE 0 END) * 100, 1) FROM master) AS missing_n_orders, (SELECT round(avg(CASE WHEN population IS NULL THEN 1 ELSE 0 END) * 100, 1) FROM master) AS missing_population, count(*) AS keys, count(m.fips) AS matched, round(count(m.fips) / count(*) * 100, 1) AS match_rate_pct, (SELECT coalesce(string_agg(fips, ',' ORDER BY fips), '') FROM (SELECT fips FROM (SELECT fips FROM panel UNION SELECT '99999') WHERE fips NOT IN (SELECT fips FROM master) ORDER BY fips LIMIT 10)) AS unmatched, (SELECT coalesce(string_agg(fips, ',' ORDER BY fips), '') FROM (SELECT fips FROM master GROUP BY fips HAVING count(*) > 1 ORDER BY fips LIMIT 10)) AS repeated FROM (SELECT DISTINCT fips FROM panel UNION SELECT '99999') k LEFT JOIN master m USING (fips)",
    "repeated_keys": "SELECT state, count(*) AS n, count(DISTINCT county_name) AS n_names FROM population GROUP BY state HAVING count(*) > 1",
    "fact_sheet": "SELECT section, metric, round(value, 4) AS value FROM (SELECT 'latest' AS section, x.* FROM lastday l, LATERAL (" + _facts([("cases", "l.cases"), ("deaths", "l.deaths"), ("population", "l.population"), ("cases_per_100k", "l.cases / l.population * 100000"), ("deaths_per_100k", "l.deaths / l.population * 100000"), ("cfr", "l.deaths / l.cases * 100")]) + ") x WHERE fips = '00005'" + "".join(f" UNION ALL SELECT '{sec}', '{f}', {v} FROM (SELECT max({f}) FILTER (fips = '00005') AS u, median({f}) AS m FROM master)" for f in ("population", "n_orders", "avg_price") for sec, v in (("value", "u"), ("difference", "(u - m) / abs(m) * 100"))) + ")",
    "associations": _associations(("total_price", "n_orders"), "master"),
    "factor_explorer": _associations(("cases_per_100k", "deaths_per_100k"), "explored"),
    "lag_pipeline": "SELECT u.unit, u.error, CASE WHEN u.error IS NULL THEN coalesce(c.n, 0) END AS case_peaks, CASE WHEN u.error IS NULL THEN coalesce(d.n, 0) END AS death_peaks, CASE WHEN u.error IS NULL THEN coalesce(m.n, 0) END AS matches, round(m.lag, 6) AS mean_lag FROM (SELECT DISTINCT fips AS unit, CASE WHEN NOT coalesce(population > 0, false) THEN 'no valid population' END AS error FROM panel WHERE fips <> '00000') u LEFT JOIN (SELECT unit, count(*) AS n FROM pc_peak GROUP BY unit) c USING (unit) LEFT JOIN (SELECT unit, count(*) AS n FROM pd_peak GROUP BY unit) d USING (unit) LEFT JOIN (SELECT unit, count(*) AS n, avg(lag_days) AS lag FROM pm_pair GROUP BY unit) m USING (unit)",
    "morans_i_test": "SELECT n, n_edges, round(i, 6) AS i, round(e, 6) AS expected, round(z, 6) AS z, round(greatest(1 - 2 * " + _area("exp(-u * u / 2)", "least(abs(z), 40)") + " / sqrt(2 * pi()), 0), 6) AS p, CASE WHEN i >= 0.4 THEN 'strong' WHEN i >= 0.15 THEN 'moderate' ELSE 'weak' END AS strength FROM (SELECT *, (i - e) / sqrt((n * n * 2 * s0 - n * 4 * dd + 3 * s0 * s0) / ((n * n - 1) * s0 * s0) - e * e) AS z FROM (SELECT n, s0 // 2 AS n_edges, s0::DOUBLE AS s0, n / s0 * num / den AS i, -1.0 / (n - 1) AS e, dd FROM (SELECT count(*)::DOUBLE AS n, sum(z * z) AS den FROM centred), (SELECT count(*) AS s0, sum(a.z * b.z) AS num FROM edges JOIN centred a ON src = a.fips JOIN centred b ON dst = b.fips), (SELECT sum(d * d)::DOUBLE AS dd FROM (SELECT count(*) AS d FROM edges GROUP BY src))))",
    "factor_ranking": "SELECT factor, n, CASE WHEN abs(r) >= 0.6 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' ELSE 'weak' END AS strength, (row_number() OVER (ORDER BY abs(r) DESC, factor))::INTEGER AS rank FROM (" + " UNION ALL ".join(_pair("total_price", f) for f in ("population", "n_orders", "avg_price")) + ")",
    "correlation_matrix": "SELECT factor, round(max(r) FILTER (outcome = 'total_price'), 6) AS total_price, round(max(r) FILTER (outcome = 'n_orders'), 6) AS n_orders FROM (" + " UNION ALL ".join(_pair(o, f) for o in ("total_price", "n_orders") for f in ("population", "n_orders", "avg_price")) + ") GROUP BY factor",
    "residual_explorer": " UNION ALL ".join(f"(SELECT fips, round(total_price - residual, 3) AS predicted, round(total_price, 3) AS actual, round(residual, 3) AS residual, '{side}' AS side FROM resid JOIN master USING (fips) ORDER BY resid.residual {how}, fips LIMIT 20)" for side, how in (("resilient", "ASC"), ("fragile", "DESC"))),
    "regression_ready": "SELECT fips, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 6) AS {c}" for c in ("total_price", "n_orders", "avg_price")) + " FROM master WHERE total_price IS NOT NULL AND n_orders IS NOT NULL AND avg_price IS NOT NULL",
    "clustering_ready": "SELECT fips, round((n_orders - avg(n_orders) OVER ()) / stddev_samp(n_orders) OVER (), 6) AS order_rate, round((avg_price - avg(avg_price) OVER ()) / stddev_samp(avg_price) OVER (), 6) AS pct_price FROM master WHERE n_orders IS NOT NULL AND avg_price IS NOT NULL",
    "insights": "SELECT side, label, round(value, 3) AS value, round(peer_median, 3) AS peer_median, round(z, 3) AS z, round(r, 3) AS r, place FROM (SELECT 'outcome' AS side, 'total_price' AS label, v AS value, median(total_price) AS peer_median, avg(CASE WHEN total_price < v THEN 1 ELSE 0 END) * 100 AS z, NULL::DOUBLE AS r, 0 AS place FROM master, (SELECT total_price AS v FROM master WHERE fips = '00005') WHERE rucc_code = 3 AND total_price IS NOT NULL GROUP BY v UNION ALL SELECT side, label, value, peer_median, z, r, (row_number() OVER (PARTITION BY side ORDER BY abs(z) DESC, label))::INTEGER FROM (SELECT *, CASE WHEN z * r > 0 THEN 'risk' ELSE 'protective' END AS side FROM (SELECT label, value, mid AS peer_median, (value - mid) / sd AS z, r FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS label, max({f}) FILTER (fips = '00005') AS value, median({f}) FILTER (rucc_code = 3) AS mid, stddev_samp({f}) AS sd, corr({f}, total_price) AS r FROM master" for f in ("population", "n_orders", "avg_price")) + ")) WHERE abs(z) >= 0.1 AND abs(r) >= 0.05))",
    "severity_correlation": "SELECT unit, n, round(r, 6) AS r, CASE WHEN r < -0.2 THEN 'lower' WHEN r > 0.2 THEN 'higher' WHEN r IS NOT NULL THEN 'none' END AS label FROM (SELECT p.unit, count(*) AS n, covar_pop(vax, p.v) / nullif(stddev_pop(vax) * stddev_pop(p.v), 0) AS r FROM ps_peak p JOIN plc c ON c.unit = p.unit AND c.k = p.k JOIN vax x ON x.fips = p.unit AND x.date = c.date WHERE vax > 0 GROUP BY p.unit HAVING count(*) >= 3)",
    "ols_simple": "WITH s AS (SELECT count(*) AS n, avg(n_orders) AS xm, regr_sxx(total_price, n_orders) AS sxx, regr_slope(total_price, n_orders) AS b, regr_intercept(total_price, n_orders) AS a, regr_r2(total_price, n_orders) AS r2 FROM master WHERE total_price IS NOT NULL AND n_orders IS NOT NULL), e AS (SELECT s.*, n_orders - xm AS d, total_price - a - b * n_orders AS e, 1.0 / n + (n_orders - xm) * (n_orders - xm) / sxx AS h FROM master, s WHERE total_price IS NOT NULL AND n_orders IS NOT NULL), v AS (SELECT n, xm, sxx, a, b, r2, sum(e * e) / (n - 2) AS s2, sqrt(sum(pow(1.0 / n - xm * d / sxx, 2) * pow(e / (1 - h), 2))) AS h0, sqrt(sum(pow(d / sxx, 2) * pow(e / (1 - h), 2))) AS h1 FROM e GROUP BY n, xm, sxx, a, b, r2), t AS (SELECT 'intercept' AS term, a AS beta, sqrt(s2 * (1.0 / n + xm * xm / sxx)) AS se, h0 AS hc3, r2, n FROM v UNION ALL SELECT 'n_orders', b, sqrt(s2 / sxx), h1, r2, n FROM v) SELECT term, round(beta, 3) AS beta, round(se, 3) AS se, round(hc3, 3) AS se_hc3, round(beta / se, 3) AS t, round(" + _p_of_t("(beta / se)", "(n - 2)") + ", 3) AS p, round(r2 / (1 - r2) * (n - 2), 3) AS f, round(" + _p_of_t("sqrt(r2 / (1 - r2) * (n - 2))", "(n - 2)") + ", 3) AS p_f, round(beta - 1.96 * se, 3) AS ci_low, round(beta + 1.96 * se, 3) AS ci_high, round(r2, 3) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 3) AS adj_r2, n FROM t",
    "greedy_matches": "SELECT unit, case_peak_date, death_peak_date, lag_days, round(case_peak_value, 6) AS case_peak_value, round(death_peak_value, 6) AS death_peak_value, round(death_peak_value / nullif(case_peak_value, 0), 6) AS severity_ratio FROM paired",
    "greedy_summary": "SELECT count(*) AS n, round(avg(lag_days), 6) AS mean_lag, median(lag_days) AS median_lag, min(lag_days) AS min_lag, max(lag_days) AS max_lag, round(avg(death_peak_value / nullif(case_peak_value, 0)), 6) AS mean_severity, round(max(case_peak_value), 6) AS largest_case_peak, round(max(death_peak_value), 6) AS largest_death_peak FROM paired",
    "greedy_compared": " UNION ALL ".join(f"SELECT '{m}' AS metric, round(({x} FILTER (unit = '3'))::DOUBLE, 6) AS a, round(({x} FILTER (unit = '7'))::DOUBLE, 6) AS b FROM paired" for m, x in (("n", "count(*)"), ("mean_lag", "avg(lag_days)"), ("median_lag", "median(lag_days)"), ("min_lag", "min(lag_days)"), ("max_lag", "max(lag_days)"), ("mean_severity", "avg(death_peak_value / nullif(case_peak_value, 0))"), ("largest_case_peak", "max(case_peak_value)"), ("largest_death_peak", "max(death_peak_value)"))),
    "vif": "WITH r AS (SELECT corr(population, n_orders) AS ab, corr(population, avg_price) AS ac, corr(n_orders, avg_price) AS bc FROM master WHERE population IS NOT NULL AND n_orders IS NOT NULL AND avg_price IS NOT NULL), d AS (SELECT *, 1 + 2 * ab * ac * bc - ab * ab - ac * ac - bc * bc AS d FROM r) SELECT 'population' AS predictor, round((1 - bc * bc) / d, 6) AS vif FROM d UNION ALL SELECT 'n_orders', round((1 - ac * ac) / d, 6) FROM d UNION ALL SELECT 'avg_price', round((1 - ab * ab) / d, 6) FROM d",
    "greedy_views": "SELECT unit, count(*) AS n, min(case_peak_date) - 45 AS view_start, max(death_peak_date) + 45 AS view_end, count(*) <= 8 AS draw FROM paired GROUP BY unit",
    "region_waves": "SELECT unit, wave_number, start_date, peak_date, end_date, round(peak_value, 6) AS peak_value, duration_days, round(wave_burden, 6) AS wave_burden, days FROM waves",
    "region_scores": "SELECT unit, wave_number, wave_significance FROM scored",
    "region_windows": "SELECT unit, wave_number, peak_date, CASE WHEN peak_date BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' THEN 'Early' WHEN peak_date BETWEEN DATE '1996-06-30' AND DATE '1999-01-01' THEN 'Middle' WHEN peak_date BETWEEN DATE '1999-01-02' AND DATE '2001-12-31' THEN 'Late' ELSE 'Outside national windows' END AS \"window\" FROM waves",
    "region_metrics": "SELECT t.unit, coalesce(n, 0) AS waves, round(coalesce(top, 0), 6) AS largest_wave, round(h, 6) AS avg_wave_height, round(d, 6) AS avg_wave_duration, round(g, 6) AS avg_interwave_days, k AS peak_wave_date, round(total, 6) AS total_burden FROM totals t LEFT JOIN (SELECT unit, count(*) AS n, arg_max(peak_value, (wave_significance, -wave_number)) AS top, avg(peak_value) AS h, avg(duration_days) AS d, (max(peak_date) - min(peak_date)) / nullif(count(*) - 1, 0) AS g, arg_max(peak_date, (wave_significance, -wave_number)) AS k FROM scored GROUP BY unit) USING (unit)",
    "region_zip": "SELECT coalesce(a.unit, b.unit) AS unit, coalesce(a.wave_number, b.wave_number) AS wave_number, a.peak_date::VARCHAR AS case_peak_date, round(a.peak_value, 6) AS case_peak_value, a.duration_days::DOUBLE AS case_duration_days, b.peak_date::VARCHAR AS death_peak_date, round(b.peak_value, 6) AS death_peak_value, b.duration_days::DOUBLE AS death_duration_days FROM waves a FULL JOIN waves2 b ON a.unit = b.unit AND a.wave_number = b.wave_number",
    "region_first_within": "SELECT a.unit, a.wave_number, a.peak_date::VARCHAR AS peak_date, min(b.wave_number)::DOUBLE AS death_wave, arg_min(b.peak_date, b.wave_number)::VARCHAR AS death_peak_date FROM waves a LEFT JOIN waves2 b ON a.unit = b.unit AND abs(b.peak_date - a.peak_date) < 90 GROUP BY ALL",
    "region_by_significance": "SELECT unit, wave_number, wave_significance FROM scored ORDER BY wave_significance DESC, unit, wave_number LIMIT 20",
    "master_table": "SELECT l.fips, l.state, l.cases, l.deaths, round(l.population, 6) AS population, CASE WHEN l.population > 0 THEN round(l.cases / l.population * 100000, 6) END AS cases_per_100k, CASE WHEN l.population > 0 THEN round(l.deaths / l.population * 100000, 6) END AS deaths_per_100k, CASE WHEN l.cases > 0 THEN round(l.deaths / l.cases * 100, 6) END AS cfr, round(n_orders, 6) AS n_orders, round(avg_price, 6) AS avg_price, round(total_price, 6) AS total_price, rucc_code, segment FROM lastday l LEFT JOIN (SELECT m.*, c_mktsegment AS segment FROM master m JOIN customer ON lpad(c_custkey::VARCHAR, 5, '0') = m.fips) USING (fips)",
    "full_audit": "WITH one AS (SELECT count(*) AS n, count(*) FILTER (population > 0 AND cases / population * 100000 > 100000) AS hi, count(DISTINCT (fips, state, date)) AS keys, count(DISTINCT (fips, state, date)) FILTER (fips = '00000') AS statewide, count(*) FILTER (fips <> '00000' AND population > 0) AS usable, count(*) FILTER (fips <> '00000' AND NOT coalesce(population > 0, false)) AS nopeople FROM panel), cov AS (SELECT count(*) FILTER (a.fips IS NOT NULL AND b.fips IS NOT NULL) AS both_, count(*) FILTER (b.fips IS NULL) AS p_only, count(*) FILTER (a.fips IS NULL) AS o_only FROM (SELECT DISTINCT fips FROM panel) a FULL JOIN (SELECT DISTINCT fips FROM population) b ON a.fips = b.fips), tip AS (SELECT count(*) AS n, count(*) FILTER (NOT coalesce(population > 0, false)) AS lost FROM lastday) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{m}' AS metric, ({v})::BIGINT AS value, {ok} AS valid FROM {t}" for c, m, v, ok, t in (
        ("per_capita", "rows", "n", "true", "one"), ("per_capita", "above_limit", "hi", "true", "one"), ("per_capita", "rate_without_population", "0", "true", "one"), ("keys", "keys", "keys", "true", "one"), ("keys", "duplicate_keys", "0", "true", "one"), ("keys", "statewide", "statewide", "true", "one"),
        ("coverage", "both", "both_", "true", "cov"), ("coverage", "panel_only", "p_only", "true", "cov"), ("coverage", "population_only", "o_only", "true", "cov"), ("manual_rates", "rows", "usable", "true", "one"), ("manual_rates", "mismatches", "0", "true", "one"), ("manual_rates", "without_people", "nopeople", "true", "one"),
        ("tooltips", "rows", "n", "true", "tip"), ("tooltips", "without_source", "lost", "true", "tip"), *(("tooltips", f"{f}_mismatches", "0", "true", "tip") for f in ("cases", "deaths", "population", "cases_pc", "deaths_pc")))),
    "vaccination_effect": "SELECT n, round(r, 6) AS r, round(slope, 6) AS slope, round(intercept, 6) AS intercept, CASE WHEN slope < 0 THEN 'negative' ELSE 'positive' END AS direction, CASE WHEN abs(r) > 0.5 THEN 'strong' WHEN abs(r) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM "
    "(SELECT count(*) AS n, corr(y, vax) AS r, regr_slope(y, vax) AS slope, regr_intercept(y, vax) AS intercept FROM vaxlast JOIN (SELECT fips, cases / population * 100000 AS y FROM windowed WHERE population > 0) USING (fips) WHERE vax > 0)",
    "feature_build": "SELECT fips, round(population_2020, 6) AS population_2020, round(hospital_beds, 6) AS hospital_beds, round(pop_65plus, 6) AS pop_65plus, c AS rucc_code, CASE WHEN population_2020 > 0 THEN round(hospital_beds / population_2020 * 100000, 6) END AS hospital_beds_per_100k, CASE WHEN population_2020 > 0 THEN round(pop_65plus / population_2020 * 100, 6) END AS pct_pop_65plus, "
    "c BETWEEN 1 AND 3 AS is_metro, CASE WHEN c BETWEEN 1 AND 3 THEN 'Metro' ELSE 'Nonmetro' END AS rucc_group FROM (SELECT fips, population AS population_2020, n_orders AS hospital_beds, avg_price AS pop_65plus, rucc_code::DOUBLE AS c FROM master WHERE fips IN (SELECT fips FROM panel))",
    "source_health": "SELECT 'counts' AS source, true AS present, count(*) AS rows, count(cases) + count(deaths) > 0 AS usable FROM panel UNION ALL SELECT 'features', true, count(*), count(n_orders) + count(avg_price) > 0 FROM master UNION ALL SELECT 'vaccination', true, count(*), count(vax) > 0 FROM vaxlast "
    "UNION ALL SELECT 'codes only', true, count(*), false FROM master UNION ALL SELECT 'boundaries', false, 0, false",
    "master_waves": "SELECT lpad(t.unit, 5, '0') AS fips, t.unit AS state, round(t.total, 6) AS cases, round(d, 6) AS deaths, people AS population, round(t.total / people * 100000, 6) AS cases_per_100k, round(d / people * 100000, 6) AS deaths_per_100k, round(d / t.total * 100, 6) AS cfr, n_regionkey, m.* EXCLUDE (unit, case_peak_wave_date, death_peak_wave_date), case_peak_wave_date::VARCHAR AS case_peak_wave_date, death_peak_wave_date::VARCHAR AS death_peak_wave_date FROM totals t "
    "LEFT JOIN (SELECT unit, sum(value) AS d FROM second GROUP BY unit) USING (unit) JOIN (SELECT c_nationkey::VARCHAR AS unit, count(*) * 1000.0::DOUBLE AS people FROM customer GROUP BY 1) USING (unit) JOIN nation ON n_nationkey::VARCHAR = t.unit LEFT JOIN (" + wave_sql.BODIES["wave_metrics"] + ") m ON m.unit = t.unit WHERE t.unit <> '0'",
    "duplicate_keys": "SELECT lpad(o_custkey::VARCHAR, 5, '0') AS fips, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
    "population_validity": "SELECT count(*) AS total, count(*) FILTER (population = 0) AS zero, count(*) FILTER (population < 0) AS negative, count(*) FILTER (population IS NULL) AS missing, count(*) FILTER (fips = '00000') AS unallocated FROM population",
}

SQL = {name: _with(body) for name, body in (_BODIES | wave_sql.BODIES).items()}
