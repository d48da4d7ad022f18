"""SQL twins of decomposition, smoothing, several columns at once, penalised regression and screening.

Constants are written out here, not taken from the queries they check.
"""

from __future__ import annotations

FEATURES = ("x_qty", "x_price", "x_disc", "x_urgent")
TRAIN = """
train AS (
  SELECT * EXCLUDE (back) FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back FROM panel) WHERE back > 12),
test AS (
  SELECT * EXCLUDE (back), row_number() OVER (PARTITION BY series_id ORDER BY ds) AS h FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back FROM panel) WHERE back <= 12)"""


def decomposition(source: str, m: int, order: str, keep: str, times: bool, digits: int = 5) -> str:
    """CTEs and query: centred average over an even season, phase means, rest.

    A monthly trend is a whole number of 1/24 of the last digit, so ties occur; a nudge below that settles them.
    """
    nudge = "CAST(1e-7 AS DOUBLE)" if digits == 5 else "0"
    half = m // 2
    left, moved, rest = (
        ("y / trend", "mean / centre", "y / (trend * seasonal)") if times else ("y - trend", "mean - centre", "y - trend - seasonal")
    )
    return f"""
placed AS (
  SELECT *, row_number() OVER w AS pos,
         CASE WHEN count(y) OVER f = {m + 1} THEN (SUM(y) OVER f - (lag(y, {half}) OVER w + lead(y, {half}) OVER w) / 2) / {m} END AS trend
  FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY {order}),
       f AS (PARTITION BY series_id ORDER BY {order} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)),
phases AS (
  SELECT series_id, (pos - 1) % {m} AS phase, avg({left}) AS mean FROM placed GROUP BY 1, 2),
seasons AS (
  SELECT series_id, phase, {moved} AS seasonal
  FROM (SELECT *, avg(mean) OVER (PARTITION BY series_id) AS centre FROM phases))
SELECT {keep}, round(trend + {nudge}, {digits}) AS trend, round(seasonal, {digits}) AS seasonal, round({rest}, {digits}) AS resid
FROM placed p JOIN seasons s ON p.series_id = s.series_id AND (p.pos - 1) % {m} = s.phase"""


def smoothing(source: str) -> str:
    """CTEs ending in ``run``: every row of every trial, and ``best``: the last row of the best trial."""
    return f"""
weights AS (
  SELECT CAST((ia * 3 + ib) * 3 + ig + 1 AS INTEGER) AS trial_id, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b, CAST(g AS DOUBLE) AS g
  FROM (VALUES (0, 0.1), (1, 0.3), (2, 0.5), (3, 0.7), (4, 0.9)) x(ia, a),
       (VALUES (0, 0.05), (1, 0.2), (2, 0.5)) y(ib, b), (VALUES (0, 0.05), (1, 0.2), (2, 0.5)) z(ig, g)),
series AS (SELECT series_id, list(y ORDER BY ds) AS ys, list(ds ORDER BY ds) AS at FROM {source} GROUP BY series_id),
starts AS (
  SELECT *, (list_avg(ys[13:24]) - level) / 12 AS trend, list_transform(ys[1:12], lambda x: x - level) AS season
  FROM (SELECT *, list_avg(ys[1:12]) AS level FROM series)),
run AS (
  SELECT series_id, trial_id, a, b, g, 0 AS t, level, trend, season, CAST(0 AS DOUBLE) AS sse, CAST(NULL AS DOUBLE) AS fitted
  FROM starts, weights
  UNION ALL
  SELECT series_id, trial_id, a, b, g, t + 1, level + trend + a * e, trend + a * b * e,
         list_concat(season[2:12], [season[1] + g * e]), sse + e * e, f
  FROM (
    SELECT r.*, r.level + r.trend + r.season[1] AS f, s.ys[r.t + 1] - (r.level + r.trend + r.season[1]) AS e
    FROM run r JOIN series s ON r.series_id = s.series_id WHERE r.t < len(s.ys))),
ended AS (SELECT r.* FROM run r JOIN series s ON r.series_id = s.series_id WHERE r.t = len(s.ys)),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY sse, trial_id) AS place FROM ended) WHERE place = 1)"""


def two_column_var() -> str:
    """CTEs ending in ``solved``: per equation the normal equations of two lagged columns, by determinants."""
    long = " UNION ALL ".join(
        f"SELECT series_id, '{c}' AS equation, {c} AS t, a, b FROM lagged WHERE a IS NOT NULL" for c in ("y", "x_qty")
    )
    return f"""
lagged AS (
  SELECT series_id, ds, y, x_qty, lag(y) OVER w AS a, lag(x_qty) OVER w AS b
  FROM train WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
equations AS ({long}),
centred AS (
  SELECT *, avg(t) OVER s AS mt, avg(a) OVER s AS ma, avg(b) OVER s AS mb FROM equations
  WINDOW s AS (PARTITION BY series_id, equation)),
moments AS (
  SELECT series_id, equation, COUNT(*) AS n, max(mt) AS mt, max(ma) AS ma, max(mb) AS mb,
         SUM((a - ma) * (a - ma)) AS saa, SUM((b - mb) * (b - mb)) AS sbb, SUM((a - ma) * (b - mb)) AS sab,
         SUM((a - ma) * (t - mt)) AS sat, SUM((b - mb) * (t - mt)) AS sbt, SUM((t - mt) * (t - mt)) AS stt
  FROM centred GROUP BY 1, 2),
slopes AS (
  SELECT *, saa * sbb - sab * sab AS det, (sat * sbb - sbt * sab) / (saa * sbb - sab * sab) AS ba,
         (sbt * saa - sat * sab) / (saa * sbb - sab * sab) AS bb FROM moments),
solved AS (
  SELECT *, mt - ba * ma - bb * mb AS c, (stt - ba * sat - bb * sbt) / (n - 3) AS s2 FROM slopes)"""


def descent(rows: str) -> str:
    """CTEs ending in ``fits(series_id, grp, l1_ratio, penalty, trial_id, const, slopes)``.

    ``rows`` has series_id, grp, y and the features without missing values; every (series_id, grp) is a problem.
    Each step of the recursion is a sweep of coordinate descent over the four standardised columns.
    """
    names = ["y", *FEATURES]
    means = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in names)
    pairs = ", ".join(
        f"SUM((d.{a} - m_{a}) * (d.{b} - m_{b})) / (any_value(n) * any_value(s_{a}) * any_value(s_{b})) AS r_{i}{j}"
        for i, a in enumerate(names) for j, b in enumerate(names) if i <= j
    )
    inner, previous = "SELECT r.*, c.* EXCLUDE (series_id, grp) FROM run r JOIN corr c ON r.series_id = c.series_id AND r.grp = c.grp WHERE t < 400", None
    level = f"({inner})"
    for i in range(1, 5):
        pull = " - ".join([f"r_0{i}", *[f"r_{min(i, j)}{max(i, j)} * b{j}" for j in range(1, 5) if j != i]])
        level = f"""(SELECT * EXCLUDE (b{i}, pull), sign(pull) * greatest(abs(pull) - penalty * l1_ratio, 0) / (1 + penalty * (1 - l1_ratio)) AS b{i}
     FROM (SELECT *, {pull} AS pull FROM {level}))"""
        previous = level
    slopes = ", ".join(f"b{i} * s_y / s_{c}" for i, c in enumerate(FEATURES, 1))
    const = " - ".join(["m_y", *[f"b{i} * s_y / s_{c} * m_{c}" for i, c in enumerate(FEATURES, 1)]])
    return f"""
grid AS (
  SELECT CAST(ir * 4 + ip + 1 AS INTEGER) AS trial_id, CAST(l1_ratio AS DOUBLE) AS l1_ratio, CAST(penalty AS DOUBLE) AS penalty
  FROM (VALUES (0, 0.0), (1, 0.5), (2, 1.0)) x(ir, l1_ratio), (VALUES (0, 0.0), (1, 0.02), (2, 0.1), (3, 0.4)) y(ip, penalty)),
scales AS MATERIALIZED (SELECT series_id, grp, COUNT(*) AS n, {means} FROM {rows} GROUP BY 1, 2),
corr AS MATERIALIZED (
  SELECT d.series_id, d.grp, {pairs} FROM {rows} d JOIN scales s ON d.series_id = s.series_id AND d.grp = s.grp GROUP BY 1, 2),
run AS (
  SELECT series_id, grp, trial_id, l1_ratio, penalty, 0 AS t, CAST(0 AS DOUBLE) AS b1, CAST(0 AS DOUBLE) AS b2,
         CAST(0 AS DOUBLE) AS b3, CAST(0 AS DOUBLE) AS b4 FROM corr, grid
  UNION ALL
  SELECT series_id, grp, trial_id, l1_ratio, penalty, t + 1, b1, b2, b3, b4 FROM {previous}),
fits AS MATERIALIZED (
  SELECT r.series_id, r.grp, trial_id, l1_ratio, penalty, n, {const} AS const, [{slopes}] AS slopes
  FROM run r JOIN scales s ON r.series_id = s.series_id AND r.grp = s.grp WHERE t = 400)"""


COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in ("y", *FEATURES))
PREDICTED = "const + " + " + ".join(f"slopes[{i}] * {c}" for i, c in enumerate(FEATURES, 1))
# every fold's complement, and group 0 with all rows
FOLDED = f"""
folded AS (
  SELECT series_id, ds, y, {", ".join(FEATURES)}, ntile(5) OVER (PARTITION BY series_id ORDER BY ds) AS fold FROM panel),
known AS MATERIALIZED (SELECT * FROM folded WHERE {COMPLETE}),
problems AS MATERIALIZED (
  SELECT k.*, grp FROM known k, (SELECT unnest(range(0, 6)) AS grp) WHERE fold <> grp)"""
TERMS = "unnest(['const', {}]) AS term, unnest(list_concat([const], slopes)) AS coefficient".format(
    ", ".join(f"'{c}'" for c in FEATURES)
)


def t_tail(source: str) -> str:
    """CTEs ending in ``tailed``: ``source`` (series_id, feature, f, free) with p = P(|T| > sqrt f), by the finite
    series for whole degrees of freedom (Abramowitz and Stegun 26.7.3 and 26.7.4)."""
    return f"""
angles AS (SELECT *, atan(sqrt(f / free)) AS angle FROM {source}),
terms AS (
  SELECT series_id, feature, exp(SUM(ln(CASE WHEN free % 2 = 1 THEN 2 * i / (2 * i + 1) ELSE (2 * i - 1) / (2 * i) END))
         OVER (PARTITION BY series_id, feature ORDER BY i) + 2 * i * ln(cos(angle))) AS term
  FROM (SELECT *, CAST(unnest(range(1, CAST(CASE WHEN free % 2 = 1 THEN (free - 3) / 2 ELSE (free - 2) / 2 END AS BIGINT) + 1)) AS DOUBLE) AS i
        FROM angles WHERE f IS NOT NULL)),
series_sums AS (SELECT series_id, feature, SUM(term) AS total FROM terms GROUP BY 1, 2),
tailed AS (
  SELECT a.*, CASE WHEN free % 2 = 1 THEN 1 - 2 / pi() * (angle + sin(angle) * cos(angle) * (1 + coalesce(total, 0)))
              ELSE 1 - sin(angle) * (1 + coalesce(total, 0)) END AS p
  FROM angles a LEFT JOIN series_sums s ON a.series_id = s.series_id AND a.feature = s.feature)"""


def series_sql(market: str, panel: str, fine: str) -> dict[str, str]:
    sql: dict[str, str] = {}
    keep = "p.series_id, ds, round(y, 5) AS y"
    sql["decompose_additive"] = f"WITH {market},{decomposition('market', 12, 'ds', keep, False)}"
    sql["decompose_multiplicative"] = f"WITH {market},{decomposition('market', 12, 'ds', keep, True)}"
    events = "event_rows AS (SELECT event_type AS series_id, ts AS ds, event_id, value AS y FROM events)"
    sql["event_decompose"] = f"WITH {events},{decomposition('event_rows', 24, 'ds, event_id', 'event_id', False, 6)}"

    sql["smoothing_search"] = f"""WITH RECURSIVE {market},{smoothing('market')}
SELECT series_id, trial_id, a AS alpha, b AS beta, g AS gamma, CAST(t AS BIGINT) AS n, round(sse, 1) AS sse FROM ended"""
    smoothed = f"WITH RECURSIVE {panel},{TRAIN},{smoothing('train')}"
    sql["smoothing_model"] = f"""{smoothed}
SELECT series_id, trial_id, round(a, 4) AS alpha, round(b, 4) AS beta, round(g, 4) AS gamma, CAST(t AS BIGINT) AS n,
       round(round(sse, 1), 4) AS sse, round(level, 4) AS level, round(trend, 4) AS trend, round(season[1], 4) AS next_season FROM best"""
    sql["smoothing_fitted"] = f"""{smoothed}
SELECT r.series_id, s.at[r.t] AS ds, round(r.fitted, 4) AS fitted, round(r.level, 4) AS level, round(r.trend, 4) AS trend,
       round(r.season[12], 4) AS season
FROM run r JOIN best b ON r.series_id = b.series_id AND r.trial_id = b.trial_id JOIN series s ON r.series_id = s.series_id WHERE r.t > 0"""
    spread = "list_sum(list_transform(range(1, h), lambda j: pow(a + a * b * j + CASE WHEN j % 12 = 0 THEN g ELSE 0 END, 2)))"
    sql["smoothing_forecast"] = f"""{smoothed},
ahead AS (
  SELECT t.series_id, t.ds, t.y, level + h * trend + season[(h - 1) % 12 + 1] AS yhat,
         CAST(1.959963984540054 AS DOUBLE) * sqrt(sse / b.t * (1 + coalesce({spread}, 0))) AS half
  FROM test t JOIN best b ON t.series_id = b.series_id)
SELECT series_id, ds, round(y, 3) AS y, round(yhat, 3) AS yhat, round(yhat - half, 3) AS yhat_lower, round(yhat + half, 3) AS yhat_upper FROM ahead"""

    var = f"{panel},{TRAIN},{two_column_var()}"
    pieces = [
        ("const", "c", "sqrt(s2 * (CAST(1 AS DOUBLE) / n + (ma * ma * sbb - 2 * ma * mb * sab + mb * mb * saa) / det))"),
        ("L1.y", "ba", "sqrt(s2 * sbb / det)"),
        ("L1.x_qty", "bb", "sqrt(s2 * saa / det)"),
    ]
    sql["var_coefficients"] = f"WITH {var}\n" + " UNION ALL ".join(
        f"SELECT series_id, equation, '{t}' AS term, round({v}, 4) AS coefficient, round({e}, 4) AS std_error, round({v} / {e}, 4) AS t_value FROM solved"
        for t, v, e in pieces
    )
    sql["var_forecast"] = f"""WITH RECURSIVE {var},
models AS (
  SELECT y.series_id, y.c AS yc, y.ba AS yy, y.bb AS yx, x.c AS xc, x.ba AS xy, x.bb AS xx
  FROM solved y JOIN solved x ON y.series_id = x.series_id WHERE y.equation = 'y' AND x.equation = 'x_qty'),
path AS (
  SELECT series_id, CAST(0 AS BIGINT) AS h, y, x_qty AS x FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS last FROM train) WHERE last = 1
  UNION ALL
  SELECT p.series_id, h + 1, yc + yy * y + yx * x, xc + xy * y + xx * x FROM path p JOIN models m ON p.series_id = m.series_id WHERE h < 12)
SELECT t.series_id, t.ds, round(p.y, 2) AS y_hat, round(p.x, 2) AS x_qty_hat
FROM test t JOIN path p ON t.series_id = p.series_id AND t.h = p.h"""

    fits = f"WITH RECURSIVE {panel},{FOLDED},{descent('problems')}"
    sql["elastic_net_path"] = f"""{fits},
errors AS (
  SELECT k.series_id, trial_id, 1 - SUM(pow(y - ({PREDICTED}), 2)) / (var_pop(y) * COUNT(*)) AS r2
  FROM known k JOIN fits f ON k.series_id = f.series_id AND f.grp = 0 GROUP BY 1, 2)
SELECT f.series_id, l1_ratio, penalty, term, round(coefficient, 4) AS coefficient, n, round(r2, 4) AS r2
FROM (SELECT *, {TERMS} FROM fits WHERE grp = 0) f JOIN errors e ON f.series_id = e.series_id AND f.trial_id = e.trial_id"""
    sql["elastic_net_search"] = f"""{fits},
scores AS (
  SELECT k.series_id, trial_id, fold, 1 - SUM(pow(y - ({PREDICTED}), 2)) / (var_pop(y) * COUNT(*)) AS r2
  FROM known k JOIN fits f ON k.series_id = f.series_id AND k.fold = f.grp GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mean_r2 DESC, trial_id) AS place
  FROM (SELECT series_id, trial_id, avg(r2) AS mean_r2 FROM scores GROUP BY 1, 2))
SELECT f.series_id, l1_ratio, penalty, round(mean_r2, 4) AS mean_r2, term, round(coefficient, 4) AS coefficient
FROM (SELECT *, {TERMS} FROM fits WHERE grp = 0) f JOIN ranked r ON f.series_id = r.series_id AND f.trial_id = r.trial_id WHERE place = 1"""
    sql["ridge_fold_scores"] = f"""WITH {panel},
grid AS (
  SELECT CAST(ir * 4 + ip + 1 AS INTEGER) AS trial_id, CAST(l1_ratio AS DOUBLE) AS l1_ratio, CAST(penalty AS DOUBLE) AS penalty
  FROM (VALUES (0, 0.0), (1, 0.5), (2, 1.0)) x(ir, l1_ratio), (VALUES (0, 0.0), (1, 0.02), (2, 0.1), (3, 0.4)) y(ip, penalty)),
folded AS (SELECT *, CAST(ntile(5) OVER (PARTITION BY series_id ORDER BY ds) AS BIGINT) AS fold FROM panel),
fitted AS (
  SELECT d.series_id, f.fold, avg(y) AS my, avg(x_qty) AS mx, stddev_pop(y) AS sy, stddev_pop(x_qty) AS sx, corr(y, x_qty) AS r
  FROM folded d, (SELECT unnest(range(1, 6)) AS fold) f WHERE d.fold <> f.fold GROUP BY 1, 2),
lines AS (
  SELECT *, sign(r) * greatest(abs(r) - penalty * l1_ratio, 0) / (1 + penalty * (1 - l1_ratio)) * sy / sx AS slope FROM fitted, grid)
SELECT d.series_id, trial_id, round(l1_ratio, 5) AS l1_ratio, round(penalty, 5) AS penalty, d.fold, COUNT(*) AS n,
       round(1 - SUM(pow(y - my - slope * (x_qty - mx), 2)) / (var_pop(y) * COUNT(*)), 5) AS r2,
       round(avg(pow(y - my - slope * (x_qty - mx), 2)), 2) AS mse
FROM folded d JOIN lines l ON d.series_id = l.series_id AND d.fold = l.fold GROUP BY 1, 2, 3, 4, 5"""

    tests = " UNION ALL ".join(
        f"SELECT series_id, '{c}' AS feature, count({c}) AS n, CASE WHEN var_pop({c}) > 0 THEN corr({c}, y) END AS r FROM flat GROUP BY 1"
        for c in (*FEATURES, "x_flat")
    )
    sql["feature_f_tests"] = f"""WITH {panel},
flat AS (SELECT *, CAST(1 AS DOUBLE) AS x_flat FROM panel),
tested AS (SELECT *, n - 2 AS free, r * r / (1 - r * r) * (n - 2) AS f FROM ({tests})),{t_tail('tested')}
SELECT series_id, feature, n, round(r, 6) AS r, round(f, 6) AS f, round(p, 6) AS p FROM tailed"""
    best = " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, y) AS r FROM panel" for c in FEATURES)
    cases = " ".join(f"WHEN '{c}' THEN {c}" for c in FEATURES)
    sql["k_best_features"] = f"""WITH {fine},
best AS (SELECT feature FROM ({best}) ORDER BY r * r DESC, feature LIMIT 1)
SELECT series_id, ds, feature AS best_feature, round(CASE feature {cases} END, 5) AS best_value FROM panel, best"""
    sql["inflation_factors"] = f"""WITH {fine},
r AS (SELECT corr(y, x_qty) AS a, corr(y, x_price) AS b, corr(x_qty, x_price) AS c FROM panel),
d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT 'y' AS feature, round((1 - c * c) / det, 4) AS vif FROM d UNION ALL SELECT 'x_qty', round((1 - b * b) / det, 4) FROM d
UNION ALL SELECT 'x_price', round((1 - a * a) / det, 4) FROM d"""

    shares = ", ".join(str(i / 8) for i in range(1, 8))
    edges = ", ".join(f"list_distinct(quantile_disc({c}, [{shares}])) AS e_{c}" for c in ("y", *FEATURES))

    def number(c: str) -> str:
        return f"CASE WHEN {c} IS NOT NULL THEN len(list_filter(e_{c}, lambda e: e < {c})) END"

    binned = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {number(c)} AS i, {number('y')} AS j FROM panel, edges WHERE {c} IS NOT NULL AND y IS NOT NULL" for c in FEATURES
    )
    sql["shared_information"] = f"""WITH {fine},
edges AS (SELECT {edges} FROM panel),
cells AS (SELECT feature, i, j, CAST(COUNT(*) AS DOUBLE) AS n FROM ({binned}) GROUP BY 1, 2, 3),
margins AS (
  SELECT *, SUM(n) OVER (PARTITION BY feature) AS total, SUM(n) OVER (PARTITION BY feature, i) AS ni, SUM(n) OVER (PARTITION BY feature, j) AS nj FROM cells),
found AS (
  SELECT feature, max(total) AS n, SUM(n / total * ln(n * total / (ni * nj))) AS mi,
         COUNT(DISTINCT i) + COUNT(DISTINCT j) - COUNT(*) - 1 AS bias FROM margins GROUP BY 1)
SELECT feature, CAST(n AS BIGINT) AS n, round(mi, 6) AS mi, round(mi + bias / (2 * n), 6) AS mi_corrected FROM found"""
    probs = ["0.01", "0.25", "0.5", "0.75", "0.99"]
    sql["event_quantiles"] = " UNION ALL ".join(
        f"SELECT event_type AS series_id, CAST({p} AS DOUBLE) AS prob, count(value) AS n, round(quantile_cont(value, CAST({p} AS DOUBLE)), 5) AS value FROM events GROUP BY 1"
        for p in probs
    )
    return sql
