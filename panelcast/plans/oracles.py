"""SQL twins of the registered queries, for any engine with standard SQL and list functions."""

from __future__ import annotations

import math
from statistics import NormalDist

from panelcast.operators.grid import grid_points
from panelcast.operators.stationarity import RESPONSE
from panelcast.plans import series_oracles, tree_oracles
from panelcast.plans.market import LINEAR_MODEL
from panelcast.plans.queries import (
    EXOG,
    GRID,
    HORIZON,
    ONE_TRIAL,
    ORDERS,
    WIDE_GRID,
    SMOOTHING,
)

MARKET = """
market AS (
  SELECT c_mktsegment AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e5 AS y
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2)"""

FACTS = """
line_sums AS (
  SELECT l_orderkey,
         SUM(CAST(round(l_quantity * 100) AS BIGINT)) AS qty_c,
         SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS ext_c,
         SUM(CAST(round(l_discount * 100) AS BIGINT)) AS disc_c,
         SUM(CAST(round(l_tax * 100) AS BIGINT)) AS tax_c,
         COUNT(*) AS n_lines
  FROM lineitem GROUP BY l_orderkey),
facts AS (
  SELECT n_name AS geography, c_mktsegment AS product,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS value_c,
         SUM(CASE WHEN o_orderpriority = '1-URGENT'
             THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS urgent_c,
         COALESCE(SUM(qty_c), 0) AS qty_c, COALESCE(SUM(ext_c), 0) AS ext_c,
         COALESCE(SUM(disc_c), 0) AS disc_c, COALESCE(SUM(tax_c), 0) AS tax_c,
         COALESCE(SUM(n_lines), 0) AS n_lines, COUNT(*) AS n_orders
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN line_sums ON l_orderkey = o_orderkey
  GROUP BY 1, 2, 3)"""


def _panel(series: str) -> str:
    return f"""{FACTS},
panel_sums AS (
  SELECT {series} AS series_id, ds, SUM(value_c) AS value_c, SUM(urgent_c) AS urgent_c,
         SUM(qty_c) AS qty_c, SUM(ext_c) AS ext_c, SUM(disc_c) AS disc_c, SUM(n_lines) AS n_lines
  FROM facts GROUP BY 1, 2),
panel AS (
  SELECT series_id, ds, CAST(value_c AS DOUBLE) / 1e5 AS y,
         CAST(qty_c AS DOUBLE) / CAST(100 AS DOUBLE) AS x_qty,
         CAST(ext_c AS DOUBLE) / NULLIF(CAST(qty_c AS DOUBLE), 0) AS x_price,
         CAST(disc_c AS DOUBLE) / NULLIF(CAST(n_lines AS DOUBLE), 0)
           / CAST(100 AS DOUBLE) AS x_disc,
         CAST(urgent_c AS DOUBLE) / NULLIF(CAST(value_c AS DOUBLE), 0) AS x_urgent
  FROM panel_sums)"""


PANEL = _panel("product")
FINE = _panel("concat_ws('/', geography, product)")

LONG = f"""{FACTS},
long_panel AS (
  SELECT strftime(ds, '%Y-%m-%d') AS date, measure, geography, product,
         CAST(CAST(CASE WHEN measure = 'value' THEN value_c ELSE qty_c END AS BIGINT) AS VARCHAR)
           AS total_market,
         CAST(CAST(urgent_c AS BIGINT) AS VARCHAR) AS own_share,
         CAST(CAST(disc_c AS BIGINT) AS VARCHAR) AS "disc_Ncov",
         CAST(CAST(disc_c + n_lines AS BIGINT) AS VARCHAR) AS "disc_Wcov",
         CAST(CAST(tax_c AS BIGINT) AS VARCHAR) AS "tax_FCT",
         CAST(CAST(floor(CAST(ext_c * 100 AS DOUBLE) / NULLIF(CAST(qty_c AS DOUBLE), 0)) AS BIGINT)
           AS VARCHAR) AS "price index",
         CAST(CAST(qty_c AS BIGINT) AS VARCHAR) AS qty,
         '1' AS flat,
         CASE WHEN month(ds) % 4 <> 0 THEN CAST(n_orders AS VARCHAR) END AS gap
  FROM facts, (VALUES ('value'), ('volume')) AS m(measure))"""

KEYS = "date, measure, geography, product"
DRIVERS = ["own_share", "disc_Ncov", "disc_Wcov", "tax_FCT", "price index", "qty", "flat", "gap"]
FEATURES = ["x_qty", "x_price", "x_disc", "x_urgent"]


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def _recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",".join(parts) + "\n"


def _quoted(names: list[str]) -> str:
    return ", ".join(f'"{n}"' for n in names)


def _r(expression: str, digits: int, name: str) -> str:
    return f"round({expression}, {digits}) AS {name}"


def _minmax(c: str) -> str:
    return (
        f"CASE WHEN max({c}) OVER () = min({c}) OVER () THEN {c} * CAST(0 AS DOUBLE) "
        f"ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END"
    )


NAIVE = """
naive AS (
  SELECT series_id, ds, yhat FROM (
    SELECT series_id, ds, lag(y, 12) OVER (PARTITION BY series_id ORDER BY ds) AS yhat FROM market)
  WHERE yhat IS NOT NULL),
aligned AS (SELECT m.series_id, m.ds, m.y, n.yhat FROM market m JOIN naive n USING (series_id, ds))"""

SCORES = """
  COUNT(*) AS n,
  1 - SUM((y - yhat) * (y - yhat)) / NULLIF(var_pop(y) * COUNT(*), 0) AS r2,
  avg(abs(y - yhat)) AS mae,
  avg(abs(y - yhat) / greatest(abs(y), CAST(2.220446049250313e-16 AS DOUBLE))) AS mape,
  avg((y - yhat) * (y - yhat)) AS mse"""

GAPS = f"""{PANEL},
gaps AS (
  SELECT series_id, ds, y, CASE WHEN month(ds) % 4 <> 0 THEN x_qty END AS x_qty,
         CASE WHEN month(ds) % 6 <> 0 THEN x_price END AS x_price FROM panel)"""

SMOOTH = f"""{MARKET},
smooth AS (""" + " UNION ALL ".join(
    f"""SELECT series_id, ds, y, CAST({i} AS INTEGER) AS trial_id, CAST({k} AS INTEGER) AS "window",
       CASE WHEN count(y) OVER w = {k} THEN avg(y) OVER w END AS yhat FROM market
       WINDOW w AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"""
    for i, k in enumerate(SMOOTHING, 1)
) + f"""),
smooth_scores AS (
  SELECT series_id, trial_id, "window", {SCORES} FROM smooth
  WHERE yhat IS NOT NULL GROUP BY series_id, trial_id, "window")"""

EVENTS = """
event_rows AS (SELECT event_type AS series_id, ts AS ds, event_id, value FROM events)"""
EVENT_WINDOW = "WINDOW w AS (PARTITION BY series_id ORDER BY ds, event_id)"

SERIES = """
series AS (SELECT DISTINCT concat_ws('/', n_name, c_mktsegment) AS series_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def _values(values: list[object], name: str) -> str:
    rows = ", ".join(f"({i}, {repr(v) if isinstance(v, str) else v})" for i, v in enumerate(values))
    return f"(VALUES {rows}) AS {name}_list({name}_pos, {name})"


def _grid_sql() -> str:
    g = WIDE_GRID
    scale, knots, mode = (
        g["changepoint_prior_scale"],
        g["n_changepoints"],
        g["seasonality_mode"],
    )
    position = (
        f"(scale_pos * {len(knots)} + knots_pos) * {len(mode)} + mode_pos + 1"
    )
    return f"""{SERIES},
grid AS (
  SELECT series_id, CAST({position} AS INTEGER) AS trial_id,
         CAST(scale AS DOUBLE) AS changepoint_prior_scale, CAST(knots AS INTEGER) AS n_changepoints,
         mode AS seasonality_mode
  FROM series, {_values(scale, "scale")}, {_values(knots, "knots")}, {_values(mode, "mode")})"""


def _polynomial(coefficients: tuple[float, ...]) -> str:
    text = f"CAST({coefficients[-1]} AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        text = f"({text} * statistic + CAST({c} AS DOUBLE))"
    return text


LAG_ZERO = """
steps AS (
  SELECT series_id, y - lag(y) OVER w AS dy, lag(y) OVER w AS y1 FROM market
  WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
sums AS (
  SELECT series_id, COUNT(*) AS n_obs, regr_slope(dy, y1) AS slope, regr_sxx(dy, y1) AS sxx,
         regr_syy(dy, y1) AS syy, regr_sxy(dy, y1) AS sxy
  FROM steps WHERE dy IS NOT NULL GROUP BY series_id),
tested AS (
  SELECT series_id, n_obs, slope / sqrt((syy - slope * sxy) / (n_obs - 2) / sxx) AS statistic,
         CAST(0 AS INTEGER) AS used_lag
  FROM sums)"""


def _residual_chain(source: str, columns: list[str], kept: list[str], label: str) -> list[str]:
    """CTEs that make ``columns[1:]`` orthogonal to the columns before them, one at a time.

    ``source`` has series_id, the columns and ``kept``; an all-zero column is passed over.
    """
    ctes = []
    previous = source
    for j in range(len(columns) - 1):
        pivot = columns[j]
        done = [f"{c}" for c in columns[: j + 1]]
        new = [
            f"{c} - {pivot} * COALESCE(SUM({c} * {pivot}) OVER s "
            f"/ NULLIF(SUM({pivot} * {pivot}) OVER s, 0), 0) AS {c}"
            for c in columns[j + 1 :]
        ]
        name = f"{label}_{j}"
        ctes.append(
            f"{name} AS (SELECT series_id, {', '.join(kept + done + new)} FROM {previous} "
            "WINDOW s AS (PARTITION BY series_id))"
        )
        previous = name
    return ctes


def _adf_statistics(width: int, trend: bool, lag_rule: str | None) -> str:
    """CTEs ending in ``tested(series_id, statistic, used_lag, n_obs)`` from ``input(series_id, ds,
    y)``: least squares by orthogonalising the rows themselves, one regressor after the other.

    ``lag_rule`` is an expression in n for a fixed lag; without it the lag minimises AIC.
    """
    fixed = ["one", "t"] if trend else ["one"]
    k = len(fixed) + 1
    lags = ", ".join(f"lag(z, {i}) OVER w AS l{i}" for i in range(1, width + 2))
    top = lag_rule or "ceil(12 * pow(n / CAST(100 AS DOUBLE), CAST(0.25 AS DOUBLE)))"
    ctes = [
        f"""
sized AS (
  SELECT series_id, ds, count(*) OVER s AS n, (y - avg(y) OVER s) / stddev_pop(y) OVER s AS z
  FROM input WINDOW s AS (PARTITION BY series_id)),
placed AS (
  SELECT *, least({top}, floor(n / 2) - {k}) AS top, row_number() OVER w AS pos, {lags}
  FROM sized WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
design AS (
  SELECT series_id, n, top, pos, CAST(1 AS DOUBLE) AS one, pos / CAST(n AS DOUBLE) AS t,
         l1 AS level, z - l1 AS dy, """
        + ", ".join(
            f"CASE WHEN {i} <= least(top, pos - 2) THEN l{i} - l{i + 1} ELSE CAST(0 AS DOUBLE) END"
            f" AS d{i}"
            for i in range(1, width + 1)
        )
        + " FROM placed WHERE pos >= 2)"
    ]
    if lag_rule is None:
        names = [*fixed, "level", *[f"d{i}" for i in range(1, width + 1)], "dy"]
        ctes.append("common AS (SELECT * FROM design WHERE pos > top + 1)")
        chain = _residual_chain("common", names[:-1], ["top", "dy"], "nested")
        ctes += chain
        last = f"nested_{len(names) - 3}"
        explained = ", ".join(
            f"COALESCE(pow(SUM(dy * {c}), 2) / NULLIF(SUM({c} * {c}), 0), 0) AS e_{c}"
            for c in names[:-1]
        )
        ctes.append(
            f"explained AS (SELECT series_id, max(top) AS top, count(*) AS rows, "
            f"SUM(dy * dy) AS total, {explained} FROM {last} GROUP BY series_id)"
        )
        options = []
        for p in range(width + 1):
            parts = " - ".join(f"e_{c}" for c in names[: k + p])
            options.append(
                f"SELECT series_id, {p} AS p, rows * ln((total - {parts}) / rows) + 2 * {k + p} "
                f"AS aic FROM explained WHERE {p} <= top"
            )
        ctes.append(
            "chosen AS (SELECT series_id, p FROM (SELECT *, row_number() OVER "
            "(PARTITION BY series_id ORDER BY aic, p) AS rn FROM ("
            + " UNION ALL ".join(options)
            + ")) WHERE rn = 1)"
        )
    else:
        ctes.append("chosen AS (SELECT DISTINCT series_id, CAST(top AS BIGINT) AS p FROM design)")
    ctes.append("final AS (SELECT * FROM design JOIN chosen USING (series_id) WHERE pos >= p + 2)")
    masked = ", ".join(
        f"CASE WHEN {i} <= p THEN d{i} ELSE CAST(0 AS DOUBLE) END AS d{i}"
        for i in range(1, width + 1)
    )
    ctes.append(
        f"masked AS (SELECT series_id, n, p, one, t, level, dy, {masked} FROM final)"
    )
    names = [*fixed, *[f"d{i}" for i in range(1, width + 1)], "level", "dy"]
    ctes += _residual_chain("masked", names, ["n", "p"], "fit")
    before, after = f"fit_{len(names) - 3}", f"fit_{len(names) - 2}"
    ctes.append(
        f"""
slopes AS (SELECT series_id, SUM(dy * level) / SUM(level * level) AS slope,
  SUM(level * level) AS spread FROM {before} GROUP BY series_id),
noise AS (SELECT series_id, SUM(dy * dy) AS sse, count(*) AS n_obs, max(p) AS used_lag
  FROM {after} GROUP BY series_id),
tested AS (
  SELECT series_id, slope / sqrt(sse / (n_obs - {k} - used_lag) / spread) AS statistic,
         CAST(used_lag AS INTEGER) AS used_lag, n_obs
  FROM slopes JOIN noise USING (series_id))"""
    )
    return ",".join(ctes)


def _p_value_ctes(regression: str) -> str:
    """CTEs from ``tested`` to ``p`` with the unit-root p-value of the statistic."""
    r = RESPONSE[regression]
    # Fixed values of the error-function approximation, highest power first.
    poly = "CAST(1.061405429 AS DOUBLE)"
    for a in (-1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = f"({poly} * t + CAST({a} AS DOUBLE))"
    root = f"CAST({math.sqrt(2.0)} AS DOUBLE)"
    return f"""
z AS (
  SELECT *, CASE WHEN statistic <= {r["split"]} THEN {_polynomial(r["left"])}
            ELSE {_polynomial(r["right"])} END AS z FROM tested),
erf AS (SELECT *, 1 / (1 + CAST(0.3275911 AS DOUBLE) * abs(z) / {root}) AS t, abs(z) / {root} AS x
  FROM z),
half AS (SELECT *, 1 - {poly} * t * exp(-x * x) AS e FROM erf),
p AS (
  SELECT *, CAST(CASE WHEN statistic > {r["high"]} THEN 1 WHEN statistic < {r["low"]} THEN 0
            WHEN z >= 0 THEN (1 + e) / 2 ELSE (1 - e) / 2 END AS DOUBLE) AS p_value FROM half)"""


TESTED = (
    "SELECT series_id, round(statistic, 5) AS statistic, round(p_value, 5) AS p_value, "
    "used_lag, n_obs, p_value <= 0.05 AS stationary FROM p"
)

def _strength(source: str) -> str:
    """CTEs ending in ``strengths(series_id, strength)``."""
    return f"""
moving AS (
  SELECT series_id, row_number() OVER w AS pos, lag(y, 6) OVER w AS centre,
         (SUM(y) OVER (w ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING)
           + (y + lag(y, 12) OVER w) / 2) / 12 AS mean
  FROM {source} WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
detrended AS (
  SELECT series_id, (pos - 6) % 12 AS phase, centre - mean AS d FROM moving WHERE pos >= 13),
seasonal AS (
  SELECT series_id, d, avg(d) OVER (PARTITION BY series_id, phase) AS s FROM detrended),
strengths AS (
  SELECT series_id, greatest(CAST(0 AS DOUBLE), 1 - var_pop(d - s) / var_pop(d)) AS strength
  FROM seasonal GROUP BY series_id)"""


def _sarx_design() -> str:
    """CTEs ending in ``sample(series_id, target and columns of the full design)``.

    Regressors of the design: one, x0, x1; e1..e5, e12 (lagged residuals of a long
    autoregression); z1..z5, z12 (lagged differenced target).
    """
    h, m = ORDERS.long_ar, ORDERS.m

    def difference(v: str) -> str:
        return (
            f"{v} - lag({v}) OVER w - CASE WHEN d = 1 THEN lag({v}, {m}) OVER w "
            f"- lag({v}, {m + 1}) OVER w ELSE 0 END"
        )

    long_names = ["one", *[f"a{i}" for i in range(1, h + 1)], "x0", "x1", "z"]
    long_lags = ", ".join(f"lag(z, {i}) OVER w AS a{i}" for i in range(1, h + 1))
    lags = [f"lag(z, {i}) OVER w AS z{i}" for i in ORDERS.y_lags]
    lags += [f"lag(e, {i}) OVER w AS e{i}" for i in ORDERS.e_lags]
    complete = " AND ".join(f"z{i} IS NOT NULL" for i in ORDERS.y_lags)
    complete += " AND " + " AND ".join(f"e{i} IS NOT NULL" for i in ORDERS.e_lags)
    chain = _residual_chain("long_rows", long_names, ["ds"], "long")
    return ",".join(
        [
            f"""
train AS (
  SELECT series_id, ds, y, x_qty, x_price FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS back FROM panel)
  WHERE back > {HORIZON})""",
            _strength("train"),
            f"""
scales AS (
  SELECT series_id, stddev_pop(y) AS ys, stddev_pop(x_qty) AS s0, stddev_pop(x_price) AS s1
  FROM train GROUP BY series_id),
scaled AS (
  SELECT series_id, ds, y / ys AS y, x_qty / s0 AS x0, x_price / s1 AS x1,
         CASE WHEN strength > 0.64 THEN 1 ELSE 0 END AS d
  FROM train JOIN scales USING (series_id) JOIN strengths USING (series_id)),
flat AS (
  SELECT series_id, ds, {difference("y")} AS z, {difference("x0")} AS x0,
         {difference("x1")} AS x1
  FROM scaled WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
long_rows AS (
  SELECT * FROM (
    SELECT series_id, ds, CAST(1 AS DOUBLE) AS one, z, x0, x1, {long_lags}
    FROM flat WINDOW w AS (PARTITION BY series_id ORDER BY ds))
  WHERE a{h} IS NOT NULL)""",
            *chain,
            f"""
residuals AS (SELECT series_id, ds, z AS e FROM long_{len(long_names) - 2}),
lagged AS (
  SELECT series_id, ds, CAST(1 AS DOUBLE) AS one, z, x0, x1, e, {", ".join(lags)}
  FROM flat LEFT JOIN residuals USING (series_id, ds)
  WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
sample AS (SELECT * FROM lagged WHERE e IS NOT NULL AND {complete})""",
        ]
    )


def _sarx_fits() -> str:
    """CTEs ending in ``log(series_id, candidate, order, aic)`` and ``coefficients(series_id, term,
    slope, coefficient, std_error)``.

    Every order keeps some columns of one Gram matrix; a column left out becomes a unit row. All
    orders are eliminated together, next to the unit matrix, which turns into the inverse.
    """
    m = ORDERS.m
    tests = {"one": "1 = 1", "x0": "1 = 1", "x1": "1 = 1"}
    tests |= {f"z{i}": f"p >= {i}" for i in range(1, ORDERS.p + 1)}
    tests |= {f"z{m * i}": f"seasonal_p >= {i}" for i in range(1, ORDERS.P + 1)}
    tests |= {f"e{i}": f"q >= {i}" for i in range(1, ORDERS.q + 1)}
    tests |= {f"e{m * i}": f"seasonal_q >= {i}" for i in range(1, ORDERS.Q + 1)}
    names = list(tests)
    k = len(names)
    orders = ", ".join(
        f"({i}, {', '.join(map(str, order))})"
        for i, (order, _) in enumerate(ORDERS.candidates(EXOG))
    )
    mask = ", ".join(f"CASE WHEN {test} THEN 1 ELSE 0 END" for test in tests.values())
    units = {"one": "ys", "x0": "ys / s0", "x1": "ys / s1"}
    terms = {"one": "const", "x0": EXOG[0], "x1": EXOG[1]}
    rows = ", ".join(
        f"({i}, '{terms.get(c, ('ar_' if c[0] == 'z' else 'ma_') + c[1:])}')"
        for i, c in enumerate(names, 1)
    )
    unit = "CASE " + " ".join(
        f"WHEN i = {i} THEN {units[c]}" for i, c in enumerate(names, 1) if c in units
    ) + " ELSE 1 END"
    return f"""
pairs AS (
  SELECT series_id, i, j, SUM(x[i] * x[j]) AS s, count(*) AS n
  FROM (SELECT series_id, [{", ".join(names)}, z] AS x FROM sample),
       range(1, {k + 2}) AS a(i), range(1, {k + 2}) AS b(j) GROUP BY ALL),
lines AS (SELECT series_id, n, i, list(s ORDER BY j) AS line FROM pairs GROUP BY ALL),
grams AS (SELECT series_id, n, list(line ORDER BY i) AS g FROM lines GROUP BY ALL),
orders_tried AS (
  SELECT *, [{mask}] AS used
  FROM (VALUES {orders}) AS o(candidate, p, q, seasonal_p, seasonal_q)),
elimination AS (
  SELECT series_id, candidate, 1 AS piv,
    [[CASE WHEN j <= {k} THEN used[i] * used[j] * g[i][j]
             + CASE WHEN i = j THEN 1 - used[i] ELSE 0 END
           WHEN j = {k + 1} THEN used[i] * g[i][j]
           WHEN j = {k + 1} + i THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
      for j in range(1, {2 * k + 2})] for i in range(1, {k + 1})] AS m
  FROM grams, orders_tried
  UNION ALL
  SELECT series_id, candidate, piv + 1,
    [[CASE WHEN i = piv THEN m[i][j] / m[piv][piv]
      ELSE m[i][j] - m[i][piv] * m[piv][j] / m[piv][piv] END
      for j in range(1, {2 * k + 2})] for i in range(1, {k + 1})]
  FROM elimination WHERE piv <= {k}),
fits AS MATERIALIZED (
  SELECT e.series_id, candidate, p, q, seasonal_p, seasonal_q, used, n, m,
         g[{k + 1}][{k + 1}] - list_sum([used[i] * m[i][{k + 1}] * g[i][{k + 1}]
           for i in range(1, {k + 1})]) AS sse, list_sum(used) AS k
  FROM elimination e JOIN grams USING (series_id) JOIN orders_tried USING (candidate)
  WHERE piv = {k + 1}),
log AS (SELECT *, n * ln(sse / n) + 2 * k AS aic FROM fits),
chosen AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY aic, candidate) AS rn FROM log)
  WHERE rn = 1),
coefficients AS MATERIALIZED (
  SELECT series_id, term, m[i][{k + 1}] AS slope, m[i][{k + 1}] * ({unit}) AS coefficient,
         sqrt(sse / (n - k) * m[i][{k + 1} + i]) * ({unit}) AS std_error
  FROM chosen JOIN scales USING (series_id), (VALUES {rows}) AS t(i, term) WHERE used[i] = 1)"""


def _sarx_path() -> str:
    """CTEs from ``coefficients`` to ``path``: the recursion, one step of all series at a time."""
    m = ORDERS.m

    def difference(v: str) -> str:
        return (
            f"{v} - lag({v}) OVER w - CASE WHEN d = 1 THEN lag({v}, {m}) OVER w "
            f"- lag({v}, {m + 1}) OVER w ELSE 0 END"
        )

    terms = ["const", *EXOG]
    terms += [f"ar_{i}" for i in ORDERS.y_lags] + [f"ma_{i}" for i in ORDERS.e_lags]
    betas = ", ".join(
        f"COALESCE(max(CASE WHEN term = '{t}' THEN slope END), 0) AS b_{t}" for t in terms
    )
    step = f"b_const + b_{EXOG[0]} * x0 + b_{EXOG[1]} * x1"
    step += "".join(f" + b_ar_{i} * COALESCE(zs[-{i}], 0)" for i in ORDERS.y_lags)
    step += "".join(f" + b_ma_{i} * COALESCE(es[-{i}], 0)" for i in ORDERS.e_lags)
    return f"""
beta AS (SELECT series_id, {betas} FROM coefficients GROUP BY series_id),
all_rows AS (
  SELECT p.series_id, p.ds, t.ds IS NULL AS ahead, t.y / ys AS y, p.x_qty / s0 AS x0,
         p.x_price / s1 AS x1, CASE WHEN strength > 0.64 THEN 1 ELSE 0 END AS d
  FROM panel p JOIN scales USING (series_id) JOIN strengths USING (series_id)
  LEFT JOIN train t ON t.series_id = p.series_id AND t.ds = p.ds),
all_flat AS (
  SELECT series_id, ds, ahead, d, y, {difference("y")} AS z, {difference("x0")} AS x0,
         {difference("x1")} AS x1
  FROM all_rows WINDOW w AS (PARTITION BY series_id ORDER BY ds)),
past AS (
  SELECT a.series_id, any_value(d) AS d, list(y ORDER BY a.ds) AS ys, list(z ORDER BY a.ds) AS zs,
         list(COALESCE(e, 0) ORDER BY a.ds) AS es
  FROM all_flat a LEFT JOIN residuals r ON r.series_id = a.series_id AND r.ds = a.ds
  WHERE NOT ahead GROUP BY a.series_id),
future AS (
  SELECT series_id, ds, x0, x1, row_number() OVER (PARTITION BY series_id ORDER BY ds) AS step
  FROM all_flat WHERE ahead),
path AS (
  SELECT series_id, CAST(0 AS BIGINT) AS step, d, ys, zs, es FROM past
  UNION ALL
  SELECT series_id, step, d,
         list_append(ys, new + ys[-1] + d * (ys[-{m}] - ys[-{m + 1}])),
         list_append(zs, new), list_append(es, CAST(0 AS DOUBLE))
  FROM (
    SELECT path.series_id, future.step, path.d, ys, zs, es, {step} AS new
    FROM path JOIN future ON future.series_id = path.series_id AND future.step = path.step + 1
    JOIN beta ON beta.series_id = path.series_id))"""


def _ridge(label: str, source: str, trend: int, season: int, scale: str) -> str:
    """CTEs ending in ``{label}_solved(series_id, beta, noise)``: six penalised fits in a row.

    ``source`` has (series_id, tau, x) with x = columns of the design, then the target. Each fit is
    one Gauss-Jordan elimination, a pivot per step of the recursion; its noise sets the penalties
    of the next fit.
    """
    k = trend + season
    return f"""
{label}_pairs AS (
  SELECT series_id, tau, i, j, SUM(x[i] * x[j]) AS s, count(*) AS n
  FROM {source}, range(1, {k + 2}) AS a(i), range(1, {k + 2}) AS b(j) GROUP BY ALL),
{label}_lines AS (
  SELECT series_id, tau, n, i, list(s ORDER BY j) AS line FROM {label}_pairs GROUP BY ALL),
{label}_gram AS (
  SELECT series_id, n, list(line ORDER BY i) AS g,
         [CASE WHEN c <= 2 THEN CAST(0.04 AS DOUBLE) WHEN c <= {trend} THEN 1 / (2 * {scale} * {scale})
          ELSE CAST(0.01 AS DOUBLE) END for c in range(1, {k + 1})] AS p
  FROM {label}_lines GROUP BY series_id, n, tau),
{label}_steps AS (
  SELECT series_id, n, g, p, 0 AS fit, 0 AS piv, CAST(0.01 AS DOUBLE) AS noise,
         CAST([] AS DOUBLE[][]) AS m, CAST([] AS DOUBLE[]) AS beta
  FROM {label}_gram
  UNION ALL
  SELECT series_id, n, g, p, CASE WHEN piv > {k} THEN fit + 1 ELSE fit END,
    CASE WHEN piv > {k} THEN 0 ELSE piv + 1 END,
    CASE WHEN piv > {k} THEN greatest(CAST(1e-8 AS DOUBLE), (g[{k + 1}][{k + 1}] + list_sum(
        [m[i][{k + 1}] * (list_inner_product([m[j][{k + 1}] for j in range(1, {k + 1})], g[i][1:{k}])
         - 2 * g[i][{k + 1}]) for i in range(1, {k + 1})])) / n) ELSE noise END,
    CASE WHEN piv = 0 THEN
        [[g[i][j] + CASE WHEN i = j THEN noise * p[i] ELSE 0 END for j in range(1, {k + 2})]
         for i in range(1, {k + 1})]
      WHEN piv <= {k} THEN
        [[CASE WHEN i = piv THEN m[i][j] / m[piv][piv]
          ELSE m[i][j] - m[i][piv] * m[piv][j] / m[piv][piv] END
          for j in range(1, {k + 2})] for i in range(1, {k + 1})]
      ELSE m END,
    CASE WHEN piv > {k} THEN [m[i][{k + 1}] for i in range(1, {k + 1})] ELSE beta END
  FROM {label}_steps WHERE fit < 6),
{label}_solved AS MATERIALIZED (
  SELECT series_id, beta, noise FROM {label}_steps WHERE fit = 6)"""


def _trend_ctes(label: str, trials: str, fit: str, ahead: str, knots: int, weighted: bool) -> str:
    """CTEs ending in ``{label}_forecast(series_id, trial_id, ds, y, yhat, reach)``.

    ``trials`` has (series_id, trial_id, mode, n_cp, tau). ``fit`` and ``ahead`` are conditions on
    ``back``, the number of a row from the end of its series. Keys of the fits are series and trial.
    """
    order, period = 3, 365.25
    waves = [
        f"{f}(CAST({2.0 * math.pi * k!r} AS DOUBLE) * days / {period})"
        for k in range(1, order + 1)
        for f in ("sin", "cos")
    ]
    hinges = [
        f"CASE WHEN knots >= {j} THEN greatest(CAST(0 AS DOUBLE), "
        f"t - CAST({0.8 * j!r} AS DOUBLE) / knots) ELSE CAST(0 AS DOUBLE) END"
        for j in range(1, knots + 1)
    ]
    trend, season = 2 + knots, len(waves) + 2
    ctes = [
        f"""
{label}_placed AS (
  SELECT series_id, ds, y, x_qty, x_price, row_number() OVER w AS back,
         CAST(date_diff('day', DATE '1970-01-01', ds) AS DOUBLE) AS days
  FROM panel WINDOW w AS (PARTITION BY series_id ORDER BY ds DESC)),
{label}_facts AS (
  SELECT series_id, count(*) AS n, min(days) AS t0, max(days) AS t1, max(abs(y)) AS ys,
         avg(x_qty) AS m0, stddev_pop(x_qty) AS s0, avg(x_price) AS m1, stddev_pop(x_price) AS s1
  FROM {label}_placed WHERE {fit} GROUP BY series_id),
{label}_full AS MATERIALIZED (
  SELECT series_id || '#' || trial_id AS series_id, mode, tau, ds, y / ys AS v, back,
         [CAST(1 AS DOUBLE), t, {", ".join(hinges)}] AS tr,
         [{", ".join(waves)}, (x_qty - m0) / s0, (x_price - m1) / s1] AS se
  FROM (
    SELECT *, (days - t0) / (t1 - t0) AS t,
           least(n_cp, greatest(floor(n * CAST(0.8 AS DOUBLE)) - 1, 0)) AS knots
    FROM {label}_placed JOIN {label}_facts USING (series_id) JOIN {trials} USING (series_id)))"""
    ]
    source = f"{label}_full WHERE {fit}"
    if weighted:
        smallest = f"CAST({min(GRID['changepoint_prior_scale'])} AS DOUBLE)"
        ctes.append(
            f" {label}_first AS (SELECT series_id, tau, list_concat(tr, se, [v]) AS x FROM {source})"
        )
        ctes.append(_ridge(f"{label}_base", f"{label}_first", trend, season, smallest))
        ctes.append(
            f"""
{label}_weighted AS (
  SELECT series_id, tau, tr, v, CASE WHEN mode = 'multiplicative'
    THEN [list_inner_product(beta[1:{trend}], tr) * e for e in se] ELSE se END AS se
  FROM {label}_full JOIN {label}_base_solved USING (series_id) WHERE {fit})"""
        )
        source = f"{label}_weighted"
    ctes.append(
        f" {label}_design AS (SELECT series_id, tau, list_concat(tr, se, [v]) AS x FROM {source})"
    )
    ctes.append(_ridge(label, f"{label}_design", trend, season, "tau"))
    ctes.append(
        f"""
{label}_parts AS (
  SELECT series_id, ds, v, mode, noise, list_inner_product(beta[1:{trend}], tr) AS trend,
         list_inner_product(beta[{trend + 1}:], se) AS rest
  FROM {label}_full JOIN {label}_solved USING (series_id) WHERE {ahead}),
{label}_forecast AS MATERIALIZED (
  SELECT split_part(p.series_id, '#', 1) AS series_id,
         CAST(split_part(p.series_id, '#', 2) AS INTEGER) AS trial_id, ds, v * ys AS y,
         ys * CASE WHEN mode = 'multiplicative' THEN trend * (1 + rest) ELSE trend + rest END
           AS yhat, sqrt(noise) * ys AS reach
  FROM {label}_parts p JOIN {label}_facts f ON f.series_id = split_part(p.series_id, '#', 1))"""
    )
    return ",".join(ctes)


def _one_trial() -> str:
    t = ONE_TRIAL[0]
    return f"""
one_trial AS (
  SELECT DISTINCT series_id, 1 AS trial_id, '{t["seasonality_mode"]}' AS mode,
         {t["n_changepoints"]} AS n_cp, CAST({t["changepoint_prior_scale"]} AS DOUBLE) AS tau
  FROM panel)"""


def _all_trials() -> str:
    rows = ", ".join(
        f"({i}, '{p['seasonality_mode']}', {p['n_changepoints']}, {p['changepoint_prior_scale']})"
        for i, p in enumerate(grid_points(GRID), 1)
    )
    return f"""
all_trials AS (
  SELECT series_id, trial_id, mode, n_cp, CAST(tau AS DOUBLE) AS tau
  FROM (SELECT DISTINCT series_id FROM panel),
       (VALUES {rows}) AS g(trial_id, mode, n_cp, tau))"""


def _phi_sql() -> str:
    parts = " UNION ALL ".join(
        f"""SELECT concat_ws('|', series_id, CAST(ds AS VARCHAR)) AS row_id, '{c}' AS feature,
       {c} AS value,
       CAST({b} AS DOUBLE) * ({c} - (SELECT round(avg({c}), 6) FROM panel)) AS phi
FROM complete"""
        for c, b in LINEAR_MODEL.items()
    )
    missing = " AND ".join(f"{c} IS NOT NULL" for c in LINEAR_MODEL)
    return f"""{FINE},
complete AS (SELECT * FROM panel WHERE {missing}),
phi AS ({parts})"""


def _linear_shares() -> str:
    """CTEs ending in ``filled``, ``reference`` and ``slopes(feature, b)`` of a least squares fit.

    Each slope is that of the target on a feature after constant and other features are out.
    """
    scaled = ", ".join(f"{_minmax(c)} AS {c}" for c in FEATURES)
    filled = ", ".join(f"COALESCE({c}, avg({c}) OVER ()) AS {c}" for c in FEATURES)
    means = ", ".join(f"avg({c}) AS {c}" for c in FEATURES)
    ctes = [
        f"""
scaled AS (SELECT series_id, ds, y, {scaled} FROM panel),
filled AS MATERIALIZED (SELECT series_id, ds, y, {filled} FROM scaled),
reference AS (
  SELECT {means} FROM (
    SELECT * FROM filled
    ORDER BY md5(concat_ws('|', series_id, CAST(ds AS VARCHAR), '21')) LIMIT 100)),
pooled AS (
  SELECT 'all' AS series_id, CAST(1 AS DOUBLE) AS one, {", ".join(FEATURES)}, y FROM filled)"""
    ]
    slopes = []
    for c in FEATURES:
        order = ["one", *[f for f in FEATURES if f != c], c, "y"]
        ctes += _residual_chain("pooled", order, [], f"share_{c}")
        slopes.append(
            f"SELECT '{c}' AS feature, SUM(y * {c}) / SUM({c} * {c}) AS b "
            f"FROM share_{c}_{len(order) - 3}"
        )
    ctes.append("slopes AS (" + " UNION ALL ".join(slopes) + ")")
    return ",".join(ctes)


def _corr_sql() -> str:
    names = ["y", *FEATURES]
    tests = []
    for i in range(1, len(names)):
        tests.append(
            f"SELECT '{names[i]}' AS \"column\" WHERE "
            + " OR ".join(
                f"(SELECT corr({names[i]}, {names[j]}) FROM panel) > 0.5" for j in range(i)
            )
        )
    return _with(FINE) + " UNION ALL ".join(tests)


def _changepoint_sql() -> str:
    hinges = ", ".join(
        _r(f"greatest(CAST(0 AS DOUBLE), t - CAST({0.8 * j / 8!r} AS DOUBLE))", 6, f"cp_{j}")
        for j in range(1, 9)
    )
    return (
        _with(
            MARKET,
            """
days AS (SELECT series_id, ds, CAST(date_diff('day', DATE '1970-01-01', ds) AS DOUBLE) AS d
  FROM market),
scaled AS (SELECT series_id, ds, (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w) AS t
  FROM days WINDOW w AS (PARTITION BY series_id))""",
        )
        + f"SELECT series_id, ds, {_r('t', 6, 't')}, {hinges} FROM scaled"
    )


def _fourier_sql() -> str:
    terms = []
    for k in range(1, 6):
        angle = f"CAST({2.0 * math.pi * k!r} AS DOUBLE) * d / CAST(30 AS DOUBLE)"
        terms += [_r(f"sin({angle})", 6, f"sin_{k}"), _r(f"cos({angle})", 6, f"cos_{k}")]
    return (
        _with(
            MARKET,
            """
days AS (SELECT series_id, ds, CAST(date_diff('day', DATE '1970-01-01', ds) AS DOUBLE) AS d
  FROM market)""",
        )
        + f"SELECT series_id, ds, {', '.join(terms)} FROM days"
    )


def oracle_sql() -> dict[str, str]:
    scaled = ", ".join(_r(_minmax(c), 6, c) for c in FEATURES)
    drivers_cast = ", ".join(f'CAST("{d}" AS DOUBLE) AS "{d}"' for d in DRIVERS)
    sql: dict[str, str] = {}

    sql["market_profile"] = (
        _with(MARKET)
        + """SELECT series_id, ds, round(y, 5) AS y,
       round(CASE WHEN count(y) OVER f = 3 THEN avg(y) OVER f END, 5) AS mean_3,
       round(y - lag(y) OVER w, 5) AS diff_1,
       round((y - min(y) OVER s) / (max(y) OVER s - min(y) OVER s), 5) AS scaled
FROM market WINDOW s AS (PARTITION BY series_id), w AS (PARTITION BY series_id ORDER BY ds),
  f AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
    )
    sql["scan_panel"] = (
        "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS ds, o_totalprice FROM orders"
    )
    head = _with(LONG) + f"SELECT {KEYS}, total_market"
    sql["filter_measure"] = head + " FROM long_panel WHERE measure = 'volume'"
    sql["filter_product"] = (
        head + " FROM long_panel WHERE measure = 'volume' AND product = 'BUILDING'"
    )
    sql["drop_columns"] = (
        _with(LONG)
        + "SELECT date, geography, product, total_market FROM long_panel WHERE measure = 'volume'"
    )
    kept = [d for d in DRIVERS if "FCT" not in d]
    sql["scan_csv"] = _with(LONG) + f"SELECT {KEYS}, total_market, {_quoted(DRIVERS)} FROM long_panel"
    sql["regex_drop"] = head + f", {_quoted(kept)} FROM long_panel"
    kept = [d for d in DRIVERS if "cov" not in d] + ["disc_Ncov"]
    sql["regex_variant"] = head + f", {_quoted(kept)} FROM long_panel"
    sql["cast_numeric"] = (
        _with(LONG)
        + f"SELECT {KEYS}, CAST(total_market AS DOUBLE) AS total_market, {drivers_cast} "
        "FROM long_panel"
    )
    sql["parse_date"] = (
        _with(LONG)
        + "SELECT CAST(date AS DATE) AS date, measure, geography, product, total_market "
        "FROM long_panel"
    )
    sql["feature_target_split"] = (
        _with(LONG) + f"SELECT {KEYS}, {_quoted(DRIVERS[1:])} FROM long_panel"
    )
    sql["rename_contract"] = (
        _with(LONG)
        + "SELECT date AS ds, measure, geography, product, total_market AS y FROM long_panel"
    )
    sql["date_range_filter"] = (
        _with(MARKET)
        + "SELECT series_id, ds, round(y, 5) AS y FROM market "
        "WHERE ds BETWEEN DATE '1998-01-01' AND DATE '1998-12-01'"
    )
    sql["strip_tz"] = (
        "SELECT event_id, ts AS ds, CAST(date_trunc('month', ts) AS DATE) AS month FROM events"
    )
    features = ", ".join(FEATURES)
    s_features = ", ".join(f"s.{c}" for c in FEATURES)
    sql["left_join_features"] = (
        _with(PANEL, f" scaled AS (SELECT series_id, ds, {scaled} FROM panel)")
        + f"SELECT p.series_id, p.ds, {features} FROM (SELECT series_id, ds FROM panel) p "
        "LEFT JOIN (SELECT * FROM scaled WHERE month(ds) <> 12) s USING (series_id, ds)"
    )
    sql["join_target"] = (
        _with(PANEL, f" scaled AS (SELECT series_id, ds, {scaled} FROM panel)")
        + f"SELECT s.series_id, s.ds, {s_features}, round(p.y, 6) AS y "
        "FROM scaled s JOIN panel p USING (series_id, ds)"
    )
    sql["align_actual_forecast"] = (
        _with(MARKET, NAIVE)
        + "SELECT series_id, ds, round(y, 5) AS y, round(yhat, 5) AS yhat FROM aligned"
    )
    sql["actual_vs_forecast"] = (
        _with(MARKET, NAIVE)
        + """SELECT series_id, ds,
       CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ds) <= 48
         THEN 'train' ELSE 'test' END AS kind, round(y, 5) AS value FROM market
UNION ALL SELECT series_id, ds, 'predicted', round(yhat, 5) FROM naive"""
    )
    sql["param_grid"] = _with(_grid_sql()) + "SELECT * FROM grid"
    sql["param_grid_count"] = (
        _with(_grid_sql()) + "SELECT series_id, COUNT(*) AS n_trials FROM grid GROUP BY series_id"
    )
    sql["feature_minmax_stats"] = _with(PANEL) + " UNION ALL ".join(
        f"SELECT series_id, '{c}' AS feature, {_r(f'min({c})', 6, 'min_value')}, "
        f"{_r(f'max({c})', 6, 'max_value')} FROM panel GROUP BY series_id"
        for c in FEATURES
    )
    scores = _with(MARKET, NAIVE, f" s AS (SELECT series_id, {SCORES} FROM aligned GROUP BY 1)")
    sql["metric_r2"] = scores + "SELECT series_id, n, round(r2, 6) AS r2 FROM s"
    sql["metric_mae"] = (
        scores + "SELECT series_id, n, round(mae, 4) AS mae, round(mse, 4) AS mse FROM s"
    )
    sql["metric_mape"] = scores + "SELECT series_id, n, round(mape, 6) AS mape FROM s"
    sql["best_params_by_metric"] = (
        _with(SMOOTH)
        + """SELECT series_id, trial_id, "window", round(mape, 6) AS mape FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mape, trial_id) AS rn
  FROM smooth_scores) WHERE rn = 1"""
    )
    sql["union_trials"] = (
        _with(SMOOTH, NAIVE)
        + f"""SELECT series_id, trial_id, "window", n, round(mape, 6) AS mape FROM smooth_scores
UNION ALL SELECT series_id, 0, 0, n, round(mape, 6)
FROM (SELECT series_id, {SCORES} FROM aligned GROUP BY series_id)"""
    )
    sql["cv_mean_score"] = (
        _with(
            MARKET,
            NAIVE,
            f"""
folds AS (SELECT ds, ntile(5) OVER (ORDER BY ds) AS fold FROM (SELECT DISTINCT ds FROM market)),
fold_scores AS (SELECT series_id, fold, {SCORES} FROM aligned JOIN folds USING (ds) GROUP BY 1, 2)""",
        )
        + "SELECT series_id, round(avg(mape), 6) AS mean_score FROM fold_scores GROUP BY series_id"
    )
    sql["corr_prune"] = _corr_sql()
    sql["standard_scale"] = (
        _with(PANEL)
        + "SELECT series_id, ds, "
        + ", ".join(
            _r(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER ()", 6, c) for c in FEATURES
        )
        + " FROM panel"
    )
    sql["minmax_scale"] = (
        _with(PANEL)
        + f"SELECT series_id, ds, {scaled}, CAST(0 AS DOUBLE) AS x_flat FROM panel"
    )
    sql["fill_target_mean"] = (
        _with(GAPS)
        + "SELECT series_id, ds, round(y, 5) AS y, "
        "round(coalesce(x_qty, avg(y) OVER ()), 5) AS x_qty, "
        "round(coalesce(x_price, avg(y) OVER ()), 5) AS x_price FROM gaps"
    )
    sql["fill_own_mean"] = (
        _with(GAPS)
        + """SELECT series_id, ds, round(y, 5) AS y,
       round(coalesce(x_qty, avg(x_qty) OVER s), 5) AS x_qty,
       round(coalesce(x_price, avg(x_price) OVER s), 5) AS x_price,
       CAST(x_qty IS NULL AS DOUBLE) AS x_qty_missing,
       CAST(x_price IS NULL AS DOUBLE) AS x_price_missing
FROM gaps WINDOW s AS (PARTITION BY series_id)"""
    )
    sql["drop_missing"] = (
        _with(GAPS)
        + """SELECT series_id, ds, round(diff, 5) AS diff FROM (
  SELECT series_id, ds, x_qty - lag(x_qty) OVER (PARTITION BY series_id ORDER BY ds) AS diff
  FROM gaps) WHERE diff IS NOT NULL"""
    )
    sql["rolling_mean_3"] = (
        _with(GAPS)
        + """SELECT series_id, ds, round(x_qty, 5) AS y,
       round(CASE WHEN count(x_qty) OVER f = 3 THEN avg(x_qty) OVER f END, 5) AS mean_3
FROM gaps WINDOW f AS (PARTITION BY series_id ORDER BY ds ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
    )
    sql["first_difference"] = (
        _with(MARKET)
        + """SELECT series_id, ds, round(y, 5) AS y,
       round(y - lag(y) OVER (PARTITION BY series_id ORDER BY ds), 5) AS diff_1 FROM market"""
    )
    sql["lag_features"] = (
        _with(MARKET)
        + "SELECT series_id, ds, round(y, 5) AS y, "
        + ", ".join(f"round(lag(y, {i}) OVER w, 5) AS y_lag_{i}" for i in (1, 2, 3, 12))
        + " FROM market WINDOW w AS (PARTITION BY series_id ORDER BY ds)"
    )
    sql["time_split"] = (
        _with(MARKET)
        + """SELECT series_id, ds, round(y, 5) AS y,
       CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ds) <= 48
         THEN 'train' ELSE 'test' END AS split FROM market"""
    )
    sql["contiguous_folds"] = (
        _with(
            MARKET,
            """
folds AS (SELECT ds, CAST(ntile(10) OVER (ORDER BY ds) AS INTEGER) AS fold
  FROM (SELECT DISTINCT ds FROM market))""",
        )
        + "SELECT series_id, ds, round(y, 5) AS y, fold FROM market JOIN folds USING (ds)"
    )
    sql["series_folds"] = (
        _with(EVENTS)
        + "SELECT series_id, ds, event_id, CAST(ntile(10) OVER w AS INTEGER) AS fold "
        f"FROM event_rows {EVENT_WINDOW}"
    )
    sql["random_holdout"] = (
        _with(FINE)
        + """SELECT series_id, ds,
       CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', series_id, CAST(ds AS VARCHAR), '21')),
                                    series_id, ds)
            <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
FROM panel"""
    )
    sql["event_rolling_mean"] = (
        _with(EVENTS)
        + """SELECT event_id, round(CASE WHEN count(value) OVER f = 3 THEN avg(value) OVER f END, 5)
         AS mean_3
FROM event_rows WINDOW f AS (PARTITION BY series_id ORDER BY ds, event_id
  ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
    )
    sql["event_difference"] = (
        _with(EVENTS)
        + "SELECT event_id, round(value - lag(value) OVER w, 5) AS diff_1 "
        f"FROM event_rows {EVENT_WINDOW}"
    )
    sql["event_lags"] = (
        _with(EVENTS)
        + "SELECT event_id, "
        + ", ".join(f"lag(value, {i}) OVER w AS value_lag_{i}" for i in (1, 5, 24))
        + f" FROM event_rows {EVENT_WINDOW}"
    )
    sql["event_time_split"] = (
        _with(EVENTS)
        + "SELECT event_id, CASE WHEN row_number() OVER w <= "
        "count(*) OVER (PARTITION BY series_id) - 100 THEN 'train' ELSE 'test' END AS split "
        f"FROM event_rows {EVENT_WINDOW}"
    )
    sql["sort_by_date"] = (
        _with(MARKET) + "SELECT series_id, ds, round(y, 5) AS y FROM market ORDER BY ds, series_id"
    )
    sql["topk_rows"] = (
        _with(MARKET)
        + """SELECT series_id, ds, round(y, 5) AS y FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY y DESC NULLS LAST, ds) AS rn
  FROM market) WHERE rn <= 15"""
    )
    sql["densify_panel"] = (
        _with(
            """
cells AS (
  SELECT concat_ws('/', n_name, c_mktsegment) AS series_id,
         CAST(date_trunc('month', o_orderdate) AS DATE) AS ds,
         CAST(SUM(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e5 AS y
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
calendar AS (
  SELECT series_id, CAST(unnest(generate_series(min(ds), max(ds), INTERVAL 1 MONTH)) AS DATE) AS ds
  FROM cells GROUP BY series_id)"""
        )
        + "SELECT series_id, ds, round(y, 5) AS y FROM calendar LEFT JOIN cells USING (series_id, ds)"
    )
    sql["fourier_features"] = _fourier_sql()
    sql["changepoint_features"] = _changepoint_sql()
    sql["df_test_lag0"] = _with(MARKET, LAG_ZERO, _p_value_ctes("c")) + TESTED
    sql["adf_test"] = (
        _with(
            FINE,
            " input AS (SELECT series_id, ds, y FROM panel)",
            _adf_statistics(12, False, None),
            _p_value_ctes("c"),
        )
        + TESTED
    )
    sql["adf_test_difference"] = (
        _with(
            MARKET,
            """
input AS (SELECT * FROM (
  SELECT series_id, ds, y - lag(y) OVER (PARTITION BY series_id ORDER BY ds) AS y FROM market)
  WHERE y IS NOT NULL)""",
            _adf_statistics(12, False, None),
            _p_value_ctes("c"),
        )
        + TESTED
    )
    sql["should_diff"] = (
        _with(
            MARKET,
            " input AS (SELECT series_id, ds, y FROM market)",
            _adf_statistics(4, True, "floor(cbrt(n - 1) + CAST(1e-9 AS DOUBLE))"),
            _p_value_ctes("ct"),
        )
        + "SELECT series_id, round(statistic, 5) AS statistic, round(p_value, 5) AS p_value, "
        "p_value > 0.05 AS diff FROM p"
    )
    sql["seasonal_strength"] = (
        _with(MARKET, _strength("market"))
        + "SELECT series_id, round(strength, 5) AS strength, "
        "CAST(strength > 0.64 AS INTEGER) AS seasonal_d FROM strengths"
    )
    sarx_fits = [PANEL, _sarx_design(), _sarx_fits()]
    sql["sarx_order_search"] = (
        _recursive(*sarx_fits)
        + "SELECT series_id, candidate, p, q, seasonal_p, seasonal_q, round(aic, 5) AS aic FROM log"
    )
    sql["sarx_coefficients"] = (
        _recursive(*sarx_fits)
        + "SELECT series_id, term, round(coefficient, 5) AS coefficient, "
        "round(std_error, 5) AS std_error, round(coefficient / std_error, 5) AS t_value "
        "FROM coefficients"
    )
    sql["sarx_forecast"] = (
        _recursive(*sarx_fits, _sarx_path())
        + """SELECT f.series_id, f.ds, round(p.y, 5) AS y, round(path.ys[-1] * scales.ys, 3) AS yhat
FROM path JOIN future f ON f.series_id = path.series_id AND f.step = path.step
JOIN panel p ON p.series_id = f.series_id AND p.ds = f.ds
JOIN scales ON scales.series_id = f.series_id"""
    )
    one = [
        PANEL,
        _one_trial(),
        _trend_ctes("one", "one_trial", f"back > {HORIZON}", f"back <= {HORIZON}", 8, False),
    ]
    sql["trend_season_fit"] = (
        _recursive(*one)
        + """SELECT f.series_id, CAST(1 AS INTEGER) AS trial_id,
       CAST(least(8, greatest(floor(n * CAST(0.8 AS DOUBLE)) - 1, 0)) AS INTEGER) AS n_knots,
       n AS n_obs, round(sqrt(noise), 6) AS sigma
FROM one_facts f JOIN one_solved e ON e.series_id = f.series_id || '#1'"""
    )
    wide = NormalDist().inv_cdf(0.9)
    sql["trend_season_forecast"] = (
        _recursive(*one)
        + f"""SELECT series_id, ds, trial_id, round(yhat, 3) AS yhat,
       round(yhat - CAST({wide!r} AS DOUBLE) * reach, 3) AS yhat_lower,
       round(yhat + CAST({wide!r} AS DOUBLE) * reach, 3) AS yhat_upper FROM one_forecast"""
    )
    knots = max(GRID["n_changepoints"])
    grid_search = [
        PANEL,
        _all_trials(),
        _trend_ctes(
            "grid",
            "all_trials",
            f"back > {2 * HORIZON}",
            f"back BETWEEN {HORIZON + 1} AND {2 * HORIZON}",
            knots,
            True,
        ),
        f"""
grid_scores AS MATERIALIZED (
  SELECT series_id, trial_id, {SCORES} FROM grid_forecast GROUP BY series_id, trial_id)""",
    ]
    sql["forecast_grid"] = (
        _recursive(*grid_search)
        + """SELECT series_id, trial_id, tau AS changepoint_prior_scale,
       CAST(n_cp AS INTEGER) AS n_changepoints, mode AS seasonality_mode, n, round(r2, 6) AS r2,
       round(mae, 2) AS mae, round(mape, 6) AS mape, round(mse, 2) AS mse
FROM grid_scores JOIN all_trials USING (series_id, trial_id)"""
    )
    sql["best_forecast"] = (
        _recursive(
            *grid_search,
            """
best_trials AS MATERIALIZED (
  SELECT series_id, trial_id, mode, n_cp, tau FROM (
    SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY mape, trial_id) AS rn
    FROM grid_scores) JOIN all_trials USING (series_id, trial_id) WHERE rn = 1)""",
            _trend_ctes(
                "best", "best_trials", f"back > {HORIZON}", f"back <= {HORIZON}", knots, True
            ),
            f" best_scores AS (SELECT series_id, {SCORES} FROM best_forecast GROUP BY series_id)",
        )
        + """SELECT series_id, n, round(r2, 6) AS r2, round(mae, 2) AS mae, round(mape, 6) AS mape,
       round(mse, 2) AS mse FROM best_scores"""
    )
    sql["shapley_linear"] = _with(FINE, _linear_shares()) + " UNION ALL ".join(
        f"SELECT f.series_id, f.ds, '{c}' AS feature, round(f.{c}, 9) AS value, "
        f"round(b * (f.{c} - r.{c}), 4) AS phi FROM filled f, reference r, slopes "
        f"WHERE feature = '{c}'"
        for c in FEATURES
    )
    phi = _with(_phi_sql())
    sql["shap_importance"] = (
        phi + "SELECT feature, round(avg(abs(phi)), 4) AS importance FROM phi GROUP BY feature"
    )
    sql["row_decomposition"] = (
        _with(
            _phi_sql(),
            """
ranked AS (
  SELECT row_id, feature, phi,
         row_number() OVER (PARTITION BY row_id ORDER BY abs(phi) DESC, feature) AS rn,
         count(*) OVER (PARTITION BY row_id) AS n FROM phi)""",
        )
        + """SELECT row_id, CASE WHEN rn < 3 OR n <= 3 THEN feature ELSE 'other' END AS part,
       CAST(CASE WHEN rn < 3 OR n <= 3 THEN rn ELSE 3 END AS INTEGER) AS rank,
       SUM(phi) AS phi
FROM ranked GROUP BY 1, 2, 3"""
    )
    sql["phi_distribution"] = (
        phi
        + """SELECT feature, COUNT(*) AS n, round(avg(phi), 4) + CAST(0 AS DOUBLE) AS mean_phi,
       min(phi) AS min_phi, quantile_disc(phi, 0.25) AS q25_phi,
       quantile_disc(phi, 0.5) AS q50_phi, quantile_disc(phi, 0.75) AS q75_phi,
       max(phi) AS max_phi FROM phi GROUP BY feature"""
    )
    sql["phi_dependence"] = (
        _with(
            _phi_sql(),
            """
extremes AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM phi GROUP BY feature),
binned AS (
  SELECT feature, value, phi, CAST(CASE WHEN hi = lo THEN 0
      ELSE least(floor((value - lo) / ((hi - lo) / CAST(10 AS DOUBLE))), 9) END AS INTEGER) AS bin
  FROM phi JOIN extremes USING (feature))""",
        )
        + """SELECT feature, bin, COUNT(*) AS n, round(avg(value), 4) AS mean_value,
       round(avg(phi), 4) AS mean_phi FROM binned GROUP BY feature, bin"""
    )
    sql |= tree_oracles.tree_sql(FINE)
    sql |= series_oracles.series_sql(MARKET, PANEL, FINE)
    sql["scan_table"] = sql["scan_panel"]
    return sql
