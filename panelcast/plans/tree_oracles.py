"""SQL twins of the small tree queries: greedy variance splits over features of few whole values.

With fewer different values than bins every midpoint is a candidate split, so the tree is determined
by the data and can be grown level by level in SQL. Constants are written out here.
"""

from __future__ import annotations

COLUMNS = ("x_month", "x_price_k", "x_year")
NODES = """
nodes0 AS (SELECT *, 0 AS grp, 1 AS node, y AS goal FROM stump_panel)"""


def panel(fine: str) -> str:
    return f"""{fine},
stump_panel AS (
  SELECT series_id, ds, y, CAST(month(ds) AS DOUBLE) AS x_month, CAST(year(ds) AS DOUBLE) AS x_year,
         CAST(floor(coalesce(x_price, 0) / 2000) AS DOUBLE) AS x_price_k
  FROM panel)"""


def value_of(feature: str) -> str:
    cases = " ".join(f"WHEN '{c}' THEN {c}" for c in COLUMNS)
    return f"(CASE {feature} {cases} END)"


def split(rows: str, out: str, train: str = "TRUE", least: int = 1, level: int = 0) -> str:
    """CTEs: the best split per (grp, node) of the training rows, and all rows sent down by it."""
    long = " UNION ALL ".join(
        f"SELECT grp, node, '{c}' AS f, {c} AS v, goal FROM {rows} WHERE {train}" for c in COLUMNS
    )
    return f"""
{out}_values AS (SELECT grp, node, f, v, COUNT(*) AS n, SUM(goal) AS s FROM ({long}) GROUP BY grp, node, f, v),
{out}_left AS (
  SELECT grp, node, f, v, SUM(n) OVER w AS nl, SUM(s) OVER w AS sl,
         SUM(n) OVER a AS n, SUM(s) OVER a AS s FROM {out}_values
  WINDOW w AS (PARTITION BY grp, node, f ORDER BY v), a AS (PARTITION BY grp, node, f)),
{out}_best AS (
  SELECT grp, node, f, v, gain FROM (
    SELECT *, row_number() OVER (PARTITION BY grp, node ORDER BY gain DESC, f, v) AS place FROM (
      SELECT *, sl * sl / nl + (s - sl) * (s - sl) / (n - nl) - s * s / n AS gain
      FROM {out}_left WHERE nl < n AND nl >= {least} AND n - nl >= {least}))
  WHERE place = 1 AND gain > 0),
{out} AS (
  SELECT r.* EXCLUDE (node),
         CASE WHEN b.f IS NULL THEN r.node ELSE 2 * r.node + CAST({value_of('b.f')} > b.v AS INTEGER) END AS node
  FROM {rows} r LEFT JOIN {out}_best b ON r.grp = b.grp AND r.node = b.node)"""


def means(rows: str, out: str, train: str = "TRUE") -> str:
    return f"""
{out} AS (
  SELECT r.*, m.yhat FROM {rows} r JOIN (
    SELECT grp, node, avg(goal) AS yhat FROM {rows} WHERE {train} GROUP BY grp, node) m
  ON r.grp = m.grp AND r.node = m.node)"""


def tree_sql(fine: str) -> dict[str, str]:
    start = f"WITH {panel(fine)}"
    deep = f"{start},{NODES},{split('nodes0', 'nodes1')},{split('nodes1', 'nodes2')}"
    predicted = "SELECT series_id, ds, round(y, 5) AS y, round(yhat, 5) AS yhat FROM scored"
    gains = """
gains AS (
  SELECT f, SUM(gain) AS gain FROM (SELECT f, gain FROM nodes1_best UNION ALL SELECT f, gain FROM nodes2_best)
  GROUP BY f),
features AS (SELECT unnest(['x_month', 'x_price_k', 'x_year']) AS attribute),
importances AS (
  SELECT 'forest' AS model, attribute, coalesce(gain, 0) / SUM(gain) OVER () AS importance
  FROM features LEFT JOIN gains ON f = attribute)"""
    held = "split = 'train'"
    holdout = """
drawn AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws('|', series_id, CAST(ds AS VARCHAR), '21')),
                                         series_id, ds)
            <= ceil(count(*) OVER () * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split
  FROM stump_panel),
nodes0 AS (SELECT *, 0 AS grp, 1 AS node, y AS goal FROM drawn)"""
    best = """
best AS (
  SELECT f FROM (SELECT f, SUM(gain) AS gain FROM (
      SELECT f, gain FROM nodes1_best UNION ALL SELECT f, gain FROM nodes2_best) GROUP BY f)
  ORDER BY gain DESC, f LIMIT 1)"""
    # the refit sees the best feature alone
    again = f"""
alone0 AS (
  SELECT series_id, ds, y, split, goal, 0 AS grp, 1 AS node,
         {value_of('f')} AS x_month, CAST(0 AS DOUBLE) AS x_price_k, CAST(0 AS DOUBLE) AS x_year
  FROM (SELECT d.*, d.y AS goal FROM drawn d), best)"""
    scores = """
  COUNT(*) AS n, round(1 - SUM((y - yhat) * (y - yhat)) / NULLIF(var_pop(y) * COUNT(*), 0), 6) AS r2,
  round(avg(abs(y - yhat)), 6) AS mae"""
    folds = """
folded AS (
  SELECT *, CAST(ntile(3) OVER (ORDER BY ds) AS INTEGER) AS fold FROM (SELECT DISTINCT ds FROM stump_panel)),
nodes0 AS (
  SELECT p.*, fold, g AS grp, 1 AS node, y AS goal FROM stump_panel p JOIN folded USING (ds),
         (SELECT unnest([1, 2, 3]) AS g))"""
    apart = "fold <> grp"
    trial = lambda rows, number, depth: f"""
SELECT CAST({number} AS INTEGER) AS trial_id, '{depth}' AS max_depth, round(avg(r2), 6) AS mean_score FROM (
  SELECT grp, 1 - SUM((y - yhat) * (y - yhat)) / NULLIF(var_pop(y) * COUNT(*), 0) AS r2
  FROM {rows} WHERE fold = grp GROUP BY grp)"""  # noqa: E731
    return {
        "tree_predictions": f"{deep},{means('nodes2', 'scored')} {predicted}",
        "gbt_two_rounds": f"""{start},{NODES},{split('nodes0', 'nodes1')},{means('nodes1', 'first')},
rest0 AS (SELECT series_id, ds, y, x_month, x_year, x_price_k, 0 AS grp, 1 AS node, yhat AS begun,
                 2 * (y - yhat) AS goal FROM first),{split('rest0', 'rest1')},{means('rest1', 'second')}
SELECT series_id, ds, round(y, 5) AS y, round(begun + CAST(0.2 AS DOUBLE) * yhat, 5) AS yhat FROM second""",
        "gbt_alt_one_round": f"{start},{NODES},{split('nodes0', 'nodes1', least=60)},"
        f"{means('nodes1', 'scored')} {predicted}",
        "tree_importance": f"{deep},{gains} SELECT model, attribute, round(importance, 6) AS importance FROM importances",
        "tree_importance_ranked": f"""{deep},{gains}
SELECT model, attribute, round(importance, 6) AS importance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY importance DESC, attribute) AS rank FROM importances) WHERE rank <= 2""",
        "tree_topk_projection": f"""{deep},{best}
SELECT series_id, ds, f AS best_feature, {value_of('f')} AS best_value FROM stump_panel, best""",
        "tree_refit_score": f"""{start},{holdout},{split('nodes0', 'nodes1', held)},{split('nodes1', 'nodes2', held)},
{best},{again},{split('alone0', 'alone1', held)},{split('alone1', 'alone2', held)},{means('alone2', 'scored', held)}
SELECT 'forest' AS model, split, {scores}, (SELECT f FROM best) AS best_feature FROM scored GROUP BY split""",
        "shapley_tree": f"""{start},{NODES},{split('nodes0', 'nodes1')},{means('nodes1', 'scored')},
reference AS (
  SELECT avg(yhat) AS base FROM (
    SELECT yhat FROM scored ORDER BY md5(concat_ws('|', series_id, CAST(ds AS VARCHAR), '21')) LIMIT 100)),
features AS (SELECT unnest(['x_month', 'x_price_k', 'x_year']) AS feature)
SELECT series_id, ds, feature, {value_of('feature')} AS value,
       CASE WHEN feature = f THEN round(yhat - base, 4) ELSE CAST(0 AS DOUBLE) END + CAST(0 AS DOUBLE) AS phi
FROM scored, reference, features, nodes1_best""",
        "tree_search_trials": f"""{start},{folds},{split('nodes0', 'nodes1', apart)},{split('nodes1', 'nodes2', apart)},
{means('nodes1', 'one', apart)},{means('nodes2', 'two', apart)}
{trial('one', 1, 1)} UNION ALL {trial('two', 2, 2)}""",
    }
