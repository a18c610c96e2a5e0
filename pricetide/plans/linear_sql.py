"""Linear regression as SQL: the feature stages and the closed form that the models of ``operators.models`` fit."""

from __future__ import annotations

from ..operators.clean import CLIP_QUANTILES, ENCODE_MIN_COUNT, IQR_FACTOR, MIN_VALUES, NUMERIC_COLUMNS, RARE_MIN_COUNT
from . import bindings as B

LISTINGS = f"""ranked AS (
    SELECT l_partkey AS entity, l_extendedprice AS price, l_quantity AS area_total, l_linenumber AS baths, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
           row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) AS rn FROM lineitem),
listings AS (
    SELECT entity, month, p_brand AS district, p_type AS kind, price, area_total, CASE WHEN entity % 3 = 0 THEN 0.0 ELSE area_total END AS area_private,
           CAST(p_size % 5 + 1 AS INTEGER) AS rooms, baths, CAST(entity % 4 AS INTEGER) AS parking, CASE WHEN {B.uniform_sql('entity', "'42'")} < 0.2 THEN 'test' ELSE 'train' END AS part
    FROM ranked JOIN part ON p_partkey = entity WHERE rn = 1)"""


def _fences(source: str) -> str:
    """``marked``: ``source`` with its price per area and whether it lies inside the fences of its kind's train part."""
    inside = []
    picks = []
    for c in ("price", "price_m2"):
        q1, q3 = f"{c}_q1", f"{c}_q3"
        picks.append(f"quantile_cont({c}, 0.25) FILTER ({c} > 0) AS {q1}, quantile_cont({c}, 0.75) FILTER ({c} > 0) AS {q3}, count(*) FILTER ({c} > 0) AS {c}_n")
        bounds = f"{c} BETWEEN {q1} - {IQR_FACTOR} * ({q3} - {q1}) AND {q3} + {IQR_FACTOR} * ({q3} - {q1})"
        inside.append(f"coalesce(CASE WHEN {c}_n >= {MIN_VALUES} AND {q3} > {q1} THEN {bounds} END, true)")
    return f"""shaped AS (SELECT *, price / CASE WHEN area_private > 0 THEN area_private WHEN area_total > 0 THEN area_total END AS price_m2 FROM {source}),
fences AS (SELECT kind, {", ".join(picks)} FROM shaped WHERE part = 'train' GROUP BY kind),
marked AS (SELECT s.*, {" AND ".join(inside)} AS typical FROM shaped s JOIN fences f ON f.kind = s.kind)"""


_bounds = ", ".join(
    f"CASE WHEN count(*) FILTER ({c} > 0) >= {MIN_VALUES} THEN quantile_cont({c}, {p}) FILTER ({c} > 0) END AS {c}_{name}" for c in NUMERIC_COLUMNS for name, p in zip(("lo", "hi"), CLIP_QUANTILES)
)
_held = ", ".join(f"CASE WHEN b.{c}_lo IS NOT NULL THEN greatest(b.{c}_lo, least(b.{c}_hi, CAST(a.{c} AS DOUBLE))) ELSE CAST(a.{c} AS DOUBLE) END AS {c}" for c in NUMERIC_COLUMNS)
PREPARED = f"""{LISTINGS},
rare AS (SELECT kind, district FROM listings WHERE part = 'train' GROUP BY 1, 2 HAVING count(*) < {RARE_MIN_COUNT}),
bounds AS (SELECT kind, {_bounds} FROM listings WHERE part = 'train' GROUP BY kind),
held AS (
    SELECT a.entity, a.month, a.kind, CASE WHEN r.kind IS NOT NULL THEN 'outros' ELSE a.district END AS district, a.price, a.part, {_held}
    FROM listings a JOIN bounds b ON b.kind = a.kind LEFT JOIN rare r ON r.kind = a.kind AND r.district = a.district),
{_fences('held')},
prepared AS (SELECT * FROM marked WHERE part = 'test' OR typical)"""
PLAIN = f"{LISTINGS},\n{_fences('listings')}"

AREA = "(CASE WHEN area_private > 0 THEN area_private WHEN area_total > 0 THEN area_total ELSE 1.0 END)"
TARGETS = {"price": "price", "log": "ln(1 + price)", "per_area": f"price / {AREA}"}
PRICES = {"price": "raw", "log": "exp(greatest(0.0, least(21.0, raw))) - 1", "per_area": f"raw * {AREA}"}


def features(given: str, numeric: tuple = NUMERIC_COLUMNS) -> str:
    """``x`` (g, role, entity, i, v): the features of ``given`` (g, role, entity, columns), learned from its rows of role 'fit'.

    The first features are the standardised numbers, then comes the constant, the rest are indicators of categories seen in 'fit'.
    """
    constant = len(numeric) + 1
    moments = ", ".join(f"avg({c}) AS m_{c}, coalesce(stddev_samp({c}), 0) AS s_{c}" for c in numeric)
    numbers = " UNION ALL ".join(
        f"SELECT g, role, entity, {k} AS i, CASE WHEN s_{c} > 0 THEN ({c} - m_{c}) / s_{c} ELSE 0.0 END AS v FROM {given} JOIN moments USING (g)" for k, c in enumerate(numeric, 1)
    )
    return f"""moments AS (SELECT g, {moments} FROM {given} WHERE role = 'fit' GROUP BY g),
cats AS (SELECT DISTINCT g, 'district' AS c, district AS name FROM {given} WHERE role = 'fit' UNION SELECT DISTINCT g, 'kind', kind FROM {given} WHERE role = 'fit'),
ids AS (SELECT g, c, name, {constant} + row_number() OVER (PARTITION BY g ORDER BY c, name) AS i FROM cats),
x AS (
    {numbers} UNION ALL SELECT g, role, entity, {constant}, 1.0 FROM {given}
    UNION ALL SELECT r.g, role, entity, i, 1.0 FROM {given} r JOIN ids ON ids.g = r.g AND c = 'district' AND name = district
    UNION ALL SELECT r.g, role, entity, i, 1.0 FROM {given} r JOIN ids ON ids.g = r.g AND c = 'kind' AND name = kind)"""


def _system(given: str, alpha: float, numeric: tuple) -> str:
    """``start`` (g, d, m): normal equations of ``given`` with the target in ``y`` as d lines of d + 1 numbers, ``alpha`` on every coefficient but the constant."""
    return f"""{features(given, numeric)},
fx AS (SELECT g, entity, i, v FROM x WHERE role = 'fit'),
xtx AS (SELECT a.g, a.i, b.i AS j, sum(a.v * b.v) AS s FROM fx a JOIN fx b ON a.g = b.g AND a.entity = b.entity GROUP BY ALL),
xty AS (SELECT fx.g, i, sum(v * y) AS t FROM fx JOIN {given} r ON r.g = fx.g AND r.entity = fx.entity AND r.role = 'fit' GROUP BY ALL),
dims AS (SELECT g, max(i) AS d FROM fx GROUP BY g),
cells AS (SELECT g, i, unnest(range(1, d + 1)) AS j FROM (SELECT g, d, unnest(range(1, d + 1)) AS i FROM dims)),
lines AS (SELECT cells.g, cells.i, list(coalesce(s, 0) + CASE WHEN cells.i = cells.j AND cells.i <> {len(numeric) + 1} THEN {alpha} ELSE 0 END ORDER BY cells.j) AS line
    FROM cells LEFT JOIN xtx ON xtx.g = cells.g AND xtx.i = cells.i AND xtx.j = cells.j GROUP BY ALL),
start AS (SELECT lines.g, count(*) AS d, list(list_append(line, coalesce(t, 0)) ORDER BY lines.i) AS m FROM lines LEFT JOIN xty ON xty.g = lines.g AND xty.i = lines.i GROUP BY lines.g)"""


RAW = "raw AS (SELECT x.g, entity, sum(v * w) AS raw FROM x JOIN weights ON weights.g = x.g AND weights.i = x.i WHERE role = 'eval' GROUP BY ALL)"


def ridge(given: str, alpha: float = 5.0, numeric: tuple = NUMERIC_COLUMNS) -> str:
    """``raw`` (g, entity, raw): predictions for rows of role 'eval', from ``given`` with the target in ``y``.

    The normal equations are solved by elimination, one step for each column.
    """
    return f"""{_system(given, alpha, numeric)},
steps AS (
    SELECT g, d, 0 AS k, m FROM start
    UNION ALL
    SELECT g, d, k + 1, list_transform(m, lambda line, r: CASE WHEN r = k + 1 THEN list_transform(line, lambda v: v / line[k + 1])
        ELSE list_transform(line, lambda v, c: v - line[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END) FROM steps WHERE k < d),
weights AS (SELECT g, i, m[i][d + 1] AS w FROM (SELECT g, d, m, unnest(range(1, d + 1)) AS i FROM steps WHERE k = d)),
{RAW}"""


def lasso(given: str, alpha: float = 0.0005, sweeps: int = 200, numeric: tuple = NUMERIC_COLUMNS) -> str:
    """``raw`` like ``ridge``'s, for half the mean squared error plus ``alpha`` times the absolute coefficients.

    Coordinate descent: a step sets one coefficient to its best value beside the others, ``sweeps`` times around.
    """
    constant = len(numeric) + 1
    return f"""{_system(given, 0.0, numeric)},
sizes AS (SELECT g, count(*) AS n FROM {given} WHERE role = 'fit' GROUP BY g),
steps AS (
    SELECT g, 0 AS k, list_transform(range(d), lambda i: 0.0::DOUBLE) AS w FROM start
    UNION ALL
    SELECT g, k + 1, list_transform(w, lambda v, i: CASE WHEN i <> j THEN v WHEN line[j] <= 1e-9 THEN 0.0 ELSE sign(r) * greatest(abs(r) - l, 0.0) / line[j] END)
    FROM (
        SELECT g, k, w, j, line, line[d + 1] - list_dot_product(line[1:d], w) + line[j] * w[j] AS r, CASE WHEN j = {constant} THEN 0.0 ELSE {alpha} * n END AS l
        FROM (SELECT s.g, k, w, d, n, k % d + 1 AS j, m[k % d + 1] AS line FROM steps s JOIN start USING (g) JOIN sizes USING (g) WHERE k < {sweeps} * d))),
weights AS (SELECT g, i, w[i] AS w FROM (SELECT s.g, w, unnest(range(1, d + 1)) AS i FROM steps s JOIN start USING (g) WHERE k = {sweeps} * d)),
{RAW}"""


def scores(predicted: str, keys: str) -> str:
    """Metrics of ``predicted`` (keys, price, typical, y_pred), for all rows and the typical ones."""
    by = f"{keys}, rows" if keys else "rows"
    return f"""SELECT {by}, round(avg(abs(price - y_pred)), 0) AS mae, round(sqrt(avg(pow(price - y_pred, 2))), 0) AS rmse,
    round(1 - sum(pow(price - y_pred, 2)) / (var_pop(price) * count(*)), 4) AS r2, round(100 * avg(abs((price - y_pred) / price)), 2) AS mape, count(*) AS n,
    round(100 * avg(CASE WHEN abs(y_pred - price) / price * 100 <= 10 THEN 1.0 ELSE 0.0 END), 2) AS within_10_pct,
    round(100 * avg(CASE WHEN abs(y_pred - price) / price * 100 <= 20 THEN 1.0 ELSE 0.0 END), 2) AS within_20_pct,
    round(quantile_cont(abs(y_pred - price) / price * 100, 0.5), 2) AS mdape
FROM (SELECT *, unnest(CASE WHEN typical THEN ['full', 'typical'] ELSE ['full'] END) AS rows FROM {predicted}) GROUP BY {by}"""


def single(target: str, solved: str = ridge("given")) -> str:
    """One model on the prepared listings, scored on the test part by kind; ``solved`` makes ``raw`` from ``given``."""
    return f"""WITH RECURSIVE {PREPARED},
given AS (SELECT 1 AS g, CASE part WHEN 'train' THEN 'fit' ELSE 'eval' END AS role, {TARGETS[target]} AS y, * FROM prepared),
{solved},
predicted AS (SELECT kind, price, typical, {PRICES[target]} AS y_pred FROM given JOIN raw USING (g, entity) WHERE role = 'eval')
{scores('predicted', 'kind')}"""


ENCODED = f"""WITH {PREPARED},
given AS (SELECT 1 AS g, CASE part WHEN 'train' THEN 'fit' ELSE 'eval' END AS role, * FROM prepared UNION ALL SELECT 2, 'eval', * FROM prepared WHERE false),
{features('given')},
width AS (SELECT CAST(5 + count(*) AS INTEGER) AS width FROM ids)
SELECT entity, any_value(width) AS width, round(sum(v) - 1, 8) AS total FROM x, width GROUP BY entity"""

SCENARIOS = f"""WITH RECURSIVE {PLAIN},
models(scenario, only_typical, target) AS (VALUES ('1 single model', false, 'price'), ('2 model per kind', false, 'price'), ('3 without outliers', true, 'price'), ('4 without outliers, log price', true, 'log')),
given AS (
    SELECT CASE WHEN scenario LIKE '2%' THEN scenario || '|' || kind ELSE scenario END AS g, CASE part WHEN 'train' THEN 'fit' ELSE 'eval' END AS role, scenario, target,
           CASE target WHEN 'log' THEN {TARGETS['log']} ELSE price END AS y, marked.* FROM marked CROSS JOIN models WHERE part = 'test' OR typical OR NOT only_typical),
{ridge('given')},
predicted AS (SELECT scenario, price, typical, CASE target WHEN 'log' THEN {PRICES['log']} ELSE raw END AS y_pred FROM given JOIN raw USING (g, entity) WHERE role = 'eval')
{scores('predicted', 'scenario')}"""


def least_squares(given: str, columns: list[str], target: str) -> str:
    """feature, coefficient of an unpenalised fit with a constant on complete rows."""
    names = [*columns, "intercept"]
    d = len(names)
    value = {**{c: c for c in columns}, "intercept": "1.0"}
    lines = ", ".join("[" + ", ".join([*(f"sum({value[a]} * {value[b]})" for b in names), f"sum({value[a]} * {target})"]) + "]" for a in names)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in (*columns, target))
    out = " UNION ALL ".join(f"SELECT '{n}' AS feature, m[{i}][{d + 1}] AS coefficient FROM steps WHERE k = {d}" for i, n in enumerate(names, 1))
    return f"""steps AS (
    SELECT 0 AS k, [{lines}] AS m FROM {given} WHERE {complete}
    UNION ALL
    SELECT k + 1, list_transform(m, lambda line, r: CASE WHEN r = k + 1 THEN list_transform(line, lambda v: v / line[k + 1])
        ELSE list_transform(line, lambda v, c: v - line[k + 1] * m[k + 1][c] / m[k + 1][k + 1]) END) FROM steps WHERE k < {d})
SELECT feature, round(coefficient, 5) AS coefficient FROM ({out})"""


# The indicators of a category add up to the constant, so plain least squares has many solutions with the same predictions;
# a penalty far below the rounding picks one.
NO_PENALTY = 1e-7

VARIANTS = f"""WITH RECURSIVE {B.LEVELS}, {PREPARED},
ref AS (SELECT coalesce(max(index_level) FILTER (month = DATE '2001-08-01'), max(index_level)) AS v FROM levels),
factored AS (SELECT p.*, coalesce(ref.v / l.index_level, 1.0) AS inflation_factor, {AREA} AS area FROM prepared p CROSS JOIN ref LEFT JOIN levels l ON l.month = p.month),
per AS (SELECT district, quantile_cont(price / area, 0.5) AS encoded FROM factored WHERE part = 'train' GROUP BY district HAVING count(*) >= {ENCODE_MIN_COUNT}),
overall AS (SELECT quantile_cont(price / area, 0.5) AS encoded FROM factored WHERE part = 'train'),
variants(variant, by_district, by_area, moved) AS (VALUES ('base', false, false, false), ('district', true, false, false), ('m2', false, true, false),
    ('district+m2', true, true, false), ('inflation', false, false, true)),
given AS (
    SELECT variant AS g, CASE part WHEN 'train' THEN 'fit' ELSE 'eval' END AS role, by_area, moved, f.*, CASE WHEN by_district THEN coalesce(per.encoded, overall.encoded) ELSE 0.0 END AS district_m2,
           price * CASE WHEN moved THEN inflation_factor ELSE 1.0 END / CASE WHEN by_area THEN area ELSE 1.0 END AS y
    FROM factored f LEFT JOIN per USING (district) CROSS JOIN overall CROSS JOIN variants),
{ridge('given', numeric=(*NUMERIC_COLUMNS, "district_m2"))},
predicted AS (
    SELECT g AS variant, price, typical, raw * CASE WHEN by_area THEN area ELSE 1.0 END / CASE WHEN moved THEN inflation_factor ELSE 1.0 END AS y_pred
    FROM given JOIN raw USING (g, entity) WHERE role = 'eval')
{scores('predicted', 'variant')}"""


def backcast_rows(years: list[int]) -> str:
    """``today``: listings at the newest month; ``history``: those of the train part and their past, numbered in ``entity``."""
    now = "year((SELECT m FROM newest)) + (month((SELECT m FROM newest)) - 0.5) / 12.0"
    return f"""{B.LEVELS}, {PREPARED},
lim AS (SELECT min(month) AS lo, max(month) AS hi FROM levels),
newest AS (SELECT max(month) AS m FROM prepared),
ref_level AS (SELECT index_level AS v FROM levels, lim, newest WHERE levels.month = greatest(lo, least(m, hi))),
today AS (
    SELECT p.* EXCLUDE (price, entity), p.entity AS part_id, p.entity * 10000 AS entity, price * ((SELECT v FROM ref_level) / x.index_level) AS price, {now} AS year, 0 AS simulated
    FROM prepared p CROSS JOIN lim JOIN levels x ON x.month = greatest(lim.lo, least(p.month, lim.hi))),
past AS (
    SELECT t.* EXCLUDE (price, entity, year, simulated), t.entity + y.y AS entity, t.price / ((SELECT v FROM ref_level) / x.index_level) AS price, y.y + 5.5 / 12.0 AS year, 1 AS simulated
    FROM today t CROSS JOIN (SELECT unnest({years}) AS y) y CROSS JOIN lim JOIN levels x ON x.month = greatest(lim.lo, least(make_date(y.y, 6, 1), lim.hi)) WHERE t.part = 'train'),
history AS (SELECT * FROM today WHERE part = 'train' UNION ALL BY NAME SELECT * FROM past)"""


def backcast_training(years: list[int], folds: int) -> str:
    """Out-of-fold errors of real rows by kind, learned from real and simulated rows of the other folds."""
    return f"""WITH RECURSIVE {backcast_rows(years)},
folded AS (SELECT *, CAST(floor({B.uniform_sql('part_id', "'folds'")} * {folds}) AS INTEGER) AS fold FROM history),
given AS (
    SELECT k.fold AS g, CASE WHEN f.fold = k.fold THEN 'eval' ELSE 'fit' END AS role, {TARGETS['log']} AS y, f.* FROM folded f CROSS JOIN (SELECT DISTINCT fold FROM folded) k
    WHERE f.fold <> k.fold OR simulated = 0),
{ridge('given', numeric=(*NUMERIC_COLUMNS, "year"))},
predicted AS (SELECT kind, price, true AS typical, {PRICES['log']} AS y_pred FROM given JOIN raw USING (g, entity) WHERE role = 'eval')
SELECT 'ridge(log)' AS model, * EXCLUDE (rows) FROM ({scores('predicted', 'kind')}) WHERE rows = 'full'"""


def implied_past(years: list[int], asked: list[int]) -> str:
    """Spread of the annual rates that a model of ``history`` implies between each asked year and the newest month."""
    return f"""WITH RECURSIVE {backcast_rows(years)},
tested AS (
    SELECT today.* EXCLUDE (entity, year), entity + a.k AS entity, year AS now, coalesce(a.y + 5.5 / 12.0, year) AS year
    FROM today CROSS JOIN (SELECT unnest(range(0, {len(asked) + 1})) AS k, unnest([NULL, {', '.join(map(str, asked))}]) AS y) a WHERE part = 'test'),
given AS (SELECT 1 AS g, 'fit' AS role, {TARGETS['log']} AS y, *, NULL AS now FROM history UNION ALL BY NAME SELECT 1 AS g, 'eval' AS role, NULL AS y, * FROM tested),
{ridge('given', numeric=(*NUMERIC_COLUMNS, "year"))},
predicted AS (SELECT part_id, kind, now, year, {PRICES['log']} AS price FROM given JOIN raw USING (g, entity) WHERE role = 'eval'),
rates AS (
    SELECT p.kind, p.year, 100 * (pow(p.price / t.price, -1.0 / (p.now - p.year)) - 1) AS r
    FROM predicted p JOIN predicted t ON t.part_id = p.part_id AND t.year = t.now WHERE p.year < p.now AND p.price > 0 AND t.price > 0)
SELECT kind, round(year, 4) AS year, count(*) AS n, round(min(r), 4) AS min, round(quantile_cont(r, 0.1), 4) AS p10, round(quantile_cont(r, 0.5), 4) AS median, round(avg(r), 4) AS mean,
       round(quantile_cont(r, 0.9), 4) AS p90, round(max(r), 4) AS max
FROM rates GROUP BY 1, 2"""
