"""Queries of trends, regression, standardized frames and study labels."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import labels, scalars
from ..functions.distributions import t_two_sided_p
from ..operators import climate, filters, joins, regression, rows, trend
from ..operators.trend import ROUNDING
from ..operators.waves import WAVE_MEASURES
from . import site_trends, standins as s
from .catalog import query, r, rounded, rs
from .queries_climate import wave_table
from .standins import table, with_ctes


def t_tail(t: str, df: str) -> str:
    """SQL of the two-sided Student-t tail for integer df (finite sum over list elements)."""
    theta, c2 = f"atan(abs({t}) / sqrt({df}))", f"pow(cos(atan(abs({t}) / sqrt({df}))), 2)"
    term = "list_product([ ({c2}) * (2 * j - 1 + {o}) / (2 * j + {o}) for j in range(1, k + 1) ])".format(c2=c2, o="{o}")
    total = "(1.0::DOUBLE + coalesce(list_sum([ " + term + " for k in range(1, ({df} - {two}) // 2 + 1) ]), 0))"
    even = f"sin({theta}) * " + total.format(o=0, df=df, two=2)
    odd = (f"{2 / math.pi!r}::DOUBLE * ({theta} + CASE WHEN {df} > 1 THEN sin({theta}) * cos({theta}) * "
           + total.format(o=1, df=df, two=3) + " ELSE 0 END)")
    return f"greatest(0, 1 - CASE WHEN {df} % 2 = 1 THEN {odd} ELSE {even} END)"


def t_tail_series(t: str, df: str) -> str:
    """SQL of the same tail as a series of positive terms, which loses no digits however small it is.

    For small t the series is slow, and there the finite sum is exact enough.
    """
    a, x = f"({df} / 2.0::DOUBLE)", f"({df} / ({df} + {t} * {t}))"
    terms = f"[exp(lgamma(n + 0.5) - lgamma(n + 1) - lgamma(0.5) + n * ln({x})) / ({a} + n) for n in range(0, 8000)]"
    return (f"exp({a} * ln({x}) + lgamma({a} + 0.5) - lgamma({a}) - lgamma(0.5)) * list_sum({terms})")


def _resid(n: str, sxx: str, syy: str, sxy: str, ax: str, ay: str) -> str:
    """SQL of the residual sum, never less than its rounding error."""
    noise = (f"{n} * {ROUNDING!r}::DOUBLE * ({syy} + abs({ay}) * sqrt({n} * {syy})"
             f" + abs({ax}) * sqrt({n} / {sxx}) * {syy})")
    return f"(CASE WHEN {syy} > 0 THEN greatest({syy} - {sxy} * {sxy} / {sxx}, {noise}) ELSE 0 END)"


_MOMENTS = ("count", "sxx", "syy", "sxy", "avgx", "avgy")


def _trend_sql(source: str, keys: str, x: str, y: str) -> str:
    """SQL of estimate, std.error, statistic, p.value, n per group."""
    return f"""
, m AS (SELECT {keys}, regr_count({y}, {x})::BIGINT AS n, regr_sxx({y}, {x}) AS sxx, regr_syy({y}, {x}) AS syy,
   regr_sxy({y}, {x}) AS sxy, regr_avgx({y}, {x}) AS ax, regr_avgy({y}, {x}) AS ay FROM {source} GROUP BY {keys})
, b AS (SELECT *, CASE WHEN sxx > 1e-9 THEN sxy / sxx END AS est FROM m)
, f AS (SELECT {keys}, n, est, CASE WHEN n > 2 AND sxx > 1e-9 THEN
   sqrt({_resid("n", "sxx", "syy", "sxy", "ax", "ay")} / ((n - 2) * sxx)) END AS se FROM b)
, t AS (SELECT {keys}, n, est, se, est / nullif(se, 0) AS t FROM f)"""


@query("group_trend", with_ctes("series", _trend_sql("series", "cell", '"Year"', '"tempC"') + f"""
SELECT cell, n, {r("est", "estimate", 8)}, {r("se", "std.error", 8)}, {r("t", "statistic")},
  {r('CASE WHEN n > 2 AND t IS NOT NULL THEN ' + t_tail("t", "(n - 2)") + ' END', "p.value", 8)} FROM t"""))
def group_trend(spark, folder):
    fit = trend.group_trend(s.series(spark, folder), ["cell"], "Year", "tempC")
    return rounded(fit.select("cell", "n", "estimate", F.col("`std.error`"), "statistic", F.col("`p.value`")), 8, statistic=6)


@query("trend_p_values", with_ctes("survey", _trend_sql("survey", '"Site"', '"Year"', "y") + f"""
SELECT "Site", n, {r("t", "statistic", 5)},
  {r('CASE WHEN n > 2 AND t IS NOT NULL THEN ' + t_tail("t", "(n - 2)") + ' END', "p.value")} FROM t"""))
def trend_p_values(spark, folder):
    survey = s.survey(spark, folder).select("Site", "Year", "y")
    fit = trend.group_trend(survey, ["Site"], "Year", "y")
    return rounded(fit.select("Site", "n", "statistic", F.col("`p.value`")), 6, statistic=5)


@query("student_t_tail", f"""
WITH g AS (SELECT l_linenumber + l_orderkey % 40 AS nu, l_quantity / 10 AS t FROM lineitem)
, d AS (SELECT DISTINCT nu, t FROM g) SELECT nu, t, {r(t_tail("t", "nu"), "p", 9)} FROM d""")
def student_t_tail(spark, folder):
    pairs = table(spark, folder, "lineitem").select(
        (F.col("l_linenumber") + F.pmod("l_orderkey", F.lit(40))).alias("nu"), (F.col("l_quantity") / 10).alias("t")
    ).distinct()
    return pairs.withColumn("p", F.round(t_two_sided_p("t", "nu"), 9))


@query("student_t_far_tail", f"""
WITH g AS (SELECT DISTINCT 0.8::DOUBLE * p_size AS t, 1 + (p_partkey * 37) % 5000 AS nu FROM part)
SELECT nu, t, {r(f'log10(CASE WHEN t * t < 0.01 * nu THEN {t_tail("t", "nu")} ELSE {t_tail_series("t", "nu")} END)', "log_p", 7)} FROM g
WHERE t * t >= 0.01 * nu OR nu <= 400""")
def student_t_far_tail(spark, folder):
    """Tails down to 1e-300: t from 0.8 to 40, up to 5,000 degrees of freedom.

    Pairs with many degrees of freedom and t near zero are left to ``student_t_tail``: there
    the SQL has no exact form of its own.
    """
    pairs = table(spark, folder, "part").select(
        (F.col("p_size") * 0.8).alias("t"), (F.pmod(F.col("p_partkey") * 37, F.lit(5000)) + 1).alias("nu")).distinct()
    kept = pairs.where((F.col("t") * F.col("t") >= 0.01 * F.col("nu")) | (F.col("nu") <= 400))
    return kept.withColumn("log_p", F.round(F.log10(t_two_sided_p("t", "nu")), 7))


def _paired_sql(prefixes: dict[str, str], source: str, keys: str, at_least: int | None = None, gate: str = "") -> str:
    parts = []
    for p, y in prefixes.items():
        n, sxx, syy, sxy, ax, ay = (f'regr_{k}({y}, "Year")' for k in _MOMENTS)
        ok = f"{sxx} > 1e-9"
        parts.append(r(f"CASE WHEN {ok} THEN {sxy} / {sxx} END", f"{p}_estimate", 7))
        parts.append(r(f"CASE WHEN {n} > 2 AND {ok} THEN sqrt({_resid(n, sxx, syy, sxy, ax, ay)} / (({n} - 2) * {sxx})) END",
                       f"{p}_std.error", 7))
    having = f" HAVING count({gate}) >= {at_least}" if at_least else ""
    return f"SELECT {keys}, {', '.join(parts)} FROM {source} GROUP BY {keys}{having}"


_ANNUAL = """, annual AS (SELECT cell, "Year", avg("tempC") AS mean_tempC, max("tempC") AS max_tempC,
  stddev_samp("tempC") AS sd_tempC FROM series GROUP BY 1, 2)"""
_MERGED = _ANNUAL + """, merged AS (SELECT s."SiteName", s."Year", s.cell, mean_tempC, max_tempC, sd_tempC FROM survey s
  LEFT JOIN annual a ON s.cell = a.cell AND s."Year" = a."Year")"""
_TEMP = {"max_temp_slope": "max_tempC", "mean_temp_slope": "mean_tempC"}


def _survey_by_site(spark, folder):
    """The survey with the site as its name, as the prior table has it."""
    return s.survey(spark, folder).withColumn("SiteName", F.col("Site"))


@query("site_temperature_trends", with_ctes("survey series", _MERGED + f"""
, tr AS ({_paired_sql(_TEMP, "merged", '"SiteName"')})
, sd AS (SELECT "SiteName", {r("avg(sd_tempC)", "avg_sd_tempC")} FROM merged GROUP BY 1)
SELECT tr.*, "avg_sd_tempC" FROM tr JOIN sd ON tr."SiteName" = sd."SiteName" """))
def site_temperature_trends(spark, folder):
    out = site_trends.temperature_trends(s.survey(spark, folder), s.series(spark, folder), ["cell"])
    return rounded(out.select(
        "SiteName", *[F.col(f"`{p}_{c}`") for p in _TEMP for c in ("estimate", "std.error")], "avg_sd_tempC"
    ), 7, avg_sd_tempC=6)


def _slots(measures) -> str:
    out = []
    for v in measures:
        n, sxx, syy, sxy, ax, ay = (f'regr_{k}({v}, "Year")' for k in _MOMENTS)
        est = f"CASE WHEN {sxx} > 1e-9 THEN {sxy} / {sxx} END"
        se = (f"CASE WHEN {n} > 2 AND {sxx} > 1e-9 THEN "
              f"sqrt({_resid(n, sxx, syy, sxy, ax, ay)} / (({n} - 2) * {sxx})) END")
        out.append(r(f"sign({est}) * ln(1 + abs({est}))", f"{v}_estimate", 7))
        out.append(r(f"ln(1 + {se})", f"{v}_std.error", 5))
    return ", ".join(out)


def _signed_log(name: str):
    """The measures span seven orders of magnitude; shown on a signed log scale."""
    x = F.col(f"`{name}`")
    return (F.signum(x) * F.log1p(F.abs(x))).alias(name)


def _survey_waves(spark, folder):
    waves = wave_table(spark, folder).select("Year", "Latitude", "Longitude", *WAVE_MEASURES)
    survey = _survey_by_site(spark, folder).select("SiteName", "Latitude", "Longitude", "Year")
    return joins.rounded_coord_join(survey, waves, also=["Year"])


@query("wave_trends", with_ctes("survey wave_frame", f"""
, sw AS (SELECT s."Site" AS "SiteName", s."Latitude", s."Longitude", s."Year", {", ".join(WAVE_MEASURES)} FROM survey s
  JOIN wave_frame w ON s."Latitude" = w."Latitude" AND s."Longitude" = w."Longitude" AND s."Year" = w."Year"
  WHERE total_wave_energy IS NOT NULL)
SELECT "SiteName", {_slots(WAVE_MEASURES)} FROM sw GROUP BY "SiteName", "Latitude", "Longitude" """))
def wave_trends(spark, folder):
    out = site_trends.wave_trends(_survey_waves(spark, folder), WAVE_MEASURES)
    return rounded(out.select(
        "SiteName", *[_signed_log(f"{v}_{c}") for v in WAVE_MEASURES for c in ("estimate", "std.error")]
    ), 7, **{f"{v}_std.error": 5 for v in WAVE_MEASURES})


@query("merged_site_trends", with_ctes("survey series prior_slopes", _MERGED.replace('s."SiteName"', 's."Site" AS "SiteName"') + f"""
, tr AS ({_paired_sql(_TEMP, "merged", '"SiteName"')})
, sd AS (SELECT "SiteName", {r("avg(sd_tempC)", "avg_sd_tempC")} FROM merged GROUP BY 1)
SELECT p."SiteName", {rs("mean se", 7)}, tr.* EXCLUDE ("SiteName"), "avg_sd_tempC" FROM prior_slopes p
LEFT JOIN tr ON p."SiteName" = tr."SiteName" LEFT JOIN sd ON p."SiteName" = sd."SiteName" WHERE parameter = 'site_slope'"""))
def merged_site_trends(spark, folder):
    temperature = site_trends.temperature_trends(_survey_by_site(spark, folder), s.series(spark, folder), ["cell"])
    out = site_trends.merged_site_trends(s.prior_slopes(spark, folder), temperature)
    return rounded(out.select(
        "SiteName", "mean", "se", *[F.col(f"`{p}_{c}`") for p in _TEMP for c in ("estimate", "std.error")], "avg_sd_tempC"
    ), 7, avg_sd_tempC=6)


_MANY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _many_sql() -> str:
    digits = {"l_extendedprice": 3}
    out = []
    for v in _MANY:
        n, sxx, syy, sxy = (f"regr_{k}({v}, y)" for k in ("count", "sxx", "syy", "sxy"))
        out.append(r(f"{sxy} / {sxx}", f"{v}_estimate", digits.get(v, 8)))
        out.append(r(f"sqrt(({syy} - {sxy} * {sxy} / {sxx}) / (({n} - 2) * {sxx}))", f"{v}_std.error", digits.get(v, 8)))
    return f"SELECT l_suppkey, {', '.join(out)} FROM (SELECT *, year(l_shipdate) AS y FROM lineitem) GROUP BY 1"


@query("many_variable_trends", _many_sql())
def many_variable_trends(spark, folder):
    lineitem = table(spark, folder, "lineitem").withColumn("Year", F.year("l_shipdate"))
    out = trend.multi_trend(lineitem, ["l_suppkey"], "Year", _MANY)
    cols = [f"{v}_{c}" for v in _MANY for c in ("estimate", "std.error")]
    return rounded(out.select("l_suppkey", *[F.col(f"`{c}`") for c in cols]), 8,
                   **{c: 3 for c in cols if "price" in c})


_POINT_YEAR = _ANNUAL + """, py AS (SELECT DISTINCT s."Latitude", s."Longitude", s."Year", mean_tempC, max_tempC
  FROM survey s LEFT JOIN annual a ON s.cell = a.cell AND s."Year" = a."Year")"""


def _point_years(spark, folder):
    """One row per place and surveyed year, the year's temperature possibly missing."""
    annual = climate.annual_summary(s.series(spark, folder), ["cell", "Year"])
    survey = s.survey(spark, folder).select("obs_id", "Latitude", "Longitude", "Year", "cell")
    merged = joins.natural_join(survey, annual, ["cell", "Year"], "left")
    return rows.first_row(merged, ["Latitude", "Longitude", "Year"], ["obs_id"])


@query("sampled_trend", with_ctes("survey series", _POINT_YEAR + f"""
, s1 AS ({_paired_sql({"max": "max_tempC", "mean": "mean_tempC"}, "py", '"Latitude", "Longitude"', 3, "mean_tempC")})
SELECT {rs("Latitude Longitude", 7)}, s1.* EXCLUDE ("Latitude", "Longitude") FROM s1"""))
def sampled_trend(spark, folder):
    out = trend.sampled_trend(_point_years(spark, folder), ["Latitude", "Longitude"], "Year", "mean_tempC",
                              {"max": "max_tempC", "mean": "mean_tempC"})
    return rounded(out, 7)


@query("long_term_trend", with_ctes("series", _ANNUAL + "," + f"""
x AS (SELECT * FROM annual WHERE mean_tempC IS NOT NULL) {_paired_sql({"max": "max_tempC", "mean": "mean_tempC"}, "x", "cell")}"""))
def long_term_trend(spark, folder):
    annual = climate.annual_summary(s.series(spark, folder), ["cell", "Year"])
    return rounded(trend.long_term_trend(annual, ["cell"], "Year", "mean_tempC", {"max": "max_tempC", "mean": "mean_tempC"}), 7)


@query("facet_trend", f"""
SELECT l_returnflag, l_linestatus, {r("regr_intercept(l_quantity, l_discount)", "intercept")},
  {r("regr_slope(l_quantity, l_discount)", "slope")}, regr_count(l_quantity, l_discount)::BIGINT AS n FROM lineitem GROUP BY 1, 2""")
def facet_trend(spark, folder):
    return rounded(trend.facet_trend(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"], "l_discount", "l_quantity"))


# ---------------------------------------------------------------- regression

def _ols_frame(spark, folder):
    return table(spark, folder, "lineitem").select(
        F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))


@query("multi_ols", f"""
WITH q AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b FROM lineitem),
m AS (SELECT regr_sxx(y, a) AS saa, regr_sxx(y, b) AS sbb, regr_sxy(a, b) AS sab, regr_sxy(y, a) AS say, regr_sxy(y, b) AS sby,
  avg(y) AS my, avg(a) AS ma, avg(b) AS mb FROM q),
c AS (SELECT (say * sbb - sby * sab) / (saa * sbb - sab * sab) AS ba, (sby * saa - say * sab) / (saa * sbb - sab * sab) AS bb, * FROM m)
SELECT 'quantity' AS term, {r("ba", "estimate", 3)} FROM c UNION ALL SELECT 'discount', {r("bb", "estimate", 3)} FROM c
UNION ALL SELECT '(Intercept)', {r("my - ba * ma - bb * mb", "estimate", 3)} FROM c""")
def multi_ols(spark, folder):
    rows_ = _ols_frame(spark, folder)
    model = regression.multi_ols(rows_, "price ~ quantity + discount")
    return rounded(regression.coefficients(model, rows_).select("term", "estimate"), 3)


# Least squares by successive orthogonalization: e1, e2, e3 are the residuals of
# quantity, discount and their product on the columns before them.
_OLS = """WITH q AS (SELECT l_extendedprice AS y, l_quantity AS a, l_discount AS b, l_quantity * l_discount AS c FROM lineitem)
, m AS (SELECT count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, avg(c) AS mc FROM q)
, z AS (SELECT y - my AS y, a - ma AS e1, b - mb AS b, c - mc AS c FROM q, m)
, k1 AS (SELECT sum(e1 * e1) AS s1, sum(e1 * b) / sum(e1 * e1) AS r12, sum(e1 * c) / sum(e1 * e1) AS r13, sum(e1 * y) / sum(e1 * e1) AS g1 FROM z)
, z2 AS (SELECT y, e1, b - r12 * e1 AS e2, c FROM z, k1)
, k2 AS (SELECT sum(e2 * e2) AS s2, sum(e2 * c) / sum(e2 * e2) AS r23, sum(e2 * y) / sum(e2 * e2) AS g2 FROM z2)
, z3 AS (SELECT y, e1, e2, c - r13 * e1 - r23 * e2 AS e3 FROM z2, k1, k2)
, k3 AS (SELECT sum(e3 * e3) AS s3, sum(e3 * y) / sum(e3 * e3) AS g3 FROM z3)
, v AS (SELECT sum(pow(y - g1 * e1 - g2 * e2 - g3 * e3, 2)) / (any_value(n) - 4) AS s FROM z3, m, k1, k2, k3)
, t AS (SELECT *, g3 AS c3, g2 - r23 * g3 AS c2, g1 - r12 * (g2 - r23 * g3) - r13 * g3 AS c1 FROM m, k1, k2, k3, v)
, o AS (SELECT 'quantity' AS term, c1 AS est, s * (1 / s1 + r12 * r12 / s2 + pow(r12 * r23 - r13, 2) / s3) AS var FROM t
  UNION ALL SELECT 'discount', c2, s * (1 / s2 + r23 * r23 / s3) FROM t
  UNION ALL SELECT 'quantity:discount', c3, s / s3 FROM t
  UNION ALL SELECT '(Intercept)', my - c1 * ma - c2 * mb - c3 * mc,
    s * (1.0::DOUBLE / n + ma * ma / s1 + pow(mb - r12 * ma, 2) / s2 + pow(mc - r23 * mb + (r12 * r23 - r13) * ma, 2) / s3) FROM t)"""


@query("ols_interactions", f"""{_OLS}
SELECT term, {r("est", "estimate", 3)}, {r("sqrt(var)", "std.error", 3)}, {r("est / sqrt(var)", "statistic", 5)} FROM o""")
def ols_interactions(spark, folder):
    rows_ = _ols_frame(spark, folder)
    model = regression.multi_ols(rows_, "price ~ quantity * discount")
    return rounded(regression.coefficients(model, rows_).drop("p.value"), 3, statistic=5)


@query("ols_predictions", f"""{_OLS}
, x AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi, quantile_cont(l_discount, 0.25) AS q1, quantile_cont(l_discount, 0.75) AS q3 FROM lineitem)
, g AS (SELECT lo + (hi - lo) / 19.0 * i AS quantity, unnest([q1, q3]) AS discount FROM x CROSS JOIN (SELECT unnest(range(0, 20)) AS i))
SELECT {rs("quantity discount")}, {r("my + c1 * (quantity - ma) + c2 * (discount - mb) + c3 * (quantity * discount - mc)", "pred", 3)} FROM g, t""")
def ols_predictions(spark, folder):
    from ..operators.reshape import grid

    rows_ = _ols_frame(spark, folder)
    model = regression.multi_ols(rows_, "price ~ quantity * discount")
    points = grid(rows_, spaced_over={"quantity": 20}, quantiles={"discount": (0.25, 0.75)})
    return rounded(regression.predict(model, points), 6, pred=3)


def _meta_sql(p: int = 4, grid: int = 65, rounds: int = 6) -> str:
    """SQL of the fit from table x (study, v, x0 .. x3, y as x4): sums per study, rounds of candidates, elimination over a list."""
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    of = lambda c, i, j: f"{c}{min(i, j)}{max(i, j)}"
    w = 2 * p + 1
    cells = ", ".join(of("q", i, c) if c < p else of("q", i, p) if c == 2 * p else str(float(c - p == i)) for i in range(p) for c in range(w))
    pivot = f"m[(k[1] * {w} + k[1])::INT + 1]"
    solve = (f"list_reduce(list_prepend([{cells}, 0.0]::DOUBLE[], list_transform(range(0, {p}), lambda i: [i::DOUBLE])),"
             f" lambda m, k: list_transform(range(0, {p * w + 1}), lambda e: CASE WHEN e = {p * w} THEN m[e + 1] + ln({pivot})"
             f" WHEN e // {w} = k[1] THEN m[e + 1] / {pivot}"
             f" ELSE m[e + 1] - m[((e // {w}) * {w} + k[1])::INT + 1] * m[(k[1] * {w} + e % {w})::INT + 1] / {pivot} END))")
    beta = [f"m[{i * w + 2 * p + 1}]" for i in range(p)]
    rss = f"{of('q', p, p)} - (" + " + ".join(f"{of('q', i, p)} * {b}" for i, b in enumerate(beta)) + ")"
    lifted = " - ".join(["lifted", *(f"m[{i * w + p + j + 1}] * {of('e', i, j)}" for i in range(p) for j in range(p)), of("e", p, p)])
    lifted += "".join(f" + 2 * {b} * {of('e', i, p)}" for i, b in enumerate(beta))
    lifted += "".join(f" - {beta[i]} * {beta[j]} * {of('e', i, j)}" for i in range(p) for j in range(p))

    def profile(candidates: str) -> str:
        sums = ", ".join(f"sum(a{i}{j} - t / (1 + t * s) * b{i} * b{j}) AS q{i}{j}, sum(b{i} * b{j} / ((1 + t * s) * (1 + t * s))) AS e{i}{j}"
                         for i, j in pairs)
        return (f"(SELECT *, -0.5 * ((n - {p}) * {math.log(2 * math.pi)!r}::DOUBLE + logdet + m[{p * w + 1}] + {rss}) AS ll, -0.5 * ({lifted}) AS score"
                f" FROM (SELECT *, {solve} AS m FROM (SELECT k, t, lo, hi, unit, sum(n) AS n, sum(logv + ln(1 + t * s)) AS logdet,"
                f" sum(s / (1 + t * s)) AS lifted, {sums} FROM sums, {candidates} GROUP BY k, t, lo, hi, unit)))")

    u = f"(lo + (hi - lo) * k / {grid - 1})"
    steps = []
    for k in range(rounds):
        best, low = ("coalesce(max(k) FILTER (score > 0), 0)", "i") if k else ("arg_max(k, ll)", "greatest(i - 1, 0)")
        at = f"(SELECT *, unit * {u} / (1 - {u}) AS t FROM (SELECT *, unnest(range(0, {grid})) AS k FROM r{k}))"
        steps.append(f", r{k + 1} AS (SELECT lo + (hi - lo) * {low} / {grid - 1} AS lo, lo + (hi - lo) * least(i + 1, {grid - 1}) / {grid - 1} AS hi, unit"
                     f" FROM (SELECT {best} AS i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(unit) AS unit FROM {profile(at)}))")
    names = ["(Intercept)", "lat", "depth", "lat:depth"]
    found = " UNION ALL ".join(f"SELECT '{t}' AS term, m[{i * w + 2 * p + 1}] AS est, sqrt(m[{i * w + p + i + 1}]) AS se, t AS tau2 FROM solved"
                               for i, t in enumerate(names))
    return f"""
, sums AS (SELECT study, sum(1 / v) AS s, sum(ln(v)) AS logv, count(*) AS n,
  {", ".join(f"sum(x{i} / v) AS b{i}" for i in range(p + 1))}, {", ".join(f"sum(x{i} * x{j} / v) AS a{i}{j}" for i, j in pairs)} FROM x GROUP BY study)
, r0 AS (SELECT 0.0::DOUBLE AS lo, {1 - 1e-9!r}::DOUBLE AS hi, var_samp(x{p}) AS unit FROM x){"".join(steps)}
, solved AS (SELECT * FROM {profile(f"(SELECT *, 0 AS k, unit * lo / (1 - lo) AS t FROM r{rounds})")})
, z AS (SELECT *, abs(est / se) AS a FROM ({found}))
, t AS (SELECT *, CASE WHEN a > 6 THEN 2 * exp(-a * a / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE / a ELSE greatest(0, 1 - 2 * exp(-a * a / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE * list_sum([
  exp((2 * k + 1) * ln(a) - (k + 1) * ln(2) - lgamma(k + 1.5) + 0.5 * ln(pi())) for k in range(0, 160)])) END AS p FROM z)"""


@query("meta_regression", with_ctes("survey prior_slopes", f"""
, sv AS (SELECT "Site" AS "SiteName", "PROVINCE" AS study, avg(abs("Latitude")) / 10 AS lat, avg("mean_Depth") / 1e4 AS depth FROM survey GROUP BY 1, 2)
, x AS (SELECT study, pow(se / 1e5, 2) AS v, 1.0::DOUBLE AS x0, lat AS x1, depth AS x2, lat * depth AS x3, mean / 1e5 AS x4
  FROM prior_slopes p JOIN sv ON p."SiteName" = sv."SiteName" WHERE parameter = 'site_slope' AND se > 0){_meta_sql()}
SELECT term, {r("est", "estimate")}, {r("se", "se")}, {r("est / se", "zval")}, {r("p", "pval")},
 {r(f"est - {NormalDist().inv_cdf(0.975)!r}::DOUBLE * se", "ci.lb")}, {r(f"est + {NormalDist().inv_cdf(0.975)!r}::DOUBLE * se", "ci.ub")},
 p <= 0.05 AS sig, {r("tau2", "tau2")} FROM t"""))
def meta_regression(spark, folder):
    """Slopes of the sites, weighted by their errors, with a random intercept per nation."""
    prior = filters.where_equal(s.prior_slopes(spark, folder), **site_trends.PRIOR_SLOPES)
    survey = s.survey(spark, folder).groupBy(F.col("Site").alias("SiteName"), F.col("PROVINCE").alias("Study")).agg(
        F.avg(F.abs("Latitude")).alias("abs_lat"), F.avg("mean_Depth").alias("depth"))
    frame = joins.natural_join(filters.complete_cases(prior, ["se"]), survey, ["SiteName"], "inner").select(
        "Study", (F.col("mean") / 1e5).alias("mean"), (F.pow(F.col("se") / 1e5, 2)).alias("v"),
        (F.col("abs_lat") / 10).alias("lat"), (F.col("depth") / 1e4).alias("depth"))
    terms = ["(Intercept)", "lat", "depth", "lat:depth"]
    design = regression.design_matrix(frame, ["lat", "depth"], keep=["Study", "mean", "v"])
    return rounded(regression.meta_regression(design, "mean", "v", terms, "Study"), 6)


@query("orthogonal_quadratic", f"""
WITH m AS (SELECT avg(value) AS m FROM events), z AS (SELECT event_id, value - m AS z FROM events, m),
p AS (SELECT sum(z * z) AS s2, sum(z * z * z) AS s3, sum(z * z * z * z) AS s4, count(*) AS n FROM z)
SELECT event_id, {r("z / sqrt(s2)", "value_1", 9)},
 {r("(z * z - s3 / s2 * z - s2 / n) / sqrt(s4 - s3 * s3 / s2 - s2 * s2 / n)", "value_2", 9)} FROM z, p""")
def orthogonal_quadratic(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return rounded(regression.poly2(events, "value").select("event_id", "value_1", "value_2"), 9)


@query("design_matrix", """
SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS "(Intercept)", l_quantity, l_discount, l_tax, l_quantity * l_discount AS "l_quantity:l_discount",
 l_quantity * l_tax AS "l_quantity:l_tax", l_discount * l_tax AS "l_discount:l_tax",
 l_quantity * l_discount * l_tax AS "l_quantity:l_discount:l_tax" FROM lineitem""")
def design_matrix(spark, folder):
    lineitem = table(spark, folder, "lineitem")
    return regression.design_matrix(lineitem, ["l_quantity", "l_discount", "l_tax"], keep=["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- standardized model frame

@query("standardized_model_frame", with_ctes("survey series prior_slopes", _MERGED.replace('s."SiteName"', 's."Site" AS "SiteName"') + f"""
, tr AS (SELECT "SiteName", regr_sxy(max_tempC, "Year") AS sxy, regr_sxx(max_tempC, "Year") AS sxx, regr_syy(max_tempC, "Year") AS syy,
   regr_count(max_tempC, "Year") AS n, regr_avgx(max_tempC, "Year") AS ax, regr_avgy(max_tempC, "Year") AS ay FROM merged GROUP BY 1)
, k AS (SELECT p."SiteName", p.mean AS slope, p.se AS slope_se, CASE WHEN sxx > 1e-9 THEN sxy / sxx END AS temp,
   CASE WHEN n > 2 AND sxx > 1e-9 THEN sqrt({_resid("n", "sxx", "syy", "sxy", "ax", "ay")} / ((n - 2) * sxx)) END AS se_temp
   FROM prior_slopes p LEFT JOIN tr ON p."SiteName" = tr."SiteName" WHERE parameter = 'site_slope')
, c AS (SELECT * FROM k WHERE temp IS NOT NULL AND slope_se IS NOT NULL AND se_temp IS NOT NULL)
, z AS (SELECT "SiteName", slope, slope_se, (temp - avg(temp) OVER ()) / stddev_samp(temp) OVER () AS temp_scale,
   se_temp / stddev_samp(temp) OVER () AS se_temp_scale FROM c)
SELECT "SiteName", {rs("slope slope_se", 7)}, {rs("temp_scale se_temp_scale", 7)} FROM z WHERE se_temp_scale <> 0"""))
def standardized_model_frame(spark, folder):
    temperature = site_trends.temperature_trends(_survey_by_site(spark, folder), s.series(spark, folder), ["cell"])
    merged = site_trends.merged_site_trends(s.prior_slopes(spark, folder), temperature)
    picked = filters.pick_measure(merged, "mean_temp_slope_estimate", "max_temp_slope_estimate")
    renamed = picked.withColumnsRenamed({"mean": "slope", "se": "slope_se"})
    frame = filters.complete_cases(renamed, ["temp", "slope_se", "se_temp"])
    scaled = rows.zscore(frame, ["temp"], errors={"temp": "se_temp"})
    kept = filters.nonzero_error(scaled, ["se_temp_scale"])
    return rounded(kept.select("SiteName", "slope", "slope_se", "temp_scale", "se_temp_scale"), 7)


@query("error_precision", with_ctes("prior_slopes", f"""
SELECT "SiteName", parameter, {r("1 / nullif(se, 0)", "precision", 9)}, {r('"upper_0.9" - "lower_0.9"', "width", 5)} FROM prior_slopes"""))
def error_precision(spark, folder):
    prior = s.prior_slopes(spark, folder)
    return rounded(prior.select(
        "SiteName", "parameter", scalars.precision(F.col("se")).alias("precision"),
        scalars.interval_width(F.col("`lower_0.9`"), F.col("`upper_0.9`")).alias("width")), 9, width=5)


# ---------------------------------------------------------------- labels

def _sql_rewrite(expr: str, rules) -> str:
    for pattern, replacement in rules:
        expr = f"regexp_replace({expr}, '{pattern}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"
    return expr


@query("clean_study_names", with_ctes("taxa", f"""
SELECT "Study" AS raw, {_sql_rewrite('"Study"', labels.TAXA_STUDY_RULES)} AS "Study", count(*) AS n FROM taxa GROUP BY 1"""))
def clean_study_names(spark, folder):
    taxa = s.taxa(spark, folder).withColumnRenamed("Study", "raw")
    cleaned = taxa.withColumn("Study", labels.rewrite(F.col("raw"), labels.TAXA_STUDY_RULES))
    return cleaned.groupBy("raw", "Study").agg(F.count(F.lit(1)).alias("n"))


_NAMED = """SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'Gerard_ 1976' WHEN p_brand = 'Brand#2' THEN 'South_Africa_Pump_House'
 WHEN p_brand = 'Brand#3' THEN 'norway_inner_coast_norderhaug-Gr' ELSE p_brand END AS "Study" FROM part"""


def _named(spark, folder):
    brand = F.col("p_brand")
    named = F.when(brand == "Brand#1", "Gerard_ 1976").when(brand == "Brand#2", "South_Africa_Pump_House").when(
        brand == "Brand#3", "norway_inner_coast_norderhaug-Gr").otherwise(brand)
    return table(spark, folder, "part").select("p_partkey", named.alias("Study"))


@query("recode_study_names", f"""
SELECT p_partkey, CASE "Study" WHEN 'Gerard_ 1976' THEN 'Gerard_1976' WHEN 'South_Africa_Pump_House' THEN 'SA_Gansbaai_kelp_data'
 WHEN 'norway_inner_coast_norderhaug-Gr' THEN 'norway_inner_coast_norderhaug' ELSE "Study" END AS "Study" FROM ({_NAMED})""")
def recode_study_names(spark, folder):
    return _named(spark, folder).withColumn("Study", labels.recode(F.col("Study"), labels.SURVEY_STUDY_RECODE))


@query("trend_study_names", f"""
SELECT p_partkey, {_sql_rewrite('"Study"', labels.TREND_STUDY_RULES)} AS "Study" FROM ({_NAMED})""")
def trend_study_names(spark, folder):
    return _named(spark, folder).withColumn("Study", labels.rewrite(F.col("Study"), labels.TREND_STUDY_RULES))


@query("canopy_overrides", f"""
SELECT p_partkey, CASE WHEN contains("Study", 'South_Africa') THEN 'canopy' END AS has_canopy FROM ({_NAMED})""")
def canopy_overrides(spark, folder):
    label = labels.override_exact(F.lit(None).cast("string"), F.col("Study"), labels.TREND_EXACT_OVERRIDES)
    return _named(spark, folder).select(
        "p_partkey", labels.override_matching(label, F.col("Study"), labels.TREND_PATTERN_OVERRIDES).alias("has_canopy"))


@query("study_from_site_name", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderstatus END AS "Study" FROM orders""")
def study_from_site_name(spark, folder):
    study = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))
    site = F.concat_ws(":", "o_custkey", "o_orderpriority")
    return table(spark, folder, "orders").select("o_orderkey", labels.study_or_suffix(study, site).alias("Study"))


@query("region_overrides", with_ctes("survey", """
SELECT obs_id, CASE WHEN "Longitude" > 100 AND "Longitude" < 160 AND "Latitude" > -39.3 AND "Latitude" < 50 THEN 'no canopy'
  WHEN "Latitude" < 0 AND "Longitude" > 0 AND "Longitude" < 40 THEN 'canopy'
  WHEN "Longitude" > -10 AND "Longitude" < 0 AND "Latitude" > 40 AND "Latitude" < 50 THEN 'no canopy'
  ELSE "focalUnit" END AS has_canopy FROM survey"""))
def region_overrides(spark, folder):
    return s.survey(spark, folder).select("obs_id", labels.override_in_boxes(
        F.col("focalUnit"), F.col("Longitude"), F.col("Latitude")).alias("has_canopy"))


@query("canopy_table_with_manual_rows", with_ctes("taxa", f"""
, c AS (SELECT {_sql_rewrite('"Study"', labels.TAXA_STUDY_RULES)} AS "Study",
  CASE WHEN bool_or("Species" = 'small ring') THEN 'canopy' ELSE 'no canopy' END AS has_canopy FROM taxa GROUP BY "Study")
SELECT * FROM c UNION ALL SELECT * FROM (VALUES ('Aus_Marmion', 'no canopy'), ('Dayton_etal_1999_Laminaria', 'no canopy'),
 ('Dayton_etal_1999_Pterygophora', 'no canopy'), ('Trowbridge_etal_2013', 'no canopy'), ('Kirihara_etal_2003', 'no canopy'))"""))
def canopy_table_with_manual_rows(spark, folder):
    by_study = climate.group_any(s.taxa(spark, folder), "Study", "Species", ["small ring"])
    cleaned = by_study.withColumn("Study", labels.rewrite(F.col("Study"), labels.TAXA_STUDY_RULES))
    manual = spark.createDataFrame(list(labels.SURVEY_MANUAL_STUDIES.items()), "Study string, has_canopy string")
    return cleaned.unionByName(manual)


@query("right_closed_bins", """
SELECT p_partkey, CASE WHEN p_size > 1 AND p_size <= 20 THEN '1 - 20 years' WHEN p_size > 20 AND p_size <= 40 THEN '20 - 40 years' END AS bin FROM part""")
def right_closed_bins(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", scalars.pretty_cut(F.col("p_size"), [1, 20, 40], " years").alias("bin"))


@query("side_labels", with_ctes("points", """
SELECT c_custkey, CASE WHEN abs("Latitude") < 40 THEN '<40 Degrees Latitude' ELSE '>40 Degrees Latitude' END AS lat_breaks,
 CASE WHEN "Longitude" < 0 THEN 'Waves Decreasing' ELSE 'Waves Increasing' END AS wave_breaks FROM points"""))
def side_labels(spark, folder):
    return s.points(spark, folder).select(
        "c_custkey",
        scalars.two_way(F.abs("Latitude"), 40, "<40 Degrees Latitude", ">40 Degrees Latitude").alias("lat_breaks"),
        scalars.two_way(F.col("Longitude"), 0, "Waves Decreasing", "Waves Increasing").alias("wave_breaks"))


@query("number_labels", with_ctes("points", """
SELECT c_custkey, CASE WHEN "Longitude" < 0 THEN 'Wave Decrease: ' ELSE 'Wave Increase: ' END || printf('%.1f', round("Longitude", 1)) || 'm' AS wave_label,
 'Latitude: ' || CAST(CAST(round_even(abs("Latitude"), 0) AS BIGINT) AS VARCHAR) || '°' AS lat_label FROM points"""))
def number_labels(spark, folder):
    return s.points(spark, folder).select(
        "c_custkey",
        scalars.signed_label(F.col("Longitude"), 1, "Wave Decrease: ", "Wave Increase: ", "m").alias("wave_label"),
        scalars.latitude_label(F.abs("Latitude"), "Latitude: ").alias("lat_label"))


@query("rotated_longitude", """
SELECT c_custkey, ((c_custkey * 37) % 360 + 180) % 360 - 180.0::DOUBLE AS lon FROM customer""")
def rotated_longitude(spark, folder):
    east = F.pmod(F.col("c_custkey") * 37, F.lit(360))
    return table(spark, folder, "customer").select("c_custkey", scalars.rotate_longitude(east).alias("lon"))


@query("missing_as_zero", """
SELECT d.doc_id, coalesce(quality, 0)::DOUBLE AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def missing_as_zero(spark, folder):
    joined = joins.natural_left_join(table(spark, folder, "documents").select("doc_id"), table(spark, folder, "labels"))
    return joined.select("doc_id", scalars.zero_if_missing(F.col("quality").cast("double")).alias("quality"))


@query("gain_or_loss", with_ctes("prior_slopes", """
SELECT "SiteName", parameter, CASE WHEN sign(lo) + sign(hi) < 0 THEN 'Loss' WHEN sign(lo) + sign(hi) > 0 THEN 'Gain' ELSE 'No change' END AS change
FROM (SELECT *, "lower_0.9" - 250000 AS lo, "upper_0.9" - 250000 AS hi FROM prior_slopes)"""))
def gain_or_loss(spark, folder):
    prior = s.prior_slopes(spark, folder)
    return prior.select("SiteName", "parameter", scalars.classify_change(
        F.col("`lower_0.9`") - 250000, F.col("`upper_0.9`") - 250000).alias("change"))


@query("latitude_band_names", with_ctes("points", """
, l AS (SELECT c_custkey, CAST(round_even(abs("Latitude"), 0) AS INTEGER) AS lat FROM points)
SELECT c_custkey, CASE lat WHEN 21 THEN 'Baja,' || chr(10) || ' Peru' WHEN 32 THEN 'Japan,' || chr(10) || ' W. Australia'
 WHEN 43 THEN 'Gulf of Maine,' || chr(10) || ' Tasmania' WHEN 55 THEN 'Northern Canada,' || chr(10) || ' Southern Chile'
 WHEN 66 THEN 'Norway,' || chr(10) || ' Northern Alaska' ELSE CAST(lat AS VARCHAR) END AS band FROM l"""))
def latitude_band_names(spark, folder):
    return s.points(spark, folder).select("c_custkey", scalars.name_latitude(F.abs("Latitude")).alias("band"))


def _raw_trend(y: str, est: str, se: str) -> str:
    """SQL of an unrounded slope and its error."""
    n, sxx, syy, sxy, ax, ay = (f'regr_{k}({y}, "Year")' for k in _MOMENTS)
    return (f"CASE WHEN {sxx} > 1e-9 THEN {sxy} / {sxx} END AS {est}, CASE WHEN {n} > 2 AND {sxx} > 1e-9 THEN"
            f" sqrt({_resid(n, sxx, syy, sxy, ax, ay)} / (({n} - 2) * {sxx})) END AS {se}")


@query("analysis_frame", with_ctes("survey series wave_frame prior_slopes", _MERGED.replace('s."SiteName"', 's."Site" AS "SiteName"') + f"""
, tr AS (SELECT "SiteName", {_raw_trend("max_tempC", "temp", "se_temp")} FROM merged GROUP BY 1)
, sw AS (SELECT s."Site" AS "SiteName", s."Latitude", s."Longitude", s."Year", max_wave_height FROM survey s
  JOIN wave_frame w ON s."Latitude" = w."Latitude" AND s."Longitude" = w."Longitude" AND s."Year" = w."Year" WHERE total_wave_energy IS NOT NULL)
, wv AS (SELECT "SiteName", {_raw_trend("max_wave_height", "waves", "se_waves")} FROM sw GROUP BY "SiteName", "Latitude", "Longitude")
, site AS (SELECT "Site" AS "SiteName", min("Study") AS "Study", min("Latitude") AS lat, min("Longitude") AS lon,
  (max("Year") - min("Year") + 1)::DOUBLE AS dur FROM survey GROUP BY 1)
, k AS (SELECT p."SiteName", p.mean AS slope, p.se AS slope_se, abs(lat) AS abs_lat, dur, waves, se_waves, temp, se_temp, "Study",
  CASE WHEN lon > 100 AND lon < 160 AND lat > -39.3 AND lat < 50 THEN 'no canopy' WHEN lat < 0 AND lon > 0 AND lon < 40 THEN 'canopy'
    WHEN lon > -10 AND lon < 0 AND lat > 40 AND lat < 50 THEN 'no canopy' ELSE 'canopy' END AS canopy
  FROM prior_slopes p JOIN site ON p."SiteName" = site."SiteName" LEFT JOIN tr ON p."SiteName" = tr."SiteName"
  LEFT JOIN wv ON p."SiteName" = wv."SiteName"
  WHERE parameter = 'site_slope' AND waves IS NOT NULL AND se_waves IS NOT NULL AND temp IS NOT NULL)
, z AS (SELECT *, {", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS {c}_z" for c in ("abs_lat", "dur", "waves", "temp"))},
  se_waves / stddev_samp(waves) OVER () AS sew, se_temp / stddev_samp(temp) OVER () AS set_,
  dense_rank() OVER (ORDER BY canopy) - 1 AS nocanopy, dense_rank() OVER (ORDER BY "Study") AS "studyIDX" FROM k)
SELECT "SiteName", {rs("slope slope_se abs_lat", 5)}, {r("temp_z", "temp_scale", 5)}, {r("waves_z", "waves_scale", 5)}, nocanopy,
  {r("set_", "se_temp_scale", 5)}, {r("sew", "se_waves_scale", 5)}, "studyIDX", {r("abs_lat_z", "abs_lat_scale", 5)}, {r("dur_z", "Duration_scale", 5)}
FROM z WHERE sew <> 0 AND set_ <> 0"""))
def analysis_frame(spark, folder):
    """The frame of the models: slopes, standardized waves and temperature with their errors, labels and indices."""
    temperature = site_trends.temperature_trends(_survey_by_site(spark, folder), s.series(spark, folder), ["cell"])
    waves = site_trends.wave_trends(_survey_waves(spark, folder), ["max_wave_height"]).drop("Latitude", "Longitude")
    sites = s.survey(spark, folder).groupBy(F.col("Site").alias("SiteName")).agg(
        F.min("Study").alias("Study"), F.min("Latitude").alias("Latitude"), F.min("Longitude").alias("Longitude"),
        (F.max("Year") - F.min("Year") + 1).alias("Duration"))
    merged = site_trends.merged_site_trends(s.prior_slopes(spark, folder), temperature, waves)
    placed = joins.natural_join(merged, sites, ["SiteName"], "inner").withColumn(
        "has_canopy", labels.override_in_boxes(F.lit("canopy"), F.col("Longitude"), F.col("Latitude")))
    frame = site_trends.standardized_frame(placed, "max_wave_height_estimate", "max_temp_slope_estimate")
    return rounded(site_trends.model_rows(frame, ["SiteName", "abs_lat_scale", "Duration_scale"]), 5)
