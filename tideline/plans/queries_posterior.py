"""Queries of posterior draws, model comparison and fitted effects."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import functions as F

from ..functions.labels import PARAMETER_LABEL_RULES, parameter_label
from ..functions.scalars import classify_change
from ..operators import posterior, reshape
from . import standins as s
from .catalog import query, r, rounded, rs
from .queries_trend import _sql_rewrite
from .standins import table, with_ctes


@query("posterior_quantiles", with_ctes("draws", f"""
SELECT param, {r("quantile_cont(value, 0.05)", "q5")}, {r("quantile_cont(value, 0.5)", "q50")}, {r("quantile_cont(value, 0.95)", "q95")}
FROM draws GROUP BY 1"""))
def posterior_quantiles(spark, folder):
    return rounded(posterior.posterior_quantiles(s.draws(spark, folder)))


_CENTRAL = ", ".join(
    r(f"quantile_cont(value, {q})", n) for p, name in ((0.99, "99"), (0.95, "95"), (0.9, "90"))
    for q, n in ((round((1 - p) / 2, 6), f"lower_{name}_q"), (round(1 - (1 - p) / 2, 6), f"upper_{name}_q")))


@query("posterior_summary", with_ctes("draws", f"""
SELECT param, {r("avg(value)", "mean", 8)}, {r("stddev_samp(value)", "se", 8)}, {r("avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END)", "p", 8)}, {_CENTRAL}
FROM draws GROUP BY 1"""))
def posterior_summary(spark, folder):
    return rounded(posterior.posterior_summary(s.draws(spark, folder)), 6, mean=8, se=8, p=8)


@query("shortest_interval", with_ctes("draws", f"""
, o AS (SELECT param, value, row_number() OVER (PARTITION BY param ORDER BY value) AS rk, count(*) OVER (PARTITION BY param) AS n FROM draws)
, w AS (SELECT a.param, a.value AS lower, b.value AS upper, row_number() OVER (PARTITION BY a.param ORDER BY b.value - a.value, a.rk) AS rn
  FROM o a JOIN o b ON a.param = b.param AND b.rk = a.rk + greatest(1, least(a.n - 1, round_even(a.n * 0.95::DOUBLE, 0)::BIGINT)))
SELECT param, {rs("lower upper", 8)} FROM w WHERE rn = 1"""))
def shortest_interval(spark, folder):
    return rounded(posterior.hpd_interval(s.draws(spark, folder), prob=0.95), 8)


@query("chain_convergence", with_ctes("draws", f"""
, h AS (SELECT d.* FROM draws d, (SELECT min(iteration) AS a, max(iteration) AS b FROM draws) l WHERE iteration - a >= (b - a + 1) / 2)
, c AS (SELECT param, chain, count(*)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM h GROUP BY 1, 2)
, g AS (SELECT param, count(*)::DOUBLE AS c, min(n) AS n, avg(v) AS w, avg(m) AS mu, var_samp(m) AS vm, var_samp(v) AS vv,
   covar_samp(v, m * m) AS c2, covar_samp(v, m) AS c1 FROM c GROUP BY 1)
, k AS (SELECT *, n * vm AS b, (n - 1) * w / n + (1 + 1 / c) * vm AS pooled FROM g)
, u AS (SELECT *, ((n - 1) * (n - 1) * vv / c + (1 + 1 / c) * (1 + 1 / c) * 2 * b * b / (c - 1)
   + 2 * (n - 1) * (1 + 1 / c) * n / c * (c2 - 2 * mu * c1)) / (n * n) AS vp FROM k)
, z AS (SELECT *, 2 * pooled * pooled / vp AS df FROM u)
SELECT param, {r("sqrt((df + 3) / (df + 1) * ((n - 1) / n + (1 + 1 / c) / n * b / w))", "rhat", 8)} FROM z"""))
def chain_convergence(spark, folder):
    return rounded(posterior.gelman_rubin(s.draws(spark, folder)), 8)


_POINTWISE = """, x AS (SELECT obs, {ll} AS ll, max({ll}) OVER (PARTITION BY obs) AS hi, count(*) OVER (PARTITION BY obs) AS s FROM {src})
, w AS (SELECT *, exp(hi - ll) / avg(exp(hi - ll)) OVER (PARTITION BY obs) AS wn FROM x)
, q AS (SELECT obs, hi + ln(avg(exp(ll - hi))) AS lpd, var_samp(ll) AS p_waic,
   hi + ln(avg(exp(ll - hi) * least(wn, sqrt(s))) / avg(least(wn, sqrt(s)))) AS elpd_loo FROM w GROUP BY obs, hi)
, pt AS (SELECT obs, -2 * (lpd - p_waic) AS waic, lpd, p_waic, lpd - p_waic AS elpd_waic, lpd - elpd_loo AS p_loo, elpd_loo FROM q)"""


def _total_sql(cols) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS quantity, {r(f'sum({c})', 'total')}, {r(f'sqrt(count({c}) * var_samp({c}))', 'se')} FROM pt" for c in cols)


@query("waic_pointwise", with_ctes("log_lik", _POINTWISE.format(ll="ll", src="log_lik") + f"""
SELECT obs, {rs(" ".join(posterior.WAIC_COLUMNS), 8)} FROM pt"""))
def waic_pointwise(spark, folder):
    return rounded(posterior.waic_pointwise(s.log_lik(spark, folder)), 8)


@query("waic_totals", with_ctes("log_lik", _POINTWISE.format(ll="ll", src="log_lik") + _total_sql(posterior.WAIC_COLUMNS)))
def waic_totals(spark, folder):
    return rounded(posterior.waic(s.log_lik(spark, folder)))


@query("waic_difference", with_ctes("log_lik", _POINTWISE.format(ll="(ll - ll2)", src="log_lik") + _total_sql(posterior.WAIC_COLUMNS)))
def waic_difference(spark, folder):
    return rounded(posterior.waic_difference(s.log_lik(spark, folder), s.log_lik(spark, folder, 2)))


def _model_sql(name: str, ll: str) -> str:
    inner = with_ctes("log_lik", _POINTWISE.format(ll=ll, src="log_lik") + f"""
SELECT sum(elpd_waic) AS elpd_waic, sum(p_waic) AS p_waic, sum(waic) AS waic, sqrt(count(waic) * var_samp(waic)) AS se_waic, '{name}' AS mod FROM pt""")
    return f"SELECT * FROM ({inner})"


@query("waic_table", f"""
WITH a AS ({_model_sql("absolute", "ll")} UNION ALL {_model_sql("squared", "ll2")})
SELECT mod, {rs("elpd_waic p_waic waic se_waic")}, {r("waic - min(waic) OVER ()", "delta")} FROM a""")
def waic_table(spark, folder):
    models = {"absolute": s.log_lik(spark, folder), "squared": s.log_lik(spark, folder, 2)}
    return rounded(posterior.waic_table(models))


# ---------------------------------------------------------------- fitted effects

_AXES = ["nocanopy", "waves_scale", "temp_scale", "abs_lat_scale"]
_COMBOS = [()] + [c for k in range(1, 5) for c in itertools.combinations(_AXES, k)]
_NAMES = ["b_Intercept"] + ["b_" + ":".join(c) for c in _COMBOS[1:]]
TERMS = dict(zip(_NAMES, _COMBOS))


def wide_draws(spark, folder):
    """One row per draw, one column per coefficient of the four-way interaction: the first 16 elements, which are all it has."""
    return table(spark, folder, "embeddings").selectExpr(
        *[f"CAST(embedding[{i}] AS DOUBLE) AS `{n}`" for i, n in enumerate(_NAMES)])


def effect_axes(spark, folder, spaced: str, n: int, fixed: dict):
    """Axes over the standardized events: one spaced over the range, one at two quantiles."""
    from ..operators.rows import zscore

    events = zscore(table(spark, folder, "events").select("value", F.col("user_id").cast("double")), ["value", "user_id"])
    frame = events.select(F.col("value_scale").alias(spaced), F.col("user_id_scale").alias("abs_lat_scale"))
    return reshape.data_axes(frame, {spaced: n}, {"abs_lat_scale": (0.25, 0.75)}, {"nocanopy": (0.0, 1.0), **fixed})


def _axes_sql(spaced: str, n: int, fixed: str) -> str:
    return f"""
z AS (SELECT (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS v, (user_id - avg(user_id) OVER ()) / stddev_samp(user_id) OVER () AS u FROM events)
, a AS (SELECT min(v) AS lo, max(v) AS hi, quantile_cont(u, 0.25) AS q1, quantile_cont(u, 0.75) AS q3 FROM z)
, g AS (SELECT lo + (hi - lo) / {n - 1}.0 * i AS {spaced}, unnest([q1, q3]) AS abs_lat_scale, nocanopy {fixed}
  FROM a CROSS JOIN (SELECT unnest(range(0, {n})) AS i) CROSS JOIN (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE]) AS nocanopy) {"CROSS JOIN (SELECT unnest([-1.0::DOUBLE, 1.0::DOUBLE]) AS waves_scale)" if fixed else ""})
, d AS (SELECT {", ".join(f'embedding[{i + 1}]::DOUBLE AS "{c}"' for i, c in enumerate(_NAMES))} FROM embeddings)"""


def _sum_sql(terms) -> str:
    return " + ".join(" * ".join([f'"{c}"', *axes]) for c, axes in terms.items())


@query("linear_predictor", f"""WITH {_axes_sql("temp_scale", 40, ", waves_scale")}
, e AS (SELECT g.*, {_sum_sql(TERMS)} AS f FROM g CROSS JOIN d)
SELECT {rs("nocanopy waves_scale temp_scale abs_lat_scale")}, {r("avg(f)", "pred")}, {r("quantile_cont(f, 0.1)", "ci_lb")}, {r("quantile_cont(f, 0.9)", "ci_ub")}
FROM e GROUP BY nocanopy, waves_scale, temp_scale, abs_lat_scale""")
def linear_predictor(spark, folder):
    axes = effect_axes(spark, folder, "temp_scale", 40, {"waves_scale": (-1.0, 1.0)})
    return rounded(posterior.linear_predictor(wide_draws(spark, folder), axes, TERMS))


@query("conditional_effect", f"""WITH {_axes_sql("waves_scale", 30, "")}
, e AS (SELECT g.*, {_sum_sql(posterior.slope_terms(TERMS, "temp_scale"))} AS f FROM g CROSS JOIN d)
SELECT {rs("nocanopy waves_scale abs_lat_scale")}, {r("avg(f)", "temp_scale_effect")}, {r("quantile_cont(f, 0.05)", "cl_lb")}, {r("quantile_cont(f, 0.95)", "cl_ub")}
FROM e GROUP BY nocanopy, waves_scale, abs_lat_scale""")
def conditional_effect(spark, folder):
    axes = effect_axes(spark, folder, "waves_scale", 30, {})
    return rounded(posterior.conditional_effect(wide_draws(spark, folder), axes, TERMS, "temp_scale"))


@query("effect_surface_classes", f"""WITH {_axes_sql("temp_scale", 40, ", waves_scale")}
, e AS (SELECT g.*, {_sum_sql(TERMS)} AS f FROM g CROSS JOIN d)
, k AS (SELECT nocanopy, sign(quantile_cont(f, 0.25)) + sign(quantile_cont(f, 0.75)) AS t FROM e GROUP BY nocanopy, waves_scale, temp_scale, abs_lat_scale)
SELECT nocanopy, CASE WHEN t < 0 THEN 'Loss' WHEN t > 0 THEN 'Gain' ELSE 'No change' END AS change, count(*) AS n FROM k GROUP BY 1, 2""")
def effect_surface_classes(spark, folder):
    axes = effect_axes(spark, folder, "temp_scale", 40, {"waves_scale": (-1.0, 1.0)})
    surface = posterior.linear_predictor(wide_draws(spark, folder), axes, TERMS, tail=0.25)
    return surface.groupBy("nocanopy", classify_change(F.col("ci_lb"), F.col("ci_ub")).alias("change")).agg(
        F.count(F.lit(1)).alias("n"))


@query("parameter_labels", with_ctes("draws", f"""
, n AS (SELECT param, CASE WHEN param % 2 = 0 THEN 'b_has_canopynocanopy:temp_scale' ELSE 'b_waves_scale:abs_lat_scale' END AS coef FROM draws)
SELECT param, {_sql_rewrite("coef", PARAMETER_LABEL_RULES)} AS coef_name, count(*) AS n FROM n GROUP BY 1, 2"""))
def parameter_labels(spark, folder):
    coef = F.when(F.col("param") % 2 == 0, "b_has_canopynocanopy:temp_scale").otherwise("b_waves_scale:abs_lat_scale")
    named_ = s.draws(spark, folder).select("param", parameter_label(coef).alias("coef_name"))
    return named_.groupBy("param", "coef_name").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- hierarchical model

def _site_group_draws(spark, folder):
    """Elements 1-25 are sites (nations), 26-30 their groups (regions)."""
    d = s.draws(spark, folder)
    site = d.where(F.col("param") < 25).select("draw", F.col("param").alias("site"), "value")
    group = d.where(F.col("param").between(25, 29)).select("draw", (F.col("param") - 25).alias("group"), "value")
    nation = table(spark, folder, "nation").select(F.col("n_nationkey").alias("site"), F.col("n_regionkey").alias("group"))
    return site, group, nation


@query("site_coefficients", with_ctes("draws", f"""
, c AS (SELECT a.param AS site, n_regionkey AS grp, a.value + b.value AS value FROM draws a JOIN nation ON a.param = n_nationkey
  JOIN draws b ON b.draw = a.draw AND b.param = 25 + n_regionkey)
SELECT site, grp AS "group", {r("avg(value)", "mean", 8)}, {r("quantile_cont(value, 0.05)", "lower_90_q", 8)}, {r("quantile_cont(value, 0.95)", "upper_90_q", 8)} FROM c GROUP BY 1, 2"""))
def site_coefficients(spark, folder):
    """Sites are as many elements as there are nations, groups as many as regions; the others are no parameters here."""
    both = posterior.site_coefficients(*_site_group_draws(spark, folder))
    summary = posterior.posterior_summary(both, ["site", "group"], probs=(0.9,))
    return rounded(summary.select("site", "group", "mean", "lower_90_q", "upper_90_q"), 8)


def _model(spark, folder):
    """Each supplier's balance and the draws of sites (nations), groups and studies."""
    emb = table(spark, folder, "embeddings")

    def per(name, count, cols):
        rows = ", ".join(
            f"named_struct('{name}', {i}, " + ", ".join(f"'{n}', {x}" for n, x in cols(i).items()) + ")" for i in range(count))
        return emb.selectExpr("vec_id AS draw", f"inline(array({rows}))")

    d = "CAST(embedding[{}] AS DOUBLE)".format
    site = per("site", 25, lambda i: {"beta1": d(i), "beta2": d(i + 25)})
    group = per("group", 5, lambda i: {"mu1": d(i + 50), "mu2": d(i + 55)})
    study = per("study", 4, lambda i: {"sd_e": f"abs({d(60 + i)}) + 0.5D"})
    places = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    obs = table(spark, folder, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("obs"), F.col("s_nationkey").alias("site"), F.col("n_regionkey").alias("group"),
        F.pmod("s_nationkey", F.lit(4)).cast("int").alias("study"), (F.pmod("s_suppkey", F.lit(7)) - 3).alias("x"),
        (F.abs("s_acctbal") / 1000 + 0.1).alias("y"))
    return obs, site, group, study


_FITS = """WITH o AS (SELECT s_suppkey AS obs, s_nationkey AS site, n_regionkey AS grp, s_nationkey % 4 AS study, s_suppkey % 7 - 3 AS x,
  abs(s_acctbal) / 1000 + 0.1::DOUBLE AS y FROM supplier JOIN nation ON s_nationkey = n_nationkey)
, f AS (SELECT obs, y, vec_id AS draw, embedding[51 + grp]::DOUBLE + embedding[1 + site]::DOUBLE
    + (embedding[56 + grp]::DOUBLE + embedding[26 + site]::DOUBLE) * x AS loc,
    embedding[51 + grp]::DOUBLE + embedding[56 + grp]::DOUBLE * x AS loc_mu, abs(embedding[61 + study]::DOUBLE) + 0.5::DOUBLE AS sd FROM o CROSS JOIN embeddings)
, l AS (SELECT *, (ln(y) - loc) / sd AS resid FROM f)"""


@query("pointwise_log_likelihood", _FITS + f"""
SELECT obs, {r("avg(resid)", "resid")}, {r("avg(loc_mu)", "y_loc_mu")},
 {r(f"avg(-ln(y) - ln(sd) - {0.5 * math.log(2 * math.pi)!r}::DOUBLE - resid * resid / 2)", "log_lik")}, count(*) AS n FROM l GROUP BY 1""")
def pointwise_log_likelihood(spark, folder):
    """Log-likelihood of each supplier's balance under each draw, and its mean."""
    return rounded(posterior.pointwise_loglik(*_model(spark, folder), means=True))


@query("residual_table", _FITS + f"""
, v AS (SELECT obs, y, exp(loc) AS fit, row_number() OVER (PARTITION BY obs ORDER BY exp(loc)) AS rk, count(*) OVER (PARTITION BY obs) AS n FROM l)
, w AS (SELECT a.obs, a.fit AS lo, b.fit AS hi, row_number() OVER (PARTITION BY a.obs ORDER BY b.fit - a.fit, a.rk) AS rn FROM v a
  JOIN v b ON a.obs = b.obs AND b.rk = a.rk + greatest(1, least(a.n - 1, round_even(a.n * 0.95::DOUBLE, 0)::BIGINT)))
, m AS (SELECT obs, any_value(y) AS y, avg(fit) AS y_hat FROM v GROUP BY 1)
SELECT m.obs, {r("y", "y")}, {r("y_hat", "y_hat")}, {r("lo", "y_hat_L")}, {r("hi", "y_hat_U")}, {r("y - y_hat", "resid")} FROM m JOIN w ON m.obs = w.obs AND rn = 1""")
def residual_table(spark, folder):
    return rounded(posterior.residual_table(posterior.observed_fits(*_model(spark, folder))))


_PROBS = (0.99, 0.95, 0.9)


def _parameter_sql(probs) -> str:
    """SQL of a parameter table over c (parameter, site, grp, chain, iteration, value)."""
    own = "parameter, site, grp"
    same = "a.parameter = b.parameter AND a.site IS NOT DISTINCT FROM b.site AND a.grp = b.grp"
    central = ", ".join(r(f"quantile_cont(value, {q})", n) for p in probs for q, n in (
        ((1 - p) / 2, f"lower_{p * 100:g}_q"), (1 - (1 - p) / 2, f"upper_{p * 100:g}_q")))
    shortest, joined, shown = "", "", []
    for p in probs:
        t = f"h{p * 100:g}"
        shortest += f"""
, {t} AS (SELECT * FROM (SELECT a.parameter, a.site, a.grp, a.value AS lo, b.value AS hi,
    row_number() OVER (PARTITION BY a.parameter, a.site, a.grp ORDER BY b.value - a.value, a.rk) AS rn FROM o a JOIN o b ON {same}
    AND b.rk = a.rk + greatest(1, least(a.n - 1, round_even(a.n * {p}::DOUBLE, 0)::BIGINT))) WHERE rn = 1)"""
        joined += f" JOIN {t} ON {same.replace('a.', 'q.').replace('b.', t + '.')}"
        shown += [r(f"{t}.lo", f"lower_{p * 100:g}"), r(f"{t}.hi", f"upper_{p * 100:g}")]
    return f"""
, o AS (SELECT *, row_number() OVER (PARTITION BY {own} ORDER BY value) AS rk, count(*) OVER (PARTITION BY {own}) AS n FROM c){shortest}
, q AS (SELECT {own}, {r("avg(value)", "mean")}, {r("stddev_samp(value)", "se")}, {r("avg(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END)", "p")},
  {central} FROM c GROUP BY {own})
, hf AS (SELECT c.* FROM c, (SELECT min(iteration) AS a, max(iteration) AS b FROM c) l WHERE iteration - a >= (b - a + 1) / 2)
, ch AS (SELECT {own}, chain, count(*)::DOUBLE AS n, avg(value) AS m, var_samp(value) AS v FROM hf GROUP BY {own}, chain)
, g AS (SELECT {own}, count(*)::DOUBLE AS c, min(n) AS n, avg(v) AS w, avg(m) AS mu, var_samp(m) AS vm, var_samp(v) AS vv,
   covar_samp(v, m * m) AS c2, covar_samp(v, m) AS c1 FROM ch GROUP BY {own})
, k AS (SELECT *, n * vm AS b, (n - 1) * w / n + (1 + 1 / c) * vm AS pooled FROM g)
, u AS (SELECT *, ((n - 1) * (n - 1) * vv / c + (1 + 1 / c) * (1 + 1 / c) * 2 * b * b / (c - 1)
   + 2 * (n - 1) * (1 + 1 / c) * n / c * (c2 - 2 * mu * c1)) / (n * n) AS vp FROM k)
, rh AS (SELECT *, 2 * pooled * pooled / vp AS df FROM u)
SELECT q.parameter, 'Region' AS "grouping", n_name AS "SiteName", r_name AS group_name, q.mean, q.se, q.p,
  q.* EXCLUDE (parameter, site, grp, mean, se, p), {", ".join(shown)},
  {r("sqrt((df + 3) / (df + 1) * ((rh.n - 1) / rh.n + (1 + 1 / rh.c) / rh.n * rh.b / rh.w))", "rhat")}
FROM q{joined} JOIN rh ON {same.replace('a.', 'q.').replace('b.', 'rh.')} LEFT JOIN nation ON q.site = n_nationkey JOIN region ON q.grp = r_regionkey"""


@query("posterior_parameters", with_ctes("draws", f"""
, c AS (SELECT 'site_' || kind AS parameter, n_nationkey AS site, n_regionkey AS grp, a.chain, a.iteration, a.value + b.value AS value
  FROM (VALUES ('intercept', 0), ('slope', 30)) t(kind, low) CROSS JOIN nation JOIN draws a ON a.param = low + n_nationkey
  JOIN draws b ON b.draw = a.draw AND b.param = low + 25 + n_regionkey
  UNION ALL SELECT 'mean_' || kind, NULL, r_regionkey, a.chain, a.iteration, a.value
  FROM (VALUES ('intercept', 0), ('slope', 30)) t(kind, low) CROSS JOIN region JOIN draws a ON a.param = low + 25 + r_regionkey){_parameter_sql(_PROBS)}"""))
def posterior_parameters(spark, folder):
    """The table of all parameters: slopes and intercepts of sites and groups, named and stacked.

    Elements 0 to 24 and 30 to 54 of the draws are sites (nations), 25 to 29 and 55 to 59 their groups (regions).
    """
    d = s.draws(spark, folder)
    nation = table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("site"), F.col("n_regionkey").alias("group"), F.col("n_name").alias("SiteName"))
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("group"), F.col("r_name").alias("group_name"))
    tables = {}
    for kind, at in (("intercept", 0), ("slope", 30)):
        part = lambda low, n, name: d.where(F.col("param").between(low, low + n - 1)).select(
            "draw", "chain", "iteration", (F.col("param") - low).alias(name), "value")
        groups = part(at + 25, 5, "group")
        sites = posterior.site_coefficients(part(at, 25, "site"), groups.drop("chain", "iteration"), nation)
        tables[f"site_{kind}"] = posterior.parameter_table(sites, ["site", "group"], nation.join(region, "group"), _PROBS)
        tables[f"mean_{kind}"] = posterior.parameter_table(groups, ["group"], region, _PROBS)
    return rounded(posterior.stacked_parameters(tables, "Region").drop("site", "group"))


@query("fits_of_sites_and_groups", _FITS + f"""
, long AS (SELECT obs, 'own' AS kind, y, exp(loc) AS fit FROM l UNION ALL SELECT obs, 'mu', y, exp(loc_mu) FROM l)
, v AS (SELECT *, row_number() OVER (PARTITION BY obs, kind ORDER BY fit) AS rk, count(*) OVER (PARTITION BY obs, kind) AS n FROM long)
, w AS (SELECT a.obs, a.kind, a.fit AS lo, b.fit AS hi, row_number() OVER (PARTITION BY a.obs, a.kind ORDER BY b.fit - a.fit, a.rk) AS rn FROM v a
  JOIN v b ON a.obs = b.obs AND a.kind = b.kind AND b.rk = a.rk + greatest(1, least(a.n - 1, round_even(a.n * 0.95::DOUBLE, 0)::BIGINT)))
, m AS (SELECT v.obs, v.kind, any_value(y) AS y, avg(fit) AS f, any_value(lo) AS lo, any_value(hi) AS hi FROM v
  JOIN w ON v.obs = w.obs AND v.kind = w.kind AND rn = 1 GROUP BY 1, 2)
SELECT a.obs, {r("a.y", "y")}, {r("a.f", "y_hat")}, {r("a.lo", "y_hat_L")}, {r("a.hi", "y_hat_U")}, {r("a.y - a.f", "resid")},
 {r("b.f", "y_hat_mu")}, {r("b.lo", "y_hat_mu_L")}, {r("b.hi", "y_hat_mu_U")} FROM m a JOIN m b ON a.obs = b.obs AND a.kind = 'own' AND b.kind = 'mu'""")
def fits_of_sites_and_groups(spark, folder):
    """Fitted values of the observations and of their groups alone, with their intervals."""
    return rounded(posterior.fitted_table(posterior.observed_fits(*_model(spark, folder))))
