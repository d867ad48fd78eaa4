"""Summaries of posterior draws, model comparison, and fitted effects.

Draws are long (keys, value) or wide (one column per parameter). Groups of any
size are handled: moments are mergeable aggregates, quantiles and shortest
intervals come from one sort over all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .climate import totals
from .effects import counted_quantiles
from .fits import density_means, packed, summaries
from .joins import natural_join, natural_left_join, with_one_row
from .materialize import written
from .quantiles import grouped_quantiles, ranked
from .reshape import expand_axes
from .rows import delta_to_best, sorted_by

#: Points of a grid up to which effects are counted; what is known of each point's ranks goes to every task.
MOST_POINTS = 1 << 16
#: Draws of a place up to which a task holds them (32 MB a pair of columns); the fits of a place with more are sorted over all tasks.
MOST_DRAWS = 1 << 21
#: Fits that a task is dealt at a time at least: observations of a place come in parts of about so many.
FITS_A_PART = 1 << 22
PLACE = ["site", "group", "study"]


def prob_name(prefix: str, prob: float) -> str:
    return f"{prefix}{prob * 100:g}".replace(".", "_")


def posterior_quantiles(
    draws: DataFrame, keys: Sequence[str] = ("param",), value: str = "value",
    probs: Sequence[float] = (0.05, 0.5, 0.95),
) -> DataFrame:
    """Quantiles of each parameter's draws, columns ``q5``, ``q50``, ..."""
    return grouped_quantiles(draws, keys, value, {prob_name("q", p): p for p in probs})


def posterior_summary(
    draws: DataFrame, keys: Sequence[str] = ("param",), value: str = "value",
    probs: Sequence[float] = (0.99, 0.95, 0.9),
) -> DataFrame:
    """Mean, sd, share of positive draws, and central intervals."""
    quantiles = {}
    for p in probs:
        quantiles[f"lower_{prob_name('', p)}_q"] = (1 - p) / 2
        quantiles[f"upper_{prob_name('', p)}_q"] = 1 - (1 - p) / 2
    return grouped_quantiles(draws, keys, value, quantiles, [
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("se"),
        F.avg((F.col(value) > 0).cast("double")).alias("p"),
    ])


def hpd_interval(
    draws: DataFrame, keys: Sequence[str] = ("param",), value: str = "value", prob: float = 0.95
) -> DataFrame:
    """Shortest interval spanning ``gap`` steps of the sorted draws; the lowest one wins ties.

    gap = max(1, min(n-1, round(n*prob))). Every draw has a rank of its own, equal ones too, so the two
    ends of an interval meet by an equi-join on unique keys: no array, window or bucket
    holds a group or a run of equal draws.
    """
    return _shortest(written(ranked(draws, keys, value)), list(keys), prob)


def _shortest(ranks: DataFrame, keys: list[str], prob: float) -> DataFrame:
    """The shortest interval of ranked draws."""
    gap = F.greatest(F.lit(1), F.least(F.col("n") - 1, F.bround(F.col("n") * float(prob)).cast("long")))
    lower = ranks.select("*", (F.col("_rank") + gap).alias("_end")).where("_end <= n").drop("_rank", "n")
    upper = ranks.where(F.col("_rank") > gap).select(F.col("_group").alias("_in"), F.col("_rank").alias("_end"), F.col("_v").alias("_upper"))
    spans = lower.join(upper, (lower["_group"] == upper["_in"]) & (lower["_end"] == upper["_end"]))
    best = spans.groupBy(*[f"`{k}`" for k in keys]).agg(
        F.min(F.struct((F.col("_upper") - F.col("_v")).alias("width"), F.col("_v").alias("lower"),
                       F.col("_upper").alias("upper"))).alias("_s"))
    return best.select(*[F.col(f"`{k}`") for k in keys], "_s.lower", "_s.upper")


def second_half(draws: DataFrame, iteration: str = "iteration") -> DataFrame:
    """Drop the first half of the iterations."""
    last = draws.agg(F.max(iteration).alias("_last"), F.min(iteration).alias("_first"))
    length = F.col("_last") - F.col("_first") + 1
    return with_one_row(draws, last).where(
        F.col(iteration) - F.col("_first") >= length / 2
    ).drop("_last", "_first")


def gelman_rubin(
    draws: DataFrame, keys: Sequence[str] = ("param",), chain: str = "chain", value: str = "value",
    iteration: str | None = "iteration",
) -> DataFrame:
    """Potential scale reduction factor, point estimate with degrees-of-freedom correction.

    Chains are of equal length; with an iteration column only its second half is used.
    """
    keys = list(keys)
    used = second_half(draws, iteration) if iteration else draws
    per_chain = used.groupBy(*keys, chain).agg(
        F.count(value).cast("double").alias("_n"), F.avg(value).alias("_m"), F.var_samp(value).alias("_v")
    ).withColumn("_m2", F.col("_m") * F.col("_m"))
    s = per_chain.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("c"), F.min("_n").alias("n"), F.avg("_v").alias("w"),
        F.avg("_m").alias("mu"), F.var_samp("_m").alias("vm"), F.var_samp("_v").alias("vv"),
        F.covar_samp("_v", "_m2").alias("c2"), F.covar_samp("_v", "_m").alias("c1"),
    )
    c, n, w, b = F.col("c"), F.col("n"), F.col("w"), F.col("n") * F.col("vm")
    var_w = F.col("vv") / c
    var_b = F.try_divide(2 * b * b, c - 1)
    cov_wb = n / c * (F.col("c2") - 2 * F.col("mu") * F.col("c1"))
    pooled = (n - 1) * w / n + (1 + 1 / c) * b / n
    var_pooled = (
        (n - 1) * (n - 1) * var_w + (1 + 1 / c) * (1 + 1 / c) * var_b + 2 * (n - 1) * (1 + 1 / c) * cov_wb
    ) / (n * n)
    df = F.try_divide(2 * pooled * pooled, var_pooled)
    # Identical chains leave the pooled variance no spread: the correction tends to 1.
    correction = F.when(var_pooled == 0, F.lit(1.0)).otherwise((df + 3) / (df + 1))
    r2 = (n - 1) / n + (1 + 1 / c) / n * F.try_divide(b, w)
    return s.select(*keys, F.sqrt(correction * r2).alias("rhat"))


def parameter_table(
    draws: DataFrame, keys: Sequence[str], names: DataFrame | None = None, probs: Sequence[float] = (0.99, 0.95, 0.9),
    value: str = "value", chain: str = "chain", iteration: str = "iteration",
) -> DataFrame:
    """One row per parameter: mean, se, p, shortest and central intervals, scale reduction, and its names.

    The shortest intervals are lower_99, upper_99, ..., the central ones lower_99_q, upper_99_q, ...; ``names`` is
    joined by the columns that it shares with the keys. The draws are ranked once for all shortest intervals.
    """
    keys = list(keys)
    out = posterior_summary(draws, keys, value, probs)
    ranks = written(ranked(draws, keys, value))
    for p in probs:
        ends = {"lower": prob_name("lower_", p), "upper": prob_name("upper_", p)}
        out = natural_join(out, _shortest(ranks, keys, p).withColumnsRenamed(ends), keys, "left")
    out = natural_join(out, gelman_rubin(draws, keys, chain, value, iteration), keys, "left")
    return out if names is None else natural_left_join(out, names)


def stacked_parameters(tables: Mapping[str, DataFrame], grouping: str) -> DataFrame:
    """Tables of parameters under one another, with their parameter's name and the grouping of the model."""
    tagged = [t.withColumns({"parameter": F.lit(name), "grouping": F.lit(grouping)}) for name, t in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


# ---------------------------------------------------------------- model comparison

WAIC_COLUMNS = ["waic", "lpd", "p_waic", "elpd_waic", "p_loo", "elpd_loo"]


def waic_pointwise(log_lik: DataFrame, draw: str = "draw", obs: str = "obs", ll: str = "ll") -> DataFrame:
    """Per observation: waic, lpd, p_waic, elpd_waic, p_loo, elpd_loo.

    Likelihoods are scaled by the observation's largest, importance weights by its
    smallest log-likelihood, so neither underflows; both scales cancel. The table is shuffled once, by
    observation; its extremes, its mean weight and its sums follow from one another on that shuffle. An
    observation has as many rows as there are draws, and Spark spills them.
    """
    group = Window.partitionBy("obs")
    scaled = log_lik.select(F.col(obs).alias("obs"), F.col(ll).alias("_ll")).select(
        "obs", "_ll", F.max("_ll").over(group).alias("_hi"), F.min("_ll").over(group).alias("_lo"),
        F.count("_ll").over(group).cast("double").alias("_s"))
    raw = F.exp(F.col("_lo") - F.col("_ll"))
    whole = scaled.withColumn("_weight", F.least(raw / F.avg(raw).over(group), F.sqrt("_s")))
    like, weight = F.exp(F.col("_ll") - F.col("_hi")), F.col("_weight")
    sums = whole.groupBy("obs").agg(
        F.max("_hi").alias("_hi"), F.var_samp("_ll").alias("p_waic"), F.avg(like).alias("_ml"),
        F.avg(like * weight).alias("_wl"), F.avg(weight).alias("_w"))
    lpd = F.col("_hi") + F.log(F.col("_ml"))
    elpd_loo = F.col("_hi") + F.log(F.col("_wl") / F.col("_w"))
    return sums.select(
        "obs",
        (-2 * (lpd - F.col("p_waic"))).alias("waic"),
        lpd.alias("lpd"),
        "p_waic",
        (lpd - F.col("p_waic")).alias("elpd_waic"),
        (lpd - elpd_loo).alias("p_loo"),
        elpd_loo.alias("elpd_loo"),
    )


def waic(log_lik: DataFrame, **cols) -> DataFrame:
    """Totals over the observations and their standard errors."""
    return totals(waic_pointwise(log_lik, **cols), WAIC_COLUMNS)


def waic_difference(a: DataFrame, b: DataFrame, draw: str = "draw", obs: str = "obs", ll: str = "ll") -> DataFrame:
    """The same totals on the draw-wise difference of two models."""
    other = b.select(draw, obs, F.col(ll).alias("_other"))
    diff = natural_join(a.select(draw, obs, ll), other, [draw, obs], "inner")
    return waic(diff.withColumn(ll, F.col(ll) - F.col("_other")), draw=draw, obs=obs, ll=ll)


def waic_table(models: Mapping[str, DataFrame], **cols) -> DataFrame:
    """One row per model: totals, standard error, and distance to the best, sorted."""
    stacked = None
    for name, log_lik in models.items():
        point = waic_pointwise(log_lik, **cols).agg(
            F.sum("elpd_waic").alias("elpd_waic"), F.sum("p_waic").alias("p_waic"), F.sum("waic").alias("waic"),
            F.sqrt(F.count("waic") * F.var_samp("waic")).alias("se_waic"),
        ).withColumn("mod", F.lit(name))
        stacked = point if stacked is None else stacked.unionByName(point)
    return sorted_by(delta_to_best(stacked), "waic")


# ---------------------------------------------------------------- fitted effects

def _effect(terms: Mapping[str, Sequence[str]]) -> str:
    """SQL of the sum over the coefficients of each times the product of its axes."""
    return " + ".join(" * ".join(f"`{c}`" for c in (coef, *axes)) for coef, axes in terms.items())


def effect_over_axes(
    draws: DataFrame, axes: DataFrame, terms: Mapping[str, Sequence[str]], probs: Mapping[str, float], name: str,
    most_points: int = MOST_POINTS,
) -> DataFrame:
    """Mean and quantiles, over the draws, of an effect at each point of a grid.

    ``axes`` is the one-row table of axis arrays. Each task multiplies its draws with the grid's products
    and counts leading bits of the effects by point; counts travel and effects don't, so the shuffle grows
    with the points and not with the draws. A grid of more than ``most_points`` points is too much to
    send to every task: there each draw is expanded over the axes and the effects are sorted.
    """
    names = [c.removeprefix("axis_") for c in axes.columns]
    row = axes.first()
    if math.prod(len(x) for x in row) <= most_points:
        return counted_quantiles(draws, dict(zip(names, row)), terms, probs, name)
    points = expand_axes(with_one_row(draws.selectExpr(*[f"`{c}`" for c in terms]), axes), names)
    valued = points.selectExpr(*names, f"{_effect(terms)} AS _effect")
    return grouped_quantiles(valued, names, "_effect", probs, [F.avg("_effect").alias(name)])


def linear_predictor(draws: DataFrame, axes: DataFrame, terms: Mapping[str, Sequence[str]], tail: float = 0.1, **how) -> DataFrame:
    """Fitted value at each grid point: mean and the two tail quantiles."""
    return effect_over_axes(draws, axes, terms, {"ci_lb": tail, "ci_ub": 1 - tail}, "pred", **how)


def slope_terms(terms: Mapping[str, Sequence[str]], by: str) -> dict[str, list[str]]:
    """Derivative of a product-term predictor with respect to one axis."""
    return {c: [a for a in axes if a != by] for c, axes in terms.items() if by in axes}


def conditional_effect(draws: DataFrame, axes: DataFrame, terms: Mapping[str, Sequence[str]], by: str, **how) -> DataFrame:
    """Slope of one predictor as the others vary: mean and 5/95 % quantiles."""
    return effect_over_axes(
        draws, axes, slope_terms(terms, by), {"cl_lb": 0.05, "cl_ub": 0.95}, f"{by}_effect", **how
    )


# ---------------------------------------------------------------- hierarchical model

def site_coefficients(
    site_draws: DataFrame, group_draws: DataFrame, membership: DataFrame,
    draw: str = "draw", site: str = "site", group: str = "group",
) -> DataFrame:
    """Site effect plus the effect of its group, draw by draw."""
    placed = natural_join(site_draws, membership.select(site, group).distinct(), [site], "inner")
    both = natural_join(placed, group_draws.withColumnRenamed("value", "_group_value"), [group, draw], "inner")
    return both.withColumn("value", F.col("value") + F.col("_group_value")).drop("_group_value")


def _place_draws(obs: DataFrame, site_draws: DataFrame, group_draws: DataFrame, study_draws: DataFrame) -> DataFrame:
    """The draws of each (site, group, study) that has observations."""
    return (
        obs.select(*PLACE).distinct().join(site_draws, "site")
        .join(group_draws, ["group", "draw"]).join(study_draws, ["study", "draw"])
    )


def pointwise_loglik(
    obs: DataFrame, site_draws: DataFrame, group_draws: DataFrame, study_draws: DataFrame,
    means: bool = False, fits_a_part: int = FITS_A_PART,
) -> DataFrame:
    """Lognormal log-density, standardized residual and mean prediction per draw and observation.

    obs (obs, site, group, study, x, y); site_draws (draw, site, beta1, beta2);
    group_draws (draw, group, mu1, mu2); study_draws (draw, study, sd_e). The draws of
    each (site, group, study) are put together first; the observations, of which there
    are many more, meet them in the last join alone, whose result is what is asked for.

    With ``means``, one row per obs is: the means of resid, y_loc_mu and log_lik over its draws and their number n. Each
    draw's values are worked out and added up in a task, in blocks, so they are no rows of a join.
    """
    if means:
        packs = _packed_draws(_place_draws(obs, site_draws, group_draws, study_draws), _INTERCEPTS_AND_SLOPES | {"own": (*_INTERCEPTS_AND_SLOPES["own"], "sd_e")})
        return density_means(_counted(obs, packs), packs, PLACE, fits_a_part)
    rows = obs.join(_place_draws(obs, site_draws, group_draws, study_draws), PLACE)
    loc = F.col("mu1") + F.col("beta1") + (F.col("mu2") + F.col("beta2")) * F.col("x")
    resid = (F.log("y") - F.col("y_loc")) / F.col("sd_e")
    return rows.withColumn("y_loc", loc).select(
        "obs", "draw", "y", "y_loc",
        (F.col("mu1") + F.col("mu2") * F.col("x")).alias("y_loc_mu"),
        resid.alias("resid"),
        (-F.log("y") - F.log("sd_e") - 0.5 * math.log(2 * math.pi) - resid * resid / 2).alias("log_lik"),
    )


@dataclass(frozen=True)
class ObservedFits:
    """Fits by observation, so that the product of observations and draws is neither shuffled nor written.

    ``rows`` has one row per observation: obs, its place, x, y and the number of its draws, which ``packs`` has packed.
    ``rest`` has, one per row as of :func:`pointwise_loglik`, the fits of observations that repeat an obs or have too
    many draws for a task; None if there are none. ``long`` has those of all observations.
    """

    rows: DataFrame
    packs: DataFrame
    fits_a_part: int
    rest: DataFrame | None
    long: DataFrame

    def tables(self, prob: float, prefixes: Mapping[str, str]) -> DataFrame:
        """obs, y, and the mean (named by the prefix) and shortest interval of exp of each of y_loc and y_loc_mu that has a prefix."""
        return summaries(self.rows, self.packs, PLACE, {_DRAWS_OF[loc]: p for loc, p in prefixes.items()}, prob, self.fits_a_part)


#: The intercepts and slopes of each prediction.
_DRAWS_OF = {"y_loc": "own", "y_loc_mu": "mu"}
_INTERCEPTS_AND_SLOPES = {"own": ("_intercept", "_slope"), "mu": ("mu1", "mu2")}


def _packed_draws(draws: DataFrame, sets: Mapping[str, Sequence[str]]) -> DataFrame:
    """The draws of each place in a form that observations meet in a task, written, since sizes are read from them first."""
    lines = draws.withColumns({"_intercept": F.col("mu1") + F.col("beta1"), "_slope": F.col("mu2") + F.col("beta2")})
    return written(packed(lines, PLACE, sets))


def _counted(obs: DataFrame, packs: DataFrame) -> DataFrame:
    """The observations that have draws, with their number _n."""
    return obs.select(*PLACE, "obs", "x", "y").join(packs.groupBy(*PLACE).agg(F.sum("_n").alias("_n")), PLACE)


def observed_fits(
    obs: DataFrame, site_draws: DataFrame, group_draws: DataFrame, study_draws: DataFrame,
    most_draws: int = MOST_DRAWS, fits_a_part: int = FITS_A_PART,
) -> ObservedFits:
    """The fits of :func:`pointwise_loglik`, by observation.

    Each place's draws are packed and sent to the parts of its observations, which are cut by the
    number of their fits, so a place that most observations have is dealt to many tasks.
    """
    model = (site_draws, group_draws, study_draws)
    packs = _packed_draws(_place_draws(obs, *model), _INTERCEPTS_AND_SLOPES)
    alone = F.count(F.lit(1)) == 1
    by_obs = written(_counted(obs, packs).groupBy("obs").agg(
        alone.alias("_alone"), F.any_value(F.struct(*PLACE, "x", "y", "_n")).alias("_row")))
    fitting = F.col("_alone") & (F.col("_row._n") <= most_draws)
    others = by_obs.where(~fitting).select("obs")
    rows = by_obs.where(fitting).select("obs", "_row.*")
    rest = None if others.isEmpty() else pointwise_loglik(natural_join(obs, others, ["obs"], "left_semi"), *model)
    return ObservedFits(rows, packs, fits_a_part, rest, pointwise_loglik(obs, *model))


def residual_table(
    fits: DataFrame | ObservedFits, prob: float = 0.95, fit: Column | None = None, loc: str = "y_loc",
) -> DataFrame:
    """Per observation: mean fitted value, shortest interval, residual.

    The fitted value is exp of the column ``loc``, or the expression ``fit`` of the rows of :func:`pointwise_loglik`.
    Fits by observation are summarized where they are worked out; only others are sorted over all tasks.
    """
    if isinstance(fits, ObservedFits):
        if fit is not None:
            return residual_table(fits.long, prob, fit)
        whole = fits.tables(prob, {loc: "y_hat"}).withColumn("resid", F.col("y") - F.col("y_hat"))
        return whole if fits.rest is None else whole.unionByName(residual_table(fits.rest, prob, loc=loc))
    fitted = fits.select("obs", "y", (F.exp(loc) if fit is None else fit).alias("_fit"))
    means = fitted.groupBy("obs").agg(F.any_value("y").alias("y"), F.avg("_fit").alias("y_hat"))
    shortest = hpd_interval(fitted, ["obs"], "_fit", prob).withColumnsRenamed(
        {"lower": "y_hat_L", "upper": "y_hat_U"}
    )
    return natural_join(means, shortest, ["obs"], "left").withColumn("resid", F.col("y") - F.col("y_hat"))


def fitted_table(fits: DataFrame | ObservedFits, prob: float = 0.95) -> DataFrame:
    """Per observation: the fitted value and the fit of its group alone, each with its shortest interval, and the residual."""
    if isinstance(fits, ObservedFits):
        whole = fits.tables(prob, {"y_loc": "y_hat", "y_loc_mu": "y_hat_mu"}).select(
            "obs", "y", "y_hat", "y_hat_L", "y_hat_U", (F.col("y") - F.col("y_hat")).alias("resid"), "y_hat_mu", "y_hat_mu_L", "y_hat_mu_U")
        return whole if fits.rest is None else whole.unionByName(fitted_table(fits.rest, prob))
    own = residual_table(fits, prob)
    group = residual_table(fits, prob, loc="y_loc_mu").select(
        "obs", F.col("y_hat").alias("y_hat_mu"), F.col("y_hat_L").alias("y_hat_mu_L"), F.col("y_hat_U").alias("y_hat_mu_U"))
    return natural_join(own, group, ["obs"], "left")
