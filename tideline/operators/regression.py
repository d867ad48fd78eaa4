"""Multi-predictor regression, meta-regression and model columns.

Only sums of a fixed size (predictors squared) leave the executors.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import RFormula
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.distributions import normal_tail_sql
from ..functions.semantics import named
from .filters import complete_cases
from .joins import with_one_row
from .materialize import written


def multi_ols(df: DataFrame, formula: str) -> PipelineModel:
    """Ordinary least squares of an R-style formula, solved from the normal equations."""
    return Pipeline(stages=[
        RFormula(formula=formula, featuresCol="_x", labelCol="_y", forceIndexLabel=False),
        LinearRegression(featuresCol="_x", labelCol="_y", solver="normal", regParam=0.0,
                         fitIntercept=not formula.replace(" ", "").endswith("-1")),
    ]).fit(df)


def term_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the fitted terms in the model's order, read from the feature column's metadata."""
    meta = model.stages[0].transform(df.limit(0)).schema["_x"].metadata["ml_attr"]["attrs"]
    ordered = sorted((a for group in meta.values() for a in group), key=lambda a: a["idx"])
    return [a["name"] for a in ordered]


def coefficients(model: PipelineModel, df: DataFrame) -> DataFrame:
    """One row per term: estimate, std.error, statistic, p.value."""
    fit = model.stages[1]
    names = term_names(model, df)
    values = [float(v) for v in fit.coefficients]
    if fit.getFitIntercept():
        names, values = [*names, "(Intercept)"], [*values, float(fit.intercept)]
    s = fit.summary
    rows = [
        (n, v, float(se), float(t), float(p))
        for n, v, se, t, p in zip(names, values, s.coefficientStandardErrors, s.tValues, s.pValues)
    ]
    return df.sparkSession.createDataFrame(
        rows, "term string, estimate double, `std.error` double, statistic double, `p.value` double"
    )


def predict(model: PipelineModel, grid: DataFrame) -> DataFrame:
    """Fitted values at new points."""
    return model.transform(grid).drop("_x", "_y").withColumnRenamed("prediction", "pred")


def interaction_terms(names: Sequence[str]) -> list[tuple[str, ...]]:
    """Main effects and all their interactions, lower orders first."""
    return [c for k in range(1, len(names) + 1) for c in itertools.combinations(names, k)]


def design_matrix(df: DataFrame, names: Sequence[str], keep: Sequence[str] = (), intercept: bool = True) -> DataFrame:
    """One numeric column per main effect and interaction, named ``a:b:c``."""
    def product(combo: Sequence[str]) -> Column:
        out = F.col(combo[0]).cast("double")
        for c in combo[1:]:
            out = out * F.col(c)
        return out

    columns = [product(c).alias(":".join(c)) for c in interaction_terms(names)]
    if intercept:
        columns.insert(0, F.lit(1.0).alias("(Intercept)"))
    return df.select(*keep, *columns)


def poly2(df: DataFrame, column: str) -> DataFrame:
    """Orthogonal linear and quadratic terms, each of length one over the table."""
    stats = df.agg(
        F.count(column).alias("_n"), F.avg(column).alias("_m"), F.var_pop(column).alias("_v"),
        F.skewness(column).alias("_g"), F.kurtosis(column).alias("_k"),
    )
    n, v = F.col("_n"), F.col("_v")
    s2, s3, s4 = n * v, n * F.col("_g") * F.pow(v, 1.5), n * (F.col("_k") + 3) * v * v
    z = F.col(column) - F.col("_m")
    length2 = s4 - F.try_divide(s3 * s3, s2) - F.try_divide(s2 * s2, n)
    return with_one_row(df, stats).withColumns({
        f"{column}_1": F.try_divide(z, F.sqrt(s2)),
        f"{column}_2": F.try_divide(z * z - F.try_divide(s3, s2) * z - F.try_divide(s2, n), F.sqrt(length2)),
    }).drop("_n", "_m", "_v", "_g", "_k")


# ---------------------------------------------------------------- meta-regression

_TAU2_GRID = 65
_TAU2_ROUNDS = 6


def _study_sums(df: DataFrame, y: str, variance: str, terms: Sequence[str], group: str) -> DataFrame:
    """Inverse-variance weighted sums per study; all the model needs from the rows."""
    w = F.lit(1.0) / F.col(variance)
    x = [named(t) for t in terms] + [F.col(y)]
    p = len(x)
    return df.groupBy(group).agg(
        F.sum(w).alias("s"),
        F.sum(F.log(variance)).alias("logv"),
        F.count(F.lit(1)).alias("n"),
        *[F.sum(w * x[i]).alias(f"b{i}") for i in range(p)],
        *[F.sum(w * x[i] * x[j]).alias(f"a{i}_{j}") for i in range(p) for j in range(i, p)],
    )


def _eliminated(p: int) -> str:
    """SQL: Gauss-Jordan over the rows of array ``m``, (matrix | identity | right side), p of 2p + 1 entries each.

    What follows the rows adds up the logarithms of the pivots. An entry without a pivot is missing.
    """
    w, end = 2 * p + 1, p * (2 * p + 1)
    pivot = f"m[k * {w} + k]"
    return (f"aggregate(sequence(0, {p - 1}), m, (m, k) -> transform(sequence(0, {end}), e -> CASE"
            f" WHEN e = {end} THEN m[e] + ln({pivot})"
            f" WHEN e DIV {w} = k THEN try_divide(m[e], {pivot})"
            f" ELSE m[e] - try_divide(m[(e DIV {w}) * {w} + k] * m[k * {w} + e % {w}], {pivot}) END))")


def _profile_sql(p: int, at: str) -> str:
    """SQL: one row per candidate variance of relation ``at`` (k, t, lo, hi, unit), joined with the studies' sums.

    (k, t, lo, hi, unit, n, ll, score, m): restricted log-likelihood, its derivative by the variance, and the solved matrix:
    of row i the inverse is in columns p to 2p - 1 and the coefficient in column 2p.
    """
    w = 2 * p + 1
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    name = lambda c, i, j: f"{c}{min(i, j)}_{max(i, j)}"
    sums = ", ".join(f"sum(a{i}_{j} - t / (1 + t * s) * b{i} * b{j}) AS q{i}_{j},"
                     f" sum(b{i} * b{j} / ((1 + t * s) * (1 + t * s))) AS e{i}_{j}" for i, j in pairs)
    rows = ", ".join([name("q", i, j) for j in range(p)][c] if c < p else ("1D" if c - p == i else "0D") if c < 2 * p else name("q", i, p)
                     for i in range(p) for c in range(w))
    beta = [f"m[{i * w + 2 * p}]" for i in range(p)]
    rss = f"q{p}_{p}" + "".join(f" - {name('q', i, p)} * {b}" for i, b in enumerate(beta))
    trace = " + ".join(f"m[{i * w + p + j}] * {name('e', i, j)}" for i in range(p) for j in range(p))
    moved = (f"e{p}_{p}" + "".join(f" - 2 * {b} * {name('e', i, p)}" for i, b in enumerate(beta))
             + "".join(f" + {beta[i]} * {beta[j]} * {name('e', i, j)}" for i in range(p) for j in range(p)))
    return f"""
    SELECT k, t, lo, hi, unit, n, m, -0.5D * ((n - {p}) * {math.log(2 * math.pi)!r}D + logdet + m[{p * w}] + {rss}) AS ll,
           -0.5D * (lifted - ({trace}) - ({moved})) AS score
    FROM (SELECT * EXCEPT (m), {_eliminated(p)} AS m FROM (
      SELECT *, array({rows}, 0D) AS m FROM (
        SELECT k, t, lo, hi, unit, sum(n) AS n, sum(logv + log1p(t * s)) AS logdet, sum(s / (1 + t * s)) AS lifted, {sums}
        FROM (SELECT * FROM {{sums}} CROSS JOIN {at}) GROUP BY k, t, lo, hi, unit)))"""


def meta_regression(
    df: DataFrame, y: str, variance: str, terms: Sequence[str], group: str, level: float = 0.95
) -> DataFrame:
    """Known-variance weighted regression with a random intercept per study.

    One pass makes the studies' sufficient sums, which are written. The study variance maximizes the
    restricted likelihood: of a grid on tau2/(1+tau2) the best point's neighbors enclose it, and rounds of
    the same grid enclose the place where the derivative turns negative. A round is one
    aggregate over the studies with the candidates as rows, and writes the one row of the next round's ends;
    nothing comes to the driver. Rows: term, estimate, se, zval, pval, ci.lb, ci.ub, sig, tau2; missing values if the
    terms depend on one another.
    """
    rows = complete_cases(df.where(F.col(variance) > 0), [y, *terms, group])
    p = len(terms)
    sums = written(_study_sums(rows, y, variance, terms, group))
    unit = rows.agg(F.coalesce(F.nullif(F.var_samp(y), F.lit(0.0)), F.lit(1.0)).alias("unit"))
    g, reach = _TAU2_GRID, _normal_quantile(0.5 + level / 2)
    spark = df.sparkSession
    ends = spark.sql(f"SELECT 0D AS lo, {1 - 1e-9!r}D AS hi, unit FROM {{unit}}", unit=unit)
    u = f"(lo + (hi - lo) * k / {g - 1})"
    at = f"(SELECT *, unit * {u} / (1 - {u}) AS t FROM (SELECT *, explode(sequence(0, {g - 1})) AS k FROM {{ends}}))"
    for k in range(_TAU2_ROUNDS):
        # the first round takes the highest point, the others the last one from which the likelihood still rises
        best, low = ("coalesce(max(k) FILTER (WHERE score > 0), 0)", "i") if k else ("max_by(k, struct(ll, -k))", "greatest(i - 1, 0)")
        ends = written(spark.sql(  # one row; without the cut the plan would grow by a round's sums each time
            f"""
            SELECT lo + (hi - lo) * {low} / {g - 1} AS lo, lo + (hi - lo) * least(i + 1, {g - 1}) / {g - 1} AS hi, unit
            FROM (SELECT {best} AS i, any_value(lo) AS lo, any_value(hi) AS hi, any_value(unit) AS unit FROM ({_profile_sql(p, at)}))
            """, sums=sums, ends=ends))
    w = 2 * p + 1
    found = ", ".join(f"struct({i} AS place, {_text(t)} AS term, m[{i * w + 2 * p}] AS estimate, sqrt(m[{i * w + p + i}]) AS se)"
                      for i, t in enumerate(terms))
    solved = _profile_sql(p, "(SELECT *, 0 AS k, unit * lo / (1 - lo) AS t FROM {ends})")
    return spark.sql(
        f"""
        SELECT term, estimate, se, estimate / se AS zval, pval, estimate - {reach!r}D * se AS `ci.lb`,
               estimate + {reach!r}D * se AS `ci.ub`, pval <= {1 - level!r}D AS sig, tau2
        FROM (SELECT *, {normal_tail_sql("(estimate / se)")} AS pval
              FROM (SELECT t AS tau2, inline(array({found})) FROM ({solved}))) ORDER BY place
        """, sums=sums, ends=ends)


def _text(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)
