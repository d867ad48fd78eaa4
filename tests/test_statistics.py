"""Numeric references in numpy, and properties that must hold."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F, types as T

from tideline.functions.distributions import normal_two_sided_p, t_two_sided_p
from tideline.operators import climate, fits, posterior, quantiles, regression, reshape, rows, trend

RNG = np.random.default_rng(7)


def t_tail(t, df):
    """Two-sided tail by numerical integration over the angle atan(t / sqrt(df))."""
    lo, hi = math.atan(abs(t) / math.sqrt(df)), min(math.pi / 2, 40 / math.sqrt(df))
    angle = np.linspace(lo, hi, 400_001)
    logc = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(math.pi)
    return 2 * np.trapezoid(np.exp(logc + (df - 1) * np.log(np.maximum(np.cos(angle), 1e-300))), angle)


def test_t_tail(spark):
    pairs = [(t, df) for t in (0.0, 0.3, 1.7, 2.5, 6.0) for df in (1, 2, 3, 7, 10, 41, 500, 2000, 2001, 9000, 10**6)]
    out = spark.createDataFrame(pairs, "t double, df bigint").withColumn("p", t_two_sided_p("t", "df"))
    for r in out.collect():
        assert r["p"] == pytest.approx(t_tail(r["t"], r["df"]), abs=2e-7), (r["t"], r["df"])


def test_normal_tail(spark):
    out = spark.createDataFrame([(z / 4,) for z in range(0, 60)], "z double").withColumn("p", normal_two_sided_p("z"))
    for r in out.collect():
        assert r["p"] == pytest.approx(math.erfc(r["z"] / math.sqrt(2)), rel=1e-6, abs=1e-15)


def test_trend_matches_numpy_and_recovers_known_slopes(spark):
    data, fits = [], {}
    for g, (slope, sd) in enumerate([(1.0, 5.0), (5.0, 15.0), (3.0, 8.0)]):
        x = np.arange(1900, 2000)
        y = 1 + slope * x + RNG.normal(0, sd, len(x))
        data += [(g, int(a), float(b)) for a, b in zip(x, y)]
        c, cov = np.polyfit(x - x.mean(), y, 1, cov=True)
        fits[g] = (c[0], math.sqrt(cov[0, 0]), slope)
    df = spark.createDataFrame(data, "g int, Year int, y double")
    for r in trend.group_trend(df, ["g"], "Year", "y").collect():
        est, se, true = fits[r["g"]]
        assert r["estimate"] == pytest.approx(est, rel=1e-9)
        assert r["std.error"] == pytest.approx(se, rel=1e-9)
        assert abs(r["estimate"] - true) < 5 * se
        assert r["p.value"] == pytest.approx(t_tail(est / se, 98), abs=1e-9)


def test_many_variable_trends_leave_missing_variables_null(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 2.0, None), ("b", 1, None, None)],
                               "SiteName string, Year int, v double, w double")
    out = trend.multi_trend(df, ["SiteName"], "Year", ["v", "w"]).collect()
    assert len(out) == 1 and out[0]["v_estimate"] == 1.0 and out[0]["w_estimate"] is None


@pytest.fixture(scope="module")
def grouped(spark):
    data = [("hot", float(v)) for v in np.round(RNG.normal(0, 1, 3000), 2)] + [("hot", 0.25)] * 2000
    data += [(f"g{i}", float(v)) for i in range(20) for v in RNG.exponential(1, 7)] + [(None, 1.0), (None, 4.0), ("empty", None)]
    return spark.createDataFrame(data, "k string, v double")


PROBS = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 0.975, "f": 1.0}


def quantiles_by_hand(frame):
    pdf = frame.toPandas()
    return {k: pdf.loc[pdf["k"].isna() if k is None else pdf["k"] == k, "v"].dropna().to_numpy()
            for k in set(pdf["k"].map(lambda k: k if isinstance(k, str) else None))}


@pytest.fixture
def many_tasks(spark):
    """Small partitions stay apart, so that groups are cut."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_of_hot_empty_and_missing_groups(many_tasks, grouped):
    got = {r["k"]: r for r in quantiles.grouped_quantiles(grouped, ["k"], "v", PROBS, [F.avg("v").alias("m")]).collect()}
    by_hand = quantiles_by_hand(grouped)
    for k, r in got.items():
        for name, p in PROBS.items():
            assert (r[name] is None) if not len(by_hand[k]) else r[name] == pytest.approx(np.quantile(by_hand[k], p), abs=1e-12), (k, name)
    assert set(got) == set(by_hand)
    assert {r["k"] for r in quantiles.grouped_quantiles(grouped, ["k"], "v", PROBS).collect()} == set(by_hand)


def test_quantiles_of_equal_and_of_extreme_values(many_tasks):
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e-310, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308,
           1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 0), 2.0, 0.1, -0.1, 1e300, 3.0]
    df = many_tasks.createDataFrame([("same", 7.25)] * 5000 + [("odd", float(v)) for v in odd] + [("one", -3.5)], "k string, v double")
    ranks = {f"q{i}": i / (len(odd) - 1) for i in range(len(odd))}
    got = {r["k"]: r for r in quantiles.grouped_quantiles(df, ["k"], "v", ranks).collect()}
    assert {got["same"][q] for q in ranks} == {7.25} and {got["one"][q] for q in ranks} == {-3.5}
    # a place that is whole but for rounding lies a hair's breadth beside it
    assert [got["odd"][q] for q in ranks] == pytest.approx(sorted(odd), rel=1e-9, abs=1e-320)


def test_a_hot_group_and_a_run_of_equal_values_are_dealt_out(many_tasks):
    df = many_tasks.createDataFrame([("same", 1.0)] * 8000 + [(f"g{i}", float(i)) for i in range(500)], "k string, v double")
    runs = quantiles.SortedRuns(df.repartition(8), ["k"], "v").runs().where("k = 'same'").collect()
    assert len(runs) >= 4 and max(r["_count"] for r in runs) <= 4000
    assert sum(r["_count"] for r in runs) == 8000 and {r["n"] for r in runs} == {8000}


def test_ranks_are_all_different(many_tasks, grouped):
    rows = quantiles.ranked(grouped, ["k"], "v").collect()
    for k, v in quantiles_by_hand(grouped).items():
        own = sorted((r["_rank"], r["_v"]) for r in rows if r["k"] == k)
        assert [a for a, _ in own] == list(range(1, len(v) + 1)) and [b for _, b in own] == sorted(v)
        assert all(r["n"] == len(v) for r in rows if r["k"] == k)
    assert len({(r["_group"], r["k"]) for r in rows}) == len({r["_group"] for r in rows})


def hpd(v, prob):
    v = np.sort(v)
    n = len(v)
    gap = max(1, min(n - 1, int(np.round(n * prob))))
    i = int(np.argmin(v[gap:] - v[:-gap]))
    return v[i], v[i + gap]


@pytest.mark.parametrize("prob", [0.5, 0.9, 0.99])
def test_shortest_interval(many_tasks, grouped, prob):
    out = {r["k"]: r for r in posterior.hpd_interval(grouped, ["k"], "v", prob).collect()}
    for k, v in quantiles_by_hand(grouped).items():
        if len(v) < 2:
            assert k not in out
            continue
        assert (out[k]["lower"], out[k]["upper"]) == pytest.approx(hpd(v, prob)), k
        if len(v) > 50:
            lo, hi = np.quantile(v, [(1 - prob) / 2, 1 - (1 - prob) / 2])
            assert out[k]["upper"] - out[k]["lower"] <= hi - lo + 0.02


def test_shortest_interval_of_very_many_equal_draws(spark):
    draws = spark.range(1_000_000).selectExpr("id % 2 AS k", "CASE WHEN id % 1000 = 1 THEN id / 1e6 ELSE 0.5 END AS v")
    out = {r["k"]: (r["lower"], r["upper"]) for r in posterior.hpd_interval(draws, ["k"], "v", 0.9).collect()}
    assert out == {0: (0.5, 0.5), 1: (0.5, 0.5)}


def chains_frame(spark, values):
    rows_ = [(c, i, "p", float(x)) for c, chain in enumerate(values) for i, x in enumerate(chain)]
    return spark.createDataFrame(rows_, "chain int, iteration int, param string, value double")


def psrf(chains):
    m, n = chains.shape
    x, s2 = chains.mean(1), chains.var(1, ddof=1)
    w, b = s2.mean(), n * x.var(ddof=1)
    v = (n - 1) / n * w + (1 + 1 / m) * b / n
    cov = lambda a, c: np.cov(a, c, ddof=1)[0, 1]
    var_v = ((n - 1) ** 2 * s2.var(ddof=1) / m + (1 + 1 / m) ** 2 * 2 * b * b / (m - 1)
             + 2 * (n - 1) * (1 + 1 / m) * n / m * (cov(s2, x * x) - 2 * x.mean() * cov(s2, x))) / n**2
    df = 2 * v * v / var_v
    return math.sqrt((df + 3) / (df + 1) * ((n - 1) / n + (1 + 1 / m) / n * b / w))


def test_gelman_rubin(spark):
    chains = RNG.normal(0, 1, (4, 60))
    chains[2] += 0.7
    df = chains_frame(spark, chains)
    assert posterior.gelman_rubin(df, iteration=None).first()["rhat"] == pytest.approx(psrf(chains), rel=1e-9)
    assert posterior.gelman_rubin(df).first()["rhat"] == pytest.approx(psrf(chains[:, 30:]), rel=1e-9)
    equal = chains_frame(spark, [chains[0], chains[0]])
    assert posterior.gelman_rubin(equal, iteration=None).first()["rhat"] == pytest.approx(math.sqrt(59 / 60), rel=1e-6)


def waic_numpy(ll):
    s = len(ll)
    hi, lo = ll.max(0), ll.min(0)
    lpd = hi + np.log(np.exp(ll - hi).mean(0))
    p = ll.var(0, ddof=1)
    w = np.exp(lo - ll)
    w = np.minimum(w / w.mean(0), math.sqrt(s))
    loo = hi + np.log((np.exp(ll - hi) * w).mean(0) / w.mean(0))
    return {"waic": -2 * (lpd - p), "lpd": lpd, "p_waic": p, "elpd_waic": lpd - p, "p_loo": lpd - loo, "elpd_loo": loo}


def ll_frame(spark, ll):
    return spark.createDataFrame(
        [(d, o, float(ll[d, o])) for d in range(ll.shape[0]) for o in range(ll.shape[1])], "draw int, obs int, ll double")


@pytest.mark.parametrize("shift", [0.0, -800.0])
def test_waic(spark, shift):
    ll = shift + RNG.normal(-2, 1.2, (40, 6))
    want = waic_numpy(ll)
    out = {r["quantity"]: r for r in posterior.waic(ll_frame(spark, ll)).collect()}
    for name, v in want.items():
        assert out[name]["total"] == pytest.approx(v.sum(), rel=1e-8)
        assert out[name]["se"] == pytest.approx(math.sqrt(6 * v.var(ddof=1)), rel=1e-6)


def test_waic_of_a_model_minus_itself_is_zero(spark):
    frame = ll_frame(spark, RNG.normal(-2, 1, (20, 4)))
    assert all(r["total"] == pytest.approx(0.0) for r in posterior.waic_difference(frame, frame).collect())
    table = posterior.waic_table({"a": frame, "b": frame.withColumn("ll", F.col("ll") - 1)}).collect()
    assert [r["mod"] for r in table] == ["a", "b"] and table[0]["delta"] == 0 and table[1]["delta"] == pytest.approx(8.0)


def test_hierarchical_predictions_of_two_sites(spark):
    obs = spark.createDataFrame([(0, 0, 0, 0, 1.0, 2.0), (1, 1, 0, 1, -1.0, 0.5)],
                                "obs int, site int, group int, study int, x double, y double")
    site = spark.createDataFrame([(0, 0, 0.1, 0.2), (0, 1, -0.1, 0.0), (1, 0, 0.3, 0.1), (1, 1, 0.0, 0.4)],
                                 "draw int, site int, beta1 double, beta2 double")
    group = spark.createDataFrame([(0, 0, 0.5, 0.1), (1, 0, 0.4, -0.1)], "draw int, group int, mu1 double, mu2 double")
    study = spark.createDataFrame([(d, s, 0.5 + 0.1 * s) for d in (0, 1) for s in (0, 1)], "draw int, study int, sd_e double")
    out = {(r["obs"], r["draw"]): r for r in posterior.pointwise_loglik(obs, site, group, study).collect()}
    loc, sd, y = 0.5 - 0.1 + (0.1 + 0.0) * -1.0, 0.6, 0.5
    z = (math.log(y) - loc) / sd
    r = out[(1, 0)]
    assert r["y_loc"] == pytest.approx(loc) and r["resid"] == pytest.approx(z) and r["y_loc_mu"] == pytest.approx(0.4)
    assert r["log_lik"] == pytest.approx(-math.log(y * sd * math.sqrt(2 * math.pi)) - z * z / 2)
    table = {r["obs"]: r for r in posterior.residual_table(posterior.pointwise_loglik(obs, site, group, study)).collect()}
    fits = [math.exp(out[(0, d)]["y_loc"]) for d in (0, 1)]
    assert table[0]["y_hat"] == pytest.approx(sum(fits) / 2) and table[0]["resid"] == pytest.approx(2.0 - sum(fits) / 2)
    assert (table[0]["y_hat_L"], table[0]["y_hat_U"]) == pytest.approx((min(fits), max(fits)))
    summed = posterior.site_coefficients(
        site.select("draw", "site", F.col("beta1").alias("value")), group.select("draw", "group", F.col("mu1").alias("value")),
        obs.select("site", "group"))
    assert {(r["draw"], r["site"]): round(r["value"], 9) for r in summed.collect()} == {
        (0, 0): 0.6, (0, 1): 0.4, (1, 0): 0.7, (1, 1): 0.4}


def test_orthogonal_quadratic(spark):
    x = RNG.gamma(2, 1, 200)
    out = regression.poly2(spark.createDataFrame([(float(v),) for v in x], "x double"), "x").toPandas()
    a, b = out["x_1"].to_numpy(), out["x_2"].to_numpy()
    assert np.allclose([a @ a, b @ b, a @ b, a.sum(), b.sum()], [1, 1, 0, 0, 0], atol=1e-9)


def test_ols_with_interaction(spark):
    x, z = RNG.normal(0, 1, 300), RNG.normal(0, 1, 300)
    y = 2 + 1.5 * x - z + 0.5 * x * z + RNG.normal(0, 0.3, 300)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(y, x, z)], "y double, x double, z double")
    model = regression.multi_ols(df, "y ~ x * z")
    got = {r["term"]: r for r in regression.coefficients(model, df).collect()}
    m = np.column_stack([np.ones(300), x, z, x * z])
    beta, rss, *_ = np.linalg.lstsq(m, y, rcond=None)
    se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * rss[0] / 296)
    for name, b, s in zip(("(Intercept)", "x", "z", "x:z"), beta, se):
        assert got[name]["estimate"] == pytest.approx(b, rel=1e-6) and got[name]["std.error"] == pytest.approx(s, rel=1e-6)
    pred = regression.predict(model, spark.createDataFrame([(1.0, 2.0)], "x double, z double")).first()["pred"]
    assert pred == pytest.approx(beta @ [1, 1, 2, 2])


def test_ols_factor_without_intercept(spark):
    data = [("a", 1.0, 2.0), ("a", 2.0, 3.1), ("a", 3.0, 3.9), ("b", 1.0, 5.0), ("b", 2.0, 6.2), ("b", 4.0, 7.9)]
    df = spark.createDataFrame(data, "k string, x double, y double")
    model = regression.multi_ols(df, "y ~ k + x - 1")
    assert len(regression.term_names(model, df)) == len(model.stages[1].coefficients)
    assert not model.stages[1].getFitIntercept()


def test_meta_regression_against_a_dense_solution(spark):
    studies, data = 12, []
    for g in range(studies):
        u = RNG.normal(0, 0.6)
        for _ in range(int(RNG.integers(2, 7))):
            x, v = RNG.normal(), RNG.uniform(0.05, 0.4)
            data.append((f"s{g}", 1.0, float(x), float(v), float(1 + 0.8 * x + u + RNG.normal(0, math.sqrt(v)))))
    df = spark.createDataFrame(data, ["Study", "one", "x", "v", "y"])
    out = {r["term"]: r for r in regression.meta_regression(df, "y", "v", ["one", "x"], "Study").collect()}
    x = np.array([[d[1], d[2]] for d in data])
    y, v, g = (np.array([d[i] for d in data]) for i in (4, 3, 0))
    same = (g[:, None] == g[None, :]).astype(float)

    def fit(t):
        vi = np.linalg.inv(np.diag(v) + t * same)
        xx = x.T @ vi @ x
        beta = np.linalg.solve(xx, x.T @ vi @ y)
        e = y - x @ beta
        ll = -0.5 * (np.linalg.slogdet(np.diag(v) + t * same)[1] + np.linalg.slogdet(xx)[1] + e @ vi @ e)
        return ll, beta, xx

    tau2 = out["x"]["tau2"]
    best = fit(tau2)
    assert all(best[0] >= fit(t)[0] - 1e-9 for t in np.linspace(0, 3, 601))
    assert [out["one"]["estimate"], out["x"]["estimate"]] == pytest.approx(list(best[1]), rel=1e-7)
    se = np.sqrt(np.diag(np.linalg.inv(best[2])))
    assert [out["one"]["se"], out["x"]["se"]] == pytest.approx(list(se), rel=1e-7)
    assert out["x"]["sig"] == (out["x"]["pval"] <= 0.05)


def test_zscore_has_mean_zero_and_sd_one(spark):
    df = spark.createDataFrame([(i % 2, float(v), 1.0) for i, v in enumerate(RNG.normal(5, 3, 100))], "g int, x double, e double")
    s = rows.zscore(df, ["x"], errors={"x": "e"}).agg(F.avg("x_scale"), F.stddev_samp("x_scale")).first()
    assert list(s) == pytest.approx([0, 1], abs=1e-12)
    by = rows.zscore(df, ["x"], by=["g"]).groupBy("g").agg(F.avg("x_scale").alias("m"), F.stddev_samp("x_scale").alias("s"))
    assert all((r["m"], r["s"]) == pytest.approx((0, 1), abs=1e-12) for r in by.collect())
    back = rows.unscale(rows.zscore(df, ["x"]).drop("x"), ["x"], rows.scale_stats(df, ["x"]))
    assert sorted(r["x"] for r in back.collect()) == pytest.approx(sorted(r["x"] for r in df.collect()))


def test_long_and_back_is_the_same_table(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, 4.0)], "k int, a double, b double")
    back = reshape.spread(reshape.to_long(df, ["k"], "name", "v"), ["k"], "name", "v", ["a", "b"])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert reshape.to_long(df, ["k"], "name", "v", drop_nulls=True).count() == 2


def test_grid_is_the_product_of_its_axes(spark):
    df = spark.createDataFrame([(float(i), float(i % 4)) for i in range(9)], "x double, y double")
    g = reshape.grid(df, spaced_over={"x": 5}, quantiles={"y": (0.25, 0.75)}, literals={"c": ("a", "b")})
    assert g.count() == 5 * 2 * 2
    assert sorted({r["x"] for r in g.collect()}) == [0, 2, 4, 6, 8]


def test_totals(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    r = climate.totals(df, ["x"]).first()
    assert r["total"] == 7 and r["se"] == pytest.approx(math.sqrt(3 * np.var([1, 2, 4], ddof=1)))


@pytest.fixture(scope="module")
def effect_draws(spark):
    r = np.random.default_rng(5)
    rows_ = [tuple(map(float, r.normal(0, 10.0 ** r.integers(-3, 4), 3))) for _ in range(400)]
    rows_ += [(0.5, 0.25, -1.0)] * 300 + [(None, 1.0, 1.0), (float("nan"), 1.0, 1.0), (1.0, 0.0, -0.0)]
    return spark.createDataFrame(rows_, "b double, b_x double, `b_x:y` double"), [x for x in rows_ if None not in x and not np.isnan(x).any()]


EFFECT_TERMS = {"b": [], "b_x": ["x"], "b_x:y": ["x", "y"]}


@pytest.mark.parametrize("most_points", [1 << 16, 0])
@pytest.mark.parametrize("cells", [1 << 21, 10])
def test_effects_by_counts_and_by_sorting(spark, effect_draws, monkeypatch, most_points, cells):
    from tideline.operators import effects

    monkeypatch.setattr(effects, "CELLS", cells)
    draws, sound = effect_draws
    draws = draws.where("NOT isnan(b) OR b IS NULL")
    axes = spark.range(1).select(F.array(*map(F.lit, [-2.0, 0.0, 1e-9])).alias("axis_x"), F.array(*map(F.lit, [1.0, 3.0])).alias("axis_y"))
    got = {(r["x"], r["y"]): r for r in posterior.effect_over_axes(
        draws, axes, EFFECT_TERMS, {"low": 0.0, "q": 0.37, "mid": 0.5, "high": 1.0}, "m", most_points).collect()}
    assert len(got) == 6
    for (x, y), r in got.items():
        v = np.array([a + b * x + c * x * y for a, b, c in sound])
        assert r["m"] == pytest.approx(v.mean(), rel=1e-9, abs=1e-12)
        assert [r["low"], r["q"], r["mid"], r["high"]] == pytest.approx(list(np.quantile(v, [0, 0.37, 0.5, 1])), rel=1e-9, abs=1e-12)


def test_effects_without_draws_and_with_missing_ones(spark, effect_draws):
    draws, sound = effect_draws
    axes = spark.range(1).select(F.array(F.lit(1.0)).alias("axis_x"), F.array(F.lit(2.0)).alias("axis_y"))
    assert posterior.effect_over_axes(draws.limit(0), axes, EFFECT_TERMS, {"q": 0.5}, "m").count() == 0
    one = posterior.effect_over_axes(draws, axes, EFFECT_TERMS, {"q": 0.5}, "m").first()
    assert one["q"] == pytest.approx(np.median([a + b + 2 * c for a, b, c in sound]))


def test_images_and_values():
    from tideline.operators.effects import image, value_of

    r = np.random.default_rng(1)
    v = np.unique(np.concatenate([r.integers(-(1 << 63), 1 << 63, 4000).view(np.float64), [0.0, 1.0, 5e-324, -1.0, np.inf, -np.inf]]))
    v = v[~np.isnan(v)]
    assert (np.diff(image(v)) > 0).all() and (value_of(image(v)) == v).all() and image(np.array([-0.0]))[0] == 0


def test_effects_that_differ_in_their_last_bits_alone(spark):
    """Values so close that every round is needed."""
    v = 1 + np.arange(200) * 2.0 ** -52
    draws = spark.createDataFrame([(float(x),) for x in v], "b double")
    axes = spark.range(1).select(F.array(F.lit(0.0)).alias("axis_x"))
    out = posterior.effect_over_axes(draws, axes, {"b": []}, {"q": 0.25, "r": 1.0}, "m").first()
    assert out["q"] == pytest.approx(np.quantile(v, 0.25), abs=0) and out["r"] == v[-1]


def test_grid_is_born_distributed(spark):
    df = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)], "x double, y double")
    g = reshape.grid(df, spaced_over={"x": 40}, quantiles={"y": (0.25, 0.5, 0.75)}, literals={"c": ("a", "b", "a")})
    assert g.rdd.getNumPartitions() > 1
    rows_ = [tuple(r) for r in g.collect()]
    assert g.columns == ["x", "y", "c"] and len(rows_) == len(set(rows_)) == 40 * len({r[1] for r in rows_}) * 2
    assert sorted({r[0] for r in rows_}) == pytest.approx([i * 49 / 39 for i in range(40)])


def test_waic_shuffles_the_draws_once(spark):
    ll = spark.range(3000).selectExpr("id % 30 AS obs", "id DIV 30 AS draw", "-0.001 * id AS ll")
    plan = posterior.waic_pointwise(ll)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Range") == 1
    total = posterior.waic(ll)._jdf.queryExecution().executedPlan().toString()
    assert total.count("Exchange hashpartitioning") == 1


def _hierarchy(spark, draws=40):
    """Observations with repeated, missing and unmatched keys, and draws with missing values."""
    obs = spark.createDataFrame(
        [(i, i % 3, (i % 3) % 2, i % 2, float(i % 5 - 2), 1.0 + i) for i in range(12)]
        + [(3, 1, 1, 0, 0.5, 4.0), (None, 0, 0, 1, 1.0, 2.0), (None, 2, 0, 0, 1.0, 3.0), (90, 9, 0, 0, 1.0, 1.0),
           (91, 1, 1, 1, None, 2.0), (92, None, 1, 1, 1.0, 2.0), (93, 2, 0, 1, 1.0, None)],
        "obs long, site int, `group` int, study int, x double, y double")
    draw = spark.range(draws).withColumnRenamed("id", "draw")
    wave = lambda name, k: F.sin(F.col("draw") * k + F.col(name))
    per = lambda name, n: draw.crossJoin(spark.range(n).select(F.col("id").cast("int").alias(name)))
    site = per("site", 3).select("draw", "site", F.when(F.col("draw") != 5, wave("site", 1.7)).alias("beta1"), wave("site", 0.3).alias("beta2"))
    group = per("group", 2).select("draw", "group", wave("group", 2.1).alias("mu1"), wave("group", 0.9).alias("mu2"))
    study = per("study", 2).select("draw", "study", (F.abs(wave("study", 1.1)) + 0.5).alias("sd_e"))
    return obs, site, group, study


@pytest.mark.parametrize("most_draws, fits_a_part", [(1 << 16, 1 << 22), (1 << 16, 50), (10, 50), (1 << 16, 1)])
def test_fits_by_observation_are_those_of_the_long_rows(spark, most_draws, fits_a_part):
    model = _hierarchy(spark)
    fits = posterior.observed_fits(*model, most_draws=most_draws, fits_a_part=fits_a_part)
    key = lambda r: (r["obs"] is None, r["obs"] or 0)
    for table in (posterior.residual_table, posterior.fitted_table):
        got, want = (sorted(table(f).collect(), key=key) for f in (fits, posterior.pointwise_loglik(*model)))
        assert len(got) == len(want) == 15
        for a, b in zip(got, want):
            assert a.asDict().keys() == b.asDict().keys() and a["obs"] == b["obs"]
            for c in a.asDict():
                if c in ("y", "resid") and a["obs"] in (None, 3):
                    continue  # any of the repeated observation's values
                assert a[c] == (None if b[c] is None else pytest.approx(b[c], rel=1e-12)), (a["obs"], c)


def test_one_draw_has_no_interval(spark):
    model = _hierarchy(spark, draws=1)
    rows = posterior.residual_table(posterior.observed_fits(*model)).where("obs = 4").collect()
    assert len(rows) == 1 and rows[0]["y_hat"] is not None and rows[0]["y_hat_L"] is None


@pytest.mark.parametrize("name", ["residual_table", "fits_of_sites_and_groups"])
def test_fits_of_all_draws_are_not_written(spark, monkeypatch, name):
    from __spark_entry__ import QUERIES

    rows = []

    def counting(df):
        out = written(df)
        rows.append(out.count())
        return out

    written = quantiles.written
    monkeypatch.setattr(quantiles, "written", counting)
    monkeypatch.setattr(posterior, "written", counting)
    folder = "/root/testdata/sf0.001"
    assert QUERIES[name](spark, folder).count() == 10
    assert sum(rows) <= 2 * 10  # a row per observation, where there are 500 draws of each


def _tall_model(spark, draws):
    """Five observations at two places, with draws that follow from their numbers."""
    obs = spark.createDataFrame([(i, i % 2, 0, 0, 0.5 * i - 1, 1.0 + i) for i in range(5)],
                                "obs long, site int, `group` int, study int, x double, y double")
    draw = spark.range(draws).withColumnRenamed("id", "draw")
    of = lambda name, k: F.sin((F.col("draw") * k + F.col(name)).cast("double"))
    site = draw.crossJoin(spark.range(2).select(F.col("id").cast("int").alias("site"))).select(
        "draw", "site", of("site", 17).alias("beta1"), of("site", 3).alias("beta2"))
    group = draw.select("draw", F.lit(0).alias("group")).select("draw", "group", of("group", 21).alias("mu1"), of("group", 9).alias("mu2"))
    study = draw.select("draw", F.lit(0).alias("study"), F.lit(0.5).alias("sd_e"))
    return obs, site, group, study


@pytest.mark.parametrize("table, locs", [("fitted_table", 2), ("residual_table", 1)])
def test_fits_of_as_many_draws_as_a_large_table_has_are_not_written(spark, monkeypatch, table, locs):
    rows, n = [], 70_000

    def counting(df):
        out = written(df)
        rows.append(out.count())
        return out

    written = quantiles.written
    monkeypatch.setattr(quantiles, "written", counting)
    monkeypatch.setattr(posterior, "written", counting)
    got = {r["obs"]: r for r in getattr(posterior, table)(posterior.observed_fits(*_tall_model(spark, n))).collect()}
    assert len(got) == 5 and sum(rows) < 1000  # observations and packs of draws; there are 350,000 fits
    d, gap = np.arange(n), round(n * 0.95)
    mu = [np.sin(d * k) for k in (21, 9)]
    for i, r in got.items():
        own = [m + np.sin(d * k + i % 2) for m, k in zip(mu, (17, 3))]
        for (a, b), name in zip((own, mu)[:locs], ("y_hat", "y_hat_mu")):
            v = np.sort(np.exp(a + b * (0.5 * i - 1)))
            at = (v[gap:] - v[:-gap]).argmin()
            assert (r[name], r[f"{name}_L"], r[f"{name}_U"]) == pytest.approx((v.mean(), v[at], v[at + gap]), rel=1e-9)


def test_draws_are_sent_to_a_bounded_number_of_parts(spark, monkeypatch):
    monkeypatch.setattr(fits, "MOST_PARTS", 1)
    obs, *model = _tall_model(spark, 100)
    obs = obs.crossJoin(spark.range(2000)).withColumn("obs", F.col("obs") + 5 * F.col("id")).drop("id")
    observed = posterior.observed_fits(obs, *model, fits_a_part=1)

    def received(keys, draws_first):
        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_pydict({"n": pa.array([sum(n.as_py() or 0 for n in batch.column("_n"))], pa.int64())})

        return run

    sent = fits.met(observed.rows, observed.packs, posterior.PLACE, ["own"], 1, True, received, T.StructType([T.StructField("n", T.LongType())]))
    most = 2 * spark.sparkContext.defaultParallelism + 2  # of 10,000 parts of one fit or more
    assert 200 <= sent.agg(F.sum("n")).first()[0] <= 100 * most


@pytest.mark.parametrize("prob", [0.0, 0.3, 0.5, 1.0])
def test_intervals_of_fits_by_observation_at_other_shares_and_of_odd_draws(spark, prob):
    obs, site, group, study = _hierarchy(spark)
    odd = F.when(F.col("draw") % 9 == 4, float("nan")).when(F.col("draw") % 9 == 7, 800.0).when(F.col("draw") % 3 == 0, 0.25)
    model = obs.where("obs < 3"), site.withColumn("beta1", odd.otherwise(F.col("beta1"))), group, study
    got, want = (sorted(map(tuple, posterior.residual_table(f, prob).collect()), key=lambda r: r[0])
                 for f in (posterior.observed_fits(*model), posterior.pointwise_loglik(*model)))
    assert len(got) == 3 and all(a == pytest.approx(b, rel=1e-12, nan_ok=True) for a, b in zip(got, want))


def _joined_rows(df):
    """Rows that the joins of a frame's plan made, the most of any."""
    df.collect()
    found, nodes = [0], [df._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            nodes.append(node.plan())
        if "Join" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return max(found)


def test_pointwise_log_likelihood_is_no_join_of_all_draws_with_all_observations(spark, tmp_path):
    from __spark_entry__ import QUERIES

    spark.range(400).selectExpr("id AS s_suppkey", "'x' AS s_name", "CAST(id % 2 AS INT) AS s_nationkey", "id * 7.5D AS s_acctbal").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(2).selectExpr("CAST(id AS INT) AS n_nationkey", "'n' AS n_name", "CAST(id AS INT) AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.range(90).selectExpr("id AS vec_id", "transform(sequence(1, 64), i -> CAST(sin(id * i) AS FLOAT)) AS embedding", "0 AS label").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["pointwise_log_likelihood"](spark, str(tmp_path))
    assert _joined_rows(out) <= 400  # of 36,000 pairs
    assert out.count() == 400 and {r["n"] for r in out.collect()} == {90}


@pytest.mark.parametrize("fits_a_part", [1 << 22, 50])
def test_means_of_pointwise_log_likelihood_are_those_of_its_rows(spark, fits_a_part):
    obs, site, group, study = _hierarchy(spark, 60)
    obs = obs.unionByName(obs.selectExpr("obs + 200 AS obs", "site", "`group`", "study", "x", "-y AS y"))  # without a logarithm
    study = study.withColumn("sd_e", F.when(F.col("draw") == 3, -0.5).when(F.col("draw") != 7, F.col("sd_e")))
    model = obs, site, group.withColumn("mu2", F.when(F.col("draw") != 11, F.col("mu2"))), study
    names = ["resid", "y_loc_mu", "log_lik"]
    long = posterior.pointwise_loglik(*model).groupBy("obs").agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("n"))
    whole = posterior.pointwise_loglik(*model, means=True, fits_a_part=fits_a_part)
    assert whole.schema.simpleString() == long.schema.simpleString()
    got, want = ({r["obs"]: tuple(r)[1:] for r in df.collect()} for df in (whole, long))
    assert got.keys() == want.keys() and len(got) == 29
    for k, values in want.items():
        assert got[k] == tuple(None if v is None else pytest.approx(v, rel=1e-11, abs=1e-12) for v in values), k


def test_an_error_of_zero_is_no_divisor(spark):
    obs, site, group, study = _tall_model(spark, 3)
    with pytest.raises(Exception, match="sd_e is zero"):
        posterior.pointwise_loglik(obs, site, group, study.withColumn("sd_e", F.lit(0.0)), means=True).collect()
