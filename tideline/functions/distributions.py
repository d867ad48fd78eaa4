"""Tail probabilities as native expressions (no UDF).

The Student-t tail is a regularized incomplete beta function, evaluated by its continued
fraction with the leading factor in logs: one method for all degrees of freedom,
whose relative error stays small in the far tail. It is evaluated once per fitted group,
never per input row, with higher-order ``aggregate`` over a fixed index.
Arguments are column names or SQL expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_NORMAL_SERIES_TERMS = 160
_NORMAL_SERIES_REACH = 6.0
_FRACTION_TERMS = 60


def _running(term: str) -> str:
    """State update of a sum whose next term is the given multiple of the last."""
    return f"named_struct('term', s.term * {term}, 'total', s.total + s.term * {term})"


def normal_tail_sql(z: str) -> str:
    """P(|Z| >= |z|): power series up to 6, continued fraction beyond, where 1 - x would cancel."""
    a = f"abs({z})"
    density = f"(exp(-{a} * {a} / 2) / {math.sqrt(2 * math.pi)!r}D)"
    series = (f"aggregate(sequence(1, {_NORMAL_SERIES_TERMS}), named_struct('term', {a}, 'total', {a}), "
              f"(s, k) -> {_running(f'({a} * {a} / (2 * k + 1))')}, s -> s.total)")
    fraction = f"aggregate(sequence({_FRACTION_TERMS}, 1, -1), {a}, (f, k) -> {a} + k / f)"
    return (f"if({a} <= {_NORMAL_SERIES_REACH}D, greatest(0D, 1 - 2 * {density} * {series}), "
            f"try_divide(2 * {density}, {fraction}))")


_BETA_TERMS = 300
_GAMMA_STEPS = 20


def _beta_fraction(x: str, a: str, b: str) -> str:
    """The continued fraction in I_x(a, b) = x^a (1-x)^b / (a B(a, b)) / fraction, from its far end."""
    odd = f"(-({a} + k DIV 2) * ({a} + {b} + k DIV 2) * {x} / (({a} + k - 1) * ({a} + k)))"
    even = f"((k DIV 2) * ({b} - k DIV 2) * {x} / (({a} + k - 1) * ({a} + k)))"
    # it converges in about the square root of the larger parameter
    terms = f"CAST(least({_BETA_TERMS}, 32 + 6 * ceil(sqrt(greatest({a}, {b})))) AS INT)"
    return (f"aggregate(sequence({terms}, 1, -1), 1D, (f, k) -> 1 + if(k % 2 = 1, {odd}, {even}) / f)")


def _log_gamma_ratio(a: str) -> str:
    """ln(Gamma(a + 1/2) / Gamma(a)): an asymptotic series past some steps of the recursion."""
    far = f"({a} + {_GAMMA_STEPS})"
    series = (f"(0.5D * ln({far}) - 1 / (8 * {far}) + 1 / (192 * pow({far}, 3)) - 1 / (640 * pow({far}, 5))"
              f" + 17 / (14336 * pow({far}, 7)))")
    steps = f"aggregate(sequence(0, {_GAMMA_STEPS - 1}), 0D, (g, k) -> g + ln(({a} + k) / ({a} + k + 0.5D)))"
    return f"({series} + {steps})"


def t_tail_sql(t: str, df: str) -> str:
    """P(|T_df| >= |t|); NULL when t is NULL or df < 1."""
    a, x, y = "s.a", "(1 / (1 + s.w))", "(s.w / (1 + s.w))"
    lead = f"exp(-{a} * log1p(s.w) + 0.5D * ln({y}) + {_log_gamma_ratio(a)} - {0.5 * math.log(math.pi)!r}D)"
    # the fraction converges fast on its side of the mean only; the other side is the complement
    tail = f"{lead} / {a} / {_beta_fraction(x, a, '0.5D')}"
    rest = f"1 - {lead} / 0.5D / {_beta_fraction(y, '0.5D', a)}"
    value = f"if({x} < ({a} + 1) / ({a} + 2.5D), {tail}, {rest})"
    terms = f"array(named_struct('a', CAST({df} AS DOUBLE) / 2, 'w', {t} * {t} / CAST({df} AS DOUBLE)))"
    return (f"CASE WHEN {t} IS NULL OR {df} < 1 THEN NULL WHEN {t} = 0 THEN 1D "
            f"ELSE transform({terms}, s -> {value})[0] END")


def normal_two_sided_p(z: str) -> Column:
    return F.expr(normal_tail_sql(z))


def t_two_sided_p(t: str, df: str) -> Column:
    return F.expr(t_tail_sql(t, df))
