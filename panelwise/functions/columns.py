"""Column functions: predicates, bands, ratios, splines. All are plain Spark expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes of a day, and the thresholds of the named validity rules
#: (least minutes, least steps).
DAY_MINUTES = 1440
RULES = {"primary": (600, None), "s1": (576, None), "s2": (600, 100), "s3": (480, None), "s4": (720, None)}


def is_in_ci(col: Column, values: Sequence[str]) -> Column:
    """Case-insensitive membership; null is in no list."""
    return F.lower(F.coalesce(col, F.lit(""))).isin([v.lower() for v in values])


def valid_day(minutes: Column, steps: Column, rule: str) -> Column:
    """Whether a day counts under a named rule. Null minutes mean no record, never a valid day; minutes
    above a whole day are not valid; an unknown rule gives null."""
    if rule not in RULES:
        return F.lit(None).cast("boolean")
    least, least_steps = RULES[rule]
    ok = minutes.isNotNull() & minutes.between(least, DAY_MINUTES)
    if least_steps is not None:
        ok = ok & (F.coalesce(steps, F.lit(0)) >= least_steps)
    return F.coalesce(ok, F.lit(False))


def band(col: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the first edge that the value stays below; the last label beyond all; null stays null."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one label more than edges is needed")
    out = F.when(col.isNull(), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(col < edge, label)
    return out.otherwise(labels[-1])


def day_window_label(day: Column, index: Column, discharge: Column, before: tuple[int, int], accrual: tuple[int, int], tail: int) -> Column:
    """baseline / accrual / tail / outside, relative to an index and a discharge date."""
    return (F.when(day.between(F.date_add(index, before[0]), F.date_add(index, before[1])), "baseline")
            .when(day.between(F.date_add(discharge, accrual[0]), F.date_add(discharge, accrual[1])), "accrual")
            .when(day.between(F.date_add(discharge, accrual[1] + 1), F.date_add(discharge, tail)), "tail").otherwise("outside"))


def first_fail(rules: Sequence[tuple[int, str, Column]]) -> tuple[Column, Column]:
    """Step and slug of the first rule that holds, null if none does."""
    step = F.coalesce(*[F.when(rule, F.lit(n)) for n, _, rule in rules])
    slug = F.coalesce(*[F.when(rule, F.lit(name)) for _, name, rule in rules])
    return step, slug


def earliest_of(dates: Sequence[tuple[str, Column]], none: str = "none") -> tuple[Column, Column]:
    """The earliest of several nullable dates and its name; on ties the first named wins."""
    low = F.least(*[d for _, d in dates]) if len(dates) > 1 else dates[0][1]
    cause = F.when(low.isNull(), none)
    for name, d in dates:
        cause = cause.when(d == low, name)
    return low, cause


def clamp(col: Column, low: int, high: int, missing: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(col, F.lit(missing))))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null, never an error, where the denominator is null or not positive."""
    return F.when(denominator > 0, numerator / denominator)


def deficit(numerator: Column, baseline: Column, truncate: bool = True) -> Column:
    """1 - ratio, not below 0 if truncated. A null ratio stays null: greatest() alone would skip it."""
    r = ratio(numerator, baseline)
    return F.when(r.isNotNull(), F.greatest(F.lit(0.0), 1 - r) if truncate else 1 - r)


def log_ratio(a: Column, b: Column) -> Column:
    return F.ln(F.nullif(F.try_divide(a, b), F.lit(0.0)))


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, floor: float = 1e-6) -> Column:
    inside = F.least(F.greatest(p, F.lit(floor)), F.lit(1 - floor))
    return F.when(p.isNotNull(), F.ln(inside / (1 - inside)))


def spline_basis(x: Column, knots: Sequence[float]) -> list[Column]:
    """Restricted cubic spline: k knots give k - 1 columns, linear beyond the outer knots."""
    k = len(knots)
    if k < 3 or sorted(set(knots)) != list(knots):
        raise ValueError("three or more rising knots are needed")
    last, before, scale = knots[-1], knots[-2], (knots[-1] - knots[0]) ** 2

    def cube(t: float) -> Column:
        return F.pow(F.greatest(x - t, F.lit(0.0)), F.lit(3.0))

    out = [x.cast("double")]
    for t in knots[:-2]:
        term = cube(t) - cube(before) * (last - t) / (last - before) + cube(last) * (before - t) / (last - before)
        out.append(F.when(x.isNotNull(), term / scale))
    return out


def age_years(birth: Column, at: Column) -> Column:
    return F.datediff(at, birth) / F.lit(365.25)


def leading_family(model: Column, known: Sequence[str], default: str = "OTHER") -> Column:
    """The first run of capitals in a model name, if it is a known family."""
    run = F.regexp_extract(F.upper(F.coalesce(model, F.lit(""))), "[A-Z]+", 0)
    return F.when(run.isin(*known), run).otherwise(default)


def classify_code(vocabulary: Column, code: Column, rules: Sequence[tuple[str, str, bool, str]]) -> Column:
    """Label of the first rule (vocabulary, code, is_prefix, label) that fits, else null."""
    out = F.lit(None).cast("string")
    for voc, text, prefix, label in reversed(rules):
        fits = (vocabulary == voc) & (F.substring(code, 1, len(text)) == text if prefix else code == text)
        out = F.when(fits, label).otherwise(out)
    return out
