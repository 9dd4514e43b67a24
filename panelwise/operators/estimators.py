"""Estimators over panels, as set-based jobs: only vectors and small matrices reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.columns import expit, logit, spline_basis
from panelwise.operators.aggregates import weighted_mean
from panelwise.operators.running import running_sums
from panelwise.sources.shared import stored

#: Fits whose coefficients pass this in size are refused.
CEILING = 10.0


def cell_means(rows: DataFrame, group: str, day: str, value: str, weight: str) -> DataFrame:
    """Weighted mean per (group, day); where a cell has no value the day's mean, then the overall one."""
    v, w = F.col(value), F.col(weight)
    cell = rows.groupBy(group, day).agg(weighted_mean(v, w).alias("cell"))
    by_day = rows.groupBy(day).agg(weighted_mean(v, w).alias("by_day"))
    total = rows.agg(weighted_mean(v, w).alias("total"))
    out = cell.join(by_day, day).join(F.broadcast(total))
    level = F.when(F.col("cell").isNotNull(), "cell").when(F.col("by_day").isNotNull(), "day").otherwise("overall")
    return out.select(group, day, F.coalesce("cell", "by_day", "total").alias("mean"), level.alias("level"))


def worst_case_bounds(rows: DataFrame, unit: str, group: str, value: str) -> DataFrame:
    """Mean over units, by group, of the observed sum, and with every missing day at 0 or at 1."""
    u = rows.groupBy(unit, group).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("low"), F.count_if(F.col(value).isNull()).alias("missing"))
    return u.groupBy(group).agg(F.count(F.lit(1)).alias("n_units"), F.avg("low").alias("lower"), F.avg(F.col("low") + F.col("missing")).alias("upper"))


def contrast_bounds(bounds: DataFrame, group: str) -> DataFrame:
    """``a, b, low, high, undecided`` for each pair of groups a < b of ``worst_case_bounds``: the difference in means is least with a's
    missing days at 0 and b's at 1 and greatest the other way around; undecided if it may be 0. A row for each pair of groups, which are few."""
    a = bounds.select(F.col(group).alias("a"), F.col("lower").alias("_la"), F.col("upper").alias("_ua"))
    b = bounds.select(F.col(group).alias("b"), F.col("lower").alias("_lb"), F.col("upper").alias("_ub"))
    low, high = F.col("_la") - F.col("_ub"), F.col("_ua") - F.col("_lb")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", low.alias("low"), high.alias("high"), ((low <= 0) & (high >= 0)).alias("undecided"))


def implied_deficit(rows: DataFrame, predicted: str, observed: str, shifts: Sequence[float]) -> DataFrame:
    """``shift, n_days, implied, observed_mean``: what each shift says that the mean of the unobserved days is, beside the mean of the observed ones."""
    d = rows.withColumn("shift", F.explode(F.array(*[F.lit(float(x)) for x in shifts])))
    hidden = F.when(F.col(observed).isNull(), expit(logit(F.col(predicted)) + F.col("shift")))
    return d.groupBy("shift").agg(F.count(hidden).alias("n_days"), F.avg(hidden).alias("implied"), F.avg(observed).alias("observed_mean"))


def logit_shift(rows: DataFrame, unit: str, predicted: str, observed: str, shifts: Sequence[float]) -> DataFrame:
    """Mean unit total when predictions for unobserved days move by each shift on the logit scale."""
    g = rows.withColumn("shift", F.explode(F.array(*map(F.lit, shifts))))
    value = F.coalesce(F.col(observed), expit(logit(F.col(predicted)) + F.col("shift")))
    return g.groupBy("shift", unit).agg(F.sum(value).alias("total")).groupBy("shift").agg(F.avg("total").alias("mean_total"))


def crossings(grid: DataFrame, x: str, y: str, level: float) -> DataFrame:
    """Grid steps on which y passes a level, and whether y never falls along x."""
    w = Window.orderBy(x)
    d = grid.withColumn("_last", F.lag(y).over(w))
    return d.agg(F.min(F.when((F.col("_last") < level) & (F.col(y) >= level), F.col(x))).alias("first_crossing"), F.coalesce(F.every(F.col(y) >= F.coalesce("_last", y)), F.lit(True)).alias("rising"))


def standardised_rates(rows: DataFrame, stratum: Column, exposed: str, outcome: str) -> DataFrame:
    """Crude rate and rate standardised to the whole panel's strata, for each level of ``exposed``."""
    d = rows.withColumn("_s", stratum)
    cells = d.groupBy("_s", exposed).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("events"))
    weights = d.groupBy("_s").agg(F.count(F.lit(1)).alias("w"))
    j = cells.join(weights, "_s")
    return j.groupBy(exposed).agg((F.sum("events") / F.sum("n")).alias("crude"), (F.sum(F.col("w") * F.col("events") / F.col("n")) / F.sum("w")).alias("standardised"), F.sum("n").alias("n"))


def roc_panel(rows: DataFrame, score: str, outcome: str, key: str) -> DataFrame:
    """ROC area, average precision and Brier score. Ties share their mean rank; the running sums are
    over distinct scores, range by range, so no task sees them all."""
    s = rows.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("hits"))
    s = running_sums(s, [], [F.col(score).asc()], {"upto": F.col("n"), "hits_upto": F.col("hits")})
    total = s.agg(F.sum("n").alias("_n"), F.sum("hits").alias("_hits"))
    s = s.join(F.broadcast(total)).withColumns({"before": F.col("upto") - F.col("n"), "top": F.col("_n") - F.col("upto") + F.col("n"), "top_hits": F.col("_hits") - F.col("hits_upto") + F.col("hits")})
    s = s.withColumn("rank", F.col("before") + (F.col("n") + 1) / 2)
    a = s.agg(F.sum("n").alias("n"), F.sum("hits").alias("n1"), F.sum(F.col("rank") * F.col("hits")).alias("ranks"), F.sum(F.col("hits") * F.col("top_hits") / F.col("top")).alias("ap"))
    b = rows.agg(F.avg(F.pow(F.col(score) - F.col(outcome), F.lit(2.0))).alias("brier"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return a.join(F.broadcast(b)).select("n", "n1", F.try_divide(F.col("ranks") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"), F.try_divide(F.col("ap"), n1).alias("average_precision"), "brier")


def confusion_at(rows: DataFrame, score: str, outcome: str, sensitivity: float) -> DataFrame:
    """The highest threshold that reaches a sensitivity, and what it does."""
    cut = rows.where(F.col(outcome) == 1).agg(F.expr(f"percentile_disc({1 - sensitivity}) WITHIN GROUP (ORDER BY {score})").alias("threshold"))
    d = rows.join(F.broadcast(cut))
    hit = F.col(score) >= F.col("threshold")
    a = d.agg(F.max("threshold").alias("threshold"), F.count_if(hit & (F.col(outcome) == 1)).alias("tp"), F.count_if(hit & (F.col(outcome) == 0)).alias("fp"), F.count_if(~hit & (F.col(outcome) == 1)).alias("fn"), F.count_if(~hit & (F.col(outcome) == 0)).alias("tn"))
    return a.withColumns({"sensitivity": F.try_divide("tp", F.col("tp") + F.col("fn")), "specificity": F.try_divide("tn", F.col("tn") + F.col("fp")), "ppv": F.try_divide("tp", F.col("tp") + F.col("fp"))})


def lead_time(ev: DataFrame, alerts: DataFrame, days: int = 6) -> DataFrame:
    """Days from the first alert in the look-back to each event; null without one."""
    a = alerts.select("episode_id", F.col("post_day").alias("alert_day"))
    j = ev.select("episode_id", "event_day").join(a, "episode_id", "left").withColumn("_in", F.col("alert_day").between(F.col("event_day") - days, F.col("event_day") - 1))
    return j.groupBy("episode_id", "event_day").agg((F.first("event_day") - F.min(F.when(F.col("_in"), F.col("alert_day")))).alias("lead_days"))


def explained(rows: DataFrame, y: str, fitted: str, weight: str) -> DataFrame:
    """Weighted explained variation from sums of one pass."""
    w = F.col(weight)
    s = rows.agg(F.sum(w).alias("w"), F.sum(w * F.col(y)).alias("wy"), F.sum(w * F.col(y) * F.col(y)).alias("wyy"), F.sum(w * F.pow(F.col(y) - F.col(fitted), F.lit(2.0))).alias("res"))
    return s.select((1 - F.try_divide("res", F.col("wyy") - F.col("wy") * F.col("wy") / F.col("w"))).alias("r2"))


def intraclass(rows: DataFrame, unit: str, y: str) -> DataFrame:
    """One-way intraclass correlation from unit sums."""
    u = rows.where(F.col(y).isNotNull()).groupBy(unit).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(F.col(y) * F.col(y)).alias("q"))
    t = u.agg(F.count(F.lit(1)).cast("double").alias("k"), F.sum("n").cast("double").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).cast("double").alias("nn"))
    between = (F.col("b") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    within = (F.col("q") - F.col("b")) / (F.col("n") - F.col("k"))
    size = (F.col("n") - F.col("nn") / F.col("n")) / (F.col("k") - 1)
    return t.select(((between - within) / (between + (size - 1) * within)).alias("icc"))


def horizon_risk(rows: DataFrame, p: str, days: int) -> DataFrame:
    """Risk over a horizon from the mean daily probability: 1 - (1 - p) ** h."""
    return rows.agg(F.avg(p).alias("daily")).select("daily", (1 - F.pow(1 - F.col("daily"), F.lit(float(days)))).alias("risk"))


def _gram(rows: DataFrame, x: Sequence[str], left: Column, weight: Column) -> tuple[np.ndarray, np.ndarray]:
    """sum(w x x') and sum(left x) in one aggregate of p * (p + 3) / 2 sums."""
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    one = rows.agg(*[F.sum(weight * F.col(x[i]) * F.col(x[j])).alias(f"h{i}_{j}") for i, j in pairs], *[F.sum(left * F.col(c)).alias(f"g{i}") for i, c in enumerate(x)]).first()
    h = np.zeros((len(x), len(x)))
    for i, j in pairs:
        h[i, j] = h[j, i] = one[f"h{i}_{j}"] or 0.0
    return h, np.array([one[f"g{i}"] or 0.0 for i in range(len(x))])


def fit_logit(rows: DataFrame, x: Sequence[str], y: str, weight: str | None = None, cluster: str | None = None, steps: int = 25) -> dict:
    """Weighted logistic (or, for y in [0, 1], fractional) regression by Newton steps, one aggregate each,
    and the covariance, robust to clusters if one is named. Coefficients beyond CEILING are refused."""
    w = F.col(weight) if weight else F.lit(1.0)
    beta = np.zeros(len(x))

    def linear(b: np.ndarray) -> Column:
        return sum((F.lit(float(v)) * F.col(c) for v, c in zip(b, x, strict=True)), F.lit(0.0))

    def parts(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mu = expit(linear(b))
        return _gram(rows, x, w * (F.col(y) - mu), w * mu * (1 - mu))

    for _ in range(steps):
        h, g = parts(beta)
        step = np.linalg.solve(h + 1e-10 * np.eye(len(x)), g)
        if np.abs(step).max() > 2:
            step *= 2 / np.abs(step).max()
        beta = beta + step
        if np.abs(beta).max() > CEILING:
            raise ValueError("separated: a coefficient passes the ceiling")
        if np.abs(step).max() < 1e-9:
            break
    h, _ = parts(beta)
    bread = np.linalg.inv(h)
    out = {"beta": beta, "cov": bread}
    if cluster:
        mu = expit(linear(beta))
        scores = rows.groupBy(cluster).agg(*[F.sum(w * (F.col(y) - mu) * F.col(c)).alias(f"s{i}") for i, c in enumerate(x)])
        meat, _ = _gram(scores, [f"s{i}" for i in range(len(x))], F.lit(0.0), F.lit(1.0))
        out["robust"] = bread @ meat @ bread
    return out


def with_fitted(rows: DataFrame, x: Sequence[str], beta: Sequence[float], name: str) -> DataFrame:
    """Rows with the probability that a fit gives them, kept off 0 and 1 by 1e-6."""
    eta = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, x, strict=True)), F.lit(0.0))
    return rows.withColumn(name, F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), expit(eta))))


def multiplicity(b: Column, unit: Column, seed: int = 1) -> Column:
    """How often a unit stands in resample ``b``: a Poisson draw from an MD5 of (b, unit, seed), so reruns, partitions and
    engines agree."""
    drawn = F.substring(F.md5(F.concat_ws("|", b.cast("string"), unit.cast("string"), F.lit(str(seed)))), 1, 8)
    m = F.lit(0)
    total, term = 0.0, np.exp(-1.0)
    for k in range(8):
        total += term
        term /= k + 1
        m = m + (drawn > f"{min(int(total * 2**32), 2**32 - 1):08x}").cast("int")
    return m


def replicates(units: DataFrame, unit: str, b: int, seed: int = 1) -> DataFrame:
    """Bootstrap multiplicities ``b, unit, multiplicity``; additive statistics take the multiplicity as a weight."""
    each = units.select(unit).distinct().withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b))))
    return each.withColumn("multiplicity", multiplicity(F.col("b"), F.col(unit), seed)).where("multiplicity > 0")


def bootstrap_mean(rows: DataFrame, unit: str, group: str, value: str, b: int, seed: int = 1) -> DataFrame:
    """Percentile interval of a group mean of unit totals, whole units resampled; units without a value drop out."""
    u = rows.groupBy(unit, group).agg(F.sum(value).alias("total")).where("total IS NOT NULL")
    r = replicates(u, unit, b, seed).join(u, unit)
    means = r.groupBy("b", group).agg((F.sum(F.col("total") * F.col("multiplicity")) / F.sum("multiplicity")).alias("mean"))
    point = u.groupBy(group).agg(F.avg("total").alias("mean"))
    q = means.groupBy(group).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count("mean").alias("n_replicates"))
    return point.join(q, group).select(group, "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "n_replicates")


def design(rows: DataFrame, splines: dict[str, Sequence[float]], levels: dict[str, Sequence[str]], logs: Sequence[str], centred: dict[str, float], products: Sequence[tuple[str, str]]) -> tuple[DataFrame, list[str]]:
    """Design columns: spline bases, indicators of all levels but the first, log(1 + x), centred columns and
    products of those. Columns that are constant over the rows are dropped, found by one aggregate."""
    made: dict[str, Column] = {}
    for c, knots in splines.items():
        made |= {f"{c}_s{k}": v for k, v in enumerate(spline_basis(F.col(c), knots), 1)}
    for c, names in levels.items():
        made |= {f"{c}_{n}": (F.col(c) == n).cast("double") for n in names[1:]}
    made |= {f"log_{c}": F.log1p(F.col(c).cast("double")) for c in logs}
    made |= {f"{c}_centred": F.col(c).cast("double") - v for c, v in centred.items()}
    made |= {f"{a}_x_{b}": made[a] * made[b] for a, b in products}
    out = rows.withColumns(made)
    ends = out.agg(*[F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")).alias(n) for n in made]).first()
    return out, [n for n in made if ends[n]["lo"] != ends[n]["hi"]]


def exposure_block(rows: DataFrame, x: str, absent: str, knots: Sequence[float], reference: float) -> tuple[DataFrame, list[str]]:
    """The exposure as spline columns that are 0 at the reference value and where the exposure is absent, and an
    indicator of its absence; a contrast with the reference is then the spline at a value, by itself."""
    at = spline_basis(F.coalesce(F.col(x), F.lit(reference)).cast("double"), knots)
    zero = spline_basis(F.lit(float(reference)), knots)
    there = (~F.col(absent)).cast("double")
    made = {f"{x}_e{k}": (a - z) * there for k, (a, z) in enumerate(zip(at, zero, strict=True), 1)} | {f"{x}_absent": F.col(absent).cast("double")}
    return rows.withColumns(made), list(made)


def fit_or_step_down(attempts: Sequence[tuple[str, Callable[[], object]]]) -> tuple[object, list[tuple[int, str, str]]]:
    """Estimators in order of preference: one that refuses (separation, a singular matrix) is recorded with its
    reason and the next is tried. Returns the first result and the record of all that were tried."""
    record: list[tuple[int, str, str]] = []
    for k, (name, fit) in enumerate(attempts, 1):
        try:
            found = fit()
        except (ValueError, np.linalg.LinAlgError) as why:
            record.append((k, name, f"failed: {str(why).split(':')[0]}"))
            continue
        record.append((k, name, "fitted"))
        return found, record
    return None, record


def fit_logit_each(rows: DataFrame, by: str, keys: Sequence[int], x: Sequence[str], y: str, weight: str, steps: int = 14) -> dict[int, np.ndarray | None]:
    """``fit_logit`` for every replicate number of ``keys`` in ``by``, all in step: each Newton step is one
    aggregate that returns a row of sums for each replicate. None where a fit is singular or passes CEILING."""
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    beta: dict[int, np.ndarray | None] = {k: np.zeros(p) for k in keys}
    for _ in range(steps):
        now = rows.sparkSession.createDataFrame([(k, *map(float, v)) for k, v in beta.items() if v is not None], f"{by} int, " + ", ".join(f"_b{i} double" for i in range(p)))
        mu = expit(sum((F.col(f"_b{i}") * F.col(c) for i, c in enumerate(x)), F.lit(0.0)))
        w = F.col(weight)
        sums = [F.sum(w * F.col("_m") * (1 - F.col("_m")) * F.col(x[i]) * F.col(x[j])).alias(f"h{i}_{j}") for i, j in pairs] + [F.sum(w * (F.col(y) - F.col("_m")) * F.col(c)).alias(f"g{i}") for i, c in enumerate(x)]
        moved, seen = 0.0, set()
        for r in rows.join(F.broadcast(now), by).withColumn("_m", mu).groupBy(by).agg(*sums).collect():
            seen.add(r[by])
            h = np.zeros((p, p))
            for i, j in pairs:
                h[i, j] = h[j, i] = r[f"h{i}_{j}"]
            try:
                step = np.linalg.solve(h, np.array([r[f"g{i}"] for i in range(p)]))
            except np.linalg.LinAlgError:
                beta[r[by]] = None
                continue
            new = beta[r[by]] + step
            beta[r[by]] = new if np.abs(new).max() <= CEILING else None
            moved = max(moved, np.abs(step).max())
        beta = {k: v if k in seen else None for k, v in beta.items()}
        if moved < 1e-9:
            break
    return beta


def patterns(rows: DataFrame, unit: str, x: Sequence[str], y: str, weight: str | None = None) -> DataFrame:
    """``unit, x.., n, wy``: rows of a unit that agree in all covariates as one, with the sum of their weights and of
    weight times response, which is all that a fit or a rank statistic of a score of x needs of them."""
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.where(F.col(y).isNotNull()).groupBy(unit, *x).agg(F.sum(w).alias("n"), F.sum(w * F.col(y)).alias("wy"))


def resampled(units: DataFrame, unit: str, b: int, seed: int = 1) -> DataFrame:
    """The rows of ``patterns`` in every resample of whole units that holds them, with their multiplicity ``m``, stored
    once: each Newton step reads it and joins nothing but coefficients."""
    each = units.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b)))).withColumn("m", multiplicity(F.col("b"), F.col(unit), seed)).where("m > 0")
    return stored(each.withColumns({"w": F.col("m") * F.col("n"), "y": F.col("wy") / F.col("n")}).where("n > 0"), "resampled")


def bootstrap_fit(rows: DataFrame, unit: str, x: Sequence[str], y: str, weight: str, b: int, seed: int = 1) -> list[tuple]:
    """Refits with whole units resampled: per term the estimate, percentile interval, two-sided p-value, share
    of refits that failed and number of replicates. Rows are weighted by multiplicities and never copied; those of
    a unit that agree in all terms are one."""
    full = fit_logit(rows, x, y, weight)["beta"]
    many = resampled(patterns(rows, unit, x, y, weight), unit, b, seed)
    found = fit_logit_each(many, "b", range(1, b + 1), x, "y", "w")
    good = np.array([v for v in found.values() if v is not None])
    failed = 1 - len(good) / max(b, 1)
    out = []
    for i, name in enumerate(x):
        v = good[:, i] if len(good) else np.array([np.nan])
        low, high = np.percentile(v, [2.5, 97.5])
        out.append((name, float(full[i]), float(low), float(high), float(min(1.0, 2 * min((v <= 0).mean(), (v >= 0).mean()))), float(failed), b))
    return out


def roc_each(rows: DataFrame, by: Sequence[str], score: str, n: str, hits: str) -> DataFrame:
    """``by.., auc``: the ROC area of every replicate at once, from rows that carry their number (or weight) ``n`` and, of it, ``hits``.

    The rows become a histogram of (replicate, score), whose running sums of negatives give each positive's
    rank, ties at half. Null where a replicate has one class only.
    """
    h = rows.groupBy(*by, score).agg(F.sum(hits).alias("_pos"), F.sum(F.col(n) - F.col(hits)).alias("_neg"))
    h = running_sums(h, by, [F.col(score).asc()], {"_upto": F.col("_neg")})
    area = F.sum(F.col("_pos") * (F.col("_upto") - F.col("_neg") / 2))
    return h.groupBy(*by).agg(F.try_divide(area, F.sum("_pos") * F.sum("_neg")).alias("auc"))


def optimism_corrected(rows: DataFrame, unit: str, x: Sequence[str], y: str, b: int, seed: int = 1, digits: int = 9) -> DataFrame:
    """Internal validation of a logistic model's ROC area by whole units resampled: ``apparent, on_resamples, on_original,
    optimism, corrected, n_replicates, failed``.

    Each resample's fit is scored on the resample and on the original rows; the mean difference is the
    optimism, and the apparent area less it the corrected one. Linear predictors are rounded to ``digits``, so
    that ties are ties in any order of sums. Refits that fail or that leave one class only are counted as failed.
    """
    spark = rows.sparkSession
    units = stored(patterns(rows, unit, x, y), "patterns")
    full = fit_logit(units.withColumn("y", F.col("wy") / F.col("n")), x, "y", "n")["beta"]
    many = resampled(units, unit, b, seed)
    found = {k: v for k, v in fit_logit_each(many, "b", range(1, b + 1), x, "y", "w").items() if v is not None}
    betas = [("apparent", 0, full), *((kind, k, v) for k, v in found.items() for kind in ("resample", "original"))]
    fits = spark.createDataFrame([(kind, k, *map(float, v)) for kind, k, v in betas], "kind string, b int, " + ", ".join(f"_b{i} double" for i in range(len(x))))
    once = units.groupBy(*x).agg(F.sum("n").alias("n"), F.sum("wy").alias("hits"))
    on_original = once.join(F.broadcast(fits.where("kind <> 'resample'")))  # one row for each fit
    on_resample = many.select("b", *x, F.col("w").alias("n"), (F.col("m") * F.col("wy")).alias("hits")).join(F.broadcast(fits.where("kind = 'resample'")), "b")
    eta = F.round(sum((F.col(f"_b{i}") * F.col(c) for i, c in enumerate(x)), F.lit(0.0)), digits)
    scored = on_original.select("kind", "b", eta.alias("score"), "n", "hits").unionByName(on_resample.select("kind", "b", eta.alias("score"), "n", "hits"))
    area = roc_each(scored, ["kind", "b"], "score", "n", "hits")
    each = area.groupBy("b").agg(*[F.max(F.when(F.col("kind") == k, F.col("auc"))).alias(k) for k in ("apparent", "resample", "original")])
    both = F.col("resample").isNotNull() & F.col("original").isNotNull()
    one = each.agg(F.max("apparent").alias("apparent"), F.avg(F.when(both, F.col("resample"))).alias("on_resamples"), F.avg(F.when(both, F.col("original"))).alias("on_original"), F.count_if(both).alias("_used"))
    optimism = F.col("on_resamples") - F.col("on_original")
    return one.select("apparent", "on_resamples", "on_original", optimism.alias("optimism"), (F.col("apparent") - optimism).alias("corrected"), F.lit(b).alias("n_replicates"), (1 - F.col("_used") / b).alias("failed"))


def inverse_weights(rows: DataFrame, observed: str, fitted: str, group: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Stabilised weights of observed rows, clipped at two percentiles. A row that was not observed has none;
    a fitted probability outside (0, 1] of a row that was is refused when the rows are computed."""
    share = rows.groupBy(group).agg(F.avg(F.col(observed).cast("double")).alias("_share"))
    inside = (F.col(fitted) > 0) & (F.col(fitted) <= 1)
    raw = F.when(inside, F.col("_share") / F.col(fitted)).otherwise(F.raise_error(F.lit("a fitted probability lies outside (0, 1]")).cast("double"))
    d = rows.join(share, group).withColumn("_w", F.when(F.col(observed), raw))
    cut = d.agg(F.percentile("_w", F.array(F.lit(low), F.lit(high))).alias("_q"))
    clipped = F.when(F.col("_w").isNotNull(), F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], F.col("_w"))))
    return d.join(F.broadcast(cut)).withColumn("weight", clipped).drop("_share", "_w", "_q")


def weight_summary(rows: DataFrame, weight: str) -> DataFrame:
    """What a set of weights looks like: n, mean, extremes (the truncation points) and effective size."""
    w = F.col(weight)
    return rows.agg(F.count(w).alias("n"), F.avg(w).alias("mean"), F.min(w).alias("least"), F.max(w).alias("most"), (F.sum(w) * F.sum(w) / F.sum(w * w)).alias("effective_n"))


def straight_line(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares of y on x from one pass of sums: intercept, slope, residual deviation, n."""
    d = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    one = d.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.count(F.lit(1)).alias("n"))
    left = F.col("syy") - F.col("slope") * F.col("sxy")
    return one.select("intercept", "slope", F.when(F.col("n") > 2, F.sqrt(F.greatest(left, F.lit(0.0)) / (F.col("n") - 2))).alias("deviation"), "n")


def normal_draw(*parts: Column) -> Column:
    """A standard normal draw from an MD5 of the parts, by Box and Muller's formula."""
    digest = F.md5(F.concat_ws("|", *[x.cast("string") for x in parts]))
    u = [(F.conv(F.substring(digest, k, 8), 16, 10).cast("double") + 0.5) / float(2**32) for k in (1, 9)]
    return F.sqrt(-2 * F.ln(u[0])) * F.cos(2 * np.pi * u[1])


def imputed_mean(rows: DataFrame, unit: str, day: str, value: str, m: int = 20, seed: int = 1) -> DataFrame:
    """Multiple imputation of missing days from a line in the day, with normal residuals and clipped to 0..1:
    the pooled mean unit total, and its variance within and between the ``m`` imputations."""
    line = straight_line(rows, day, value)
    d = rows.select(unit, day, value).join(F.broadcast(line)).withColumn("imputation", F.explode(F.sequence(F.lit(1), F.lit(m))))
    drawn = F.col("intercept") + F.col("slope") * F.col(day) + F.col("deviation") * normal_draw(F.col("imputation"), F.col(unit), F.col(day), F.lit(seed))
    filled = F.coalesce(F.col(value), F.greatest(F.lit(0.0), F.least(F.lit(1.0), drawn)))
    each = d.groupBy("imputation", unit).agg(F.sum(filled).alias("total")).groupBy("imputation").agg(F.avg("total").alias("mean"), (F.var_samp("total") / F.count("total")).alias("within"))
    out = each.agg(F.avg("mean").alias("pooled"), F.avg("within").alias("within"), F.var_samp("mean").alias("between"))
    return out.withColumn("total", F.col("within") + (1 + 1 / F.lit(float(m))) * F.col("between"))


def horizon_interval(rows: DataFrame, p: str, cluster: str, days: int, z: float = 1.959963984540054) -> DataFrame:
    """``horizon_risk`` with an interval: the delta method on the logit of the daily probability, its variance
    robust to clusters."""
    mean = rows.agg(F.avg(p).alias("daily"), F.count(F.lit(1)).alias("n"))
    u = rows.join(F.broadcast(mean)).groupBy(cluster).agg(F.sum(F.col(p) - F.col("daily")).alias("s"), F.first("daily").alias("daily"), F.first("n").alias("n"))
    v = u.agg(F.first("daily").alias("daily"), (F.sqrt(F.sum(F.col("s") * F.col("s"))) / F.first("n")).alias("se"))
    eta, width = F.ln(F.col("daily") / (1 - F.col("daily"))), F.lit(z) * F.col("se") / (F.col("daily") * (1 - F.col("daily")))
    risk = lambda q: 1 - F.pow(1 - q, F.lit(float(days)))
    return v.select("daily", "se", risk(F.col("daily")).alias("risk"), risk(expit(eta - width)).alias("low"), risk(expit(eta + width)).alias("high"))


def alert_burden(rows: DataFrame, score: str, outcome: str, threshold: DataFrame) -> DataFrame:
    """Alerts at a threshold: how many, per 100 days, and per event that they catch."""
    d = rows.join(F.broadcast(threshold.select("threshold"))).agg(F.count(F.lit(1)).alias("n_days"), F.count_if(F.col(score) >= F.col("threshold")).alias("n_alerts"), F.count_if((F.col(score) >= F.col("threshold")) & (F.col(outcome) == 1)).alias("n_caught"))
    return d.withColumns({"per_100_days": F.try_divide(100.0 * F.col("n_alerts"), F.col("n_days")), "per_caught": F.try_divide("n_alerts", "n_caught")})


def marginal_mean(rows: DataFrame, linear: str, sd: float, draws: Sequence[float]) -> DataFrame:
    """Mean over a random effect by common standard normal draws, a literal array of fixed length."""
    inner = F.aggregate(F.array(*map(F.lit, draws)), F.lit(0.0), lambda acc, z: acc + expit(F.col(linear) + z * sd)) / len(draws)
    return rows.withColumn("marginal", inner)


#: Draws of the marginal mean, of its recheck and beyond the tolerance.
DRAWS = (2000, 4000, 10_000)
TOLERANCE = 0.05


def intercept_variance(rows: DataFrame, unit: str, linear: str, value: str) -> DataFrame:
    """``variance``: of a random intercept of the units on the logit scale, by moments from one pass of unit sums: the products
    of two residuals of a unit hold the variance times the products of their slopes mu (1 - mu)."""
    mu = expit(F.col(linear))
    left, slope = F.col(value) - mu, mu * (1 - mu)
    u = rows.where(F.col(value).isNotNull()).groupBy(unit).agg(F.sum(left).alias("r"), F.sum(left * left).alias("rr"), F.sum(slope).alias("d"), F.sum(slope * slope).alias("dd"))
    pairs = F.try_divide(F.sum(F.col("r") * F.col("r") - F.col("rr")), F.sum(F.col("d") * F.col("d") - F.col("dd")))
    return u.agg(F.greatest(F.lit(0.0), F.coalesce(pairs, F.lit(0.0))).alias("variance"))


def marginal_mean_drawn(rows: DataFrame, unit: str, linear: str, value: str, seed: int = 1, draws: Sequence[int] = DRAWS, tolerance: float = TOLERANCE) -> DataFrame:
    """``sd, mean_total, rechecked, n_draws``: the mean unit total of expit(linear + random intercept), by draws that all rows share.

    A draw is a normal number from an MD5 of its own number, so draws are the same on every task and the first 2,000 of 4,000
    are those of a run of 2,000. The mean over the first count is checked against the second, and beyond the tolerance the third is
    used. Linear predictors that agree to nine digits are drawn for once. Units without rows do not exist.
    """
    one = intercept_variance(rows, unit, linear, value).select(F.sqrt("variance").alias("sd"))
    eta = rows.groupBy(unit, F.round(linear, 9).alias("eta")).agg(F.count(F.lit(1)).alias("n"))
    eta = stored(eta, "predictors")
    n_units = eta.agg(F.countDistinct(unit).alias("units"))
    each = eta.groupBy("eta").agg(F.sum("n").alias("n")).join(F.broadcast(one))
    z = rows.sparkSession.range(1, draws[-1] + 1).select(normal_draw(F.col("id"), F.lit(seed)).alias("z"), "id")

    def mean(of: DataFrame, names: dict[str, int]) -> DataFrame:
        """Totals over a block of draws for each distinct predictor; the draws are a table of fixed size."""
        block = z.where(F.col("id") <= max(names.values()))
        p = expit(F.col("eta") + F.col("sd") * F.col("z"))
        sums = of.join(F.broadcast(block)).groupBy("eta", "n", "sd").agg(*[(F.sum(F.when(F.col("id") <= k, p)) / k).alias(n) for n, k in names.items()])
        return sums.agg(F.first("sd").alias("sd"), *[F.sum(F.col("n") * F.col(n)).alias(n) for n in names]).join(F.broadcast(n_units)).select("sd", *[(F.col(n) / F.col("units")).alias(n) for n in names])

    first = mean(each, {"mean_total": draws[0], "rechecked": draws[1]}).first()
    if first is None or first["mean_total"] is None or abs(first["mean_total"] - first["rechecked"]) <= tolerance:
        return rows.sparkSession.createDataFrame([(*(tuple(first) if first else (None,) * 3), draws[0])], "sd double, mean_total double, rechecked double, n_draws int")
    more = mean(each, {"mean_total": draws[2], "rechecked": draws[1]})
    return more.select("sd", "mean_total", "rechecked", F.lit(draws[2]).alias("n_draws"))


def shifted_contrast(rows: DataFrame, unit: str, person: str, group: str, predicted: str, observed: str, shifts: Sequence[float], b: int, seed: int = 1) -> DataFrame:
    """``shift, contrast, low, high``: the difference in mean unit total between units with and without ``group``, when the
    predictions for unobserved days of the former go down by each shift on the logit scale, with percentile intervals over resamples of whole
    persons.

    One pass makes the sums of each person, group and shift; a joint table of (resample, shift) is made of those. A resample
    without units of one group has no contrast and drops out.
    """
    g = rows.withColumn("shift", F.explode(F.array(*[F.lit(float(x)) for x in shifts])))
    value = F.coalesce(F.col(observed), expit(logit(F.col(predicted)) - F.when(F.col(group), F.col("shift")).otherwise(0.0)))
    total = g.groupBy(unit, person, group, "shift").agg(F.sum(value).alias("t"))
    people = stored(total.groupBy(person, group, "shift").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("n")), "totals")

    def contrast(d: DataFrame, by: Sequence[str], m: Column) -> DataFrame:
        side = lambda yes: F.try_divide(F.sum(F.when(F.col(group) == yes, m * F.col("t"))), F.sum(F.when(F.col(group) == yes, m * F.col("n"))))
        return d.groupBy(*by).agg((side(True) - side(False)).alias("contrast"))

    drawn = people.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b)))).withColumn("m", multiplicity(F.col("b"), F.col(person), seed)).where("m > 0")
    many = contrast(drawn, ["b", "shift"], F.col("m")).groupBy("shift").agg(F.percentile("contrast", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return contrast(people, ["shift"], F.lit(1)).join(many, "shift", "left").select("shift", "contrast", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def tipping_points(curve: DataFrame) -> DataFrame:
    """``crossing, already, falling, interval_crossing, interval_already``: of a curve ``shift, contrast, low, high``, the first shift at which the contrast is 0 or
    less after one above it (none where it starts there), whether it never rises, and the first at which the interval holds 0.
    The curve has one row for each shift of a fixed grid."""
    w = Window.orderBy("shift")
    d = curve.withColumns({"_last": F.lag("contrast").over(w), "_i": F.row_number().over(w), "_in": F.coalesce((F.col("low") <= 0) & (F.col("high") >= 0), F.lit(False))})
    started = F.max(F.when(F.col("_i") == 1, F.col("contrast") <= 0))
    out = d.agg(F.min(F.when((F.col("_last") > 0) & (F.col("contrast") <= 0), F.col("shift"))).alias("crossing"), started.alias("already"),
                F.coalesce(F.every(F.col("contrast") <= F.col("_last") + 1e-9), F.lit(True)).alias("falling"), F.min(F.when(F.col("_in"), F.col("shift"))).alias("interval_crossing"),
                F.max(F.when(F.col("_i") == 1, F.col("_in"))).alias("interval_already"))
    return out.withColumn("crossing", F.when(~F.col("already"), F.col("crossing")))


def under_exposure(rows: DataFrame, unit: str, x: Sequence[str], beta: Sequence[float], exposure: str, levels: Sequence[float]) -> DataFrame:
    """g-computation: the mean unit total had every row each exposure level."""
    d = rows.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    eta = sum((F.lit(float(b)) * (F.col("level") if c == exposure else F.col(c)) for b, c in zip(beta, x, strict=True)), F.lit(0.0))
    return d.groupBy("level", unit).agg(F.sum(expit(eta)).alias("total")).groupBy("level").agg(F.avg("total").alias("mean_total"))


def contrast(beta: np.ndarray, cov: np.ndarray, weights: np.ndarray, z: float = 1.959963984540054) -> dict:
    est, se = float(weights @ beta), float(np.sqrt(weights @ cov @ weights))
    return {"estimate": est, "low": est - z * se, "high": est + z * se}
