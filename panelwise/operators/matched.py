"""Conditional likelihood over matched sets in built-in aggregates, for one fit or for many resamples at once.

For a set with members i, case flags y and multiplicities m the log likelihood is
sum(m y eta) - sum(m y) * log(sum(m exp(eta))). A Newton step is one aggregate by (replicate, set), which gives the sums of exp(eta),
x exp(eta) and x x' exp(eta), and one over the sets. The design is stored once in buckets of the set, so
no step moves a row; what comes back is a row of p * (p + 3) / 2 + 1 sums for each replicate.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.operators.estimators import CEILING, multiplicity
from panelwise.sources.shared import stored_by

#: A refit share above this refuses the interval.
MOST_REFUSED = 0.25


def matched_design(rows: DataFrame, x: Sequence[str], person: str | None = None, weight: str | None = None) -> DataFrame:
    """``set_id, person, y, w, x0.., c0..`` of the sets that hold a case and a control, in buckets of the set.

    c are the covariates less their set's mean: the likelihood does not change and its exponentials stay small.
    Rows with a null in any of the columns are left out before sets are judged. ``weight`` is the set's (each
    member carries it); without one it is 1.
    """
    of_set = Window.partitionBy("set_id")
    d = rows.select("set_id", (F.col(person).cast("string") if person else F.lit("")).alias("person"), F.col("is_case").cast("double").alias("y"),
                    (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)]).dropna()
    d = d.withColumns({"_cases": F.sum("y").over(of_set), "_all": F.count(F.lit(1)).over(of_set), **{f"c{i}": F.col(f"x{i}") - F.avg(f"x{i}").over(of_set) for i in range(len(x))}})
    return stored_by(d.where("_cases > 0 AND _cases < _all").drop("_cases", "_all"), "set_id", "matched")


def _sums(rows: DataFrame, p: int, by: str, betas: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Log likelihood, gradient and information of each replicate at its coefficients."""
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    at = rows.sparkSession.createDataFrame([(k, *map(float, b)) for k, b in betas.items()], f"{by} int, " + ", ".join(f"_b{i} double" for i in range(p)))
    eta = sum((F.col(f"_b{i}") * F.col(f"c{i}") for i in range(p)), F.lit(0.0))
    d = rows.join(F.broadcast(at), by).withColumn("_e", F.col("m") * F.exp(eta))  # a row for each replicate
    cases = F.col("m") * F.col("y")
    by_set = d.groupBy(by, "set_id").agg(
        F.sum(cases).alias("n"), F.first("w").alias("w"), F.sum("_e").alias("s"), *[F.sum(cases * F.col(f"c{i}")).alias(f"k{i}") for i in range(p)],
        *[F.sum(F.col("_e") * F.col(f"c{i}")).alias(f"s{i}") for i in range(p)], *[F.sum(F.col("_e") * F.col(f"c{i}") * F.col(f"c{j}")).alias(f"s{i}_{j}") for i, j in pairs])
    share, n = lambda c: F.col(c) / F.col("s"), F.col("w") * F.col("n")
    total = by_set.where("n > 0").groupBy(by).agg(
        F.sum(n * F.ln("s")).alias("ll"), *[F.sum(F.col("w") * F.col(f"k{i}")).alias(f"k{i}") for i in range(p)], *[F.sum(n * share(f"s{i}")).alias(f"g{i}") for i in range(p)],
        *[F.sum(n * (share(f"s{i}_{j}") - share(f"s{i}") * share(f"s{j}"))).alias(f"h{i}_{j}") for i, j in pairs])
    out = {}
    for r in total.collect():
        k, h = np.array([r[f"k{i}"] for i in range(p)]), np.zeros((p, p))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        out[r[by]] = (float(betas[r[by]] @ k) - r["ll"], k - np.array([r[f"g{i}"] for i in range(p)]), h)
    return out


def fit_matched_each(rows: DataFrame, p: int, by: str, keys: Sequence[int], ridge: float = 0.0, steps: int = 30) -> dict[int, dict | None]:
    """A damped Newton fit for every value of ``by``, all in step; None where no set is informative or the steps
    run out. Coefficients beyond CEILING are kept and marked, as a resample's must be counted and not dropped.

    ``rows`` has the columns of ``matched_design``, ``by`` and the multiplicity ``m``.
    """
    beta = {k: np.zeros(p) for k in keys}
    now: dict[int, tuple] = {}
    step: dict[int, np.ndarray] = {}
    tried = dict(beta)
    done: dict[int, bool] = {}
    for _ in range(steps):
        if not tried:
            break
        found = _sums(rows, p, by, tried)
        for k in list(tried):
            if k not in found:
                done[k] = False
                continue
            ll, g, h = found[k]
            ll, g, h = ll - ridge * tried[k] @ tried[k] / 2, g - ridge * tried[k], h + ridge * np.eye(p)
            if k in now and not ll >= now[k][0] - 1e-9 * (1 + abs(now[k][0])) and np.abs(step[k]).max() > 1e-6:
                step[k] = step[k] / 2  # the likelihood fell: half the step
                continue
            moved = np.abs(tried[k] - beta[k]).max() if k in now else np.inf
            beta[k], now[k] = tried[k], (ll, g, h)
            if moved < 1e-8:
                done[k] = True
                continue
            step[k] = np.linalg.pinv(h, hermitian=True) @ g
            if not np.isfinite(step[k]).all():
                done[k] = False
        tried = {k: beta[k] + step[k] for k in tried if k not in done}
    return {k: {"beta": beta[k], "information": now[k][2], "loglik": now[k][0], "above": bool(np.abs(beta[k]).max() > CEILING)} if done.get(k, k in now and np.abs(step[k]).max() < 1e-5) else None for k in keys}


def _scores(design: DataFrame, p: int, beta: np.ndarray, by: str) -> np.ndarray:
    """Sum of outer products of the scores (y - cases * p) x, summed by set or by person first."""
    eta = sum((F.lit(float(b)) * F.col(f"c{i}") for i, b in enumerate(beta)), F.lit(0.0))
    d = design.withColumn("_e", F.exp(eta))
    sets = d.groupBy("set_id").agg(F.sum("_e").alias("_s"), F.sum("y").alias("_n"))
    left = F.col("w") * (F.col("y") - F.col("_n") * F.col("_e") / F.col("_s"))
    by_cluster = d.join(sets, "set_id").groupBy(by).agg(*[F.sum(left * F.col(f"x{i}")).alias(f"u{i}") for i in range(p)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    r = by_cluster.agg(*[F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i, j in pairs]).first()
    out = np.zeros((p, p))
    for i, j in pairs:
        out[i, j] = out[j, i] = r[f"m{i}_{j}"] or 0.0
    return out


def fit_conditional_logit(rows: DataFrame, x: Sequence[str], person: str | None = None, weight: str | None = None, ridge: float = 0.0, steps: int = 60, design: DataFrame | None = None) -> dict:
    """Conditional logistic regression over ``set_id, is_case`` and covariates: coefficients, model covariance, covariances robust to
    sets and, if ``person`` is named, to persons over all the sets that they serve in.

    Sets without a case or without a control say nothing and are left out. ``ridge`` is a penalty on the
    squared coefficients. Refused: no informative set, no convergence, a coefficient beyond CEILING.
    """
    p = len(x)
    d = design if design is not None else matched_design(rows, x, person, weight)
    fit = fit_matched_each(d.withColumns({"b": F.lit(0), "m": F.lit(1.0)}), p, "b", [0], ridge, steps)[0]
    if fit is None:
        raise ValueError("not estimable: no informative set, or no convergence")
    if fit["above"]:
        raise ValueError("separated: a coefficient passes the ceiling")
    bread = np.linalg.pinv(fit["information"], hermitian=True)
    out = {"beta": fit["beta"], "cov": bread, "loglik": fit["loglik"], "robust": bread @ _scores(d, p, fit["beta"], "set_id") @ bread}
    if person:
        out["clustered"] = bread @ _scores(d, p, fit["beta"], "person") @ bread
    return out


def bootstrap_contrasts(design: DataFrame, p: int, contrasts: dict[str, np.ndarray], b: int, ridge: float = 0.0, seed: int = 1) -> list[tuple]:
    """``name, low, high, failed, above``: percentile intervals of contrasts over refits in resamples of whole persons, who carry all
    their rows; sets keep their identity, so one whose case was not drawn says nothing. Refits that fail are
    counted, those beyond CEILING kept and counted; more than MOST_REFUSED of those and the interval is
    refused (nan)."""
    many = design.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b)))).withColumn("m", multiplicity(F.col("b"), F.col("person"), seed).cast("double")).where("m > 0")
    fits = fit_matched_each(stored_by(many, "set_id", "resampled"), p, "b", range(1, b + 1), ridge)
    good = [f for f in fits.values() if f is not None]
    failed, above = 1 - len(good) / max(b, 1), sum(f["above"] for f in good) / max(len(good), 1)
    out = []
    for name, c in contrasts.items():
        v = np.array([c @ f["beta"] for f in good])
        low, high = np.percentile(v, [2.5, 97.5]) if len(v) and above <= MOST_REFUSED else (np.nan, np.nan)
        out.append((name, float(low), float(high), float(failed), float(above)))
    return out


def association(members: DataFrame, block: Sequence[str], structural: Column, contrasts: dict[str, np.ndarray], covariates: Sequence[str] = (), person: str = "person_id", b: int = 1000, ridge: float = 0.0, z: float = 1.959963984540054) -> list[tuple]:
    """How an exposure goes with being the case of a matched set: per contrast over the block's columns the estimate, its model and
    person-clustered errors, the clustered interval, the bootstrap interval, shares of refits that failed and that passed the ceiling.

    ``members``: set_id, role, the person, and the columns of ``block`` (see ``exposure_block``) and ``covariates``. Members that could have no exposure
    (``structural``) are dropped before sets are judged. The design is built once; resamples reweight its rows.
    """
    x = [*block, *covariates]
    rows = members.where(~F.coalesce(structural, F.lit(False))).withColumn("is_case", F.col("role") == "case")
    d = matched_design(rows, x, person)
    fit = fit_conditional_logit(rows, x, person, ridge=ridge, design=d)
    wide = {n: np.r_[np.asarray(c, float), np.zeros(len(covariates))] for n, c in contrasts.items()}
    boot = {r[0]: r[1:] for r in bootstrap_contrasts(d, len(x), wide, b, ridge)}
    out = []
    for n, c in wide.items():
        est, naive, se = float(c @ fit["beta"]), float(np.sqrt(c @ fit["cov"] @ c)), float(np.sqrt(c @ fit["clustered"] @ c))
        out.append((n, est, naive, se, est - z * se, est + z * se, *boot[n]))
    return out
