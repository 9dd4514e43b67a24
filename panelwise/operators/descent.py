"""A ladder of estimators that is left downwards for named reasons only, with a record of every rung."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np

#: Fixed value: the share of resamples that may fail before the ladder goes one rung down.
FAILURE_SHARE = 0.25

#: The reasons for leaving a rung. None speaks of a contrast's size or sign.
TRIGGERS = {
    "T0": "the environment of the estimator is not there",
    "T1": "the fit did not converge",
    "T2": "an estimate lies on the boundary of its range",
    "T3": "a singular covariance of random effects",
    "T4": "too many resamples failed",
}


class RungFailure(ValueError):
    """A fit that failed for one of the named reasons."""

    def __init__(self, trigger: str, detail: str):
        if trigger not in TRIGGERS:
            raise KeyError(f"{trigger} is no named trigger")
        super().__init__(f"{trigger}: {detail}")
        self.trigger, self.detail = trigger, detail


@dataclass(frozen=True)
class Rung:
    """One estimator: how it is fitted, the triggers that it may fail on, whether it needs a response within [0, 1], and the
    environment it runs in (T0 skips the other rungs of that environment)."""

    name: str
    fit: Callable[[], object]
    triggers: tuple[str, ...] = ()
    bounded: bool = False
    environment: str = ""


@dataclass
class Descent:
    """What the ladder came to: the result, the rung (from 1), an outcome for each rung and the triggers in order."""

    result: object
    rung: int
    outcomes: list[tuple[int, str, str]]
    triggers: list[str] = field(default_factory=list)


def descend(rungs: Sequence[Rung], start: int = 1, start_trigger: str | None = None, bounded: bool = True) -> Descent:
    """The first rung from ``start`` that fits.

    Outcomes are ``converged``, ``did not converge``, ``skipped`` and ``not attempted``. A start below the first rung names its
    trigger if it is a descent (T4 after unstable resamples); without one it repeats the rung of another analysis. A response
    that is not ``bounded`` skips the rungs that need one. A singular matrix or a refused coefficient is T1. A failure on a trigger
    that the rung does not list is an error and no descent, as is a ladder without a rung that fits.
    """
    outcome = {i: "not attempted" for i in range(1, len(rungs) + 1)}
    fired = []
    if start > 1:
        outcome |= {i: "skipped" for i in range(1, start)}
        fired += [start_trigger] if start_trigger else []
    absent: set[str] = set()

    def record() -> list[tuple[int, str, str]]:
        return [(i, r.name, outcome[i]) for i, r in enumerate(rungs, 1)]

    for i, rung in enumerate(rungs, 1):
        if i < start:
            continue
        if (rung.bounded and not bounded) or (rung.environment and rung.environment in absent):
            outcome[i] = "skipped"
            continue
        try:
            result = rung.fit()
        except (RungFailure, np.linalg.LinAlgError, ValueError) as why:
            failed = why if isinstance(why, RungFailure) else RungFailure("T1", str(why))
            if failed.trigger not in rung.triggers:
                raise RuntimeError(f"{rung.name} failed on {failed.trigger}, which it does not list") from why
            fired.append(failed.trigger)
            outcome[i] = "did not converge"
            if failed.trigger == "T0":
                absent.add(rung.environment)
                outcome[i] = "skipped"
            continue
        outcome[i] = "converged"
        return Descent(result, i, record(), fired)
    raise RuntimeError("no rung of the ladder fits")


def stable_or_below(found: Descent, rungs: Sequence[Rung], resamples: Callable[[int], Sequence[object]], bounded: bool = True) -> Descent:
    """``found``, or one rung further down (T4) while more than FAILURE_SHARE of its resamples failed. ``resamples`` gives
    the fits of a rung's resamples, None for each that failed; the last rung cannot fail and is not asked."""
    while found.rung < len(rungs):
        fits = resamples(found.rung)
        if not len(fits) or sum(f is None for f in fits) <= FAILURE_SHARE * len(fits):
            break
        before = found.triggers
        found = descend(rungs, found.rung + 1, "T4", bounded)
        found.triggers = [*before, *found.triggers]
    return found
