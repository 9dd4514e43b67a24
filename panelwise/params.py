"""Run parameters: windows and thresholds are data. The defaults are the reference windows."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CohortParams:
    baseline: tuple[int, int] = (-30, -8)
    baseline_early: tuple[int, int] = (-60, -15)
    baseline_late: tuple[int, int] = (-30, -1)
    least_baseline_days: int = 7
    least_baseline_span: int = 14
    accrual: tuple[int, int] = (1, 35)
    panel_days: int = 90
    landmark: tuple[int, int] = (-5, -3)
    reference: tuple[int, int] = (-12, -6)
    control: tuple[int, int] = (-14, -8)
    least_window_days: int = 2
    lag_days: int = 7
    prior_days: int = 90
    look_back: int = 30
    ed_days: int = 2
    baseline_floor: int = 1000
    bands: tuple[int, int] = (3000, 7000)
    per_set: int = 5
    per_person: int = 3
    rule: str = "primary"
    junction_map: str = "primary"
    salt: str = "panel"
    seed: int = 1
    minute_column: str = "minute_in_zone"

    def validated(self) -> CohortParams:
        if self.baseline[0] > self.baseline[1] or self.baseline[1] >= 0:
            raise ValueError("the baseline window must end before the index date")
        if self.rule not in ("primary", "s1", "s2", "s3", "s4"):
            raise ValueError(f"unknown validity rule {self.rule}")
        if self.junction_map not in ("primary", "mirrored"):
            raise ValueError(f"unknown map {self.junction_map}")
        if self.panel_days < self.accrual[1]:
            raise ValueError("the panel must hold the accrual window")
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", self.minute_column):
            raise ValueError("not a column name")
        return self


#: Windows for tables that span 30 days.
SCALED = replace(CohortParams(), baseline=(-10, -3), baseline_early=(-14, -5), baseline_late=(-10, -1), least_baseline_days=3, least_baseline_span=4, accrual=(1, 10), panel_days=15)


def build_params(spark: SparkSession, params: CohortParams, records: DataFrame, date: str) -> DataFrame:
    """The one-row parameter table: validated settings and the source's last date."""
    p = params.validated()
    cols = {k: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for k, v in asdict(p).items()}
    return records.agg(F.max(date).alias("source_cutoff")).withColumns(cols)
