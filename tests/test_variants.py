"""Re-fits under changed definitions against a plain Newton loop."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from panelwise.operators import variants as V


def newton(x, y, w):
    b = np.zeros(x.shape[1])
    for _ in range(30):
        m = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (w * m * (1 - m))[:, None]).T @ x, x.T @ (w * (y - m)))
    return b


def test_every_variant_is_its_own_fit(spark):
    rng = np.random.default_rng(3)
    n = 400
    a, g, y, w = rng.integers(0, 4, n), rng.integers(0, 2, n), rng.random(n), rng.random(n) + 0.1
    rows = spark.createDataFrame([(f"e{i % 90}", float(a[i]), float(g[i]), float(y[i]) if i % 7 else None, float(w[i])) for i in range(n)], "episode_id string, a double, g double, v double, w double")
    x = {"one": F.lit(1.0), "a": F.col("a"), "g": F.col("g")}
    variants = {"all": (None, x, F.col("v"), F.col("w")), "even": (F.col("a") % 2 == 0, x, F.col("v"), F.lit(1.0)), "other_group": (None, x | {"g": 1 - F.col("g")}, F.col("v"), F.col("w")),
                "none": (F.col("a") > 9, x, F.col("v"), F.col("w")), "singular": (F.col("g") == 1, x, F.col("v"), F.col("w")), "no_weight": (None, x, F.col("v"), F.lit(0.0))}
    got = {r.variant: r for r in V.fit_variants(V.long_design(rows, variants), list(variants), tuple(x), "g").collect()}
    seen = np.arange(n) % 7 != 0
    design = np.column_stack([np.ones(n), a, g])
    even = seen & (a % 2 == 0)
    np.testing.assert_allclose(got["all"].coefficient, newton(design[seen], y[seen], w[seen])[2], atol=1e-7)
    np.testing.assert_allclose(got["even"].coefficient, newton(design[even], y[even], np.ones(even.sum()))[2], atol=1e-7)
    np.testing.assert_allclose(got["other_group"].coefficient, -got["all"].coefficient, atol=1e-7)
    assert (got["all"].n_rows, got["all"].n_units) == (seen.sum(), len(set(np.arange(n)[seen] % 90)))
    assert [(got[k].coefficient, got[k].n_rows) for k in ("none", "no_weight")] == [(None, 0), (None, 0)]
    assert got["singular"].coefficient is None and got["singular"].n_rows == (seen & (g == 1)).sum()


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def test_kept_device(spark):
    episodes = spark.createDataFrame([(e, p, day(50), day(52)) for e, p in (("same", 1), ("changed", 2), ("before", 3), ("after", 4), ("none", 5), ("edge", 6))], "episode_id string, person_id long, index_date date, discharge_date date")
    devices = [(1, 30, "A"), (1, 60, "A"), (2, 45, "A"), (2, 60, "B"), (3, 10, "B"), (3, 50, "A"), (4, 50, "A"), (4, 63, "B"), (6, 20, "A"), (6, 62, "B")]
    d = spark.createDataFrame([(p, day(n), m) for p, n, m in devices], "person_id long, device_date date, model string")
    assert sorted(r[0] for r in V.kept_device(episodes, d, 30, 10).collect()) == ["after", "before", "none", "same"]
    assert V.kept_device(episodes, d.limit(0), 30, 10).count() == 6


def test_plain_flag(spark):
    episodes = spark.createDataFrame([("a", 1, day(1)), ("b", 2, day(1)), ("c", 3, day(1))], "episode_id string, person_id long, index_date date")
    records = spark.createDataFrame([(1, day(1), 10), (1, day(1), 30), (2, day(1), 20), (2, day(1), 30), (3, day(2), 20)], "person_id long, procedure_date date, code int")
    codes = spark.createDataFrame([(10, False, "fusion"), (20, True, "fusion"), (30, False, "other")], "code int, is_add_on boolean, procedure_class string")
    got = {r.episode_id: r.flag for r in V.plain_flag(episodes, records, codes, F.col("procedure_class") == "fusion").collect()}
    assert got == {"a": True, "b": False, "c": False}
