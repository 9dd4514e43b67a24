"""Supplementary re-fits of the deficit model (E13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators import estimators as E
from panelwise.operators import variants as V
from panelwise.params import SCALED as P
from panelwise.plans.chain import Chain, rounded
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.fits import newton_sql
from panelwise.plans.registry import query

#: Days that each half of the week needs for a baseline of its own.
WEEKDAYS, WEEKEND_DAYS = 2, 1

_LAGGED = newton_sql("(SELECT *, coalesce(lagged_wear_fraction, 0) AS lag FROM days)", ["1", "day", "lag"], "y")
_DESIGN = f"""lagged AS MATERIALIZED ({_LAGGED}),
raw AS (SELECT d.episode_id, d.post_day, 1 / (1 + exp(-(b0 + b1 * day + b2 * coalesce(lagged_wear_fraction, 0)))) AS p, avg(y) OVER (PARTITION BY region) AS share, is_analyzable FROM days d, lagged),
lag_weights AS (SELECT episode_id, post_day, greatest(quantile_cont(r, 0.01) OVER (), least(quantile_cont(r, 0.99) OVER (), r)) AS lag_weight FROM (SELECT episode_id, post_day, share / p AS r FROM raw WHERE is_analyzable)),
own AS (SELECT e.episode_id, bool_or(k.procedure_class = 'fusion') AS own_fusion FROM episodes e JOIN records r ON r.person_id = e.person_id AND r.procedure_date = e.index_date JOIN codes k USING (code) WHERE NOT k.is_add_on GROUP BY 1),
moved AS (SELECT f.episode_id FROM features f JOIN devices d ON d.person_id = f.person_id AND d.device_date BETWEEN f.index_date - {P.look_back} AND f.index_date + {3 * P.panel_days} WHERE d.device_date <= f.discharge_date + {P.panel_days} GROUP BY 1 HAVING count(DISTINCT d.model) > 1),
lasted AS (SELECT w.*, lag_weight, CAST(coalesce(own_fusion, FALSE) AS DOUBLE) AS own_fusion, w.episode_id IN (SELECT episode_id FROM moved) AS moved, b.n_valid_baseline_days_weekday AS k5, b.n_valid_baseline_days_weekend AS k2, CASE WHEN weekend = 1 THEN b.baseline_steps_weekend ELSE b.baseline_steps_weekday END AS own_base
 FROM weighted w LEFT JOIN lag_weights USING (episode_id, post_day) LEFT JOIN own USING (episode_id) JOIN baseline b ON b.episode_id = w.episode_id)"""
_THREE = {
    "primary": ("TRUE", "fusion", "deficit", "weight"),
    "unweighted": ("TRUE", "fusion", "deficit", "1"),
    "weights_with_lag": ("TRUE", "fusion", "deficit", "lag_weight"),
    "one_device": ("NOT moved", "fusion", "deficit", "weight"),
    "own_records_only": ("TRUE", "own_fusion", "deficit", "weight"),
    "both_halves_of_week": (f"k5 >= {WEEKDAYS} AND k2 >= {WEEKEND_DAYS}", "fusion", "CASE WHEN is_analyzable AND own_base > 0 THEN greatest(0, 1 - steps / own_base) END", "weight"),
}
_UNION = " UNION ALL ".join(f"SELECT '{n}' AS variant, episode_id, day, CAST({f} AS DOUBLE) AS fusion, {y} AS y, {w} AS w FROM lasted WHERE {c}" for n, (c, f, y, w) in _THREE.items())


@query("e13c_supplementary", sql(f"WITH {_DESIGN}, design AS MATERIALIZED (SELECT * FROM ({_UNION}) WHERE y IS NOT NULL AND w > 0), fits AS MATERIALIZED ({newton_sql('design', ['1', 'day', 'fusion'], 'y', 'w', 'variant')}) SELECT variant, count(episode_id) AS n_rows, count(DISTINCT episode_id) AS n_units, round(any_value(b2), 5) AS coefficient FROM (SELECT unnest({list(_THREE)}) AS variant) LEFT JOIN design USING (variant) LEFT JOIN fits USING (variant) GROUP BY variant", "weighted", "baseline", "devices", "records", "codes"))
def e13c(c: Chain) -> DataFrame:
    """The deficit model's contrast under other weights, without changed devices, with fusion read from records that define
    an operation, and with a baseline for each half of the week, all fitted together."""
    d = _rows(c)
    three = lambda fusion="fusion": {"one": F.lit(1.0), "day": F.col("day"), "fusion": F.col(fusion)}
    lost, w = F.col("deficit"), F.col("weight")
    halves = (F.col("n_valid_baseline_days_weekday") >= WEEKDAYS) & (F.col("n_valid_baseline_days_weekend") >= WEEKEND_DAYS)
    base = F.when(F.col("weekend") == 1, F.col("baseline_steps_weekend")).otherwise(F.col("baseline_steps_weekday"))
    own_lost = F.when(F.col("is_analyzable") & (base > 0), F.greatest(F.lit(0.0), 1 - F.col("steps") / base))
    variants = {"primary": (None, three(), lost, w), "unweighted": (None, three(), lost, F.lit(1.0)), "weights_with_lag": (None, three(), lost, F.col("lag_weight")), "one_device": (F.col("same_device"), three(), lost, w),
                "own_records_only": (None, three("own_fusion"), lost, w), "both_halves_of_week": (halves, three(), own_lost, w)}
    return rounded(V.fit_variants(V.long_design(d, variants), list(variants), ("one", "day", "fusion"), "fusion"), "coefficient", digits=5)


def _rows(c: Chain) -> DataFrame:
    from panelwise.plans.estimates import _observed

    def make() -> DataFrame:
        d = _observed(c).drop("observed").withColumn("lag", F.coalesce("lagged_wear_fraction", F.lit(0.0)))
        seen = ("one", "day", "lag")
        other = E.inverse_weights(E.with_fitted(d.drop("weight"), seen, E.fit_logit(d, seen, "y")["beta"], "observed"), "is_analyzable", "observed", "region")
        d = d.join(other.select("episode_id", "post_day", F.col("weight").alias("lag_weight")), ["episode_id", "post_day"])
        base = c.baseline.select("episode_id", *[f"{a}_{h}" for a in ("baseline_steps", "n_valid_baseline_days") for h in ("weekday", "weekend")])
        own = V.plain_flag(c.episodes, c.records, c.codes, F.col("procedure_class") == "fusion").select("episode_id", F.col("flag").cast("double").alias("own_fusion"))
        same = V.kept_device(c.features, c.devices, P.look_back, P.panel_days).withColumn("same_device", F.lit(True))
        return d.join(base, "episode_id").join(own, "episode_id", "left").join(same, "episode_id", "left").withColumns({"own_fusion": F.coalesce("own_fusion", F.lit(0.0)), "same_device": F.coalesce("same_device", F.lit(False))})

    return c.kept("variant_rows", make)


_FOUR = {
    "baseline_adjusted": ("TRUE", "day", "baseline_steps / 10000"),
    "four_groups": ("region IN ('cervical', 'lumbar')", "CAST(region = 'cervical' AS DOUBLE)", "fusion * CAST(region = 'cervical' AS DOUBLE)"),
}


@query("e13d_wider_models", sql("WITH design AS MATERIALIZED (SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS variant, episode_id, {a} AS a, fusion, {b} AS b, deficit AS y, weight AS w FROM weighted WHERE {cond}" for n, (cond, a, b) in _FOUR.items())
       + f") WHERE y IS NOT NULL AND w > 0), fits AS MATERIALIZED ({newton_sql('design', ['1', 'a', 'fusion', 'b'], 'y', 'w', 'variant')}) SELECT variant, count(*) AS n_rows, count(DISTINCT episode_id) AS n_units, round(any_value(b2), 5) AS coefficient FROM design JOIN fits USING (variant) GROUP BY variant", "weighted"))
def e13d(c: Chain) -> DataFrame:
    """The contrast with the baseline's step count in the model, and in a model of four groups (region by fusion, where fusion's
    term is that of the lumbar pair)."""
    from panelwise.plans.estimates import _observed

    lost, w, one, fusion = F.col("deficit"), F.col("weight"), F.lit(1.0), F.col("fusion")
    cervical = (F.col("region") == "cervical").cast("double")
    variants = {"baseline_adjusted": (None, {"one": one, "a": F.col("day"), "fusion": fusion, "b": F.col("baseline_steps") / 10000}, lost, w),
                "four_groups": (F.col("region").isin("cervical", "lumbar"), {"one": one, "a": cervical, "fusion": fusion, "b": fusion * cervical}, lost, w)}
    return rounded(V.fit_variants(V.long_design(_observed(c), variants), list(variants), ("one", "a", "fusion", "b"), "fusion"), "coefficient", digits=5)
