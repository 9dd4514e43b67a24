"""Checks between parts of an analysis, each over a whole table as built and over one that is damaged on purpose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators import descent, events, ledgers
from panelwise.operators import disclosure as D
from panelwise.operators import estimators as E
from panelwise.operators import gates as G
from panelwise.operators.aggregates import missingness
from panelwise.operators.joins import orphans
from panelwise.params import SCALED as P
from panelwise.plans.chain import Chain
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.fits import multiplicity_sql
from panelwise.plans.registry import query
from panelwise.sources import io


def _both(first: DataFrame, second: DataFrame, a: str = "as_built", b: str = "damaged") -> DataFrame:
    return first.withColumn("input", F.lit(a)).unionByName(second.withColumn("input", F.lit(b)))


_BANDS = """
days AS (SELECT reading, person_id, date, sum(m) AS total, sum(k) AS n_rows, count(zone) AS n_zones, sum(nulls) AS n_null FROM per_zone GROUP BY ALL),
counted AS (SELECT reading, count(*) AS person_days, count(DISTINCT person_id) AS persons, sum(CASE WHEN total < 600 THEN 1 ELSE 0 END) AS below_valid, sum(CASE WHEN total >= 600 AND total <= 1440 THEN 1 ELSE 0 END) AS valid, sum(CASE WHEN total > 1440 THEN 1 ELSE 0 END) AS above_ceiling,
 sum(CASE WHEN total >= 1380 AND total <= 1440 THEN 1 ELSE 0 END) AS top, sum(CASE WHEN n_rows > n_zones THEN 1 ELSE 0 END) AS repeated_label, sum(CASE WHEN n_null > 0 THEN 1 ELSE 0 END) AS null_minutes, sum(CASE WHEN total IS NULL THEN 1 ELSE 0 END) AS no_total FROM days GROUP BY reading)"""


@query("q01b_zone_verdict", sql(f"""WITH recorded AS (SELECT person_id, date, zone, sum(minute_in_zone) AS m, count(*) AS k, count(*) - count(minute_in_zone) AS nulls FROM zones GROUP BY ALL),
per_zone AS (SELECT 'recorded' AS reading, * FROM recorded UNION ALL SELECT 'merged', person_id, date, zone, m, 1, CASE WHEN m IS NULL THEN 1 ELSE 0 END FROM recorded),{_BANDS}
SELECT reading, 'minutes' AS block, label, CAST(n AS BIGINT) AS n FROM counted UNPIVOT (n FOR label IN (person_days, persons, below_valid, valid, above_ceiling, top, repeated_label, null_minutes, no_total))
UNION ALL SELECT reading, 'zone', zone, CAST(sum(k) AS BIGINT) FROM per_zone GROUP BY reading, zone
UNION ALL SELECT reading, 'verdict', CASE WHEN repeated_label > 0 THEN 'repeated_label' WHEN above_ceiling > 0 THEN 'above_ceiling' WHEN top > 0 THEN 'partition' ELSE 'inconclusive' END, person_days FROM counted""", "zones"))
def q01b(c: Chain) -> DataFrame:
    """Bands, labels and verdict of the zones as recorded, and with the rows of a zone on a day merged."""
    merged = c.zones.groupBy("person_id", "date", "zone").agg(F.sum("minute_in_zone").alias("minute_in_zone"))
    out = None
    for name, rows in (("recorded", c.zones), ("merged", merged)):
        bands = G.zone_bands(rows, "person_id", "date", "zone", "minute_in_zone")
        one = bands.unionByName(G.zone_verdict(bands).select(F.lit("verdict").alias("block"), F.col("verdict").alias("label"), "n")).withColumn("reading", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("cp24c_tier_catalogue", sql("SELECT stratum, n, tier, analysis, coalesce(tier <= most, FALSE) AS permitted, CASE WHEN most IS NULL THEN 'never' WHEN tier <= most THEN 'permitted' ELSE 'too_few_events' END AS why FROM (SELECT *, CASE WHEN n >= 100 THEN 1 WHEN n >= 50 THEN 2 WHEN n >= 20 THEN 3 ELSE 4 END AS tier FROM (SELECT unnest(['all', region]) AS stratum, count(*) AS n FROM ev JOIN features USING (episode_id) WHERE has_landmark GROUP BY 1)), (VALUES "
       + ", ".join(f"('{a}', {max(t) if t else 'NULL'})" for a, t in G.CATALOGUE) + ") v(analysis, most)", "ev", "features"))
def cp24c(c: Chain) -> DataFrame:
    """What each region's number of events, and that of all, permits."""
    e = c.ev.where("has_landmark").select("episode_id").join(c.features.select("episode_id", "region"), "episode_id")
    strata = e.select(F.explode(F.array(F.lit("all"), F.col("region"))).alias("stratum")).groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return G.permitted(strata, G.catalogue(c.spark), "n")


_STAGES = f"""totals AS (SELECT 1 AS place, 'A' AS stage, count(*) AS n FROM episodes WHERE region IN ('cervical', 'lumbar') UNION ALL SELECT 2, 'B', count(*) FROM baseline WHERE n_valid_baseline_days >= {P.least_baseline_days}
 UNION ALL SELECT 3, 'C', count(*) FROM elig WHERE NOT x_no_window UNION ALL SELECT 4, 'D', count(*) FROM ev WHERE is_first_event UNION ALL SELECT 5, 'E', count(*) FROM ev WHERE is_first_event AND has_landmark UNION ALL SELECT 6, 'F', count(*) FROM ev WHERE is_first_event AND has_landmark),
leaves AS (SELECT sum(k) AS n, count(*) AS n_leaves FROM (SELECT count(*) AS k FROM ev JOIN features f USING (episode_id) WHERE is_first_event AND has_landmark GROUP BY f.is_fusion, f.region)),
seen AS (SELECT 'as_built' AS input, * FROM totals UNION ALL SELECT 'damaged', * FROM totals WHERE stage <> 'C')"""


@query("q29b_ladder_read", sql(f"""WITH {_STAGES}
SELECT input, 'rises' AS rule, stage, last AS expected, n AS found FROM (SELECT *, lag(n) OVER (PARTITION BY input ORDER BY place) AS last FROM seen) WHERE n > last
UNION ALL SELECT 'damaged', 'absent_stage', 'C', 1, 0 FROM totals WHERE stage = 'C' UNION ALL SELECT 'damaged', 'unknown_stage', 'X', 0, 1 FROM totals WHERE stage = 'A'
UNION ALL SELECT 'damaged', 'repeated_row', 'A', 1, 2 FROM totals WHERE stage = 'A'
UNION ALL SELECT input, 'split_differs', 'F', t.n, l.n + more * l.n_leaves FROM leaves l, (VALUES ('as_built', 0), ('damaged', 1)) v(input, more), totals t WHERE t.stage = 'E' AND t.n <> l.n + more * l.n_leaves""", "episodes", "baseline", "elig", "ev", "features"))
def q29b(c: Chain) -> DataFrame:
    """The gate's ledger read as built, and with stage C gone, an unknown stage, a row twice and one more event in each stratum of F."""
    from panelwise.plans.whole import cp25b

    built = cp25b(c).withColumn("part", F.when(F.col("part") == "composite", "total").otherwise(F.col("part")))
    leaf = F.col("stratum").contains("_")
    top = built.where("stage = 'A' AND stratum = 'all'")
    damaged = built.where("stage <> 'C'").withColumn("n", F.when((F.col("stage") == "F") & leaf, F.col("n") + 1).otherwise(F.col("n")))
    damaged = damaged.unionByName(top).unionByName(top.withColumn("stage", F.lit("X")))
    read = lambda d: G.stage_problems(d, "ABCDEF", "E", "F", leaf)
    return _both(read(built), read(damaged))


_GAPS = "(SELECT count_if(lagged_wear_fraction IS NULL) AS lag_gaps, count_if(day_kind = 'observed' AND deficit IS NULL) AS gaps FROM panel)"


@query("q25c_missingness_rules", sql(f"SELECT 'as_built' AS input, 'gap_in_complete' AS rule, CAST(1 AS BIGINT) AS n FROM {_GAPS} WHERE gaps > 0 UNION ALL SELECT 'damaged', rule, 1 FROM {_GAPS}, (VALUES ('undeclared'), ('absent'), ('repeated')) v(rule) UNION ALL SELECT 'damaged', 'gap_in_complete', 1 FROM {_GAPS} WHERE lag_gaps > 0 UNION ALL SELECT 'damaged', 'missing_over_rows', 1 FROM (SELECT count(*) - count(steps) AS gaps FROM panel WHERE NOT is_censored) WHERE gaps > 0 UNION ALL SELECT 'damaged', 'negative', 1 FROM (SELECT count(*) - count(steps) AS gaps FROM panel WHERE NOT is_censored) WHERE gaps > 0", "panel"))
def q25c(c: Chain) -> DataFrame:
    """Rules of the missingness ledger, as built and with another list of variables, a row twice and a count turned round."""
    built = missingness(c.panel, {"deficit": F.col("day_kind") == "observed", "lagged_wear_fraction": F.lit(True), "steps": ~F.col("is_censored"), "region": F.lit(True)})
    turned = built.where("variable = 'steps'").select("variable", (-F.col("n_missing")).alias("n"), "n_missing")
    damaged = built.where("variable <> 'steps'").unionByName(turned).unionByName(built.where("variable = 'deficit'"))
    return _both(G.missingness_problems(built, ("deficit", "lagged_wear_fraction", "steps", "region"), ("deficit",)),
                 G.missingness_problems(damaged, ("deficit", "lagged_wear_fraction", "steps", "baseline_steps"), ("lagged_wear_fraction",)))


_LAG = "(SELECT list_position([0, 0.25, 0.5, 0.75], (SELECT max(x) FROM (SELECT unnest([0, 0.25, 0.5, 0.75]) AS x) WHERE x <= f)) AS band, * FROM (SELECT lagged_wear_fraction AS f, is_censored, is_analyzable, post_day FROM panel))"


@query("q25d_observation_rules", sql(f"""WITH b AS (SELECT CASE WHEN f IS NULL THEN 'unavailable' WHEN f = 0 THEN 'none' WHEN f = 1 THEN 'all' ELSE CAST(band AS VARCHAR) END AS name, count(*) - count_if(is_censored) AS risk, count_if(is_analyzable) AS seen, count_if(post_day = 1) AS first FROM {_LAG} GROUP BY 1)
SELECT * FROM (SELECT 'as_built' AS input, 'analyzable_over_at_risk' AS rule, count_if(seen > risk) AS n FROM b UNION ALL SELECT 'as_built', 'lag_on_first_day', CAST(sum(CASE WHEN name <> 'unavailable' THEN first ELSE 0 END) AS BIGINT) FROM b
UNION ALL SELECT 'damaged', 'analyzable_over_at_risk', count_if(risk > seen) FROM b UNION ALL SELECT 'damaged', 'unknown_band', count_if(name = 'unavailable') FROM b UNION ALL SELECT 'damaged', 'lag_on_first_day', CAST(sum(first) AS BIGINT) FROM b) WHERE n > 0""", "panel"))
def q25d(c: Chain) -> DataFrame:
    """Rules of the observation model's input by band of the lag, as built and with two counts swapped and a band renamed."""
    bands = G.lag_band_ledger(c.panel)
    swapped = bands.select(F.when(F.col("band") == "unavailable", "blank").otherwise(F.col("band")).alias("band"), "n_days", F.col("n_analyzable").alias("n_at_risk"), F.col("n_at_risk").alias("n_analyzable"), "n_first_day")
    return _both(G.observation_problems(bands), G.observation_problems(swapped))


_CELLS = "(SELECT visit_kind, origin, count(*) AS n FROM visits GROUP BY ALL)"


@query("q32b_print_rules", sql(f"SELECT * FROM (SELECT 'raw' AS input, 'illegal_count' AS rule, 'n' AS \"column\", count_if(n % 20 <> 0) AS n FROM {_CELLS} UNION ALL SELECT 'raw', rule, c, count(*) > 0 FROM {_CELLS}, (VALUES ('declared_twice', 'n'), ('undeclared', 'visit_kind'), ('undeclared', 'last_seen'), ('absent', 'gone'), ('date', 'last_seen')) v(rule, c) GROUP BY rule, c) WHERE n > 0", "visits"))
def q32b(c: Chain) -> DataFrame:
    """Reasons not to print a table of visits: none once it is suppressed and declared, six of the raw one with a wrong declaration."""
    cells = c.visits.groupBy("visit_kind", "origin").agg(F.count(F.lit(1)).alias("n"), F.max("visit_start_date").alias("last_seen"))
    ready = D.suppress_frame(cells.drop("last_seen"), ["n"]).select("visit_kind", "origin", "n")
    return _both(G.print_problems(ready, ["n"], ["visit_kind", "origin"]), G.print_problems(cells, ["n"], ["origin", "n", "gone"]), "prepared", "raw")


@query("q33b_stored_compared", sql("SELECT n_controls, a.n AS stored, b.n AS made, coalesce(a.n = b.n, FALSE) AS agrees FROM (SELECT k AS n_controls, count(*) AS n FROM (SELECT set_id, count(CASE WHEN role = 'control' THEN 1 END) AS k FROM sets GROUP BY set_id) GROUP BY k) a FULL JOIN (SELECT k AS n_controls, count(*) AS n FROM (SELECT set_id, count(CASE WHEN role = 'control' THEN 1 END) AS k FROM sets WHERE match_rung < 3 GROUP BY set_id) GROUP BY k) b USING (n_controls)", "sets"))
def q33b(c: Chain) -> DataFrame:
    """The stored ledger of set sizes beside one counted again from sets without the loosest rung: where they differ is named."""
    stored = c.kept("set_sizes", lambda: ledgers.set_size_ledger(c.sets))
    return G.compared(stored, ledgers.set_size_ledger(c.sets.where("match_rung < 3")), "n_controls", "n_sets")


@query("cp13y_broken_landmarks", sql("SELECT l.episode_id, l.post_day, l.n_valid + 1 AS n_valid, e.n_valid AS ev_valid FROM lm l, ev e WHERE e.episode_id = l.episode_id AND e.event_day = l.post_day AND l.post_day % 3 = 0 AND l.n_valid + 1 <> e.n_valid", "lm", "ev"))
def cp13y(c: Chain) -> DataFrame:
    """The cross-check of landmark windows over a panel that counts one day too many on every third day."""
    return events.landmark_disagreements(c.lm.withColumn("n_valid", F.col("n_valid") + (F.col("post_day") % 3 == 0).cast("int")), c.ev)


@query("q22c_broken_ladder", sql("WITH l AS (SELECT CAST(s AS INTEGER) AS step, (SELECT count(*) FROM elig WHERE coalesce(first_fail_step, 99) >= s) AS n_in, (SELECT count(*) FROM elig WHERE coalesce(first_fail_step, 99) > s) AS n_out FROM range(3, 16) r(s)), b AS (SELECT step, n_in, CASE WHEN step = 7 THEN -1 ELSE n_in - n_out END AS d, n_out + CASE WHEN step = 5 THEN n_in + 1 ELSE 0 END AS n_out FROM l) SELECT step, 'closes' AS problem FROM b WHERE n_in - d <> n_out UNION ALL SELECT step, 'carries' FROM (SELECT step, n_in, lag(n_out) OVER (ORDER BY step) AS last FROM b) WHERE last <> n_in UNION ALL SELECT step, 'not_negative' FROM b WHERE d < 0 OR n_in < 0 OR n_out < 0 UNION ALL SELECT step, 'falls' FROM b WHERE n_out > n_in", "elig"))
def q22c(c: Chain) -> DataFrame:
    """The ladder's rules over one whose fifth step lets more out than came in and whose seventh drops less than nothing."""
    built = ledgers.attrition(c.elig)
    return ledgers.ladder_problems(built.withColumns({"n_out": F.col("n_out") + F.when(F.col("step") == 5, F.col("n_in") + 1).otherwise(0), "n_dropped": F.when(F.col("step") == 7, -1).otherwise(F.col("n_dropped"))}))


@query("cp16d_broken_slugs", sql("SELECT 'cut_short' AS slug FROM elig, range(2) GROUP BY range UNION ALL SELECT 'out_of_list' FROM (SELECT count(*) FROM elig)", "elig"))
def cp16d(c: Chain) -> DataFrame:
    """Reasons below rungs that no ladder has: two of a renamed rung and one of a made-up one are named."""
    from panelwise.plans.whole import cp16b

    slugs = cp16b(c).select(F.when(F.col("slug") == "truncated", "cut_short").otherwise(F.col("slug")).alias("slug"))
    more = c.elig.agg(F.lit("out_of_list").alias("slug"))
    return orphans(slugs.unionByName(more), ledgers.full_ladder(c.elig, c.persons, c.ev), ["slug"])


@query("io3b_table_sizes")
def io3b(c: Chain) -> DataFrame:
    """Rows, files and bytes of each table that is read here."""
    names = ("events", "documents", "orders", "lineitem", "customer")
    return io.table_sizes({n: c.spark.read.parquet(f"{c.sf}/{n}.parquet") for n in names}, "^(events|orders|lineitem)$")


_B = 20
_WHO = "(SELECT min(person_id) AS person_id FROM (SELECT person_id FROM days WHERE deficit IS NOT NULL GROUP BY person_id HAVING avg(deficit) > 0 AND avg(deficit) < 1))"


@query("e23b_named_triggers", sql(f"""WITH reps AS (SELECT CAST(unnest(range(1, {_B + 1})) AS INTEGER) AS b), units AS (SELECT person_id, bool_or(fusion = 1) AS fused, bool_or(fusion = 0) AS unfused FROM days WHERE deficit IS NOT NULL GROUP BY person_id),
drawn AS (SELECT b, u.*, {multiplicity_sql('b', 'person_id')} AS m FROM units u, reps),
shares AS (SELECT 'steady' AS ladder, avg(CAST(NOT (x AND y) AS INTEGER)) AS failed FROM (SELECT b, bool_or(fused AND m > 0) AS x, bool_or(unfused AND m > 0) AS y FROM drawn GROUP BY b) UNION ALL SELECT 'one_person', avg(CAST(m = 0 AS INTEGER)) FROM drawn JOIN {_WHO} USING (person_id))
SELECT ladder, rung, estimator, CASE WHEN failed > 0.25 THEN first_out ELSE outcome END AS outcome, CASE WHEN failed > 0.25 THEN 'T4' ELSE '' END AS triggers FROM shares, (VALUES (1, 'fractional_logit', 'converged', 'skipped'), (2, 'cell_means', 'not attempted', 'converged')) v(rung, estimator, outcome, first_out)
UNION ALL SELECT 'separated', rung, estimator, outcome, 'T1' FROM (SELECT count(DISTINCT y) AS k FROM days), (VALUES (1, 'logit_on_itself', 'did not converge'), (2, 'fractional_logit', 'converged'), (3, 'cell_means', 'not attempted')) v(rung, estimator, outcome) WHERE k = 2
UNION ALL SELECT 'unbounded', rung, estimator, outcome, '' FROM (SELECT count(*) FROM days), (VALUES (1, 'fractional_logit', 'skipped'), (2, 'cell_means', 'converged')) v(rung, estimator, outcome)""", "days"))
def e23b(c: Chain) -> DataFrame:
    """Four ladders: one that holds; one whose covariate is a single person's, who is missing from more than a quarter of the resamples; one
    that is separated; and one whose response leaves [0, 1]. Each rung's outcome and the triggers that were fired."""
    from panelwise.plans.estimates import _terms

    d = c.kept("triggers", lambda: _terms(c).select("person_id", "region", "post_day", "one", "day", "fusion", "y", "deficit", "deficit_untruncated", F.lit(1.0).alias("w")))
    lost = d.where("deficit IS NOT NULL")
    usable = lost.groupBy("person_id").agg(F.avg("deficit").alias("m")).where("m > 0 AND m < 1").agg(F.min("person_id").alias("who"))
    lost = lost.join(F.broadcast(usable), F.lit(True)).withColumn("alone", (F.col("person_id") == F.col("who")).cast("double"))
    means = descent.Rung("cell_means", lambda: E.cell_means(d, "region", "post_day", "deficit", "w"))

    def fractional(x: tuple[str, ...]) -> descent.Rung:
        return descent.Rung("fractional_logit", lambda: E.fit_logit(lost, x, "deficit"), ("T1", "T2"), bounded=True)

    def resamples(x: tuple[str, ...]):  # noqa: ANN202
        return lambda _: list(E.fit_logit_each(E.resampled(E.patterns(lost, "person_id", x, "deficit"), "person_id", _B), "b", range(1, _B + 1), x, "y", "w").values())

    found = {}
    for name, x in (("steady", ("one", "day", "fusion")), ("one_person", ("one", "day", "alone"))):
        rungs = [fractional(x), means]
        found[name] = descent.stable_or_below(descent.descend(rungs), rungs, resamples(x))
    itself = descent.Rung("logit_on_itself", lambda: E.fit_logit(d, ("one", "y"), "y"), ("T1",))
    found["separated"] = descent.descend([itself, fractional(("one", "day", "fusion")), means])
    found["unbounded"] = descent.descend([fractional(("one", "day", "fusion")), means], bounded=False)
    rows = [(name, *o, ",".join(f.triggers)) for name, f in found.items() for o in f.outcomes]
    return c.spark.createDataFrame(rows, "ladder string, rung int, estimator string, outcome string, triggers string")
