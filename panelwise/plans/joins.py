"""Joins, windows, sorts, set operations (J, W, K, U) and source reads (IO)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.operators import joins as J
from panelwise.plans.chain import Chain, rounded
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.registry import query
from panelwise.sources import io


@query("io1b_scan_all", "SELECT event_id, user_id FROM events")
def io1b(c: Chain) -> DataFrame:
    """Two columns of every row of events."""
    return io.scan(c.spark, f"{c.sf}/events.parquet", ["event_id", "user_id"])


@query("io3_table_rows", "SELECT 'events' AS \"table\", count(*) AS n_rows FROM events UNION ALL SELECT 'orders', count(*) FROM orders")
def io3(c: Chain) -> DataFrame:
    read = lambda n: c.spark.read.parquet(f"{c.sf}/{n}.parquet")
    return io.table_rows({"events": read("events"), "orders": read("orders"), "nation": read("nation")}, "^(events|orders)$")


@query("io5b_resolve_all", "SELECT user_id AS person, ts AS at FROM events")
def io5b(c: Chain) -> DataFrame:
    """The roles of every row of events."""
    return io.resolve_roles(c.spark.read.parquet(f"{c.sf}/events.parquet"), {"person": ("person_id", "user_id"), "at": ("time(stamp)?", "ts")})


@query("io14_stamp", sql("SELECT episode_id, (SELECT max(procedure_date) FROM records) AS source_cutoff FROM episodes", "episodes"))
def io14(c: Chain) -> DataFrame:
    return io.stamped(c.episodes.select("episode_id"), c.records, "procedure_date").drop("built_at")


@query("j01_equi_join", sql("SELECT person_id, code, region FROM records JOIN codes USING (code)", "records", "codes"))
def j01(c: Chain) -> DataFrame:
    return c.records.join(c.codes, "code").select("person_id", "code", "region")


@query("j02_left_chain", sql("SELECT e.episode_id, d.death_date, o.observation_period_end_date, p.sex FROM episodes e LEFT JOIN deaths d USING (person_id) LEFT JOIN observation o USING (person_id) LEFT JOIN persons p USING (person_id)", "episodes", "deaths", "persons"))
def j02(c: Chain) -> DataFrame:
    e = c.episodes.join(c.deaths, "person_id", "left").join(c.observation, "person_id", "left").join(c.persons, "person_id", "left")
    return e.select("episode_id", "death_date", "observation_period_end_date", "sex")


_J3 = sql("SELECT e.episode_id, k.condition_id, k.condition_start_date - e.index_date AS rel_day FROM episodes e JOIN conditions k ON k.person_id = e.person_id AND k.condition_start_date BETWEEN e.index_date - 5 AND e.index_date + 2", "episodes", "conditions")


@query("j03_window_join", _J3)
def j03(c: Chain) -> DataFrame:
    return J.window_join(c.episodes.select("episode_id", "person_id", "index_date"), c.conditions, "person_id", "index_date", "condition_start_date", -5, 2).select("episode_id", "condition_id", "rel_day")


@query("j03b_window_join_by_bucket", _J3)
def j03b(c: Chain) -> DataFrame:
    return J.by_bucket(c.episodes.select("episode_id", "person_id", "index_date"), c.conditions, "person_id", "index_date", "condition_start_date", -5, 2).select("episode_id", "condition_id", "rel_day")


@query("j04_contained", sql("SELECT k.condition_id, v.visit_occurrence_id FROM conditions k JOIN visits v ON v.person_id = k.person_id AND k.condition_start_date BETWEEN v.visit_start_date AND coalesce(v.visit_end_date, v.visit_start_date)", "conditions", "visits"))
def j04(c: Chain) -> DataFrame:
    return J.contained_join(c.conditions, c.visits, "person_id", "condition_start_date", "visit_start_date", "visit_end_date").select("condition_id", "visit_occurrence_id")


@query("j05_nearest_before", sql("SELECT episode_id, value_as_number, measurement_date FROM (SELECT e.episode_id, m.value_as_number, m.measurement_date, row_number() OVER (PARTITION BY e.episode_id ORDER BY m.measurement_date DESC, m.measurement_id DESC) AS rn FROM episodes e JOIN measurements m ON m.person_id = e.person_id AND m.measurement_date BETWEEN e.index_date - 365 AND e.index_date WHERE m.value_as_number BETWEEN 10 AND 80) WHERE rn = 1", "episodes", "measurements"))
def j05(c: Chain) -> DataFrame:
    m = c.measurements.where("value_as_number BETWEEN 10 AND 80")
    return J.nearest_before(c.episodes.select("episode_id", "person_id", "index_date"), m, "person_id", "episode_id", "index_date", "measurement_date", "value_as_number", 365, "measurement_id")


@query("j06_neighbours", sql("SELECT e.episode_id, coalesce(bool_or(o.index_date BETWEEN e.index_date - 3 AND e.index_date - 1), FALSE) AS has_prior, min(CASE WHEN o.index_date > coalesce(e.discharge_date, e.index_date) THEN o.index_date END) AS next_date FROM episodes e LEFT JOIN episodes o ON o.person_id = e.person_id AND o.index_date <> e.index_date GROUP BY e.episode_id", "episodes"))
def j06(c: Chain) -> DataFrame:
    return J.neighbours(c.episodes, "person_id", "episode_id", "index_date", "discharge_date", 3)


@query("j08_panel_offset", sql("SELECT episode_id, post_day, n_valid FROM lm", "lm"))
def j08(c: Chain) -> DataFrame:
    a, b = c.panel.select("person_id", "episode_id", "post_day"), c.panel.select(F.col("person_id").alias("_p"), F.col("episode_id").alias("_e"), F.col("post_day").alias("_d"), (F.col("valid_wear") & F.col("steps").isNotNull()).alias("_ok"))
    j = a.join(b, (F.col("person_id") == F.col("_p")) & (F.col("episode_id") == F.col("_e")) & F.col("_d").between(F.col("post_day") - 5, F.col("post_day") - 3), "left")
    return j.groupBy("person_id", "episode_id", "post_day").agg(F.count_if("_ok").alias("n_valid")).drop("person_id")


@query("j10_semi_within", sql("SELECT condition_id FROM conditions k WHERE EXISTS (SELECT 1 FROM visits v WHERE v.person_id = k.person_id AND v.visit_kind = 'inpatient' AND k.condition_start_date BETWEEN v.visit_start_date AND coalesce(v.visit_end_date, v.visit_start_date))", "conditions", "visits"))
def j10(c: Chain) -> DataFrame:
    return J.having_within(c.conditions, c.visits.where("visit_kind = 'inpatient'"), "person_id", "condition_start_date", "visit_start_date", "visit_end_date").select("condition_id")


@query("j11_orphans", sql("SELECT DISTINCT d.person_id FROM devices d WHERE d.person_id NOT IN (SELECT person_id FROM episodes WHERE is_fusion)", "devices", "episodes"))
def j11(c: Chain) -> DataFrame:
    return J.orphans(c.devices.select("person_id").distinct(), c.episodes.where("is_fusion"), ["person_id"])


@query("j12_reconcile", sql("SELECT metric, n FROM (SELECT count_if(b.person_id IS NULL) AS only_a, count_if(a.person_id IS NULL) AS only_b, count_if(a.person_id IS NOT NULL AND b.person_id IS NOT NULL AND a.wear_minutes IS DISTINCT FROM b.wear_minutes) AS differs_wear_minutes FROM (SELECT person_id, date, wear_minutes FROM minutes) a FULL JOIN (SELECT person_id, activity_date AS date, CASE WHEN wear_minutes % 5 = 0 THEN 0 ELSE wear_minutes END AS wear_minutes FROM grid WHERE steps IS NOT NULL) b USING (person_id, date)) UNPIVOT (n FOR metric IN (only_a, only_b, differs_wear_minutes))", "grid"))
def j12(c: Chain) -> DataFrame:
    b = c.grid.where("steps IS NOT NULL").select("person_id", F.col("activity_date").alias("date"), F.when(F.col("wear_minutes") % 5 == 0, 0).otherwise(F.col("wear_minutes")).alias("wear_minutes"))
    return J.reconcile(c.minutes.select("person_id", "date", "wear_minutes"), b, ["person_id", "date"], ["wear_minutes"])


@query("j13_in_list", sql("SELECT episode_id, coalesce(list_contains(visit_ids, index_visit_id), FALSE) AS linked FROM episodes", "episodes"))
def j13(c: Chain) -> DataFrame:
    return c.episodes.select("episode_id", J.in_list(F.col("index_visit_id"), F.col("visit_ids")).alias("linked"))


@query("w01_dedupe", sql("SELECT person_id, condition_start_date, condition_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id, condition_start_date ORDER BY category = 'trauma' DESC NULLS LAST, condition_id) AS rn FROM conditions) WHERE rn = 1", "conditions"))
def w01(c: Chain) -> DataFrame:
    order = [(F.col("category") == "trauma").desc_nulls_last(), F.col("condition_id").asc()]
    return J.latest_first(c.conditions, ["person_id", "condition_start_date"], order).select("person_id", "condition_start_date", "condition_id")


@query("w02_mode", sql("SELECT person_id, zone, n FROM (SELECT person_id, zone, count(*) AS n, row_number() OVER (PARTITION BY person_id ORDER BY count(*) DESC, max(date) DESC, zone) AS rn FROM zones GROUP BY person_id, zone) WHERE rn = 1", "zones"))
def w02(c: Chain) -> DataFrame:
    n = c.zones.groupBy("person_id", "zone").agg(F.count(F.lit(1)).alias("n"), F.max("date").alias("last"))
    return J.latest_first(n, ["person_id"], [F.desc("n"), F.desc("last"), F.asc("zone")]).drop("last")


@query("w03_sequence", sql("SELECT episode_id, episode_seq, episode_seq = 1 AS is_first FROM episodes", "episodes"))
def w03(c: Chain) -> DataFrame:
    return c.episodes.select("episode_id", "episode_seq", (F.col("episode_seq") == 1).alias("is_first"))


_RUN = "PARTITION BY person_id ORDER BY index_date"


@query("w04_w07_running", sql(f"SELECT episode_id, count_if(is_fusion) OVER ({_RUN} ROWS UNBOUNDED PRECEDING) AS so_far, coalesce(CAST(sum(n_records) OVER ({_RUN} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before, index_date - lag(index_date) OVER ({_RUN}) AS gap FROM episodes", "episodes"))
def w04(c: Chain) -> DataFrame:
    w = Window.partitionBy("person_id").orderBy("index_date")
    return c.episodes.select("episode_id", F.count_if("is_fusion").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("so_far"),
                             F.coalesce(F.sum("n_records").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.datediff("index_date", F.lag("index_date").over(w)).alias("gap"))


@query("w06_lagged_mean", sql("SELECT person_id, activity_date, round(avg(CAST(valid_wear AS INTEGER)) OVER (PARTITION BY person_id ORDER BY activity_date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS lagged FROM grid", "grid"))
def w06(c: Chain) -> DataFrame:
    w = Window.partitionBy("person_id").orderBy("activity_date").rowsBetween(-7, -1)
    return c.grid.select("person_id", "activity_date", F.round(F.avg(F.col("valid_wear").cast("int")).over(w), 6).alias("lagged"))


@query("w08_surrogate_keys", sql("SELECT dense_rank() OVER (ORDER BY person_id) AS person_index, episode_id FROM episodes", "episodes"))
def w08(c: Chain) -> DataFrame:
    from panelwise.operators.groups import with_surrogate

    return with_surrogate(c.episodes.select("person_id", "episode_id"), "person_id", "person_index").select("person_index", "episode_id")


@query("w09_capped_sample", sql("SELECT condition_id FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY f) AS r2 FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY f) AS r1 FROM (SELECT *, md5(concat_ws('|', 's', condition_id)) AS f FROM conditions)) WHERE r1 <= 5) WHERE r2 <= 3", "conditions"))
def w09(c: Chain) -> DataFrame:
    f = c.conditions.withColumn("f", F.md5(F.concat_ws("|", F.lit("s"), F.col("condition_id").cast("string"))))
    return J.latest_first(J.latest_first(f, ["code"], [F.asc("f")], 5), ["person_id"], [F.asc("f")], 3).select("condition_id")


@query("w10_average_rank", sql("SELECT episode_id, rank() OVER (PARTITION BY region ORDER BY los_days NULLS FIRST) + (count(*) OVER (PARTITION BY region, los_days) - 1) / 2 AS mean_rank FROM episodes", "episodes"))
def w10(c: Chain) -> DataFrame:
    from panelwise.operators.running import running_sums

    ties = c.episodes.groupBy("region", "los_days").agg(F.count(F.lit(1)).alias("n"))
    upto = running_sums(ties, ["region"], [F.col("los_days").asc_nulls_first()], {"upto": F.col("n")})
    mean = upto.select(F.col("region").alias("_region"), F.col("los_days").alias("_los"), (F.col("upto") - F.col("n") + (F.col("n") + 1) / 2).alias("mean_rank"))
    return c.episodes.join(mean, F.col("region").eqNullSafe(F.col("_region")) & F.col("los_days").eqNullSafe(F.col("_los"))).select("episode_id", "mean_rank")


@query("w11_precision_at_rank", sql("SELECT episode_id, CAST(sum(CAST(is_fusion AS INTEGER)) OVER w AS BIGINT) AS hits, round(sum(CAST(is_fusion AS INTEGER)) OVER w / row_number() OVER w, 6) AS prec FROM episodes WINDOW w AS (PARTITION BY region ORDER BY n_records DESC, episode_id ROWS UNBOUNDED PRECEDING)", "episodes"))
def w11(c: Chain) -> DataFrame:
    from panelwise.operators.running import running_sums

    d = running_sums(c.episodes.select("episode_id", "region", "n_records", "is_fusion"), ["region"], [F.desc("n_records"), F.asc("episode_id")], {"hits": F.col("is_fusion").cast("int"), "place": F.lit(1)})
    return d.select("episode_id", "hits", F.round(F.col("hits") / F.col("place"), 6).alias("prec"))


@query("w12_gaps_and_islands", sql("SELECT person_id, segment, min(date) AS first_day, max(date) AS last_day, count(*) AS n FROM (SELECT person_id, date, sum(jump) OVER (PARTITION BY person_id ORDER BY date) AS segment FROM (SELECT person_id, date, CASE WHEN date - lag(date) OVER (PARTITION BY person_id ORDER BY date) = 1 THEN 0 ELSE 1 END AS jump FROM activity)) GROUP BY ALL", "activity"))
def w12(c: Chain) -> DataFrame:
    w = Window.partitionBy("person_id").orderBy("date")
    jump = F.when(F.datediff("date", F.lag("date").over(w)) == 1, 0).otherwise(1)
    seg = c.activity.withColumn("jump", jump).withColumn("segment", F.sum("jump").over(w))
    return seg.groupBy("person_id", "segment").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).alias("n"))


@query("k2_top_n", sql("SELECT code, count(*) AS n FROM conditions GROUP BY code ORDER BY n DESC, code LIMIT 10", "conditions"))
def k2(c: Chain) -> DataFrame:
    return c.conditions.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(10)


@query("u1_union_all", sql("SELECT 'condition' AS kind, person_id FROM conditions UNION ALL SELECT 'visit', person_id FROM visits", "conditions", "visits"))
def u1(c: Chain) -> DataFrame:
    return c.conditions.select(F.lit("condition").alias("kind"), "person_id").unionByName(c.visits.select(F.lit("visit").alias("kind"), "person_id"))


@query("u2_union_distinct", sql("SELECT person_id, condition_start_date AS day FROM conditions UNION SELECT person_id, visit_start_date FROM visits", "conditions", "visits"))
def u2(c: Chain) -> DataFrame:
    return c.conditions.select("person_id", F.col("condition_start_date").alias("day")).union(c.visits.select("person_id", "visit_start_date")).distinct()


@query("a12_impute", sql("SELECT episode_id, coalesce(los_days, (SELECT median(los_days) FROM episodes)) AS los, los_days IS NULL AS was_missing FROM episodes", "episodes"))
def a12(c: Chain) -> DataFrame:
    m = c.episodes.agg(F.median("los_days").alias("_m"))
    return rounded(c.episodes.join(F.broadcast(m)).select("episode_id", F.coalesce(F.col("los_days").cast("double"), "_m").alias("los"), F.col("los_days").isNull().alias("was_missing")), "los")
