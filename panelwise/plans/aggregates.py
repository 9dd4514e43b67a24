"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.operators import aggregates as A
from panelwise.plans.chain import Chain, rounded
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.registry import query


@query("a01_group", sql("SELECT person_id, count(*) AS n, CAST(sum(minute_in_zone) AS BIGINT) AS total, min(date) AS first, max(date) AS last, round(avg(minute_in_zone), 6) AS mean FROM zones GROUP BY person_id", "zones"))
def a01(c: Chain) -> DataFrame:
    return c.zones.groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.sum("minute_in_zone").alias("total"), F.min("date").alias("first"), F.max("date").alias("last"), F.round(F.avg("minute_in_zone"), 6).alias("mean"))


@query("a02_a04_conditional", sql("SELECT visit_kind, count_if(visit_end_date IS NULL) AS n_open, bool_or(origin = 'Home') AS any_home, bool_and(origin = 'Home') AS all_home, count(DISTINCT CASE WHEN origin = 'Home' THEN person_id END) AS n_home_persons FROM visits GROUP BY visit_kind", "visits"))
def a02(c: Chain) -> DataFrame:
    home = F.col("origin") == "Home"
    return c.visits.groupBy("visit_kind").agg(F.count_if(F.col("visit_end_date").isNull()).alias("n_open"), F.bool_or(home).alias("any_home"), F.every(home).alias("all_home"), F.countDistinct(F.when(home, F.col("person_id"))).alias("n_home_persons"))


@query("a05_a06_quantiles", sql("SELECT zone, median(minute_in_zone) AS med, quantile_cont(minute_in_zone, 0.25) AS q1, quantile_cont(minute_in_zone, 0.75) AS q3, median(CASE WHEN minute_in_zone > 100000 THEN minute_in_zone END) AS none FROM zones GROUP BY zone", "zones"))
def a05(c: Chain) -> DataFrame:
    q = A.quartiles(F.col("minute_in_zone"))
    return c.zones.groupBy("zone").agg(F.median("minute_in_zone").alias("med"), q[0], q[2], F.median(F.when(F.col("minute_in_zone") > 100000, F.col("minute_in_zone"))).alias("none"))


@query("a07_a11_windows", sql("SELECT episode_id, baseline_steps, baseline_steps_early, baseline_steps_late, baseline_span_days FROM baseline", "baseline"))
def a07(c: Chain) -> DataFrame:
    return c.baseline.select("episode_id", "baseline_steps", "baseline_steps_early", "baseline_steps_late", "baseline_span_days")


@query("a08_collect_set", sql("SELECT person_id, array_to_string(list_sort(list(DISTINCT category)), ',') AS categories FROM conditions WHERE category IS NOT NULL GROUP BY person_id", "conditions"))
def a08(c: Chain) -> DataFrame:
    return c.conditions.where("category IS NOT NULL").groupBy("person_id").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"))


@query("a13_having", sql("SELECT person_id, date FROM zones GROUP BY person_id, date HAVING sum(minute_in_zone) BETWEEN 600 AND 1440 AND bool_or(zone = 'view')", "zones"))
def a13(c: Chain) -> DataFrame:
    g = c.zones.groupBy("person_id", "date").agg(F.sum("minute_in_zone").alias("m"), F.bool_or(F.col("zone") == "view").alias("v"))
    return g.where("m BETWEEN 600 AND 1440 AND v").select("person_id", "date")


_W = {"trauma": 4, "malignancy": 3, "spinal_infection": 2, "degenerative": 1}


@query("a14_hierarchical_score", sql("SELECT person_id, CAST(sum(w) AS BIGINT) AS score, count(*) AS n_categories FROM (SELECT DISTINCT k.person_id, k.category, CASE k.category WHEN 'trauma' THEN 4 WHEN 'malignancy' THEN 3 WHEN 'spinal_infection' THEN 2 ELSE 1 END AS w FROM conditions k WHERE k.category IS NOT NULL AND NOT (k.category = 'degenerative' AND EXISTS (SELECT 1 FROM conditions x WHERE x.person_id = k.person_id AND x.category = 'trauma'))) GROUP BY person_id", "conditions"))
def a14(c: Chain) -> DataFrame:
    return A.hierarchical_score(c.conditions, "person_id", "category", _W, {"trauma": "degenerative"})


@query("a15_overlap_groups", sql("SELECT ga AS region, gb AS is_fusion, count(*) AS n FROM (SELECT unnest([region, region, 'all', 'all']) AS ga, unnest([CAST(is_fusion AS VARCHAR), 'all', CAST(is_fusion AS VARCHAR), 'all']) AS gb FROM episodes) GROUP BY ALL", "episodes"))
def a15(c: Chain) -> DataFrame:
    return A.overlap_groups(c.episodes.withColumn("is_fusion", F.col("is_fusion").cast("string")), "region", "is_fusion", [F.count(F.lit(1)).alias("n")])


@query("a16_segment_and_all", sql("SELECT s AS zone, count(*) AS n FROM (SELECT unnest([zone, 'all']) AS s FROM zones) GROUP BY s", "zones"))
def a16(c: Chain) -> DataFrame:
    return A.with_all(c.zones, "zone").groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


@query("a17_distribution", sql("SELECT metric, CAST(value AS DOUBLE) AS value, count(*) AS n FROM (SELECT 'n_zones' AS metric, n_zones AS value FROM minutes UNION ALL SELECT 'largest_zone', largest_zone FROM minutes) GROUP BY ALL", "minutes"))
def a17(c: Chain) -> DataFrame:
    return A.distribution(c.minutes, ["n_zones", "largest_zone"])


@query("a18_pivot", sql("SELECT person_id, count_if(zone = 'view') AS view, count_if(zone = 'click') AS click, count_if(zone = 'error') AS error FROM zones GROUP BY person_id", "zones"))
def a18(c: Chain) -> DataFrame:
    return c.zones.groupBy("person_id").pivot("zone", ["view", "click", "error"]).agg(F.count(F.lit(1))).na.fill(0)


@query("a19_weighted_quantiles", sql("SELECT zone, count(*) AS n, quantile_cont(b, 0.25) AS q1, median(b) AS median, quantile_cont(b, 0.75) AS q3 FROM (SELECT zone, minute_in_zone // 10 * 10 AS b FROM zones) GROUP BY zone", "zones"))
def a19(c: Chain) -> DataFrame:
    hist = c.zones.groupBy("zone", (F.floor(F.col("minute_in_zone") / 10) * 10).alias("b")).agg(F.count(F.lit(1)).alias("w"))
    return A.weighted_quantiles(hist, ["zone"], "b", "w")


@query("a20_weighted_mean", sql("SELECT region, round(sum(CASE WHEN n_valid_baseline_days > 0 THEN baseline_steps * n_valid_baseline_days END) / sum(CASE WHEN n_valid_baseline_days > 0 AND baseline_steps IS NOT NULL THEN n_valid_baseline_days END), 4) AS mean FROM elig GROUP BY region", "elig"))
def a20(c: Chain) -> DataFrame:
    j = c.episodes.join(c.baseline.drop("person_id", "index_date"), "episode_id")
    return j.groupBy("region").agg(F.round(A.weighted_mean(F.col("baseline_steps"), F.col("n_valid_baseline_days")), 4).alias("mean"))


@query("a21_mean_sd", sql("SELECT region, count(los_days) AS n, round(CASE WHEN count(los_days) > 20 THEN avg(los_days) END, 6) AS mean, round(CASE WHEN count(los_days) > 20 THEN stddev_samp(los_days) END, 6) AS sd FROM episodes GROUP BY region", "episodes"))
def a21(c: Chain) -> DataFrame:
    return rounded(c.episodes.groupBy("region").agg(*A.mean_sd(F.col("los_days"))), "mean", "sd")


@query("a22_table_digest", sql("SELECT count(*) AS n, md5(string_agg(k, '~' ORDER BY k)) AS digest FROM (SELECT concat_ws('|', set_id, role, episode_id, day) AS k FROM sets)", "sets"))
def a22(c: Chain) -> DataFrame:
    return A.table_digest(c.sets, ["set_id", "role", "episode_id", "day"])


_H = "CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(person_id AS VARCHAR), ''), coalesce(CAST(activity_date AS VARCHAR), ''), coalesce(CAST(steps AS VARCHAR), ''), coalesce(CAST(wear_minutes AS VARCHAR), ''))), 1, 15) AS BIGINT)"


@query("a22b_big_digest", sql(f'SELECT count(*) AS n, bit_xor({_H}) AS "xor", CAST(sum({_H} % 2147483648) AS BIGINT) AS total FROM grid', "grid"))
def a22b(c: Chain) -> DataFrame:
    return A.big_digest(c.grid, ["person_id", "activity_date", "steps", "wear_minutes"])


_KEY = "md5(concat_ws('|', coalesce(CAST(person_id AS VARCHAR), ''), coalesce(CAST(activity_date AS VARCHAR), ''), coalesce(CAST(steps AS VARCHAR), ''), coalesce(CAST(wear_minutes AS VARCHAR), '')))"
_GRID_COLS = ["person_id", "activity_date", "steps", "wear_minutes"]


@query("a22c_tree_digest", sql(f"WITH leaves AS (SELECT k[:2] AS leaf, count(*) AS n, md5(string_agg(k, '' ORDER BY k)) AS d FROM (SELECT {_KEY} AS k FROM grid) GROUP BY 1), inner_nodes AS (SELECT leaf[:1] AS leaf, sum(n) AS n, md5(string_agg(concat(leaf, ':', d), ',' ORDER BY leaf)) AS d FROM leaves GROUP BY 1) SELECT CAST(sum(n) AS BIGINT) AS n, md5(string_agg(concat(leaf, ':', d), ',' ORDER BY leaf)) AS digest FROM inner_nodes", "grid"))
def a22c(c: Chain) -> DataFrame:
    """The root of a hash tree of two levels over the grid."""
    return A.tree_digest(c.grid, _GRID_COLS, 2)


@query("a22d_changed_rows", sql("SELECT person_id, activity_date, coalesce(steps, -1) + d.k AS steps, 1 - d.k AS n_a, d.k AS n_b FROM grid, (VALUES (0), (1)) d(k) WHERE wear_minutes > 1200", "grid"))
def a22d(c: Chain) -> DataFrame:
    """The rows that differ between the grid and a copy with other steps on very long days, found by their leaves."""
    a = c.grid.select("person_id", "activity_date", F.coalesce("steps", F.lit(-1)).cast("long").alias("steps"), "wear_minutes")
    b = a.withColumn("steps", F.when(F.col("wear_minutes") > 1200, F.col("steps") + 1).otherwise(F.col("steps")))
    return A.changed_rows(a, b, ["person_id", "activity_date", "steps"]).select("person_id", "activity_date", "steps", F.col("n_a").cast("int").alias("n_a"), F.col("n_b").cast("int").alias("n_b"))


@query("a23_evidence_path", sql("SELECT path, count(*) AS n_persons FROM (SELECT person_id, CASE WHEN bool_or(category = 'trauma') THEN 'trauma' WHEN bool_or(category = 'malignancy') THEN 'malignancy' WHEN bool_or(category = 'degenerative') THEN 'degenerative' ELSE 'none' END AS path FROM conditions GROUP BY person_id) GROUP BY path", "conditions"))
def a23(c: Chain) -> DataFrame:
    return A.evidence_path(c.conditions, "person_id", {n: F.col("category") == n for n in ("trauma", "malignancy", "degenerative")})


@query("q20_digests_agree", sql("SELECT n AS n_a, n AS n_b, d = e AS equal FROM (SELECT count(*) AS n, bit_xor(hash(set_id, role, episode_id)) AS d FROM sets), (SELECT bit_xor(hash(set_id, role, episode_id)) AS e FROM (SELECT * FROM sets ORDER BY episode_id DESC))", "sets"))
def q20(c: Chain) -> DataFrame:
    """Membership of the sets, digested as built and in another order and partitioning."""
    cols = ["set_id", "role", "episode_id"]
    return A.digests_agree(A.big_digest(c.sets, cols), A.big_digest(c.sets.orderBy(F.desc("episode_id")), cols))
