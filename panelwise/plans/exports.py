"""Exhibits, export checks and sinks (DC, IO, Q32): what leaves, and what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwise.functions import disclosure as K
from panelwise.operators import disclosure as D
from panelwise.params import SCALED as P
from panelwise.plans.chain import Chain, rounded
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.registry import query
from panelwise.sources import io
from panelwise.sources.shared import shared_folder


def _folder(c: Chain, name: str) -> str:
    return f"{shared_folder(c.spark)}/exports-{uuid.uuid4().hex}/{name}"


_VISITS = "(SELECT visit_kind, origin, count(*) AS n FROM visits GROUP BY ALL)"
_R = lambda n: f"CASE WHEN {n} = 0 THEN 0 WHEN {n} > 20 THEN ({n} + 10) // 20 * 20 END"


@query("io02_schema_rows", "SELECT CAST(ordinal_position AS INTEGER) AS ordinal, column_name AS \"column\", CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'double' ELSE 'timestamp' END AS kind FROM (SELECT row_number() OVER () AS ordinal_position, column_name, regexp_replace(column_type, ' WITH.*|_.*|\\(.*', '') AS data_type FROM (DESCRIBE SELECT * FROM events))")
def io02(c: Chain) -> DataFrame:
    rows = io.schema_rows(c.spark.read.parquet(f"{c.sf}/events.parquet"))
    return rows.select("ordinal", "column", F.regexp_replace("type", "_.*|\\(.*", "").alias("kind"))


@query("io04_required_columns", "SELECT name AS \"column\", name IN (SELECT column_name FROM (DESCRIBE SELECT * FROM events)) AS present FROM (VALUES ('event_id'), ('user_id'), ('ts'), ('zone_minutes')) v(name)")
def io04(c: Chain) -> DataFrame:
    """Which of some columns a build would refuse to begin without."""
    df = c.spark.read.parquet(f"{c.sf}/events.parquet")
    found = []
    for name in ("event_id", "user_id", "ts", "zone_minutes"):
        try:
            io.require_columns(df, [name])
            found.append((name, True))
        except ValueError:
            found.append((name, False))
    return c.spark.createDataFrame(found, "column string, present boolean")


@query("io07_clustered", sql("SELECT person_id, count(*) AS n, CAST(sum(steps) AS BIGINT) AS steps FROM activity GROUP BY person_id", "activity"))
def io07(c: Chain) -> DataFrame:
    """A table written clustered by person, read back and summed."""
    io.write_clustered(c.activity, path := _folder(c, "clustered"), "person_id")
    return c.spark.read.parquet(path).groupBy("person_id").agg(F.count(F.lit(1)).alias("n"), F.sum("steps").alias("steps"))


@query("io08_by_month", sql("SELECT strftime(activity_date, '%Y-%m') AS month, count(*) AS n, count(DISTINCT person_id) AS n_persons FROM grid GROUP BY ALL", "grid"))
def io08(c: Chain) -> DataFrame:
    io.write_by_month(c.grid.select("person_id", "activity_date"), path := _folder(c, "months"), "activity_date")
    return c.spark.read.parquet(path).groupBy(F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("person_id").alias("n_persons"))


@query("io09_bucket_range", sql("SELECT post_day, count(*) AS n FROM panel WHERE post_day BETWEEN 3 AND 11 GROUP BY post_day", "panel"))
def io09(c: Chain) -> DataFrame:
    """Panel days 3 to 11 from a table in buckets of five days: other buckets are not read."""
    io.write_by_bucket(c.panel.select("episode_id", "post_day"), path := _folder(c, "buckets"), "post_day")
    return io.read_bucket(c.spark, path, "post_day", 3, 11).groupBy("post_day").agg(F.count(F.lit(1)).alias("n"))


@query("io10_restarted_build", sql("SELECT region, count(*) AS n FROM features GROUP BY region", "features"))
def io10(c: Chain) -> DataFrame:
    """A build of three tables that is started again at its last one."""
    stages = {"cohort": lambda _: c.features, "by_region": lambda t: t["cohort"].groupBy("region").agg(F.count(F.lit(1)).alias("n")), "named": lambda t: t["by_region"].where("region IS NOT NULL")}
    io.build_tables(c.spark, stages, folder := _folder(c, "build"))
    return io.build_tables(c.spark, stages, folder, "named")["named"]


@query("io11_gated_csv", sql(f"SELECT visit_kind, origin, CAST({_R('n')} AS VARCHAR) AS n, CASE WHEN {_R('n')} IS NULL THEN 'suppressed' END AS n_reason FROM {_VISITS}", "visits"))
def io11(c: Chain) -> DataFrame:
    """An aggregate that passes every refusal rule, written as CSV and read back as text."""
    cells = D.suppress_frame(c.visits.groupBy("visit_kind", "origin").agg(F.count(F.lit(1)).alias("n")), ["n"])
    io.gated_export(cells, path := _folder(c, "cells"), counts=["n"], texts=["origin"])
    return c.spark.read.option("header", True).csv(path)


@query("io13_json_results", sql("SELECT region, count(los_days) AS n, round(avg(los_days), 6) AS mean FROM episodes GROUP BY region HAVING count(los_days) > 20", "episodes"))
def io13(c: Chain) -> DataFrame:
    """Results written as JSON rows and read back; groups on the floor or below stay behind."""
    d = c.episodes.groupBy("region").agg(F.count("los_days").alias("n"), F.avg("los_days").alias("mean")).where(F.col("n") > K.FLOOR)
    io.json_rows(d).write.text(path := _folder(c, "results"))
    return c.spark.read.schema("region string, n bigint, mean double").json(path)


_DC8 = f"(SELECT visit_kind, origin, CASE WHEN n % 3 = 0 THEN n ELSE {_R('n')} END AS n, CASE WHEN n > 0 THEN 50 END AS pct FROM {_VISITS})"


@query("dc08b_all_refusals", sql(f"SELECT * FROM (SELECT '1_extension' AS class, 'cells.xlsx' AS \"column\", count(DISTINCT 1) AS n FROM {_DC8} UNION ALL SELECT '2_illegal_count', 'n', count_if(n IS NOT NULL AND n % 20 <> 0) FROM {_DC8} UNION ALL SELECT '3_percent_beside_hidden', 'pct', count_if(pct IS NOT NULL AND n IS NULL) FROM {_DC8} UNION ALL SELECT '4_lone_hidden', 'n', count(*) FROM (SELECT visit_kind FROM {_DC8} GROUP BY visit_kind HAVING count_if(n IS NULL) = 1 AND count_if(n > 0) > 0) UNION ALL SELECT '5_banned_character', 'label', count_if(n IS NULL) FROM {_DC8} UNION ALL SELECT '7_identifier', 'episode_id', count(DISTINCT 1) FROM {_DC8}) WHERE n > 0", "visits"))
def dc08b(c: Chain) -> DataFrame:
    """A table with something wrong in each class, and what the gate finds."""
    n = F.col("n")
    cells = c.visits.groupBy("visit_kind", "origin").agg(F.count(F.lit(1)).alias("n")).withColumns({"pct": F.when(n > 0, 50), "n": F.when(n % 3 == 0, n).otherwise(K.round20(n)), "episode_id": F.lit("x")})
    cells = cells.withColumn("label", F.when(n.isNull(), "<hidden>").otherwise("shown"))
    return D.export_refusals(cells, "cells.xlsx", "table", counts=["n"], percents={"pct": "n"}, partitions={"n": ["visit_kind"]}, texts=["label"])


@query("dc09_guarded_summary", sql("SELECT region, CASE WHEN n = 0 OR n > 20 THEN n END AS safe_n, CASE WHEN n > 20 THEN format('{:.1f} ({:.1f})', round(m, 1), round(s, 1)) ELSE 'suppressed' END AS mean_sd, CASE WHEN n > 20 THEN format('{:.1f} [{:.1f}, {:.1f}]', round(q[2], 1), round(q[1], 1), round(q[3], 1)) ELSE 'suppressed' END AS median_iqr FROM (SELECT region, count(los_days) AS n, avg(los_days) AS m, stddev_samp(los_days) AS s, quantile_cont(los_days, [0.25, 0.5, 0.75]) AS q FROM episodes GROUP BY region)", "episodes"))
def dc09(c: Chain) -> DataFrame:
    """Count, mean with deviation and median with quartiles as they may be shown: none on the floor or below."""
    q = F.percentile("los_days", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = c.episodes.groupBy("region").agg(F.count("los_days").alias("n"), F.avg("los_days").alias("m"), F.stddev_samp("los_days").alias("s"), q.alias("q"))
    one = lambda x: F.format_number(F.round(x, 1), 1)
    show = lambda text: F.when(F.col("n") > K.FLOOR, text).otherwise(K.HIDDEN)
    return d.select("region", F.when(K.disclosable(F.col("n")), F.col("n")).alias("safe_n"), show(F.concat(one(F.col("m")), F.lit(" ("), one(F.col("s")), F.lit(")"))).alias("mean_sd"),
                    show(F.concat(one(F.col("q")[1]), F.lit(" ["), one(F.col("q")[0]), F.lit(", "), one(F.col("q")[2]), F.lit("]"))).alias("median_iqr"))


_NODES = "SELECT unnest([concat(region, '.n'), concat(region, '.share'), concat(region, '.median')]) AS path, unnest(['count', 'percentage', 'quantile']) AS kind, unnest([CAST(n AS DOUBLE), 100.0 * n / t, med]) AS v, n FROM (SELECT region, count(*) AS n, sum(count(*)) OVER () AS t, CAST(median(n_records) AS DOUBLE) AS med FROM episodes GROUP BY region)"
_SHOWN = f"SELECT path, kind, CASE WHEN n = 0 OR n > 20 THEN CASE kind WHEN 'count' THEN {_R('n')} WHEN 'percentage' THEN round(v) ELSE round(v, 3) END END AS value, n BETWEEN 1 AND 20 AS suppressed FROM ({_NODES})"


def _nodes(c: Chain) -> DataFrame:
    d = c.episodes.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.median("n_records").alias("med"))
    d = d.join(F.broadcast(d.agg(F.sum("n").alias("t"))))
    long = F.explode(F.array(*[F.struct(F.concat("region", F.lit(s)).alias("path"), F.lit(k).alias("kind"), v.cast("double").alias("v")) for s, k, v in ((".n", "count", F.col("n")), (".share", "percentage", 100.0 * F.col("n") / F.col("t")), (".median", "quantile", F.col("med")))])).alias("x")
    return D.nodes(d.select("n", long), F.col("x.path"), F.col("x.kind"), F.col("x.v"), F.col("n"))


@query("dc11b_nodes", sql(f"SELECT path, kind, CAST(value AS DOUBLE) AS value, suppressed FROM ({_SHOWN})", "episodes"))
def dc11b(c: Chain) -> DataFrame:
    return _nodes(c).select("path", "kind", "value", "suppressed")


@query("dc11c_suppression_log", sql(f"SELECT kind, CASE WHEN suppressed THEN 'suppressed' ELSE 'shown' END AS reason, count(*) AS n FROM ({_SHOWN}) GROUP BY ALL", "episodes"))
def dc11c(c: Chain) -> DataFrame:
    return D.suppression_log(_nodes(c))


@query("dc12_daily_curve", sql(f"SELECT is_fusion, post_day, n, mean, CASE WHEN mean IS NOT NULL THEN sum(jump) OVER (PARTITION BY is_fusion ORDER BY post_day) END AS segment FROM (SELECT *, CASE WHEN mean IS NULL THEN 0 WHEN lag(mean) OVER (PARTITION BY is_fusion ORDER BY post_day) IS NULL THEN 1 ELSE 0 END AS jump FROM (SELECT is_fusion, post_day, {_R('k')} AS n, CASE WHEN k > 20 THEN round(m, 3) END AS mean FROM (SELECT f.is_fusion, post_day, count(deficit) AS k, avg(deficit) AS m FROM panel p JOIN features f ON f.episode_id = p.episode_id GROUP BY ALL)))", "panel", "features"))
def dc12(c: Chain) -> DataFrame:
    """The daily curve of the mean deficit by group: every day of the grid, hidden points as gaps."""
    grid = c.spark.range(1, P.panel_days + 1).select(F.col("id").cast("int").alias("post_day")).join(c.features.select("is_fusion").distinct())
    found = c.panel.join(c.features.select("episode_id", "is_fusion"), "episode_id").groupBy("is_fusion", "post_day").agg(F.count("deficit").alias("k"), F.avg("deficit").alias("m"))
    d = grid.join(found, ["is_fusion", "post_day"], "left").select("is_fusion", "post_day", K.round20(F.coalesce("k", F.lit(0))).alias("n"), F.when(F.col("k") > K.FLOOR, F.round("m", 3)).alias("mean"))
    return D.with_gaps(d, "is_fusion", "post_day", "mean")


@query("dc12b_first_table", sql(f"SELECT variable, level, {_R('n')} AS n, CASE WHEN n > 20 AND t > 20 AND (t = n OR t - n > 20) THEN CAST(round(100.0 * n / t) AS BIGINT) END AS pct FROM (SELECT variable, level, count(*) AS n, any_value(t) AS t FROM (SELECT unnest(['sex', 'region', 'class']) AS variable, unnest([sex, region, CASE WHEN is_fusion THEN 'fusion' ELSE 'other' END]) AS level, (SELECT count(*) FROM features) AS t FROM features) GROUP BY ALL)", "features"))
def dc12b(c: Chain) -> DataFrame:
    """The blocks of a first table: each level of each variable, and its share where part and rest may be shown."""
    total = c.features.agg(F.count(F.lit(1)).alias("t"))
    blocks = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), e.alias("level")) for v, e in (("sex", F.col("sex")), ("region", F.col("region")), ("class", F.when(F.col("is_fusion"), "fusion").otherwise("other")))])).alias("x")
    d = c.features.select(blocks).groupBy("x.variable", "x.level").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total))
    ok = (F.col("n") > K.FLOOR) & K.shown_part(F.col("n"), F.col("t"))
    return d.select("variable", "level", K.round20(F.col("n")).alias("n"), F.when(ok, F.round(100.0 * F.col("n") / F.col("t"))).cast("long").alias("pct"))


@query("dc13_bundle_checks", sql(f"SELECT count(*) AS n_rows, count_if(x IS NULL) AS n_hidden, count_if(x % 20 <> 0) AS n_illegal, TRUE AS same_digest FROM (SELECT {_R('n')} AS x FROM {_VISITS})", "visits"))
def dc13(c: Chain) -> DataFrame:
    """A file that was exported, read back: its counts are legal and its digest is that of the table."""
    from panelwise.operators.aggregates import table_digest

    cells = D.suppress_frame(c.visits.groupBy("visit_kind", "origin").agg(F.count(F.lit(1)).alias("n")), ["n"]).drop("n_reason")
    io.gated_export(cells, path := _folder(c, "bundle"), counts=["n"])
    back = c.spark.read.option("header", True).csv(path)
    n = F.col("n").try_cast("long")
    facts = back.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(n.isNull()).alias("n_hidden"), F.count_if(n.isNotNull() & ~K.is_legal_count(n)).alias("n_illegal"))
    one, two = (table_digest(d, ["visit_kind", "origin", "n"]).select(F.col("digest").alias(a)) for d, a in ((back, "x"), (cells, "y")))
    return facts.join(F.broadcast(one)).join(F.broadcast(two)).select("n_rows", "n_hidden", "n_illegal", (F.col("x") == F.col("y")).alias("same_digest"))


def _both_ways() -> str:
    from panelwise.plans.disclosure import _grid_sql

    return f"SELECT visit_kind, origin, hidden, CASE WHEN NOT hidden THEN {_R('n')} END AS shown, {_R('sum(n) OVER (PARTITION BY visit_kind)')} AS total_visit_kind, {_R('sum(n) OVER (PARTITION BY origin)')} AS total_origin, coalesce(sum(n) FILTER (WHERE NOT hidden) OVER (PARTITION BY visit_kind), 0) <= sum(n) OVER (PARTITION BY visit_kind) AS checks_visit_kind, coalesce(sum(n) FILTER (WHERE NOT hidden) OVER (PARTITION BY origin), 0) <= sum(n) OVER (PARTITION BY origin) AS checks_origin FROM ({_grid_sql()})"


@query("dc17b_strata_both_ways", sql(_both_ways(), "visits"))
def dc17b(c: Chain) -> DataFrame:
    return D.strata_both_ways(c.visits, "visit_kind", "origin")


@query("dc19_contract", sql("SELECT \"check\", \"column\", n FROM (SELECT 'spelling' AS \"check\", 'origin' AS \"column\", count_if(origin = 'Home') AS n FROM (SELECT DISTINCT visit_kind, origin FROM visits) UNION ALL SELECT 'undeclared_column', 'n', count(DISTINCT 1) FROM visits UNION ALL SELECT 'missing_column', 'share', count(DISTINCT 1) FROM visits) WHERE n > 0", "visits"))
def dc19(c: Chain) -> DataFrame:
    """A table held against a contract that it breaks in three ways."""
    cells = c.visits.groupBy("visit_kind", "origin").agg(F.count(F.lit(1)).alias("n"))
    return D.contract_problems(cells, ["visit_kind", "origin", "share"], {"origin": ("Ambulatory Clinic", "Emergency Room"), "visit_kind": ("inpatient", "emergency")}, {})


@query("dc21_results", sql(f"SELECT path, CAST(value AS DOUBLE) AS value, suppressed, path IN ('cervical.n', 'lumbar.n') AS required FROM ({_SHOWN}) UNION ALL SELECT concat('events.', event_kind), CAST({_R('n')} AS DOUBLE), n BETWEEN 1 AND 20, FALSE FROM (SELECT event_kind, count(*) AS n FROM ev GROUP BY event_kind)", "episodes", "ev"))
def dc21(c: Chain) -> DataFrame:
    """Results assembled as one long table of nodes, with the required ones marked; a required one that is missing refuses."""
    need = ("cervical.n", "lumbar.n")
    kinds = c.ev.groupBy("event_kind").agg(F.count(F.lit(1)).alias("n"))
    out = _nodes(c).unionByName(D.nodes(kinds, F.concat(F.lit("events."), F.col("event_kind")), F.lit("count"), F.col("n").cast("double"), F.col("n")))
    if out.where(F.col("path").isin(*need)).count() != len(need):
        raise ValueError("a required result is missing")
    return out.select("path", "value", "suppressed", F.col("path").isin(*need).alias("required"))


@query("q32_print_gate", sql(f"SELECT count(*) AS n_rows, count_if(x IS NOT NULL AND x % 20 <> 0) AS n_illegal, count_if(regexp_matches(concat(visit_kind, origin), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}')) AS n_dates, count(DISTINCT (visit_kind, origin)) = count(*) AS keyed_once FROM (SELECT visit_kind, origin, {_R('n')} AS x FROM {_VISITS})", "visits"))
def q32(c: Chain) -> DataFrame:
    """What is checked before a table is printed: legal counts, no dates, each row once."""
    d = D.suppress_frame(c.visits.groupBy("visit_kind", "origin").agg(F.count(F.lit(1)).alias("n")), ["n"])
    return d.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("n").isNotNull() & ~K.is_legal_count(F.col("n"))).alias("n_illegal"), F.count_if(F.concat("visit_kind", "origin").rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}")).alias("n_dates"), (F.countDistinct("visit_kind", "origin") == F.count(F.lit(1))).alias("keyed_once"))


@query("io10b_signed_build", sql("SELECT stage, built_first, built_again, n_rows FROM (SELECT 'cohort' AS stage, TRUE AS built_first, FALSE AS built_again, count(*) AS n_rows FROM features UNION ALL SELECT 'long_stays', TRUE, TRUE, count(*) FROM features WHERE los_days >= 1 UNION ALL SELECT 'by_region', TRUE, TRUE, count(DISTINCT coalesce(region, '')) FROM features WHERE los_days >= 1 UNION ALL SELECT 'by_sex', TRUE, FALSE, count(DISTINCT coalesce(sex, '')) FROM features)", "features"))
def io10b(c: Chain) -> DataFrame:
    """A signed build run twice with another parameter of its second stage: that stage and what reads it are made anew, the rest is read."""
    def stages(least: int) -> dict[str, io.Stage]:
        return {"cohort": io.Stage(lambda _: c.features), "long_stays": io.Stage(lambda t: t["cohort"].where(F.col("los_days") >= least), ("cohort",), {"least": least}),
                "by_region": io.Stage(lambda t: t["long_stays"].groupBy("region").count(), ("long_stays",)), "by_sex": io.Stage(lambda t: t["cohort"].groupBy("sex").count(), ("cohort",))}

    folder = _folder(c, "signed")
    _, first = io.build_signed(c.spark, stages(0), folder, "2024-01-31")
    tables, again = io.build_signed(c.spark, stages(1), folder, "2024-01-31")
    out = None
    for name, t in tables.items():
        one = t.agg(F.lit(name).alias("stage"), F.lit(name in first).alias("built_first"), F.lit(name in again).alias("built_again"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionByName(one)
    return out


_BUNDLE = f"(SELECT 'cells' AS exhibit, count(*) AS n_rows FROM {_VISITS} UNION ALL SELECT 'regions', count(DISTINCT coalesce(region, '')) FROM features UNION ALL SELECT 'kinds', count(DISTINCT event_kind) FROM ev)"


@query("dc13b_bundle_problems", sql(f"SELECT CASE exhibit WHEN 'gone' THEN 'gone' ELSE exhibit END AS exhibit, problem, n_rows FROM (SELECT exhibit, n_rows, CASE exhibit WHEN 'cells' THEN 'damaged' WHEN 'regions' THEN 'extra' ELSE 'recount' END AS problem FROM {_BUNDLE} UNION ALL SELECT 'gone', 0, 'missing')", "visits", "features", "ev"))
def dc13b(c: Chain) -> DataFrame:
    """Three exhibits written with a manifest that is then wrong in four ways, each of which is named."""
    count = lambda d, *by: D.suppress_frame(d.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), ["n"]).drop("n_reason")
    tables = {"cells": count(c.visits, "visit_kind", "origin"), "regions": count(c.features, "region"), "kinds": count(c.ev, "event_kind")}
    counts = dict.fromkeys(tables, "n")
    told = io.write_bundle(tables, counts, folder := _folder(c, "bundle13"))
    exhibit = F.substring_index("file", "/", 1)
    wrong = told.where(exhibit != "regions").withColumns({"md5": F.when(exhibit == "cells", F.md5(F.lit("other"))).otherwise(F.col("md5")), "n_rows": F.when(exhibit == "kinds", F.col("n_rows") + 1).otherwise(F.col("n_rows"))})
    wrong = wrong.unionByName(c.spark.createDataFrame([("gone/part.csv", 1, "x", 0, 0)], told.schema))
    found = io.bundle_problems(c.spark, folder, wrong, counts)
    return found.join(io.file_facts(c.spark, folder, counts), "file", "left").select(exhibit.alias("exhibit"), "problem", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


@query("io13b_json_gate", sql(f"SELECT visit_kind AS doc, concat('$.origins.', replace(origin, ' ', '_')) AS path, 'lone_hidden' AS rule FROM (SELECT *, count_if(n BETWEEN 1 AND 20) OVER w AS h, count_if(n > 20) OVER w AS s FROM {_VISITS} WINDOW w AS (PARTITION BY visit_kind)) WHERE n BETWEEN 1 AND 20 AND h = 1 AND s > 0", "visits"))
def io13b(c: Chain) -> DataFrame:
    """Nested results of each kind of visit, held against the rules at every depth: lone hidden counts are named by their path."""
    cells = c.visits.groupBy("visit_kind", "origin").agg(F.count(F.lit(1)).alias("n"))
    node = F.struct(K.disclosable(F.col("n")).alias("_ok"), F.struct(K.round20(F.col("n")).alias("value"), (~K.disclosable(F.col("n"))).alias("suppressed"), F.lit("count").alias("unit")).alias("v"))
    doc = F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.replace("origin", F.lit(" "), F.lit("_")), F.col("_n.v")))).alias("origins")), {"ignoreNullFields": "false"})
    docs = cells.withColumn("_n", node).groupBy("visit_kind").agg(doc.alias("doc"))  # a few origins a kind
    return io.json_refusals(docs, "visit_kind", "doc")
