"""Disclosure control (DC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions import disclosure as K
from panelwise.operators import disclosure as D
from panelwise.operators.episodes import LADDER
from panelwise.plans.chain import Chain
from panelwise.plans.chain import with_tables as sql
from panelwise.plans.registry import query

_CELLS = "SELECT code, region, count(*) AS n FROM conditions JOIN codes USING (code) GROUP BY ALL"


def _cells(c: Chain) -> DataFrame:
    return c.conditions.join(c.codes, "code").groupBy("code", "region").agg(F.count(F.lit(1)).alias("n"))


_OK = "(n = 0 OR n > 20)"
_R20 = "CASE WHEN n = 0 THEN 0 WHEN n > 20 THEN (n + 10) // 20 * 20 END"


@query("dc01_disclosable", sql(f"SELECT code, n, {_OK} AS ok, {_R20} AS shown, CASE WHEN NOT {_OK} THEN 'suppressed' END AS reason, n % 20 = 0 AS legal FROM ({_CELLS})", "conditions", "codes"))
def dc01(c: Chain) -> DataFrame:
    n = F.col("n")
    return _cells(c).select("code", "n", K.disclosable(n).alias("ok"), K.round20(n).alias("shown"), K.reason(n).alias("reason"), K.is_legal_count(n).alias("legal"))


@query("dc04_n_pct", sql(f"SELECT code, CASE WHEN p IS NULL THEN 'suppressed' ELSE format('{{:,}} ({{}}%)', a, CAST(p AS BIGINT)) END AS cell FROM (SELECT code, a, CASE WHEN b > 0 THEN floor(100 * a / b + 0.5) END AS p FROM (SELECT code, {_R20} AS a, (t + 10) // 20 * 20 AS b FROM (SELECT code, n, sum(n) OVER () AS t FROM ({_CELLS}))))", "conditions", "codes"))
def dc04(c: Chain) -> DataFrame:
    cells = _cells(c)
    total = cells.agg(F.sum("n").alias("t"))
    return cells.join(F.broadcast(total)).select("code", K.n_pct(F.col("n"), F.col("t")).alias("cell"))


@query("dc05_suppress_frame", sql(f"SELECT code, region, {_R20} AS n, CASE WHEN NOT {_OK} THEN 'suppressed' END AS n_reason FROM ({_CELLS})", "conditions", "codes"))
def dc05(c: Chain) -> DataFrame:
    return D.suppress_frame(_cells(c), ["n"])


@query("dc06_fold_small", sql(f"SELECT CASE WHEN {_OK} THEN CAST(code AS VARCHAR) ELSE 'suppressed' END AS code, CAST(sum(CASE WHEN {_OK} THEN (n + 10) // 20 * 20 END) AS BIGINT) AS n, count(*) AS n_labels FROM (SELECT code, count(*) AS n FROM conditions GROUP BY code) GROUP BY 1", "conditions"))
def dc06(c: Chain) -> DataFrame:
    return D.fold_small(c.conditions.select(F.col("code").cast("string").alias("code")), "code")


@query("dc07_complementary", sql(f"SELECT code, region, n, small OR (lone AND rk = 1) AS hidden FROM (SELECT *, sum(CAST(small AS INTEGER)) OVER (PARTITION BY region) = 1 AND count_if(NOT small AND n > 0) OVER (PARTITION BY region) > 0 AS lone, row_number() OVER (PARTITION BY region ORDER BY small OR n = 0, n, code) AS rk FROM (SELECT *, NOT {_OK} AS small FROM ({_CELLS})))", "conditions", "codes"))
def dc07(c: Chain) -> DataFrame:
    return D.complementary(_cells(c), ["region"], "n", ["code"])


def _grid_sql(passes: int = 8) -> str:
    """The passes unrolled: each hides the smallest shown cell of every row, then column, with a lone hidden one."""
    t = "SELECT visit_kind, origin, count(*) AS n, NOT (count(*) = 0 OR count(*) > 20) AS hidden FROM visits GROUP BY ALL"
    for k in range(2 * passes):
        line, other = ("visit_kind", "origin") if k % 2 == 0 else ("origin", "visit_kind")
        t = f"SELECT visit_kind, origin, n, hidden OR (count_if(hidden) OVER w = 1 AND count_if(NOT hidden AND n > 0) OVER w > 0 AND row_number() OVER (PARTITION BY {line} ORDER BY NOT hidden AND n > 0 DESC, n, {other}) = 1) AS hidden FROM ({t}) WINDOW w AS (PARTITION BY {line})"
    return t


@query("dc07b_complementary_grid", sql(_grid_sql(), "visits"))
def dc07b(c: Chain) -> DataFrame:
    cells = c.visits.groupBy("visit_kind", "origin").agg(F.count(F.lit(1)).alias("n"))
    return D.complementary_grid(cells, "visit_kind", "origin", "n")


#: One ladder for each region. A rung's out and the next one's in are one node, v<step of the next rung>; d<step> is what the rung
#: drops. A lone unknown of v(s) = d(s) + v(s + 1) is joined by the smallest shown node, until none is left.
_STEPS = range(3, 3 + len(LADDER))
_LADDERS = f"""WITH RECURSIVE rungs AS MATERIALIZED (SELECT region, s.step, count_if(first_fail_step IS NULL OR first_fail_step = 2 OR first_fail_step >= s.step) AS n_in, count_if(first_fail_step = s.step) AS n_dropped FROM elig, (SELECT unnest({list(_STEPS)}) AS step) s GROUP BY ALL),
nodes AS MATERIALIZED (SELECT region, printf('%04d/in', step) AS node, n_in AS n FROM rungs UNION ALL SELECT region, printf('%04d/out', step), n_in - n_dropped FROM rungs WHERE step = {_STEPS[-1]} UNION ALL SELECT region, printf('%04d/dropped', step), n_dropped FROM rungs),
named AS MATERIALIZED (SELECT region, n, CASE WHEN node LIKE '%/in' AND node[:4] <> '{_STEPS[0]:04d}' THEN printf('%04d/in', CAST(node[:4] AS INTEGER)) ELSE node END AS node FROM nodes),
eqs AS MATERIALIZED (SELECT r.region, r.step, t.node, t.n FROM rungs r JOIN named t ON t.region = r.region AND t.node IN (printf('%04d/in', r.step), printf('%04d/dropped', r.step), CASE WHEN r.step = {_STEPS[-1]} THEN printf('%04d/out', r.step) ELSE printf('%04d/in', r.step + 1) END)),
h AS (SELECT region, 0 AS i, list(node) FILTER (n BETWEEN 1 AND 20) AS hidden FROM named GROUP BY region
 UNION ALL SELECT region, i + 1, list_distinct(hidden || more) FROM (
  SELECT region, i, hidden, list(pick) AS more FROM (
   SELECT h.region, h.i, h.hidden, e.step, arg_min(e.node, (e.n, e.node)) FILTER (NOT list_contains(h.hidden, e.node)) AS pick, count_if(list_contains(h.hidden, e.node)) AS k
   FROM h JOIN eqs e ON e.region = h.region WHERE h.hidden IS NOT NULL GROUP BY h.region, h.i, h.hidden, e.step) WHERE k = 1 AND pick IS NOT NULL GROUP BY region, i, hidden)),
final AS (SELECT region, arg_max(hidden, i) AS hidden FROM h GROUP BY region)
SELECT r.region, r.step, f.field, coalesce(list_contains(x.hidden, CASE f.field WHEN 'dropped' THEN printf('%04d/dropped', r.step) WHEN 'in' THEN printf('%04d/in', r.step) ELSE CASE WHEN r.step = {_STEPS[-1]} THEN printf('%04d/out', r.step) ELSE printf('%04d/in', r.step + 1) END END), FALSE) AS hidden
FROM rungs r, (SELECT unnest(['in', 'dropped', 'out']) AS field) f JOIN final x ON x.region = r.region"""


@query("dc07c_ladders", sql(_LADDERS, "elig"))
def dc07c(c: Chain) -> DataFrame:
    """Which counts of each region's ladder must stay hidden so that none follows from the others."""
    # Out and the next in are one class, named here by its smaller cell; ties go by the in, as the class's name would not.
    rows = c.elig.groupBy("region", F.col("first_fail_step").alias("step")).agg(F.count(F.lit(1)).alias("n"))
    steps = c.spark.createDataFrame([(i,) for i in _STEPS], "step int")
    total = rows.groupBy("region").agg(F.sum("n").alias("_all"))
    w = Window.partitionBy("region").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    ladder = total.join(F.broadcast(steps)).join(rows, ["region", "step"], "left").withColumn("n_dropped", F.coalesce("n", F.lit(0)))
    ladder = ladder.withColumn("n_in", F.col("_all") - F.coalesce(F.sum("n_dropped").over(w), F.lit(0))).withColumn("n_out", F.col("n_in") - F.col("n_dropped"))
    found = D.suppressed_equations(*D.ladder_cells(ladder.select("region", "step", "n_in", "n_dropped", "n_out"), ["region"]), ["region"])
    return found.select("region", F.substring("cell", 1, 4).cast("int").alias("step"), F.substring_index("cell", "/", -1).alias("field"), "hidden")


@query("dc08_export_violations", sql(f"SELECT * FROM (SELECT 'illegal_count' AS rule, 'n' AS \"column\", count_if(n < 0 OR n % 20 <> 0) AS n FROM ({_CELLS}) UNION ALL SELECT 'near_unique', 'label', CASE WHEN count(*) > 20 AND count(DISTINCT code) > 0.9 * count(*) THEN count(DISTINCT code) ELSE 0 END FROM ({_CELLS})) WHERE n > 0", "conditions", "codes"))
def dc08(c: Chain) -> DataFrame:
    return D.export_violations(_cells(c).withColumn("label", F.concat(F.lit("code "), F.col("code").cast("string"))), ["n"], texts=["label"])


@query("dc10_fold_levels", sql("SELECT CASE WHEN count(*) OVER (PARTITION BY category) > 20 AND category IS NOT NULL THEN category ELSE 'other_or_unknown' END AS category, condition_id FROM conditions", "conditions"))
def dc10(c: Chain) -> DataFrame:
    return D.fold_levels(c.conditions.select("condition_id", "category"), "category")


@query("dc11_value_nodes", sql(f"SELECT code, CASE WHEN {_OK} THEN CAST({_R20} AS DOUBLE) END AS value, CASE WHEN {_OK} THEN format('{{:,}}', {_R20}) END AS display, NOT {_OK} AS suppressed, CASE WHEN NOT {_OK} THEN 'small_cell' END AS reason FROM ({_CELLS})", "conditions", "codes"))
def dc11(c: Chain) -> DataFrame:
    n = F.col("n")
    node = K.node(K.round20(n), K.render_count(K.round20(n)), ~K.disclosable(n), F.lit("small_cell"))
    return _cells(c).select("code", node.alias("x")).select("code", "x.*")


@query("dc14_hidden_cells", sql(f"SELECT code, CASE WHEN {_OK} THEN format('{{:,}}', {_R20}) ELSE 'suppressed' END AS cell, NOT {_OK} AS hidden, {_R20} AS parsed FROM ({_CELLS})", "conditions", "codes"))
def dc14(c: Chain) -> DataFrame:
    cell = K.render_count(K.round20(F.col("n")))
    return _cells(c).select("code", cell.alias("cell")).select("code", "cell", K.is_hidden_cell(F.col("cell")).alias("hidden"), K.parsed_count(F.col("cell")).alias("parsed"))


@query("dc16_complement_guard", sql(f"SELECT code, (n = 0 OR n > 20) AND (t = 0 OR t > 20) AND (t - n = 0 OR t - n > 20) AS shown FROM (SELECT code, n, sum(n) OVER (PARTITION BY region) AS t FROM ({_CELLS}))", "conditions", "codes"))
def dc16(c: Chain) -> DataFrame:
    cells = _cells(c)
    totals = cells.groupBy("region").agg(F.sum("n").alias("t"))
    return cells.join(totals, "region").select("code", K.shown_part(F.col("n"), F.col("t")).alias("shown"))


@query("dc17_rendered_strata", sql("SELECT visit_kind, origin, CASE WHEN NOT hidden THEN (n + 10) // 20 * 20 END AS n, hidden FROM (SELECT *, small OR (lone AND rk = 1) AS hidden FROM (SELECT *, sum(CAST(small AS INTEGER)) OVER (PARTITION BY visit_kind) = 1 AND count_if(NOT small AND n > 0) OVER (PARTITION BY visit_kind) > 0 AS lone, row_number() OVER (PARTITION BY visit_kind ORDER BY small OR n = 0, n, origin) AS rk FROM (SELECT visit_kind, origin, count(*) AS n, NOT (count(*) = 0 OR count(*) > 20) AS small FROM visits GROUP BY ALL)))", "visits"))
def dc17(c: Chain) -> DataFrame:
    return D.rendered_strata(c.visits, "visit_kind", "origin")


@query("dc20_registry", sql("SELECT vocabulary, procedure_class, count(*) AS n_codes, count_if(region = 'thoracic') AS n_moved FROM codes WHERE code IN (SELECT code FROM conditions) GROUP BY ALL", "codes", "conditions"))
def dc20(c: Chain) -> DataFrame:
    return c.codes.join(c.conditions, "code", "left_semi").groupBy("vocabulary", "procedure_class").agg(F.count(F.lit(1)).alias("n_codes"), F.count_if(F.col("region") == "thoracic").alias("n_moved"))


@query("io12_manifest", sql(f"SELECT 'cells' AS file, count(*) AS n_rows, count_if({_R20} IS NULL) AS n_hidden, min(CASE WHEN {_R20} > 0 THEN {_R20} END) AS least_count, md5(string_agg(concat_ws(',', CAST(code AS VARCHAR), region, coalesce(CAST({_R20} AS VARCHAR), '')), chr(10) ORDER BY concat_ws(',', CAST(code AS VARCHAR), region, coalesce(CAST({_R20} AS VARCHAR), '')))) AS md5 FROM ({_CELLS})", "conditions", "codes"))
def io12(c: Chain) -> DataFrame:
    from panelwise.sources.io import manifest

    return manifest({"cells": D.suppress_frame(_cells(c), ["n"]).select("code", "region", "n")}, {"cells": "n"})
