"""Suppression of whole tables, export checks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwise.functions.disclosure import FLOOR, HIDDEN, disclosable, is_legal_count, round20
from panelwise.sources.shared import shared_folder, stored


def suppress_frame(table: DataFrame, counts: Sequence[str]) -> DataFrame:
    """Rounded counts and, where one is hidden, its reason."""
    return table.withColumns({c: round20(F.col(c)) for c in counts} | {f"{c}_reason": F.when(~disclosable(F.col(c)), HIDDEN) for c in counts})


def fold_small(rows: DataFrame, label: str, sentinel: str = HIDDEN) -> DataFrame:
    """Counts by label; labels below the floor lose count and name and become one row."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    kept = F.when(disclosable(F.col("_n")), F.col(label)).otherwise(sentinel)
    return n.groupBy(kept.alias(label)).agg(F.when(F.first(disclosable(F.col("_n"))), F.sum(round20(F.col("_n")))).alias("n"), F.count(F.lit(1)).alias("n_labels"))


def complementary(table: DataFrame, partition: Sequence[str], count: str, order: Sequence[str]) -> DataFrame:
    """Adds ``hidden``: counts below the floor, and the smallest shown member (not 0) of a partition with
    a lone hidden one. On ties the first by ``order``."""
    w = Window.partitionBy(*partition)
    t = table.withColumn("_h", ~disclosable(F.col(count)))
    rank = F.row_number().over(w.orderBy((F.col("_h") | (F.col(count) == 0)).asc(), F.col(count).asc(), *[F.col(c).asc() for c in order]))
    lone = (F.sum(F.col("_h").cast("int")).over(w) == 1) & (F.count_if(~F.col("_h") & (F.col(count) > 0)).over(w) > 0)
    return t.withColumn("_r", rank).withColumn("hidden", F.col("_h") | (lone & (F.col("_r") == 1))).drop("_h", "_r")


def complementary_grid(table: DataFrame, row: str, col: str, count: str) -> DataFrame:
    """Hide cells of a table with margins until no row or column has a lone hidden member.

    Every pass hides one more cell of each such line, so it ends within the number of cells. Each pass's
    result is written to the shared folder and read back, so a table of any size keeps a short plan.
    """
    spark = table.sparkSession
    t = table.withColumn("hidden", ~disclosable(F.col(count)))
    while True:
        for line, other in ((row, col), (col, row)):
            w = Window.partitionBy(line)
            shown = ~F.col("hidden") & (F.col(count) > 0)
            rank = F.row_number().over(w.orderBy(shown.desc(), F.col(count).asc(), F.col(other).asc()))
            lone = (F.sum(F.col("hidden").cast("int")).over(w) == 1) & (F.count_if(shown).over(w) > 0)
            t = t.withColumn("_new", F.col("hidden") | (lone & (rank == 1))).withColumn("hidden", F.col("_new")).drop("_new")
        path = f"{shared_folder(spark)}/grid-{uuid.uuid4().hex}"
        t.write.parquet(path)
        before = spark.read.schema(t.schema).parquet(path)
        lines = [before.groupBy(x).agg(F.count_if("hidden").alias("h"), F.count_if(~F.col("hidden") & (F.col(count) > 0)).alias("s")).where("h = 1 AND s > 0") for x in (row, col)]
        t = before
        if not any(x.limit(1).count() for x in lines):
            return t


def equal_classes(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by.., node, class`` for the nodes of ``pairs`` (by.., a, b): nodes that a chain of pairs joins share the class of the
    smallest of them. Labels take the least of their neighbours' and jump to their label's own, so chains halve."""
    by = list(by)
    both = stored(pairs.select(*by, "a", "b").unionByName(pairs.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "pairs")
    labels = both.select(*by, F.col("a").alias("node")).distinct().withColumn("class", F.col("node"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), [*by, "b"]).groupBy(*by, F.col("a").alias("node")).agg(F.min("class").alias("_near"))
        of = labels.select(*by, F.col("node").alias("class"), F.col("class").alias("_own"))
        new = labels.join(near, [*by, "node"]).join(of, [*by, "class"]).select(*by, "node", F.least("_near", "_own", "class").alias("_new"), "class")
        new = stored(new, "classes")
        labels = new.select(*by, "node", F.col("_new").alias("class"))
        if new.where("_new < class").isEmpty():
            return labels


def suppressed_equations(cells: DataFrame, terms: DataFrame, equal: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``cells`` (by.., cell, n) with ``class`` and ``hidden``: counts below the floor and what must be hidden with them so that no
    hidden count follows from the shown ones.

    ``equal`` (by.., a, b) names cells that hold the same count; they are hidden together. ``terms`` (by.., equation,
    cell) names the cells of each equation, whose signed sum is 0: an equation with a lone unknown class would
    give it away, so its smallest shown class (ties: the first) is hidden as well, and so on to a fixpoint. This is
    enough where the equations form a forest over the unknowns, as a ladder's do (each count stands in two at
    most). Null counts are hidden. Every pass hides a class in each such equation, so passes are at most the
    classes of the longest chain; all work is on small tables and each pass is stored.
    """
    by = list(by)
    classes = equal_classes(equal, by)
    c = cells.join(classes.withColumnRenamed("node", "cell"), [*by, "cell"], "left").withColumn("class", F.coalesce("class", "cell"))
    c = stored(c, "cells")
    of_class = c.groupBy(*by, "class").agg(F.max("n").alias("n"), F.bool_or(~F.coalesce(disclosable(F.col("n")), F.lit(False))).alias("hidden"))
    # A class that stands twice in an equation (in = dropped + out with in and out alike) cancels or is known by its twin:
    # it is one unknown there.
    inside = stored(terms.join(c.select(*by, "cell", "class"), [*by, "cell"]).select(*by, "equation", "class").distinct(), "terms")
    state = stored(of_class, "state")
    while True:
        w = Window.partitionBy(*by, "equation")
        seen = inside.join(state, [*by, "class"]).withColumns({
            "_unknown": F.sum(F.col("hidden").cast("int")).over(w), "_all": F.count(F.lit(1)).over(w),
            "_place": F.row_number().over(w.orderBy(F.col("hidden").asc(), F.col("n").asc(), F.col("class").asc()))})
        more = seen.where("_unknown = 1 AND _all > 1 AND _place = 1").select(*by, "class").distinct().withColumn("_more", F.lit(True))
        new = stored(state.join(more, [*by, "class"], "left").select(*by, "class", "n", (F.col("hidden") | F.col("_more").isNotNull()).alias("hidden"), F.col("_more").isNotNull().alias("_more")), "state")
        state = new.drop("_more")
        if new.where("_more").isEmpty():
            return c.join(state.select(*by, "class", "hidden"), [*by, "class"]).select(*by, "cell", "n", "class", "hidden")


def ladder_cells(ladder: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells, equations and equalities of ladders with columns ``by.., step, n_in, n_dropped, n_out``: in = dropped + out in every
    rung, and a rung's out is the next one's in."""
    by = list(by)
    step = F.lpad(F.col("step").cast("string"), 4, "0")
    name = lambda f: F.concat(step, F.lit(f"/{f}"))
    cells = ladder.select(*by, F.explode(F.array(*[F.struct(name(f).alias("cell"), F.col(f"n_{f}").alias("n")) for f in ("in", "dropped", "out")])).alias("c")).select(*by, "c.cell", "c.n")
    terms = ladder.select(*by, step.alias("equation"), F.explode(F.array(*map(name, ("in", "dropped", "out")))).alias("cell"))
    after = F.lead(name("in")).over(Window.partitionBy(*by).orderBy("step"))
    return cells, terms, ladder.select(*by, name("out").alias("a"), after.alias("b")).where("b IS NOT NULL")


def rendered_strata(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Exact margins first, then complementary suppression inside each row of ``a``, then rounding."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    hidden = complementary(cells, [a], "n", [b])
    return hidden.select(a, b, F.when(~F.col("hidden"), round20(F.col("n"))).alias("n"), "hidden")


def export_violations(table: DataFrame, counts: Sequence[str] = (), percents: dict[str, str] | None = None, texts: Sequence[str] = (), banned: str = r"[<>\x00-\x08]", dates: str = r"[0-9]{4}-[0-9]{2}-[0-9]{2}") -> DataFrame:
    """Refusal rows ``rule, column, n`` with n > 0, found in one pass over the table: counts that may not
    be shown, percentages beside hidden counts, banned characters, dates, and columns that nearly name
    their rows (over 0.9 distinct in more than 20 rows)."""
    aggs: list[tuple[str, str, Column]] = []
    for c in counts:
        aggs.append(("illegal_count", c, F.count_if(F.col(c).isNotNull() & ~is_legal_count(F.col(c)))))
    for pct, c in (percents or {}).items():
        aggs.append(("percent_beside_hidden", pct, F.count_if(F.col(pct).isNotNull() & F.col(c).isNull())))
    for c in texts:
        aggs += [("banned_character", c, F.count_if(F.col(c).rlike(banned))), ("date", c, F.count_if(F.col(c).rlike(dates))),
                 ("near_unique", c, F.when((F.count(F.lit(1)) > FLOOR) & (F.countDistinct(c) > 0.9 * F.count(F.lit(1))), F.countDistinct(c)).otherwise(0))]
    one = table.agg(*[n.alias(f"a{i}") for i, (_, _, n) in enumerate(aggs)])
    long = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("column"), F.col(f"a{i}").cast("long").alias("n")) for i, (r, c, _) in enumerate(aggs)]))
    return one.select(long.alias("x")).select("x.*").where("n > 0")


def fold_levels(rows: DataFrame, col: str, other: str = "other_or_unknown") -> DataFrame:
    """Levels of a category with FLOOR rows or fewer, and null, become one."""
    n = rows.groupBy(F.col(col).alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FLOOR).drop("_n").where("_c IS NOT NULL")
    return rows.join(n, rows[col] == n["_c"], "left").withColumn(col, F.coalesce("_c", F.lit(other))).drop("_c")


#: File kinds that may leave, by extension.
KINDS = {"csv": "table", "json": "results"}


def export_refusals(table: DataFrame, file: str, kind: str, counts: Sequence[str] = (), percents: dict[str, str] | None = None, partitions: dict[str, Sequence[str]] | None = None, texts: Sequence[str] = (), identifiers: Sequence[str] = ("person_id", "episode_id", "user_id")) -> DataFrame:
    """``class, column, n`` for each of the seven refusal classes that finds something; all are evaluated.

    1 extension, 2 illegal count, 3 percentage beside a hidden count, 4 lone hidden member of a partition,
    5 banned characters, 6 kind that does not fit the extension, 7 identifiers, dates and near-unique columns.
    """
    spark = table.sparkSession
    extension = file.rsplit(".", 1)[-1]
    named = [("7_identifier", c, 1) for c in table.columns if c.lower() in identifiers]
    if extension not in KINDS:
        named.append(("1_extension", file, 1))
    elif KINDS[extension] != kind:
        named.append(("6_kind", kind, 1))
    out = spark.createDataFrame(named, "class string, column string, n long")
    names = {"illegal_count": "2_illegal_count", "percent_beside_hidden": "3_percent_beside_hidden", "banned_character": "5_banned_character", "date": "7_date", "near_unique": "7_near_unique"}
    if counts or percents or texts:
        found = export_violations(table, counts, percents, texts)
        out = out.unionByName(found.select(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("rule")).alias("class"), "column", "n"))
    for count, by in (partitions or {}).items():
        lone = table.groupBy(*by).agg(F.count_if(F.col(count).isNull()).alias("h"), F.count_if(F.col(count) > 0).alias("s")).where("h = 1 AND s > 0")
        out = out.unionByName(lone.agg(F.lit("4_lone_hidden").alias("class"), F.lit(count).alias("column"), F.count(F.lit(1)).alias("n")).where("n > 0"))
    return out


def strata_both_ways(rows: DataFrame, a: str, b: str) -> DataFrame:
    """A table of strata with its exact margins taken first: cells hidden until no row and no column has a lone
    hidden one, then rounded; every line says whether its shown cells stay within its own margin."""
    cells = complementary_grid(rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n")), a, b, "n")
    shown = cells.withColumn("shown", F.when(~F.col("hidden"), round20(F.col("n"))))
    by = {x: shown.groupBy(x).agg(round20(F.sum("n")).alias(f"total_{x}"), F.sum(F.when(~F.col("hidden"), F.col("n"))).alias("_kept"), F.sum("n").alias("_all")) for x in (a, b)}
    out = shown
    for x, t in by.items():
        out = out.join(t.select(x, f"total_{x}", (F.coalesce("_kept", F.lit(0)) <= F.col("_all")).alias(f"checks_{x}")), x)
    return out.drop("n")


def nodes(table: DataFrame, path: Column, kind: Column, value: Column, count: Column) -> DataFrame:
    """``path, kind, value, display, suppressed, reason``: a value with its display text, or nothing and why.
    Counts are rounded, percentages whole, quantiles and bounds kept to three digits; a value that rests on a
    count below the floor is suppressed."""
    ok = disclosable(count)
    rounded = F.when(kind == "count", round20(count).cast("double")).when(kind == "percentage", F.round(value)).otherwise(F.round(value, 3))
    display = F.when(kind == "count", F.format_number(rounded, 0)).when(kind == "percentage", F.concat(F.format_number(rounded, 0), F.lit("%"))).when((kind == "p") & (value < 0.001), "<0.001").otherwise(F.format_number(rounded, 3))
    return table.select(path.alias("path"), kind.alias("kind"), F.when(ok, rounded).alias("value"), F.when(ok, display).alias("display"), (~ok).alias("suppressed"), F.when(~ok, HIDDEN).alias("reason"))


def suppression_log(found: DataFrame) -> DataFrame:
    """How many nodes of each kind were suppressed, and why."""
    return found.groupBy("kind", F.coalesce("reason", F.lit("shown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def with_gaps(rows: DataFrame, by: str, x: str, value: str) -> DataFrame:
    """Numbers the stretches of a curve that have a value: a missing or hidden point begins a new one."""
    w = Window.partitionBy(by).orderBy(x)
    jump = F.when(F.col(value).isNull(), 0).when(F.lag(value).over(w).isNull(), 1).otherwise(0)
    return rows.withColumn("_jump", jump).withColumn("segment", F.when(F.col(value).isNotNull(), F.sum("_jump").over(w))).drop("_jump")


def contract_problems(table: DataFrame, columns: Sequence[str], spellings: dict[str, Sequence[str]], parts: dict[str, tuple[str, str]]) -> DataFrame:
    """``check, column, n``: columns that are missing or were not declared, values outside their spellings, and
    partitions (column -> value, group) whose parts pass the whole named "all"."""
    spark = table.sparkSession
    named = [("missing_column", c, 1) for c in columns if c not in table.columns] + [("undeclared_column", c, 1) for c in table.columns if c not in columns]
    out = spark.createDataFrame(named, "check string, column string, n long")
    for c, allowed in spellings.items():
        if c in table.columns:
            out = out.unionByName(table.agg(F.lit("spelling").alias("check"), F.lit(c).alias("column"), F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*allowed)).alias("n")))
    for c, (value, group) in parts.items():
        sums = table.groupBy(group).agg(F.sum(F.when(F.col(c) != "all", F.col(value))).alias("p"), F.max(F.when(F.col(c) == "all", F.col(value))).alias("w"))
        out = out.unionByName(sums.agg(F.lit("partition").alias("check"), F.lit(c).alias("column"), F.count_if(F.col("p") > F.col("w")).alias("n")))
    return out.where("n > 0")
