from datetime import date

import pytest
from pyspark.sql import functions as F

from panelwise.functions import columns as K
from panelwise.functions import disclosure as D


def one(spark, col, schema="x long", row=(1,)):
    return spark.createDataFrame([row], schema).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize(("minutes", "steps", "rule", "want"), [
    (600, None, "primary", True), (599, 10, "primary", False), (None, 10, "primary", False), (1441, 10, "primary", False), (1440, 0, "primary", True),
    (576, 0, "s1", True), (600, 99, "s2", False), (600, 100, "s2", True), (600, None, "s2", False), (480, None, "s3", True), (719, None, "s4", False), (600, 1, "other", None)])
def test_valid_day(spark, minutes, steps, rule, want):
    assert one(spark, K.valid_day(F.col("m"), F.col("s"), rule), "m long, s long", (minutes, steps)) == want


@pytest.mark.parametrize(("s", "b", "want"), [(None, 10.0, None), (0, 10.0, 1.0), (20, 10.0, 0.0), (5, 10.0, 0.5), (5, 0.0, None), (5, None, None)])
def test_deficit_keeps_null(spark, s, b, want):
    assert one(spark, K.deficit(F.col("s"), F.col("b")), "s long, b double", (s, b)) == want


def test_band_edges_and_null(spark):
    rows = spark.createDataFrame([(None,), (2999,), (3000,), (6999,), (7000,)], "x long").select(K.band(F.col("x"), [3000, 7000], ["a", "b", "c"]).alias("v")).collect()
    assert [r["v"] for r in rows] == [None, "a", "b", "b", "c"]
    with pytest.raises(ValueError):
        K.band(F.col("x"), [1], ["a"])


def test_earliest_of_takes_the_first_name_on_ties(spark):
    df = spark.createDataFrame([(date(2024, 1, 2), date(2024, 1, 2)), (None, date(2024, 1, 1)), (None, None)], "a date, b date")
    low, why = K.earliest_of([("a", F.col("a")), ("b", F.col("b"))])
    assert [(r["l"], r["w"]) for r in df.select(low.alias("l"), why.alias("w")).collect()] == [(date(2024, 1, 2), "a"), (date(2024, 1, 1), "b"), (None, "none")]


def test_spline_is_linear_beyond_the_knots(spark):
    df = spark.createDataFrame([(float(x),) for x in (100, 101, 102)], "x double")
    cols = K.spline_basis(F.col("x"), (10.0, 20.0, 30.0, 40.0))
    assert len(cols) == 3
    v = [r["v"] for r in df.select(cols[1].alias("v")).collect()]
    assert abs((v[2] - v[1]) - (v[1] - v[0])) < 1e-6


@pytest.mark.parametrize(("n", "ok", "shown"), [(0, True, 0), (1, False, None), (20, False, None), (21, True, 20), (30, True, 40), (29, True, 20), (None, False, None)])
def test_rounding_floor(spark, n, ok, shown):
    r = spark.createDataFrame([(n,)], "n long").select(D.disclosable(F.col("n")).alias("ok"), D.round20(F.col("n")).alias("shown")).first()
    assert (r["ok"], r["shown"]) == (ok, shown)


def test_displayed_counts_parse_back(spark):
    df = spark.createDataFrame([("1,240 (12%)",), ("suppressed",), (None,), ("<=20",)], "t string").select(D.parsed_count(F.col("t")).alias("n"), D.is_hidden_cell(F.col("t")).alias("h"))
    assert [(r["n"], r["h"]) for r in df.collect()] == [(1240, False), (None, True), (None, False), (None, True)]
