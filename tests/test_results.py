"""Bundles read back from their files, nested results, signed builds and hash trees."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from panelwise.functions.disclosure import is_legal_count
from panelwise.operators import aggregates
from panelwise.sources import io


def test_a_written_20_is_legal(spark):
    d = spark.createDataFrame([(n,) for n in (None, -20, 0, 7, 20, 21, 40)], "n long")
    assert [r[0] for r in d.select(is_legal_count(F.col("n"))).collect()] == [False, False, True, False, True, False, True]


def bundle(spark, folder):
    a = spark.createDataFrame([("x", 40), ("y", None), ("z", 20)], "k string, n long").coalesce(1)
    b = spark.createDataFrame([("p", 60)], "k string, n long").coalesce(1)
    return io.write_bundle({"one": a, "two": b}, {"one": "n", "two": "n"}, str(folder)), {"one": "n", "two": "n"}


def problems(spark, folder, told, counts, budget=None):
    return {(r["file"].split("/")[0], r["problem"]) for r in io.bundle_problems(spark, str(folder), told, counts, budget).collect()}


def test_damaged_missing_and_extra_files_are_named(spark, tmp_path):
    folder = tmp_path / "bundle"
    told, counts = bundle(spark, folder)
    rows = {r["file"].split("/")[0]: r for r in told.collect()}
    assert (rows["one"]["n_rows"], rows["one"]["n_hidden"], rows["two"]["n_rows"]) == (3, 1, 1)
    one, two = (next((folder / n).glob("*.csv")) for n in ("one", "two"))
    assert rows["one"]["md5"] == hashlib.md5(one.read_bytes()).hexdigest() and rows["one"]["bytes"] == one.stat().st_size
    assert problems(spark, folder, told, counts) == set()
    assert problems(spark, folder, told, counts, 10) == {("*", "over_budget")}
    one.write_text(one.read_text().replace("40", "47"))
    for crc in folder.rglob("*.crc"):
        crc.unlink()
    assert problems(spark, folder, told, counts) == {("one", "damaged"), ("one", "illegal_count")}
    one.write_text("k,n\nx,40\n")
    assert problems(spark, folder, told, counts) == {("one", "damaged"), ("one", "recount")}
    (folder / "two" / "more.csv").write_text("k,n\nq,80\n")
    two.unlink()
    assert problems(spark, folder, told, counts) == {("one", "damaged"), ("one", "recount"), ("two", "missing"), ("two", "extra")}


def node(value, hidden=False, unit="count"):
    return {"value": value, "suppressed": hidden, "unit": unit}


GOOD = {"a": {"b": {"c": {"x": node(None, True), "y": node(None, True), "z": node(60)}}}, "list": [node(0), {"deep": [node(20), "text"]}], "mean": node(1.5, unit="mean")}


def test_a_lone_hidden_member_three_levels_down_is_refused(spark, tmp_path):
    lone = json.loads(json.dumps(GOOD))
    lone["a"]["b"]["c"]["y"] = node(80)
    beside, bad, illegal = ({"r": [[{"k": node(5, True)}]]}, {"t": ["ok", {"u<v": "seen 2024-01-31"}]}, {"q": node(33)})
    docs = spark.createDataFrame([("good", json.dumps(GOOD)), ("lone", json.dumps(lone)), ("beside", json.dumps(beside)), ("bad", json.dumps(bad)), ("illegal", json.dumps(illegal)), ("broken", "{no"), ("empty", "{}"), ("null", None)], "doc string, text string")
    got = {(r["doc"], r["path"], r["rule"]) for r in io.json_refusals(docs, "doc", "text").collect()}
    assert got == {("lone", "$.a.b.c.x", "lone_hidden"), ("beside", "$.r[0][0].k", "value_beside_hidden"), ("bad", "$.t[1].u<v", "banned_character"), ("bad", "$.t[1].u<v", "date"), ("illegal", "$.q", "illegal_count"), ("broken", "$", "unreadable")}
    nodes = io.json_nodes(docs.where("doc = 'good'"), "doc", "text")
    assert nodes.where("value = '60'").first()["path"] == "$.a.b.c.z.value" and nodes.agg(F.max("depth")).first()[0] == 5
    io.gated_json(docs.where("doc = 'good'"), "doc", "text", str(tmp_path / "ok"))
    assert json.loads(next((tmp_path / "ok").glob("part-*.txt")).read_text()) == GOOD
    with pytest.raises(ValueError, match=r"lone_hidden at \$\.a\.b\.c\.x of lone"):
        io.gated_json(docs, "doc", "text", str(tmp_path / "no"))


def test_a_changed_parameter_rebuilds_its_stage_and_all_after_it(spark, tmp_path):
    made = []

    def stage(name, reads=(), **params):
        def make(t):
            made.append(name)
            return spark.range(params.get("n", 1) + sum(d.count() for d in t.values()))
        return io.Stage(make, reads, params)

    def build(n=2, cutoff="2024-01-31"):
        made.clear()
        tables, built = io.build_signed(spark, {"a": stage("a"), "b": stage("b", ("a",), n=n), "c": stage("c", ("b",)), "d": stage("d", ("a",))}, str(tmp_path), cutoff)
        assert built == made
        return list(made), {k: t.count() for k, t in tables.items()}

    assert build() == (["a", "b", "c", "d"], {"a": 1, "b": 3, "c": 4, "d": 2})
    assert build() == ([], {"a": 1, "b": 3, "c": 4, "d": 2})
    assert build(5) == (["b", "c"], {"a": 1, "b": 6, "c": 7, "d": 2})
    assert build()[0] == [] and build(cutoff="2024-02-01")[0] == ["a", "b", "c", "d"]
    for done in tmp_path.glob("c-*/_SUCCESS"):
        done.unlink()  # as an attempt that broke off
    assert build()[0] == ["c"]
    with pytest.raises(ValueError, match="no earlier stage"):
        io.stage_stamps({"x": io.Stage(lambda t: None, ("y",))}, "")
    d = io.stamped(spark.range(1), spark.createDataFrame([(3,)], "at int"), "at", {"n": 1})
    assert (d.first()["source_cutoff"], json.loads(d.first()["params"])) == (3, {"n": 1})


def test_tree_digest_and_changed_rows(spark, monkeypatch):
    monkeypatch.setattr(aggregates, "LEAF_ROWS", 20)
    rows = [(k % 700, f"v{k % 31}" if k % 5 else None) for k in range(900)]
    a = spark.createDataFrame(rows, "k int, v string")
    assert aggregates.leaf_digits(a) == 2
    one, two = (aggregates.tree_digest(d, ["k", "v"]).first() for d in (a, a.repartition(5)))
    assert one == two and one["n"] == 900
    b = spark.createDataFrame(rows[1:] + [(5000, "new")], "k int, v string")
    assert aggregates.tree_digest(b, ["k", "v"]).first()["digest"] != one["digest"]
    got = {(r["k"], r["v"], r["n_a"], r["n_b"]) for r in aggregates.changed_rows(a, b, ["k", "v"]).collect()}
    k, v = rows[0]
    n = rows.count((k, v))
    assert got == {(k, v, n, n - 1), (5000, "new", 0, 1)}
    assert aggregates.changed_rows(a, a.repartition(3), ["k", "v"]).count() == 0
    assert tuple(aggregates.tree_digest(a.where("false"), ["k", "v"]).first()) == (0, None)
