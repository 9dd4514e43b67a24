"""Risk sets in the order of the pair's MD5, against all pairs."""

import hashlib
from datetime import timedelta

import duckdb
from test_matching import made

from panelwise.operators import events
from panelwise.params import SCALED


def brute(features, ev, p, reach=2):
    first = {}
    for _, e, _, d, *_ in ev:
        first[e] = min(first.get(e, d), d)
    out, chosen = [], []
    for s, own, person, at, dow, is_first, none in ev:
        if not is_first or none:
            continue
        out.append((s, "case", own, person, at, 1))
        found = []
        for e, who, discharged, last in features:
            last = min(last, first.get(e, last + 1) - 1)
            offers = []
            for t in range(max(1, at - reach), min(last, at + reach) + 1):
                w = ((discharged + timedelta(days=t + p.landmark[1])).isoweekday() % 7) + 1
                mark = hashlib.md5("|".join(map(str, (p.salt, p.seed, s, e, t))).encode()).hexdigest()
                offers.append((1 if t == at and w == dow else 2 if (w in (1, 7)) == (dow in (1, 7)) else 3, abs(t - at), mark, t))
            if offers and e != own:
                found.append((*min(offers), e, who))
        rungs = sorted(x[0] for x in found)
        allowed = rungs[1] if len(rungs) > 1 else 3
        chosen += [(x[2], s, x[4], x[5], x[3], allowed) for x in sorted((x for x in found if x[0] <= allowed), key=lambda x: x[2])[:p.per_set]]
    served = {}
    for _, s, e, who, t, rung in sorted(chosen):
        served[who] = served.get(who, 0) + 1
        if served[who] <= p.per_person:
            out.append((s, "control", e, who, t, rung))
    return sorted(out)


def test_pair_order_against_all_pairs(spark):
    for seed, n in ((1, 200), (2, 40), (3, 6)):
        features, ev, f, e = made(spark, n, max(3, n // 4), seed)
        assert sorted(map(tuple, events.risk_sets(f, e, SCALED, order="pair").collect())) == brute(features, ev, SCALED)
    _, _, f, e = made(spark, 20, 5, 4)
    assert events.risk_sets(f, e.where("false"), SCALED, order="pair").count() == 0
    assert events.risk_sets(f.where("false"), e, SCALED, order="pair").where("role = 'control'").count() == 0


def test_a_set_for_which_too_few_pass_the_bound_is_asked_again(spark):
    from panelwise.operators.joins import latest_first
    from pyspark.sql import functions as F

    _, _, f, e = made(spark, 150, 30, 5)
    few, all_ = (latest_first(events.pair_candidates(f, e, SCALED, ample=n)[1], ["set_id"], [F.asc("fingerprint")], SCALED.per_set) for n in (2, 10**6))
    assert sorted(map(tuple, few.drop("bound").collect())) == sorted(map(tuple, all_.drop("bound").collect()))


def test_the_query_has_an_order_for_each_set(spark):
    """Set and SQL as the reference orders them: by the fingerprint of set, episode and day."""
    from panelwise.plans import registry

    sql, sf = registry.oracle_sql()["cp14_risk_sets"], "/root/testdata/sf0.01"
    assert "set_id, episode_id, day)) AS fingerprint" in sql
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    got = registry.queries()["cp14_risk_sets"](spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall())
