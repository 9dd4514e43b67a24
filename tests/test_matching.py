"""Risk sets by a searched order: against all pairs, and how many pairs are made."""

import hashlib
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from panelwise.operators import events, matching
from panelwise.params import SCALED

RING = 1 << 52


def place(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def made(spark, n_pool, n_cases, seed):
    rng = np.random.default_rng(seed)
    features = [(f"e{k}", k // 2, date(2024, 1, 1) + timedelta(days=int(rng.integers(0, 20))), int(rng.integers(0, 16))) for k in range(n_pool)]
    ev = [(f"e{k}-x{d}", f"e{k}", k // 2, d, int(rng.integers(1, 8)), r == 0, bool(rng.random() < 0.1)) for k in range(n_cases) for r, d in enumerate(sorted(set(map(int, rng.integers(1, 15, 2)))))]
    f = spark.createDataFrame(features, "episode_id string, person_id int, discharge_date date, at_risk_last_day int")
    e = spark.createDataFrame(ev, "event_id string, episode_id string, person_id int, event_day int, landmark_dow int, is_first_event boolean, no_window boolean")
    return features, ev, f, e


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
                offers.append((1 if t == at and w == dow else 2 if (w in (1, 7)) == (dow in (1, 7)) else 3, abs(t - at), t))
            if offers and e != own:
                found.append((*min(offers), (place(p.salt, p.seed, e) - place(p.salt, p.seed, s)) % RING, e, who))
        rungs = sorted(x[0] for x in found)
        allowed = rungs[1] if len(rungs) > 1 else 3
        chosen += [(x[3], s, x[4], x[5], x[2], allowed) for x in sorted((x for x in found if x[0] <= allowed), key=lambda x: x[3:5])[:p.per_set]]
    served = {}
    for d, s, e, who, t, rung in sorted(chosen):
        served[who] = served.get(who, 0) + 1
        if served[who] <= p.per_person:
            out.append((s, "control", e, who, t, rung))
    return sorted(out)


def test_against_all_pairs(spark):
    for seed, n in ((1, 200), (2, 40), (3, 6)):
        features, ev, f, e = made(spark, n, max(3, n // 4), seed)
        assert sorted(map(tuple, events.risk_sets(f, e, SCALED).collect())) == brute(features, ev, SCALED)
    _, _, f, e = made(spark, 20, 5, 4)
    assert events.risk_sets(f, e.where("false"), SCALED).count() == 0
    assert events.risk_sets(f.where("false"), e, SCALED).where("role = 'control'").count() == 0


def test_pairs_grow_with_cases_not_with_the_pool(spark):
    def pairs(n_pool):
        _, _, f, e = made(spark, n_pool, 30, 5)
        return events.risk_set_candidates(f, e, SCALED)[1].count()

    small, large = pairs(1500), pairs(15000)
    assert large < 1.3 * small and large < 30 * 7 * 12 * 6


def test_next_on_ring(spark):
    rng = np.random.default_rng(7)
    items = [(int(c), int(p), f"i{k}") for k, (c, p) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(0, 40, 300), strict=True))] + [(9, 5, "alone"), (None, 3, "no class")]
    asked = [(int(c), int(p), k) for k, (c, p) in enumerate(zip(rng.integers(0, 5, 50), rng.integers(0, 40, 50), strict=True))] + [(9, 6, 100)]
    got = {}
    made_ = matching.next_on_ring(spark.createDataFrame(items, "class long, place long, item string"), spark.createDataFrame(asked, "class long, place long, ask long"), 7)
    for r in made_.collect():
        got.setdefault(r["ask"], []).append((r["distance"], r["item"]))
    for c, p, k in asked:
        want = sorted(((q - p) % RING, i) for d, q, i in items if d == c)[:7]
        assert sorted(got.get(k, [])) == want, k
