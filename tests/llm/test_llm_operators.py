"""Each operator against a brute-force version on small tables with nulls, empty texts and repeats."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwise.llm import bpe, components, embeddings, exact_dedup, minhash, mixing, pii, quality, suffix, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _k string"


def docs(spark, rows):
    """Rows of (doc_id, text, source) with an extra column whose name clashes with none."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x") for i, t, s in rows], DOCS)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(n))


def edited(text, seed, n):
    rng, w = np.random.default_rng(seed), text.split(" ")
    for k in rng.choice(len(w), n, replace=False):
        w[k] = f"new{seed}x{k}"
    return " ".join(w)


BASE = words(120, 0)
ROWS = ([(1, None, "a"), (2, "", "a"), (3, "  \n\t", None), (4, "one two", "b"), (5, "one two", "b"), (6, "ONE two", "b"), (7, BASE, "c"), (8, BASE, None), (20, words(60, 9) + " é ü 日本 " + words(3000, 8), "c")]
        + [(30 + k, edited(BASE, k, 1 + k % 5), "c") for k in range(8)] + [(60 + k, words(30 + k, 50 + k), "b") for k in range(10)])


@pytest.fixture(scope="module")
def table(spark):
    return docs(spark, ROWS)


def test_exact_classes(spark, table):
    got = {r["doc_id"]: r for r in exact_dedup.duplicate_classes(table).collect()}
    groups = defaultdict(list)
    for i, t, _ in ROWS:
        groups[t or ""].append(i)
    for i, t, _ in ROWS:
        g = groups[t or ""]
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    kept = exact_dedup.drop_duplicates(table)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {max(g) for g in groups.values()}


def test_exact_hot_digest_and_repeated_rows(spark):
    many = docs(spark, [(k, "hot", "a") for k in range(3000)] + [(5000 + k, f"t{k}", "a") for k in range(500)] + [(9000, "rep", "a")] * 3 + [(None, "hot", "a")])
    got = exact_dedup.duplicate_classes(many)
    hot = got.where(f"text_sha256 = '{hashlib.sha256(b'hot').hexdigest()}'")
    assert hot.count() == 3001 and hot.where("kept").count() == 1 and hot.where("keep_id = 2999 AND group_size = 3001").count() == 3001
    assert got.where("doc_id = 9000 AND kept").count() == 1
    assert exact_dedup.drop_duplicates(many).count() == 502


@pytest.mark.parametrize("make", [exact_dedup.duplicate_classes, exact_dedup.drop_duplicates, mixing.mixed, minhash.near_duplicates, suffix.without_repeats, pii.personal_data])
def test_empty_tables(spark, make):
    assert make(docs(spark, [])).count() == 0


def water_fill(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), list(names), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            free.remove(s)


def test_mixing_targets_and_taken(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " ".join(["w"] * int(rng.integers(1, 40))), ["a", "b", None, "d", "zz"][min(4, int(rng.integers(0, 9)))]) for k in range(1500)] + [(2000, None, "a"), (2001, "", "only empty")]
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = Counter()
    for i, _, s in rows:
        by[s] += size[i]
    want = water_fill(dict(by))
    got = mixing.mixed(docs(spark, rows)).collect()
    taken = Counter()
    source = {i: s for i, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        due = want[s] / by[s] if by[s] else 0.0
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == by[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["copies"] in (np.floor(due + 1e-9), np.ceil(due - 1e-9)) and r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 40 for s in by)
    again = mixing.mixed(docs(spark, rows).repartition(7)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((r["doc_id"], r["taken"]) for r in again)


def test_mixing_misses_by_less_than_a_median_document(spark):
    docs_ = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    by = defaultdict(list)
    for r in mixing.mixed(docs_).collect():
        by[r["source"]].append((r["size"], r["taken"], r["target"]))
    assert len(by) > 10
    for s, rows in by.items():
        miss = abs(sum(r[1] for r in rows) - rows[0][2])
        assert miss <= max(0.01 * rows[0][2], np.median([r[0] for r in rows])), s


def test_mixing_counts_repeated_rows_before_it_deals_them(spark):
    rows = [(7, "w w w", "a")] * 700 + [(None, "w", "a")] * 300 + [(k, "w w", "b") for k in range(200)]
    got = mixing.mixed(docs(spark, rows)).collect()
    assert len(got) == len(rows) and Counter((r["doc_id"], r["size"]) for r in got) == Counter((i, len(t.split())) for i, t, _ in rows)
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[r["source"]] - r["target"]) <= 3 for r in got) and {r["copies"] for r in got if r["source"] == "a"} <= {0, 1}


def test_mixing_is_unbiased(spark):
    rows = [(k, "w " * (1 + k % 7), "a" if k % 3 else "b") for k in range(300)]
    mean = Counter()
    for seed in range(6):
        for r in mixing.mixed(docs(spark, rows), seed).collect():
            mean[r["doc_id"]] += r["copies"] / 6
    assert 0 < np.mean([v for v in mean.values()]) < 3 and len({round(v, 2) for v in mean.values()}) > 2


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(5, len(w))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if n else set()


def near_brute(rows):
    sets = {i: shingles(t) for i, t, _ in rows}
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates(spark, table):
    want = near_brute(ROWS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table).collect()}
    assert got == want
    kept = minhash.drop_near_duplicates(table)
    assert kept.columns == table.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_near_duplicates_in_chains_and_families(spark):
    base = words(200, 77)
    rows = [(100 + k, edited(base, 1000 + k, 3), "a") for k in range(25)] + [(900, base, "a")]
    step = base
    for k in range(12):
        step = edited(step, 2000 + k, 3)
        rows.append((1000 + k, step, "a"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == near_brute(rows)


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}


def suffix_brute(rows):
    seen, out = {}, {}
    for i, t, _ in rows:
        raw = (t or "").encode()
        for s in range(len(raw) - 49):
            w = raw[s:s + 50]
            seen[w] = min(seen.get(w, i), i)
    for i, t, _ in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 49):
            if seen[raw[s:s + 50]] < i:
                gone[s:s + 50] = True
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), np.frombuffer(raw, np.uint8)[~gone].tobytes())
    return out


def test_repeats(spark):
    p49, p50, p51 = "q" * 20 + words(6, 1)[:29], words(12, 2)[:50], words(12, 3)[:51]
    rows = [r for r in ROWS if r[0] != 20] + [(200, f"left {p50} right", "a"), (201, f"other{p50}side", "a"), (202, p50, "a"), (203, f"a {p49} b", "a"), (204, f"c {p49} d", "a"), (205, p51 + "!", "a"), (206, "?" + p51, "a"),
            (207, "ab" * 300, "a"), (208, "x" + "ab" * 200, "a"), (209, "é" * 60, "a"), (210, "é" * 40, "a"), (211, "z" * 49, "a"), (212, "z" * 49, "a")]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix.without_repeats(docs(spark, rows)).collect()}
    assert got == suffix_brute(rows)


def test_bpe_round_trip(spark, table):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(300, "I'll  don't   \n\n x y　z <|endoftext|> 123abc!!! 😀👍🏽", "a"), (301, "a" * 400, "a"), (302, "\u0000�​", "a"), (303, " ", "a")]
    rows = ROWS + odd
    out = bpe.encoded(docs(spark, rows), ranks, public_tokenizers.PATTERN)
    out = out.select("doc_id", "ids", bpe.decoded(F.col("ids"), ranks).alias("back"), bpe.ids_bytes(F.col("ids"), ranks).alias("raw"))
    text = {i: t or "" for i, t, _ in rows}
    for r in out.collect():
        ids = own.encode_ordinary(text[r["doc_id"]])
        assert list(r["ids"]) == ids and bytes(r["back"]) == text[r["doc_id"]].encode() and bytes(r["raw"]) == np.array(ids, "<u4").tobytes()


def test_vectors_links_and_recall(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = np.concatenate([centres + 0.25 * rng.normal(size=centres.shape) * rng.random((40, 1)) for _ in range(6)] + [rng.normal(size=(150, 64))])
    rows = [(int(i), [float(v) for v in e], int(i % 2)) for i, e in enumerate(x)] + [(900 + k, [float(v) for v in x[0]], 0) for k in range(3)]
    rows += [(950, None, 0), (951, [0.0] * 64, 0), (952, [float("nan")] * 64, 0), (953, [float(v) for v in x[0]], None), (954, [], 0), (955, [1.0, None], 0)]
    got = {r["vec_id"]: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    good = [r for r in rows if r[0] < 950]
    v, lab, ids = np.array([r[1] for r in good]), np.array([r[2] for r in good]), np.array([r[0] for r in good])
    u = v / np.linalg.norm(v, axis=1)[:, None]
    true = ((u @ u.T >= 0.93) & (lab[:, None] == lab[None, :])).sum(1) - 1
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= true).all() and found.sum() >= 0.97 * true.sum() > 100
    assert all(got[k]["n_links"] == 0 and got[k]["component_id"] == k and got[k]["kept"] for k in range(950, 956))


def test_big_bucket_is_cut_into_blocks(spark):
    rng = np.random.default_rng(6)
    c = rng.normal(size=16)
    rows = [(int(i), [float(v) for v in c + 0.01 * rng.normal(size=16)], 1) for i in range(600)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert got.where("n_links = 599 AND component_id = 0").count() == 600 and got.where("kept").count() == 1


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


PII = ["a@b.c_d@e.fg x@y@z.com é😀 me.too+1@host-1.co.uk @ a@b", "1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255 99999999999.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 0000000000000", "+1 (555) 123-4567 +123 + 44 20 7946 0958 +442079460958+1-2-3-4-5-6-7-8-9-0", None, "", "9" * 20000, "a" * 20000 + "@", "token = \"ede43f42c939b6405768150e0411590525cf889e\" Dr. Anna met Mr John, call 555 123 4567 or on 2024-01-02"]


def test_pii_base_spans_stay(spark):
    rows = [(k, t, "a") for k, t in enumerate(PII)]
    for r in pii.personal_data(docs(spark, rows)).collect():
        want = base_spans(PII[r["doc_id"]])
        assert [tuple(s) for s in r["base"]] == want
        spans = [tuple(s) for s in r["spans"]]
        assert set(want) <= set(spans) and spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), s[1]))


@settings(max_examples=20, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from(["secret", "number"]), st.text("yno", min_size=6, max_size=6)), st.integers(1, 1000), min_size=1, max_size=12))
def test_em_gives_probabilities(raw):
    counts = {f"{k}:{v}": n for (k, v), n in raw.items()}
    posterior = pii.estimate(counts, 10)
    assert set(posterior) == set(counts) and all(0 <= p <= 1 for p in posterior.values())
    assert all(np.isfinite(v) for v in pii.train(counts, posterior, 20).values())


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200
    pages = [(5, "http://www.b.org/x", big), (2, "http://a.com/y?q=1", big), (9, None, big + "é"), (7, "https://a.com/\nz", None), (8, "http://a.com/", "short"), (11, "http://a.com/", "short"), (None, "u", big), (12, "http://a.com/1", big + "2")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows, shards = warc.archive(df)
    got = warc.read_back(df, shards).collect()
    assert len(got) == len(pages) and rows.count() == len(pages)
    for r in got:
        html = next(h for i, u, h in pages if i == r["page_id"]) or ""
        raw = html.encode()
        revisit = html == big and r["page_id"] != 2
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 2) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == raw
    assert warc.reversed_host_key("http://www.a.org:80/x?y") == "org,a,www)/x?y"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_back(empty, warc.archive(empty)[1]).count() == 0


def test_index_finds_keys_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    pages = spark.createDataFrame([(k % 50, f"http://h{k % 3}.org/{k % 50}", f"<p>{k}</p>" * 30) for k in range(200)], "page_id long, url string, html string")
    _, shards = warc.archive(pages)
    assert warc.read_back(pages, shards).count() == 200


def labelled(n):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for k in range(n):
        t = words(60, 500 + k)
        bad, toxic = k % 4 == 0, k % 5 == 1
        if bad:
            t = " | ".join(t.split(" "))
        elif toxic:
            w = t.split(" ")
            for i in rng.choice(len(w), 3, replace=False):
                w[i] = "idiot"
            t = " ".join(w)
        rows.append((k, t, "a"))
        labels.append((k, int(not bad), int(toxic and not bad)))
    return rows + [(10_000, None, "a"), (10_001, "", "a")], labels


def test_quality_held_out_accuracy(spark):
    rows, labels = labelled(400)
    d, lab = docs(spark, rows), spark.createDataFrame(labels + [(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    out = quality.with_scores(d, quality.fit(d, lab)).withColumn("h", quality.held_out(F.col("doc_id"))).toPandas().set_index("doc_id")
    want = pd.DataFrame(labels, columns=["doc_id", "q", "t"]).set_index("doc_id").join(out)
    held = want[want.h]
    assert out["score"].between(0, 1).all() and ((held["score"] >= 0.7) == (held["q"] == 1)).mean() > 0.95
    assert (out["h"] == [__import__("zlib").crc32(str(i).encode()) % 4 == 2 for i in out.index]).all()


def test_toxicity_held_out_accuracy_and_grammar(spark):
    rows, labels = labelled(400)
    d, lab = docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    grammar = toxicity.fit(d, lab)
    out = toxicity.with_scores(d, grammar).toPandas().set_index("doc_id")
    want = pd.DataFrame(labels, columns=["doc_id", "q", "t"]).set_index("doc_id").join(out)
    assert out["score"].between(0, 1).all() and ((want["score"] >= 0.7) == (want["t"] == 1)).mean() > 0.95
    f = toxicity.clause_factors
    assert f("i", False) == [1.0] and f("yi", False)[1] == 1.5 and f("ni", False)[1] < 0.5 and f("ri", False)[1] < 0.5 and f("i", True) == [0.4] and f("t", False) == [0.0]


def test_models_without_labels(spark):
    d = docs(spark, ROWS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for fit, score in ((quality.fit, quality.with_scores), (toxicity.fit, toxicity.with_scores)):
        assert score(d, fit(d, none)).where("score BETWEEN 0 AND 1").count() == len(ROWS)
