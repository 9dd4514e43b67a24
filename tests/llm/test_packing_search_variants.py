"""Packing, spelling variants and ranked search against brute force, with nulls, ties, repeats, long texts and clashing columns."""

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelwise.llm import packing, queries, search, variants

WORDS = public_tokenizers.path("word_bpe_49k.json")
DIR = "/root/testdata/sf0.001"


def tokenizer(path=WORDS):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


ODD = [None, "", " ", "\n\n", "don't STOP we'll", "Été naïve ÀÉÎ ß µm ²³ ¼", "a̸ ≮ H̱", "日本語 テスト", "x\x1cy\x85z\xa0w", "İstanbul ΣΊΣΥΦΟΣ ﬁne", "🙂 ok", "<|endoftext|> here", "z" * 30000, "word " * 5000, "tab\tand\x0bmore\x00nul\x7f"]


def document_table(spark, texts):
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    return df.withColumns({n: F.lit("clash") for n in ("uid", "chunk", "n", "word", "score", "rank")})


def brute_pieces(rows, size=2048, path=WORDS):
    t = tokenizer(path)
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), size)):
            one = ids[at:at + size]
            out.append((i, k, at, len(one), zlib.crc32(struct.pack(f"<{len(one)}I", *one))))
    return out


def check_sequences(rows, room):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= room.tokens and len(places) <= room.documents and sum(n * n for _, n in places) <= room.attention
    return len(by)


def test_pieces_of_odd_texts(spark):
    texts = ODD + ["".join(np.random.default_rng(k).choice(list("abcÀéÿß'sté .,!?1²\t\n\x1f"), 50)) for k in range(200)]
    table = document_table(spark, texts).unionByName(document_table(spark, ["again", "again"]).withColumn("doc_id", F.lit(None).cast("long"))).unionByName(document_table(spark, ["same id"] * 2).withColumn("doc_id", F.lit(3)))
    made = packing.token_pieces(table, WORDS)
    want = brute_pieces([*enumerate(texts), (None, "again"), (None, "again"), (3, "same id"), (3, "same id")])
    assert sorted(map(tuple, made.collect()), key=lambda r: (r[0] is None, *(x or 0 for x in r))) == sorted(want, key=lambda r: (r[0] is None, *(x or 0 for x in r)))
    placed = packing.packed(made).collect()
    assert sorted(Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in placed).items(), key=str) == sorted(Counter(want).items(), key=str)
    check_sequences(placed, packing.Capacity())
    assert packing.packed(packing.token_pieces(table.where("false"), WORDS)).count() == 0


def test_another_tokenizer_and_whole_sequences(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [t for t in ODD if t != "z" * 30000][:12] + ["one two  three\nfour " * 30]
    table = document_table(spark, texts)
    room = packing.Capacity(tokens=64, documents=3, attention=64 * 64)
    made = {(r["doc_id"], r["piece"]): tuple(r)[2:] for r in packing.token_pieces(table, path, 64).collect()}
    assert made == {r[:2]: r[2:] for r in brute_pieces(enumerate(texts), 64, path)}
    whole = packing.sequences(table, path, room).collect()
    t, got = tokenizer(path), defaultdict(list)
    for r in whole:
        assert len(r["ids"]) <= 64 and len(r["doc_ids"]) <= 3
        ends = [*r["starts"][1:], len(r["ids"])]
        for d, a, b in zip(r["doc_ids"], r["starts"], ends, strict=True):
            got[d].append(r["ids"][a:b])
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert sorted(map(tuple, got[i])) == sorted(tuple(ids[k:k + 64]) for k in range(0, len(ids), 64))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds_and_few_sequences_are_made(spark, rule, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 200)
    rng = np.random.default_rng(3)
    lengths = np.r_[rng.integers(1, 101, 1500), np.full(100, 100)]
    rows = [(i % 900, i // 900, 0, int(n), i) for i, n in enumerate(lengths)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    for room in (packing.Capacity(100, 100, 10_000, rule=rule), packing.Capacity(100, 4, 10_000, rule=rule), packing.Capacity(100, 100, 10_000, (1.0, 0.0, 1.0), rule)):
        placed = packing.packed(df, room).collect()
        n = check_sequences(placed, room)
        assert len(placed) == len(rows) and n <= max(np.ceil(lengths.sum() / 100), len(rows) / room.documents) * 1.04
    with pytest.raises(ValueError):
        packing.packed(df, packing.Capacity(50, 50, 2500))
    for bad in ({"tokens": 0}, {"rule": "x"}, {"tokens": 100, "attention": 9}):
        with pytest.raises(ValueError):
            packing.Capacity(**bad)


def test_best_fit_prefers_the_tightest_place():
    bins, places, unused = packing.best_fit(np.array([60, 50, 45, 40, 5]), packing.Capacity(100, 10, 10_000))
    assert list(bins) == [0, 1, 1, 0, 1] and list(places) == [0, 0, 50, 60, 95] and list(unused) == [0, 0]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_variants(rows):
    counts, find = Counter(), re.compile("[A-Za-zÀ-ÿ]+")
    for i, text in rows:
        for w in find.findall(text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}
    near, masks = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            masks[w[:k] + "*" + w[k + 1:]].add(w)
            if w[:k] + w[k + 1:] in n:
                near[w].add(w[:k] + w[k + 1:])
                near[w[:k] + w[k + 1:]].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 2 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), k, len(near[w]), n[form[w]] if w in form else None) for w, k in n.items()}


def variant_rows():
    rng = np.random.default_rng(9)
    stems = sorted({"".join(rng.choice(list("abé"), int(rng.integers(4, 8)))) for _ in range(300)})
    share = 1 / np.arange(1, len(stems) + 1) ** 0.7
    texts = [" ".join(rng.choice(stems, 80, p=share / share.sum())) for _ in range(60)]
    long = "qwertyuiop" * 400
    texts += [f"{long} {long[:-1]}x {long}s aaaaaa aaaaaaa aaaaaaaa abcdef {k}" for k in range(4)]
    texts += ["THORN thorn Thorn þorns þorns þorns ×÷×÷× ×÷×÷× ×÷×÷× abcÿf abcÿf abcÿf", None, "", "12 345", "日本 abcdē abcdē abcdē", "a-b_c'd"]
    return [*enumerate(texts), (None, texts[0]), (7, texts[7]), (7, "other text with the same id " + texts[8])]


def test_variants_against_all_pairs(spark, monkeypatch):
    rows = variant_rows()
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string")
    want = brute_variants(rows)
    assert sum(v[3] for v in want.values()) > 300 and any(v[0] for v in want.values())
    for held in (variants.HELD, 20):
        monkeypatch.setattr(variants, "HELD", held)
        got = variants.spelling_variants(df)
        assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
        assert {r["word"]: tuple(r)[1:] for r in got.collect()} == want
    assert variants.spelling_variants(df.where("doc_id < 0")).count() == 0


def test_variants_when_hashes_collide(spark, monkeypatch):
    """Prefixes that share a node by chance add candidates and change no result."""
    rows = variant_rows()[:30]
    monkeypatch.setattr(variants, "mixed_bits", lambda x: x & np.uint64(0xFFF))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["word"]: tuple(r)[1:] for r in variants.spelling_variants(df).collect()} == brute_variants(rows)


def test_a_chain_of_forms_has_one_root(spark):
    forms = spark.createDataFrame([(f"w{k:02d}", f"w{k + 1:02d}") for k in range(20)] + [("x", "w05")], "word string, form string")
    assert {r["root"] for r in variants.roots(forms).collect()} == {"w20"}
    assert variants.roots(forms.where("false")).count() == 0


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(docs, items):
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, n_terms = sum(c.total() > 0 for _, c in found), sum(c.total() for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in found:
            m = 10 + 90 * c.total() * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(TERM.findall((text or "").translate(LOWER))) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:10], 1)]
    return sorted(out, key=str)


def search_rows():
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(60)] + ["Été", "日本", "x9"]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    docs = [(i, text(int(rng.integers(1, 40)))) for i in range(150)]
    docs += [(200 + k, "w1 w2 W3, w3") for k in range(15)] + [(None, "w1 w2 w3 w3"), (300, None), (301, ""), (302, "!!"), (5, docs[5][1]), (303, "w4 " * 3000)]
    items = [(k, text(6)) for k in range(30)] + [(3, "w1 w2 w3"), (None, "w5 été"), (40, None), (41, "nothing of this"), (42, ""), (43, "ÉTÉ Été")]
    return docs, items


@pytest.mark.parametrize("tiles", [(64, 1024, 4096, 1 << 20), (3, 7, 5, 120)])
def test_search_against_brute_force(spark, tiles, monkeypatch):
    for name, value in zip(("ITEM_TILE", "DOC_TILE", "VOCABULARY_TILE", "BLOCK_BYTES"), tiles, strict=True):
        monkeypatch.setattr(search, name, value)
    docs, items = search_rows()
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, ids string, n int")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, rank int")
    got = search.ranked(d, q)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_search(docs, items)


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame(x, f"{k} long, text string") for x, k in zip(search_rows(), ("doc_id", "item_id"), strict=True))
    none = docs.where("false")
    assert search.ranked(none, items).count() == 0 and search.ranked(docs, items.where("false")).count() == 0
    assert search.ranked(none, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def test_query_of_search_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.sql(f"SELECT item_id, rank, doc_id, score FROM ({queries.OP13_SQL})").fetchall()
    assert sorted(map(tuple, queries.op13_blocked_search(spark, DIR).collect())) == sorted(want)


def test_queries_of_packing_and_variants(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DIR}/documents.parquet'").fetchall()
    placed = queries.op11_vector_best_fit(spark, DIR).collect()
    assert sorted(tuple(r)[:5] for r in placed) == sorted(brute_pieces(rows))
    n = check_sequences(placed, packing.Capacity())
    assert n <= math.ceil(sum(r["length"] for r in placed) / 2048) + 1
    assert {r["word"]: tuple(r)[1:] for r in queries.op12_trie_frontier(spark, DIR).collect()} == brute_variants(rows)
