"""The registered queries against Python on a small folder, and the edge cases of each operator."""

import hashlib

import numpy as np
import pytest
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F
from test_llm_operators import ROWS, base_spans, docs, edited, near_brute, suffix_brute, words

from panelwise.llm import bpe, common, embeddings, exact_dedup, minhash, mixing, pii, quality, queries, suffix, toxicity, warc

LONG = words(4000, 321)
ROWS2 = ROWS + [(300, "mail a@b.cd from 10.0.0.1", "a"), (301, LONG, "b"), (302, edited(LONG, 3, 4), "b"), (303, "漢字" * 300, "c")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    docs(spark, ROWS2).drop("_k").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, int(k % 2), int(k % 3 == 0)) for k, (i, _, _) in enumerate(ROWS2)], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(i, f"http://a.org/{i}", t) for i, t, _ in ROWS2], "page_id long, url string, html string").write.parquet(str(path / "pages.parquet"))
    return str(path)


def ranks_and_twin():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_queries_of_scores(spark, folder):
    for make, module, folds, part in ((queries.op1_quality_classifier, quality, 4, 2), (queries.op4_toxicity, toxicity, 3, 1)):
        got = {r["doc_id"]: r for r in make(spark, folder).collect()}
        assert set(got) == {i for i, _, _ in ROWS2}
        import zlib
        for i, r in got.items():
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == (zlib.crc32(str(i).encode()) % folds == part)


def test_a_tie_at_the_threshold_is_predicted(spark, folder, monkeypatch):
    monkeypatch.setattr(quality, "with_scores", lambda d, m: d.withColumn("score", F.lit(0.7)))
    assert queries.op1_quality_classifier(spark, folder).where("predicted = 1").count() == len(ROWS2)


def test_query_of_personal_data(spark, folder):
    text = {i: t or "" for i, t, _ in ROWS2}
    for r in queries.op2_weak_supervision_pii(spark, folder).collect():
        want = base_spans(text[r["doc_id"]])
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_query_of_tokens(spark, folder):
    _, own = ranks_and_twin()
    text = {i: t or "" for i, t, _ in ROWS2}
    for r in queries.op3_byte_bpe(spark, folder).collect():
        ids = own.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text[r["doc_id"]].encode()).hexdigest())


def test_query_of_repeats(spark, folder):
    want = suffix_brute(ROWS2)
    for r in queries.op6_prefix_doubling(spark, folder).collect():
        n, gone, spans, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, gone, spans, hashlib.sha256(kept).hexdigest())


def test_query_of_pages(spark, folder):
    text = {i: (t or "").encode() for i, t, _ in ROWS2}
    first = {}
    for i in sorted(text):
        first.setdefault(text[i], i)
    for r in queries.op10_warc_index(spark, folder).collect():
        raw = text[r["page_id"]]
        again = len(raw) >= 100 and first[raw] != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None)


def test_empty_tables(spark):
    none, vectors = docs(spark, []), spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    ranks, _ = ranks_and_twin()
    assert quality.with_scores(none, quality.fit(none, labels)).count() == 0
    assert toxicity.with_scores(none, toxicity.fit(none, labels)).count() == 0
    assert bpe.encoded(none, ranks, public_tokenizers.PATTERN).count() == 0
    assert embeddings.near_vectors(vectors).count() == 0


TWICE = [(1, "one two three four five six seven", "a"), (1, "one two three four five six seven", "a"), (2, words(60, 1), "a"), (2, words(60, 2), "a"), (3, words(60, 2), "b"), (None, words(60, 1), "b"), (None, None, "b")]


def test_repeated_and_null_ids(spark):
    table = docs(spark, TWICE)
    _, own = ranks_and_twin()
    ranks, _ = ranks_and_twin()
    got = bpe.encoded(table, ranks, public_tokenizers.PATTERN).collect()
    assert sorted((r["doc_id"] or 0, list(r["ids"])) for r in got) == sorted((i or 0, own.encode_ordinary(t or "")) for i, t, _ in TWICE)
    kept = suffix.without_repeats(table).collect()
    assert len(kept) == len(TWICE) and all(r["n_removed"] == 0 for r in kept if r["doc_id"] in (None, 1))
    assert [r["n_removed"] for r in kept if r["doc_id"] == 3] == [len(words(60, 2))]
    mix = mixing.mixed(table).collect()
    assert len(mix) == len(TWICE) and all(r["taken"] <= 3 * r["size"] for r in mix)
    near = minhash.near_duplicates(table).collect()
    assert len(near) == len(TWICE) and all(r["component_id"] is None and r["kept"] for r in near if r["doc_id"] is None)
    by = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near}
    assert {v for (i, _), v in by.items() if i in (2, 3)} == {2} and {v for (i, _), v in by.items() if i is None} == {None}
    classes = exact_dedup.duplicate_classes(table)
    assert classes.count() == len(TWICE) and classes.where("doc_id = 1 AND kept").count() == 1


def test_null_vector_ids(spark):
    v = [float(k) for k in range(1, 9)]
    rows = [(None, v, 1), (4, v, 1), (5, v, 1), (5, v, 1)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in got) == [(0, 0), (4, 2), (5, 2), (5, 2)]


def test_columns_with_the_names_of_results(spark):
    ranks, _ = ranks_and_twin()
    table = docs(spark, ROWS[:6]).withColumns({"ids": F.lit(1), "score": F.lit(2), "word": F.lit("w"), "places": F.lit("p"), "c0": F.lit("c")})
    out = bpe.encoded(table, ranks, public_tokenizers.PATTERN)
    assert set(out.columns) == set(table.columns) and out.where("word = 'w' AND places = 'p' AND c0 = 'c' AND score = 2").count() == 6
    model = quality.train(quality.pd.DataFrame({"text": [], "y": [], "weight": []}))
    assert quality.with_scores(table, model).where("ids = 1 AND score BETWEEN 0 AND 1").count() == 6


def test_long_words_and_newer_code_points(spark, monkeypatch):
    ranks, own = ranks_and_twin()
    rng = np.random.default_rng(8)
    texts = ["漢字かな交じり文" * 2500, "x" * 20_000, "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 3000))), "a\U00016d40\U00016d41 \U00031350\U0001e5d0 Ᲊꟍ ⿿\U0001fae9"]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    for longest in (64, 1 << 30):  # in rounds, and word by word for the last
        monkeypatch.setattr(bpe, "LONG_WORD", longest)
        use = rows if longest == 64 else [(9, texts[2][:60], "a"), rows[3]]
        for r in bpe.encoded(docs(spark, use), ranks, public_tokenizers.PATTERN).collect():
            assert list(r["ids"]) == own.encode_ordinary(r["text"])


def test_small_bounds_change_no_result(spark, monkeypatch):
    table = docs(spark, ROWS)
    ranks, own = ranks_and_twin()
    whole = {r["doc_id"]: list(r["ids"]) for r in bpe.encoded(table, ranks, public_tokenizers.PATTERN).collect()}
    monkeypatch.setattr(bpe, "TEXT_BYTES", 500)
    monkeypatch.setattr(bpe, "WORD_ROWS", 7)
    assert {r["doc_id"]: list(r["ids"]) for r in bpe.encoded(table, ranks, public_tokenizers.PATTERN).collect()} == whole
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 2)
    want = near_brute(ROWS)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table).collect()} == want
    assert {r["doc_id"] for r in minhash.drop_near_duplicates(table).collect()} == {i for i, (_, c) in want.items() if i == c}
    monkeypatch.setattr(suffix, "LONGEST_BLOCK", 3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix.without_repeats(docs(spark, ROWS[:12] + [(900, "ab" * 200, "a"), (901, "ab" * 150, "a")])).collect()}
    assert got == {i: v[:2] for i, v in suffix_brute(ROWS[:12] + [(900, "ab" * 200, "a"), (901, "ab" * 150, "a")]).items()}


def test_many_sources_are_joined_by_salt(spark, monkeypatch):
    table = docs(spark, [(k, "w " * (k % 9 + 1), f"s{k % 7}") for k in range(200)])
    want = sorted((r["doc_id"], r["taken"]) for r in mixing.mixed(table).collect())
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 2)
    assert sorted((r["doc_id"], r["taken"]) for r in mixing.mixed(table).collect()) == want


def test_few_shards_and_small_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "MAX_SHARDS", 2)
    monkeypatch.setattr(warc, "SHARD_LINES", 10)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 300)
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.org/{k}", f"<p>{k}</p>" * 40) for k in range(100)], "page_id long, url string, html string")
    _, shards = warc.archive(pages)
    got = warc.read_back(pages, shards).collect()
    assert len(got) == 100 and all(bytes(r["payload"]) == (f"<p>{r['page_id']}</p>" * 40).encode() for r in got)


def test_family_below_the_threshold_to_its_centre(spark):
    """Copies that no star links to the centre, and pairs of them that only the second round can find."""
    base = words(150, 5)
    rows = [(k, edited(base, k, 2), "a") for k in range(30)]
    for k in range(15):
        far = edited(base, 500 + k, 7)
        rows += [(100 + 2 * k, far, "a"), (101 + 2 * k, edited(far, 900 + k, 2), "a")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == near_brute(rows)


def test_quotes_and_composed_machine():
    g = toxicity.Grammar({"idiot": 2.0}, {}, (0.0, 1.0, 0.0, 0.0, 0.0))
    plain, quoted = g.features("you idiot.")[1], g.features("\"you idiot.\"")[1]
    assert quoted < plain and g.features("\" a mark alone\nyou idiot.")[1] == plain
    for symbols in ("ni", "rit", "ytt", "iii", "nrtyio"):
        for reported in (False, True):
            states, want = [0, int(reported), int("y" in symbols), 0, 0], []
            for x in symbols:
                f = 1.0
                for k, m in enumerate((toxicity.NEGATION, toxicity.REPORT, toxicity.TARGET, toxicity.INSULT, toxicity.THREAT)):
                    states[k], step = m.step(states[k], x)
                    f *= step
                want.append(f)
            assert toxicity.clause_factors(symbols, reported) == pytest.approx(want)


def test_added_spans_find_planted_secrets(spark):
    """Secrets in their usual places are found, by kind-blind overlap; dates and sums of money are not."""
    rng = np.random.default_rng(4)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(60)]
    rows = [(k, f"{words(12, k)} token = \"{h}\" {words(8, k + 500)}", "a") for k, h in enumerate(hexes)]
    rows += [(1000 + k, f"{words(10, k + 900)} on 2024-01-{k % 28 + 1:02d} for 1,250.00 in chapter {k} {words(8, k + 950)}", "a") for k in range(60)]
    text = {i: t for i, t, _ in rows}
    hit = 0
    for r in pii.personal_data(docs(spark, rows)).collect():
        added = [s for s in r["spans"] if tuple(s) not in {tuple(b) for b in r["base"]}]
        if r["doc_id"] < 1000:
            at = text[r["doc_id"]].index(hexes[r["doc_id"]])
            hit += any(s["start"] <= at and at + 40 <= s["end"] for s in added)
        else:
            assert not added
    assert hit >= 54


def test_pieces_hold_all_rows():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 10, None, "b" * 50, "", "c" * 5, "d" * 5])], ["i", "t"])
    for size in (1, 10, 12, 1000):
        assert [i for b in common.pieces([batch], 1, size) for i in b.column(0).to_pylist()] == list(range(6))


def test_bpe_words_of_a_task(spark, monkeypatch):
    """Words stay known from piece to piece, are folded once, and again when the task has forgotten them."""
    ranks, own = ranks_and_twin()
    rows = [(i, f"reatheer andertioninat number{i % 7} \u00e9{i % 3} ofhethhath " * 3, "a") for i in range(40)] + [(40, "", "a"), (41, None, "a"), (42, "zqzqzq" * 30, "a")]
    table = docs(spark, rows).coalesce(1)
    for remembered in (400_000, 0, 9):
        monkeypatch.setattr(bpe, "TEXT_BYTES", 300)
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        got = {r["doc_id"]: r for r in bpe.encoded(table, ranks, public_tokenizers.PATTERN, also=["raw", "back"]).collect()}
        assert {k: list(r["ids"]) for k, r in got.items()} == {k: own.encode_ordinary(t or "") for k, t, _ in rows}
        assert all(bytes(r["ids_back"]) == (r["text"] or "").encode() for r in got.values())
        assert all(bytes(r["ids_raw"]) == b"".join(i.to_bytes(4, "little") for i in r["ids"]) for r in got.values())


def test_bpe_plan_text_without_the_merge_table(spark):
    """The driver keeps the text of every plan that ran; it had the whole merge table in it."""
    ranks, _ = ranks_and_twin()
    for keep in (["doc_id"], None):
        plan = bpe.encoded(docs(spark, [(1, "a text", "a")]), ranks, public_tokenizers.PATTERN, keep=keep)._jdf.queryExecution().executedPlan()
        assert len(plan.toString()) < 20_000


def _dense_vectors():
    """300 vectors near one direction, 120 less near another, 80 anywhere, all of one label."""
    rng = np.random.default_rng(17)
    c, d = rng.normal(size=(2, 32))
    x = np.concatenate([c + 0.05 * rng.normal(size=(300, 32)), d + 0.26 * rng.normal(size=(120, 32)), rng.normal(size=(80, 32))])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    return [(i, [float(v) for v in e], 1) for i, e in enumerate(x)], (u @ u.T >= 0.93).sum(1) - 1


def test_dense_vectors_are_not_copied_to_every_block(spark, monkeypatch):
    rows, true = _dense_vectors()
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    plain = {r["vec_id"]: r for r in embeddings.near_vectors(table).collect()}
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "BALL_FROM", 40)
    counted, places = [], embeddings._places

    def counting(member, vectors):
        placed = places(member, vectors)
        counted.append((member.where("rep < 300").count(), placed.where("rep < 300").count()))
        return placed

    monkeypatch.setattr(embeddings, "_places", counting)
    got = {r["vec_id"]: r for r in embeddings.near_vectors(table).collect()}
    # Of the dense group each goes to the few blocks of others, or to none: by the block it would be some ten copies.
    (before, after), = counted
    assert after <= 3 * before
    assert all(got[i]["n_links"] == true[i] == 299 and got[i]["component_id"] == 0 for i in range(300))
    assert all(plain[i]["n_links"] <= got[i]["n_links"] <= true[i] for i in got) and sum(true[300:420]) > 1000
    assert {i: (r["component_id"], r["kept"]) for i, r in got.items()} == {i: (r["component_id"], r["kept"]) for i, r in plain.items()}


def test_buckets_in_rounds_give_the_same_links(spark, monkeypatch):
    table = spark.createDataFrame(_dense_vectors()[0], "vec_id long, embedding array<double>, label int")
    once = sorted(map(tuple, embeddings.near_vectors(table).collect()))
    monkeypatch.setattr(embeddings, "ROUND_BYTES", 1_000_000)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    dealt = []
    monkeypatch.setattr(embeddings, "_release", lambda spark: dealt.append(1))
    assert sorted(map(tuple, embeddings.near_vectors(table).collect())) == once and len(dealt) > 1
