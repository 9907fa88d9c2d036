"""Golden cases and agreement tests of the general operators."""

import json
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from listwright.functions import text as T
from listwright.operators import clustering, evaluation, extract, graph, mapping, matching, profile, providers, spelling, vectors
from listwright.plans import pipeline, records
from listwright.plans.pipeline import Params, run, search
from listwright.runtime import SHUFFLE_CLEANUP, broadcast_if_small, plan_bytes, stored
from listwright.sources import readers
from listwright.streaming.rows import clean_listings, first_deliveries


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_normalize_text():
    assert T.normalize_text("Ｂritannia  Good-Day™ Cookies, 200gm!") == "britannia good day cookies 200 g"
    assert T.normalize_text("Rice & Dal 1.5kg") == "rice and dal 1500 g"
    assert T.normalize_text("Atta 1kg") == T.normalize_text("ATTA 1000 gm") == "atta 1000 g"


def test_header_rules(spark):
    want = {"sale_price": "price", "brand": "brand", "manufacturer": "brand", "product_category_tree": "category", "sub_category": "sub_category", "product_url": "other", "crawl_timestamp": "other", "uniq_id": "id", "title": "product_name", "overall_rating": "rating", "quantity": "quantity"}
    df = spark.createDataFrame([(h,) for h in want], "header string")
    assert {r.header: r.f for r in df.select("header", mapping.map_by_rules(F.col("header")).alias("f")).collect()} == want
    hit = df.sparkSession.createDataFrame([("sale_price",), ("isFKAdvantage",)], "header string").select(mapping.header_tokens(F.col("header")).alias("t"), mapping.rule_hit(F.col("header")).alias("h")).collect()
    assert [(r.t, r.h) for r in hit] == [(["sale", "price"], True), (["is", "fkadvantage"], False)]


def test_canonical_table(spark):
    df = spark.createDataFrame([("Shirt", '["Clothing >> Women\'s >> Tops"]', "Rs. 999", "http://x")], "title string, category_tree string, market_price string, url string")
    out = mapping.to_canonical(df, mapping.rule_mapping(df), "shop")
    assert out.columns == ["source", *mapping.FIELDS]
    r = out.first()
    assert (r.product_name, r.category, r.sub_category, r.mrp, r.brand) == ("Shirt", "Clothing", "Women's", 999.0, None)


def test_price_conflict(spark):
    df = spark.createDataFrame([(90.0, 100.0), (180.0, 200.0)], "sale double, other double")
    assert mapping.resolve_price_conflict(df, {"sale": "price", "other": "price"}) == {"sale": "price", "other": "mrp"}
    assert mapping.resolve_price_conflict(df.where("false"), {"sale": "price", "other": "price"}) == {"sale": "price", "other": "price"}


def test_profiles(spark):
    df = spark.createDataFrame([("a",)] * 10 + [("b",)] * 10, "v string")
    assert profile.entropy(df, "v").first()[0] == 1.0
    names = spark.createDataFrame([("Tea 250 g", "A"), ("tea 250 g ", "A"), ("Coffee", "B")], "name string, brand string")
    r = profile.profile_table(names, "name", "brand").first()
    assert (r.rows, r.duplicate_names, r.duplicate_names_folded, r.brands) == (3, 0, 1, 2)
    free = spark.createDataFrame([(f"nice thing number {w} here", str(k), "x") for k, w in enumerate("abcdefghijklmnop")], "name string, sku string, kind string")
    chosen = {r.column: r.role for r in profile.select_columns(profile.column_profiles(free)).collect()}
    assert chosen == {"name": "primary", "sku": "none", "kind": "none"}
    assert profile.column_profiles(free.where("false")).count() == 0


def test_edit_distance():
    assert spelling.edit_distance("ab", "ba", 2) == 1
    assert spelling.edit_distance("choclate", "chocolate", 2) == 1
    assert spelling.edit_distance("abcdef", "ghijkl", 2) == 3


def test_corrections(spark):
    counts = spark.createDataFrame([("chocolate", 50), ("biscuit", 40), ("toaster", 1), ("toasted", 30)], "token string, count bigint")
    asked = spark.createDataFrame([("chocolat",), ("toaster",), ("tea",), (None,)], "token string")
    got = {r.token: r.word for r in spelling.corrections(asked, counts).collect()}
    assert got == {"chocolat": "chocolate", "toaster": "toasted"}
    assert spelling.corrections(asked.where("false"), counts).count() == 0


def test_spans(spark):
    df = spark.createDataFrame([("Sony black headphones black", [("brand", "SONY"), ("colour", "black headphones"), ("other", "headphones"), ("gone", "red")])], "t string, v array<struct<label string, value string>>")
    assert [tuple(s) for s in df.select(T.spans(F.col("t"), F.col("v")).alias("s")).first().s] == [(0, 4, "brand"), (5, 21, "colour")]


def test_rules_extraction(spark):
    df = spark.createDataFrame([(1, "Sony Black Headphones, 250 g"), (2, "nothing here"), (3, None)], "id int, t string")
    g = extract.brand_gazetteer(spark.createDataFrame([("Sony",), ("Sony Bravia",), ("Black",), ("x",)], "b string"))
    got = {r.id: (r.brand, r.colour, r.product_type) for r in extract.extract_rules(df, "id", "t", g).collect()}
    assert got[1] == ("Sony", "black", "headphones")
    assert got[2] == (None, None, "nothing here")
    assert got[3] == (None, None, None)


@pytest.mark.parametrize(("lenient", "recall"), [(False, 0.5), (True, 0.5)])
def test_slot_scores(spark, lenient, recall):
    pred = spark.createDataFrame([(1, "brand", "sony"), (2, "brand", "Dell")], "id int, attribute string, value string")
    gold = spark.createDataFrame([(1, "brand", ["Sony"]), (2, "brand", ["HP"])], "id int, attribute string, values array<string>")
    r = extract.slot_scores(pred, gold, "id", lenient).where("attribute = 'brand'").first()
    assert (r.precision, r.recall) == (0.5, recall)


def test_sparse_and_dense_topk_agree(spark):
    rng = np.random.default_rng(0)
    x = rng.random((9, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dense = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id bigint, v array<double>")
    sparse = dense.select("id", F.posexplode("v").alias("term", "weight"))
    a = vectors.dense_topk(dense, dense, "id", "v", 3, self_join=True, block=4)
    b = vectors.sparse_topk(sparse, sparse, 3, self_join=True)
    assert rows(a.select("query", "id", "rank")) == rows(b.select("query", "id", "rank"))


def test_char_tfidf_prefers_spelling_variants(spark):
    df = spark.createDataFrame([(1, "sony pslx350h"), (2, "sony ps lx350h turntable"), (3, "bose speaker"), (4, None)], "id int, t string")
    w = vectors.tfidf(df, "id", vectors.char_grams(F.col("t")))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "i int, j int")
    got = {r.j: r.char_cos for r in vectors.pair_cosine(pairs, w).collect()}
    assert got[2] > got[3]


def test_retrieval_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (2, 11, 1), (2, 12, 2), (2, 13, 3), (3, 14, 1)], "query int, id int, rank int")
    gold = spark.createDataFrame([(1, 10), (2, 13), (3, 99)], "query int, id int")
    assert tuple(vectors.retrieval_metrics(ranked, gold).first()) == (3, 0.3333, 0.6667, 0.4444)


def test_token_set_ratio():
    assert vectors.token_set_ratio("tata salt 1 kg", "salt tata 1 kg 1") == 1.0
    assert vectors.token_set_ratio("", "a") == 0.0
    assert 0 < vectors.token_set_ratio("abc def", "abd def") < 1


def test_code_conflict(spark):
    df = spark.createDataFrame([(["am53bk"], ["am53"]), (["pslx350h"], ["pslx250h"]), ([], ["x100"]), (None, ["x100"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(matching.codes_conflict(F.col("a"), F.col("b"))).collect()] == [False, True, False, False]


def test_hybrid_score(spark):
    df = spark.createDataFrame([(0.9, 0.7, False, False, False, False), (0.9, 0.7, True, False, False, False), (0.9, 0.7, False, False, True, False), (None, None, None, None, None, None)], "sbert double, char_cos double, qty_conflict boolean, pack_conflict boolean, brand_conflict boolean, code_conflict boolean")
    assert [r[0] for r in df.select(matching.hybrid_score(F.lit(0.5), F.lit(0.2), F.lit(0.1))).collect()] == [0.8, 0.0, 0.6, 0.0]


def test_tune_and_prf(spark):
    df = spark.createDataFrame([(s, s, False, False, False, False, y) for s, y in ((0.9, True), (0.8, True), (0.3, False), (0.2, False))], "sbert double, char_cos double, qty_conflict boolean, pack_conflict boolean, brand_conflict boolean, code_conflict boolean, label boolean")
    r = matching.tune(df).first()
    assert (r.f1, r.threshold, r.w) == (1.0, 0.8, 0.0)
    p, g = (spark.createDataFrame([(k,) for k in ks], "k int") for ks in ((1, 2, 3), (2, 3, 4, 5)))
    r = matching.pair_prf(p, g, ["k"]).first()
    assert (r.precision, r.recall, r.f1) == (0.667, 0.5, 0.571)
    report = spark.createDataFrame([(0.25, 0.9004, 0.8), (0.5, 0.7, 0.7)], "w double, threshold double, f1 double")
    assert Params.from_report(report) == Params(0.25, 0.9, True)
    assert Params.from_report(report.where("false")) == Params()


def test_components_of_chain_star_and_loops(spark):
    n = 300
    links = [(k, k + 1) for k in range(n)] + [(1000, k) for k in range(1001, 1050)] + [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000)]
    got = {r.id: r.group_id for r in graph.components(spark.createDataFrame(links, "i bigint, j bigint")).collect()}
    assert all(got[k] == 0 for k in range(n + 1))
    assert all(got[k] == 1000 for k in range(1000, 1050))
    assert 5000 not in got
    assert got[7001] == 7000


def test_components_without_edges(spark):
    empty = spark.createDataFrame([], "i bigint, j bigint")
    assert graph.components(empty).count() == 0
    assert rows(graph.components(empty, vertices=spark.createDataFrame([(1,), (1,), (None,)], "id bigint"))) == [(1, 1)]


def test_linkage_by_component_equals_linkage_of_the_whole(spark):
    rng = np.random.default_rng(3)
    for t in (0.3, 0.5, 0.7):
        sim = np.round(rng.random((12, 12)) * (rng.random((12, 12)) < 0.4), 3)
        sim = np.maximum(sim, sim.T)
        want = clustering.average_linkage(sim, t)
        df = spark.createDataFrame([(i, j, float(sim[i, j])) for i in range(12) for j in range(i + 1, 12)], "i bigint, j bigint, score double")
        got = {r.id: r.group_id for r in clustering.agglomerative(df, t).collect()}
        assert [got[k] for k in range(12)] == [int(np.where(want == want[k])[0].min()) for k in range(12)]


def test_density_clusters(spark):
    a, b = np.array([1.0, 0]), np.array([0, 1.0])
    pts = [a, a + [0, 0.05], a + [0, 0.1], b, b + [0.05, 0], b + [0.1, 0], np.array([-1.0, 0])]
    df = spark.createDataFrame([(k, (v / np.linalg.norm(v)).tolist(), 1) for k, v in enumerate(pts)], "id bigint, v array<double>, p int")
    got = {r.id: r.group_id for r in clustering.density_clusters(df, "id", "v", "p").collect()}
    assert len({got[0], got[1], got[2]}) == 1
    assert len({got[3], got[4], got[5]}) == 1
    assert got[0] != got[3]


def test_matrices_are_bounded(spark):
    pts = spark.createDataFrame([(k, [1.0, 0.0], 1) for k in range(5)], "id bigint, v array<double>, p int")
    with pytest.raises(ValueError, match="bound"):
        clustering.density_clusters(pts, "id", "v", "p", most=4)
    links = spark.createDataFrame([(k, k + 1, 0.9) for k in range(5)], "i bigint, j bigint, score double")
    with pytest.raises(ValueError, match="bound"):
        clustering.agglomerative(links, 0.5, most=4)


def test_linkage_beyond_the_matrix(spark, monkeypatch):
    n = 3102
    links = [(k, k + 1, 0.8 if k % 2 else 0.95) for k in range(n - 1)]
    got = {r.id: r.group_id for r in clustering.agglomerative(spark.createDataFrame(links, "i bigint, j bigint, score double"), 0.7).collect()}
    assert got == {k: k - k % 2 for k in range(n)}
    rng = np.random.default_rng(5)
    sim = np.triu(np.round(rng.random((16, 16)), 6), 1)
    df = spark.createDataFrame([(i, j, float(sim[i, j])) for i in range(16) for j in range(i + 1, 16)], "i bigint, j bigint, score double")
    want = clustering.average_linkage(sim + sim.T, 0.5)
    monkeypatch.setattr(clustering, "MATRIX_ROWS", 4, raising=True)
    got = {r.id: r.group_id for r in clustering.agglomerative(df, 0.5).collect()}
    assert [got[k] for k in range(16)] == [int(np.where(want == want[k])[0].min()) for k in range(16)]


def test_linkage_by_pairs_equals_linkage_by_matrix(spark, monkeypatch):
    rng = np.random.default_rng(11)
    for n, share, t in ((40, 0.2, 0.3), (60, 0.9, 0.6), (50, 0.5, 0.45), (1, 1.0, 0.5)):
        sim = np.triu(np.round(rng.random((n, n)), 2) * (rng.random((n, n)) < share), 1)
        want = clustering.average_linkage(sim + sim.T, t)
        i, j = np.nonzero(sim)
        got = clustering.sparse_linkage(i.tolist(), j.tolist(), sim[i, j].tolist(), t)
        assert [got.get(k, k) for k in range(n)] == [int(np.where(want == want[k])[0].min()) for k in range(n)]
    sim = np.triu(np.round(rng.random((16, 16)), 6), 1)
    df = spark.createDataFrame([(i, j, float(sim[i, j])) for i in range(16) for j in range(i + 1, 16)], "i bigint, j bigint, score double")
    want = clustering.average_linkage(sim + sim.T, 0.5)
    monkeypatch.setattr(clustering, "TASK_PAIRS", 4)
    got = {r.id: r.group_id for r in clustering.agglomerative(df, 0.5).collect()}
    assert [got[k] for k in range(16)] == [int(np.where(want == want[k])[0].min()) for k in range(16)]


def test_small_components_share_a_task(spark, monkeypatch):
    calls = spark.sparkContext.accumulator(0)
    own = clustering._linked

    def counted(batches, threshold, schema):
        calls.add(1)
        yield from own(batches, threshold, schema)

    monkeypatch.setattr(clustering, "_linked", counted)
    n = 20_000  # a Python call for each of so many components took minutes
    links = spark.range(n).select((F.col("id") * 2).alias("i"), (F.col("id") * 2 + 1).alias("j"), F.when(F.col("id") % 2 == 0, 0.9).otherwise(0.7).alias("score"))
    got = clustering.agglomerative(links, 0.7).groupBy("group_id").count().groupBy("count").count()
    assert dict(tuple(r) for r in got.collect()) == {2: n // 2, 1: n}
    assert calls.value <= 2 * 4


def test_search_scores_no_pair(spark, monkeypatch):
    def never(*_):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(pipeline, "_match", never)
    df = spark.createDataFrame([(1, "Mustard Oil 1 kg", "A"), (2, "Wall Clock", "B"), (3, None, "C")], "no bigint, `Item Title` string, Brand string")
    result = pipeline.run(df, key="no")
    assert [r.row_id for r in pipeline.search(result, "mustard oil 1 kg", 1).collect()] == [1]
    assert result.records.count() == 3


def test_vectors_stand_beside_all_columns(spark):
    df = spark.createDataFrame([(1, "Salt 1 kg", 2.0), (2, None, None), (3, "", 3.0)], "id bigint, t string, p double")
    got = {r.id: r for r in vectors.with_encoded(df, "t").collect()}
    plain = vectors.hashed_encoder()(["Salt 1 kg"])[0]
    assert got[1].p == 2.0 and got[1].embedding == plain.tolist()
    assert got[2].embedding is None and got[3].embedding == [0.0] * 64


def test_known_ranks_are_those_of_topk(spark, monkeypatch):
    rng = np.random.default_rng(21)
    x = rng.integers(-2, 3, (400, 8)).astype(np.float32)  # with equal vectors and a blank one
    x[7] = 0
    x /= np.maximum(1e-9, np.linalg.norm(x, axis=1, keepdims=True))
    q = x[:60] + (rng.random((60, 1)) < 0.6) * rng.normal(size=(60, 8)) * 0.2
    q = (q / np.maximum(1e-9, np.linalg.norm(q, axis=1, keepdims=True))).astype(np.float32)
    index = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(400, None)], "id bigint, v array<float>")
    asked = spark.createDataFrame([(k, k, q[k].tolist(), x[k].tolist()) for k in range(60)], "query bigint, id bigint, v array<float>, known array<float>")
    want = {r.query: r.rank for r in vectors.dense_topk(asked.select("id", "v"), index, "id", "v", 5).collect() if r.query == r.id}
    assert 5 < len(want) < 60
    for held in (32 << 20, 32 * 25):
        monkeypatch.setattr(vectors, "HELD_BYTES", held)
        assert {r.query: r["rank"] for r in vectors.known_ranks(asked, index, "id", "v", "known", 5).collect()} == want


def test_rewritten_names_take_no_topk(spark, monkeypatch):
    names = [(k, f"{a} {b} {c}") for k, (a, b, c) in enumerate((a, b, c) for a in "atta rice milk soap".split() for b in "alpha beta gamma".split() for c in ("1 kg", "2 kg", "5 kg"))]
    corpus = spark.createDataFrame(names, "id bigint, text string")
    asked = spark.createDataFrame([("same", k, t) for k, t in names] + [("lower", k, t.upper()) for k, t in names] + [("cut", k, t[2:-1] if k else None) for k, t in names] + [("cut", 99, "atta")], "form string, id bigint, text string")
    x = {t: vectors.hashed_encoder()([t])[0].astype(float) for t in {t for _, t in names} | {r.text for r in asked.collect() if r.text}}
    want = {}
    for r in asked.collect():
        s = sorted((-round(float(x[r.text] @ x[t]), 6), k) for k, t in names) if r.text else []
        at = [k for _, k in s[:10]]
        want.setdefault(r.form, []).append(at.index(r.id) + 1 if r.id in at else 0)
    monkeypatch.setattr(vectors, "_ranked", None)  # no list of neighbours is made
    got = {r.form: (r.queries, r.recall_1, r.recall_5, r.mrr) for r in evaluation.rewritten_retrieval(corpus, asked, vectors.hashed_encoder()).collect()}
    share = lambda v: round(float(np.mean(v)), 4)
    assert got == {f: (len(v), share([a == 1 for a in v]), share([0 < a <= 5 for a in v]), pytest.approx(share([1 / a if a else 0 for a in v]), abs=1e-4)) for f, v in want.items()}


@pytest.mark.parametrize("held", [32 << 20, 32 * 60])
def test_pruned_topk_is_that_of_all_pairs(spark, monkeypatch, held):
    rng = np.random.default_rng(31)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 9)) % 300) for _ in range(500)]
    texts[40:44] = [texts[20], "solo", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    grams = vectors.word_grams(F.col("t"))
    w = vectors.tfidf(df, "id", grams)
    want = vectors.sparse_topk(w.where("id % 4 = 0"), w, 3, self_join=True, digits=4)
    monkeypatch.setattr(vectors, "HELD_BYTES", held)
    packed = stored(vectors.packed_tfidf(df, "id", grams), "packed")
    again = [(r.id, round(x, 9)) for r in packed.collect() for x in r.w]
    assert sorted(again) == sorted((r.id, round(r.weight, 9)) for r in w.collect())
    monkeypatch.setattr(vectors, "_dealt", None)  # rows aren't dealt out to blocks of queries
    for rest in (0.3, 0.9, 0.0):
        monkeypatch.setattr(vectors, "REST", rest)
        assert rows(vectors.tfidf_topk(packed, F.expr("id % 4 = 0"), 3, digits=4)) == rows(want)


def test_stored_frames_leave_no_shuffle_files(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    n = tracker.shuffleStatuses().size()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count()
    assert stored(df, "t").count() == 7
    assert stored(df, "t").where("count > 142").count() == 6
    assert tracker.shuffleStatuses().size() <= n + 2  # of the two counts
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == before


def test_pair_cosine_of_packed_vectors(spark):
    df = spark.createDataFrame([(1, "sony pslx350h"), (2, "sony ps lx350h turntable"), (3, "bose speaker"), (4, None)], "id int, t string")
    grams, pairs = vectors.char_grams(F.col("t")), spark.createDataFrame([(1, 2), (1, 3), (2, 4)], "i int, j int")
    assert rows(vectors.pair_cosine(pairs, vectors.packed_tfidf(df, "id", grams))) == rows(vectors.pair_cosine(pairs, vectors.tfidf(df, "id", grams)))


def test_density_beyond_the_matrix(spark):
    rng = np.random.default_rng(6)
    angle = np.concatenate([rng.random(1550) * 0.5, 2 + rng.random(1550) * 0.5])
    df = spark.createDataFrame([(k, [float(np.cos(a)), float(np.sin(a))], 1) for k, a in enumerate(angle)], "id bigint, v array<double>, p int")
    assert clustering.density_clusters(df, "id", "v", "p").count() == 3100
    x = rng.normal(size=(300, 5))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert (clustering._density_labels(np.sqrt(np.maximum(0, 2 - 2 * x @ x.T)), 2) == clustering._density_labels(x, 2, True)).all()
    steps = np.cumsum(1.0005 ** -np.arange(3500)) * 1e-3
    chain = np.stack([np.cos(steps), np.sin(steps)], 1)
    assert len(clustering._density_labels(chain, 2, True)) == 3500


def test_fits_take_all_rows(spark):
    n = 100_400
    df = spark.range(n).select("id", F.concat(F.lit("w"), (F.col("id") / 2).cast("int").cast("string")).alias("t"))
    got = vectors.skip_gram_vectors(df, "id", "t", 4)
    assert got.where(F.exists("embedding", lambda x: x != 0)).count() == n
    odd = df.orderBy(F.xxhash64("id").desc()).first().id
    points = spark.range(n).select("id", F.array(F.when(F.col("id") == odd, -1.0).otherwise(1.0), F.lit(0.0)).alias("v"))
    alone = clustering.topics(points, "id", "v", 2).groupBy("topic").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    assert {(r.n, r.id) for r in alone.collect()} >= {(1, odd)}


def test_undecided_pairs_are_clustered(spark, tmp_path):
    rows = [(1, 2, None), (3, 4, True), (6, 5, False), (5, 6, None), (7, None, None)]
    flags = ", ".join(f"{c} boolean" for c in records._FLAGS)
    spark.createDataFrame([(i, j, y, 0.9, 0.9, *[False] * 5) for i, j, y in rows], f"i bigint, j bigint, label boolean, sbert double, char_cos double, {flags}").write.parquet(str(tmp_path / "phase5_pairs.parquet"))
    assert {r.id: r.group_id for r in records.agglomerative(spark, str(tmp_path)).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5}


def test_cluster_scores(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 2), (None, 2)], "g string, p int")
    r = clustering.cluster_scores(df, "g", "p").first()
    assert (r.n, r.ari, r.nmi) == (4, 1.0, 1.0)
    assert clustering.cluster_scores(df.where("false"), "g", "p").first().ari is None


def test_medoid_in_linear_time(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.8, 0.6]), (3, "a", [0.0, 1.0])], "id int, g string, v array<double>")
    assert clustering.medoids(df, "g", "id", "v").first().id == 2


def test_ask_caches_validates_and_gives_up(spark):
    def provider(prompt):
        if prompt == "bad":
            return json.dumps({"x": 1})
        if prompt == "down":
            raise TimeoutError
        return json.dumps({"name": prompt.upper()})

    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "bad"), (4, "down"), (5, None)], "k int, prompt string")
    met, fresh = providers.ask(df, "prompt", provider, lambda r: "name" in r)
    got = {r.k: r.name for r in met.select("k", providers.json_field(F.col("response"), "name").alias("name")).collect()}
    assert got == {1: "A", 2: "A", 3: None, 4: None, 5: None}
    assert fresh.count() == 1
    again, new = providers.ask(df, "prompt", lambda p: 1 / 0, lambda r: True, cache=fresh)
    assert new.count() == 0
    assert again.where("response is not null").count() == 2


def test_batches_keep_order_and_void_wrong_lengths(spark):
    df = spark.createDataFrame([(k, str(k)) for k in range(25)], "k bigint, t string")
    assert {r.batch: r["keys"] for r in providers.batches_of(df, "k", "t", 10).collect()}[2] == [20, 21, 22, 23, 24]
    b = spark.createDataFrame([([1, 2], '{"labels": ["x", "y"]}'), ([3, 4], '{"labels": ["x"]}'), ([5], '{"labels": ["q"]}')], "keys array<int>, response string")
    assert rows(providers.batch_labels(b, ["x", "y"])) == [(1, "x"), (2, "y"), (3, None), (4, None), (5, None)]


def test_pipeline_end_to_end(spark):
    raw = spark.createDataFrame(
        [(1, "Tata Salt 1kg", "Tata"), (2, "TATA SALT 1000 gm", "tata"), (3, "Amul Butter 500 g", "Amul"), (4, "Amul Butter 100 g", "Amul"), (5, "Fortune Sunflower Oil 1 ltr", "Fortune"), (6, "Fortune Sunflower Oil 1 litre", "Fortune")],
        "no bigint, `Item Title` string, Brand string",
    )
    result = run(raw, key="no")
    got = {r.cluster_id: r.size for r in result.clusters.collect()}
    assert got[1] == 2 and got[5] == 2 and got[3] == 1 and got[4] == 1
    assert {r.row_id for r in search(result, "sunflower oil 1 litre", 2).collect()} == {5, 6}


def test_copies_stay_together_whatever_their_number(spark):
    names = [(k, "Tata Salt 1kg", "Tata") for k in range(40)] + [(100 + k, f"Fresh Toor Dal Unpolished Premium Quality Natural {chr(97 + k // 6) * 2}{chr(97 + k % 6)} 500 g", "Dal") for k in range(36)] + [(200, "", None), (201, "", None)]
    result = run(spark.createDataFrame(names, "no bigint, `Item Title` string, Brand string"), key="no", params=Params(threshold=0.7))
    got = {r.cluster_id: r.size for r in result.clusters.collect()}
    assert got == {0: 40, 100: 36, 200: 1, 201: 1}
    # copies that differ in what a conflict reads don't follow
    prices = [(k, "Tata Salt 1kg", "Tata", 20.0 if k % 2 else 90.0) for k in range(40)]
    result = run(spark.createDataFrame(prices, "no bigint, `Item Title` string, Brand string, mrp double"), key="no", params=Params(use_mrp=True))
    assert {r.cluster_id: r.size for r in result.clusters.collect()} == {0: 20, 1: 20}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("index,product\n1,Tea\n2,\"Coffee, ground\"\n")
    (tmp_path / "b.txt").write_text("# taxonomy\nFood > Tea > Green\nHome\n\n")
    (tmp_path / "c.tsv").write_text('code\tcountries\n1\ten:india "x\n2\ten:france\n')
    (tmp_path / "d.csv").write_text("a;b\n1;2\n3;4\n")
    assert readers.read_csv_folder(spark, str(tmp_path)).count() == 2
    assert readers.read_catalogue_csv(spark, str(tmp_path / "a.csv"), "index").columns == ["product"]
    assert rows(readers.read_taxonomy(spark, str(tmp_path / "b.txt"))) == [("Food > Tea > Green", "Food", 3), ("Home", "Home", 1)]
    readers.filter_to_parquet(spark, str(tmp_path / "c.tsv"), str(tmp_path / "out"), ["code"], "countries", "en:india")
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [("1",)]
    assert readers.read_upload(spark, str(tmp_path / "d.csv"), 1).columns == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        readers.read_csv_folder(spark, str(tmp_path / "none"))
    for kind in ("parquet", "json", "csv"):
        readers.write_table(spark.range(2), str(tmp_path / kind), kind)
    gold = '{"id": "1", "category": "c", "input_title": "t", "target_scores": {"Brand": {"Sony": {"pid": [0, 1]}, "n/a": {"pid": [0]}}}}'
    (tmp_path / "g.jsonl").write_text(gold + "\n")
    pairs = extract.attribute_pairs(readers.read_attribute_gold(spark, str(tmp_path / "g.jsonl")), "id", "target_scores")
    assert rows(extract.title_values(pairs, "id").select("attribute", F.array_join("values", ","))) == [("Brand", "Sony")]


def test_streamed_rows_equal_batch_rows(spark, tmp_path):
    schema = "row_id bigint, product_name string"
    src = spark.createDataFrame([(1, "Atta 1kg"), (2, None)], schema)
    src.write.parquet(str(tmp_path / "in"))
    stream = clean_listings(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("cleaned").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("cleaned")) == rows(clean_listings(src))


def test_late_first_deliveries_are_kept(spark, tmp_path):
    schema = "row_id bigint, crawl_timestamp timestamp"
    for k, batch in enumerate(([(1, "2024-03-31")], [(3, "2024-04-01")], [(2, "2024-01-01"), (1, "2024-03-31")], [(2, "2024-01-01"), (3, "2024-06-30")])):
        spark.createDataFrame(batch, "row_id bigint, t string").selectExpr("row_id", "t::timestamp as crawl_timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"d={k}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = first_deliveries(source, "row_id").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.row_id for r in spark.table("firsts").collect()) == [1, 2, 3]


def test_stored_frames_and_guarded_broadcasts(spark):
    df = stored(spark.range(5), "t")
    assert df.count() == 5
    assert plan_bytes(df) > 0
    assert broadcast_if_small(df, 0) is df




def _unit_rows(spark, n, width=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, width))
    x = centres[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return spark.createDataFrame([(k, v.astype(np.float32).tolist(), "x") for k, v in enumerate(x)] + [(n, None, "x")], "id bigint, v array<float>, score string"), x


def test_exact_topk_in_blocks_equals_brute_force(spark):
    df, x = _unit_rows(spark, 300)
    whole = {(r.query, r["rank"]): (r.id, r.score) for r in vectors.dense_topk(df, df, "id", "v", 5, self_join=True).collect()}
    blocks = {(r.query, r["rank"]): (r.id, r.score) for r in vectors.dense_topk(df, df, "id", "v", 5, self_join=True, block=70).collect()}
    assert whole == blocks and len(whole) == 1500
    s = np.round(x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T, 6)
    np.fill_diagonal(s, -9)
    assert all(abs(whole[q, 1][1] - s[q].max()) < 1e-6 for q in range(300))
    assert vectors.dense_topk(df.where("false"), df, "id", "v", 5).count() == 0 == vectors.dense_topk(df, df.where("false"), "id", "v", 5).count()


def test_near_topk_finds_nine_in_ten_and_splits_hot_cells(spark):
    df, _ = _unit_rows(spark, 3000)
    df = df.union(df.where("id < 3000").limit(1).selectExpr("explode(sequence(5000, 5800)) AS id", "v", "score"))  # one vector 801 times
    pairs = lambda got: {(r.query, r.id) for r in got.collect()}
    queries = df.where("id % 10 = 0 and id < 3000")
    exact = pairs(vectors.dense_topk(queries, df, "id", "v", 10, self_join=True))
    near = pairs(vectors.near_topk(queries, df, "id", "v", 10, self_join=True, cell_rows=100, probes=8, block=64))
    assert len(near & exact) >= 0.9 * len(exact)
    assert vectors.near_topk(df.where("false"), df.where("false"), "id", "v", 3).count() == 0


def test_medoids_pass_over_nulls(spark):
    df = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.8, 0.6]), ("a", 3, [0.0, 1.0]), ("b", 4, None), (None, 5, [1.0, 0.0])], "g string, k int, v array<double>")
    assert rows(clustering.medoids(df, "g", "k", "v").select("g", "k")) == [("a", 2), (None, 5)]
    assert clustering.medoids(df.where("false"), "g", "k", "v").count() == 0


def test_batches_keep_the_order_of_keys(spark):
    df = spark.createDataFrame([(k * 40_000_000, f"t{k}") for k in range(25)], "k bigint, t string")
    got = {r.batch: r.texts for r in providers.batches_of(df, "k", "t", 10).collect()}
    assert [x for b in sorted(got) for x in got[b]] == [f"t{k}" for k in range(25)] and len(got) == 3


def test_settings_shrink_where_memory_runs_out():
    seen = []

    def chat(prompt, options):
        seen.append(options)
        if len(seen) == 1:
            raise RuntimeError("CUDA error: out of memory")
        if len(seen) == 2:
            raise RuntimeError("model needs more: out of memory")
        return "{}"

    assert providers.laddered(chat)("x") == "{}"
    assert [(o.get("num_gpu"), o["num_ctx"]) for o in seen] == [(None, 2048), (12, 2048), (12, 1024)]
    with pytest.raises(RuntimeError, match="3 times"):
        providers.laddered(lambda p, o: (_ for _ in ()).throw(MemoryError("out of memory")))("x")
    with pytest.raises(ValueError, match="bad"):
        providers.laddered(lambda p, o: (_ for _ in ()).throw(ValueError("bad")))("x")


def test_best_spans_and_typed_records(spark):
    spans = spark.createDataFrame([(1, "brand", "b", 5, 0.9), (1, "brand", "a", 2, 0.9), (1, "colour", "c", 1, 0.3), (2, "brand", None, 1, 0.9)], "k int, label string, value string, start int, score double")
    assert rows(extract.best_spans(spans, "k")) == [(1, "brand", "a", 0.9)]
    names = spark.createDataFrame([(1, "good"), (2, "wrong pack"), (3, "other field"), (4, None)], "k int, name string")
    reply = lambda p: json.dumps({"brand": "b", "pack_count": 2} if "good" in p else {"pack_count": 0} if "pack" in p else {"shape": "x"})
    assert rows(extract.extract_record(names, "k", "name", reply).select("k", "brand", "pack_count")) == [(1, "b", 2), (2, None, None), (3, None, None), (4, None, None)]


def test_configurations_errors_and_costs(spark):
    cols = "i int, j int, sbert double, char_cos double, qty_conflict boolean, pack_conflict boolean, brand_conflict boolean, code_conflict boolean, label boolean, is_val boolean"
    data = [(k, k + 1, 0.9, 0.8, False, False, None, False, True, k % 2 == 0) for k in range(6)] + [(k, k + 9, 0.9, 0.8, True, False, False, False, False, k % 2 == 0) for k in range(6)] + [(1, 2, None, None, None, None, None, None, None, True)]
    df = spark.createDataFrame(data, cols)
    got = {r.config: (r.f1, r.tp, r.fp) for r in evaluation.configuration_report(df).collect()}
    assert len(got) == 5 and got["hybrid with all rules"] == (1.0, 3, 0) and got["char only"] == (0.667, 3, 3)
    wrong = evaluation.error_pool(df.withColumn("score", F.lit(0.8)).withColumn("d", F.lit("x")), "d", 0.5, 2)
    assert [(r.i, r.gold, r.predicted, r.rules) for r in wrong.orderBy("i").collect()] == [(0, False, True, "qty_conflict"), (1, False, True, "qty_conflict")]
    assert evaluation.configuration_report(df.where("false")).count() == 0
    assert [(c["stage"], c["rows"]) for c in evaluation.stage_costs({"a": lambda: spark.range(7)})] == [("a", 7)]


def test_offers_are_chosen_by_name(spark, tmp_path):
    (tmp_path / f"{readers.offer_file('offers', 80, 'gs', '', 50)}.json").write_text('{"id": 1}\n')
    assert rows(readers.read_offers(spark, str(tmp_path), "id int", unseen=50)) == [(1,)]
    with pytest.raises(FileNotFoundError):
        readers.read_offers(spark, str(tmp_path), "id int", split="train")


def test_all_quantities(spark):
    got = spark.createDataFrame([("2 kg and 500 g, .5l",), ("none 5 kgx",), (None,)], "t string").select(T.all_quantities(F.col("t")).alias("q")).collect()
    assert [[(x.value, x.unit) for x in r.q] for r in got] == [[(2.0, "kg"), (500.0, "g"), (0.5, "l")], [], []]


def test_clean_names(spark):
    df = spark.createDataFrame([(1, "Choc Biscuits™ 2 kg, Pack of 3"), (1, "Choc Biscuits™ 2 kg, Pack of 3"), (2, None), (3, ""), (4, "Wireeless & router 500GM")], "k int, name string")
    fixes = spark.createDataFrame([("wireeless", "wireless")], "token string, word string")
    got = {r.k: tuple(r)[1:] for r in spelling.clean_names(df, "k", "name", fixes).collect()}
    assert got[1] == ("chocolate biscuits 2000 g pack of 3", "chocolate biscuit 2000 g pack of 3", 2000.0, "g", 3)
    assert got[2] == (None, None, None, None, None) and got[3][:2] == ("", "")
    assert got[4] == ("wireless and router 500 g", "wireless and router 500 g", 500.0, "g", None)
    assert spelling.clean_names(df.where("false"), "k", "name").count() == 0


def test_folding_few_or_many_characters_is_the_same():
    from listwright.functions import charfold

    mapped = list(charfold._drawn())
    for some in (mapped[:5], mapped[::97], mapped):
        text = "a " + " b".join(some) + " é é"
        whole = " ".join(unicodedata.normalize("NFC", text.translate(charfold._whole())).split())
        assert charfold.fold(text) == whole and charfold.fold(whole) == whole
    assert charfold.fold(None) is None and charfold.fold("") == "" == charfold.fold(" ​")
