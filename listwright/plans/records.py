"""Queries on vectors, blocking, pair scores, clusters, language-model steps and the whole pipeline, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from listwright.functions import text as T
from listwright.operators import clustering, evaluation, graph, mapping, matching, providers, vectors
from listwright.plans.pipeline import run, run_benchmark, search
from listwright.plans.tables import L, ONCE, _UNIT_ROWS, listings
from listwright.runtime import stored, table

P = "phase5_pairs"


def _pairs(spark, sf_dir, undecided=False):
    """Distinct scored pairs of the pair table, each unordered pair once with its greatest scores and agreed label; ``undecided`` rows have no label."""
    df = table(spark, sf_dir, P).where("i is not null and j is not null and i <> j")
    df = df if undecided else df.where("label is not null")
    ends = df.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "label", "sbert", F.col("char_cos"), *[c for c in df.columns if c.endswith("_conflict") or c == "is_val"])
    return ends.groupBy("i", "j").agg(F.bool_and("label").alias("label"), F.max("sbert").alias("sbert"), F.max("char_cos").alias("char_cos"), *[F.bool_or(c).alias(c) for c in ends.columns if c.endswith("_conflict") or c == "is_val"])


_FLAGS = ["qty_conflict", "pack_conflict", "brand_conflict", "code_conflict", "mrp_conflict"]
PAIRS = f"(SELECT least(i, j) AS i, greatest(i, j) AS j, bool_and(label) AS label, bool_or(is_val) AS is_val, max(sbert) AS sbert, max(char_cos) AS char_cos, {', '.join(f'bool_or({c}) AS {c}' for c in _FLAGS)} FROM {P} WHERE i IS NOT NULL AND j IS NOT NULL AND i <> j AND label IS NOT NULL GROUP BY 1, 2)"
_VETO = "coalesce(qty_conflict, false) OR coalesce(pack_conflict, false)"
_HYBRID = f"round(CASE WHEN {_VETO} THEN 0.0 ELSE w * coalesce(sbert, 0.0) + (1 - w) * coalesce(char_cos, 0.0) - CASE WHEN coalesce(brand_conflict, false) THEN bp ELSE 0.0 END - CASE WHEN coalesce(code_conflict, false) THEN mp ELSE 0.0 END END, 6)"
HYBRID = f"(SELECT *, {_HYBRID} AS score FROM (SELECT *, 0.5 AS w, 0.2 AS bp, 0.1 AS mp FROM {PAIRS}))"


def _hybrid(spark, sf_dir, undecided=False):
    return _pairs(spark, sf_dir, undecided).withColumn("score", matching.hybrid_score(F.lit(0.5), F.lit(0.2), F.lit(0.1)))


# vectors


def _names(spark, sf_dir):
    return listings(spark, sf_dir, "name_clean").select(F.col("row_id").alias("id"), "name_clean")


_NAMES_SQL = f"(SELECT row_id AS id, name_clean FROM {ONCE})"


def word_tfidf(spark, sf_dir):
    return vectors.tfidf(_names(spark, sf_dir), "id", vectors.word_grams(F.col("name_clean"))).select("id", "term", F.round("weight", 6).alias("weight"))


def char_tfidf(spark, sf_dir):
    return vectors.tfidf(_names(spark, sf_dir), "id", vectors.char_grams(F.col("name_clean"))).select("id", "term", F.round("weight", 6).alias("weight"))


def _tfidf_sql(grams: str) -> str:
    return f"""g AS ({grams}), t AS (SELECT id, term, count(*) AS c FROM g GROUP BY id, term), n AS (SELECT count(DISTINCT id) AS n FROM {_NAMES_SQL}),
i AS (SELECT term, ln((1 + (SELECT n FROM n)) / (1.0 + count(*))) + 1 AS idf FROM t GROUP BY term), r AS (SELECT id, term, (1 + ln(c)) * idf AS w FROM t JOIN i USING (term)),
v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM r)"""


_WORDS = f"SELECT id, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS term FROM (SELECT id, regexp_extract_all(lower(name_clean), '[a-z0-9]+') AS w FROM {_NAMES_SQL})"
_CHARS = f"SELECT id, unnest(flatten(list_transform([3, 4, 5], lambda n: CASE WHEN length(w) > n THEN list_transform(range(1, length(w) - n + 2), lambda k: substr(w, k, n)) WHEN length(w) = n OR n = 3 THEN [w] ELSE [] END))) AS term FROM (SELECT id, ' ' || w || ' ' AS w FROM (SELECT id, unnest(string_split_regex(lower(name_clean), '\\s+')) AS w FROM {_NAMES_SQL}) WHERE w <> '')"


def word_tfidf_topk(spark, sf_dir):
    packed = stored(vectors.packed_tfidf(_names(spark, sf_dir), "id", vectors.word_grams(F.col("name_clean"))), "packed")
    return vectors.tfidf_topk(packed, F.expr("id % 100 = 0"), 3, digits=4)


def _queries(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return df.where("vec_id % 100 = 0"), df


_DOT = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 4)"


def dense_topk(spark, sf_dir):
    q, df = _queries(spark, sf_dir)
    return vectors.dense_topk(q, df, "vec_id", "embedding", 5, self_join=True, digits=4)


def retrieval_metrics(spark, sf_dir):
    q, df = _queries(spark, sf_dir)
    top = vectors.dense_topk(q, df, "vec_id", "embedding", 10, self_join=True, digits=4)
    gold = q.select(F.col("vec_id").alias("query"), "label").join(df.select(F.col("vec_id").alias("id"), "label"), "label").where("query <> id")
    return vectors.retrieval_metrics(top, gold)


_TOP = f"SELECT a.vec_id AS query, b.vec_id AS id, a.label = b.label AS gold, s AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS rank FROM (SELECT a, b, {_DOT} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)"


def semantic_search(spark, sf_dir):
    q, df = _queries(spark, sf_dir)
    return vectors.dense_topk(q.where("vec_id = 100"), df, "vec_id", "embedding", 10, digits=4).select("id", "score", "rank")


def categorize_centroid(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    means = df.select("label", F.posexplode("embedding").alias("d", "x")).groupBy("label", "d").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("m"))
    labels = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("v")).select("label", F.col("v.m").alias("label_vector"))
    return vectors.categorize(df, "vec_id", "embedding", labels).select("vec_id", "label")


def token_set_ratio(spark, sf_dir):
    df = listings(spark, sf_dir, "name_clean")
    pairs = _pairs(spark, sf_dir, undecided=True).select("i", "j").join(df.select(F.col("row_id").alias("i"), F.col("name_clean").alias("a")), "i").join(df.select(F.col("row_id").alias("j"), F.col("name_clean").alias("b")), "j")
    return vectors.with_token_set_ratio(pairs, "a", "b").select("i", "j", "fuzzy")


def encoded_names(spark, sf_dir):
    return vectors.encoded(_names(spark, sf_dir), "id", "name_clean")


def skip_gram_vectors(spark, sf_dir):
    return vectors.skip_gram_vectors(listings(spark, sf_dir, "name_clean"), "row_id", "name_clean", 16)


# blocking, features, scores


def block_topk_union(spark, sf_dir):
    q, df = _queries(spark, sf_dir)
    left, right = q, df.where("vec_id % 100 <> 0")
    ahead, back = vectors.dense_topk(left, right, "vec_id", "embedding", 5, digits=4), vectors.dense_topk(right, left, "vec_id", "embedding", 1, digits=4)
    return matching.block(ahead, back)


_SIDES = f"SELECT a.vec_id AS l, b.vec_id AS r, s FROM (SELECT a, b, {_DOT} AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND b.vec_id % 100 <> 0)"


def block_brand(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("brand"))
    b = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_nationkey").alias("brand"))
    return matching.block(a.select(F.col("id").alias("query"), "id").where("false"), brands=(a, b))


def self_block(spark, sf_dir):
    q, df = _queries(spark, sf_dir)
    return matching.self_block(vectors.dense_topk(df, df, "vec_id", "embedding", 3, self_join=True, digits=4))


def blocking_quality(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    ids = listings(spark, sf_dir).select("row_id")
    return matching.blocking_quality(p.where("char_cos >= 0.7").select("i", "j"), p.where("label").select("i", "j"), ids, ids)


def pair_features(spark, sf_dir):
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding")
    own = listings(spark, sf_dir, "brand", "qty_value", "qty_unit", "pack_count", "mrp", "name_clean").join(vec, "row_id", "left")
    records = own.withColumn("codes", T.model_codes(F.col("name_clean"))).withColumnRenamed("row_id", "id")
    met = matching.pair_features(_pairs(spark, sf_dir, undecided=True), records)
    return met.withColumn("sbert", F.round("sbert", 4))


def hybrid_score(spark, sf_dir):
    return _hybrid(spark, sf_dir, undecided=True).select("i", "j", "score")


def catalogue_score(spark, sf_dir):
    return _pairs(spark, sf_dir, undecided=True).select("i", "j", matching.catalogue_score(0.25).alias("score"))


def tune_grid(spark, sf_dir):
    return matching.tune(_pairs(spark, sf_dir))


def best_threshold(spark, sf_dir):
    return matching.best_threshold(_hybrid(spark, sf_dir).withColumn("config", F.lit("hybrid")), ["config"])


def pair_prf(spark, sf_dir):
    s = _hybrid(spark, sf_dir)
    return matching.pair_prf(s.where("score >= 0.6"), s.where("label"), ["i", "j"])


def split_ids(spark, sf_dir):
    return matching.split_ids(table(spark, sf_dir, L), "row_id")


def stratified_pairs(spark, sf_dir):
    return matching.stratified_pairs(_hybrid(spark, sf_dir, undecided=True).where("not coalesce(brand_conflict, false)"), 20)


def configuration_report(spark, sf_dir):
    return evaluation.configuration_report(_pairs(spark, sf_dir))


def error_pool(spark, sf_dir):
    return evaluation.error_pool(_hybrid(spark, sf_dir).withColumn("dataset", F.when(F.col("is_val"), "val").otherwise("test")), "dataset", 0.6)


def rewritten_retrieval(spark, sf_dir):
    names = stored(listings(spark, sf_dir, "name_clean").where("name_clean is not null").groupBy(F.col("name_clean").alias("text")).agg(F.min("row_id").alias("id")), "names")
    forms = {"casual": F.lower("text"), "hinglish": F.coalesce(T.to_hinglish(F.col("text")), F.lower("text")), "variants": evaluation.spelling_variant(F.col("text"), _spellings()), "typos": F.array_join(F.transform(F.split("text", " "), T.add_typo), " ")}
    asked = names.where("id % 100 = 0").select("id", F.explode(F.array(*[F.struct(F.lit(n).alias("form"), c.alias("text")) for n, c in forms.items()])).alias("q")).select("id", "q.*")
    return evaluation.rewritten_retrieval(names, asked, vectors.hashed_encoder())


SPELLED = {"salt": ["namak", "nammak"], "rice": ["chawal", "chaval", "chaawal"], "soap": ["sabun", "saabun"], "flour": ["atta", "aata"], "milk": []}


def _spellings():
    return F.create_map(*[x for k, vs in SPELLED.items() for x in (F.lit(k), F.array(*map(F.lit, vs)).cast("array<string>"))])


def spelling_variants(spark, sf_dir):
    return table(spark, sf_dir, L).where("name_clean is not null").select("row_id", evaluation.spelling_variant(F.col("name_clean"), _spellings()).alias("variant")).distinct()


def ablation_pivot(spark, sf_dir):
    s = _pairs(spark, sf_dir).withColumn("dataset", F.when(F.col("i") % 2 == 0, "even").otherwise("odd"))
    long = s.select("dataset", "label", F.explode(F.array(*[F.struct(F.lit(n).alias("config"), c.alias("score")) for n, c in (("char", F.coalesce("char_cos", F.lit(0.0))), ("rules", matching.catalogue_score(0.0)))])).alias("x")).select("dataset", "label", "x.*")
    return matching.ablation(long, "config", "dataset", spark.createDataFrame([("char", 0.7), ("rules", 0.7)], "config string, threshold double"))


def grey_zone_band(spark, sf_dir):
    return matching.grey_zone(_hybrid(spark, sf_dir, undecided=True), 0.7).select("i", "j", "score")


def grey_zone_budget(spark, sf_dir):
    return matching.grey_zone_budget(_hybrid(spark, sf_dir, undecided=True), 0.7, 25).select("i", "j", "score")


def adjudicated_pairs(spark, sf_dir):
    s = _hybrid(spark, sf_dir)
    answers = matching.grey_zone(s, 0.7).select("i", "j", F.when(F.col("i") % 3 > 0, F.col("label")).alias("same"))
    return matching.adjudicated(s, 0.7, answers)


def classification_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "documents").withColumn("guess", F.when(F.col("doc_id") % 7 > 0, F.col("doc_type")).when(F.col("doc_id") % 14 == 0, "review"))
    return matching.classification_metrics(df, "doc_type", "guess")


def per_class_sample(spark, sf_dir):
    return matching.per_class_sample(table(spark, sf_dir, "documents"), "doc_type", "doc_id", 20)


# clusters


def components(spark, sf_dir):
    return graph.components(table(spark, sf_dir, P).where("label"))


def threshold_components(spark, sf_dir):
    ids = listings(spark, sf_dir).select(F.col("row_id").alias("id"))
    return clustering.threshold_components(_hybrid(spark, sf_dir, undecided=True), 0.8, ids)


def _reach(edges: str) -> str:
    return f"""WITH RECURSIVE e AS ({edges}), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, low) AS (SELECT DISTINCT a, a FROM s UNION SELECT s.b, r.low FROM r JOIN s ON s.a = r.id WHERE r.low < s.b), g AS (SELECT id, min(low) AS group_id FROM r GROUP BY id)"""


def agglomerative(spark, sf_dir):
    return clustering.agglomerative(_hybrid(spark, sf_dir, undecided=True), 0.75)


def resplit_components(spark, sf_dir):
    ids = listings(spark, sf_dir).select(F.col("row_id").alias("id"))
    return clustering.agglomerative(_hybrid(spark, sf_dir, undecided=True), 0.7, ids, only_above=30)


def density_clusters(spark, sf_dir):
    return clustering.density_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")


def _grouped(spark, sf_dir):
    got = clustering.threshold_components(_hybrid(spark, sf_dir, undecided=True), 0.8, listings(spark, sf_dir).select(F.col("row_id").alias("id")))
    return listings(spark, sf_dir, "brand").join(got.withColumnRenamed("id", "row_id"), "row_id")


def cluster_metrics(spark, sf_dir):
    return clustering.cluster_scores(_grouped(spark, sf_dir), "brand", "group_id").select("n", "gold_clusters", "pred_clusters", F.round("ari", 4).alias("ari"), F.round("nmi", 4).alias("nmi"))


def cluster_sizes(spark, sf_dir):
    return clustering.cluster_sizes(graph.components(table(spark, sf_dir, P).where("label")), "group_id")


def medoids(spark, sf_dir):
    return clustering.medoids(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id")


# language-model steps with a deterministic stub


def _stub(prompt: str) -> str:
    if len(prompt) % 11 == 0:
        raise TimeoutError("no answer")
    return json.dumps({"name": prompt.partition(": ")[2].split(" | ")[0][:120], "labels": [w[:1] for w in prompt.split("\n")[1:]]})


def ask_json(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("One name for: "), "p_name").alias("prompt"))
    met, _ = providers.ask(df, "prompt", _stub, lambda r: bool(r.get("name")))
    return met.select("p_partkey", providers.json_field(F.col("response"), "name").alias("name"))


def canonical_names(spark, sf_dir):
    c = table(spark, sf_dir, "phase6_canonical_names").select("cluster_id", "members", "medoid_name").distinct()
    return providers.canonical_names(c, _stub)


def category_batches(spark, sf_dir):
    b = providers.batches_of(table(spark, sf_dir, "part"), "p_partkey", "p_name", 10)
    asked, _ = providers.ask(b.withColumn("prompt", F.concat(F.lit("labels\n"), F.array_join("texts", "\n"))), "prompt", _stub, lambda r: isinstance(r.get("labels"), list))
    return providers.batch_labels(asked, [*"abcdefghijklmnopqrstuvwxyz"])


def adjudicate_names(spark, sf_dir):
    names = listings(spark, sf_dir, "name_clean")
    zone = matching.grey_zone(_hybrid(spark, sf_dir, undecided=True), 0.7).select("i", "j").join(names.select(F.col("row_id").alias("i"), F.col("name_clean").alias("a")), "i").join(names.select(F.col("row_id").alias("j"), F.col("name_clean").alias("b")), "j")
    return providers.adjudicate(zone, "a", "b", lambda p: json.dumps({"same": p.count("kg") % 2 == 0, "reason": "stub"})).select("i", "j", "same")


def hinglish_rewrites(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return providers.rewrites(df, "p_partkey", "p_name", "red|blue", lambda p: json.dumps({"text": p[9:].upper()}))


def header_scores(spark, sf_dir):
    headers = spark.createDataFrame([("product_title",), ("selling_price",), ("brand_name",)], "header string")
    return mapping.map_headers(headers, mapping.embedding_scores(headers, vectors.hashed_encoder()), threshold=0.3)


def slot_values(spark, sf_dir):
    return table(spark, sf_dir, L).select("row_id", T.norm_value("quantity", F.col("quantity")).alias("quantity"), T.norm_value("pack_count", F.col("pack_count").cast("string")).alias("pack"), T.norm_value("brand", F.col("brand")).alias("brand")).distinct()


#: .40 to .95 in steps of .025.
GRID = [round(0.4 + 0.025 * k, 3) for k in range(23)]


def threshold_grid(spark, sf_dir):
    gold = listings(spark, sf_dir, "brand").where("brand is not null").select(F.col("row_id").alias("id"), F.lower(F.trim("brand")).alias("gold"))
    return clustering.threshold_grid(_hybrid(spark, sf_dir, undecided=True), gold, GRID)


def topics(spark, sf_dir):
    return clustering.topics(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10)


# the whole


def two_table_benchmark(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    first = df.groupBy("p_name", "p_size").agg(F.min("id").alias("id"))
    a = first.select("id", F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("kg")).alias("text"), F.lit(None).cast("string").alias("brand"))
    b = first.select("id", F.concat(F.upper("p_name"), F.lit("  "), (F.col("p_size") * 1000).cast("string"), F.lit(" gm")).alias("text"), F.lit(None).cast("string").alias("brand"))
    return run_benchmark(a, b, first.select(F.col("id").alias("i"), F.col("id").alias("j"))).test


def _raw(spark, sf_dir):
    """Listings as they come, under the headers of a shop's export."""
    df = listings(spark, sf_dir, "product_name", "brand", "category", "price", "mrp")
    return df.select(F.col("row_id").alias("sku"), F.col("product_name").alias("title"), "brand", "category", F.col("price").alias("sale_price"), F.col("mrp").alias("retail_price"))


def dedupe_pipeline(spark, sf_dir):
    return run(_raw(spark, sf_dir), key="sku").clusters


def pipeline_search(spark, sf_dir):
    return search(run(_raw(spark, sf_dir), key="sku"), "mustard oil 1 kg", 5).select("row_id", "rank")


_LIST = """word_tfidf char_tfidf word_tfidf_topk dense_topk retrieval_metrics semantic_search categorize_centroid token_set_ratio encoded_names skip_gram_vectors
block_topk_union block_brand self_block blocking_quality pair_features hybrid_score catalogue_score tune_grid best_threshold pair_prf split_ids stratified_pairs
ablation_pivot configuration_report error_pool rewritten_retrieval spelling_variants grey_zone_band grey_zone_budget adjudicated_pairs classification_metrics per_class_sample components threshold_components agglomerative
resplit_components density_clusters cluster_metrics cluster_sizes medoids ask_json canonical_names category_batches adjudicate_names hinglish_rewrites header_scores slot_values threshold_grid topics two_table_benchmark dedupe_pipeline pipeline_search"""
QUERIES = {n: globals()[n] for n in _LIST.split()}

_JOINED = "lower(name_clean)"
for _ in range(3):  # a mark between two others is joined in a later round
    _JOINED = f"regexp_replace({_JOINED}, '([a-z0-9])[-/.]([a-z]*[0-9])', '\\1\\2', 'g')"
_F1 = lambda tp, fp, fn: f"round(coalesce(2.0 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0.0), 3)"
_SCORED = f"(SELECT *, {_HYBRID} AS score FROM {PAIRS}, (VALUES (0.0), (0.25), (0.5), (0.75), (1.0)) a(w), (VALUES (0.0), (0.1), (0.2)) b(bp), (VALUES (0.0), (0.1), (0.2)) c(mp))"
_CURVE = f"SELECT w, bp, mp, score, sum(sum(CASE WHEN label THEN 1 ELSE 0 END)) OVER (PARTITION BY w, bp, mp ORDER BY score DESC) AS tp, sum(count(*)) OVER (PARTITION BY w, bp, mp ORDER BY score DESC) AS k FROM {_SCORED} GROUP BY w, bp, mp, score"
_CAT = "CASE WHEN coalesce(qty_conflict, false) OR coalesce(pack_conflict, false) OR coalesce(brand_conflict, false) OR coalesce(mrp_conflict, false) THEN 0.0 ELSE {w} * coalesce(sbert, 0.0) + (1 - {w}) * coalesce(char_cos, 0.0) END"

ORACLES = {
    "word_tfidf": f"WITH {_tfidf_sql(_WORDS)} SELECT id, term, round(weight, 6) AS weight FROM v",
    "char_tfidf": f"WITH {_tfidf_sql(_CHARS)} SELECT id, term, round(weight, 6) AS weight FROM v",
    "word_tfidf_topk": f"WITH {_tfidf_sql(_WORDS)}, s AS (SELECT a.id AS query, b.id AS id, round(sum(a.weight * b.weight), 4) AS score FROM v a JOIN v b USING (term) WHERE a.id % 100 = 0 AND a.id <> b.id GROUP BY 1, 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 3",
    "dense_topk": f"SELECT query, id, score, rank FROM ({_TOP}) WHERE rank <= 5",
    "retrieval_metrics": f"WITH f AS (SELECT query, min(CASE WHEN gold AND rank <= 10 THEN rank END) AS first FROM ({_TOP}) GROUP BY query HAVING bool_or(gold)) SELECT count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 4) AS recall_1, round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 4) AS recall_5, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr FROM f",
    "semantic_search": f"SELECT id, score, rank FROM (SELECT b.vec_id AS id, {_DOT} AS score, row_number() OVER (ORDER BY {_DOT} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id = 100) WHERE rank <= 10",
    "block_topk_union": f"WITH s AS ({_SIDES}) SELECT l AS i, r AS j FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY s DESC, r) AS n FROM s) WHERE n <= 5 UNION SELECT l, r FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY s DESC, l) AS n FROM s) WHERE n <= 1",
    "block_brand": "SELECT c_custkey AS i, n_nationkey AS j FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "blocking_quality": f"SELECT (SELECT count(*) FROM {PAIRS} WHERE char_cos >= 0.7) AS candidates, round(1 - (SELECT count(*) FROM {PAIRS} WHERE char_cos >= 0.7) / power((SELECT count(*) FROM {ONCE}), 2), 4) AS reduction, (SELECT round(avg(CASE WHEN char_cos >= 0.7 THEN 1 ELSE 0 END), 4) FROM {PAIRS} WHERE label) AS completeness",
    "pair_features": f"""WITH o AS (SELECT row_id, brand, qty_value, qty_unit, pack_count, mrp, embedding, list_sort(list_distinct(list_filter(regexp_extract_all({_JOINED}, '[a-z0-9]+'),
lambda t: length(t) >= 4 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') AND NOT regexp_full_match(t, '[0-9]+(gb|tb|mb|mm|cm|in|mp|hz|w|v|g|kg|ml|l)')))) AS codes FROM {ONCE} LEFT JOIN embeddings ON vec_id = row_id)
SELECT i, j, {_DOT} AS sbert, coalesce(a.qty_unit = b.qty_unit AND abs(a.qty_value - b.qty_value) > 0.02 * a.qty_value, false) AS qty_conflict, coalesce(a.pack_count <> b.pack_count, false) AS pack_conflict, coalesce(lower(trim(a.brand)) <> lower(trim(b.brand)), false) AS brand_conflict,
coalesce(len(a.codes) > 0 AND len(b.codes) > 0 AND len(list_filter(a.codes, lambda x: len(list_filter(b.codes, lambda y: starts_with(x, y) OR starts_with(y, x))) > 0)) = 0, false) AS code_conflict,
coalesce(abs(a.mrp - b.mrp) / nullif(greatest(a.mrp, b.mrp), 0) > 0.05, false) AS mrp_conflict FROM {PAIRS.replace(" AND label IS NOT NULL", "")} JOIN o a ON a.row_id = i JOIN o b ON b.row_id = j""",
    "hybrid_score": f"SELECT i, j, score FROM {HYBRID}",
    "catalogue_score": f"SELECT i, j, round({_CAT.format(w=0.25)}, 6) AS score FROM {PAIRS}",
    "tune_grid": f"WITH n AS (SELECT count(*) AS n FROM {PAIRS} WHERE label), c AS (SELECT w, bp, mp, score, round(2.0 * tp / (k + (SELECT n FROM n)), 6) AS f1 FROM ({_CURVE})) SELECT w, bp AS brand_penalty, mp AS code_penalty, score AS threshold, f1 FROM c ORDER BY f1 DESC, w, bp, mp, score DESC LIMIT 1",
    "best_threshold": f"WITH n AS (SELECT count(*) AS n FROM {PAIRS} WHERE label), c AS (SELECT score, sum(sum(CASE WHEN label THEN 1 ELSE 0 END)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS k FROM {HYBRID} GROUP BY score) SELECT 'hybrid' AS config, score AS threshold, round(2.0 * tp / (k + (SELECT n FROM n)), 6) AS f1 FROM c ORDER BY f1 DESC, score DESC LIMIT 1",
    "pair_prf": f"WITH c AS (SELECT count(*) FILTER (score >= 0.6 AND label) AS tp, count(*) FILTER (score >= 0.6 AND NOT label) AS fp, count(*) FILTER (score < 0.6 AND label) AS fn FROM {HYBRID}) SELECT tp, fp, fn, round(tp / (tp + fp), 3) AS precision, round(tp / (tp + fn), 3) AS recall, {_F1('tp', 'fp', 'fn')} AS f1 FROM c",
    "split_ids": f"SELECT DISTINCT row_id, ('0x' || substr(md5('42|' || row_id), 1, 8))::BIGINT < 2147483648 AS is_val FROM {L}",
    "stratified_pairs": f"WITH b AS (SELECT i, j, score, CASE WHEN score >= 0.95 AND score < 1.01 THEN 0 WHEN score >= 0.85 AND score < 0.95 THEN 1 WHEN score >= 0.75 AND score < 0.85 THEN 2 WHEN score >= 0.65 AND score < 0.75 THEN 3 WHEN score >= 0 AND score < 0.65 THEN 4 END AS band FROM {HYBRID} WHERE NOT coalesce(brand_conflict, false)) SELECT i, j, score, band FROM (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('42|' || i || '|' || j), i, j) AS n FROM b WHERE band IS NOT NULL) WHERE n <= 20",
    "ablation_pivot": f"""WITH s AS (SELECT i % 2 = 0 AS even, label, 'char' AS config, coalesce(char_cos, 0.0) AS score FROM {PAIRS} UNION ALL SELECT i % 2 = 0, label, 'rules', round({_CAT.format(w=0.0)}, 6) FROM {PAIRS}),
c AS (SELECT config, even, count(*) FILTER (score >= 0.7 AND label) AS tp, count(*) FILTER (score >= 0.7 AND NOT label) AS fp, count(*) FILTER (score < 0.7 AND label) AS fn FROM s GROUP BY 1, 2) SELECT config, max(CASE WHEN even THEN {_F1('tp', 'fp', 'fn')} END) AS even, max(CASE WHEN NOT even THEN {_F1('tp', 'fp', 'fn')} END) AS odd FROM c GROUP BY config""",
    "grey_zone_band": f"SELECT i, j, score FROM {HYBRID} WHERE score >= 0.6 AND score < 0.8",
    "grey_zone_budget": f"SELECT i, j, score FROM {HYBRID} ORDER BY round(abs(score - 0.7), 6), i, j LIMIT 25",
    "adjudicated_pairs": f"SELECT i, j, CASE WHEN score >= 0.6 AND score < 0.8 AND i % 3 > 0 THEN label ELSE score >= 0.7 END AS decision FROM {HYBRID}",
    "classification_metrics": """WITH d AS (SELECT doc_type AS g, coalesce(CASE WHEN doc_id % 7 > 0 THEN doc_type WHEN doc_id % 14 = 0 THEN 'review' END, 'INVALID') AS p FROM documents WHERE doc_type IS NOT NULL), k AS (SELECT g AS c FROM d UNION SELECT p FROM d),
f AS (SELECT c, 2.0 * (SELECT count(*) FROM d WHERE g = c AND p = c) / ((SELECT count(*) FROM d WHERE g = c) + (SELECT count(*) FROM d WHERE p = c)) AS f FROM k) SELECT count(*) AS n, round(avg(CASE WHEN g = p THEN 1 ELSE 0 END), 4) AS accuracy, (SELECT round(avg(f), 4) FROM f) AS macro_f1, count(*) FILTER (p = 'INVALID') AS invalid FROM d""",
    "per_class_sample": "SELECT doc_type, doc_id FROM (SELECT doc_type, doc_id, row_number() OVER (PARTITION BY doc_type ORDER BY md5('42|' || doc_id), doc_id) AS n FROM documents WHERE doc_type IS NOT NULL) WHERE n <= 20",
    "components": _reach(f"SELECT DISTINCT i AS a, j AS b FROM {P} WHERE label AND i IS NOT NULL AND j IS NOT NULL AND i <> j") + " SELECT id, group_id FROM g",
    "threshold_components": _reach(f"SELECT i AS a, j AS b FROM {HYBRID} WHERE score >= 0.8") + f" SELECT row_id AS id, coalesce(group_id, row_id) AS group_id FROM {ONCE} o LEFT JOIN g ON g.id = o.row_id",
    "cluster_metrics": _reach(f"SELECT i AS a, j AS b FROM {HYBRID} WHERE score >= 0.8")
    + f""", d AS (SELECT brand AS k, coalesce(group_id, row_id) AS p FROM {ONCE} o LEFT JOIN g ON g.id = o.row_id WHERE brand IS NOT NULL), c AS (SELECT k, p, count(*)::DOUBLE AS c FROM d GROUP BY k, p), ck AS (SELECT k, sum(c) AS c FROM c GROUP BY k), cp AS (SELECT p, sum(c) AS c FROM c GROUP BY p),
x AS (SELECT (SELECT sum(c) FROM c) AS n, (SELECT sum(c * (c - 1) / 2) FROM c) AS c2, (SELECT sum(c * (c - 1) / 2) FROM ck) AS k2, (SELECT sum(c * (c - 1) / 2) FROM cp) AS p2, (SELECT sum(c * ln(c)) FROM c) AS cl, (SELECT sum(c * ln(c)) FROM ck) AS kl, (SELECT sum(c * ln(c)) FROM cp) AS pl)
SELECT n::BIGINT AS n, (SELECT count(*) FROM ck) AS gold_clusters, (SELECT count(*) FROM cp) AS pred_clusters, round((c2 - k2 * p2 / (n * (n - 1) / 2)) / ((k2 + p2) / 2 - k2 * p2 / (n * (n - 1) / 2)), 4) AS ari, round(2 * (ln(n) - kl / n + ln(n) - pl / n - ln(n) + cl / n) / (2 * ln(n) - kl / n - pl / n), 4) AS nmi FROM x""",
    "cluster_sizes": _reach(f"SELECT DISTINCT i AS a, j AS b FROM {P} WHERE label AND i IS NOT NULL AND j IS NOT NULL AND i <> j") + ", z AS (SELECT count(*) AS n FROM g GROUP BY group_id) SELECT count(*) AS clusters, count(*) FILTER (n > 1) AS multi_member, coalesce(sum(n) FILTER (n > 1), 0) AS records_in_multi, max(n) AS largest FROM z",
    "medoids": f"SELECT label, vec_id FROM (SELECT a.label, a.vec_id, row_number() OVER (PARTITION BY a.label ORDER BY round(sum({_DOT.replace(', 4)', ', 12)')}), 6) DESC, a.vec_id) AS n FROM embeddings a JOIN embeddings b ON a.label = b.label GROUP BY a.label, a.vec_id) WHERE n = 1",
    "hinglish_rewrites": "SELECT p_partkey, upper(p_name) AS rewritten FROM part WHERE regexp_matches(p_name, 'red|blue')",
    "threshold_grid": f"""WITH RECURSIVE h AS (SELECT i, j, score FROM {HYBRID.replace(" AND label IS NOT NULL", "")}), t AS (SELECT unnest([{", ".join(map(str, GRID))}])::DOUBLE AS t), e AS (SELECT t, i AS a, j AS b FROM h, t WHERE score >= t), s AS (SELECT t, a, b FROM e UNION SELECT t, b, a FROM e),
r(t, id, low) AS (SELECT DISTINCT t, a, a FROM s UNION SELECT s.t, s.b, r.low FROM r JOIN s ON s.t = r.t AND s.a = r.id WHERE r.low < s.b), g AS (SELECT t, id, min(low) AS group_id FROM r GROUP BY t, id),
d AS (SELECT t.t, lower(trim(brand)) AS k, coalesce(group_id, row_id) AS p FROM {ONCE} o CROSS JOIN t LEFT JOIN g ON g.id = o.row_id AND g.t = t.t WHERE brand IS NOT NULL), c AS (SELECT t, k, p, count(*)::DOUBLE AS c FROM d GROUP BY t, k, p),
x AS (SELECT t, sum(c) AS n, sum(c * (c - 1) / 2) AS c2 FROM c GROUP BY t), k AS (SELECT t, sum(c * (c - 1) / 2) AS k2 FROM (SELECT t, k, sum(c) AS c FROM c GROUP BY t, k) GROUP BY t), p AS (SELECT t, count(*) AS clusters, sum(c * (c - 1) / 2) AS p2 FROM (SELECT t, p, sum(c) AS c FROM c GROUP BY t, p) GROUP BY t)
SELECT t AS threshold, clusters, round((c2 - k2 * p2 / (n * (n - 1) / 2)) / ((k2 + p2) / 2 - k2 * p2 / (n * (n - 1) / 2)), 6) AS ari FROM x JOIN k USING (t) JOIN p USING (t)""",
    "self_block": f"SELECT DISTINCT least(query, id) AS i, greatest(query, id) AS j FROM (SELECT a.vec_id AS query, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS n FROM (SELECT a, b, {_DOT} AS s FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id)) WHERE n <= 3",
    "categorize_centroid": """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, list(m ORDER BY d) AS v FROM (SELECT label, d, round(avg(x), 9) AS m FROM x GROUP BY label, d) GROUP BY label)
SELECT vec_id, label FROM (SELECT e.vec_id, m.label, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_sum(list_transform(list_zip(e.embedding, m.v), lambda p: p[1]::DOUBLE * p[2])), 6) DESC, m.label) AS n FROM embeddings e, m) WHERE n = 1""",
    "adjudicate_names": f"WITH n AS (SELECT row_id, name_clean FROM {ONCE}), z AS (SELECT i, j, 'Same product? A: ' || a.name_clean || ' B: ' || b.name_clean AS p FROM {HYBRID} h JOIN n a ON a.row_id = h.i JOIN n b ON b.row_id = h.j WHERE score >= 0.6 AND score < 0.8) SELECT i, j, CASE WHEN p IS NOT NULL THEN ((length(p) - length(replace(p, 'kg', ''))) // 2) % 2 = 0 END AS same FROM z",
    "ask_json": "SELECT p_partkey, CASE WHEN (length(p_name) + 14) % 11 <> 0 THEN p_name END AS name FROM part",
}
for _name in "hybrid_score catalogue_score threshold_components stratified_pairs grey_zone_band grey_zone_budget adjudicate_names cluster_metrics".split():
    ORACLES[_name] = ORACLES[_name].replace(" AND label IS NOT NULL", "")  # these need no label
_CELLS = ", ".join(f"('{n}', {w}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {v})" for n, w, b, c, v in evaluation.cells_of())
ORACLES["configuration_report"] = f"""WITH s AS (SELECT config, w, bp, mp, label, is_val, round(CASE WHEN vetoes AND (coalesce(qty_conflict, false) OR coalesce(pack_conflict, false)) THEN 0.0 ELSE w * coalesce(sbert, 0.0) + (1 - w) * coalesce(char_cos, 0.0)
- CASE WHEN coalesce(brand_conflict, false) THEN bp ELSE 0.0 END - CASE WHEN coalesce(code_conflict, false) THEN mp ELSE 0.0 END END, 6) AS score FROM {PAIRS}, (VALUES {_CELLS}) c(config, w, bp, mp, vetoes) WHERE is_val IS NOT NULL),
n AS (SELECT count(*) FILTER (label AND is_val) AS n FROM {PAIRS}), c AS (SELECT config, w, bp, mp, score, sum(sum(CASE WHEN label THEN 1 ELSE 0 END)) OVER x AS tp, sum(count(*)) OVER x AS k FROM s WHERE is_val GROUP BY config, w, bp, mp, score WINDOW x AS (PARTITION BY config, w, bp, mp ORDER BY score DESC)),
t AS (SELECT config, w, bp, mp, score AS threshold, f1 AS val_f1 FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY f1 DESC, w, bp, mp, score DESC) AS rn FROM (SELECT *, round(2.0 * tp / (k + (SELECT n FROM n)), 6) AS f1 FROM c)) WHERE rn = 1),
r AS (SELECT config, w, bp AS brand_penalty, mp AS code_penalty, threshold, val_f1, count(*) FILTER (score >= threshold AND label) AS tp, count(*) FILTER (score >= threshold AND NOT label) AS fp, count(*) FILTER (score < threshold AND label) AS fn FROM s JOIN t USING (config, w, bp, mp) WHERE NOT is_val GROUP BY ALL)
SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 3) AS recall, {_F1('tp', 'fp', 'fn')} AS f1 FROM r"""
ORACLES["error_pool"] = f"""SELECT dataset, i, j, label AS gold, score >= 0.6 AS predicted, score, rules FROM (SELECT *, CASE WHEN is_val THEN 'val' ELSE 'test' END AS dataset, concat_ws(',', CASE WHEN qty_conflict THEN 'qty_conflict' END, CASE WHEN pack_conflict THEN 'pack_conflict' END, CASE WHEN brand_conflict THEN 'brand_conflict' END, CASE WHEN code_conflict THEN 'code_conflict' END) AS rules,
row_number() OVER (PARTITION BY CASE WHEN is_val THEN 'val' ELSE 'test' END ORDER BY round(abs(score - 0.6), 6) DESC, i, j) AS rn FROM {HYBRID} WHERE (score >= 0.6) <> label) WHERE rn <= 40"""
_CHOSEN = " ".join(f"WHEN '{k}' THEN {vs}[('0x' || substr(md5('42|' || t || '|' || name_clean), 1, 8))::BIGINT % {len(vs)} + 1]" for k, vs in SPELLED.items() if vs)
ORACLES["spelling_variants"] = f"SELECT DISTINCT row_id, array_to_string(list_transform(string_split(name_clean, ' '), lambda t: CASE t {_CHOSEN} ELSE t END), ' ') AS variant FROM {L} WHERE name_clean IS NOT NULL"
ORACLES["canonical_names"] = """WITH d AS (SELECT DISTINCT cluster_id, members, medoid_name FROM phase6_canonical_names), p AS (SELECT *, 'One name for: ' || array_to_string(members[1:10], ' | ') AS prompt, substr(split_part(array_to_string(members[1:10], ' | '), ' | ', 1), 1, 120) AS said FROM d)
SELECT cluster_id, CASE WHEN length(prompt) % 11 <> 0 AND said <> '' THEN said ELSE medoid_name END AS name FROM p"""
ORACLES["category_batches"] = """WITH n AS (SELECT p_partkey AS key, p_name, (row_number() OVER (ORDER BY p_partkey) - 1) // 10 AS b FROM part), p AS (SELECT b, length('labels' || chr(10) || string_agg(p_name, chr(10))) AS size, bool_and(regexp_full_match(substr(p_name, 1, 1), '[a-z]')) AS good FROM n GROUP BY b)
SELECT key, CASE WHEN size % 11 <> 0 AND good THEN substr(p_name, 1, 1) END AS label FROM n JOIN p USING (b)"""
_PLAIN = "regexp_replace(lower(trim({})), '\\s+', ' ', 'g')"
_READ = f"([0-9]+(?:\\.[0-9]+)?|\\.[0-9]+)\\s*({T._UNITS})(?:[^a-z0-9]|$)"
ORACLES["slot_values"] = f"""WITH u AS (SELECT * FROM (VALUES {_UNIT_ROWS}) t(u, base_unit, factor)), l AS (SELECT row_id, {_PLAIN.format("quantity")} AS q, pack_count, {_PLAIN.format("brand")} AS brand FROM {L}),
r AS (SELECT *, try_cast(regexp_extract(q, '{_READ}', 1) AS DOUBLE) AS v, regexp_extract(q, '{_READ}', 2) AS spelling FROM l)
SELECT DISTINCT row_id, CASE WHEN factor IS NOT NULL AND v IS NOT NULL THEN round(v * factor, 3)::VARCHAR || ' ' || base_unit ELSE q END AS quantity, nullif(regexp_extract(pack_count::VARCHAR, '([0-9]+)', 1), '') AS pack, brand FROM r LEFT JOIN u ON u.u = spelling"""
