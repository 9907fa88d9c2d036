"""Queries on profiling, schema mapping, sources and scalar text functions, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.functions import text as T
from listwright.operators import extract, mapping, profile, spelling
from listwright.operators.pairs import SHORT, class_tfidf, synthetic_pairs, training_triplets, transliteration_map
from listwright.operators.units import compositions, spelling_table
from listwright.runtime import broadcast_if_small, table
from listwright.sources.readers import pick_name

L = "phase2_before_after"
UNITS = "|".join(profile.UNIT_WORDS.split())


def listings(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``row_id`` and some columns of all listings, one row per row_id: of second deliveries the first by time of ingestion."""
    first = table(spark, sf_dir, L).groupBy("row_id").agg(F.min(F.struct("ingested_at", *columns)).alias("r"))
    return first.select("row_id", *[F.col(f"r.{c}").alias(c) for c in columns])


ONCE = f"(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ingested_at) rn FROM {L}) WHERE rn = 1)"


# profiling


def profile_table(spark, sf_dir):
    return profile.profile_table(table(spark, sf_dir, "part"), "p_name", "p_brand")


def null_percent(spark, sf_dir):
    return profile.null_percent(table(spark, sf_dir, L).select("brand", "category", "description", "price", "rating", "quantity", "qty_value"))


def top_values(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, L), "category", 10)


def unit_mentions(spark, sf_dir):
    return profile.unit_mentions(table(spark, sf_dir, L), "name_clean")


def token_counts(spark, sf_dir):
    return profile.token_counts(table(spark, sf_dir, "part"), "p_name")


def column_entropy(spark, sf_dir):
    return profile.entropy(table(spark, sf_dir, L), "source")


PROFILED = ["p_name", "p_brand", "p_type", "p_size"]


def column_profile(spark, sf_dir):
    return profile.column_profiles(table(spark, sf_dir, "part"), PROFILED)


def select_columns(spark, sf_dir):
    return profile.select_columns(profile.column_profiles(table(spark, sf_dir, L), SELECTED))


_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT {k} AS ordinal, '{c}' AS "column", round(count(v)::DOUBLE / count(*), 3) AS non_null, round(avg(len(string_split_regex(trim(v), '\\s+'))), 2) AS avg_tokens,
round(count(DISTINCT v)::DOUBLE / count(v), 3) AS unique_ratio, round(sum(length(regexp_replace(v, '[^A-Za-z]', '', 'g')))::DOUBLE / sum(length(regexp_replace(v, '\\s', '', 'g'))), 3) AS alpha_ratio,
round(entropy(v), 3) AS entropy, round(avg(CASE WHEN regexp_matches(v, 'https?://|www[.]') THEN 1 ELSE 0 END), 3) AS url_ratio FROM (SELECT {c}::VARCHAR AS v FROM part)"""
    for k, c in enumerate(PROFILED)
)

SELECTED = ["source", "product_name", "brand", "category", "quantity", "description"]
_SELECT_SQL = """WITH p AS ({}), r AS (SELECT "column", ordinal, avg_tokens, concat_ws('; ', CASE WHEN non_null < {non_null} THEN 'mostly empty' END, CASE WHEN coalesce(avg_tokens, 0) < {avg_tokens} THEN 'too short' END,
CASE WHEN coalesce(unique_ratio, 0) < {unique_ratio} THEN 'too repetitive' END, CASE WHEN coalesce(alpha_ratio, 0) < {alpha_ratio} THEN 'too few letters' END, CASE WHEN url_ratio > {url_ratio} THEN 'links' END) AS reason FROM p),
s AS (SELECT "column", reason = '' AS selected, CASE WHEN reason = '' THEN 'free text' ELSE reason END AS reason, CASE WHEN reason <> '' THEN 'none' WHEN ordinal = (SELECT arg_min(ordinal, (avg_tokens, ordinal)) FROM r WHERE reason = '') THEN 'primary' ELSE 'secondary' END AS role FROM r)""".format(
    " UNION ALL ".join(
        f"""SELECT {k} AS ordinal, '{c}' AS "column", round(count(v)::DOUBLE / count(*), 3) AS non_null, round(avg(len(string_split_regex(trim(v), '\\s+'))), 2) AS avg_tokens,
round(count(DISTINCT v)::DOUBLE / count(v), 3) AS unique_ratio, round(sum(length(regexp_replace(v, '[^A-Za-zÀ-ɏ]', '', 'g')))::DOUBLE / sum(length(regexp_replace(v, '\\s', '', 'g'))), 3) AS alpha_ratio,
round(avg(CASE WHEN regexp_matches(v, 'https?://|www[.]') THEN 1 WHEN v IS NOT NULL THEN 0 END), 3) AS url_ratio FROM (SELECT {c}::VARCHAR AS v FROM {L})"""
        for k, c in enumerate(SELECTED)
    ),
    **profile.LIMITS,
)

# mapping

HEADERS = "sale_price brand manufacturer product_category_tree sub_category product_url crawl_timestamp uniq_id title overall_rating quantity pid index market_price isFKAdvantageProduct".split()
_HEADERS_SQL = ", ".join(f"('{h}')" for h in HEADERS)


def _headers(spark):
    return spark.createDataFrame([(h,) for h in HEADERS], "header string")


def map_headers_rules(spark, sf_dir):
    return mapping.map_headers(_headers(spark))


def header_tokens(spark, sf_dir):
    return _headers(spark).select("header", F.array_join(mapping.header_tokens(F.col("header")), " ").alias("tokens"), mapping.rule_hit(F.col("header")).alias("hit"))


_TOKENS_SQL = r"string_split_regex(lower(regexp_replace(header, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+')"
_RULE_SQL = " ".join(f"WHEN list_has_any(t, {words}) THEN '{field}'" for field, words in mapping._rules())


def sample_values(spark, sf_dir):
    return mapping.sample_values(table(spark, sf_dir, L), "brand", 5)


def to_number(spark, sf_dir):
    return table(spark, sf_dir, L).select("row_id", mapping.to_number(F.col("quantity")).alias("number")).distinct()


def category_levels(spark, sf_dir):
    top, below = mapping.category_levels(F.col("category"))
    return table(spark, sf_dir, L).select("row_id", top.alias("top"), below.alias("below")).distinct()


def price_conflict(spark, sf_dir):
    df = table(spark, sf_dir, L).select(F.col("price").alias("sale_price"), F.col("mrp").alias("selling_cost"))
    got = mapping.resolve_price_conflict(df, mapping.rule_mapping(df))
    return spark.createDataFrame(sorted(got.items()), "header string, field string")


def canonical_part(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sku"), F.col("p_name").alias("product_title"), F.col("p_brand").alias("brand"), F.concat(F.lit("Goods >> "), "p_type").alias("category_tree"), F.concat(F.lit("Rs. "), F.col("p_retailprice").cast("string")).alias("retail_price"))
    return mapping.to_canonical(df, mapping.rule_mapping(df), "part")


def canonical_tables(spark, sf_dir):
    a = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_brand").alias("manufacturer"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("title"), F.col("s_suppkey").alias("supplier_id"))
    return mapping.canonical_tables({"part": a, "supplier": b}).groupBy("source").agg(F.count("*").alias("n"), F.count("product_name").alias("names"), F.count("brand").alias("brands"), F.count("id").alias("ids"))


def mapping_accuracy(spark, sf_dir):
    gold = spark.createDataFrame([("sale_price", "price"), ("brand", "brand"), ("title", "product_name"), ("pid", "other"), ("index", "other"), ("uniq_id", "id")], "header string, field string")
    return mapping.mapping_accuracy(mapping.map_headers(_headers(spark)), gold)


def selection_quality(spark, sf_dir):
    got = select_columns(spark, sf_dir)
    gold = spark.createDataFrame([("product_name", True), ("description", True), ("brand", False), ("source", False)], "column string, wanted boolean")
    return mapping.selection_quality(got, gold)


def pick_names(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", F.array(F.struct(F.lit("fr").alias("lang"), F.concat(F.lit("le "), "n_name").alias("text")), F.struct(F.when(F.col("n_nationkey") % 2 == 0, "en").otherwise("de").alias("lang"), F.col("n_name").alias("text"))).alias("names"))
    return df.select("n_nationkey", pick_name(F.col("names")).alias("name"))


# text


def find_quantities(spark, sf_dir):
    read = table(spark, sf_dir, L).select("row_id", "name_clean").distinct().select("row_id", F.posexplode(T.all_quantities(F.col("name_clean"))).alias("place", "q"))
    return read.select("row_id", "place", F.col("q.value").alias("value"), F.col("q.unit").alias("spelling")).distinct()


_SPELL = T._UNITS


def parse_quantity(spark, sf_dir):
    value, unit = T.first_quantity(F.col("name_clean"))
    units = broadcast_if_small(spelling_table(spark))
    read = table(spark, sf_dir, L).select("row_id", value.alias("value"), unit.alias("spelling")).distinct()
    return read.join(units, "spelling").select("row_id", "base_unit", F.round(F.col("value") * F.col("factor"), 3).alias("amount"))


def parse_number(spark, sf_dir):
    return spark.createDataFrame([(x,) for x in ["3-1/2", "8 1/2", "4/5", "1,000", ".5", "7/0", "x"]], "t string").select("t", F.round(T.parse_number(F.col("t")), 4).alias("value"))


def pack_counts(spark, sf_dir):
    return table(spark, sf_dir, L).select("row_id", T.pack_count(F.col("name_clean")).alias("pack")).distinct()


def model_codes(spark, sf_dir):
    c = T.model_codes(F.concat("p_name", F.lit(" PS-LX"), F.col("p_partkey").cast("string"), F.lit("H 250GB")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(c, " ").alias("codes"))


def expand_abbreviations(spark, sf_dir):
    return table(spark, sf_dir, L).where("name_clean is not null").select("row_id", T.expand_abbreviations(F.col("name_clean")).alias("expanded")).distinct()


def lemmatized(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.lemmatize(F.col("p_name")).alias("lemmas"))


def hinglish_names(spark, sf_dir):
    return table(spark, sf_dir, L).select("row_id", T.to_hinglish(F.col("name_clean")).alias("hinglish")).where("hinglish is not null").distinct()


def _hinglish_sql() -> str:
    out = "lower(name_clean)"
    for a, b in T.pairs_of(T.HINGLISH):
        out = f"regexp_replace({out}, '\\b{a}\\b', '{b}', 'g')"
    return out


def normalize_names(spark, sf_dir):
    df = T.with_normalized(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit("kg, (New)")).alias("name")), "name", "norm")
    return df.select("k", "norm")


def match_text(spark, sf_dir):
    return table(spark, sf_dir, L).select("row_id", T.match_text(F.col("brand"), F.col("name_clean")).alias("text")).distinct()


def kind_format(spark, sf_dir):
    rows = [("length", '3-1/2"'), ("length", "48"), ("weight_g", "2.5 oz"), ("weight_kg", "20-lb."), ("count", "24/Box"), ("speed", "15K"), ("named", "128MB"), ("named", "16 lbs.")]
    return spark.createDataFrame(rows, "kind string, raw string").select("kind", "raw", T.kind_format(F.col("kind"), F.col("raw")).alias("shown"))


def attribute_spans(spark, sf_dir):
    values = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in ("brand", "source")])
    s = T.spans(F.col("product_name"), F.filter(values, lambda v: v["value"].isNotNull()))
    return table(spark, sf_dir, L).select("row_id", F.explode(s).alias("s")).select("row_id", "s.start", "s.end", "s.label").distinct()


def synthetic(spark, sf_dir):
    return synthetic_pairs(table(spark, sf_dir, L), "name_clean")


# spelling


def mine_abbreviations(spark, sf_dir):
    return spelling.mine_abbreviations(profile.token_counts(table(spark, sf_dir, L), "name_clean"))


_COUNTS_SQL = f"(SELECT token, count(*) AS n FROM (SELECT unnest(string_split_regex(trim(lower(name_clean)), '\\s+')) AS token FROM {L}) WHERE token <> '' GROUP BY token)"


def spell_correct(spark, sf_dir):
    counts = profile.token_counts(table(spark, sf_dir, L), "name_clean")
    return spelling.corrections(counts.where(F.col("count") < 3), counts)


def corrected_names(spark, sf_dir):
    df = table(spark, sf_dir, L).where("name_clean is not null").select("row_id", F.lower(F.trim("name_clean")).alias("name_clean")).distinct()
    counts = profile.token_counts(table(spark, sf_dir, L), "name_clean")
    fixed = spelling.correct_text(df, "row_id", "name_clean", spelling.corrections(counts.where(F.col("count") < 3), counts))
    return fixed.distinct()


def clean_names(spark, sf_dir):
    counts = profile.token_counts(table(spark, sf_dir, L), "name_clean")
    return spelling.clean_names(table(spark, sf_dir, L), "row_id", "product_name", spelling.corrections(counts.where(F.col("count") < 3), counts))


def spelling_quality(spark, sf_dir):
    counts = profile.token_counts(table(spark, sf_dir, L), "name_clean")
    originals = counts.where("count >= 3 and token rlike '^[a-z]{5,}$'").select(F.col("token").alias("original"), T.add_typo(F.col("token")).alias("token")).where("original <> token")
    return spelling.spelling_quality(originals, spelling.corrections(originals.select("token"), counts))


def unit_accuracy(spark, sf_dir):
    df = table(spark, sf_dir, L).where("qty_unit is not null and quantity is not null").select("qty_unit", F.lower(F.regexp_extract("quantity", "([A-Za-z]+)[^A-Za-z]*$", 1)).alias("read"))
    return spelling.rollup_accuracy(df.withColumn("gold", F.lower("qty_unit")), "qty_unit", "read", "gold")


# extraction


def gazetteer(spark, sf_dir):
    return extract.brand_gazetteer(table(spark, sf_dir, "part").select("p_brand"), table(spark, sf_dir, "supplier").select("s_name"))


def gazetteer_brand(spark, sf_dir):
    g = extract.brand_gazetteer(table(spark, sf_dir, L).where("brand is not null").select("brand"))
    names = table(spark, sf_dir, L).select("row_id", "name_clean").distinct().groupBy("row_id").agg(F.max(F.coalesce("name_clean", F.lit(""))).alias("n"))
    return extract.phrase_matches(names, "row_id", "n", g).select("row_id", "value", "start", "size")


def extract_rules(spark, sf_dir):
    df = listings(spark, sf_dir, "product_name", "brand").where("product_name is not null")
    return extract.extract_rules(df, "row_id", "product_name", extract.brand_gazetteer(df.where("brand is not null").select("brand")))


def attribute_record(spark, sf_dir):
    df = listings(spark, sf_dir, "name_clean", "brand")
    return extract.attribute_record(df, "row_id", "name_clean", "brand", extract.brand_gazetteer(df.where("brand is not null").select("brand")))


def best_spans(spark, sf_dir):
    at = lambda c: F.call_function("instr", F.lower("product_name"), F.lower(c))
    found = F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value"), at(c).alias("start"), F.round(F.length(c) / F.length("product_name"), 4).alias("score")) for c in ("brand", "quantity", "sub_category")], F.struct(F.lit("brand").alias("label"), F.split_part("product_name", F.lit(" "), F.lit(1)).alias("value"), F.lit(1).alias("start"), F.lit(0.2).cast("double").alias("score")))
    spans = listings(spark, sf_dir, "product_name", "brand", "quantity", "sub_category").select("row_id", F.explode(found).alias("s")).select("row_id", "s.*")
    return extract.best_spans(spans.where("start > 0"), "row_id", 0.1)


def extracted_records(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_name").alias("name"))
    return extract.extract_record(df, "p_partkey", "name", _reader, (("Red tea 2 pcs", '{"colour": "red", "pack_count": 2}'),))


def _reader(prompt: str) -> str:
    words = prompt.rpartition("Name: ")[2].partition("\n")[0].split()
    return json.dumps({"brand": words[0], "product_type": words[-1], "pack_count": len(words) - 3})


def slot_scores(spark, sf_dir):
    df = listings(spark, sf_dir, "name_clean", "brand")
    pred = df.select("row_id", F.lit("brand").alias("attribute"), F.split_part(F.trim("name_clean"), F.lit(" "), F.lit(1)).alias("value")).where("value is not null")
    gold = df.where("brand is not null").select("row_id", F.lit("brand").alias("attribute"), F.array("brand").alias("values"))
    return extract.slot_scores(pred, gold, "row_id")


def interleaved_sample(spark, sf_dir):
    return extract.interleaved_sample(table(spark, sf_dir, L), "row_id", "source", 40)


def attribute_pairs(spark, sf_dir):
    pid = lambda k: F.struct(F.array(F.lit(k)).alias("pid"))
    df = table(spark, sf_dir, "part").select("p_partkey", F.create_map(F.lit("brand"), F.create_map(F.col("p_brand"), pid(0)), F.lit("type"), F.create_map(F.col("p_type"), pid(1), F.lit("n/a"), pid(0))).alias("scores"))
    pairs = extract.attribute_pairs(df, "p_partkey", "scores")
    return extract.title_values(pairs, "p_partkey").select("p_partkey", "attribute", F.array_join("values", "|").alias("value"))


# training data of the reference


def transliteration(spark, sf_dir):
    df = table(spark, sf_dir, L).where("brand is not null").select(F.lower(F.trim("brand")).alias("roman"), F.col("category").alias("native")).where("native is not null")
    return transliteration_map(df, table(spark, sf_dir, "phase6_canonical_names").select(F.lower(F.trim("brand")).alias("roman"))).select("roman", "native", F.size("others").alias("others"))


def training_rows(spark, sf_dir):
    df = listings(spark, sf_dir, "name_clean").where("name_clean is not null")
    syn = synthetic(spark, sf_dir)
    matched = table(spark, sf_dir, "phase5_pairs").where("label").select(F.col("i").alias("row_id"), "j").join(df.select("row_id", F.col("name_clean").alias("left")), "row_id").join(df.select(F.col("row_id").alias("j"), F.col("name_clean").alias("right")), "j").select("left", "right")
    tested = table(spark, sf_dir, "phase5_pairs").where("is_val").select(F.col("i").alias("row_id"))
    held = df.join(tested, "row_id", "left_semi").select(F.col("name_clean").alias("original"))
    return training_triplets(syn, matched, held)


def class_terms(spark, sf_dir):
    return class_tfidf(table(spark, sf_dir, "part"), "p_type", "p_name", 5)


_NAMES = """profile_table null_percent top_values unit_mentions token_counts column_entropy column_profile select_columns map_headers_rules header_tokens
sample_values to_number category_levels price_conflict canonical_part canonical_tables mapping_accuracy selection_quality pick_names find_quantities
parse_quantity parse_number pack_counts model_codes expand_abbreviations lemmatized hinglish_names normalize_names match_text kind_format attribute_spans
synthetic mine_abbreviations spell_correct corrected_names clean_names spelling_quality unit_accuracy gazetteer gazetteer_brand extract_rules attribute_record best_spans extracted_records slot_scores
interleaved_sample attribute_pairs transliteration training_rows class_terms"""
QUERIES = {n: globals()[n] for n in _NAMES.split()}

_UNIT_ROWS = ", ".join(f"('{u}', '{b}', {float(f)!r})" for u, (b, f, _) in ((s, compositions()[u]) for s, u in T.spellings().items() if s.isascii()))
_SHORT = " ".join("WHEN '{}' THEN '{}'".format(*p.split("=")) for p in SHORT.split())
_SPELLED = "o"  # letters whose capital is two letters
for _small, _large in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ß", "ss")):
    _SPELLED = f"replace({_SPELLED}, '{_small}', '{_large}')"
_HEX = lambda k: f"('0x' || substr(md5('42|' || t), {k}, 4))::BIGINT"
_AT = f"({_HEX(1)} % (length(t) - 1) + 1)"
_TYPO = f"""(CASE {_HEX(9)} % 4 WHEN 0 THEN substr(t, 1, {_AT} - 1) || substr(t, {_AT} + 1) WHEN 1 THEN substr(t, 1, {_AT}) || substr(t, {_AT}) WHEN 2 THEN substr(t, 1, {_AT} - 1) || substr(t, {_AT} + 1, 1) || substr(t, {_AT}, 1) || substr(t, {_AT} + 2)
ELSE substr(t, 1, {_AT} - 1) || substr('abcdefghijklmnopqrstuvwxyz', {_HEX(5)} % 26 + 1, 1) || substr(t, {_AT} + 1) END)"""
_LEMMA = """CASE WHEN t IN ('gas', 'bus', 'plus', 'glass', 'lens', 'oats', 'jeans', 'series', 'molasses', 'hummus', 'asparagus') THEN t WHEN regexp_full_match(t, '[a-z]+(ss|us|is)') THEN t
WHEN regexp_full_match(t, '[a-z]{2,}ies') THEN regexp_replace(t, 'ies$', 'y') WHEN regexp_full_match(t, '[a-z]+(ch|sh|x|z)es') THEN regexp_replace(t, 'es$', '') WHEN regexp_full_match(t, '[a-z]{2,}oes') THEN regexp_replace(t, 'es$', '')
WHEN regexp_full_match(t, '[a-z]{3,}s') THEN regexp_replace(t, 's$', '') ELSE t END"""

ORACLES = {
    "parse_quantity": f"WITH q AS (SELECT DISTINCT row_id, try_cast(regexp_extract(lower(name_clean), '([0-9]+(?:\\.[0-9]+)?|\\.[0-9]+)\\s*({_SPELL})(?:[^a-z0-9]|$)', 1) AS DOUBLE) AS v, regexp_extract(lower(name_clean), '([0-9]+(?:\\.[0-9]+)?|\\.[0-9]+)\\s*({_SPELL})(?:[^a-z0-9]|$)', 2) AS u FROM {L}) SELECT row_id, base_unit, round(v * factor, 3) AS amount FROM q JOIN (VALUES {_UNIT_ROWS}) t(u, base_unit, factor) USING (u) WHERE v IS NOT NULL",
    "synthetic": f"""WITH n AS (SELECT DISTINCT name_clean AS o FROM {L} WHERE length(trim(name_clean)) > 0), t AS (SELECT o, string_split(o, ' ') AS w, ('0x' || substr(md5('42|' || o), 1, 8))::BIGINT AS h, try_cast(regexp_extract(o, '([0-9]+)', 1) AS BIGINT) AS number, regexp_extract(o, '([0-9]+)', 1) AS digits FROM n)
SELECT o AS original, array_to_string(list_transform(w, lambda t: CASE WHEN length(t) > 4 AND ('0x' || substr(md5('t42|' || t), 1, 4))::BIGINT % 10 < 3 THEN {_TYPO} ELSE t END), ' ') AS variant, 'typos' AS kind, true AS label FROM t
UNION ALL SELECT o, array_to_string(list_transform(string_split(lower(o), ' '), lambda t: CASE t {_SHORT} ELSE t END), ' '), 'brief', true FROM t
UNION ALL SELECT o, CASE WHEN h % 2 = 0 THEN array_to_string(w[2:] || w[1:1], ' ') ELSE upper({_SPELLED}) END, 'turned', true FROM t
UNION ALL SELECT o, CASE WHEN number IS NOT NULL THEN regexp_replace(o, '^([^0-9]*)' || digits, '\\1' || (2 * number)) ELSE o || ' ' || ['Lite', 'Plus', 'Max', 'Gold', 'Mini'][h % 5 + 1] END, 'negative', false FROM t""",
    "lemmatized": f"SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda t: {_LEMMA}), ' ') AS lemmas FROM part",
    "spell_correct": f"""WITH c AS (SELECT * FROM {_COUNTS_SQL} WHERE regexp_full_match(token, '[a-z]+')), m AS (SELECT a.token, d.token AS word, d.n, damerau_levenshtein(a.token, d.token) AS distance, length(a.token) AS size
FROM c a JOIN c d ON a.n < 3 AND d.n >= 3 AND d.n >= 10 * a.n AND length(a.token) >= 5 AND length(d.token) >= 3 AND abs(length(a.token) - length(d.token)) <= 2)
SELECT token, word, distance FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, n DESC, word) AS rn FROM m WHERE distance <= CASE WHEN size < 8 THEN 1 ELSE 2 END) WHERE rn = 1""",
    "gazetteer_brand": f"""WITH g AS (SELECT trim(brand) AS brand, array_to_string(list_filter(string_split_regex(lower(trim(brand)), '[^\\p{{L}}\\p{{N}}'']+'), lambda w: w <> ''), ' ') AS p FROM {L} WHERE length(trim(brand)) >= 2),
k AS (SELECT p, min(brand) AS value FROM g WHERE p <> '' AND NOT list_contains(string_split('{extract.COLOURS} {extract.CUTS}', ' '), p) GROUP BY p), n AS (SELECT row_id, list_filter(string_split_regex(lower(max(coalesce(name_clean, ''))), '[^\\p{{L}}\\p{{N}}'']+'), lambda w: w <> '') AS w FROM {L} GROUP BY row_id),
t AS (SELECT row_id, unnest(flatten(list_transform([1, 2, 3, 4], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: {{'n': -n, 'start': i, 'p': array_to_string(w[i:i + n - 1], ' ')}})))) AS h FROM n),
h AS (SELECT row_id, list({{'n': h.n, 'start': h.start, 'value': k.value}} ORDER BY h.n, h.start, k.value) AS hs FROM t JOIN k ON k.p = h.p GROUP BY row_id),
r AS (SELECT row_id, list_reduce(list_transform(hs, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda o: x[1].start < o.start - o.n AND o.start < x[1].start - x[1].n)) = 0 THEN a || x ELSE a END) AS kept FROM h),
f AS (SELECT row_id, list_sort(list_transform(kept, lambda x: {{'start': x.start, 'size': -x.n, 'value': x.value}}))[1] AS f FROM r) SELECT row_id, f.value AS value, f.start AS start, f.size AS size FROM f""",
    "attribute_spans": f"SELECT DISTINCT row_id, strpos(lower(product_name), lower(v)) - 1 AS start, strpos(lower(product_name), lower(v)) - 1 + length(v) AS \"end\", label FROM (SELECT row_id, product_name, brand AS v, 'brand' AS label FROM {L} UNION ALL SELECT row_id, product_name, source, 'source' FROM {L}) WHERE length(v) > 0 AND strpos(lower(product_name), lower(v)) > 0",
    "slot_scores": f"""WITH d AS (SELECT row_id, nullif(split_part(trim(name_clean), ' ', 1), NULL) AS v, brand AS g FROM {ONCE}), c AS (SELECT count(*) FILTER (coalesce(lower(trim(v)) = lower(trim(g)), false)) AS tp, count(*) FILTER (v IS NOT NULL AND NOT coalesce(lower(trim(v)) = lower(trim(g)), false)) AS fp, count(*) FILTER (g IS NOT NULL AND NOT coalesce(lower(trim(v)) = lower(trim(g)), false)) AS fn FROM d),
r AS (SELECT tp, fp, fn, round(tp / (tp + fp), 3) AS precision, round(tp / (tp + fn), 3) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 3) AS f1 FROM c) SELECT 'brand' AS attribute, * FROM r UNION ALL SELECT 'MACRO', * FROM r""",
    "profile_table": f"""SELECT count(*) AS rows, 6 AS columns, 0.0 AS mean_null_pct, count(*) - count(DISTINCT (p_partkey, p_name, p_brand, p_type, p_size, p_retailprice)) AS duplicate_rows,
count(p_name) - count(DISTINCT p_name) AS duplicate_names, count(p_name) - count(DISTINCT lower(trim(p_name))) AS duplicate_names_folded, median(length(p_name)) AS median_chars,
round(avg(len(string_split_regex(trim(p_name), '\\s+'))), 2) AS mean_tokens, max(len(string_split_regex(trim(p_name), '\\s+'))) AS max_tokens,
round(100 * avg(CASE WHEN regexp_matches(lower(p_name), '[0-9]\\s*({UNITS})\\b') THEN 1 ELSE 0 END), 1) AS with_unit_pct, count(DISTINCT p_brand) AS brands,
(SELECT count(DISTINCT u) FROM (SELECT unnest(regexp_extract_all(lower(p_name), '[0-9]\\s*({UNITS})\\b', 1)) AS u FROM part)) AS unit_spellings FROM part""",
    "null_percent": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", round(100 * avg(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END), 1) AS null_pct FROM {L}" for c in ("brand", "category", "description", "price", "rating", "quantity", "qty_value")),
    "top_values": f"SELECT trim(category) AS value, count(*) AS count FROM {L} WHERE category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "unit_mentions": f"SELECT unit, count(*) AS count FROM (SELECT unnest(regexp_extract_all(lower(name_clean), '[0-9]\\s*({UNITS})(?:[^a-z0-9]|$)', 1)) AS unit FROM {L}) GROUP BY unit",
    "token_counts": "SELECT token, count(*) AS count FROM (SELECT unnest(string_split_regex(trim(lower(p_name)), '\\s+')) AS token FROM part) WHERE token <> '' GROUP BY token",
    "column_entropy": f"SELECT round(entropy(source), 4) AS entropy FROM {L}",
    "column_profile": _PROFILE_SQL,
    "map_headers_rules": f"WITH h AS (SELECT header, {_TOKENS_SQL} AS t FROM (VALUES {_HEADERS_SQL}) v(header)) SELECT header, CASE {_RULE_SQL} ELSE 'other' END AS predicted, 'rules' AS decided_by FROM h",
    "select_columns": f'{_SELECT_SQL} SELECT "column", selected, reason, role FROM s',
    "selection_quality": f"""{_SELECT_SQL}, c AS (SELECT count(*) FILTER (selected AND wanted) AS tp, count(*) FILTER (selected AND NOT wanted) AS fp, count(*) FILTER (NOT selected AND wanted) AS fn FROM s JOIN (VALUES ('product_name', true), ('description', true), ('brand', false), ('source', false)) g(c, wanted) ON c = s."column")
SELECT tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 3) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 3) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 3) AS f1 FROM c""",
    "header_tokens": f"WITH h AS (SELECT header, {_TOKENS_SQL} AS t FROM (VALUES {_HEADERS_SQL}) v(header)) SELECT header, array_to_string(t, ' ') AS tokens, CASE {_RULE_SQL} END IS NOT NULL AS hit FROM h",
    "sample_values": f"SELECT substr(v, 1, 60) AS value FROM (SELECT DISTINCT trim(brand) AS v FROM {L} WHERE trim(brand) <> '') ORDER BY md5('42|' || v), v LIMIT 5",
    "to_number": f"SELECT DISTINCT row_id, try_cast(regexp_extract(replace(quantity, ',', ''), '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS number FROM {L}",
    "category_levels": f"""SELECT DISTINCT row_id, nullif(trim(p[1]), '') AS top, nullif(trim(p[2]), '') AS below FROM (SELECT row_id, string_split_regex(regexp_replace(category, '^[\\[" ]+|[\\]" ]+$', '', 'g'), '\\s*>>\\s*') AS p FROM {L})""",
    "price_conflict": f"SELECT header, field FROM (SELECT median(price) AS a, median(mrp) AS b FROM {L}), (VALUES ('sale_price'), ('selling_cost')) v(header), LATERAL (SELECT CASE WHEN (header = 'sale_price') = (a > b) THEN 'mrp' ELSE 'price' END AS field)",
    "canonical_part": "SELECT 'part' AS source, p_name AS product_name, p_brand AS brand, 'Goods' AS category, p_type AS sub_category, NULL::DOUBLE AS price, p_retailprice AS mrp, NULL::VARCHAR AS quantity, NULL::VARCHAR AS description, NULL::DOUBLE AS rating, p_partkey::VARCHAR AS id FROM part",
    "canonical_tables": "SELECT 'part' AS source, count(*) AS n, count(p_name) AS names, count(p_brand) AS brands, 0 AS ids FROM part UNION ALL SELECT 'supplier', count(*), count(s_name), 0, count(s_suppkey) FROM supplier",
    "mapping_accuracy": f"WITH h AS (SELECT header, {_TOKENS_SQL} AS t FROM (VALUES {_HEADERS_SQL}) v(header)), p AS (SELECT header, CASE {_RULE_SQL} ELSE 'other' END AS predicted FROM h) SELECT count(*) AS n, round(avg(CASE WHEN predicted = field THEN 1 ELSE 0 END), 3) AS accuracy FROM p JOIN (VALUES ('sale_price', 'price'), ('brand', 'brand'), ('title', 'product_name'), ('pid', 'other'), ('index', 'other'), ('uniq_id', 'id')) g(header, field) USING (header)",
    "pick_names": "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE 'le ' || n_name END AS name FROM nation",
    "spelling_quality": f"""WITH c AS (SELECT * FROM {_COUNTS_SQL} WHERE regexp_full_match(token, '[a-z]+')), o AS (SELECT DISTINCT t AS original, {_TYPO} AS token FROM (SELECT token AS t FROM c WHERE n >= 3 AND length(token) >= 5)),
q AS (SELECT * FROM o WHERE token <> original), a AS (SELECT DISTINCT q.token, coalesce(c.n, 0) AS own FROM q LEFT JOIN c USING (token) WHERE length(q.token) >= 5 AND coalesce(c.n, 0) < 3),
m AS (SELECT a.token, d.token AS word, d.n, damerau_levenshtein(a.token, d.token) AS distance FROM a JOIN c d ON d.n >= 3 AND d.n >= 10 * greatest(a.own, 1) AND length(d.token) >= 3 AND abs(length(a.token) - length(d.token)) <= 2),
f AS (SELECT token, word FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, n DESC, word) AS rn FROM m WHERE distance <= CASE WHEN length(token) < 8 THEN 1 ELSE 2 END) WHERE rn = 1)
SELECT count(*) AS n, round(avg(CASE WHEN coalesce(word = original, false) THEN 1 ELSE 0 END), 4) AS restored, round(avg(CASE WHEN coalesce(word <> original, false) THEN 1 ELSE 0 END), 4) AS wrong FROM q LEFT JOIN f USING (token)""",
    "find_quantities": f"""WITH d AS (SELECT DISTINCT row_id, name_clean FROM {L}), q AS (SELECT row_id, unnest(m) AS q, generate_subscripts(m, 1) - 1 AS place FROM (SELECT row_id, regexp_extract_all(lower(name_clean) || ' ', '((?:[0-9]+(?:\\.[0-9]+)?|\\.[0-9]+)\\s*(?:{_SPELL}))[^a-z0-9]', 1) AS m FROM d))
SELECT DISTINCT row_id, place, regexp_extract(q, '^([0-9.]+)', 1)::DOUBLE AS value, regexp_extract(q, '([a-z]+(?:\\.[a-z]+)?|100[a-z]+)$', 1) AS spelling FROM q""",
    "parse_number": "SELECT * FROM (VALUES ('3-1/2', 3.5), ('8 1/2', 8.5), ('4/5', 0.8), ('1,000', 1000.0), ('.5', 0.5), ('7/0', NULL), ('x', NULL)) v(t, value)",
    "pack_counts": f"""WITH d AS (SELECT DISTINCT row_id, lower(name_clean) AS t FROM {L}), f AS (SELECT row_id, t, p, regexp_extract(t, p, 0) AS whole, try_cast(regexp_extract(t, p, 1) AS INT) AS n FROM d, (VALUES {", ".join(f"('{p}')" for p in T.PACK_FORMS)}) v(p)),
b AS (SELECT row_id, t, arg_min(n, strpos(t, whole)) FILTER (whole <> '' AND n > 0) AS pack FROM f GROUP BY row_id, t) SELECT DISTINCT row_id, pack FROM b""",
    "model_codes": "SELECT p_partkey, 'pslx' || p_partkey || 'h' AS codes FROM part",
    "expand_abbreviations": f"SELECT DISTINCT row_id, array_to_string(list_transform(string_split(name_clean, ' '), lambda t: CASE t {' '.join(f'WHEN {chr(39)}{a}{chr(39)} THEN {chr(39)}{b}{chr(39)}' for a, b in T.pairs_of(T.ABBREVIATIONS))} ELSE t END), ' ') AS expanded FROM {L} WHERE name_clean IS NOT NULL",
    "hinglish_names": f"SELECT DISTINCT row_id, h AS hinglish FROM (SELECT row_id, lower(name_clean) AS n, {_hinglish_sql()} AS h FROM {L}) WHERE h <> n",
    "normalize_names": "SELECT p_partkey AS k, lower(p_name) || ' ' || (p_size * 1000) || ' g new' AS norm FROM part",
    "match_text": f"SELECT DISTINCT row_id, trim(concat_ws(' ', lower(trim(brand)), name_clean)) AS text FROM {L}",
    "kind_format": """SELECT * FROM (VALUES ('length', '3-1/2"', '8.9'), ('length', '48', '121.9'), ('weight_g', '2.5 oz', '71'), ('weight_kg', '20-lb.', '9.1'), ('count', '24/Box', '24'), ('speed', '15K', '15000'), ('named', '128MB', '128 Megabytes'), ('named', '16 lbs.', '16 lbs.')) v(kind, raw, shown)""",
    "mine_abbreviations": f"""WITH c AS (SELECT * FROM {_COUNTS_SQL} WHERE regexp_full_match(token, '[a-z]+')), m AS (SELECT s.token AS short, s.n AS short_count, l.token AS long, l.n AS long_count, row_number() OVER (PARTITION BY s.token ORDER BY l.n DESC, l.token) AS rn
FROM c s JOIN c l ON starts_with(l.token, s.token) AND length(l.token) >= length(s.token) + 2 WHERE length(s.token) BETWEEN 2 AND 5 AND s.n >= 3 AND length(l.token) >= 6)
SELECT short, long, short_count, long_count FROM m WHERE rn = 1 AND long_count >= 2 * short_count ORDER BY short_count DESC, short LIMIT 60""",
    "unit_accuracy": f"WITH d AS (SELECT qty_unit, CASE WHEN lower(regexp_extract(quantity, '([A-Za-z]+)[^A-Za-z]*$', 1)) = lower(qty_unit) THEN 1 ELSE 0 END AS ok FROM {L} WHERE qty_unit IS NOT NULL AND quantity IS NOT NULL) SELECT coalesce(qty_unit, 'ALL') AS qty_unit, count(*) AS n, round(avg(ok), 4) AS accuracy FROM d GROUP BY ROLLUP (qty_unit)",
    "gazetteer": "SELECT min(b) AS brand, p AS phrase FROM (SELECT b, trim(regexp_replace(lower(b), '[^a-z0-9'']+', ' ', 'g')) AS p FROM (SELECT trim(p_brand) AS b FROM part UNION ALL SELECT trim(s_name) FROM supplier) WHERE length(b) >= 2) GROUP BY p",
    "interleaved_sample": f"SELECT turn, source, row_id FROM (SELECT source, row_id, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || row_id), row_id) AS turn FROM (SELECT DISTINCT source, row_id FROM {L})) ORDER BY turn, source, row_id LIMIT 40",
    "attribute_pairs": "SELECT p_partkey, 'brand' AS attribute, p_brand AS value FROM part",
    "transliteration": f"""WITH d AS (SELECT lower(trim(brand)) AS roman, category AS native FROM {L} WHERE brand IS NOT NULL AND category IS NOT NULL), b AS (SELECT roman, native, row_number() OVER (PARTITION BY roman ORDER BY count(*) DESC, native) AS rn FROM d WHERE roman IN (SELECT lower(trim(brand)) FROM phase6_canonical_names) GROUP BY roman, native)
SELECT b.roman, b.native, (SELECT count(DISTINCT d.roman) FROM d WHERE d.native = b.native AND d.roman <> b.roman) AS others FROM b WHERE rn = 1""",
    "class_terms": """WITH w AS (SELECT p_type AS g, unnest(string_split_regex(lower(trim(p_name)), '[^a-z0-9]+')) AS term FROM part), c AS (SELECT g, term, count(*) AS c FROM w WHERE term <> '' GROUP BY g, term), s AS (SELECT g, sum(c) AS n FROM c GROUP BY g), f AS (SELECT term, sum(c) AS f FROM c GROUP BY term),
x AS (SELECT g, term, round(c / n * ln(1 + (SELECT avg(n) FROM s) / f), 6) AS score FROM c JOIN s USING (g) JOIN f USING (term)) SELECT p_type, term, score, rank FROM (SELECT g AS p_type, term, score, row_number() OVER (PARTITION BY g ORDER BY score DESC, term) AS rank FROM x) WHERE rank <= 5""",
}
_JOINED = "lower(name_clean)"
for _ in range(3):  # a mark between two others is joined in a later round
    _JOINED = f"regexp_replace({_JOINED}, '([a-z0-9])[-/.]([a-z]*[0-9])', '\\1\\2', 'g')"
_CODES_SQL = f"coalesce(array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({_JOINED}, '[a-z0-9]+'), lambda t: length(t) >= 4 AND regexp_matches(t, '[a-z]') AND regexp_matches(t, '[0-9]') AND NOT regexp_full_match(t, '[0-9]+(gb|tb|mb|mm|cm|in|mp|hz|w|v|g|kg|ml|l)')))), ' '), '')"
ORACLES["attribute_record"] = f"""WITH gb AS ({ORACLES["gazetteer_brand"].replace("max(coalesce(name_clean, ''))", "coalesce(arg_min(name_clean, ingested_at), '')")}), q AS (SELECT row_id, base_unit, amount FROM ({ORACLES["parse_quantity"]})), k AS ({ORACLES["pack_counts"]})
SELECT o.row_id, coalesce(nullif(lower(trim(o.brand)), ''), lower(gb.value)) AS brand, q.base_unit, q.amount, k.pack AS pack_count, {_CODES_SQL} AS codes FROM {ONCE} o LEFT JOIN gb USING (row_id) LEFT JOIN q USING (row_id) LEFT JOIN k USING (row_id)"""
ORACLES["best_spans"] = f"""WITH o AS (SELECT row_id, product_name AS t, unnest([{{'label': 'brand', 'value': brand, 'score': NULL::DOUBLE}}, {{'label': 'quantity', 'value': quantity, 'score': NULL}}, {{'label': 'sub_category', 'value': sub_category, 'score': NULL}}, {{'label': 'brand', 'value': split_part(product_name, ' ', 1), 'score': 0.2}}]) AS s FROM {ONCE}),
d AS (SELECT row_id, s.label AS label, s.value AS value, CASE WHEN s.score IS NULL THEN strpos(lower(t), lower(s.value)) ELSE 1 END AS start, coalesce(s.score, round(length(s.value)::DOUBLE / length(t), 4)) AS score FROM o)
SELECT row_id, label, value, score FROM (SELECT *, row_number() OVER (PARTITION BY row_id, label ORDER BY score DESC, start, value) AS rn FROM d WHERE start > 0 AND score >= 0.1 AND value IS NOT NULL) WHERE rn = 1"""
ORACLES["extracted_records"] = """WITH w AS (SELECT p_partkey, string_split_regex(trim(concat_ws(' ', p_brand, p_name)), '\\s+') AS w FROM part) SELECT p_partkey, CASE WHEN len(w) > 3 THEN w[1] END AS brand, CASE WHEN len(w) > 3 THEN w[-1] END AS product_type,
NULL::VARCHAR AS variant, NULL::VARCHAR AS quantity, CASE WHEN len(w) > 3 THEN (len(w) - 3)::INT END AS pack_count, NULL::VARCHAR AS colour FROM w"""
ORACLES["corrected_names"] = f"""WITH f AS ({ORACLES["spell_correct"]}), d AS (SELECT DISTINCT row_id, lower(trim(name_clean)) AS n FROM {L} WHERE name_clean IS NOT NULL), t AS (SELECT row_id, n, unnest(string_split(n, ' ')) AS token, generate_subscripts(string_split(n, ' '), 1) AS k FROM d)
SELECT DISTINCT row_id, corrected FROM (SELECT row_id, n, string_agg(coalesce(word, token), ' ' ORDER BY k) AS corrected FROM t LEFT JOIN f USING (token) GROUP BY row_id, n)"""
ORACLES["training_rows"] = f"""WITH y AS ({ORACLES["synthetic"]}), o AS (SELECT row_id, name_clean FROM {ONCE} WHERE name_clean IS NOT NULL), held AS (SELECT name_clean AS h FROM o WHERE row_id IN (SELECT i FROM phase5_pairs WHERE is_val)),
a AS (SELECT p.original AS anchor, p.variant AS positive, n.variant AS negative FROM y p JOIN y n USING (original) WHERE p.label AND NOT n.label UNION SELECT a.name_clean, b.name_clean, NULL FROM phase5_pairs p JOIN o a ON a.row_id = p.i JOIN o b ON b.row_id = p.j WHERE p.label)
SELECT DISTINCT anchor, positive, negative FROM a WHERE anchor <> positive AND anchor NOT IN (SELECT h FROM held)"""
_WORDS_SQL = "list_filter(string_split_regex(lower({}), '[^\\p{{L}}\\p{{N}}'']+'), lambda w: w <> '')"
_NAMED_SQL = ORACLES["gazetteer_brand"].replace("max(coalesce(name_clean, ''))", "coalesce(arg_min(product_name, ingested_at), '')")
_COLOURS_SQL = f"string_split('{extract.COLOURS}', ' ')"
ORACLES["extract_rules"] = f"""WITH gb AS ({_NAMED_SQL}), o AS (SELECT row_id, product_name AS t, {_WORDS_SQL.format("product_name")} AS w, {_WORDS_SQL.format("regexp_extract(product_name, '^([^,(|/[]*?)(?: - |[,(|/[]|$)', 1)")} AS part FROM {ONCE} WHERE product_name IS NOT NULL),
x AS (SELECT o.row_id, gb.value AS brand, list_filter(w, lambda v: list_contains({_COLOURS_SQL}, v))[1] AS colour, list_filter(part, lambda v: regexp_full_match(v, '\\p{{L}}+') AND NOT list_contains({_COLOURS_SQL}, v) AND NOT list_contains(coalesce({_WORDS_SQL.format("gb.value")}, []), v)) AS rest FROM o LEFT JOIN gb USING (row_id))
SELECT row_id, brand, colour, nullif(array_to_string(rest[-3:], ' '), '') AS product_type FROM x"""
