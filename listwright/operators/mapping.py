"""Mapping arbitrary headers to the canonical product schema, and tables to canonical form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ["product_name", "brand", "category", "sub_category", "price", "mrp", "quantity", "description", "rating", "id"]
NUMERIC = ["price", "mrp", "rating"]

# Header words by field; the first field with a matching word wins.
RULES = """
other: url image img link date time timestamp specifications created creator index packaging stores countries labels
sub_category: sub subcategory
mrp: mrp market retail list
price: price cost amount selling sale discounted
rating: rating ratings stars review
description: description desc details about ingredients
brand: brand brands manufacturer maker company
category: category categories type department tree
quantity: quantity qty size weight volume
product_name: name title product item
id: id code sku pid uniq asin key
"""


def header_tokens(header: Column) -> Column:
    """Lower-case words of a header, split at camel humps and at what isn't a letter or digit."""
    humps = F.regexp_replace(header, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(humps), r"[^a-z0-9]+"), lambda t: t != "")


def _rules() -> list[tuple[str, list[str]]]:
    return [(field, words.split()) for field, _, words in (line.partition(": ") for line in RULES.strip().split("\n"))]


def rule_hit(header: Column) -> Column:
    """Does any rule match the header?"""
    tokens = header_tokens(header)
    return reduce(lambda a, b: a | b, [F.arrays_overlap(tokens, F.array(*map(F.lit, words))) for _, words in _rules()])


def map_by_rules(header: Column) -> Column:
    """The field of the first matching rule, else other."""
    tokens = header_tokens(header)
    return F.coalesce(*[F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, words))), F.lit(field)) for field, words in _rules()], F.lit("other"))


def map_headers(headers: DataFrame, scores: DataFrame | None = None, answers: DataFrame | None = None, threshold: float = 0.6) -> DataFrame:
    """``header, predicted, decided_by`` by a cascade: rules, else a model's answer, else other.

    With ``scores(header, field, score)`` the best scoring field decides instead of rules, and ``answers(header, field)``
    decides below the threshold.
    """
    out = headers.select("header").distinct()
    none = F.lit(None).cast("string")
    if answers is not None:
        out = out.join(answers.select("header", F.col("field").alias("answer")), "header", "left")
    answer = F.col("answer") if answers is not None else none
    if scores is None:
        hit = rule_hit(F.col("header"))
        return out.select("header", F.when(hit, map_by_rules(F.col("header"))).otherwise(F.coalesce(answer, F.lit("other"))).alias("predicted"), F.when(hit, "rules").when(answer.isNotNull(), "model").otherwise("rules").alias("decided_by"))
    best = scores.groupBy("header").agg(F.max(F.struct(F.col("score"), F.col("field"))).alias("b"))
    sure = F.col("b.score") >= threshold
    return out.join(best, "header", "left").select("header", F.when(sure | answer.isNull(), F.coalesce("b.field", F.lit("other"))).otherwise(answer).alias("predicted"), F.when(sure | answer.isNull(), "embedding").otherwise("model").alias("decided_by"))


# What each canonical field holds, in words that an encoder can compare with a header and its values.
MEANINGS = """
product_name: product name or item title
brand: brand or manufacturer of the product
category: product category or department
sub_category: product sub category
price: selling price amount
mrp: list price or maximum retail price
quantity: pack size quantity weight volume
description: long product description text
rating: customer rating stars
id: unique product identifier code
other: url image timestamp or other data
"""


def embedding_scores(headers: DataFrame, encoder, samples: DataFrame | None = None) -> DataFrame:
    """``header, field, score``: cosine of each header, with its sample values if given, to the meaning of every field.

    ``samples(header, value)``. There are as many meanings as fields, so the pairing is a handful of rows a header.
    """
    from listwright.operators.vectors import dot, encoded

    spark = headers.sparkSession
    texts = headers.select("header").distinct().withColumn("text", F.array_join(header_tokens(F.col("header")), " "))
    if samples is not None:
        joined = samples.groupBy("header").agg(F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("values"))
        texts = texts.join(joined, "header", "left").withColumn("text", F.concat_ws(": ", "text", "values"))
    meanings = spark.createDataFrame([tuple(x.split(": ")) for x in MEANINGS.strip().split("\n")], "field string, meaning string")
    a = encoded(texts, "header", "text", encoder, "a")
    b = encoded(meanings, "field", "meaning", encoder, "b")
    return a.crossJoin(F.broadcast(b)).select("header", "field", F.round(dot(F.col("a"), F.col("b")), 4).alias("score"))  # a row per field


def sample_values(df: DataFrame, column: str, n: int = 5, chars: int = 60, seed: int = 42) -> DataFrame:
    """``value``: up to n distinct non-empty values, cut to a length, chosen by a seeded hash of the value."""
    v = F.trim(F.col(f"`{column}`").cast("string"))
    picked = df.select(v.alias("v")).where("v <> ''").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col("v"))), "v").limit(n)
    return picked.select(F.substring("v", 1, chars).alias("value"))


def to_number(text: Column) -> Column:
    """The first number of a text, commas taken as thousands separators; else null."""
    found = F.regexp_extract(F.replace(text.cast("string"), F.lit(","), F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1)
    return found.try_cast("double")


def category_levels(path: Column) -> tuple[Column, Column]:
    """The first two levels of a ``["A >> B >> C"]`` path; null where there is none."""
    bare = F.regexp_replace(path, r'^[\[" ]+|[\]" ]+$', "")
    parts = F.transform(F.split(bare, r"\s*>>\s*"), F.trim)
    some = lambda k: F.nullif(F.get(parts, F.lit(k)), F.lit(""))
    return some(0), some(1)


def resolve_price_conflict(df: DataFrame, mapping: dict[str, str]) -> dict[str, str]:
    """Of exactly two columns mapped to price and none to mrp, the one with the higher median becomes mrp."""
    prices = [c for c, f in mapping.items() if f == "price"]
    if len(prices) != 2 or "mrp" in mapping.values():
        return mapping
    a, b = df.agg(*[F.median(to_number(F.col(f"`{c}`"))) for c in prices]).first()
    if a is None or b is None:
        return mapping
    return mapping | {prices[0] if a > b else prices[1]: "mrp"}


def to_canonical(df: DataFrame, mapping: dict[str, str], source: str) -> DataFrame:
    """The canonical columns of a table; of several columns for one field the first counts, missing fields are null.

    Categories with ``>>`` anywhere in the column are split for all rows, and the second level fills sub_category where
    that is wholly null: the two tests are one small aggregate.
    """
    first: dict[str, str] = {}
    for header in df.columns:
        if (field := mapping.get(header, "other")) in FIELDS:
            first.setdefault(field, header)
    own = {f: F.col(f"`{first[f]}`").cast("string") if f in first else F.lit(None).cast("string") for f in FIELDS}
    paths, subs = df.agg(F.coalesce(F.bool_or(own["category"].contains(">>")), F.lit(False)), F.count(own["sub_category"])).first()
    if paths:
        top, below = category_levels(own["category"])
        own |= {"category": top, **({} if subs else {"sub_category": below})}
    own |= {f: to_number(own[f]) for f in NUMERIC}
    return df.select(F.lit(source).alias("source"), *[own[f].alias(f) for f in FIELDS])


def canonical_tables(tables: dict[str, DataFrame], mappings: dict[str, dict[str, str]] | None = None) -> DataFrame:
    """All tables in canonical form, one below the other; headers without a given mapping go by the rules."""
    parts = []
    for source, df in tables.items():
        mapping = (mappings or {}).get(source) or rule_mapping(df)
        parts.append(to_canonical(df, resolve_price_conflict(df, mapping), source))
    return reduce(DataFrame.unionByName, parts)


def rule_mapping(df: DataFrame) -> dict[str, str]:
    """Header to field by rules. The headers are the schema's, so this reads no data."""
    spark: SparkSession = df.sparkSession
    if not df.columns:
        return {}
    rows = spark.createDataFrame([(c,) for c in df.columns], "header string").select("header", map_by_rules(F.col("header"))).collect()
    return {h: f for h, f in rows}


def mapping_accuracy(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """``n, accuracy`` of predicted fields against ``gold(header, field)``."""
    return gold.join(predicted, "header").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("field")).cast("int")), 3).alias("accuracy"))


def selection_quality(selected: DataFrame, gold: DataFrame) -> DataFrame:
    """``tp, fp, fn, precision, recall, f1`` of selected columns against ``gold(column, wanted)``; inner join on the column."""
    s, g = F.col("selected"), F.col("wanted")
    c = selected.join(gold, "column").agg(F.count_if(s & g).alias("tp"), F.count_if(s & ~g).alias("fp"), F.count_if(~s & g).alias("fn"))
    return prf_columns(c)


def prf_columns(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of ``tp, fp, fn`` counts; 0 where a denominator is 0."""
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select(*counts.columns, F.round(p, 3).alias("precision"), F.round(r, 3).alias("recall"), F.round(f, 3).alias("f1"))
