"""Profiles of tables and columns: fill rates, repetition, token counts, entropy, and which columns carry free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Unit spellings counted after a number in product names.
UNIT_WORDS = "kg kgs g gm gms gram grams mg ml ltr l litre liter cl oz lb lbs cm mm inch inches pcs pc pack pieces"

# Limits a column must keep to be free text.
LIMITS = {"avg_tokens": 2.0, "unique_ratio": 0.3, "alpha_ratio": 0.6, "url_ratio": 0.1, "non_null": 0.5}


def _rounded(c: Column, digits: int) -> Column:
    return F.round(c, digits)


def null_percent(df: DataFrame) -> DataFrame:
    """``column, null_pct``: share of nulls per column in percent, one decimal, largest first; an empty table gives null."""
    shares = df.agg(*[_rounded(100 * F.avg(F.col(f"`{c}`").isNull().cast("int")), 1).alias(c) for c in df.columns])
    return shares.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("null_pct")) for c in df.columns])).alias("s")).select("s.*").orderBy(F.desc("null_pct"), "column")


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """``value, count``: the n most frequent values after trimming, ties by value; nulls don't count."""
    return df.where(F.col(column).isNotNull()).groupBy(F.trim(column).alias("value")).count().orderBy(F.desc("count"), "value").limit(n)


def unit_mentions(df: DataFrame, name: str) -> DataFrame:
    """``unit, count``: how often each unit spelling follows a number, spellings kept apart."""
    pattern = rf"[0-9]\s*({UNIT_WORDS.replace(' ', '|')})(?:[^a-z0-9]|$)"
    found = df.select(F.explode(F.regexp_extract_all(F.lower(name), F.lit(pattern), 1)).alias("unit"))
    return found.groupBy("unit").count()


def token_counts(df: DataFrame, text: str) -> DataFrame:
    """``token, count`` over all texts, split at white space."""
    return df.select(F.explode(F.split(F.trim(F.lower(text)), r"\s+")).alias("token")).where("token <> ''").groupBy("token").count()


def entropy(df: DataFrame, column: str) -> DataFrame:
    """``entropy`` in bits of the distribution of non-null values; null for none."""
    c = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").cast("double").alias("c"))
    return c.agg(_rounded(F.log2(F.sum("c")) - F.sum(F.col("c") * F.log2("c")) / F.sum("c"), 4).alias("entropy"))


def profile_table(df: DataFrame, name: str, brand: str) -> DataFrame:
    """One row: size, mean null share, repeated rows and names, name lengths, share of names with a unit, distinct units and brands."""
    n = F.col(name)
    tokens = F.size(F.split(F.trim(n), r"\s+"))
    units = F.array_distinct(F.regexp_extract_all(F.lower(n), F.lit(rf"[0-9]\s*({UNIT_WORDS.replace(' ', '|')})\b"), 1))
    row_hash = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    base = df.select(n.alias("n"), F.col(brand).alias("b"), F.to_json(row_hash).alias("r"), units.alias("u"), tokens.alias("t"), reduce(lambda a, b: a + b, [F.col(f"`{c}`").isNull().cast("int") for c in df.columns]).alias("nulls"))
    one = base.agg(
        F.count("*").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        _rounded(100 * F.avg("nulls") / len(df.columns), 1).alias("mean_null_pct"),
        (F.count("*") - F.count_distinct("r")).alias("duplicate_rows"),
        (F.count("n") - F.count_distinct("n")).alias("duplicate_names"),
        (F.count("n") - F.count_distinct(F.lower(F.trim("n")))).alias("duplicate_names_folded"),
        F.median(F.length("n")).alias("median_chars"),
        _rounded(F.avg("t"), 2).alias("mean_tokens"),
        F.max("t").alias("max_tokens"),
        _rounded(100 * F.avg((F.size("u") > 0).cast("int")), 1).alias("with_unit_pct"),
        F.count_distinct("b").alias("brands"),
    )
    spelled = base.select(F.explode("u").alias("u")).agg(F.count_distinct("u").alias("unit_spellings"))
    return one.crossJoin(spelled)  # single rows


def column_profiles(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: ``ordinal, column, non_null, avg_tokens, unique_ratio, alpha_ratio, entropy, url_ratio``.

    Values are compared as text. The letter share is that of the whole column. Counts run over ``(column, value)`` groups,
    so that repeated values cost one row.
    """
    columns = columns or df.columns
    pairs = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in enumerate(columns)])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").groupBy("ordinal", "column", "value").agg(F.count("*").alias("c"))
    filled = F.when(F.col("value").isNotNull() & (F.trim("value") != ""), F.col("c"))
    v = F.when(filled.isNotNull(), F.col("value"))
    letters = F.length(F.regexp_replace(v, r"[^A-Za-zÀ-ɏ]", ""))
    spaces = F.length(F.regexp_replace(v, r"\S", ""))
    n = F.sum(filled)
    out = values.groupBy("ordinal", "column").agg(
        _rounded(F.coalesce(n, F.lit(0)) / F.sum("c"), 3).alias("non_null"),
        _rounded(F.sum(filled * F.size(F.split(F.trim(v), r"\s+"))) / n, 2).alias("avg_tokens"),
        _rounded(F.count(filled) / n, 3).alias("unique_ratio"),
        _rounded(F.sum(filled * letters) / F.nullif(F.sum(filled * (F.length(v) - spaces)), F.lit(0)), 3).alias("alpha_ratio"),
        _rounded(F.log2(n) - F.sum(filled * F.log2(filled)) / n, 3).alias("entropy"),
        _rounded(F.sum(F.when(v.rlike("https?://|www[.]"), filled).otherwise(F.when(filled.isNotNull(), 0))) / n, 3).alias("url_ratio"),
    )
    return out


def select_columns(profiles: DataFrame) -> DataFrame:
    """``column, selected, reason, role``: columns within all limits are selected; the one with fewest tokens is primary."""
    low = lambda c, say: F.when(F.coalesce(F.col(c), F.lit(0.0)) < LIMITS[c], F.lit(say))
    reason = F.concat_ws("; ", low("non_null", "mostly empty"), low("avg_tokens", "too short"), low("unique_ratio", "too repetitive"), low("alpha_ratio", "too few letters"), F.when(F.col("url_ratio") > LIMITS["url_ratio"], F.lit("links")))
    judged = profiles.withColumn("reason", F.when(reason == "", "free text").otherwise(reason)).withColumn("selected", reason == "")
    first = judged.where("selected").agg(F.min(F.struct("avg_tokens", "ordinal")).alias("first"))
    marked = judged.crossJoin(first)  # one row
    role = F.when(~F.col("selected"), F.lit("none")).when(F.col("ordinal") == F.col("first.ordinal"), "primary").otherwise("secondary")
    return marked.select("column", "selected", "reason", role.alias("role"))
