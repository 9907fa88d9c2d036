"""Synthetic variants, transliteration maps and assembly of training pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listwright.functions.text import add_typo

# Words and the short forms that synthetic variants use.
SHORT = "packet=pkt pieces=pcs chocolate=choc kilogram=kg gram=gm litre=ltr powder=pwd pack=pk"
SUFFIXES = ["Lite", "Plus", "Max", "Gold", "Mini"]


def variants(name: Column, seed: int = 42) -> tuple[Column, Column, Column, Column]:
    """(typos in long words, abbreviated lower case, rotated or upper case, hard negative) of a name, chosen by hashes.

    The hard negative doubles the first whole number or, without one, adds a suffix.
    """
    tokens = F.split(name, " ")
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name)), 1, 8), 16, 10).cast("bigint")
    odd = lambda t: F.conv(F.substring(F.md5(F.concat(F.lit(f"t{seed}|"), t)), 1, 4), 16, 10).cast("int") % 10 < 3
    typos = F.array_join(F.transform(tokens, lambda t: F.when((F.length(t) > 4) & odd(t), add_typo(t, seed)).otherwise(t)), " ")
    short = F.create_map(*[F.lit(x) for p in SHORT.split() for x in p.split("=")])
    brief = F.array_join(F.transform(F.split(F.lower(name), " "), lambda t: F.coalesce(F.try_element_at(short, t), t)), " ")
    rotated = F.array_join(F.concat(F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 1, 1)), " ")
    number = F.regexp_extract(name, "([0-9]+)", 1)
    doubled = F.regexp_replace(name, F.concat(F.lit("^([^0-9]*)"), number), F.concat(F.lit("$1"), (2 * number.try_cast("bigint")).cast("string")))
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (h % len(SUFFIXES) + 1).cast("int"))
    return typos, brief, F.when(h % 2 == 0, rotated).otherwise(F.upper(name)), F.when(number.try_cast("bigint").isNotNull(), doubled).otherwise(F.concat(name, F.lit(" "), suffix))


def synthetic_pairs(df: DataFrame, name: str) -> DataFrame:
    """``original, variant, kind, label``: three positives and a hard negative for every distinct name."""
    typos, brief, turned, negative = variants(F.col("original"))
    rows = F.array(*[F.struct(v.alias("variant"), F.lit(k).alias("kind"), F.lit(k != "negative").alias("label")) for v, k in ((typos, "typos"), (brief, "brief"), (turned, "turned"), (negative, "negative"))])
    names = df.where(F.length(F.trim(name)) > 0).select(F.col(name).alias("original")).distinct()
    return names.select("original", F.explode(rows).alias("r")).select("original", "r.*")


def transliteration_map(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``roman, native, others``: the most frequent native spelling of each roman word of a vocabulary, ties to the smaller,
    and the other romanisations of it.
    """
    counts = pairs.join(vocabulary.select("roman").distinct(), "roman", "left_semi").groupBy("roman", "native").count()
    w = Window.partitionBy("roman").orderBy(F.desc("count"), "native")
    best = counts.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("roman", "native")
    all_ = pairs.join(best.select("native").distinct(), "native", "left_semi").select("native", "roman").distinct().groupBy("native").agg(F.collect_set("roman").alias("all"))
    return best.join(all_, "native", "left").select("roman", "native", F.array_sort(F.array_except(F.col("all"), F.array("roman"))).alias("others"))


def training_triplets(synthetic: DataFrame, matched: DataFrame, held_out: DataFrame) -> DataFrame:
    """``anchor, positive, negative``: synthetic positives with their hard negative, and matched pairs without one.

    Anchors that occur in ``held_out(original)`` are left out by an anti-join.
    """
    positive = synthetic.where("label").select("original", "variant")
    negative = synthetic.where("not label").select("original", F.col("variant").alias("negative"))
    made = positive.join(negative, "original").select(F.col("original").alias("anchor"), F.col("variant").alias("positive"), "negative")
    given = matched.select(F.col("left").alias("anchor"), F.col("right").alias("positive"), F.lit(None).cast("string").alias("negative"))
    out = made.union(given).where("anchor <> positive").distinct()
    return out.join(held_out.select(F.col("original").alias("anchor")).distinct(), "anchor", "left_anti")


def class_tfidf(df: DataFrame, group: str, text: str, top: int = 5) -> DataFrame:
    """``group, term, score, rank``: the terms that set each group apart, by term share times log(1 + mean size / frequency)."""
    words = df.select(F.col(group).alias("g"), F.explode(F.split(F.lower(F.trim(text)), r"[^a-z0-9]+")).alias("term")).where("term <> '' and g is not null")
    c = words.groupBy("g", "term").agg(F.count("*").alias("c"))
    size = c.groupBy("g").agg(F.sum("c").alias("n"))
    freq = c.groupBy("term").agg(F.sum("c").alias("f"))
    mean = size.agg(F.avg("n").alias("a"))
    scored = c.join(size, "g").join(freq, "term").crossJoin(mean).select("g", "term", F.round(F.col("c") / F.col("n") * F.log(1 + F.col("a") / F.col("f")), 6).alias("score"))  # mean is one row
    w = Window.partitionBy("g").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(F.col("g").alias(group), "term", "score", "rank")
