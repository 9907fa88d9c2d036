"""The part that words of product names play, learned from the catalogue itself.

A word that occurs in a brand column is a brand word. One that goes with several brands is a term: a kind of article or a
property. The others name product lines. Rare spellings of a term are corrected to it. Terms that stand for each other
are found without a dictionary: in listings that agree in line, amount, pack count and added article, two wordings of one
meaning keep meeting in different names and never in the same one, while two properties rarely meet at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.operators.spelling import corrections
from listwright.runtime import broadcast_if_small, drop_stored, stored

#: Distinct brands with which a word has to occur to be a term.
BRANDS = 3
#: Share of a term's groups in which another one has to occur to stand for it, or to be understood where it is stated.
MEETS = 0.4
#: Share of a term's names that may hold the term it stands for.
TOGETHER = 0.05
#: Share of a term's names that hold the term it is part of, and of their groups that both have in common.
PART, COMMON = 0.9, 0.25
#: Words of a long name that are looked at together.
WINDOW = 32


def _sorted_words(flag: Column, word: str = "w") -> Column:
    return F.array_join(F.array_sort(F.collect_set(F.when(flag, F.col(word)))), " ")


def word_roles(parsed: DataFrame, brands: int = BRANDS) -> DataFrame:
    """``w, role, to``: each left-over word is a ``brand`` word, a ``term`` (``to`` its correct spelling) or part of a ``line``.

    ``parsed`` holds ``brand`` and ``over``, words apart by one blank. Words are counted once per distinct pair of the two,
    weighted by its rows, so a listing repeated any number of times costs one row.
    """
    distinct = parsed.where("over <> ''").groupBy("over", "brand").agg(F.count("*").alias("n"))
    each = distinct.select(F.explode(F.array_distinct(F.split("over", " "))).alias("w"), "brand", "n")
    named = parsed.where("brand is not null").select(F.explode(F.split("brand", " ")).alias("w")).distinct().withColumn("named", F.lit(True))
    counts = each.groupBy("w").agg(F.sum("n").alias("count"), F.count_distinct("brand").alias("brands")).join(named, "w", "left")
    words = stored(counts.select("w", "count", F.when(F.col("named"), "brand").when(F.col("brands") >= brands, "term").otherwise("line").alias("role")), "words")
    terms = words.where("role = 'term'").select(F.col("w").alias("token"), "count")
    if terms.isEmpty():
        return words.select("w", "role", F.col("w").alias("to"))
    rare = words.where("role <> 'brand'").select(F.col("w").alias("token"), "count")
    fixed = corrections(rare, terms.union(rare.join(terms.select("token"), "token", "left_anti").withColumn("count", F.lit(0).cast("bigint"))), unseen_only=False)
    fixed = fixed.select(F.col("token").alias("w"), "word")
    return words.join(fixed, "w", "left").select("w", F.when(F.col("word").isNotNull(), "term").otherwise(F.col("role")).alias("role"), F.coalesce("word", "w").alias("to"))


def _pairs(df: DataFrame, group: str) -> DataFrame:
    """``a, b, n``: in how many groups two different words occur, in both directions; ``df`` holds distinct group and word."""
    x, y = df.select(group, F.col("w").alias("a")), df.select(group, F.col("w").alias("b"))
    return x.join(y, group).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def wordings(listed: DataFrame, meets: float = MEETS) -> DataFrame:
    """``w, concept``: for each term the most frequent term that it is another wording or a fixed part of, or itself.

    ``listed`` holds ``name`` (an id of the name), ``meeting`` (an id of the line, amount, pack count and added article) and
    ``terms`` (an array). Pairs are those of words of one meeting, whose number is bounded by the vocabulary, not by the
    listings; words of a long name meet within windows. A term points to a more frequent one, so that pointers form trees.
    """
    placed = listed.select("name", "meeting", F.posexplode("terms").alias("p", "w")).select("name", F.xxhash64("meeting", F.floor(F.col("p") / WINDOW)).alias("meeting"), F.xxhash64("name", F.floor(F.col("p") / WINDOW)).alias("part"), "w")
    meeting, part = placed.select("meeting", "w").distinct(), placed.select("part", "w").distinct()
    in_meetings, in_names = meeting.groupBy("w").agg(F.count("*").alias("c")), part.groupBy("w").agg(F.count("*").alias("r"))
    seen = stored(in_meetings.join(in_names, "w"), "seen")
    of = lambda k: seen.select(F.col("w").alias(k), F.col("c").alias(f"c_{k}"), F.col("r").alias(f"r_{k}"))
    met = _pairs(meeting, "meeting").where("a <> b").join(of("a"), "a").join(of("b"), "b")
    upward = met.where("struct(c_b, b) > struct(c_a, a)").where(F.col("n") >= COMMON * F.col("c_a"))
    both = upward.join(_pairs(part, "part").select("a", "b", F.col("n").alias("same")), ["a", "b"], "left")
    share, same = F.col("n") / F.col("c_a"), F.coalesce(F.col("same") / F.col("r_a"), F.lit(0.0))
    jaccard = F.col("n") / (F.col("c_a") + F.col("c_b") - F.col("n"))
    good = both.where(((share >= meets) & (same <= TOGETHER)) | ((jaccard >= COMMON) & (same >= PART)))
    best = good.groupBy("a").agg(F.max(F.struct(F.round(share, 9).alias("s"), F.round(jaccard, 9).alias("j"), "b"))["b"].alias("b"))
    tree = stored(seen.select("w").join(best.withColumnRenamed("a", "w"), "w", "left").select("w", F.coalesce("b", "w").alias("concept")), "tree")
    while True:  # pointers to pointers: the depth is halved in every round
        up = tree.select(F.col("w").alias("concept"), F.col("concept").alias("top"))
        after = stored(tree.join(up, "concept").select("w", F.col("top").alias("concept"), (F.col("top") != F.col("concept")).alias("moved")), "tree")
        moved = not after.where("moved").isEmpty()
        drop_stored(tree)
        tree = after.select("w", "concept")
        if not moved:
            return tree


def understood(listed: DataFrame, meets: float = MEETS) -> DataFrame:
    """``a, b``: concepts ``b`` that add nothing where ``a`` is stated, since most meetings of ``a`` have the more frequent ``b``.

    ``listed`` is as in :func:`wordings`, its terms being concepts.
    """
    placed = listed.select(F.posexplode("terms").alias("p", "w"), "meeting").select(F.xxhash64("meeting", F.floor(F.col("p") / WINDOW)).alias("meeting"), "w").distinct()
    count = placed.groupBy("w").agg(F.count("*").alias("c"))
    met = _pairs(placed, "meeting").join(count.select(F.col("w").alias("a"), F.col("c").alias("c_a")), "a").join(count.select(F.col("w").alias("b"), F.col("c").alias("c_b")), "b")
    return met.where((F.col("n") >= meets * F.col("c_a")) & (F.col("c_b") > F.col("c_a"))).select("a", "b")


def with_words(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``line`` and ``terms`` in place of ``over``, and ``brand`` filled from the words of the name.

    Either is null where no word is left for it. Word lists meet in joins on distinct left-overs; nothing is held on the driver.
    """
    roles = stored(word_roles(parsed), "roles")
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    each = parsed.where("over <> ''").select("over").distinct().select("over", F.posexplode(F.split("over", " ")).alias("p", "w")).join(broadcast_if_small(roles), "w")
    role = lambda r: F.col("role") == r
    in_order = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(role("line"), F.struct("p", "w")))), lambda x: x["w"]))
    cut = each.groupBy("over").agg(F.array_join(in_order, " ").alias("line"), _sorted_words(role("brand")).alias("named"), F.array_sort(F.collect_set(F.when(role("term"), F.col("to")))).alias("words"))
    split = parsed.join(broadcast_if_small(stored(cut, "cut")), "over", "left").withColumn("line", some("line")).withColumn("brand", F.coalesce("brand", some("named"))).drop("named")
    if roles.where("role = 'term'").isEmpty():
        return split.drop("over", "words").withColumn("terms", F.lit(None).cast("string"))
    split = stored(split, "split")
    meeting = F.xxhash64("line", "base", F.coalesce(F.col("amount"), F.lit(-1.0)), "pack", F.coalesce("article", F.lit("")))
    listed = stored(split.where("line is not null and size(words) > 0").select(F.xxhash64("over").alias("name"), meeting.alias("meeting"), F.col("words").alias("terms")).distinct(), "listed")
    concept = stored(wordings(listed), "concept")
    alike = lambda df, keep: df.select(*keep, F.explode("terms").alias("w")).join(concept, "w").groupBy(*keep).agg(F.array_sort(F.collect_set("concept")).alias("terms"))
    spare = understood(alike(listed, ["name", "meeting"]))
    sets = alike(split.where("size(words) > 0").select("words", F.col("words").alias("terms")).distinct(), ["words"])
    dropped = sets.select("words", F.explode("terms").alias("a")).join(spare, "a").groupBy("words").agg(F.collect_set("b").alias("dropped"))
    final = sets.join(dropped, "words", "left").select("words", F.array_join(F.array_except("terms", F.coalesce("dropped", F.array().cast("array<string>"))), " ").alias("terms"))
    return split.join(final, "words", "left").withColumn("terms", some("terms")).drop("over", "words")

