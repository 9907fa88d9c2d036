"""Spelling correction against a corpus dictionary, and mining of abbreviations, as equi-joins on shared fragments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.functions.text import expand_abbreviations, first_quantity, lemmatize, pack_count, with_normalized
from listwright.operators.units import spelling_table
from listwright.runtime import broadcast_if_small

# Limits of the corrector.
MIN_COUNT, MIN_LENGTH, LONG_WORD, RATIO = 3, 5, 8, 10


def edit_distance(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours, no fragment edited twice; most + 1 if there are more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one, row = [], list(range(len(b) + 1)), []
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def _deletes(word: str):
    """All strings with up to two letters deleted from a word."""
    one = F.transform(F.sequence(F.lit(1), F.length(word)), lambda k: F.concat(F.substring(word, F.lit(1), k - 1), F.substring(word, k + 1, F.length(word))))
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    two = F.when(F.length(word) >= LONG_WORD - 2, F.flatten(F.transform(one, cut))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.col(word)), one, two))


def corrections(tokens: DataFrame, dictionary: DataFrame, unseen_only: bool = True) -> DataFrame:
    """``token, word, distance``: the correction of each token that has one.

    Dictionary words are alphabetic and counted at least three times in ``dictionary(token, count)``. A token of five or
    more letters goes to the nearest, then most frequent word within one edit (two from eight letters on) whose count is
    ten times its own. Both sides meet on shared deletions, so no token is compared with the whole dictionary.
    """
    words = dictionary.where((F.col("count") >= MIN_COUNT) & F.col("token").rlike("^[a-z]+$")).select(F.col("token").alias("word"), F.col("count").alias("n"))
    asked = tokens.select("token").distinct().where((F.length("token") >= MIN_LENGTH) & F.col("token").rlike("^[a-z]+$")).join(dictionary.select("token", "count"), "token", "left").withColumn("own", F.coalesce("count", F.lit(0)))
    if unseen_only:
        asked = asked.join(words.select(F.col("word").alias("token")), "token", "left_anti")
    left = asked.select("token", "own", F.explode(_deletes("token")).alias("d"))
    right = words.where(F.length("word") >= MIN_LENGTH - 2).select("word", "n", F.explode(_deletes("word")).alias("d"))
    met = left.join(right, "d").where((F.col("token") != F.col("word")) & (F.col("n") >= RATIO * F.greatest("own", F.lit(1)))).select("token", "word", "n").distinct()
    schema = T.StructType([*met.schema.fields, T.StructField("distance", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([edit_distance(a, b, 2) for a, b in pairs], pa.int32())], names=schema.names)

    near = met.mapInArrow(run, schema).where(F.col("distance") <= F.when(F.length("token") < LONG_WORD, 1).otherwise(2))
    w = Window.partitionBy("token").orderBy("distance", F.desc("n"), "word")
    return near.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("token", "word", "distance")


def correct_text(df: DataFrame, key: str, text: str, fixes: DataFrame) -> DataFrame:
    """``key, corrected``: every token of a text replaced by its correction."""
    each = df.select(key, F.posexplode(F.split(text, " ")).alias("p", "token")).join(fixes.select("token", "word"), "token", "left")
    parts = each.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("p", F.coalesce("word", "token").alias("w")))).alias("x"))
    return parts.select(key, F.array_join(F.col("x.w"), " ").alias("corrected"))


def clean_names(df: DataFrame, key: str, name: str, fixes: DataFrame | None = None) -> DataFrame:
    """``key, name_clean, name_norm, qty_value, qty_unit, pack_count`` of raw names: the whole cleaner in one plan.

    Names are normalized, abbreviations spelled out and, with ``fixes(token, word)``, misspelt words put right; name_norm has
    lemmas in their place. The amount and the pack count are read from the raw name, the pack count else from the
    clean one. Null names give nulls; of repeated keys with different names the smallest counts.
    """
    once = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(name).alias("_name"))
    clean = with_normalized(once, "_name", "_clean").withColumn("_clean", expand_abbreviations(F.col("_clean")))
    if fixes is not None:
        mended = correct_text(clean.where(F.col("_clean").isNotNull()).select(key, "_clean"), key, "_clean", fixes)
        clean = clean.join(mended, key, "left").withColumn("_clean", F.coalesce("corrected", "_clean")).drop("corrected")
    value, unit = first_quantity(F.col("_name"))
    read = clean.select(key, F.col("_clean").alias("name_clean"), lemmatize(F.col("_clean")).alias("name_norm"), value.alias("_v"), unit.alias("spelling"), F.coalesce(pack_count(F.col("_name")), pack_count(F.col("_clean"))).alias("pack_count"))
    met = read.join(broadcast_if_small(spelling_table(df.sparkSession)), "spelling", "left")
    return met.select(key, "name_clean", "name_norm", F.round(F.col("_v") * F.col("factor"), 3).alias("qty_value"), F.col("base_unit").alias("qty_unit"), "pack_count")


def mine_abbreviations(counts: DataFrame, top: int = 60) -> DataFrame:
    """``short, long, short_count, long_count``: likely abbreviations in ``(token, count)``.

    A token of two to five letters seen three times that begins a word of at least six letters and two more; its most
    frequent expansion counts if it is at least twice as frequent. Words meet on their prefixes.
    """
    alpha = counts.where(F.col("token").rlike("^[a-z]+$"))
    short = alpha.where(F.length("token").between(2, 5) & (F.col("count") >= 3)).select(F.col("token").alias("short"), F.col("count").alias("short_count"))
    long = alpha.where(F.length("token") >= 6).select(F.col("token").alias("long"), F.col("count").alias("long_count"), F.explode(F.transform(F.sequence(F.lit(2), F.lit(5)), lambda k: F.substring("token", F.lit(1), k))).alias("short"))
    met = short.join(long, "short").where(F.length("long") >= F.length("short") + 2)
    best = met.groupBy("short", "short_count").agg(F.min(F.struct((-F.col("long_count")).alias("n"), F.col("long"))).alias("b")).where(-F.col("b.n") >= 2 * F.col("short_count"))
    return best.select("short", F.col("b.long").alias("long"), "short_count", (-F.col("b.n")).alias("long_count")).orderBy(F.desc("short_count"), "short").limit(top)


def spelling_quality(typos: DataFrame, fixes: DataFrame) -> DataFrame:
    """``n, restored, wrong``: shares of ``typos(token, original)`` put right, and put wrong."""
    met = typos.join(fixes.select("token", "word"), "token", "left")
    share = lambda c: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4)
    return met.agg(F.count("*").alias("n"), share(F.col("word") == F.col("original")).alias("restored"), share(F.col("word") != F.col("original")).alias("wrong"))


def rollup_accuracy(df: DataFrame, group: str, predicted: str, gold: str) -> DataFrame:
    """``group, n, accuracy`` per value and, under ``ALL``, in total."""
    ok = F.coalesce(F.col(predicted) == F.col(gold), F.lit(False)).cast("int")
    out = df.withColumn("ok", ok).rollup(group).agg(F.count("*").alias("n"), F.round(F.avg("ok"), 4).alias("accuracy"), F.grouping(group).alias("whole"))
    return out.select(F.when(F.col("whole") == 1, "ALL").otherwise(F.col(group).cast("string")).alias(group), "n", "accuracy")
