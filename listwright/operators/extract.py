"""Attribute extraction by gazetteers, slot scoring, and hooks for models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.functions.text import first_quantity, model_codes, pack_count
from listwright.operators.mapping import prf_columns
from listwright.operators.units import spelling_table
from listwright.runtime import broadcast_if_small

# Colours and cuts that are never brands.
COLOURS = "black white grey gray silver gold red maroon pink orange yellow green teal olive blue navy purple violet brown beige cream crème"
CUTS = "slim regular loose fit skinny straight round neck crew"

_WORDS = r"[^\p{L}\p{N}']+"


def words(text: Column) -> Column:
    """Lower-case words of a text."""
    return F.filter(F.split(F.lower(text), _WORDS), lambda w: w != "")


def brand_gazetteer(*columns: DataFrame) -> DataFrame:
    """``brand, phrase``: distinct trimmed values of one-column tables, two characters or more, without colours and cuts.

    ``phrase`` is the value in lower-case words; of several spellings of one phrase the smallest is kept.
    """
    parts = [df.select(F.trim(df.columns[0]).alias("brand")) for df in columns]
    union = parts[0]
    for p in parts[1:]:
        union = union.union(p)
    stop = [w for w in (COLOURS + " " + CUTS).split()]
    named = union.where(F.length("brand") >= 2).withColumn("phrase", F.array_join(words(F.col("brand")), " ")).where((F.col("phrase") != "") & ~F.col("phrase").isin(*stop))
    return named.groupBy("phrase").agg(F.min("brand").alias("brand")).select("brand", "phrase")


def phrase_matches(df: DataFrame, key: str, text: str, gazetteer: DataFrame, longest: int = 4) -> DataFrame:
    """``key, value, start, size``: the first of the longest phrases of a gazetteer in each text.

    Word n-grams meet the gazetteer's phrases in an equi-join, broadcast only within the size bound. Of the matches that
    overlap the longest counts; the leftmost of these is returned. Texts without a match have no row.
    """
    w = words(F.col(text))
    of = lambda n: F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.lit(n).alias("size"), i.alias("start"), F.array_join(F.slice(w, i, n), " ").alias("phrase")))
    grams = df.select(key, F.explode(F.concat(*[of(n) for n in range(1, longest + 1)])).alias("g")).select(key, "g.*")
    hits = grams.join(broadcast_if_small(gazetteer.select("phrase", F.col("brand").alias("value"))), "phrase")
    found = hits.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("n"), "start", "value"))).alias("h"))
    free = lambda acc, s: ~F.exists(acc, lambda o: (s["start"] < o["start"] - o["n"]) & (o["start"] < s["start"] - s["n"]))
    kept = F.aggregate("h", F.slice("h", 1, 0), lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(s))).otherwise(acc))
    first = F.array_min(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), (-s["n"]).alias("size"), s["value"].alias("value"))))
    return found.select(key, first.alias("f")).select(key, "f.value", "f.start", "f.size")


def product_type(text: Column, taken: Column) -> Column:
    """The last up to three alphabetic words of the first segment that aren't taken already; null without one.

    No tagger is at hand, so the last words before the first separator stand for the last noun phrase.
    """
    segment = F.regexp_extract(text, r"^([^,(|/\[]*?)(?: - |[,(|/\[]|$)", 1)
    left = F.filter(words(segment), lambda t: t.rlike(r"^\p{L}+$") & ~F.array_contains(taken, t))
    last = F.slice(left, F.greatest(F.size(left) - 2, F.lit(1)), F.lit(3))
    return F.nullif(F.array_join(last, " "), F.lit(""))


def extract_rules(df: DataFrame, key: str, text: str, gazetteer: DataFrame) -> DataFrame:
    """``key, brand, colour, product_type`` by gazetteers and word order."""
    colours = df.sparkSession.createDataFrame([(c, c) for c in COLOURS.split()], "brand string, phrase string")
    brand = phrase_matches(df, key, text, gazetteer).select(key, F.col("value").alias("brand"))
    colour = phrase_matches(df, key, text, colours, 1).select(key, F.col("value").alias("colour"))
    met = df.select(key, text).join(brand, key, "left").join(colour, key, "left")
    taken = F.concat(F.coalesce(words(F.col("brand")), F.array().cast("array<string>")), F.array(*map(F.lit, COLOURS.split())))
    return met.select(key, "brand", "colour", product_type(F.col(text), taken).alias("product_type"))


def extract_model(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[dict]], labels: list[str]) -> DataFrame:
    """``key`` and one string column per label, from a model that reads a batch of texts; missing labels are null."""
    schema = T.StructType([df.schema[key], *(T.StructField(x, T.StringType()) for x in labels)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f.get(x) for f in found], pa.string()) for x in labels)], names=[key, *labels])

    return df.select(key, text).mapInArrow(run, schema)


def best_spans(spans: DataFrame, key: str, threshold: float = 0.4) -> DataFrame:
    """``key, label, value, score``: of a model's ``(key, label, value, start, score)`` the best span per label at or above a
    threshold, ties to the first.
    """
    good = spans.where((F.col("score") >= threshold) & F.col("value").isNotNull())
    best = good.groupBy(key, "label").agg(F.min(F.struct((-F.col("score")).alias("s"), "start", "value")).alias("b"))
    return best.select(key, "label", F.col("b.value").alias("value"), (-F.col("b.s")).alias("score"))


#: Fields of the typed record that a provider reads from a name.
RECORD = "brand string, product_type string, variant string, quantity string, pack_count int, colour string"


def extract_record(df: DataFrame, key: str, text: str, provider: Callable[[str], str], examples: tuple[tuple[str, str], ...] = (), **how) -> DataFrame:
    """``key`` and the fields of RECORD, read by a provider after a few ``(name, JSON)`` examples; all null where no valid reply came.

    A reply is valid if it is an object with no other fields, texts where texts are due and a positive whole pack count.
    """
    from listwright.operators.providers import ask

    names = [f.split()[0] for f in RECORD.split(", ")]
    shown = "".join(f"Name: {n}\nRecord: {r}\n" for n, r in examples)

    def valid(reply: dict) -> bool:
        pack = reply.get("pack_count")
        texts = all(reply.get(n) is None or isinstance(reply[n], str) for n in names if n != "pack_count")
        return set(reply) <= set(names) and texts and (pack is None or isinstance(pack, int) and not isinstance(pack, bool) and pack > 0)

    met, _ = ask(df.select(key, F.concat(F.lit(shown + "Name: "), F.col(text), F.lit("\nRecord:")).alias("prompt")), "prompt", provider, valid, **how)
    return met.select(key, F.from_json("response", RECORD).alias("r")).select(key, *[F.col(f"r.{n}").alias(n) for n in names])


def attribute_record(df: DataFrame, key: str, text: str, brand: str, gazetteer: DataFrame) -> DataFrame:
    """``key, brand, base_unit, amount, pack_count, codes``: the recorded brand in lower case, else the gazetteer's, with
    the first quantity in its canonical unit, the pack count and the model codes of the text.
    """
    value, unit = first_quantity(F.col(text))
    units = broadcast_if_small(spelling_table(df.sparkSession))
    found = phrase_matches(df.where(F.col(text).isNotNull()), key, text, gazetteer).select(key, F.lower("value").alias("found"))
    read = df.select(key, F.nullif(F.lower(F.trim(brand)), F.lit("")).alias("brand"), value.alias("value"), unit.alias("spelling"), pack_count(F.col(text)).alias("pack_count"), F.coalesce(F.array_join(model_codes(F.col(text)), " "), F.lit("")).alias("codes"))
    met = read.join(units, "spelling", "left").join(found, key, "left")
    return met.select(key, F.coalesce("brand", "found").alias("brand"), "base_unit", F.round(F.col("value") * F.col("factor"), 3).alias("amount"), "pack_count", "codes")


def attribute_pairs(df: DataFrame, key: str, scores: str) -> DataFrame:
    """``key, attribute, value, places`` of a ``map<attribute, map<value, struct<pid>>>`` column, without ``n/a``."""
    outer = df.select(key, F.explode(scores).alias("attribute", "values"))
    return outer.select(key, "attribute", F.explode("values").alias("value", "at")).where("value <> 'n/a'").select(key, "attribute", "value", F.col("at.pid").alias("places"))


def title_values(pairs: DataFrame, key: str, place: int = 0) -> DataFrame:
    """``key, attribute, values``: the values that occur in the given place (0 is the title)."""
    return pairs.where(F.array_contains("places", place)).groupBy(key, "attribute").agg(F.array_sort(F.collect_set("value")).alias("values"))


def slot_scores(predicted: DataFrame, gold: DataFrame, key: str, lenient: bool = False) -> DataFrame:
    """``attribute, tp, fp, fn, precision, recall, f1`` and a ``MACRO`` row, from ``(key, attribute, value)`` and
    ``(key, attribute, values)``.

    A wrong value is a false positive and, where gold exists, a false negative too. Lenient values match where one holds
    the other as whole words.
    """
    v = F.lower(F.trim("value"))
    pad = lambda c: F.concat(F.lit(" "), F.lower(F.trim(c)), F.lit(" "))
    same = (lambda g: F.contains(pad(g), pad(F.col("value"))) | F.contains(pad(F.col("value")), pad(g))) if lenient else (lambda g: F.lower(F.trim(g)) == v)
    met = predicted.where("value is not null").join(gold, [key, "attribute"], "full")
    hit = F.coalesce(F.exists("values", same), F.lit(False)) & F.col("value").isNotNull()
    per = prf_columns(met.groupBy("attribute").agg(F.count_if(hit).alias("tp"), F.count_if(F.col("value").isNotNull() & ~hit).alias("fp"), F.count_if(F.col("values").isNotNull() & ~hit).alias("fn")))
    macro = per.agg(F.lit("MACRO").alias("attribute"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.round(F.avg(c), 3).alias(c) for c in ("precision", "recall", "f1")])
    return per.unionByName(macro)


def interleaved_sample(df: DataFrame, key: str, source: str, n: int, seed: int = 42) -> DataFrame:
    """``rank, source, key``: n rows taken from the sources in turn, each source in a seeded order."""
    w = Window.partitionBy(source).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    turn = df.select(source, key).distinct().withColumn("turn", F.row_number().over(w))
    return turn.orderBy("turn", source, key).limit(n)
