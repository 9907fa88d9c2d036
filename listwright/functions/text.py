"""Scalar text functions as column expressions, and Arrow functions where a replacement has to be computed."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.functions.quantity import spellings
from listwright.operators.units import compositions
from listwright.runtime import spread

# Abbreviations and their words.
ABBREVIATIONS = "pkt=packet pkts=packets pcs=pieces pc=piece pk=pack choc=chocolate choco=chocolate deo=deodorant"

# English words and what they become in romanised Hindi, in order of replacement.
HINGLISH = """
black pepper=kali mirch
coconut water=nariyal pani
mustard oil=sarson ka tel
turmeric powder=haldi powder
wheat flour=gehu ka atta
rose water=gulab jal
chickpeas=chana
coriander=dhaniya
turmeric=haldi
cardamom=elaichi
mustard=sarson
coconut=nariyal
flour=atta
sugar=chini
water=pani
butter=makkhan
yogurt=dahi
lentils=dal
cumin=jeera
lemon=nimbu
mango=aam
onion=pyaz
potato=aloo
ginger=adrak
garlic=lahsun
spices=masala
tea=chai
milk=doodh
rice=chawal
salt=namak
soap=sabun
oil=tel
"""

# Units and counts as they are read by the cleaner.
_COUNT = "pc pcs piece pieces nos units unit sachets sachet tablets tablet capsules capsule count ct"


def pairs_of(block: str) -> list[tuple[str, str]]:
    """``key=value`` pairs of a block of fixed values, in order."""
    return [tuple(p.split("=")) for p in (block.strip().split("\n") if "\n" in block.strip() else block.split())]


def model_codes(text: Column) -> Column:
    """Distinct tokens of at least four characters with a letter and a digit, joined over ``- / .``, without plain measures."""
    joined = F.regexp_replace(F.lower(text), r"(?<=[a-z0-9])[-/.](?=[a-z]*[0-9])", "")
    tokens = F.regexp_extract_all(joined, F.lit(r"([a-z0-9]+)"), 1)
    keep = lambda t: (F.length(t) >= 4) & t.rlike("[a-z]") & t.rlike("[0-9]") & ~t.rlike("^[0-9]+(gb|tb|mb|mm|cm|in|mp|hz|w|v|g|kg|ml|l)$")
    return F.array_sort(F.array_distinct(F.filter(tokens, keep)))


def expand_abbreviations(text: Column) -> Column:
    """Each token replaced by its word where it is a known abbreviation."""
    table = F.create_map(*[F.lit(x) for p in pairs_of(ABBREVIATIONS) for x in p])
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def parse_number(text: Column) -> Column:
    """A mixed fraction, fraction, number with thousands commas, decimal or leading-dot decimal; null for a zero denominator."""
    t = F.trim(text)
    part = lambda p, k: F.regexp_extract(t, p, k).try_cast("double")
    mixed, frac = r"^([0-9]+)[ -]([0-9]+)/([0-9]+)$", r"^([0-9]+)/([0-9]+)$"
    plain = F.regexp_replace(t, ",", "")
    return (
        F.when(t.rlike(mixed), part(mixed, 1) + part(mixed, 2) / F.nullif(part(mixed, 3), F.lit(0.0)))
        .when(t.rlike(frac), part(frac, 1) / F.nullif(part(frac, 2), F.lit(0.0)))
        .when(plain.rlike(r"^([0-9]+(\.[0-9]+)?|\.[0-9]+)$"), plain.try_cast("double"))
    )


def to_hinglish(name: Column) -> Column:
    """English words replaced one after the other in fixed order, whole words only; null where nothing changed."""
    low = F.lower(name)
    out = reduce(lambda c, p: F.regexp_replace(c, rf"\b{p[0]}\b", p[1]), pairs_of(HINGLISH), low)
    return F.when(out != low, out)


def replace_tokens(text: Column, table: Column) -> Column:
    """Token-wise dictionary replacement; tokens without an entry stay."""
    return F.array_join(F.transform(F.split(text, " "), lambda t: F.coalesce(F.try_element_at(table, t), t)), " ")


def add_typo(word: Column, seed: int = 42) -> Column:
    """One edit of a word of at least three letters, chosen by a hash: delete, double, swap or replace a letter."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), word))
    num = lambda a: F.conv(F.substring(h, a, 4), 16, 10).cast("int")
    n = F.length(word)
    k = F.pmod(num(1), n - 1) + 1
    head, at, after = F.substring(word, F.lit(1), k - 1), F.substring(word, k, F.lit(1)), F.substring(word, k + 1, F.lit(1))
    tail, rest = F.substring(word, k + 1, n), F.substring(word, k + 2, n)
    letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(num(5), F.lit(26)) + 1, F.lit(1))
    kind = F.pmod(num(9), F.lit(4))
    return F.when(n < 3, word).otherwise(F.when(kind == 0, F.concat(head, tail)).when(kind == 1, F.concat(head, at, at, tail)).when(kind == 2, F.concat(head, after, at, rest)).otherwise(F.concat(head, letter, tail)))


def kind_format(kind: Column, raw: Column) -> Column:
    """A raw measure in the target form of its kind: lengths in cm with one decimal (bare numbers are inches), weights in
    whole grams or kilograms with one decimal, counts, speeds with k, sizes in MB, GB or Watts; unread values stay.
    """
    low = F.lower(F.trim(raw))
    form = r'^([0-9,]*\.?[0-9]*(?:[ -][0-9]+/[0-9]+|/[0-9]+)?)[ -]*([a-z"]*)'
    value, unit = parse_number(F.regexp_extract(low, form, 1)), F.regexp_extract(low, form, 2)
    length = F.create_map(*[F.lit(x) for p in (("", 2.54), ('"', 2.54), ("in", 2.54), ("inch", 2.54), ("inches", 2.54), ("cm", 1.0), ("mm", 0.1), ("ft", 30.48), ("feet", 30.48), ("m", 100.0)) for x in p])
    grams = F.create_map(*[F.lit(x) for p in (("g", 1.0), ("gm", 1.0), ("gram", 1.0), ("grams", 1.0), ("kg", 1000.0), ("oz", 28.349523125), ("ounce", 28.349523125), ("ounces", 28.349523125), ("lb", 453.59237), ("lbs", 453.59237), ("pounds", 453.59237)) for x in p])
    big = F.create_map(*[F.lit(x) for p in (("mb", "Megabytes"), ("gb", "Gigabytes"), ("tb", "Terabytes"), ("w", "Watts"), ("watt", "Watts"), ("watts", "Watts")) for x in p])
    cm, g = value * F.try_element_at(length, unit), value * F.try_element_at(grams, unit)
    short = lambda c: F.format_string("%.1f", c)
    whole = lambda c: F.round(c).cast("bigint").cast("string")
    return F.coalesce(
        F.when(kind == "length", short(F.round(cm, 1))),
        F.when(kind == "weight_g", whole(g)),
        F.when(kind == "weight_kg", short(F.round(g / 1000, 1))),
        F.when(kind == "count", whole(value)),
        F.when(kind == "speed", whole(F.when(unit == "k", value * 1000).otherwise(value))),
        F.when(kind == "named", F.when(F.try_element_at(big, unit).isNotNull(), F.concat(whole(value), F.lit(" "), F.try_element_at(big, unit)))),
        raw,
    )


def spans(text: Column, values: Column) -> Column:
    """Character spans of extracted values: ``values`` is an array of ``struct(label, value)``; the first occurrence of each
    in any case, absent ones dropped, of overlapping ones the longest, in order of start.
    """
    low = F.lower(text)
    at = lambda v: F.call_function("instr", low, F.lower(v["value"])) - 1
    found = F.transform(values, lambda v: F.struct((-F.length(v["value"])).alias("size"), at(v).alias("start"), v["label"].alias("label")))
    there = F.array_sort(F.filter(found, lambda s: (s["start"] >= 0) & (s["size"] < 0)))
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    free = lambda acc, s: ~F.exists(acc, lambda o: (s["start"] < o["end"]) & (o["start"] < s["start"] - s["size"]))
    add = lambda acc, s: F.when(free(acc, s), F.concat(acc, F.array(F.struct(s["start"].cast("int").alias("start"), (s["start"] - s["size"]).cast("int").alias("end"), s["label"].alias("label"))))).otherwise(acc)
    return F.array_sort(F.aggregate(there, empty, add))


def lemma(token: Column) -> Column:
    """A singular form by suffix rules with exceptions; anything but lower-case letters stays."""
    keep = token.isin("gas", "bus", "plus", "glass", "lens", "oats", "jeans", "series", "molasses", "hummus", "asparagus")
    bare = (
        F.when(token.rlike("^[a-z]+(ss|us|is)$"), token)
        .when(token.rlike("^[a-z]{2,}ies$"), F.regexp_replace(token, "ies$", "y"))
        .when(token.rlike("^[a-z]+(ch|sh|x|z)es$"), F.regexp_replace(token, "es$", ""))
        .when(token.rlike("^[a-z]{2,}oes$"), F.regexp_replace(token, "es$", ""))
        .when(token.rlike("^[a-z]{3,}s$"), F.regexp_replace(token, "s$", ""))
        .otherwise(token)
    )
    return F.when(keep, token).otherwise(bare)


def lemmatize(text: Column) -> Column:
    """Every token of a text by :func:`lemma`."""
    return F.array_join(F.transform(F.split(text, " "), lemma), " ")


_UNITS = "|".join(re.escape(s) for s in sorted((s for s in spellings() if s.isascii() and s[0].isalpha()), key=len, reverse=True))
_QUANTITY = re.compile(rf'(?<![\w.])(\d+[ -]\d+/\d+|\d+/\d+|\d[\d,]*(?:\.\d+)?|\.\d+)\s*({_UNITS}|")(?![a-z])')


def _shown(x: float) -> str:
    return f"{x:.6g}" if x < 1e6 else f"{x:.0f}"


@lru_cache(1)
def _table() -> dict[str, tuple[str, float]]:
    return {u: (base, float(f)) for u, (base, f, _) in compositions().items()}


def normalize_text(text: str) -> str:
    """Trade marks dropped, compatibility form, lower case, ``&`` spelled out, digits and letters apart, quantities in
    canonical units, punctuation dropped except inside numbers, blanks collapsed. Amounts of a million and more are
    written in plain digits.
    """
    t = unicodedata.normalize("NFKC", re.sub("[™®©]", "", text)).lower().replace("&", " and ")
    t = re.sub(r"(?<=\d)(?=[^\W\d_])|(?<=[^\W\d_])(?=\d)", " ", t)
    table = _table()

    def canonical(m: re.Match) -> str:
        whole, _, frac = re.sub("[ -]", " ", m[1]).rpartition(" ")
        if "/" in frac:
            a, b = map(int, frac.split("/"))
            if not b:
                return m[0]
            value = float(whole or 0) + a / b
        else:
            value = float(m[1].replace(",", "") or 0)
        base, factor = table[spellings()[m[2]]]
        return f"{_shown(round(value * factor, 3))} {base}"

    t = _QUANTITY.sub(canonical, t)
    t = re.sub(r"(?<!\d)[.,]|[.,](?!\d)|[^\w\s.,%]|_", " ", t)
    return " ".join(t.split())


def with_normalized(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with ``out``, the normalized text of a column; null stays null."""
    kept = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    at, schema = kept.index(column), T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if t is None else normalize_text(t) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, out])

    return spread(df).mapInArrow(run, schema)


def match_text(brand: Column, clean: Column) -> Column:
    """Brand and clean name in one text for matching."""
    return F.trim(F.concat_ws(" ", F.lower(F.trim(brand)), clean))


# The forms of a pack count.
PACK_FORMS = [r"\b(?:pack|set|combo|box|case|pk) of ([0-9]{1,4})\b", r"\b([0-9]{1,3}) ?[x*] ", rf"\b([0-9]{{1,4}}) ?(?:{_COUNT.replace(' ', '|')})\b", r"\b([0-9]{1,4}) ?(?:per|/) ?(?:box|carton|pack|case|bag)\b"]


def pack_count(text: Column) -> Column:
    """The leftmost pack count of a text in ASCII: *pack of N*, *N x*, *N pieces*, *N per box*; null without one. Other characters part words."""
    low = F.regexp_replace(F.lower(text), "[^ -~]", "~")
    found = [F.when(F.regexp_instr(low, F.lit(p)) > 0, F.struct(F.regexp_instr(low, F.lit(p)).alias("at"), F.regexp_extract(low, p, 1).cast("int").alias("n"))) for p in PACK_FORMS]
    good = F.filter(F.array(*found), lambda x: x.isNotNull() & (x["n"] > 0))
    return F.array_min(good)["n"]


def first_quantity(text: Column) -> tuple[Column, Column]:
    """(number, unit spelling) of the first mass, volume or length in an ASCII text, for a join with the conversion table."""
    pattern = rf"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*({_UNITS})(?:[^a-z0-9]|$)"
    low = F.lower(text)
    return F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).try_cast("double"), F.nullif(F.regexp_extract(low, pattern, 2), F.lit(""))


def all_quantities(text: Column) -> Column:
    """Every mass, volume or length of an ASCII text in order, as ``array<struct<value, unit>>`` with the unit as it is spelled; ``[]`` without one."""
    low = F.lower(text)
    pattern = rf"(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)\s*(?:{_UNITS})(?![a-z0-9])"
    found = F.coalesce(F.regexp_extract_all(low, F.lit(pattern), 0), F.array().cast("array<string>"))
    return F.transform(found, lambda q: F.struct(F.regexp_extract(q, r"^([0-9.]+)", 1).cast("double").alias("value"), F.regexp_extract(q, r"([a-z]+(?:\.[a-z]+)?|100[a-z]+)$", 1).alias("unit")))


def norm_value(attribute: str, value: Column) -> Column:
    """A slot value in comparable form: counts as their number, quantities in canonical units, other values in lower case with single blanks."""
    low = F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")
    if attribute == "pack_count":
        return F.nullif(F.regexp_extract(low, "([0-9]+)", 1), F.lit(""))
    if attribute == "quantity":
        number, unit = first_quantity(low)
        table = F.create_map(*[F.lit(x) for s, u in spellings().items() if s.isascii() for x in (s, compositions()[u][0])])
        factor = F.create_map(*[F.lit(x) for s, u in spellings().items() if s.isascii() for x in (s, float(compositions()[u][1]))])
        amount = F.round(number * F.try_element_at(factor, unit), 3)
        return F.when(amount.isNotNull(), F.concat_ws(" ", amount.cast("string"), F.try_element_at(table, unit))).otherwise(low)
    return low
