"""Reading amounts and pack counts out of free product text (row-local, Arrow-friendly Python).

Spark has no built-in for Unicode folding or for a replacement that depends on a computed number, so these run inside
Arrow batches. Unit arithmetic is not done here: a parsed part keeps its unit spelling and meets the conversion table
in a join (:mod:`listwright.operators.units`).
"""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction
from functools import lru_cache

from listwright.functions.charfold import fold

# Unit spellings by unit. A final full stop is optional wherever a spelling is read.
SPELLINGS = """
mg: mg mgs milligram milligrams
g: g gm gms gr grm gram grams gramme grammes ग्राम ग्रा
100g: 100g
kg: kg kgs k.g kilo kilos kilogram kilograms किलो किग्रा किलोग्राम
oz: oz ounce ounces
lb: lb lbs pound pounds
ml: ml mls millilitre millilitres milliliter milliliters मिली मिलीलीटर
100ml: 100ml
cl: cl centilitre centilitres centiliter centiliters
l: l lt ltr ltrs litre litres liter liters लीटर
mm: mm mms millimetre millimetres millimeter millimeters मिमी
cm: cm cms centimetre centimetres centimeter centimeters सेमी
m: m mtr mtrs metre metres meter meters मीटर
inch: inch inches "
ft: ft feet foot
yd: yd yds yard yards
"""

# Words that stand before or after a number of packed units.
PACK_OF = "pack set combo box case pk"
PIECE_WORDS = "pc pcs piece pieces nos"


@lru_cache(1)
def spellings() -> dict[str, str]:
    """Spelling to unit."""
    return {s: unit for line in SPELLINGS.strip().split("\n") for unit, _, all_ in [line.partition(":")] for s in all_.split()}


_DIGITS = {cp: str(unicodedata.digit(chr(cp))) for cp in range(0x660, 0x1E960) if unicodedata.category(chr(cp)) == "Nd"}
_VULGAR = {chr(cp): Fraction(unicodedata.normalize("NFKC", chr(cp)).replace("⁄", "/")) for cp in [0xBC, 0xBD, 0xBE, *range(0x2150, 0x215F)]}
_V = "".join(_VULGAR)
_NUMBER = rf"(?:\d+\s?[{_V}]|[{_V}]|\d+[ -]\d+/\d+|\d+/\d+|[1-9]\d{{0,2}}(?:,\d{{2,3}})*,\d{{3}}(?!\d)(?:\.\d+)?|\d+,\d+|\d*\.\d+|\d+|half(?= ))"
_AT = re.compile(rf"({_NUMBER})(\s*)(k\.g|\"|[a-z\u0900-\u097f]+)\.?(?!\d)")
_MORE = re.compile(rf"(?: and | & | )({_NUMBER})\s*(\"|[a-z\u0900-\u097f]+)")
_START = re.compile(rf"[\d{_V}]+|half |\.\d+")
_TIMES = re.compile(rf"(?<=\d)\s*[x×*]\s*(?=[\d.{_V}]|half )")
_GENERATION = re.compile(r"[345]g")
_OF = re.compile(rf"\b(?:{PACK_OF.replace(' ', '|')}) of (\d{{1,4}})\b")
_BEFORE = re.compile(rf"(?<![\w.,/])(\d{{1,3}}) x (?=[\d.{_V}]|half )")
_AFTER = re.compile(r"[^\W\d_\u200d]?[\"\u0900-\u097f.)\]a-z] x (\d{1,3})(?![\w.,])")
_PIECES = re.compile(rf"(?<![\w.,/])(\d{{1,4}}) ?(?:{PIECE_WORDS.replace(' ', '|')})\b")


def plain(text: str) -> str:
    """Folded, lower case, ASCII digits, ``3x50`` spaced out: the form that amounts are read from."""
    text = fold(text).lower()
    if not text.isascii():
        text = text.translate(_DIGITS)
    return _TIMES.sub(" x ", text)


def number(text: str) -> Fraction | int | None:
    """A decimal, thousands, decimal-comma, fraction or mixed number; null for a zero denominator."""
    text = text.strip()
    if text.isdecimal():
        return int(text)
    if text == "half":
        return Fraction(1, 2)
    if text[-1] in _VULGAR:
        return (Fraction(text[:-1].strip()) if text[:-1].strip() else 0) + _VULGAR[text[-1]]
    if "/" in text:
        whole, _, rest = re.sub("[ -]", " ", text).rpartition(" ")
        top, bottom = map(int, rest.split("/"))
        return None if not bottom else Fraction(int(whole or 0)) + Fraction(top, bottom)
    if re.fullmatch(r"[1-9]\d{0,2}(?:,\d{2,3})*,\d{3}(?:\.\d+)?", text):
        return Fraction(text.replace(",", ""))
    return Fraction(text.replace(",", "."))


def amounts(text: str | None, title: bool = True) -> list[tuple[float, str]]:
    """The first stated mass, volume or length of ``text`` as one part, or two where it is written in two parts.

    Each part is (value, unit). Null, empty and amount-free texts give []. In a title what follows `` + `` belongs to an
    added article and ``4G``/``5G`` without a blank names a network generation, so neither is read.
    """
    return amounts_in(plain(text).partition(" + ")[0] if title else plain(text), title) if text else []


def amounts_in(text: str, title: bool = True) -> list[tuple[float, str]]:
    """:func:`amounts` of a text that went through :func:`plain` already."""
    names, done = spellings(), 0
    for start in _START.finditer(text):
        at = start.start()
        if at < done or at and (text[at - 1].isalnum() or text[at - 1] in ".,/_"):
            continue
        if not (m := _AT.match(text, at)):
            continue
        unit = names.get(m[3])
        if unit is None:
            continue
        done = m.end(3)
        value = number(m[1])
        if not value or value <= 0 or title and not m[2] and _GENERATION.fullmatch(m[1] + m[3]):
            continue
        out = [(float(value), unit)]
        if (more := _MORE.match(text, m.end())) and (unit, second := names.get(more[2])) in TWO_PART and (value := number(more[1])):
            out.append((float(value), second))
        return out
    return []


# Units in which one amount is written in two parts.
TWO_PART = {("kg", "g"), ("g", "mg"), ("lb", "oz"), ("l", "ml"), ("l", "cl"), ("m", "cm"), ("m", "mm"), ("cm", "mm"), ("ft", "inch"), ("yd", "ft")}


def packs(text: str | None) -> list[int]:
    """Every pack count stated in a text, in order, without what follows `` + ``. ``2 in 1`` and ``B1G1`` are none."""
    return packs_in(plain(text).partition(" + ")[0]) if text else []


def packs_in(text: str) -> list[int]:
    """:func:`packs` of a text that went through :func:`plain` already."""
    rules = [_OF] * (" of " in text) + [_AFTER] * (" x " in text) + [_PIECES] * any(w in text for w in ("pc", "piece", "nos"))
    found = [(m.start(), int(m[1])) for rule in rules for m in rule.finditer(text)]
    if " x " in text:
        names = spellings()
        found += [(m.start(), int(m[1])) for m in _BEFORE.finditer(text) if (unit := _AT.match(text, m.end())) and unit[3] in names]
    return [n for _, n in sorted(found) if n > 0]
