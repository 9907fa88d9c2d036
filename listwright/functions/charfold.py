"""Character tables that draw text which prints alike with one set of code points.

The width, ligature, font and blank tables come by rule from the Unicode database. The look-alike letters are fixed
values. Visible differences stay: case, accents, digits of other scripts, fractions, superscripts, enclosed letters.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

# Letters of other scripts that print like a Latin letter, as "Latin letter: look-alikes".
LOOKALIKES = """
A: Α А
B: Β В
C: Ϲ С
E: Ε Е
F: Ϝ
G: Ԍ
H: Η Н
I: Ι І Ӏ
J: Ј Ϳ
K: Κ К
M: Μ М Ϻ
N: Ν
O: Ο О Օ
P: Ρ Р
Q: Ԛ
S: Ѕ Տ
T: Τ Т
U: Ս
V: Ѵ
W: Ԝ
X: Χ Х
Y: Υ Ү
Z: Ζ
a: а ɑ
c: с ϲ
d: ԁ
e: е
g: ɡ
h: һ հ
i: і
j: ј ϳ
k: к
l: ӏ
n: ո
o: о ο օ
p: р ρ
q: ԛ
s: ѕ
u: ս
v: ν ѵ
w: ԝ
x: х
y: у ү
"""

# Marks drawn like the ASCII mark before the colon.
MARK_ALIKES = """
-: ‐ ‑
': ʼ
"""


@lru_cache(1)
def tables() -> dict[str, dict[int, str]]:
    """``letters`` (one code point each), ``fonts`` (likewise), ``spelled`` (several), ``invisible`` and ``blanks``."""
    alike = {}
    for line in (LOOKALIKES + MARK_ALIKES).split("\n"):
        shown, _, others = line.partition(":")
        alike |= dict.fromkeys(map(ord, others.split()), shown)
    letters, fonts, spelled, invisible, blanks = dict(alike), {}, {}, {0x34F: ""}, {}
    for cp in range(0x7F, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cn", "Co", "Cs"):
            continue
        if kind == "Cf" or kind == "Cc" and not ch.isspace() or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            invisible[cp] = ""
        elif ch.isspace():
            blanks[cp] = " "
        elif cp not in alike and (parts := unicodedata.decomposition(ch)):
            tag, plain = parts.split()[0], unicodedata.normalize("NFKC", ch)
            plain = "".join(alike.get(ord(c), c) for c in plain)
            if tag in ("<wide>", "<narrow>") and len(plain) == 1:
                letters[cp] = plain
            elif tag == "<font>" and len(plain) == 1:
                fonts[cp] = plain
            elif tag == "<compat>" and len(plain) > 1 and (re.search("LIGATURE|DIGRAPH", unicodedata.name(ch)) and plain.isalpha() and plain.isascii() or set(plain) == {"."}):
                spelled[cp] = plain
            elif tag[0] != "<":  # an accented look-alike
                base, *marks = unicodedata.normalize("NFD", ch)
                whole = unicodedata.normalize("NFC", alike.get(ord(base), base) + "".join(marks))
                if ord(base) in alike and len(whole) == 1:
                    letters[cp] = whole
    letters[0xB5] = "μ"
    return {"letters": letters, "fonts": fonts, "spelled": spelled, "invisible": invisible, "blanks": blanks}


@lru_cache(1)
def _whole() -> dict[int, str]:
    return {k: v for part in tables().values() for k, v in part.items()} | dict.fromkeys([*range(9, 14), *range(28, 32)], " ")


@lru_cache(1)
def _drawn() -> dict[str, str]:
    return {chr(k): v for k, v in _whole().items()}


#: Distinct mapped characters up to which they are replaced one by one, which is quicker than translating every character.
FEW = 24


def fold(text: str | None) -> str | None:
    """``text`` with one code point for each visible character, blanks collapsed and trimmed; null stays null."""
    if text is None:
        return None
    if not text.isascii():
        drawn = _drawn()
        mapped = drawn.keys() & set(text)
        if len(mapped) > FEW:
            text = text.translate(_whole())
        else:
            for ch in mapped:  # no form is itself mapped, so the order doesn't matter
                text = text.replace(ch, drawn[ch])
        text = unicodedata.normalize("NFC", text)
    return " ".join(text.split())
