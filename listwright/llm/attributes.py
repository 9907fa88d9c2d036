"""Reading the attributes of a product listing: kind, variant, amount, pack count, added article and the words left over.

The lexicon of :mod:`listwright.llm.lexicon` names synonyms that are known beforehand. Words it doesn't know are left over
for :mod:`listwright.llm.vocabulary`, which learns their part from the catalogue; ``known=False`` leaves all words to it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from listwright.functions.charfold import fold
from listwright.functions.quantity import PACK_OF, amounts_in, packs_in, plain, spellings
from listwright.llm.lexicon import ALSO_PRAISE, FILLERS, JOINERS, KINDS, PROMOTIONS, VARIANTS
from listwright.operators.units import compositions

_MARKS = {cp: None for cp in range(0x300, 0x370)}
_TOKEN = re.compile(r"[ऀ-ॣॱ-ॿ]+|[^\W\d_ऀ-ॿ]+(?:['-][^\W\d_ऀ-ॿ]+)*")
_PACKED = re.compile(rf"\b(?:{PACK_OF.replace(' ', '|')}) of \d+")
_CODES = re.compile(r"\b(\d{1,2}k gold)\b|\b(spf) ?(\d{1,3})\b|\b(\d) in (1)\b|\b(\d{1,4}) ?(gb|tb)\b|\bmodel ([a-z]\d{1,4})\b|(?<![\w.,])([345]g)\b(?!\.)")
_PROMOTIONS = [(p.strip(), re.compile(rf"(?<![^\s(\[|]){re.escape(p.strip())}(?=$|[\s)\]|,])")) for p in re.split("[;\n]", PROMOTIONS) if p.strip()]
_CODE_HINTS = ("k gold", "spf", "in 1", "gb", "tb", "model ", "3g", "4g", "5g")


def bare(text: str) -> str:
    """Without accents; marks of other scripts stay."""
    return text if text.isascii() else unicodedata.normalize("NFD", text).translate(_MARKS)


def without_promotions(text: str) -> str:
    """A text without promotional phrases; a phrase is only searched for where its characters occur."""
    for phrase, pattern in _PROMOTIONS:
        if phrase in text:
            text = pattern.sub(" ", text)
    return text


def _lines(block: str) -> list[list[tuple[str, ...]]]:
    phrases = [[p.strip() for p in line.split(";") if p.strip()] for line in block.strip().split("\n")]
    # capitals and small letters of other scripts may look like different Latin ones
    return [list(dict.fromkeys(tuple(_TOKEN.findall(bare(fold(form).lower()))) for p in line for form in (p, p.upper()))) for line in phrases]


@lru_cache(1)
def _vocabulary() -> tuple[list, list, dict[str, str], dict[str, list[str]], frozenset[str], frozenset[str]]:
    """(kinds, variants) as (phrase, name) from longest to shortest, words, words by deletion, words to pass over, those without promotions.

    Phrases are folded like names are, so that a word of another script meets its folded spelling.
    """
    kinds = sorted(((p, " ".join(line[0])) for line in _lines(KINDS) for p in line), key=lambda x: (-len(x[0]), x))
    variants = sorted(((p, " ".join(line[0])) for line in _lines(VARIANTS) for p in line), key=lambda x: (-len(x[0]), x))
    words = {w: w for p, _ in [*kinds, *variants] for w in p}
    skip = {*JOINERS.split(), *(w for w in spellings() if w[0].isalpha()), *"k g".split()}
    promo = {w for w in _TOKEN.findall(PROMOTIONS)} - set(words)
    close: dict[str, list[str]] = {}
    for w in sorted({*words, *promo}):
        if len(w) >= 4:
            for cut in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
                close.setdefault(cut, []).append(w)
    return kinds, variants, words, close, frozenset(skip | promo), frozenset(skip)


def _one_edit(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart; words of four letters need the same letters or one more or less."""
    if len(a) == len(b) <= 4 and sorted(a) != sorted(b):
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])


def known_word(token: str) -> bool:
    """Is a word part of the vocabulary as it stands?"""
    return bare(token) in _vocabulary()[2]


@lru_cache(1 << 16)
def _words(token: str) -> tuple[str, ...]:
    """The vocabulary words that a token may stand for, itself first, then those one edit off; '' for one to pass over."""
    _, _, words, close, skip, _ = _vocabulary()
    if token in skip and token not in words:
        return ("",)
    found = [token] if token in words else []
    if len(token) >= 3:
        for cut in (token, *(token[:k] + token[k + 1 :] for k in range(len(token)))):
            for near in close.get(cut, ()):
                if near not in found and _one_edit(token, near):
                    found.append(near)
    if found and token not in words and not any(w in words for w in found):
        return ("",)
    return tuple(w for w in found if w in words)


def _take(phrase: tuple[str, ...], options: list[tuple[str, ...]], free: set[int]) -> list[int] | None:
    """Tokens that stand for the words of a phrase, one each; those that spell a word out come before those that only may."""
    if not phrase:
        return []
    fits = sorted((k for k in free if phrase[0] in options[k]), key=lambda k: (options[k].index(phrase[0]), k))
    for k in fits:
        if (rest := _take(phrase[1:], options, free - {k})) is not None:
            return [k, *rest]
    return None


@lru_cache(1 << 16)
def _readings(tokens: tuple[str, ...]) -> tuple[str | None, str, str]:
    """(kind, variant, tokens left over): the reading that leaves fewest tokens over, over all meanings of every token."""
    options = [_words(t) for t in tokens]
    kinds, variants, *_ = _vocabulary()
    there = {w for o in options for w in o}
    best = None
    for phrase, name in [*kinds, ((), None)]:
        if not there.issuperset(phrase) or (at := _take(phrase, options, set(range(len(tokens))))) is None:
            continue
        free, found = set(range(len(tokens))) - {*at}, []
        for other, variant in variants:
            while there.issuperset(other) and (used := _take(other, options, free)) is not None:
                free -= {*used}
                found.append(variant)
        if len({*found}) > 1:
            found = [v for v in found if v not in ALSO_PRAISE] or found
        straight = len(phrase) > 1 and at == list(range(at[0], at[0] + len(phrase)))
        guessed = sum(options[k][0] != w for k, w in zip(at, phrase, strict=True))
        score = (name is None, len(free), guessed, -len(phrase), not straight, len(found), name)
        if best is None or score < best[0]:
            best = (score, name, " ".join(sorted({*found})), " ".join(tokens[k] for k in sorted(free)))
    return best[1:]


def read(name: str | None, known: bool = True) -> tuple[str | None, str, tuple[str, float] | None, list[int], str, str]:
    """(kind, variant, (unit, amount) or null, pack counts, added article, words left over) of a listing's name.

    Without ``known`` the kind is null, the variant holds codes only and all words are left over.
    """
    if not name:
        return None, "", None, [], "", ""
    text = plain(name)
    main, _, added = text.partition(" + ")
    main = bare(without_promotions(main))
    extra = []

    def code(m: re.Match) -> str:
        extra.append(" ".join(g for g in m.groups() if g))
        return " "

    rest_text = _PACKED.sub(" ", main) if " of " in main else main
    if any(h in rest_text for h in _CODE_HINTS):
        rest_text = _CODES.sub(code, rest_text)
    read_, over = [], []
    for token in _TOKEN.findall(rest_text):
        words = _words(token) if known else ("",) if token in _vocabulary()[5] else ()
        if not words:
            if len(token) > 1:
                over.append(token)
        elif words[0]:
            read_.append(token)
    kind, variant, left = _readings(tuple(read_)) if read_ else (None, "", "")
    part = amounts_in(main)
    if extra and variant in ALSO_PRAISE:
        variant = ""
    return kind, " ".join(filter(None, [*sorted({*extra}), variant])), total(part), packs_in(main), article(added), " ".join(filter(None, [*over, left]))


def total(parts: list[tuple[float, str]]) -> tuple[str, float] | None:
    """(canonical unit, amount) of parsed parts."""
    if not parts:
        return None
    table = _factors()
    return table[parts[0][1]][0], sum(v * table[u][1] for v, u in parts)


@lru_cache(1)
def _factors() -> dict[str, tuple[str, float]]:
    return {u: (base, float(f)) for u, (base, f, _) in compositions().items()}


def article(text: str) -> str:
    """The added article of a bundle in one form: its words without promotions."""
    return " ".join(re.findall(r"[^\W_]+", bare(without_promotions(text)))) if text else ""


def usable(text: str | None) -> str | None:
    """A recorded value folded and in lower case, or null if it stands for no value."""
    if text is None:
        return None
    form = plain(text)
    return None if form in FILLERS else form


def brand_words(text: str | None) -> str | None:
    """The words of a recorded brand in one form and order; null for a value that stands for none."""
    form = usable(text)
    return " ".join(sorted(_TOKEN.findall(bare(form)))) or None if form else None
