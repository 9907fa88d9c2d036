"""Problem 8: sentence boundaries across languages and scripts.

A pushdown automaton runs over the marks of a text (terminators, quotation marks, brackets, blank lines, list markers).
Its stack holds open quotations, brackets and list levels. Only outside quotations and brackets can a terminator end a
sentence, and a closing mark belongs to the sentence before it. A list level opens at a first number or letter that
starts a paragraph or follows a colon or terminator; the stop of an open level's next number ends nothing, whatever stands
before it, and closes the levels inside. Abbreviations are recognised in a trie that is walked backwards from the full
stop. A quotation or bracket that isn't closed within its paragraph is not opened at all.

What follows decides ambiguous cases: a lower-case word goes on, unless the paragraph, the text or the sentence so far is in lower case; then the kind of
mark and the next word decide. Scripts without case go on after a quoted question, a conjunction or a letter that
directly follows the closing mark. Every look ahead or back is bounded by the next mark or by the longest abbreviation, and
case is counted once, so the time is linear in the text.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.runtime import spread

# Abbreviations after which a full stop doesn't end a sentence.
NEVER_ENDS = """
rs. pvt. vs. e.g. i.e. fig. figs. tol. incl. approx. sec. app. tbsp. tsp. sept. jan. feb. aug. oct. nov. dec.
dr. mr. mrs. ms. st. capt. jr. sr. prof. rev. gen. wks. vol. ed. eds. pp. cf. ca. viz. al. dept. est.
nr. bzw. ff. fa. co. z.b. d.h. u.a. s.o. ggf. evtl. inkl. zzgl. str. hr. fr. abb. sog. vgl. mind. max. bspw. tel.
env. c.-à-d. c-à-d. ex. mme. mm. éd. chap. p.ex. av. bd.
sra. sr. srta. dra. ee. aprox. núm. pág. págs. ud. uds. art. tfno. avda. ej. p.ej.
रु. नं. कि.ग्रा. प्रा. डॉ. श्री. सं. पं. ग्रा. मि.ली.
กก. มล. บจก. พ.ศ. ดร. จ. อ.
كغ. د. أ. ص. م.
"""

# Abbreviations after which a full stop may also end a sentence.
MAY_END = "etc. usw. إلخ. ltd. inc. corp. a.m. p.m. u.s. e.u. u.k. uu. लि. वगैरह. आदि. bros."

# Abbreviations only before a number.
BEFORE_NUMBER = "no. nos. p. min. art. ch. n. s. pág. op."

# Words that carry a sentence on after an ellipsis or a time of day.
GOES_ON = "and but or so then yet it it's es aber und doch y pero et mais फिर पर लेकिन और مگر و ولكن لكن ثم"
GOES_ON_CJK = "不过 但 可是 然后 而 却 でも しかし けれど だが แต่"
AFTER_TIME = "on and to or but in with from sharp ke ko se tak mein until till by"
VERBS = "is are was were has have had makes made came comes sold sells says said ist sind hat es est a"
OPENS_WITH_TIME = "at by around on before after from until since about um gegen kal subah"
MONTHS = "januar februar märz april mai juni juli august september oktober november dezember jänner"

# Pairs of quotation marks and brackets; a closing mark of several openings is listed with each.
PAIRS = ["\"\"", "“”", "„“", "„”", "«»", "‹›", "「」", "『』", "()", "[]", "{}", "（）", "【】", "《》", "〈〉", "［］"]

_TERMINATORS = ".!?…。！？｡．।॥؟۔"
_OPEN = {p[0]: {q[1] for q in PAIRS if q[0] == p[0]} for p in PAIRS}
_CLOSE = {p[1] for p in PAIRS}
_BRACKETS = set("([{（【［")
_MARK = re.compile(rf"(?P<blank>[^\S\n]*\n[^\S\n]*\n\s*)|(?P<end>[{re.escape(_TERMINATORS)}]+|(?:(?<=[ऀ-ॣ])|(?<=[ऀ-ॣ] ))\|+(?=\s|$))|(?P<pair>[{re.escape(''.join(sorted({*_OPEN, *_CLOSE})))}])|(?P<thai>(?<=[฀-๿])\s+(?=[ก-ฯะาำเ-ๆ]))")
_VERBS, _GOES_ON, _GOES_ON_CJK, _AFTER_TIME, _OPENS_WITH_TIME, _MONTHS = (frozenset(w.split()) for w in (VERBS, GOES_ON, GOES_ON_CJK, AFTER_TIME, OPENS_WITH_TIME, MONTHS))
_PARAGRAPH = re.compile(r"\n[^\S\n]*\n")
_LONGEST = max(map(len, f"{NEVER_ENDS} {MAY_END} {BEFORE_NUMBER}".split()))
_LEAD = re.compile(r"""["\“„«‹'’([{*_¿¡\s]*""")
_LEADS = set(":;：；" + _TERMINATORS)
_ITEM = re.compile(r"(?:^|(?<=\s))(\d{1,3}|[A-Za-z])$")
_CJK = re.compile("[㐀-䶿一-鿿豈-﫿぀-ヿ]")
_WORD = re.compile(r"(?:[^\W_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0e31-\u0e4e])+(?:['’][^\W_]+)*")


@lru_cache(1)
def _trie() -> dict:
    """Abbreviations spelled backwards, with their class at the end of each path."""
    root: dict = {}
    for kind, words in (("number", BEFORE_NUMBER), ("may", MAY_END), ("never", NEVER_ENDS)):
        for word in words.split():
            node = root
            for ch in reversed(word):
                node = node.setdefault(ch, {})
            node["kind"] = kind
    return root


def _abbreviation(text: str, stop: int) -> tuple[str | None, int]:
    """(class, start) of the longest abbreviation that ends with the full stop at ``stop`` and starts at a word boundary."""
    node, at, found = _trie(), stop, (None, stop)
    while at >= 0 and (node := node.get(text[at].lower())) is not None:
        if "kind" in node and (at == 0 or not (text[at - 1].isalnum() or unicodedata.category(text[at - 1])[0] == "M" or text[at - 1] in ".-&'’")):
            found = (node["kind"], at)
        at -= 1
    return found


class _Levels:
    """The open list levels, outermost first: the style of their markers and the value of the last one.

    A first marker of a style that is open already starts that level anew, so there are at most as many levels as styles.
    """

    def __init__(self) -> None:
        self.open: list[tuple[str, int]] = []
        self.paragraph = -1  # start of the paragraph of the last marker

    def marker(self, text: str, stop: int, first: int) -> bool:
        """Does the full stop at ``stop`` belong to a list marker? ``first`` is where its paragraph starts."""
        if not (m := _ITEM.search(text, max(first, stop - 4), stop)):
            return False
        token, begin = m[1], m.start(1)
        style, value = ("1", int(token)) if token.isdigit() else ("a", ord(token) - 96) if token.islower() else ("A", ord(token) - 64)
        before = begin - 1
        while before >= first and text[before].isspace():
            before -= 1
        for depth in range(len(self.open) - 1, -1, -1):
            # a list of the paragraph before goes on only at the start of this one
            if self.open[depth] == (style, value - 1) and (self.paragraph == first or before < first):
                self.open[depth:], self.paragraph = [(style, value)], first
                return True
        if value == 1 and (before < first or text[before] in _LEADS):
            depth = next((k for k, (s, _) in enumerate(self.open) if s == style), len(self.open))
            self.open[depth:], self.paragraph = [(style, value)], first
            return True
        return False


def _structure(text: str, marks: list[tuple[str, int, int]]) -> tuple[dict[int, int], set[int], list[int]]:
    """(opening to closing position of every quotation and bracket at level zero, stops of list markers, ends of paragraphs)."""
    out: dict[int, int] = {}
    stack: list[int] = []
    inner: list[tuple[int, int]] = []
    levels, markers, ends, first, marked = _Levels(), set(), [], 0, False

    def flush() -> None:
        # pairs inside a mark that was never closed move up to level zero
        last = -1
        for a, b in sorted(inner):
            if a > last:
                out[a], last = b, b
        inner.clear()
        stack.clear()

    for kind, at, stop in marks:
        if kind == "blank":
            flush()
            if not marked:
                levels.open.clear()  # a paragraph without a marker ends the list
            ends.append(at)
            first, marked = stop, False
        elif kind == "end":
            if stop == at + 1 and text[at] == "." and levels.marker(text, at, first):
                markers.add(at)
                marked = True
        elif kind == "pair":
            ch = text[at]
            before = text[at - 1] if at else " "
            after = text[at + 1] if at + 1 < len(text) else " "
            if ch in _CLOSE and stack and any(ch in _OPEN[text[s]] for s in stack):
                if ch == '"' and before.isspace() and not after.isspace() and after.isalnum() and text[stack[-1]] == '"':
                    stack[-1] = at  # the earlier mark was a stray one
                    continue
                while ch not in _OPEN[text[stack[-1]]]:
                    stack.pop()
                inner.append((stack.pop(), at))
            elif ch in _OPEN and not (ch == '"' and (before.isdigit() or after.isspace())):
                stack.append(at)
    flush()
    return out, markers, [*ends, len(text)]


@lru_cache(1)
def _cases() -> np.ndarray:
    """1 for a lower-case code point, 2 for another one with case, 0 for the rest; scripts with case end before U+1F200."""
    return np.array([1 if chr(c).islower() else 2 if chr(c).isupper() or chr(c).istitle() else 0 for c in range(0x1F200)] + [0], np.uint8)


class _Case:
    """Places of cased characters, so that any stretch of a text is judged without reading it again."""

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = _cases()[np.minimum(codes, 0x1F200)]
        self.lower = np.flatnonzero(kinds == 1)
        self.other = np.flatnonzero(kinds == 2).tolist()

    def all_lower(self, start: int, stop: int) -> bool:
        """As ``text[start:stop].islower()``: a lower-case character and no other with case."""
        at = bisect_left(self.other, start)
        if at < len(self.other) and self.other[at] < stop:
            return False
        a, b = self.lower.searchsorted((start, stop))
        return bool(a < b)


class _So:
    """The sentence so far: where it starts, whether it or its paragraph is in lower case (asked only where it matters),
    whether a verb was read, and the run of characters without a blank. Every character is read once, however often a stop asks.
    """

    __slots__ = ("text", "case", "start", "at", "paragraph", "read", "verb", "seen", "token_start", "link")

    def __init__(self, text: str, case: _Case, start: int, paragraph: bool) -> None:
        self.text, self.case, self.start, self.at, self.paragraph, self.read, self.verb = text, case, start, start, paragraph, start, False
        self.seen, self.token_start, self.link = 0, 0, False

    def __bool__(self) -> bool:
        return self.paragraph or self.case.all_lower(self.start, self.at)

    def begin(self, start: int) -> None:
        self.start, self.read, self.verb = start, start, False

    def has_verb(self, stop: int) -> bool:
        """Is one of VERBS among the words before ``stop``?"""
        if stop > self.read:
            words = self.text[self.read : stop].split()
            self.verb = self.verb or not _VERBS.isdisjoint(words)
            self.read = stop
        return self.verb

    def token(self, at: int) -> tuple[int, bool]:
        """(start of what stands between the last blank or line break and ``at``, is it part of an address?)."""
        blank = max(self.text.rfind(" ", self.seen, at), self.text.rfind("\n", self.seen, at))
        if blank >= 0:
            self.token_start, self.link = blank + 1, False
        piece = self.text[max(self.token_start, self.seen - 4) : at].lower()
        self.link = self.link or "www." in piece or "://" in piece or "@" in piece
        self.seen = max(self.seen, at)
        return self.token_start, self.link or piece.endswith("www")


def _skip(text: str, at: int) -> int:
    while at < len(text) and text[at].isspace():
        at += 1
    return at


def boundaries(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points; no white space at either end, nothing but white space between."""
    case, marks = _Case(text), [(m.lastgroup, m.start(), m.end()) for m in _MARK.finditer(text)]
    pairs, markers, ends = _structure(text, marks)
    closing, edge = set(pairs.values()), iter(ends)
    cuts: list[int] = []
    start, inside = _skip(text, 0), -1
    so = _So(text, case, start, case.all_lower(0, next(edge)))

    def close(end: int) -> None:
        nonlocal start
        if end > start:
            cuts.append(end)
            start = _skip(text, end)
            so.begin(start)

    for kind, at, stop in marks:
        if kind == "blank":
            close(at)
            inside = -1
            so.paragraph = case.all_lower(stop, next(edge))
            continue
        if kind == "pair":
            if at in pairs and at >= inside:
                inside = pairs[at]
            elif at == inside:
                k = at - 1
                while k > start and text[k].isspace():
                    k -= 1
                inside = -1
                if k >= start and text[k] in _TERMINATORS and text[at] != '"' or k == at - 1 and text[k] in _TERMINATORS:
                    end, so.at = _closers(text, at + 1, closing), at
                    if _ends_after_quote(text, k, at, end, so):
                        close(end)
            continue
        if at < start or at < inside:
            continue
        if kind == "thai":
            close(at)
            continue
        if at in markers:
            continue
        end, so.at = _closers(text, stop, closing), at
        if _ends(text, at, stop, end, so):
            close(end)
    close(len(text.rstrip()))
    out, begin = [], _skip(text, 0)
    for end in cuts:
        stop = end
        while stop > begin and text[stop - 1].isspace():
            stop -= 1
        if stop > begin:
            out.append((begin, stop))
        begin = _skip(text, end)
    return out


def _closers(text: str, at: int, closing: set[int]) -> int:
    """Past emphasis marks and unpaired closing marks that directly follow."""
    while at < len(text) and (text[at] in "*_’'" and not text[at + 1 : at + 2].isalnum() or text[at] in _CLOSE and text[at] not in _OPEN and at not in closing):
        at += 1
    return at


def _starts_upper(word: str) -> bool:
    """Starts a sentence by its case: a capital, or a name such as eBook."""
    return word[0].isupper() or len(word) > 1 and word[0].islower() and word[1].isupper()


def _next_word(text: str, at: int) -> str:
    m = _WORD.match(text, _LEAD.match(text, at).end())
    return m[0] if m else ""


def _ends_after_quote(text: str, mark: int, closing: int, end: int, so: _So) -> bool:
    """Does a sentence end after a closing mark that follows a terminator?"""
    after = _skip(text, end)
    if after >= len(text) or _PARAGRAPH.search(text, end, after):
        return True
    ch = text[after]
    if ch in ",;:，、；：،؛-–—)" or ch in _TERMINATORS:
        return False
    if text[mark] == "." and _abbreviation(text, mark)[0] == "never":
        return False
    if text[closing] in _BRACKETS or text[closing] in ")]}）】］":
        return after > end or not ch.islower()
    if not ch.isalpha():
        return True
    if ch.islower() and not _starts_upper(text[after : after + 2]):
        return bool(so) and text[mark] not in "!?…"
    if ch.isupper() or ch.islower():
        return True
    if after == end:
        return False
    return text[mark] not in "!?؟…"


def _ends(text: str, at: int, stop: int, end: int, so: _So) -> bool:
    """Does a sentence end after the terminators text[at:stop]?"""
    after = _skip(text, end)
    if after >= len(text) or _PARAGRAPH.search(text, end, after):
        return True
    run, ch, gap = text[at:stop], text[after], after > end
    if ch in ",;:，、；：،؛)”’»」』" and ch not in _OPEN:
        return False
    if run.strip(".") == "" and len(run) >= 2 or "…" in run:
        return _ends_ellipsis(text, run, after, ch, gap, so)
    if run[-1] in "。！？｡．।॥؟۔|":
        return True
    if run[-1] in "!?":
        if not gap:
            return not ch.isdigit() and not (ch.islower() and not so) and (ch.isalpha() or ch in _OPEN or ch in "¿¡*")
        return not ch.islower() or _starts_upper(text[after : after + 2]) or bool(so)
    return _ends_stop(text, at, after, ch, gap, so)


def _ends_ellipsis(text: str, run: str, after: int, ch: str, gap: bool, so: _So) -> bool:
    if not ch.isalpha():
        return True
    word = _next_word(text, after)
    if ch.islower() and not _starts_upper(text[after : after + 2]):
        return gap and word not in _GOES_ON and bool(so)
    if ch.isupper() or ch.islower():
        return gap or "…" in run or run[-1] != "."
    return word not in _GOES_ON and not any(text.startswith(w, after) for w in _GOES_ON_CJK)


def _words_before(text: str, start: int, stop: int, n: int) -> list[str]:
    """The last ``n`` words of text[start:stop], in lower case; fewer if there are fewer."""
    out: list[str] = []
    while len(out) < n:
        while stop > start and text[stop - 1].isspace():
            stop -= 1
        end = stop
        while stop > start and not text[stop - 1].isspace():
            stop -= 1
        if stop == end:
            break
        out.insert(0, text[stop:end].lower())
    return out


def _ends_stop(text: str, at: int, after: int, ch: str, gap: bool, so: _So) -> bool:
    """The full stop proper."""
    start = so.start
    before = text[at - 1] if at > start else " "
    kind, begin = _abbreviation(text, at)
    if not gap:
        token, link = so.token(at)
        more = text.find(".", at + 1, at + _LONGEST)
        while more > 0:
            other, first = _abbreviation(text, more)
            if other and first <= at:
                return False
            more = text.find(".", more + 1, at + _LONGEST)
        if kind or link or not (before.isalnum() or before in "%)]\"”»'’" or unicodedata.category(before)[0] in "MS"):
            return False
        if before.isdigit() and ch.isdigit():
            return False
        if token < at and text[at - 1].isalpha() and (at - 2 < token or not (text[at - 2].isalnum() or text[at - 2] in "°-")):
            return False  # one letter: an initial
        return ch.isupper() or ch in _OPEN or ch in "¿¡*" or ch.isdigit() and not before.isdigit() or ch.isalpha() and not ch.islower() or bool(ch.islower() and (_starts_upper(text[after : after + 2]) or len(_next_word(text, after)) > 1 and so))
    if kind == "never":
        return False
    if kind == "number" and (ch.isdigit() or text[begin : at + 1].lower() == "min." and ch.islower()):
        return False
    if kind == "may":
        name, word = text[begin : at + 1].lower(), _next_word(text, after)
        upper = bool(word) and (_starts_upper(word) or not word[0].islower() and not word[0].isdigit())
        if name in ("a.m.", "p.m."):
            lead = _words_before(text, start, begin, 3)
            if len(lead) > 1 and lead[-2] in _OPENS_WITH_TIME and (len(lead) == 2 or lead[-3].endswith(",")):
                return False  # the sentence opens with the time
            return not ch.islower() or upper or word not in _AFTER_TIME and bool(so)
        if name in ("u.s.", "e.u.", "u.k."):
            return upper and not so
        if name in ("लि.", "ltd.", "inc.", "corp."):
            if so:
                return so.has_verb(begin)
            return word.isascii() and upper if name == "लि." else upper or not ch.islower()
        return upper or not ch.islower() or bool(so)
    if before.isalpha() and (at - 2 < start or not (text[at - 2].isalnum() or unicodedata.category(text[at - 2])[0] == "M" or text[at - 2] in "-’'")) and len(before) == 1:
        # one letter: an initial, unless it is a unit after a number or a degree sign, or ends a code
        near = text[max(start, at - 4) : at - 1]
        return bool(re.search(r"[\d°]\s?$", near)) and not (before.isupper() and re.search(r"\d\s$", near))
    if ch.islower() and text[at - 3 : at].lower().strip() == "in" and re.search(r"\d\s?in$", text[max(start, at - 5) : at].lower()):
        return False
    if before.isdigit():
        number = re.search(r"(?:^|[^\w.,])(\d{1,2})$", text[max(start, at - 4) : at])
        if number and _next_word(text, after).lower() in _MONTHS:
            return False
        if number and start + len(number[1]) >= at:
            return False  # nothing but a number so far
    return not ch.islower() or _starts_upper(text[after : after + 2]) or bool(so)


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, sent_start, sent_end``: one row per sentence of every text, offsets in code points, end exclusive.

    Together the sentences cover all but white space. Null, empty and blank texts give no rows; repeated rows of a key
    repeat its sentences. Every row is read whole, whatever its length.
    """
    slim = df.where(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("text"))
    schema = T.StructType([slim.schema[0], T.StructField("sent_start", T.IntegerType()), T.StructField("sent_end", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows, starts, ends = [], [], []
            for k, t in enumerate(part.column(1).to_pylist()):
                for a, b in boundaries(t):
                    rows.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[key, "sent_start", "sent_end"])

    return spread(slim).mapInArrow(run, schema)
