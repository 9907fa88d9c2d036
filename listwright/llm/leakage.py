"""Problem 7: passages of evaluation items inside a training corpus.

Winnowing: of every window of consecutive k-gram hashes the smallest (the rightmost of equals) is kept as fingerprint, on
both sides. A shared span of k + window - 1 units holds a whole window of equal hashes, so both sides keep the same one
and no sufficiently long span is missed. Fingerprints meet in a join; each hit is then extended to both sides over the
units themselves and counts if the common run is long enough, so hash collisions give no false result.

Units are words, or single letters and digits for items in languages written without blanks. Case, punctuation, markup,
blanks, line breaks, invisible and look-alike characters are removed first, alike on both sides.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from listwright.functions.charfold import fold
from listwright.runtime import BROADCAST_BYTES, spread, stored

#: Units of a reported span and of a hashed gram, by kind of unit. The window is span - gram + 1.
SPAN = {"word": 12, "char": 24}
GRAM = {"word": 8, "char": 18}
#: Characters that are hashed at a time.
SLICE_CHARS = 1 << 20

# Elements of HTML, and attributes that are written without a value.
TAGS = """
a abbr acronym address article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data dd del
details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe
img input ins kbd label legend li link main map mark menu meta meter nav nobr noscript object ol optgroup option output p param picture pre
progress q rb rp rt rtc ruby s samp script section select slot small source span strike strong style sub summary sup svg table tbody td
template textarea tfoot th thead time title tr track tt u ul var video wbr
"""
BARE_ATTRIBUTES = "async autofocus autoplay checked compact controls default defer disabled hidden ismap loop multiple muted nohref noshade novalidate nowrap open readonly required reversed selected"

_ATTRIBUTE = rf"""[a-z_:][\w:.-]*\s*=\s*(?:"[^"<>]*"|'[^'<>]*'|[^\s"'<>=`]+)|(?:{"|".join(BARE_ATTRIBUTES.split())})(?=[\s/>])"""
_MARKUP = re.compile(rf"</?(?:{'|'.join(TAGS.split())})(?:\s+(?:{_ATTRIBUTE}))*\s*/?>|(?<=\]\()[^()\s]*(?=\))", re.I)
_COMMENT = re.compile(r"<!--[^<>]*-->")
_CJK = re.compile("[㐀-䶿一-鿿豈-﫿぀-ヿ\U00020000-\U0003134f]")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def plain_text(text: str) -> str:
    """Lower case, folded, without tags, link targets, entities and such comments as can't hold a reportable span.

    Only known elements with attributes in their syntax are tags: other text in angle brackets is text and stays.
    """
    if "<" in text or "](" in text:
        text = _MARKUP.sub(" ", text)
        text = _COMMENT.sub(lambda m: " " if sum(map(str.isalnum, m[0])) < SPAN["word"] else m[0], text)
    if "&" in text:
        text = html.unescape(text)
    return fold(text).casefold()


def units(plain: str, kind: str) -> list[str]:
    """The words, or the single letters and digits, of a text that went through :func:`plain_text`."""
    import regex

    words = regex.findall(r"[\p{L}\p{M}\p{N}]+", plain)
    return words if kind == "word" else list("".join(words))


def _codes(seq: list[str]) -> np.ndarray:
    coded = pa.array(seq, pa.large_string()).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return table[coded.indices.to_numpy()] if len(seq) else np.zeros(0, np.uint64)


def winnow(codes: np.ndarray, ends: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the fingerprints of several texts laid end to end; ``ends`` are their stops.

    A text of fewer than ``span`` units has none.
    """
    n, window = len(codes), span - gram + 1
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = np.zeros(n - gram + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(gram):
            grams = grams * _PRIME + codes[k : n - gram + 1 + k]
        grams ^= grams >> np.uint64(29)
        grams *= _PRIME
        grams ^= grams >> np.uint64(32)
    # the smallest of each window, the rightmost of equals: compare from left to right, later ones win ties
    low, at = grams[: len(grams) - window + 1].copy(), np.zeros(len(grams) - window + 1, np.int64)
    for k in range(1, window):
        other = grams[k : k + len(low)]
        less = other <= low
        low[less], at[less] = other[less], k
    at += np.arange(len(at))
    start = np.arange(len(at))
    inside = np.searchsorted(ends, start, "right") == np.searchsorted(ends, start + span - 1, "right")
    picked = np.unique(at[inside])
    return picked, grams[picked]


def fingerprints(df: DataFrame, key: str, text: str, kinds: str | tuple[str, ...], cjk_only: bool = False) -> DataFrame:
    """``key, kind, hash, pos``: the fingerprints of every text.

    ``kinds`` are the kinds of unit that every text is cut into, or the name of a column that holds one kind a row.
    With ``cjk_only`` letters are only hashed in texts with a Chinese or Japanese character. Null texts have none.
    """
    slim = df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(kinds) if isinstance(kinds, str) else F.lit("")).alias("kind"))
    fields = [T.StructField(key, df.schema[key].dataType), T.StructField("kind", T.StringType()), T.StructField("hash", T.LongType()), T.StructField("pos", T.IntegerType())]

    def cut(keys: pa.Array, texts: list[str], own: list[str]) -> Iterator[pa.RecordBatch]:
        plains = [plain_text(t) for t in texts]
        for kind in SPAN:
            chosen = [i for i, p in enumerate(plains) if (own[i] == kind if isinstance(kinds, str) else kind in kinds) and (kind == "word" or not cjk_only or _CJK.search(p))]
            parts = [units(plains[i], kind) for i in chosen]
            ends = np.cumsum([len(p) for p in parts]) if parts else np.zeros(0, np.int64)
            pos, hashes = winnow(_codes([u for p in parts for u in p]), ends, GRAM[kind], SPAN[kind])
            if len(pos):
                which = np.searchsorted(ends, pos, "right")
                begin = np.concatenate([[0], ends[:-1]])
                rows = np.asarray(chosen)[which]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array([kind] * len(pos)), pa.array(hashes.view(np.int64)), pa.array((pos - begin[which]).astype(np.int32))], names=[key, "kind", "hash", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            texts, own = part.column(1).to_pylist(), part.column(2).to_pylist()
            begin, chars = 0, 0
            for i, t in enumerate(texts):
                chars += len(t)
                if chars > SLICE_CHARS or i == len(texts) - 1:
                    yield from cut(part.column(0).slice(begin, i + 1 - begin), texts[begin : i + 1], own[begin : i + 1])
                    begin, chars = i + 1, 0

    return spread(slim).mapInArrow(run, T.StructType(fields))


def _longest(doc: np.ndarray, item: np.ndarray, diagonals: list[dict], gram: int, enough: int) -> bool:
    """Does any diagonal hold a common run of ``enough`` units that meets one of its hits?"""
    for d in diagonals:
        shift = d["shift"]
        low = max(d["low"] - enough, shift, 0)
        high = min(d["high"] + gram + enough, len(doc), len(item) + shift)
        if high - low < enough:
            continue
        differs = np.flatnonzero(doc[low:high] != item[low - shift : high - shift])
        if np.diff(differs, prepend=-1, append=high - low).max() > enough:
            return True
    return False


def _counted(df: DataFrame, size: int) -> DataFrame:
    """``df`` as one side of a join: broadcast if its counted bytes are within the bound, else kept from being broadcast.

    Without the hint Catalyst goes by the size of the files, and a text that many rows share is in them once.
    """
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def leaked_items(documents: DataFrame, items: DataFrame, doc_key: str, doc_text: str, item_key: str, item_text: str, item_lang: str, unspaced: tuple[str, ...] = ("zh", "ja")) -> DataFrame:
    """``doc_key, item_key``: every document and item with a common run of 12 words (24 letters and digits for ``unspaced``).

    Null, empty and too short texts match nothing; repeated rows give one result row. The item fingerprints and texts
    are broadcast where their counted bytes are within a bound, else both sides are shuffled; hits are always shuffled. They
    are reduced map-side to the diagonals (position in the document less position in the item) they lie on, so that passages
    repeated on both sides cost a row per diagonal and not per pair of places. A document's text meets the list of its items
    in one row.
    """
    items = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("itext"), F.when(F.col(item_lang).isin(*unspaced), "char").otherwise("word").alias("ikind"))
    letters = F.regexp_replace("itext", r"[^\p{L}\p{N}]", "")
    bare = items.where((F.col("ikind") == "char") & letters.rlike(rf"[^\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}]{{{SPAN['char']}}}"))
    cjk_only = bare.isEmpty()  # true if every reportable span of a letter-wise item holds a Chinese or Japanese character
    test = stored(fingerprints(items, "item", "itext", "ikind").select("item", "kind", "hash", F.col("pos").alias("ipos")).distinct(), "items")
    docs = documents.select(F.col(doc_key).alias("doc"), F.col(doc_text).alias("dtext"))
    train = fingerprints(docs, "doc", "dtext", ("word", "char"), cjk_only)
    hits = train.join(_counted(test, test.count() * 40), ["kind", "hash"]).select("doc", "item", "kind", (F.col("pos") - F.col("ipos")).alias("shift"), "pos")
    diagonals = hits.groupBy("doc", "item", "kind", "shift").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    found = diagonals.groupBy("doc", "item", "kind").agg(F.collect_list(F.struct("shift", "low", "high")).alias("hits"))
    passages = items.where(F.col("itext").isNotNull()).select("item", "itext").distinct()
    size = passages.agg(F.sum(F.octet_length("itext") + 40)).first()[0] or 0
    met = found.join(_counted(passages, size), "item")
    listed = stored(met.groupBy("doc").agg(F.collect_list(F.struct("item", "itext", "kind", "hits")).alias("items")), "hits")
    pairs = docs.where(F.col("dtext").isNotNull()).join(listed.hint("merge"), "doc")  # either side grows with the documents

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = lru_cache(1024)(lambda text, kind: _codes(units(plain_text(text), kind)))  # of items that many rows share
        for part in batches:
            rows, which = [], []
            for n, (text, found) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                plain, own = plain_text(text), {}
                for hit in found:
                    kind = hit["kind"]
                    if kind not in own:
                        own[kind] = _codes(units(plain, kind))
                    if _longest(own[kind], coded(hit["itext"], kind), hit["hits"], GRAM[kind], SPAN[kind]):
                        rows.append(n)
                        which.append(hit["item"])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(which, item_type)], names=["doc", "item"])

    schema = T.StructType([T.StructField("doc", docs.schema["doc"].dataType), T.StructField("item", items.schema["item"].dataType)])
    item_type = to_arrow_type(schema["item"].dataType)
    checked = pairs.select("doc", "dtext", "items").mapInArrow(verify, schema)
    return checked.distinct().select(F.col("doc").alias(doc_key), F.col("item").alias(item_key))
