"""Queries of the general (core) problem operators over the whole test tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from listwright.functions.charfold import tables
from listwright.functions.quantity import SPELLINGS, TWO_PART
from listwright.operators.units import canonical_amounts, compositions
from listwright.runtime import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated amount of every listing in grams, millilitres or centimetres."""
    return canonical_amounts(table(spark, sf_dir, "phase2_before_after"), "row_id")


QUERIES = {"p3_found": p3_found}

# The SQL shares the tables of characters, spellings and factors; it reads and converts on its own.


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _folded(column: str) -> str:
    t = tables()
    single = {k: v for part in ("letters", "fonts", "blanks") for k, v in t[part].items() if len(v) == 1} | dict.fromkeys([*range(9, 14), *range(28, 32)], " ")
    out = f"translate({column}, {_quoted(''.join(map(chr, [*single, *t['invisible']])))}, {_quoted(''.join(single.values()))})"
    for cp, shown in t["spelled"].items():
        out = f"replace({out}, {_quoted(chr(cp))}, {_quoted(shown)})"
    return f"lower(trim(regexp_replace(nfc_normalize({out}), '\\s+', ' ', 'g')))"


#: Digits of other scripts in the tables, and vulgar fractions.
_ZEROS = [0x660, 0x6F0, 0x966, 0x9E6, 0xE50]
_VULGAR = {"½": "1/2", "⅓": "1/3", "⅔": "2/3", "¼": "1/4", "¾": "3/4", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6", "⅐": "1/7", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅑": "1/9", "⅒": "1/10"}
_SPELLED = {s: line.partition(":")[0] for line in SPELLINGS.strip().split("\n") for s in line.partition(":")[2].split()}
_WRITTEN = "|".join(re.escape(s) for s in sorted(_SPELLED, key=len, reverse=True) if not s[0].isdigit())
_V = "".join(_VULGAR)
_NUMBER = rf"(?:[0-9]+\s?[{_V}]|[{_V}]|[0-9]+[ -][0-9]+/[0-9]+|[0-9]+/[0-9]+|[1-9][0-9]{{0,2}}(?:,[0-9]{{2,3}})*,[0-9]{{3}}(?:\.[0-9]+)?|[0-9]+,[0-9]+|[0-9]*\.[0-9]+|[0-9]+|half )"
_STARTS, _STOPS = r"(?:^|[^\p{L}\p{N}\p{M}.,/_])", r"\.?(?:[^0-9a-z\x{900}-\x{97f}.]|$)"
_ONE = rf"{_NUMBER}\s*(?:{_WRITTEN})"
_MORE = rf"\.?(?: and | & | )({_NUMBER})\s*({_WRITTEN})"
_SPLIT = r"^(?:([0-9]+)[ -])?([0-9]+)/([0-9]+)$"


def _read(number: str) -> str:
    """A number as it is written, in a column."""
    vulgar = " ".join(f"WHEN '{c}' THEN {f}.0" for c, f in _VULGAR.items())
    n = f"trim({number})"
    return f"""CASE WHEN {n} = 'half' THEN 0.5 WHEN contains('{_V}', right({n}, 1)) AND {n} <> '' THEN coalesce(try_cast(trim(left({n}, length({n}) - 1)) AS DOUBLE), 0) + CASE right({n}, 1) {vulgar} END
WHEN contains({n}, '/') THEN coalesce(try_cast(regexp_extract({n}, '{_SPLIT}', 1) AS DOUBLE), 0) + try_cast(regexp_extract({n}, '{_SPLIT}', 2) AS DOUBLE) / nullif(try_cast(regexp_extract({n}, '{_SPLIT}', 3) AS DOUBLE), 0)
WHEN regexp_full_match({n}, '[1-9][0-9]{{0,2}}(?:,[0-9]{{2,3}})*,[0-9]{{3}}(?:\\.[0-9]+)?') THEN try_cast(replace({n}, ',', '') AS DOUBLE) ELSE try_cast(replace({n}, ',', '.') AS DOUBLE) END"""


def _p3_sql() -> str:
    digits = _quoted("".join(chr(z + k) for z in _ZEROS for k in range(10)))
    plain = lambda c: f"regexp_replace(translate({_folded(c)}, {digits}, '{'0123456789' * len(_ZEROS)}'), '([0-9])\\s*[x×*]\\s*([0-9.{_V}]|half )', '\\1 x \\2', 'g')"
    units = ", ".join(f"({_quoted(s)}, '{u}', '{compositions()[u][0]}', {float(compositions()[u][1])!r})" for s, u in _SPELLED.items())
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in sorted(TWO_PART))
    generation = rf"({_STARTS})[345]g([^0-9a-z.]|$)"
    return f"""WITH u AS (SELECT * FROM (VALUES {units}) t(s, unit, base, factor)), two AS (SELECT * FROM (VALUES {pairs}) t(a, b)),
l AS (SELECT DISTINCT row_id, product_name, quantity, qty_value, qty_unit FROM phase2_before_after), p AS (SELECT *, row_number() OVER () AS id, regexp_replace(split_part({plain("product_name")}, ' + ', 1), '{generation}', '\\1 \\2', 'g') AS n, {plain("quantity")} AS q FROM l),
h AS (SELECT id, 1 AS place, unnest(regexp_extract_all(n, '{_STARTS}({_ONE}(?:{_MORE})?){_STOPS}', 1)) AS hit, generate_subscripts(regexp_extract_all(n, '{_STARTS}({_ONE}(?:{_MORE})?){_STOPS}', 1), 1) AS k FROM p
UNION ALL SELECT id, 2, unnest(regexp_extract_all(q, '{_STARTS}({_ONE}(?:{_MORE})?){_STOPS}', 1)), generate_subscripts(regexp_extract_all(q, '{_STARTS}({_ONE}(?:{_MORE})?){_STOPS}', 1), 1) FROM p),
x AS (SELECT *, regexp_extract(hit, '^({_NUMBER})', 1) AS n1, regexp_extract(hit, '^{_NUMBER}\\s*({_WRITTEN})', 1) AS s1, regexp_extract(hit, '^{_ONE}{_MORE}$', 1) AS n2, regexp_extract(hit, '^{_ONE}{_MORE}$', 2) AS s2 FROM h),
v AS (SELECT id, place, k, a.base, a.factor * {_read("n1")} AS first, CASE WHEN (a.unit, b.unit) IN (SELECT (a, b) FROM two) THEN b.factor * {_read("n2")} END AS second FROM x JOIN u a ON a.s = s1 LEFT JOIN u b ON b.s = s2),
w AS (SELECT id, place, k, base, first + coalesce(second, 0) AS total FROM v WHERE first > 0
UNION ALL SELECT id, 3, 1, base, qty_value * factor FROM p JOIN u ON u.s = CASE WHEN rtrim(lower(trim(qty_unit)), '.') = 'in' THEN 'inch' ELSE regexp_replace(replace(lower(trim(qty_unit)), ' ', ''), '\\.$', '') END WHERE qty_value > 0),
f AS (SELECT id, base, total, row_number() OVER (PARTITION BY id ORDER BY place, k) AS rn FROM w)
SELECT DISTINCT row_id, base AS base_unit, round(round(total * 1000, 4))::BIGINT AS amount_milli FROM f JOIN p USING (id) WHERE rn = 1"""


ORACLES: dict[str, str] = {"p3_found": _p3_sql()}
