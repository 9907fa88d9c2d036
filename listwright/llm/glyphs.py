"""Problem 1: one consistent form for text that prints alike but is made of different characters.

The transformation is embedded SQL that DuckDB evaluates over the Arrow batches of each partition: ``translate`` draws
look-alike letters, width variants and blanks with one code point each and drops what is invisible, ``replace`` spells
out ligatures, ``nfc_normalize`` composes accents, a regular expression collapses blanks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.functions.charfold import tables
from listwright.runtime import spread, stored


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _ranges(points: list[int]) -> str:
    """A regular-expression class of code points, neighbours joined into ranges."""
    out: list[list[int]] = []
    for cp in sorted(points):
        if out and cp == out[-1][1] + 1:
            out[-1][1] = cp
        else:
            out.append([cp, cp])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in out) + "]"


@lru_cache(1)
def canonical_sql() -> str:
    """DuckDB SQL that reads ``batch(name)`` and returns ``form``, one row per input row in input order.

    The wide tables stand behind a ``CASE``, so that ASCII text only pays for the collapse of its blanks.
    """
    t = tables()
    single = t["letters"] | t["blanks"]
    drop = _ranges(list(t["invisible"]))
    spelled = f"regexp_replace(name, {_quoted(drop)}, '', 'g')"
    spelled = f"translate({spelled}, {_quoted(''.join(map(chr, single)))}, {_quoted(''.join(single.values()))})"
    fonts = f"translate(name, {_quoted(''.join(map(chr, t['fonts'])))}, {_quoted(''.join(t['fonts'].values()))})"
    ligatures = "name"
    for cp, plain in t["spelled"].items():
        ligatures = f"replace({ligatures}, {_quoted(chr(cp))}, {_quoted(plain)})"
    return f"""
WITH a AS (SELECT i, name, strlen(name) = length(name) AS plain FROM batch),
b AS (SELECT i, CASE WHEN plain THEN name ELSE {spelled} END AS name FROM a),
c AS (SELECT i, CASE WHEN strlen(name) > length(name) AND regexp_matches(name, {_quoted(_ranges(list(t["fonts"])))}) THEN {fonts} ELSE name END AS name FROM b),
d AS (SELECT i, CASE WHEN strlen(name) > length(name) AND regexp_matches(name, {_quoted(_ranges(list(t["spelled"])))}) THEN {ligatures} ELSE name END AS name FROM c)
SELECT trim(regexp_replace(CASE WHEN strlen(name) > length(name) THEN nfc_normalize(name) ELSE name END,
       '[\\t-\\r\\x1c-\\x1f ]+', ' ', 'g'), ' ') AS form FROM d ORDER BY i"""


def canonical_text(df: DataFrame, column: str, out: str = "form") -> DataFrame:
    """``df`` with ``out``, the consistent form of string column ``column``.

    Null stays null, empty or blank text becomes ''. Two texts get equal forms when they differ only in the code points
    that draw them, in width, in invisible characters or in blanks at either end. Works on whole texts of any length;
    an existing column named ``out`` is replaced.
    """
    kept = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])
    at, sql = kept.index(column), canonical_sql()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
        for part in batches:
            names = part.column(at).cast(pa.string())
            con.register("batch", pa.table({"i": pa.array(range(len(names)), pa.int32()), "name": names}))
            form = con.sql(sql).to_arrow_table().column("form").combine_chunks()
            con.unregister("batch")
            form = form if isinstance(form, pa.Array) else pa.concat_arrays(form.chunks) if form.num_chunks else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, form.cast(pa.string())], names=[*part.schema.names, out])
        con.close()

    return spread(df).mapInArrow(run, schema)


def look_alike_pairs(df: DataFrame, key: str, column: str) -> DataFrame:
    """Every two keys (``<key>_a`` < ``<key>_b``) whose texts have one form but are not equal character by character.

    Repeated rows of a key count once; null texts pair with nothing. Texts that only repeat are never paired: the
    distinct spellings of a form are paired first, and only those pairs meet the rows, so the work follows the result.
    """
    rows = canonical_text(df.select(F.col(key).alias("k"), F.col(column).alias("t")).where(F.col(column).isNotNull() & F.col(key).isNotNull()), "t", "f")
    rows = stored(rows, "forms")  # read three times; the embedded SQL runs once
    spelling = rows.groupBy("f").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).where("lo < hi").select("f")
    kept = rows.join(spelling, "f", "left_semi").distinct()
    texts = kept.select("f", "t").distinct()
    pairs = texts.alias("x").join(texts.alias("y"), "f").where("x.t < y.t").select("f", F.col("x.t").alias("ta"), F.col("y.t").alias("tb"))
    left = kept.select("f", F.col("t").alias("ta"), F.col("k").alias("ka"))
    right = kept.select("f", F.col("t").alias("tb"), F.col("k").alias("kb"))
    met = pairs.join(left, ["f", "ta"]).join(right, ["f", "tb"]).where("ka <> kb")
    return met.select(F.least("ka", "kb").alias(f"{key}_a"), F.greatest("ka", "kb").alias(f"{key}_b")).distinct()
