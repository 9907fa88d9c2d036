"""Problem 3: the same measured quantity recorded in different units and scales, converted to one unit each.

Conversions are edges of a graph, each an affine function. The shortest composition from every unit to the canonical
unit of its dimension is computed once, and every other edge is checked against it: a cycle that does not come back to
the identity is an error. Rows then meet the finished table in an equi-join on their unit.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listwright.functions.quantity import amounts, spellings
from listwright.runtime import broadcast_if_small, spread

Edge = tuple[str, str, str, str]

# Fixed values: (from, to, factor, offset), one unit of `from` being factor * x + offset units of `to`.
CONVERSIONS: list[Edge] = [
    ("mg", "g", "0.001", "0"),
    ("100g", "g", "100", "0"),
    ("kg", "g", "1000", "0"),
    ("oz", "g", "28.349523125", "0"),
    ("lb", "g", "453.59237", "0"),
    ("lb", "oz", "16", "0"),
    ("100ml", "ml", "100", "0"),
    ("cl", "ml", "10", "0"),
    ("l", "ml", "1000", "0"),
    ("l", "cl", "100", "0"),
    ("mm", "cm", "0.1", "0"),
    ("m", "cm", "100", "0"),
    ("m", "mm", "1000", "0"),
    ("inch", "cm", "2.54", "0"),
    ("ft", "inch", "12", "0"),
    ("ft", "cm", "30.48", "0"),
    ("yd", "ft", "3", "0"),
]
CANONICAL = ("g", "ml", "cm")


def compositions(edges: Iterable[Edge] = CONVERSIONS, canonical: Iterable[str] = CANONICAL) -> dict[str, tuple[str, Fraction, Fraction]]:
    """Unit to (canonical unit, factor, offset) along the fewest edges.

    Raises ValueError for a unit that reaches two canonical units and for an edge that disagrees with the composition
    of the others (a cycle whose product is not the identity). Exact, in fractions.
    """
    edges = [(a, b, Fraction(f), Fraction(o)) for a, b, f, o in edges]
    if any(not f for _, _, f, _ in edges):
        raise ValueError("a conversion needs a factor other than zero")
    into: dict[str, list[tuple[str, Fraction, Fraction]]] = {}
    for a, b, f, o in edges:
        into.setdefault(b, []).append((a, f, o))
        into.setdefault(a, []).append((b, 1 / f, -o / f))
    found: dict[str, tuple[str, Fraction, Fraction]] = {}
    for base in canonical:
        if base in found:
            raise ValueError(f"{base} is reached from {found[base][0]}")
        found[base], queue = (base, Fraction(1), Fraction(0)), deque([base])
        while queue:
            _, f, o = found[unit := queue.popleft()]
            for near, g, p in into.get(unit, []):
                if near not in found:
                    found[near] = (base, f * g, f * p + o)
                    queue.append(near)
    for a, b, f, o in edges:
        if a in found and (found[b][0], found[b][1] * f, found[b][1] * o + found[b][2]) != found[a]:
            raise ValueError(f"the conversion {a} -> {b} contradicts the path by way of other units")
    return found


def conversion_table(spark: SparkSession, edges: Iterable[Edge] = CONVERSIONS) -> DataFrame:
    """``unit, base_unit, factor, offset``: one row per unit."""
    rows = [(unit, base, float(f), float(o)) for unit, (base, f, o) in compositions(edges).items()]
    return spark.createDataFrame(rows, "unit string, base_unit string, factor double, offset double")


def spelling_table(spark: SparkSession) -> DataFrame:
    """``spelling, base_unit, factor``: one row per spelling of a unit."""
    table = compositions()
    rows = [(s, table[u][0], float(table[u][1])) for s, u in spellings().items()]
    return spark.createDataFrame(rows, "spelling string, base_unit string, factor double")


_PARTS = T.StructType([T.StructField("v1", T.DoubleType()), T.StructField("u1", T.StringType()), T.StructField("v2", T.DoubleType()), T.StructField("u2", T.StringType())])


def stated_parts(df: DataFrame, keep: list[str], title: str, text: str, value: str, unit: str) -> DataFrame:
    """``keep`` plus ``v1, u1, v2, u2``: the amount that counts, from the title, else the text, else value and unit."""
    slim = df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(title).alias("title"), F.col(text).alias("text"), F.col(value).cast("double").alias("value"), F.col(unit).alias("unit"))
    n, schema = len(keep), T.StructType([*slim.schema.fields[: len(keep)], *_PARTS.fields])
    names = spellings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = []
            for name, other, v, u in zip(*(part.column(n + i).to_pylist() for i in range(4)), strict=True):
                found = amounts(name) or amounts(other, title=False)
                if not found and v is not None and u and 0 < v < float("inf"):
                    known = names.get(u.strip().lower().replace(" ", "").removesuffix(".")) or ("inch" if u.strip().lower().removesuffix(".") == "in" else None)
                    found = [(v, known)] if known else []
                first, second = (*found, (None, None), (None, None))[:2]
                rows.append((*first, *second))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.float64(), pa.string(), pa.float64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns[:n], *columns], names=schema.names)

    return spread(slim).mapInArrow(run, schema)


def canonical_amounts(df: DataFrame, key: str, title: str = "product_name", text: str = "quantity", value: str = "qty_value", unit: str = "qty_unit", edges: Iterable[Edge] = CONVERSIONS) -> DataFrame:
    """``key, base_unit, amount_milli``: the amount of one unit of each row in thousandths of g, ml or cm.

    The title counts if it states a mass, volume or length, else the text, else value with unit; rows without any are
    left out, as are a value without a unit, a count of pieces, zero, negative and non-finite values. Repeated rows of a
    key give one row per distinct amount. The conversion table has one row per unit, so its broadcast is bounded.
    """
    table = broadcast_if_small(conversion_table(df.sparkSession, edges))
    one = table.select(F.col("unit").alias("u1"), "base_unit", F.col("factor").alias("f1"), F.col("offset").alias("o1"))
    two = table.select(F.col("unit").alias("u2"), F.col("base_unit").alias("b2"), F.col("factor").alias("f2"), F.col("offset").alias("o2"))
    parts = stated_parts(df, [key], title, text, value, unit).where(F.col("u1").isNotNull())
    met = parts.join(one, "u1").join(two, "u2", "left")
    total = F.col("v1") * F.col("f1") + F.col("o1") + F.coalesce(F.col("v2") * F.col("f2") + F.col("o2"), F.lit(0.0))
    return met.select(F.col("k0").alias(key), "base_unit", F.round(F.round(total * 1000, 4)).cast("bigint").alias("amount_milli")).distinct()
