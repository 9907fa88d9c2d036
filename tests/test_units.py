"""Amounts and unit conversion: golden cases, the graph, and every kind of awkward row."""

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st

from listwright.functions.charfold import fold
from listwright.functions.quantity import amounts, number, packs
from listwright.operators.units import CANONICAL, CONVERSIONS, canonical_amounts, compositions

SCHEMA = "row_id bigint, product_name string, quantity string, qty_value double, qty_unit string"


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Atta 1kg", [(1.0, "kg")]),
        ("Oil 1 ltr", [(1.0, "l")]),
        ("Pepsi 2.25L", [(2.25, "l")]),
        ("1,250GM", [(1250.0, "g")]),
        ("2,5 kg", [(2.5, "kg")]),
        ("0,340 kg", [(0.34, "kg")]),
        (".5 ltr", [(0.5, "l")]),
        ("½ kg", [(0.5, "kg")]),
        ("1½ KG", [(1.5, "kg")]),
        ("1 1/2 kg", [(1.5, "kg")]),
        ('8-1/2"', [(8.5, "inch")]),
        ("half litre", [(0.5, "l")]),
        ("2 lb 8 oz", [(2.0, "lb"), (8.0, "oz")]),
        ("1 kg 250 g", [(1.0, "kg"), (250.0, "g")]),
        ("5k.g.", [(5.0, "kg")]),
        ("२.५ किलो", [(2.5, "kg")]),
        ("७५ ग्राम", [(75.0, "g")]),
        ("４ x ５００ｇ", [(500.0, "g")]),
        ("Soap 2 in 1, 70 grams + Mist 100 ml", [(70.0, "g")]),
        ("Monitor 4G - 14 INCHES", [(14.0, "inch")]),
        ("64 GB", []),
        ("24K Gold", []),
        ("Model T20", []),
        ("(B1G1)", []),
        ("1/0 kg", []),
        ("0 kg", []),
        ("100 pcs", []),
        ("", []),
        (None, []),
    ],
)
def test_amounts(text, parts):
    assert amounts(text) == parts


@pytest.mark.parametrize(("text", "counts"), [("(Pack of 6)", [6]), ("3 x 100g", [3]), ("70 g x 4", [4]), ("12 pcs", [12]), ("24x7 Fresh", []), ("2 in 1", []), ("Set of 2 + Brush 4 pcs", [2]), (None, [])])
def test_packs(text, counts):
    assert packs(text) == counts


@given(st.text())
def test_any_text_is_read(text):
    assert fold(fold(text)) == fold(text)
    for value, _ in amounts(text):
        assert value > 0


def test_number_without_denominator():
    assert number("3/0") is None


def test_every_unit_reaches_one_canonical_unit():
    found = compositions()
    assert {base for base, _, _ in found.values()} == set(CANONICAL)
    assert float(found["ft"][1]) == 30.48
    assert math.isclose(float(found["oz"][1]) * 16, float(found["lb"][1]))


def test_affine_conversion_and_its_inverse():
    found = compositions([("f", "c", "5/9", "-160/9"), ("k", "c", "1", "-273.15")], ["c"])
    assert float(found["f"][1] * 212 + found["f"][2]) == 100
    back = compositions([("c", "f", "9/5", "32")], ["c"])
    assert float(back["f"][1] * 212 + back["f"][2]) == 100


def test_a_cycle_that_contradicts_itself_is_refused():
    with pytest.raises(ValueError, match="contradicts"):
        compositions([*CONVERSIONS, ("lb", "kg", "0.5", "0")])
    with pytest.raises(ValueError, match="reached"):
        compositions([("g", "ml", "1", "0")], ["g", "ml"])


def test_rows(spark):
    rows = [
        (1, "Atta 1kg", "2 kg", 3.0, "kg"),
        (1, "Atta 1kg", "2 kg", 3.0, "kg"),
        (2, "Atta", "4 x 500 g", None, None),
        (3, "Atta", None, 22.5, "100 ml"),
        (4, "Atta", None, 5.0, None),
        (5, "Atta", None, 5.0, "pc"),
        (6, None, None, 12.0, "in."),
        (7, "", " ", float("nan"), "kg"),
        (8, "x " * 200_000 + "3 oz", None, None, None),
        (None, "1 g", None, None, None),
        (9, "Atta", None, -1.0, "kg"),
    ]
    got = {tuple(r) for r in canonical_amounts(spark.createDataFrame(rows, SCHEMA), "row_id").collect()}
    assert got == {(1, "g", 1_000_000), (2, "g", 500_000), (3, "ml", 2_250_000), (6, "cm", 30_480), (8, "g", 85_049), (None, "g", 1_000)}


def test_empty_table_and_clashing_columns(spark):
    assert canonical_amounts(spark.createDataFrame([], SCHEMA), "row_id").count() == 0
    df = spark.createDataFrame([(1, "1 kg", None, None, None, "a", 2.0)], SCHEMA + ", base_unit string, u1 double")
    assert [tuple(r) for r in canonical_amounts(df, "row_id").collect()] == [(1, "g", 1_000_000)]
