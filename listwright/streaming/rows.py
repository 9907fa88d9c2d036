"""Stages of the pipeline on streams: row-local ones keep no state, so a stream gives the rows that a batch gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.functions.text import first_quantity, pack_count, with_normalized


def clean_listings(df: DataFrame, name: str = "product_name") -> DataFrame:
    """A batch or stream of listings with ``name_clean, qty_value, qty_unit, pack_count``; null names give nulls."""
    value, unit = first_quantity(F.col(name))
    return with_normalized(df, name, "name_clean").withColumns({"qty_value": value, "qty_unit": unit, "pack_count": pack_count(F.col(name))})


def first_deliveries(stream: DataFrame, key: str) -> DataFrame:
    """A stream with only the first delivery of every key, however late a row or its repeat arrives.

    No watermark, since rows arrive weeks after their event time and would be lost behind it: the state holds every key.
    """
    return stream.dropDuplicates([key])
