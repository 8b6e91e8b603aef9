"""Maps of bits with a fixed size: supersets of key sets that may be broadcast whatever the input."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 32768


def build(places: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bytes of a map in which the places (0 to bits - 1) of a column are set; at most ``bits`` reach the driver."""
    pages = places.groupBy(F.floor(F.col(column) / PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col(column) % PAGE).alias("bits"))
    table = pages.toArrow()
    out = np.zeros((bits // PAGE, PAGE // 8), np.uint8)
    for page, b in zip(table["page"].to_pylist(), table["bits"].to_pylist(), strict=True):
        out[page] = np.frombuffer(b, np.uint8)
    return out.ravel()


def test(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def pages(places: DataFrame, column: str) -> DataFrame:
    """The map as rows (_page, _bits): at most ``bits`` / PAGE of 4 KB each, whatever the input."""
    return places.groupBy(F.floor(F.col(column) / PAGE).alias("_page")).agg(F.bitmap_construct_agg(F.col(column) % PAGE).alias("_bits"))


def split(rows: DataFrame, place: Column, table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose place is not set, and those where it is, by a broadcast of the map's pages; no row is moved."""
    at = place % PAGE
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(1), F.lit(0))
    tested = rows.withColumn("_page", F.floor(place / PAGE)).join(F.broadcast(table), "_page", "left")
    return tested.filter(bit == 0).select(*rows.columns), tested.filter(bit == 1).select(*rows.columns)
