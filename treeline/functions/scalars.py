"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_power_of_two(n: Column) -> Column:
    """The smallest power of two that is not below n, from 1; exact, by the binary digits of n - 1."""
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2.0), F.length(F.bin(n.cast("long") - 1))).cast("long"))


def digits(n: Column) -> Column:
    return F.length(F.abs(n).cast("string"))


def percent_cells(share: Column, width: int = 60) -> Column:
    """Cells of a progress bar, rounded half up."""
    return F.round(share * width).cast("long")


def without(text: Column, character: str) -> Column:
    return F.translate(text, character, "")


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def number_list(text: Column) -> Column:
    """Ascending distinct numbers of a list such as 0-3,7 9-10; blanks separate like commas."""
    parts = F.filter(F.split(F.trim(text), r"[,\s]+"), lambda p: p.rlike(r"^\d+(-\d+)?$"))
    ranges = F.transform(parts, lambda p: F.sequence(F.split(p, "-")[0].cast("long"), F.element_at(F.split(p, "-"), -1).cast("long")))
    return F.array_sort(F.array_distinct(F.flatten(ranges)))


def pairs_total(text: Column) -> Column:
    """Sum of the counts in a text of loop:count pairs."""
    return F.aggregate(F.transform(F.regexp_extract_all(text, F.lit(r"\d+:(\d+)")), lambda c: c.cast("long")), F.lit(0).cast("long"), lambda a, c: a + c)


def mask_bits(mask: Column) -> Column:
    """Set bits of a hexadecimal mask of up to 16 digits, groups separated by commas."""
    return F.bit_count(F.conv(F.translate(mask, ",", ""), 16, 10).cast("decimal(20,0)").cast("long"))
