"""Logs of forest runs: name:value fields on one line for each run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed names of the log format.
NUMBERS = {"nthreads": "nthreads:", "batch": "batch#", "msf_edges": "msf_edges:", "cycles_main": "cycles_main:", "cycles_helper": "cycles_helper:", "cycles_skipped": "cycles_skipped:"}


def _number(text: Column, mark: str, pattern: str, kind: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?:^|\s){mark}({pattern})", 1), F.lit("")).cast(kind)


def parse_runs(lines: DataFrame, line: str = "value") -> DataFrame:
    """The fields of each run, null where one is missing, and the cycles of each helper as an array in order of helpers."""
    text = F.col(line)
    helpers = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"cycles_ht#(\d+):\d+")).alias("i"), F.regexp_extract_all(text, F.lit(r"cycles_ht#\d+:(\d+)")).alias("n"))
    cycles = F.transform(F.array_sort(F.transform(helpers, lambda h: F.struct(h["i"].cast("long"), h["n"].cast("long").alias("n")))), lambda h: h["n"])
    return lines.filter(text.rlike(r"(?:^|\s)nthreads:\d+")).select(
        *(_number(text, mark, r"\d+", "long").alias(name) for name, mark in NUMBERS.items()), _number(text, "seconds:", r"\d+(?:\.\d+)?", "double").alias("seconds"), cycles.alias("cycles_by_helper")
    )


def write_runs(runs: DataFrame, path: str) -> None:
    """As CSV with a header; the cycles of the helpers on one field, joined by blanks."""
    runs.withColumn("cycles_by_helper", F.array_join(F.transform("cycles_by_helper", lambda n: n.cast("string")), " ")).write.option("header", True).csv(path)
