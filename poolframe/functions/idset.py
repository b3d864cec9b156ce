"""Compressed sets of ids and hosts: "0-3,7" and "node[0-3,7]"."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def members(text: str) -> list[str]:
    """What a compressed set holds: ids of "0-3,7", names of "node[0-3],rack1"."""
    out = []
    for part in re.findall(r"[^,\[\]]*\[[^\]]*\]|[^,]+", text):
        prefix, _, body = part.partition("[")
        if not body:
            prefix, body = ("", part) if re.fullmatch(r"\d+(-\d+)?", part) else (part, "")
        for span in body.rstrip("]").split(",") if body else [""]:
            low, _, high = span.partition("-")
            out += [f"{prefix}{i:0{len(low)}d}" for i in range(int(low), int(high) + 1)] if high else [prefix + low]
    return out


def within(column: Column, text: str) -> Column:
    """Whether a column's name or number is in a compressed set; a range is a comparison, however long it is."""
    out, name = F.lit(False), column.cast("string")
    for part in re.findall(r"[^,\[\]]*\[[^\]]*\]|[^,]+", text):
        prefix, _, body = part.partition("[")
        if not body:
            prefix, body = ("", part) if re.fullmatch(r"\d+(-\d+)?", part) else (part, "")
        for span in body.rstrip("]").split(",") if body else [""]:
            low, _, high = span.partition("-")
            if not high:
                out = out | (name == prefix + low)
                continue
            digits = F.regexp_extract(name, f"^{re.escape(prefix)}(\\d+)$", 1)
            number = digits.try_cast("bigint")
            plain = F.length(digits) == F.greatest(F.lit(len(low)), F.length(number.cast("string")))
            out = out | F.coalesce(number.between(int(low), int(high)) & plain, F.lit(False))
    return out


def encode(rows: DataFrame, by: Sequence[str], column: str, out: str = "idset") -> DataFrame:
    """by, out: each group's distinct ids as ranges in ascending order.

    Ids less their place in order are equal within a range, so ranges are groups; ids are made
    distinct first, in the tasks where they lie.
    """
    distinct = rows.select(*by, F.col(column).cast("bigint").alias("id")).where("id IS NOT NULL").distinct()
    turn = Window.partitionBy(*by).orderBy("id")
    ranges = distinct.withColumn("island", F.col("id") - F.row_number().over(turn)).groupBy(*by, "island").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    text = F.when(F.col("low") == F.col("high"), F.col("low").cast("string")).otherwise(F.concat_ws("-", "low", "high"))
    return ranges.groupBy(*by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("low", text.alias("text")))), lambda x: x["text"]), ",").alias(out))


def decode(rows: DataFrame, column: str, out: str = "id") -> DataFrame:
    """A row for each id of a compressed set, its columns repeated; empty and null sets give none."""
    parts = F.split(column, ",")
    bounds = F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.element_at(F.split(p, "-"), 1).cast("bigint").alias("low"), F.element_at(F.split(p, "-"), -1).cast("bigint").alias("high")))
    return rows.withColumn(out, F.explode(F.flatten(F.transform(bounds, lambda b: F.sequence(b["low"], b["high"])))))
