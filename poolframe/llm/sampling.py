"""Samples of bounded size, alike on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def smallest(rows: DataFrame, by: str, key: str, n: int, parts: int = 64) -> DataFrame:
    """Of each group the `n` rows with the smallest hashes of the key.

    Groups are cut in parts by the hash first, and of each part only `n` rows go on: so a group with most of
    the rows is ranked by many tasks, and no task sees more than parts * n rows in the end.
    """
    drawn = rows.withColumns({"h": F.xxhash64(key), "part": F.pmod(F.xxhash64(F.lit(1), F.col(key)), F.lit(parts))})
    order = [F.col("h"), F.col(key)]
    some = drawn.withColumn("n", F.row_number().over(Window.partitionBy(by, "part").orderBy(*order))).where(F.col("n") <= n)
    best = some.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("n") <= n)
    return best.select(*rows.columns)
