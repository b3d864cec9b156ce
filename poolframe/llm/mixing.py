"""Mixing sources to target weights by thresholds on a hash, found in nested histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolframe.llm.store import stored

WORD = r"[^\x20\x09-\x0D]+"

#: Hex digits of the hash that each level of the histogram looks at: 4096 buckets.
DIGITS = 3
LEVELS = 3
#: Thresholds of up to so many sources are broadcast; more are joined on salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _draw(key: Column, text: Column) -> Column:
    """The hash that decides on a document, as hex digits; of the text where there is no key."""
    return F.substring(F.md5(F.coalesce(key.cast("string"), text, F.lit(""))), 1, DIGITS * LEVELS)


def _number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Of rows (source, source_size): what each source is to give, as `target`.

    Sources in order of code points, null last, have the weights in turn and share
    `share` of all sizes by them; none gets more than `most` times its size, the excess
    goes to the others by weight until none is above. In order of size by weight the
    sources at their limit come first, so running sums find them in one pass over
    rows that are as many as sources.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    lightest = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    weighed = sizes.withColumn("place", (F.row_number().over(turn) - 1) % len(weights)).select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") + 1).cast("int")).cast("bigint").alias("weight"), (F.col("source_size") * most).alias("cap")
    )
    summed = weighed.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(share) - (F.sum("cap").over(lightest) - F.col("cap"))).alias("left"),
        (F.sum("weight").over(every) - (F.sum("weight").over(lightest) - F.col("weight"))).alias("heavy"),
    )
    full = F.col("cap") * F.col("heavy") <= F.col("weight") * F.col("left")
    level = F.min(F.when(~full, F.struct("cap_by_weight", F.col("left") / F.col("heavy")))).over(every)["col2"]
    summed = summed.withColumn("cap_by_weight", F.struct(F.col("cap") / F.col("weight"), F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()))
    return summed.select("source", "source_size", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def thresholds(drawn: DataFrame, goals: DataFrame) -> DataFrame:
    """For each source (source, source_size, target): every document's copies, and the
    hash below which one more is taken.

    `drawn` has source, size and draw. A level sums sizes by source and bucket of the
    hash; the bucket in which a source's budget falls is the only one that the next level
    looks into. At the last level the bucket is taken if that comes nearer to the target.
    The budget below a threshold holds all that a smaller budget's does.
    """
    found = goals.select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int").alias("base"),
    ).select("*", (F.col("target") - F.col("base") * F.col("source_size")).alias("budget"), F.lit("").alias("edge"))
    for level in range(LEVELS):
        inside = drawn if not level else _to_source(drawn, found.select("source", "edge"), ["edge"]).where(F.substring("draw", 1, DIGITS * level) == F.col("edge"))
        histogram = inside.groupBy("source", F.substring("draw", 1, DIGITS * (level + 1)).alias("bucket")).agg(F.sum("size").alias("tokens"))
        below = Window.partitionBy("source").orderBy("bucket")
        levels = histogram.join(found, histogram.source.eqNullSafe(found.source)).drop(histogram.source)
        edge = (
            levels.withColumn("upto", F.sum("tokens").over(below))
            .where(F.col("upto") > F.col("budget"))
            .groupBy("source", "source_size", "target", "base", "budget")
            .agg(F.min(F.struct("bucket", "tokens", "upto")).alias("b"))
            .select("source", "source_size", "target", "base", "b.bucket", "b.tokens", (F.col("budget") - (F.col("b.upto") - F.col("b.tokens"))).alias("left"))
        )
        last = level == LEVELS - 1
        found = stored(
            edge.select(
                "source",
                "source_size",
                "target",
                "base",
                F.col("left").alias("budget"),
                (F.concat("bucket", F.when(2 * F.col("left") >= F.col("tokens"), F.lit("~")).otherwise(F.lit(""))) if last else F.col("bucket")).alias("edge"),
            ),
            "mix",
        )
    return found


def _to_source(rows: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of a table of sources, put to rows: broadcast if it is small, else on salted sources."""
    table = table.withColumnRenamed("source", "of_source")
    if table.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), rows.source.eqNullSafe(F.col("of_source")), "left").drop("of_source")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("of_salt", F.pmod(F.xxhash64("draw"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, dealt.source.eqNullSafe(F.col("of_source")) & (F.col("of_salt") == F.col("salt")), "left").drop("of_source", "salt", "of_salt")


def mix(documents: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The documents with size, source_size, target, copies and taken, in columns after their own.

    A document's size is its number of words (null text: 0), `copies` (0 to `most`) how
    often the mix takes it, `taken` their product. Documents of one key have one hash and
    so are taken alike; a null key is replaced by the text. A null source is a source of its
    own, sizes of 0 take nothing. Columns of those five names are replaced. Reruns agree:
    the hash is of the key alone.
    """
    spark = documents.sparkSession
    for name in ("size", "source_size", "target", "copies", "taken"):
        if name in documents.columns:
            documents = documents.drop(name)
    slim = stored(documents.select(documents[source].alias("source"), word_count(documents[text]).alias("size"), _draw(documents[key], documents[text]).alias("draw")), "drawn")
    sums = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(sums, weights, share, most), "goals")
    edges = thresholds(slim, goals)
    table = goals.join(edges.select(F.col("source").alias("s"), "base", "edge"), goals.source.eqNullSafe(F.col("s")), "left").drop("s")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    table = stored(table.select("source", "source_size", "target", F.coalesce("base", whole).cast("int").alias("base"), F.coalesce("edge", F.lit("")).alias("edge")), "edges")
    mixed = _to_source(documents.select(F.struct("*").alias("row"), F.col(source).alias("source"), word_count(documents[text]).alias("size"), _draw(documents[key], documents[text]).alias("draw")), table, ["source_size", "target", "base", "edge"])
    copies = (F.col("base") + (F.col("draw") < F.col("edge")).cast("int")).cast("int")
    return mixed.select("row.*", F.col("size").alias("size"), "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
