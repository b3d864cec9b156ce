"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_inner: ContextVar[str | None] = ContextVar("poolframe_scratch", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only in local mode, where it may be unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.conf.get("poolframe.shared.dir", None)
        if not folder:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="poolframe-")
            spark.conf.set("poolframe.shared.dir", folder)
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_inner.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes folders that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """What is stored within goes to a folder of its own, which is deleted in the end."""
    path = fresh_path(spark, name)
    token = _inner.set(path)
    try:
        yield
    finally:
        _inner.reset(token)
        discard(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared folder and read again.

    This cuts the lineage at files that outlive any executor, and gives the planner
    the real size of the table.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, *tables: DataFrame) -> str:
    """The name, with underscores added until none of the tables has such a column."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The table with columns of these names, in any case, renamed; and what gives a later table its columns back.

    So an operator that adds columns of such names replaces none of the table's own.
    """
    own, taken = df.columns, {n.lower() for n in names}
    hidden = {c: unused(f"own_{c}", df) for c in own if c.lower() in taken}
    return df.withColumnsRenamed(hidden), lambda after: after.select(*[F.col(f"`{hidden.get(c, c)}`").alias(c) for c in own])


#: Keys with more than this part of all rows are broadcast; so there are fewer of them than this.
HOT_KEYS = 10_000


def join_counted(rows: DataFrame, table: DataFrame, on: str, count: str, total: int, partitions: int = 0) -> DataFrame:
    """`rows` left-joined with a table that has a row for each key `on`, and in `count` how many of the `total` rows have it.

    Keys with more than total / HOT_KEYS rows are put to the rows by a broadcast, as there are fewer than HOT_KEYS
    of them; the rows of others are shuffled by the key, those of hot ones and of null keys anywhere. `count` is left
    out. A key that isn't in the table must be rare. With `partitions`, rows are dealt to so many.
    """
    values = [c for c in table.columns if c not in (on, count)]
    hot = F.col(count) * HOT_KEYS > total
    near, spread = unused("near", rows, table), unused("spread", rows, table)
    first = table.where(hot).select(F.col(on), F.struct(F.lit(True).alias("is"), *values).alias(near))
    marked = rows.join(F.broadcast(first), on, "left")
    away = F.concat(F.lit("~"), F.monotonically_increasing_id().cast("string"))
    marked = marked.withColumn(spread, F.when(F.col(near).isNotNull() | F.col(on).isNull(), away).otherwise(F.col(on).cast("string")))
    if partitions:
        marked = marked.repartition(partitions, spread)
    rest = table.where(~hot).select(F.col(on).cast("string").alias(spread), F.struct(*values).alias(f"{near}_"))
    joined = marked.join(rest, spread, "left")
    return joined.select(*rows.columns, *[F.coalesce(F.col(near)[c], F.col(f"{near}_")[c]).alias(c) for c in values])
