"""Ordered outputs: a table sorted over all its partitions, with the place of each row as a column, and files that keep the order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.sources.stages import checkpointed

#: Rows of a partition are counted in so many bits of the row ids.
_ROW_BITS = 33


def _sorted(df: DataFrame, keys: list[str | Column], partitions: int | None) -> DataFrame:
    dealt = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def positioned(df: DataFrame, keys: list[str | Column], partitions: int | None = None) -> DataFrame:
    """df with position (from 0) in the order of keys, which must tell rows apart for equal runs.

    Ranges of keys are sorted on their own; a row's position is its place in its range and the rows in the ranges before, which
    are counted in a table of one row a partition. No task sees more than its range, unless rows have equal keys.
    """
    # Ids of rows must be those of the written ranges, whatever is computed again later.
    held = checkpointed(_sorted(df, keys, partitions).withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftright("_row", _ROW_BITS)
    sizes = held.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a partition
    joined = held.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.withColumn("position", F.col("_before") + F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).drop("_row", "_part", "_before")


def write_sorted(df: DataFrame, path: str, keys: list[str | Column], partitions: int | None = None) -> None:
    """Parquet files whose names sort like their ranges of keys, each sorted inside: reading them in name order is reading in key order."""
    _sorted(df, keys, partitions).write.parquet(path)


def file_order(found: DataFrame, keys: list[str]) -> DataFrame:
    """(file, first, last, n) of a sorted output and whether it follows the file before it; sorted says that no row of the file is out of order."""
    key = F.struct(*keys)
    placed = found.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("i"), key.alias("k"))
    w = Window.partitionBy("file").orderBy("i")
    inside = placed.withColumn("ok", F.coalesce(F.col("k") >= F.lag("k").over(w), F.lit(True))).groupBy("file").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.count("*").alias("n"), F.min("ok").alias("sorted"))
    return inside.withColumn("follows", F.coalesce(F.col("first") >= F.lag("last").over(Window.orderBy("file")), F.lit(True)))  # a row a file
