"""The order in which items are processed, and ranks in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from photonflow.functions.naturalsort import directory_order, order_key


def sort_columns(order: str) -> list[Column]:
    """Deepest directories first, files within a directory by ``order``."""
    return [*directory_order(F.col("dir"), F.col("depth"), order), F.col("dir"), order_key(F.col("name"), order), F.col("name")]


def in_order(images: DataFrame, order: str = "natural-desc", partitions: int | None = None) -> DataFrame:
    """``images`` by ``sort_columns``: a range sort, spread over tasks; over ``partitions`` tasks, each of which takes its rows in order, if given."""
    by = sort_columns(order)
    return images.repartitionByRange(partitions, *by).sortWithinPartitions(*by) if partitions else images.orderBy(*by)


def rank_within(group: Column, name: Column, order: str, tie: Column) -> Column:
    """Rank of ``name`` in ``order`` within ``group``; ``tie`` must tell equal names apart."""
    return F.row_number().over(W.partitionBy(group).orderBy(order_key(name, order), tie))
