"""The row that follows in a global order, without gathering all rows in one task."""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_guards(rows: DataFrame, key: str, ties: list[str], runs: int | None = None) -> DataFrame:
    """Deal ``rows`` into runs of ascending ``key``; each run ends with a copy of the row that follows it.

    Adds ``_run`` and ``_guard`` (true for the copies); partitions hold whole runs, sorted by run,
    guard, key and ``ties``. The last run is followed by the first row of all. The driver sees one
    key for each run, and the number of runs is that of shuffle partitions times four, whatever the
    rows. A key that many rows share stays in one run, so keys should end in something distinct.
    ``key`` must not be null.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.select(F.col(key).alias("k")).repartitionByRange(runs or 4 * parts, "k")
    firsts = sorted(r["k"] for r in ranged.groupBy(F.spark_partition_id()).agg(F.min("k").alias("k")).collect())
    known = set(firsts)

    @F.pandas_udf("array<struct<_run:int,_guard:boolean>>")
    def places(keys: pd.Series) -> pd.Series:
        out = []
        for k in keys:
            run = max(0, bisect_right(firsts, k) - 1)
            out.append([(run, False)] + ([((run - 1) % len(firsts), True)] if k in known else []))
        return pd.Series(out)

    dealt = rows.withColumn("_place", F.explode(places(F.col(key)))).select(*rows.columns, "_place._run", "_place._guard")
    return dealt.repartition(parts, "_run").sortWithinPartitions("_run", "_guard", key, *ties)
