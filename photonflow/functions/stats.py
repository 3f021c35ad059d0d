"""Counters of a stage: what came in, went out, failed and was rejected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE, FAILED, REJECTED = "done", "failed", "rejected"


def stage_stats(events: DataFrame, *keys: str) -> DataFrame:
    """``events(keys, outcome, output_count)`` -> counters by key; ``diff`` tells that some item had not exactly one output."""
    done = F.col("outcome") == DONE
    return events.groupBy(*keys).agg(
        F.count("*").alias("input"), F.count_if(done).alias("done"), F.count_if(F.col("outcome") == FAILED).alias("failed"), F.count_if(F.col("outcome") == REJECTED).alias("rejected"),
        F.coalesce(F.sum(F.when(done, F.col("output_count"))), F.lit(0)).cast("long").alias("output"), F.coalesce(F.bool_or(done & (F.col("output_count") != 1)), F.lit(False)).alias("diff"),
    )


def stats_line(input_: Column, output: Column, failed: Column, rejected: Column, diff: Column) -> Column:
    """``[in>][nF][nR]outD``."""
    shown = lambda n, mark: F.when(n > 0, F.concat(n.cast("string"), F.lit(mark))).otherwise("")
    return F.concat(F.when(diff, F.concat(input_.cast("string"), F.lit(">"))).otherwise(""), shown(failed, "F"), shown(rejected, "R"), output.cast("string"), F.lit("D"))


def output_count(outputs: Column) -> Column:
    """Length of an array of outputs; null is none."""
    return F.coalesce(F.size(outputs), F.lit(0))
