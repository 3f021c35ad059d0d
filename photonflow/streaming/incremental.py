"""Incremental runs: the tree is listed, and only what has no result yet is processed.

A run's state is its result tables, not a streaming checkpoint: who deletes an output has it done again.
For listings that arrive as files, a bounded stream reads what is new and hands it to a pipeline.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from photonflow.config import PipelineConfig
from photonflow.operators.sink import Store
from photonflow.plans.pipelines import Services, run_pipeline
from photonflow.schema import ERRORS, IMAGES, OUTPUT
from photonflow.sources.image_tree import images_and_errors, stream_tree


def stream_listings(spark: SparkSession, folder: str, checkpoint: str, process: Callable[[DataFrame], object], files_per_batch: int = 64) -> None:
    """Hand each new batch of listing files (Parquet, schema IMAGES) to ``process``, then stop.

    ``process`` may see a batch again after a failure; the skip check of a pipeline makes that harmless.
    """
    rows = spark.readStream.schema(IMAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    query = rows.writeStream.foreachBatch(lambda df, _: process(df)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def follow_tree(spark: SparkSession, name: str, config: PipelineConfig, store: str, checkpoint: str, services: Services | None = None, settle: float = 1.0) -> str:
    """Take in what is new or changed in the tree since the last call, then run the pipeline over all that is known; -> its counters.

    The listing is a result table too. Each file comes once, and again when it is another; what it had as result or error
    goes in the same commit, so it is done again. A batch that is seen twice after a failure changes nothing. Outputs that were deleted are missing from the results
    and so are done again. A file that is gone stays in the listing; its item fails.
    """
    tables = Store(spark, store)

    def take(batch: DataFrame, _: int) -> None:
        files, problems = images_and_errors(batch)
        keys = files.select("rel_path")
        tables.commit({"listing": (files, None, IMAGES), "scan_errors": (problems, keys, ERRORS), name: (None, keys, OUTPUT), f"{name}_errors": (None, keys, ERRORS)})

    rows = stream_tree(spark, config.input_dir, config.extensions, settle)
    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return run_pipeline(spark, name, config, store, services, listing=tables.read("listing", IMAGES))
