"""Shortcuts to images, as a table, and as files through a writer of the platform's."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonflow.functions.paths import output_path


class Linker(Protocol):
    def write(self, link_path: str, target_path: str, working_dir: str) -> None:
        """Make the shortcut; an existing one is replaced."""


class Symlinks:
    """Symbolic links, where the platform has no shortcuts of its own."""

    def write(self, link_path: str, target_path: str, working_dir: str) -> None:
        os.makedirs(os.path.dirname(link_path), exist_ok=True)
        part = f"{link_path}.{os.getpid()}.part"
        os.symlink(target_path, part)
        os.replace(part, link_path)


def links(images: DataFrame, output_dir: str) -> DataFrame:
    """``(rel_path, target_path, working_dir, link_path)``."""
    return images.select("rel_path", F.col("path").alias("target_path"), F.col("dir").alias("working_dir"), output_path(output_dir, F.col("rel_path"), ".lnk").alias("link_path"))


def write_links(rows: DataFrame, factory: Callable[[], Linker]) -> DataFrame:
    """``rows`` of ``links`` with ``error``; one writer for each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        linker = factory()
        for batch in batches:
            errors = []
            for row in batch.itertuples(index=False):
                try:
                    errors.append(linker.write(row.link_path, row.target_path, row.working_dir))
                except Exception as e:  # whatever the platform raises is this shortcut's error
                    errors.append(f"{type(e).__name__}: {e}")
            yield batch.assign(error=pd.Series(errors, dtype=object))

    return rows.mapInPandas(run, "rel_path string, target_path string, working_dir string, link_path string, error string")
