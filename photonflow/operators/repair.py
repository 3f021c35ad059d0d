"""Repair of images that the model server refused."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonflow.functions.paths import fixed_variant, has_extension
from photonflow.media.jpeg import SIGNATURE, repair
from photonflow.operators.lookup import with_error

JPEG = (".jpg", ".jpeg")


def repairable(images: DataFrame, errors: DataFrame) -> DataFrame:
    """JPEG images whose last error is the one that a repair removes."""
    return with_error(images.where(has_extension(F.col("name"), JPEG)), errors, SIGNATURE)


def repair_images(images: DataFrame, output_dir: str, quality: int = 95) -> DataFrame:
    """Write repaired variants; -> ``(rel_path, fixed_path, method, error)``. Variants keep the original's time stamp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, rel, variant in zip(batch["path"], batch["rel_path"], batch["variant"]):
                target = f"{output_dir}/{variant}"
                try:
                    with open(path, "rb") as f:
                        data, how = repair(f.read(), quality)
                    stamp = os.stat(path).st_mtime
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    part = f"{target}.{os.getpid()}.part"
                    with open(part, "wb") as f:
                        f.write(data)
                    os.utime(part, (stamp, stamp))
                    os.replace(part, target)
                    out.append((rel, target, how, None))
                except Exception as e:  # whatever the decoder raises is this image's error
                    out.append((rel, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["rel_path", "fixed_path", "method", "error"])

    return images.select("path", "rel_path", fixed_variant(F.col("rel_path")).alias("variant")).mapInPandas(run, "rel_path string, fixed_path string, method string, error string")
