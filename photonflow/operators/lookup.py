"""Filters and lookups between the media listing and the tables that earlier runs wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photonflow.functions.paths import fixed_variant
from photonflow.functions.text import stripped_or_null

#: What each pipeline appends to the relative path for results and errors.
SUFFIXES = {
    "describe": (".txt", ".error.txt"),
    "enhance": (".enhanced.txt", ".enhanced.error.txt"),
    "geolocate": (".geocode.txt", ".geocode.error.txt"),
    "shortcut": (".lnk", ".lnk.error.txt"),
    "fix-jpeg": (".fixed", ".fixed.error.txt"),
}


def pending(images: DataFrame, done: DataFrame, failed: DataFrame, retry: bool = False, retry_failed: bool = False, compat: bool = False) -> DataFrame:
    """Images without a result and without an error, by ``rel_path``.

    ``retry`` does everything again; ``retry_failed`` does failed items again. In ``compat`` errors are
    looked for under a name that nothing writes, so failed items are always done again.
    """
    out = images
    if not retry:
        out = out.join(done.select("rel_path").distinct(), "rel_path", "left_anti")
        if not (retry_failed or compat):
            out = out.join(failed.select("rel_path").distinct(), "rel_path", "left_anti")
    return out


def skip_reason(has_output: Column, has_error: Column, retry: bool, retry_failed: bool) -> Column:
    """``done``, ``failed`` or null for items to process."""
    none = F.lit(None).cast("string")
    if retry:
        return none
    failed = none if retry_failed else F.when(has_error, "failed")
    return F.when(has_output, F.lit("done")).otherwise(failed)


def with_text(images: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """Adds the stripped ``text`` of ``texts(rel_path, text)`` as ``name``; missing and blank are null."""
    return images.join(texts.select("rel_path", stripped_or_null(F.col("text")).alias(name)), "rel_path", "left")


def with_preferred(images: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds ``preferred``: the repaired variant's path where the listing has one, else the own path."""
    fixed = listing.select(F.col("rel_path").alias("_fixed"), F.col("path").alias("_fixed_path"))
    met = images.withColumn("_variant", fixed_variant(F.col("rel_path"))).join(fixed, F.col("_variant") == F.col("_fixed"), "left")
    return met.withColumn("preferred", F.coalesce("_fixed_path", "path")).drop("_variant", "_fixed", "_fixed_path")


def without_fixed(images: DataFrame, compat: bool = False) -> DataFrame:
    """Repaired variants are not images of their own, except in ``compat``."""
    return images if compat else images.where(~F.lower("base").endswith(".fixed"))


def with_error(images: DataFrame, errors: DataFrame, signature: str) -> DataFrame:
    """Images whose error text contains ``signature``."""
    return images.join(errors.where(F.col("error").contains(signature)).select("rel_path"), "rel_path", "left_semi")


def split_outcomes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, ``rel_path`` and ``error`` of what failed)."""
    return rows.where("error is null"), rows.where("error is not null").select("rel_path", "error")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that it does not replace."""
    return old.join(new.select("rel_path"), "rel_path", "left_anti").unionByName(new)
