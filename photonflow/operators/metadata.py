"""Capture metadata of images: tags first, then what the path tells."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonflow.functions.datetimes import path_datetime
from photonflow.functions.geo import location_string
from photonflow.media.exif import read_exif
from photonflow.schema import EXIF

#: Bytes read from the head of a file; the metadata segments stand before the picture.
HEAD = 1 << 20


def _read(path: str) -> dict | None:
    try:
        fs, at = pyarrow.fs.FileSystem.from_uri(path)
        with fs.open_input_file(at) as f:
            return read_exif(f.read(HEAD))
    except OSError:
        return None


@F.pandas_udf(EXIF)
def exif_of_path(paths: pd.Series) -> pd.DataFrame:
    return _frame(_read(p) if p else None for p in paths)


@F.pandas_udf(EXIF)
def exif_of_bytes(contents: pd.Series) -> pd.DataFrame:
    return _frame(read_exif(b) if b else None for b in contents)


def _frame(found: Iterator[dict | None]) -> pd.DataFrame:
    names = EXIF.fieldNames()
    rows = [[(x or {}).get(n) for n in names] for x in found]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    out["datetime"] = pd.to_datetime(out["datetime"])
    place = [v if v else (None, None) for v in out.pop("location")]
    out.insert(1, "location", [{"lat": a, "lon": b} for a, b in place])
    return out


def unread(images: DataFrame, heads: DataFrame) -> DataFrame:
    """Images whose file at ``preferred``, by size and time, is not that of ``heads`` (schema HEADS)."""
    known = heads.select("rel_path", F.col("source").alias("preferred"), "size", "mtime")
    return images.join(known, ["rel_path", "preferred", "size", "mtime"], "left_anti")


def read_heads(images: DataFrame) -> DataFrame:
    """``images`` as rows of HEADS; opens each file."""
    return images.select("rel_path", F.col("preferred").alias("source"), "size", "mtime", exif_of_path(F.col("preferred")).alias("exif"))


def with_metadata(images: DataFrame, heads: DataFrame, geocodes: DataFrame | None = None) -> DataFrame:
    """Adds ``metadata`` (schema METADATA) from ``heads`` (schema HEADS) and from ``path``.

    A place is told only with coordinates; a geocode of none leaves the coordinates alone.
    """
    rows = images.join(heads.select("rel_path", F.col("exif").alias("_exif")), "rel_path", "left").withColumn("_range", path_datetime(F.col("path")))
    if geocodes is None:
        rows = rows.withColumn("_address", F.lit(None).cast("string"))
    else:
        rows = rows.join(geocodes.select("rel_path", F.col("text").alias("_address")), "rel_path", "left")
    e = lambda name: F.col(f"_exif.{name}")
    tagged = e("datetime").isNotNull()
    low, high = F.coalesce(e("datetime"), F.col("_range.min")), F.when(tagged, e("datetime")).otherwise(F.col("_range.max"))
    meta = F.struct(
        low.alias("datetime"), low.alias("datetime_min"), high.alias("datetime_max"), F.when(tagged, "exif").when(low.isNotNull(), "filename_or_path").alias("datetime_source"),
        F.when(e("location.lat").isNotNull(), e("location")).alias("location"), location_string(e("coordinates"), F.col("_address")).alias("location_str"), F.lit(None).cast("string").alias("location_error"),
        e("camera").alias("camera"), e("focal_length").alias("focal_length"), e("aperture").alias("aperture"), e("iso").alias("iso"), e("shutter_speed").alias("shutter_speed"), F.col("name").alias("filename"),
    )
    return rows.withColumn("metadata", meta).drop("_exif", "_range", "_address")
