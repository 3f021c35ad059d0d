"""Calls of services from partitions: a client is opened once for each, and a failed row is a row with an error.

Answers are written to a journal as they come, and read from it: nothing is asked twice, and what a stopped run was told is kept.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photonflow.functions.geo import decoded_place, full_address
from photonflow.functions.text import clean_reply
from photonflow.operators.journal import Client, Journal, Watch, ask, followed
from photonflow.operators.ordering import in_order
from photonflow.operators.tables import shared_path
from photonflow.services.geocoder import Geocoder, with_retries
from photonflow.services.model import ModelClient

REPLIES = pa.schema([("rel_path", pa.string()), ("asked", pa.int64()), ("raw_output", pa.string()), ("error", pa.string())])
PARTS = pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))
PLACES = pa.schema([("lat", pa.float64()), ("lon", pa.float64()), ("line", pa.string()), ("parts", PARTS), ("reply", pa.string()), ("error", pa.string())])
_PARTS = "array<struct<key:string,value:string>>"


def ask_model(rows: DataFrame, factory: Callable[[], ModelClient], model: str, partitions: int, image: str | None = None, clean: bool = True, context_length: int | None = None, order: str | None = None, journal: str | None = None, in_flight: int = 1, watch: Watch | None = None) -> DataFrame:
    """``rows`` with ``raw_output``, ``content`` and ``error``, asked once for each row's ``prompt`` and image path.

    ``partitions`` caps how many clients are open, ``in_flight`` how many requests each has open. An empty reply is an error. ``order`` is that in which each
    client is asked, by the rows' ``dir``, ``depth`` and ``name``; without it rows are dealt out evenly. ``journal`` is the folder that
    keeps answers; those that are there to the same prompt are taken. Of a run that ``watch`` stops, only the rows that were answered come back.
    """
    spark, keep = rows.sparkSession, rows.columns
    kept = Journal(spark, journal or shared_path(spark, "answers"))

    def opened() -> Client:
        client = factory()
        client.open(model, context_length)
        return (lambda row: (row["rel_path"], row["asked"], *_reply(client, row["prompt"], row[image] if image else None))), client.close

    keyed = rows.withColumn("asked", F.xxhash64(F.lit(model), "prompt", *([image] if image else [])))
    schema = "rel_path string, asked long, raw_output string, error string"
    before = kept.read(schema).select("rel_path", "asked")
    needed = ["rel_path", "asked", "prompt", *([image] if image else [])]
    todo = keyed.select(*needed, *(["dir", "depth", "name"] if order else [])).join(before, ["rel_path", "asked"], "left_anti")
    dealt = in_order(todo, order, partitions).select(*needed) if order else todo.repartition(partitions)
    with followed(spark, "model", kept, watch or Watch(), lambda r: f"{r['rel_path']} \u2192 {r['error'] or (r['raw_output'] or '')[:80]}"):
        ask(dealt, kept, REPLIES, ["rel_path", "asked"], opened, in_flight)
    answers = kept.read(schema).dropDuplicates(["rel_path", "asked"])
    content = clean_reply(F.col("raw_output")) if clean else F.col("raw_output")
    return keyed.join(answers, ["rel_path", "asked"]).select(*keep, "raw_output", "error").withColumn("content", content)


def _reply(client: ModelClient, prompt: str, image: str | None) -> tuple[str | None, str | None]:
    try:
        data = None
        if image:
            fs, path = pyarrow.fs.FileSystem.from_uri(image)
            with fs.open_input_file(path) as f:
                data = f.read()
        out = client.respond(prompt, data)
        return (out, None) if out else (None, "empty response")
    except Exception as e:  # whatever a client raises is this row's error
        return None, f"{type(e).__name__}: {e}"


def geocode(rows: DataFrame, factory: Callable[[], Geocoder], partitions: int = 1, attempts: int = 5, wait: float = 1.0, journal: str | None = None, in_flight: int = 1, watch: Watch | None = None) -> DataFrame:
    """``rows`` with ``address`` and ``error``; each pair of coordinates is asked once. Of a run that ``watch`` stops, rows whose place was not asked are left out."""
    spark = rows.sparkSession
    kept = Journal(spark, journal or shared_path(spark, "places"))

    def opened() -> Client:
        client = factory()

        def call(row: dict) -> tuple:
            lat, lon = row["lat"], row["lon"]
            try:
                found = with_retries(lambda: client.reverse(lat, lon), attempts, wait)
                if isinstance(found, str):
                    return lat, lon, None, None, found, None
                line, parts = found or (None, None)
                return lat, lon, line, None if parts is None else [{"key": k, "value": v} for k, v in parts], None, None
            except Exception as e:  # whatever a client raises is this place's error
                return lat, lon, None, None, None, f"{type(e).__name__}: {e}"

        return call, getattr(client, "close", lambda: None)

    lat, lon = F.col("metadata.location.lat"), F.col("metadata.location.lon")
    schema = f"lat double, lon double, line string, parts {_PARTS}, reply string, error string"
    places = rows.select(lat.alias("lat"), lon.alias("lon")).where("lat is not null and lon is not null").dropDuplicates()
    todo = places.join(kept.read(schema).select("lat", "lon"), ["lat", "lon"], "left_anti")
    with followed(spark, "geocoder", kept, watch or Watch(), lambda r: f"{r['lat']}, {r['lon']} \u2192 {r['error'] or r['line'] or r['reply'] or 'N/A'}"):
        ask(todo.repartition(partitions), kept, PLACES, ["lat", "lon"], opened, in_flight)
    answers = kept.read(schema).dropDuplicates(["lat", "lon"]).withColumn("place", decoded_place(F.col("reply")))
    either = lambda a, b: F.coalesce(F.col(a), F.col(b))
    named = answers.select("lat", "lon", full_address(either("line", "place.line"), F.coalesce("parts", "place.parts", F.array().cast(_PARTS))).alias("address"), "error", F.lit(True).alias("known"))
    met = rows.join(named, (lat == F.col("lat")) & (lon == F.col("lon")), "left")
    return met.where(F.col("known") | lat.isNull() | lon.isNull()).drop("lat", "lon", "known")
