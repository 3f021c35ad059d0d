"""The five pipelines, as compositions of operators over a store of result tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photonflow.config import PipelineConfig
from photonflow.functions.geo import written_address
from photonflow.functions.stats import DONE, FAILED, REJECTED
from photonflow.operators import context, infer, lookup, metadata, prompt, repair
from photonflow.operators.journal import Journal, Watch
from photonflow.operators.links import Linker, links, write_links
from photonflow.operators.sink import Store, write_sidecars
from photonflow.operators.tables import stable
from photonflow.plans.graph import Pipeline, Stage
from photonflow.schema import ERRORS, HEADS, OUTPUT
from photonflow.services.geocoder import FakeGeocoder, Geocoder
from photonflow.services.model import FakeModel, ModelClient
from photonflow.sources.image_tree import images_and_errors, read_tree


@dataclass
class Services:
    """Factories of clients; each partition makes its own."""

    vision: Callable[[], ModelClient] = FakeModel
    text: Callable[[], ModelClient] = FakeModel
    geocoder: Callable[[], Geocoder] = FakeGeocoder
    #: Writes shortcuts; without one they are a table.
    linker: Callable[[], Linker] | None = None


@dataclass
class Run:
    """What a pipeline works with: the listing, the configuration, the store and the services."""

    spark: SparkSession
    config: PipelineConfig
    store: Store
    services: Services
    listing: DataFrame
    sidecars: bool = False
    watch: Watch = field(default_factory=Watch)

    def journal(self, name: str) -> str:
        """Where the answers of a stage are until its results are stored."""
        return f"{self.store.root}/journal/{name}"

    def todo(self, name: str, images: DataFrame) -> DataFrame:
        c = self.config
        return lookup.pending(images, self.store.read(name), self.store.read(f"{name}_errors", ERRORS), c.retry, c.retry_failed, c.compat)

    def finish(self, name: str, rows: DataFrame, cleared: dict[str, DataFrame] | None = None) -> DataFrame:
        """Store ``rows(rel_path, text, error)`` once, results and errors in one commit; ``cleared``: errors of other stages that go with it. -> outcome of each."""
        rows = stable(rows.select("rel_path", "text", "error"), name)
        good, bad = lookup.split_outcomes(rows)
        others = {f"{stage}_errors": (None, keys, ERRORS) for stage, keys in (cleared or {}).items()}
        self.store.commit({name: (good, None, OUTPUT), f"{name}_errors": (bad, good, ERRORS)} | others)
        Journal(self.spark, self.journal(name)).clear()
        if self.sidecars and self.config.output_dir:
            stable(write_sidecars(rows, self.config.output_dir, *lookup.SUFFIXES[name]), "sidecars").where("problem is not null").count()
        return rows.select("rel_path", F.when(F.col("error").isNull(), DONE).otherwise(FAILED).alias("outcome"), F.lit(1).alias("output_count"))

    def images(self) -> DataFrame:
        """Images with the path that is to be read: the repaired variant's, if there is one."""
        fixed = self.store.read("fix-jpeg").select("rel_path", F.col("text").alias("_fixed"))
        return lookup.without_fixed(self.listing, self.config.compat).join(fixed, "rel_path", "left").withColumn("preferred", F.coalesce("_fixed", "path")).drop("_fixed")

    def heads(self, images: DataFrame) -> DataFrame:
        """What the files' heads say; only files that are new or changed since a run before are opened."""
        new = stable(metadata.read_heads(metadata.unread(images, self.store.read("heads", HEADS))), "heads")
        if not new.isEmpty():
            self.store.put("heads", new, HEADS)
        return self.store.read("heads", HEADS)

    def told(self, images: DataFrame, geocodes: DataFrame | None = None) -> DataFrame:
        return metadata.with_metadata(images, self.heads(images), geocodes)

    def geocodes(self) -> DataFrame:
        return self.store.read("geolocate")


def describe(run: Run, todo: DataFrame) -> DataFrame:
    """Images -> metadata -> prompt -> vision model -> description text."""
    c = run.config
    rows = run.told(todo, run.geocodes())
    m = lambda name: F.col(f"metadata.{name}")
    asked = rows.select("rel_path", "dir", "depth", "name", "metadata", "preferred", prompt.describe_prompt(c.prompt, m("datetime"), m("location_str"), m("camera"), m("filename"), c.compat).alias("prompt"))
    asked = stable(asked, "asked")  # it is read twice, and reads every image's head
    answered = infer.ask_model(asked, run.services.vision, c.model, c.model_partitions, image="preferred", clean=False, order=c.sort_order, journal=run.journal("describe"), in_flight=c.in_flight, watch=run.watch)
    keep_debug(run, "describe", answered)
    text = prompt.output_text(c.output_format, F.col("content"), m("datetime"), m("location_str"), m("camera"), m("filename"))
    return run.finish("describe", answered.withColumn("text", text))


def keep_debug(run: Run, name: str, answered: DataFrame) -> None:
    """With ``debug``, prompts and raw replies as tables."""
    if run.config.debug:
        both = stable(answered.select("rel_path", "prompt", "raw_output"), "debug")
        tables = {f"{name}_input": (both.select("rel_path", F.col("prompt").alias("text")), None, OUTPUT), f"{name}_output": (both.select("rel_path", F.col("raw_output").alias("text")), None, OUTPUT)}
        run.store.commit(tables)


def enhance(run: Run, todo: DataFrame) -> DataFrame:
    """Images with a description -> nearest items' descriptions as context -> text model -> better description.

    Images without a description are rejected and asked again when they have one.
    """
    c = run.config
    known = lookup.with_text(run.images(), run.store.read("describe"), "description")
    told = stable(run.told(known, run.geocodes()), "metadata")
    items = told.select("rel_path", "description", F.col("metadata.datetime_min").alias("datetime_min"), F.col("metadata.datetime_max").alias("datetime_max"))
    todo = stable(told.join(todo.select("rel_path"), "rel_path", "left_semi"), "todo")
    near = context.nearest(items, c.max_context_items, c.context_window_days, todo.where("description is not null"), walk=c.compat)
    arrays = context.context_arrays(near, items.select("rel_path", "description"), c.compat)
    rows = todo.where("description is not null").join(arrays, "rel_path", "left")
    texts = F.transform(F.coalesce("context", F.array().cast("array<struct<place:int,item:string,score_min:double,score_max:double,description:string>>")), lambda x: x["description"])
    section = context.context_section(texts, c.context_template, c.context_item_template, c.max_context_in_prompt, c.context_item_max_length, c.max_context_length, c.compat)
    asked = rows.select("rel_path", "dir", "depth", "name", "metadata", prompt.enhance_prompt(c.enhance_prompt, section, F.col("description")).alias("prompt"))
    answered = stable(infer.ask_model(asked, run.services.text, c.enhance_model, c.model_partitions, context_length=c.model_context_length, order=c.sort_order, journal=run.journal("enhance"), in_flight=c.in_flight, watch=run.watch), "enhanced")
    keep_debug(run, "enhance", answered)
    m = lambda name: F.lit(None).cast("string") if c.compat else F.col(f"metadata.{name}")
    moment = F.lit(None).cast("timestamp_ntz") if c.compat else F.col("metadata.datetime")
    text = prompt.output_text(c.enhance_output_format, F.col("content"), moment, m("location_str"), m("camera"), m("filename"))
    rejected = stable(todo.where("description is null").select("rel_path", F.lit(REJECTED).alias("outcome"), F.lit(0).alias("output_count")), "rejected")
    return run.finish("enhance", answered.withColumn("text", text)).unionAll(rejected)


def geolocate(run: Run, todo: DataFrame) -> DataFrame:
    """Images -> coordinates -> address; an image without coordinates or address gets the mark for none."""
    c = run.config
    rows = stable(run.told(todo), "metadata")
    found = infer.geocode(rows, run.services.geocoder, c.geocode_partitions, c.geocode_attempts, c.geocode_wait, run.journal("geolocate"), c.in_flight, run.watch)
    return run.finish("geolocate", found.withColumn("text", written_address(F.col("address"))))


def shortcut(run: Run, todo: DataFrame) -> DataFrame:
    """A shortcut to each image, as a row, and as a file where there is a writer of such files."""
    rows = links(todo, run.config.output_dir or run.config.input_dir)
    written = write_links(rows, run.services.linker) if run.services.linker else rows.withColumn("error", F.lit(None).cast("string"))
    return run.finish("shortcut", written.select("rel_path", F.col("link_path").alias("text"), "error"))


def fix_jpeg(run: Run, todo: DataFrame) -> DataFrame:
    """Repair images that describing refused; their error goes, so that they are described again. Others are rejected."""
    broken = repair.repairable(todo, run.store.read("describe_errors", ERRORS))
    fixed = stable(repair.repair_images(broken, run.config.output_dir or run.config.input_dir, run.config.jpeg_quality), "repaired")
    others = todo.join(fixed.select("rel_path"), "rel_path", "left_anti").select("rel_path", F.lit(REJECTED), F.lit(0))
    rejected = stable(others.toDF("rel_path", "outcome", "output_count"), "rejected")
    return run.finish("fix-jpeg", fixed.withColumn("text", F.col("fixed_path")), {"describe": fixed.where("error is null")}).unionAll(rejected)


def discover(run: Run, listing: DataFrame) -> DataFrame:
    return run.images()


def skip(name: str) -> Callable[[Run, DataFrame], DataFrame]:
    """Leaves out what has a result or an error."""
    return lambda run, rows: run.todo(name, rows)


def chain(name: str, work: Callable[[Run, DataFrame], DataFrame]) -> Pipeline:
    return Pipeline(Stage("discover", discover), Stage("skip", skip(name), ("discover",)), Stage(name, work, ("skip",)))


PIPELINES: dict[str, tuple[str, Pipeline]] = {
    "describe": ("scan, skip, metadata, vision model, write", chain("describe", describe)),
    "enhance": ("scan, skip, context, text model, write", chain("enhance", enhance)),
    "geolocate": ("scan, skip, reverse geocoding, write", chain("geolocate", geolocate)),
    "shortcut": ("scan, skip, links", chain("shortcut", shortcut)),
    "fix-jpeg": ("scan, skip, repair", chain("fix-jpeg", fix_jpeg)),
}
#: What a pipeline looks for besides the configured extensions.
ALSO = {"shortcut": (".lnk",)}


def register_pipeline(name: str, text: str, pipeline: Pipeline) -> None:
    """Make a pipeline known by name; its stages must be in order."""
    pipeline.order()
    PIPELINES[name] = (text, pipeline)


def list_pipelines() -> dict[str, str]:
    return {k: text for k, (text, _) in PIPELINES.items()}


def get_pipeline(name: str) -> Pipeline:
    if name not in PIPELINES:
        raise ValueError(f"unknown pipeline {name!r}; known: {', '.join(PIPELINES)}")
    return PIPELINES[name][1]


def run_pipeline(spark: SparkSession, name: str, config: PipelineConfig, store: str, services: Services | None = None, listing: DataFrame | None = None, sidecars: bool = False, watch: Watch | None = None) -> str:
    """Run a pipeline over ``config.input_dir`` (or a given listing) and tell the counters of its last stage as a line.

    ``watch`` says status lines on the way, at the end one of all stages, and can stop the run: what was answered by then is stored, and the
    next run asks for the rest.
    """
    pipeline = get_pipeline(name)
    watch = watch or Watch(config.status_interval, config.verbose)
    tables = Store(spark, store)
    if listing is None:
        listing, problems = images_and_errors(stable(read_tree(spark, config.input_dir, (*config.extensions, *ALSO.get(name, ()))), "listing"))
        tables.put("scan_errors", problems, ERRORS)
    lines = pipeline.run(Run(spark, config, tables, services or Services(), listing, sidecars, watch), listing)
    if watch.interval:
        watch.say(f"[{datetime.now():%Y-%m-%d %H:%M:%S}] " + " | ".join(f"{k}: {v}" for k, v in lines.items()))
    return f"{name}: {lines[pipeline.order()[-1].name]}"
