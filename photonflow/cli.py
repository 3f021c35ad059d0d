"""Command line: ``python -m photonflow.cli describe INPUT OUTPUT``."""

from __future__ import annotations

import argparse
import os
from functools import partial

from pyspark.sql import SparkSession

from photonflow.config import load_config
from photonflow.functions.naturalsort import ORDERS
from photonflow.operators.links import Symlinks
from photonflow.plans.pipelines import Services, list_pipelines, run_pipeline
from photonflow.services.geocoder import FakeGeocoder
from photonflow.services.http import HttpGeocoder, HttpModel
from photonflow.services.model import backend


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="photonflow", description="Resumable enrichment of media trees", epilog="; ".join(f"{k}: {v}" for k, v in list_pipelines().items()))
    p.add_argument("pipeline", choices=list(list_pipelines()))
    p.add_argument("input_dir", nargs="?")
    p.add_argument("output_dir", nargs="?")
    p.add_argument("--input-dir", dest="input_flag")
    p.add_argument("--output-dir", dest="output_flag")
    p.add_argument("--config", help="TOML file with defaults")
    p.add_argument("--store", help="folder of the result tables; by default in the output folder")
    p.add_argument("--backend", default="fake", help="client of the model: http, or one that is registered")
    p.add_argument("--url", help="server of the model, for --backend http; its key is read from MODEL_API_KEY")
    p.add_argument("--uploads", action="store_true", help="send each image once, by its digest")
    p.add_argument("--geocoder", choices=["fake", "http"], default="fake")
    p.add_argument("--geocoder-url")
    p.add_argument("--per-second", type=float, help="requests a second of the whole run")
    p.add_argument("--links", action="store_true", help="write shortcuts as symbolic links")
    p.add_argument("--status-interval", type=float, help="seconds between status lines, 5 by default; 0 for none")
    p.add_argument("--model")
    p.add_argument("--prompt", help="template, or @file")
    p.add_argument("--prompt-file")
    p.add_argument("--sort-order", choices=ORDERS)
    p.add_argument("--retry", action="store_true", help="do everything again")
    p.add_argument("--retry-failed", action="store_true", help="do failed items again")
    p.add_argument("--sidecars", action="store_true", help="write text files as well as tables")
    p.add_argument("--debug", action="store_true", help="keep prompts and raw replies")
    p.add_argument("--compat", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    a = parser().parse_args(argv)
    env = os.environ.get
    prompt = f"@{a.prompt_file}" if a.prompt_file else a.prompt or env("PROMPT")
    model = a.model or env("MODEL_NAME")
    models = {"enhance_model": model, "enhance_prompt": prompt} if a.pipeline == "enhance" else {"model": model, "prompt": prompt}
    flags = {k: True for k in ("retry", "retry_failed", "debug", "compat", "verbose") if getattr(a, k)}
    if env("RETRY_FAILED", "").lower() in ("1", "true", "yes"):
        flags["retry_failed"] = True
    source, target = a.input_flag or a.input_dir or env("INPUT_DIR"), a.output_flag or a.output_dir or env("OUTPUT_DIR")
    config = load_config(a.config, input_dir=source, output_dir=target, sort_order=a.sort_order or env("SORT_ORDER"), status_interval=a.status_interval, **models, **flags)
    if config.status_interval is None:
        config = config.with_options(status_interval=5.0)
    if not config.input_dir:
        parser().error("an input folder is needed")
    config = config.with_options(output_dir=config.output_dir or config.input_dir)
    spark = spark or SparkSession.builder.appName("photonflow").getOrCreate()
    share = lambda clients: a.per_second / clients if a.per_second else None
    places = FakeGeocoder
    if a.backend == "http":
        factory = partial(HttpModel, a.url or parser().error("--backend http needs --url"), env("MODEL_API_KEY"), per_second=share(config.model_partitions), uploads=a.uploads)
    else:
        factory = backend(a.backend)
    if a.geocoder == "http":
        places = partial(HttpGeocoder, a.geocoder_url or parser().error("--geocoder http needs --geocoder-url"), per_second=share(config.geocode_partitions) or 1.0)
    services = Services(factory, factory, places, Symlinks if a.links else None)
    line = run_pipeline(spark, a.pipeline, config, a.store or f"file://{config.output_dir}/.photonflow", services, sidecars=a.sidecars)
    print(line)
    return line


if __name__ == "__main__":
    main()
