"""Prompts and output texts from templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photonflow.functions.datetimes import display
from photonflow.functions.template import fill, fill_output
from photonflow.functions.text import or_unknown


def describe_prompt(template: str, moment: Column, location: Column, camera: Column, filename: Column, compat: bool = False) -> Column:
    """The prompt for an image. What is unknown is empty; in ``compat`` unknown place and camera read ``None``."""
    shown = (lambda c: F.coalesce(c, F.lit("None"))) if compat else (lambda c: c)
    return fill(template, {"datetime": display(moment), "location": shown(location), "camera": shown(camera), "filename": filename})


def enhance_prompt(template: str, section: Column, original: Column) -> Column:
    return fill(template, {"context_section": section, "original_description": original})


def output_text(template: str, content: Column, moment: Column, location: Column, camera: Column, filename: Column) -> Column:
    """The text that is stored; unknown time, place and camera read ``Unknown``."""
    return fill_output(template, {"datetime": or_unknown(display(moment)), "location": or_unknown(location), "camera": or_unknown(camera), "filename": filename, "content": content})
