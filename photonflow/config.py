"""Configuration: defaults from TOML, overridden explicitly. No environment variable is written."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields, replace
from pathlib import Path

#: The prompt and output templates, which must be as they are for equal results.
DESCRIBE_PROMPT = "Context:\nBestandsnaam: {filename}\nDatumtijd: {datetime}\nLocatie: {location}\nCamera: {camera}\n\nOpdracht: Beschrijf de foto in het Nederlands. Geef geen informatie terug over context bestandsnaam, datumtijd, locatie en camera, maar als nodig gebruik die informatie wel."
DESCRIBE_OUTPUT = "Bestandsnaam: {filename}\nDatumtijd: {datetime}\nLocatie: {location}\nCamera: {camera}\n\nBeschrijving:\n{content}"
CONTEXT_TEMPLATE = "Context van andere foto's uit dezelfde periode/locatie:\n\n{items}\n"
CONTEXT_ITEM = "{number}. {description}\n"
ENHANCE_PROMPT = "{context_section}Originele beschrijving van de huidige foto:\n{original_description}\n\nVerbeter de beschrijving van de foto door logische, aannemelijke context af te leiden uit beschrijvingen uit de context. Behoud zichtbare elementen, voeg alleen goed onderbouwde interpretaties toe en vermijd speculatie. Geef één natuurlijke, vloeiende beschrijving van de foto."
ENHANCE_OUTPUT = "Bestandsnaam: {filename}\nDatum tijd: {datetime}\nLocatie: {location}\nVerbeterde beschrijving:\n{content}"
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")


@dataclass(frozen=True)
class PipelineConfig:
    """What a pipeline needs to know. ``compat`` reproduces the original's known defects where there is a choice."""

    input_dir: str = ""
    output_dir: str = ""
    extensions: tuple[str, ...] = EXTENSIONS
    reverse_geocode: bool = False
    model: str = ""
    prompt: str = DESCRIBE_PROMPT
    output_format: str = DESCRIBE_OUTPUT
    enhance_model: str = ""
    enhance_prompt: str = ENHANCE_PROMPT
    enhance_output_format: str = ENHANCE_OUTPUT
    context_template: str = CONTEXT_TEMPLATE
    context_item_template: str = CONTEXT_ITEM
    context_item_max_length: int = 1000
    max_context_in_prompt: int = 30
    max_context_items: int = 100
    max_context_length: int | None = None
    context_window_days: int | None = None
    model_context_length: int = 16384
    sort_order: str = "natural-desc"
    retry: bool = False
    retry_failed: bool = False
    debug: bool = False
    compat: bool = False
    model_partitions: int = 8
    geocode_partitions: int = 1
    geocode_attempts: int = 5
    geocode_wait: float = 1.0
    jpeg_quality: int = 95
    in_flight: int = 1
    status_interval: float | None = None
    verbose: bool = False

    def with_options(self, **options: object) -> PipelineConfig:
        """A copy with the options that are not None; a prompt ``@file`` is read from that file."""
        known = {f.name for f in fields(self)}
        if unknown := set(options) - known:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        given = {k: v for k, v in options.items() if v is not None}
        for k in ("prompt", "enhance_prompt"):
            if isinstance(given.get(k), str) and given[k].startswith("@"):
                given[k] = Path(given[k][1:]).read_text(encoding="utf-8").strip()
        return replace(self, **given)


#: Where a TOML section and key go in the configuration.
_TOML = {
    ("directories", "input_dir"): "input_dir", ("directories", "output_dir"): "output_dir", ("image", "extensions"): "extensions", ("metadata", "reverse_geocode_gps"): "reverse_geocode",
    ("describe", "model"): "model", ("describe", "prompt"): "prompt", ("describe", "output_format"): "output_format", ("enhancement", "model"): "enhance_model", ("enhancement", "prompt"): "enhance_prompt",
    ("enhancement", "output_format"): "enhance_output_format", ("enhancement", "context_template"): "context_template", ("enhancement", "context_item_template"): "context_item_template",
    ("enhancement", "context_item_max_length"): "context_item_max_length", ("enhancement", "max_context_in_prompt"): "max_context_in_prompt", ("enhancement", "max_context_items"): "max_context_items",
    ("enhancement", "max_context_length"): "max_context_length", ("enhancement", "context_window_days"): "context_window_days", ("enhancement", "model_context_length"): "model_context_length",
    ("sorting", "order"): "sort_order", ("retry", "failed"): "retry_failed", ("threads", "llm"): "model_partitions", ("performance", "backpressure_multiplier"): "in_flight", ("ui", "status_interval"): "status_interval", ("ui", "verbose"): "verbose",
}


def load_config(path: str | Path | None = None, **options: object) -> PipelineConfig:
    """Defaults, then the TOML file, then ``options``. Unknown TOML keys are left alone."""
    values: dict[str, object] = {}
    if path:
        data = tomllib.loads(Path(path).read_text(encoding="utf-8"))
        for (section, key), name in _TOML.items():
            if key in data.get(section, {}):
                value = data[section][key]
                values[name] = tuple(value) if isinstance(value, list) else max(1, int(value)) if name == "in_flight" else value
    return PipelineConfig().with_options(**values).with_options(**options)
