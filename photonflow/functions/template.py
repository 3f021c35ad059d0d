"""Named placeholders, compiled once to a concatenation of columns.

Values are never searched for placeholders, as they would be by replacing in turn.
"""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """A template that cannot be filled at all: positional or attribute fields, bad braces."""


def fields(template: str) -> list[tuple[str, str | None]]:
    """(text, field) pairs; raises TemplateError where the template is not plain."""
    try:
        parsed = [(text, field, spec, conv) for text, field, spec, conv in Formatter().parse(template)]
    except ValueError as e:
        raise TemplateError(str(e)) from e
    for _, field, spec, conv in parsed:
        if field is not None and (not field.isidentifier() or spec or conv):
            raise TemplateError(f"not a plain named placeholder: {{{field}}}")
    return [(text, field) for text, field, _, _ in parsed]


def fill(template: str, values: dict[str, Column]) -> Column:
    """The filled template; the template itself, verbatim, if it asks for a name that is not given. Null values are empty."""
    try:
        parts = fields(template)
    except TemplateError:
        return F.lit(template)
    if any(f is not None and f not in values for _, f in parts):
        return F.lit(template)
    return _concat(parts, values)


def fill_output(template: str, values: dict[str, Column]) -> Column:
    """As ``fill``, but an unknown name leaves ``content`` alone instead of the template."""
    parts = fields(template)
    if any(f is not None and f not in values for _, f in parts):
        return F.coalesce(values["content"], F.lit(""))
    return _concat(parts, values)


def _concat(parts: list[tuple[str, str | None]], values: dict[str, Column]) -> Column:
    columns = []
    for text, field in parts:
        if text:
            columns.append(F.lit(text))
        if field is not None:
            columns.append(F.coalesce(values[field].cast("string"), F.lit("")))
    return F.concat(*columns) if columns else F.lit("")
