"""Path functions over columns; separators are ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """Everything before the last separator; the root stays, and a bare name has none."""
    return F.when(path.rlike(r"^/+[^/]*$"), F.lit("/")).otherwise(F.regexp_extract(path, r"^(.*?)/+[^/]*$", 1))


def extension(name: Column) -> Column:
    """The last suffix of a file name with its dot; leading dots begin no suffix."""
    return F.regexp_extract(name, r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(name: Column) -> Column:
    return name.substr(F.lit(1), F.length(name) - F.length(extension(name)))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def has_extension(name: Column, extensions: tuple[str, ...]) -> Column:
    """By the suffix proper, in any case: ``.jpg`` alone has none."""
    return F.lower(extension(name)).isin(*extensions)


def ends_with_extension(name: Column, extensions: tuple[str, ...]) -> Column:
    """By the end of the name, in any case: ``.jpg`` alone counts."""
    out = F.lit(False)
    for e in extensions:
        out = out | F.lower(name).endswith(e)
    return out


def relative(path: Column, root: str) -> Column:
    """The path below ``root``; the base name where it is elsewhere."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), path.substr(F.lit(len(prefix) + 1), F.length(path))).otherwise(basename(path))


def output_path(output_dir: str, rel_path: Column, suffix: str) -> Column:
    return F.concat(F.lit(output_dir.rstrip("/") + "/"), rel_path, F.lit(suffix))


def fixed_variant(rel_path: Column) -> Column:
    """``a/b.jpg`` -> ``a/b.fixed.jpg``."""
    ext = extension(basename(rel_path))
    return F.concat(rel_path.substr(F.lit(1), F.length(rel_path) - F.length(ext)), F.lit(".fixed"), ext)
