"""Natural order: runs of digits compare as numbers, the rest without case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORDERS = ("natural-asc", "natural-desc", "name-asc", "name-desc")


def natural_key(text: Column) -> Column:
    """An array of (text, number) pairs that orders as the parts between and within runs of digits do."""
    runs = F.regexp_extract_all(text, F.lit(r"(\D*)(\d+|$)"), 0)
    return F.transform(runs, lambda r: F.struct(F.lower(F.regexp_extract(r, r"^(\D*)", 1)).alias("s"), F.coalesce(F.regexp_extract(r, r"(\d+)$", 1).try_cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)")).alias("n")))


def order_key(text: Column, order: str) -> Column:
    """Sort expression for one of ORDERS; any other name sorts by lower-cased name, ascending."""
    key = natural_key(text) if order.startswith("natural") else F.lower(text)
    return key.desc() if order.endswith("desc") else key.asc()


def directory_order(path: Column, depth: Column, order: str) -> list[Column]:
    """Deepest first, then natural; a descending order turns numbers round but not text."""
    key = natural_key(path)
    if order.endswith("desc"):
        key = F.transform(key, lambda k: F.struct(k["s"].alias("s"), (-k["n"]).alias("n")))
    return [depth.desc(), key.asc()]
