"""Capture times: from paths, from tags, for display, and their distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from photonflow.functions.paths import basename

#: Fixed patterns of dates in names, in the order in which they are tried.
EXACT = r"([0-9]{4})([0-9]{2})([0-9]{2})[_\-]?([0-2][0-9])([0-5][0-9])([0-5][0-9])"
DELIMITED_DAY = r"[\-_/]([1-2][0-9]{3})([0-1][0-9])([0-3][0-9])[\-_/]"
LEADING_DAY = r"^([1-2][0-9]{3})([0-1][0-9])([0-3][0-9])"
DASHED_DAY = r"^([1-2][0-9]{3})-([0-1][0-9])-([0-3][0-9])"


#: Either of the two that a folder may begin with; no name matches both.
FOLDER_DAY = f"{LEADING_DAY}|{DASHED_DAY}"


def _moment(text: Column, pattern: str) -> Column:
    """The first match as a time, at midnight without a clock; null without a match or where the calendar has no such day."""
    digits = F.translate(F.regexp_extract(text, pattern, 0), "-_/", "")
    part = lambda at, n: F.substring(digits, at, n).try_cast("int")
    h, m, s = (part(9, 2), part(11, 2), part(13, 2)) if pattern == EXACT else (F.lit(0),) * 3
    made = F.try_make_timestamp_ntz(part(1, 4), part(5, 2), part(7, 2), h, m, s.cast("decimal(8,6)"))
    return F.when(digits >= "0001", made)


def path_datetime(path: Column) -> Column:
    """``struct(min, max)`` of the time that a path tells, or null.

    The file name goes first: an exact time anywhere, a delimited day, a leading day. Then the
    directories from the deepest up: a leading day, packed or with dashes. A match that is no
    calendar date makes room for the next rule.
    """
    name, parts = basename(path), F.split(path, "/")
    folders = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    walked = F.get(F.filter(F.transform(folders, lambda d: _moment(d, FOLDER_DAY)), lambda x: x.isNotNull()), F.lit(0))
    exact = F.when(name.rlike("[0-9]{8}"), _moment(name, EXACT))
    day = F.coalesce(F.when(name.rlike("[0-9]{8}"), F.coalesce(_moment(name, DELIMITED_DAY), _moment(name, LEADING_DAY))), walked)
    # an array of one, so that what is found is not looked for again at each use
    found = F.array(F.struct(exact.alias("exact"), F.when(exact.isNull(), day).alias("day")))
    end = lambda f: F.coalesce(f["exact"], f["day"] + F.expr("INTERVAL '23:59:59' HOUR TO SECOND"))
    ends = F.transform(found, lambda f: F.when(F.coalesce(f["exact"], f["day"]).isNotNull(), F.struct(F.coalesce(f["exact"], f["day"]).alias("min"), end(f).alias("max"))))
    return F.get(ends, F.lit(0))


def tag_datetime(*tags: Column) -> Column:
    """The first of the tag texts that is a time, ``yyyy:MM:dd HH:mm:ss``."""
    return F.coalesce(*(F.try_to_timestamp(t, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz") for t in tags))


def display(moment: Column) -> Column:
    """Date and time; the date alone at midnight; null for null."""
    midnight = (F.hour(moment) == 0) & (F.minute(moment) == 0) & (F.second(moment) == 0)
    return F.when(midnight, F.date_format(moment, "yyyy-MM-dd")).otherwise(F.date_format(moment, "yyyy-MM-dd HH:mm:ss"))


def distance_seconds(a: Column, b: Column) -> Column:
    return F.abs(F.timestamp_diff("SECOND", a, b))


def proximity(target_min: Column, target_max: Column, item_min: Column, item_max: Column) -> Column:
    """``struct(score_min, score_max)``: seconds between the ranges' ends; infinite where a time is unknown."""
    known = target_min.isNotNull() & item_min.isNotNull()
    far = F.lit(float("inf"))
    near = F.when(known, distance_seconds(target_max, item_min).cast("double")).otherwise(far)
    wide = F.when(known, distance_seconds(target_min, item_max).cast("double")).otherwise(far)
    return F.struct(near.alias("score_min"), wide.alias("score_max"))
