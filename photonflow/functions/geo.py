"""Coordinates, places and exposure values as text."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from photonflow.functions.text import or_unknown

#: Address parts that the address line already has.
ADDRESS_KEYS = ("country_code", "country", "state", "county", "city", "town", "village", "postcode", "road", "house_number")
NO_ADDRESS = "N/A"


def decimal_degrees(d: Column, m: Column, s: Column, ref: Column) -> Column:
    """Degrees, minutes and seconds as decimal degrees, negative for S and W; null without a reference."""
    value = d + m / 60.0 + s / 3600.0
    return F.when(F.length(ref) > 0, F.when(ref.isin("S", "W"), -value).otherwise(value))


def location_string(coordinates: Column, address: Column) -> Column:
    """``lat, lon | address``, either alone where the other is missing; the mark for no address is none."""
    return F.when(coordinates.isNotNull(), F.concat_ws(" | ", coordinates, F.nullif(F.nullif(address, F.lit("")), F.lit(NO_ADDRESS))))


def points_of_interest(parts: Column) -> Column:
    """``key: value, ...`` of an array of (key, value), in order, without address keys and empty values."""
    kept = F.filter(parts, lambda p: ~p["key"].isin(*ADDRESS_KEYS) & (F.length(p["value"]) > 0))
    return F.array_join(F.transform(kept, lambda p: F.concat(p["key"], F.lit(": "), p["value"])), ", ")


def object_entries(text: Column) -> Column:
    """The entries of a JSON object as an array of (key, value) in their order; null for anything else.

    Values are the strings' texts, or the JSON text of other values; null is null. A key that is repeated stands where it was first, with what it was last.
    """
    found = F.map_entries(F.from_json(text, "map<string,string>"))
    keys = F.array_distinct(F.transform(found, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(found, lambda e: e["key"] == k), -1)["value"]
    return F.when(F.size(found) >= 0, F.transform(keys, lambda k: F.struct(k.alias("key"), last(k).alias("value"))))


#: JSON texts of values that say nothing.
EMPTY = ("false", "0", "0.0", "[]", "{}")


def decoded_place(reply: Column) -> Column:
    """``struct(line, parts)`` of a geocoder's JSON reply: its ``display_name``, and the entries of ``address`` in order; values that say nothing are empty. Null without a name."""
    line = F.get_json_object(reply, "$.display_name")
    parts = F.transform(object_entries(F.get_json_object(reply, "$.address")), lambda e: F.struct(e["key"].alias("key"), F.when(e["value"].isin(*EMPTY), "").otherwise(e["value"]).alias("value")))
    return F.when(line.isNotNull(), F.struct(line.alias("line"), parts.alias("parts")))


def fixed_point(value: Column, places: int) -> Column:
    """``value`` with ``places`` (up to 6) decimals, rounded by its exact binary value, ties to even, as in C and Python. Null from 2^63 on.

    The fraction of a double that can round up is a whole number of 2^-74: it is split in two parts of 37 bits, which are exact, and compared as a decimal.
    """
    size = F.abs(value.cast("double"))
    whole = F.floor(size).cast("long")
    part = (size - whole.cast("double")) * float(1 << 37)
    high = F.floor(part)
    low = F.floor((part - high.cast("double")) * float(1 << 37))
    ten = 10**places
    scaled = (high.cast("decimal(12,0)") * F.lit(1 << 37).cast("decimal(12,0)") + low.cast("decimal(12,0)")) * F.lit(ten).cast("decimal(7,0)")
    one = F.lit(Decimal(1 << 74)).cast("decimal(23,0)")
    rest = F.array(F.struct(F.floor(scaled / one).cast("long").alias("d"), scaled.alias("s")))

    def rounded(r: Column) -> Column:
        over = r["s"] - r["d"].cast("decimal(7,0)") * one
        twice = over * F.lit(2).cast("decimal(1,0)")
        up = (twice > one) | ((twice == one) & ((r["d"] if places else whole) % 2 == 1))
        digits = r["d"] + F.when(up, 1).otherwise(0)
        carried = whole + F.when(digits >= ten, 1).otherwise(0)
        tail = F.concat(F.lit("."), F.lpad((digits % ten).cast("string"), places, "0")) if places else F.lit("")
        return F.concat(F.when(value.cast("string").startswith("-"), "-").otherwise(""), carried.cast("string"), tail)

    plain = F.get(F.transform(rest, rounded), F.lit(0))
    return F.when(F.isnan(value), "nan").when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf")).when(size < float(1 << 63), plain)


def full_address(address: Column, parts: Column) -> Column:
    return F.when(address.isNotNull(), F.concat_ws(" | ", address, F.nullif(points_of_interest(parts), F.lit(""))))


def written_address(address: Column) -> Column:
    return or_unknown(address, NO_ADDRESS)


def camera(make: Column, model: Column) -> Column:
    return F.nullif(F.concat_ws(" ", F.nullif(F.trim(make), F.lit("")), F.nullif(F.trim(model), F.lit(""))), F.lit(""))


def shutter(seconds: Column) -> Column:
    """``1/n s`` below a second, else with one decimal; null for null, zero or less."""
    return F.when(seconds.isNull() | (seconds <= 0), None).when(seconds < 1, F.concat(F.lit("1/"), F.floor(1 / seconds).cast("string"), F.lit("s"))).otherwise(F.concat(fixed_point(seconds, 1), F.lit("s")))


def iso(value: Column) -> Column:
    return F.concat(F.lit("ISO "), value.cast("long").cast("string"))


def aperture(value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit("f/"), fixed_point(value, 1)))
