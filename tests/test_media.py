"""EXIF and JPEG bytes that are put together by hand."""

import struct
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from photonflow.media.exif import read_exif, shutter_text
from photonflow.media.jpeg import repair_header
from photonflow.operators.metadata import exif_of_bytes


def tiff(order, main=(), exif=(), gps=()):
    """A TIFF block; entries are (tag, type, count, bytes)."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    main = list(main)
    parts = {"main": main, "exif": list(exif), "gps": list(gps)}
    if exif:
        main.append((0x8769, 4, 1, "exif"))
    if gps:
        main.append((0x8825, 4, 1, "gps"))
    start, at = {}, 8
    for name in parts:
        start[name] = at
        at += 2 + 12 * len(parts[name]) + 4
    out, data = head, b""
    for name, entries in parts.items():
        out += struct.pack(order + "H", len(entries))
        for tag, kind, count, value in entries:
            value = struct.pack(order + "I", start[value]) if isinstance(value, str) else value
            if len(value) > 4:
                place = at + len(data)
                data += value
                value = struct.pack(order + "I", place)
            out += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
        out += b"\0\0\0\0"
    return out + data


def jpeg(block):
    app1 = b"Exif\0\0" + block
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xd9"


def sample(order="<", **change):
    r = lambda *v: struct.pack(order + "I" * len(v), *v)
    text = lambda s: (2, len(s) + 1, s.encode() + b"\0")
    exif = {33434: (5, 1, r(1, 125)), 33437: (5, 1, r(18, 10)), 34855: (3, 1, struct.pack(order + "H", 200)), 36867: text("2020:01:02 03:04:05"), 37386: (5, 1, r(425, 100))}
    main = {271: text(" Canon "), 272: text("X1"), 306: text("2019:01:01 00:00:00")}
    gps = {1: text("S"), 2: (5, 3, r(52, 1, 30, 1, 36, 1)), 3: text("E"), 4: (5, 3, r(5, 1, 0, 1, 0, 1))}
    for name, part in (("exif", exif), ("main", main), ("gps", gps)):
        part |= change.get(name, {})
    flat = lambda d: [(k, *v) for k, v in sorted(d.items()) if v]
    return jpeg(tiff(order, flat(main), flat(exif), flat(gps)))


@pytest.mark.parametrize("order", ["<", ">"])
def test_all_fields_in_both_byte_orders(order):
    x = read_exif(sample(order))
    assert x["camera"] == "Canon X1" and x["aperture"] == "f/1.8" and x["iso"] == "ISO 200" and x["shutter_speed"] == "1/125s"
    assert x["focal_length"] == f"{4.25:.1f}mm" and x["datetime"] == datetime(2020, 1, 2, 3, 4, 5)
    assert x["location"] == (pytest.approx(-52.51), 5.0) and x["coordinates"] == "-52.510000, 5.000000"


def test_missing_and_broken_entries():
    bad_time = (2, 4, b"bad\0")
    x = read_exif(sample(exif={36867: bad_time}, main={271: None}))
    assert x["datetime"] == datetime(2019, 1, 1) and x["camera"] == "X1"
    assert read_exif(sample(gps={1: None}))["location"] is None
    assert read_exif(sample(exif={33434: (5, 1, struct.pack("<II", 1, 0))}))["shutter_speed"] is None
    assert read_exif(b"") is None and read_exif(None) is None and read_exif(b"\xff\xd8\xff\xd9") is None
    whole = sample()
    for n in range(len(whole)):
        read_exif(whole[:n])  # a cut file must not raise
    assert (shutter_text(2.0), shutter_text(0.0), shutter_text(None)) == ("2.0s", None, None)


def test_exif_column(spark):
    rows = spark.createDataFrame([(1, sample()), (2, b"no"), (3, None)], "i int, b binary").select("i", exif_of_bytes(F.col("b")).alias("x")).orderBy("i").collect()
    assert rows[0]["x"]["camera"] == "Canon X1" and rows[0]["x"]["location"]["lon"] == 5.0
    assert rows[1]["x"]["camera"] is None and rows[2]["x"]["datetime"] is None


def test_scan_header_repair():
    frame = b"\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00"
    scan = b"\xff\xda\x00\x08\x01\x01\x00\x05\x10\x11" + b"data\xff\xd9"
    fixed = repair_header(b"\xff\xd8" + frame + scan)
    assert fixed.endswith(b"\x01\x01\x00\x00\x3f\x00data\xff\xd9") and len(fixed) == len(b"\xff\xd8" + frame + scan)
    for bad in (b"x", b"\xff\xd8\xff\xd9", b"\xff\xd8" + scan, b"\xff\xd8" + frame.replace(b"\xc0", b"\xc2") + scan):
        with pytest.raises(ValueError):
            repair_header(bad)
