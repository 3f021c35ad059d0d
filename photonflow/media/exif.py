"""Capture data from the EXIF block of JPEG bytes, without an imaging library.

Reads the TIFF structure in the first APP1 segment: the main directory, the EXIF directory and the
GPS directory, in either byte order, with every offset checked against the block.
"""

from __future__ import annotations

import struct
from datetime import datetime
from fractions import Fraction

#: Fixed tag numbers.
MAKE, MODEL, DATETIME, EXIF_IFD, GPS_IFD = 271, 272, 306, 0x8769, 0x8825
EXPOSURE, APERTURE, ISO, ORIGINAL, DIGITIZED, FOCAL = 33434, 33437, 34855, 36867, 36868, 37386
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
#: TIFF type -> (bytes, struct code); rationals are pairs.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 7: (1, "s"), 9: (4, "i"), 10: (8, "ii")}


def exif_block(data: bytes) -> bytes | None:
    """The TIFF bytes of a JPEG's EXIF segment."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        if marker in (0xD9, 0xDA) or size < 2:
            return None
        at += 2 + size
    return None


def _directory(block: bytes, at: int, order: str) -> dict[int, object]:
    """Tag -> value; a rational is a Fraction, or None for a zero denominator. Entries that point outside are left out."""
    out: dict[int, object] = {}
    if at + 2 > len(block):
        return out
    (n,) = struct.unpack_from(order + "H", block, at)
    for i in range(n):
        entry = at + 2 + 12 * i
        if entry + 12 > len(block):
            break
        tag, kind, count = struct.unpack_from(order + "HHI", block, entry)
        if kind not in TYPES:
            continue
        size, code = TYPES[kind]
        where = entry + 8 if size * count <= 4 else struct.unpack_from(order + "I", block, entry + 8)[0]
        if where + size * count > len(block):
            continue
        if code == "s":
            raw = block[where : where + count]
            out[tag] = raw.split(b"\0")[0].decode("latin-1") if kind == 2 else raw
            continue
        flat = struct.unpack_from(order + code * count, block, where)
        values = [Fraction(a, b) if b else None for a, b in zip(flat[::2], flat[1::2])] if len(code) == 2 else list(flat)
        out[tag] = values[0] if len(values) == 1 else values
    return out


def _number(value: object) -> float | None:
    return float(value) if isinstance(value, (int, Fraction)) else None


def _degrees(value: object) -> float | None:
    if not isinstance(value, list) or len(value) != 3 or None in value:
        return None
    d, m, s = map(float, value)
    return d + m / 60.0 + s / 3600.0


def _time(text: object) -> datetime | None:
    try:
        return datetime.strptime(text, "%Y:%m:%d %H:%M:%S") if isinstance(text, str) else None
    except ValueError:
        return None


def read_exif(data: bytes | None) -> dict[str, object] | None:
    """The fields of ``schema.EXIF``; None without an EXIF block. Broken entries are null, the others are kept."""
    block = exif_block(data or b"")
    if not block or len(block) < 8 or block[:2] not in (b"II", b"MM"):
        return None
    order = "<" if block[:2] == b"II" else ">"
    magic, first = struct.unpack_from(order + "HI", block, 2)
    if magic != 42:
        return None
    tags = _directory(block, first, order)
    if isinstance(tags.get(EXIF_IFD), int):
        tags = _directory(block, tags[EXIF_IFD], order) | tags
    gps = _directory(block, tags[GPS_IFD], order) if isinstance(tags.get(GPS_IFD), int) else {}
    make, model = (str(tags.get(t, "")).strip() for t in (MAKE, MODEL))
    focal, aperture, exposure = (_number(tags.get(t)) for t in (FOCAL, APERTURE, EXPOSURE))
    lat, lon = _degrees(gps.get(LAT)), _degrees(gps.get(LON))
    located = lat is not None and lon is not None and gps.get(LAT_REF) and gps.get(LON_REF)
    lat, lon = (-lat if gps[LAT_REF] == "S" else lat, -lon if gps[LON_REF] == "W" else lon) if located else (None, None)
    iso = tags.get(ISO)
    return {
        "datetime": next((t for t in (_time(tags.get(k)) for k in (ORIGINAL, DIGITIZED, DATETIME)) if t), None),
        "location": (lat, lon) if located else None,
        "coordinates": f"{lat:.6f}, {lon:.6f}" if located else None,
        "camera": f"{make} {model}".strip() or None,
        "focal_length": f"{focal:.1f}mm" if focal is not None else None,
        "aperture": f"f/{aperture:.1f}" if aperture is not None else None,
        "iso": f"ISO {iso}" if isinstance(iso, int) else None,
        "shutter_speed": shutter_text(exposure),
    }


def shutter_text(seconds: float | None) -> str | None:
    """``1/125s`` below a second, ``2.0s`` from there; nothing for zero or unknown."""
    if not seconds:
        return None
    return f"1/{int(1 / seconds)}s" if seconds < 1 else f"{seconds:.1f}s"
