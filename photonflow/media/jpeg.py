"""Repair of JPEG files whose scan parameters a strict decoder refuses.

With an imaging library present the picture is decoded and written anew; without one the scan header
of a sequential file is set to the only values that such a file may have. Both keep the metadata segments.
"""

from __future__ import annotations

import io
import struct

#: What the model server says of such a file, and the descriptive fields that a repaired file keeps.
SIGNATURE = "Chat response error: VipsJpeg: Invalid SOS parameters for sequential JPEG"
KEPT_INFO = ("comment", "description", "copyright", "artist")


def repair_header(data: bytes) -> bytes:
    """Spectral selection 0 to 63 and no approximation in each scan of a baseline or extended sequential file."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, at, sequential = bytearray(data), 2, False
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("no marker where one must be")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if marker in (0xC0, 0xC1):
            sequential = True
        elif marker == 0xC2:
            raise ValueError("progressive files have other scan parameters")
        elif marker == 0xDA:
            if not sequential:
                raise ValueError("scan before frame")
            out[at + 2 + size - 3 : at + 2 + size] = b"\x00\x3f\x00"
            return bytes(out)
        at += 2 + size
    raise ValueError("no scan")


def repair(data: bytes, quality: int = 95) -> tuple[bytes, str]:
    """(repaired bytes, ``reencoded`` or ``header``). Transparent and palette pictures are laid on white."""
    try:
        from PIL import Image
    except ImportError:
        return repair_header(data), "header"
    with Image.open(io.BytesIO(data)) as image:
        info = dict(image.info)
        picture = image
        if image.mode in ("RGBA", "LA", "P"):
            layer = image.convert("RGBA")
            picture = Image.new("RGB", image.size, (255, 255, 255))
            picture.paste(layer, mask=layer.split()[-1])
        kept = {k: info[k] for k in ("exif", "icc_profile", *KEPT_INFO) if k in info}
        sink = io.BytesIO()
        picture.save(sink, "JPEG", quality=int(info.get("quality", quality)), **kept)
    return sink.getvalue(), "reencoded"
