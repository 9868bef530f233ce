"""Image headers: size, depth, channels, format; a cascade of readers of which the first success counts."""

from __future__ import annotations

import calendar
import re
import struct
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dds

#: bytes of a file that readers see; headers, profiles and dates lie there
HEAD = 256 * 1024

META_SCHEMA = "path string, mtime double, file_size bigint, resolution_w int, resolution_h int, format_str string, compression_format string, format_details string, has_alpha boolean, bit_depth int, mipmap_count int, texture_type string, color_space string, capture_date double"
FAILED = {"w": 0, "h": 0, "format": "METADATA FAILED"}


def taken_at(text: str) -> float | None:
    """Seconds since 1970 of a date as cameras write it, taken as UTC; None if it is none."""
    try:
        return float(calendar.timegm(time.strptime(text.strip("\0 "), "%Y:%m:%d %H:%M:%S")))
    except ValueError:
        return None


def _directory(b: bytes) -> dict[int, list[int] | bytes]:
    """Tags of the first directory of a TIFF structure: numbers as a list, texts as bytes."""
    order = {b"II": "<", b"MM": ">"}[b[:2]]
    at = struct.unpack_from(order + "I", b, 4)[0]
    out: dict[int, list[int] | bytes] = {}
    for i in range(struct.unpack_from(order + "H", b, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", b, at + 2 + 12 * i)
        code = {1: "B", 2: "s", 3: "H", 4: "I"}.get(kind)
        if code is None or n > 65_536:
            continue
        size = n * struct.calcsize(code)
        place = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack_from(order + "I", b, at + 2 + 12 * i + 8)[0]
        if place + size <= len(b):
            out[tag] = b[place : place + n] if code == "s" else list(struct.unpack_from(f"{order}{n}{code}", b, place))
    return out


def _date(b: bytes) -> float | None:
    try:
        text = _directory(b).get(0x0132)
        return taken_at(text.decode("ascii", "replace")) if isinstance(text, bytes) else None
    except (KeyError, struct.error):
        return None


def _tiff(b: bytes) -> dict | None:
    if b[:4] not in (b"II*\0", b"MM\0*"):
        return None
    tags = _directory(b)
    bits, n = tags.get(258, [1]), tags.get(277, [1])[0]
    kind = {1: "Grayscale", 2: "GA", 3: "RGB", 4: "RGBA"}.get(n, f"{n}ch")
    return {"w": tags[256][0], "h": tags[257][0], "format": "TIFF", "depth": bits[0], "details": kind, "alpha": 338 in tags or n in (2, 4), "taken": _date(b), "space": "sRGB" if 34675 in tags else "Unknown"}


def _png(b: bytes) -> dict | None:
    if b[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    w, h, depth, kind = struct.unpack(">IIBB", b[16:26])
    details = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}.get(kind, "?")
    at, taken = 8, None
    while at + 8 <= len(b):
        n, name = struct.unpack_from(">I4s", b, at)
        if name == b"eXIf":
            taken = _date(b[at + 8 : at + 8 + n])
        if name in (b"eXIf", b"IDAT"):
            break
        at += 12 + n
    return {"w": w, "h": h, "format": "PNG", "depth": depth, "details": details, "alpha": kind in (4, 6), "taken": taken}


def _gif(b: bytes) -> dict | None:
    if b[:6] not in (b"GIF87a", b"GIF89a"):
        return None
    w, h = struct.unpack("<HH", b[6:10])
    return {"w": w, "h": h, "format": "GIF", "details": "P"}


def _bmp(b: bytes) -> dict | None:
    if b[:2] != b"BM":
        return None
    w, h, _, bits = struct.unpack("<iiHH", b[18:30])
    return {"w": w, "h": abs(h), "format": "BMP", "depth": 8, "details": "RGBA" if bits == 32 else "RGB", "alpha": bits == 32}


def _jpeg(b: bytes) -> dict | None:
    if b[:2] != b"\xff\xd8":
        return None
    at, taken = 2, None
    while at + 9 < len(b):
        if b[at] != 0xFF:
            at += 1
            continue
        marker = b[at + 1]
        if marker == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
            taken = _date(b[at + 10 : at + 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]])
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            depth, h, w, n = struct.unpack(">BHHB", b[at + 4 : at + 10])
            return {"w": w, "h": h, "format": "JPEG", "depth": depth, "details": "L" if n == 1 else "RGB", "taken": taken}
        at += 2 if marker in (0x01, *range(0xD0, 0xDA)) else 2 + struct.unpack(">H", b[at + 2 : at + 4])[0]
    return None


def _webp(b: bytes) -> dict | None:
    if b[:4] != b"RIFF" or b[8:12] != b"WEBP":
        return None
    kind = b[12:16]
    if kind == b"VP8X":
        return {"w": 1 + int.from_bytes(b[24:27], "little"), "h": 1 + int.from_bytes(b[27:30], "little"), "format": "WEBP", "alpha": bool(b[20] & 16)}
    if kind == b"VP8L":
        bits = int.from_bytes(b[21:25], "little")
        return {"w": 1 + (bits & 0x3FFF), "h": 1 + (bits >> 14 & 0x3FFF), "format": "WEBP", "alpha": bool(bits >> 28 & 1)}
    w, h = struct.unpack("<HH", b[26:30])
    return {"w": w & 0x3FFF, "h": h & 0x3FFF, "format": "WEBP"}


def _psd(b: bytes) -> dict | None:
    if b[:4] != b"8BPS":
        return None
    channels, h, w, depth = struct.unpack(">HIIH", b[12:24])
    return {"w": w, "h": h, "format": "PSD", "depth": depth, "alpha": channels > 3}


def _exr(b: bytes) -> dict | None:
    if b[:4] != b"\x76\x2f\x31\x01":
        return None
    at, found, planes, deep, taken = 8, None, [], 16, None
    while at < len(b) and b[at]:
        name = b[at : b.index(b"\0", at)]
        at += len(name) + 1
        at = b.index(b"\0", at) + 1
        size = struct.unpack_from("<i", b, at)[0]
        value, at = b[at + 4 : at + 4 + size], at + 4 + size
        if name == b"dataWindow":
            x0, y0, x1, y1 = struct.unpack("<4i", value)
            found = (x1 - x0 + 1, y1 - y0 + 1)
        elif name == b"capDate":
            taken = taken_at(value.decode("ascii", "replace"))
        elif name == b"channels":
            i = 0
            while i < len(value) and value[i]:
                end = value.index(b"\0", i)
                planes.append(value[i:end].decode("ascii", "replace"))
                deep = {0: 32, 1: 16, 2: 32}.get(struct.unpack_from("<i", value, end + 1)[0], 16)
                i = end + 17
    kind = {1: "Grayscale", 2: "GA", 3: "RGB", 4: "RGBA"}.get(len(planes), f"{len(planes)}ch")
    return found and {"w": found[0], "h": found[1], "format": "OPENEXR", "depth": deep, "details": kind, "alpha": "A" in planes, "space": "Linear", "taken": taken}


def _hdr(b: bytes) -> dict | None:
    if not b.startswith((b"#?RADIANCE", b"#?RGBE")):
        return None
    size = re.search(rb"\n[-+]Y (\d+) [-+]X (\d+)\n", b)
    return size and {"w": int(size[2]), "h": int(size[1]), "format": "HDR", "depth": 32, "details": "RGB", "space": "Linear"}


def _box(b: bytes) -> dict | None:
    """Pictures in boxes: HEIF, AVIF and JPEG 2000."""
    if b[4:8] == b"ftyp":
        brand = b[8:12]
        name = "AVIF" if brand in (b"avif", b"avis") else "HEIF" if brand in (b"heic", b"heix", b"mif1", b"msf1", b"hevc") else None
        sizes = [struct.unpack_from(">II", b, m.start() + 8) for m in re.finditer(rb"ispe", b)]
        return {"w": max(s[0] for s in sizes), "h": max(s[1] for s in sizes), "format": name, "alpha": b"auxl" in b} if name and sizes else None
    if b[4:12] == b"jP  \r\n\x87\n" and (at := b.find(b"ihdr")) > 0:
        h, w, n, deep = struct.unpack_from(">IIHB", b, at + 4)
        return {"w": w, "h": h, "format": "JPEG2000", "depth": (deep & 127) + 1, "details": {1: "Grayscale", 2: "GA", 3: "RGB", 4: "RGBA"}.get(n, f"{n}ch"), "alpha": n in (2, 4)}
    return None


def _icon(b: bytes) -> dict | None:
    if b[:4] not in (b"\0\0\1\0", b"\0\0\2\0") or not b[4]:
        return None
    bits = struct.unpack_from("<H", b, 12)[0] if b[2] == 1 else 32
    return {"w": b[6] or 256, "h": b[7] or 256, "format": "ICO" if b[2] == 1 else "CUR", "details": "RGBA" if bits in (0, 32) else "P", "alpha": bits in (0, 32)}


def _film(b: bytes) -> dict | None:
    """Scanned film, DPX and Cineon."""
    if b[:4] in (b"SDPX", b"XPDS"):
        order = ">" if b[:4] == b"SDPX" else "<"
        w, h = struct.unpack_from(order + "II", b, 772)
        return {"w": w, "h": h, "format": "DPX", "depth": b[803], "alpha": b[800] in (51, 52), "space": "Log"}
    if b[:4] == b"\x80\x2a\x5f\xd7":
        w, h = struct.unpack_from(">II", b, 200)
        return {"w": w, "h": h, "format": "CINEON", "depth": b[198], "space": "Log"}
    return None


def _tga(b: bytes) -> dict | None:
    """A format without a mark: every field of its header has to make sense."""
    mapped, kind = b[1], b[2]
    w, h, bits, flags = struct.unpack_from("<HHBB", b, 12)
    if mapped > 1 or kind not in (1, 2, 3, 9, 10, 11) or bits not in (8, 15, 16, 24, 32) or not w or not h or flags & 0xC0:
        return None
    details = {8: "P" if mapped else "Grayscale", 32: "RGBA"}.get(bits, "RGB")
    return {"w": w, "h": h, "format": "TARGA", "details": details, "alpha": bits == 32}


def _dds(b: bytes) -> dict | None:
    m = dds.read_header(dds.standard(b))
    return m and {"w": m["width"], "h": m["height"], "format": "DDS", "compression": m["format"], "depth": m["depth_bits"], "details": "DXGI", "alpha": m["alpha"], "mips": m["mips"], "kind": m["texture_type"], "space": "sRGB" if m["format"].endswith("_SRGB") else "Linear"}


READERS: list[Callable[[bytes], dict | None]] = [_dds, _png, _jpeg, _webp, _gif, _bmp, _psd, _tiff, _exr, _hdr, _box, _icon, _film, _tga]


def read_metadata(content: bytes) -> dict:
    """First reader that answers; a file that none can read is a 0 x 0 row."""
    for reader in READERS:
        try:
            if found := reader(content):
                return found
        except (struct.error, IndexError, KeyError, ValueError):
            continue
    return FAILED


def image_metadata(files: DataFrame) -> DataFrame:
    """One metadata row for each file of :func:`lumatrace.sources.files.discover` with content; readers see its first HEAD bytes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, mtime, size, content in zip(f["path"], f["mtime"], f["file_size"], f["content"]):
                m = read_metadata(bytes(content or b""))
                rows.append((path, mtime, size, m["w"], m["h"], m["format"], m.get("compression", m["format"]), m.get("details", "RGB"), m.get("alpha", False), m.get("depth", 8), max(1, m.get("mips", 1)), m.get("kind", "2D"), m.get("space", "sRGB"), m.get("taken")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in META_SCHEMA.split(", ")])

    head = F.substring("content", 1, HEAD).alias("content")  # only this much leaves the JVM
    return files.select("path", "mtime", "file_size", head).mapInPandas(run, META_SCHEMA)
