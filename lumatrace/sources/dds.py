"""DDS textures: header and uncompressed surfaces."""

from __future__ import annotations

import struct

import numpy as np

#: DXGI format numbers of the formats that are decoded or named here.
DXGI = {
    2: "R32G32B32A32_FLOAT", 10: "R16G16B16A16_FLOAT", 11: "R16G16B16A16_UNORM", 28: "R8G8B8A8_UNORM", 29: "R8G8B8A8_UNORM_SRGB", 31: "R8G8B8A8_SNORM",
    41: "R32_FLOAT", 49: "R8G8_UNORM", 54: "R16_FLOAT", 56: "R16_UNORM", 61: "R8_UNORM", 65: "A8_UNORM", 71: "BC1_UNORM", 72: "BC1_UNORM_SRGB", 74: "BC2_UNORM",
    75: "BC2_UNORM_SRGB", 77: "BC3_UNORM", 78: "BC3_UNORM_SRGB", 80: "BC4_UNORM", 81: "BC4_SNORM", 83: "BC5_UNORM", 84: "BC5_SNORM", 85: "B5G6R5_UNORM", 86: "B5G5R5A1_UNORM",
    87: "B8G8R8A8_UNORM", 88: "B8G8R8X8_UNORM", 91: "B8G8R8A8_UNORM_SRGB", 95: "BC6H_UF16", 96: "BC6H_SF16", 98: "BC7_UNORM", 99: "BC7_UNORM_SRGB", 115: "B4G4R4A4_UNORM",
}
#: FourCC codes of the older header.
FOURCC = {b"DXT1": 71, b"DXT2": 74, b"DXT3": 74, b"DXT4": 77, b"DXT5": 77, b"ATI1": 80, b"BC4U": 80, b"BC4S": 81, b"ATI2": 83, b"BC5U": 83, b"BC5S": 84, b"\x24\x00\x00\x00": 11, b"\x6f\x00\x00\x00": 54, b"\x71\x00\x00\x00": 10, b"\x72\x00\x00\x00": 41, b"\x74\x00\x00\x00": 2}
#: Fixed values: (bits, red mask, alpha mask) of mask-described formats.
MASKS = {(32, 0xFF, 0xFF000000): 28, (32, 0xFF0000, 0xFF000000): 87, (32, 0xFF0000, 0): 88, (16, 0xF800, 0): 85, (16, 0x7C00, 0x8000): 86, (16, 0x0F00, 0xF000): 115, (8, 0xFF, 0): 61, (8, 0, 0xFF): 65, (16, 0xFF, 0xFF00): 49}


def read_header(b: bytes) -> dict | None:
    """Size, format name, mip count, texture type and where the pixels start; None if this is no DDS file."""
    if b[:4] != b"DDS " or len(b) < 128:
        return None
    height, width = struct.unpack_from("<II", b, 12)
    mips = struct.unpack_from("<I", b, 28)[0]
    flags, code, bits, red, _, _, alpha = struct.unpack_from("<I4sIIIII", b, 80)
    caps2 = struct.unpack_from("<I", b, 112)[0]
    start, array = 128, 1
    kind = "Cubemap" if caps2 & 0x200 else "3D" if caps2 & 0x200000 else "2D"
    if flags & 4 and code == b"DX10":
        number, dimension, misc, array = struct.unpack_from("<IIII", b, 128)
        start = 148
        kind = "3D" if dimension == 4 else "Cubemap" if misc & 4 else "2D"
    elif flags & 4:
        number = FOURCC.get(code, 0)
    else:
        number = MASKS.get((bits, red, alpha if flags & 3 else 0), 0)
    name = DXGI.get(number, "UNKNOWN")
    deep = 32 if "32_" in name or name.startswith("R32") else 16 if "16" in name else 8
    return {"width": width, "height": height, "mips": max(1, mips), "format": name, "texture_type": kind, "start": start, "array": array, "depth_bits": deep, "alpha": "A" in name.split("_")[0] or name[:3] in ("BC2", "BC3", "BC7")}


def _bits(v: np.ndarray, shift: int, width: int) -> np.ndarray:
    x = (v >> shift) & ((1 << width) - 1)
    return np.rint(x * (255.0 / ((1 << width) - 1))).astype(np.uint8)


def decode(b: bytes, mip_level: int = 0) -> np.ndarray | None:
    """Raster of one mip level of an uncompressed surface, in the stored type; None for block-compressed or unknown formats."""
    h = read_header(b)
    if h is None:
        return None
    name, at, w, n = h["format"], h["start"], h["width"], h["height"]
    size = {"R32G32B32A32_FLOAT": 16, "R16G16B16A16_FLOAT": 8, "R16G16B16A16_UNORM": 8, "R32_FLOAT": 4, "R8_UNORM": 1, "A8_UNORM": 1}.get(name)
    size = size or (2 if name in ("R8G8_UNORM", "R16_FLOAT", "R16_UNORM") or name.startswith(("B5", "B4")) else 4 if name.startswith(("R8G8B8A8", "B8G8R8")) else None)
    if size is None or not 0 <= mip_level < h["mips"]:
        return None
    for _ in range(mip_level):
        at += w * n * size
        w, n = max(1, w // 2), max(1, n // 2)
    raw = b[at : at + w * n * size]
    if len(raw) < w * n * size:
        return None
    view = lambda t, c: np.frombuffer(raw, dtype=t).reshape(n, w, c)
    if name.startswith("R8G8B8A8"):
        return view(np.int8 if name.endswith("SNORM") else np.uint8, 4).copy()
    if name.startswith("B8G8R8"):
        out = view(np.uint8, 4)[..., [2, 1, 0, 3]].copy()
        if name.startswith("B8G8R8X8"):
            out[..., 3] = 255
        return out
    if name.startswith(("B5", "B4")):
        v = np.frombuffer(raw, dtype="<u2").reshape(n, w).astype(np.uint32)
        if name.startswith("B5G6R5"):
            planes = [_bits(v, 11, 5), _bits(v, 5, 6), _bits(v, 0, 5), np.full((n, w), 255, np.uint8)]
        elif name.startswith("B5G5R5A1"):
            planes = [_bits(v, 10, 5), _bits(v, 5, 5), _bits(v, 0, 5), _bits(v, 15, 1)]
        else:
            planes = [_bits(v, 8, 4), _bits(v, 4, 4), _bits(v, 0, 4), _bits(v, 12, 4)]
        return np.stack(planes, axis=-1)
    kinds = {"R32G32B32A32_FLOAT": ("<f4", 4), "R16G16B16A16_FLOAT": ("<f2", 4), "R16G16B16A16_UNORM": ("<u2", 4), "R32_FLOAT": ("<f4", 1), "R16_FLOAT": ("<f2", 1), "R16_UNORM": ("<u2", 1), "R8G8_UNORM": ("u1", 2), "R8_UNORM": ("u1", 1), "A8_UNORM": ("u1", 1)}
    t, c = kinds[name]
    return view(t, c).copy()


def _ramp(a: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """The values between two ends, the ends left out, along a new axis behind the first."""
    i = np.arange(1, steps).reshape(1, -1, *[1] * (a.ndim - 1))
    return ((steps - i) * a[:, None] + i * b[:, None]) / steps


def _block_colours(raw: np.ndarray, always_four: bool) -> np.ndarray:
    """Pixels of colour blocks: two ends of 5, 6 and 5 bits and two bits a pixel; the fourth channel is where the blocks are clear."""
    ends = raw[:, :4].copy().view("<u2").astype(np.uint32)
    rgb = np.stack([_bits(ends, 11, 5), _bits(ends, 5, 6), _bits(ends, 0, 5)], axis=-1).astype(np.float64)
    four = (ends[:, 0] > ends[:, 1]) | always_four
    thirds = _ramp(rgb[:, 0], rgb[:, 1], 3)
    half = np.stack([_ramp(rgb[:, 0], rgb[:, 1], 2)[:, 0], np.zeros_like(rgb[:, 0])], axis=1)
    colours = np.concatenate([rgb, np.where(four[:, None, None], thirds, half)], axis=1)
    alpha = np.full((len(raw), 4, 1), 255.0)
    alpha[~four, 3] = 0
    which = raw[:, 4:8].copy().view("<u4") >> np.arange(0, 32, 2, dtype=np.uint32) & 3
    return np.rint(np.take_along_axis(np.concatenate([colours, alpha], axis=-1), which[..., None].astype(np.int64), axis=1)).astype(np.uint8)


def _block_values(raw: np.ndarray) -> np.ndarray:
    """Pixels of one-channel blocks: two ends of a byte and three bits a pixel."""
    a, b = raw[:, 0].astype(np.float64), raw[:, 1].astype(np.float64)
    short = np.concatenate([_ramp(a, b, 5), np.zeros((len(raw), 1)), np.full((len(raw), 1), 255.0)], axis=1)
    table = np.concatenate([a[:, None], b[:, None], np.where((a > b)[:, None], _ramp(a, b, 7), short)], axis=1)
    bits = np.unpackbits(raw[:, 2:8], axis=1, bitorder="little").reshape(len(raw), 16, 3) @ np.array([1, 2, 4])
    return np.rint(np.take_along_axis(table, bits, axis=1)).astype(np.uint8)


def decode_blocks(b: bytes, mip_level: int = 0, array_index: int = 0) -> np.ndarray | None:
    """RGBA, grey or two-channel raster of a block-compressed surface (BC1 to BC5, unsigned); None for other formats."""
    h = read_header(b)
    kind = h and h["format"][:3]
    if kind not in ("BC1", "BC2", "BC3", "BC4", "BC5") or h["format"].endswith("SNORM") or not 0 <= mip_level < h["mips"] or array_index < 0:
        return None
    size = 8 if kind in ("BC1", "BC4") else 16
    levels = [(max(1, h["width"] >> i), max(1, h["height"] >> i)) for i in range(h["mips"])]
    bytes_of = [-(-w // 4) * -(-n // 4) * size for w, n in levels]
    at = h["start"] + array_index * sum(bytes_of) + sum(bytes_of[:mip_level])
    (w, n), across = levels[mip_level], -(-levels[mip_level][0] // 4)
    if len(b) < at + bytes_of[mip_level]:
        return None
    raw = np.frombuffer(b, dtype=np.uint8, count=bytes_of[mip_level], offset=at).reshape(-1, size)
    if kind == "BC1":
        px = _block_colours(raw, False)
    elif kind in ("BC2", "BC3"):
        px = _block_colours(raw[:, 8:], True)
        if kind == "BC3":
            px[..., 3] = _block_values(raw[:, :8])
        else:
            px[..., 3] = np.stack([raw[:, :8] & 15, raw[:, :8] >> 4], axis=-1).reshape(-1, 16) * 17
    else:
        px = np.stack([_block_values(raw[:, i : i + 8]) for i in range(0, size, 8)], axis=-1)
    c = px.shape[-1]
    return px.reshape(-1, across, 4, 4, c).transpose(0, 2, 1, 3, 4).reshape(-1, across * 4, c)[:n, :w].copy()


#: Codes that consoles write backwards, and the 16-bit words of a block that they write in the other byte order.
BACKWARD = [b"DXT1", b"DXT3", b"DXT5", b"DX10", b"ATI1", b"ATI2", b"BC4U", b"BC5U"]
SWAPPED_WORDS = {"BC1": [0, 1], "BC2": [4, 5], "BC3": [1, 2, 3, 4, 5], "BC4": [0, 1], "BC5": [1, 2, 3, 5, 6, 7]}
#: Marks that an engine puts before the pixels, with the bytes to leave out; behind the first, blocks lie in Morton order.
MARKS = {b"CRYF": 8, b"FYRC": 4}


def morton(across: int, down: int) -> np.ndarray:
    """Where each unit of a raster lies in Morton order: bits of column and row in turn, then what the longer side has left."""
    bits = [max(0, n - 1).bit_length() for n in (across, down)]
    both = min(bits)
    x, y = np.arange(across)[None, :], np.arange(down)[:, None]
    at = np.zeros((down, across), dtype=np.int64)
    for i in range(both):
        at += (x >> i & 1) << (2 * i)
        at += (y >> i & 1) << (2 * i + 1)
    return at + ((x if bits[0] > bits[1] else y) >> both << (2 * both))


def standard(b: bytes) -> bytes:
    """A texture with the quirks of consoles and of one engine as other readers expect it, its first level only; others as they are."""
    if b[:4] != b"DDS " or len(b) < 132:
        return b
    turned = b[84:88][::-1] in BACKWARD
    b = b[:84] + b[84:88][::-1] + b[88:] if turned else b
    h = read_header(b)
    mark = b[h["start"] : h["start"] + 4]
    if not turned and mark not in MARKS:
        return b
    head, body, kind = bytearray(b[: h["start"]]), b[h["start"] + MARKS.get(mark, 0) :], h["format"][:3]
    across, down = max(1, -(-h["width"] // 4)), max(1, -(-h["height"] // 4))
    if mark in MARKS and struct.unpack_from("<I", b, 80)[0] & 0x40 and len(body) >= across * down * 8:
        head[80:88], kind = struct.pack("<I", 4) + b"DXT1", "BC1"  # such files state masks but hold blocks
    struct.pack_into("<I", head, 28, 1)
    unit = {"BC1": 8, "BC4": 8, "BC2": 16, "BC3": 16, "BC5": 16}.get(kind, 2 * struct.unpack_from("<I", b, 88)[0])
    size = across * down * unit
    if not unit or len(body) < size:
        return bytes(head) + body
    data = np.frombuffer(body, dtype=np.uint8, count=len(body) // unit * unit).reshape(-1, unit)
    if mark == b"CRYF":
        at = morton(across, down).ravel()
        data = np.where((at < len(data))[:, None], data[np.minimum(at, len(data) - 1)], 0).astype(np.uint8)
    data = data[: across * down].copy()
    if turned and kind in SWAPPED_WORDS:
        words = data.view("<u2")
        words[:, SWAPPED_WORDS[kind]] = words[:, SWAPPED_WORDS[kind]].byteswap()
    elif turned and unit >= 32:
        data = data.reshape(-1, unit // 16)[:, ::-1].copy()
    return bytes(head) + data.tobytes()


def to_bytes(a: np.ndarray) -> np.ndarray:
    """Any decoded raster as bytes: 16 bit by 257, signed stretched between its extremes, float clipped to 0..1."""
    if a.dtype == np.uint8:
        return a
    if a.dtype == np.uint16:
        return (a // 257).astype(np.uint8)
    if a.dtype.kind == "i":
        lo, hi = int(a.min()), int(a.max())
        return ((a.astype(np.float64) - lo) * (255.0 / max(1, hi - lo))).astype(np.uint8)
    return (np.clip(np.nan_to_num(a.astype(np.float64)), 0, 1) * 255).astype(np.uint8)
