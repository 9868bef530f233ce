"""Pixel arithmetic on numpy rasters, and the array expressions that need none."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def resize_nearest(a: np.ndarray, w: int, h: int) -> np.ndarray:
    ys = np.minimum((np.arange(h) + 0.5) * a.shape[0] / h, a.shape[0] - 1).astype(int)
    xs = np.minimum((np.arange(w) + 0.5) * a.shape[1] / w, a.shape[1] - 1).astype(int)
    return a[ys][:, xs]


def resize_mean(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Area mean for reduction, nearest for enlargement."""
    a = np.asarray(a, dtype=np.float64)
    if a.shape[0] < h or a.shape[1] < w:
        a = resize_nearest(a, max(w, a.shape[1]), max(h, a.shape[0]))

    def weights(n: int, m: int) -> np.ndarray:
        lo, hi = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
        cell = np.arange(n)[None, :]
        return np.clip(np.minimum(hi, cell + 1) - np.maximum(lo, cell), 0, None) * m / n

    return weights(a.shape[0], h) @ a @ weights(a.shape[1], w).T


def resize_bilinear(a: np.ndarray, w: int, h: int) -> np.ndarray:
    """Between the centres of pixels, the edge repeated beyond them."""
    a = np.asarray(a, dtype=np.float64)

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(a.shape[0], h)
    x0, x1, fx = axis(a.shape[1], w)
    fy, fx = fy[:, None, None], fx[None, :, None]
    return (a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx) * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows of length one; a row of zeros stays."""
    v = v.astype(np.float64).reshape(len(v), -1)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, n, out=v.copy(), where=n > 0)


def masked(rgba: np.ndarray, shown: str = "RGBA") -> np.ndarray:
    """Only the shown channels: a single one as grey, others black, alpha opaque where it is hidden."""
    if len(shown) == 1:
        grey = rgba[..., "RGBA".index(shown)]
        return np.stack([grey, grey, grey, np.full_like(grey, 255)], axis=-1)
    out = rgba.copy()
    for i, c in enumerate("RGBA"):
        if c not in shown:
            out[..., i] = 255 if c == "A" else 0
    return out


def _dct(n: int) -> np.ndarray:
    k = np.arange(n)
    return 2 * np.cos(np.pi * k[:, None] * (2 * k[None, :] + 1) / (2 * n))


def pack(bits: np.ndarray) -> int:
    """Row-major bits, first one highest, as a signed 64-bit number."""
    return int(np.packbits(bits.ravel().astype(np.uint8)).view(">u8")[0].astype(np.uint64).view(np.int64))


def dhash(grey: np.ndarray) -> int:
    small = resize_mean(grey, 9, 8)
    return pack(small[:, 1:] > small[:, :-1])


def phash(grey: np.ndarray) -> int:
    small = resize_mean(grey, 32, 32)
    low = (_dct(32) @ small @ _dct(32).T)[:8, :8]
    return pack(low > np.median(low))


def whash(grey: np.ndarray) -> int:
    """Haar approximation at 8 x 8 without its own mean, against the median."""
    side = 1 << max(3, int(np.log2(max(8, min(grey.shape)))))
    low = resize_mean(resize_mean(grey, side, side) / 255.0, 8, 8)
    low = low - low.mean()
    return pack(low > np.median(low))


def luminance(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., 0] * 0.299 + rgb[..., 1] * 0.587 + rgb[..., 2] * 0.114


def over_black(rgba: np.ndarray) -> np.ndarray:
    return np.rint(rgba[..., :3] * (rgba[..., 3:] / 255.0)).astype(np.uint8)


def is_solid(channel: np.ndarray) -> bool:
    """Nearly black or nearly white throughout, by the extremes first and by the mean otherwise."""
    lo, hi = channel.min(), channel.max()
    return bool(hi < 5 or lo > 250 or not 5 <= channel.mean() <= 250)


def channel_view(rgba: np.ndarray, analysis_type: str) -> np.ndarray:
    """The plane that an analysis type looks at, as floats."""
    if analysis_type in "RGBA" and len(analysis_type) == 1:
        return rgba[..., "RGBA".index(analysis_type)].astype(np.float64)
    return luminance(rgba[..., :3].astype(np.float64))


def tonemap(x: np.ndarray) -> np.ndarray:
    """Float raster to bytes: no negatives, exposure 1.5, a filmic curve, clipped."""
    x = np.maximum(np.nan_to_num(x), 0) * 1.5
    y = (x * (2.51 * x + 0.03)) / (x * (2.43 * x + 0.59) + 0.14)
    return (np.clip(y, 0, 1) * 255).astype(np.uint8)


def unpremultiply(rgba: np.ndarray) -> np.ndarray:
    a = rgba[..., 3:].astype(np.float64)
    rgb = np.where(a > 0, np.minimum(255, rgba[..., :3] * 255.0 / np.maximum(a, 1)), rgba[..., :3])
    return np.concatenate([rgb.astype(np.uint8), rgba[..., 3:]], axis=-1)


def resolve_alpha(rgba: np.ndarray) -> np.ndarray:
    """Opaque: no alpha; all clear with colour: alpha from colour; colourless with alpha: colour from alpha; else un-premultiplied."""
    a, rgb = rgba[..., 3], rgba[..., :3]
    if a.min() == 255:
        return rgb.copy()
    out = rgba.copy()
    if a.max() == 0 and rgb.max() > 0:
        out[..., 3] = rgb.max(axis=-1)
        return out
    if rgb.max() == 0 and a.max() > 0:
        out[..., :3] = a[..., None]
        return out
    return unpremultiply(rgba)


def pixel_diff(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def channel_active(values: Column) -> Column:
    return F.array_min(values) != F.array_max(values)


def solid_channel(values: Column) -> Column:
    """The same test as :func:`is_solid` on an array column of 0..255."""
    mean = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)
    return (F.array_max(values) < 5) | (F.array_min(values) > 250) | (mean < 5) | (mean > 250)
