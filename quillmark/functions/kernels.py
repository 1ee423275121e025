"""NumPy kernels over images of height x width x 3 bytes, and their Spark wrapper.

Images travel as (pixels binary, height int, width int); codecs stay outside. A kernel
is deterministic: random ones take a generator seeded from the row's key.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Kernel = Callable[..., np.ndarray]


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def grey(img: np.ndarray) -> np.ndarray:
    """Luma with the usual video weights."""
    return img.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def _along(x: np.ndarray, taps: np.ndarray, axis: int) -> np.ndarray:
    r = len(taps) // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (r, r)
    wide = np.pad(x, pad, mode="symmetric")
    windows = np.lib.stride_tricks.sliding_window_view(wide, len(taps), axis=axis)
    return windows @ taps


def blur(img: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian, separable, radius int(4 sigma + 0.5), mirrored borders."""
    if sigma <= 0:
        return img
    r = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    taps /= taps.sum()
    return _bytes(_along(_along(img.astype(np.float64), taps, 0), taps, 1))


def motion_blur(img: np.ndarray, length: int, angle: float = 0.0) -> np.ndarray:
    """Mean along a line of ``length`` pixels at ``angle`` degrees, edges mirrored."""
    n = max(3, int(length))
    half, turn = (n - 1) / 2.0, np.deg2rad(angle)
    along = np.linspace(-half, half, 4 * n)
    dots = {(round(y), round(x)) for y, x in zip(along * np.sin(turn), along * np.cos(turn), strict=True)}
    reach = max(max(abs(y), abs(x)) for y, x in dots)
    wide = np.pad(img.astype(np.float64), ((reach, reach), (reach, reach), (0, 0))[: img.ndim], mode="symmetric")
    h, w = img.shape[:2]
    return _bytes(sum(wide[reach + y : reach + y + h, reach + x : reach + x + w] for y, x in dots) / len(dots))


def noise(img: np.ndarray, sigma: float, rng: np.random.Generator) -> np.ndarray:
    return _bytes(img + rng.normal(0, sigma, img.shape))


def impulse(img: np.ndarray, share: float, rng: np.random.Generator) -> np.ndarray:
    """A share of pixels black or white."""
    u = rng.random(img.shape[:2])
    out = img.copy()
    out[u < share / 2], out[u > 1 - share / 2] = 0, 255
    return out


def brightness(img: np.ndarray, factor: float) -> np.ndarray:
    return _bytes(img * factor)


def contrast(img: np.ndarray, factor: float) -> np.ndarray:
    mean = grey(img).mean()
    return _bytes((img - mean) * factor + mean)


def saturation(img: np.ndarray, factor: float) -> np.ndarray:
    g = grey(img)[..., None]
    return _bytes(g + (img - g) * factor)


def jitter(img: np.ndarray, b: float, c: float, s: float) -> np.ndarray:
    return saturation(contrast(brightness(img, b), c), s)


def quantize(img: np.ndarray, bits: int) -> np.ndarray:
    keep = 0xFF & ~((1 << (8 - bits)) - 1)
    return img & np.uint8(keep)


def channel_shift(img: np.ndarray, shift: tuple[int, int, int]) -> np.ndarray:
    return _bytes(img.astype(np.int64) + np.array(shift))


def tone_curve(img: np.ndarray, low: float, high: float) -> np.ndarray:
    """Tones along a cubic Bezier curve from 0 to 1 with control points (0.25, low) and
    (0.75, high), which is the identity for 0.25 and 0.75."""
    t = np.linspace(0.0, 1.0, 512)
    weights = 3 * t * (1 - t) ** 2, 3 * t**2 * (1 - t), t**3
    at, value = (weights[0] * x + weights[1] * y + weights[2] for x, y in ((0.25, 0.75), (low, high)))
    return _bytes(255 * np.interp(np.arange(256) / 255.0, at, value))[img]


def resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Box means where the image shrinks, nearest pixels where it grows."""

    def one(x: np.ndarray, n: int, axis: int) -> np.ndarray:
        m = x.shape[axis]
        edges = np.arange(n + 1) * m / n
        lo = np.floor(edges[:-1]).astype(int)
        hi = np.maximum(np.ceil(edges[1:]).astype(int), lo + 1)
        total = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis=axis)], axis=axis)
        size = (hi - lo).reshape([-1 if k == axis else 1 for k in range(x.ndim)])
        return (np.take(total, hi, axis) - np.take(total, lo, axis)) / size

    return _bytes(one(one(img.astype(np.float64), h, 0), w, 1))


def pixelate(img: np.ndarray, block: int) -> np.ndarray:
    h, w = img.shape[:2]
    return resize(resize(img, max(1, h // block), max(1, w // block)), h, w)


def resize_roundtrip(img: np.ndarray, scale: float) -> np.ndarray:
    h, w = img.shape[:2]
    return resize(resize(img, max(1, round(h * scale)), max(1, round(w * scale))), h, w)


def center_crop(img: np.ndarray, share: float) -> np.ndarray:
    """The central part, brought back to the image's size."""
    h, w = img.shape[:2]
    ch, cw = max(1, round(h * share)), max(1, round(w * share))
    t, l = (h - ch) // 2, (w - cw) // 2
    return resize(img[t : t + ch, l : l + cw], h, w)


def dihedral(img: np.ndarray, k: int) -> np.ndarray:
    """One of the 8 symmetries of the square: k % 4 turns, mirrored from 4 on."""
    out = np.rot90(img, k % 4)
    return np.ascontiguousarray(out[:, ::-1] if k >= 4 else out)


def phash(img: np.ndarray) -> int:
    """64 signs of low DCT frequencies (without the first row and column) against their
    median, as a signed 64-bit number."""
    n, keep = 32, 8
    small = resize(np.repeat(grey(img)[..., None], 3, axis=2).astype(np.uint8), n, n)[..., 0].astype(np.float64)
    i = np.arange(n)
    basis = np.cos(np.pi * (2 * i[None] + 1) * np.arange(1, keep + 1)[:, None] / (2 * n))
    low = basis @ small @ basis.T
    bits = (low > np.median(low)).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def laplacian_variance(img: np.ndarray) -> float:
    g = grey(img)
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def noise_floor(img: np.ndarray) -> float:
    """Deviation of the residual of a Gaussian of sigma 1, as 1.4826 times its median
    absolute deviation."""
    g = grey(img)
    taps = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    taps /= taps.sum()
    r = g - _along(_along(g, taps, 0), taps, 1)
    return float(1.4826 * np.median(np.abs(r - np.median(r))))


def neighbour_residuals(img: np.ndarray, stride: int = 2) -> np.ndarray:
    """Mean and deviation of differences within stride x stride cells, along both axes."""
    g = grey(img)
    h, w = (s // stride * stride for s in g.shape)
    cells = g[:h, :w].reshape(h // stride, stride, w // stride, stride)
    dx, dy = np.abs(np.diff(cells, axis=3)), np.abs(np.diff(cells, axis=1))
    return np.array([dx.mean(), dx.std(), dy.mean(), dy.std()])


def thumbnail(img: np.ndarray, side: int = 16) -> np.ndarray:
    return resize(img, side, side).astype(np.float64).ravel() / 255.0


#: Name, function, whether it draws random numbers.
OPS: dict[str, tuple[Kernel, bool]] = {
    "blur": (blur, False), "motion_blur": (motion_blur, False), "noise": (noise, True), "impulse": (impulse, True), "brightness": (brightness, False),
    "contrast": (contrast, False), "saturation": (saturation, False), "jitter": (jitter, False), "quantize": (quantize, False), "tone_curve": (tone_curve, False),
    "pixelate": (pixelate, False), "resize_roundtrip": (resize_roundtrip, False), "center_crop": (center_crop, False), "dihedral": (dihedral, False),
}


def apply_ops(df: DataFrame, key: str, ops: list[tuple[str, dict]], seed: int = 0) -> DataFrame:
    """Run a recipe over every image row; other columns stay as they are."""
    names, at = df.columns, [df.columns.index(c) for c in ("pixels", "height", "width")]
    where = df.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for raw, h, w, k in zip(*(batch.column(c).to_pylist() for c in (*at, where)), strict=True):
                img = np.frombuffer(raw, np.uint8).reshape(h, w, 3)
                rng = np.random.default_rng([seed, zlib.crc32(str(k).encode())])
                for name, params in ops:
                    f, random = OPS[name]
                    img = f(img, **params, rng=rng) if random else f(img, **params)
                out.append((img.tobytes(), img.shape[0], img.shape[1]))
            cols = list(batch.columns)
            for c, values, kind in zip(at, zip(*out, strict=True) if out else [[], [], []], (pa.binary(), pa.int32(), pa.int32()), strict=True):
                cols[c] = pa.array(list(values), kind)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return df.mapInArrow(run, df.schema)


def features(df: DataFrame, key: str) -> DataFrame:
    """(key, phash, laplacian_variance, noise_floor, residuals, thumbnail) of each image."""
    schema = T.StructType([df.schema[key]]).add("phash", T.LongType()).add("laplacian_variance", T.DoubleType()).add("noise_floor", T.DoubleType()).add("residuals", T.ArrayType(T.DoubleType())).add("thumbnail", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            imgs = [np.frombuffer(p, np.uint8).reshape(h, w, 3) for p, h, w in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([phash(i) for i in imgs], pa.int64()), pa.array([laplacian_variance(i) for i in imgs], pa.float64()),
                    pa.array([noise_floor(i) for i in imgs], pa.float64()), pa.array([neighbour_residuals(i) for i in imgs], pa.list_(pa.float64())),
                    pa.array([thumbnail(i) for i in imgs], pa.list_(pa.float64())),
                ],
                names=schema.names,
            )

    return df.select(key, "pixels", "height", "width").mapInArrow(run, schema)
