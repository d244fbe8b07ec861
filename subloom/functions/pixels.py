"""Images as bytes: masks, components and thumbnails (F30, F31, F33, F34), a batch of images at a time.

An image is ``pixels`` (unsigned bytes, row by row; of three channels blue, green
and red stand together, one channel is gray), ``width`` and ``height``.  A kernel
sees one image, which a frame's size bounds, and works on whole arrays.  A null
image, one without pixels, and bytes that don't fill the size give null.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

# What is bright, the share of rows at the top without text, the
# kernels (width, height), the sizes (width, height) of masks and thumbnails.
BRIGHT = 180
TOP = 0.18
CLOSE, OPEN = (9, 3), (2, 2)
MASK, SMALL = (96, 32), (160, 40)
# Weights of blue, green and red in gray, of 2**15.
GRAY = (3735, 19235, 9798)


def image(content: bytes | None, width: float | None, height: float | None) -> np.ndarray | None:
    """Rows, columns and channels; None for what is no image."""
    if content is None or pd.isna(width) or pd.isna(height) or width <= 0 or height <= 0:
        return None
    w, h, values = int(width), int(height), np.frombuffer(content, np.uint8)
    return values.reshape(h, w, -1) if len(values) in (w * h, 3 * w * h) else None


def gray(img: np.ndarray) -> np.ndarray:
    if img.shape[2] == 1:
        return img[:, :, 0]
    return ((img.astype(np.int64) @ np.array(GRAY) + (1 << 14)) >> 15).astype(np.uint8)


def _slide(values: np.ndarray, size: tuple[int, int], take: np.ufunc) -> np.ndarray:
    """``take`` over a window whose anchor is its middle, of an even one the place after it; what is outside doesn't count."""
    for axis, n in ((1, size[0]), (0, size[1])):
        out = values.copy()
        for step in range(-(n // 2), n - n // 2):
            if abs(step) >= values.shape[axis] or step == 0:
                continue
            to, of = slice(max(0, -step), values.shape[axis] - max(0, step)), slice(max(0, step), values.shape[axis] + min(0, step))
            to, of = ((slice(None), to), (slice(None), of)) if axis == 1 else ((to,), (of,))
            out[to] = take(out[to], values[of])
        values = out
    return values


def closed(mask: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Gaps narrower than the window are filled."""
    return _slide(_slide(mask, size, np.maximum), size, np.minimum)


def opened(mask: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """What is narrower than the window goes; a window of even size moves the rest by one place right or down."""
    return _slide(_slide(mask, size, np.minimum), size, np.maximum)


def components(mask: np.ndarray) -> np.ndarray:
    """x, y, width, height and area of what is connected over eight neighbours, in order of first places.

    Runs of a row are the nodes; a run meets those of the next row that touch
    it.  The smallest run hands its number on, a tree at a time.
    """
    wide = mask.shape[1] + 2
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, start = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    if not len(row):
        return np.zeros((0, 5), np.int64)
    below = (row + 1) * wide
    first = np.searchsorted(row * wide + end, below + start, "left")
    n = np.maximum(np.searchsorted(row * wide + start, below + end, "right") - first, 0)
    a = np.repeat(np.arange(len(row)), n)
    b = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
    root = np.arange(len(row))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root != root[root]).any():
            root = root[root]
    heads, of = np.unique(root, return_inverse=True)
    out = np.empty((len(heads), 5), np.int64)
    x2 = np.zeros(len(heads), np.int64)
    np.maximum.at(x2, of, end)
    out[:, 0], out[:, 4] = mask.shape[1], np.bincount(of, end - start)
    np.minimum.at(out[:, 0], of, start)
    out[:, 1] = row[heads]
    last = np.zeros(len(heads), np.int64)
    np.maximum.at(last, of, row)
    out[:, 2], out[:, 3] = x2 - out[:, 0], last + 1 - out[:, 1]
    return out


def _cover(n: int, to: int) -> np.ndarray:
    """Share that each of ``n`` places has in each of ``to``."""
    edges = np.arange(to + 1) * (n / to)
    part = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
    return np.maximum(part, 0) * (to / n)


def area_resize(values: np.ndarray, size: tuple[int, int]) -> np.ndarray:
    """Means over the area of each place of ``size`` (width, height), as bytes."""
    out = _cover(values.shape[0], size[1]) @ values.astype(float) @ _cover(values.shape[1], size[0]).T
    return np.rint(out.round(9)).astype(np.uint8)


def white_text(img: np.ndarray, limit: float) -> tuple[np.ndarray, float, np.ndarray]:
    """Mask, bright share and components; over the limit the mask is as it is and has no components."""
    bright = (img >= BRIGHT).all(axis=2)
    bright[: int(bright.shape[0] * TOP)] = False
    share = np.count_nonzero(bright) / bright.size
    if share > limit:
        return bright, share, np.zeros((0, 5), np.int64)
    mask = opened(closed(bright, CLOSE), OPEN)
    return mask, share, components(mask)


# types, not their names: workers import this module, and names are parsed by the driver
_BOXES = ArrayType(StructType([*[StructField(k, IntegerType()) for k in "xywh"], StructField("area", LongType())]))
_TEXT = StructType([StructField("mask", ArrayType(BooleanType())), StructField("small", ArrayType(IntegerType())), StructField("bright", DoubleType()), StructField("components", _BOXES)])


def _lists(rows: list[np.ndarray | None], values: pa.Array) -> pa.Array:
    """A list for each row over one flat array of all their values; None is a null list."""
    ends = np.cumsum([0, *[0 if r is None else len(r) for r in rows]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([*[r is None for r in rows], False])), values)


def _flat(rows: list[np.ndarray | None], empty: np.ndarray) -> np.ndarray:
    return np.concatenate([empty, *[r for r in rows if r is not None]])


@F.arrow_udf(_TEXT)
def _text_of(pixels: pa.Array, width: pa.Array, height: pa.Array, limit: pa.Array) -> pa.Array:
    """Pixels are read where Arrow has them, and results are flat arrays: a batch takes little more than its bytes."""
    masks, smalls, shares, found = [], [], [], []
    for at, (w, h, most) in enumerate(zip(width.to_pylist(), height.to_pylist(), limit.to_pylist(), strict=True)):
        img = image(pixels[at].as_buffer() if pixels[at].is_valid else None, w, h)
        mask, share, boxes = (None, None, None) if img is None else white_text(img, most)
        masks.append(None if img is None else area_resize(mask * np.uint8(255), MASK).ravel() > 0)
        smalls.append(None if img is None else area_resize(gray(img), SMALL).ravel().astype(np.int32))
        shares.append(share)
        found.append(boxes)
    flat = _flat(found, np.zeros((0, 5), np.int64))
    box = pa.StructArray.from_arrays([*[pa.array(flat[:, k].astype(np.int32)) for k in range(4)], pa.array(np.ascontiguousarray(flat[:, 4]))], [*"xywh", "area"])
    parts = [_lists(masks, pa.array(_flat(masks, np.zeros(0, bool)))), _lists(smalls, pa.array(_flat(smalls, np.zeros(0, np.int32)))), pa.array(shares, pa.float64()), _lists(found, box)]
    return pa.StructArray.from_arrays(parts, ["mask", "small", "bright", "components"])


def text_of(pixels: Column, width: Column, height: Column, legacy: bool = False) -> Column:
    """struct(mask, small, bright, components): compact mask, thumbnail, bright share and components of a crop."""
    return _text_of(pixels, width, height, F.lit(0.42 if legacy else 0.32))


@F.pandas_udf(_BOXES)
def _components_of(mask: pd.Series, width: pd.Series, close: pd.Series, open: pd.Series) -> pd.Series:  # noqa: A002
    def one(values, w, c, o):  # noqa: ANN001, ANN202
        if values is None or pd.isna(w) or w <= 0 or not len(values) or len(values) % int(w):
            return None
        m = np.array([bool(v) for v in values]).reshape(-1, int(w))
        return [dict(zip("xywh", map(int, b[:4])), area=int(b[4])) for b in components(opened(closed(m, tuple(c)), tuple(o)))]

    return pd.Series([one(*r) for r in zip(mask, width, close, open, strict=True)])


def components_of(mask: Column, width: Column, close: tuple[int, int] = CLOSE, open: tuple[int, int] = OPEN) -> Column:  # noqa: A002
    """Components of a boolean mask after closing and opening by windows (width, height); null places are false, a size of one changes nothing."""
    size = lambda s: F.array(*[F.lit(n) for n in s])
    return _components_of(mask, width, size(close), size(open))


def enlarge(img: np.ndarray, by: int) -> np.ndarray:
    """Cubic interpolation (a of -0.75) with weights of 2**11; places outside are those of the edge."""
    out = img.astype(np.int64)
    for axis in (1, 0):
        at = (np.arange(img.shape[axis] * by) + 0.5) / by - 0.5
        base = np.floor(at).astype(int)
        near, far = (lambda t: (1.25 * t - 2.25) * t * t + 1), (lambda t: -0.75 * (((t - 5) * t + 8) * t - 4))
        x = at - base
        w = [np.rint(2048 * c).astype(np.int64) for c in (far(x + 1), near(x), near(1 - x))]
        w.append(np.rint(2048 * (1 - far(x + 1) - near(x) - near(1 - x))).astype(np.int64))
        lie = (1, -1) if axis == 1 else (-1, 1)
        taps = [np.take(out, np.clip(base + i - 1, 0, img.shape[axis] - 1), axis) * c.reshape(*lie, *[1] * (img.ndim - 2)) for i, c in enumerate(w)]
        out = sum(taps)
    return np.clip((out + (1 << 21)) >> 22, 0, 255).astype(np.uint8)


def scaled(values: np.ndarray, alpha: float, beta: float) -> np.ndarray:
    out = np.abs(values.astype(np.float32) * np.float32(alpha) + np.float32(beta))
    return np.minimum(np.rint(out), 255).astype(np.uint8)


def two_levels(values: np.ndarray) -> np.ndarray:
    """255 over the level that parts the values best (the first of equal ones), else 0; values of one level are over none."""
    n = np.bincount(values.ravel(), minlength=256).astype(float)
    low, mass, total, all_mass = np.cumsum(n), np.cumsum(n * np.arange(256)), n.sum(), (n * np.arange(256)).sum()
    part = low * (total - low)
    apart = np.divide((all_mass * low - mass * total) ** 2, part, out=np.zeros(256), where=part > 0)
    return np.where(values > int(apart.argmax()), np.uint8(255), np.uint8(0))


def _blurred(values: np.ndarray, weights: np.ndarray, edge: str) -> np.ndarray:
    r = len(weights) // 2
    out = values
    for axis in (1, 0):
        wide = np.pad(out, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode=edge)
        out = sum(wide[(slice(None), slice(i, i + out.shape[1])) if axis == 1 else (slice(i, i + out.shape[0]),)] * w for i, w in enumerate(weights))
    return out


def local_levels(values: np.ndarray, size: int, over: int) -> np.ndarray:
    """255 where a value is more than ``over`` above the Gaussian mean around it, else 0."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma * sigma))
    mean = np.rint(_blurred(values.astype(float), w / w.sum(), "edge"))
    return np.where(values - mean > over, np.uint8(255), np.uint8(0))


def denoised(values: np.ndarray, h: float = 12.0, patch: int = 7, search: int = 21) -> np.ndarray:
    """Means over a search window, weighted by how alike the patches around are: an offset at a time, its patches by summed areas."""
    p, s = patch // 2, search // 2
    wide = np.pad(values.astype(np.int64), p + s, mode="reflect")
    rows, cols = values.shape
    mine = wide[s : s + rows + 2 * p, s : s + cols + 2 * p]
    total, weight = np.zeros(values.shape), np.zeros(values.shape)
    for dy in range(search):
        for dx in range(search):
            other = wide[dy : dy + rows + 2 * p, dx : dx + cols + 2 * p]
            area = np.pad(((mine - other) ** 2).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
            apart = area[patch:, patch:] - area[:-patch, patch:] - area[patch:, :-patch] + area[:-patch, :-patch]
            w = np.exp(-apart / (patch * patch) / (h * h))
            w[w < 0.001] = 0.0
            total += w * other[p : p + rows, p : p + cols]
            weight += w
    return np.floor(total / weight + 0.5).astype(np.uint8)


def yellow(img: np.ndarray) -> np.ndarray:
    """Places of a yellow hue: 30 to 90 degrees in steps of two, neither pale nor dark."""
    b, g, r = (img[:, :, min(i, img.shape[2] - 1)].astype(float) for i in (0, 1, 2))
    top = np.maximum(np.maximum(b, g), r)
    span = top - np.minimum(np.minimum(b, g), r)
    turn = np.where(top == r, g - b, np.where(top == g, b - r + 2 * span, r - g + 4 * span))
    hue = np.floor(30 * turn / np.maximum(span, 1) + 0.5)
    return (hue >= 15) & (hue <= 45) & (np.floor(255 * span / np.maximum(top, 1) + 0.5) >= 45) & (top >= 120)


def style(img: np.ndarray) -> str:
    """``yellow`` or ``white``, whichever letters an image has."""
    return "yellow" if np.count_nonzero(yellow(img)) > 0.35 * np.count_nonzero(gray(img) >= 190) else "white"


# Names of the modes; every other name, "auto" too, is "subtitle".
MODES = ("none", "grayscale", "contrast", "threshold", "adaptive", "denoise", "simple", "subtitle")


def prepare(img: np.ndarray, mode: str, letters: str = "auto") -> np.ndarray:
    """An image as a recogniser is given it in a mode."""
    if mode == "none":
        return img
    if mode in MODES[1:-1]:
        big = enlarge(gray(img), 2 if mode == "simple" else 3)
        if mode == "grayscale":
            return big
        if mode == "contrast":
            return scaled(big, 1.75, 12)
        if mode == "threshold":
            return two_levels(scaled(big, 1.55, 8))
        if mode == "simple":
            return two_levels(scaled(big, 1.35, 10))
        if mode == "adaptive":
            soft = (_blurred(big.astype(np.int64), np.array([1, 2, 1]), "reflect") + 8) >> 4
            return local_levels(soft, 35, 6)
        return local_levels(scaled(denoised(big), 1.55, 10), 35, 6)
    big = enlarge(img, 3)
    if (style(big) if letters == "auto" else letters) == "yellow":
        mask = yellow(big)
    else:
        level = gray(big)
        mask = (level >= 175) | (local_levels(level, 31, 8) > 0)
    mask = np.pad(closed(mask, (2, 2)).astype(np.int64) * 255, 1, mode="reflect")
    sharp = 5 * mask[1:-1, 1:-1] - mask[:-2, 1:-1] - mask[2:, 1:-1] - mask[1:-1, :-2] - mask[1:-1, 2:]
    return np.clip(sharp, 0, 255).astype(np.uint8)


# How far a variant moves its crop, as a share of the height.
SHIFTS = {"crop": 0.0, "crop_up": -0.06, "crop_down": 0.06}


def variant(img: np.ndarray, name: str, letters: str = "auto") -> np.ndarray:
    """An image as ``place:mode`` or ``mode`` has it: moved, its edge repeated, then prepared; ``invert`` is the negative of grayscale."""
    place, _, mode = name.rpartition(":")
    rows = img.shape[0]
    by = round(rows * SHIFTS.get(place, 0.0))
    if by:
        img = img[np.clip(np.arange(rows) - by, 0, rows - 1)]
    return 255 - prepare(img, "grayscale") if mode == "invert" else prepare(img, mode, letters)


_PORTABLE = re.compile(rb"P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+255\s")


def decoded(content: bytes) -> np.ndarray:
    """A portable graymap or pixmap (P5, P6, of 255 levels) as rows, columns and channels."""
    head = _PORTABLE.match(content)
    if head is None:
        raise ValueError("not a binary portable graymap or pixmap of 255 levels")
    w, h, n = int(head[2]), int(head[3]), 1 if head[1] == b"5" else 3
    body = np.frombuffer(content, np.uint8, offset=head.end())
    if w * h == 0 or len(body) < w * h * n:
        raise ValueError(f"{len(body)} bytes for {w} by {h} of {n}")
    return body[: w * h * n].reshape(h, w, n)[:, :, ::-1]


def encoded(img: np.ndarray) -> bytes:
    n = img.shape[2] if img.ndim == 3 else 1
    body = img[:, :, ::-1] if n == 3 else img
    return b"P%d %d %d 255\n" % (6 if n == 3 else 5, img.shape[1], img.shape[0]) + np.ascontiguousarray(body).tobytes()


def portable_variant(content: bytes, name: str) -> bytes:
    """A portable image as a variant has it."""
    return encoded(variant(decoded(content), name))


_IMAGE = StructType([StructField("pixels", BinaryType()), StructField("width", IntegerType()), StructField("height", IntegerType())])


@F.pandas_udf(_IMAGE)
def _prepared(pixels: pd.Series, width: pd.Series, height: pd.Series, mode: pd.Series, letters: pd.Series) -> pd.DataFrame:
    out = []
    for content, w, h, m, s in zip(pixels, width, height, mode, letters, strict=True):
        img = image(content, w, h)
        done = None if img is None else variant(img, m or "subtitle", s or "auto")
        out.append((None, None, None) if done is None else (done.tobytes(), done.shape[1], done.shape[0]))
    return pd.DataFrame(out, columns=["pixels", "width", "height"]).astype({"width": "Int32", "height": "Int32"})


def prepared(pixels: Column, width: Column, height: Column, mode: Column, letters: str = "auto") -> Column:
    """struct(pixels, width, height) of images as a mode or variant has them; what is no image gives nulls, a null mode is "subtitle" (F30)."""
    return _prepared(pixels, width, height, mode, F.lit(letters))
