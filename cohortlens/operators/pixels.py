"""Item features from pixels: crop, resize, grey grid, histograms, edges, regions, descriptors.

Every operator maps an item row to an item row (no shuffle); numpy works on all items of an Arrow batch at once.  A grid
is a flat, row-major ``array<double>`` of grey values, an image its RGB values interleaved, both in [0, 1].
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scale import spread
from ..functions.vectors import VECTOR, doubles

# Appearance and embedding grid sizes, embedding width.
APPEARANCE_SIZE, EMBED_SIZE, EMBEDDING_WIDTH = 64, 32, 1073
DESCRIPTORS = [
    "luminance", "contrast", "warmth", "saturation", "edge_density", "symmetry",
    "upper_band_darkness", "middle_luminance", "lower_luminance",
]


def grids(values: pd.Series, channels: int = 1) -> np.ndarray:
    """Square grids of one batch as (items, side, side[, channels]); all items of a column have one size."""
    stacked = np.stack(values.to_list()).astype(np.float64)
    side = int(round((stacked.shape[1] / channels) ** 0.5))
    return stacked.reshape(len(values), side, side) if channels == 1 else stacked.reshape(len(values), side, side, channels)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms < 1e-12, 1.0, norms)


def gradients(grey: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertical and horizontal gradients: central differences inside, one-sided at the border."""
    return np.gradient(grey, axis=1), np.gradient(grey, axis=2)


def standardised(grey: np.ndarray) -> np.ndarray:
    """Zero mean and unit population deviation; an even grid is only centred."""
    flat = grey.reshape(len(grey), -1)
    spread = flat.std(axis=1, keepdims=True)
    return (flat - flat.mean(axis=1, keepdims=True)) / np.where(spread < 1e-6, 1.0, spread)


def binned(values: np.ndarray, bins: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Per-row histogram of values in [0, 1] (the last bin is closed), counts or summed weights."""
    rows = np.arange(len(values))[:, None]
    inside = (values >= 0.0) & (values <= 1.0)
    index = np.minimum((np.clip(values, 0.0, 1.0) * bins).astype(int), bins - 1)
    amount = inside.astype(float) if weights is None else weights * inside
    return np.bincount((rows * bins + index).ravel(), amount.ravel(), minlength=len(values) * bins).reshape(len(values), bins)


def colour_histogram(rgb: np.ndarray, bins: int = 8) -> np.ndarray:
    """Density histogram of each channel, concatenated, unit length."""
    parts = []
    for channel in range(3):
        counts = binned(rgb[..., channel].reshape(len(rgb), -1), bins)
        total = counts.sum(axis=1, keepdims=True)
        parts.append(counts / np.where(total == 0, 1.0, total) * bins)
    return unit_rows(np.concatenate(parts, axis=1))


def edge_features(grey: np.ndarray) -> np.ndarray:
    """Eight magnitude-weighted orientation bins and mean, deviation, p75, p90 of the magnitude, unit length."""
    gy, gx = gradients(grey)
    magnitude = np.sqrt(gx * gx + gy * gy).reshape(len(grey), -1)
    angle = ((np.arctan2(gy, gx) + np.pi) / (2 * np.pi)).reshape(len(grey), -1)
    summary = [magnitude.mean(axis=1), magnitude.std(axis=1), np.percentile(magnitude, 75, axis=1), np.percentile(magnitude, 90, axis=1)]
    return unit_rows(np.concatenate([binned(angle, 8, magnitude), np.stack(summary, axis=1)], axis=1))


def region_features(grey: np.ndarray, rgb: np.ndarray) -> np.ndarray:
    """Mean and deviation of the horizontal thirds and vertical halves, then the channel means."""
    h, w = grey.shape[1:]
    bands = [np.s_[:, : h // 3], np.s_[:, h // 3 : 2 * h // 3], np.s_[:, 2 * h // 3 :], np.s_[:, :, : w // 2], np.s_[:, :, w // 2 :]]
    columns = [stat(grey[band], axis=(1, 2)) for band in bands for stat in (np.mean, np.std)]
    return np.stack(columns + [rgb[..., c].mean(axis=(1, 2)) for c in range(3)], axis=1)


def described(grey: np.ndarray, rgb: np.ndarray) -> dict[str, np.ndarray]:
    """The nine descriptors of every item of a batch."""
    h, w = grey.shape[1:]
    half = w // 2
    mirror = grey[:, :, ::-1][:, :, :half]
    gy, gx = gradients(grey)
    band = lambda low, high: grey[:, int(h * low) : int(h * high) if high else h].mean(axis=(1, 2))
    return {
        "luminance": grey.mean(axis=(1, 2)),
        "contrast": grey.std(axis=(1, 2)),
        "warmth": rgb[..., 0].mean(axis=(1, 2)) - rgb[..., 2].mean(axis=(1, 2)),
        "saturation": (rgb.max(axis=3) - rgb.min(axis=3)).mean(axis=(1, 2)),
        "edge_density": np.sqrt(gx * gx + gy * gy).mean(axis=(1, 2)),
        "symmetry": 1.0 - np.abs(grey[:, :, :half] - mirror).mean(axis=(1, 2)),
        "upper_band_darkness": 1.0 - band(0.20, 0.48),
        "middle_luminance": band(0.32, 0.68),
        "lower_luminance": band(0.62, None),
    }


@F.pandas_udf(VECTOR)
def standardise(grey: pd.Series) -> pd.Series:
    return pd.Series(list(standardised(grids(grey))))


@F.pandas_udf(VECTOR)
def colour_histograms(rgb: pd.Series) -> pd.Series:
    return pd.Series(list(colour_histogram(grids(rgb, 3))))


@F.pandas_udf(VECTOR)
def edges(grey: pd.Series) -> pd.Series:
    return pd.Series(list(edge_features(grids(grey))))


@F.pandas_udf(VECTOR)
def regions(grey: pd.Series, rgb: pd.Series) -> pd.Series:
    return pd.Series(list(region_features(grids(grey), grids(rgb, 3))))


@F.pandas_udf(doubles(DESCRIPTORS))
def descriptors(grey: pd.Series, rgb: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(described(grids(grey), grids(rgb, 3)))


@F.pandas_udf(doubles(DESCRIPTORS))
def appearance_descriptors(rgb: pd.Series) -> pd.DataFrame:
    """Descriptors of an aggregate image: values clipped to [0, 1], grey as the channel mean."""
    clipped = np.clip(grids(rgb, 3), 0.0, 1.0)
    return pd.DataFrame(described(clipped.mean(axis=3), clipped))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    near, far = ((a + 2) * x - (a + 3)) * x * x + 1, ((x - 5) * x + 8) * x * a - 4 * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


@lru_cache(maxsize=256)
def resize_weights(source: int, target: int, kernel, reach: float) -> np.ndarray:
    """(target, source) weights of a resize that widens the kernel when shrinking."""
    ratio = source / target
    stretch = max(ratio, 1.0)
    centres = (np.arange(target) + 0.5) * ratio
    offsets = (np.arange(source)[None, :] + 0.5 - centres[:, None]) / stretch
    weights = np.where(np.abs(offsets) < reach, kernel(offsets), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resized(image: np.ndarray, side: int, kernel, reach: float) -> np.ndarray:
    """One 8-bit image (height, width, channels) to a square, width first, each pass rounded to 8 bits."""
    byte = lambda x: np.clip(np.floor(x + 0.5), 0, 255)
    across = resize_weights(image.shape[1], side, kernel, reach)
    wide = byte(np.matmul(across, image))  # (side, width) x (height, width, channels)
    down = resize_weights(image.shape[0], side, kernel, reach)
    return byte(np.tensordot(down, wide, axes=(1, 0)))


def centre_square(image: np.ndarray) -> np.ndarray:
    height, width = image.shape[:2]
    side = min(height, width)
    top, left = (height - side) // 2, (width - side) // 2
    return image[top : top + side, left : left + side]


def _normalised(rgb: np.ndarray, crop: str) -> tuple[np.ndarray, np.ndarray]:
    """(64x64 RGB, 32x32 grey), both 8-bit valued."""
    square = centre_square(rgb) if crop == "center" else rgb
    appearance = resized(square.astype(float), APPEARANCE_SIZE, _lanczos, 3.0)
    grey = np.floor((appearance @ np.array([19595.0, 38470.0, 7471.0]) + 32768.0) / 65536.0)
    return appearance, resized(grey[..., None], EMBED_SIZE, _cubic, 2.0)[..., 0]


PIXELS = T.ArrayType(T.FloatType())
FEATURES = T.StructType(
    [
        T.StructField("appearance", PIXELS),
        T.StructField("grey", PIXELS),
        T.StructField("embedding", VECTOR),
        *doubles(DESCRIPTORS).fields,
        T.StructField("reason", T.StringType()),
    ]
)
_CHUNK = 64  # items vectorised together; bounds a task's memory whatever the Arrow batch size


def _lists(matrix: np.ndarray, kind: pa.DataType, bad: np.ndarray) -> pa.Array:
    flat = matrix.reshape(len(matrix), -1)
    offsets = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], mask=np.append(bad, False))
    return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel(), kind))


def _pixels(bgr: bytes, width: int, height: int, channels: int, crop: str) -> tuple[np.ndarray, np.ndarray]:
    pixels = np.frombuffer(bgr, dtype=np.uint8).reshape(height, width, channels)
    return _normalised(np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[..., 2::-1], crop)


def _features(rows: list[dict], crop: str) -> tuple[list[pa.Array], list[str | None]]:
    rgb = np.zeros((len(rows), APPEARANCE_SIZE, APPEARANCE_SIZE, 3))
    grey = np.zeros((len(rows), EMBED_SIZE, EMBED_SIZE))
    reasons = [row["reason"] for row in rows]
    for i, row in enumerate(rows):
        if reasons[i] is None:
            try:
                rgb[i], grey[i] = _pixels(row["bgr"], row["width"], row["height"], row["channels"], crop)
            except (TypeError, ValueError) as error:  # a broken item is reported, the batch goes on
                reasons[i] = str(error)
    rgb, grey = rgb / 255.0, grey / 255.0
    bad = np.array([r is not None for r in reasons])
    embedding = unit_rows(
        np.concatenate([standardised(grey), colour_histogram(rgb), edge_features(grey), region_features(grey, rgb)], axis=1)
    )
    lists = [_lists(rgb, pa.float32(), bad), _lists(grey, pa.float32(), bad), _lists(embedding, pa.float64(), bad)]
    return lists + [pa.array(values, mask=bad) for values in described(grey, rgb).values()], reasons


def vectorise_items(images: DataFrame, keys: list[str], crop: str = "center") -> DataFrame:
    """Embedding, appearance and descriptors of decoded items (``width``, ``height``, ``channels``, ``bgr`` bytes).

    Standardised grid (1024) + colour histogram (24) + edges (12) + regions (13), unit length.  An item without usable
    pixels keeps its row with a reason.
    """
    if crop not in ("center", "none"):
        raise ValueError(f"unsupported crop mode: {crop}")
    source = spread(images.select(*keys, "width", "height", "channels", "bgr", "reason"))
    schema = T.StructType([*images.select(*keys).schema.fields, *FEATURES.fields])
    names = [f.name for f in FEATURES.fields]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(start, _CHUNK)
                columns, reasons = _features(part.select(["width", "height", "channels", "bgr", "reason"]).to_pylist(), crop)
                kept = [part.column(part.schema.get_field_index(k)) for k in keys]
                yield pa.RecordBatch.from_arrays([*kept, *columns, pa.array(reasons, pa.string())], names=[*keys, *names])

    return source.mapInArrow(run, schema)
