"""Pixel features, computed by NumPy kernels over stacks of pictures inside Arrow batches.

A table of pictures has columns height, width and either `data` (bytes, with `channels`, blue first) or
`pixels` (grey values). Spark partitions the pictures; a task stacks those of one shape, a bounded number of pixels at a time, and a kernel
works along the first axis and returns a few columns, a value a picture. All scores are ordinary columns over them. Sample before calling: filters do not move
through a Python step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of one stack; a kernel's temporary arrays take about 200 bytes for each. A larger picture is a stack of its own.
STACK_PIXELS = 1 << 19
_GREY = np.array([0.114, 0.587, 0.299])


def _picture(row) -> np.ndarray:
    """Height x width x channels array of one row."""
    if hasattr(row, "pixels"):
        return np.asarray(row.pixels, dtype=np.float64).reshape(row.height, row.width, 1)
    return np.frombuffer(row.data, dtype=np.uint8).astype(np.float64).reshape(row.height, row.width, -1)


def _stacked(kernel: Callable[[np.ndarray], tuple]) -> Callable[[np.ndarray], tuple]:
    """Let a kernel of stacks take a single picture as well, and give its values."""

    @wraps(kernel)
    def run(pictures: np.ndarray) -> tuple:
        if pictures.ndim == 4:
            return kernel(pictures)
        return tuple(column[0] for column in kernel(pictures[None]))

    return run


def _grey(pictures: np.ndarray) -> np.ndarray:
    return pictures[..., 0] if pictures.shape[-1] == 1 else np.rint(pictures[..., :3] @ _GREY)


def _padded(grey: np.ndarray, by: int) -> np.ndarray:
    edges = [(0, 0)] * (grey.ndim - 2) + [(by, by)] * 2
    return np.pad(grey, edges, mode="reflect" if min(grey.shape[-2:]) > 1 else "edge")


def _filter(grey: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation with a small kernel, tap by tap."""
    h, w = grey.shape[-2:]
    padded, out = _padded(grey, kernel.shape[0] // 2), np.zeros(grey.shape)
    for (i, j), tap in np.ndenumerate(kernel):
        if tap:
            out += tap * padded[..., i : i + h, j : j + w]
    return out


def _correlated(grey: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Correlation of a stack with a kernel, or a stack of kernels, where these fit in whole, by Fourier transforms."""
    size, inner = grey.shape[-2:], kernel.shape[-2:]
    spectrum = np.fft.rfft2(grey) * np.conj(np.fft.rfft2(kernel, s=size))
    return np.fft.irfft2(spectrum, s=size)[..., : size[0] - inner[0] + 1, : size[1] - inner[1] + 1]


_LAPLACE = np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], dtype=np.float64)
_SOBEL_X = np.array([[-1, 0, 1], [-2, 0, 2], [-1, 0, 1]], dtype=np.float64)
_PLANE = (-2, -1)


def _gradient(grey: np.ndarray) -> np.ndarray:
    return np.hypot(_filter(grey, _SOBEL_X), _filter(grey, _SOBEL_X.T))


def _edges(grey: np.ndarray, limit: float = 150.0) -> np.ndarray:
    """Pixels with a strong gradient; stands in for a contour follower."""
    return _gradient(grey) > limit


def _resample(length: int, target: int) -> np.ndarray:
    """Area-average matrix from `length` samples to `target`."""
    edges = np.linspace(0, length, target + 1)
    overlap = np.minimum(edges[1:, None], np.arange(1, length + 1)) - np.maximum(edges[:-1, None], np.arange(length))
    return np.clip(overlap, 0, None) * target / length


def _shrink(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    return _resample(grey.shape[-2], height) @ grey @ _resample(grey.shape[-1], width).T


def _cosines(n: int) -> np.ndarray:
    """Orthonormal DCT-II matrix."""
    k = np.arange(n)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n)) * np.sqrt(2 / n)
    basis[0] /= np.sqrt(2)
    return basis


def _hex(bits: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in np.packbits(bits.reshape(len(bits), -1).astype(np.uint8), axis=1)]


@_stacked
def perceptual_hashes(pictures: np.ndarray) -> tuple:
    grey = _grey(pictures)
    wide, small = _shrink(grey, 8, 9), _shrink(grey, 8, 8)
    basis = _cosines(32)
    low = (basis @ _shrink(grey, 32, 32) @ basis.T)[:, :8, :8]
    above = lambda values, middle: _hex(values > middle(values, axis=_PLANE, keepdims=True))
    return (_hex(np.round(wide[:, :, 1:] - wide[:, :, :-1], 6) > 0), above(small, np.mean), above(low, np.median), above(small, np.median))


@_stacked
def picture_statistics(pictures: np.ndarray) -> tuple:
    grey = _grey(pictures)
    brightness, deviation = grey.mean(axis=_PLANE), grey.std(axis=_PLANE)
    ratio = np.divide(deviation, brightness, out=np.zeros(len(grey)), where=brightness > 0)
    return (brightness, deviation, grey.min(axis=_PLANE), grey.max(axis=_PLANE), ratio,
            pictures.mean(axis=(1, 2)).tolist(), pictures.std(axis=(1, 2)).tolist(), _edges(grey).mean(axis=_PLANE), _gradient(grey).var(axis=_PLANE))


@_stacked
def sharpness(pictures: np.ndarray) -> tuple:
    grey = _grey(pictures)
    return (_filter(grey, _LAPLACE).var(axis=_PLANE), grey.mean(axis=_PLANE), grey.std(axis=_PLANE))


@_stacked
def spectral_texture(pictures: np.ndarray) -> tuple:
    """High-frequency share, autocorrelation spread and texture variance."""
    grey = _grey(pictures)
    h, w = grey.shape[-2:]
    spectrum = np.log(np.abs(np.fft.fftshift(np.fft.fft2(grey), axes=_PLANE)) + 1)
    y, x = np.ogrid[:h, :w]
    high = (x - w // 2) ** 2 + (y - h // 2) ** 2 > (min(h, w) * 0.3) ** 2
    share = (spectrum[:, high].mean(axis=1) if high.any() else 0.0) / (spectrum.mean(axis=_PLANE) + 1e-8)
    half = max(8, min(32, h // 4, w // 4)) // 2
    core = grey[:, max(0, h // 2 - half): h // 2 + half, max(0, w // 2 - half): w // 2 + half]
    frame = [(0, 0), *((n // 2, (n - 1) // 2) for n in core.shape[1:])]
    auto = _correlated(np.pad(grey, frame), core)
    return (share, auto.std(axis=_PLANE) / (auto.mean(axis=_PLANE) + 1e-8), _uniform_patterns(grey).var(axis=_PLANE))


def _uniform_patterns(grey: np.ndarray) -> np.ndarray:
    """Rotation-invariant uniform patterns of eight points on the unit circle, interpolated, zero outside."""
    h, w = grey.shape[-2:]
    padded = np.pad(grey, [(0, 0)] * (grey.ndim - 2) + [(2, 2)] * 2)
    points = []
    for i in range(8):
        dy, dx = -np.sin(np.pi * i / 4), np.cos(np.pi * i / 4)
        y0, x0 = int(np.floor(round(dy, 9))), int(np.floor(round(dx, 9)))
        fy, fx = round(dy - y0, 9), round(dx - x0, 9)
        at = lambda a, b: padded[..., 2 + y0 + a: 2 + y0 + a + h, 2 + x0 + b: 2 + x0 + b + w]
        points.append((1 - fy) * ((1 - fx) * at(0, 0) + fx * at(0, 1)) + fy * ((1 - fx) * at(1, 0) + fx * at(1, 1)))
    bits = np.stack(points) >= grey - 1e-9
    changes = (bits != np.roll(bits, 1, axis=0)).sum(axis=0)
    return np.where(changes <= 2, bits.sum(axis=0), 9)


def _tiles(pictures: np.ndarray, size: int) -> np.ndarray:
    """Full tiles of every picture, those that end at its border left out: n x tiles x size x size (x channels)."""
    down, across = (len(range(0, n - size, size)) for n in pictures.shape[1:3])
    cut = pictures[:, : down * size, : across * size].reshape(len(pictures), down, size, across, size, *pictures.shape[3:])
    return np.moveaxis(cut, 3, 2).reshape(len(pictures), down * across, size, size, *pictures.shape[3:])


@_stacked
def patches(pictures: np.ndarray, size: int = 16) -> tuple:
    """Edge density and colour consistency of each full patch."""
    tiles = _tiles(pictures, size)
    edges = _edges(_grey(tiles)).mean(axis=_PLANE) if tiles.size else np.zeros(tiles.shape[:2])
    colours = 1 / (1 + tiles.std(axis=(2, 3)).mean(axis=2)) if tiles.size and pictures.shape[3] > 1 else np.ones(tiles.shape[:2])
    return (edges.tolist(), colours.tolist())


@_stacked
def frame_texture(pictures: np.ndarray) -> tuple:
    """Noise, edge density, regularity; neighbour contrast, pattern uniformity, spread of oriented responses."""
    grey = _grey(pictures)
    n, h, w = grey.shape
    box = np.full((5, 5), 1 / 25)
    local = _filter((grey - _filter(grey, box)) ** 2, box)
    contrast = ((grey[:, :, 1:] - grey[:, :, :-1]) ** 2).mean(axis=_PLANE)
    centre = grey[:, 1:-1, 1:-1]
    order = [(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0)]
    codes = np.zeros(centre.shape, np.int64)
    for bit, (a, b) in enumerate(order):
        codes += (grey[:, a : a + h - 2, b : b + w - 2] >= centre).astype(np.int64) << (7 - bit)
    counts = np.bincount((codes + 256 * np.arange(n)[:, None, None]).ravel(), minlength=256 * n).reshape(n, 256)
    share = counts / max(centre[0].size, 1)
    wide = _padded(grey, 10)
    spread = np.var([np.clip(np.rint(_correlated(wide, _gabor(t))), 0, 255).std(axis=_PLANE) for t in (0, 45, 90, 135)], axis=0)
    return (_filter(grey, _LAPLACE).var(axis=_PLANE), _edges(grey).mean(axis=_PLANE) * 255, 1 / (1 + local.std(axis=_PLANE)), contrast, (share**2).sum(axis=1), spread)


def _gabor(degrees: float, size: int = 21, sigma: float = 5.0, wave: float = 2 * np.pi / 3, ratio: float = 0.5) -> np.ndarray:
    half, angle = size // 2, np.radians(degrees)
    y, x = np.mgrid[half:-half - 1:-1, half:-half - 1:-1]
    along, across = x * np.cos(angle) + y * np.sin(angle), -x * np.sin(angle) + y * np.cos(angle)
    return np.exp(-(along**2 + (ratio * across) ** 2) / (2 * sigma**2)) * np.cos(2 * np.pi * along / wave)


@_stacked
def block_artifacts(pictures: np.ndarray) -> tuple:
    """Mean variance of the 8x8 block coefficients (first row and column left out) and mean step at block borders."""
    grey = _grey(pictures)
    basis, blocks = _cosines(8), _tiles(grey, 8)
    variance = (basis @ blocks @ basis.T)[..., 1:, 1:].var(axis=_PLANE).mean(axis=1) if blocks.size else np.zeros(len(grey))
    rows = np.abs(grey[:, 7::8] - grey[:, 6::8][:, : grey[:, 7::8].shape[1]])
    cols = np.abs(grey[:, :, 7::8] - grey[:, :, 6::8][:, :, : grey[:, :, 7::8].shape[2]])
    return (variance, (rows.mean(axis=_PLANE) + cols.mean(axis=_PLANE)) / 2 if rows.size and cols.size else np.zeros(len(grey)))


@_stacked
def model_input(pictures: np.ndarray, size: int = 224) -> tuple:
    """Resized, scaled and channel-normalised picture, red plane first."""
    planes = (0,) if pictures.shape[3] == 1 else (2, 1, 0)
    out = np.empty((len(pictures), 3, size, size), np.float32)
    for i, picture in enumerate(pictures):  # one at a time: its planes stay in the processor's cache
        shrunk = [_shrink(picture[..., c], size, size) / 255 for c in planes]
        for c, (m, s) in enumerate(zip((0.485, 0.456, 0.406), (0.229, 0.224, 0.225))):
            out[i, c] = (shrunk[c % len(shrunk)] - m) / s
    return (out.reshape(len(pictures), -1),)


Kernel = Callable[[np.ndarray], tuple]
FEATURES: dict[str, tuple[Kernel, str]] = {
    "hashes": (perceptual_hashes, "dhash string, ahash string, phash string, whash string"),
    "statistics": (picture_statistics, "mean_brightness double, std_brightness double, min_brightness double, max_brightness double, contrast_ratio double, "
                                       "channel_means array<double>, channel_stds array<double>, edge_density double, texture_variance double"),
    "sharpness": (sharpness, "sharpness double, brightness double, contrast double"),
    "spectral": (spectral_texture, "spectral_ratio double, periodic_score double, texture_variance double"),
    "patches": (patches, "edge_densities array<double>, colour_consistencies array<double>"),
    "texture": (frame_texture, "noise double, edge_density double, regularity double, glcm_contrast double, lbp_uniformity double, gabor_variance double"),
    "blocks": (block_artifacts, "dct_variance double, blocking double"),
    "model_input": (model_input, "model_input array<float>"),
}
#: Features of many numbers a picture: they go to Spark as they are, as through pandas each number becomes an object.
FLAT = {"model_input"}
#: Rows of results that a task holds at once; a model input takes 600 KB.
OUTPUT_ROWS = {name: 32 if name == "model_input" else 2048 for name in FEATURES}


def _features(kernel: Kernel, pictures: list[np.ndarray], columns: int) -> list[list]:
    """Columns of values, in the order of the pictures; those of one shape go to the kernel together."""
    shapes: dict[tuple, list[int]] = {}
    for i, picture in enumerate(pictures):
        shapes.setdefault(picture.shape, []).append(i)
    out: list[list] = [[None] * len(pictures) for _ in range(columns)]
    for shape, places in shapes.items():
        step = max(STACK_PIXELS // (shape[0] * shape[1]), 1)
        for at in range(0, len(places), step):
            some = places[at : at + step]
            for column, values in zip(out, kernel(np.stack([pictures[i] for i in some]))):
                for i, value in zip(some, values.tolist() if isinstance(values, np.ndarray) and values.ndim == 1 else values):
                    column[i] = value
    return out


def _flat_lists(rows: list[np.ndarray]) -> pa.ListArray:
    """A list of numbers a picture; what is not a number is null, as through pandas."""
    sizes = [len(row) for row in rows]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(rows), from_pandas=True))


def with_features(pictures: DataFrame, feature: str, keys: list[str]) -> DataFrame:
    """The key columns of every readable picture and the chosen features."""
    kernel, fields = FEATURES[feature]
    names = [f.split()[0] for f in fields.split(", ")]
    inputs = [c for c in ("height", "width", "channels", "data", "pixels") if c in pictures.columns]
    types = dict(pictures.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + fields

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), OUTPUT_ROWS[feature]):
                part = batch.iloc[at:at + OUTPUT_ROWS[feature]]
                values = _features(kernel, [_picture(row) for row in part.itertuples(index=False)], len(names))
                yield pd.concat([part[keys].reset_index(drop=True), pd.DataFrame(dict(zip(names, values)), columns=names)], axis=1)

    def run_flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, OUTPUT_ROWS[feature]):
                part = batch.slice(at, OUTPUT_ROWS[feature])
                columns = _features(kernel, [_picture(row) for row in part.to_pandas().itertuples(index=False)], len(names))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *map(_flat_lists, columns)], [*keys, *names])

    rows = pictures.filter(F.col("height") > 0).select(*keys, *inputs)
    return rows.mapInArrow(run_flat, schema) if feature in FLAT else rows.mapInPandas(run, schema)


def capped(x: Column) -> Column:
    return F.least(x, F.lit(1.0))


def frame_quality() -> Column:
    """Quality of a frame from its `sharpness` features."""
    return capped(F.col("sharpness") / 1000 + F.col("contrast") / 255)


def is_high_quality(sharp: Column, bright: Column, contrast: Column, side: Column) -> Column:
    return (sharp > 10) & (bright > 20) & (bright < 250) & (contrast > 5) & (side >= 32)


def spectral_score(threshold: float = 0.15) -> Column:
    test = lambda condition, weight: F.when(condition, weight).otherwise(0.0)
    return (test(F.col("spectral_ratio") > threshold, 0.4) + test(F.col("periodic_score") > 0.5, 0.3) + test(F.col("texture_variance") < 10, 0.3))


def _array_deviation(values: str) -> Column:
    total = lambda f: F.aggregate(values, F.lit(0.0), lambda acc, v: acc + f(v))
    n = F.nullif(F.size(values), F.lit(0))
    mean_square, mean = total(lambda v: v * v) / n, total(lambda v: v) / n
    return F.sqrt(F.greatest(mean_square - mean * mean, F.lit(0.0)))


def patch_score(compression: float = 0.25) -> Column:
    """Uniformity of the patches, with the constant compression share; clipped to [0, 1]."""
    uniform = F.coalesce(0.6 * (1 - _array_deviation("edge_densities")) + 0.4 * (1 - _array_deviation("colour_consistencies")), F.lit(0.0))
    return F.greatest(F.lit(0.0), capped(0.7 * uniform + 0.3 * compression))


def spatial_score() -> Column:
    return capped(F.col("noise") / 10000) * 0.4 + capped(F.col("edge_density") * 10) * 0.3 + F.col("regularity") * 0.3


def texture_score() -> Column:
    return capped(F.col("glcm_contrast") / 10000) * 0.4 + F.col("lbp_uniformity") * 0.3 + capped(F.col("gabor_variance") / 1000) * 0.3


def compression_score() -> Column:
    return capped(F.col("dct_variance") / 1000) * 0.6 + capped(F.col("blocking") / 50) * 0.4
