"""Numeric kernels over small matrices (grey images), in numpy, and pandas UDFs that apply them to array columns.

Every kernel takes images of one size on its last two axes and any number of them
on the axes before, so that a batch is one call.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# Kernels go to the executors by value, so that these don't need the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dct_matrix(n: int) -> np.ndarray:
    """Orthonormal DCT-II."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


def log_dct(grey: np.ndarray) -> np.ndarray:
    rows, columns = dct_matrix(grey.shape[-2]), dct_matrix(grey.shape[-1])
    return np.log(np.abs(rows @ grey @ columns.T) + 1e-8)


def spectrum(grey: np.ndarray) -> np.ndarray:
    """Centred log-magnitude of the two-dimensional Fourier transform."""
    return np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(grey), axes=(-2, -1))))


def luminance(rgb: np.ndarray) -> np.ndarray:
    return rgb[..., :3] @ np.array([0.299, 0.587, 0.114])


def cubic_weights(old: int, new: int) -> np.ndarray:
    """new x old: how a line of old pixels becomes one of new pixels, by the cubic of parameter -1/2; for fewer pixels it is widened."""
    scale = old / new
    wide = max(scale, 1.0)
    t = np.abs((np.arange(old)[None, :] + 0.5 - (np.arange(new)[:, None] + 0.5) * scale) / wide)
    w = np.where(t < 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))
    return w / w.sum(axis=1, keepdims=True)


def resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bicubic, pixel centres aligned; what lies beyond the border has no weight."""
    return cubic_weights(grey.shape[-2], height) @ grey @ cubic_weights(grey.shape[-1], width).T


def centre_crop(grey: np.ndarray, size: int) -> np.ndarray:
    """A square from the middle; smaller images are enlarged by their shortest side first."""
    if min(grey.shape[-2:]) < size:
        grey = shortest_side(grey, size)
    y, x = (grey.shape[-2] - size) // 2, (grey.shape[-1] - size) // 2
    return grey[..., y : y + size, x : x + size]


def shortest_side(grey: np.ndarray, size: int) -> np.ndarray:
    h, w = grey.shape[-2:]
    scale = size / min(h, w)
    return resize(grey, max(size, round(h * scale)), max(size, round(w * scale)))


def _windows(grey: np.ndarray, h: int, w: int) -> np.ndarray:
    """The h x w surroundings of each pixel, on two more axes; the border is repeated."""
    around = [(0, 0)] * (grey.ndim - 2) + [(h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2)]
    return np.lib.stride_tricks.sliding_window_view(np.pad(grey, around, mode="edge"), (h, w), axis=(-2, -1))


def convolve(grey: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Same-size correlation; the border is repeated."""
    return np.einsum("...kl,kl->...", _windows(grey, *kernel.shape), kernel)


def gaussian(sigma: float) -> np.ndarray:
    r = max(1, int(4 * sigma + 0.5))
    g = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma**2))
    return np.outer(g, g) / g.sum() ** 2


def residual(grey: np.ndarray, size: int = 32) -> np.ndarray:
    """What a Gaussian of deviation 1 takes away, resized."""
    return resize(grey - convolve(grey, gaussian(1.0)), size, size)


def blur(grey: np.ndarray, sigma: float) -> np.ndarray:
    return convolve(grey, gaussian(sigma))


def sharpen(grey: np.ndarray, amount: float = 1.0) -> np.ndarray:
    return grey + amount * (grey - blur(grey, 1.0))


def round_trip(grey: np.ndarray, factor: float) -> np.ndarray:
    h, w = grey.shape[-2:]
    return resize(resize(grey, max(1, round(h * factor)), max(1, round(w * factor))), h, w)


#: The luminance table of the JPEG standard's annex K, by rows.
JPEG_LUMINANCE = np.array(
    [
        [16, 11, 10, 16, 24, 40, 51, 61],
        [12, 12, 14, 19, 26, 58, 60, 55],
        [14, 13, 16, 24, 40, 57, 69, 56],
        [14, 17, 22, 29, 51, 87, 80, 62],
        [18, 22, 37, 56, 68, 109, 103, 77],
        [24, 35, 55, 64, 81, 104, 113, 92],
        [49, 64, 78, 87, 103, 121, 120, 101],
        [72, 92, 95, 98, 112, 100, 103, 99],
    ]
)


def nearest(x: np.ndarray) -> np.ndarray:
    """The nearest whole numbers; what lies half-way, but for the last bits, goes up."""
    return np.floor(x + 0.5 + 1e-7)


def jpeg(grey: np.ndarray, quality: int, low: float = 0.0, high: float = 255.0) -> np.ndarray:
    """What a JPEG round trip leaves of the grey values, low to high standing for 0 to 255: 8 x 8 cosine blocks, quantised and rounded."""
    scale = 5000 / quality if quality < 50 else 200 - 2 * quality
    steps = np.clip(np.floor((JPEG_LUMINANCE * scale + 50) / 100), 1, 255)
    h, w = grey.shape[-2:]
    x = nearest(np.clip((grey - low) / (high - low), 0, 1) * 255) - 128
    x = np.pad(x, [(0, 0)] * (grey.ndim - 2) + [(0, -h % 8), (0, -w % 8)], mode="edge")
    blocks = x.reshape(*x.shape[:-2], x.shape[-2] // 8, 8, x.shape[-1] // 8, 8).swapaxes(-3, -2)
    m = dct_matrix(8)
    blocks = m.T @ (nearest(m @ blocks @ m.T / steps) * steps) @ m
    out = np.clip(nearest(blocks.swapaxes(-3, -2).reshape(x.shape)[..., :h, :w] + 128), 0, 255)
    return low + out / 255 * (high - low)


#: Named variants and perturbations of a grey image with values from -1 to 1.
VARIANTS = {"scaled": lambda g: resize(g, 8, 8), "cropped": lambda g: centre_crop(g, 8), "aspect": lambda g: centre_crop(shortest_side(g, 8), 8)}
PERTURBATIONS = {
    "jpeg30": lambda g: jpeg(g, 30, -1.0, 1.0),
    "jpeg50": lambda g: jpeg(g, 50, -1.0, 1.0),
    "jpeg70": lambda g: jpeg(g, 70, -1.0, 1.0),
    "blur1": lambda g: blur(g, 1.0),
    "blur2": lambda g: blur(g, 2.0),
    "resize75": lambda g: round_trip(g, 0.75),
    "resize50": lambda g: round_trip(g, 0.5),
    "sharpen": sharpen,
}


def fingerprint(grey: np.ndarray, size: int = 32, mode: str = "both") -> np.ndarray:
    """Residual, spectrum or both (in this order), as one vector of length 1."""
    blocks = {"residual": [residual], "spectrum": [lambda g, n: resize(spectrum(g), n, n)], "both": [residual, lambda g, n: resize(spectrum(g), n, n)]}[mode]
    x = np.concatenate([b(grey, size).reshape(*grey.shape[:-2], size * size) for b in blocks], axis=-1)
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def tile_energy(grey: np.ndarray, tiles: int = 8) -> np.ndarray:
    """Mean absolute AC coefficient of each tile of a grid."""
    h, w = max(grey.shape[-2] // tiles, 2), max(grey.shape[-1] // tiles, 2)
    grey = resize(grey, h * tiles, w * tiles)
    blocks = grey.reshape(*grey.shape[:-2], tiles, h, tiles, w).swapaxes(-3, -2)
    c = np.abs(dct_matrix(h) @ blocks @ dct_matrix(w).T)
    return (c.sum(axis=(-2, -1)) - c[..., 0, 0]) / (h * w - 1)


def difference_hash(grey: np.ndarray) -> int:
    """64 bits of one image, as a signed number: whether each pixel of an 8 x 9 reduction is darker than its right neighbour."""
    small = resize(grey, 8, 9)
    bits = (small[:, 1:] > small[:, :-1]).ravel()
    value = int("".join("1" if b else "0" for b in bits), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def high_pass_bank() -> np.ndarray:
    """30 zero-sum 5 x 5 kernels: differences of order one to three, squares and edges, turned to all their directions."""

    def placed(values: dict[tuple[int, int], float]) -> np.ndarray:
        k = np.zeros((5, 5))
        for (y, x), v in values.items():
            k[2 + y, 2 + x] = v
        return k

    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    first = [placed({(0, 0): -1, s: 1}) for s in steps]
    second = [placed({(0, 0): -2, s: 1, (-s[0], -s[1]): 1}) for s in steps[:4]]
    third = [placed({(-s[0], -s[1]): -1, (0, 0): 3, s: -3, (2 * s[0], 2 * s[1]): 1}) for s in steps]
    square3 = np.pad(np.array([[-1.0, 2, -1], [2, -4, 2], [-1, 2, -1]]), 1)
    edge3 = np.pad(np.array([[-1.0, 2, -1], [2, -4, 2], [0, 0, 0]]), 1)
    square5 = np.array([[-1.0, 2, -2, 2, -1], [2, -6, 8, -6, 2], [-2, 8, -12, 8, -2], [2, -6, 8, -6, 2], [-1, 2, -2, 2, -1]])
    edge5 = square5.copy()
    edge5[3:] = 0
    edges = [np.rot90(e, k) for e in (edge3, edge5) for k in range(4)]
    return np.stack([*first, *second, *third, square3, square5, *edges])


#: Places in the bank whose responses are paired: first with second differences of one direction, and two directions of each order.
EXTREMES = [(0, 8), (1, 9), (2, 10), (3, 11), (0, 1), (8, 9)]


def high_pass_response(grey: np.ndarray, extremes: bool = False) -> np.ndarray:
    """Mean absolute response to each kernel of the bank; with extremes, also to the smaller and the larger of each EXTREMES pair."""
    responses = np.moveaxis(np.einsum("...kl,nkl->...n", _windows(grey, 5, 5), high_pass_bank()), -1, 0)
    means = [np.abs(responses).mean(axis=(-2, -1))]
    if extremes:
        pairs = [f(responses[i], responses[j]) for i, j in EXTREMES for f in (np.minimum, np.maximum)]
        means.append(np.abs(np.stack(pairs)).mean(axis=(-2, -1)))
    return np.moveaxis(np.concatenate(means), 0, -1)


#: Images that go through a kernel at once.
IMAGES = 512


def _stacked(column: pd.Series, height: int, width: int):
    """(places, images) of the arrays of the right length, in parts of at most IMAGES."""
    places = [i for i, x in enumerate(column) if x is not None and len(x) == height * width]
    for at in range(0, len(places), IMAGES):
        part = places[at : at + IMAGES]
        yield part, np.stack([np.asarray(column.iloc[i], float) for i in part]).reshape(len(part), height, width)


def over_array(kernel, height: int, width: int, values: Column) -> Column:
    """Applies a kernel to an array column read as a height x width image; a null, or an array of another length, gives null."""

    @F.pandas_udf("array<double>")
    def run(column: pd.Series) -> pd.Series:
        out: list = [None] * len(column)
        for places, images in _stacked(column, height, width):
            for i, row in zip(places, np.asarray(kernel(images), float).reshape(len(places), -1)):
                out[i] = row
        return pd.Series(out, dtype=object)

    return run(values)


def each_over_array(kernels: dict, height: int, width: int, values: Column) -> Column:
    """The same for several named kernels in one pass: an array of (name, values), to be exploded."""

    @F.pandas_udf("array<struct<name: string, values: array<double>>>")
    def run(column: pd.Series) -> pd.Series:
        out: list = [[{"name": name, "values": None} for name in kernels] for _ in range(len(column))]
        for places, images in _stacked(column, height, width):
            for k, kernel in enumerate(kernels.values()):
                for i, row in zip(places, np.asarray(kernel(images), float).reshape(len(places), -1)):
                    out[i][k]["values"] = row
        return pd.Series(out, dtype=object)

    return run(values)
