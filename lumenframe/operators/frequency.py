"""Fourier transforms: an image's rows are gathered in one task, as the transform needs them all.

An image is the unit of work, so memory is bounded by the largest image, and
images spread over the cluster. A pixel that doesn't exist counts as 0 in a transform.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.expr import Op, atan2, cos, ex, sin, sqrt, when
from .image import KEYS, Img


#: The channel that is 1 where an image has a pixel, else 0.
KNOWN = "known"


def gridwise(img: Img, f, channels: tuple[str, ...], marked: bool = False, known_only: bool = False) -> Img:
    """`f` of each image's channels as arrays (height, width, channels) gives the new channels' arrays.

    Channel `known`, if there, isn't shown to `f`: it says which pixels exist. `marked` adds it to the result; with `known_only` the
    pixels that don't exist don't come back.
    """
    roi, names = img.roi, tuple(c for c in img.channels if c != KNOWN)
    flag = [KNOWN] if KNOWN in img.channels else []
    made = (*channels, KNOWN) if marked else channels

    def run(table: pa.Table) -> pa.Table:
        y, x = (table.column(c).to_numpy() for c in ("y", "x"))
        grid = np.zeros((roi.height, roi.width, len(names)))
        grid[y - roi.y0, x - roi.x0] = np.stack([table.column(c).to_numpy() for c in names], axis=1)
        known = np.zeros(grid.shape[:2])
        known[y - roi.y0, x - roi.x0] = table.column(KNOWN).to_numpy() if flag else 1.0
        out = f(grid)
        if marked:
            out = np.concatenate([out, known[..., None]], axis=-1)
        kept = known > 0 if known_only else np.ones(known.shape, bool)
        ys, xs = (c[kept] for c in np.mgrid[roi.y0 : roi.y0 + out.shape[0], roi.x0 : roi.x0 + out.shape[1]])
        ids = np.full(ys.size, table.column("image_id")[0].as_py())
        values = {c: out[..., i][kept] for i, c in enumerate(made)}
        return pa.table({"image_id": ids, "y": ys.astype(np.int32), "x": xs.astype(np.int32), **values})

    schema = "image_id bigint, y int, x int, " + ", ".join(f"{c} double" for c in made)
    return Img(img.df.select(*KEYS, *names, *flag).groupBy("image_id").applyInArrow(run, schema), roi, made)


def fft(img: Img, channel: str | None = None, marked: bool = False) -> Img:
    """The unitary transform of one channel as channels re and im; `marked` adds which pixels exist, for the way back."""
    one = img.select({"v": F.col(channel or img.channels[0])})

    def run(g):
        t = np.fft.fft2(g[..., 0], norm="ortho")
        return np.stack([t.real, t.imag], axis=-1)

    return gridwise(one, run, ("re", "im"), marked)


def ifft(img: Img) -> Img:
    """Back from channels re and im; with a channel `known`, only the pixels that exist come back."""
    return gridwise(img, lambda g: np.fft.ifft2(g[..., 0] + 1j * g[..., 1], norm="ortho").real[..., None], ("v",), known_only=KNOWN in img.channels)


def to_polar(*kept: str) -> Op:
    """(re, im) to (size, angle in [0, 2 pi)); channels `kept` stay."""
    angle = atan2("im", "re")
    return Op({"size": sqrt(ex("re") * "re" + ex("im") * "im"), "angle": when((angle < 0.0, angle + 2 * math.pi), angle), **{c: c for c in kept}})


def to_complex(*kept: str) -> Op:
    return Op({"re": ex("size") * cos("angle"), "im": ex("size") * sin("angle"), **{c: c for c in kept}})


def _frequencies(h: int, w: int) -> np.ndarray:
    return np.fft.fftfreq(h)[:, None] ** 2 + np.fft.fftfreq(w)[None, :] ** 2


def filtered(img: Img, response) -> Img:
    """Channels multiplied by a response (of squared frequencies in cycles per pixel) in the frequency domain."""

    def run(g):
        r = response(_frequencies(*g.shape[:2]))[..., None]
        return np.fft.ifft2(np.fft.fft2(g, axes=(0, 1)) * r, axes=(0, 1)).real

    return gridwise(img, run, img.channels)


def fft_blur(img: Img, sigma: float) -> Img:
    """Gaussian blur with periodic borders."""
    return filtered(img, lambda f2: np.exp(-2 * (math.pi * sigma) ** 2 * f2))


def fft_highpass(img: Img, sigma: float) -> Img:
    return filtered(img, lambda f2: 1 - np.exp(-2 * (math.pi * sigma) ** 2 * f2))


def fft_sharpen(img: Img, sigma: float, amount: float) -> Img:
    return filtered(img, lambda f2: 1 + amount * (1 - np.exp(-2 * (math.pi * sigma) ** 2 * f2)))


def fft_convolve(img: Img, kernel: np.ndarray) -> Img:
    """Circular convolution with a centred kernel, at the pixels that exist."""
    kernel = np.asarray(kernel, float)

    def run(g):
        h, w = g.shape[:2]
        k = np.zeros((h, w))
        kh, kw = kernel.shape
        for i in range(kh):
            for j in range(kw):
                k[(i - kh // 2) % h, (j - kw // 2) % w] += kernel[i, j]
        return np.fft.ifft2(np.fft.fft2(g, axes=(0, 1)) * np.fft.fft2(k)[..., None], axes=(0, 1)).real

    return gridwise(img, run, img.channels, known_only=True)
