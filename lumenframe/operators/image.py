"""Images as DataFrames: one row for each pixel, one column for each channel."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Op

KEYS = ("image_id", "y", "x")


@dataclass(frozen=True)
class Roi:
    """A half-open box of pixels."""

    x0: int
    x1: int
    y0: int
    y1: int

    @property
    def width(self) -> int:
        return max(0, self.x1 - self.x0)

    @property
    def height(self) -> int:
        return max(0, self.y1 - self.y0)

    def intersect(self, o: Roi) -> Roi:
        return Roi(max(self.x0, o.x0), min(self.x1, o.x1), max(self.y0, o.y0), min(self.y1, o.y1))

    def union(self, o: Roi) -> Roi:
        return Roi(min(self.x0, o.x0), max(self.x1, o.x1), min(self.y0, o.y0), max(self.y1, o.y1))

    def moved(self, dx: int, dy: int) -> Roi:
        return Roi(self.x0 + dx, self.x1 + dx, self.y0 + dy, self.y1 + dy)

    def grown(self, n: int) -> Roi:
        return Roi(self.x0 - n, self.x1 + n, self.y0 - n, self.y1 + n)

    def predicate(self):
        return (F.col("x") >= self.x0) & (F.col("x") < self.x1) & (F.col("y") >= self.y0) & (F.col("y") < self.y1)


@dataclass(frozen=True)
class Img:
    """Images of one size: pixel rows (image_id, y, x, channels) and the box they cover."""

    df: DataFrame
    roi: Roi
    channels: tuple[str, ...]

    def select(self, channels: dict) -> Img:
        """The same pixels with other channels: name to Column."""
        return replace(self, df=self.df.select(*KEYS, *[c.alias(k) for k, c in channels.items()]), channels=tuple(channels))

    def apply(self, op: Op) -> Img:
        """A per-pixel operation: a projection, no shuffle."""
        return replace(self, df=op.frame(self.df, list(KEYS)), channels=tuple(op.out))

    def moved(self, x, y, roi: Roi) -> Img:
        """Pixels at new places."""
        return replace(self, df=self.df.select("image_id", y.cast("int").alias("y"), x.cast("int").alias("x"), *self.channels), roi=roi)

    def crop(self, roi: Roi) -> Img:
        return replace(self, df=self.df.where(roi.predicate()), roi=self.roi.intersect(roi))
