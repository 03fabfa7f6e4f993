"""A decoded image."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Picture:
    """Channels (height, width) by name, and attributes."""

    channels: dict[str, np.ndarray]
    attributes: dict[str, str] = field(default_factory=dict)
    format: str = ""

    @property
    def height(self) -> int:
        return next(iter(self.channels.values())).shape[0]

    @property
    def width(self) -> int:
        return next(iter(self.channels.values())).shape[1]


class Unreadable(ValueError):
    """Bytes that no decoder here can read."""


NAMES = {1: ("y",), 2: ("y", "a"), 3: ("r", "g", "b"), 4: ("r", "g", "b", "a")}


def names_of(n: int) -> list[str]:
    """The usual names of `n` channels."""
    return list(NAMES.get(n) or (f"channel{i}" for i in range(n)))


def named(data: np.ndarray) -> dict[str, np.ndarray]:
    """Channels of a (height, width, n) array under their usual names."""
    return {c: np.ascontiguousarray(data[..., i]) for i, c in enumerate(names_of(data.shape[2]))}


def from_int(data: np.ndarray) -> np.ndarray:
    return data.astype(np.float32) / np.float32(np.iinfo(data.dtype).max)
