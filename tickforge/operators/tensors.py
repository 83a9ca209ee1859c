"""Layouts of sequences of feature vectors, as nested arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F

LAYOUTS = ("flat", "deeplob", "hlob", "image")


def image_size(features: int, levels: int) -> tuple[int, int, int]:
    """Channels, height and width of an image of all features: a channel for 4 rows of `levels` cells."""
    return -(-features // (4 * levels)), 4, levels


def reshape(sequence: Column, layout: str, levels: int, channels: int = 4, height: int | None = None, width: int | None = None) -> Column:
    """A sequence [T][F] with grouped raw levels first, as flat [T][F], deeplob [T][4][L], hlob [T][L][4], or image
    [T][C][H][W] padded by zeros."""
    if layout not in LAYOUTS:
        raise ValueError(layout)
    if layout == "flat":
        return sequence
    if layout == "deeplob":
        return F.transform(sequence, lambda v: F.array(*(F.slice(v, k * levels + 1, levels) for k in range(4))))
    if layout == "hlob":
        return F.transform(sequence, lambda v: F.array(*(F.array(*(v[k * levels + i] for k in range(4))) for i in range(levels))))
    cell = lambda v, k: F.when(F.size(v) > k, v[k]).otherwise(F.lit(0.0))
    return F.transform(sequence, lambda v: F.array(*(F.array(*(F.array(*(cell(v, (c * height + h) * width + w) for w in range(width))) for h in range(height))) for c in range(channels))))
