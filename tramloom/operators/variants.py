"""Variants of an image for reading: resized, softly enhanced and binarised planes, by numpy in one narrow stage."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tramloom.operators.images import _box, decode

SCHEMA = "image_id string, variant string, content binary, error string"


@dataclass(frozen=True)
class Binarise:
    """One way of binarising. ``block`` 0 takes a side from the image's size; ``morph`` is the radius of a closing."""

    name: str
    mode: str = "otsu"
    block: int = 0
    offset: float = 11.0
    blur: bool = False
    stretch: bool = False
    morph: int = 0
    invert_dark: bool = True


def configs() -> list[Binarise]:
    """The built-in sweep: every mode with and without blur and contrast, and block sizes and offsets of the adaptive one."""
    out = [Binarise(f"otsu{'_blur' * b}{'_stretch' * s}", blur=b, stretch=s) for b in (False, True) for s in (False, True)]
    out += [Binarise(f"adaptive_{k or 'auto'}_{c:g}{'_blur' * b}", "adaptive", k, c, blur=b) for k in (0, 31, 51) for c in (7.0, 11.0) for b in (False, True)]
    return [*out, Binarise("otsu_close", morph=1), Binarise("adaptive_close", "adaptive", morph=1), Binarise("otsu_plain", invert_dark=False)]


def config_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(pd.DataFrame([asdict(c) for c in configs()]))


def resize(a: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear; a scale within 3 % of 1 changes nothing."""
    if abs(scale - 1) < 0.03:
        return a
    h, w = max(1, round(a.shape[0] * scale)), max(1, round(a.shape[1] * scale))
    y, x = np.linspace(0, a.shape[0] - 1, h), np.linspace(0, a.shape[1] - 1, w)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, a.shape[0] - 1), np.minimum(x0 + 1, a.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    top = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx
    return top * (1 - fy) + (a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx) * fy


def otsu(a: np.ndarray) -> float:
    """Threshold that separates two classes of brightness best."""
    p = np.bincount(a.clip(0, 255).astype(np.uint8).ravel(), minlength=256) / a.size
    w, m = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m) ** 2 / (w * (1 - w))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def stretch(a: np.ndarray) -> np.ndarray:
    low, high = np.percentile(a, [1, 99])
    return ((a - low) * 255 / max(high - low, 1)).clip(0, 255)


def _grow(a: np.ndarray, r: int, pick) -> np.ndarray:
    p = np.pad(a, r, mode="edge")
    return pick([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1)], axis=0)


def binarise(a: np.ndarray, c: Binarise) -> np.ndarray:
    """Black and white plane; a dark background is turned light where ``invert_dark``."""
    a = _box(a, 1) if c.blur else a
    a = stretch(a) if c.stretch else a
    if c.mode == "adaptive":
        side = c.block or min(71, max(21, min(a.shape) // 28))
        out = np.where(a > _box(a, side // 2) - c.offset, 255.0, 0.0)
    else:
        out = np.where(a > otsu(a), 255.0, 0.0)
    if c.morph:
        out = _grow(_grow(out, c.morph, np.max), c.morph, np.min)
    return 255 - out if c.invert_dark and out.mean() < 127 else out


def soften(a: np.ndarray) -> np.ndarray:
    """Contrast stretched and edges sharpened."""
    b = stretch(a)
    return (b + 0.5 * (b - _box(b, 1))).clip(0, 255)


def encode(a: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.round().clip(0, 255).astype(np.uint8).tobytes()


def make_variants(images: DataFrame, sweep: list[Binarise] | None = None) -> DataFrame:
    """(image_id, variant, content, error) of (image_id, content, scale): ``raw_resized``, ``soft_enhanced`` and
    ``hard_fallback``, or one row for each way of ``sweep``. An image that can't be read gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for image_id, content, scale in zip(b.image_id, b.content, b.scale):
                try:
                    a = resize(decode(content), float(scale if scale is not None and scale == scale else 1.0))
                    made = {c.name: binarise(a, c) for c in sweep} if sweep else {"raw_resized": a, "soft_enhanced": soften(a), "hard_fallback": binarise(a, Binarise("hard"))}
                    rows = [(image_id, k, encode(v), None) for k, v in made.items()]
                except Exception as e:  # noqa: BLE001
                    rows = [(image_id, None, None, str(e)[:500] or type(e).__name__)]
                yield pd.DataFrame(rows, columns=["image_id", "variant", "content", "error"])

    return images.select("image_id", "content", "scale").mapInPandas(run, SCHEMA)
