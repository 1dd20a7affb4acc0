"""Statistics of images by numpy, for the router: brightness, sharpness, noise, background."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "image_id string, width int, height int, mean_luma double, std_luma double, p05 double, p95 double, luma_range double, laplacian double, edge_density double, noise double, background double, near_binary_ratio double, error string"


def decode(content: bytes) -> np.ndarray:
    """Brightness of an image: PGM and PPM here, other formats by Pillow where it is installed."""
    if content[:2] in (b"P5", b"P6"):
        parts = content.split(None, 4)
        w, h = int(parts[1]), int(parts[2])
        depth = 3 if content[:2] == b"P6" else 1
        a = np.frombuffer(content[len(content) - w * h * depth :], np.uint8).reshape(h, w, depth).astype(np.float64)
        return a[..., 0] if depth == 1 else a @ np.array([0.299, 0.587, 0.114])
    import io

    from PIL import Image

    return np.asarray(Image.open(io.BytesIO(content)).convert("L"), np.float64)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of side 2 r + 1, edges repeated."""
    p = np.pad(a, r + 1, mode="edge").cumsum(0).cumsum(1)
    n = 2 * r + 1
    s = p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]
    return s[: a.shape[0], : a.shape[1]] / n**2


def features(luma: np.ndarray, most: int = 800) -> dict[str, float]:
    """Statistics of one plane of brightness, taken on at most ``most`` pixels a side."""
    step = max(1, -(-max(luma.shape) // most))
    a = luma[::step, ::step]
    p = np.pad(a, 1, mode="edge")
    lap = p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * a
    gx, gy = p[1:-1, 2:] - p[1:-1, :-2], p[2:, 1:-1] - p[:-2, 1:-1]
    grad = np.hypot(gx, gy)
    rest = a - _box(a, 1)
    p05, p95 = np.percentile(a, [5, 95])
    return {
        "mean_luma": a.mean(), "std_luma": a.std(), "p05": p05, "p95": p95, "luma_range": p95 - p05, "laplacian": lap.var(), "edge_density": float((grad > 1.33 * max(1.0, float(np.median(a)))).mean()),
        "noise": 1.4826 * float(np.median(np.abs(rest - np.median(rest)))), "background": _box(a, max(12, min(a.shape) // 18)).std(), "near_binary_ratio": float(((a < 25) | (a > 230)).mean()),
    }


def image_features(images: DataFrame) -> DataFrame:
    """Statistics of (image_id, content); an image that can't be read has its error and NULL values."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for image_id, content in zip(b.image_id, b.content):
                try:
                    luma = decode(content)
                    rows.append({"image_id": image_id, "width": luma.shape[1], "height": luma.shape[0], **features(luma), "error": None})
                except Exception as e:  # noqa: BLE001
                    rows.append({"image_id": image_id, "error": str(e)[:500] or type(e).__name__})
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"width": "Int32", "height": "Int32"})

    return images.select("image_id", "content").mapInPandas(run, SCHEMA)
