"""Pluggable readers of images: a backend is built once a worker, and a failing image becomes a row with its error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tramloom.functions.workers import per_worker

SCHEMA = "image_id string, text string, conf double, boxes int, error string"
BACKENDS: dict[str, Callable[..., Callable[[bytes], tuple[str, float, int]]]] = {}


def register(name: str, build: Callable[..., Callable[[bytes], tuple[str, float, int]]]) -> None:
    """``build(**options)`` gives a function from an image's bytes to (text, mean confidence, number of boxes)."""
    BACKENDS[name] = build


def recognise(images: DataFrame, backend: str, **options) -> DataFrame:
    """Readings of (image_id, content)."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend}; there are {', '.join(sorted(BACKENDS)) or 'none'}")
    build = BACKENDS[backend]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = per_worker(f"ocr_{backend}", lambda: build(**options))
        for b in batches:
            rows = []
            for image_id, content in zip(b.image_id, b.content):
                try:
                    text, conf, boxes = read(content)
                    rows.append((image_id, text, float(conf), int(boxes), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((image_id, "", -1.0, 0, str(e)[:500]))
            yield pd.DataFrame(rows, columns=["image_id", "text", "conf", "boxes", "error"])

    return images.select("image_id", "content").mapInPandas(run, SCHEMA)
