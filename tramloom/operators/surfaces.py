"""Surface variants of names, mined from the texts that they label."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tramloom.functions import text as X
from tramloom.functions.blocks import ratios
from tramloom.functions.similarity import bags
from tramloom.operators import segments as S


def _closest(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each row, the window whose key is most like the name's; then the longest, then the last by text."""
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                windows, keys, name = (batch.column(i).to_pylist() for i in (3, 4, 5))
                row = [i for i, w in enumerate(windows) for _ in w]
                window, key = [x for w in windows for x in w], [x for k in keys for x in k]
                other = [name[i] for i in row]
                # no two keys share more than their common letters, so what these don't reach isn't compared
                bound = 2.0 * bags(key, other) / np.maximum(1, [len(x) + len(y) for x, y in zip(key, other)])
                near = np.flatnonzero(bound >= least)
                alike = ratios([key[i] for i in near], [other[i] for i in near]) / 100
                best: dict[int, tuple[float, int, str]] = {}
                for i, a in zip(near.tolist(), alike.tolist()):
                    if a >= least:
                        rank = (round(a, 9), len(window[i]), window[i])
                        best[row[i]] = max(best.get(row[i], rank), rank)
                found = pa.array([best[i][2] if i in best else None for i in range(len(name))], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["entry_id", "key", "rows", "surface"])

    return run


def mine(labels: DataFrame, entries: DataFrame, text: str, name: str, least: float = 0.72, keep: int = 40) -> DataFrame:
    """(entry_id, surface, n): how names are written in the texts that they label.

    Of each labelled text and name, all windows of two tokens fewer to four more than the name are compared with it by
    their accent-free keys; the most alike one counts if it is alike enough and has another key than the name. The
    ``keep`` commonest variants of each entry, a top-k report, then the longest, then by text.

    Defined results: NULL and blank texts and names give nothing; repeated rows count each; an entry's key must be listed.
    """
    named = S.product_surfaces(labels.where(F.col(text).isNotNull()).select(X.light(F.col(text)).alias("__text"), X.safe_text(F.col(name)).alias("__name")), "__name")
    named = named.withColumn("key", X.key(F.col("surface"))).join(entries.select("entry_id", F.col("canonical_key").alias("key")), "key")
    # a text and name that come again are compared once
    pairs = named.groupBy("entry_id", "key", "__text").agg(F.count("*").alias("rows"))
    tokens = pairs.withColumn("t", X.tokens(F.col("__text"))).withColumn("n", F.size(F.split("key", " ")))
    spans = F.flatten(F.transform(F.sequence(F.greatest(F.lit(1), F.col("n") - 2), F.greatest(F.lit(1), F.col("n") + 4)), lambda w: F.when(F.size("t") >= w, F.transform(F.sequence(F.lit(1), F.size("t") - w + 1), lambda s: F.array_join(F.slice("t", s, w), " "))).otherwise(F.array().cast("array<string>"))))
    windows = tokens.select("entry_id", "key", "rows", F.array_distinct(spans).alias("w"))
    folded = F.transform("w", lambda x: X.fold_key(x))
    best = windows.select("entry_id", "key", "rows", "w", folded.alias("f"), X.fold_key(F.col("key")).alias("name"))
    best = best.mapInArrow(_closest(least), "entry_id string, key string, rows long, surface string").where("surface is not null")
    counted = best.where(X.key(F.col("surface")) != F.col("key")).groupBy("entry_id", "surface").agg(F.sum("rows").alias("n"))
    w = Window.partitionBy("entry_id").orderBy(F.desc("n"), F.desc(F.length("surface")), F.desc("surface"))
    return counted.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep).drop("r")
