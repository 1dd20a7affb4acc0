"""Final names of documents and the output table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tramloom.functions import text as X


def final_names(displays: Column) -> Column:
    """Names joined by `` + ``: the first of each display key, without single items that a joined name contains.
    The names must be composed (NFC)."""
    clean = F.filter(F.transform(displays, lambda x: X.output_text(x, compose=False)), lambda x: x != "")
    keyed = F.transform(clean, lambda x: F.struct(x.alias("name"), X.display_key(x).alias("key")))
    keys = F.transform(keyed, lambda k: k["key"])
    first = F.filter(keyed, lambda k, i: F.array_position(keys, k["key"]) == i + 1)
    covered = F.flatten(F.transform(F.filter(clean, lambda x: x.contains(" + ")), lambda x: F.transform(F.split(x, r"\s+\+\s+"), lambda y: X.display_key(y))))
    left = F.filter(first, lambda k: ~F.array_contains(covered, k["key"]))
    return F.array_join(F.transform(left, lambda k: k["name"]), " + ")


def submission(spine: DataFrame, decisions: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """(key, ocr_text, product_name): one row a key of the spine; missing values are empty."""
    d = decisions.groupBy(key).agg(F.first("product_name").alias("product_name"))
    t = texts.groupBy(key).agg(F.max_by("ocr_text", F.struct(F.length("ocr_text"), "ocr_text")).alias("ocr_text"))
    return spine.select(key).distinct().join(t, key, "left").join(d, key, "left").select(key, X.empty(F.col("ocr_text")).alias("ocr_text"), X.empty(F.col("product_name")).alias("product_name"))


def not_cached(ids: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Keys that the cache doesn't hold."""
    return ids.select(key).distinct().join(cache.select(key), key, "left_anti")


TEXT_COLUMNS = ("ocr_text", "selected_text", "hard_text", "soft_text", "raw_text")


def text_column(df: DataFrame) -> str:
    """The first of the usual text columns that ``df`` has."""
    have = [c for c in TEXT_COLUMNS if c in df.columns]
    if not have:
        raise ValueError(f"none of {', '.join(TEXT_COLUMNS)}")
    return have[0]


def product_frame(decisions: DataFrame, key: str) -> DataFrame:
    """(key, product_name): the name where a decision emits one, else an empty text."""
    return decisions.select(key, F.when(F.col("emit"), X.empty(F.col("product_name"))).otherwise("").alias("product_name"))


def wanted(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows of ``df`` whose key is asked for."""
    return df.join(ids.select(key).distinct(), key, "left_semi")
