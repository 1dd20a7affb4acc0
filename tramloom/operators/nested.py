"""Deeply nested selection records as flat child tables with parent keys.

The JSON text is parsed once by Spark into typed nested columns; the flattening works on Arrow buffers: the offsets of
a list give each element its parent's index, keys follow by a vectorised ``take``, and no row is touched in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tramloom.functions import text as X

#: Scalars are read as text, since exporter versions differ in their types; ``typed`` casts them at the end.
STATS = "struct<text_length:string,alnum_chars:string,alpha_chars:string,digit_chars:string,space_chars:string,cjk_chars:string,kana_chars:string,hangul_chars:string,emoji_chars:string,symbol_chars:string,junk_chars:string,alnum_ratio:string,cjk_ratio:string,emoji_ratio:string,symbol_ratio:string,junk_ratio:string>"
REPORT = f"struct<variant_name:string,is_bad:string,score:string,avg_conf:string,n_boxes:string,n_chars:string,n_alnum:string,error:string,reasons:array<string>,text_stats:{STATS}>"
LINE = "struct<text:string,conf:string,box:string,block_num:string,par_num:string,line_num:string>"
RESULT = f"struct<variant_name:string,text:string,avg_conf:string,n_boxes:string,latency_ms:string,backend:string,lang:string,error:string,image_shape:string,raw:string,lines:array<{LINE}>>"
TOP = "image_id string, selected_variant string, selection_reason string, tried_variants string, reports string, results string, selection string, _corrupt_record string"

CHILDREN = ("report", "text_stats", "reason", "line")
LONG = {"text_length", "alnum_chars", "alpha_chars", "digit_chars", "space_chars", "cjk_chars", "kana_chars", "hangul_chars", "emoji_chars", "symbol_chars", "junk_chars", "n_boxes", "n_chars", "n_alnum", "block_num", "par_num", "line_num"}
DOUBLE = {"score", "avg_conf", "conf", "latency_ms", "alnum_ratio", "cjk_ratio", "emoji_ratio", "symbol_ratio", "junk_ratio"}


def _object(c: Column) -> Column:
    """The text of a complete JSON object, unwrapped if it was written as a JSON string; NULL for anything else."""
    text = F.regexp_replace(c, r"^[\s\x{FEFF}]+|\s+$", "")
    as_string = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    inner = F.when(as_string["_corrupt_record"].isNull(), F.trim(as_string["v"]))
    out = F.when(text.startswith('"'), inner).otherwise(text)
    return F.when(out.startswith("{") & out.endswith("}"), out)


def _by_variant(c: Column, kind: str) -> Column:
    """array<struct<variant_name, value>> of a part written as an object by variant or as a list of objects."""
    pair = f"array<struct<variant_name:string,value:{kind}>>"
    entries = F.map_entries(F.from_json(c, f"map<string,{kind}>"))
    listed = F.transform(F.from_json(c, f"array<{kind}>"), lambda x: F.struct(x["variant_name"].alias("variant_name"), x.alias("value")))
    return F.when(c.startswith("{"), entries.cast(pair)).when(c.startswith("["), listed.cast(pair))


def parse_records(df: DataFrame, column: str = "record_json") -> DataFrame:
    """Adds ``__rec`` (top fields), ``__reports`` and ``__results`` (arrays of variant and object).

    A record that isn't complete JSON or holds no object has NULL in all of them. An envelope with the record under
    ``selection`` and a record written as a JSON string count as usual.
    """
    opts = {"columnNameOfCorruptRecord": "_corrupt_record"}
    df = df.withColumn("__top", F.from_json(_object(F.col(f"`{column}`")), TOP, opts))
    bad = F.col("__top._corrupt_record").isNotNull()
    inner = F.from_json(_object(F.col("__top.selection")), TOP, opts)
    df = df.withColumn("__rec", F.when(bad, F.lit(None)).when(F.col("__top.selection").isNotNull(), inner).otherwise(F.col("__top")))
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c != "__top"],
        _by_variant(F.col("__rec.reports"), REPORT).alias("__reports"),
        _by_variant(F.col("__rec.results"), RESULT).alias("__results"),
    )


def _elements(a: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Of a list array: the elements, the index of each one's parent, its place in the parent."""
    parent = pc.list_parent_indices(a)
    values = pc.list_flatten(a)
    lengths = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    pos = np.arange(len(values), dtype=np.int64) - starts[parent.to_numpy(zero_copy_only=False)] if len(values) else np.empty(0, np.int64)
    return values, parent, pa.array(pos.astype(np.int32))


def _keep(mask: pa.Array, *arrays: pa.Array) -> list[pa.Array]:
    return [a.filter(mask) for a in arrays]


def _children(batch: pa.RecordBatch, want: tuple[str, ...]) -> Iterator[tuple[str, pa.Array, pa.Array, pa.Array, pa.Array]]:
    """(child, row index in the batch, variant, position, value) for each kind of child, by offsets only."""

    def column(name: str) -> pa.ListArray:
        return batch.column(batch.schema.get_field_index(name))

    def zeros(n: int) -> pa.Array:
        return pa.array([0], pa.int32()).take(pa.array([0] * n, pa.int64())) if n < 1 else pa.repeat(pa.scalar(0, pa.int32()), n)

    def parts(name: str) -> tuple[pa.Array, pa.Array, pa.Array]:
        pairs, row, _ = _elements(column(name))
        variant, value = pc.struct_field(pairs, [0]), pc.struct_field(pairs, [1])
        return _keep(value.is_valid(), row, variant, value)

    def field(a: pa.StructArray, name: str) -> pa.Array:
        return pc.struct_field(a, [a.type.get_field_index(name)])

    if {"report", "text_stats", "reason"} & set(want):
        row, variant, report = parts("__reports")
        if "report" in want:
            yield "report", row, variant, zeros(len(row)), report
        if "text_stats" in want:
            stats = field(report, "text_stats")
            r, v, s = _keep(stats.is_valid(), row, variant, stats)
            yield "text_stats", r, v, zeros(len(r)), s
        if "reason" in want:
            value, parent, pos = _elements(field(report, "reasons"))
            value, parent, pos = _keep(value.is_valid(), value, parent, pos)
            yield "reason", row.take(parent), variant.take(parent), pos, value
    if "line" in want:
        row, variant, result = parts("__results")
        value, parent, pos = _elements(field(result, "lines"))
        value, parent, pos = _keep(value.is_valid(), value, parent, pos)
        yield "line", row.take(parent), variant.take(parent), pos, value


def child_keys(df: DataFrame, key: str = "selection_id", column: str = "record_json") -> DataFrame:
    """(key, variant_name, child, pos): one row per existing report, text_stats, reason and line.

    Defined results: a null or missing object gives no row; a null element gives none but keeps its place; NULL,
    broken and empty records give none; repeated records each give their rows; other columns of ``df`` don't matter.
    """
    flat = parse_records(df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{column}`")), column).select("__key", "__reports", "__results")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("variant_name", T.StringType()), T.StructField("child", T.StringType()), T.StructField("pos", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for child, row, variant, pos, _ in _children(batch, CHILDREN):
                if len(row):
                    yield pa.RecordBatch.from_arrays([keys.take(row), variant, pa.repeat(pa.scalar(child), len(row)), pos], names=schema.names)

    return flat.mapInArrow(run, schema)


def child_table(df: DataFrame, child: str, key: str = "selection_id", column: str = "record_json") -> DataFrame:
    """The flat table of one child: the key, ``variant_name``, ``pos`` and the child's own fields, cast to their types.

    A scalar that doesn't fit its type is NULL; non-finite numbers are kept as such.
    """
    kind = {"report": REPORT, "text_stats": STATS, "reason": "string", "line": LINE}[child]
    flat = parse_records(df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{column}`")), column).select("__key", "__reports", "__results")
    value = T.StructType.fromDDL(f"value {kind}")["value"].dataType
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("variant_name", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("value", value)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for _, row, variant, pos, value in _children(batch, (child,)):
                if len(row):
                    yield pa.RecordBatch.from_arrays([keys.take(row), variant, pos, value], names=schema.names)

    out = flat.mapInArrow(run, schema)
    if not isinstance(value, T.StructType):
        return out.withColumnRenamed("value", child)
    fields = [f.name for f in value.fields if f.name not in ("variant_name", "reasons", "text_stats")]
    return out.select(key, "variant_name", "pos", *[typed(F.col("value")[n], n).alias(n) for n in fields])


def typed(c: Column, name: str) -> Column:
    """``c`` cast to the type of the field ``name``. A box is (x, y, w, h): four numbers as they are, or the box around a list
    of points."""
    if name in LONG:
        return c.try_cast("double").try_cast("bigint")
    if name in DOUBLE:
        return c.try_cast("double")
    if name == "is_bad":
        return F.lower(F.trim(c)).isin("1", "true", "yes", "y", "t")
    if name == "box":
        flat = F.transform(F.from_json(c, "array<double>"), lambda x: x.cast("int"))
        points = F.filter(F.from_json(c, "array<array<double>>"), lambda p: (F.size(p) >= 2) & p[0].isNotNull() & p[1].isNotNull())
        around = F.when(F.size(points) > 0, F.transform(X.box_of(points), lambda x: x.cast("int")))
        return F.when(c.rlike(r"^\s*\[\s*\["), around).otherwise(flat)
    if name == "image_shape":
        return F.from_json(c, "array<int>")
    return c
