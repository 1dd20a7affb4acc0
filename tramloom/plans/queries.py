"""Queries of the engine's core operators over one data directory, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tramloom.operators import linker, nested, packed, rules, surfaces
from tramloom.plans import audits, catalogue, pipeline  # noqa: F401  (audits registers its queries)
from tramloom.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per value of each label."""
    return packed.explode_values(table(spark, d, "train_labels", ["label_id", "product_name"]), "product_name").select("label_id", "item_pos", "item")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per existing report, text_stats, reason and line of each selection."""
    return nested.child_keys(table(spark, d, "ocr_selections", ["selection_id", "record_json"]))


def p3_child(child: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        out = nested.child_table(table(spark, d, "ocr_selections", ["selection_id", "record_json"]), child)
        return out.withColumn("box", out["box"].cast("string")) if "box" in out.columns else out

    query.__doc__ = f"The flat table of {child}."
    return query


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, **{f"p3_{c.rstrip('s')}s": p3_child(c) for c in nested.CHILDREN}, **catalogue.QUERIES}
SQL: dict[str, str] = {**catalogue.SQL}


def _fillers(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.fillers_of(table(spark, d, "train_labels", ["ocr_text", "product_name"]), table(spark, d, "gazetteer_entries"))


def generated_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidate phrases of all read lines."""
    c = pipeline.generate_candidates(pipeline.lines_of(spark, d), _fillers(spark, d))
    return c.select("image_id", "normalized_key", "source", "support", "available", "agreement", "structure_score", "token_count")


def predicted_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of all images, from their read lines to the gate's decision."""
    return pipeline.predict(pipeline.lines_of(spark, d), table(spark, d, "gazetteer_entries"), rules.registry(spark, catalogue.RULES), link=linker.LinkConfig(top=2), fillers=_fillers(spark, d))


def surface_mining(spark: SparkSession, d: str) -> DataFrame:
    """How the listed names are written in the labelled texts."""
    return surfaces.mine(table(spark, d, "train_labels", ["ocr_text", "product_name"]), table(spark, d, "gazetteer_entries"), "ocr_text", "product_name")


QUERIES |= {f.__name__: f for f in (generated_candidates, predicted_names, surface_mining)}


# ---- SQL twins of the nested tables --------------------------------------------------------------------------------

_NUMBERS = r"""regexp_replace(regexp_replace(record_json, '(:|,|\[)(\s*)(-?(?:NaN|Infinity|INF)|\+INF)\b', '\1\2"\3"', 'g'), '^[\s\x{FEFF}]+|\s+$', '', 'g')"""
_OBJECT = "CASE WHEN json_valid({x}) THEN CASE json_type({x}) WHEN 'OBJECT' THEN ({x})::JSON WHEN 'VARCHAR' THEN CASE WHEN json_valid(trim(({x})::JSON ->> '$')) AND json_type(trim(({x})::JSON ->> '$')) = 'OBJECT' THEN trim(({x})::JSON ->> '$')::JSON END END END"
_RECORDS = f"""r0 AS (SELECT selection_id, {_NUMBERS} AS x FROM ocr_selections), r1 AS (SELECT selection_id, {_OBJECT.format(x='x')} AS top FROM r0),
r2 AS (SELECT selection_id, CASE WHEN (top -> '$.selection') IS NOT NULL AND json_type(top -> '$.selection') <> 'NULL' THEN (top -> '$.selection')::VARCHAR ELSE top::VARCHAR END AS x FROM r1 WHERE top IS NOT NULL), rec AS (SELECT selection_id, {_OBJECT.format(x='x')} AS j FROM r2)"""


def _by_variant(part: str) -> str:
    """(selection_id, variant_name, v) of the objects of a part, written by variant or as a list."""
    p = f"(j -> '$.{part}')"
    return f"""(SELECT selection_id, k AS variant_name, json_extract({p}, '$."' || k || '"') AS v FROM (SELECT selection_id, j, unnest(json_keys({p})) AS k FROM rec WHERE json_type({p}) = 'OBJECT') WHERE json_type(json_extract({p}, '$."' || k || '"')) = 'OBJECT'
 UNION ALL SELECT selection_id, v ->> '$.variant_name', v FROM (SELECT selection_id, unnest(from_json({p}, '["JSON"]')) AS v FROM rec WHERE json_type({p}) = 'ARRAY') WHERE json_type(v) = 'OBJECT')"""


def _elements(rows: str, field: str) -> str:
    return f"""(SELECT selection_id, variant_name, i - 1 AS pos, l[i] AS e FROM (SELECT selection_id, variant_name, from_json(v -> '$.{field}', '["JSON"]') AS l FROM {rows} WHERE json_type(v -> '$.{field}') = 'ARRAY'), unnest(range(1, len(l) + 1)) AS u(i) WHERE l[i] IS NOT NULL AND json_type(l[i]) <> 'NULL')"""


SQL["p3_found"] = f"""WITH {_RECORDS}, rep AS (SELECT * FROM {_by_variant('reports')}), res AS (SELECT * FROM {_by_variant('results')})
SELECT selection_id, variant_name, 'report' AS child, 0::INT AS pos FROM rep UNION ALL SELECT selection_id, variant_name, 'text_stats', 0 FROM rep WHERE json_type(v -> '$.text_stats') = 'OBJECT'
UNION ALL SELECT selection_id, variant_name, 'reason', pos::INT FROM {_elements('rep', 'reasons')} UNION ALL SELECT selection_id, variant_name, 'line', pos::INT FROM {_elements('res', 'lines')}"""
SQL["p3_reasons"] = f"WITH {_RECORDS}, rep AS (SELECT * FROM {_by_variant('reports')}) SELECT selection_id, variant_name, pos::INT AS pos, e ->> '$' AS reason FROM {_elements('rep', 'reasons')}"


def _fields(v: str, kind: str) -> str:
    """The scalar fields of an object by their types."""
    out = []
    for n in [f.split(":")[0] for f in kind.removeprefix("struct<").split(",") if ":string" in f]:
        x = f"({v} ->> '$.{n}')"
        if n in nested.LONG:
            x = f"try_cast(trunc(try_cast({x} AS DOUBLE)) AS BIGINT)"
        elif n in nested.DOUBLE:
            x = f"try_cast({x} AS DOUBLE)"
        elif n == "is_bad":
            x = f"lower(trim({x})) IN ('1', 'true', 'yes', 'y', 't')"
        out.append(f"{x} AS {n}")
    return ", ".join(out)


SQL["p3_text_stats"] = f"WITH {_RECORDS}, rep AS (SELECT * FROM {_by_variant('reports')}) SELECT selection_id, variant_name, 0::INT AS pos, {_fields('s', nested.STATS.rstrip('>'))} FROM (SELECT *, v -> '$.text_stats' AS s FROM rep) WHERE json_type(s) = 'OBJECT'"
SQL["p3_reports"] = f"WITH {_RECORDS}, rep AS (SELECT * FROM {_by_variant('reports')}) SELECT selection_id, variant_name, 0::INT AS pos, {_fields('v', 'struct<is_bad:string,score:string,avg_conf:string,n_boxes:string,n_chars:string,n_alnum:string,error:string')} FROM rep"
_BOX = """CASE WHEN json_type(b) <> 'ARRAY' THEN NULL WHEN json_type(b -> 0) = 'ARRAY' THEN (SELECT [trunc(min(p[1]))::INT, trunc(min(p[2]))::INT, trunc(max(p[1]) - min(p[1]))::INT, trunc(max(p[2]) - min(p[2]))::INT]::VARCHAR FROM (SELECT unnest(from_json(b, '[["DOUBLE"]]')) AS p))
 ELSE list_transform(from_json(b, '["DOUBLE"]'), lambda x: trunc(x)::INT)::VARCHAR END"""
SQL["p3_lines"] = f"WITH {_RECORDS}, res AS (SELECT * FROM {_by_variant('results')}) SELECT selection_id, variant_name, pos::INT AS pos, {_fields('e', 'struct<text:string,conf:string,block_num:string,par_num:string,line_num:string')}, {_BOX} AS box FROM (SELECT *, e -> '$.box' AS b FROM {_elements('res', 'lines')})"
