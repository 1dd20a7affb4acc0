"""Queries of audits, summaries, reading order, plain quality tests, contexts and output forms, with their SQL twins.

The twins are written from the definitions of the operators, not from the constants of the code.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tramloom.functions import text as X
from tramloom.operators import candidates as C, gazetteer as Z, linker as L, metrics as M, ocr_quality as Q, rules as U, segments as S
from tramloom.plans import catalogue as K, sql as Y
from tramloom.plans.catalogue import query
from tramloom.sources.tables import table


@query("""WITH g AS (SELECT event_type, count(*) AS n, avg(value) AS mean, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.95) AS p95, max(value) AS worst, avg((value < 1)::INT) AS fail_rate, avg((value > 50)::INT) AS over_rate, avg((value > 90)::INT) AS error_rate FROM events GROUP BY 1),
o AS (SELECT *, round(median + 0.5 * p90 + 2 * fail_rate + 1.5 * over_rate + 3 * error_rate, 6) AS objective FROM g)
SELECT event_type, n, round(mean, 6) AS mean, round(median, 6) AS median, round(p90, 6) AS p90, round(p95, 6) AS p95, round(worst, 6) AS worst, round(fail_rate, 6) AS fail_rate, round(over_rate, 6) AS over_rate, round(error_rate, 6) AS error_rate, objective, row_number() OVER (ORDER BY objective, p90, median, event_type)::INT AS place FROM o""")
def tuning_objective(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return M.objective(table(spark, d, "events", ["event_type", "value"]), "event_type", "value", v < 1, 50.0, v > 90)


@query("SELECT event_id, value FROM events ORDER BY value DESC NULLS LAST, event_id LIMIT 25")
def worst_audited(spark: SparkSession, d: str) -> DataFrame:
    """The 25 worst rows of an audit, a top-k report."""
    return M.worst_first(table(spark, d, "events", ["event_id", "value"]), "value", "event_id", 25)


@query("""SELECT row_number() OVER (ORDER BY image_id)::INT AS tune_idx, image_id, truth FROM (SELECT DISTINCT l.image_id, t.truth FROM (SELECT image_id FROM ocr_lines WHERE text IS NOT NULL AND length(text) <= 499 AND conf BETWEEN 0 AND 1 AND line_index BETWEEN 1 AND 29) l
 LEFT JOIN (SELECT image_id, min(ocr_text) AS truth FROM train_labels GROUP BY 1) t USING (image_id) ORDER BY image_id LIMIT 100)""")
def tuning_sample(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 100 images within the audit's bounds, a sampling operator."""
    audit = table(spark, d, "ocr_lines", ["image_id", "text", "conf", "line_index"]).where("text is not null").select("image_id", F.col("conf").alias("cer"), F.col("line_index").alias("boxes"), "text", F.lit(None).cast("string").alias("error"))
    return M.tuning_sample(audit, table(spark, d, "train_labels", ["image_id", "ocr_text"]), 100, cer=(0.0, 1.0))


@query("SELECT line_id, (row_number() OVER (PARTITION BY image_id, variant_name ORDER BY box[2] NULLS LAST, box[1] NULLS LAST, line_id) - 1)::INT AS line_num FROM ocr_lines")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "ocr_lines", ["line_id", "image_id", "variant_name", "box"])
    return S.reading_order(lines, ["image_id", "variant_name"], "box", "line_id").select("line_id", "line_num")


@query("""WITH w AS (SELECT *, CASE WHEN len(box) = 4 THEN box END AS b FROM ocr_lines WHERE trim(text) <> '' AND conf >= 0.3)
SELECT image_id, variant_name, block_num, par_num, string_agg(text, ' ' ORDER BY line_id) AS text, round(avg(conf), 6) AS conf, count(*) AS n_words, CASE WHEN count(b) > 0 THEN concat_ws(',', min(b[1]), min(b[2]), max(b[1] + b[3]) - min(b[1]), max(b[2] + b[4]) - min(b[2])) END AS box FROM w GROUP BY ALL""")
def assembled_lines(spark: SparkSession, d: str) -> DataFrame:
    """Read pieces of at least 0.3 confidence joined by block and paragraph, with the box around them."""
    lines = table(spark, d, "ocr_lines", ["line_id", "image_id", "variant_name", "block_num", "par_num", "text", "conf", "box"])
    out = S.assemble_lines(lines, ["image_id", "variant_name"], ["block_num", "par_num"], "line_id", "text", "conf", 0.3, "box")
    return out.withColumn("box", F.when(F.col("box").isNotNull(), F.array_join(F.col("box").cast("array<string>"), ",")))


def _plain(spark: SparkSession, d: str) -> DataFrame:
    r = K.readings(spark, d)
    bad = Q.plainly_bad(F.lit(None).cast("string"), F.col("text"), F.col("boxes"), F.col("conf"))
    r = r.withColumn("bad", F.coalesce(bad, F.lit(False)))
    return r.withColumn("score", Q.plain_score(F.col("text"), F.col("boxes"), F.col("conf"), F.col("bad")))


_PLAIN = """SELECT *, round(CAST((CASE WHEN bad THEN 0.65::DOUBLE ELSE 1.0::DOUBLE END) * (0.65::DOUBLE * least(greatest(coalesce(conf, 0), 0), 1) + 0.25::DOUBLE * least(alnum / 80.0::DOUBLE, 1) + 0.10::DOUBLE * least(boxes / 12.0::DOUBLE, 1)) AS DECIMAL(18, 9)), 4)::DOUBLE AS score
 FROM (SELECT *, st = '' OR boxes < 1 OR salnum < 4 OR (coalesce(conf, 0) < 0.35 AND salnum < 20) AS bad FROM (SELECT image_id, variant, conf, boxes, regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS st, len(regexp_extract_all(x, '[\\p{L}\\p{N}]')) AS alnum, len(regexp_extract_all(x, '[\\p{L}\\p{N}]')) AS salnum
 FROM (SELECT image_id, variant_name AS variant, string_agg(text, chr(10) ORDER BY line_index NULLS FIRST, line_id) AS x, avg(conf) FILTER (conf >= 0 AND conf <= 1) AS conf, count(*) AS boxes FROM ocr_lines WHERE text IS NOT NULL GROUP BY 1, 2)))"""


@query(f"SELECT image_id, variant, bad, score FROM ({_PLAIN})")
def plain_quality(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d).select("image_id", "variant", "bad", "score")


@query(f"""SELECT image_id, variant, CASE WHEN variant = 'soft_enhanced' AND NOT bad THEN 'primary' ELSE 'best_score' END AS reason, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY (variant = 'soft_enhanced' AND NOT bad) DESC, score DESC, coalesce(list_position(['hard_fallback', 'raw_resized', 'soft_enhanced'], variant), 0)) AS k FROM ({_PLAIN})) WHERE k = 1""")
def primary_variant(spark: SparkSession, d: str) -> DataFrame:
    return Q.keep_primary(_plain(spark, d), "image_id", "soft_enhanced")


# ---- contexts and rules ---------------------------------------------------------------------------------------------

POSITIVE, NEGATIVE, GENERIC = [r"\bkem\b", r"\bsua\b", r"\btra\b"], [r"\bcong ty\b", r"\btuyen dung\b"], [r"\bkhuyen mai\b", r"\bgiao hang\b"]


def _any(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, {Y.rx('|'.join(f'(?:{p})' for p in patterns))})"


@query(f"""SELECT candidate_id, c <> '' AND ((c NOT IN ('giao hang', 'xem them') AND (c <> 'sen' OR ({_any('t', POSITIVE)} AND NOT {_any('t', NEGATIVE)}))) OR t = '') AS keep FROM (SELECT candidate_id, {Y.rule_text('clean_text')} AS c, {Y.rule_text('raw_text')} AS t FROM product_candidates)""")
def contextual_keep(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "product_candidates", ["candidate_id", "clean_text", "raw_text"])
    return c.select("candidate_id", U.keep_candidate(F.col("clean_text"), F.col("raw_text"), ("giao hang", "xem them"), {"sen": (POSITIVE, NEGATIVE)}).alias("keep"))


@query(f"""WITH x AS (SELECT doc_id, 'candidate' AS rule, key AS canonical, 80 AS priority, 0.9::DOUBLE AS score FROM ({K.SQL['link_exact']})),
a AS (SELECT * FROM ({K.SQL['rule_hits']}) UNION ALL SELECT * FROM x), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, score DESC, length(canonical) DESC, rule, canonical) AS k FROM a)
SELECT b.doc_id, rule, canonical, priority, score FROM b JOIN (SELECT doc_id, {Y.rule_text('text')} AS t FROM documents) USING (doc_id) WHERE k = 1 AND (priority >= 95 OR NOT {_any('t', GENERIC)})""")
def rule_resolver(spark: SparkSession, d: str) -> DataFrame:
    """The best of the rules' hits and of the exact links of each document, generic topics only by strong rules."""
    docs = table(spark, d, "documents", ["doc_id", "text"])
    every = K.QUERIES["link_exact"](spark, d).select("doc_id", F.col("key").alias("canonical"))
    return U.resolve_with(K.QUERIES["rule_hits"](spark, d), every, "doc_id", docs, "text", GENERIC)


@query("SELECT * FROM (VALUES ('kem danh rang', 'Kem Đánh Răng'), ('pate gan', 'Pate Gan'), ('bap', 'Snack Bắp'), ('snack bap', 'Snack Bắp')) t(alias, canonical)")
def rule_aliases(spark: SparkSession, d: str) -> DataFrame:
    return U.aliases(U.registry(spark, K.RULES), spark.createDataFrame([("bap", "Snack Bắp")], "alias string, canonical string"))


# ---- output forms -------------------------------------------------------------------------------------------------


_S = "(CASE WHEN product_name IS NULL OR lower(trim(product_name)) IN ('nan', 'none', 'null') THEN '' ELSE product_name END)"
_O = Y.strip(Y.sub(Y.sub(Y.sub(f"nfc_normalize({_S})", r"\r\n?", "\n"), r"\s*\+\s*", " + "), X.SPACES, " "))


@query(f"""SELECT label_id, o AS output, {Y.strip(Y.sub(Y.sub(f"lower({Y.fold('o')})", rf"[^{X.LETTERS}\s+]", " "), X.SPACES, " "))} AS display_key, upper({Y.sub("coalesce(ocr_text, '')", X.SPACES, "")}) AS compact,
 CASE WHEN length(s) > 120 THEN s[1:117] || '...' ELSE s END AS short, {Y.strip(Y.sub("nfc_normalize(coalesce(ocr_text, ''))", X.SPACES, " "))} AS cer_form, array_to_string(list_sort(list_distinct(list_filter(list_transform({Y.tokens(Y.light('product_name'))}, lambda t: {Y.key_of_light('t')}), lambda t: t <> ''))), ',') AS tokens
 FROM (SELECT *, {_O} AS o, replace(coalesce(ocr_text, ''), chr(10), ' / ') AS s FROM train_labels)""")
def output_forms(spark: SparkSession, d: str) -> DataFrame:
    """Names and texts of labels in the forms for output, comparison and error rates."""
    t = table(spark, d, "train_labels", ["label_id", "ocr_text", "product_name"])
    t = t.withColumn("output", X.output_text(F.col("product_name"))).withColumn("light", X.light(F.col("product_name"))).withColumn("cer_form", X.cer_text(F.col("ocr_text")))
    return t.select("label_id", "output", X.display_key(F.col("output")).alias("display_key"), X.compact_upper(F.col("ocr_text")).alias("compact"), X.shorten(F.col("ocr_text")).alias("short"), "cer_form", F.array_join(X.token_keys(F.col("light")), ",").alias("tokens"))


# ---- candidates, fillers, links -----------------------------------------------------------------------------------------


@query(f"""SELECT candidate_id, rank FROM (SELECT candidate_id, row_number() OVER (PARTITION BY c.image_id ORDER BY CASE c.source WHEN 'line' THEN 4 WHEN 'whole_line' THEN 3 WHEN 'segment' THEN 2 WHEN 'ngram' THEN 1 ELSE 0 END DESC, least(coalesce(token_count, 0), 8) DESC, coalesce(agreement, 0) DESC, coalesce(structure_score, 0) DESC, coalesce(ocr_conf, 0) DESC, length(coalesce(clean_text, '')) DESC, candidate_id)::INT AS rank
 FROM product_candidates c LEFT JOIN ({K.SQL['variant_support']}) s ON c.image_id = s.image_id AND c.normalized_key = s.normalized_key)""")
def candidate_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Rank of every candidate within its image by the six measures."""
    c = table(spark, d, "product_candidates", ["candidate_id", "image_id", "normalized_key", "source", "token_count", "structure_score", "ocr_conf", "clean_text"])
    agree = K.QUERIES["variant_support"](spark, d).select("image_id", "normalized_key", "agreement")
    c = c.join(agree, ["image_id", "normalized_key"], "left").withColumnsRenamed({"ocr_conf": "conf", "candidate_id": "seq"})
    return C.ranked_by_evidence(c, "image_id").select(F.col("seq").alias("candidate_id"), "rank")


@query(f"""WITH p AS (SELECT DISTINCT unnest(list_concat(token_keys, folded_token_keys)) AS token FROM gazetteer_entries), b AS (SELECT token FROM ({K.SQL['filler_mining']}) UNION SELECT lower(word) FROM common_words WHERE word IS NOT NULL)
SELECT token FROM b WHERE length(token) >= 2 AND regexp_matches(token, '\\p{{L}}') AND {Y.key('token')} NOT IN (SELECT token FROM p WHERE token IS NOT NULL) AND {Y.fold_key('token')} NOT IN (SELECT token FROM p WHERE token IS NOT NULL)""")
def filler_union(spark: SparkSession, d: str) -> DataFrame:
    """Mined fillers and a manual list together, protected words left out."""
    g = table(spark, d, "gazetteer_entries", ["token_keys", "folded_token_keys"])
    protected = g.select(F.explode(F.concat("token_keys", "folded_token_keys")).alias("token")).where("token is not null").distinct()
    return Z.with_manual(K.QUERIES["filler_mining"](spark, d), table(spark, d, "common_words", ["word"]).where("word is not null").select(F.col("word").alias("token")), protected)


def _links(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "product_candidates", ["candidate_id", "image_id", "clean_text", "source", "structure_score", "ocr_conf"]).withColumnRenamed("ocr_conf", "conf")
    return L.link(c, table(spark, d, "gazetteer_entries"))


@query()
def linking_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counts, rates, means and medians of all links."""
    return M.linking_summary(_links(spark, d))


@query()
def links_in_order(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate's link with its place within the image."""
    return L.in_order(_links(spark, d)).select("candidate_id", "image_id", "place", "matched", "entry_id", "score", "margin", "match_type")


@query()
def audit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Error rates of every variant's reading against the label, and the best variant of each image."""
    labels = table(spark, d, "train_labels", ["image_id", "ocr_text"]).where(F.trim("ocr_text") != "").groupBy("image_id").agg(F.min("ocr_text").alias("ocr_text"))
    return M.audit_rows(K.readings(spark, d), labels)


@query()
def gazetteer_build(spark: SparkSession, d: str) -> DataFrame:
    """The entries of a gazetteer built from all labels, with their mined surface variants."""
    e = Z.build(table(spark, d, "train_labels", ["ocr_text", "product_name"]), "ocr_text", "product_name")["entries"]
    return e.select("entry_id", "canonical_key", "canonical_display", "frequency_prior", F.array_join("surface_variants", "|").alias("variants"))


_N = f"nfc_normalize({_S})"
_OUTPUT = Y.strip(Y.sub(Y.sub(Y.sub("x", r"\r\n?", "\n"), r"\s*\+\s*", " + "), X.SPACES, " "))
_DISPLAY = Y.strip(Y.sub(Y.sub(f"lower({Y.fold('x')})", rf"[^{X.LETTERS}\s+]", " "), X.SPACES, " "))
K.SQL["final_names"] = f"""WITH i AS (SELECT label_id, list_filter(list_transform(regexp_split_to_array(regexp_replace({_N}, '\\s+', ' ', 'g'), '\\s+\\+\\s+'), lambda x: {_OUTPUT}), lambda x: x <> '') AS items FROM train_labels),
e AS (SELECT label_id, k, items[k] AS name, items[k] AS x FROM i, unnest(range(1, len(items) + 1)) AS u(k)), d AS (SELECT label_id, k, name, {_DISPLAY} AS key FROM e),
c AS (SELECT label_id, {_DISPLAY} AS key FROM (SELECT label_id, unnest(regexp_split_to_array(name, '\\s+\\+\\s+')) AS x FROM d WHERE contains(name, ' + '))),
f AS (SELECT *, row_number() OVER (PARTITION BY label_id, key ORDER BY k) AS r FROM d), o AS (SELECT label_id, string_agg(name, ' + ' ORDER BY k) AS n FROM f WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM c WHERE c.label_id = f.label_id AND c.key = f.key) GROUP BY 1)
SELECT i.label_id, coalesce(n, '') AS final_name FROM i LEFT JOIN o USING (label_id)"""
