"""Queries of the text, candidate, gazetteer, linking, rule, gate, quality and metric operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tramloom.functions import similarity, text as X
from tramloom.operators import candidates as C, gate as G, gazetteer as Z, linker as L, metrics as M, ocr_quality as Q, predict as P, router as R, rules as U, segments as S
from tramloom.plans import sql as Y
from tramloom.sources.tables import table, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL twin where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- text -------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {Y.key('text')} AS key FROM documents")
def normalize_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.key(F.col("text")).alias("key"))


@query(f"SELECT doc_id, {Y.fold_key('text')} AS folded FROM documents")
def fold_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.fold_key(F.col("text")).alias("folded"))


@query(f"SELECT doc_id, {Y.light('text')} AS light FROM documents")
def normalize_light(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.light(F.col("text")).alias("light"))


@query(f"SELECT doc_id, {Y.rule_text('text')} AS norm FROM documents")
def rule_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.rule_text(F.col("text")).alias("norm"))


@query(f"SELECT doc_id, len(t)::BIGINT AS n_tokens, len(list_distinct(t))::BIGINT AS n_distinct FROM (SELECT doc_id, {Y.tokens(Y.light('text'))} AS t FROM documents)")
def tokenize_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", X.tokens(X.light(F.col("text"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT doc_id, round({Y.digit_ratio('x')}, 6) AS digits, round({Y.alpha_ratio('x')}, 6) AS letters, round({Y.punct_ratio('x')}, 6) AS puncts, round({Y.emoji_ratio('x')}, 6) AS emojis FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)")
def text_ratios(spark: SparkSession, d: str) -> DataFrame:
    x = X.empty(F.col("text"))
    return table(spark, d, "documents").select("doc_id", *[F.round(f(x), 6).alias(n) for f, n in ((X.digit_ratio, "digits"), (X.alpha_ratio, "letters"), (X.punct_ratio, "puncts"), (X.emoji_ratio, "emojis"))])


_OUT = Y.strip(Y.sub(Y.sub(Y.sub(Y.sub("nfc_normalize(CASE WHEN text IS NULL OR lower(trim(text)) IN ('nan', 'none', 'null') THEN '' ELSE text END)", r"\r\n?", "\n"), r"[ \t]+", " "), r" *\n *", "\n"), r"\n{3,}", "\n\n"))
_CLEAN = Y.strip(Y.sub(Y.sub(_OUT, X.OUTPUT_ALLOWED, " "), X.SPACES, " "))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(x, {Y.rx(X.READABLE)}) THEN x ELSE '' END AS clean FROM (SELECT doc_id, {_CLEAN} AS x FROM documents)")
def clean_ocr_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.clean_ocr_text(F.col("text")).alias("clean"))


@query("SELECT candidate_id, CASE WHEN ocr_conf IS NULL OR ocr_conf < 0 THEN -1.0::DOUBLE WHEN ocr_conf > 1 THEN ocr_conf / 100 ELSE ocr_conf END AS conf FROM product_candidates")
def confidence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_candidates", ["candidate_id", "ocr_conf"]).select("candidate_id", X.confidence(F.col("ocr_conf")).alias("conf"))


@query("""WITH l AS (SELECT label_id, regexp_replace(lower(trim(coalesce(ocr_text, ''))), '[^a-z0-9 ]+', '', 'g') AS a, regexp_replace(lower(trim(coalesce(product_name, ''))), '[^a-z0-9 ]+', '', 'g') AS b FROM train_labels),
n AS (SELECT label_id, trim(regexp_replace(a, ' +', ' ', 'g')) AS a, trim(regexp_replace(b, ' +', ' ', 'g')) AS b FROM l)
SELECT label_id, round(CASE WHEN b = '' THEN CASE WHEN a = '' THEN 0.0 ELSE 1.0 END ELSE levenshtein(a, b) / length(b)::DOUBLE END, 6)::DOUBLE AS cer FROM n""")
def cer_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Error rate of the read text against the name, over their ASCII letters."""
    ascii_ = lambda c: F.regexp_replace(F.lower(F.trim(X.empty(F.col(c)))), r"[^a-z0-9 ]+", "")
    return table(spark, d, "train_labels").select("label_id", F.round(X.cer(ascii_("ocr_text"), ascii_("product_name")), 6).alias("cer"))


# ---- lines, segments, n-grams -----------------------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return S.text_lines(table(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text")


_L = Y.lines("documents", "doc_id", "text")


@query(f"SELECT doc_id, line_index::INT AS line_index, text FROM ({_L})")
def line_records(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d)


@query(f"SELECT coalesce({Y.filter_reason('text')}, 'keep') AS reason, count(*) AS n FROM ({_L}) GROUP BY 1")
def structural_filter(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy(F.coalesce(C.filter_reason(F.col("text")), F.lit("keep")).alias("reason")).agg(F.count("*").alias("n"))


_SCORE = f"""SELECT doc_id, line_index::INT AS line_index, round(CAST(CASE reason WHEN 'empty' THEN 0.0 WHEN 'too_short' THEN 0.25 WHEN 'no_tokens' THEN 0.0 WHEN 'too_many_tokens' THEN 0.55 WHEN 'numeric_only' THEN 0.15 WHEN 'no_alpha' THEN 0.10 WHEN 'emoji_heavy' THEN 0.20 WHEN 'punct_heavy' THEN 0.20
 ELSE least(greatest(0.55::DOUBLE + CASE WHEN n BETWEEN 1 AND 4 THEN 0.18::DOUBLE WHEN n BETWEEN 5 AND 8 THEN 0.10::DOUBLE ELSE -0.05::DOUBLE END + CASE WHEN al BETWEEN 2 AND 10 THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN ar >= 0.45 THEN 0.10::DOUBLE ELSE 0 END - CASE WHEN dr > 0.50 THEN 0.15::DOUBLE ELSE 0 END, 0), 1) END AS DECIMAL(18, 9)), 4)::DOUBLE::DOUBLE AS score
 FROM (SELECT *, {Y.filter_reason('text')} AS reason, len(t) AS n, coalesce(list_sum(list_transform(t, lambda x: length(x))), 0) / greatest(len(t), 1)::DOUBLE AS al, {Y.alpha_ratio('text')} AS ar, {Y.digit_ratio('text')} AS dr FROM (SELECT *, {Y.tokens('text')} AS t FROM ({_L})))"""


@query(_SCORE)
def structure_score(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_index", C.structure_score(F.col("text"), F.lit("line")).alias("score"))


_BARS = Y.sub(Y.sub("text", r"[()\[\]{}]", " | "), r"[|/:;,•‣◦⁃∙·]+", "|")


@query(f"""WITH p AS (SELECT doc_id, line_index, unnest(list_filter(list_transform(string_split({_BARS}, '|'), lambda x: {Y.strip('x')}), lambda x: x <> '')) AS part FROM ({_L})),
b AS (SELECT *, list_filter(list_transform(regexp_split_to_array(part, {Y.rx(r'\s*\+\s*')}), lambda x: {Y.strip('x')}), lambda x: x <> '') AS bits FROM p)
SELECT DISTINCT doc_id, line_index::INT AS line_index, segment FROM (SELECT doc_id, line_index, part AS segment FROM b
 UNION ALL SELECT doc_id, line_index, unnest(bits) FROM b WHERE contains(part, '+')
 UNION ALL SELECT doc_id, line_index, bits[i] || ' + ' || bits[i + 1] FROM b, unnest(range(1, len(bits))) AS u(i) WHERE contains(part, '+'))""")
def segments(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("doc_id", "line_index", F.explode(S.split_segments(F.col("text"))).alias("segment"))


@query(Y.ngrams(f"(SELECT DISTINCT p_name, {Y.tokens('p_name')} AS t FROM part)", "p_name", "t", 1, 4).replace("s AS start, n", "s::INT AS start, n::INT AS n"))
def segment_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part", ["p_name"]).distinct().select("p_name", F.explode(S.ngrams(X.tokens(F.col("p_name")), 1, 4)).alias("g")).select("p_name", "g.*")


@query(f"""WITH l AS (SELECT *, {Y.tokens('text')} AS t FROM ({_L})),
w AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY line_index) AS nx FROM l),
a AS (SELECT doc_id, line_index, len(t) AS b, list_concat(t, nx) AS al FROM w WHERE nx IS NOT NULL AND len(t) > 0 AND len(nx) > 0 AND len(t) + len(nx) <= 60),
g AS ({Y.ngrams('a', 'doc_id, line_index, b', 'al', 2, 6)}),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, {Y.key('text')} ORDER BY line_index, n, start) AS r FROM g WHERE start < b AND start + n > b)
SELECT doc_id, line_index::INT AS line_index, start::INT AS start, n::INT AS n, text FROM c WHERE r = 1""")
def cross_line_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return S.cross_line_ngrams(_lines(spark, d), ["doc_id"])


# ---- candidates -------------------------------------------------------------------------------------------------


@query("""SELECT image_id, normalized_key, candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, normalized_key ORDER BY CASE source WHEN 'line' THEN 4 WHEN 'whole_line' THEN 3 WHEN 'segment' THEN 2 WHEN 'ngram' THEN 1 ELSE 0 END DESC,
 least(coalesce(token_count, 0), 8) DESC, coalesce(ocr_conf, 0) DESC, length(coalesce(clean_text, '')) DESC, candidate_id) AS r FROM product_candidates WHERE trim(normalized_key) <> '') WHERE r = 1""")
def candidate_dedupe(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "product_candidates", ["candidate_id", "image_id", "normalized_key", "source", "token_count", "ocr_conf", "clean_text"])
    rank = [C.source_priority(F.col("source")), F.least(F.coalesce("token_count", F.lit(0)), F.lit(8)), F.coalesce("ocr_conf", F.lit(0.0)), F.length(X.empty(F.col("clean_text")))]
    return C.dedupe(c, ["image_id"], "normalized_key", rank, "candidate_id").select("image_id", "normalized_key", "candidate_id")


@query("""WITH s AS (SELECT image_id, normalized_key, count(DISTINCT variant_name) AS support FROM product_candidates WHERE trim(normalized_key) <> '' GROUP BY 1, 2), a AS (SELECT image_id, count(DISTINCT variant_name) AS available FROM product_candidates GROUP BY 1)
SELECT image_id, normalized_key, support, available, CASE WHEN available >= 2 THEN round(support / available::DOUBLE, 4) ELSE 0.0 END::DOUBLE AS agreement FROM s JOIN a USING (image_id)""")
def variant_support(spark: SparkSession, d: str) -> DataFrame:
    return C.agreement(table(spark, d, "product_candidates", ["image_id", "normalized_key", "variant_name"]), "image_id", "normalized_key", "variant_name")


@query("""SELECT image_id, candidate_id, rank FROM (SELECT image_id, candidate_id, row_number() OVER (PARTITION BY image_id ORDER BY CASE source WHEN 'line' THEN 4 WHEN 'whole_line' THEN 3 WHEN 'segment' THEN 2 WHEN 'ngram' THEN 1 ELSE 0 END DESC, coalesce(structure_score, 0) DESC, coalesce(ocr_conf, 0) DESC, candidate_id)::INT AS rank FROM product_candidates) WHERE rank <= 5""")
def candidate_topk(spark: SparkSession, d: str) -> DataFrame:
    """The five best candidates of each image, a top-k report."""
    c = table(spark, d, "product_candidates", ["candidate_id", "image_id", "source", "structure_score", "ocr_conf"])
    order = [F.desc(C.source_priority(F.col("source"))), F.desc(F.coalesce("structure_score", F.lit(0.0))), F.desc(F.coalesce("ocr_conf", F.lit(0.0))), F.asc("candidate_id")]
    return C.ranked(c, "image_id", order, 5).select("image_id", "candidate_id", "rank")


_POS = "0.50::DOUBLE * greatest(0, 1 - 0.5::DOUBLE * (abs(cx - 500) / 500 + abs(cy - 500) / 500)) + 0.35::DOUBLE * least(1, w * h / 1000000.0::DOUBLE * 8) + 0.15::DOUBLE * CASE WHEN cy <= 650 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END"


@query(f"""SELECT candidate_id, CASE WHEN ok THEN round(CAST(least(greatest({_POS}, 0), 1) AS DECIMAL(18, 9)), 4)::DOUBLE END::DOUBLE AS score FROM (SELECT *, x + w / 2 AS cx, y + h / 2 AS cy, coalesce(len(bbox_coords) = 4 AND w > 0 AND h > 0, false) AS ok
 FROM (SELECT candidate_id, bbox_coords, bbox_coords[1]::DOUBLE AS x, bbox_coords[2]::DOUBLE AS y, bbox_coords[3]::DOUBLE AS w, bbox_coords[4]::DOUBLE AS h FROM product_candidates))""")
def position_score(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "product_candidates", ["candidate_id", "bbox_coords"])
    return c.select("candidate_id", C.position_score(F.col("bbox_coords"), F.lit(1000.0), F.lit(1000.0)).alias("score"))


# ---- gazetteer --------------------------------------------------------------------------------------------------


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "train_labels", ["product_name"]).select(X.safe_text(F.col("product_name")).alias("name")).where(F.trim("name") != "")


_NAME = "(SELECT CASE WHEN product_name IS NULL OR lower(trim(product_name)) IN ('nan', 'none', 'null') THEN '' ELSE product_name END AS name FROM train_labels)"
_ITEMS = f"list_filter(list_transform(regexp_split_to_array(regexp_replace(name, '\\s+', ' ', 'g'), '\\s+\\+\\s+'), lambda x: {Y.strip('x')}), lambda x: x <> '')"
_SURF = f"""(WITH i AS (SELECT name, {_ITEMS} AS items FROM {_NAME} WHERE trim(name) <> '')
 SELECT {Y.strip("regexp_replace(name, '\\s+', ' ', 'g')")} AS surface, 'full' AS surface_class, len(items) AS n_items FROM i UNION ALL SELECT unnest(items), 'atomic', 1 FROM i WHERE len(items) > 1)"""


@query(f"SELECT surface, surface_class, n_items::BIGINT AS n_items, count(*) AS n FROM {_SURF} GROUP BY ALL")
def product_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return S.product_surfaces(_names(spark, d), "name").groupBy("surface", "surface_class", F.col("n_items").cast("long").alias("n_items")).agg(F.count("*").alias("n"))


_ENT = f"""WITH s AS (SELECT *, {Y.key('surface')} AS canonical_key FROM {_SURF}), g AS (SELECT canonical_key, surface, count(*) AS n, max(n_items) AS items, bool_or(surface_class = 'full') AS f, bool_or(surface_class = 'atomic') AS a FROM s WHERE canonical_key <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY canonical_key ORDER BY n DESC, {Y.count('surface', chr(92) + 'p{L}')} DESC, length(surface) DESC, surface DESC) AS k FROM g)
SELECT substr(sha1('entry:' || canonical_key), 1, 12) AS entry_id, canonical_key, max(surface) FILTER (k = 1) AS canonical_display, CASE WHEN bool_or(f) AND bool_or(a) THEN 'mixed' WHEN bool_or(f) THEN 'full' ELSE 'atomic' END AS source_class, sum(n)::BIGINT AS frequency_prior, max(items)::BIGINT AS item_count FROM r GROUP BY canonical_key"""


def _entries(spark: SparkSession, d: str) -> DataFrame:
    return Z.entries(_names(spark, d), "name")


@query(f"SELECT entry_id, canonical_key, canonical_display, {Y.fold_key('canonical_display')} AS folded_key, source_class, frequency_prior, item_count FROM ({_ENT})")
def gazetteer_entries(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d)


@query("SELECT token, array_to_string(list_sort(list(DISTINCT entry_id)), ',') AS entry_ids FROM (SELECT entry_id, unnest(string_split(folded_key, ' ')) AS token FROM gazetteer_entries) WHERE token <> '' GROUP BY token")
def token_index(spark: SparkSession, d: str) -> DataFrame:
    return Z.token_index(table(spark, d, "gazetteer_entries", ["entry_id", "folded_key"]), "folded_key").select("token", F.array_join("entry_ids", ",").alias("entry_ids"))


_IDX = f"""SELECT DISTINCT kind, key, entry_id FROM (SELECT 'exact' AS kind, canonical_key AS key, entry_id FROM gazetteer_entries UNION ALL SELECT 'folded', folded_key, entry_id FROM gazetteer_entries
 UNION ALL SELECT 'token', unnest(token_keys), entry_id FROM gazetteer_entries UNION ALL SELECT 'folded_token', unnest(folded_token_keys), entry_id FROM gazetteer_entries UNION ALL SELECT 'folded_surface', unnest(folded_surface_keys), entry_id FROM gazetteer_entries
 UNION ALL SELECT 'surface', {Y.key('s')}, entry_id FROM (SELECT entry_id, unnest(surface_variants) AS s FROM gazetteer_entries)) WHERE key IS NOT NULL AND key <> ''"""


@query(_IDX)
def index_table(spark: SparkSession, d: str) -> DataFrame:
    return Z.index_table(table(spark, d, "gazetteer_entries"))


@query(f"SELECT folded, count(DISTINCT key) AS n_keys FROM (SELECT {Y.key('clean_text')} AS key, {Y.fold_key('clean_text')} AS folded FROM product_candidates) WHERE folded <> '' GROUP BY 1 HAVING count(DISTINCT key) > 1")
def folded_collisions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "product_candidates", ["clean_text"]).select(X.key(F.col("clean_text")).alias("key"), X.fold_key(F.col("clean_text")).alias("folded"))
    return t.where("folded <> ''").groupBy("folded").agg(F.count_distinct("key").alias("n_keys")).where("n_keys > 1")


@query("""WITH t AS (SELECT DISTINCT entry_id, unnest(string_split(folded_key, ' ')) AS token FROM gazetteer_entries), df AS (SELECT token FROM t GROUP BY token HAVING count(*) <= greatest(2, floor((SELECT count(*) FROM gazetteer_entries) * 0.10))),
k AS (SELECT t.* FROM t JOIN df USING (token)) SELECT x.token AS a, y.token AS b, count(DISTINCT x.entry_id) AS n_entries FROM k x JOIN k y ON x.entry_id = y.entry_id AND x.token < y.token GROUP BY 1, 2 HAVING count(DISTINCT x.entry_id) > 1""")
def ambiguous_pairs(spark: SparkSession, d: str) -> DataFrame:
    return Z.ambiguous_pairs(table(spark, d, "gazetteer_entries", ["entry_id", "folded_key"]))


@query("SELECT anchor, count(DISTINCT entry_id) AS n_entries FROM (SELECT entry_id, array_to_string(string_split(folded_key, ' ')[1:2], ' ') AS anchor FROM gazetteer_entries) WHERE anchor <> '' GROUP BY 1 HAVING count(DISTINCT entry_id) > 1")
def ambiguous_anchors(spark: SparkSession, d: str) -> DataFrame:
    return Z.shared_anchors(table(spark, d, "gazetteer_entries", ["entry_id", "folded_key"]))


_CLASS = "CASE WHEN named AND NOT blank THEN 'text_with_product' WHEN blank AND NOT named THEN 'blank' WHEN named THEN 'product_only' ELSE 'text_no_product' END"
_NAMED = "coalesce(trim(product_name) <> '' AND lower(trim(product_name)) NOT IN ('nan', 'none', 'null'), false) AS named, coalesce(trim(ocr_text) = '', true) AS blank"


@query(f"SELECT {_CLASS} AS label_class, count(*) AS n FROM (SELECT {_NAMED} FROM train_labels) GROUP BY 1")
def label_classes(spark: SparkSession, d: str) -> DataFrame:
    return Z.label_class(table(spark, d, "train_labels", ["ocr_text", "product_name"]), "ocr_text", "product_name").groupBy("label_class").agg(F.count("*").alias("n"))


@query(f"""WITH l AS (SELECT ocr_text, {_NAMED} FROM train_labels), t AS (SELECT named, unnest(list_distinct(list_transform({Y.tokens(Y.light('ocr_text'))}, lambda x: lower(x)))) AS token FROM l),
dd AS (SELECT token, count(*) FILTER (NOT named) AS df_without, count(*) FILTER (named) AS df_with FROM t WHERE regexp_matches(token, '\\p{{L}}') AND length(token) >= 2 GROUP BY 1),
p AS (SELECT unnest(list_concat(token_keys, folded_token_keys)) AS token FROM gazetteer_entries), n AS (SELECT count(*) FILTER (named) AS n_with FROM l)
SELECT token, df_without, round(df_with / greatest(n_with, 1)::DOUBLE, 6) AS ratio_with FROM dd, n WHERE df_without >= 2 AND token NOT IN (SELECT token FROM p WHERE token IS NOT NULL) AND round(df_with / greatest(n_with, 1)::DOUBLE, 6) <= 0.5 ORDER BY df_without DESC, ratio_with, token DESC LIMIT 300""")
def filler_mining(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gazetteer_entries", ["token_keys", "folded_token_keys"])
    protected = g.select(F.explode(F.concat("token_keys", "folded_token_keys")).alias("token")).distinct()
    labels = table(spark, d, "train_labels", ["ocr_text", "product_name"]).select("ocr_text", (F.trim(X.safe_text(F.col("product_name"))) != "").alias("named"))
    return Z.fillers(labels, "named", "ocr_text", protected, least_df=2, most_ratio=0.5)


@query(f"""WITH a(alias, canonical) AS (VALUES ('pate', 'Pate Gan'), ('kem', 'Kem Đánh Răng'), ('first', (SELECT min(canonical_display) FROM gazetteer_entries)), ('last', (SELECT upper(max(folded_key)) FROM gazetteer_entries))),
k AS (SELECT alias, {Y.key('canonical')} AS k, {Y.fold_key('canonical')} AS f FROM a)
SELECT alias, coalesce(e.entry_id, (SELECT min(x.entry_id) FROM gazetteer_entries x WHERE x.folded_key = k.f)) AS entry_id FROM k LEFT JOIN gazetteer_entries e ON e.canonical_key = k.k WHERE coalesce(e.entry_id, (SELECT min(x.entry_id) FROM gazetteer_entries x WHERE x.folded_key = k.f)) IS NOT NULL""")
def alias_enrich(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "gazetteer_entries")
    a = spark.createDataFrame([("pate", "Pate Gan"), ("kem", "Kem Đánh Răng")], "alias string, canonical string")
    a = a.unionByName(g.agg(F.min("canonical_display").alias("canonical")).select(F.lit("first").alias("alias"), "canonical")).unionByName(g.agg(F.upper(F.max("folded_key")).alias("canonical")).select(F.lit("last").alias("alias"), "canonical"))
    return Z.add_aliases(g, a)


@query(f"SELECT count(*) AS n_surfaces, count(e.canonical_key) AS n_known, round(count(e.canonical_key) / greatest(count(*), 1)::DOUBLE, 6) AS coverage FROM (SELECT {Y.key('surface')} AS k FROM {_SURF}) s LEFT JOIN (SELECT DISTINCT canonical_key FROM gazetteer_entries) e ON s.k = e.canonical_key WHERE s.k <> ''")
def coverage_check(spark: SparkSession, d: str) -> DataFrame:
    return Z.coverage(S.product_surfaces(_names(spark, d), "name"), table(spark, d, "gazetteer_entries", ["canonical_key"]))


@query("SELECT row_number() OVER (ORDER BY frequency_prior DESC, canonical_display)::INT AS rank, canonical_display, frequency_prior FROM gazetteer_entries ORDER BY frequency_prior DESC, canonical_display LIMIT 20")
def gazetteer_summary(spark: SparkSession, d: str) -> DataFrame:
    return Z.summary(table(spark, d, "gazetteer_entries", ["canonical_display", "frequency_prior"]))


# ---- linking ----------------------------------------------------------------------------------------------------

_PHR = f"(SELECT DISTINCT {Y.key('clean_text')} AS key FROM product_candidates)"


@query(f"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n+')) AS line FROM documents), k AS (SELECT DISTINCT doc_id, {Y.key("regexp_replace(line, '^\\s*(?:[-*•+✓]|\\d+[.)])\\s+', '')")} AS key FROM l)
SELECT doc_id, key FROM k WHERE key <> '' AND key IN (SELECT {Y.key('canonical_display')} FROM gazetteer_entries)""")
def link_exact(spark: SparkSession, d: str) -> DataFrame:
    return L.exact_links(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "gazetteer_entries", ["canonical_display"]), "doc_id", "text", "canonical_display")


@query(f"""WITH p AS (SELECT key, {Y.fold_key('key')} AS folded FROM {_PHR} WHERE key <> ''), i AS ({_IDX}),
w AS (SELECT DISTINCT key, kind, k FROM (SELECT key, 'exact' AS kind, key AS k FROM p UNION ALL SELECT key, 'surface', key FROM p UNION ALL SELECT key, 'folded', folded FROM p UNION ALL SELECT key, 'folded_surface', folded FROM p UNION ALL SELECT key, 'token', unnest(string_split(key, ' ')) FROM p UNION ALL SELECT key, 'folded_token', unnest(string_split(folded, ' ')) FROM p)),
h AS (SELECT w.key, i.entry_id, 2 * count(*) FILTER (w.kind = 'exact') + count(*) FILTER (w.kind = 'surface') AS a, 2 * count(*) FILTER (w.kind = 'folded') + count(*) FILTER (w.kind = 'folded_surface') AS b, count(*) FILTER (w.kind = 'token') AS shared, count(*) FILTER (w.kind = 'folded_token') AS folded_shared FROM w JOIN i ON w.kind = i.kind AND w.k = i.key GROUP BY 1, 2),
r AS (SELECT h.*, row_number() OVER (PARTITION BY h.key ORDER BY a DESC, b DESC, shared DESC, folded_shared DESC, frequency_prior DESC, canonical_display DESC, h.entry_id) AS rank FROM h JOIN gazetteer_entries e USING (entry_id))
SELECT key, entry_id, shared, folded_shared, rank::INT AS rank FROM r WHERE rank <= 80""")
def retrieve_topk(spark: SparkSession, d: str) -> DataFrame:
    p = L.phrases(table(spark, d, "product_candidates", ["clean_text"]), "clean_text")
    return L.retrieve(p, table(spark, d, "gazetteer_entries"))


@query()
def link_best(spark: SparkSession, d: str) -> DataFrame:
    """Best entry, second score and margin of each distinct phrase."""
    p = L.phrases(table(spark, d, "product_candidates", ["clean_text"]), "clean_text")
    return L.matches(p, table(spark, d, "gazetteer_entries"))


@query()
def similarity_scores(spark: SparkSession, d: str) -> DataFrame:
    """The ratio family over each entry's display and its surface variants."""
    g = table(spark, d, "gazetteer_entries", ["entry_id", "folded_key", "folded_surface_keys"]).select("entry_id", "folded_key", F.explode("folded_surface_keys").alias("surface"))
    a, b = F.col("folded_key"), F.col("surface")
    return g.select("entry_id", "surface", *[F.round(f(a, b), 4).alias(n) for n, f in (("ratio", similarity.ratio), ("partial", similarity.partial_ratio), ("token_sort", similarity.token_sort_ratio), ("token_set", similarity.token_set_ratio))])


# ---- rules and context ------------------------------------------------------------------------------------------

RULES = [("toothpaste", 90, 0.9, "Kem Đánh Răng", ["kem danh|rang", "toothpaste"]), ("pate", 80, 0.8, "Pate Gan", ["pate|gan", "gan|pate"]), ("corn_snack", 95, 0.95, "Snack Bắp", ["snack|bap", "bim|bap"])]
STOP_PHRASES = ("giao hang", "khuyen mai", "mua ngay", "xem them")
LEXICON = ["khuyen mai", "giao hang", "cong ty", "gia", "tang ban", "thanh phan", "bao quan", "han dung"]
_VALUES = ", ".join(f"('{r}', {p}, {s}::DOUBLE, '{c}', {i}, {Y.rx(U.pattern(a))})" for r, p, s, c, alts in RULES for i, a in enumerate(alts))
_HITS = f"""SELECT doc_id, rule, canonical, priority, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, rule ORDER BY seq) AS k FROM (SELECT doc_id, {Y.rule_text('text')} AS norm FROM documents) t JOIN (VALUES {_VALUES}) r(rule, priority, score, canonical, seq, pattern) ON norm <> '' AND regexp_matches(norm, pattern)) WHERE k = 1"""


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return U.hits(table(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text", U.registry(spark, RULES))


@query(_HITS)
def rule_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


@query(f"SELECT doc_id, rule, canonical, priority, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, score DESC, length(canonical) DESC, rule) AS q FROM ({_HITS})) WHERE q = 1")
def rule_resolve(spark: SparkSession, d: str) -> DataFrame:
    return U.resolve(_hits(spark, d), "doc_id").select("doc_id", "rule", "canonical", "priority", "score")


@query(f"SELECT rejected, count(*) AS n FROM (SELECT (r = '' OR r IN ({', '.join(Y.rx(w) for w in STOP_PHRASES)})) AS rejected FROM (SELECT {Y.rule_text('clean_text')} AS r FROM product_candidates)) GROUP BY 1")
def short_reject(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "product_candidates", ["clean_text"]).groupBy(U.rejected(F.col("clean_text"), STOP_PHRASES).alias("rejected")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, array_to_string(h, '|') AS hits, len(h)::INT AS n_hits FROM (SELECT doc_id, list_sort(list_filter([{', '.join(Y.rx(w) for w in LEXICON)}], lambda p: contains(norm, p))) AS h FROM (SELECT doc_id, {Y.rule_text('text')} AS norm FROM documents))")
def context_hits(spark: SparkSession, d: str) -> DataFrame:
    return U.lexicon_hits(table(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text", LEXICON)


# ---- gate -------------------------------------------------------------------------------------------------------


ANCHORS, AGAINST, FOR = ["kem", "sua", "tra", "bun", "snack"], ["tuyen dung", "khuyen mai", "giao hang"], ["thanh phan", "han dung", "bao quan"]


def _linked(spark: SparkSession, d: str) -> DataFrame:
    """Candidates linked by the exact tiers, with margin, agreement of variants, context and the gate's score."""
    c = table(spark, d, "product_candidates", ["candidate_id", "image_id", "variant_name", "source", "clean_text", "normalized_key", "line_index", "ocr_conf", "position_score", "structure_score"])
    e = table(spark, d, "gazetteer_entries")
    j = L.link(c, e, cfg=L.LinkConfig(fuzzy=False)).where("matched").withColumnsRenamed({"score": "match_score", "candidate_id": "seq"})
    agree = C.agreement(c, "image_id", "normalized_key", "variant_name").select("image_id", "normalized_key", "agreement", "available")
    # both grow with the candidates, whatever the planner makes of their files' size
    j = j.join(agree.hint("merge"), ["image_id", "normalized_key"], "left").join(G.context(c, "image_id", ["clean_text"], AGAINST, FOR).hint("merge"), "image_id")
    j = j.join(F.broadcast(e.agg(F.max("frequency_prior").alias("most")))).withColumn("words", F.array_distinct(F.split(X.fold_key(F.col("key")), " ")))  # one row
    g = G.gate_score(F.col("match_score"), F.col("margin"), F.col("structure_score"), F.col("source"), F.col("ocr_conf"), F.col("agreement"), F.col("available"), F.col("position_score"), F.col("prior"), F.col("most"), F.col("match_type"), F.col("positive"), F.col("negative"))
    own = G.specific(F.col("match_type"), F.col("match_score"), F.col("folded_overlap"), F.col("candidate_coverage"), F.col("words"), ANCHORS)
    return j.withColumn("gate_score", g).withColumn("specific", own)


_TIERS = f"""(WITH p AS (SELECT key, {Y.fold_key('key')} AS folded FROM {_PHR} WHERE key <> ''), e AS (SELECT *, coalesce(surface_variants, []) AS sv FROM gazetteer_entries),
h AS (SELECT p.key, e.entry_id, 100.0 AS s FROM p JOIN e ON p.key = e.canonical_key UNION ALL SELECT p.key, x.entry_id, 99.0 FROM p JOIN (SELECT entry_id, {Y.key('v', compose=False)} AS k FROM (SELECT entry_id, unnest(sv) AS v FROM e)) x ON p.key = x.k
 UNION ALL SELECT p.key, e.entry_id, 98.0 FROM p JOIN e ON p.folded = e.folded_key UNION ALL SELECT p.key, x.entry_id, 97.0 FROM p JOIN (SELECT entry_id, unnest(folded_surface_keys) AS k FROM e) x ON p.folded = x.k),
b AS (SELECT key, entry_id, max(s)::DOUBLE AS score FROM h GROUP BY 1, 2), o AS (SELECT b.*, len(list_intersect(list_distinct(string_split(p.folded, ' ')), e.folded_token_keys)) AS ov, len(list_distinct(string_split(p.folded, ' '))) AS pn, len(e.folded_token_keys) AS en, e.frequency_prior, e.canonical_display FROM b JOIN p USING (key) JOIN e USING (entry_id)),
r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS nxt FROM o WINDOW w AS (PARTITION BY key ORDER BY score DESC, ov DESC, round(ov / greatest(pn, 1)::DOUBLE, 4) DESC, round(ov / greatest(en, 1)::DOUBLE, 4) DESC, frequency_prior DESC, canonical_display DESC, entry_id))
SELECT key, entry_id, score AS match_score, round(score - coalesce(nxt, 0), 4) AS margin, CASE score WHEN 100 THEN 'exact' WHEN 99 THEN 'surface_exact' WHEN 98 THEN 'folded_exact' ELSE 'surface_folded' END AS match_type, frequency_prior AS prior FROM r WHERE k = 1)"""
_CTX = f"""(SELECT image_id, len(list_distinct(flatten(list(list_filter([{', '.join(Y.rx(x) for x in AGAINST)}], lambda q: contains(t, q)))))) AS negative, len(list_distinct(flatten(list(list_filter([{', '.join(Y.rx(x) for x in FOR)}], lambda q: contains(t, q)))))) AS positive FROM (SELECT image_id, {Y.rule_text('clean_text')} AS t FROM product_candidates) GROUP BY 1)"""
_LINKED = f"""SELECT seq, image_id, entry_id, source, line_index, words, match_score, margin, match_type, match_score >= 94 AS is_strong, true AS specific, negative, round(CAST(least(greatest(0.42::DOUBLE * match_score / 100 + 0.14::DOUBLE * least(greatest(margin / 12, 0), 1) + 0.10::DOUBLE * coalesce(structure_score, 0.60) + 0.08::DOUBLE * CASE source WHEN 'line' THEN 1.0 WHEN 'whole_line' THEN 0.95 WHEN 'segment' THEN 0.85 WHEN 'ngram' THEN 0.70 ELSE 0.60 END::DOUBLE
 + 0.08::DOUBLE * CASE WHEN ocr_conf IS NULL THEN 0.65::DOUBLE WHEN ocr_conf <= 0 THEN 0.55::DOUBLE ELSE least(ocr_conf, 1) END + 0.05::DOUBLE * CASE WHEN coalesce(available, 0) < 2 THEN 0 ELSE least(greatest(coalesce(agreement, 0), 0), 1) END
 + 0.04::DOUBLE * CASE WHEN position_score IS NULL OR position_score <= 0 THEN 0.50::DOUBLE ELSE least(position_score, 1) END + 0.04::DOUBLE * CASE WHEN prior > 0 THEN least(greatest(ln(1 + prior) / ln(1 + most), 0), 1) ELSE 0 END
 + 0.05::DOUBLE * least(positive / 3.0::DOUBLE, 1) - least(0.06::DOUBLE * negative, 0.24::DOUBLE), 0), 1) AS DECIMAL(18, 9)), 4)::DOUBLE AS gate_score
 FROM (SELECT c.*, c.candidate_id AS seq, t.*, list_distinct(string_split({Y.fold_key('t.key')}, ' ')) AS words, a.agreement, a.available, x.negative, x.positive, (SELECT max(frequency_prior) FROM gazetteer_entries) AS most
 FROM (SELECT *, {Y.key('clean_text')} AS ck FROM product_candidates) c JOIN {_TIERS} t ON c.ck = t.key LEFT JOIN ({SQL['variant_support']}) a ON c.image_id = a.image_id AND c.normalized_key = a.normalized_key JOIN {_CTX} x ON c.image_id = x.image_id)"""
_EVID = f"""SELECT v.*, coalesce(item_count, 1) AS item_count, coalesce(folded_token_keys, []) AS words, coalesce(frequency_prior, 0) AS prior, match_score >= 88 AND (is_strong OR margin >= 8) AND gate_score >= CASE WHEN is_strong THEN 0.72 ELSE 0.82 END AS ok FROM (SELECT image_id, entry_id, max(gate_score) AS gate_score, arg_max(match_score, (gate_score, -seq)) AS match_score, arg_max(margin, (gate_score, -seq)) AS margin, arg_max(match_type, (gate_score, -seq)) AS match_type, arg_max(is_strong, (gate_score, -seq)) AS is_strong, count(*) AS support, count(DISTINCT source) AS n_sources, min(line_index) AS first_line, any_value(negative) AS negative FROM ({_LINKED}) GROUP BY 1, 2) v JOIN gazetteer_entries USING (entry_id)"""


@query(f"SELECT seq AS candidate_id, entry_id, margin, match_type, gate_score FROM ({_LINKED})")
def gate_score(spark: SparkSession, d: str) -> DataFrame:
    return _linked(spark, d).select(F.col("seq").alias("candidate_id"), "entry_id", "margin", "match_type", "gate_score")


@query(f"SELECT image_id, entry_id, gate_score, match_type, support, n_sources, first_line FROM ({_EVID})")
def entry_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = G.evidence(_linked(spark, d), "image_id")
    return e.select("image_id", "entry_id", "gate_score", "match_type", "support", "n_sources", "first_line")


@query(f"SELECT image_id, entry_id FROM ({_EVID}) WHERE ok")
def entry_qualify(spark: SparkSession, d: str) -> DataFrame:
    return G.evidence(_linked(spark, d), "image_id").where(G.qualifies()).select("image_id", "entry_id")


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Evidence with the entries' facts, and the pool of words, of each image; the links are written once."""
    linked = written(_linked(spark, d).select("image_id", "entry_id", "seq", "source", "line_index", "words", "gate_score", "match_score", "margin", "match_type", "is_strong", "specific"))
    facts = table(spark, d, "gazetteer_entries").select("entry_id", F.coalesce("item_count", F.lit(1)).alias("item_count"), F.coalesce("folded_token_keys", F.array().cast("array<string>")).alias("words"), F.coalesce("frequency_prior", F.lit(0)).alias("prior"))
    return G.evidence(linked, "image_id").join(facts, "entry_id"), G.token_pool(linked, "image_id", "words")


_DEDUP = """SELECT a.* FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.image_id = a.image_id AND b.k < a.k AND list_has_all(b.words, a.words))"""
_CHOSEN = f"""(WITH v AS ({_EVID}), pool AS (SELECT image_id, list_distinct(flatten(list(words))) AS pool FROM ({_LINKED}) GROUP BY 1),
f AS (SELECT v.*, len(list_intersect(v.words, pool)) / len(v.words)::DOUBLE AS cov, (SELECT count(*) FROM v a WHERE a.image_id = v.image_id AND a.ok AND a.entry_id <> v.entry_id AND len(a.words) > 0 AND list_has_all(v.words, a.words)) AS parts FROM v JOIN pool USING (image_id) WHERE item_count > 1 AND len(v.words) > 0),
f1 AS (SELECT image_id, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY cov DESC, len(words) DESC, match_score DESC, entry_id DESC) AS k FROM f WHERE ok OR (match_score >= 88 AND cov >= 0.7 AND parts >= 2)) WHERE k = 1),
a AS (WITH s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY len(words) DESC, prior DESC, gate_score DESC, entry_id DESC) AS k FROM v WHERE ok AND item_count <= 1) {_DEDUP}),
m AS (SELECT image_id, string_agg(entry_id, ',' ORDER BY k2) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY first_line NULLS LAST, gate_score DESC, entry_id) AS k2, count(*) OVER (PARTITION BY image_id) AS c FROM a) WHERE c > 1 AND k2 <= 4 GROUP BY 1),
o AS (SELECT image_id, entry_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gate_score DESC, match_score DESC, prior DESC, entry_id DESC) AS k3 FROM (WITH s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY len(words) DESC, prior DESC, gate_score DESC, entry_id DESC) AS k FROM v WHERE ok) {_DEDUP})) WHERE k3 = 1)
SELECT i.image_id, CASE WHEN f1.entry_id IS NOT NULL THEN 'full' WHEN m.ids IS NOT NULL THEN 'multi' ELSE 'single' END AS mode, coalesce(f1.entry_id, m.ids, o.entry_id) AS chosen FROM (SELECT DISTINCT image_id FROM v) i LEFT JOIN f1 USING (image_id) LEFT JOIN m USING (image_id) LEFT JOIN o USING (image_id) WHERE coalesce(f1.entry_id, m.ids, o.entry_id) IS NOT NULL)"""


@query(f"SELECT * FROM {_CHOSEN}")
def full_vs_compose(spark: SparkSession, d: str) -> DataFrame:
    e, pool = _evidence(spark, d)
    return G.choose(e, "image_id", pool).select("image_id", "mode", F.array_join("chosen", ",").alias("chosen"))


@query(f"WITH s AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY len(words) DESC, prior DESC, gate_score DESC, entry_id DESC) AS k FROM ({_EVID})) SELECT image_id, entry_id FROM ({_DEDUP})")
def subset_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e, _ = _evidence(spark, d)
    return G.drop_subsets(e.withColumn("n", F.size("words")), "image_id", "words", ["n", "prior", "gate_score", "entry_id"]).select("image_id", "entry_id")


@query(f"SELECT image_id, array_to_string(list_sort(list_distinct(flatten(list(words)))), ',') AS pool FROM ({_LINKED}) GROUP BY 1")
def token_pool(spark: SparkSession, d: str) -> DataFrame:
    return G.token_pool(_linked(spark, d), "image_id", "words").select("image_id", F.array_join(F.array_sort("pool"), ",").alias("pool"))


@query(f"SELECT image_id, negative, positive FROM {_CTX}")
def context_evidence(spark: SparkSession, d: str) -> DataFrame:
    return G.context(table(spark, d, "product_candidates", ["image_id", "clean_text"]), "image_id", ["clean_text"], AGAINST, FOR).select("image_id", F.col("negative").cast("long").alias("negative"), F.col("positive").cast("long").alias("positive"))


_TEXTS = f"(SELECT image_id, norm FROM (SELECT image_id, trim(string_agg({Y.rule_text('text')}, ' ' ORDER BY variant_name, line_index NULLS FIRST, line_id)) AS norm FROM ocr_lines WHERE text IS NOT NULL GROUP BY 1) WHERE norm <> '')"
_BEST = f"""(SELECT image_id, canonical, priority FROM (SELECT image_id, canonical, priority, row_number() OVER (PARTITION BY image_id ORDER BY priority DESC, score DESC, length(canonical) DESC, rule) AS k FROM {_TEXTS} t JOIN (VALUES {_VALUES}) r(rule, priority, score, canonical, seq, pattern) ON regexp_matches(norm, pattern)) WHERE k = 1)"""


def _image_rules(spark: SparkSession, d: str) -> DataFrame:
    """The best rule's hit of each image, over all of its lines."""
    lines = table(spark, d, "ocr_lines", ["image_id", "variant_name", "line_index", "line_id", "text"]).where("text is not null")
    text = lines.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant_name", "line_index", "line_id", "text"))), lambda x: x["text"]), " ").alias("text"))
    return U.resolve(U.hits(text, "image_id", "text", U.registry(spark, RULES)), "image_id")


@query(f"""SELECT i.image_id, CASE WHEN b.priority >= 90 THEN 'rule' WHEN mode IS NOT NULL THEN mode ELSE 'no_match' END AS reason, CASE WHEN b.priority >= 90 THEN b.canonical ELSE coalesce(chosen, '') END AS chosen FROM (SELECT DISTINCT image_id FROM ocr_lines) i LEFT JOIN {_BEST} b USING (image_id) LEFT JOIN {_CHOSEN} c USING (image_id)""")
def gate_decision(spark: SparkSession, d: str) -> DataFrame:
    e, pool = _evidence(spark, d)
    out = G.decide(table(spark, d, "ocr_lines", ["image_id"]), G.choose(e, "image_id", pool), _image_rules(spark, d), "image_id", G.context(table(spark, d, "product_candidates", ["image_id", "clean_text"]), "image_id", ["clean_text"], AGAINST, FOR).hint("merge"))
    return out.select("image_id", "reason", F.array_join("chosen", ",").alias("chosen"))


@query(f"SELECT image_id, canonical FROM {_BEST} WHERE priority >= 90 AND image_id NOT IN (SELECT image_id FROM {_CHOSEN})")
def rescue_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Images without a chosen entry that a strong rule names."""
    e, pool = _evidence(spark, d)
    return G.rescued(table(spark, d, "ocr_lines", ["image_id"]), G.choose(e, "image_id", pool), _image_rules(spark, d), "image_id")


@query("SELECT image_id FROM (SELECT DISTINCT image_id FROM train_labels) ANTI JOIN ocr_selections USING (image_id)")
def cache_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return P.not_cached(table(spark, d, "train_labels", ["image_id"]), table(spark, d, "ocr_selections", ["image_id"]), "image_id")


@query()
def final_names(spark: SparkSession, d: str) -> DataFrame:
    """Final name of each label, its items split, cleaned, deduplicated and joined."""
    named = table(spark, d, "train_labels", ["label_id", "product_name"]).select("label_id", X.nfc(X.safe_text(F.col("product_name"))).alias("n"))
    return named.select("label_id", P.final_names(S.product_items(F.col("n"))).alias("final_name"))


_SUB = f"""SELECT i.image_id, coalesce(t.ocr_text, '') AS ocr_text, coalesce(c.chosen, '') AS product_name FROM (SELECT DISTINCT image_id FROM train_labels) i LEFT JOIN (SELECT image_id, arg_max(ocr_text, (length(ocr_text), ocr_text)) AS ocr_text FROM train_labels WHERE ocr_text IS NOT NULL GROUP BY 1) t USING (image_id) LEFT JOIN {_CHOSEN} c USING (image_id)"""


def _submission(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "train_labels", ["image_id", "ocr_text"])
    e, pool = _evidence(spark, d)
    chosen = G.choose(e, "image_id", pool).select("image_id", F.array_join("chosen", ",").alias("product_name"))
    return P.submission(labels, chosen, labels.where("ocr_text is not null"), "image_id")


@query(_SUB)
def submission(spark: SparkSession, d: str) -> DataFrame:
    return _submission(spark, d)


@query(f"SELECT count(*) AS n_rows, count(*) - count(DISTINCT image_id) AS duplicate_keys, count(*) FILTER (trim(ocr_text) = '') AS blank_ocr_text, round(1 - count(*) FILTER (trim(ocr_text) = '') / count(*)::DOUBLE, 6) AS fill_ocr_text, count(*) FILTER (trim(product_name) = '') AS blank_product_name, round(1 - count(*) FILTER (trim(product_name) = '') / count(*)::DOUBLE, 6) AS fill_product_name FROM ({_SUB})")
def validate_submission(spark: SparkSession, d: str) -> DataFrame:
    return M.validate(_submission(spark, d), "image_id", ["ocr_text", "product_name"])


# ---- quality and routing ----------------------------------------------------------------------------------------

_JUNK = {"n_chars": "length(x)", "alnum_chars": Y.count("x", r"[\p{L}\p{N}]"), "alpha_chars": Y.count("x", r"\p{L}"), "digit_chars": Y.count("x", r"\p{Nd}"), "space_chars": Y.count("x", r"[\s\p{Z}]"), "cjk_chars": Y.count("x", Q.CJK), "kana_chars": Y.count("x", Q.KANA), "hangul_chars": Y.count("x", Q.HANGUL), "emoji_chars": Y.count("x", Q.EMOJI), "symbol_chars": Y.count("x", r"[\p{So}\p{Sk}\p{Cf}\p{Co}]")}
_RATIO = {"alnum_ratio": _JUNK["alnum_chars"], "cjk_ratio": f"({_JUNK['cjk_chars']} + {_JUNK['kana_chars']} + {_JUNK['hangul_chars']})", "symbol_ratio": _JUNK["symbol_chars"], "junk_ratio": Y.count("x", f"{Q.CJK}|{Q.KANA}|{Q.HANGUL}|{Q.EMOJI}|[\\p{{So}}\\p{{Sk}}\\p{{Cf}}\\p{{Co}}]")}
_STATS = ", ".join([*(f"({v})::BIGINT AS {k}" for k, v in _JUNK.items()), *(f"round({Y.ratio_of(v, 'length(x)')}, 6) AS {k}" for k, v in _RATIO.items())])


@query(f"SELECT line_id, {_STATS} FROM (SELECT line_id, coalesce(text, '') AS x FROM ocr_lines)")
def junk_stats(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ocr_lines", ["line_id", "text"]).select("line_id", *[v.alias(k) for k, v in Q.junk_stats(F.col("text")).items()])


def readings(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "ocr_lines", ["line_id", "image_id", "variant_name", "line_index", "text", "conf"])
    r = Q.read_variants(lines, "image_id", "variant_name", "text", "conf", ["line_index", "line_id"])
    r = r.withColumn("why", Q.reasons(F.lit(None).cast("string"), F.col("boxes"), F.col("text"), F.col("conf")))
    return r.withColumn("score", Q.quality_score(F.col("boxes"), F.col("text"), F.col("conf"), F.col("why"), F.col("variant"))).withColumn("fatal", Q.is_fatal(F.col("why")))


_READ = f"""SELECT *, round(CAST(CASE WHEN st = '' THEN 0.0 ELSE least(greatest(0.45::DOUBLE * least(greatest(coalesce(conf, 0), 0), 1) + 0.20::DOUBLE * least(alnum_chars / 60.0::DOUBLE, 1) + 0.10::DOUBLE * least(boxes / 10.0::DOUBLE, 1) + 0.25::DOUBLE * (1 - least(junk_ratio, 1)) - CASE WHEN len(why) > 0 THEN 0.25::DOUBLE ELSE 0 END
 + CASE WHEN variant = 'soft_enhanced' THEN -0.015::DOUBLE WHEN variant = 'raw_resized' THEN 0.005::DOUBLE ELSE 0 END - CASE WHEN alnum_chars > 180 THEN least((alnum_chars - 180) / 600.0::DOUBLE, 0.10::DOUBLE) ELSE 0 END - CASE WHEN boxes > 40 THEN least((boxes - 40) / 150.0::DOUBLE, 0.06::DOUBLE) ELSE 0 END, -1), 1) END AS DECIMAL(18, 9)), 4)::DOUBLE::DOUBLE AS score, list_has_any(why, [{', '.join(Y.rx(x) for x in Q.FATAL)}]) AS fatal
 FROM (SELECT *, list_filter([CASE WHEN boxes < 1 THEN 'no_or_too_few_boxes' END, CASE WHEN length(st) < 3 THEN 'text_too_short' END, CASE WHEN alnum_chars < 4 THEN 'too_few_alnum_chars' END, CASE WHEN coalesce(conf, 0) < 0.18 THEN 'very_low_avg_conf' END, CASE WHEN coalesce(conf, 0) >= 0.18 AND conf < 0.35 AND alnum_chars < 20 THEN 'low_avg_conf_short_text' END, CASE WHEN cjk_ratio > 0.20 THEN 'too_many_cjk_kana_hangul_chars' END,
 CASE WHEN {Y.emoji_ratio('st')} > 0.20 THEN 'too_many_emoji_chars' END, CASE WHEN symbol_ratio > 0.55 THEN 'too_many_symbol_chars' END, CASE WHEN junk_ratio > 0.35 THEN 'too_much_junk' END, CASE WHEN st <> '' AND alnum_chars = 0 THEN 'no_alnum_only_symbols' END], lambda r: r IS NOT NULL) AS why
 FROM (SELECT *, {Y.strip('x')} AS st, {_STATS} FROM (SELECT image_id, variant_name AS variant, string_agg(text, chr(10) ORDER BY line_index NULLS FIRST, line_id) AS x, avg(conf) FILTER (conf >= 0 AND conf <= 1) AS conf, count(*) AS boxes FROM ocr_lines WHERE text IS NOT NULL GROUP BY 1, 2)))"""


@query(f"SELECT image_id, variant, array_to_string(why, '|') AS why, score, fatal FROM ({_READ})")
def quality_report(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("image_id", "variant", F.array_join("why", "|").alias("why"), "score", "fatal")


@query(f"""SELECT image_id, variant, CASE WHEN NOT fatal AND variant = 'hard_fallback' THEN 'hard_first_non_fatal' WHEN NOT fatal THEN 'best_non_fatal' ELSE 'best_overall' END AS reason, score FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY fatal, CASE WHEN NOT fatal THEN o ELSE 0 END, score DESC, o) AS k
 FROM (SELECT *, coalesce(list_position(['hard_fallback', 'raw_resized', 'soft_enhanced'], variant), 0) AS o FROM ({_READ}))) WHERE k = 1""")
def variant_select(spark: SparkSession, d: str) -> DataFrame:
    return Q.choose_variant(readings(spark, d), "image_id")


@query("""SELECT vec_id, round(list_avg(l), 4) AS mean_luma, round(list_stddev_pop(l), 4) AS std_luma, round(quantile_cont_05, 4) AS p05, round(quantile_cont_95, 4) AS p95, round(len(list_filter(l, lambda x: x < 25 OR x > 230)) / len(l)::DOUBLE, 6) AS near_binary_ratio
 FROM (SELECT vec_id, l, list_aggregate(l, 'quantile_cont', 0.05) AS quantile_cont_05, list_aggregate(l, 'quantile_cont', 0.95) AS quantile_cont_95 FROM (SELECT vec_id, list_transform(embedding, lambda x: (x * 100 + 128)::DOUBLE) AS l FROM embeddings))""")
def array_image_stats(spark: SparkSession, d: str) -> DataFrame:
    luma = F.transform("embedding", lambda x: (x * F.lit(100).cast("float") + F.lit(128).cast("float")).cast("double"))
    e = table(spark, d, "embeddings", ["vec_id", "embedding"]).select("vec_id", luma.alias("l"))
    s = R.luma_stats(F.col("l"))
    return e.select("vec_id", *[F.round(s[k], 6 if k == "near_binary_ratio" else 4).alias(k) for k in ("mean_luma", "std_luma", "p05", "p95", "near_binary_ratio")])


def _features(spark: SparkSession, d: str) -> DataFrame:
    v, i = F.col("value"), F.col("event_id")
    return table(spark, d, "events", ["event_id", "value"]).select("event_id", R.scale((400 + F.pmod(i, F.lit(900))).cast("double"), (1200 + F.pmod(i, F.lit(1700))).cast("double")).alias("scale"), F.pmod(v * 7, F.lit(255.0)).alias("mean_luma"), F.pmod(v * 3, F.lit(80.0)).alias("std_luma"), F.pmod(v * 5, F.lit(230.0)).alias("luma_range"), F.pmod(v * 11, F.lit(150.0)).alias("laplacian"), (F.pmod(i, F.lit(100)) / 1000).alias("edge_density"), F.pmod(i * 7, F.lit(20)).cast("double").alias("noise"), F.pmod(i * 3, F.lit(40)).cast("double").alias("background"), (F.pmod(i, F.lit(10)) / 10).alias("near_binary_ratio"))


_FEAT = "SELECT event_id, least(greatest(least(CASE WHEN s < 900 THEN 900.0::DOUBLE / s ELSE 1 END, 1600.0::DOUBLE / l), 0.5), 2.5) AS scale, value * 7 % 255.0::DOUBLE AS mean_luma, value * 3 % 80.0::DOUBLE AS std_luma, value * 5 % 230.0::DOUBLE AS luma_range, value * 11 % 150.0::DOUBLE AS laplacian, (event_id % 100) / 1000.0::DOUBLE AS edge_density, (event_id * 7 % 20)::DOUBLE AS noise, (event_id * 3 % 40)::DOUBLE AS background, (event_id % 10) / 10.0::DOUBLE AS near_binary_ratio FROM (SELECT *, (400 + event_id % 900)::DOUBLE AS s, (1200 + event_id % 1700)::DOUBLE AS l FROM events)"
_FLAGS = {"small_image_upscale": "scale > 1.10", "large_image_downscale": "scale < 0.90", "dark": "mean_luma < 75", "bright": "mean_luma > 205", "low_contrast": "(std_luma < 38 OR luma_range < 115)", "very_low_contrast": "(std_luma < 25 OR luma_range < 80)", "blurry": "(laplacian < 70 AND edge_density < 0.075)", "very_blurry": "(laplacian < 35 AND edge_density < 0.045)", "noisy": "noise > 7.5", "very_noisy": "noise > 13", "uneven_background": "background > 18", "strong_uneven_background": "background > 28", "near_binary": "near_binary_ratio > 0.55"}


@query(f"""WITH f AS ({_FEAT}), g AS (SELECT *, list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FLAGS.items())}], lambda x: x IS NOT NULL) AS flags FROM f),
a AS (SELECT *, len(list_intersect(flags, ['low_contrast', 'dark', 'bright', 'uneven_background'])) > 0 AND NOT list_contains(flags, 'near_binary') AS clahe, list_contains(flags, 'noisy') AS med, list_contains(flags, 'very_noisy') AND NOT list_contains(flags, 'very_blurry') AS gau FROM g),
b AS (SELECT *, (list_contains(flags, 'blurry') OR scale > 1.15 OR clahe) AND NOT list_contains(flags, 'very_noisy') AS sha FROM a)
SELECT event_id, CASE WHEN clahe OR med OR gau OR sha THEN 'soft_enhanced' ELSE 'raw_resized' END AS primary_variant, CASE WHEN len(flags) > 0 THEN array_to_string(flags, '+') ELSE 'clean_or_unknown' END AS reason, CASE WHEN list_contains(flags, 'uneven_background') THEN 'adaptive' ELSE 'otsu' END AS threshold_mode, sha AS use_sharpen,
 len(list_intersect(flags, ['very_low_contrast', 'strong_uneven_background', 'near_binary', 'very_blurry'])) > 0 AS use_hard_fallback FROM b""")
def router_decision(spark: SparkSession, d: str) -> DataFrame:
    return R.route(_features(spark, d)).select("event_id", "primary_variant", "reason", "threshold_mode", "use_sharpen", "use_hard_fallback")


# ---- metrics ----------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return M.audit_summary(table(spark, d, "events", ["event_type", "value"]), "event_type", "value")


@query("SELECT source, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, source NULLS LAST LIMIT 20")
def value_counts_topk(spark: SparkSession, d: str) -> DataFrame:
    return M.top_counts(table(spark, d, "documents", ["source"]), "source")


@query("SELECT user_id, arg_min(event_type, (value, event_type)) AS event_type, min(value) AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def oracle_variant(spark: SparkSession, d: str) -> DataFrame:
    return M.oracle_variant(table(spark, d, "events", ["user_id", "event_type", "value"]), "user_id", "event_type", "value")


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def lines_json_parse(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", ["event_id", "props"]).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT l_orderkey, l_returnflag, string_agg(l_linestatus, ' ' ORDER BY l_linenumber, l_linestatus) AS text, round(avg(l_discount), 6) AS conf, count(*) AS n_words FROM lineitem WHERE l_discount >= 0 AND trim(l_linestatus) <> '' GROUP BY 1, 2""")
def tesseract_lines(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem", ["l_orderkey", "l_returnflag", "l_linenumber", "l_linestatus", "l_discount"])  # noqa: E741
    return S.assemble_lines(l, ["l_orderkey"], ["l_returnflag"], "l_linenumber", "l_linestatus", "l_discount")


@query("""WITH p AS (SELECT image_id, min(trim(product_name)) AS p FROM train_labels WHERE trim(product_name) <> '' GROUP BY 1), t AS (SELECT image_id, max(trim(product_name)) AS t FROM train_labels WHERE trim(product_name) <> '' GROUP BY 1), j AS (SELECT count(*) FILTER (p = t) AS tp, count(*) FILTER (p <> t) AS w FROM p JOIN t USING (image_id))
SELECT tp, w AS fp, w AS fn, round(tp / greatest(tp + w, 1)::DOUBLE, 6) AS precision, round(tp / greatest(tp + w, 1)::DOUBLE, 6) AS recall, round(2 * tp / greatest(2 * tp + 2 * w, 1)::DOUBLE, 6) AS f1 FROM j""")
def f1_product(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of the first and the last label of each image."""
    t = table(spark, d, "train_labels", ["image_id", "product_name"]).where(F.trim("product_name") != "")
    return M.f1(t.groupBy("image_id").agg(F.min(F.trim("product_name")).alias("name")), t.groupBy("image_id").agg(F.max(F.trim("product_name")).alias("name")), "image_id", "name")
