"""Queries of the corpus operators over one data directory, and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tramloom.llm import gazetteer, leakage, lookalike, mixing, quality, spans
from tramloom.plans import sql as Y
from tramloom.sources.tables import table

FORM_FIELDS = [("ocr_lines", "line_id", "text"), ("product_candidates", "candidate_id", "clean_text"), ("gazetteer_entries", "entry_id", "canonical_key")]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry that each candidate names, or ``unmatched``."""
    return gazetteer.link_values(table(spark, d, "product_candidates", ["candidate_id", "clean_text"]), table(spark, d, "gazetteer_entries"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """The values that name no entry, with how often each occurs."""
    c = table(spark, d, "product_candidates", ["candidate_id", "clean_text"])
    un = gazetteer.link_values(c, table(spark, d, "gazetteer_entries")).where(F.col("entry_id") == gazetteer.UNMATCHED)
    return c.join(un, "candidate_id", "left_semi").groupBy("clean_text").agg(F.count("*").alias("n_rows"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose text differs from its form."""
    return reduce(DataFrame.unionByName, [lookalike.changed(table(spark, d, t, [i, c]), i, c, t) for t, i, c in FORM_FIELDS])


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Texts of the three tables grouped by equal form, where a form has more than one spelling."""
    return lookalike.groups(reduce(DataFrame.unionByName, [table(spark, d, t, [c]).withColumnRenamed(c, "text") for t, _, c in FORM_FIELDS]), "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't prose, with what they are."""
    return p5_kinds(spark, d).where(F.col("kind") != "prose").select("doc_id", "kind")


def p5_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Shares of prose, list, table and junk in each document."""
    return quality.kinds(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "common_words", ["word"]))


def p5_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of words, lines and characters of each document."""
    return quality.statistics(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "common_words", ["word"]))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Wanted and actual share of each source."""
    return mixing.shares(_tokens(spark, d), table(spark, d, "mix_targets"))


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    t = _tokens(spark, d)
    return mixing.repeats(t, mixing.plan(t, table(spark, d, "mix_targets"))).select("doc_id", "source", "tokens", "repeats")


def p7_schedule(spark: SparkSession, d: str) -> DataFrame:
    """Slots of the mix with the stretches of documents that fill them."""
    return mixing.schedule(_tokens(spark, d), table(spark, d, "mix_targets"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return mixing.token_table(table(spark, d, "documents", ["doc_id", "source", "text"]))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items with which they share a run of 12 words."""
    return leakage.find_leaks(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "eval_items", ["item_id", "text"]))


def p6_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold an evaluation item with up to three words changed, left out or put in."""
    return leakage.near_leaks(table(spark, d, "documents", ["doc_id", "text"]), table(spark, d, "eval_items", ["item_id", "text"]))


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """How many documents hold each leaked item."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document stands verbatim in others."""
    return spans.shared_spans(table(spark, d, "documents", ["doc_id", "text"])).select("doc_id", "shared_chars")


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """The maximal stretches of each document that stand verbatim in others."""
    s = spans.shared_spans(table(spark, d, "documents", ["doc_id", "text"]))
    return s.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", "s.stop")


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p4_found, p4_groups, p5_found, p5_kinds, p5_stats, p6_found, p6_near, p6_items, p7_plan, p7_shares, p7_schedule, p8_found, p8_spans)}
# ---- SQL twins ----

_FOLDED = "replace(lower(strip_accents(regexp_replace(nfc_normalize(text), '[\\p{Cf}]', '', 'g'))), 'đ', 'd')"


def _grams(table_: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i : i + 11], ' ') AS g FROM (SELECT {key}, regexp_extract_all({_FOLDED}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table_} WHERE text IS NOT NULL), unnest(range(1, greatest(len(w) - 10, 1))) AS u(i) WHERE len(w) >= 12"""


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


SQL: dict[str, str] = {
    "p6_found": f"SELECT DISTINCT doc_id, item_id FROM ({_grams('documents', 'doc_id')}) JOIN ({_grams('eval_items', 'item_id')}) USING (g)",
    "p6_items": f"SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM ({_grams('documents', 'doc_id')}) JOIN ({_grams('eval_items', 'item_id')}) USING (g) GROUP BY 1",
    "p8_found": """WITH w AS (SELECT doc_id, i, md5(substring(text, i, 200)) AS h FROM documents, unnest(range(1, length(text) - 198)) AS u(i) WHERE length(text) >= 200), r AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(DISTINCT i + k)::INT AS shared_chars FROM w JOIN r USING (h), unnest(range(0, 200)) AS v(k) GROUP BY 1""",
    "p8_spans": """WITH w AS (SELECT doc_id, i, md5(substring(text, i, 200)) AS h FROM documents, unnest(range(1, length(text) - 198)) AS u(i) WHERE length(text) >= 200), r AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
s AS (SELECT doc_id, i, i >= coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 200 AS first FROM w JOIN r USING (h)), g AS (SELECT *, sum(first::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s)
SELECT doc_id, (min(i) - 1)::INT AS start, (max(i) + 199)::INT AS stop FROM g GROUP BY doc_id, k""",
    "p5_stats": f"""SELECT doc_id, length(text) AS n_chars, {_count('[\\p{L}\\p{N}]+')} AS n_words, round({_count('[\\p{L}\\p{N}]')} / greatest({_count('[\\p{L}\\p{N}]+')}, 1)::DOUBLE, 6) AS mean_word_length,
 {_count('(?m)^[^\\n]*[^ \\t\\n\\r\\f\\v][^\\n]*$')} AS n_lines, round({_count('(?m)[.!?…:;][ \\t\\r\\f\\v]*$')} / greatest({_count('(?m)^[^\\n]*[^ \\t\\n\\r\\f\\v][^\\n]*$')}, 1)::DOUBLE, 6) AS punctuated_lines,
 round(len(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+'), lambda x: list_contains(listed, x))) / greatest({_count('[\\p{L}\\p{N}]+')}, 1)::DOUBLE, 6) AS common_ratio, round({_count('[\\p{L}\\p{N}]')} / greatest(length(text), 1)::DOUBLE, 6) AS alnum_ratio,
 round({_count(quality.SYMBOL)} / greatest(length(text), 1)::DOUBLE, 6) AS symbol_ratio, round({_count(f'{quality.CJK}|{quality.KANA}|{quality.HANGUL}|{quality.EMOJI}|{quality.SYMBOL}')} / greatest(length(text), 1)::DOUBLE, 6) AS junk_ratio FROM documents, (SELECT list(lower(word)) || list({Y.fold('lower(word)')}) AS listed FROM common_words WHERE word IS NOT NULL) WHERE regexp_matches(text, '[^ \\t\\n\\r\\f\\v]')""",
}
