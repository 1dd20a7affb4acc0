"""The whole way from read lines to an output table, composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from tramloom.functions import text as X
from tramloom.operators import candidates as C, gate as G, gazetteer as Z, linker as L, predict as P, rules as U, segments as S
from tramloom.sources.tables import checkpointed, table

FIELDS = ["image_id", "variant", "source", "line_index", "clean_text", "conf", "box"]


@dataclass(frozen=True)
class CandidateConfig:
    """Bounds of the phrases taken from a line: names are short, so longer stretches of it are none."""

    max_ngram: int = 4
    segment_tokens: int = 8
    line_tokens: int = 12
    cross_low: int = 2
    cross_high: int = 6
    cross_tokens: int = 60


def generate_candidates(lines: DataFrame, fillers: DataFrame | None = None, cfg: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Candidate phrases of (image_id, variant, line_index, text, conf, box): whole lines, segments, n-grams of short
    segments, and n-grams across line breaks; filtered, scored, one row for each key of an image.

    The only wide steps are by image: the window over a variant's lines and the two aggregates."""
    base = lines.select(*[c for c in lines.columns if c != "text"], X.once(X.light(F.col("text"))).alias("text")).where("text <> ''")
    # one shuffle of the lines serves all kinds of candidates, which read the light text instead of making it anew
    base = base.repartition("image_id").withColumn("__fillers", F.array().cast("array<string>"))
    if fillers is not None:
        words = F.broadcast(fillers.agg(F.collect_set("token").alias("__fillers")))  # one row; the miner keeps 300 words
        base = base.drop("__fillers").crossJoin(words)
    # segments are cut from the text as read, since their separators are no tokens
    left = lambda c: X.strip_fillers(X.tokens(F.col(c)), F.col("__fillers"))
    bare = lambda c: F.when(F.size("__fillers") > 0, X.detokenize(left(c))).otherwise(F.col(c))
    stripped = base.withColumn("text", bare("text")).where("text <> ''")
    whole = stripped.select("image_id", "variant", F.lit("line").alias("source"), "line_index", F.col("text").alias("clean_text"), "conf", "box")
    parts = base.select("image_id", "variant", "line_index", "text", "conf", "box", "__fillers", F.explode_outer(S.split_segments(F.col("text"))).alias("segment")).where("segment is not null and segment <> text")
    segments = parts.select("image_id", "variant", F.lit("segment").alias("source"), "line_index", bare("segment").alias("clean_text"), "conf", "box")
    tokens = parts.withColumn("t", left("segment")).where(F.size("t") <= cfg.segment_tokens)
    grams = tokens.select("image_id", "variant", F.lit("ngram").alias("source"), "line_index", F.explode_outer(F.transform(S.ngrams(F.col("t"), 1, cfg.max_ngram), lambda g: g["text"])).alias("clean_text"), "conf", "box").where("clean_text is not null")
    cross = S.cross_line_ngrams(stripped.select("image_id", "variant", "line_index", "text"), ["image_id", "variant"], cfg.cross_low, cfg.cross_high, cfg.cross_tokens)
    cross = cross.select("image_id", "variant", F.lit("ngram").alias("source"), "line_index", F.col("text").alias("clean_text"), F.lit(None).cast("double").alias("conf"), F.lit(None).cast("array<int>").alias("box"))
    every = whole.unionByName(segments).unionByName(grams).unionByName(cross)
    kept = every.select("*", X.once(C.measures(F.col("clean_text"))).alias("m")).where(C.reason_of(F.col("m"), most_tokens=cfg.line_tokens).isNull())
    # a phrase with a plain letter or digit has rule text
    kept = kept.where(F.col("clean_text").rlike("[0-9A-Za-z]") | ~U.rejected(F.col("clean_text")))
    kept = kept.select("*", X.once(X.key(F.col("clean_text"))).alias("normalized_key")).where("normalized_key <> ''")
    # the order of equal candidates: line, source, variant, text
    kept = kept.withColumn("n", F.col("m.n")).withColumn("seq", F.xxhash64("line_index", "source", "variant", "clean_text"))
    kept = kept.withColumn("structure_score", C.structure_of(F.col("m"), F.col("source"))).drop("m")
    rank = F.struct(C.source_priority(F.col("source")), F.least("n", F.lit(8)), F.coalesce("conf", F.lit(0.0)), F.length("clean_text"), -F.col("seq"))
    row = F.max_by(F.struct("variant", "source", "line_index", "clean_text", "conf", "box", "seq", "structure_score", F.col("n").alias("token_count")), rank)
    # few rows of an image share a key, so nothing is combined before the shuffle; an image has a handful of variants
    best = kept.repartition("image_id").groupBy("image_id", "normalized_key").agg(row.alias("row"), F.size(F.collect_set("variant")).cast("long").alias("support")).select("image_id", "normalized_key", "row.*", "support")
    read = base.groupBy("image_id").agg(F.count_distinct("variant").alias("available"))
    share = F.when(F.col("available") >= 2, F.round(F.col("support") / F.col("available"), 4)).otherwise(0.0)
    best = best.join(read, "image_id").withColumn("agreement", share)
    return best.select(*[c for c in best.columns if c not in ("structure_score", "token_count")], "structure_score", "token_count")


def predict(lines: DataFrame, entries: DataFrame, rules: DataFrame | None = None, link: L.LinkConfig = L.LinkConfig(), gate: G.GateConfig = G.GateConfig(), fillers: DataFrame | None = None, negative: list[str] | None = None, positive: list[str] | None = None, anchors: list[str] | None = None, generic: list[str] | None = None) -> DataFrame:
    """(image_id, emit, reason, product_name) of read lines: candidates without ``fillers``, links, evidence, gate, final
    names. The lexicons of the gate are the caller's data; none is built in."""
    c = checkpointed(generate_candidates(lines, fillers))  # read by the distinct phrases and by the join with their matches
    told = G.context(c, "image_id", ["clean_text"], negative or [], positive or []) if negative or positive else None
    linked = L.link(c, entries, "clean_text", replace(link, only_matched=True)).where("matched")
    top = entries.agg(F.max("frequency_prior").alias("most"))
    linked = linked.join(F.broadcast(top)).withColumnRenamed("score", "match_score")  # one row
    if told is not None:
        linked = linked.join(told, "image_id", "left")
    else:
        linked = linked.withColumn("positive", F.lit(0)).withColumn("negative", F.lit(0))
    words = F.array_distinct(F.split(X.fold_key(F.col("key")), " "))
    score = G.gate_score(F.col("match_score"), F.col("margin"), F.col("structure_score"), F.col("source"), F.col("conf"), F.col("agreement"), F.col("available"), F.lit(None).cast("double"), F.col("prior"), F.col("most"), F.col("match_type"), F.col("positive"), F.col("negative"), gate)
    own = G.specific(F.col("match_type"), F.col("match_score"), F.col("folded_overlap"), F.col("candidate_coverage"), F.col("words"), anchors or [])
    # one row a matched phrase, behind all similarity scores; evidence and pool read it
    linked = checkpointed(linked.withColumn("words", words).withColumn("gate_score", score).withColumn("specific", own).select("image_id", "entry_id", "seq", "source", "line_index", "words", "gate_score", "match_score", "margin", "match_type", "is_strong", "specific"))
    facts = entries.select("entry_id", F.coalesce("item_count", F.lit(1)).alias("item_count"), F.coalesce("folded_token_keys", F.array().cast("array<string>")).alias("words"), F.coalesce("frequency_prior", F.lit(0)).alias("prior"))
    chosen = G.choose(checkpointed(G.evidence(linked, "image_id").join(facts, "entry_id")), "image_id", G.token_pool(linked, "image_id", "words"), gate)
    names = chosen.select("image_id", F.posexplode("chosen").alias("pos", "entry_id")).join(entries.select("entry_id", "canonical_display"), "entry_id")
    names = names.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "canonical_display"))), lambda x: x["canonical_display"]).alias("names"))
    chosen = chosen.join(names, "image_id").drop("chosen").withColumnRenamed("names", "chosen")
    text = lines.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("variant", "line_index", "text"))), lambda x: x["text"]), "\n").alias("text"))
    none = lines.select("image_id", F.lit(None).cast("string").alias("canonical"), F.lit(None).cast("int").alias("priority")).limit(0)
    over = U.resolve(U.hits(text, "image_id", "text", rules), "image_id") if rules is not None else none
    topic = text.where(U.in_context(F.col("text"), generic, [])).select("image_id") if generic else None
    out = G.decide(lines, chosen, over, "image_id", told, topic, gate)
    return out.select("image_id", "emit", "reason", P.final_names(F.col("chosen")).alias("product_name"))


def lines_of(spark: SparkSession, d: str) -> DataFrame:
    """Lines as read, in the shape that the pipeline takes; repeated lines count once."""
    t = table(spark, d, "ocr_lines", ["image_id", "variant_name", "line_index", "text", "conf", "box"])
    first = t.where("text is not null").groupBy("image_id", F.col("variant_name").alias("variant"), "line_index").agg(F.max_by(F.struct("text", "conf", "box"), F.struct(F.coalesce("conf", F.lit(0.0)), "text")).alias("l"))
    return first.select("image_id", "variant", "line_index", "l.text", X.confidence(F.col("l.conf")).alias("conf"), "l.box")


# Words of brands and kinds that are never fillers, beside those of the listed names.
PROTECTED = ["pate", "patê", "cot", "cột", "den", "đèn", "ha", "hạ", "long", "halong", "canfoco", "nan", "nestle", "nestlé", "optipro", "infinipro", "a2", "highland", "highlands", "coffee", "tra", "trà", "sen", "vang", "vàng", "sua", "sữa", "banh", "bánh", "mi", "mì", "que"]


def fillers_of(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """(token, df_without, ratio_with) of labels (ocr_text, product_name): filler words by the miner's default thresholds.
    Words of the listed names and their surface variants, with and without accents, are none."""
    none = F.array().cast("array<string>")
    surfaces = X.tokens(X.light(F.array_join(F.coalesce("surface_variants", none), "\n")))
    words = F.concat(F.coalesce("token_keys", none), F.coalesce("folded_token_keys", none), surfaces, F.array(*map(F.lit, PROTECTED)))
    listed = entries.select(F.explode(words).alias("w")).distinct()
    protected = listed.select(F.explode(F.array(X.key(F.col("w")), X.fold_key(F.col("w")))).alias("token")).distinct()
    read = labels.where(F.trim("ocr_text") != "").select("ocr_text", (F.trim(X.safe_text(F.col("product_name"))) != "").alias("named"))
    return checkpointed(Z.fillers(read, "named", "ocr_text", protected, folded=True))  # at most 300 rows, read by each kind of candidate
