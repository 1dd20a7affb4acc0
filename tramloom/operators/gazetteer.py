"""Gazetteer of names: entries, index tables, ambiguity, fillers, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tramloom.functions import text as X
from tramloom.operators.segments import product_surfaces


def entries(labels: DataFrame, name: str) -> DataFrame:
    """One row a canonical key: (entry_id, canonical_key, canonical_display, folded_key, source_class, frequency_prior,
    item_count). The display is the commonest spelling; ties go to more letters, length, then text order.

    Two aggregates, the first by spelling, so that a hot name is one row before the second."""
    s = product_surfaces(labels.select(name), name).withColumn("canonical_key", X.key(F.col("surface"))).where("canonical_key <> ''")
    spelled = s.groupBy("canonical_key", "surface").agg(
        F.count("*").alias("n"), F.max("n_items").alias("items"), F.max((F.col("surface_class") == "full").cast("int")).alias("full"), F.max((F.col("surface_class") == "atomic").cast("int")).alias("atomic")
    )
    rank = F.struct(F.col("n"), X.count(F.col("surface"), r"\p{L}"), F.length("surface"), F.col("surface"))
    e = spelled.groupBy("canonical_key").agg(F.max_by("surface", rank).alias("canonical_display"), F.sum("n").alias("frequency_prior"), F.max("items").alias("item_count"), F.max("full").alias("__f"), F.max("atomic").alias("__a"))
    kind = F.when((F.col("__f") == 1) & (F.col("__a") == 1), "mixed").when(F.col("__f") == 1, "full").otherwise("atomic")
    return e.select(X.entry_id(F.col("canonical_key")).alias("entry_id"), "canonical_key", "canonical_display", X.fold_key(F.col("canonical_display")).alias("folded_key"), kind.alias("source_class"), "frequency_prior", F.col("item_count").cast("long").alias("item_count"))


def token_index(e: DataFrame, key: str = "canonical_key") -> DataFrame:
    """(token, entry_ids): sorted entries of each token."""
    t = e.select("entry_id", F.explode(F.array_distinct(F.split(key, " "))).alias("token")).where("token <> ''")
    return t.groupBy("token").agg(F.array_sort(F.collect_set("entry_id")).alias("entry_ids"))


def with_keys(entries: DataFrame) -> DataFrame:
    """Entries with the keys of their surface variants."""
    surfaces = F.coalesce("surface_variants", F.array().cast("array<string>"))
    return entries.withColumn("surface_keys", F.transform(surfaces, lambda x: X.key(x, compose=False))).withColumn("folded_surface_keys", F.coalesce("folded_surface_keys", F.transform(surfaces, lambda x: X.fold_key(x))))


def index_table(e: DataFrame) -> DataFrame:
    """(kind, key, entry_id): exact, folded, surface and token keys, plain and folded, as one exploded index."""
    e = e if "surface_keys" in e.columns else with_keys(e)

    def of(kind: str, key) -> DataFrame:
        return e.select(F.lit(kind).alias("kind"), key.alias("key"), "entry_id").where("key is not null and key <> ''")

    parts = [of("exact", F.col("canonical_key")), of("folded", F.col("folded_key")), of("token", F.explode_outer("token_keys")), of("folded_token", F.explode_outer("folded_token_keys")), of("surface", F.explode_outer("surface_keys")), of("folded_surface", F.explode_outer("folded_surface_keys"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def shared_anchors(e: DataFrame) -> DataFrame:
    """(anchor, n_entries): first two folded words that begin several entries."""
    words = F.split("folded_key", " ")
    a = e.select("entry_id", F.array_join(F.slice(words, 1, 2), " ").alias("anchor")).where("anchor <> ''")
    return a.groupBy("anchor").agg(F.count_distinct("entry_id").alias("n_entries")).where("n_entries > 1")


def ambiguous_pairs(e: DataFrame, ratio: float = 0.10) -> DataFrame:
    """(a, b, n_entries): pairs of folded words shared by several entries, words of more than ``max(2, ratio * n)``
    entries left out. Pairs are built inside each entry's short word list, not by a join."""
    words = F.array_sort(F.array_distinct(F.split("folded_key", " ")))
    t = e.select("entry_id", words.alias("w"))
    n = e.agg(F.greatest(F.lit(2), F.floor(F.count("*") * ratio)).alias("most"))
    common = t.select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n), F.col("df") <= F.col("most")).select("token")
    kept = t.select("entry_id", F.explode("w").alias("token")).join(common, "token").groupBy("entry_id").agg(F.array_sort(F.collect_set("token")).alias("w"))
    pairs = F.flatten(F.transform("w", lambda a, i: F.transform(F.slice("w", i + 2, F.size("w")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return kept.select("entry_id", F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count_distinct("entry_id").alias("n_entries")).where("n_entries > 1")


def label_class(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``label_class``: blank, text_no_product or text_with_product."""
    blank = F.coalesce(F.trim(F.col(text)) == "", F.lit(True))
    named = F.trim(X.safe_text(F.col(name))) != ""
    return df.withColumn("label_class", F.when(named & ~blank, "text_with_product").when(blank & ~named, "blank").when(named, "product_only").otherwise("text_no_product"))


def fillers(texts: DataFrame, has_product: str, text: str, protected: DataFrame, least_df: int = 8, most_ratio: float = 0.02, top: int = 300, folded: bool = False) -> DataFrame:
    """(token, df_without, ratio_with): words common where there is no product and rare where there is one.

    ``protected`` (token) is left out, with ``folded`` also the words whose key or accent-free key it holds; the ``top`` of
    the report are by frequency, ratio, then text order."""
    t = texts.select(F.col(has_product).alias("p"), F.explode(F.array_distinct(F.transform(X.tokens(X.light(F.col(text))), F.lower))).alias("token"))
    t = t.where(F.col("token").rlike(r"\p{L}") & (F.length("token") >= 2))
    n = texts.agg(F.sum(F.col(has_product).cast("long")).alias("n_with"))
    d = t.groupBy("token").agg(F.sum((~F.col("p")).cast("long")).alias("df_without"), F.sum(F.col("p").cast("long")).alias("df_with"))
    d = d.where(F.col("df_without") >= least_df).join(protected, "token", "left_anti").join(F.broadcast(n))
    for key in (X.key, X.fold_key) if folded else ():
        d = d.withColumn("__k", key(F.col("token"))).where("__k <> ''").join(protected.select(F.col("token").alias("__k")), "__k", "left_anti").drop("__k")
    d = d.withColumn("ratio_with", F.round(F.col("df_with") / F.greatest(F.col("n_with"), F.lit(1)), 6)).where(F.col("ratio_with") <= most_ratio)
    return d.orderBy(F.desc("df_without"), "ratio_with", F.desc("token")).limit(top).select("token", "df_without", "ratio_with")


def with_manual(mined: DataFrame, manual: DataFrame, protected: DataFrame) -> DataFrame:
    """(token): mined and manual fillers, without those that are too short, without letters, or protected."""
    both = mined.select("token").unionByName(manual.select(F.lower("token").alias("token"))).distinct()
    both = both.where((F.length("token") >= 2) & F.col("token").rlike(r"\p{L}"))
    for key in (X.key, X.fold_key):
        both = both.withColumn("__k", key(F.col("token"))).join(protected.select(F.col("token").alias("__k")).distinct(), "__k", "left_anti").drop("__k")
    return both


def add_aliases(e: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, entry_id): the entry of each alias's canonical name by exact key, else the least id by folded key."""
    a = aliases.select("alias", X.key(F.col("canonical")).alias("k"), X.fold_key(F.col("canonical")).alias("f"))
    exact = a.join(e.select(F.col("canonical_key").alias("k"), F.col("entry_id").alias("exact_id")), "k", "left")
    folded = e.groupBy(F.col("folded_key").alias("f")).agg(F.min("entry_id").alias("folded_id"))
    return exact.join(folded, "f", "left").select("alias", F.coalesce("exact_id", "folded_id").alias("entry_id")).where("entry_id is not null")


def coverage(surfaces: DataFrame, e: DataFrame) -> DataFrame:
    """(n_surfaces, n_known, coverage): share of the surfaces whose key is an entry's."""
    keys = surfaces.select(X.key(F.col("surface")).alias("canonical_key")).where("canonical_key <> ''")
    known = keys.join(e.select("canonical_key", F.lit(1).alias("hit")).distinct(), "canonical_key", "left")
    return known.agg(F.count("*").alias("n_surfaces"), F.count("hit").alias("n_known")).withColumn("coverage", F.round(F.col("n_known") / F.greatest(F.col("n_surfaces"), F.lit(1)), 6))


def summary(e: DataFrame, top: int = 20) -> DataFrame:
    """The ``top`` entries by frequency, with their rank."""
    return e.orderBy(F.desc("frequency_prior"), "canonical_display").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("frequency_prior"), "canonical_display"))).select("rank", "canonical_display", "frequency_prior")


def build(labels: DataFrame, text: str, name: str, aliases: DataFrame | None = None, manual: DataFrame | None = None, least_df: int = 8, most_ratio: float = 0.02) -> dict[str, DataFrame]:
    """A gazetteer from labels, as tables: ``entries`` with keys, token keys, anchors and mined surface variants, the
    ``index``, ambiguous ``anchors`` and ``pairs``, ``fillers``, and one row of ``metadata``."""
    from tramloom.operators import surfaces
    from tramloom.sources.tables import written

    named = labels.withColumn("__name", X.safe_text(F.col(name))).where(F.trim("__name") != "")
    e = entries(named, "__name")
    light = X.light(F.col("canonical_display"))
    e = written(e.withColumn("token_keys", X.token_keys(light)).withColumn("folded_token_keys", X.folded_token_keys(light)).withColumn("brand_anchor", F.array_join(F.slice(F.transform(X.tokens(light), F.lower), 1, 2), " ")))
    mined = surfaces.mine(labels, e, text, name).select("entry_id", "surface")
    if aliases is not None:
        mined = mined.unionByName(add_aliases(e, aliases).select("entry_id", F.col("alias").alias("surface")))
    v = mined.groupBy("entry_id").agg(F.array_sort(F.collect_set("surface")).alias("surface_variants"))  # at most forty and the aliases
    e = written(with_keys(e.join(v, "entry_id", "left").withColumn("folded_surface_keys", F.lit(None).cast("array<string>"))))
    words = e.select(F.explode(F.concat("token_keys", "folded_token_keys", F.flatten(F.transform("surface_keys", lambda k: F.split(k, " "))))).alias("token")).distinct()
    read = labels.where(F.trim(text) != "").select(F.col(text).alias("t"), (F.trim(X.safe_text(F.col(name))) != "").alias("p"))
    fill = fillers(read, "p", "t", words, least_df, most_ratio, folded=True)
    if manual is not None:
        fill = with_manual(fill, manual, words)
    facts = e.agg(F.count("*").alias("n_entries"), F.sum("frequency_prior").alias("n_surfaces"), F.sum(F.size("surface_keys")).alias("n_variants"))
    return {"entries": e, "index": index_table(e), "anchors": shared_anchors(e), "pairs": ambiguous_pairs(e), "fillers": fill.select("token"), "metadata": facts}


def save(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as parquet under ``path``, the metadata as one line of JSON."""
    for k, df in tables.items():
        (df.coalesce(1).write.mode("overwrite").json if k == "metadata" else df.write.mode("overwrite").parquet)(f"{path}/{k}")  # the metadata are one row


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """What ``save`` wrote."""
    return {k: spark.read.json(f"{path}/{k}") if k == "metadata" else spark.read.parquet(f"{path}/{k}") for k in ("entries", "index", "anchors", "pairs", "fillers", "metadata")}
