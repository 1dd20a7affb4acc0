"""Linking candidate phrases to gazetteer entries: retrieval by index tables, tiered scores, best match and margin."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tramloom.functions import text as X
from tramloom.functions.similarity import CAPS, Names, fuzzy_score
from tramloom.operators.candidates import source_priority
from tramloom.operators.gazetteer import index_table, with_keys
from tramloom.sources.tables import written

# Scores of the exact tiers, highest first.
EXACT = {"exact": 100.0, "surface_exact": 99.0, "folded_exact": 98.0, "surface_folded": 97.0}
HIGH_TRUST = tuple(EXACT)
#: The six indexes and the field of an entry that each holds.
KINDS = {"exact": "canonical_key", "folded": "folded_key", "surface": "surface_keys", "folded_surface": "folded_surface_keys", "token": "token_keys", "folded_token": "folded_token_keys"}


@dataclass(frozen=True)
class LinkConfig:
    """``pool``: entries scored for a phrase, the closest by index; ``threshold``, ``strong``: least score of a match and
    of a strong one; ``top``: matches kept for the report; ``most_sent``: entries that may travel to all tasks;
    ``most_scored``: entries up to which phrases are scored where they are; ``most_rows``: rows of keys or of matches that
    may travel; ``fuzzy``: are pairs that no exact tier settles scored by
    similarity, or left out? ``only_matched``: are phrases without a match left out, and so needn't be scored in full?"""

    pool: int = 80
    threshold: float = 88.0
    strong: float = 94.0
    top: int = 5
    most_sent: int = 50_000
    most_scored: int = 5_000
    most_rows: int = 50_000
    fuzzy: bool = True
    only_matched: bool = False


def keyed(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``key``, the match key of ``column``, worked out once a row."""
    return df.select("*", X.once(X.key(F.col(column))).alias("key"))


def phrases(candidates: DataFrame, column: str) -> DataFrame:
    """(key, folded_key, tokens, folded_tokens): distinct phrases by key. Each is linked once however often it occurs."""
    k = keyed(candidates.select(column), column).where("key <> ''").select("key").distinct()
    k = k.select("key", X.once(X.fold_key(F.col("key"))).alias("folded_key"))
    return k.withColumn("tokens", F.array_sort(F.array_distinct(F.split("key", " ")))).withColumn("folded_tokens", F.array_sort(F.array_distinct(F.split("folded_key", " "))))


def sent(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for its join: it travels to all tasks if it has at most ``most`` rows by count, else both sides are
    shuffled. The planner's own guess follows the size of compressed files, which says little of the rows behind it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df.hint("merge")


def _listed(entries: DataFrame) -> DataFrame:
    return with_keys(entries).select("entry_id", "canonical_key", "folded_key", "surface_keys", "folded_surface_keys", "token_keys", "folded_token_keys", "frequency_prior", "canonical_display")


def retrieve(p: DataFrame, entries: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """(key, entry_id, shared, folded_shared, rank): up to ``cfg.pool`` entries of each phrase that share a key, a surface
    or a token with it, plain or folded, closest first: by plain keys, folded keys, shared tokens, shared folded tokens,
    frequency, then display.

    A list of at most ``cfg.most_sent`` entries travels to the phrases as postings, and each phrase is ranked where it
    is; a longer one is joined on the exploded index."""
    listed = _listed(entries)
    if listed.limit(cfg.most_sent + 1).count() <= cfg.most_sent:
        return _retrieve_here(p, listed, cfg)
    return _retrieve_by_joins(p, listed, cfg)


class Postings:
    """Entries of each key of each kind, entries in order of frequency and display."""

    def __init__(self, rows: list):
        low = float("-inf")
        rows = sorted(rows, key=lambda r: r["entry_id"])
        rows = sorted(rows, key=lambda r: (low if r["frequency_prior"] is None else r["frequency_prior"], r["canonical_display"] or ""), reverse=True)
        self.rows, self.ids = rows, [r["entry_id"] for r in rows]
        self.of: dict[str, dict[str, np.ndarray]] = {}
        for kind, column in KINDS.items():
            found: dict[str, list[int]] = {}
            for i, r in enumerate(rows):
                for k in {r[column]} if isinstance(r[column], str) else set(r[column] or ()):
                    if k:
                        found.setdefault(k, []).append(i)
            self.of[kind] = {k: np.array(v, np.int64) for k, v in found.items()}

    @property
    def names(self) -> Names:
        """The entries' keys for scoring, made where they are first asked for."""
        if "_names" not in self.__dict__:
            self._names = Names([r["canonical_key"] or "" for r in self.rows], [r["folded_key"] or "" for r in self.rows])
        return self._names

    def ranked(self, wanted: dict[str, list[list[str]]], n: int, pool: int) -> tuple[np.ndarray, ...]:
        """(phrase, entry, shared, folded shared, rank, score of the first exact tier or -1) of ``n`` phrases with the keys
        ``wanted`` by kind."""
        m = len(self.ids)
        cells = {kind: [i * m + e for i, ks in enumerate(wanted[kind]) for k in ks if (e := self.of[kind].get(k)) is not None] for kind in KINDS}
        hits = {kind: np.concatenate([np.empty(0, np.int64), *c]) for kind, c in cells.items()}
        cell, which = np.unique(np.concatenate(list(hits.values())), return_inverse=True)
        ends = np.cumsum([0, *(len(h) for h in hits.values())])
        count = {kind: np.bincount(which[a:b], minlength=len(cell)) for kind, a, b in zip(hits, ends, ends[1:])}
        phrase, entry = cell // m, cell % m
        plain, folded = 2 * count["exact"] + count["surface"], 2 * count["folded"] + count["folded_surface"]
        order = np.lexsort((entry, -count["folded_token"], -count["token"], -folded, -plain, phrase))
        first = np.searchsorted(phrase[order], np.arange(n))
        rank = np.arange(len(order)) - first[phrase[order]] + 1
        order, rank = order[rank <= pool], rank[rank <= pool]
        tier = np.select([count[k][order] > 0 for k in ("exact", "surface", "folded", "folded_surface")], list(EXACT.values()), -1.0)
        return phrase[order], entry[order], count["token"][order], count["folded_token"][order], rank, tier


def _wanted(key: list, folded: list, tokens: list, folded_tokens: list) -> dict[str, list]:
    one = lambda x: [[k] for k in x]
    return {"exact": one(key), "folded": one(folded), "surface": one(key), "folded_surface": one(folded), "token": [set(t) for t in tokens], "folded_token": [set(t) for t in folded_tokens]}


def _retrieve_here(p: DataFrame, listed: DataFrame, cfg: LinkConfig) -> DataFrame:
    held = p.sparkSession.sparkContext.broadcast(Postings(listed.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                key, folded, tokens, folded_tokens = (c.to_pylist() for c in b.columns)
                phrase, entry, shared, folded_shared, rank, _ = held.value.ranked(_wanted(key, folded, tokens, folded_tokens), len(key), cfg.pool)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(phrase)), pa.array(held.value.ids, pa.string()).take(pa.array(entry)), pa.array(shared), pa.array(folded_shared), pa.array(rank.astype(np.int32))], names=["key", "entry_id", "shared", "folded_shared", "rank"])

    return p.select("key", "folded_key", "tokens", "folded_tokens").mapInArrow(run, "key string, entry_id string, shared long, folded_shared long, rank int")


def _retrieve_by_joins(p: DataFrame, listed: DataFrame, cfg: LinkConfig) -> DataFrame:
    def want(kind: str, c: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), c.alias("k"))

    keys = F.array(want("exact", F.col("key")), want("surface", F.col("key")), want("folded", F.col("folded_key")), want("folded_surface", F.col("folded_key")))
    tokens = F.concat(F.transform("tokens", lambda t: want("token", t)), F.transform("folded_tokens", lambda t: want("folded_token", t)))
    wanted = p.select("key", F.explode(F.array_distinct(F.concat(keys, tokens))).alias("w"))
    hits = wanted.select("key", F.col("w.kind").alias("kind"), F.col("w.k").alias("index_key")).join(index_table(listed).withColumnRenamed("key", "index_key"), ["kind", "index_key"])
    n = lambda kind: F.sum((F.col("kind") == kind).cast("int"))
    pool = hits.groupBy("key", "entry_id").agg((2 * n("exact") + n("surface")).alias("plain"), (2 * n("folded") + n("folded_surface")).alias("folded"), n("token").alias("shared"), n("folded_token").alias("folded_shared"))
    pool = pool.join(listed.select("entry_id", "frequency_prior", "canonical_display"), "entry_id")
    w = Window.partitionBy("key").orderBy(F.desc("plain"), F.desc("folded"), F.desc("shared"), F.desc("folded_shared"), F.desc("frequency_prior"), F.desc("canonical_display"), "entry_id")
    return pool.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= cfg.pool).select("key", "entry_id", "shared", "folded_shared", "rank")


def exact_tier(key: Column, folded: Column, entry: str = "e") -> Column:
    """(score, match_type) of the first exact tier that fits, or NULL."""
    def tier(kind: str) -> Column:
        return F.struct(F.lit(EXACT[kind]).alias("score"), F.lit(kind).alias("match_type"))

    return (
        F.when(key == F.col(f"{entry}.canonical_key"), tier("exact"))
        .when(F.array_contains(F.col(f"{entry}.surface_keys"), key), tier("surface_exact"))
        .when(folded == F.col(f"{entry}.folded_key"), tier("folded_exact"))
        .when(F.array_contains(F.col(f"{entry}.folded_surface_keys"), folded), tier("surface_folded"))
    )


def score_pairs(pool: DataFrame, p: DataFrame, entries: DataFrame, top: int | None = None) -> DataFrame:
    """Scored pairs (key, entry_id, score, match_type, overlaps and coverages). Only pairs that no exact tier settles
    go through the similarity UDF. With ``top`` the scores behind the first ``top`` of a phrase may be lower bounds."""
    e = with_keys(entries).select("entry_id", F.struct("canonical_key", "folded_key", "surface_keys", "folded_surface_keys", "folded_token_keys", "canonical_display", "frequency_prior").alias("e"))
    pairs = pool.select("key", "entry_id").join(p.hint("merge"), "key").join(e.hint("merge"), "entry_id").withColumn("tier", exact_tier(F.col("key"), F.col("folded_key")))
    exact = pairs.where("tier is not null").withColumn("s", F.col("tier"))
    # scoring costs far more than a row's bytes tell, so the pairs are spread by number, not by size
    spark = pool.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    fuzzy = pairs.where("tier is null").repartition(parts, "key").withColumn("s", fuzzy_score(F.col("key"), F.col("e.canonical_key"), F.col("folded_key"), F.col("e.folded_key"), top))
    both = exact.unionByName(fuzzy)
    overlap = F.size(F.array_intersect("folded_tokens", "e.folded_token_keys"))
    return both.select("key", "entry_id", F.col("s.score").alias("score"), F.col("s.match_type").alias("match_type"), overlap.alias("folded_overlap"), F.round(overlap / F.greatest(F.size("e.folded_token_keys"), F.lit(1)), 4).alias("entry_coverage"), F.round(overlap / F.greatest(F.size("folded_tokens"), F.lit(1)), 4).alias("candidate_coverage"), F.col("e.canonical_display").alias("display"), F.col("e.frequency_prior").alias("prior"))


def exact_pairs(p: DataFrame, entries: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """Scored pairs of the exact tiers alone, the columns of ``score_pairs``: the phrases' plain and folded keys are looked up
    among those of the entries, so no pair without an exact tier is ever built."""
    e = with_keys(entries)

    def of(tier: str, folded: bool, k: Column) -> DataFrame:
        return e.select(F.lit(folded).alias("folded"), k.alias("k"), "entry_id", F.lit(EXACT[tier]).alias("score"))

    listed = of("exact", False, F.col("canonical_key")).unionByName(of("surface_exact", False, F.explode("surface_keys"))).unionByName(of("folded_exact", True, F.col("folded_key"))).unionByName(of("surface_folded", True, F.explode("folded_surface_keys")))
    listed = listed.where("k is not null").groupBy("folded", "k", "entry_id").agg(F.max("score").alias("score"))
    sides = F.array(F.struct(F.lit(False).alias("folded"), F.col("key").alias("k")), F.struct(F.lit(True).alias("folded"), F.col("folded_key").alias("k")))
    hits = p.select("key", "folded_key", F.explode(sides).alias("w")).select("key", "folded_key", "w.*").join(sent(listed, cfg.most_rows), ["folded", "k"])
    hits = hits.groupBy("key", "folded_key", "entry_id").agg(F.max("score").alias("score"))
    facts = entries.select("entry_id", "folded_token_keys", F.col("canonical_display").alias("display"), F.col("frequency_prior").alias("prior"))
    words = F.array_distinct(F.split("folded_key", " "))
    pairs = hits.join(sent(facts, cfg.most_rows), "entry_id").withColumn("n", F.size(words)).withColumn("folded_overlap", F.size(F.array_intersect(words, "folded_token_keys")))
    kind = F.lit(None).cast("string")
    for tier, score in EXACT.items():
        kind = F.when(F.col("score") == score, tier).otherwise(kind)
    return pairs.select("key", "entry_id", "score", kind.alias("match_type"), "folded_overlap", F.round(F.col("folded_overlap") / F.greatest(F.size("folded_token_keys"), F.lit(1)), 4).alias("entry_coverage"), F.round(F.col("folded_overlap") / F.greatest("n", F.lit(1)), 4).alias("candidate_coverage"), "display", "prior")


def best_match(scored: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """(key, matched, is_strong, entry_id, display, score, second_score, margin, match_type, pool, top_matches): the best
    entry of each phrase and its lead; with one entry in the pool the second score is 0."""
    w = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("folded_overlap"), F.desc("candidate_coverage"), F.desc("entry_coverage"), F.desc("prior"), F.desc("display"), "entry_id")
    r = scored.withColumn("r", F.row_number().over(w)).withColumn("pool", F.count("*").over(Window.partitionBy("key"))).where(F.col("r") <= max(2, cfg.top))
    return _first_rows(r.groupBy("key", "pool").agg(F.array_sort(F.collect_list(F.struct("r", "entry_id", "score", "display", "prior", "match_type", "folded_overlap", "candidate_coverage"))).alias("rows")), cfg)


def _first_rows(rows: DataFrame, cfg: LinkConfig) -> DataFrame:
    first, second = F.col("rows")[0], F.coalesce(F.try_element_at("rows", F.lit(2))["score"], F.lit(0.0))
    matched = first["score"] >= cfg.threshold
    top = F.to_json(F.transform(F.slice("rows", 1, cfg.top), lambda x: F.struct(x["entry_id"].alias("entry_id"), x["score"].alias("score"))))
    return rows.select(
        "key", matched.alias("matched"), (first["score"] >= cfg.strong).alias("is_strong"), F.when(matched, first["entry_id"]).alias("entry_id"), F.when(matched, first["display"]).alias("display"), F.when(matched, first["prior"]).alias("prior"), first["score"].alias("score"), second.alias("second_score"),
        F.round(first["score"] - second, 4).alias("margin"), first["match_type"].alias("match_type"), "pool", first["folded_overlap"].alias("folded_overlap"), first["candidate_coverage"].alias("candidate_coverage"), top.alias("top_matches")
    )


def best_here(p: DataFrame, listed: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """``best_match`` over the pools of ``retrieve``, each phrase retrieved, scored and ranked where it is: no pair leaves its
    batch. The list travels, so it must be short."""
    held, top = p.sparkSession.sparkContext.broadcast(Postings(listed.collect())), max(2, cfg.top)
    prior = listed.schema["frequency_prior"].dataType
    kinds = [*EXACT, *CAPS, "no_score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        display, priors, size = pa.array([r["canonical_display"] for r in own.rows], pa.string()), pa.array([r["frequency_prior"] for r in own.rows], to_arrow_type(prior)), np.array([len(r["folded_token_keys"] or ()) for r in own.rows], np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                b = batch.slice(at, 2000)
                key, folded, tokens, folded_tokens = (c.to_pylist() for c in b.columns)
                phrase, entry, _, overlap, _, tier = own.ranked(_wanted(key, folded, tokens, folded_tokens), len(key), cfg.pool)
                score, kind = own.names.top_scores(key, folded, phrase, entry, tier, top, cfg.threshold if cfg.only_matched else 0.0)
                n = np.array([len(t) for t in folded_tokens], np.int64)[phrase]
                share = lambda x: np.floor(overlap / np.maximum(x, 1) * 10_000 + 0.5) / 10_000
                mine = share(n)
                blank = np.array([not r["canonical_key"] for r in own.rows], bool)[entry] & (tier < 0)
                kind = np.where(tier >= 0, np.searchsorted(-np.array(list(EXACT.values())), -tier), np.where(blank, len(kinds) - 1, kind + len(EXACT)))
                order = np.lexsort((entry, -share(size[entry]), -mine, -overlap, -score, phrase))
                pool = np.bincount(phrase, minlength=len(key))
                some = pool > 0
                if cfg.only_matched:
                    some = np.zeros(len(key), bool)
                    some[phrase[score >= cfg.threshold]] = True
                place = np.arange(len(order)) - np.repeat(np.cumsum(pool) - pool, pool) + 1
                kept = (place <= top) & some[phrase[order]]
                order, place = order[kept], place[kept]
                e = pa.array(entry[order])
                fields = {"r": pa.array(place, pa.int32()), "entry_id": pa.array(own.ids, pa.string()).take(e), "score": pa.array(score[order]), "display": display.take(e), "prior": priors.take(e), "match_type": pa.array(kinds, pa.string()).take(pa.array(kind[order])), "folded_overlap": pa.array(overlap[order], pa.int32()), "candidate_coverage": pa.array(mine[order])}
                ends = np.concatenate([[0], np.cumsum(np.minimum(pool[some], top))])
                rows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), pa.array(pool[some]), rows], names=["key", "pool", "rows"])

    # scoring costs far more than a row's bytes tell, so the phrases are spread by number, not by size
    spark = p.sparkSession
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = p.select("key", "folded_key", "tokens", "folded_tokens").repartition(parts, "key")
    kind = f"struct<r:int,entry_id:string,score:double,display:string,prior:{prior.simpleString()},match_type:string,folded_overlap:int,candidate_coverage:double>"
    return _first_rows(spread.mapInArrow(run, f"key string, pool long, rows array<{kind}>"), cfg)


def matches(p: DataFrame, entries: DataFrame, cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """The best entry of each phrase, as ``best_match`` gives it."""
    if not cfg.fuzzy:
        return best_match(exact_pairs(p, entries, cfg), cfg)
    listed = _listed(entries)
    if listed.limit(cfg.most_scored + 1).count() <= cfg.most_scored:
        return best_here(p, listed, cfg)
    return best_match(score_pairs(retrieve(p, entries, cfg), p, entries, max(2, cfg.top)), cfg)


def link(candidates: DataFrame, entries: DataFrame, column: str = "clean_text", cfg: LinkConfig = LinkConfig()) -> DataFrame:
    """``candidates`` with the match of their phrase; phrases without an entry in the pool stay unmatched.

    Phrases are distinct before retrieval, and the matches come back by a left join on the key."""
    p = phrases(candidates, column)
    m = written(matches(p, entries, cfg))
    out = keyed(candidates, column).join(sent(m, cfg.most_rows), "key", "left")
    return out.fillna({"matched": False, "is_strong": False, "score": 0.0, "second_score": 0.0, "margin": 0.0, "match_type": "no_candidates", "pool": 0})


def exact_links(docs: DataFrame, names: DataFrame, doc: str, text: str, name: str) -> DataFrame:
    """(doc, key): lines of a text whose key is a listed name's. The smallest useful link: one equi-join on the key."""
    lines = docs.select(doc, F.explode(F.split(F.col(text), r"[\n]+")).alias("line")).select(doc, X.key(F.regexp_replace("line", r"^\s*(?:[-*•+✓]|\d+[.)])\s+", "")).alias("key")).where("key <> ''").distinct()
    return lines.join(names.select(X.key(F.col(name)).alias("key")).distinct(), "key", "left_semi")


def in_order(links: DataFrame, image: str = "image_id") -> DataFrame:
    """Links with ``place`` within their image: matched, strong, score and margin, then source, structure and confidence, all
    descending, ties by phrase."""
    w = Window.partitionBy(image).orderBy(F.desc("matched"), F.desc("is_strong"), F.desc("score"), F.desc("margin"), F.desc(source_priority(F.col("source"))), F.desc_nulls_last("structure_score"), F.desc_nulls_last("conf"), "clean_text")
    return links.withColumn("place", F.row_number().over(w))


def top_links(links: DataFrame, image_id: str, top: int = 30, only_matched: bool = False, image: str = "image_id") -> DataFrame:
    """The first ``top`` links of one image, a report."""
    one = in_order(links.where(F.col(image) == image_id), image)
    return (one.where("matched") if only_matched else one).orderBy("place").limit(top)
