"""Per-document text quality: statistics of words, lines and characters, and what kind of text a document is.

Each line is labelled prose, list, table or junk by a hidden Markov model over line statistics. A seed model adds log
odds for what a line's layout, words and damage speak for. It labels the lines of all documents; from those labels
the emissions of mean word length, symbol ratio, share of common words, number of words and final punctuation and the
moves between labels are estimated, and seed and estimates together label all documents: neighbouring lines tend to
share a label, and the best path over a document's lines is found for all documents of a batch at once. The labels'
shares of the text then tell the kind. What a line's text says is read once and written as a number a line, since the
seed model and the estimated one both label it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tramloom.functions import text as X
from tramloom.llm.codes import pieces
from tramloom.llm.lines import Lines, word_hash
from tramloom.sources.tables import written

KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)

#: Bounds of the bins of each estimated emission.
BINS = {"word_length": [1.5, 2.5, 3.0, 3.5, 4.0, 4.5, 5.0, 6.0, 8.0], "symbols": [0.001, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5], "common": [0.001, 0.03, 0.06, 0.12, 0.2, 0.3], "words": [0.5, 1.5, 3.5, 6.5, 9.5, 14.5, 24.5], "ended": [0.5]}

#: Bits of a line's facts; above them four bits of each statistic's bin.
FACTS = ("bad", "poor", "sound", "wordy", "flowing", "some", "sentence", "mark", "tags", "inline", "short", "head", "ruled", "laid", "barred", "many", "two", "near")


@dataclass(frozen=True)
class QualityConfig:
    """``stay``: chance in the seed model that a line has the label of the line before it; ``weights``: its log odds;
    ``fit_docs``: None, and the emissions are estimated on all documents; a caller who wants a sample gives about how many
    documents it holds; ``learnt``, ``most``: weight and bound of an estimated log odds."""

    stay: float = 0.85
    common_high: float = 0.12
    common_low: float = 0.06
    fit_docs: int | None = None
    learnt: float = 0.2
    most: float = 2.0
    weights: dict[str, float] = field(default_factory=lambda: {"common": 3.0, "some": 1.2, "none": 1.5, "sentence": 2.5, "mark": 3.0, "inline": 5.0, "tags": 6.0, "short": 1.5, "head": 1.0, "cells": 5.0, "two": 2.5, "rule": 6.0, "bad": 7.0, "poor": 3.5})


@dataclass(frozen=True)
class Model:
    """``move``: log chances from label to label; ``odds``: of each statistic, log odds by label and bin."""

    move: np.ndarray
    odds: dict[str, np.ndarray]


def seed_model(cfg: QualityConfig) -> Model:
    move = np.full((4, 4), np.log((1 - cfg.stay) / 3))
    np.fill_diagonal(move, np.log(cfg.stay))
    return Model(move, {})


def line_facts(x: Lines, cfg: QualityConfig) -> np.ndarray:
    """What each line's layout, words and damage are, as the bits of ``FACTS``, and its bins."""
    facts = np.zeros(x.n, np.uint64)
    if not x.n:
        return facts
    share = x.known / np.maximum(x.words, 1)
    flowing = (x.known >= 2) & (share >= cfg.common_high)
    ruled = x.rule & (x.bars > 0)
    many = (x.cells >= 3) & (x.words <= 7 * x.cells)
    is_ = {
        "bad": x.bad >= 0.5, "poor": x.bad >= 0.28, "sound": x.bad < 0.9,  # else its blanks and bars are no layout
        "wordy": x.words >= 4, "flowing": flowing, "some": share >= cfg.common_low, "sentence": x.sentence & ~x.marked,
        "mark": x.marked, "tags": (x.tokens >= 2) & x.tags, "inline": (x.items >= 4) & (x.words <= 4 * x.items) & (share < cfg.common_high), "short": (x.words <= 9) & ~flowing, "head": (x.words <= 5) & x.heading,
        "ruled": ruled, "laid": ~ruled & (~flowing | (x.tabs > 0) | ((x.cells >= 3) & (x.bars > 0))), "barred": (x.tabs > 0) | (x.bars > 0), "many": many, "two": ~many & (x.cells == 2) & (x.words <= 14), "near": x.near >= 3,
    }
    for i, name in enumerate(FACTS):
        facts |= is_[name].astype(np.uint64) << np.uint64(i)
    values = {"word_length": x.word_length, "symbols": x.symbols, "common": share, "words": x.words, "ended": x.ended.astype(float)}
    for i, (name, bounds) in enumerate(BINS.items()):
        facts |= np.searchsorted(bounds, values[name], "right").astype(np.uint64) << np.uint64(len(FACTS) + 4 * i)
    return facts


def bins_of(facts: np.ndarray) -> dict[str, np.ndarray]:
    """Bin of each line by statistic."""
    return {k: (facts >> np.uint64(len(FACTS) + 4 * i) & np.uint64(15)).astype(np.int64) for i, k in enumerate(BINS)}


def line_scores(facts: np.ndarray, model: Model, cfg: QualityConfig) -> np.ndarray:
    """Log odds of each label for each line."""
    w, s = cfg.weights, np.zeros((len(facts), 4))
    has = {name: (facts & np.uint64(1 << i)) != 0 for i, name in enumerate(FACTS)}
    sound = has["sound"]
    s[:, JUNK] += np.where(has["bad"], w["bad"], np.where(has["poor"], w["poor"], -w["none"]))
    s[:, PROSE] += np.where(sound & has["wordy"], np.where(has["flowing"], w["common"], np.where(has["some"], w["some"], -w["none"])), 0.0)
    s[:, PROSE] += np.where(sound & has["sentence"], w["sentence"], 0.0)
    for name in ("mark", "tags", "inline", "short", "head"):
        s[:, LIST] += np.where(sound & has[name], w[name], 0.0)
    s[:, TABLE] += np.where(sound & has["ruled"], w["rule"], 0.0)
    laid, barred = sound & has["laid"], has["barred"]
    s[:, TABLE] += np.where(laid & has["many"], w["cells"] + 2.0 * barred, np.where(laid & has["two"], w["two"] + 1.0 * barred, 0.0))
    s[:, TABLE] += np.where(laid & has["near"], w["cells"] + 2.0, 0.0)
    for name, at in bins_of(facts).items() if model.odds else ():
        s += cfg.learnt * model.odds[name][:, at].T
    return s


def viterbi(scores: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best labels of all lines; ``first[d]`` .. ``first[d+1]`` are document d's. All documents move on together."""
    n_docs = len(first) - 1
    length = np.diff(first)
    labels = np.zeros(len(scores), np.int8)
    if not len(scores):
        return labels
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    alive = int((length > 0).sum())
    best = scores[begin[:alive]].copy()
    back = np.zeros((len(scores), 4), np.int8)
    ends = np.zeros((n_docs, 4))
    t = 1
    while alive:
        still = int((length[:alive] > t).sum())
        ends[still:alive] = best[still:alive]
        alive = still
        step = best[:alive, :, None] + move
        at = begin[:alive] + t
        back[at] = step.argmax(1)
        best = step.max(1) + scores[at] if alive else best[:0]
        t += 1
    state = ends.argmax(1)
    n = int((length > 0).sum())
    for t in range(int(length.max()) - 1, -1, -1):
        live = np.arange(n)[length[:n] > t]
        at = begin[live] + t
        labels[at] = state[live]
        state[live] = back[at, state[live]]
    return labels


def labelled(facts: np.ndarray, first: np.ndarray, model: Model, cfg: QualityConfig) -> np.ndarray:
    """The labels of the lines; ``first[d]`` .. ``first[d+1]`` are document d's."""
    return viterbi(line_scores(facts, model, cfg), first, model.move)


def label_shares(facts: np.ndarray, dense: np.ndarray, first: np.ndarray, model: Model, cfg: QualityConfig) -> np.ndarray:
    """Share of each label in each text, by ``dense``, the characters of its lines that aren't blank."""
    n = len(first) - 1
    doc = np.repeat(np.arange(n), np.diff(first))
    shares = np.bincount(doc * 4 + labelled(facts, first, model, cfg), weights=dense, minlength=4 * n).reshape(-1, 4)
    return shares / shares.sum(1, keepdims=True).clip(1)


def hashes_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words and of their accent-free forms."""
    return tuple(np.array(sorted({word_hash(w) for w in ws if w}), np.uint64) for ws in (words, [_plain(w) for w in words]))


def _plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word.replace("đ", "d")) if not unicodedata.combining(c))


def packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """The numbers of each document's lines as one binary value."""
    offsets = first.astype(np.int64) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]).cast(pa.binary())


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all documents' lines, and where each document's begin."""
    first = np.zeros(len(column) + 1, np.int64)
    np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), out=first[1:])
    return np.frombuffer(b"".join(column.to_pylist()), kind), first // np.dtype(kind).itemsize


def line_table(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], cfg: QualityConfig) -> DataFrame:
    """(doc_id, facts, dense): of each document with a line that isn't blank, the facts of those lines and how many of
    their characters aren't blank, as numbers one after another."""
    held = docs.sparkSession.sparkContext.broadcast(common)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("facts", T.BinaryType()), T.StructField("dense", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 2_000_000):
            x = Lines(b.column(1), *held.value)
            if x.n:
                out = pa.RecordBatch.from_arrays([b.column(0), packed(line_facts(x, cfg), x.first), packed(x.dense.astype(np.int32), x.first)], names=schema.names)
                yield out.filter(pa.array(np.diff(x.first) > 0))

    return docs.where(F.col("text").rlike(r"[^\s\p{Z}\p{Cf}\p{Cc}]")).select("doc_id", "text").mapInArrow(run, schema)


def line_counts(facts: np.ndarray, first: np.ndarray, cfg: QualityConfig) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Moves between labels of neighbouring lines, and lines by label and bin, as the seed model labels them."""
    labels = labelled(facts, first, seed_model(cfg), cfg).astype(np.int64)
    near = np.ones(max(len(labels) - 1, 0), bool)
    near[first[(first > 0) & (first < len(labels))] - 1] = False
    moves = np.bincount(labels[:-1][near] * 4 + labels[1:][near], minlength=16)
    return moves, {k: np.bincount(labels * (len(BINS[k]) + 1) + b, minlength=4 * (len(BINS[k]) + 1)) for k, b in bins_of(facts).items()}


def model_of(moves: np.ndarray, counts: dict[str, np.ndarray], cfg: QualityConfig) -> Model:
    """The model of such counts: emissions as counted, moves halfway between the seed's and those counted."""
    seed = np.exp(seed_model(cfg).move)
    m = seed + (moves.reshape(4, 4) + seed) / (moves.reshape(4, 4) + seed).sum(1, keepdims=True)
    odds = {}
    for k, c in counts.items():
        share = (c.reshape(4, -1) + 5.0) / (c.reshape(4, -1) + 5.0).sum(1, keepdims=True)
        odds[k] = np.clip(np.log(share) - np.log(share).mean(0), -cfg.most, cfg.most)
    return Model(np.log(m / m.sum(1, keepdims=True)), odds)


def fit(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], cfg: QualityConfig = QualityConfig()) -> Model:
    """The model estimated on all documents. Where ``cfg.fit_docs`` asks for it, on a sample of about so many (all, if there
    are fewer), drawn by a hash of the text so that neither order nor partitions matter."""
    total = docs.count() if cfg.fit_docs is not None else 0
    if cfg.fit_docs is not None and total > cfg.fit_docs:
        docs = docs.where(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < int(1_000_003 * cfg.fit_docs / total))
    return fit_lines(line_table(docs, common, cfg), cfg)


def fit_lines(lines: DataFrame, cfg: QualityConfig = QualityConfig()) -> Model:
    """The model estimated on all rows of a ``line_table``. Only counts, whole numbers, reach the driver, so that neither
    order nor partitions matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(pa.RecordBatch.from_arrays([b.column(0), b.column(0)], names=["f", "facts"]) for b in batches):
            moves, counts = line_counts(*unpacked(b.column(1), np.uint64), cfg)
            rows = [("", i, int(n)) for i, n in enumerate(moves) if n] + [(k, i, int(n)) for k, c in counts.items() for i, n in enumerate(c) if n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["k", "i", "n"])

    moves, counts = np.zeros(16), {k: np.zeros(4 * (len(b) + 1)) for k, b in BINS.items()}
    for r in lines.select("facts").mapInArrow(run, "k string, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n")).collect():  # a row a label and bin
        (counts[r.k] if r.k else moves)[r.i] = r.n
    return model_of(moves, counts, cfg)


def kinds(docs: DataFrame, common_words: DataFrame, cfg: QualityConfig = QualityConfig(), max_words: int = 100_000) -> DataFrame:
    """(doc_id, prose, list, table, junk, kind): shares of the labels in each text, and the label of the largest share.

    ``common_words`` is a list of function words; its size is checked against ``max_words`` before it travels to the
    tasks. The model is fitted on all documents and labels all documents: their lines are written once, 12 bytes each
    before compression, and read by both. Only the counts of the fit are shuffled.

    Defined results: NULL and blank texts give no row; equal shares go to the first of prose, list, table, junk; very
    long texts are read whole; repeated rows each count and each give theirs; other columns don't matter.
    """
    rows = [r[0] for r in common_words.where("word is not null").select(F.lower("word")).distinct().limit(max_words + 1).collect()]
    if len(rows) > max_words:
        raise ValueError(f"more than {max_words} common words: not a list of function words")
    common = hashes_of(sorted(rows))
    lines = written(line_table(docs, common, cfg))
    model = fit_lines(lines, cfg) if cfg.fit_docs is None else fit(docs, common, cfg)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(k, T.DoubleType()) for k in KINDS), T.StructField("kind", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            facts, first = unpacked(b.column(1), np.uint64)
            shares = label_shares(facts, unpacked(b.column(2), np.int32)[0], first, model, cfg)
            kind = pa.array(KINDS).take(pa.array(shares.argmax(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(shares[:, k]) for k in range(4)), kind], names=schema.names)

    return lines.mapInArrow(run, schema)


# Character classes of the statistics.
CJK = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
KANA = r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{FF66}-\x{FF9F}]"
HANGUL = r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]"
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"
SYMBOL = r"[\p{So}\p{Sk}\p{Sc}\p{Cf}\p{Co}\x00-\x08\x0E-\x1F\x7F-\x9F\x{AC}\x{B1}\x{D7}\x{F7}\x{2200}-\x{22FF}]"


def statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """Statistics of each document that isn't NULL or blank, as column expressions only: words, mean word length,
    lines, share of lines ending in punctuation, share of words that ``common_words`` lists (as written or without
    accents), and the ratios of letters and digits, symbols and junk to characters. The list rides along as one row."""
    w = F.lower("word")
    listed = common_words.where("word is not null").agg(F.array_distinct(F.flatten(F.collect_list(F.array(w, X.fold(w))))).alias("__listed"))
    docs = docs.select("doc_id", "text").crossJoin(F.broadcast(listed))
    t = F.col("text")
    n = F.length(t)
    words = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]+"))
    alnum = F.regexp_count(t, F.lit(r"[\p{L}\p{N}]"))
    symbols = F.regexp_count(t, F.lit(SYMBOL))
    junk = F.regexp_count(t, F.lit(f"{CJK}|{KANA}|{HANGUL}|{EMOJI}|{SYMBOL}"))
    common = F.size(F.filter(F.regexp_extract_all(F.lower(t), F.lit(r"([\p{L}\p{N}]+)"), 1), lambda x: F.array_contains("__listed", x)))
    lines = F.regexp_count(t, F.lit(r"(?m)^[^\n]*[^ \t\n\r\f\x0B][^\n]*$"))
    ended = F.regexp_count(t, F.lit(r"(?m)[.!?…:;][ \t\r\f\x0B]*$"))

    def ratio(a: Column, b: Column) -> Column:
        return F.round(a / F.greatest(b, F.lit(1)), 6)

    return docs.where(t.rlike(r"\S")).select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        words.cast("long").alias("n_words"),
        ratio(alnum, words).alias("mean_word_length"),
        lines.cast("long").alias("n_lines"),
        ratio(ended, lines).alias("punctuated_lines"),
        ratio(common, words).alias("common_ratio"),
        ratio(alnum, n).alias("alnum_ratio"),
        ratio(symbols, n).alias("symbol_ratio"),
        ratio(junk, n).alias("junk_ratio"),
    )
