"""Long exact spans shared between documents.

Rabin-Karp hashes of windows of ``span`` characters are counted in Spark; windows that stand in more than one document
merge into maximal intervals. Three things keep the count small without changing its result:

* copies of a whole text are one text in the count, and are shared from end to end;
* a window can only be repeated if the least of the ``gram``-hashes inside it is repeated (winnowing); the windows that
  a gram leads are one stretch, and one gram a stretch, about one for fifty characters, is counted first;
* where the whole text under a stretch is repeated, so are all its windows; only the windows of the other stretches of
  repeated grams, those at the ends of shared spans, are counted one by one, against those of the repeated stretches
  that the same gram leads, which two of their documents give.

Stretches and windows are counted by two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tramloom.llm.codes import Codes, Rolling, pieces
from tramloom.sources.tables import checkpointed, written

#: So many stretches or hashes at most travel to all tasks; more are joined by a shuffle.
MOST_SENT = 1_000_000


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least of each run of ``width`` numbers, the first of equal ones."""
    if len(h) < width:
        return np.empty(0, np.int64)
    least, at = h, np.arange(len(h), dtype=np.int32 if len(h) < 1 << 31 else np.int64)

    def halves(shift: int) -> tuple[np.ndarray, np.ndarray]:
        left, right = least[: len(least) - shift], least[shift:]
        take = right < left
        return np.where(take, right, left), np.where(take, at[shift:], at[: len(at) - shift])

    have = 1
    while have * 2 <= width:
        least, at = halves(have)
        have *= 2
    if width > have:
        least, at = halves(width - have)
    return at.astype(np.int64)


def stretches(texts: pa.Array, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first start, last start, hash) of the stretches of windows that one gram leads."""
    codes = Codes(texts)
    n = len(codes.cp)
    if n < span:
        return (*(np.empty(0, np.int64) for _ in range(3)), np.empty(0, np.uint64))
    at = np.arange(n - gram + 1)
    h = Rolling(codes.cp).spans(at, at + gram)
    lead = least_positions(h, span - gram + 1)  # of the window that starts at each position
    doc = np.repeat(np.arange(len(codes.start), dtype=np.int32), codes.stop - codes.start)
    inside = np.flatnonzero(doc[: n - span + 1] == doc[span - 1 :])
    own, led = doc[inside], lead[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (own[1:] != own[:-1]) | (led[1:] != led[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(inside)) - 1
    d = own[first].astype(np.int64)
    return d, inside[first] - codes.start[d], inside[last] - codes.start[d], h[led[first]]


def span_hashes(texts: pa.Array, lists: pa.ListArray, step: int, span: int, windows: bool) -> tuple[np.ndarray, ...]:
    """(text, place, gram, hash, second hash) of the listed stretches' texts, or of each of their ``windows``."""
    codes = Codes(texts)
    rows, doc = lists.flatten(), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    place, lead = (pc.struct_field(rows, [i]).to_numpy(zero_copy_only=False) for i in (0, 1))
    fits = place // step + place % step + span <= (codes.stop - codes.start)[doc]
    place, lead, doc = place[fits], lead[fits], doc[fits]
    first, more = place // step, place % step
    if windows:
        count = more + 1
        doc, lead = np.repeat(doc, count), np.repeat(lead, count)
        first = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
        place, more = first * step, np.zeros(len(first), np.int64)
    start = codes.start[doc] + first
    stop = start + more + span
    return doc, place, lead, Rolling(codes.cp).spans(start, stop), Rolling(codes.cp, 1).spans(start, stop)


def _repeated(occ: DataFrame, keys: list[str], doc: str, most_sent: int) -> DataFrame:
    """Rows of ``occ`` whose keys occur in more than one document.

    The count combines before its shuffle. Repeated keys travel to the rows while there are at most ``most_sent``; beyond,
    the rows are joined to them, those of a hot key (more than a thousandth of them) in as many parts as the session
    has shuffle partitions.
    """
    counted = checkpointed(occ.groupBy(*keys).agg(F.min(doc).alias("lo"), F.max(doc).alias("hi"), F.count("*").alias("n")).where("lo < hi").select(*keys, "n"))
    size, rows = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if size <= most_sent:
        return occ.join(F.broadcast(counted.select(*keys)), keys, "left_semi")
    parts = int(occ.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(counted.where(F.col("n") > rows / 1000).select(*keys, F.lit(True).alias("hot")))  # fewer than 1000
    split = lambda df, part: df.join(hot, keys, "left").withColumn("part", F.explode(F.when(F.col("hot"), part).otherwise(F.array(F.lit(0)))))
    own = split(occ, F.array(F.pmod(F.xxhash64(doc), F.lit(parts)).cast("int")))
    return own.join(split(counted, F.sequence(F.lit(0), F.lit(parts - 1))).select(*keys, "part"), [*keys, "part"], "left_semi").drop("hot", "part")


def shared_spans(docs: DataFrame, span: int = 200, gram: int = 100, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, shared_chars, spans): documents with a span of at least ``span`` characters that stands in another
    document too, the number of their characters inside such spans, and the maximal intervals (start, stop); intervals
    that only touch stay apart.

    No text is shuffled while the stretches of repeated grams number at most ``most_sent``; beyond, the texts are joined
    to them. A list of stretches is never longer than the text that it belongs to.

    Defined results: NULL texts and texts shorter than ``span`` share nothing; repeats inside one document don't
    count; copies of a text are shared from end to end; ``doc_id`` must be unique; other columns don't matter.
    """
    step = span - gram + 1
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= span)
    keyed = long_.select("doc_id", "text", F.length("text").alias("len"), F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), "text").alias("u"))
    own = checkpointed(keyed.select("doc_id", "len", "t", "u"))
    texts = own.groupBy("t", "u").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a task tells the stretches of a text once, however many copies it reads
        for b in pieces(batches):
            ids = b.column(0).to_pylist()
            new = []
            for t in ids:
                new.append(t not in seen)
                seen.add(t)
            b = b.filter(pa.array(new))
            doc, first, last, h = stretches(b.column(1), span, gram)
            yield pa.RecordBatch.from_arrays([_signed(h), b.column(0).take(pa.array(doc)), pa.array(first * step + last - first)], names=["h", "t", "place"])

    led = written(keyed.select("t", "text").mapInArrow(prints, "h long, t long, place long"))  # counted and joined, made once
    marks = _repeated(led, ["h"], "t", most_sent).groupBy("t").agg(F.collect_set(F.struct("place", F.col("h").alias("lead"))).alias("places"))
    marks = checkpointed(marks.join(texts.select("t", "rep"), "t").select("rep", "places"))

    def hashed(spots: DataFrame, windows: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in pieces(batches, 1_000_000):
                doc, place, lead, h, g = span_hashes(b.column(1), b.column(2), step, span, windows)
                yield pa.RecordBatch.from_arrays([_signed(h), _signed(g), b.column(0).take(pa.array(doc)), pa.array(place), pa.array(lead)], names=["h", "g", "rep", "place", "lead"])

        n = spots.agg(F.coalesce(F.sum(F.size("places")), F.lit(0))).first()[0]
        sent = F.broadcast(spots) if n <= most_sent else spots
        return long_.withColumnRenamed("doc_id", "rep").join(sent, "rep").select("rep", "text", "places").mapInArrow(run, "h long, g long, rep long, place long, lead long")

    laid = written(hashed(marks, False))
    told = written(_repeated(laid, ["h", "g"], "rep", most_sent))
    left = laid.join(told.select("h", "g").distinct(), ["h", "g"], "left_anti").select("rep", "place", "lead")
    pair = F.explode(F.array(F.col("a"), F.col("b"))).alias("x")
    known = told.groupBy("h", "g", "lead").agg(F.min(F.struct("rep", "place")).alias("a"), F.max(F.struct("rep", "place")).alias("b"))
    known = known.join(left.select("lead").distinct(), "lead", "left_semi").select(pair, "lead").select("x.rep", "x.place", "lead")
    rest = checkpointed(left.unionByName(known).groupBy("rep").agg(F.collect_list(F.struct("place", "lead")).alias("places")))
    ends = _repeated(hashed(rest, True).drop("lead"), ["h", "g"], "rep", most_sent)
    found = told.select("rep", "place").unionByName(ends.select("rep", "place"))
    merged = found.groupBy("rep").agg(F.sort_array(F.collect_list("place")).alias("places")).mapInArrow(_merge(span, step), "rep long, spans array<struct<start:int,stop:int>>")
    shared = texts.where("n = 1").join(merged, "rep").select("t", "u", "spans")
    copied = texts.where("n > 1").select("t", "u", "n")
    hot = F.broadcast(copied.where(F.col("n") > own.count() / 1000).select("t", "u"))  # fewer than 1000 texts
    copies = own.join(hot, ["t", "u"], "left_semi").unionByName(own.join(hot, ["t", "u"], "left_anti").join(copied, ["t", "u"], "left_semi"))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("len").alias("stop")))
    out = copies.select("doc_id", whole.alias("spans")).unionByName(own.join(shared, ["t", "u"]).select("doc_id", "spans"))
    chars = F.aggregate("spans", F.lit(0), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc_id", chars.cast("int").alias("shared_chars"), "spans")


def _merge(span: int, step: int):
    """Sorted stretches of repeated windows as maximal intervals, by list offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
        for b in batches:
            lists = b.column(1)
            place = lists.flatten().to_numpy(zero_copy_only=False)
            owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
            start, own = place // step, owner.astype(np.int64) << 40
            stop = np.maximum.accumulate(own + start + place % step + span) - own
            new = np.ones(len(start), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (start[1:] >= stop[:-1])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(start)) - 1
            offsets = np.searchsorted(owner[first], np.arange(b.num_rows + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array(stop[last].astype(np.int32))], fields=list(kind))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["rep", "spans"])

    return run
