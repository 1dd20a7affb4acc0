"""Whole Arrow batches of texts as one array of code points, folded by table look-ups."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tramloom.functions.workers import per_worker

#: Letters of other scripts that look like a Latin letter, with that letter.
LOOKALIKES = {
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "α": "a", "γ": "y", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ӏ": "I", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ԁ": "D",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v",
    # Armenian
    "Օ": "O", "Ս": "U", "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q",
}

#: Latin letters outside Vietnamese spelling that look like one inside it.
LATIN_LOOKALIKES = {"ɡ": "g", "ɑ": "a", "ı": "i", "Ð": "Đ", "Ɖ": "Đ", "ɖ": "đ", "ƒ": "f", "ѡ": "w", "ʋ": "v", "Ɩ": "I", "ǀ": "l"}


def pieces(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each (a longer text alone)."""
    for batch in batches:
        size = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
        total = np.cumsum(size)
        at = 0
        while at < batch.num_rows:
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + most, "right")))
            yield batch.slice(at, end - at)
            at = end


class Codes:
    """``cp``: code points of all texts one after another; ``start``, ``stop``: each text's part of them (NULL: empty)."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string())
        n = len(texts)
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and n else np.empty(0, np.uint8)
        self.cp = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        at = first[off - off[0]]
        self.start, self.stop = at[:-1], at[1:]


def _fold_one(ch: str) -> int:
    """The letter or digit that ``ch`` counts as: lower case, without marks; 0: nothing; 32: a break between words."""
    if unicodedata.category(ch) in ("Cf", "Mn", "Me", "Cs"):
        return 0
    base = [c for c in unicodedata.normalize("NFKD", ch).lower() if not unicodedata.combining(c)]
    if not base:
        return 0
    c = "d" if base[0] in "đð" and ch in "đĐ" else base[0]
    return ord(c) if unicodedata.category(c)[0] in "LN" else 32


def fold_table() -> np.ndarray:
    """Of each code point, what it counts as in a word (see ``_fold_one``), by rule."""

    def build() -> np.ndarray:
        t = np.full(0x110000, 32, np.uint32)
        for a, b in ((0, 0x3400), (0xA000, 0xA800), (0xF900, 0x10000), (0x1D400, 0x1D800), (0x1F100, 0x1F200), (0xE0000, 0xE0200)):
            t[a:b] = [_fold_one(chr(i)) for i in range(a, b)]
        for a, b in ((0x3400, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x32000)):
            t[a:b] = np.arange(a, b)
        return t

    return per_worker("fold_table", build)


def look_table(letters: dict[str, str] | None = None) -> np.ndarray:
    """Like ``fold_table``, with look-alike letters as the Latin letter they look like: those of ``letters`` (on a worker's
    first call), else the fixed ones."""

    def build() -> np.ndarray:
        t = fold_table().copy()
        for a, b in ((letters or {}) | LOOKALIKES | LATIN_LOOKALIKES).items():
            if len(b) == 1:
                t[ord(a)] = t[ord(b)]
        return t

    return per_worker("look_table", build)


def mixed(x: np.ndarray) -> np.ndarray:
    """A well mixed 64-bit number for each number (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of two independent hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Rabin-Karp hashes of any span of a sequence of numbers: one running sum, then O(1) a span."""

    def __init__(self, numbers: np.ndarray, which: int = 0):
        n = len(numbers)
        base = BASES[which]
        self.sum = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(numbers.astype(np.uint64) + np.uint64(0x51ED270B + which)) * powers(pow(base, -1, 1 << 64), n)[:n], out=self.sum[1:])
        self.up = powers(base, n + 1)

    def spans(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of each span; equal spans have equal hashes wherever they stand."""
        return mixed((self.sum[stop] - self.sum[start]) * self.up[start] + (stop - start).astype(np.uint64))


class Words:
    """Words of a batch: runs of letters and digits after folding. ``doc``, ``start``, ``stop``: each word's text and span in ``letters``; ``hash``: its number."""

    def __init__(self, codes: Codes, table: np.ndarray):
        folded = table[codes.cp]
        doc_of = np.repeat(np.arange(len(codes.start), dtype=np.int32), codes.stop - codes.start)
        kept = folded != 0
        self.letters, doc_of = folded[kept], doc_of[kept]
        self.raw = np.flatnonzero(kept)
        word = self.letters != 32
        same = np.zeros(len(word), bool)
        same[1:] = word[1:] & word[:-1] & (doc_of[1:] == doc_of[:-1])
        self.start = np.flatnonzero(word & ~same)
        ends = np.ones(len(word), bool)
        ends[:-1] = ~same[1:]
        self.stop = np.flatnonzero(word & ends) + 1
        self.doc = doc_of[self.start]
        self.hash = Rolling(self.letters).spans(self.start, self.stop)
        counts = np.bincount(self.doc, minlength=len(codes.start))
        self.first = np.concatenate([[0], np.cumsum(counts)])
