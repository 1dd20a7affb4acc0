"""Token counts by a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tramloom.functions.workers import per_worker

#: Fixed value: how byte-level BPE splits a text before it merges, as published with the GPT-2 tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text is cut for the tokenizer at a word's start after so many characters; the pattern never joins words over a
#: blank, so the count stays that of the whole text.
PIECE = 20_000


def default_vocabulary() -> str:
    """Path of the multilingual byte-level BPE ranks, of ``TRAMLOOM_VOCABULARY`` or else of the installed package."""
    if path := os.environ.get("TRAMLOOM_VOCABULARY"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _encoding(path: str):
    def build():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return per_worker("encoding_" + "".join(c if c.isalnum() else "_" for c in path), build)


def count_tokens(text: str, encoding) -> int:
    total, at = 0, 0
    while len(text) - at > PIECE:
        cut = text.find(" ", at + PIECE)
        while cut > 0 and (text[cut - 1].isspace() or not text[cut + 1 : cut + 2].strip()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        total += len(encoding.encode_ordinary(text[at:cut]))
        at = cut
    return total + len(encoding.encode_ordinary(text[at:]))


def with_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, tokens) of each document; a NULL text has no tokens."""
    path = vocabulary or default_vocabulary()
    schema = T.StructType([docs.schema["doc_id"], docs.schema["source"], T.StructField("tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for b in batches:
            counts = [0 if x is None else count_tokens(x, encoding) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=schema.names)

    return docs.select("doc_id", "source", "text").mapInArrow(run, schema)
