"""Exact token counts by a BPE vocabulary file, in Arrow batches; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import functools

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .batches import mapped

#: Fixed value: how the vocabulary's pattern splits text before pairs are merged.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str) -> Column:
    @F.arrow_udf("long")
    def run(t: pa.Array) -> pa.Array:
        e = encoding(path)
        return mapped(lambda x: 0 if x is None else len(e.encode_ordinary(x)), pa.int64(), t)

    return run(text)


def truncate_tokens(text: Column, budget: int, path: str) -> Column:
    @F.arrow_udf("string")
    def run(t: pa.Array) -> pa.Array:
        e = encoding(path)
        return mapped(lambda x: None if x is None else e.decode(e.encode_ordinary(x)[:budget]), pa.string(), t)

    return run(text)
