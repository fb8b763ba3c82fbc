"""Token counts under a public byte-level BPE vocabulary. The vocabulary file is a parameter and is never copied."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary splits text into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_encoders: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of a worker process, read once."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(df: DataFrame, text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``df`` with ``text`` replaced by ``n_tokens``. Null and empty texts have no tokens; whole texts are encoded."""
    keep = [c for c in df.columns if c != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != text] + ["n_tokens long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for pdf in batches:
            out = pdf[keep].copy()
            out["n_tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in pdf[text]]
            yield out

    return df.select(*keep, F.col(text)).mapInPandas(run, schema)
