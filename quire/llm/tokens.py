"""Token counts under a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Where the vocabulary is by default, on the driver; it goes to the workers with the job.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the vocabulary's splitting pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict = {}


def encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file, loaded once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def n_tokens(text: Column, path: str = VOCABULARY) -> Column:
    """The number of tokens of a text; 0 for NULL. The rank file need only be where the driver is."""
    SparkSession.active().sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        enc = encoding(SparkFiles.get(name))
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], dtype="int64")

    return count(text)
