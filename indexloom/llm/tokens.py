"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Vocabulary files of public tokenizers, installed on every machine.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this family cut a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def encoding(vocabulary: str):
    """The tokenizer of a rank file; read once per worker."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a whole text as int; 0 for a null or empty one. Strings of special tokens are ordinary text."""

    def count(texts: pa.Array) -> pa.Array:
        enc = encoding(vocabulary)
        return pa.array([len(enc.encode_ordinary(t)) if t else 0 for t in texts.to_pylist()], pa.int32())

    return F.arrow_udf(count, "int")(text)


def quality_of(n_chars: int, ids: Sequence[int]) -> float:
    """A quality weight in [0.05, 1] of a text from its tokens.

    The geometric mean of three parts of at most 1: *fluency*, characters per token over 4 (a
    tokenizer cuts codes, digits and noise into short pieces and prose into long ones); *variety*,
    different tokens over n^0.7, what a text of its length may have without repeating itself; and
    *substance*, n / (n + 16), as very short texts say little.
    """
    n = len(ids)
    if not n:
        return 0.05
    fluency, variety, substance = min(1.0, n_chars / n / 4), min(1.0, len(set(ids)) / n**0.7), n / (n + 16)
    return max(0.05, (fluency * variety * substance) ** (1 / 3))


def tokens_and_quality(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Struct of ``n`` (as :func:`n_tokens`) and ``quality`` (as :func:`quality_of`; 0.05 for a null or empty text), from one pass over the whole text."""

    def measure(texts: pa.Array) -> pa.Array:
        enc = encoding(vocabulary)
        n, q = [], []
        for t in texts.to_pylist():
            ids = enc.encode_ordinary(t) if t else []
            n.append(len(ids))
            q.append(quality_of(len(t or ""), ids))
        return pa.StructArray.from_arrays([pa.array(n, pa.int32()), pa.array(q, pa.float64())], names=["n", "quality"])

    return F.arrow_udf(measure, "struct<n:int,quality:double>")(text)
