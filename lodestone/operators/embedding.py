"""Deterministic hashed bag-of-words vectors."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.durable import in_small_batches
from lodestone.operators.packed import VECTORS, packed

DIMENSIONS = 1024
#: Hashes that a worker keeps.
HASHES = 200_000
#: Of ASCII characters, those of tokens in lower case and spaces for all others.
_ASCII = {c: chr(c).lower() if re.match(r"\w", chr(c)) else " " for c in range(128)}


def model_id(dimensions: int = DIMENSIONS) -> str:
    return f"hashing-bow-{dimensions}"


def token_hash(token: str) -> int:
    """The first eight bytes of BLAKE2b of a token: the remainder by the number of dimensions is its place,
    the top bit its sign."""
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest())


class _Hashes(dict):
    """Hashes of tokens that have been seen, up to a number of them."""

    def __missing__(self, token: str) -> int:
        if len(self) >= HASHES:
            self.clear()
        out = self[token] = token_hash(token)
        return out


_hashes = _Hashes()


def words(text: str) -> list[str]:
    """Runs of letters, digits and underscores, lower-cased once matched."""
    if text.isascii():
        return text.translate(_ASCII).split()
    return [*map(str.lower, re.findall(r"\w+", text))]


def hashed_vector(text: str | None, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The unit vector of a text's tokens, each weighing 1 + ln(count); zero if it has none."""
    counts = Counter(words(text or ""))
    out = np.zeros(dimensions)
    if counts:
        hashes = np.fromiter(map(_hashes.__getitem__, counts), np.uint64, len(counts))
        weights = 1 + np.log(np.fromiter(counts.values(), float, len(counts)))
        np.add.at(out, (hashes % np.uint64(dimensions)).astype(np.int64), np.where(hashes >> np.uint64(63), weights, -weights))
    norm = math.sqrt(float(out @ out))
    return out / norm if norm else out


def embed(rows: DataFrame, text_col: str, dimensions: int = DIMENSIONS, client: Callable[[list[str]], list[list[float]]] | None = None, as_bytes: bool = False) -> DataFrame:
    """``rows`` with ``embedding``. ``client`` embeds a batch of texts (256 at most) in place of the hashing; it
    is called on the executors and must be safe to call again. ``as_bytes`` gives vectors as ``packed`` does."""
    made = packed if as_bytes else lambda v: v

    @F.pandas_udf("binary" if as_bytes else "array<double>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            if client is None:
                # some at a time, since a vector may be much longer than its text
                for k in range(0, len(batch), VECTORS):
                    yield pd.Series([made(hashed_vector(t, dimensions)) for t in batch[k : k + VECTORS]])
            else:
                values = batch.fillna("").tolist()
                yield pd.Series([made(v) for k in range(0, len(values), 256) for v in client(values[k : k + 256])])

    return in_small_batches(rows).withColumn("embedding", vectors(F.col(text_col)))
