"""Vectors of doubles as bytes: where a vector is not zero, and the values there, bit for bit.

Hashed vectors are nearly all zeros; a column of arrays costs 8 bytes and a call of the writer for each of them, in files, in shuffles and in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors that a worker holds at once.
VECTORS = 256


def packed(vector: np.ndarray | list[float] | None) -> bytes | None:
    """The length, then the steps from one value to the next and the values, or all values if these are fewer bytes."""
    if vector is None:
        return None
    v = np.asarray(vector, "<f8")
    at = np.flatnonzero(v.view("<i8"))
    kind = np.dtype("<u2" if len(v) <= 1 << 16 else "<u4")
    size = np.uint32(len(v)).tobytes()
    if len(at) * (kind.itemsize + 8) >= 8 * len(v):
        return size + v.tobytes()
    steps = at.astype(kind)
    steps[1:] -= at[:-1].astype(kind)
    return size + steps.tobytes() + v[at].tobytes()


def unpacked(data: bytes | None) -> np.ndarray | None:
    if data is None:
        return None
    n = int.from_bytes(data[:4], "little")
    if len(data) == 4 + 8 * n:
        return np.frombuffer(data, "<f8", n, 4)
    kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
    k = (len(data) - 4) // (kind.itemsize + 8)
    out = np.zeros(n)
    out[np.cumsum(np.frombuffer(data, kind, k, 4), dtype=np.int64)] = np.frombuffer(data, "<f8", k, 4 + k * kind.itemsize)
    return out


@F.pandas_udf(T.BinaryType())
def pack(vectors: pd.Series) -> pd.Series:
    return pd.Series([packed(v) for v in vectors], dtype=object)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def unpack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for data in batches:
        # some at a time, since a vector may be much longer than its bytes
        for k in range(0, len(data), VECTORS):
            yield pd.Series([unpacked(d) for d in data[k : k + VECTORS]], dtype=object)
