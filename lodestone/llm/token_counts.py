"""Token counts by rank-synchronous array merging.

The words of a batch are held as one ragged array of symbols. In each round every
sequence merges its own lowest-ranked neighbouring pair, wherever it stands in
that sequence, and all sequences do so at once. What is left when no pair can be
merged is counted.

Defined results: a null or empty text has no tokens; a string of an added token
counts as that one token; repeated rows are counted each; other columns of the
input are not looked at, so their names cannot clash.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import in_small_batches, slices

#: The split that byte-level tokenizer files with ``use_regex`` stand for (fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words whose counts a worker remembers between batches; only a memory bound.
REMEMBERED = 400_000

_NEVER = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairRanks:
    """Merge ranks by pair of symbols, in a hash table of numpy arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(2**64 - 1))
        self.rank = np.full(1 << bits, _NEVER)
        self.merged = np.append(merged, -1).astype(np.int32)
        keys = self.key(left, right)
        todo, slot = np.arange(len(keys)), self.slot(keys)
        self.probes = 0
        while len(todo):
            self.probes += 1
            free = self.keys[slot[todo]] == np.uint64(2**64 - 1)
            tried, first = np.unique(slot[todo[free]], return_index=True)
            placed = todo[free][first]
            self.keys[tried], self.rank[tried] = keys[placed], placed
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    @staticmethod
    def key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = self.key(left, right)
        slot = self.slot(keys)
        found = np.where(self.keys[slot] == keys, self.rank[slot], _NEVER)
        open_ = np.flatnonzero((found == _NEVER) & (self.keys[slot] != np.uint64(2**64 - 1)))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & self.mask
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            found[open_[hit]] = self.rank[slot[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(2**64 - 1))]
        return found


class MergeCounter:
    """Counts symbols by the merges of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or spec.get("normalizer") or model.get("dropout"):
            raise ValueError(f"{path}: only plain byte-level BPE files are supported")
        added = [t["content"] for t in spec.get("added_tokens", [])]
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.split = regex.compile(SPLIT)
        vocab = model["vocab"]
        self.byte_symbol = np.array([vocab[c] for c in byte_characters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right, merged = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        born = np.full(max(vocab.values()) + 1, -1)
        born[merged[::-1]] = np.arange(len(merged))[::-1]
        if (np.maximum(born[left], born[right]) >= np.arange(len(merged))).any():
            raise ValueError(f"{path}: a merge comes before those that make its parts")
        self.pairs = PairRanks(left, right, merged)
        self.known: dict[str, int] = {}

    def symbols(self, words: list[str]) -> np.ndarray:
        """The number of symbols of each word after all merges."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        left = sizes.copy()
        sym = self.byte_symbol[np.frombuffer(b"".join(raw), np.uint8)]
        owner = np.repeat(np.arange(len(raw)), sizes)
        while len(sym) > 1:
            same = owner[1:] == owner[:-1]
            rank = np.full(len(sym), _NEVER)
            rank[:-1][same] = self.pairs.of(sym[:-1][same], sym[1:][same])
            begin = np.flatnonzero(np.append(True, ~same))
            lowest = np.minimum.reduceat(rank, begin)
            run = np.diff(np.append(begin, len(sym)))
            going = lowest != _NEVER
            if not going.any():
                break
            keep = np.repeat(going, run)
            merge = (rank == np.repeat(lowest, run)) & keep
            # of equal pairs that overlap (aaa), every second one from the left merges
            at = np.flatnonzero(merge)
            head = np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
            place = np.arange(len(at)) - np.repeat(np.flatnonzero(head), np.diff(np.append(np.flatnonzero(head), len(at))))
            at = at[place % 2 == 0]
            left -= np.bincount(owner[at], minlength=len(left))
            sym[at] = self.pairs.merged[rank[at]]
            keep[at + 1] = False
            sym, owner = sym[keep], owner[keep]
        return left

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The words of a text and the number of added tokens in it."""
        if self.added is None or not (marks := len(self.added.findall(text))):
            return self.split.findall(text), 0
        return [w for part in self.added.split(text) for w in self.split.findall(part)], marks

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self.pieces(t) if t else ([], 0) for t in texts]
        words = set().union(*(own for own, _ in split))
        fresh = words.difference(self.known)
        if len(self.known) + len(fresh) > REMEMBERED:
            self.known.clear()
            fresh = words
        if fresh:
            ordered = list(fresh)
            self.known.update(zip(ordered, self.symbols(ordered).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, words)) + marks for words, marks in split]


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> MergeCounter:
    return MergeCounter(path)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """For each row its id, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    One Arrow pass over two columns, without a shuffle; a worker holds a slice of
    a batch and the counts of at most ``REMEMBERED`` words.
    """
    path = os.fspath(path)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(counter.count(part.column("text").to_pylist()), pa.int64()), part.column("n_bytes")], ["id", "n_tokens", "n_bytes"])

    rows = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    id_type = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(count, f"id {id_type}, n_tokens long, n_bytes long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
