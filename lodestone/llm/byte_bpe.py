"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file (base64 token, rank) becomes a vocabulary of byte characters and the
merges of every split of each token into two tokens, in rank order. Each match of
the split pattern is a word of its own; equal words of a batch are encoded once.

Offsets are in characters of the text: a token that begins or ends inside a
character covers that character whole. Decoding turns ids into bytes by the
reversed byte table; bytes that are no whole character stay bytes, or become
U+FFFD where a string is asked for.

Defined results: a null text is an empty one; no special tokens are known; ids
out of the vocabulary raise; other columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import in_small_batches, slices
from lodestone.llm.token_counts import byte_characters

#: Words whose codes a worker remembers between batches; only a memory bound.
REMEMBERED = 250_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """Every pair of tokens that makes a token, by the rank of what it makes."""
    return [
        (token[:i], token[i:])
        for token in sorted(ranks, key=ranks.__getitem__)
        for i in sorted(range(1, len(token)), key=lambda i, t=token: (ranks.get(t[:i], 0), ranks.get(t[i:], 0)))
        if token[:i] in ranks and token[i:] in ranks
    ]


class Codec:
    def __init__(self, path: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # an executor's cores are shared out by Spark
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        shown = byte_characters()
        write = lambda token: "".join(map(shown.__getitem__, token))
        self.tokenizer = Tokenizer(models.BPE(vocab={write(t): r for t, r in ranks.items()}, merges=[(write(a), write(b)) for a, b in merges_of(ranks)], ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in enumerate(shown)}
        self.token_bytes = {i: bytes(map(back.__getitem__, t)) for t, i in self.tokenizer.get_vocab().items()}
        self.split = regex.compile(pattern)
        #: by word: its ids as decimals with commas, and the bytes that these decode to
        self.written: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, text: str) -> tuple[list[int], list[int], list[int]]:
        """Ids, and the first and the past-the-last character of each."""
        words = self.split.findall(text)
        distinct = dict.fromkeys(words)
        for word, ids in zip(distinct, self.ids(list(distinct)), strict=True):
            distinct[word] = ids
        ids = [i for w in words for i in distinct[w]]
        size = np.fromiter((len(self.token_bytes[i]) for i in ids), np.int64, len(ids))
        end = np.cumsum(size)
        raw = np.frombuffer(text.encode(), np.uint8)
        character = np.append(np.cumsum((raw & 0xC0) != 0x80) - 1, len(text))
        return ids, character[end - size].tolist(), (character[end - 1] + 1).tolist() if ids else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def learn(self, split: list[list[str]]) -> None:
        words = set().union(*split)
        fresh = words.difference(self.written)
        if len(self.written) + len(fresh) > REMEMBERED:
            self.written.clear()
            self.decoded.clear()
            fresh = words
        ordered = list(fresh)
        for word, ids in zip(ordered, self.ids(ordered), strict=True):
            self.written[word], self.decoded[word] = ",".join(map(str, ids)).encode(), self.decode(ids)

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text its number of tokens, the SHA-256 of its ids, and of the bytes these decode to."""
        split = [self.split.findall(t) if t else [] for t in texts]
        self.learn(split)
        found = []
        for words in split:
            ids = b",".join(map(self.written.__getitem__, words))
            raw = b"".join(map(self.decoded.__getitem__, words))
            found.append((ids.count(b",") + 1 if words else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))
        return found


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id, the token ``ids``, and their ``starts`` and ``ends`` in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                coded = [own.encode(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), *(pa.array([c[k] for c in coded], pa.list_(pa.int32())) for k in range(3))], ["id", "ids", "starts", "ends"])

    rows = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, starts array<int>, ends array<int>")
    return out.withColumnRenamed("id", id_col)


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """For each row its id, the ``decoded`` bytes of its ids, and ``decoded_text``, where
    bytes that are no whole character are U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            raw = [own.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.binary()), pa.array([r.decode("utf-8", "replace") for r in raw], pa.string())], ["id", "decoded", "decoded_text"])

    rows = in_small_batches(coded).select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, decoded binary, decoded_text string")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass: id, ``n_tokens``, ``ids_sha256`` (of the decimal
    ids joined by commas) and ``decoded_sha256`` (of the decoded bytes). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            for part in slices(batch, "text"):
                count, ids, decoded = zip(*own.digests(part.column("text").to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
