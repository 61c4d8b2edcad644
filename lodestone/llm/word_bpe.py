"""BPE with word ends, by speculation and verification: encoding and decoding as the tokenizers library does.

A text is normalised and cut into words; each distinct word of a batch is encoded once, all of them together:

1. Speculate: the longest token that begins at each symbol is found for all symbols at once, by steps down a trie; taking the longest
   at each word's beginning, then behind it, and so on, proposes tokens.
2. Verify: merging would have given the very same tokens if each neighbouring pair of them would have stayed apart. For all pairs at once
   the merges that made the two are undone from the last to the first; where the two parts that meet at the border would
   have merged before the next part was made, the pair is no neighbouring one.
3. Only words with such a pair are merged exactly, pair by pair in order of rank.

Tokens that merging would not make of their own symbols are never proposed, as they are in no result.

Normalisation is done by Python where it agrees with the library's for all characters of the text (``_SURE``), which the tests hold over every one of
them; texts with any other character, such as one that only some version of Unicode knows, are normalised and cut by the library.

Defined results: a null text is an empty one; a string of a special token in a text is that token, as the library has it; ids that no token has
are left out by ``decode``; repeated rows are encoded each; other columns of the input are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import in_small_batches, slices
from lodestone.llm.token_counts import PairRanks, byte_characters

#: Words whose tokens a worker remembers between batches; only a memory bound.
REMEMBERED = 250_000
#: Characters that Python and the library lower, compose and class alike: Latin, Greek and Cyrillic letters, punctuation and signs, kana,
#: the common Han and Hangul blocks, and pictures.
_SURE = "\x00-\u052f\u1e00-\u2070\u20a0-\u20bf\u2100-\u218b\u2190-\u23ff\u2500-\u27bf\u3000-\u303f\u3041-\u3096\u3099-\u30ff\u4e00-\u9fef\uac00-\ud7a3\U0001f300-\U0001f64f"
_UNSURE = re.compile(f"[^{_SURE}]")
_NEVER = np.iinfo(np.int32).max


class WordCodec:
    """Encodes and decodes by a BPE file whose tokens at a word's end carry a suffix."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added, pre = spec["model"], spec.get("added_tokens", []), (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        plain = len(pre) == 2 and pre[0]["type"] == "Split" and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and pre[1]["type"] == "ByteLevel" and not pre[1]["use_regex"] and not pre[1]["add_prefix_space"]
        spaces = [n for n in (spec.get("normalizer") or {}).get("normalizers", []) if n["type"] == "Replace"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if not plain or steps != ["NFC", "Replace", "Lowercase"] or spaces[0]["pattern"] != {"Regex": r"\s+"} or spaces[0]["content"] != " " or model["type"] != "BPE" or not self.suffix or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError(f"{path}: only BPE files with word ends, white space dropped and lower case are supported")
        if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: added tokens that take in their surroundings are not supported")
        pattern = pre[0]["pattern"]["Regex"]
        self.split = regex.compile(pattern)
        library = Tokenizer.from_file(path)
        self.normalized, self.cut = library.normalizer.normalize_str, pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
        self.added = {t["content"]: t["id"] for t in added}
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None
        vocab: dict[str, int] = model["vocab"]
        self.token = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for t, i in (vocab | self.added).items():
            self.token[i] = t
        self._merges(vocab, [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        self._trie(vocab)
        #: by word: its ids as decimals with spaces, and its tokens with spaces
        self.written: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}
        #: words that were verified, and those that had to be merged
        self.held, self.failed = 0, 0

    def _merges(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        shown = byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in shown], np.int64)
        left, right, merged = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in merges), strict=True))
        self.pairs = PairRanks(left, right, merged)
        self.ranks = {pair: (k, to) for k, (pair, to) in enumerate(zip(zip(left.tolist(), right.tolist(), strict=True), merged.tolist(), strict=True))}
        # of each token the rank of the merge that makes it, and the two parts
        self.made = np.full(len(self.token), -1, np.int64)
        self.left, self.right = np.arange(len(self.token)), np.arange(len(self.token))
        self.made[merged], self.left[merged], self.right[merged] = np.arange(len(merged)), left, right
        if len(np.unique(merged)) < len(merged) or (np.maximum(self.made[left], self.made[right]) >= np.arange(len(merged))).any():
            raise ValueError("each token must be made by one merge, after those that make its parts")
        sound = self.made < 0
        apart = self.apart(left, right, np.arange(len(merged)))
        for t, l_, r_, ok in zip(merged.tolist(), left.tolist(), right.tolist(), apart.tolist(), strict=True):
            sound[t] = ok and sound[l_] and sound[r_]
        self.sound = sound

    def _trie(self, vocab: dict[str, int]) -> None:
        """Edges by (node, symbol), where edge k leads to node k + 1, and the token that ends at each node, or -1."""
        inner, last = (dict(zip(byte_characters(), of.tolist(), strict=True)) for of in (self.inner, self.last))
        edges: dict[tuple[int, int], int] = {}
        ends = {}
        for text, token in vocab.items():
            if not self.sound[token]:
                continue
            bare = text.removesuffix(self.suffix)
            symbols = [inner[c] for c in bare]
            if bare != text:
                symbols[-1] = last[bare[-1]]
            node = 0
            for s in symbols:
                node = edges.setdefault((node, s), len(edges) + 1)
            ends[node] = token
        self.ends = np.full(len(edges) + 1, -1, np.int64)
        self.ends[list(ends)] = list(ends.values())
        node, symbol = (np.array(x, np.int64) for x in zip(*edges, strict=True))
        self.edges = PairRanks(node, symbol, node)

    def apart(self, x: np.ndarray, y: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether neighbouring tokens x and y stay apart; given ``limit``, whether they do so until the merge of that rank.

        At any time the last part of x that is made by then meets the first one of y. The later made of the two is undone, and the parts
        that meet before it was made must not merge earlier than it: of equal ranks, merges further left come first.
        """
        x, y = x.copy(), y.copy()
        limit = np.full(len(x), _NEVER, np.int64) if limit is None else limit.copy()
        out, todo = np.ones(len(x), bool), np.arange(len(x))
        while len(todo):
            a, b = x[todo], y[todo]
            out[todo[self.pairs.of(a, b) < limit[todo]]] = False
            of_a, of_b = self.made[a], self.made[b]
            ends = out[todo] & (np.maximum(of_a, of_b) >= 0)
            todo, a, b, of_a, of_b = todo[ends], a[ends], b[ends], of_a[ends], of_b[ends]
            first = of_a > of_b
            x[todo] = np.where(first, self.right[a], a)
            y[todo] = np.where(first, b, self.left[b])
            limit[todo] = np.where(first, of_a, of_b + 1)
        return out

    def exact(self, symbols: list[int]) -> list[int]:
        """The tokens of one word by merging its lowest-ranked pairs, of equal ones the first."""
        after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))
        heap = [(found[0], k) for k in range(len(symbols) - 1) if (found := self.ranks.get((symbols[k], symbols[k + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            other = after[k]
            if symbols[k] < 0 or other >= len(symbols) or (now := self.ranks.get((symbols[k], symbols[other]))) is None or now[0] != rank:
                continue
            symbols[k], symbols[other] = now[1], -1
            after[k] = after[other]
            if after[k] < len(symbols):
                before[after[k]] = k
                if found := self.ranks.get((symbols[k], symbols[after[k]])):
                    heapq.heappush(heap, (found[0], k))
            if before[k] >= 0 and (found := self.ranks.get((symbols[before[k]], symbols[k]))):
                heapq.heappush(heap, (found[0], before[k]))
        return [s for s in symbols if s >= 0]

    def ids(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word; none of the words is empty."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        if not len(size):
            return []
        end = np.cumsum(size)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[flat]
        symbol[end - 1] = self.last[flat[end - 1]]
        stop = np.repeat(end, size)
        # the longest token from each symbol on
        token, reach = np.full(len(symbol), -1, np.int64), np.arange(len(symbol))
        going, node = np.arange(len(symbol)), np.zeros(len(symbol), np.int64)
        at = going
        while len(going):
            edge = self.edges.of(node, symbol[at])
            there = edge != _NEVER
            going, at, node = going[there], at[there] + 1, edge[there].astype(np.int64) + 1
            ends = self.ends[node] >= 0
            token[going[ends]], reach[going[ends]] = self.ends[node[ends]], at[ends]
            more = at < stop[going]
            going, at, node = going[more], at[more], node[more]
        taken = np.zeros(len(symbol), bool)
        at, stops = end - size, end
        while len(at):
            taken[at] = True
            at = reach[at]
            more = at < stops
            at, stops = at[more], stops[more]
        place = np.flatnonzero(taken)
        token, owner = token[place], np.searchsorted(end, place, "right")
        pair = np.flatnonzero(owner[1:] == owner[:-1])
        wrong = np.unique(owner[pair[~self.apart(token[pair], token[pair + 1])]])
        cuts = np.searchsorted(owner, np.arange(len(raw) + 1))
        every = token.tolist()
        out = [every[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        for w in wrong.tolist():
            out[w] = self.exact(symbol[end[w] - size[w] : end[w]].tolist())
        self.held, self.failed = self.held + len(raw) - len(wrong), self.failed + len(wrong)
        return out

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if text.isascii():
            return self.split.findall(text.lower())
        if _UNSURE.search(text):
            return [w for w, _ in self.cut(self.normalized(text))]
        # one by one, a capital sigma becomes the common small one, also at a word's end
        return self.split.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str | None) -> list[str]:
        """Words and special tokens in order; a special token is led by a NUL, which no word has beside a letter."""
        if not text:
            return []
        if self.marks is None or not self.marks.search(text):
            return self.words(text)
        out = []
        for k, part in enumerate(self.marks.split(text)):
            out += [f"\x00{part}"] if k % 2 else self.words(part) if part else []
        return out

    def learn(self, split: list[list[str]]) -> None:
        words = set().union(*split)
        fresh = words.difference(self.written)
        if len(self.written) + len(fresh) > REMEMBERED:
            self.written.clear()
            self.decoded.clear()
            fresh = words
        special = {w for w in fresh if w[0] == "\x00" and w[1:] in self.added}
        ordered = list(fresh - special)
        for word, ids in [*zip(ordered, self.ids(ordered), strict=True), *((w, [self.added[w[1:]]]) for w in special)]:
            self.written[word], self.decoded[word] = " ".join(map(str, ids)).encode(), self.decode(ids)

    def encode(self, text: str | None) -> list[int]:
        pieces = self.pieces(text)
        self.learn([pieces])
        return [int(i) for p in pieces for i in self.written[p].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids if 0 <= i < len(self.token) and self.token[i])

    def digests(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text its number of tokens, the SHA-256 of its ids and of what they decode to."""
        split = [self.pieces(t) for t in texts]
        self.learn(split)
        found = []
        for words in split:
            ids = b" ".join(map(self.written.__getitem__, words))
            text = " ".join(map(self.decoded.__getitem__, words))
            found.append((ids.count(b" ") + 1 if words else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
        return found


@functools.lru_cache(maxsize=2)
def codec(path: str) -> WordCodec:
    return WordCodec(path)


def _mapped(rows: DataFrame, id_col: str, value_col: str, schema: str, of) -> DataFrame:
    """``of`` (a slice of texts or lists as a column) for each row, beside its id."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in [batch] if pa.types.is_list(batch.column("value").type) else slices(batch, "value"):
                yield pa.RecordBatch.from_arrays([part.column("id"), *of(part.column("value"))], ["id", *names])

    held = in_small_batches(rows).select(F.col(id_col).alias("id"), F.col(value_col).alias("value"))
    return held.mapInArrow(run, f"id {held.schema['id'].dataType.simpleString()}, {schema}").withColumnRenamed("id", id_col)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row its id and the token ``ids`` of its text."""
    return _mapped(docs, id_col, text_col, "ids array<int>", lambda texts: [pa.array([codec(path).encode(t) for t in texts.to_pylist()], pa.list_(pa.int32()))])


def decode(coded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """For each row its id and ``decoded``, its tokens with spaces in between."""
    return _mapped(coded, id_col, ids_col, "decoded string", lambda lists: [pa.array([codec(path).decode(ids or []) for ids in lists.to_pylist()], pa.string())])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes in one pass without a shuffle: id, ``n_tokens``, ``ids_sha256`` (of the decimal ids with spaces in
    between) and ``decoded_sha256`` (of the decoded text)."""

    def of(texts: pa.Array) -> list[pa.Array]:
        count, ids, decoded = zip(*codec(path).digests(texts.to_pylist()), strict=True)
        return [pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]

    return _mapped(docs, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", of)
