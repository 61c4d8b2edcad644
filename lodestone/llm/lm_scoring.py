"""LM scoring: the log10 probability of each whole document under a gated recurrent
language model, and under the counts of the training tokens alone.

Tokens are the words of a text, lower-cased A-Z, and one end. The training rows' tokens are
all counted: each task adds up its own, and Spark adds up those of all tasks by word, so that the most
frequent word is one row of each task. The counts of the ``FREQUENT`` most frequent words, and so of the end, go
to every task, which looks them up in place; any other word makes up less than 1 in ``FREQUENT`` of the
tokens, and its pairs of row and word are joined with the counts by word. So no key is hot, and what
is gathered, a count for every word, grows with the corpus.

The model goes over classes of words: the most frequent words and the end are classes of
their own, all others are classed by their last three bytes. P(word) is P(class | what came
before), from the recurrent network, times (c + 1) / (N + V + 1) within the class, c being the
word's count and N and V the class's training tokens and distinct words. Networks are trained
where the data is, each partition from the same weights on its own training rows, and averaged by
the number of tokens, 16 at a time. The rows are dealt into ``LOTS`` lots by hash, and there is a round of
that over each lot, so that the network learns from every training row once; counts and
classes are of all training rows too. Training carries the state over pieces of ``recurrent.PIECE``
symbols, scoring over whole documents.

Defined results: a null or empty text is just an end; equal texts have equal scores; a row
without an id belongs to the training rows (there is no id to hold it out by); other columns
are not looked at. Words are told apart by 64-bit hashes. The logs of the less frequent words are added up as whole
numbers of 1e-9, so that a score does not depend on the order of addition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import recurrent
from lodestone.llm.arrays import Words, in_small_batches, lower_ascii, slices, text_bytes
from lodestone.operators.durable import durable

#: Classes of words by their last bytes; the most frequent words that are classes of their own; members of an output group.
TAIL_CLASSES, HEAD_WORDS, MEMBERS = 191, 320, 23
HIDDEN = 16
#: Words whose counts are sent to every task (16 bytes each).
FREQUENT = 1 << 15
#: Lots that the training rows are dealt into, with a round of network training over each.
LOTS = 3
#: Networks that one task averages.
AVERAGED = 16
#: Tokens that a worker counts at once, and classes that it learns from and scores at once.
COUNT_TOKENS, LEARN_TOKENS, SCORE_TOKENS = 1_500_000, 1_000_000, 5_000_000
#: The hash that stands for the end of a document.
END = np.uint64(0x1D8E4E27C47D124F)
#: Parts of one in which logs are added up.
SCALE = 1e9


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each slice the hashes and tail classes of its tokens, and the index of each row's first; each row ends with ``END``."""
    for batch in batches:
        for part in slices(batch, "text"):
            raw, at = text_bytes(part.column("text"))
            raw = lower_ascii(raw)
            words = Words(raw, at)
            last = np.zeros(len(words), np.int64)
            for k in range(1, 4):
                place = words.end - k
                last = last * 257 + np.where(place >= words.start, raw[np.maximum(place, 0)].astype(np.int64) + 1, 0)
            tails = (last * 0x9E3779B1 % 4294967291 % TAIL_CLASSES).astype(np.uint8)
            ends = words.first[1:]
            yield part, np.insert(words.hashes(), ends, END), np.insert(tails, ends, 0), words.first + np.arange(len(words.first))


def _counted(rows: DataFrame) -> DataFrame:
    """(word, cls, n): the number of each token of the texts; the end's class is -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add_up(held: list) -> pa.RecordBatch:
            hashes, tails = (np.concatenate(x) for x in zip(*held, strict=True))
            word, first, n = np.unique(hashes, return_index=True, return_counts=True)
            cls = np.where(word == END, -1, tails[first].astype(np.int32)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(cls), pa.array(n.astype(np.int64))], ["word", "cls", "n"])

        held, total = [], 0
        for _, hashes, tails, _ in _tokens(batches):
            held.append((hashes, tails))
            total += len(hashes)
            if total > COUNT_TOKENS:
                yield add_up(held)
                held, total = [], 0
        if held:
            yield add_up(held)

    return rows.mapInArrow(run, "word long, cls int, n long").groupBy("word").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))


class Frequent:
    """The counts and symbols of the most frequent words, ascending by word."""

    def __init__(self, word: np.ndarray, n: np.ndarray, symbol: np.ndarray) -> None:
        order = np.argsort(word)
        self.word, self.symbol = word[order], symbol[order].astype(np.int16)
        self.logs = np.log10(n[order] + 1.0)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        if not len(self.word):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.word, hashes), len(self.word) - 1)
        return np.where(self.word[at] == hashes, at, -1)


class Classes:
    """Symbols of the network: the end, the head words, then the tail classes. ``tail`` has rows of cls, n and v, over
    all words of a tail class."""

    def __init__(self, word: np.ndarray, cls: np.ndarray, n: np.ndarray, tail: list) -> None:
        order = np.argsort(word)
        self.words, own = word[order], 1 + np.arange(len(word))
        size = 1 + len(word) + TAIL_CLASSES
        self.n, self.v = np.zeros(size), np.zeros(size)
        for r in tail:
            at = 0 if r.cls < 0 else 1 + len(word) + r.cls
            self.n[at], self.v[at] = r.n, r.v
        self.n[own], self.v[own] = n[order], 1
        for lost, by in ((self.n, n[order]), (self.v, np.ones(len(word)))):
            np.subtract.at(lost, 1 + len(word) + cls[order], by)
        self.tokens, self.distinct = int(self.n.sum()), int(self.v.sum())
        self.within = np.log10(self.n + self.v + 1)

    def symbol(self, word: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The symbols of words (signed hashes) of tail classes; class -1 is the end."""
        out = np.where(cls < 0, 0, 1 + len(self.words) + cls)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
            out = np.where(self.words[at] == word, 1 + at, out)
        return out


def _symbols(hashes: np.ndarray, tails: np.ndarray, frequent: Frequent, heads: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of tokens, and their places among the frequent words."""
    place = frequent.places(hashes)
    rare = (1 + heads + tails.astype(np.int16)).astype(np.int16)
    symbol = np.where(place >= 0, frequent.symbol[place], rare) if len(frequent.word) else rare
    symbol[hashes == END] = 0
    return symbol, place


def _write(w: recurrent.Weights) -> bytes:
    return b"".join(w[k].astype(np.float32).tobytes() for k in sorted(w))


def _read(raw: bytes, like: recurrent.Weights) -> recurrent.Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = np.frombuffer(raw, np.float32, like[k].size, at).reshape(like[k].shape)
        at += out[k].nbytes
    return out


def _trained(rows: DataFrame, frequent: Frequent, heads: int, weights: recurrent.Weights) -> recurrent.Weights:
    """The average of what every partition makes of ``weights``."""
    many = AVERAGED

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, n, held, total = weights, 0, [], 0
        for _, hashes, tails, first in _tokens(batches):
            symbols = _symbols(hashes, tails, frequent, heads)[0]
            held += np.split(symbols, first[1:-1])
            total += len(symbols)
            if total > LEARN_TOKENS:
                w, more = recurrent.train(w, held, 0)
                n, held, total = n + more, [], 0
        w, more = recurrent.train(w, held, 0)
        n += more
        task = TaskContext.get()
        yield pa.RecordBatch.from_arrays([pa.array([task.partitionId() if task else 0] if n else [], pa.int32()), pa.array([n] if n else [], pa.int64()), pa.array([_write(w)] if n else [], pa.binary())], ["task", "n", "w"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums, task = 0, None, 0
        rows = sorted((t, n, w) for batch in batches for t, n, w in zip(*(batch.column(c).to_pylist() for c in ("task", "n", "w")), strict=True))
        for task, n, raw in rows:  # in one order, whatever order they came in
            w = np.frombuffer(raw, np.float32).astype(np.float64) * n
            total, sums = total + n, w if sums is None else sums + w
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array([task // many], pa.int32()), pa.array([total], pa.int64()), pa.array([(sums / total).astype(np.float32).tobytes()], pa.binary())], ["task", "n", "w"])

    kind = "task int, n long, w binary"
    found = rows.mapInArrow(learn, kind)
    # a tree of averages, so that no task and not the driver has many
    tasks = rows.rdd.getNumPartitions()
    while tasks > many:
        tasks = -(-tasks // many)
        found = found.repartitionById(tasks, F.floor(F.col("task") / many).cast("int")).mapInArrow(average, kind)
    found = found.toArrow()
    if not found.num_rows:
        return weights
    batch = next(average(iter(found.combine_chunks().to_batches())))
    return _read(batch.column("w")[0].as_py(), weights)


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", share: int = LOTS, hidden: int = HIDDEN, frequent: int = FREQUENT) -> DataFrame:
    """For each row its id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score``, both log10. Rows for which ``held_out`` is true are not learnt from; the others are dealt into ``share`` lots."""
    rows = in_small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = durable(_counted(rows.where(~F.col("held_out")).select("text")))
    # the most frequent words, and a row for each tail class: neither grows with the corpus
    top = counts.orderBy(F.desc("n"), "word").limit(frequent).toArrow()
    word, cls, n = (top.column(c).to_numpy() for c in ("word", "cls", "n"))
    tail = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).orderBy("cls").collect()
    own = np.flatnonzero(cls >= 0)[:HEAD_WORDS]
    classes = Classes(word[own], cls[own], n[own], tail)
    known = Frequent(word.view(np.uint64), n, classes.symbol(word, cls))
    heads, within = len(classes.words), classes.within
    weights = recurrent.initial(classes.n, hidden, MEMBERS)
    lot = F.pmod(F.xxhash64("text", F.lit("share")), F.lit(share))
    for k in range(share):
        weights = _trained(rows.where(~F.col("held_out") & (lot == k)).select("text"), known, heads, weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId() << 40, 0

        def looked_up(hashes: np.ndarray, place: np.ndarray, at: np.ndarray) -> tuple:
            """By row: the logs and the number of its frequent words, its other words, and how often it has each."""
            there, n = place >= 0, len(at) - 1
            row = np.repeat(np.arange(n), np.diff(at))
            logs = np.bincount(row[there], known.logs[place[there]], n)
            n_known = np.bincount(row[there], minlength=n)
            row, word = row[~there], hashes[~there].view(np.int64)
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (word[1:] != word[:-1]))) if len(row) else np.zeros(0, np.int64)
            cut = pa.array(np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32))
            often = np.diff(np.append(first, len(row))).astype(np.int32)
            return pa.array(n_known), pa.array(logs), pa.ListArray.from_arrays(cut, pa.array(word[first])), pa.ListArray.from_arrays(cut, pa.array(often))

        def give(held: list) -> pa.RecordBatch:
            documents = [d for *_, symbols, at, _ in held for d in np.split(symbols, at[1:-1])]
            likely = recurrent.log_likelihoods(weights, documents, 0) / math.log(10)
            likely -= [within[d].sum() for d in documents]
            ids, out = (pa.concat_arrays([part.column(c) for part, *_ in held]) for c in ("id", "held_out"))
            sums = [pa.concat_arrays([found[k] for *_, found in held]) for k in range(4)]
            return pa.RecordBatch.from_arrays([ids, out, pa.array(np.arange(task + number, task + number + len(ids))), pa.array([len(d) for d in documents], pa.int64()), pa.array(likely), *sums], names)

        held, total = [], 0
        for part, hashes, tails, first in _tokens(batches):
            symbols, place = _symbols(hashes, tails, known, heads)
            held.append((part.select(["id", "held_out"]), symbols, first, looked_up(hashes, place, first)))
            total += len(hashes)
            if total > SCORE_TOKENS:
                yield give(held)
                number += sum(part.num_rows for part, *_ in held)
                held, total = [], 0
        if held:
            yield give(held)

    names = ["id", "held_out", "row", "n_tokens", "likely", "n_known", "logs", "rare", "often"]
    kind = rows.schema["id"].dataType.simpleString()
    scored = durable(rows.mapInArrow(score, f"id {kind}, held_out boolean, row long, n_tokens long, likely double, n_known long, logs double, rare array<long>, often array<int>"))
    pairs = scored.select("row", F.explode(F.arrays_zip("rare", "often")).alias("p")).select("row", F.col("p.rare").alias("word"), F.col("p.often").alias("often"))
    part = F.round(F.log10(F.col("n") + 1) * SCALE).cast("long") * F.col("often")
    rest = pairs.join(counts.select("word", "n"), "word").groupBy("row").agg(F.sum(part).alias("more"), F.sum("often").alias("found"))
    out = scored.drop("rare", "often").join(rest, "row", "left")
    lost = math.log10(classes.tokens + classes.distinct + 1)
    logs = F.col("logs") + F.coalesce(F.col("more") / SCALE, F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(classes.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * lost).alias("base_score"), (logs + F.col("likely")).alias("score"),
    )
