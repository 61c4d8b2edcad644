"""Toxicity: cumulative-link ordinal regression over sparse text features.

Features of a text are its words, lower-cased A-Z, and the first four, five and six bytes of
each; a feature's value is log(1 + its count). Of all features of the training rows those are kept
that tell toxic from other rows best (likelihood ratio of document counts). Rows have
grades: 0 if not toxic, else 1 to ``GRADES`` by how many tokens they have that are found in
toxic rows almost alone, cut where the training rows' counts fall into equal parts.

The model is logit P(grade > k) = w . x - t_k with one w for all k and ascending t_k.
Its result is the expected grade, the sum of P(grade > k).

Defined results: a null or empty text has no features and gets what the thresholds alone say;
rows without a label are not learnt from; of several labels of one id the highest counts, and of several texts the least; with no
toxic training row every severity is 0. Columns of the input other than the id and the
text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import Words, in_small_batches, lower_ascii, mix64, slices, text_bytes
from lodestone.llm.quality_classifier import labelled_texts

#: Labelled rows that are learnt from: those with the least hashes of their ids.
TRAIN_ROWS = 20_000
#: Features that the model knows, and grades above 0.
KEPT, GRADES = 4096, 3
#: Likelihood ratio that a feature must have: chance gives it to one in some hundred thousand.
GAIN = 20.0

_GAPS = np.ones(256, bool)
_GAPS[48:58] = _GAPS[97:123] = _GAPS[128:] = False


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The feature hashes of all texts, one for each word and kind, and their texts' row numbers."""
    low = lower_ascii(raw)
    words = Words(low, at, _GAPS)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(words.first))
    size = words.end - words.start
    found, owner = [words.hashes()], [rows]
    lead = np.zeros(len(words), np.uint64)
    for k in range(6):
        lead |= np.where(size > k, low[np.minimum(words.start + k, len(low) - 1)].astype(np.uint64), np.uint64(0)) << np.uint64(8 * k)
        if k >= 3:
            long = size > k
            found.append(mix64(lead[long] + (np.uint64(k) << np.uint64(56))))
            owner.append(rows[long])
    return np.concatenate(found), np.concatenate(owner)


@dataclass
class OrdinalModel:
    names: np.ndarray  # ascending hashes of the features
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[(self.names & np.uint64(self.maybe.size - 1)).astype(np.int64)] = True

    def counts(self, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the known features: row, feature and count."""
        some = self.maybe[(hashes & np.uint64(self.maybe.size - 1)).astype(np.int64)]
        hashes, rows = hashes[some], rows[some]
        if not len(self.names):
            return rows[:0], rows[:0], rows[:0]
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        hit = self.names[at] == hashes
        cell, count = np.unique(rows[hit] * len(self.names) + at[hit], return_counts=True)
        return cell // len(self.names), cell % len(self.names), count

    def above(self, linear: np.ndarray) -> np.ndarray:
        """P(grade > k), a column for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - linear[:, None], -50, 50)))

    def linear(self, hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        row, feature, count = self.counts(hashes, rows)
        return np.bincount(row, self.weights[feature] * np.log1p(count), n)


def fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, grade: np.ndarray, size: int, grades: int = GRADES, steps: int = 1500, rate: float = 0.05, ridge: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the mean likelihood of the grades less a ridge, by Adam.
    Thresholds are a first one and positive gaps, so that they stay in order."""
    n = len(grade)
    share = np.clip([(grade > k).mean() for k in range(grades)], 1e-3, 1 - 1e-3)
    start = -np.log(share / (1 - share))
    p = np.concatenate([np.zeros(size), start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    first, second = np.zeros_like(p), np.zeros_like(p)
    inner = np.arange(n)
    for t in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([p[size : size + 1], np.exp(p[size + 1 :])]))
        linear = np.bincount(row, p[feature] * value, n)
        above = 1 / (1 + np.exp(np.clip(cuts - linear[:, None], -50, 50)))
        edge = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], 1)
        slope = edge * (1 - edge)
        chance = np.maximum(edge[inner, grade] - edge[inner, grade + 1], 1e-12)
        d_linear = (slope[inner, grade] - slope[inner, grade + 1]) / chance / n
        d_cut = np.zeros((n, grades + 2))
        d_cut[inner, grade] -= slope[inner, grade] / chance / n
        d_cut[inner, grade + 1] += slope[inner, grade + 1] / chance / n
        d_cut = d_cut.sum(0)[1:-1]
        tail = np.cumsum(d_cut[::-1])[::-1]
        up = np.concatenate([np.bincount(feature, d_linear[row] * value, size) - ridge * p[:size], tail[:1], tail[1:] * np.exp(p[size + 1 :])])
        first, second = 0.9 * first + 0.1 * up, 0.999 * second + 0.001 * up**2
        p = p + rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
    return p[:size], np.cumsum(np.concatenate([p[size : size + 1], np.exp(p[size + 1 :])]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, kept: int = KEPT) -> OrdinalModel:
    """Learns from at most ``rows`` labelled texts; ``learn`` is the condition on the id column that a
    row of ``labels`` must meet."""
    texts = labelled_texts(docs, labels, learn, F.max(label_col).cast("int"), id_col, text_col, rows)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, owner = features(*text_bytes(part.column("text")))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])) if len(hashes) else np.zeros(0, bool)
                y = part.column("y").to_numpy()
                # counts of this slice's rows by feature, so that less is shuffled
                name, inverse = np.unique(hashes[new], return_inverse=True)
                toxic = np.bincount(inverse, y[owner[new]] > 0, len(name)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(toxic), pa.array(np.bincount(inverse, minlength=len(name)) - toxic)], ["feature", "toxic", "other"])

    both = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum((F.col("y") > 0).cast("long")), F.lit(0)).alias("toxic")).first()
    a_all, b_all = both.toxic, both.n - both.toxic
    if not a_all:
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 50.0))
    counts = texts.mapInArrow(distinct, "feature long, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).where("a + b >= 3")
    a, b = F.col("a"), F.col("b")
    total = a_all + max(b_all, 0)
    part = lambda got, share: F.when(got > 0, got * F.log(got / ((a + b) * share))).otherwise(0.0)
    gain = 2 * (part(a, a_all / total) + part(b, max(b_all, 1e-9) / total))
    best = counts.withColumn("gain", gain).where(F.col("gain") >= GAIN).orderBy(F.desc("gain"), "feature").limit(kept).toArrow()
    name = best.column("feature").to_numpy().view(np.uint64)
    order = np.argsort(name)
    if not len(name):
        return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES, 50.0))
    name, a, b = name[order], best.column("a").to_numpy()[order], best.column("b").to_numpy()[order]
    model = OrdinalModel(name, np.zeros(len(name)), np.zeros(GRADES))

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, feature, count = model.counts(*features(*text_bytes(part.column("text"))))
                cut = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
                as_lists = lambda x: pa.ListArray.from_arrays(pa.array(cut), pa.array(x, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("y"), as_lists(feature), as_lists(count)], ["y", "feature", "count"])

    held = texts.mapInArrow(known, "y int, feature array<int>, count array<int>").toArrow().to_pydict()
    data = sorted(zip(held["y"], held["feature"], held["count"], strict=True))  # the same model whatever order the rows come in
    row = np.repeat(np.arange(len(data)), [len(f) for _, f, _ in data])
    feature = np.array([k for _, f, _ in data for k in f], np.int64)
    count = np.array([c for _, _, n in data for c in n], np.float64)
    toxic = np.array([y > 0 for y, _, _ in data])
    alone = (a >= 3) & (a >= 0.95 * (a + b))
    hits = np.bincount(row, count * alone[feature], len(data))
    cuts = np.quantile(hits[toxic], np.arange(1, GRADES) / GRADES)
    grade = np.where(toxic, 1 + np.searchsorted(cuts, hits, "left"), 0)
    model.weights, model.thresholds = fit_ordinal(row, feature, np.log1p(count), grade, len(name))
    return model


def severities(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.35) -> DataFrame:
    """For each row its id, ``severity`` (the expected grade), ``grade`` (the likeliest, above 0 if
    toxic), ``score`` (P(grade > 0)) and ``toxic`` (score of at least ``threshold``: to miss a toxic text
    is held to be worse than to look at one in vain). No shuffle."""
    rows = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                above = model.above(model.linear(*features(*text_bytes(part.column("text"))), part.num_rows))
                edge = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
                grade = np.maximum((edge[:, :-1] - edge[:, 1:]).argmax(1), above[:, 0] >= threshold).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(above.sum(1)), pa.array(grade), pa.array(above[:, 0].copy()), pa.array(above[:, 0] >= threshold)], ["id", "severity", "grade", "score", "toxic"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, severity double, grade int, score double, toxic boolean").withColumnRenamed("id", id_col)
