"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins. Boosting goes round the features again and
again, and each time fits a shallow tree to what the others leave over; its leaves
are added to that feature's lookup table. Then the pairs that promise most get
two-dimensional tables in the same way. A score is the sum of a text's table entries,
so every feature's part in it can be read off.

Defined results: a null or empty text has all features zero and gets a score like any
other; rows without a label, or whose label is null, are not learnt from; of several
labels of one id the lowest counts, and of several texts the least; with no labels of both kinds the score is the
prior. Columns of the input are kept; those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrays import Words, in_small_batches, slices, text_bytes, window_hashes
from lodestone.operators.durable import durable

#: Labelled rows that are learnt from: those with the least hashes of their ids.
TRAIN_ROWS = 20_000

#: Symbols that count as such (fixed value).
SYMBOLS = b"#*$%&|<>"
FEATURES = ("log_words", "word_bytes", "upper", "symbols", "bars", "shouts", "stops", "digits", "wide", "lines", "distinct", "echo", "repeats", "same_lines", "shortest_run")

_KINDS = np.zeros((9, 256), bool)
_KINDS[0, 65:91] = True
_KINDS[1, 97:123] = True
_KINDS[2, list(SYMBOLS)] = True
_KINDS[3, ord("|")] = True
_KINDS[4, ord("!")] = True
_KINDS[5, list(b".,;:?")] = True
_KINDS[6, 48:58] = True
_KINDS[7, 192:] = True  # the first byte of a character outside ASCII
_KINDS[8, 10] = True
_CODES = (_KINDS * (1 << np.arange(9))[:, None]).sum(0).astype(np.uint16)
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def _repeated(values: np.ndarray) -> float:
    """The share of values that are found twice or more."""
    if len(values) < 2:
        return 0.0
    own = np.sort(values)
    twice = own[1:] == own[:-1]
    return float((np.append(twice, False) | np.append(False, twice)).mean())


def text_features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text."""
    codes = _CODES[raw]
    upper, lower, symbols, bars, shouts, stops, digits, wide, lines = (_sums((codes >> k) & 1, at) for k in range(9))
    words = Words(raw, at)
    hashes = words.hashes()
    n = np.diff(words.first)
    some = np.maximum(n, 1)
    long = _sums_of(words.end - words.start, words.first)
    out = np.zeros((len(n), len(FEATURES)))
    for k, x in enumerate((np.log1p(n), long / some, upper / np.maximum(upper + lower, 1), symbols / some, bars / some, shouts / some, stops / some, digits / some, wide / some, lines / some)):
        out[:, k] = x
    rows = Words(raw, at, _LINE)
    line_hashes = rows.hashes()
    for d, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True)):
        if b > a:
            own = hashes[a:b]
            out[d, 10] = len(np.unique(own)) / len(own)
            out[d, 11] = float((own[1:] == own[:-1]).mean()) if len(own) > 1 else 0.0
            out[d, 12] = _repeated(window_hashes(own, 3))
            out[d, 13] = _repeated(line_hashes[rows.first[d] : rows.first[d + 1]])
            out[d, 14] = np.log1p(len(own) / max(1, rows.first[d + 1] - rows.first[d]))
    return out


def _sums_of(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


@dataclass
class AdditiveModel:
    """``base`` plus, for each feature, ``tables[k][bin]``, plus, for each of ``pairs``, its ``grids[k][bin, bin]``."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    grids: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)], 1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for (i, j), g in zip(self.pairs, self.grids, strict=True):
            total += g[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g / (h + ridge)


def _stump(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> tuple[int, float]:
    """The cut of bins (left is < cut) that gains most, and its gain; 0 if none does."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    gain[(hl < least) | (hr < least)] = 0
    if not len(gain) or gain.max() <= 1e-12:
        return 0, 0.0
    return int(gain.argmax()) + 1, float(gain.max())


def _tree(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """A table of bins from a tree of two levels over one feature."""
    out = np.full(len(g), _leaf(g.sum(), h.sum(), ridge))
    cut, _ = _stump(g, h, ridge, least)
    for part in (slice(0, cut), slice(cut, len(g))) if cut else ():
        inner, _ = _stump(g[part], h[part], ridge, least)
        at = part.start + inner
        for piece in (slice(part.start, at), slice(at, part.stop)) if inner else (part,):
            out[piece] = _leaf(g[piece].sum(), h[piece].sum(), ridge)
    return out


def _tree2(g: np.ndarray, h: np.ndarray, ridge: float, least: float) -> np.ndarray:
    """A grid from a tree that cuts the first feature and each side by the second."""
    out = np.full(g.shape, _leaf(g.sum(), h.sum(), ridge))
    best, cut = 0.0, 0
    for at in range(1, len(g)):
        gain = sum(_stump(g[s].sum(0), h[s].sum(0), ridge, least)[1] + g[s].sum() ** 2 / (h[s].sum() + ridge) for s in (slice(0, at), slice(at, None))) - g.sum() ** 2 / (h.sum() + ridge)
        if gain > best:
            best, cut = gain, at
    for s in (slice(0, cut), slice(cut, None)) if cut else ():
        gs, hs = g[s].sum(0), h[s].sum(0)
        inner, _ = _stump(gs, hs, ridge, least)
        for t in (slice(0, inner), slice(inner, None)) if inner else (slice(None),):
            out[s, t] = _leaf(gs[t].sum(), hs[t].sum(), ridge)
    return out


def fit_additive(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, pair_rounds: int = 40, pairs: int = 5, rate: float = 0.1, ridge: float = 1.0, least: float = 1.0) -> AdditiveModel:
    """Cyclic boosting of the main tables, then of the grids of the pairs that gain most."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(mean / (1 - mean)))
    quantiles = np.linspace(0, 1, bins + 1)[1:-1]
    cuts = [np.unique(np.quantile(x[:, k], quantiles)) if len(x) else np.zeros(0) for k in range(x.shape[1])]
    model = AdditiveModel(base, cuts, [np.zeros(len(c) + 1) for c in cuts])
    if len(np.unique(y)) < 2:
        return model
    b = model.bins(x)
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(b[:, k], g, len(table)), np.bincount(b[:, k], h, len(table)), ridge, least)
            table += step
            total += step[b[:, k]]
    coarse = [b[:, k] * 8 // len(t) for k, t in enumerate(model.tables)]
    g, h = slopes()
    promise = []
    for i in range(len(cuts)):
        for j in range(i + 1, len(cuts)):
            cell = coarse[i] * 8 + coarse[j]
            gs, hs = np.bincount(cell, g, 64), np.bincount(cell, h, 64)
            promise.append((float((gs**2 / (hs + ridge)).sum()), i, j))
    model.pairs = [(i, j) for _, i, j in sorted(promise, reverse=True)[:pairs]]
    model.grids = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), grid in zip(model.pairs, model.grids, strict=True):
            g, h = slopes()
            cell = b[:, i] * grid.shape[1] + b[:, j]
            step = rate * _tree2(np.bincount(cell, g, grid.size).reshape(grid.shape), np.bincount(cell, h, grid.size).reshape(grid.shape), ridge, least)
            grid += step
            total += step[b[:, i], b[:, j]]
    return model


def labelled_texts(docs: DataFrame, labels: DataFrame, learn: Column, label: Column, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(y, text) of the ``rows`` labelled ids of least hashes: one row for each id, however often it is found. ``label`` is the
    aggregate that makes one label of those of an id. The rows are kept, so that the documents are read once for them."""
    chosen = labels.where(learn & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(label.alias("y")).where("y IS NOT NULL")
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(rows)
    texts = in_small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    return durable(texts.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text"))


def fit_quality(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> AdditiveModel:
    """Learns from at most ``rows`` labelled texts; ``learn`` is the condition on the id column
    that a row of ``labels`` must meet."""
    texts = labelled_texts(docs, labels, learn, F.min(label_col).cast("double"), id_col, text_col, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x = text_features(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("y"), *(pa.array(c) for c in x.T)], ["y", *FEATURES])

    table = texts.mapInArrow(run, ", ".join(f"{c} double" for c in ("y", *FEATURES))).toArrow()
    x = np.stack([table.column(c).to_numpy() for c in FEATURES], 1)
    y = table.column("y").to_numpy()
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows come in
    return fit_additive(x[order], (y[order] > 0).astype(float))


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = 0.3, columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or just ``columns`` of it) with ``score``, the probability of label 1, and ``predicted``. No shuffle."""
    kept = [c for c in (columns or docs.columns) if c not in ("score", "predicted")]
    rows = in_small_batches(docs).select(F.col(text_col).alias("_text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                score = model.score(text_features(*text_bytes(part.column("_text"))))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*kept, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructType

    schema = StructType([docs.schema[c] for c in kept]).add("score", DoubleType()).add("predicted", IntegerType())
    return rows.mapInArrow(run, schema)
