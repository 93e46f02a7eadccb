"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its quantile bins, learned by cyclic boosting: round after round, one feature after the
other, a tree of few leaves fits the loss's gradient over the bins, and a small step of it is added to the table. Pairs of
features that explain most of what is left get tables over two features' coarse bins in the same way. A score is a sum of looked-up
values. Fitting takes a bounded sample of labelled rows; scoring is one pass over whole texts, without shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, flat, hashes, slices, spans

#: About so many labelled rows are fitted; rows are taken by a hash of doc_id.
SAMPLE = 20_000
FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "other", "bang", "mark", "bar", "wide", "distinct", "repeated", "title", "short", "log_lines", "line_words", "same_lines", "stop")

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*@^~<>{}[]=+_\\/"]] = True


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text; an empty or null text has zeros."""
    data, starts = flat(column)
    rows = len(starts) - 1
    size = np.diff(starts).astype(float)

    def share(of: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(of)]
        return (total[starts[1:]] - total[starts[:-1]]) / np.maximum(size, 1)

    begin, end, row = spans(data, starts, ~SPACE[data])
    n = np.bincount(row, minlength=rows).astype(float)
    per = np.maximum(n, 1)
    word = hashes(LOWER[data], begin, end) if len(begin) else np.zeros(0, np.uint64)
    mean = lambda x: np.bincount(row, x, rows) / per
    order = np.lexsort((word, row))
    new = np.ones(len(word), bool)
    new[1:] = (word[order][1:] != word[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=rows) / per
    again = np.zeros(len(word))
    again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
    letters = share(_LETTER[data])
    line_begin, line_end, line_row = spans(data, starts, data != 10)
    line = hashes(data, line_begin, line_end)
    lines = np.bincount(line_row, minlength=rows).astype(float)
    by = np.lexsort((line, line_row))
    fresh = np.ones(len(line), bool)
    fresh[1:] = (line[by][1:] != line[by][:-1]) | (line_row[by][1:] != line_row[by][:-1])
    ends = data[end - 1] if len(end) else np.zeros(0, np.uint8)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(n),
            mean((end - begin).astype(float)),
            share(_UPPER[data]) / np.maximum(letters, 1e-9) * (letters > 0),
            share(_DIGIT[data]),
            1 - letters - share(SPACE[data]) - share(_DIGIT[data]),
            share(data == 33),
            share(_MARK[data]),
            share(data == 124),
            share(data >= 128),
            distinct,
            mean(again),
            mean(_UPPER[data[begin]].astype(float)) if len(begin) else np.zeros(rows),
            mean((end - begin <= 3).astype(float)),
            np.log1p(lines),
            n / np.maximum(lines, 1),
            1 - np.bincount(line_row[by][fresh], minlength=rows) / np.maximum(lines, 1),
            mean(np.isin(ends, np.frombuffer(b".!?", np.uint8)).astype(float)),
        ]
    ) * (size > 0)[:, None]


@dataclass
class Model:
    """bias, a table for each feature over its bins, and tables for pairs over coarse bins."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (cuts, own) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += own[np.searchsorted(cuts, x[:, j], side="right")]
        for (a, b), own in zip(self.pairs, self.pair_tables, strict=True):
            z += own[np.searchsorted(self.coarse[a], x[:, a], side="right"), np.searchsorted(self.coarse[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _bins(x: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, most + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, least: float = 2.0) -> np.ndarray:
    """The values of a tree over ordered bins, given the gradients' and curvatures' sums in each bin."""
    parts, values = [(0, len(g))], np.zeros(len(g))
    gain = lambda a, b: a * a / (b + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for k, (lo, hi) in enumerate(parts):
            gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
            gr, hr = g[lo:hi].sum() - gl, h[lo:hi].sum() - hl
            won = np.where((hl >= least / 4) & (hr >= least / 4), gain(gl, hl) + gain(gr, hr) - gain(gl + gr, hl + hr), 0)
            if len(won) and won.max() > best[0]:
                best = (won.max(), (k, lo + 1 + int(won.argmax())))
        if best[1] is None:
            break
        k, at = best[1]
        lo, hi = parts[k]
        parts[k : k + 1] = [(lo, at), (at, hi)]
    for lo, hi in parts:
        values[lo:hi] = g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return values


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, step: float = 0.15, bins: int = 48, coarse: int = 8) -> Model:
    """Fits the model to features x and labels y of 0 and 1. With no rows the score is 1/2, with one label near that label."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate / (1 - rate)))
    width = x.shape[1]
    if not len(y) or y.min() == y.max():
        empty = [np.zeros(0)] * width
        return Model(bias, empty, [np.zeros(1)] * width, empty, [], [])
    cuts = [_bins(x[:, j], bins) for j in range(width)]
    at = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(width):
            g, h = slopes()
            own = step * _tree(np.bincount(at[j], g, len(tables[j])), np.bincount(at[j], h, len(tables[j])))
            tables[j] += own
            z += own[at[j]]
    rough = [_bins(x[:, j], coarse) for j in range(width)]
    cell = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(rough)]
    g, h = slopes()
    won = []
    for a in range(width):
        for b in range(a):
            n = (len(rough[a]) + 1) * (len(rough[b]) + 1)
            k = cell[a] * (len(rough[b]) + 1) + cell[b]
            won.append((float((np.bincount(k, g, n) ** 2 / (np.bincount(k, h, n) + 1)).sum()), a, b))
    chosen = [(a, b) for _, a, b in sorted(won, reverse=True)[:pairs]]
    grids = [np.zeros((len(rough[a]) + 1, len(rough[b]) + 1)) for a, b in chosen]
    for _ in range(pair_rounds):
        for (a, b), grid in zip(chosen, grids, strict=True):
            g, h = slopes()
            k = cell[a] * grid.shape[1] + cell[b]
            gs, hs = (np.bincount(k, v, grid.size).reshape(grid.shape) for v in (g, h))
            # a tree of four leaves: the best cut of one feature, then of the other within each side
            cut = _tree(gs.sum(1), hs.sum(1), 2)
            own = np.zeros(grid.shape)
            for side in np.unique(cut):
                rows = cut == side
                own[rows] = _tree(gs[rows].sum(0), hs[rows].sum(0), 2)
            grid += step * own
            z += step * own[cell[a], cell[b]]
    return Model(bias, cuts, tables, rough, chosen, grids)


def fold(of: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def _extract(batches):
    for batch in slices(batches, "text"):
        x = features(batch.column("text")).astype(np.float32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in x.T)], names=["doc_id", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Fits to about `sample` rows of labels(doc_id, <label>) for which keep, a condition on doc_id, holds, and their texts.

    Rows with null id or label are left out; of equal ids in labels, each counts. Only sampled rows' texts are read into features."""
    rows = labels.filter(keep).filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("_y"))
    n = rows.count()
    share = 1.0 if n <= sample else sample / n
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    kind = dict(docs.dtypes)["doc_id"]
    made = docs.select("doc_id", "text").filter(keep & chosen).mapInArrow(_extract, f"doc_id {kind}, " + ", ".join(f"{f} float" for f in FEATURES))
    got = made.join(rows.filter(chosen), "doc_id").select("_y", *FEATURES).toArrow()
    data = np.column_stack([c.to_numpy() for c in got.columns]).astype(float) if got.num_rows else np.zeros((0, 1 + len(FEATURES)))
    data = data[np.lexsort(data.T)]  # the order of rows must not matter
    return fit(data[:, 1:].astype(np.float32).astype(float), data[:, 0])


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """Adds the model's score of each whole text to docs, a column of that name is replaced. Rows are independent; null is
    as empty text, which has a score too."""
    docs = docs.drop(name)
    columns = docs.columns

    def run(batches):
        for batch in slices(batches, "text"):
            got = model.score(features(batch.column("text")).astype(np.float32).astype(float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, {name} double")
