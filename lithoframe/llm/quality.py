"""Quality scores by a factorisation machine.

A text's features are its words, hashed into 2**14 cells and weighted by how often
they occur, and statistics of its structure (character classes, lengths,
repetition) and of its metadata (the recorded number of characters), each cut into
bins at the sample's quantiles. The score is the logistic function of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2)

in which the last term holds all pairwise interactions of rank ``RANK``, in time
linear in the features.

The model is fitted on at most ``max_rows`` labelled rows, those of least hash of
their id; everything else covers all rows. Word features come from whole texts.

A null text is empty; empty texts get the score that their statistics give. A null
or missing count of characters is a bin of its own. Labels that are null or
neither 0 nor 1 are left out, of several labels of an id the least counts. Without
any label the score is 0.5. Input columns that clash with the output's are
replaced. Repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import without
from .vectext import NON_SPACE, byte_class, slices, with_columns, words

CELLS, RANK, BINS = 1 << 14, 8, 10
#: Most labelled rows that the model is fitted on.
MAX_ROWS = 6000

_KIND = np.full(256, 5, dtype=np.int64)  # other marks
for _k, _bytes in enumerate((b" \t\n\x0b\x0c\r", bytes(range(97, 123)) + bytes(range(128, 256)), bytes(range(65, 91)), b"0123456789", b".,;:'\"?!()-")):
    _KIND[byte_class(_bytes)] = _k
_KINDS = 6
STATS = ("log_bytes", "upper", "digits", "punctuation", "marks", "space", "word_length", "distinct", "repeats", "long_words", "marked_words", "lines", "n_chars")


def features(raw: np.ndarray, at: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells and counts of all rows' words, row after row; each row's number of cells; a row of STATS for each text."""
    rows = len(at) - 1
    h, first = words(raw, at, NON_SPACE)
    n_words = np.diff(first)
    owner = np.repeat(np.arange(rows, dtype=np.int64), n_words)
    cell, count = np.unique(owner * CELLS + (h >> np.uint64(50)).astype(np.int64), return_counts=True)
    per_row = np.bincount(cell // CELLS, minlength=rows)
    size = np.diff(at)
    line = np.repeat(np.arange(rows, dtype=np.int64), size)
    kinds = np.bincount(line * _KINDS + _KIND[raw], minlength=rows * _KINDS).reshape(rows, _KINDS)
    lines = np.bincount(line[raw == 10], minlength=rows)
    again = np.zeros(rows)
    if len(h) > 1:
        same = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
        again = np.bincount(owner[1:][same], minlength=rows)
    mask = NON_SPACE[raw]
    last = np.flatnonzero(mask & ~np.append(mask[1:], False)) if len(raw) else np.zeros(0, np.int64)
    marked = np.bincount(line[last[_KIND[raw[last]] == 5]], minlength=rows) if len(last) else np.zeros(rows)
    some, some_words = np.maximum(size, 1), np.maximum(n_words, 1)
    length = (size - kinds[:, 0]) / some_words
    stats = np.stack([
        np.log1p(size), kinds[:, 2] / some, kinds[:, 3] / some, kinds[:, 4] / some, kinds[:, 5] / some, kinds[:, 0] / some,
        length, per_row / some_words, again / some_words, length > 12, marked / some_words, lines / some_words, np.log1p(np.where(n_chars >= 0, n_chars, np.nan)),
    ], axis=1)
    return cell % CELLS, count, per_row, stats


@dataclass
class Machine:
    """w0, the weights of cells and bins, their vectors, and the bins' edges."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    edges: np.ndarray

    def inputs(self, cell: np.ndarray, count: np.ndarray, per_row: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, value, row start) of all features: a row's bins, then its words, each part of length 1."""
        rows, k = stats.shape
        bins = np.stack([np.where(np.isnan(stats[:, j]), BINS, np.searchsorted(self.edges[j], stats[:, j], side="right")) for j in range(k)], axis=1) if rows else np.zeros((0, k), np.int64)
        bins = CELLS + np.arange(k) * (BINS + 1) + bins
        x = np.log1p(count)
        owner = np.repeat(np.arange(rows), per_row)
        norm = np.sqrt(np.bincount(owner, weights=x * x, minlength=rows))
        first = np.concatenate([[0], np.cumsum(per_row + k)])
        index, value = np.empty(first[-1], dtype=np.int64), np.empty(first[-1], dtype=np.float32)
        place = np.arange(len(cell)) + (owner + 1) * k
        index[place], value[place] = cell, x / norm[owner]
        place = (first[:-1, None] + np.arange(k)).ravel()
        index[place], value[place] = bins.ravel(), 1 / np.sqrt(k)
        return index, value, first[:-1]

    def raw_scores(self, index: np.ndarray, value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not len(first):
            return np.zeros(0), np.zeros((0, RANK)), np.zeros((0, RANK))
        vx = self.v[index] * value[:, None]
        s = np.add.reduceat(vx, first, axis=0)
        q = np.add.reduceat(vx * vx, first, axis=0)
        return self.w0 + np.add.reduceat(self.w[index] * value, first) + 0.5 * (s * s - q).sum(axis=1), s, vx

    def scores(self, *of: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw_scores(*self.inputs(*of))[0].astype(np.float64), -30, 30)))


def fit(rows: pa.Table, steps: int = 560, rate: float = 0.02, decay: float = 1e-4) -> Machine:
    """At least ``steps`` steps of Adam on the logistic loss over shuffled batches; rows hold cell, count, stats and label."""
    rng = np.random.default_rng(3)
    size = CELLS + len(STATS) * (BINS + 1)
    stats = np.array(rows["stats"].to_pylist(), dtype=np.float64).reshape(-1, len(STATS))
    edges = np.quantile(np.nan_to_num(stats), np.arange(1, BINS) / BINS, axis=0).T if len(stats) else np.zeros((len(STATS), BINS - 1))
    m = Machine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, RANK)).astype(np.float32), edges)
    y = np.array(rows["label"].to_pylist(), dtype=np.float64)
    if not len(y) or y.min() == y.max():
        m.v[:] = 0
        m.w0 = 0.0 if not len(y) else 4.0 * (2 * y[0] - 1)
        return m
    m.w0 = float(np.log(y.mean() / (1 - y.mean())))
    cells, counts = ([x.values.to_numpy().astype(np.int64) for x in rows[c]] for c in ("cell", "count"))
    per = np.array([len(c) for c in cells])
    state = {k: (np.zeros_like(p), np.zeros_like(p)) for k, p in (("w", m.w), ("v", m.v))}
    b0, t = [0.0, 0.0], 0
    for _ in range(-(-steps * 128 // len(y))):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 128):
            own = order[lo : lo + 128]
            index, value, first = m.inputs(np.concatenate([cells[k] for k in own]), np.concatenate([counts[k] for k in own]), per[own], stats[own])
            raw, s, vx = m.raw_scores(index, value, first)
            slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[own]) / len(own)
            n = np.diff(np.append(first, len(index)))
            g = np.repeat(slope, n).astype(np.float32) * value
            t += 1
            for name, p, grad in (("w", m.w, np.bincount(index, weights=g, minlength=size)), ("v", m.v, np.stack([np.bincount(index, weights=g * (np.repeat(s[:, f], n) - vx[:, f]), minlength=size) for f in range(RANK)], axis=1))):
                grad = grad.astype(np.float32) + decay * p
                a, b = state[name]
                a += 0.1 * (grad - a)
                b += 0.001 * (grad * grad - b)
                p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            b0 = [b0[0] + 0.1 * (slope.sum() - b0[0]), b0[1] + 0.001 * (slope.sum() ** 2 - b0[1])]
            m.w0 -= rate * (b0[0] / (1 - 0.9**t)) / (np.sqrt(b0[1] / (1 - 0.999**t)) + 1e-8)
    return m


def held_out(id_col: str) -> Column:
    """Rows that no label is learnt from; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str | None = "n_chars", label_col: str = "quality", max_rows: int = MAX_ROWS) -> Machine:
    """A model of ``label_col``, from at most ``max_rows`` labelled documents that aren't held out."""
    chosen = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out("id"))
    chosen = chosen.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    own = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), _n_chars(docs, n_chars_col).alias("n_chars"))
    own = own.join(F.broadcast(chosen), "id").select("text", "n_chars", "label", F.xxhash64("id", "text").alias("place"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.array(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.float64)
            for lo, hi, raw, at in slices(batch.column(0)):
                cell, count, per, stats = features(raw, at, numbers[lo:hi])
                cuts = np.cumsum(per)[:-1]
                yield pa.RecordBatch.from_arrays([
                    batch.column(3).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                    pa.array([x.astype(np.int32) for x in np.split(cell, cuts)], pa.list_(pa.int32())), pa.array([x.astype(np.int32) for x in np.split(count, cuts)], pa.list_(pa.int32())),
                    pa.array(list(stats), pa.list_(pa.float64())),
                ], names=["place", "label", "cell", "count", "stats"])

    rows = own.mapInArrow(run, "place bigint, label int, cell array<int>, count array<int>, stats array<double>").dropDuplicates(["place"]).orderBy("place")
    return fit(rows.toArrow())


def _n_chars(docs: DataFrame, name: str | None) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(-1.0)) if name and name in docs.columns else F.lit(-1.0)


def quality_scores(docs: DataFrame, machine: Machine, *, text_col: str = "text", n_chars_col: str | None = "n_chars", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns if None) plus score: the chance that a document's label is 1."""
    carry = [c for c in (docs.columns if carry is None else carry) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.array(batch.column(len(carry) + 1).to_numpy(zero_copy_only=False), dtype=np.float64)
            out = [shared.value.scores(*features(raw, at, numbers[lo:hi])) for lo, hi, raw, at in slices(batch.column(len(carry)))]
            yield with_columns(batch, carry, {"score": pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())})

    schema = T.StructType([*without(docs.select(*carry).schema, ("score",)).fields, T.StructField("score", T.DoubleType())])
    return docs.select(*carry, F.col(text_col).cast("string").alias("__text"), _n_chars(docs, n_chars_col).alias("__n_chars")).mapInArrow(run, schema)
