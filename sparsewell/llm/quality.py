"""Document quality by Naive Bayes support vectors.

Features are indicators of hashed n-grams: runs of one to four bytes of the
text, and runs of one to three word shapes (a shape tells capitals, small
letters, digits and marks of a word apart and says whether the word repeats the
one before).  Each indicator is scaled by its class log-count ratio, rows are
brought to length one, and a linear hinge-loss model is fitted by dual
coordinate descent.  Margins become probabilities by a sigmoid fitted to
margins of rows that the model in question had not seen.

The fit takes a sample of labelled rows that is bounded in rows (``FIT_ROWS``) and
in buckets (``FIT_GRAMS``); scoring reads every whole text.  Labels, lang, source and
doc_id are never inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, bounded_batches, materialize

#: Most labelled rows a model is fitted on.
FIT_ROWS = 8192
#: Most buckets of all these rows together (four bytes each).
FIT_GRAMS = 1 << 25
#: Buckets of hashed n-grams; bounds the size of the model that tasks receive.
BUCKETS = 1 << 18
#: Rows are held out if crc32(doc_id) leaves remainder 0.
FOLDS = 5
#: Least score of predicted class 1.
THRESHOLD = 0.3
SMOOTHING = 1.0
PENALTY = 1.0
EPOCHS = 12

_U = np.uint32
_GRAM_BYTES = 4
_SHAPE_RUN = 3
#: Byte classes of a shape: bit 0 capital, 1 small letter, 2 digit, 3 other mark, 4 beyond ASCII.
_CLASS = np.full(256, 8, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 4, 16
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _hashed(code: np.ndarray, salt: int) -> np.ndarray:
    code = (code ^ _U(salt * 0x9E3779B1 & 0xFFFFFFFF)) * _U(0x85EBCA6B)
    code ^= code >> _U(15)
    return (code * _U(0xC2B2AE35)) >> _U(32 - (BUCKETS.bit_length() - 1))


def gram_buckets(text: str | None) -> np.ndarray:
    """Distinct buckets of a whole text's n-grams (none for a null or empty text)."""
    if not text:
        return np.zeros(0, np.int64)
    data = np.frombuffer(text.encode(), np.uint8)
    code, parts = data.astype(_U), []
    for n in range(1, _GRAM_BYTES + 1):
        if n > 1:
            if len(data) < n:
                break
            code = code[:-1] | (data[n - 1 :].astype(_U) << _U(8 * (n - 1)))
        parts.append(_hashed(code, n))
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts):
        shape = np.bitwise_or.reduceat(_CLASS[data] * ~_SPACE[data], starts).astype(_U)
        flat = np.concatenate(([0], np.cumsum(data, dtype=np.int64)))
        size, total = ends - starts, flat[ends] - flat[starts]
        again = np.zeros(len(starts), bool)
        again[1:] = (size[1:] == size[:-1]) & (total[1:] == total[:-1]) & (data[starts[1:]] == data[starts[:-1]])
        one = shape | (again.astype(_U) << _U(5)) | (np.minimum(size, 3).astype(_U) << _U(6))
        code = one
        for n in range(1, _SHAPE_RUN + 1):
            if n > 1:
                if len(one) < n:
                    break
                code = code[:-1] | (one[n - 1 :] << _U(8 * (n - 1)))
            parts.append(_hashed(code, 16 + n))
    return _distinct(np.concatenate(parts).astype(np.int64))


_stamp = np.zeros(BUCKETS, np.int64)


def _distinct(buckets: np.ndarray) -> np.ndarray:
    """Distinct values: of equal ones only the last write to the stamp array stays."""
    at = np.arange(len(buckets))
    _stamp[buckets] = at
    return buckets[_stamp[buckets] == at]


@dataclass(frozen=True)
class QualityModel:
    """Weights by bucket (log-count ratio times hyperplane), squared ratios for the norm, and the sigmoid."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, buckets: np.ndarray) -> float:
        norm = float(self.squares[buckets].sum())
        return float(self.weights[buckets].sum()) / norm**0.5 + self.bias if norm > 0 else self.bias

    def score(self, text: str | None) -> float:
        """Probability of label 1."""
        z = self.slope * self.margin(gram_buckets(text)) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def _log_count_ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    counts = np.full((2, BUCKETS), SMOOTHING)
    for buckets, label in zip(rows, y, strict=True):
        counts[int(label > 0), buckets] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    return np.log(counts[1] / counts[0])


def _penalties(y: np.ndarray) -> np.ndarray:
    """Weight of each row's loss: the labels weigh as much in all."""
    return PENALTY / (2 * np.where(y > 0, (y > 0).mean(), (y < 0).mean()).clip(1e-9))


def _dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float, np.ndarray]:
    """Hinge-loss hyperplane (weights, bias, dual variables) over unit rows of scaled indicators; rarer labels weigh more."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(BUCKETS), 0.0
    alpha = np.zeros(len(rows))
    # only norms are kept: the scaled rows would take three times the memory of the rows
    norms = np.array([np.sqrt((v * v).sum()) for v in (ratio[r] for r in rows)])
    norms[norms == 0] = 1.0
    most = _penalties(y)
    for _ in range(EPOCHS):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = ratio[r] / norms[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            projected = min(gradient, 0.0) if alpha[i] <= 0 else max(gradient, 0.0) if alpha[i] >= most[i] else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / ((v @ v) + 1), 0.0), most[i])
                step = (new - alpha[i]) * y[i]
                alpha[i] = new
                w[r] += step * v
                bias += step
        if worst < 1e-3:
            break
    return w, bias, alpha


def _sigmoid(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1 | margin) by Newton steps on the smoothed log loss."""
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log((n1 + 1) / (n0 + 1)))
    x = np.stack([margins, np.ones_like(margins)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = x @ (p - target)
        h = (x * (p * (1 - p) + 1e-9)) @ x.T + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-9:
            break
    return float(max(a, 0.0)), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> QualityModel:
    """Model of bucket rows with labels 0/1; without both labels, one that scores every text 0.5 or the one label."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if len(rows) < 4 or (y > 0).all() or (y < 0).all():
        one = float((y > 0).mean()) if len(rows) else 0.5
        shift = float(np.log((one * len(y) + 1) / ((1 - one) * len(y) + 1)))
        return QualityModel(np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32), 0.0, 0.0, shift)

    def plane(idx: np.ndarray) -> QualityModel:
        part = [rows[i] for i in idx]
        ratio = _log_count_ratios(part, y[idx])
        w, bias, _ = _dual_coordinate_descent(part, y[idx], ratio)
        return QualityModel((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), bias, 1.0, 0.0)

    margins = np.zeros(len(rows))
    order = np.argsort(y, kind="stable")
    for fold in range(2):  # both halves hold both labels
        inside, outside = order[fold::2], order[1 - fold :: 2]
        m = plane(inside)
        for i in outside:
            margins[i] = m.margin(rows[i])
    slope, shift = _sigmoid(margins, y)
    m = plane(np.arange(len(rows)))
    return QualityModel(m.weights, m.squares, m.bias, slope, shift)


def held_out(doc_id: str = "doc_id"):
    """Whether a row's label is kept for evaluation (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int, fit_grams: int) -> DataFrame:
    """At most ``fit_rows`` labelled rows (doc_id, label, grams, n) with ``fit_grams`` buckets in all, by the hash of doc_id."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(fit_rows)
    )
    # at most fit_rows pairs of numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = [gram_buckets(t).astype("<u4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1).cast(pa.int32()), pa.array(grams, pa.binary()), pa.array([len(g) // 4 for g in grams], pa.int64())], names=["doc_id", "label", "grams", "n"])

    sample = materialize(rows.mapInArrow(run, "doc_id long, label int, grams binary, n long"), "quality-sample")
    # a window over at most fit_rows pairs of numbers
    upto = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    within = sample.select("doc_id", "n").select("doc_id", upto.alias("upto")).where(F.col("upto") <= fit_grams).select("doc_id")
    return sample.join(F.broadcast(within), "doc_id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, fit_grams: int = FIT_GRAMS) -> QualityModel:
    """Fit a model on at most ``fit_rows`` labelled rows that are not held out.

    Both bounds of the sample, rows and buckets, are those of the module: the
    sample is the rows with the smallest hashes of doc_id, up to the first that
    would exceed ``fit_grams`` buckets in all.  The fit is one task over it;
    only the model reaches the driver.  Rows without a quality label of 0 or 1, or
    without an id, are left out; of several labels of one doc_id the smallest
    counts, and so does the smallest of several texts.
    """
    bounded_batches(docs.sparkSession)
    sample = _sample(docs, labels, fit_rows, fit_grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, rows = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
            rows += [np.frombuffer(g, "<u4") for g in b.column(2).to_pylist()]
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        m = fit([rows[i] for i in order], np.array(y)[order] if y else np.zeros(0))
        yield pa.record_batch([pa.array([m.weights.tobytes()]), pa.array([m.squares.tobytes()]), *(pa.array([float(x)]) for x in (m.bias, m.slope, m.shift))], names=["weights", "squares", "bias", "slope", "shift"])

    found = sample.select("doc_id", "label", "grams").coalesce(1).mapInArrow(run, "weights binary, squares binary, bias double, slope double, shift double").first()
    if found is None:  # no rows, no task
        return fit([], np.zeros(0))
    return QualityModel(np.frombuffer(bytes(found.weights), np.float32), np.frombuffer(bytes(found.squares), np.float32), found.bias, found.slope, found.shift)


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """Score every whole text.

    Returns one row per input row: doc_id, held_out, score (0 to 1) and
    predicted (1 if score >= threshold).  Null and empty texts have no n-grams
    and get the score of the bias alone; a null id stays null and is not held
    out; repeated rows give repeated results; other columns are ignored; an
    empty table gives an empty table.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of BUCKETS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = [m.score(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` whose score reaches the threshold; edge cases as in ``score_documents``."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield b.filter(pa.array([m.score(t) >= threshold for t in b.column(1).to_pylist()], pa.bool_()))

    rows = docs.select(*DOCUMENT_COLUMNS)
    return rows.mapInArrow(run, rows.schema)
