"""Quality scores of documents: a Naive Bayes support vector machine over n-gram indicators.

An indicator says that an n-gram has a certain share of its text, as a power of two: byte trigrams
(hashed) and one or two word shapes (case, last character, length, repetition). Indicators are scaled
by the log-count ratio of the two classes, each text to unit length, and a linear hinge-loss model is
fitted by dual coordinate descent (Hsieh et al., 2008). A logistic curve turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from punctual.llm.storage import freeing, stored
from punctual.llm.words import Words, slices, text_buffers

#: Labelled rows the model is fitted on, at most about, chosen by the hash of their id.
FIT_ROWS = 8000
#: Score from which a document is predicted to be good.
GOOD = 0.3
_TRIGRAMS, _LEVELS = 1 << 14, 12
_SHAPES, _SHORT = 180, 36
FEATURES = (_TRIGRAMS + _SHAPES + _SHORT * _SHORT) * _LEVELS

_LAST = np.zeros(256, np.int64)
for _kind, _chars in ((1, "."), (2, ","), (3, "!"), (5, "0123456789")):
    _LAST[[ord(c) for c in _chars]] = _kind
_LAST[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,!"]] = 4
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def _levels(counts: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    found = np.flatnonzero(counts)
    share = np.log2(counts[found] * (2.0 ** (_LEVELS - 1) * 2 / total))
    return found, np.clip(share.astype(np.int64), 0, _LEVELS - 1)


def indicators(data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The indicators of every text; an empty text has none."""
    wide = data.astype(np.uint32)
    grams = (wide[:-2] << np.uint32(16)) | (wide[1:-1] << np.uint32(8)) | wide[2:] if len(data) > 2 else wide[:0]
    grams = (grams * np.uint32(0x9E3779B1)) >> np.uint32(18)
    words = Words(data, bounds)
    hashes = words.hashes() if len(words) else np.zeros(0, np.uint64)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    caps = np.minimum(upper[words.ends] - upper[words.starts], 2)
    sizes = words.ends - words.starts
    again = np.zeros(len(words), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])
    short = (_LAST[data[words.ends - 1]] * 3 + caps) * 2 + again if len(words) else again
    shape = short * 5 + np.searchsorted([2, 4, 8, 16], sizes, "right")
    out = []
    for k in range(len(bounds) - 1):
        parts = []
        a, b = bounds[k], bounds[k + 1] - 2
        if b > a:
            found, level = _levels(np.bincount(grams[a:b], minlength=_TRIGRAMS), b - a)
            parts.append(found * _LEVELS + level)
        a, b = words.first[k], words.first[k + 1]
        if b > a:
            found, level = _levels(np.bincount(shape[a:b], minlength=_SHAPES), b - a)
            parts.append((_TRIGRAMS + found) * _LEVELS + level)
        if b > a + 1:
            pairs = short[a : b - 1] * _SHORT + short[a + 1 : b]
            found, level = _levels(np.bincount(pairs, minlength=_SHORT * _SHORT), b - a - 1)
            parts.append((_TRIGRAMS + _SHAPES + found) * _LEVELS + level)
        out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    return out


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    data, bounds = text_buffers(batch.column("text"))
    for i, j in slices(bounds):
        yield i, indicators(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])


@dataclass(frozen=True)
class Model:
    """Margins are sum(weights[indicators]) / norm + bias; scores are 1 / (1 + exp(-(slope * margin + shift)))."""

    ratios: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        norm = np.sqrt(np.square(self.ratios[found]).sum()) or 1.0
        return float(self.weights[found].sum() / norm + self.bias)

    def score(self, found: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(found) + self.shift, -500, 500))))


def log_count_ratios(good: np.ndarray, bad: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p, q = good + smoothing, bad + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, epochs: int = 12, seed: int = 7):
    """(weights, bias) of min |w|^2 / 2 + sum cost_i * hinge(y_i * (w x_i + bias)), the bias as one more weight."""
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(rows))
    curve = np.array([np.square(v).sum() + 1 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in order.permutation(len(rows)):
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / curve[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[rows[i]] += step * y[i] * values[i]
                bias += step * y[i]
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by Newton's method, towards targets a little inside 0 and 1 (Platt, 1999)."""
    n1, n0 = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(hessian, x.T @ (target - p) - 1e-3 * beta)
        beta = beta + np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """Model from labelled indicator sets; a third of them only places the logistic curve."""
    y = np.where(labels > 0, 1.0, -1.0)
    counts = np.zeros((2, FEATURES))
    for row, good in zip(rows, y > 0):
        counts[int(good), row] += 1
    ratios = log_count_ratios(counts[1], counts[0])
    if len(y) == 0 or (y > 0).all() or (y < 0).all():
        share = float((y > 0).mean()) if len(y) else 0.5
        return Model(ratios, np.zeros(FEATURES), 0.0, 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    values = [ratios[r] / (np.sqrt(np.square(ratios[r]).sum()) or 1.0) for r in rows]
    share = (y > 0).mean()
    cost = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))

    def model(chosen):
        w, bias = dual_coordinate_descent([rows[i] for i in chosen], [values[i] for i in chosen], y[chosen], cost[chosen], FEATURES)
        return w, bias

    everyone = np.arange(len(y))
    apart = everyone % 3 == 0
    if len(set(y[apart])) < 2 or len(set(y[~apart])) < 2:
        apart = np.zeros(len(y), bool)
    w, bias = model(everyone[~apart])
    judged = everyone[apart] if apart.any() else everyone
    margins = np.array([w[rows[i]] @ values[i] + bias for i in judged])
    slope, shift = _logistic(margins, y[judged])
    return Model(ratios, w * ratios, float(bias), slope, shift)


def _extractor(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, found in _texts(batch):
            rows = [own.astype(np.int32) for own in found]
            yield pa.record_batch(
                [
                    batch.column("doc").slice(i, len(rows)),
                    batch.column("label").slice(i, len(rows)),
                    pa.array(rows, pa.list_(pa.int32())),
                ],
                names=["doc", "label", "found"],
            )


def train(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_rows: int = FIT_ROWS) -> Model:
    """Fit on about fit_rows rows of docs that labels name; ids with different labels, or a NULL one, are left out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("doc")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("_high"))
    known = known.where("label = _high").select("doc", F.col("label").cast("int"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    # Both sides are thinned by the id before they meet, so that few texts move.
    n = known.count()
    share = min(1.0, fit_rows / n) if n else 1.0
    chosen = F.pmod(F.xxhash64("doc"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    sample = texts.where(chosen).hint("merge").join(known.where(chosen), "doc")
    fields = [T.StructField("label", T.IntegerType()), T.StructField("found", T.ArrayType(T.IntegerType()))]
    sample = sample.mapInArrow(freeing(_extractor), T.StructType([texts.schema["doc"], *fields]))
    got = sample.toArrow().sort_by("doc")
    rows = [np.asarray(r.values, np.int64) for r in got.column("found")]
    return fit(rows, got.column("label").to_numpy())


def _scorer(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(own) for _, found in _texts(batch) for own in found]
            columns = [batch.column(n) for n in batch.schema.names]
            yield pa.record_batch([*columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return run


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    good: float = GOOD,
) -> DataFrame:
    """(row, text, held_out, score, predicted): the other columns of every row as a struct, and its score.

    Only texts are scored on. Rows whose crc32(id as text) is a multiple of 5 are held out: nothing is
    learnt from them. NULL and empty texts have no indicator and the score of the bias. Without labels,
    or with one class only, every score is the share of label 1 (0.5 without labels). Equal texts have
    equal scores. A NULL id is not held out and never labelled. No other column is read.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5)) == 0, F.lit(False))
    model = train(docs.where(~held_out), labels.where(~held_out), id_col, text_col, label_col)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        F.col(text_col).cast("string").alias("text"),
        held_out.alias("held_out"),
    )
    scored = rows.mapInArrow(freeing(_scorer(model)), T.StructType([*rows.schema.fields, T.StructField("score", T.DoubleType())]))
    return scored.withColumn("predicted", F.when(F.col("score") >= good, 1).otherwise(0))
