"""Text quality by a factorisation machine over hashed words and structure statistics.

The score of a text with features x is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j. The pairwise
part is computed in linear time as half of sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, learning_rows, lowered, span_hashes, text_groups, word_spans

GROUP_BYTES = 1 << 20
WORD_DIMS = 1 << 12
STEPS = 16
#: Statistics of a text, each cut into STEPS one-hot steps; fixed values, in this order.
STATISTICS = (
    "upper", "digit", "non_ascii", "symbol", "stop_mark", "comma", "bar", "hash_dollar_percent", "exclaim", "asterisk_ampersand",
    "log_words", "mean_word", "words_per_line", "short_lines", "distinct_words", "repeated_words", "distinct_lines",
    "capital_words", "one_byte_words", "log_bytes",
)


@dataclass
class FactorizationMachine:
    """Bias, weights, factors; ``prior`` is the score where nothing could be learned."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    prior: float | None = None

    def logits(self, feature: np.ndarray, value: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Scores of rows given as runs of (feature, value); every row has at least one feature."""
        at = ends[:-1]
        vx = self.factors[feature] * value[:, None]
        pairs = np.add.reduceat(vx, at, axis=0) ** 2 - np.add.reduceat(vx * vx, at, axis=0)
        return self.bias + np.add.reduceat(self.weights[feature] * value, at) + 0.5 * pairs.sum(1)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets]).astype(float)


def _unique_per_text(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (text, hash) pairs in order, and their counts."""
    order = np.lexsort((hashes, text))
    h, t = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
    first = np.flatnonzero(new)
    return t[first], h[first], np.diff(np.append(first, len(h)))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of a group of texts: feature numbers, values, and the n+1 offsets of the rows."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    starts, ends, text = word_spans(data, offsets)
    words = np.bincount(text, minlength=n).astype(float)
    low = lowered(data)
    t, h, count = _unique_per_text(span_hashes(low, starts, ends), text, n)
    distinct = np.bincount(t, minlength=n)
    bucket = (h >> np.uint64(64 - 12)).astype(np.int64)
    # several words of a text may share a bucket: add them up, so that the squares in the score are right
    flat, inverse = np.unique(t * WORD_DIMS + bucket, return_inverse=True)
    value = np.sqrt(np.bincount(inverse, count, len(flat)))
    t, bucket = flat // WORD_DIMS, flat % WORD_DIMS
    norm = np.sqrt(np.bincount(t, value * value, n))
    value = value / norm[t]

    upper = (data >= 65) & (data <= 90)
    newline = data == 10
    line_starts = np.unique(np.concatenate([np.flatnonzero(newline) + 1, offsets[:-1]]))
    line_starts = line_starts[line_starts < len(data)]
    line_text = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = np.minimum(np.append(line_starts[1:], len(data)), offsets[line_text + 1])
    lines = np.maximum(np.bincount(line_text, minlength=n), 1).astype(float)
    short = np.bincount(line_text, (line_ends - line_starts) < 20, n)
    lt, _, _ = _unique_per_text(span_hashes(low, line_starts, line_ends), line_text, n)
    length = (ends - starts).astype(float)
    capital = np.bincount(text, upper[starts], n)
    some, any_words = np.maximum(size, 1), np.maximum(words, 1)

    def of(*chars: str) -> np.ndarray:
        return _per_text(np.isin(data, np.frombuffer("".join(chars).encode(), np.uint8)), offsets) / any_words

    symbol = ((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127))
    stats = np.stack([
        _per_text(upper, offsets) / some, _per_text((data >= 48) & (data <= 57), offsets) / some,
        _per_text(data >= 128, offsets) / some, _per_text(symbol, offsets) / some, of("."), of(","), of("|"), of("#$%"), of("!"),
        of("*&"), np.log1p(words) / 10, np.bincount(text, length, n) / any_words / 16, np.minimum(words / lines / 64, 1),
        short / lines, distinct / any_words, np.bincount(t, value > 0, n) / any_words,
        np.bincount(lt, minlength=n) / lines, capital / any_words, np.bincount(text, length < 2, n) / any_words, np.log1p(size) / 14,
    ], 1)
    step = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * STEPS).astype(np.int64), STEPS - 1)
    stat_feature = WORD_DIMS + np.arange(len(STATISTICS)) * STEPS + step
    feature = np.concatenate([bucket, stat_feature.ravel()])
    values = np.concatenate([value, np.full(stat_feature.size, len(STATISTICS) ** -0.5)])
    row = np.concatenate([t, np.repeat(np.arange(n), len(STATISTICS))])
    order = np.argsort(row, kind="stable")
    return feature[order], values[order].astype(np.float32), np.searchsorted(row[order], np.arange(n + 1))


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, lo, hi, data, offsets in text_groups(batches, "text", GROUP_BYTES):
        feature, value, ends = features(data, offsets)
        cut = lambda x, kind: [x[a:b].astype(kind).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.record_batch([batch.column(batch.schema.get_field_index("y")).slice(lo, hi - lo),
                               pa.array(cut(feature, np.int16), pa.binary()), pa.array(cut(value, np.float16), pa.binary())], ["y", "f", "x"])


def fit(rows: DataFrame, rank: int = 8, epochs: int = 8, rate: float = 0.1, ridge: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Fit by AdaGrad on (text, y) rows, a bounded sample.

    Features are made on the cluster; the driver gets some hundred numbers per sampled row, texts not.
    """
    sample = rows.select("text", "y").mapInArrow(_feature_rows, "y int, f binary, x binary").collect()
    dims = WORD_DIMS + STEPS * len(STATISTICS)
    y = np.array([r["y"] for r in sample], float)
    rng = np.random.default_rng(seed)
    model = FactorizationMachine(0.0, np.zeros(dims), rng.normal(0, 0.05, (dims, rank)))
    if len(y) == 0 or y.min() == y.max():
        model.prior = float(y[0]) if len(y) else 0.5
        return model
    order = sorted(range(len(y)), key=lambda i: (sample[i]["f"], sample[i]["x"]))  # whatever order the rows arrived in
    fs = [np.frombuffer(sample[i]["f"], np.int16).astype(np.int64) for i in order]
    xs = [np.frombuffer(sample[i]["x"], np.float16).astype(float) for i in order]
    y = y[order]
    model.bias = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv = np.full(dims, 1e-6), np.full((dims, rank), 1e-6)
    for _ in range(epochs):
        for rows_at in np.array_split(rng.permutation(len(y)), max(1, len(y) // 128)):
            feature, value = np.concatenate([fs[i] for i in rows_at]), np.concatenate([xs[i] for i in rows_at])
            ends = np.concatenate([[0], np.cumsum([len(fs[i]) for i in rows_at])])
            error = 1 / (1 + np.exp(-np.clip(model.logits(feature, value, ends), -30, 30))) - y[rows_at]
            row = np.repeat(np.arange(len(rows_at)), np.diff(ends))
            sums = np.add.reduceat(model.factors[feature] * value[:, None], ends[:-1], axis=0)
            pull = error[row] * value / len(rows_at)
            dw = np.bincount(feature, pull, dims) + ridge * model.weights
            each = pull[:, None] * (sums[row] - model.factors[feature] * value[:, None])
            dv = np.stack([np.bincount(feature, each[:, k], dims) for k in range(rank)], 1) + ridge * model.factors
            gw += dw * dw
            gv += dv * dv
            model.weights -= rate * dw / np.sqrt(gw)
            model.factors -= 0.3 * rate * dv / np.sqrt(gv)
            model.bias -= rate * error.mean()
    return model


def _score(model: FactorizationMachine, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in text_groups(batches, "text", GROUP_BYTES):
            if model.prior is None:
                score = 1 / (1 + np.exp(-np.clip(model.logits(*features(data, offsets)), -30, 30)))
            else:
                score = np.full(hi - lo, model.prior)
            column = lambda name: batch.column(batch.schema.get_field_index(name)).slice(lo, hi - lo)  # noqa: B023, E731
            yield pa.record_batch([column("doc_id"), column("held_out"), pa.array(score.astype(float)),
                                   pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    return run


def score(docs: DataFrame, model: FactorizationMachine, parts: int, fold: int, threshold: float = 0.7) -> DataFrame:
    """Score every text: doc_id, held_out, score, predicted. Null and empty texts are scored by their statistics."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), parts, fold).alias("held_out"), "text")
    return rows.mapInArrow(_score(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, parts: int = 4, fold: int = 2, sample: int = 12_000, threshold: float = 0.7) -> DataFrame:
    """Learn ``labels.quality`` from at most ``sample`` labelled rows outside the fold, and score all documents.

    Returns doc_id, held_out, score, predicted; one row per document, repeated rows included. With no labels
    every score is 0.5, with one kind of label that label. Only the text is read for a score.
    """
    return score(docs, fit(learning_rows(docs, labels, "quality", parts, fold, sample)), parts, fold, threshold)
