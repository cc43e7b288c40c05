"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier per bit, over hashed byte trigrams of lower-cased
words, tells the languages with that bit from the others. A text's bits are decoded to the language
whose codeword has the smallest loss, every bit weighted by how well it works for that language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, text_groups

UNKNOWN = "und"
GROUP_BYTES = 1 << 19
#: Trigrams between this count and none shrink a score towards "can't tell".
PRIOR_TRIGRAMS = 25.0
#: Loss of the runner-up minus that of the winner, per bit, below which a text is ambiguous.
AMBIGUOUS_GAP = 0.1


@dataclass
class LanguageModel:
    """Languages, their codewords (+1/-1), bit weights by language, and linear classifiers of the bits."""

    languages: list[str]
    codes: np.ndarray
    bit_weights: np.ndarray
    table: np.ndarray
    slope: np.ndarray
    offset: np.ndarray


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n codewords as rows of +1/-1, far apart; exhaustive codes up to 5 languages, chosen random ones beyond."""
    if n < 2:
        return np.ones((n, 1), np.float32)
    if n <= 5:
        columns = range(1, 2 ** (n - 1))
        bits = [[1] + [(c >> (n - 2 - i)) & 1 ^ 1 for i in range(n - 1)] for c in columns]
        return (2 * np.array(bits).T - 1).astype(np.float32)
    width, rng = 8 * int(np.ceil(np.log2(n))), np.random.default_rng(seed)
    best, best_gap = None, -1
    for _ in range(200):
        code = rng.integers(0, 2, (n, width)) * 2 - 1
        apart = (width - code @ code.T) // 2
        gap = int(apart[~np.eye(n, dtype=bool)].min())
        if gap > best_gap and (np.abs(code.sum(0)) < n).all():
            best, best_gap = code, gap
    return best.astype(np.float32)


def _word_bytes() -> np.ndarray:
    table = np.full(256, 32, np.uint8)
    table[97:123] = table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table


def trigrams(data: np.ndarray, offsets: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each byte trigram whose middle lies in a word, and the n+1 offsets of the texts in it."""
    n = len(offsets) - 1
    padded = np.full(len(data) + n + 1, 32, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = _word_bytes()[data]
    middle = np.flatnonzero(padded[1:-1] != 32) + 1
    wide = padded.astype(np.uint32)
    code = wide[middle - 1] | wide[middle] << np.uint32(8) | wide[middle + 1] << np.uint32(16)
    bucket = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - dims.bit_length() + 1)
    return bucket.astype(np.int64), np.searchsorted(middle, offsets + np.arange(n + 1))


def _count(dims: int, languages: list[str]):
    at = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), dims), np.int64)
        for batch, lo, hi, data, offsets in text_groups(batches, "text", GROUP_BYTES):
            bucket, ends = trigrams(data, offsets, dims)
            lang = np.array([at[x] for x in batch.column(batch.schema.get_field_index("lang")).slice(lo, hi - lo).to_pylist()])
            flat = np.repeat(lang, np.diff(ends)) * dims + bucket
            counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        lang, bucket = np.nonzero(counts)
        yield pa.record_batch([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(counts[lang, bucket])], ["l", "b", "n"])
    return run


def bit_scores(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text the damped mean of its trigrams' weights for every bit, and the number of trigrams."""
    bucket, ends = trigrams(data, offsets, len(table))
    counts = np.diff(ends)
    sums = np.zeros((len(counts), table.shape[1]))
    if (counts > 0).any():
        sums[counts > 0] = np.add.reduceat(table[bucket], ends[:-1][counts > 0], axis=0)
    return sums / np.sqrt(counts + PRIOR_TRIGRAMS)[:, None], counts


def _scored_sample(table: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in text_groups(batches, "text", GROUP_BYTES):
            scores, _ = bit_scores(data, offsets, table)
            yield pa.record_batch([batch.column(batch.schema.get_field_index("lang")).slice(lo, hi - lo),
                                   pa.array(list(scores), pa.list_(pa.float64()))], ["lang", "z"])
    return run


def _platt(z: np.ndarray, bit: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into log-odds, by Newton steps with a small ridge."""
    x = np.stack([z / (np.abs(z).mean() + 1e-9), np.ones_like(z)], 1)
    target, beta = (bit > 0).astype(float), np.zeros(2)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * len(z) ** 0.5 * np.eye(2)
        beta = beta - np.linalg.solve(hess, x.T @ (p - target) + 0.01 * len(z) ** 0.5 * beta)
    return float(beta[0] / (np.abs(z).mean() + 1e-9)), float(beta[1])


def fit(labelled: DataFrame, sample_per_language: int = 4000, dims: int = 1 << 15) -> LanguageModel:
    """Fit on (doc_id, text, lang) rows, lang not null.

    Of each language about ``sample_per_language`` rows are used, chosen by a hash of the id; counting and scoring of the
    sample run on the cluster, and the driver gets counts of at most languages x dims and the sample's bit scores.
    """
    labelled = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.ones((0, 1)), np.ones((0, 1)), np.zeros((dims, 1), np.float32), np.ones(1), np.zeros(1))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample_per_language / sizes[k])))])
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.filter(draw < F.element_at(share, F.col("lang"))).select("text", "lang")
    counts = np.zeros((len(languages), dims))
    found = sample.mapInArrow(_count(dims, languages), "l int, b int, n long").groupBy("l", "b").agg(F.sum("n").alias("n"))
    for row in found.toLocalIterator():
        counts[row["l"], row["b"]] = row["n"]
    codes = codewords(len(languages))
    smooth = counts + 0.5
    p = smooth / smooth.sum(1, keepdims=True)
    one, zero = (codes > 0).astype(float), (codes < 0).astype(float)
    mean = lambda chosen: (chosen.T @ p + 1e-12) / np.maximum(chosen.sum(0), 1)[:, None]
    table = (np.log(mean(one)) - np.log(mean(zero))).T.astype(np.float32) if len(languages) > 1 else np.zeros((dims, 1), np.float32)
    scored = sample.mapInArrow(_scored_sample(table), "lang string, z array<double>").collect()
    z = np.array([r["z"] for r in scored]).reshape(len(scored), table.shape[1])
    lang = np.array([languages.index(r["lang"]) for r in scored], int)
    slope, offset = np.ones(table.shape[1]), np.zeros(table.shape[1])
    weights = np.ones(codes.shape)
    if len(languages) > 1:
        for b in range(table.shape[1]):
            slope[b], offset[b] = _platt(z[:, b], codes[lang, b])
        right = np.sign(z * slope + offset) == codes[lang]
        for i in range(len(languages)):
            weights[i] = right[lang == i].mean(0) + 1e-3 if (lang == i).any() else 1.0
    weights = weights / weights.sum(1, keepdims=True)
    return LanguageModel(languages, codes, weights, table, slope, offset)


def decode(model: LanguageModel, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the language with the least weighted loss, its probability, and whether it is ambiguous."""
    margin = z * model.slope + model.offset
    loss = (np.logaddexp(0, -margin[:, None, :] * model.codes[None]) * model.bit_weights[None]).sum(2)
    best = loss.argmin(1)
    odds = np.exp(-(loss - loss.min(1, keepdims=True)) * model.codes.shape[1])
    score = 1 / odds.sum(1)
    gap = np.partition(loss, 1, axis=1)[:, 1] - loss.min(1) if loss.shape[1] > 1 else np.full(len(loss), np.inf)
    return best, score, gap < AMBIGUOUS_GAP


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        for batch, lo, hi, data, offsets in text_groups(batches, "text", GROUP_BYTES):
            n = hi - lo
            ids = batch.column(batch.schema.get_field_index("doc_id")).slice(lo, n)
            held = batch.column(batch.schema.get_field_index("held_out")).slice(lo, n)
            seen = np.concatenate([[0], np.cumsum(ascii_letter[data])])
            letters = np.diff(seen[offsets]) > 0
            for i in np.flatnonzero(~letters):  # other scripts: ask Unicode
                letters[i] = any(c.isalpha() for c in bytes(data[offsets[i]:offsets[i + 1]]).decode("utf-8", "replace"))
            known = letters & bool(model.languages)
            names, score, unsure = np.full(n, UNKNOWN, object), np.zeros(n), np.ones(n, bool)
            if known.any():
                z, _ = bit_scores(data, offsets, model.table)
                best, probability, ambiguous = decode(model, z[known])
                names[known] = np.array(model.languages, object)[best]
                score[known], unsure[known] = probability, ambiguous
            yield pa.record_batch([ids, held, pa.array(names, pa.string()), pa.array(score), pa.array(unsure)],
                                  ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])
    return run


def identify(docs: DataFrame, model: LanguageModel, parts: int = 4, fold: int = 2) -> DataFrame:
    """Predict the language of every text.

    Returns doc_id, held_out, lang_pred, score (0 to 1), ambiguous. Texts that are null or hold no letter are
    ``und`` with score 0 and ambiguous, as is everything if nothing could be learned. Only the text is read for a
    prediction. Repeated rows are scored one by one; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), parts, fold).alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def languages_of(docs: DataFrame, parts: int = 4, fold: int = 2) -> DataFrame:
    """Fit on the documents outside the held-out fold that carry a language, and predict all."""
    return identify(docs, fit(docs.filter(~in_fold(F.col("doc_id"), parts, fold))), parts, fold)
