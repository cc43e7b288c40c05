"""Toxicity by a misspelling-tolerant lexicon and the context of its hits.

Terms are learned from labelled texts: words, or beginnings of words, that tell toxic texts. All terms stand in
one trie. Levenshtein automata of the terms are intersected with that trie and compiled into
one deterministic table, which all tokens of a group of texts run through together. Hits
are weighed by term, number of edits, and the words and quotation marks around them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_fold, learning_rows, mixed, span_hashes, text_groups, written

GROUP_BYTES = 1 << 20
SHORTEST, LONGEST_START, LONGEST_WORD = 4, 12, 24
#: Terms of fewer bytes are matched without edits.
EDIT_FROM = 5
WINDOW_BYTES = 40
NEIGHBOURS = 3
CONTEXT_DIMS = 1 << 10


def _fold_table() -> np.ndarray:
    """Bytes of tokens: letters and digits, A-Z lowered, and bytes beyond ASCII; others 0."""
    table = np.zeros(256, np.uint8)
    table[48:58], table[97:123], table[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(128, 256)
    table[65:91] = np.arange(97, 123)
    return table


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, start and end of each token, and its text. The marks @ $ * ! count between two token bytes."""
    low = _fold_table()[data]
    plain = low > 0
    marks = np.flatnonzero(np.isin(data, np.frombuffer(b"@$*!", np.uint8)))
    marks = marks[(marks > 0) & (marks < len(data) - 1)]
    marks = marks[plain[marks - 1] & plain[marks + 1]]
    low[marks] = data[marks]
    inside = low > 0
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    inner = offsets[1:-1]
    first, last = inner[inner < len(data)], inner[inner > 0] - 1
    start[first], end[last] = inside[first], inside[last]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return low, starts, ends, np.searchsorted(offsets, starts, side="right") - 1


class LexiconAutomaton:
    """Deterministic form of the trie of all terms intersected with their Levenshtein automata.

    A state of the intersection is a set of (trie node, edits). ``step`` goes from state and byte class to state; ``word`` and
    ``start`` give what is accepted if the token ends there, or whatever follows: term * 2 + edits, or -1.
    State 0 is dead; states in ``settled`` can't find anything better.
    """

    def __init__(self, terms: list[tuple[bytes, bool]]) -> None:
        self.terms = terms
        children: list[dict[int, int]] = [{}]
        ending: list[list[int]] = [[]]
        for number, (text, _) in enumerate(terms):
            node = 0
            for byte in text:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    ending.append([])
                node = children[node][byte]
            ending[node].append(number)
        self.byte_class = np.zeros(256, np.int64)
        letters = sorted({b for text, _ in terms for b in text})
        self.byte_class[letters] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1

        def closed(items: set[tuple[int, int]]) -> frozenset:
            for node, edits in list(items):
                if edits == 0:  # a byte of the term is missing
                    items.update((child, 1) for child in children[node].values())
            return frozenset((n, e) for n, e in items if not (e == 1 and (n, 0) in items))

        def accepted(items: frozenset, starts: bool) -> int:
            found = [2 * t + e for n, e in items for t in ending[n]
                     if terms[t][1] == starts and (e == 0 or len(terms[t][0]) >= EDIT_FROM)]
            return min(found, key=lambda x: (x & 1, -len(terms[x >> 1][0]), x), default=-1)

        def better(a: int, b: int) -> int:
            return a if b < 0 or (a >= 0 and a & 1 <= b & 1) else b

        first = closed({(0, 0)})
        dead = (frozenset(), -1)
        numbers, queue, step, word, start = {dead: 0, (first, -1): 1}, [(first, -1)], [[0] * width], [-1], [-1]
        settled = [True]
        while queue:
            following = []
            for items, held in queue:
                row = []
                for byte in [None, *letters]:
                    after: set[tuple[int, int]] = set()
                    for node, edits in items:
                        child = children[node].get(byte) if byte is not None else None
                        if child is not None:
                            after.add((child, edits))
                        if edits == 0:
                            after.add((node, 1))
                            after.update((c, 1) for c in children[node].values())
                    new = closed(after)
                    keep = better(held, accepted(new, True))
                    if keep >= 0 and keep & 1 == 0:
                        new = frozenset()
                    key = (new, keep)
                    if key not in numbers:
                        numbers[key] = len(numbers)
                        following.append(key)
                    row.append(numbers[key])
                step.append(row)
                word.append(better(accepted(items, False), held))
                start.append(held)
                settled.append(not items)
            queue = following
        self.step = np.array(step, np.int32).ravel()
        self.width = width
        self.word, self.settled = np.array(word), np.array(settled)

    def match(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For each token the accepted term * 2 + edits, or -1."""
        found = np.full(len(starts), -1)
        if not self.terms:
            return found
        at, state, position = np.arange(len(starts)), np.ones(len(starts), np.int64), starts.copy()
        while len(at):
            state = self.step[state * self.width + self.byte_class[low[position]]].astype(np.int64)
            position = position + 1
            done = (position == ends[at]) | self.settled[state]
            found[at[done]] = self.word[state[done]]
            at, state, position = at[~done], state[~done], position[~done]
        return found


@dataclass
class ToxicityModel:
    """Terms, their weights by edits, context weights, and the logistic regression of a text's hits."""

    terms: list[tuple[bytes, bool]] = field(default_factory=list)
    hit_weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    context_weight: np.ndarray = field(default_factory=lambda: np.zeros(CONTEXT_DIMS + 2))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(7))
    prior: float | None = 0.0


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Smallest hash of a text's pairs of neighbouring tokens: near copies mostly share it, other texts rarely."""
    for batch, lo, hi, data, offsets in text_groups(batches, "text", GROUP_BYTES):
        low, starts, ends, text = tokens(data, offsets)
        token = span_hashes(low, starts, ends)
        pair = token.copy()
        pair[:-1] = np.where(text[:-1] == text[1:], mixed(token[:-1]) ^ token[1:], token[:-1])
        sketch = np.full(hi - lo, np.iinfo(np.int64).max)
        np.minimum.at(sketch, text, (mixed(pair) >> np.uint64(1)).astype(np.int64))
        ids = batch.column(batch.schema.get_field_index("doc_id")).slice(lo, hi - lo)
        yield pa.record_batch([ids, pa.array(sketch)], ["doc_id", "sketch"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with each token and each beginning of one, by label; tokens end in a zero byte."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        out = pa.record_batch([pa.array(names, pa.binary()), pa.array([counts[1][x] for x in names], pa.int64()),
                               pa.array([counts[0][x] for x in names], pa.int64())], ["term", "toxic", "clean"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch, lo, hi, data, offsets in text_groups(batches, "text", GROUP_BYTES):
        low, starts, ends, text = tokens(data, offsets)
        raw = low.tobytes()
        rows = np.searchsorted(text, np.arange(hi - lo + 1))
        labels = batch.column(batch.schema.get_field_index("y")).slice(lo, hi - lo).to_pylist()
        for i, y in enumerate(labels):
            spans = slice(rows[i], rows[i + 1])
            words = {raw[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True) if SHORTEST <= b - a}
            seen = {w + b"\0" for w in words if len(w) <= LONGEST_WORD}
            for w in words:
                seen.update([w[:k] for k in range(SHORTEST, min(len(w), LONGEST_START) + 1)])
            counts[int(y > 0)].update(seen)
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield flush()
    yield flush()


def chosen_terms(found: list[tuple[bytes, int, int]], toxic: int, clean: int, candidates: int) -> list[tuple[bytes, bool]]:
    """Terms whose share of toxic texts can't be chance among so many candidates; (text, is a beginning).

    The shortest telling beginning is taken, then lengthened as far as nine tenths of its toxic texts go along.
    """
    base = (toxic + 1) / (toxic + clean + 2)
    counts = {t: (n, c) for t, n, c in found}

    def telling(t: bytes) -> bool:
        n, c = counts[t]
        if n < 0.8 * (n + c):
            return False
        # chance of n or more toxic among n + c texts, bounded by its largest terms
        log_tail = max(math.lgamma(n + c + 1) - math.lgamma(n + k + 1) - math.lgamma(c - k + 1) + (n + k) * math.log(base)
                       + (c - k) * math.log1p(-base) for k in range(c + 1))
        return log_tail + math.log(c + 1) + math.log(max(candidates, 1)) < math.log(0.01)

    ordered = sorted(counts, key=lambda t: (len(t.rstrip(b"\0")), t.endswith(b"\0"), t))
    starts: set[bytes] = set()
    for t in ordered:
        bare = t.rstrip(b"\0")
        if not any(bare[:k] in starts for k in range(SHORTEST, len(bare) + 1)) and telling(t):
            starts.add(t)
    out = set()
    for t in starts:
        n = counts[t][0]
        longer = [x for x in counts if x.startswith(t) and counts[x][0] >= 0.9 * n] if not t.endswith(b"\0") else [t]
        best = max(longer, key=lambda x: (len(x), x))
        out.add((best.rstrip(b"\0"), not best.endswith(b"\0")))
    return sorted(out)


def _quotes(data: np.ndarray) -> np.ndarray:
    """Positions of straight, curly and angle quotation marks (last byte of each)."""
    mark = data == 34
    if len(data) > 2:
        mark[1:] |= (data[:-1] == 0xC2) & ((data[1:] == 0xAB) | (data[1:] == 0xBB))
        mark[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & ((data[2:] >= 0x9C) & (data[2:] <= 0x9F))
    return mark


def hits(data: np.ndarray, offsets: np.ndarray, automaton: LexiconAutomaton):
    """Text, term * 2 + edits and context buckets of every hit, and the number of tokens per text.

    The context is the buckets of up to NEIGHBOURS tokens on either side (-1: none), then the bucket that tells
    whether quotation marks stand within WINDOW_BYTES on both sides.
    """
    low, starts, ends, text = tokens(data, offsets)
    code = automaton.match(low, starts, ends)
    at = np.flatnonzero(code >= 0)
    near = at[:, None] + np.array([d for d in range(-NEIGHBOURS, NEIGHBOURS + 1) if d])[None]
    ok = (near >= 0) & (near < len(starts))
    near = np.where(ok, near, 0)
    ok &= text[near] == text[at][:, None] if len(at) else ok
    used, where = np.unique(near, return_inverse=True)
    bucket = (span_hashes(low, starts[used], ends[used]) >> np.uint64(54)).astype(np.int64)[where.reshape(near.shape)] if len(used) else near
    context = np.where(ok, bucket, -1)
    seen = np.concatenate([[0], np.cumsum(_quotes(data))])
    a, b = offsets[text[at]], offsets[text[at] + 1]
    before = seen[starts[at]] - seen[np.maximum(starts[at] - WINDOW_BYTES, a)]
    after = seen[np.minimum(ends[at] + WINDOW_BYTES, b)] - seen[ends[at]]
    quoted = CONTEXT_DIMS + ((before > 0) & (after > 0)).astype(np.int64)
    return text[at], code[at], np.concatenate([context, quoted[:, None]], 1), np.bincount(text, minlength=len(offsets) - 1)


def _hit_rows(automaton: LexiconAutomaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in text_groups(batches, "text", GROUP_BYTES):
            text, code, context, n_tokens = hits(data, offsets, automaton)
            ends = np.searchsorted(text, np.arange(hi - lo + 1))
            cut = lambda x: [x[a:b].astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]  # noqa: B023, E731
            yield pa.record_batch([batch.column(batch.schema.get_field_index("y")).slice(lo, hi - lo), pa.array(n_tokens),
                                   pa.array(cut(code), pa.binary()), pa.array(cut(context), pa.binary())], ["y", "n", "code", "context"])
    return run


def _text_features(model: ToxicityModel, text: np.ndarray, code: np.ndarray, context: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
    """Constant, any hit, log of hits, total and best weight, hits per token, share of quoted hits."""
    n = len(n_tokens)
    around = np.where(context >= 0, model.context_weight[np.maximum(context, 0)], 0.0)
    weight = model.hit_weight[code] + around.sum(1) / np.maximum((context >= 0).sum(1), 1) if len(code) else np.zeros(0)
    count = np.bincount(text, minlength=n).astype(float)
    best = np.full(n, -8.0)
    np.maximum.at(best, text, weight)
    quoted = np.bincount(text, context[:, -1] == CONTEXT_DIMS + 1, n) if len(code) else np.zeros(n)
    some = np.maximum(count, 1)
    return np.stack([np.ones(n), count > 0, np.log1p(count), np.bincount(text, np.maximum(weight, 0), n) / 8,
                     np.where(count > 0, best, 0) / 4, np.minimum(10 * count / np.maximum(n_tokens, 1), 2), quoted / some], 1)


def fit(rows: DataFrame) -> ToxicityModel:
    """Fit on (doc_id, text, y) rows, a bounded sample.

    Near copies in the sample count once for the lexicon. Term counts and hits are made on the
    cluster; the driver gets terms found in toxic texts and the hits of the sample, no texts.
    """
    sample = written(rows.select("doc_id", "text", "y"), "toxic-sample")
    one = sample.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, sketch long")
    one = one.groupBy("sketch").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    single = written(sample.join(one, "doc_id", "left_semi"), "toxic-single")
    sizes = {r["toxic"]: r["n"] for r in single.groupBy((F.col("y") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(True, 0), sizes.get(False, 0)
    if not toxic or not clean:
        return ToxicityModel(prior=1.0 if toxic else 0.0)
    counted = single.select("text", "y").mapInArrow(_term_counts, "term binary, toxic long, clean long")
    counted = written(counted.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
                      .filter("toxic >= 3"), "toxic-terms")
    found = [(bytes(r["term"]), r["toxic"], r["clean"]) for r in counted.filter("toxic >= 4 * clean").collect()]
    model = ToxicityModel(chosen_terms(found, toxic, clean, counted.count()), prior=None)
    model.hit_weight = np.zeros(2 * len(model.terms))
    automaton = LexiconAutomaton(model.terms)
    seen = sample.select("text", "y").mapInArrow(_hit_rows(automaton), "y int, n long, code binary, context binary").collect()
    seen.sort(key=lambda r: (r["y"], r["n"], r["code"], r["context"]))
    y = np.array([r["y"] > 0 for r in seen], float)
    code = [np.frombuffer(r["code"], np.int32) for r in seen]
    text = np.repeat(np.arange(len(seen)), [len(c) for c in code])
    code = np.concatenate(code).astype(np.int64)
    context = np.concatenate([np.frombuffer(r["context"], np.int32).reshape(-1, 2 * NEIGHBOURS + 1) for r in seen]).astype(np.int64)
    odds = lambda x, where, size: np.log((np.bincount(x[where > 0], minlength=size) + 0.5) / y.sum()) - np.log(
        (np.bincount(x[where == 0], minlength=size) + 0.5) / (len(y) - y.sum()))
    once = np.unique(np.stack([text, code], 1), axis=0) if len(code) else np.zeros((0, 2), int)
    model.hit_weight = odds(once[:, 1], y[once[:, 0]], 2 * len(model.terms))
    flat, label = context.ravel(), np.repeat(y[text], context.shape[1])
    hit_y = y[text]
    size = CONTEXT_DIMS + 2
    inside = flat >= 0
    a, b = (np.bincount(flat[inside & (label == v)], minlength=size) + 4.0 for v in (1, 0))
    if hit_y.any() and not hit_y.all():
        model.context_weight = np.log(a / a.sum()) - np.log(b / b.sum())
    x = _text_features(model, text, code, context, np.array([r["n"] for r in seen]))
    beta, ridge = np.zeros(x.shape[1]), 0.5 * np.diag([0.0] + [1.0] * (x.shape[1] - 1)) + 1e-6 * np.eye(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta = beta - np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + ridge, x.T @ (p - y) + ridge @ beta)
    model.beta = beta
    return model


def _score(model: ToxicityModel, automaton: LexiconAutomaton, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in text_groups(batches, "text", GROUP_BYTES):
            text, code, context, n_tokens = hits(data, offsets, automaton)
            if model.prior is None:
                score = 1 / (1 + np.exp(-np.clip(_text_features(model, text, code, context, n_tokens) @ model.beta, -30, 30)))
            else:
                score = np.full(hi - lo, model.prior)
            column = lambda name: batch.column(batch.schema.get_field_index(name)).slice(lo, hi - lo)  # noqa: B023, E731
            yield pa.record_batch([column("doc_id"), column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)),
                                   pa.array(np.bincount(text, minlength=hi - lo))], ["doc_id", "held_out", "score", "predicted", "hits"])
    return run


def score(docs: DataFrame, model: ToxicityModel, parts: int, fold: int, threshold: float = 0.7) -> DataFrame:
    """Score every text: doc_id, held_out, score, predicted, hits (lexicon terms found). Null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), parts, fold).alias("held_out"), "text")
    return rows.mapInArrow(_score(model, LexiconAutomaton(model.terms), threshold),
                           "doc_id long, held_out boolean, score double, predicted int, hits long")


def toxicity(docs: DataFrame, labels: DataFrame, parts: int = 3, fold: int = 1, sample: int = 12_000, threshold: float = 0.7) -> DataFrame:
    """Learn ``labels.toxic`` from at most ``sample`` labelled rows outside the fold, and score all documents.

    Returns doc_id, held_out, score, predicted, hits; one row per document, repeated rows included. Without toxic labels
    every score is 0, with toxic labels alone 1. Only the text is read for a score.
    """
    return score(docs, fit(learning_rows(docs, labels, "toxic", parts, fold, sample)), parts, fold, threshold)
