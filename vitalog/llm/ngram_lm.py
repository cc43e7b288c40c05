"""A bigram language model in sharded Elias-Fano tries, counted and queried block by block.

Texts stay where they are read: a task cuts its input into blocks, keeps each as a file of token numbers in the shared
folder, and sends only the different words and word pairs of a block, with their counts, to the shards
that own them. A shard adds up the counts of all blocks, builds its part of the trie, and answers every block's
own words and pairs. So nothing is ever sent once per token, and no task sees more than a block or a shard.

P(w | u) = max(c(uw) - D, 0) / (c(u) + K) + (D T(u) + K) / (c(u) + K) * P(w), where T(u) counts the different
successors of u and P(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). It sums to one over the words and one unknown word.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, block_tasks, by_block, by_shard, from_small, grouped, load, message, new_folder, save, sent, small
from .common import in_fold, lowered, mixed, span_hashes, text_groups, word_spans, written
from .elias_fano import EliasFano, encode

BLOCK_BYTES = 8 << 20
SHARD_TOKENS = 4_000_000
DISCOUNT, CONFIDENCE = 0.9, 5.0
#: Probabilities are stored as 16-bit steps of their logarithm, rounded down, from 1 to 2^-48; 0 means none.
LOG_RANGE = 48.0
END, BEGIN = np.uint64(0x5BD1E995_9E3779B1), np.uint64((1 << 32) - 1)
ADD = 0.1


def _planes(numbers: np.ndarray) -> bytes:
    """Four byte planes of 32-bit numbers: the upper ones compress to next to nothing."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order and each value's place among them, as np.unique has it, in narrow numbers and with few copies."""
    width = np.int32 if len(values) < 1 << 31 else np.int64
    order = np.argsort(values)
    ordered = values[order]
    first = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    different = ordered[first]
    del ordered
    place = np.empty(len(values), width)
    place[order] = np.cumsum(first, dtype=width)
    place -= 1
    return different, place


# --- first round: words ---------------------------------------------------------------------------------------------

def _block_words(folder: str, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, lo, hi, data, offsets in text_groups(batches, "text", BLOCK_BYTES):
            column = lambda name: batch.column(batch.schema.get_field_index(name)).slice(lo, hi - lo)  # noqa: B023, E731
            held = np.array(column("held_out").to_pylist(), bool)
            low = lowered(data)
            starts, ends, text = word_spans(low, offsets)
            n_words = np.bincount(text, minlength=hi - lo)
            del text
            n_tokens = n_words + 1
            last = np.cumsum(n_tokens) - 1
            tokens = np.full(int(n_tokens.sum()), END, np.uint64)
            is_word = np.ones(len(tokens), bool)
            is_word[last] = False
            tokens[is_word] = span_hashes(low, starts, ends)
            del low, starts, ends, is_word
            words, inverse = _numbered(tokens)
            del tokens
            learned = np.bincount(inverse[np.repeat(~held, n_tokens)], minlength=len(words))
            often = np.argsort(-np.bincount(inverse, minlength=len(words)), kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[often] = np.arange(len(words))
            block = save(folder, ids=column("doc_id").to_pylist(), held=held, n_tokens=n_tokens, words=words,
                          often=often.astype(np.uint32), tokens=_planes(rank[inverse]))
            del inverse
            owner = (words % np.uint64(shards)).astype(np.int64)
            rows = []
            for shard in np.unique(owner):
                mine = owner == shard
                rows.append((block, int(shard), message(words=encode(words[mine] // np.uint64(shards)), learned=small(learned[mine]))))
            yield sent(rows)
    return run


def _answer_words(shards: int):
    """Each word's number among all words and its count in the learning texts, for every block that asks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in grouped(batches, "shard"):
            asked = [EliasFano(m["words"]).all() for _, _, m in rows]
            words, inverse = np.unique(np.concatenate(asked), return_inverse=True)
            learned = np.concatenate([from_small(m["learned"], len(a)) for a, (_, _, m) in zip(asked, rows, strict=True)])
            total = np.zeros(len(words), np.int64)
            np.add.at(total, inverse, learned)
            if len(words) * shards >= BEGIN:
                raise ValueError("words are numbered with 32 bits: too many different words")
            at = 0
            out = []
            for (block, _, _), mine in zip(rows, asked, strict=True):
                number = inverse[at:at + len(mine)]
                at += len(mine)
                out.append((block, shard, message(number=encode(number), total=small(total[number]))))
            batch = sent(out)
            first = lambda value: pa.array([value] + [0] * (len(out) - 1), pa.int64())  # noqa: B023, E731
            yield batch.append_column("learned", first(int(total.sum()))).append_column("different", first(int((total > 0).sum())))
    return run


# --- second round: pairs --------------------------------------------------------------------------------------------

def _local_tokens(block: dict) -> np.ndarray:
    """The block's tokens as places in its list of words."""
    return block["often"][_from_planes(block["tokens"])]


def _pairs(tokens: np.ndarray, n_tokens: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different (context, word) pairs of a block in order as 64-bit keys, and the pair of each token; a text's first context is BEGIN."""
    word = number.astype(np.uint64)[tokens]
    keys = np.empty(len(word), np.uint64)
    keys[1:] = word[:-1]
    keys[np.cumsum(n_tokens) - n_tokens] = BEGIN
    keys <<= np.uint64(32)
    keys |= word
    del word
    return _numbered(keys)


def _pair_owner(keys: np.ndarray, shards: int, often: np.ndarray) -> np.ndarray:
    """Shard of each pair: by context, but spread by pair where the context is one of the ``often`` ones."""
    context = keys >> np.uint64(32)
    spread = np.isin(context, often)
    return (mixed(np.where(spread, keys, context)) % np.uint64(shards)).astype(np.int64)


def _often(contexts: np.ndarray, counts: np.ndarray, n_tokens: int, shards: int) -> np.ndarray:
    """Contexts with more than a quarter of a shard's even share of the tokens; the same for every block."""
    return contexts[counts > n_tokens / (4 * shards)]


def _block_numbers(block: dict, rows: list[tuple[str, int, dict]], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Number and learned count of each of the block's words, from the answers of the first round."""
    owner = (block["words"] % np.uint64(shards)).astype(np.int64)
    number, total = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
    for _, shard, body in rows:
        mine = np.flatnonzero(owner == shard)
        number[mine] = EliasFano(body["number"]).all().astype(np.int64) * shards + shard
        total[mine] = from_small(body["total"], len(mine))
    return number, total


def _contexts(keys: np.ndarray, number: np.ndarray, total: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Different contexts of the pairs and their learned counts."""
    contexts = np.unique(keys >> np.uint64(32)).astype(np.int64)
    order = np.argsort(number, kind="stable")
    at = np.minimum(np.searchsorted(number[order], contexts), max(len(number) - 1, 0))
    counts = np.where(contexts == int(BEGIN), texts, total[order][at])
    return contexts, counts


def _block_pairs(folder: str, shards: int, n_tokens: int, texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, rows in grouped(batches, "block"):
            block = load(path)
            number, total = _block_numbers(block, rows, shards)
            known = save(folder, number=_planes(number), total=small(total))
            keys, inverse = _pairs(_local_tokens(block), block["n_tokens"], number)
            learned = np.bincount(inverse[np.repeat(~block["held"], block["n_tokens"])], minlength=len(keys))
            del inverse
            contexts, counts = _contexts(keys, number, total, texts)
            often = _often(contexts, counts, n_tokens, shards)
            owner = _pair_owner(keys, shards, often.astype(np.uint64))
            everywhere = np.isin(contexts, often)
            home = (mixed(contexts.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            by_owner, by_home = np.argsort(owner, kind="stable"), np.argsort(home, kind="stable")
            pair_cut = np.searchsorted(owner[by_owner], np.arange(shards + 1))
            home_cut = np.searchsorted(home[by_home], np.arange(shards + 1))
            wide = np.flatnonzero(everywhere)
            for shard in range(shards):
                mine = by_owner[pair_cut[shard]:pair_cut[shard + 1]]
                here = np.unique(np.concatenate([by_home[home_cut[shard]:home_cut[shard + 1]], wide]))
                if len(mine) or len(here):
                    yield sent([(f"{path} {known}", shard, message(contexts=encode(contexts[here]), counts=small(counts[here]),
                                                                   n=len(here), pairs=encode(keys[mine]), learned=small(learned[mine])))])
    return run


def _codes(learned: np.ndarray, counts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """16-bit codes of the pairs' discounted probabilities, worked out in place."""
    p = learned - DISCOUNT
    np.maximum(p, 0, out=p)
    p /= (counts + CONFIDENCE)[rank]
    np.log2(p, out=p)
    p /= LOG_RANGE
    p += 1
    p *= 65534
    np.floor(p, out=p)
    p += 1
    return np.maximum(p, 1, out=p).astype("<u2")


class TrieShard:
    """The pairs of one shard as a two-level trie in memory-mapped files.

    First level: context numbers, and pointers to where each context's successors begin, both ascending. Second level:
    successors relative to their context, each as its word plus the last number of the context before, so the whole level ascends and its
    numbers stay as small as the words allow; with a 16-bit code of the discounted probability each. A context's two pointers
    bound its range, the number in front of the range is its base, and base plus word is looked for by successor search in that range alone.
    """

    def __init__(self, contexts: np.ndarray, counts: np.ndarray, keys: np.ndarray, learned: np.ndarray, folder: str) -> None:
        seen = learned > 0
        if not seen.all():
            keys, learned = keys[seen], learned[seen]
        rank = np.searchsorted(contexts, keys >> np.uint64(32))
        codes = _codes(learned, counts, rank)
        self.codes = np.frombuffer(self._file(folder, codes.tobytes()), "<u2") if len(codes) else codes
        del seen, codes
        word = keys & np.uint64((1 << 32) - 1)
        pointers = np.searchsorted(rank, np.arange(len(contexts) + 1)).astype(np.uint64)
        self.contexts = self._mapped(folder, encode(contexts))
        self.pointers = self._mapped(folder, encode(pointers))
        largest = np.zeros(len(contexts), np.uint64)  # of each context's words, which ascend
        some = np.flatnonzero(np.diff(pointers.astype(np.int64)))
        largest[some] = word[pointers[some + 1].astype(np.int64) - 1]
        base = np.cumsum(largest) - largest
        word += base[rank]
        del rank
        self.words = self._mapped(folder, encode(word))
        self.successors = np.diff(pointers).astype(np.int64)

    @staticmethod
    def _file(folder: str, data: bytes) -> np.ndarray:
        with tempfile.NamedTemporaryFile(dir=folder, delete=False) as out:
            out.write(data)
        return np.memmap(out.name, np.uint8, mode="r")

    def _mapped(self, folder: str, data: bytes) -> EliasFano:
        return EliasFano(self._file(folder, data))

    def codes_of(self, keys: np.ndarray) -> np.ndarray:
        """Codes of (context, word) keys; 0 for pairs that were not learned."""
        out = np.zeros(len(keys), np.uint16)
        rank, known = self.contexts.successor(keys >> np.uint64(32))
        asked = np.flatnonzero(known)
        begin, end = (self.pointers.at(rank[asked] + k).astype(np.int64) for k in (0, 1))
        base = np.zeros(len(asked), np.uint64)
        behind = np.flatnonzero((begin > 0) & (begin < end))
        base[behind] = self.words.at(begin[behind] - 1)
        at, found = self.words.successor_within(base + (keys[asked] & np.uint64((1 << 32) - 1)), begin, end)
        out[asked[found]] = self.codes[at[found]]
        return out


def _learned_pairs(bodies: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """The learned pairs of all blocks that ask, in order, and their counts."""
    lists = [EliasFano(m["pairs"]) for m in bodies]
    asked = np.empty(sum(x.n for x in lists), np.uint64)
    learned, at = np.empty(len(asked), np.int64), 0
    for m, x in zip(bodies, lists, strict=True):
        asked[at:at + x.n], learned[at:at + x.n] = x.all(), from_small(m["learned"], x.n)
        at += x.n
    some = learned > 0
    asked, learned = asked[some], learned[some]
    keys, place = _numbered(asked)
    del asked
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, place, learned)
    return keys, total


def _answer_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard, rows in grouped(batches, "shard"):
        named = [EliasFano(m["contexts"]).all() for _, _, m in rows]
        contexts, first = np.unique(np.concatenate(named), return_index=True)
        counts = np.concatenate([from_small(m["counts"], m["n"]) for _, _, m in rows])[first]
        with tempfile.TemporaryDirectory(prefix="trie-") as folder:
            trie = TrieShard(contexts, counts, *_learned_pairs([m for _, _, m in rows]), folder)
            for (block, _, m), own in zip(rows, named, strict=True):
                yield sent([(block, shard, message(codes=zlib.compress(trie.codes_of(EliasFano(m["pairs"]).all()).astype("<u2").tobytes(), 1),
                                                     successors=small(trie.successors[np.searchsorted(contexts, own)])))])
            del trie


# --- last round: scores ---------------------------------------------------------------------------------------------

def _scores(shards: int, n_tokens: int, different: int, texts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for paths, rows in grouped(batches, "block"):
            path, known = paths.split(" ")
            block, words = load(path), load(known)
            number = _from_planes(words["number"])
            total = from_small(words["total"], len(number))
            tokens = _local_tokens(block)
            keys, inverse = _pairs(tokens, block["n_tokens"], number)
            contexts, counts = _contexts(keys, number, total, texts)
            often = _often(contexts, counts, n_tokens, shards)
            owner = _pair_owner(keys, shards, often.astype(np.uint64))
            home = (mixed(contexts.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
            everywhere = np.isin(contexts, often)
            codes, successors = np.zeros(len(keys), np.uint16), np.zeros(len(contexts), np.int64)
            for _, shard, body in rows:
                mine = np.flatnonzero(owner == shard)
                codes[mine] = np.frombuffer(zlib.decompress(body["codes"]), "<u2")
                here = np.flatnonzero((home == shard) | everywhere)
                successors[here] += from_small(body["successors"], len(here))
            seen = np.where(codes > 0, 2.0 ** (LOG_RANGE * ((codes.astype(float) - 1) / 65534 - 1)), 0.0)
            rank = np.searchsorted(contexts, (keys >> np.uint64(32)).astype(np.int64))
            rest = (DISCOUNT * successors + CONFIDENCE) / (counts + CONFIDENCE)
            plain = (total + ADD) / (n_tokens + ADD * (different + 1))
            logs = rest[rank][inverse]
            logs *= plain[tokens]
            logs += seen[inverse]
            np.log10(logs, out=logs)
            del inverse
            at = np.cumsum(block["n_tokens"]) - block["n_tokens"]
            sums = lambda x: np.add.reduceat(x, at)  # noqa: B023, E731
            yield pa.record_batch([pa.array(block["ids"], pa.int64()), pa.array(block["held"]), pa.array(block["n_tokens"].astype(np.int64)),
                                   pa.array(sums((total > 0)[tokens].astype(np.int64))), pa.array(np.full(len(at), n_tokens)),
                                   pa.array(sums(np.log10(plain)[tokens])), pa.array(sums(logs))],
                                  ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def score(docs: DataFrame, parts: int = 10, fold: int = 0) -> DataFrame:
    """Learn from the texts outside the held-out fold and score all texts.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams, added 0.1) and score (log10 probability
    of the text under the bigram model). Tokens are words with A-Z lowered, told apart by 64-bit hashes, and one end per
    text; null text is empty, so its only token is the end. Repeated rows are counted and scored one by one. If no text
    is left to learn from, scores are those of no counts. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "lm-blocks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", in_fold(F.col("doc_id"), parts, fold).alias("held_out"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (6 * SHARD_TOKENS)))
    tasks = block_tasks(spark, size, BLOCK_BYTES)
    asked = written(rows.mapInArrow(_block_words(folder, shards), MESSAGE), "lm-words")
    answers = written(by_shard(asked, shards).mapInArrow(_answer_words(shards), MESSAGE + ", learned long, different long"), "lm-counts")
    n_tokens, different = (x or 0 for x in answers.agg(F.sum("learned"), F.sum("different")).first())
    texts = rows.filter(~F.col("held_out")).count()
    pairs = by_block(answers, tasks).mapInArrow(_block_pairs(folder, shards, n_tokens, texts), MESSAGE)
    found = by_shard(pairs, shards).mapInArrow(_answer_pairs, MESSAGE)
    return by_block(found, tasks).mapInArrow(
        _scores(shards, n_tokens, different, texts),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
