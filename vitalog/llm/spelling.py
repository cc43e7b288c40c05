"""Spelling variants: words one edit apart, found by walking a frontier of states through a distributed trie.

The words are range-sorted, as they are and reversed, and every block of sorted words gives its part of two radix tries: nodes are known by a hash of
their prefix, edges carry the letters between two nodes. A node is kept where words of the block part or end, or where other blocks say that theirs do:
a prefix that several blocks share begins the first or last word of each, so a block tells the others about its nodes on those two paths alone.

Two words one edit apart agree up to the edit or from it on, and one of these parts holds at least half of the longer word. So a word's
edit-free states, known from its own path, may take their edit from the middle on, in the forward trie or in the reversed one. Rounds
then join all states (word, position, node) that had their edit with the edges of their nodes, until none is left; states that end with their word
on a node where another word ends are neighbours. Only replacements by a larger letter and deletions are walked: their mirror images are the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.sized_join import if_small
from .common import LOWER, UPPER, written

RUN = "[a-zÀ-ÿ]"
#: States of one node (or words of one form) that a task of a join should see; the rest meet copies of the node's edges elsewhere.
HOT = 50_000
BLOCK_WORDS = 10_000
_TRIE = "side int, kind int, node long, text string, child long, n long, pos array<int>, nodes array<long>"
WORD_ROW, EDGE_ROW = 0, 1


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, drop_every: int = 97, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters with their number of occurrences.

    Of every ``drop_every``-th occurrence, told by the checksum of id and run, one letter is left out (0: none). A null id counts as empty.
    """
    folded = F.translate(F.col(text_col), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(folded, F.lit(RUN + "{%d,}" % least_length), F.lit(0))).alias("run"))
    word = F.col("run")
    if drop_every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        short = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(F.col("h") % drop_every == 0, short).otherwise(F.col("run"))
    counted = runs.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def common(a: str, b: str) -> int:
    """Number of leading letters two words share."""
    for i, (x, y) in enumerate(zip(a, b)):  # noqa: B905 - the shorter one ends it
        if x != y:
            return i
    return min(len(a), len(b))


def partings(words: list[str]) -> tuple[list[int], list[tuple[int, ...]], list[tuple[int, ...]]]:
    """For sorted words: what each shares with the one before, and the lengths at which its path parts from words before and behind it."""
    n = len(words)
    shared = [0] + [common(words[i - 1], words[i]) for i in range(1, n)]

    def walk(order: range, step: int) -> list[tuple[int, ...]]:
        stack, out = [], [()] * n
        for i in order:
            border = shared[max(i, i - step)]
            while stack and stack[-1] > border:
                stack.pop()
            if not stack or stack[-1] < border:
                stack.append(border)
            out[i] = tuple(stack)
        return out

    return shared, walk(range(1, n), 1), walk(range(n - 2, -1, -1), -1)


def paths(words: list[str], on_first: list[int], on_last: list[int]) -> tuple[list[list[int]], list[int]]:
    """For sorted words: the lengths of the prefixes kept on each word's path, and what it shares with the word before.

    ``on_first`` and ``on_last`` are lengths at which other blocks keep prefixes of the first and the last word.
    """
    shared, before, behind = partings(words)
    n = len(words)
    of_first, of_last = [len(words[0])] * n, [len(words[-1])] * n
    for i in range(1, n):
        of_first[i] = min(of_first[i - 1], shared[i])
    for i in range(n - 2, -1, -1):
        of_last[i] = min(of_last[i + 1], shared[i + 1])
    kept = [sorted({0, len(w), *before[i], *behind[i], *(at for at in on_first if at <= of_first[i]), *(at for at in on_last if at <= of_last[i])})
            for i, w in enumerate(words)]
    return kept, shared


def _node(prefix: str, side: int) -> int:
    value = xxhash.xxh64_intdigest(prefix.encode(), seed=side)
    return value - (1 << 64) if value >> 63 else value


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack the sorted words of a task into blocks of one side each."""
    seq = 0
    held: list[tuple] = []

    def block():
        sides, words, counts, parts = zip(*held, strict=True)
        return pa.record_batch([pa.array([parts[0]], pa.int32()), pa.array([seq], pa.int32()), pa.array([sides[0]], pa.int32()), pa.array([words[0]]),
                                pa.array([words[-1]]), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))],
                               ["part", "seq", "side", "first", "last", "words", "counts"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (len(held) >= BLOCK_WORDS or held[-1][0] != row[0]):
                yield block()
                held, seq = [], seq + 1
            held.append(row)
    if held:
        yield block()


def _border_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = batch.to_pydict()
        left = [common(a, b) if a is not None else 0 for a, b in zip(got["previous"], got["first"], strict=True)]
        right = [common(a, b) if b is not None else 0 for a, b in zip(got["last"], got["following"], strict=True)]
        yield pa.record_batch([batch.column("part"), batch.column("seq"), pa.array(left, pa.int32()), pa.array(right, pa.int32())],
                              ["part", "seq", "left", "right"])


def _shared_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of each block that are also prefixes of words in the block before or behind it."""
    for batch in batches:
        for row in batch.to_pylist():
            words, side, left, right = (row[c] for c in ("words", "side", "left", "right"))
            _, before, behind = partings(words)
            nodes = {_node(words[0][:at], side) for at in (*behind[0], left) if at <= left}
            nodes |= {_node(words[-1][:at], side) for at in (*before[-1], right) if at <= right}
            yield pa.record_batch([pa.array(sorted(nodes), pa.int64())], ["node"])


def _tries(common_nodes: set[int]):
    """Rows of words, with the nodes from the middle of their path on, and rows of edges."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                yield _trie_rows(block, common_nodes)
    return run


def _trie_rows(block: dict, common_nodes: set[int]) -> pa.RecordBatch:
    side, words = block["side"], block["words"]
    out = {name: [] for name in ("side", "kind", "node", "text", "child", "n", "pos", "nodes")}

    def row(*values):
        for column, value in zip(out.values(), values, strict=True):
            column.append(value)

    on = [[at for at in range(border + 1) if _node(word[:at], side) in common_nodes]
          for word, border in ((words[0], block["left"]), (words[-1], block["right"]))]
    for word, n, path, known in zip(words, block["counts"], *paths(words, *on), strict=True):
        middle = len(word) // 2 if side == 0 else len(word) - len(word) // 2
        first = next(i for i, at in enumerate(path) if at >= middle)
        new = next(i for i, at in enumerate(path) if at > known)
        nodes = {at: _node(word[:at], side) for at in path[min(first, new - 1):]}
        row(side, WORD_ROW, nodes[len(word)], word, None, n, path[first:-1], [nodes[at] for at in path[first:-1]])
        for a, b in zip(path[new - 1:], path[new:]):  # noqa: B905
            row(side, EDGE_ROW, nodes[a], word[a:b], nodes[b], None, None, None)
    types = {"side": pa.int32(), "kind": pa.int32(), "node": pa.int64(), "text": pa.string(), "child": pa.int64(), "n": pa.int64(),
             "pos": pa.list_(pa.int32()), "nodes": pa.list_(pa.int64())}
    return pa.record_batch([pa.array(v, types[k]) for k, v in out.items()], list(out))


def _trie(words: DataFrame) -> DataFrame:
    """Both tries as rows of words and of edges."""
    sides = words.select(F.lit(0).alias("side"), "word", "n").union(words.select(F.lit(1).alias("side"), F.reverse("word").alias("word"), "n"))
    ranged = sides.repartitionByRange("side", "word").sortWithinPartitions("side", "word").withColumn("part", F.spark_partition_id())
    blocks = written(ranged.mapInArrow(_word_blocks, "part int, seq int, side int, first string, last string, words array<string>, counts array<long>"),
                     "spelling-blocks")
    in_order = W.partitionBy("side").orderBy("part", "seq")  # a row per block: its two outer words
    outer = blocks.select("part", "seq", "first", "last", F.lag("last").over(in_order).alias("previous"), F.lead("first").over(in_order).alias("following"))
    borders = written(outer.mapInArrow(_border_lengths, "part int, seq int, left int, right int"), "spelling-borders")
    bordered = blocks.drop("first", "last").join(F.broadcast(borders), ["part", "seq"])  # four numbers per block of words
    # to the driver: some nodes of two paths per block, far fewer than one per hundred words
    common_nodes = {r[0] for r in bordered.mapInArrow(_shared_nodes, "node long").distinct().collect()}
    return written(bordered.mapInArrow(_tries(common_nodes), _TRIE), "spelling-trie")


def _met(states: DataFrame, others: DataFrame, keys: list[str], how: str = "inner", hot: int | None = None) -> DataFrame:
    """Join states with rows of which a key has few; keys with more than ``hot`` states are spread over copies of those rows."""
    hot = hot or HOT
    full = states.groupBy(*keys).agg(F.count("*").alias("states")).filter(F.col("states") > hot)
    full = written(full.select(*keys, F.ceil(F.col("states") / hot).cast("int").alias("copies")), "spelling-hot")
    if full.isEmpty():
        return states.join(others, keys, how)
    full = if_small(full) or full  # a row for at least ``hot`` states each
    copies = F.coalesce("copies", F.lit(1))
    dealt = states.join(full, keys, "left").withColumn("copy", F.pmod(F.xxhash64("word"), copies).cast("int")).drop("copies")
    copied = others.join(full, keys, "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("copies")
    return dealt.join(copied, [*keys, "copy"], how).drop("copy")


def _letters(at: Column, n: Column | int) -> Column:
    """``n`` letters of the word from a position counted from 0."""
    return F.substring("word", at + 1, n if isinstance(n, Column) else F.lit(n))


def neighbours(words: DataFrame) -> DataFrame:
    """Pairs of words exactly one inserted, deleted or replaced code point apart, each once: (word, n, near, near_n).

    ``words`` has the columns word and n and is written by the caller; words are not repeated and not empty.
    """
    trie = _trie(words)
    own = trie.filter(F.col("kind") == WORD_ROW).select("side", "node", F.col("text").alias("word"), "n", "pos", "nodes")
    edges = trie.filter(F.col("kind") == EDGE_ROW).select(
        "node", F.col("text").alias("label"), "child", F.char_length("text").alias("m"), F.substring("text", 1, 1).alias("next"))
    edges = written(edges.distinct(), "spelling-edges")  # batches share their border words' nodes
    pos, end = F.col("pos"), F.char_length("word")
    free = own.select("side", "word", "n", F.explode(F.arrays_zip("pos", "nodes")).alias("at")).select("side", "word", "n", "at.pos", F.col("at.nodes").alias("node"))
    # a deletion stays on its node; of a run of equal letters the last one goes
    deleted = free.filter((pos == end - 1) | (_letters(pos, 1) != _letters(pos + 1, 1))).withColumn("pos", pos + 1)
    tail = F.substring("label", F.lit(2), F.col("m"))
    replaced = _met(free, edges, ["node"]).filter(
        (F.col("next") > _letters(pos, 1)) & (pos + F.col("m") <= end) & (tail == _letters(pos + 1, F.col("m") - 1)))
    replaced = replaced.select("side", "word", "n", (pos + F.col("m")).alias("pos"), F.col("child").alias("node"))
    frontier = written(deleted.filter(pos < end).union(replaced), "spelling-frontier")
    ended = [deleted.filter(pos == end), frontier.filter(pos == end)]
    while True:
        states = frontier.filter(pos < end).withColumn("next", _letters(pos, 1))
        if states.isEmpty():
            break
        met = _met(states, edges, ["node", "next"]).filter(F.col("label") == _letters(pos, F.col("m")))
        frontier = written(met.select("side", "word", "n", (pos + F.col("m")).alias("pos"), F.col("child").alias("node")), "spelling-frontier")
        ended.append(frontier.filter(pos == end))
    final = ended[0]
    for more in ended[1:]:
        final = final.union(more)
    ends = own.select("side", "node", F.col("word").alias("near"), F.col("n").alias("near_n"))
    found = _met(written(final.select("side", "word", "n", "node"), "spelling-ended"), ends, ["side", "node"])
    # nodes are hashes: the words themselves decide
    found = found.filter((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    ahead = lambda c: F.when(F.col("side") == 1, F.reverse(c)).otherwise(F.col(c))
    both = found.select("side", ahead("word").alias("word"), "n", ahead("near").alias("near"), "near_n")
    # what begins alike up to the middle has been found in the forward trie
    half = F.floor(F.char_length("word") / 2).cast("int")
    twice = (F.col("side") == 1) & (F.substring("word", F.lit(1), half) == F.substring("near", F.lit(1), half))
    return both.filter(~twice).drop("side")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: pointers to forms are doubled until they end."""
    up = written(forms.select("word", F.col("form").alias("at")), "spelling-forms")
    while True:
        onward = up.select(F.col("word").alias("at"), F.col("at").alias("further"))
        up = written(_met(up, onward, ["at"], "left").select("word", F.coalesce("further", "at").alias("at"), F.col("further").isNotNull().alias("moved")),
                     "spelling-roots")
        if up.filter("moved").isEmpty():
            return up.select("word", F.col("at").alias("root"))
        up = up.drop("moved")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """Each word's accepted form: its near word of largest n (ties: the smallest word), where that is at least ``ratio`` times as frequent.

    ``words`` has the columns word and n, without repeats. Returns word, form, root (the last of the chain of forms, or the word itself), n, n_near,
    form_n; the number of rounds is that of the nested parting points behind the middle of a word, not its length.
    """
    words = written(words.select("word", "n"), "spelling-words")
    pairs = written(neighbours(words), "spelling-pairs")
    both = pairs.union(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best"))
    told = words.join(best, "word", "left")
    holds = -F.col("best.less") >= ratio * F.col("n")
    told = written(told.select("word", F.when(holds, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(holds, -F.col("best.less")).alias("form_n")), "spelling-told")
    roots = _roots(told.filter("form IS NOT NULL"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, drop_every: int = 97, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The variants among the words of whole texts; see :func:`word_counts` and :func:`variants`.

    Null and empty texts hold no words, repeated rows count again, ties go to the smallest word; an empty table gives an empty result and other
    columns are ignored. A run of letters of any length is one word.
    """
    return variants(word_counts(docs, least_length, least_count, drop_every, id_col, text_col), ratio)


# Near words share what is left when the code point at their edit is taken out, or replaced by a blank.
ORACLE = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{C0}-\\x{FF}]{5,}')) AS run
  FROM documents),
spelt AS (SELECT doc_id, run, count(*) AS times, doc_id::VARCHAR || ':' || run AS s FROM runs GROUP BY doc_id, run),
bytes AS (
  SELECT run, times, flatten(list_transform(range(len(s)), lambda i: CASE WHEN ord(s[i + 1]) < 128 THEN [ord(s[i + 1])]
    ELSE [192 + (ord(s[i + 1]) >> 6), 128 + (ord(s[i + 1]) & 63)] END)) AS b FROM spelt),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT)) AS h FROM bytes, steps),
made AS (
  SELECT CASE WHEN h % 97 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, times FROM hashed),
words AS (SELECT word, sum(times)::BIGINT AS n FROM made WHERE len(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
holes AS (
  SELECT word, n, unnest(range(len(word))) AS i FROM words),
cut AS (SELECT word, n, word[:i] AS a, word[i + 2:] AS z FROM holes),
pairs AS (
  SELECT x.word, y.word AS near, y.n AS near_n FROM cut x JOIN cut y ON x.a = y.a AND x.z = y.z AND x.word <> y.word AND len(x.word) = len(y.word)
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.a || c.z = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.a || c.z = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(near_n) AS top FROM pairs GROUP BY word),
firsts AS (SELECT p.word, min(near) AS near FROM pairs p JOIN best b ON p.word = b.word AND p.near_n = b.top GROUP BY p.word),
told AS (
  SELECT w.word, CASE WHEN b.top >= 2 * w.n THEN f.near END AS form, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near,
    CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word LEFT JOIN firsts f ON w.word = f.word),
climb(word, top) AS (
  SELECT word, word FROM told
  UNION ALL SELECT c.word, t.form FROM climb c JOIN told t ON c.top = t.word WHERE t.form IS NOT NULL)
SELECT t.word, t.form, c.top AS root, t.n, t.n_near, t.form_n
FROM told t JOIN climb c ON t.word = c.word JOIN told e ON e.word = c.top AND e.form IS NULL
"""
