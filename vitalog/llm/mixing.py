"""Mixing sources to target weights with DataFrame operations only.

Every document gets a hash-random key; documents are ordered by it within their source, summed up by
distributed prefix sums, and the mix takes whole epochs of a source plus the documents in front of its
exact budget. The document at the cut is taken in part, so that a source gives exactly its budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import word_count, written

BUCKET_ROWS = 50_000


def _ranked_sources(sources: DataFrame) -> DataFrame:
    """Number the sources by code point, null last, without gathering them in one task."""
    ranged = written(sources.repartitionByRange("no_source", "src")
                     .withColumn("part", F.spark_partition_id()), "mix-sources")
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    # one row per partition, not per source
    before = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("part").orderBy("no_source", "src"))
    return ranged.withColumn("at", within).join(before, "part").select(
        "no_source", "src", "source_size", (F.col("at") + F.col("before") - 1).alias("rank"))


def targets(sized: DataFrame, weights: tuple[int, ...], share: float, most_repeats: int) -> DataFrame:
    """One row per source: its size and its target in words.

    Sources share ``share`` of all words by weight. A target stops at ``most_repeats`` times its source's
    size; what it leaves is shared again by weight until nobody is above. The level at which that
    ends is found by passes over the source rows; each pass fixes at least one more source.
    """
    sources = sized.groupBy("no_source", "src").agg(F.sum("size").alias("source_size"))
    ranked = _ranked_sources(sources)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighted = written(ranked.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
                       .withColumn("cap", F.col("source_size") * most_repeats), "mix-weights")
    total, all_weights = weighted.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = (total or 0) * share
    level = wanted / all_weights if all_weights else 0.0
    while True:
        open_ = F.col("cap") > F.col("weight") * F.lit(level)
        closed, still = weighted.agg(F.sum(F.when(~open_, F.col("cap")).otherwise(0)),
                                     F.sum(F.when(open_, F.col("weight")).otherwise(0))).first()
        if not still:
            level = float("inf")
            break
        following = (wanted - closed) / still
        if following <= level:
            break
        level = following
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    target = F.when(F.col("cap") == 0, F.lit(0.0)).otherwise(target)
    return weighted.select("no_source", "src", "source_size", target.alias("target"))


def _plan(docs: DataFrame, carried: list[Column], weights, share, most_repeats, id_col, text_col, source_col) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("no_source"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("src"), word_count(F.col(text_col)).alias("size"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("key"), *carried)
    sized = written(rows, "mix-sizes")
    goal = targets(sized.select("no_source", "src", "size"), weights, share, most_repeats)
    # Keys are uniform, so their leading digits are ranges of equal size: no sampling pass is needed.
    at_least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(at_least, min(16 ** 6, sized.count() // BUCKET_ROWS))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / F.lit(16 ** 8)).cast("int")
    bucketed = sized.withColumn("bucket", bucket)
    by = ["no_source", "src"]
    sums = bucketed.groupBy(*by, "bucket").agg(F.sum("size").alias("bucket_size"))
    offsets = sums.select(*by, "bucket", (F.sum("bucket_size").over(
        W.partitionBy(*by).orderBy("bucket")) - F.col("bucket_size")).alias("offset"))
    budget = F.floor(F.col("target") + 0.5)
    cuts = offsets.join(goal, by).withColumn("budget", budget).withColumn(
        "epochs", F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("budget") / F.col("source_size")))
    ).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    running = F.sum("size").over(W.partitionBy(*by, "bucket").orderBy("key", "doc_id", "size")
                                 .rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = bucketed.withColumn("running", running).join(cuts, [*by, "bucket"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("offset") - F.col("running")))
    return placed.withColumn("part", part.cast("long")).withColumn("epochs", F.col("epochs").cast("long")).withColumn(
        "taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most_repeats: int = 3,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How many words of each document the mix takes, repeats counted.

    Returns doc_id, source, size, source_size, target, taken. Null text has size 0; a null source is
    a source of its own, ranked last. Rows that share an id are ordered by size; equal rows get equal
    or neighbouring shares in any order. An empty table gives an empty result; other columns are ignored.
    """
    out = _plan(docs, [], weights, share, most_repeats, id_col, text_col, source_col)
    source = F.when(~F.col("no_source"), F.col("src"))
    return out.select("doc_id", source.alias("source"), "size", "source_size", "target", "taken")


def _free(name: str, columns: list[str]) -> str:
    """``name``, with as many underscores behind it as it takes to be none of ``columns``."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0,
                    most_repeats: int = 3) -> DataFrame:
    """The mixed corpus: one row per document and epoch, the document at the cut shortened.

    Returns the columns of ``docs`` (doc_id, text and source among them), then mix_epoch and mix_taken, the words of this row. Should ``docs``
    have columns of these names, they stay as they are and the new ones get an underscore more. Texts of size 0 belong to no epoch and are left out.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"))  # no name can clash
    plan = written(mix(docs, weights, share, most_repeats).select(
        F.col("doc_id").alias("mix_id"), F.col("size").alias("mix_size"), F.col("taken").alias("mix_total")), "mix-plan")
    if plan.groupBy("mix_id").count().filter("count > 1").isEmpty():
        rows = whole.join(plan.filter("mix_total > 0"), F.col("document.doc_id").eqNullSafe(F.col("mix_id"))).drop("mix_id")
    else:  # an id doesn't tell its row: let the rows take part themselves
        named = whole.select("document", F.col("document.doc_id"), F.col("document.text"), F.col("document.source"))
        placed = _plan(named, [F.col("document")], weights, share, most_repeats, "doc_id", "text", "source").filter("taken > 0")
        rows = placed.select("document", F.col("size").alias("mix_size"), F.col("taken").alias("mix_total"))
    last = F.ceil(F.col("mix_total") / F.col("mix_size")).cast("int")
    rows = rows.withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), last)))
    rows = rows.withColumn("mix_taken", F.least(F.col("mix_size"), F.col("mix_total") - (F.col("mix_epoch") - 1) * F.col("mix_size")))
    text = F.col("document.text")
    words = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    head = F.array_join(F.slice(words, F.lit(1), F.col("mix_taken").cast("int")), " ")
    text = F.when(F.col("mix_taken") == F.col("mix_size"), text).otherwise(head)
    return rows.select(*[(text if c == "text" else F.col("document").getField(c)).alias(c) for c in docs.columns],
                       F.col("mix_epoch").alias(_free("mix_epoch", docs.columns)), F.col("mix_taken").alias(_free("mix_taken", docs.columns)))


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         md5(doc_id::VARCHAR) AS k FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size,
          1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source),
filled AS (SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio,
             sum(source_size) OVER () AS total FROM src),
tries AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
             / (sum(weight) OVER (ORDER BY ratio DESC, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::DOUBLE AS level FROM filled),
chosen AS (SELECT max(level) FILTER (WHERE level <= ratio) AS level FROM tries),
goal AS (SELECT source, source_size, least(cap::DOUBLE, weight * chosen.level) AS target FROM filled, chosen),
cut AS (SELECT *, floor(target + 0.5)::BIGINT AS budget FROM goal),
placed AS (SELECT s.doc_id, s.source, s.size, c.source_size, c.target, c.budget,
             CASE WHEN c.source_size = 0 THEN 0 ELSE c.budget // c.source_size END AS epochs,
             sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id) - s.size AS before
           FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, size, source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM placed
"""
