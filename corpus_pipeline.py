"""The corpus pipeline: language ID, exact dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all documents its predecessor kept. All but the last return the
columns of ``docs``; the last returns the mixed corpus. A stage numbers its rows by file and place:
operators get the numbers for ids, so decisions on a row hold for that row alone, also where its doc_id is null or repeated. Inside, columns go by their
place, so none can clash with a name used here. An empty table stays empty. Ties between rows with the same doc_id go to the row read first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitalog import files
from vitalog.llm import decontamination, exact_dedup, language_id, mixing, simhash
from vitalog.llm.common import in_fold, written
from vitalog.operators.sized_join import if_small, join_group_rows
from vitalog.session import configure, scratch, scratch_dir

#: A text whose best language has less than this probability is in no language the model knows well enough.
LEAST_LANGUAGE_SCORE = 0.4
#: Parts the ids are dealt into by their checksum, and the part the language model doesn't learn from.
LANGUAGE_PARTS, LANGUAGE_FOLD = 4, 2
#: Operator 1's contract: words of a shingle, and bits in which linked fingerprints may differ.
SHINGLE_WORDS, MOST_BITS = 3, 2
#: Bits of a row's number that count inside its file.
PLACE_BITS = 40
#: Numbers of dropped rows are broadcast up to this many, by count: as files they are a tenth of what they take in memory, on the driver too.
BROADCAST_DROPPED = 1_000_000


def _numbered(docs: DataFrame, label: str) -> DataFrame:
    """The columns by their place (c0, c1, ...) and row: a number from the file and the place in it; a table that isn't read from files is written first."""
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    try:
        placed = docs.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("at"), *columns)
    except AnalysisException:
        return written(docs.select(F.monotonically_increasing_id().alias("row"), *columns), f"pipeline-{label}")
    names = placed.select("path").distinct().withColumn("file", F.row_number().over(Window.orderBy("path")).cast("long"))  # a row per file
    names = written(names, f"pipeline-{label}")
    return placed.join(if_small(names) or names, "path").withColumn("row", F.shiftleft("file", PLACE_BITS) + F.col("at")).drop("path", "at", "file")


def _texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, text) with the number of the row for an id."""
    return rows.select(F.col("row").alias("doc_id"), F.col(f"c{docs.columns.index('text')}").cast("string").alias("text"))


def _without(docs: DataFrame, rows: DataFrame, dropped: DataFrame, label: str) -> DataFrame:
    """The documents whose number is not in the one column of ``dropped``."""
    dropped = written(dropped.toDF("row"), f"pipeline-{label}")
    return rows.join(if_small(dropped, BROADCAST_DROPPED) or dropped.hint("merge"), "row", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _all_but_one(docs: DataFrame, rows: DataFrame, groups: DataFrame, smallest: bool, label: str) -> DataFrame:
    """The documents but those of a group (row, group) whose id is not its smallest (or largest); a row without id stays only among such."""
    doc_id = F.col(f"c{docs.columns.index('doc_id')}").cast("long")
    held = written(groups.join(rows.select("row", doc_id.alias("doc_id")), "row"), f"pipeline-{label}-groups")
    if smallest:
        kept = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    else:
        kept = F.max(F.struct(F.col("doc_id").isNotNull(), "doc_id", (-F.col("row")).alias("less"), "row"))
    chosen = held.groupBy("group").agg(kept["row"].alias("kept"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return _without(docs, rows, join_group_rows(held, chosen, ["group"]).filter("row <> kept").select("row"), label)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters, and those no language fits."""
    learned = docs.filter(~in_fold(F.col("doc_id"), LANGUAGE_PARTS, LANGUAGE_FOLD))  # as operator 3 learns
    rows = _numbered(docs, "language-rows")
    told = language_id.identify(_texts(docs, rows), language_id.fit(learned))
    rejected = told.filter((F.col("lang_pred") == language_id.UNKNOWN) | (F.col("score") < LEAST_LANGUAGE_SCORE))
    return _without(docs, rows, rejected.select("doc_id"), "language")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, whole and but for the case of A-Z, keep the row with the largest id."""
    rows = _numbered(docs, "exact-rows")
    told = exact_dedup.exact_copies(_texts(docs, rows)).filter("group_size > 1")
    return _all_but_one(docs, rows, told.select(F.col("doc_id").alias("row"), F.col("keep_id").alias("group")), False, "exact")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by their SimHash fingerprints keep the row with the smallest id."""
    rows = _numbered(docs, "near-rows")
    told = simhash.near_duplicates(_texts(docs, rows), width=SHINGLE_WORDS, tau=MOST_BITS)
    return _all_but_one(docs, rows, told.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")), True, "near")


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    rows = _numbered(docs, "leak-rows")
    found = decontamination.contaminated(_texts(docs, rows), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, rows, found.select("doc_id").distinct(), "leaks")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: a row per document and epoch, shortened where the budget ends."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", leak_stage),
    ("mixing", mix_stage),
]

#: Language ID, fingerprint links and edit matching are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each written as Parquet and read again by the next.

    What a stage kept for itself is removed when its result is written, and its result when the next one's is.
    """
    docs, before = configure(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_dir(spark, f"pipeline-{name}", kept=True)
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            files.delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
