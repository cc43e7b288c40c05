"""Questions asked of the export itself, without an import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import attribute_contains
from ..session import checkpointed
from ..sources.markup import NAMED, POSITION, SEARCHED, attributes, start_tags, with_names
from .sized_join import if_small


def _named(found: DataFrame) -> DataFrame:
    """Elements with the names that questions ask for; landed elements have them already."""
    return found if set(NAMED.values()) <= set(found.columns) else with_names(found)


def structure(found: DataFrame) -> DataFrame:
    """``kind, name``: the distinct element names, record types, workout types and sources.

    One pass over the elements; the four sets come out of their distinct combinations.
    """
    tag = F.col("tag")

    def entry(kind: str, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.nullif(name, F.lit("")).alias("name"))

    # Each combination of names goes on once.
    combinations = (
        _named(found).filter(F.col("kind") != "close")
        .select("tag", F.col("name_type").alias("type"), F.col("name_source").alias("source"),
                F.col("name_activity").alias("activity"))
        .distinct()
    )
    pairs = combinations.select(F.inline(F.array(
        entry("root_elements", tag),
        entry("record_types", F.when(tag == "Record", F.col("type"))),
        entry("workout_types", F.when(tag == "Workout", F.col("activity"))),
        entry("sources", F.when(tag == "Record", F.col("source"))),
    )))
    return pairs.filter(F.col("name").isNotNull()).distinct()


def tag_counts(found: DataFrame, tags: tuple[str, ...] | None = None) -> DataFrame:
    """How often each element name occurs, or only the given ones."""
    wanted = found.filter(F.col("kind") != "close")
    if tags is not None:
        wanted = wanted.filter(F.col("tag").isin(*tags))
    return wanted.groupBy("tag").agg(F.count(F.lit(1)).alias("count"))


def tags_in_text(df: DataFrame, column: str) -> DataFrame:
    """How often each element name opens in a column of markup text."""
    names = F.regexp_extract_all(F.col(column), F.lit(r"<([A-Za-z][A-Za-z0-9]*)"), F.lit(1))
    return (df.select(F.explode(names).alias("tag"))
            .groupBy("tag").agg(F.count(F.lit(1)).alias("count")))


def _first(found: DataFrame, condition: Column, limit: int) -> DataFrame:
    """The first matches in document order. At least one is returned, also for a limit of 0."""
    return found.filter(condition).orderBy(*POSITION).limit(max(1, limit))


def _may_hold(text: Column, needle: str) -> Column:
    """False only where no attribute can hold the needle as it is written; cheap to test."""
    if not needle or any(c.isspace() for c in needle):
        return F.lit(True)
    return text.contains(needle) | text.contains("&")


def search_elements(found: DataFrame, query: str = "", max_results: int = 50) -> DataFrame:
    """Records and workouts with the query in any attribute value, whatever the case."""
    likely = found.filter(F.col("tag").isin(*SEARCHED)
                          & _may_hold(F.lower(F.col("inside")), query.lower()))
    return _first(start_tags(likely), attribute_contains(F.col("attrs"), query), max_results)


def elements_by_type(found: DataFrame, record_type: str = "", limit: int = 20) -> DataFrame:
    """Records of exactly one type."""
    of_type = (F.col("tag") == "Record") & (F.col("name_type") == F.lit(record_type))
    return start_tags(_first(_named(found), of_type & (F.col("kind") != "close"), limit))


def escaped(text: Column) -> Column:
    """Attribute text as it must be written between double quotes."""
    out = text
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(plain), F.lit(reference))
    return out


def tag_text(tag: Column, attrs: Column, kind: Column) -> Column:
    """A tag as XML text."""
    written = F.array_join(F.transform(
        F.map_entries(attrs),
        lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escaped(e["value"]), F.lit('"'))), "")
    return F.when(kind == "close", F.concat(F.lit("</"), tag, F.lit(">"))).otherwise(
        F.concat(F.lit("<"), tag, written, F.when(kind == "empty", " />").otherwise(">")))


def _after(ordinal: str, block: str, hit: str) -> Column:
    """Whether a tag stands behind the place of a hit in its file."""
    return (F.col(block) > F.col(f"{hit}.block")) | (
        (F.col(block) == F.col(f"{hit}.block")) & (F.col(ordinal) > F.col(f"{hit}.ordinal")))


def as_xml(found: DataFrame, hits: DataFrame) -> DataFrame:
    """The hits as complete XML elements with everything inside them, in document order.

    ``hits`` must come from a ``limit``; it is computed when this is called. A hit that opens ends at the next closing tag of its
    own depth, which is looked up on positions alone; then the tags from its begin to its end are read. The hits are few, so both
    are joins with a broadcast side and no text is moved but what is shown. A hit inside another is shown in it and by itself.
    """
    hits = checkpointed(hits.select(*POSITION, "kind", "depth"))
    opened = hits.filter(F.col("kind") == "open")
    closing = found.filter(F.col("kind") == "close").select("file", "depth", F.col("block").alias("end_block"), F.col("ordinal").alias("end_ordinal"))
    few = if_small(opened) or opened
    ends = (
        closing.alias("c").join(few.alias("h"), (F.col("c.file") == F.col("h.file")) & (F.col("c.depth") == F.col("h.depth"))
                                & _after("c.end_ordinal", "c.end_block", "h"))
        .groupBy("h.file", "h.block", "h.ordinal").agg(F.min(F.struct("end_block", "end_ordinal")).alias("end"))
    )
    ranges = checkpointed(ends.select("file", "block", "ordinal", "end.end_block", "end.end_ordinal").unionByName(
        hits.filter(F.col("kind") == "empty").select(
            "file", "block", "ordinal", F.col("block").alias("end_block"), F.col("ordinal").alias("end_ordinal"))))
    tag = F.col("t.tag")
    at = (F.col("t.block") == F.col("h.block")) & (F.col("t.ordinal") == F.col("h.ordinal"))
    until = (F.col("t.block") < F.col("h.end_block")) | (
        (F.col("t.block") == F.col("h.end_block")) & (F.col("t.ordinal") <= F.col("h.end_ordinal")))
    shown = found.select("file", "block", "ordinal", "kind", "tag", "inside").alias("t").join(
        (if_small(ranges) or ranges).alias("h"),
        (F.col("t.file") == F.col("h.file")) & (at | _after("t.ordinal", "t.block", "h")) & until)
    parts = shown.select(
        F.col("h.file").alias("file"), F.col("h.block").alias("hit_block"), F.col("h.ordinal").alias("hit_ordinal"),
        F.struct(F.col("t.block").alias("block"), F.col("t.ordinal").alias("ordinal"),
                 tag_text(tag, attributes(F.col("t.inside"), tag), F.col("t.kind")).alias("xml")).alias("piece"))
    pieces = F.sort_array(F.collect_list("piece"))
    return (
        parts.groupBy("file", F.col("hit_block").alias("block"), F.col("hit_ordinal").alias("ordinal"))
        .agg(F.array_join(F.transform(pieces, lambda p: p["xml"]), "").alias("xml"))
        .orderBy(*POSITION)
    )


def hit_count(hits: DataFrame) -> DataFrame:
    """Number of rows that were returned after the cut."""
    return hits.agg(F.count(F.lit(1)).alias("hits"))
