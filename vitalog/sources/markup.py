"""A splittable scan of XML elements, for exports too large for one task per file.

A "<" can only begin markup, so the text reader cuts the files at "<" wherever a split starts.
What a tag means can depend on text before it: whether a comment is still open, how many elements
are open, which workout a statistic stands in. Those are running values over the document. They
are computed inside each split, reduced to one row per split, carried over the splits of a file,
and added back, so no task ever has to see a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.dates import lenient_iso_text, parse_date
from ..functions.numeric import safe_float
from ..operators.sized_join import BROADCAST_ROWS
from ..session import scratch_dir
from . import normalize

# A split is known by a hash of its file and its offset, which sort and compare faster than paths.
SPLIT = ["file_id", "block"]
POSITION = ["file", "block", "ordinal"]

# XML syntax.
_NAME = r"^/?([\p{L}_:][\p{L}\p{N}_:.\-]*)"
_ATTRIBUTE = r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*')"""
_WHOLE_NAME = r"[\p{L}_:][\p{L}\p{N}\p{M}_:.\-·]*+"
_WHOLE_TAG = rf"""^(/{_WHOLE_NAME}\s*+|{_WHOLE_NAME}(?:\s++{_WHOLE_NAME}\s*+=\s*+(?:"[^"]*+"|'[^']*+'))*+\s*+/?+)>"""
_DECLARATION = r"^!(?:DOCTYPE|ELEMENT|ATTLIST|ENTITY|NOTATION)\s"
# Tags as exports write nearly all of theirs: names of letters, one blank before an attribute, no ">" in values, blanks alone behind them. They are told by one
# look; all other pieces are taken apart by the patterns above.
_USUAL_NAME = r"[A-Za-z_][A-Za-z0-9_.:]*+"
_USUAL_VALUE = r"[^\"<>&]*+(?:&(?:lt|gt|quot|apos|amp);[^\"<>&]*+)*+"
_USUAL_TAG = rf"""^(?:/{_USUAL_NAME}|{_USUAL_NAME}(?: {_USUAL_NAME}="{_USUAL_VALUE}")*+ ?+/?+)>\s*+\z"""
_HIDDEN_END = r"(?s)^.*(?:-->|\]\]>)"
_WHOLE_COMMENT = r"(?s)^!--(?:[^-]|-(?!-))*+-->"
_BLANK = "^[\\s\ufeff]*$"

# What a piece holds beside its tag: nothing, text (or character data), a declaration, or it is blank altogether.
NOTHING, TEXT, DECLARATION, BLANK = 0, 1, 2, 3


def _order():
    return Window.partitionBy(*SPLIT).orderBy("ordinal")


def _earlier_in_split():
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def _earlier_splits():
    return Window.partitionBy("file_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)


def _same_file(found: Column) -> Column:
    """The file of a split; fails the job should two files ever share a hash."""
    return F.when(F.min(found) == F.max(found), F.min(found)).otherwise(
        F.raise_error(F.lit("two files have the same hash")).cast("string"))


def scan_tags(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every piece of markup: where it stands, whether it opens, closes or is empty, its name.

    ``ordinal`` grows along the document inside one split. ``fits`` says whether the piece is markup as the grammar has it, with all references
    known, ``beside`` what it holds beside its tag; both count where the piece is not hidden. ``beside_end`` holds for one in which a hidden span ends.
    """
    pieces = (
        spark.read.option("lineSep", "<").option("recursiveFileLookup", "true").text(path)
        .select(F.col("value").alias("text"),
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("ordinal"))
    )
    text = F.col("text")
    usual, inside = F.col("usual"), F.col("inside")
    until_end = F.substring_index(text, ">", 1)
    # nothing, if the piece is no tag as the grammar has it
    whole = F.when(usual, until_end).otherwise(F.regexp_extract(text, _WHOLE_TAG, 1))
    tag = F.when(usual, F.btrim(F.substring_index(until_end, " ", 1), F.lit("/"))).otherwise(F.nullif(F.regexp_extract(text, _NAME, 1), F.lit("")))
    kind = (F.when(F.col("tag").isNull(), "other").when(text.startswith("/"), "close")
            .when(inside.endswith("/"), "empty").otherwise("open"))
    opens_hidden = ((text.startswith("!--") & ~text.contains("-->"))
                    | (text.startswith("![CDATA[") & ~text.contains("]]>")))
    hides = F.when(~usual & opens_hidden, F.lit(True)).when(
        ~usual & (text.contains("-->") | text.contains("]]>")), F.lit(False))
    return (pieces.withColumn("usual", text.rlike(_USUAL_TAG)).withColumns({"tag": tag, "inside": whole}).withColumns({"kind": kind, "hides": hides})
            .withColumn("behind", F.when(~usual, _behind())).withColumns({"fits": _fits(), "beside": _beside(), "beside_end": _beside_end()})
            .select(F.xxhash64("file").alias("file_id"), *POSITION, "kind", "tag", "inside", "hides", "fits", "beside", "beside_end"))


# Attributes of these are read one by one, where a repeated one is an error.
_READ = ("Record", "Workout", "WorkoutStatistics")


def _behind() -> Column:
    """The text behind a piece's tag, comment, character data or instruction."""
    text = F.col("text")
    return (F.when(F.col("kind") != "other", F.substring(text, F.length("inside") + 2, F.length(text)))
            .when(text.startswith("?"), F.substring_index(text, "?>", -1)).when(F.col("hides"), F.lit(""))
            .otherwise(F.regexp_replace(text, _HIDDEN_END, "")))


def _fits() -> Column:
    text, behind = F.col("text"), F.col("behind")
    names = F.regexp_extract_all(F.col("inside"), F.lit(_ATTRIBUTE), F.lit(1))
    once = F.col("tag").isin(*_READ) | ~F.col("inside").contains("=") | (F.size(names) == F.size(F.array_distinct(names)))
    hidden = text.startswith("!--") & (F.col("hides") | text.rlike(_WHOLE_COMMENT)) | text.startswith("![CDATA[")
    as_text = ~(behind.contains("&") & behind.rlike(_UNKNOWN_REFERENCE)) & ~behind.contains("]]>")
    # blanks stand before a file's first markup, which is counted later
    as_other = text.rlike(_BLANK) | (hidden & as_text) | text.rlike(_DECLARATION) | (text.startswith("?") & text.contains("?>") & as_text)
    known = ~(text.contains("&") & text.rlike(_UNKNOWN_REFERENCE))
    return F.coalesce(F.when(F.col("usual"), once).when(F.col("kind") == "other", as_other).otherwise((F.col("inside") != "") & as_text & known & once), F.lit(False))


def _beside() -> Column:
    text, behind = F.col("text"), F.col("behind")
    # behind a comment in a declaration stands what closes that
    closing = text.startswith("!--") & behind.rlike("^\\s*\\]\\s*>\\s*$")
    return (F.when(F.col("usual"), NOTHING).when(text.rlike(_BLANK), BLANK).when(text.startswith("![CDATA["), TEXT)
            .when((F.col("kind") == "other") & (text.rlike(_DECLARATION) | closing), DECLARATION)
            .when(behind.rlike("\\S"), TEXT).otherwise(NOTHING)).cast("int")


def _beside_end() -> Column:
    behind = F.regexp_replace("text", _HIDDEN_END, "")
    closing = behind.rlike("^\\s*\\]\\s*>\\s*$")
    return F.when(~F.col("usual") & ~F.col("hides"), F.when(closing, DECLARATION).when(behind.rlike("\\S"), TEXT).otherwise(NOTHING)).cast("int")


def hidden_spans(tags: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame | None:
    """Where comments and character data hide tags: ``(after, until]`` of a split's ordinals; None, if nowhere.

    Found from a few narrow columns, written to the shared folder and counted when this is called. Spans are rare: up to ``broadcast_rows`` are
    broadcast, so that the text of the tags is not moved.
    """
    per_split = tags.groupBy(*SPLIT).agg(
        _same_file(F.col("file")).alias("file"),
        F.min(F.when(F.col("hides").isNotNull(), F.col("ordinal"))).alias("first_border"),
        F.max_by("hides", F.when(F.col("hides").isNotNull(), F.col("ordinal"))).alias("last_hides"))
    began_hidden = F.last("last_hides", ignorenulls=True).over(_earlier_splits())
    carried = (per_split.withColumn("began_hidden", began_hidden).filter("began_hidden")
               .filter(F.col("file").isNotNull())
               .select(*SPLIT, F.lit(-1).cast("bigint").alias("after"), F.col("first_border").alias("until")))
    inside = (tags.filter(F.col("hides").isNotNull()).select(*SPLIT, "ordinal", "hides")
              .withColumn("until", F.lead("ordinal").over(_order())).filter("hides")
              .select(*SPLIT, F.col("ordinal").alias("after"), "until"))
    spark, path = tags.sparkSession, scratch_dir(tags.sparkSession, "hidden")
    found = inside.unionByName(carried)
    found.write.parquet(path)
    spans = spark.read.schema(found.schema).parquet(path)
    n = spans.count()
    return None if not n else F.broadcast(spans) if n <= broadcast_rows else spans


def visible(wanted: DataFrame, spans: DataFrame | None) -> DataFrame:
    """The tags that stand outside comments and character data."""
    if spans is None:
        return wanted
    end = F.coalesce(F.col("s.until"), F.lit(2 ** 63 - 1))
    within = ((F.col("t.file_id") == F.col("s.file_id")) & (F.col("t.block") == F.col("s.block"))
              & (F.col("t.ordinal") > F.col("s.after")) & (F.col("t.ordinal") <= end))
    return wanted.alias("t").join(spans.alias("s"), within, "left_anti")


def span_ends(tags: DataFrame, spans: DataFrame) -> DataFrame:
    """The pieces in which hidden spans end; what stands behind the mark is shown again."""
    side = spans.filter("until IS NOT NULL").select(*SPLIT, F.col("until").alias("ordinal"))
    return tags.join(side, [*SPLIT, "ordinal"], "left_semi")


def elements(tags: DataFrame, spans: DataFrame | None, kept: Column | None = None,
             with_text: Column | None = None) -> DataFrame:
    """The visible tags with their depth (the root has depth 0).

    ``kept`` may leave out empty elements that are not asked for, as they do not change the
    depth of others; ``with_text`` names the tags whose attributes go along. ``tags`` is read several times; see ``landing``.
    """
    if with_text is not None:
        tags = tags.withColumn("inside", F.when(with_text, F.col("inside")))
    step = F.when(F.col("kind") == "open", 1).when(F.col("kind") == "close", -1).otherwise(0)
    wanted = tags.filter((F.col("kind") != "other") & (F.lit(True) if kept is None else kept))
    shown = visible(wanted, spans).withColumn("step", step.cast("bigint"))
    local = shown.withColumn("local", F.coalesce(F.sum("step").over(_earlier_in_split()), F.lit(0)))
    per_split = shown.groupBy(*SPLIT).agg(F.sum("step").alias("net"))
    carried = per_split.select(
        *SPLIT, F.coalesce(F.sum("net").over(_earlier_splits()), F.lit(0)).alias("began"))
    # A closing tag is as deep as the element it closes.
    depth = F.col("began") + F.col("local") - F.when(F.col("kind") == "close", 1).otherwise(0)
    # One row per split is small, and the tags are not moved for it.
    found = local.join(F.broadcast(carried), SPLIT).select(
        "file_id", *POSITION, "kind", "tag", "inside", depth.cast("int").alias("depth"))
    return found.withColumn("answers", _answers())


def _answers() -> Column:
    """For a closing tag: whether the tag before it at its depth opened that name; NULL where that stands in an earlier split.

    Opening and closing tags alternate at every depth, so what a closing tag closes is simply the one before.
    """
    before = Window.partitionBy(*SPLIT, "depth").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("kind") != "empty", F.concat("kind", F.lit(" "), "tag")), ignorenulls=True).over(before)
    return F.when(F.col("kind") == "close", opened == F.concat(F.lit("open "), F.col("tag")))


def malformed(tags: DataFrame, spans: DataFrame | None, found: DataFrame) -> DataFrame:
    """(file, what): what is wrong with files that are no well-formed documents, as far as a parser without a schema tells.

    ``tags`` are all pieces, ``found`` the elements, with all opening and closing tags among them. Every visible piece must be markup; every closing tag must
    answer the last tag at its depth, inside its split or, from one row per split and depth, across splits; and in each file one root must hold all
    tags and all text. Only aggregates per split go through an exchange.
    """
    unfit = visible(tags.filter(~F.col("fits")), spans).groupBy("file").agg(
        F.concat(F.lit("no markup: <"), F.coalesce(F.min("tag"), F.lit(""))).alias("what"))

    as_last = F.struct("kind", "tag")
    per_split = found.filter(F.col("kind") != "empty").groupBy(*SPLIT, "depth").agg(
        F.min("file").alias("file"), F.min_by(as_last, "ordinal").alias("first"), F.max_by(as_last, "ordinal").alias("last"), F.min("answers").alias("answers"),
        F.min_by("tag", F.when(~F.col("answers"), F.col("ordinal"))).alias("wrong"))
    along = Window.partitionBy("file_id", "depth").orderBy("block")
    joined = per_split.withColumns({"before": F.lag("last").over(along), "final": F.lead("block").over(along).isNull()})
    opens_before = F.coalesce(F.col("before.kind") == "open", F.lit(False))
    answered = F.when(F.col("first.kind") == "close", opens_before & F.coalesce(F.col("before.tag") == F.col("first.tag"), F.lit(False))).otherwise(~opens_before)
    bad = (F.col("depth") < 0) | ~F.coalesce("answers", F.lit(True)) | ~answered | (F.col("final") & (F.col("last.kind") == "open"))
    crossed = joined.filter(bad).groupBy("file").agg(F.concat(
        F.lit("not opened and closed in turn: "), F.first(F.coalesce("wrong", "first.tag"))).alias("what"))

    place, is_tag = F.struct("block", "ordinal"), F.col("kind") != "other"
    pieces = tags.select(*SPLIT, "file", "ordinal", "beside")
    shown = visible(pieces, spans)
    if spans is not None:  # a piece in which a comment ends is no tag, but its text counts
        ends = span_ends(tags.select(*SPLIT, "file", "ordinal", "beside_end"), spans)
        shown = shown.union(ends.select(*SPLIT, "file", "ordinal", F.col("beside_end").alias("beside")))
    per_file = shown.groupBy("file_id").agg(
        F.min("file").alias("file"),
        F.min(F.when(F.col("beside") == TEXT, place)).alias("first_text"), F.max(F.when(F.col("beside") == TEXT, place)).alias("last_text"),
        F.max(F.when(F.col("beside") == DECLARATION, place)).alias("last_declared"), F.sum((F.col("beside") == BLANK).cast("int")).alias("blanks"))
    tagged = visible(tags.select(*SPLIT, "ordinal", "kind").filter(is_tag), spans).groupBy("file_id").agg(
        F.count("*").alias("n"), F.min(place).alias("first_tag"), F.max(place).alias("last_tag"), F.max(F.col("kind") == "empty").alias("empties"))
    root = found.filter((F.col("depth") == 0) & (F.col("kind") != "empty")).groupBy("file_id").agg(
        F.sum((F.col("kind") == "open").cast("int")).alias("roots"), F.min(F.when(F.col("kind") == "open", place)).alias("root_start"), F.max(F.when(F.col("kind") == "close", place)).alias("root_end"))
    whole = per_file.join(tagged, "file_id", "left").join(root, "file_id", "left")
    alone = F.col("roots").isNull() & (F.col("n") == 1) & F.col("empties")
    one_root = F.coalesce(alone | ((F.col("roots") == 1) & (F.col("root_start") == F.col("first_tag")) & (F.col("root_end") == F.col("last_tag"))), F.lit(False))
    outside = (F.col("last_text") >= F.col("last_tag")) | (F.col("first_text") < F.col("first_tag")) | (F.col("last_declared") >= F.col("first_tag"))
    loose = whole.filter(~one_root | F.coalesce(outside, F.lit(False)) | (F.col("blanks") > 1)).select(
        "file", F.lit("something stands outside its one root element").alias("what"))
    return unfit.union(crossed).union(loose)


def check_closed(tags: DataFrame, spans: DataFrame | None) -> None:
    """Fail if in any file more, or less, is opened than closed: told by one sum per split, before depths are worked out on all tags."""
    step = F.when(F.col("kind") == "open", 1).otherwise(-1)
    marks = tags.filter(F.col("kind").isin("open", "close")).select(*SPLIT, "file", "ordinal", "kind")
    per_split = visible(marks, spans).groupBy(*SPLIT).agg(F.min("file").alias("file"), F.sum(step).alias("net"))
    wrong = per_split.groupBy("file_id").agg(F.min("file").alias("file"), F.sum("net").alias("net")).filter("net <> 0").first()
    if wrong is not None:
        raise ValueError(f"malformed XML in {wrong['file']}: not opened and closed in turn: {abs(wrong['net'])} tags too {'few' if wrong['net'] > 0 else 'many'} close")


def check_well_formed(tags: DataFrame, spans: DataFrame | None, found: DataFrame) -> None:
    """Fail if any file is malformed."""
    wrong = malformed(tags, spans, found).first()
    if wrong is not None:
        raise ValueError(f"malformed XML in {wrong['file']}: {wrong['what']}")


OWNER = ["owner_block", "owner_ordinal", "owner_depth"]


def with_owner(found: DataFrame, owners: tuple[str, ...]) -> DataFrame:
    """Add the position and depth of the ``owners`` element each tag belongs to, itself included.

    The three ``owner_*`` columns are NULL outside of any. Owners are taken not to contain one
    another.
    """
    is_owner = F.col("tag").isin(*owners)
    begins = is_owner & (F.col("kind") != "close")
    # What the tags after this one belong to, where this one changes it; depth -1 is "nothing".
    marked = found.withColumns({
        "mark_ordinal": F.when(is_owner, F.col("ordinal")),
        "mark_depth": F.when(is_owner, F.when(F.col("kind") == "open", F.col("depth")).otherwise(-1)),
    })

    def latest(name: str, over) -> Column:
        return F.last(name, ignorenulls=True).over(over)

    local = marked.withColumns({
        "local_ordinal": latest("mark_ordinal", _earlier_in_split()),
        "local_depth": latest("mark_depth", _earlier_in_split()),
    })
    per_split = marked.groupBy(*SPLIT).agg(
        F.max("mark_ordinal").alias("last_ordinal"),
        F.max_by("mark_depth", "mark_ordinal").alias("last_depth"),
    ).withColumn("last_block", F.when(F.col("last_ordinal").isNotNull(), F.col("block")))
    carried = per_split.select(
        *SPLIT, *[latest(f"last_{n}", _earlier_splits()).alias(f"carried_{n}")
                  for n in ("block", "ordinal", "depth")])

    here = F.col("local_ordinal").isNotNull()
    depth = F.when(here, F.col("local_depth")).otherwise(F.col("carried_depth"))
    inside = depth >= 0
    return local.join(F.broadcast(carried), SPLIT).select(
        *found.columns,
        F.when(begins, F.col("block")).when(inside & here, F.col("block"))
        .when(inside, F.col("carried_block")).alias("owner_block"),
        F.when(begins, F.col("ordinal")).when(inside & here, F.col("local_ordinal"))
        .when(inside, F.col("carried_ordinal")).alias("owner_ordinal"),
        F.when(begins, F.col("depth")).when(inside, depth).alias("owner_depth"),
    )


# The references every XML text may use; "&amp;" is resolved last.
_NAMED = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))
_UNKNOWN_REFERENCE = r"&(?!(?:lt|gt|quot|apos|amp|#[0-9]+|#x[0-9A-Fa-f]+);)"


def _named(text: Column) -> Column:
    for reference, character in _NAMED:
        text = F.replace(text, F.lit(reference), F.lit(character))
    return text


def decode(text: Column) -> Column:
    """Attribute text with line breaks as blanks and references such as ``&amp;`` resolved; unknown ones are an error."""
    blank = F.translate(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\r\t", "   ")
    wrapped = F.concat(F.lit("<r><v>"), blank, F.lit("</v></r>"))
    numbered = F.from_xml(wrapped, "v string", {"ignoreSurroundingSpaces": "false"})["v"]
    unknown = F.raise_error(F.concat(F.lit("undefined reference in: "), blank)).cast("string")
    return (F.when(~blank.contains("&"), blank)
            .when(blank.rlike(_UNKNOWN_REFERENCE), unknown)
            .when(blank.contains("&#"), F.coalesce(numbered, blank))
            .otherwise(_named(blank)))


def attributes(inside: Column, tag: Column) -> Column:
    """The attributes of a start tag as a map, in the order they are written.

    A double quote cannot occur in a double-quoted value, so cutting at them gives names and
    values in turn. Tags with a single-quoted value are matched by pattern.
    """
    written = F.substring(inside, F.length(tag) + 1, F.length(inside))

    def cut(pieces: Column) -> Column:
        names = F.filter(pieces, lambda _, i: (i % 2 == 0) & (i < F.size(pieces) - 1))
        return F.map_from_arrays(F.transform(names, lambda n: F.btrim(n, F.lit(" =\t\r\n"))),
                                 F.filter(pieces, lambda _, i: i % 2 == 1))

    # As the only element of an array the pieces are computed once and bound to a variable.
    by_quotes = F.element_at(F.transform(F.array(F.split(written, '"', -1)), cut), 1)
    by_pattern = F.map_from_arrays(
        F.regexp_extract_all(written, F.lit(_ATTRIBUTE), F.lit(1)),
        F.transform(F.regexp_extract_all(written, F.lit(_ATTRIBUTE), F.lit(2)),
                    lambda q: F.substring(q, F.lit(2), F.length(q) - 2)))
    single_quoted = inside.contains("'") & inside.rlike(r"=\s*'")
    as_written = F.when(single_quoted, by_pattern).otherwise(by_quotes)
    return F.when(inside.rlike(r"[&\n\r\t]"),
                  F.transform_values(as_written, lambda _, v: decode(v))).otherwise(as_written)


# No blanks that count as others, and no references whose text could be taken for a quote.
_USUAL_FORM = r"^[^&\n\r\t]*+(?:&(?:lt|gt|apos|amp);[^&\n\r\t]*+)*+\z"


def attribute_columns(tags: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Add ``attrs``, a struct of the named attributes of start tags, NULL where absent; a repeated attribute is an error.

    A tag written as ``<tag name="value" ...>`` that has none but the named attributes, each once, is cut at its quotes and its names are looked up
    among the pieces. All others go by :func:`attributes`.
    """
    inside = F.col("inside")
    written = F.substring(inside, F.length("tag") + 1, F.length(inside))
    cut = tags.withColumn("_pieces", F.when(inside.rlike(_USUAL_FORM), F.split(F.when(inside.contains("&"), _named(written)).otherwise(written), '"', -1)))
    # Names stand at the odd places; each that is found once stands at one of its own.
    placed = cut.withColumns({f"_at_{n}": F.array_position("_pieces", F.lit(f" {n}=")) for n in names})
    at = {n: F.col(f"_at_{n}") for n in names}
    odd = sum((F.when(p % 2 == 1, 1).otherwise(0) for p in at.values()), F.lit(0))
    behind = F.btrim(F.get("_pieces", F.size("_pieces") - 1), F.lit(" /"))
    usual = F.coalesce((odd * 2 + 1 == F.size("_pieces")) & (behind == ""), F.lit(False))
    checked = placed.withColumn("_usual", usual).withColumn(
        "_attrs", F.when(~F.col("_usual"), attributes(F.col("inside"), F.col("tag"))))

    def value(name: str) -> Column:
        here = F.when(at[name] > 0, F.get("_pieces", at[name].cast("int")))
        return F.when(F.col("_usual"), here).otherwise(F.col("_attrs")[name])

    return checked.withColumn("attrs", F.struct(*[value(n).alias(n) for n in names])).select(*tags.columns, "attrs")


# Attributes that questions ask for, and the columns they are kept in beside the elements.
NAMED = {"type": "name_type", "sourceName": "name_source", "workoutActivityType": "name_activity"}
SEARCHED = ("Record", "Workout")


def with_names(found: DataFrame) -> DataFrame:
    """Add the :data:`NAMED` attributes of records and workouts as columns, for filters that reach the scan."""
    asked = F.col("tag").isin(*SEARCHED) & (F.col("kind") != "close")
    known = tuple(dict.fromkeys([*schemas.RECORD_ATTRIBUTES, *schemas.WORKOUT_ATTRIBUTES, *NAMED]))
    named = attribute_columns(found.withColumn("_inside", F.col("inside")).withColumn("inside", F.when(asked, F.col("inside"))), known)
    return named.withColumn("inside", F.col("_inside")).select(*found.columns, *[F.col("attrs")[k].alias(v) for k, v in NAMED.items()])


def start_tags(found: DataFrame) -> DataFrame:
    """Elements only, with their attributes."""
    return found.filter(F.col("kind") != "close").withColumn(
        "attrs", attributes(F.col("inside"), F.col("tag")))


def _as_columns(found: DataFrame, names: tuple[str, ...], *extra: Column) -> DataFrame:
    """The named attributes of elements as columns."""
    tags = attribute_columns(found.filter(F.col("kind") != "close"), names)
    return tags.select(*extra, *[F.col("attrs")[n].alias(n) for n in names])


def records(found: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """``records`` rows from ``Record`` elements at any depth, behind the ``kept`` columns of the elements."""
    return normalize.records(_as_columns(found.filter(F.col("tag") == "Record"), schemas.RECORD_ATTRIBUTES, *map(F.col, kept)), kept)


def shown_records(tags: DataFrame, spans: DataFrame | None, kept: tuple[str, ...] = ()) -> DataFrame:
    """``records`` rows from tags. They need no depth, so the bulk of an export is imported without a shuffle."""
    return records(visible(tags.filter((F.col("tag") == "Record") & (F.col("kind") != "close")), spans), kept)


def enclosing_elements(tags: DataFrame, spans: DataFrame | None) -> DataFrame:
    """Workouts, statistics and all elements that can enclose others, with their depth; only the first two keep their text."""
    asked = F.col("tag").isin("Workout", "WorkoutStatistics")
    return elements(tags, spans, (F.col("kind") != "empty") | asked, asked)


def _workout_id(block: Column, ordinal: Column) -> Column:
    return F.concat_ws("-", F.hex("file_id"), block, ordinal)


def workouts(found: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """``workouts`` rows; ``workout_id`` names the position, so write the elements down first."""
    tags = found.filter(F.col("tag") == "Workout")
    return normalize.workouts(_as_columns(
        tags, schemas.WORKOUT_ATTRIBUTES, _workout_id(F.col("block"), F.col("ordinal")).alias("workout_id"), *map(F.col, kept)), kept)


def stats(found: DataFrame, absent: float | None = 0.0, kept: tuple[str, ...] = ()) -> DataFrame:
    """``stats`` rows from statistics written directly inside a workout."""
    wanted = found.filter(F.col("tag").isin("Workout", "WorkoutStatistics"))
    direct = with_owner(wanted, ("Workout",)).filter(
        (F.col("tag") == "WorkoutStatistics") & (F.col("depth") == F.col("owner_depth") + 1))
    return normalize.stats(_as_columns(
        direct, schemas.STAT_ATTRIBUTES,
        _workout_id(F.col("owner_block"), F.col("owner_ordinal")).alias("workout_id"), *map(F.col, kept)), absent, kept)


def documents(found: DataFrame) -> DataFrame:
    """One document per direct child of the root, whatever its name, all attributes kept.

    Malformed dates stay text: the ``...Text`` columns hold ISO 8601 with the written offset or
    the original text, the typed columns the instant or NULL.
    """
    attrs = F.col("attrs")
    children = start_tags(found.filter(F.col("depth") == 1))
    native_date = F.coalesce(parse_date(attrs["dateComponents"]),
                             F.try_to_timestamp(attrs["dateComponents"], F.lit("yyyy-MM-dd")))
    return children.select(
        "tag", "attrs",
        attrs["type"].alias("type"),
        attrs["sourceName"].alias("sourceName"),
        F.coalesce(attrs["value"], F.lit("")).alias("textvalue"),
        F.when(attrs["value"].isNotNull(), safe_float(attrs["value"])).alias("value"),
        parse_date(attrs["startDate"]).alias("startDate"),
        parse_date(attrs["endDate"]).alias("endDate"),
        F.when(attrs["startDate"].isNotNull(), parse_date(attrs["startDate"]))
        .otherwise(native_date).alias("dateComponents"),
        lenient_iso_text(attrs["startDate"]).alias("startDateText"),
        lenient_iso_text(attrs["endDate"]).alias("endDateText"),
        F.coalesce(lenient_iso_text(attrs["startDate"]), attrs["dateComponents"]).alias("dateComponentsText"),
        *POSITION,
    )
