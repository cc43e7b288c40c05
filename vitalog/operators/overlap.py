"""Time that several sources cover together, by sweeping over intervals cut at cell borders.

All intervals are cut at the borders of days, and those of busy days at the borders of smaller cells, so every cell can be swept on its own and the
result doesn't depend on the cells. Within a cell a source's intervals are merged into islands (a running maximum of ends over sorted starts);
how long a source has covered up to an instant is then a running sum over its islands' ends, and what it covers of any other interval is the
difference of two such sums. Each record therefore meets the sources of its cell, never their records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, scratch_dir
from ..sinks.tables import write_parquet
from .filters import of_type
from .sized_join import if_small, join_group_rows

DAY = 86_400_000_000
#: Different intervals of a type that one cell should hold, and the smallest cell: a day halved so often (its microseconds divide by 2^13).
CELL_ROWS, MOST_HALVINGS = 100_000, 13
#: Halvings of a busy cell before its pieces are counted again, so a record is never in more than 2^4 + 1 pieces at once; pieces a task sweeps.
HALVINGS, TASK_PIECES = 4, 50_000
CELL = ["type", "day", "level", "cell"]
_PIECE = ["source", "s", "e", "rate", "point", "instants"]


def _cut(rows: DataFrame, keys: list[str], size: Column, number: str) -> DataFrame:
    """Rows cut at the borders of cells of a ``size``, numbered by ``number``: the first and the last piece of each; the pieces between, which fill
    their cells, are added up to one per cell and source. So a long record adds two rows, however small the cells are. An instant is in the cell it stands in.
    """
    first = F.floor(F.col("s") / size)
    placed = rows.withColumns({"_size": size, "_first": first, "_last": F.greatest(first, F.floor((F.col("e") - 1) / size))})
    low, high = F.col(number) * F.col("_size"), (F.col(number) + 1) * F.col("_size")
    edges = placed.withColumn(number, F.explode(F.array_distinct(F.array("_first", "_last"))))
    edges = edges.withColumns({"s": F.greatest(F.col("s"), low), "e": F.least(F.col("e"), high)})
    between = placed.filter("_last - _first > 1").withColumn(number, F.explode(F.sequence(F.col("_first") + 1, F.col("_last") - 1)))
    between = between.withColumns({"s": low, "e": high}).groupBy(*keys, number, "source", "s", "e").agg(
        F.sum("rate").alias("rate"), F.sum("point").alias("point"), F.sum("instants").cast("int").alias("instants"))
    columns = [*keys, number, *_PIECE]
    return edges.select(columns).union(between.select(columns))


def _written(pieces: DataFrame) -> DataFrame:
    """Written to the shared folder, compressed, and read back."""
    path = scratch_dir(pieces.sparkSession, "pieces", kept=True)
    write_parquet(pieces, path)
    return pieces.sparkSession.read.schema(pieces.schema).parquet(path)


def _pieces(records: DataFrame, cell_rows: int) -> DataFrame:
    """(type, day, level, cell, source, s, e, rate, point, instants): intervals inside a cell, microseconds from its day; equal ones, and those that fill a
    cell, are added up."""
    start, end = F.unix_micros("startDate"), F.unix_micros("endDate")
    known = records.filter("type IS NOT NULL AND startDate IS NOT NULL AND endDate >= startDate").select(
        "type", F.coalesce("sourceName", F.lit("")).alias("source"), start.alias("s"), end.alias("e"),
        F.coalesce(F.col("value"), F.lit(0.0)).alias("value"))
    equal = known.groupBy("type", "source", "s", "e").agg(F.sum("value").alias("value"), F.count("*").alias("n"))
    length = F.nullif(F.col("e") - F.col("s"), F.lit(0))
    rows = equal.withColumns({"rate": F.coalesce(F.col("value") / length, F.lit(0.0)), "point": F.when(length.isNull(), F.col("value")).otherwise(0.0),
                              "instants": F.when(length.isNull(), F.col("n")).otherwise(0).cast("int")})
    low = F.col("day") * DAY
    rows = _cut(rows, ["type"], F.lit(DAY), "day").withColumns({"s": F.col("s") - low, "e": F.col("e") - low})
    found, settled = rows.withColumns({"level": F.lit(0), "cell": F.lit(0).cast("long")}).select(*CELL, *_PIECE), []
    size = F.expr(f"shiftright({DAY}L, level)")
    filling = (F.col("s") == F.col("cell") * size) & (F.col("e") == (F.col("cell") + 1) * size)
    while True:  # busy cells are halved until they hold few enough pieces beside those that fill them, or are the smallest
        found = _written(found)
        busy = found.filter(~filling).groupBy(*CELL).agg(F.count("*").alias("n")).filter((F.col("n") > cell_rows) & (F.col("level") < MOST_HALVINGS))
        halvings = F.least(F.lit(HALVINGS), MOST_HALVINGS - F.col("level"), F.ceil(F.log2(F.col("n") / cell_rows))).cast("int")
        busy = checkpointed(busy.select(*CELL, halvings.alias("halvings")))
        if busy.isEmpty():
            break
        settled.append(found.join(if_small(busy) or busy, CELL, "left_anti"))
        split = join_group_rows(found, busy, CELL).withColumn("level", F.col("level") + F.col("halvings")).drop("cell")
        found = _cut(split, ["type", "day", "level"], size, "cell").select(*CELL, *_PIECE)
    for cold in settled:
        found = found.union(cold)
    return found


def _islands(pieces: DataFrame) -> DataFrame:
    """(type, day, level, cell, source, s, e): what each source covers of a cell, as disjoint intervals."""
    along = Window.partitionBy(*CELL, "source").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*CELL, "source").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)
    lasting = pieces.filter("e > s").select(*CELL, "source", "s", "e").withColumn("reached", F.max("e").over(along))
    begins = F.col("reached").isNull() | (F.col("s") > F.col("reached"))
    numbered = lasting.withColumn("island", F.sum(begins.cast("int")).over(upto))
    return numbered.groupBy(*CELL, "source", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def _ends(rows: DataFrame, at: str, sign: int, turn: int = 0, **weighed: Column) -> DataFrame:
    names = ("w_length", "w_value", "w_point", "w_instants")
    zero = {"w_length": F.lit(0).cast("long"), "w_value": F.lit(0.0), "w_point": F.lit(0.0), "w_instants": F.lit(0).cast("long")}
    return rows.select(*CELL, F.col("source").alias("asking"), F.col(at).alias("t"), F.lit(turn).alias("turn"), *[
        (weighed[n] * sign if n in weighed else zero[n]).alias(n) for n in names])


def source_overlap_time(records: DataFrame, record_type: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """How long two sources recorded the same type at once, and what sums over both count twice.

    One row per type and pair of sources (by name) that have time or instants in common: ``overlap_seconds``, the time both cover, however many of
    their records overlap among themselves; ``first_value`` and ``second_value``, the part of each source's values that falls into time the other
    covers, values spread evenly over their records; ``double_counted``, the smaller of them; ``instants``, the records without length that fall into the other's time
    (``[start, end)``), which count whole. Records without a date or ending before they start are left out, a missing source is the empty name. Runs a counting pass when called.
    """
    pieces = _pieces(of_type(records, record_type), cell_rows)
    islands = _islands(pieces)
    lasting, instant = pieces.filter("e > s"), pieces.filter("e = s")
    one = F.lit(1).cast("long")
    points = (_ends(islands, "e", 1, -1, w_length=one).union(_ends(islands, "s", -1, 1, w_length=one))
              .union(_ends(lasting, "e", 1, w_value=F.col("rate"))).union(_ends(lasting, "s", -1, w_value=F.col("rate")))
              .union(_ends(instant, "s", 1, w_point=F.col("point"), w_instants=F.col("instants").cast("long"))))
    # Dealt out by cell once: what follows needs no further exchange, and a point meets the other sources of its cell, not their records, inside its task.
    spark = records.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces.count() // TASK_PIECES)
    points = points.repartition(tasks, *CELL).groupBy(*CELL, "asking", "t").agg(
        *[F.sum(n).alias(n) for n in ("w_length", "w_value", "w_point", "w_instants")], F.sum("turn").alias("turn"))
    marked = F.col("turn") != 0
    covering = F.collect_set(F.when(marked, F.col("asking"))).over(Window.partitionBy(*CELL))
    here = F.struct(F.col("asking").alias("source"), F.col("turn").alias("turn"))
    others = F.transform(F.array_remove("sources", F.col("asking")), lambda s: F.struct(s.alias("source"), F.lit(0).cast("long").alias("turn")))
    both = points.withColumn("sources", covering).withColumn(
        "met", F.explode(F.concat(others, F.when(marked, F.array(here)).otherwise(F.array().cast("array<struct<source:string,turn:bigint>>")))))
    both = both.drop("sources", "turn").select("*", "met.*").drop("met")
    # a source's own marks come before questions about the same instant
    upto = Window.partitionBy(*CELL, "source").orderBy("t", F.col("turn") == 0).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumns({"open": F.sum("turn").over(upto), "closed": F.sum(-F.col("turn") * F.col("t")).over(upto)}).filter("turn = 0")
    covered, inside = F.col("closed") + F.col("open") * F.col("t"), (F.col("open") > 0).cast("int")
    sums = swept.groupBy("type", "asking", "source").agg(
        F.sum(F.col("w_length") * covered).alias("time"), F.sum(F.col("w_value") * covered + F.col("w_point") * inside).alias("value"),
        F.sum(F.col("w_instants") * inside).alias("instants"))
    ahead = F.col("asking") < F.col("source")
    paired = sums.groupBy("type", F.least("asking", "source").alias("first_source"), F.greatest("asking", "source").alias("second_source")).agg(
        (F.max("time") / 1e6).alias("overlap_seconds"), F.coalesce(F.sum(F.when(ahead, F.col("value"))), F.lit(0.0)).alias("first_value"),
        F.coalesce(F.sum(F.when(~ahead, F.col("value"))), F.lit(0.0)).alias("second_value"), F.sum("instants").alias("instants"))
    shared = paired.filter((F.col("overlap_seconds") > 0) | (F.col("instants") > 0))
    return shared.withColumn("double_counted", F.least("first_value", "second_value"))
