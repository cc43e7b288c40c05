"""The import job: export files in, the three tables out."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import files, schemas
from ..session import scratch, scratch_dir
from ..sinks import buckets as cut
from ..sinks import tables as sinks
from . import markup, normalize
from .manifest import Manifest

STORED = {"records": schemas.RECORDS, "workouts": schemas.KEYED_WORKOUTS, "stats": schemas.KEYED_STATS}
PAIRED = ("workouts", "stats")

# Text of the files that one shuffle partition of an import should hold, and the least that one is worth; how much small ones are merged to, as shuffles
# store it: markup takes several times as much in memory, where a partition must be sorted without spilling.
SHUFFLE_BYTES, LEAST_BYTES, MERGED_BYTES = 32 << 20, 4 << 20, 8 << 20
_INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_MERGED = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


@dataclass(frozen=True)
class Tables:
    """The tables of all imports under one root.

    Every import writes a folder of its own, which counts from the moment a change that names it is in the store's log (see
    :mod:`~vitalog.sources.manifest`) and all three of its tables are complete: readers see all of an import or nothing of it, and a
    failed one changes nothing.
    """

    root: str

    def folder(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def log(self) -> Manifest:
        return Manifest(self.folder("_tables"))

    def imports(self, spark: SparkSession) -> list[dict]:
        """Name, layout and row counts of the imports that count."""
        return list(self.log.state(spark).current.values())

    def done(self, spark: SparkSession, name: str) -> dict[str, int] | None:
        """Rows of an import of that name since the last replacement, also where it has been compacted since."""
        return self.log.state(spark).done.get(name)

    def publish(self, spark: SparkSession, kind: str, entry: dict, names: list[str] | None = None) -> bool:
        """Make an import count: ``add`` it to the others, ``replace`` all, or ``compact`` the named ones into it.

        Returns whether it counts: a compaction doesn't if what it united is gone. Folders taken out stay for readers that hold them until the next time
        some are taken out.
        """
        state = self.log.publish(spark, {"kind": kind, "entry": entry, "names": names or []})
        for old in state.gone if kind != "add" else []:
            files.delete(spark, self.folder(old))
        return entry["name"] in state.current

    def paths(self, spark: SparkSession, name: str) -> list[tuple[str, str]]:
        """Folders and layout of a table in each import."""
        return [found for e in self.imports(spark) for found in self.paths_of(e, name)]

    def paths_of(self, entry: dict, name: str) -> list[tuple[str, str]]:
        folder = self.folder(entry["name"])
        if name == "records" or not entry.get("buckets"):
            return [(f"{folder}/{name}", entry["layout"] if name == "records" else "plain")]
        return [(f"{folder}/{name}_paired", "plain")] + ([(f"{folder}/{name}_hot", "plain")] if name == "stats" else [])

    def pairs(self, spark: SparkSession) -> list[tuple[DataFrame, DataFrame]]:
        """(workouts, stats) in parts that pair by ``workout_id`` only among themselves, cut alike where that needs no shuffle.

        None unless the store is one import whose tables are cut by workout (see :func:`pair_imports`): the same workout may be in two imports.
        """
        found = self.imports(spark)
        if len(found) != 1 or not found[0].get("buckets"):
            return []
        entry = found[0]
        schemas_of = tuple(STORED[t] for t in PAIRED)
        return cut.read_pairs(spark, self.folder(entry["name"]), PAIRED, schemas_of, "workout_id", entry["buckets"], entry["hot"])

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return self.read_imports(spark, name, self.imports(spark))

    def read_imports(self, spark: SparkSession, name: str, imports: list[dict]) -> DataFrame:
        schema = STORED[name]
        found = [f for e in imports for f in self.paths_of(e, name)]
        plain = [p for p, layout in found if layout != "sorted"]
        sorted_ = [p for p, layout in found if layout == "sorted"]
        parts = ([spark.read.schema(schema).parquet(*plain)] if plain else []) + (
            [sinks.read_by_type(spark, sorted_, schema)] if sorted_ else [])
        if not parts:
            return spark.createDataFrame([], schema)
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


# Text in a byte of a compressed file, about, and how much of such files one task should read: they are read whole, however a task's share is cut.
PACKED, PACKED_SPLIT = 8, 16 << 20
_ENDS_PACKED = r"\.(?:gz|deflate|bz2|zst|lz4|snappy)$"
_SPLIT_BYTES = "spark.sql.files.maxPartitionBytes"


def _text_bytes() -> Column:
    return F.col("length") * F.when(F.col("path").rlike(_ENDS_PACKED), PACKED).otherwise(1)


def text_bytes(path: str, length: int) -> int:
    """The same of one file."""
    return length * (PACKED if re.search(_ENDS_PACKED, path) else 1)


def _size(spark: SparkSession, path: str | list[str]) -> int:
    return _files(spark, path).agg(F.sum(_text_bytes())).first()[0] or 0


@contextmanager
def _small_splits_of_packed(spark: SparkSession, path: str | list[str]) -> Iterator[None]:
    """Tasks that each take few compressed files, as those hold several times their size."""
    before = spark.conf.get(_SPLIT_BYTES)
    if _files(spark, path).filter(F.col("path").rlike(_ENDS_PACKED)).select("path").isEmpty() or _as_bytes(spark, before) < PACKED_SPLIT:
        yield
        return
    spark.conf.set(_SPLIT_BYTES, PACKED_SPLIT)
    try:
        yield
    finally:
        spark.conf.set(_SPLIT_BYTES, before)


def _as_bytes(spark: SparkSession, size: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(str(size))


def file_sizes(spark: SparkSession, path: str | list[str]) -> tuple[int, int]:
    """Bytes of text in all files under ``path``, and in the largest one; contents are not read, and those of compressed files are guessed."""
    found = _files(spark, path)
    total, largest, n = found.agg(F.sum(_text_bytes()), F.max(_text_bytes()), F.count("*")).first()
    if n < len(found.inputFiles()):  # empty files are listed, but not read
        raise ValueError(f"malformed XML: an empty file in {path}")
    return total or 0, largest or 0


def parts_for(spark: SparkSession, size: int) -> int:
    """How many parts ``size`` bytes of text are worth."""
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BYTES))
    return max(1, few, size // SHUFFLE_BYTES)


@contextmanager
def shuffles_sized_for(spark: SparkSession, size: int) -> Iterator[None]:
    """Enough shuffle partitions for ``size`` bytes, and no more than that many are worth; small ones are merged again at run time."""
    wanted = {_INITIAL_PARTITIONS: parts_for(spark, size), _MERGED: MERGED_BYTES}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def land(df: DataFrame, path: str, parts: int) -> DataFrame:
    """Write once and read back: later steps start from files that survive lost executors.

    A split is read by one task, so its tags lie together; they are cut by split as they are written, and all that is worked out inside splits
    needs no shuffle of the text.
    """
    cut.write_in_place(df, path, markup.SPLIT, parts)
    return cut.read_in_place(df.sparkSession, path, df.schema)


def land_elements(spark: SparkSession, source: str | list[str], path: str | None = None) -> DataFrame:
    """Scan the markup once and keep its elements as Parquet, with the attributes that questions ask for as columns.

    The text is read and taken apart once, into tags; depth is then worked out on those. Malformed files are an error.
    """
    size, _ = file_sizes(spark, source)
    with shuffles_sized_for(spark, size), scratch(spark):
        tags = land_tags(spark, source, parts_for(spark, size))
        spans = markup.hidden_spans(tags)
        markup.check_closed(tags, spans)
        found = land(markup.with_names(markup.elements(tags, spans)), path or scratch_dir(spark, "elements", kept=True), parts_for(spark, size))
        markup.check_well_formed(tags, spans, found)
        return found


def landed_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements that :func:`land_elements` kept at ``path``, from any session."""
    return cut.read_in_place(spark, path)


def land_tags(spark: SparkSession, source: str | list[str], parts: int | None = None) -> DataFrame:
    """The tags of export files, kept in the shared folder in ``parts`` parts; as many as their size asks for, where none are named."""
    parts = parts_for(spark, _size(spark, source)) if parts is None else parts
    with _small_splits_of_packed(spark, source):
        return land(markup.scan_tags(spark, source), scratch_dir(spark, "tags"), parts)


def malformed_files(spark: SparkSession, source: str | list[str]) -> DataFrame:
    """(file, what) of the files that are no well-formed documents and would fail an import; empty files are not read here."""
    parts = parts_for(spark, _size(spark, source))
    tags = land_tags(spark, source, parts)
    spans = markup.hidden_spans(tags)
    return markup.malformed(tags, spans, land(markup.enclosing_elements(tags, spans), scratch_dir(spark, "enclosing"), parts))


def scan_tables(spark: SparkSession, source: str | list[str], absent: float | None = 0.0, size: int | None = None,
                kept: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The three tables of export files, however large a file is.

    The text is read once; tags, and the elements that workouts and statistics hang on, are kept in the shared folder.
    Malformed files are an error. ``size`` is that of the files, where it is known; ``kept`` are columns of the elements that stand before the tables' own.
    """
    size = _size(spark, source) if size is None else size
    with shuffles_sized_for(spark, size):
        tags = land_tags(spark, source, parts_for(spark, size))
        spans = markup.hidden_spans(tags)
        markup.check_closed(tags, spans)
        found = land(markup.enclosing_elements(tags, spans), scratch_dir(spark, "enclosing"), parts_for(spark, size))
        markup.check_well_formed(tags, spans, found)
    return {"records": markup.shown_records(tags, spans, kept), "workouts": markup.workouts(found, kept), "stats": markup.stats(found, absent, kept)}


def import_export(spark: SparkSession, source: str | list[str], target: str, mode: str = "overwrite", layout: str = "plain",
                  absent: float | None = 0.0, narrow: bool = False, name: str | None = None, buckets: int | None = None) -> dict[str, int]:
    """Import export files into ``records``, ``workouts`` and ``stats`` under ``target``; returns the rows written per table.

    The three tables count together, once all are complete; if anything fails, what was there before stays as it is.
    ``overwrite`` makes a repeated import idempotent, ``append`` adds to what is there. An import ``name`` that counts already is not
    repeated. ``layout="sorted"`` keeps ``records`` in one folder per type, sorted by time. ``absent=None`` keeps absent
    numbers of statistics NULL; ``narrow`` stores values in single precision and times in whole seconds. Workouts and statistics are
    cut alike by workout into ``buckets``; without a number, as many as their size asks for, and not at all where that is one (as 1 does).
    """
    tables, name = Tables(target), name or f"import-{uuid.uuid4().hex}"
    if layout not in ("plain", "sorted") or mode not in ("overwrite", "append"):
        raise ValueError(f"no such layout or mode: {layout}, {mode}")
    done = tables.done(spark, name)
    if done is not None:
        return done
    folder = tables.folder(name)
    size, _ = file_sizes(spark, source)
    try:
        with shuffles_sized_for(spark, size), scratch(spark):
            counts = {}
            for table, df in scan_tables(spark, source, absent, size).items():
                df = normalize.narrowed(df) if narrow and table == "records" else df
                path = f"{folder}/{table}"
                if table == "records" and layout == "sorted":
                    landing = scratch_dir(spark, "records")
                    counts[table] = sinks.write_counted(df, landing, "errorifexists")
                    sinks.write_sorted(spark.read.schema(df.schema).parquet(landing), path, mode="overwrite", by_type=True)
                else:
                    counts[table] = sinks.write_counted(df, path, "overwrite")
            cuts = _cut_by_workout(spark, folder, buckets)
        tables.publish(spark, "replace" if mode == "overwrite" else "add", {"name": name, "layout": layout, "rows": counts, **cuts})
    except BaseException:
        if tables.done(spark, name) is None:
            files.delete(spark, folder)
        raise
    return counts


def numbered_tables(spark: SparkSession, groups: list[list[str]], absent: float | None = 0.0) -> dict[str, DataFrame]:
    """The three tables of several groups of files, read in one scan; ``_group`` is the place of a row's group among them."""
    place = {path: n for n, group in enumerate(groups) for path in group}
    names = _files(spark, list(place)).select("path", F.xxhash64("_metadata.file_path").alias("file_id")).collect()
    if len(place) != sum(map(len, groups)) or {r["path"] for r in names} != set(place) or len({r["file_id"] for r in names}) != len(names):
        raise ValueError("the files of several groups must be told apart by their names")
    of_file = F.broadcast(spark.createDataFrame([(r["file_id"], place[r["path"]]) for r in names], "file_id long, _group int"))
    return {t: df.join(of_file, "file_id").drop("file_id") for t, df in scan_tables(spark, list(place), absent, kept=("file_id",)).items()}


def write_apart(df: DataFrame, staging: str, to: list[str]) -> list[int]:
    """Write the rows of each ``_group`` to the folder in its place of ``to``, by way of a folder beside those; returns their numbers of rows."""
    spark = df.sparkSession
    with cut.open_writers(spark):
        sinks.write_parquet(df, staging, "overwrite", ("_group",))
    stored = T.StructType([*df.drop("_group").schema.fields, T.StructField("_group", T.IntegerType())])
    rows = {r["_group"]: r["count"] for r in spark.read.schema(stored).parquet(staging).groupBy("_group").count().collect()}
    for n, path in enumerate(to):
        files.move(spark, f"{staging}/_group={n}", path)
    return [rows.get(n, 0) for n in range(len(to))]


def import_together(spark: SparkSession, groups: dict[str, list[str]], target: str, absent: float | None = 0.0, narrow: bool = False) -> dict[str, dict[str, int]]:
    """What :func:`import_export` with ``append`` does for each group of files, an import by its name, with one scan for all of them.

    Each import has its folder and its change of the log; they are published in turn once all are written. If a file is malformed none of them counts.
    """
    tables = Tables(target)
    done = {name: tables.done(spark, name) for name in groups}
    wanted = {name: paths for name, paths in groups.items() if done[name] is None}
    if not wanted:
        return done
    staging, folders = tables.folder(f"_together-{uuid.uuid4().hex}"), [tables.folder(name) for name in wanted]
    every = [path for paths in wanted.values() for path in paths]
    size, _ = file_sizes(spark, every)
    try:
        with shuffles_sized_for(spark, size), scratch(spark):
            counts = {}
            for table, df in numbered_tables(spark, list(wanted.values()), absent).items():
                df = normalize.narrowed(df) if narrow and table == "records" else df
                counts[table] = write_apart(df, f"{staging}/{table}", [f"{folder}/{table}" for folder in folders])
            cuts = [_cut_by_workout(spark, folder, None) for folder in folders]
        for n, name in enumerate(wanted):
            done[name] = {table: rows[n] for table, rows in counts.items()}
            tables.publish(spark, "add", {"name": name, "layout": "plain", "rows": done[name], **cuts[n]})
    except BaseException:
        for name, folder in zip(wanted, folders, strict=True):
            if tables.done(spark, name) is None:
                files.delete(spark, folder)
        raise
    finally:
        files.delete(spark, staging)
    return done


def _cut_by_workout(spark: SparkSession, folder: str, buckets: int | None) -> dict[str, int]:
    """Replace an import's plain workouts and statistics, which no log names yet, by ones cut by workout if they are large; what its entry says of that."""
    paths = [f"{folder}/{t}" for t in PAIRED]
    buckets = cut.bucket_count(max(files.size(spark, p) for p in paths)) if buckets is None else buckets
    if buckets < 2:
        return {}
    workouts, stats = (spark.read.schema(STORED[t]).parquet(p) for t, p in zip(PAIRED, paths, strict=True))
    hot = cut.write_pairs(workouts, stats, folder, PAIRED, "workout_id", buckets)
    for path in paths:
        files.delete(spark, path)
    return {"buckets": buckets, "hot": hot}


def pair_imports(spark: SparkSession, target: str, buckets: int | None = None, file_bytes: int = 128 << 20) -> int:
    """Unite all imports into one whose workouts and statistics are cut alike by workout; returns how many were united.

    Published as one change of the log, as a compaction is. Records are sorted if those of any import are.
    """
    tables = Tables(target)
    group = tables.imports(spark)
    if not group:
        return 0
    layout = "sorted" if any(e["layout"] == "sorted" for e in group) else "plain"
    return _unite(spark, tables, group, layout, file_bytes, buckets)


def compact_imports(spark: SparkSession, target: str, file_bytes: int = 128 << 20, below: int | None = None) -> int:
    """Unite small imports of a layout, in their order, into ones of about ``below`` bytes; returns how many folders were united.

    Imports whose records have at least that size (``file_bytes``, that of a written file, unless named) are left alone. Each group is written and published on its own, as one change of the log, so
    readers see a group's old folders or its new one. A repeated import of a united name still adds nothing.
    """
    tables, united, below = Tables(target), 0, file_bytes if below is None else below
    for layout in ("plain", "sorted"):
        groups, held = [[]], 0
        for entry in [e for e in tables.imports(spark) if e["layout"] == layout]:
            size = files.size(spark, f"{tables.folder(entry['name'])}/records")
            if size >= below:
                continue
            if held + size > below and groups[-1]:
                groups, held = [*groups, []], 0
            groups[-1].append(entry)
            held += size
        for group in groups:
            if len(group) > 1:
                united += _unite(spark, tables, group, layout, file_bytes)
    return united


def _unite(spark: SparkSession, tables: Tables, group: list[dict], layout: str, file_bytes: int, buckets: int | None = None) -> int:
    name = f"compact-{uuid.uuid4().hex}"
    try:
        for table in STORED:
            size = sum(files.size(spark, p) for e in group for p, _ in tables.paths_of(e, table))
            path, united = f"{tables.folder(name)}/{table}", tables.read_imports(spark, table, group)
            if table == "records" and layout == "sorted":
                sinks.write_sorted(united, path, by_type=True)
            else:
                sinks.write_parquet(united.coalesce(max(1, -(-size // file_bytes))), path)
        cuts = _cut_by_workout(spark, tables.folder(name), buckets)
        rows = {t: sum(e["rows"][t] for e in group) for t in STORED}
        counts = tables.publish(spark, "compact", {"name": name, "layout": layout, "rows": rows, **cuts}, [e["name"] for e in group])
    except BaseException:
        files.delete(spark, tables.folder(name))
        raise
    if not counts:
        files.delete(spark, tables.folder(name))
    return len(group) if counts else 0
