"""Writing tables, and imports that run more than once."""

import shutil
import threading
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from conftest import SAMPLE
from pyspark.sql import functions as F

from vitalog import ExportFiles, HealthStore, schemas
from vitalog.sinks import tables as sinks
from vitalog.sources import landing, normalize
from vitalog.sources.tables import read_parquet, read_table, route_by_schema, table_kind
from vitalog.streaming import ingest, samples

DAY = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def records(spark):
    rows = [(f"type{i % 3}", "src", DAY if i < 400 else DAY + timedelta(minutes=i), float(i)) for i in range(1200)]
    raw = spark.createDataFrame(rows, "type string, sourceName string, startDate timestamp, value double")
    return normalize.fit(raw, schemas.RECORDS)


def test_sorted_layout_is_in_order_and_splits_a_busy_instant(spark, records, tmp_path):
    path = tmp_path / "sorted"
    sinks.write_sorted(records, str(path), partitions=6)
    ranges, busy = [], 0
    for file in sorted(path.glob("*.parquet")):
        times = pq.read_table(file)["startDate"].to_pylist()
        assert times == sorted(times)
        busy += any(t.replace(tzinfo=None) == DAY for t in times)
        ranges.append((times[0], times[-1]))
        assert "zstd" in str(pq.ParquetFile(file).metadata.row_group(0).column(0).compression).lower()
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))
    assert busy > 1
    assert read_parquet(spark, str(path), schemas.RECORDS).count() == 1200


def test_folders_by_type_are_pruned(spark, records, tmp_path):
    path = str(tmp_path / "by-type")
    sinks.write_sorted(records, path, by_type=True)
    one = sinks.read_by_type(spark, path, schemas.RECORDS).filter("type = 'type1'")
    assert one.count() == 400
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(CASE WHEN" in plan or "PartitionFilters: [CASE WHEN" in plan or "= type1)" in plan.split("PartitionFilters")[1][:200]


def test_type_folders_keep_every_type_as_it_was(spark, records, tmp_path):
    path, kinds = str(tmp_path / "odd"), ["", "~", "~x", "a/b=c", None, "plain"]
    odd = spark.createDataFrame([(k,) for k in kinds], "type string").join(records.drop("type").limit(2))
    sinks.write_sorted(normalize.fit(odd, schemas.RECORDS), path, by_type=True)
    got = [r.type for r in sinks.read_by_type(spark, path, schemas.RECORDS).collect()]
    assert sorted(got, key=str) == sorted(kinds * 2, key=str)


def test_append_counts_and_doubles(spark, records, tmp_path):
    path = str(tmp_path / "append")
    assert sinks.append(records, path) == 1200
    assert sinks.append(records, path) == 1200
    assert read_parquet(spark, path).count() == 2400
    sinks.append_new(records, path)
    sinks.append_new(records, path, within="startDate")
    assert read_parquet(spark, path).count() == 2400
    later = records.filter("value = 7").withColumn("value", F.col("value") + 0.5)
    sinks.append_new(later.union(later).union(records.limit(5)), path, within="startDate")
    assert read_parquet(spark, path).count() == 2402
    spark.read.parquet(path).filter("value <> 7.5").write.parquet(path + "-all")
    path += "-all"
    assert sinks.delete_all(spark, path, schemas.RECORDS) == 2400
    assert read_parquet(spark, path, schemas.RECORDS).count() == 0
    assert sinks.delete_all(spark, str(tmp_path / "nothing"), schemas.RECORDS) == 0


def test_compaction(spark, records, tmp_path):
    parts = []
    for i in range(3):
        sinks.write_parquet(records, str(tmp_path / f"chunk{i}"))
        parts.append(read_parquet(spark, str(tmp_path / f"chunk{i}"), schemas.RECORDS))
    sinks.compact(parts, str(tmp_path / "one"), partitions=1)
    assert len(list((tmp_path / "one").glob("*.parquet"))) == 1
    assert read_parquet(spark, str(tmp_path / "one")).count() == 3600


def test_documents_as_json(spark, tmp_path):
    docs = spark.createDataFrame([("Record", {"type": "a"}, 1.0)], "tag string, attrs map<string,string>, value double")
    assert sinks.write_documents(docs, str(tmp_path / "docs"), "json") == 1
    assert spark.read.json(str(tmp_path / "docs")).first().attrs.type == "a"


def test_catalog_tables(spark, records):
    spark.sql("CREATE DATABASE IF NOT EXISTS vitalog_test")
    try:
        for _ in range(2):
            sinks.create_tables(spark, "vitalog_test")
        assert sinks.append_to_table(records, "vitalog_test.records") == 1200
        store = HealthStore.from_catalog(spark, "vitalog_test")
        assert not store.keyed
        assert store.summary().count() == 3
        sinks.truncate_table(spark, "vitalog_test.records")
        assert read_table(spark, "vitalog_test.records").count() == 0
        sinks.truncate_table(spark, "vitalog_test.missing")
    finally:
        spark.sql("DROP DATABASE IF EXISTS vitalog_test CASCADE")


def test_routing(spark, records):
    workouts = normalize.fit(records.select("type"), schemas.WORKOUTS)
    mixed = records.select(*reversed(records.columns))
    routed = route_by_schema([mixed, workouts, records, records.select("type")])
    assert {k: v.count() for k, v in routed.items()} == {"records": 2400, "workouts": 1200}
    assert routed["records"].columns == schemas.RECORDS.names
    assert table_kind(records.select("type")) is None


def test_new_files_are_imported_once(spark, tmp_path):
    source, target, checkpoints = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.xml").write_text(SAMPLE, encoding="utf-8")

    def run():
        ingest.import_new_files(spark, source, target, checkpoints)
        return (ingest.read_records(spark, target).count(), ingest.read_workouts(spark, target).count(),
                ingest.read_stats(spark, target).count())
    assert run() == (3, 2, 2)
    assert run() == (3, 2, 2)
    shutil.copy(tmp_path / "in" / "a.xml", tmp_path / "in" / "b.xml")
    assert run() == (6, 4, 4)
    linked = ingest.read_workouts(spark, target).join(ingest.read_stats(spark, target), "workout_id")
    assert linked.count() == 4


def test_every_batch_counts_once(spark, tmp_path):
    source, target, checkpoints = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    for i in range(6):
        (tmp_path / "in" / f"{i}.xml").write_text(f'<HealthData><Record type="t{i}"/><Workout></Workout></HealthData>')
    kept = spark.conf.get("spark.sql.streaming.numRecentProgressUpdates")
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    try:
        got = ExportFiles(spark, source).import_new_to(target, checkpoints, max_files=1)
    finally:
        spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", kept)
    assert got == {"records": 6, "workouts": 6, "stats": 0}
    store = HealthStore.from_import(spark, target)
    assert store.records.count() == 6 and store.workouts.count() == 6
    # a batch that is run again adds nothing
    from vitalog.sources.landing import import_export
    assert import_export(spark, f"{source}/0.xml", target, mode="append", name="batch-000000000000")["records"] == 1
    assert HealthStore.from_import(spark, target).records.count() == 6


def test_samples_of_new_files_add_up(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()
    record = ('<HealthData><Record type="steps" sourceName="phone" startDate="{} 10:00:00 +0000" value="{}"/>'
              '</HealthData>')
    got = []
    # The second file is years older than the first: nothing is too late.
    for name, at, value in (("a", "2024-05-02", 2), ("b", "2019-05-02", 3), ("c", "2024-05-30", 5)):
        (tmp_path / "in" / f"{name}.xml").write_text(record.format(at, value))
        for _ in range(2):
            samples.sample_new_files(spark, source, target, checkpoint, "month", scale=1)
        rows = samples.read_samples(spark, target, scale=1).orderBy("startDate").collect()
        got.append([(str(r.startDate)[:7], r.value, r.n_values) for r in rows])
    assert got == [[("2024-05", 2.0, 1)], [("2019-05", 3.0, 1), ("2024-05", 2.0, 1)],
                   [("2019-05", 3.0, 1), ("2024-05", 3.5, 2)]]


def test_small_batches_run_at_once(spark, tmp_path):
    """Micro-batches of a trigger meet at a barrier, each in a session of its own that merges small partitions; a second call has nothing to do."""
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.xml").write_text("<HealthData/>")
    met, seen = threading.Barrier(4, timeout=60), []

    def work(session, paths, name):
        met.wait()
        seen.append((name, [p[-5:] for p in paths], session.conf.get("spark.sql.adaptive.enabled"), session is spark))

    for _ in range(2):
        ingest.each_batch_of_files(spark, str(tmp_path / "in"), str(tmp_path / "cp"), work, max_files=1)
    number = "0" * 12
    assert sorted(seen) == [(number + (f"-{i}" if i else ""), [f"{i}.xml"], "true", False) for i in range(4)]


def _one_record_files(folder, n):
    folder.mkdir()
    for i in range(n):
        stat = f'<Workout><WorkoutStatistics type="s{i}" sum="{i}"/></Workout>' if i % 2 else ""
        (folder / f"{i}.xml").write_text(f'<HealthData><Record type="t{i}" value="{i}" unit="u"/>{stat}</HealthData>')


def test_small_batches_are_read_in_one_scan(spark, tmp_path, monkeypatch):
    """Each still is an import of its own, with its own rows and numbers."""
    _one_record_files(tmp_path / "a b", 5)
    scans, scan = [], landing.scan_tables
    monkeypatch.setattr(landing, "scan_tables", lambda *a, **b: scans.append(1) or scan(*a, **b))
    target = str(tmp_path / "out")
    assert ingest.import_new_files(spark, str(tmp_path / "a b"), target, str(tmp_path / "cp"), max_files=1) == {"records": 5, "workouts": 2, "stats": 2}
    assert len(scans) == 1
    tables = landing.Tables(target)
    found = tables.imports(spark)
    assert [e["name"] for e in found] == [f"batch-{'0' * 12}" + (f"-{i}" if i else "") for i in range(5)]
    for i, e in enumerate(found):
        assert e["rows"] == {"records": 1, "workouts": i % 2, "stats": i % 2}
        assert [r.type for r in tables.read_imports(spark, "records", [e]).collect()] == [f"t{i}"]
        assert [(r.type, r.sum) for r in tables.read_imports(spark, "stats", [e]).collect()] == [(f"s{i}", float(i))] * (i % 2)
    assert ingest.read_workouts(spark, target).join(ingest.read_stats(spark, target), "workout_id").count() == 2
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_together")]


def test_a_malformed_file_stops_its_own_batch_only(spark, tmp_path):
    _one_record_files(tmp_path / "in", 3)
    (tmp_path / "in" / "1.xml").write_text("<HealthData><Record></HealthData>")
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    with pytest.raises(Exception, match="malformed XML"):
        ingest.import_new_files(spark, source, target, checkpoint, max_files=1)
    assert sorted(r.type for r in ingest.read_records(spark, target).collect()) == ["t0", "t2"]
    (tmp_path / "in" / "1.xml").write_text('<HealthData><Record type="t1"/></HealthData>')
    assert ingest.import_new_files(spark, source, target, checkpoint, max_files=1)["records"] == 3  # what counted already is reported, not added
    assert sorted(r.type for r in ingest.read_records(spark, target).collect()) == ["t0", "t1", "t2"]


def test_samples_of_small_batches_are_read_in_one_scan(spark, tmp_path, monkeypatch):
    _one_record_files(tmp_path / "in", 4)
    (tmp_path / "in" / "0.xml").write_text("<HealthData/>")  # a batch without samples
    scans, scan = [], landing.scan_tables
    monkeypatch.setattr(landing, "scan_tables", lambda *a, **b: scans.append(1) or scan(*a, **b))
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    samples.sample_new_files(spark, source, target, checkpoint, "month", scale=1, max_files=1)
    assert len(scans) == 1
    assert sorted((r.type, r.value, r.n_values) for r in samples.read_samples(spark, target, scale=1).collect()) == [(f"t{i}", float(i), 1) for i in (1, 2, 3)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"batch={'0' * 12}" + (f"-{i}" if i else "") for i in range(4)]


def test_scans_hold_a_bounded_amount_of_text(monkeypatch):
    monkeypatch.setattr(ingest, "TOGETHER_BYTES", 10)
    groups = {"a": ["1"], "b": ["2"], "c": ["3", "4"], "d": ["5"]}
    assert [list(s) for s in ingest._scans(groups, {"1": 4, "2": 6, "3": 9, "4": 9, "5": 1})] == [["a", "b"], ["c"], ["d"]]
