"""The log of imports: races, restarts, segments and compaction."""

import threading
from functools import partial

import pytest
from vitalog import HealthStore, files
from vitalog.plans import export_queries
from vitalog.sources import landing, manifest


def entry(name):
    return {"name": name, "layout": "plain", "rows": {"records": 1, "workouts": 0, "stats": 0}}


def fresh(folder):
    """The state another process would read."""
    manifest._STATES.pop(folder, None)
    return folder


@pytest.mark.parametrize("segment", [2, 3, 100])
def test_replay_of_any_length(spark, tmp_path, monkeypatch, segment):
    monkeypatch.setattr(manifest, "SEGMENT", segment)
    log = manifest.Manifest(f"{tmp_path}/_tables")
    for i in range(25):
        log.publish(spark, {"kind": "replace" if i == 4 else "add", "entry": entry(f"i{i}"), "names": []})
        if i % 6 == 0:
            fresh(log.folder)
        assert list(log.state(spark).current) == [f"i{k}" for k in range(4 if i >= 4 else 0, i + 1)]
    log.publish(spark, {"kind": "compact", "entry": entry("c"), "names": ["i6", "i5"]})
    log.publish(spark, {"kind": "compact", "entry": entry("late"), "names": ["i7", "i5"]})
    fresh(log.folder)
    state = log.state(spark)
    assert set(state.current) == {f"i{k}" for k in range(4, 25)} - {"i5", "i6"} | {"c"} and "i5" in state.done and state.retired == ["i6", "i5"]


def test_writers_at_once_all_land(spark, tmp_path, monkeypatch):
    """Each with a state of its own, as sessions have."""
    monkeypatch.setattr(manifest, "SEGMENT", 5)
    folder = f"{tmp_path}/_tables"
    stores = [{} for _ in range(4)]
    local = threading.local()

    class PerThread:
        get = staticmethod(lambda key, default=None: local.store.get(key, default))
        __setitem__ = lambda self, key, value: local.store.__setitem__(key, value)

    monkeypatch.setattr(manifest, "_STATES", PerThread())

    def write(k):
        local.store = stores[k]
        for i in range(9):
            manifest.Manifest(folder).publish(spark, {"kind": "add", "entry": entry(f"w{k}-{i}"), "names": []})

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    local.store = {}
    got = list(manifest.Manifest(folder).state(spark).current)
    assert sorted(got) == sorted(f"w{k}-{i}" for k in range(4) for i in range(9))
    for k in range(4):
        assert [n for n in got if n.startswith(f"w{k}")] == [f"w{k}-{i}" for i in range(9)]


def test_many_batches_cost_the_same_each(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(manifest, "SEGMENT", 10)
    log, reads = manifest.Manifest(f"{tmp_path}/_tables"), []
    plain = files.read_json
    monkeypatch.setattr(files, "read_json", lambda *a: reads.append(a[1]) or plain(*a))
    costs = []
    for i in range(300):
        before = len(reads)
        log.publish(spark, {"kind": "add", "entry": entry(f"b{i}"), "names": []})
        costs.append(len(reads) - before)
    assert sum(costs[200:]) <= sum(costs[100:200]) and max(costs) <= 30
    fresh(log.folder)
    before = len(reads)
    assert len(log.state(spark).current) == 300 and len(reads) - before <= 5
    assert len(files.names(spark, log.folder)) <= 30


def test_a_store_that_was_removed_begins_again(spark, tmp_path):
    log = manifest.Manifest(f"{tmp_path}/_tables")
    log.publish(spark, {"kind": "add", "entry": entry("a"), "names": []})
    files.delete(spark, log.folder)
    assert log.state(spark).current == {}
    log.publish(spark, {"kind": "add", "entry": entry("b"), "names": []})
    assert list(log.state(spark).current) == ["b"]


@pytest.mark.parametrize("layout", ["plain", "sorted"])
def test_compaction_of_imports(spark, export, tmp_path, layout):
    target = str(tmp_path / "t")
    for name in ("x", "y", "z"):
        landing.import_export(spark, export, target, mode="append", layout=layout, name=name)
    tables = landing.Tables(target)
    rows = lambda: sorted(map(tuple, tables.read(spark, "records").collect()), key=repr)
    before = rows()
    assert landing.compact_imports(spark, target) == 3
    assert rows() == before and len(tables.imports(spark)) == 1 and tables.imports(spark)[0]["rows"]["records"] == 9
    assert landing.import_export(spark, export, target, mode="append", layout=layout, name="y")["records"] == 3 and rows() == before
    assert landing.compact_imports(spark, target) == 0
    assert (tmp_path / "t" / "x").exists()  # for readers that hold it
    landing.import_export(spark, export, target)
    assert not (tmp_path / "t" / "x").exists() and HealthStore.from_import(spark, target).records.count() == 3


def test_large_imports_are_left_alone(spark, export, tmp_path):
    target = str(tmp_path / "t")
    for _ in range(2):
        landing.import_export(spark, export, target, mode="append")
    assert landing.compact_imports(spark, target, file_bytes=100) == 0


def test_imports_of_any_size_are_united_on_request(spark, export, tmp_path):
    target = str(tmp_path / "t")
    for _ in range(3):
        landing.import_export(spark, export, target, mode="append")
    before = landing.Tables(target).read(spark, "records").count()
    assert landing.compact_imports(spark, target, file_bytes=10) == 0
    assert landing.compact_imports(spark, target, file_bytes=10, below=1 << 30) == 3
    assert len(landing.Tables(target).imports(spark)) == 1 and landing.Tables(target).read(spark, "records").count() == before


def test_the_query_unites_imports_above_the_size_of_a_file(spark, tmp_path, monkeypatch):
    """As they are where the tables are large."""
    spark.sql("""SELECT id AS event_id, timestamp'2024-01-01 10:00:00' AS ts, id % 4 AS user_id, 'click' AS event_type,
      1.5D AS value, 'p' AS props FROM range(12)""").write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(export_queries, "compact_imports", partial(landing.compact_imports, file_bytes=10))
    assert export_queries.QUERIES["compact_imports"](spark, str(tmp_path)).groupBy("type").count().orderBy("type").collect() == [("click", 12), ("inner", 12)]
