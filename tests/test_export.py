"""The XML sources on a sample export, whole and cut into splits of a few bytes."""

import math
import xml.etree.ElementTree as ET
from contextlib import contextmanager

import pytest
from conftest import SAMPLE
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vitalog import ExportFiles, HealthStore, SearchParams
from vitalog import files
from vitalog.operators import rawxml
from vitalog.session import checkpoint_root
from vitalog.sources import landing, markup


@contextmanager
def splits_of(spark, size):
    """Cut files into splits of ``size`` bytes, however small they are."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    for n, v in zip(names, (size, "0")):
        spark.conf.set(n, v)
    try:
        yield
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)


@pytest.fixture(scope="module", params=["100m", "200"])
def found(spark, export, request):
    """The sample's elements, scanned whole and scanned in splits that cut most tags."""
    path = landing.scratch_dir(spark, "sample")
    with splits_of(spark, request.param):
        landing.land_elements(spark, export, path)
    return spark.read.parquet(path).coalesce(1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def tree():
    return ET.fromstring(SAMPLE.encode())


def test_the_import_reads_the_records(spark, export, found):
    split = rows(markup.records(found))
    assert split == rows(landing.scan_tables(spark, export)["records"])
    assert len(split) == 3
    by_type = {r[0]: r for r in split}
    steps = by_type["HKQuantityTypeIdentifierStepCount"]
    assert steps[1:4] == ("15.4", "Rob’s & A iPhone", "<<HKDevice>, a=b/>") and steps[8:] == (125.0, "125")
    sleep = by_type["HKCategoryTypeIdentifierSleepAnalysis"]
    assert sleep[1:4] == ("", ' Rob\'s "Watch" ', "") and sleep[7] == ""
    assert sleep[8:] == (0.0, "HKCategoryValueSleepAnalysisAsleepDeep")


def test_statistics_are_linked_to_workouts(spark, export, found):
    tables = landing.scan_tables(spark, export)
    seen = []
    for workouts, stats in ((markup.workouts(found), markup.stats(found)), (tables["workouts"], tables["stats"])):
        pairs = workouts.join(stats.withColumnRenamed("type", "stat"), "workout_id", "left")
        seen.append(rows(pairs.select("type", "duration", "stat", "sum", "average", "minimum", "unit")))
    assert seen[0] == seen[1] == [
        ("HKWorkoutActivityTypeHiking", 0.0, None, None, None, None, None),
        ("HKWorkoutActivityTypeRunning", 30.5, "HKQuantityTypeIdentifierActiveEnergyBurned", 310.0, 0.0, 0.0, "kcal"),
        ("HKWorkoutActivityTypeRunning", 30.5, "HKQuantityTypeIdentifierHeartRate", 0.0, 150.0, 90.0, "count/min"),
    ]


def test_elements_follow_the_tree(found):
    def walk(node, depth):
        yield node.tag, depth
        for child in node:
            yield from walk(child, depth + 1)
    opened = found.filter("kind <> 'close'")
    got = [(r.tag, r.depth) for r in opened.orderBy(*markup.POSITION).collect()]
    assert got == list(walk(tree(), 0))


def test_documents_are_the_children_of_the_root(found):
    docs = markup.documents(found).orderBy(*markup.POSITION).collect()
    assert [d.tag for d in docs] == [c.tag for c in tree()]
    for doc, child in zip(docs, tree()):
        assert doc.attrs == child.attrib
        assert doc.textvalue == child.attrib.get("value", "")
    summary = next(d for d in docs if d.tag == "ActivitySummary")
    assert str(summary.dateComponents) == "2022-04-29 00:00:00" and summary.value is None
    steps = next(d for d in docs if d.type == "HKQuantityTypeIdentifierStepCount")
    assert steps.value == 125.0 and steps.startDateText == "2022-04-29T05:40:00-04:00"
    assert steps.dateComponentsText == steps.startDateText


def test_structure(spark, export):
    files = ExportFiles(spark, export)
    got = {}
    for r in files.structure().collect():
        got.setdefault(r.kind, set()).add(r["name"])
    assert got["root_elements"] == {e.tag for e in tree().iter()}
    assert got["record_types"] == {e.get("type") for e in tree().iter("Record")}
    assert got["workout_types"] == {e.get("workoutActivityType") for e in tree().iter("Workout")}
    assert got["sources"] == {e.get("sourceName") for e in tree().iter("Record")}
    assert files.size_mb().first()[0] == round(len(SAMPLE.encode()) / 1048576, 2)


def strip(node):
    node.tail = None
    if node.text is not None and not node.text.strip():
        node.text = None
    for child in node:
        strip(child)
    return ET.tostring(node, encoding="unicode")


@pytest.mark.parametrize("query", ["WATCH", "", "& a", '"watch"', "nothing"])
def test_search_returns_whole_elements(found, query):
    hits = rawxml.search_elements(found, query, 50)
    got = [strip(ET.fromstring(r.xml)) for r in rawxml.as_xml(found, hits).collect()]
    want = [strip(e) for e in tree().iter() if e.tag in ("Record", "Workout")
            and any(v and query.lower() in v.lower() for v in e.attrib.values())]
    assert got == want


def test_cut_in_document_order(spark, export):
    files = ExportFiles(spark, export)
    first = [e for e in tree().iter() if e.tag in ("Record", "Workout")][:2]
    assert [ET.fromstring(r.xml).attrib for r in files.search("", 2).collect()] == [e.attrib for e in first]
    assert files.search("", 0).count() == 1
    assert files.by_type("HKQuantityTypeIdentifierHeartRate").count() == 1
    assert files.by_type("hkquantitytypeidentifierheartrate").count() == 0
    assert rawxml.hit_count(rawxml.search_elements(files.elements, "", 3)).first()[0] == 3


@pytest.mark.parametrize("layout", ["plain", "sorted"])
def test_import(spark, export, tmp_path, layout):
    target = str(tmp_path / "tables")
    counts = landing.import_export(spark, export, target, layout=layout)
    assert counts == {"records": 3, "workouts": 2, "stats": 2}
    landing.import_export(spark, export, target, layout=layout)
    store = HealthStore.from_import(spark, target)
    assert {(r.type, r["count"]) for r in store.summary().collect()} == {
        ("HKQuantityTypeIdentifierStepCount", 1), ("HKCategoryTypeIdentifierSleepAnalysis", 1),
        ("HKQuantityTypeIdentifierHeartRate", 1), ("HKWorkoutActivityTypeRunning", 2)}
    assert store.total().first()[0] == 3 and store.date_range().count() == 3 and store.downsample().count() == 3
    run = "HKWorkoutActivityTypeRunning"
    assert store.search(SearchParams(record_type=run, limit=20)).count() == 2
    assert {r.measure for r in store.statistics(run).collect()} == {"duration", "sum"}
    assert store.trend(run, "month", "2022-01-01T00:00:00+00:00", "2022-12-31T23:59:59+00:00").count() == 4
    assert store.trend("HKCategoryTypeIdentifierSleepAnalysis", numeric_only=True).count() == 0
    landing.import_export(spark, export, target, mode="append", layout="plain", absent=None, narrow=True)
    store = HealthStore.from_import(spark, target)
    assert store.records.count() == 6 and store.stats.filter("average IS NULL").count() == 1


WELL_FORMED = {
    "prolog": '\ufeff<?xml version="1.0"?>\n<!-- a & b --><!DOCTYPE H [\n<!-- < > --> <!ELEMENT H (Record*)>\n<!ATTLIST H locale CDATA #REQUIRED>\n<!-- c -->\n]>\n<H>%s</H>',
    "epilog": "<H>%s</H>\n<!-- <H> & --><?end of it?>\n<!-- - -->\n",
    "one empty root": "%.0s<H/>",
    "text": "<H a = 'b'\n c=\"d'>\" >one &amp; two &#38; three > four --> five %s</H >",
    "hidden": "<H><![CDATA[ <a> & <b x=y ]] > ]]>%s<!-- <Record type='no'/> & <x --> text <?pi a=b?></H>",
    "same names": "<H><a><a></a></a><a/><b><a></a></b>%s</H>",
}


MALFORMED = {
    "cut short": '<HealthData><Record type="t"/><Workout><WorkoutStatistics sum="1"/>',
    "wrong closing tag": "<HealthData><Workout></Record></HealthData>",
    "wrong order": "<HealthData><A><B></A></B></HealthData>",
    "closed too often": "<HealthData></HealthData></HealthData>",
    "two roots": "<HealthData></HealthData><HealthData></HealthData>",
    "siblings closed crosswise": "<HealthData><A><x></y><y></x></A></HealthData>",
    "second root of another name": "<HealthData></HealthData><G></G>",
    "record after the root": '<HealthData></HealthData><Record type="a"/>',
    "record before the root": '<Record type="a"/><HealthData></HealthData>',
    "value without quotes": '<HealthData><Record type=a value="1"/></HealthData>',
    "attribute without a value": '<HealthData><Record type "a"/></HealthData>',
    "attributes without a blank": '<HealthData><Record type="a"unit="b"/></HealthData>',
    "attribute twice": '<HealthData><Metadata k="a" k="b"/></HealthData>',
    "record attribute twice": '<HealthData><Record type="a" type="b"/></HealthData>',
    "text after the root": "<HealthData></HealthData> text",
    "text before the root": "text <HealthData></HealthData>",
    "text before the root's comment": "<!-- c --> text <HealthData></HealthData>",
    "text after a long comment": "<HealthData></HealthData><!-- <a> <b> --> text",
    "character data after the root": "<HealthData></HealthData><![CDATA[ x ]]>",
    "declaration after the root": "<HealthData></HealthData><!DOCTYPE HealthData >",
    "no name": "<HealthData>< a></HealthData>",
    "a bare bracket": "<HealthData>a < b</HealthData>",
    "two brackets": "<HealthData><<a/></HealthData>",
    "bracket in a value": '<HealthData><Record type="a<b"/></HealthData>',
    "an end of character data": "<HealthData>]]></HealthData>",
    "hyphens in a comment": "<HealthData><!-- a -- b --></HealthData>",
    "bare ampersand in text": "<HealthData>this & that</HealthData>",
    "only text": "nothing here",
    "only blanks": "  ",
    "nothing at all": "",
    "unknown reference": '<HealthData><Record type="a &bogus; b"/></HealthData>',
    "bare ampersand": '<HealthData><Record type="a & b"/></HealthData>',
    "date": '<HealthData><Record type="t" startDate="soon"/></HealthData>',
    "date without a zone": '<HealthData><Record type="t" startDate="2022-01-01 00:00:00 "/></HealthData>',
    "date with two zones": '<HealthData><Record type="t" startDate="2022-01-01 00:00:00 +00:00+0000"/></HealthData>',
    "number": '<HealthData><Workout><WorkoutStatistics sum="many"/></Workout></HealthData>',
    "number of the JVM": '<HealthData><Workout><WorkoutStatistics sum="3d"/></Workout></HealthData>',
}


@pytest.mark.parametrize("name", [n for n in MALFORMED if not n.startswith(("date", "number"))])
def test_the_yardstick_refuses_them_too(name):
    with pytest.raises(ET.ParseError):
        ET.fromstring(MALFORMED[name].encode())


VALUES = [n for n in MALFORMED if n.startswith(("date", "number")) or n in ("record attribute twice", "nothing at all")]


@pytest.mark.parametrize("split", ["100m", "48"])
def test_malformed_files_are_told(spark, tmp_path, split):
    """All in one folder, beside good files."""
    for name, text in (MALFORMED | {f"good {n}": t % "<Record/>" for n, t in WELL_FORMED.items()}).items():
        if name not in VALUES:
            (tmp_path / f"{name.replace(' ', '_')}.xml").write_text(text)
    with splits_of(spark, split):
        told = {r["file"].rsplit("/", 1)[1][:-4].replace("_", " ") for r in landing.malformed_files(spark, str(tmp_path)).collect()}
    assert told == {n.replace("'", "%27") if "%27" in str(told) else n for n in MALFORMED if n not in VALUES}


@pytest.mark.parametrize("name", VALUES)
def test_malformed_values_fail_the_import(spark, tmp_path, name):
    (tmp_path / "a.xml").write_text(MALFORMED[name])
    with pytest.raises((PySparkException, ValueError)):
        landing.import_export(spark, str(tmp_path / "a.xml"), str(tmp_path / "tables"))


@pytest.mark.parametrize("name", ["wrong order", "date", "number"])
def test_a_failed_import_changes_nothing(spark, export, tmp_path, name):
    target, bad = str(tmp_path / "tables"), tmp_path / "bad"
    bad.mkdir()
    (bad / "a.xml").write_text(MALFORMED[name])
    landing.import_export(spark, export, target)
    before = [rows(landing.Tables(target).read(spark, t)) for t in landing.STORED]
    for mode in ("overwrite", "append"):
        with pytest.raises((PySparkException, ValueError)):
            landing.import_export(spark, str(bad), target, mode=mode)
    assert [rows(landing.Tables(target).read(spark, t)) for t in landing.STORED] == before
    assert len([p for p in (tmp_path / "tables").iterdir() if p.name.startswith("import-")]) == 1


@pytest.mark.parametrize("name", ["wrong order", "unknown reference"])
def test_malformed_files_give_no_documents(spark, tmp_path, name):
    (tmp_path / "a.xml").write_text(MALFORMED[name])
    with pytest.raises((PySparkException, ValueError)):
        ExportFiles(spark, str(tmp_path)).documents().documents.collect()


@pytest.mark.parametrize("split", ["100m", "48"])
def test_well_formed_files_are_read(spark, tmp_path, split):
    for name, text in WELL_FORMED.items():
        whole = text % '<Record type="a" sourceName="x > y"/>'
        ET.fromstring(whole.encode())
        (tmp_path / f"{name}.xml").write_text(whole)
    with splits_of(spark, split):
        found = landing.scan_tables(spark, str(tmp_path))["records"].collect()
        landing.land_elements(spark, str(tmp_path))
    assert [r.sourceName for r in found] == ["x > y"] * (len(WELL_FORMED) - 1)


@pytest.mark.parametrize("split", ["100m", "30"])
def test_records_inside_records_count(spark, tmp_path, split):
    text = '<HealthData><Record type="a"><Record type="b"><M k="1"/></Record></Record><Record type="c"/></HealthData>'
    (tmp_path / "a.xml").write_text(text)
    with splits_of(spark, split):
        assert sorted(r.type for r in landing.scan_tables(spark, str(tmp_path))["records"].collect()) == ["a", "b", "c"]
        found = landing.land_elements(spark, str(tmp_path))
    shown = [r.xml for r in rawxml.as_xml(found, rawxml.search_elements(found, "", 5)).collect()]
    assert shown == ['<Record type="a"><Record type="b"><M k="1" /></Record></Record>', '<Record type="b"><M k="1" /></Record>',
                     '<Record type="c" />']


def test_an_import_leaves_no_scratch(spark, export, tmp_path):
    before = set(files.names(spark, f"{checkpoint_root(spark)}/vitalog"))
    landing.import_export(spark, export, str(tmp_path / "t"), layout="sorted")
    assert set(files.names(spark, f"{checkpoint_root(spark)}/vitalog")) == before


def test_acceptance_scenario_on_the_sample(spark, export, tmp_path):
    store = ExportFiles(spark, export).import_to(str(tmp_path / "t"))
    year = dict(date_from="2016-01-01T00:00:00+00:00", date_to="2016-12-31T23:59:59+00:00")
    assert store.trend("HKWorkoutActivityTypeRunning", **year).count() == 0
    assert store.search(SearchParams("HKWorkoutActivityTypeRunning", limit=20, **year)).count() == 0
    deep = store.search_values("HKCategoryTypeIdentifierSleepAnalysis", "HKCategoryValueSleepAnalysisAsleepDeep")
    assert deep.count() == 1
    assert store.search_values("HKWorkoutActivityTypeRunning", "125").count() == 0
    assert store.search_values(None, "125").count() == 1


def test_missing_workout_attributes(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<HealthData><Workout><WorkoutStatistics/></Workout></HealthData>")
    tables = landing.scan_tables(spark, str(tmp_path))
    row = tables["workouts"].first()
    assert row.duration == 0.0 and row.type is None and row.startDate is None
    assert tables["stats"].first().sum == 0.0
    assert landing.scan_tables(spark, str(tmp_path), absent=None)["stats"].first().sum is None


def test_a_file_of_many_splits(spark, tmp_path):
    """Depth, comments and links carried over many splits."""
    folder = tmp_path / "many"
    folder.mkdir()
    body, want = [], 0
    for i in range(150):
        body.append(f'<!-- <Workout n="{i}"> <x> --><Workout workoutActivityType="W{i}" duration="{i}">')
        for j in range(i % 7):
            body.append(f'<WorkoutStatistics type="S{i}" sum="{j}"/><Deep><WorkoutStatistics type="no"/></Deep>')
            want += j
        body.append("</Workout>")
    (folder / "a.xml").write_text("<HealthData>\n" + "\n".join(body) + "\n</HealthData>")
    with splits_of(spark, "1500"):
        found = landing.land_elements(spark, str(folder)).coalesce(2)
    workouts, stats = markup.workouts(found), markup.stats(found)
    assert workouts.count() == 150
    linked = workouts.join(stats.withColumnRenamed("type", "stat"), "workout_id")
    total, wrong = linked.agg(F.sum("sum"), F.sum((F.expr("'S' || substring(type, 2)") != F.col("stat")).cast("int"))).first()
    assert math.isclose(total, want) and wrong == 0
    assert found.filter("tag = 'HealthData' and depth = 0").count() == 2


@pytest.mark.parametrize("broadcast_rows", [100, 0])
def test_hidden_tags_are_left_out_whichever_way_they_are_joined(spark, tmp_path, broadcast_rows):
    folder = tmp_path / "hidden"
    folder.mkdir()
    hidden = "<!-- " + '<Record type="c"/> ' * 40 + "-->"
    body = "".join(f'<Record type="r{i}"/>{hidden if i % 9 == 0 else "<!-- x -->"}' for i in range(60))
    (folder / "a.xml").write_text(f"<HealthData>{body}<![CDATA[{'<Record/>' * 30}]]><Record type='z'/></HealthData>")
    with splits_of(spark, "400"):
        tags = landing.land_tags(spark, str(folder)).coalesce(2)
    shown = markup.visible(tags.filter("tag = 'Record'"), markup.hidden_spans(tags, broadcast_rows))
    got = [r.type for r in markup.records(shown).collect()]
    assert sorted(got) == sorted([f"r{i}" for i in range(60)] + ["z"])
    plain = tags.filter("hides is null")
    assert markup.visible(plain, markup.hidden_spans(plain)) is plain


ODD_TAGS = ['Record type="a" value="1"/', 'Record type="a" value="1" /', "Record type='a' value=\"1\"/", 'Record type="a" value=\'1\'/', 'Record  type="a"/',
            'Record type = "a"/', 'Record\n type="a"/', 'Record type="a\nb"/', 'Record type=" value=" value="2"/', 'Record unit=" type=" value="2" type="t"/',
            'Record type="&lt;&amp;quot;&gt;"/', 'Record type="&quot;x&quot; &#65;"/', "Record type=\"Rob's\" unit=\"='\"", 'Record type="a" other="b" value=""/', "Record", "Record/",
            'Record a:type="x" type="y"/', 'Record value="" type=""/']


def test_attributes_as_columns_are_those_of_the_map(spark):
    tags = spark.createDataFrame([(i, "Record", t) for i, t in enumerate(ODD_TAGS)], "id int, tag string, inside string")
    names = ("type", "value", "unit")
    as_map = markup.attributes(F.col("inside"), F.col("tag"))
    both = markup.attribute_columns(tags.withColumn("map", as_map), names)
    for r in both.collect():
        assert r.attrs.asDict() == {n: r.map.get(n) for n in names}, r.inside
    twice = spark.createDataFrame([("Record", 'Record type="a" type="b"/')], "tag string, inside string")
    with pytest.raises(PySparkException):
        markup.attribute_columns(twice, names).collect()


def test_text_is_not_shuffled(spark, export):
    with splits_of(spark, "200"):
        tags = landing.land_tags(spark, export, 4)
    spans = markup.hidden_spans(tags)
    found = markup.elements(tags, spans)
    found.collect()
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    shuffled = [part for part in plan.split("\n\n") if ") Exchange\n" in part]
    assert shuffled and not any("inside" in part for part in shuffled)


def test_a_compressed_export_reads_the_same(spark, export, tmp_path):
    import gzip
    (tmp_path / "export.xml.gz").write_bytes(gzip.compress(SAMPLE.encode()))
    assert landing.file_sizes(spark, str(tmp_path))[0] > len(gzip.compress(SAMPLE.encode()))
    for name, df in landing.scan_tables(spark, str(tmp_path)).items():
        want = landing.scan_tables(spark, export)[name]
        assert rows(df.drop("workout_id")) == rows(want.drop("workout_id"))


def test_unclosed_tags_are_told_before_depths_are_worked_out(spark, tmp_path, monkeypatch):
    """A broken export of any depth is refused by sums per split; what a comment hides doesn't count."""
    monkeypatch.setattr(markup, "elements", lambda *_: pytest.fail("depths were worked out"))
    for name, text in (("open", "<a>" * 2000), ("closed", "<a></a></a>"), ("hidden", "<a><!-- </a> -->")):
        (tmp_path / f"{name}.xml").write_text(text)
        for read in (landing.scan_tables, landing.land_elements):
            with pytest.raises(ValueError, match="not opened and closed in turn"):
                read(spark, f"{tmp_path}/{name}.xml")
