import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from vitalog import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 8, partitions=2, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SAMPLE = '''<?xml version="1.0" encoding="UTF-8"?>
<!DOCTYPE HealthData [
<!ELEMENT HealthData (ExportDate,Me,(Record|Workout)*)>
<!-- <Record type="hidden"/> and <Workout> in the DTD -->
]>
<HealthData locale="en_US">
 <ExportDate value="2022-05-01 10:00:00 -0400"/>
 <!-- a comment with <Record type="commented"/>
  over lines -->
 <Record type="HKQuantityTypeIdentifierStepCount" sourceName="Rob’s &amp; &#x41; iPhone" sourceVersion="15.4" device="&lt;&lt;HKDevice>, a=b/>" unit="count"
   creationDate="2022-04-29 05:49:44 -0400" startDate="2022-04-29 05:40:00 -0400" endDate="2022-04-29 05:49:44 -0400" value="125"/>
 <Record type='HKCategoryTypeIdentifierSleepAnalysis' sourceName=" Rob's &quot;Watch&quot; "
   creationDate="2022-01-29 05:49:44 -0500" startDate="2022-01-29 01:00:00 -0500" endDate="2022-01-29 02:00:00 -0500"
   value="HKCategoryValueSleepAnalysisAsleepDeep"><MetadataEntry key="k" value="v"/></Record>
 <Workout workoutActivityType="HKWorkoutActivityTypeRunning" duration="30.5" durationUnit="min" sourceName="Watch"
   creationDate="2022-04-29 07:00:00 -0400" startDate="2022-04-29 06:00:00 -0400" endDate="2022-04-29 06:30:30 -0400">
  <WorkoutStatistics type="HKQuantityTypeIdentifierActiveEnergyBurned" startDate="2022-04-29 06:00:00 -0400" endDate="2022-04-29 06:30:30 -0400" sum="310" unit="kcal"/>
  <WorkoutActivity uuid="x"><WorkoutStatistics type="nested"/></WorkoutActivity>
  <WorkoutStatistics type="HKQuantityTypeIdentifierHeartRate" startDate="2022-04-29 06:00:00 -0400" endDate="2022-04-29 06:30:30 -0400" average="150" minimum="90" maximum="180" unit="count/min"/>
 </Workout>
 <Workout workoutActivityType="HKWorkoutActivityTypeHiking" duration="abc" durationUnit="min" sourceName="Watch"
   creationDate="2022-04-30 07:00:00 -0400" startDate="2022-04-30 06:00:00 -0400" endDate="2022-04-30 08:00:00 -0400"/>
 <Correlation type="BP"><Record type="HKQuantityTypeIdentifierHeartRate" sourceName="Watch" value="61" unit="count/min"
   creationDate="2022-04-30 07:00:00 -0400" startDate="2022-04-30 06:00:00 -0400" endDate="2022-04-30 06:00:00 -0400"/></Correlation>
 <ActivitySummary dateComponents="2022-04-29"><WorkoutStatistics type="stray"/></ActivitySummary>
 <Note><![CDATA[ <Record type="cdata"/> ]]></Note>
</HealthData>
'''


@pytest.fixture(scope="session")
def export(tmp_path_factory):
    folder = tmp_path_factory.mktemp("export")
    (folder / "export.xml").write_text(SAMPLE, encoding="utf-8")
    return str(folder)
