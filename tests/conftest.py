from __future__ import annotations

import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from holdfast.config import ID, SOURCE_COLUMNS  # noqa: E402

SMALL = "/root/testdata/sf0.001"

LEARNER = {
    "School": "GP", "Gender": "F", "Age": "17", "Address": "U", "Family_Size": "GT3",
    "Parental_Status": "T", "Mother_Education": "2", "Father_Education": "4",
    "Mother_Job": "teacher", "Father_Job": "other", "Reason_for_Choosing_School": "course",
    "Guardian": "mother", "Travel_Time": "2", "Study_Time": "2", "Number_of_Failures": "0",
    "School_Support": "no", "Family_Support": "yes", "Extra_Paid_Class": "no",
    "Extra_Curricular_Activities": "yes", "Attended_Nursery": "yes",
    "Wants_Higher_Education": "yes", "Internet_Access": "yes", "In_Relationship": "no",
    "Family_Relationship": "4", "Free_Time": "3", "Going_Out": "3",
    "Weekend_Alcohol_Consumption": "2", "Weekday_Alcohol_Consumption": "1",
    "Health_Status": "4", "Number_of_Absences": "2", "Grade_1": "12", "Grade_2": "13",
    "Final_Grade": "14", "Dropped_Out": "False",
}


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="holdfast-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def learners(spark):
    """Raw rows that differ from one ordinary learner in the given cells."""

    def build(*changes: dict):
        schema = f"{ID} bigint, " + ", ".join(f"{c} string" for c in SOURCE_COLUMNS)
        rows = [
            (change.get(ID, i + 1), *[change.get(c, LEARNER[c]) for c in SOURCE_COLUMNS])
            for i, change in enumerate(changes)
        ]
        return spark.createDataFrame(rows, schema)

    return build


def by_id(df, *columns):
    """``{id: row}`` or ``{id: value}`` of a small result."""
    rows = df.collect()
    if len(columns) == 1:
        return {row[ID]: row[columns[0]] for row in rows}
    return {row[ID]: tuple(row[c] for c in columns) if columns else row for row in rows}


def as_set(df):
    return sorted(map(str, df.collect()))
