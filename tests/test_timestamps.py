"""Problem 2: timestamps, against Python's own date and zone arithmetic."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge.functions.zones import zone_table
from folioforge.operators.timestamps import found_moments, normalise_timestamps, to_micros, to_pandas_moments

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def micros(d: datetime) -> int:
    return (d - EPOCH) // timedelta(microseconds=1)


def one(value: str, zone: str = "UTC", order: str = "dmy"):
    return to_micros([value], [zone], [order])[0][0]


@pytest.mark.parametrize(
    ("value", "zone", "order", "want"),
    [
        ("2021-03-28 02:30", "Europe/Stockholm", "dmy", "2021-03-28T01:30:00+00:00"),  # skipped: offset before
        ("2021-10-31 02:30", "Europe/Stockholm", "dmy", "2021-10-31T00:30:00+00:00"),  # twice: first
        ("2021-10-31 02:30 CET", "UTC", "dmy", "2021-10-31T01:30:00+00:00"),
        ("2021-10-31T02:30:00+01:00[Europe/Stockholm]", "UTC", "dmy", "2021-10-31T01:30:00+00:00"),
        ("03/04/2020 1:05 pm", "America/New_York", "mdy", "2020-03-04T18:05:00+00:00"),
        ("03/04/2020", "UTC", "dmy", "2020-04-03T00:00:00+00:00"),
        ("  5\xa0maj 2022 kl. 07.09 ", "Europe/Stockholm", "dmy", "2022-05-05T05:09:00+00:00"),
        ("12 oktober 2022 kl. 23.59", "UTC", "dmy", "2022-10-12T23:59:00+00:00"),
        ("Tue, 07 Sep 2021 07:44:02 GMT", "Asia/Tokyo", "dmy", "2021-09-07T07:44:02+00:00"),
        ("20211014T134614Z", "Asia/Tokyo", "dmy", "2021-10-14T13:46:14+00:00"),
        ("2024-11-03T01:31:19,000000999", "UTC", "dmy", "2024-11-03T01:31:19+00:00"),
        ("2019-03-27T11:48:13.4+05:45[Asia/Kathmandu]", "UTC", "dmy", "2019-03-27T06:03:13.400000+00:00"),
        ("1591102182", "Asia/Tokyo", "dmy", "2020-06-02T12:49:42+00:00"),
        ("1591102182123", "UTC", "dmy", "2020-06-02T12:49:42.123000+00:00"),
        ("1591102182123456", "UTC", "dmy", "2020-06-02T12:49:42.123456+00:00"),
        ("December 16, 2020 12:20 AM", "UTC", "dmy", "2020-12-16T00:20:00+00:00"),
        ("2020-07-01 12:00:00 Australia/Sydney", "UTC", "dmy", "2020-07-01T02:00:00+00:00"),
        ("2023-02-01 24:00", "UTC", "dmy", "2023-02-02T00:00:00+00:00"),
        ("2022-05-01 08:00:00 -0330", "UTC", "dmy", "2022-05-01T11:30:00+00:00"),
    ],
)
def test_forms(value, zone, order, want):
    assert one(value, zone, order) == micros(datetime.fromisoformat(want))


@pytest.mark.parametrize("value", ["", "   ", "n/a", "TBD", "yesterday", "circa 2024", "11111", "2025-??-01", "January 32, 2020 9:10 AM", "2024-01-10 24:60:00", "2019-02-29", "2020-13-01", "0000-00-00 00:00:00", "31.04.2019 08:30", "13:00 PM", "05/05/2025 13:32 pm", "2020-01-01 10:00 Nowhere/Land", "x" * 5000])
def test_no_moment(value):
    assert one(value) is None


@settings(max_examples=300, deadline=None)
@given(st.datetimes(datetime(1971, 1, 1), datetime(2037, 12, 30)), st.sampled_from(["Europe/Stockholm", "America/New_York", "Australia/Sydney", "Asia/Kathmandu", "UTC", "America/St_Johns"]))
def test_zone_tables_agree_with_the_library(local, zone):
    """Also within doubled and skipped hours: fold 0 is the first occurrence and the offset before a gap."""
    seconds = int((local.replace(microsecond=0) - datetime(1970, 1, 1)).total_seconds())
    want = int(local.replace(microsecond=0, tzinfo=ZoneInfo(zone), fold=0).timestamp())
    import numpy as np

    assert int(zone_table(zone).to_utc(np.array([seconds]))[0]) == want


def test_many_forms_of_one_moment():
    rng = random.Random(4)
    for _ in range(200):
        d = datetime(2019, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=rng.randrange(7 * 365 * 86400))
        forms = [d.strftime("%Y-%m-%dT%H:%M:%SZ"), d.strftime("%a, %d %b %Y %H:%M:%S GMT"), d.strftime("%d.%m.%Y %H:%M:%S"), d.strftime("%B %d, %Y %I:%M:%S %p"), d.strftime("%Y%m%dT%H%M%SZ"), str(int(d.timestamp()))]
        got, masks = to_micros(forms, ["UTC"] * 6, ["dmy"] * 6)
        assert set(got) == {micros(d)}
        assert len(set(masks)) == 6


SCHEMA = "request_id string, received_at timestamp, created_at_source string, updated_at_source string, retrieved_at string, publisher string, origin string"


def _requests(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_sender_rules_and_deliveries(spark):
    t1, t2 = datetime(2025, 1, 1), datetime(2025, 1, 2)
    rows = [
        ("a", t1, "2020-06-01 12:00", None, None, " ACME ", "elsewhere"),
        ("a", t2, "2020-06-01 12:00", None, None, " ACME ", "elsewhere"),  # delivered again
        ("b", t1, "06/01/2020", None, "?", None, "acme_site"),
        ("c", t1, "06/01/2020", None, None, None, None),
        (None, t1, "2020-01-01", None, None, None, None),
    ]
    pubs = spark.createDataFrame([("Acme", "acme_site", "America/New_York", "mdy")], "publisher string, origin string, home_zone string, date_order string")
    manifests = _requests(spark, []).withColumnRenamed("request_id", "source_id").withColumnRenamed("received_at", "updated_at")
    got = {(r.record_id, r.field_name): r.utc_micros for r in found_moments(_requests(spark, rows).withColumn("zone", F.lit("clash")).withColumn("k_", F.lit(1)), manifests, pubs).collect()}
    assert got == {
        ("a", "created_at_source"): micros(datetime(2020, 6, 1, 16, tzinfo=timezone.utc)),
        ("b", "created_at_source"): micros(datetime(2020, 6, 1, 4, tzinfo=timezone.utc)),
        ("c", "created_at_source"): micros(datetime(2020, 1, 6, tzinfo=timezone.utc)),
    }


def test_empty_nulls_and_repeats(spark):
    schema = "record_id string, field_name string, value string, zone string, date_order string, mask string"
    assert normalise_timestamps(spark.createDataFrame([], schema)).count() == 0
    rows = [("r", "f", None, None, None, "m"), ("r", "f", "2020-01-01", None, None, "m"), ("r", "f", "2020-01-01", "No/Zone", None, "m"), (None, None, "2020-01-01T00:00Z", None, None, "m"), ("r", "f", "2020-01-01", None, None, "m")]
    got = [r.utc_micros for r in normalise_timestamps(spark.createDataFrame(rows, schema)).collect()]
    day = micros(datetime(2020, 1, 1, tzinfo=timezone.utc))
    assert sorted(got, key=str) == sorted([None, day, None, day, day], key=str)


def test_pandas_form():
    import pandas as pd

    assert to_pandas_moments(pd.Series(["2020-01-01", None, "x"])).tolist()[0] == 1577836800000000
