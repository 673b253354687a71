import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import pytest

from inkspark.functions.timestamps import normalize_timestamps
from inkspark.operators import timestamps

CASES = [
    ("2024-08-22", "Europe/Berlin", "DMY", "2024-08-22"),
    (" 20240822 ", "Europe/Berlin", "DMY", "2024-08-22"),
    ("01/12/2022", "Europe/Berlin", "DMY", "2022-12-01"),
    ("01/12/2022", "America/New_York", "MDY", "2022-01-12"),
    ("2022/11/27", "Asia/Tokyo", "YMD", "2022-11-27"),
    ("26/07/25, 07:25", "UTC", "DMY", "2025-07-26T07:25:00.000000Z"),
    ("12/31/24, 7:31 AM", "UTC", "MDY", "2024-12-31T07:31:00.000000Z"),
    ("Mar 13, 2024, 12:27 am", "UTC", "MDY", "2024-03-13T00:27:00.000000Z"),
    ("Wed 25 October 2023", "UTC", "DMY", "2023-10-25"),
    ("Tue 25 October 2023", "UTC", "DMY", None),
    ("Fri, 08 Dec 2023 18:34:18 +0530", "UTC", "DMY", "2023-12-08T13:04:18.000000Z"),
    ("2024-02-26T06:38:32.316+09:00", None, None, "2024-02-25T21:38:32.316000Z"),
    ("2025-12-11T01:06:49 +00:00[Europe/London]", "UTC", "DMY", "2025-12-11T01:06:49.000000Z"),
    ("1729994571", None, None, "2024-10-27T02:02:51.000000Z"),
    ("1753847070041", None, None, "2025-07-30T03:44:30.041000Z"),
    ("17 December 2023 21:18 CET", "Europe/Berlin", "DMY", "2023-12-17T20:18:00.000000Z"),
    ("17 December 2023 21:18 EST", "Europe/Berlin", "DMY", None),
    ("15 May 2023 01:01 IST", "Asia/Kolkata", "DMY", "2023-05-14T19:31:00.000000Z"),
    ("2024-03-31T02:30:00", "Europe/Berlin", "DMY", None),
    ("2024-10-27T02:30:00", "Europe/Berlin", "DMY", None),
    ("2024-10-27T03:00:00", "Europe/Berlin", "DMY", "2024-10-27T02:00:00.000000Z"),
    ("2024-10-27T02:30:00Z", "Europe/Berlin", "DMY", "2024-10-27T02:30:00.000000Z"),
    ("2024-13-05", "UTC", "DMY", None),
    ("2023-02-30T10:00:00Z", "UTC", "DMY", None),
    ("20240231", "UTC", "DMY", None),
    ("2024-05-01T24:00:00", "UTC", "DMY", None),
    ("2024-05-01T10:60", "UTC", "DMY", None),
    ("13/13/2022 10:00 PM", "UTC", "DMY", None),
    ("2024-05-01T10:00", None, None, None),
    ("2024-05-01T10:00", "No/Where", "DMY", None),
    ("yesterday", "UTC", "DMY", None),
    ("12:45", "UTC", "DMY", None),
    ("", "UTC", "DMY", None),
    (None, "UTC", "DMY", None),
]


@pytest.mark.parametrize("session_zone", ["UTC", "America/Los_Angeles"])
def test_cases(spark, session_zone):
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        rows = spark.createDataFrame([(i, *c, "clash") for i, c in enumerate(CASES)], "i int, raw string, zone string, ord string, want string, ts_status string")
        got = {r.i: r.ts_value for r in normalize_timestamps(rows, "raw", "zone", "ord").collect()}
        assert {i: got[i] for i in got if got[i] != CASES[i][3]} == {}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def wall(text, zone):
    """Brute force over the offsets that the zone has within two days."""
    w = datetime.fromisoformat(text)
    found = {u for h in range(-18 * 4, 18 * 4) if (u := w.replace(tzinfo=timezone.utc) - timedelta(minutes=15 * h)).astimezone(ZoneInfo(zone)).replace(tzinfo=None) == w}
    return found.pop().strftime("%Y-%m-%dT%H:%M:%S.%fZ") if len(found) == 1 else None


def test_changes_of_the_clock_against_brute_force(spark):
    try:
        ZoneInfo("Europe/Berlin")
    except ZoneInfoNotFoundError:
        pytest.skip("no zone data")
    starts = {"Europe/Berlin": "2024-10-26T22:00", "America/New_York": "2024-03-10T00:00", "Australia/Sydney": "2024-10-05T22:00", "Asia/Tokyo": "2024-01-01T00:00", "Australia/Lord_Howe": "2024-04-06T22:00"}
    rows = [(z, (datetime.fromisoformat(s) + timedelta(minutes=17 * i)).isoformat(timespec="seconds")) for z, s in starts.items() for i in range(30)]
    got = normalize_timestamps(spark.createDataFrame(rows, "zone string, raw string").selectExpr("*", "'DMY' ord"), "raw", "zone", "ord").collect()
    assert {(r.zone, r.raw): r.ts_value for r in got} == {(z, t): wall(t, z) for z, t in rows}


def test_found(spark, data):
    rows = timestamps.found(spark, data).collect()
    assert len({(r.rec_type, r.rec_id) for r in rows}) == len(rows) > 100
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\d(T\d\d:\d\d:\d\d\.\d{6}Z)?", r.norm_value) for r in rows)


def test_empty(spark):
    rows = spark.createDataFrame([], "raw string, zone string, ord string")
    assert normalize_timestamps(rows, "raw", "zone", "ord").count() == 0
