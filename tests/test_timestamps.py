import pandas as pd
import pytest

from verbatrix.operators.timestamps import header_values, parse_moments, shape_mask, utc_moments, zone_table

NY, BERLIN, TOKYO = "America/New_York", "Europe/Berlin", "Asia/Tokyo"
CASES = [
    ("2024-08-24T08:07:44Z", NY, "2024-08-24T08:07:44Z"),
    ("2018-11-20T21:58:36.999Z", NY, "2018-11-20T21:58:36Z"),
    ("2021-07-09", NY, "2021-07-09T04:00:00Z"),
    ("2021/10/05 21:18 UTC-04:00", BERLIN, "2021-10-06T01:18:00Z"),
    ("3/4/2019 7:05 PM", NY, "2019-03-05T00:05:00Z"),
    ("03/04/2019 19:05", BERLIN, "2019-04-03T17:05:00Z"),
    ("Thursday, 02-Jan-25 08:04:54 GMT", "UTC", "2025-01-02T08:04:54Z"),
    ("Thu Jan  2 08:12:48 2025", "UTC", "2025-01-02T08:12:48Z"),
    ("Oct. 23, 2013 8:06 PM BST", NY, "2013-10-23T19:06:00Z"),
    ("Saturday, July 13, 2024, 9:18 AM ET", NY, "2024-07-13T13:18:00Z"),
    ("12 de marzo de 2020, 00:30", NY, "2020-03-12T04:30:00Z"),
    ("2. November 2013, 00:39 Uhr", BERLIN, "2013-11-01T23:39:00Z"),
    ("2013年3月14日 22時42分", TOKYO, "2013-03-14T13:42:00Z"),
    ("1496102627", NY, "2017-05-30T00:03:47Z"),
    ("1559294154204", NY, "2019-05-31T09:15:54Z"),
    ("2017-04-01T02:22:54[America/Chicago]", NY, "2017-04-01T07:22:54Z"),
    ("June 5, 2014 at 12:47 a.m. EDT", NY, "2014-06-05T04:47:00Z"),
    ("20241004T155004Z", NY, "2024-10-04T15:50:04Z"),
    # twice: the earlier; skipped: on by the gap
    ("2012-11-04 01:30:00", NY, "2012-11-04T05:30:00Z"),
    ("2012-11-04T01:30:00-0500", NY, "2012-11-04T06:30:00Z"),
    ("2015-03-08T02:45", NY, "2015-03-08T07:45:00Z"),
    ("2018-03-25 02:30:00", BERLIN, "2018-03-25T01:30:00Z"),
]
BAD = ["", "   ", "NaN", "null", "{{ pubdate }}", "13/32/2021 9:00 AM", "25:61", "2023-02-30T10:15:00Z", "0000-00-00 00:00:00", "last Tuesday", "-1", "0", "2021-11-31", "2020-01-01 10:00 XQZ", "x" * 100_000]


def text(seconds):
    return pd.Timestamp(seconds, unit="s").strftime("%Y-%m-%dT%H:%M:%SZ")


@pytest.mark.parametrize("value,zone,expected", CASES)
def test_moments(value, zone, expected):
    assert text(parse_moments(pd.Series([value]), pd.Series([zone]))[0]) == expected


def test_batch_gives_what_single_values_give():
    got = parse_moments(pd.Series([c[0] for c in CASES] + BAD), pd.Series([c[1] for c in CASES] + [NY] * len(BAD)))
    assert [text(x) for x in got[: len(CASES)]] == [c[2] for c in CASES]
    assert got[len(CASES) :].isna().all()


def test_local_time_without_zone_is_no_moment():
    assert parse_moments(pd.Series(["2020-01-01 10:00:00", "2020-01-01T10:00:00Z"]), pd.Series([None, None])).isna().tolist() == [True, False]
    assert parse_moments(pd.Series(["2020-01-01 10:00:00"]), pd.Series(["No/Where"])).isna().all()


def test_masks_and_zone_tables():
    assert shape_mask("2024-08-24T08:07:44Z") == "9999-99-99a99:99:99a"
    table = zone_table(NY)
    assert table.version and len(table.bounds) + 1 == len(table.offsets)


def test_operator_edges(spark):
    schema = "id long, value string, zone string, utc string, extra int"
    rows = [(1, "2020-01-01T00:00:00Z", None, "old", 1), (1, "2020-01-01T00:00:00Z", None, "old", 1), (2, None, NY, None, None), (3, "", NY, None, None), (4, "2020-07-01", NY, None, 2)]
    got = sorted(map(tuple, utc_moments(spark.createDataFrame(rows, schema)).select("id", "utc", "extra").collect()))
    assert got == [(1, "2020-01-01T00:00:00Z", 1)] * 2 + [(4, "2020-07-01T04:00:00Z", 2)]
    assert utc_moments(spark.createDataFrame([], schema)).count() == 0


def test_headers_in_any_case(spark):
    pages = spark.createDataFrame([(1, {"DATE": "a", "date": "b", "Server": "x"}), (2, None), (3, {})], "page_id long, headers map<string,string>")
    assert sorted(map(tuple, header_values(pages, ["date"]).collect())) == [(1, "date", "a"), (1, "date", "b")]
