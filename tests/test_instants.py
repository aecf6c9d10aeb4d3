import shutil
from datetime import datetime, timezone

import pytest

from clueforge.functions.times import with_instant
from clueforge.operators.instants import InstantDictionary, normalise_times


def us(*a):
    return int(datetime(*a, tzinfo=timezone.utc).timestamp() * 1_000_000)


CASES = [
    ("2025-01-02 03:04:05", "Asia/Shanghai", "ymd", us(2025, 1, 1, 19, 4, 5)), ("2025-01-02T03:04:05Z", "Asia/Shanghai", "ymd", us(2025, 1, 2, 3, 4, 5)),
    ("2025-01-02T03:04:05.123456+0530", "UTC", "ymd", us(2025, 1, 1, 21, 34, 5) + 123456), ("2025-01-02 03:04:05 UTC+8", "UTC", "ymd", us(2025, 1, 1, 19, 4, 5)), ("2025-01-02 03:04 GMT-05:00", "UTC", "ymd", us(2025, 1, 2, 8, 4)),
    ("北京时间2025-01-02 03:04:05", "UTC", "ymd", us(2025, 1, 1, 19, 4, 5)), ("2025-01-02 03:04:05（北京时间）", "UTC", "ymd", us(2025, 1, 1, 19, 4, 5)), ("２０２５-０１-０２ ０３：０４：０５", "UTC", "ymd", us(2025, 1, 2, 3, 4, 5)),
    ("2025年1月2日 03:04:05", "UTC", "ymd", us(2025, 1, 2, 3, 4, 5)), ("2025年01月02日3时04分", "UTC", "ymd", us(2025, 1, 2, 3, 4)), ("  2025.01.02　03:04:05 ", "UTC", "ymd", us(2025, 1, 2, 3, 4, 5)), ("2025-01-02 下午3:04", "UTC", "ymd", us(2025, 1, 2, 15, 4)),
    ("2025-01-02 上午12:04", "UTC", "ymd", us(2025, 1, 2, 0, 4)), ("20250102030405", "UTC", "ymd", us(2025, 1, 2, 3, 4, 5)), ("1735787045", "Asia/Shanghai", "ymd", us(2025, 1, 2, 3, 4, 5)), ("1735787045123", "UTC", "ymd", us(2025, 1, 2, 3, 4, 5) + 123000),
    ("03/04/2025 10:00", "Europe/Berlin", "dmy", us(2025, 4, 3, 8)), ("03/04/2025 10:00 PM", "America/New_York", "mdy", us(2025, 3, 5, 3)), ("3.4.2025 10:00:01", "UTC", "dmy", us(2025, 4, 3, 10, 0, 1)), ("14 Mar 2025, 12:30", "UTC", "dmy", us(2025, 3, 14, 12, 30)),
    ("14 Mar 2025 12:30:00 CEST", "UTC", "dmy", us(2025, 3, 14, 10, 30)), ("Jun 2, 2025 9:05 PM", "UTC", "mdy", us(2025, 6, 2, 21, 5)), ("2025-10-26 02:30:00", "Europe/Berlin", "ymd", us(2025, 10, 26, 0, 30)), ("2025-03-30 02:30:00", "Europe/Berlin", "ymd", us(2025, 3, 30, 1, 30)),
    ("2025-01-02", "UTC", "ymd", None), ("03:04", "UTC", "ymd", None), ("2025-02-30 10:00", "UTC", "ymd", None), ("2025-13-40 10:00", "UTC", "ymd", None), ("2025-01-02 25:00", "UTC", "ymd", None), ("13/13/2025 10:00", "UTC", "dmy", None), ("待定", "UTC", "ymd", None),
    ("", "UTC", "ymd", None), (None, "UTC", "ymd", None), ("0000-00-00 00:00:00", "UTC", "ymd", None), ("2025-01-02 03:04:05 XYZ", "UTC", "ymd", None), ("x" * 50_000, "UTC", "ymd", None),
]


def test_every_form(spark):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "i int, raw string, zone string, o string, want bigint")
    got = {r["i"]: (r["raw"], r["utc"]) for r in with_instant(df, "raw", "zone", "o", "utc").collect()}
    for i, (raw, _, _, want) in enumerate(CASES):
        assert got[i] == (raw, want), raw


SOURCES = [("eu", "Europe/Berlin", "dmy", "x"), ("eu", "Europe/Berlin", "dmy", "y"), ("us", "America/New_York", "mdy", "z")]
RECORDS = "record_id string, a string, b string, source_system string, raw string, zone string, __s string"


def test_records_sources_and_repeats(spark):
    rows = [
        ("1", "03/04/2025 10:00", None, "eu", "clash", "clash", "clash"), ("1", "03/04/2025 10:00", None, "eu", "clash", "clash", "clash"), ("2", "03/04/2025 10:00", " ", "us", None, None, None),
        ("3", "2025-01-01 08:00", "soon", None, None, None, None), ("4", None, None, "unknown", None, None, None), ("5", "2025-01-01 08:00", None, "unknown", None, None, None),
    ]
    sources = spark.createDataFrame(SOURCES, "source_system string, tz_name string, date_order string, raw string")
    out = normalise_times(spark.createDataFrame(rows, RECORDS), sources, ["a", "b"]).collect()
    got = sorted((r["record_id"], r["field_name"], r["utc_us"]) for r in out if r["utc_us"] is not None)
    assert got == [("1", "a", us(2025, 4, 3, 8)), ("1", "a", us(2025, 4, 3, 8)), ("2", "a", us(2025, 3, 4, 15)), ("3", "a", us(2025, 1, 1)), ("5", "a", us(2025, 1, 1))]
    assert sum(r["utc_us"] is None for r in out) == 1
    assert normalise_times(spark.createDataFrame([], RECORDS), sources, ["a", "b"]).count() == 0


def test_dictionary_keeps_what_it_parsed(spark, tmp_path):
    keep = InstantDictionary(f"file://{tmp_path}/dictionary")
    first = spark.createDataFrame([("2025-01-01 08:00", "UTC", "ymd")] * 3, "raw string, zone string, date_order string")
    assert keep.resolve(first).count() == 1
    both = first.unionAll(spark.createDataFrame([("nonsense", "UTC", "ymd")], first.schema))
    assert {r["raw"]: r["utc_us"] for r in keep.resolve(both).collect()} == {"2025-01-01 08:00": us(2025, 1, 1, 8), "nonsense": None}
    keep.resolve(both)
    folder = next((tmp_path / "dictionary").iterdir())
    assert spark.read.parquet(f"file://{folder}/batch-*").count() == 2
    twice = next(b for b in folder.iterdir() if list(b.glob("*.parquet")) and spark.read.parquet(f"file://{b}").count())
    shutil.copytree(twice, folder / "batch-of-another-run")  # two runs at once may write one value twice
    assert keep.resolve(both).count() == 2
    (folder / "batch-of-another-run" / "_SUCCESS").unlink()  # an unfinished batch doesn't count
    assert keep.resolve(both).count() == 2


@pytest.mark.parametrize("zone", ["UTC", "Asia/Shanghai"])
def test_result_does_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = spark.createDataFrame([("2025-07-01 10:00:00", "Europe/Berlin", "ymd")], "raw string, zone string, o string")
        assert with_instant(df, "raw", "zone", "o", "utc").first()["utc"] == us(2025, 7, 1, 8)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
