"""Timestamps as typed by many sources, parsed to one instant with Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import narrow, squeeze

DAY_US = 86_400_000_000
#: Zone abbreviations found in texts, as offsets in minutes.
ZONES = {
    "Z": 0, "UTC": 0, "GMT": 0, "WET": 0, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "JST": 540, "KST": 540,
    "AEST": 600, "AEDT": 660, "ACST": 570, "AWST": 480, "NZST": 720, "NZDT": 780, "HKT": 480, "北京时间": 480,
}
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
_M = "|".join(MONTHS)
_Z = r"(?:\s*\(?\s*(Z|UTC|GMT|[A-Z]{3,4}|北京时间)?\s*([+-]\d{1,2}(?::?\d{2})?)?\s*\)?)"
_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
#: Each form: regex and the replacement that puts its groups in one order:
#: year | month | day | half of day | hour | minute | second | fraction | zone word | offset | kind.
FORMS = [
    (
        rf"^(?:北京时间 ?)?(\d{{4}})[-/.年](\d{{1,2}})[-/.月](\d{{1,2}})日?[T ]?\s*(上午|下午)?\s*{_T}\s*([AaPp][Mm])?{_Z}$",
        "$1|$2|$3|$4$9|$5|$6|$7|$8|$10|$11|first",
    ),
    (
        rf"^(?:北京时间 ?)?(\d{{4}})年(\d{{1,2}})月(\d{{1,2}})日\s*(上午|下午)?\s*(\d{{1,2}})[时点](\d{{1,2}})分(?:(\d{{1,2}})秒)?{_Z}$",
        "$1|$2|$3|$4|$5|$6|$7||$8|$9|first",
    ),
    (
        rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}),?[T ]\s*(上午|下午)?\s*{_T}\s*([AaPp][Mm])?{_Z}$",
        "$3|$1|$2|$4$9|$5|$6|$7|$8|$10|$11|last",
    ),
    (
        rf"^(\d{{1,2}})[ -]({_M})[a-z]*\.?,?[ -](\d{{4}}),? {_T}\s*([AaPp][Mm])?{_Z}$",
        "$3|$2|$1|$8|$4|$5|$6|$7|$9|$10|name",
    ),
    (
        rf"^({_M})[a-z]*\.? (\d{{1,2}}),? (\d{{4}}),? {_T}\s*([AaPp][Mm])?{_Z}$",
        "$3|$1|$2|$8|$4|$5|$6|$7|$9|$10|name",
    ),
    (
        rf"^(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_Z}$",
        "$1|$2|$3||$4|$5|$6|$7|$8|$9|first",
    ),
]


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def with_instant(df: DataFrame, raw: str, zone: str, order: str, out: str) -> DataFrame:
    """df with the column out: microseconds since 1970-01-01 UTC of the typed timestamp in raw, or null.

    Null results: blank text, words, dates without a time of day, times without a date, dates that don't exist
    (30 February, month 13 in the source's order), hours beyond 23, minutes or seconds beyond 59. Digits beyond
    microseconds are cut. A zone or offset in the text decides; without it the zone column does, where a local time
    that occurs twice means the earlier instant and one that is skipped is read with the offset before the change.
    Bare numbers of 10, 13 or 16 digits are epoch seconds, milliseconds or microseconds. Each stage is a projection
    of its own, so that every regular expression runs once a value.
    """
    s = F.col("__s")
    fields = F.lit(None).cast("string")
    for pattern, layout in reversed(FORMS):
        fields = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, layout)).otherwise(fields)
    fields = F.when(~s.rlike(r"^(?:\d{10}|\d{13}|\d{16})$"), fields)
    staged = (
        df.withColumn("__s", F.regexp_replace(squeeze(narrow(F.col(raw))), r"\s*:\s*", ":"))
        .withColumn("__p", F.split(fields, r"\|"))
        .withColumns({f"__{k}": F.get("__p", i) for i, k in enumerate("y m d half hh mi ss f z o kind".split())})
    )
    c = {k: F.col(f"__{k}") for k in "y m d half hh mi ss f z o kind".split()}
    first, second = _int(c["m"]), _int(c["d"])
    month_first = (F.col(order) == "mdy") | ((F.col(order) == "ymd") & (second > 12) & (first <= 12))
    last = c["kind"] == "last"
    named_month = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(c["m"], 1, 3)).cast("int")
    month = F.when(last & ~month_first, second).when(c["kind"] == "name", named_month).otherwise(first)
    day = F.when(last & ~month_first, first).otherwise(second)
    half = F.lower(c["half"])
    hour, pm, am = _int(c["hh"]), half.isin("pm", "下午"), half.isin("am", "上午")
    hour24 = (
        F.when(pm & (hour < 12), hour + 12).when(am & (hour == 12), 0).when(am & (hour > 12), F.lit(None)).otherwise(hour)
    )
    digits = F.regexp_replace(F.substring(c["o"], 2, 9), ":", "")
    off_h = F.when(F.length(digits) <= 2, _int(digits)).otherwise(_int(F.substring(F.lpad(digits, 4, "0"), 1, 2)))
    off_m = F.when(F.length(digits) <= 2, 0).otherwise(_int(F.substring(F.lpad(digits, 4, "0"), 3, 2)))
    offset = F.when(c["o"].startswith("-"), -1).otherwise(1) * (off_h * 60 + off_m)
    named = F.element_at(F.create_map(*[F.lit(x) for z in ZONES.items() for x in z]), F.upper(c["z"]))
    staged = staged.withColumn(
        "__date", F.concat_ws("-", c["y"], F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0")).try_cast("date")
    ).withColumns(
        {
            "__hour": hour24,
            "__minute": _int(c["mi"]),
            "__second": F.coalesce(_int(c["ss"]), F.when(c["ss"] == "", 0)),
            "__fraction": F.when(c["f"] == "", 0).otherwise(_int(F.rpad(F.substring(c["f"], 1, 6), 6, "0"))),
            "__off": F.when(c["o"] != "", F.when((off_h <= 18) & (off_m < 60), offset))
            .when(c["z"] != "", named)
            .when(s.startswith("北京时间"), 480),
            "__zoned": (c["o"] != "") | (c["z"] != "") | s.startswith("北京时间"),
        }
    )
    local = F.when(
        (F.col("__hour") < 24) & (F.col("__minute") < 60) & (F.col("__second") < 60),
        F.unix_date("__date").cast("bigint") * DAY_US
        + (F.col("__hour") * 3600 + F.col("__minute") * 60 + F.col("__second")).cast("bigint") * 1_000_000
        + F.col("__fraction"),
    )
    staged = staged.withColumn("__local", local)
    number = s.try_cast("bigint")
    instant = (
        F.when(s.rlike(r"^\d{10}$"), number * 1_000_000)
        .when(s.rlike(r"^\d{13}$"), number * 1000)
        .when(s.rlike(r"^\d{16}$"), number)
        .when(F.col("__zoned"), F.col("__local") - F.col("__off").cast("bigint") * 60_000_000)
        .when(F.col("__local").isNotNull(), F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col("__local")), F.col(zone))))
    )
    keep = [F.col(f"`{x}`") for x in df.columns]
    return staged.select(*keep, instant.cast("bigint").alias(out))
