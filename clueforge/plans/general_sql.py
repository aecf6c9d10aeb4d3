"""SQL twins of the common-unit and instant queries, written for DuckDB's regular expressions and time zones."""

from __future__ import annotations

from ..functions.money import CURRENCY_WORDS, DIGITS, MIXED, NUMERALS, PLAIN_DIGITS, SCALES, SIMPLE
from ..functions.times import MONTHS, ZONES

_WIDE = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　 "
_THIN = "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)).replace("'", "''") + "  "


def _long(fields: list[str]) -> str:
    names = ", ".join(f"'{f}'" for f in fields)
    return f"SELECT record_id, source_system, currency, amount_unit, extra, unnest([{names}]) AS field_name, unnest([{', '.join(fields)}]) AS raw FROM audit_records"


_T = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_M = "|".join(MONTHS)
#: pattern and layout: year | month | day | half | hour | minute | second | fraction | half | kind.
_FORMS = [
    (rf"^(\d{{4}})[-/.年](\d{{1,2}})[-/.月](\d{{1,2}})日?[T ]?\s*(上午|下午)?\s*{_T}\s*([AaPp][Mm])?$", r"\1|\2|\3|\4|\5|\6|\7|\8|\9|first"),
    (r"^(\d{4})年(\d{1,2})月(\d{1,2})日\s*(上午|下午)?\s*(\d{1,2})[时点](\d{1,2})分(?:(\d{1,2})秒)?$", r"\1|\2|\3|\4|\5|\6|\7|||first"),
    (rf"^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}),?[T ]\s*(上午|下午)?\s*{_T}\s*([AaPp][Mm])?$", r"\3|\1|\2|\4|\5|\6|\7|\8|\9|last"),
    (rf"^(\d{{1,2}})[ -]({_M})[a-z]*\.?,?[ -](\d{{4}}),? {_T}\s*([AaPp][Mm])?$", r"\3|\2|\1||\4|\5|\6|\7|\8|name"),
    (rf"^({_M})[a-z]*\.? (\d{{1,2}}),? (\d{{4}}),? {_T}\s*([AaPp][Mm])?$", r"\3|\1|\2||\4|\5|\6|\7|\8|name"),
    (r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d{1,9}))?)?$", r"\1|\2|\3||\4|\5|\6|\7||first"),
]
_PARTS = "CASE " + " ".join(f"WHEN regexp_matches(core, '{p}') THEN regexp_replace(core, '{p}', '{x}')" for p, x in _FORMS) + " END"
_TAIL = r"[ (]*(Z|UTC|GMT|[A-Z]{3,4}|北京时间)?[ ]*([+-]\d{1,2}(?::?\d{2})?)?[ )]*$"
_ZONE = "CASE upper(zw) " + " ".join(f"WHEN '{z}' THEN {m}" for z, m in ZONES.items()) + " END"
_MONTH = "CASE substr(q[2], 1, 3) " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(MONTHS)) + " END"
_SWAP = "(o = 'mdy' OR (o = 'ymd' AND b > 12 AND a <= 12))"
P7 = rf"""
WITH v AS (SELECT DISTINCT record_id, field_name, raw, source_system FROM ({_long(["event_time", "created_at", "modified_at", "uploaded_at"])}) WHERE regexp_matches(raw, '[^\s　]')),
z AS (SELECT record_id, field_name, coalesce(tz_name, 'Asia/Shanghai') AS zone, coalesce(lower(date_order), 'ymd') AS o,
  regexp_replace(trim(regexp_replace(translate(raw, '{_WIDE}', '{_THIN}'), '\s+', ' ', 'g')), '\s*:\s*', ':', 'g') AS s FROM v LEFT JOIN source_systems USING (source_system)),
e AS (SELECT *, regexp_full_match(s, '\d{{10}}|\d{{13}}|\d{{16}}') AS bare, regexp_replace(regexp_replace(s, '^北京时间 ?', ''), '{_TAIL}', '') AS core, regexp_extract(s, '{_TAIL}', 1) AS zt, regexp_extract(s, '{_TAIL}', 2) AS ot FROM z),
g AS (SELECT *, CASE WHEN s LIKE '北京时间%' AND zt = '' THEN '北京时间' ELSE zt END AS zw, string_split({_PARTS}, '|') AS q FROM e),
h AS (SELECT *, try_cast(q[2] AS INT) AS a, try_cast(q[3] AS INT) AS b, q[10] AS kind, lower(q[4] || q[9]) AS half, try_cast(q[5] AS INT) AS h0, try_cast(q[6] AS INT) AS mi, coalesce(try_cast(q[7] AS INT), 0) AS se,
  coalesce(try_cast(rpad(substr(nullif(q[8], ''), 1, 6), 6, '0') AS INT), 0) AS fr FROM g),
m AS (SELECT *, CASE WHEN kind = 'name' THEN {_MONTH} WHEN kind = 'last' AND NOT {_SWAP} THEN b ELSE a END AS mon, CASE WHEN kind = 'last' AND NOT {_SWAP} THEN a ELSE b END AS d,
  CASE WHEN half IN ('pm', '下午') AND h0 < 12 THEN h0 + 12 WHEN half IN ('am', '上午') AND h0 = 12 THEN 0 WHEN half IN ('am', '上午') AND h0 > 12 THEN NULL ELSE h0 END AS hh FROM h),
n AS (SELECT *, try_cast(q[1] || '-' || lpad(mon::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) AS dt, replace(ot[2:], ':', '') AS od FROM m),
l AS (SELECT *, CASE WHEN hh < 24 AND mi < 60 AND se < 60 THEN epoch_us(dt::TIMESTAMP) + (hh * 3600 + mi * 60 + se)::BIGINT * 1000000 + fr END AS lo,
  CASE WHEN ot <> '' THEN (CASE WHEN ot[1] = '-' THEN -1 ELSE 1 END) * (CASE WHEN length(od) <= 2 THEN od::INT * 60 ELSE lpad(od, 4, '0')[1:2]::INT * 60 + lpad(od, 4, '0')[3:4]::INT END) WHEN zw <> '' THEN {_ZONE} END AS off FROM n),
u AS (SELECT *, CASE WHEN lo IS NOT NULL AND ot = '' AND zw = '' THEN epoch_us(timezone(zone, make_timestamp(lo))) END AS late FROM l),
f AS (SELECT record_id, field_name, CASE WHEN bare AND length(s) = 10 THEN s::BIGINT * 1000000 WHEN bare AND length(s) = 13 THEN s::BIGINT * 1000 WHEN bare THEN s::BIGINT WHEN ot <> '' OR zw <> '' THEN lo - off::BIGINT * 60000000
  WHEN epoch_us(timezone(zone, timezone('UTC', make_timestamp(late - 3600000000)))) = lo THEN late - 3600000000 ELSE late END AS utc_us FROM u)
SELECT DISTINCT record_id, field_name, utc_us FROM f WHERE utc_us IS NOT NULL"""


def _digit(text: str) -> str:
    return f"(greatest(instr('{DIGITS}', {text}), instr('{PLAIN_DIGITS}', {text}), 1) - 1)"


def _section(text: str) -> str:
    """Value of numerals under ten thousand, from the digit before each unit."""
    found = []
    for unit, n in (("[仟千]", 1000), ("[佰百]", 100), ("[拾十]", 10)):
        before = _digit(f"regexp_extract({text}, '(.){unit}', 1)")
        found.append(f"CASE WHEN regexp_matches({text}, '{unit}') THEN greatest({before}, 1) * {n} ELSE 0 END")
    last = _digit(f"right({text}, 1)")
    return f"({' + '.join(found)} + {last})"


def _scale(word: str) -> str:
    return f"CASE {word} " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in SCALES.items()) + " END"


def _bare(column: str) -> str:
    return f"regexp_replace({column}, '{CURRENCY_WORDS}', '', 'g')"


def _number(n: int) -> str:
    return f"coalesce(try_cast(nullif(regexp_extract(s, '{MIXED}', {n}), '') AS DECIMAL(28,8)), 0)"


_ZH = r"(十万|百万|千万|亿|万|千|仟|分|角)?元"
_EN = "(10k|k|m|mn|million|thousand|bn|billion)"
P3 = rf"""
WITH v AS (SELECT DISTINCT record_id, field_name, raw, amount_unit, array_to_string(map_values(extra), chr(10)) AS notes FROM ({_long(["amount", "control_amount"])})
  WHERE regexp_matches(raw, '[^\s　]') AND (NOT coalesce(regexp_matches(currency, '[^\s　]'), false) OR upper(trim(currency)) = 'CNY')),
c AS (SELECT *, regexp_replace(lower(translate(raw, '{_WIDE}', '{_THIN}')), '[\s,，]+', '', 'g') AS s, regexp_replace(lower(translate(coalesce(amount_unit, ''), '{_WIDE}', '{_THIN}')), '[\s()]+', '', 'g') AS au,
  lower(translate(coalesce(notes, ''), '{_WIDE}', '{_THIN}')) AS nt FROM v),
p AS (SELECT *, regexp_matches(s, '{MIXED}') AS mixed, regexp_matches(s, '{SIMPLE}') AS simple, regexp_matches(s, '{NUMERALS}') AS words,
  regexp_extract(s, '{SIMPLE}', 1) || regexp_extract(s, '{SIMPLE}', 3) || regexp_extract(s, '{SIMPLE}', 4) AS own, regexp_extract(s, '{NUMERALS}', 1) AS w,
  regexp_extract(nt, '(?m)(?:^|单位:?\s*(?:人民币)?|以|[(/]){_ZH}(?:计|\)|$)', 0) AS zh, regexp_extract(nt, '\bin {_EN} (?:cny|rmb|yuan)', 1) || regexp_extract(nt, '\b(?:cny|rmb|yuan) {_EN}\b', 1) AS en FROM c),
q AS (SELECT *, {_scale(_bare("own"))} AS fo, {_scale(_bare("au"))} AS fa, CASE WHEN zh <> '' THEN {_scale(f"regexp_extract(zh, '{_ZH}', 1)")} WHEN en <> '' THEN {_scale("en")} ELSE 1 END AS fx,
  CASE WHEN contains(w, '亿') THEN regexp_extract(w, '^(.*)亿', 1) ELSE '' END AS w8, CASE WHEN contains(w, '万') THEN regexp_extract(w, '^(?:.*亿)?(.*)万', 1) ELSE '' END AS w4, regexp_extract(w, '([^万亿]*)$', 1) AS w0 FROM p),
n AS (SELECT record_id, field_name, CASE
  WHEN mixed THEN ({_number(1)} * 100000000 + {_number(2)} * 10000 + {_number(3)} + {_number(4)} / 10 + {_number(5)} / 100)::DOUBLE * 100
  WHEN simple AND (own = '' OR fo IS NOT NULL) THEN try_cast(regexp_extract(s, '{SIMPLE}', 2) AS DOUBLE) * (CASE WHEN own <> '' THEN fo WHEN au <> '' THEN fa ELSE fx END)::DOUBLE * 100
  WHEN NOT simple AND words THEN {_section("w8")}::DOUBLE * 10000000000 + {_section("w4")}::DOUBLE * 1000000 + {_section("w0")} * 100 + {_digit(f"regexp_extract(s, '{NUMERALS}', 2)")} * 10 + {_digit(f"regexp_extract(s, '{NUMERALS}', 3)")} END AS fen FROM q)
SELECT DISTINCT record_id, field_name, round(fen)::BIGINT AS value_fen FROM n WHERE round(fen) > 0"""
