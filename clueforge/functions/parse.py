"""Strict parsing of single fields, as the audit engines need it (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import UNIT_FACTORS
from .chars import is_blank

_TIMES = [
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$", "yyyy/MM/dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}年\d{2}月\d{2}日 \d{2}:\d{2}:\d{2}$", "yyyy年MM月dd日 HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
]
_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)
_CREDIT_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"


def present(c: Column) -> Column:
    return ~is_blank(c)


def strict_amount(c: Column) -> Column:
    """Positive decimal of a sum typed as a plain number with optional currency words and commas; else null."""
    s = F.regexp_replace(c, r"人民币|RMB|CNY|¥|￥|元|,|，|\s", "")
    value = F.when(s.rlike(r"^\d{1,13}(\.\d+)?$"), s.cast("decimal(20,6)"))
    return F.when(value > 0, value)


def unit_factor(c: Column) -> Column:
    """Factor of a unit text to one yuan; 1 where it is missing, null where it is unknown."""
    u = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return F.element_at(F.create_map(*[F.lit(x) for kv in UNIT_FACTORS.items() for x in kv]), u)


def strict_time(c: Column) -> Column:
    """Timestamp of the plain forms (no zone, read as UTC); else null."""
    s, out = F.trim(c), F.lit(None).cast("timestamp")
    for pattern, form in reversed(_TIMES):
        out = F.when(s.rlike(pattern), F.try_to_timestamp(s, F.lit(form))).otherwise(out)
    return out


def tri_state(c: Column) -> Column:
    """True, False or null of a bilingual yes or no."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("true", "1", "yes", "y", "t", "是", "真", "有", "中标", "on"), True).when(
        s.isin("false", "0", "no", "n", "f", "否", "假", "无", "未中标", "off"), False
    )


def valid_credit_code(c: Column) -> Column:
    """The cleaned 18-character code where its check character (modulo 31) is right, else null."""
    s = F.upper(F.regexp_replace(c, r"[\s-]", ""))
    at = lambda i: F.instr(F.lit(_CREDIT_ALPHABET), F.substring(s, i, 1)) - 1
    total = sum((at(i + 1) * w for i, w in enumerate(_WEIGHTS)), F.lit(0))
    good = s.rlike("^[0-9ABCDEFGHJKLMNPQRTUWXY]{18}$") & (at(18) == F.pmod(31 - F.pmod(total, F.lit(31)), F.lit(31)))
    return F.when(good, s)


def text_credit_code(c: Column) -> Column:
    """As valid_credit_code, but codes of digits only don't count (they are other numbers when met in text)."""
    return F.when(~valid_credit_code(c).rlike(r"^\d+$"), valid_credit_code(c))


def ip_prefix(c: Column) -> Column:
    """The /24 of an IPv4 address, the /64 of a full-length IPv6 one."""
    v4 = F.regexp_extract(c, r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", 1)
    v6 = F.regexp_extract(F.lower(c), r"^((?:[0-9a-f]{1,4}:){4})(?:[0-9a-f]{1,4}:){3}[0-9a-f]{1,4}$", 1)
    return F.when(v4 != "", F.concat(v4, F.lit(".0/24"))).when(v6 != "", F.concat(v6, F.lit(":/64")))


def valid_ipv4(c: Column) -> Column:
    part = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    return c.rlike(rf"^{part}(?:\.{part}){{3}}$")


def value_hint(kind: str, c: Column) -> Column:
    """What may be shown of a sensitive value: its kind, a short hash and its length."""
    return F.concat(F.lit(f"{kind}:sha256:"), F.substring(F.sha2(c.cast("binary"), 256), 1, 12), F.lit(";len="), F.length(c).cast("string"))


def short_id(prefix: str, *parts: Column) -> Column:
    """Stable identifier: a prefix and 12 hexadecimal digits over the parts."""
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha1(F.concat_ws("\x1f", *parts).cast("binary")), 1, 12))
