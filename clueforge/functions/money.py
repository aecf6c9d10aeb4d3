"""Sums of money as typed: number, unit and numeral parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import narrow

#: Scale words of money units and their factor to one yuan.
SCALES = {
    "": "1",
    "分": "0.01",
    "fen": "0.01",
    "角": "0.1",
    "jiao": "0.1",
    "十": "10",
    "百": "100",
    "千": "1000",
    "仟": "1000",
    "k": "1000",
    "thousand": "1000",
    "万": "10000",
    "萬": "10000",
    "10k": "10000",
    "w": "10000",
    "十万": "100000",
    "百万": "1000000",
    "m": "1000000",
    "mn": "1000000",
    "million": "1000000",
    "千万": "10000000",
    "亿": "100000000",
    "億": "100000000",
    "bn": "1000000000",
    "billion": "1000000000",
}
#: Words that name the currency inside a unit.
CURRENCY_WORDS = r"元|圆|圓|块|yuan|cny|rmb|人民币|¥|￥"
#: Financial numerals.
DIGITS = "零壹贰叁肆伍陆柒捌玖"
PLAIN_DIGITS = "〇一二三四五六七八九"
_DEC = "decimal(30,12)"
NUMERALS = r"^(?:大写)?:?(?:人民币)?:?([零壹贰叁肆伍陆柒捌玖〇一二三四五六七八九两拾佰仟十百千万亿]+)(?:元|圆)(?:([零壹贰叁肆伍陆柒捌玖一二三四五六七八九])角)?(?:零?([壹贰叁肆伍陆柒捌玖一二三四五六七八九])分)?整?$"
SIMPLE = r"^(?:大写)?:?(人民币|rmb|cny|¥|￥)?:?(\d+(?:\.\d*)?(?:e[+-]?\d{1,2})?)\(?([a-z0-9千仟万萬百十亿億分角元圆圓块]*?)\)?(人民币|rmb|cny)?整?$"
MIXED = r"^(?:人民币|rmb|cny|¥|￥)?(?:(\d+(?:\.\d+)?)亿)?(?:(\d+(?:\.\d+)?)万)?(\d+(?:\.\d+)?)(?:元|圆)(?:(\d)角)?(?:(\d)分)?整?$"


def compact(c: Column) -> Column:
    """Narrow, lower-case, without blanks and thousands commas."""
    return F.regexp_replace(F.lower(narrow(c)), r"(?U)[\s,，]+", "")


def scale_of(unit: Column) -> Column:
    """Factor of a money unit to one yuan as decimal; null where the text is no unit of money.

    "元", "CNY" and the like give 1, "万 元" 10000, "fen" 0.01; "%", "批" or "" give null.
    """
    u = F.regexp_replace(F.lower(narrow(unit)), r"(?U)[\s()\[\]]+", "")
    rest = F.regexp_replace(u, CURRENCY_WORDS, "")
    known = F.create_map(*[F.lit(x) for pair in SCALES.items() for x in pair])
    return F.when(u != "", F.element_at(known, rest).cast(_DEC))


def numeral_value(text: Column) -> Column:
    """Integer value of Chinese numerals (financial or plain): 壹佰零叁万伍仟 -> 1035000."""

    dec = "decimal(20,0)"
    digits = {ch: i for i, ch in enumerate(DIGITS)} | {ch: i for i, ch in enumerate(PLAIN_DIGITS)} | {"两": 2}
    units = {"拾": 10, "十": 10, "佰": 100, "百": 100, "仟": 1000, "千": 1000}
    digit_of = F.create_map(*[F.lit(x) for pair in digits.items() for x in pair])
    unit_of = F.create_map(*[F.lit(x) for pair in units.items() for x in pair])

    def made(total: Column, section: Column, digit: Column) -> Column:
        return F.struct(total.cast(dec).alias("total"), section.cast(dec).alias("section"), digit.cast(dec).alias("digit"))

    def step(acc: Column, ch: Column) -> Column:
        total, section, digit, none = acc["total"], acc["section"], acc["digit"], F.lit(0)
        return (
            F.when(F.map_contains_key(digit_of, ch), made(total, section, F.element_at(digit_of, ch)))
            .when(F.map_contains_key(unit_of, ch), made(total, section + F.greatest(digit, F.lit(1)) * F.element_at(unit_of, ch), none))
            .when(ch == "万", made(total + (section + digit) * 10000, none, none))
            .otherwise(made((total + section + digit) * 100000000, none, none))
        )

    zero = F.struct(*[F.lit(0).cast("decimal(20,0)").alias(n) for n in ("total", "section", "digit")])
    return F.aggregate(F.split(text, ""), zero, step, lambda a: a["total"] + a["section"] + a["digit"])


def _num(s: Column) -> Column:
    return F.coalesce(F.nullif(s, F.lit("")).try_cast(_DEC), F.lit(0).cast(_DEC))


def with_sum(df: DataFrame, text: str, number: str, factor: str) -> DataFrame:
    """df with the number typed in the column text and the factor of the unit inside that text.

    factor is null where the text names no unit; number is null where the text isn't one sum (blank, words,
    percentages, negative numbers, several numbers, a unit that isn't money). Financial numerals and mixed forms
    such as "136万8351元" give their value in yuan with factor 1.
    """
    s, p = F.col("__s"), F.col("__p")
    tenth, hundredth, one = (F.lit(x).cast(_DEC) for x in ("0.1", "0.01", "1"))
    fields = (
        F.when(s.rlike(MIXED), F.regexp_replace(s, MIXED, "mixed|$1|$2|$3|$4|$5"))
        .when(s.rlike(SIMPLE), F.regexp_replace(s, SIMPLE, "simple|$2|$1$3$4"))
        .when(s.rlike(r"[拾佰仟万亿元圆]") & s.rlike(NUMERALS), F.regexp_replace(s, NUMERALS, "numerals|$1|$2|$3"))
    )
    staged = df.withColumn("__s", compact(F.col(text))).withColumn("__p", F.split(fields, r"\|"))
    staged = staged.withColumn("__u", F.when(p[0] == "simple", scale_of(F.get(p, 2))))
    mixed = (
        _num(F.get(p, 1)) * 100000000 + _num(F.get(p, 2)) * 10000 + _num(F.get(p, 3)) + _num(F.get(p, 4)) * tenth + _num(F.get(p, 5)) * hundredth
    )
    numerals = numeral_value(F.get(p, 1)) + numeral_value(F.get(p, 2)) * tenth + numeral_value(F.get(p, 3)) * hundredth
    simple = F.when((F.get(p, 2) == "") | F.col("__u").isNotNull(), F.get(p, 1).try_cast(_DEC))
    value = F.when(p[0] == "mixed", mixed.cast(_DEC)).when(p[0] == "simple", simple).when(p[0] == "numerals", numerals.cast(_DEC))
    unit = F.when(p[0] == "simple", F.col("__u")).when(p[0].isNotNull(), one)
    return staged.withColumns({number: value, factor: unit}).drop("__s", "__p", "__u")


def stated_scale(extra: Column) -> Column:
    """Factor stated in a free-key map ("金额单位：万元", "投标报价（千元）", "amounts in 10k CNY"); null if none is."""
    text = F.lower(narrow(F.array_join(F.map_values(extra), "\n")))
    chinese = F.regexp_extract(text, r"(?m)(?:^|单位:?\s*(?:人民币)?|以|[(/])(十万|百万|千万|亿|万|千|仟|分|角)?元(?:计|\)|$)", 0)
    word = F.regexp_extract(chinese, r"(十万|百万|千万|亿|万|千|仟|分|角)?元", 1)
    a = F.regexp_extract(text, r"\bin (10k|k|m|mn|million|thousand|bn|billion) (?:cny|rmb|yuan)", 1)
    b = F.regexp_extract(text, r"\b(?:cny|rmb|yuan) (10k|k|m|mn|million|thousand|bn|billion)\b", 1)
    return (
        F.when(chinese != "", scale_of(F.concat(word, F.lit("元"))))
        .when(a != "", scale_of(a))
        .when(b != "", scale_of(b))
    )
