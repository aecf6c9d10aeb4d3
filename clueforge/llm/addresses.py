"""Postal addresses of the same place written differently: parsing, deletion-neighbourhood blocks, component assignment."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable, spread

#: Traditional and variant characters in addresses, and their simplified forms.
_VARIANTS = str.maketrans(
    "號區縣樓銀鐵齊雲莊蘭楓橋靜瀾麥澤滄灣嶺葦鷺寧慶雙樂溫榮華曉顧頤霧層單門鎮鄉棟兩開關東車廣馬龍興長陽園廠節峯栢邨碼",
    "号区县楼银铁齐云庄兰枫桥静澜麦泽沧湾岭苇鹭宁庆双乐温荣华晓顾颐雾层单门镇乡栋两开关东车广马龙兴长阳园厂节峰柏村码",
)
#: Characters used in place names and how they are spelled in Latin letters.
SPELLING = {
    ch: syllable
    for line in """an安 bai白百 bei北 bi碧 bo柏 chao朝 chen辰 cheng橙城 chi赤 chun春 cang沧 dan丹 dao稻 di荻 dong冬东 feng枫丰 fu福 ge阁 hai海 he荷河和
    hu湖 hua华花 huai槐 jia嘉 jiang绛江 jin金锦 jing静 ju菊 kang康 kui葵 lan澜兰 le乐 liao蓼 lin林 ling岭 long龙 lu鹭 luan峦 ma麻 mai麦 mei梅 mian棉 ming明 mo墨 mu暮
    nan南 ning宁 ping平 po坡 pu浦 qiao桥 qing青清 qiu秋 rui瑞 sang桑 sha沙 shan山 shi石 shuang霜 shui水 song松 su粟 ta塔 tai泰 tang棠 tian天 tie铁 ting汀 tong桐 wan湾 wei苇
    wu梧 xi溪西 xia霞 xiang祥 xiao晓 xin新 xing星兴 xue雪 ya雅 yan岩 yang阳 yi颐 yin银 yong永 yu榆玉 yuan垣 yue月 yun云 ze泽 zhong中 zhou洲 zhu渚竹 zi紫""".split("\n")
    for word in line.split()
    for syllable, chars in [re.match(r"([a-z]+)(.+)", word).groups()]
    for ch in chars
}
#: Kinds of road, each with the words that stand for it.
KINDS = {
    "大道": ("大道", "avenue", "ave", "boulevard", "blvd"),
    "路": ("路", "road", "rd"),
    "街": ("街", "street", "st"),
    "巷": ("巷", "lane", "ln", "alley"),
    "道": ("道",),
    "胡同": ("胡同",),
    "弄": ("弄",),
}
_KIND_OF = {word: kind for kind, words in KINDS.items() for word in words}
_NUMERAL = "零〇一二三四五六七八九十百千两"
_NUMBER = rf"(?:门牌)?(?:[Nn][Oo]\.? ?|#)?(\d+|[{_NUMERAL}]+)(?![\d{_NUMERAL}])"
_ROAD = re.compile(rf"([一-鿿]{{1,24}}?)(大道|胡同|路|街|巷|弄|道)(?=(?:门牌)?(?:[Nn][Oo]\.? ?|#)?(?:\d|[{_NUMERAL}]+(?:号|#|栋|$|[A-Z]座|-))){_NUMBER}")
_ENDS_ROAD = re.compile(r"[一-鿿](?:大道|胡同|路|街|巷|弄|道)$")
_FULL = re.compile(r"^(?:中国)?([一-鿿]{2,4}?)(?:省|自治区)([一-鿿]{2,4}?)市([一-鿿]{2,4}?)([区县旗])(?=[一-鿿]{2,6}(?:路|街|大道|巷|道|弄))")
_EN = re.compile(
    r"(?:(?:no\.? ?)?(\d+)#?,? +)?([a-z]+(?: [a-z]+)*?) (street|road|avenue|lane|ave|st|rd|ln|blvd|boulevard|alley)\b\.?(?: (?:no\.? ?)?(\d+)#?)?(.*)$"
)
PARTS = "province string, city string, district string, name string, kind string, number int, latin boolean"
_PARSED = f"raw string, {PARTS}, postcode string"
_POSTCODE = re.compile(r"(?:邮编|邮政编码|P\.?C\.?|postcode)[:： ]{0,2}(\d{6})(?!\d)|^\s*(\d{6})[ ，,]", re.I)
SKIPPED_KEYS = ("contact", "备注", "remark", "phone", "email")


def _value(number: str) -> int | None:
    if number.isdigit():
        return int(number) if len(number) <= 6 else None
    total, digit = 0, 0
    if not re.search("[十百千]", number):
        return int("".join(str("零一二三四五六七八九".find({"〇": "零", "两": "二"}.get(c, c))) for c in number)) if len(number) <= 6 else None
    for c in number:
        d = "零一二三四五六七八九".find({"〇": "零", "两": "二"}.get(c, c))
        if d >= 0:
            digit = d
        else:
            total, digit = total + max(digit, 1 if c == "十" and not digit else digit) * {"十": 10, "百": 100, "千": 1000}[c], 0
    return total + digit


def spell(name: str) -> str | None:
    """Latin spelling of a place name, or null where a character's isn't known."""
    parts = [SPELLING.get(ch) for ch in name]
    return None if None in parts else "".join(parts)


def plain_address(raw: str) -> str:
    """Half-width, simplified, without postcode, country, remarks about stations and the like; a locality in brackets first."""
    s = unicodedata.normalize("NFKC", raw).translate(_VARIANTS)
    s = re.sub(r"^\s*邮编:? ?\d{6}\s*|邮编:? ?\d{6}|^\s*\d{6} ", "", s)
    s = re.sub(r"\((?:近|靠近|原|旧|内|院内)[^)]*\)", "", s)
    brackets = re.findall(r"\(([^)]*[一-鿿][^)]*)\)", s)
    s = re.sub(r"\([^)]*\)", "", s).strip()
    if "," in s:
        tokens = [re.sub("^中国", "", t).strip() for t in s.split(",")]
        at = next((k for k, t in enumerate(tokens) if _ENDS_ROAD.search(t) and re.search(rf"[\d{_NUMERAL}]", tokens[0])), None)
        if at:  # number and room, road, then ever larger units
            s = "".join(reversed(tokens[at:])) + "-".join(tokens[:at])
    s = re.sub(r"(?<=[一-鿿])[\s,、/-]+(?=[一-鿿]|No|NO|门牌|#|\d)", "", s)
    return re.sub("^中国", "", "".join(brackets)) + re.sub("^中国", "", s)


#: Administrative units there can be, with room for typed errors that survive written_places.
MOST_PLACES = 100_000


def written_places(full: DataFrame) -> list[tuple]:
    """(province, city, district, n) as written in full, without those that are one typed character from a far more frequent one.

    A place goes where one of its units, the other two equal, is within one typed character of one at least twenty times as
    frequent. Places are administrative units, of which a country has a few thousand however many the rows are; more than
    MOST_PLACES raise a ValueError before anything is sent.
    """
    units = ["province", "city", "district"]
    names = durable(full.groupBy(*units).agg(F.count("*").alias("n")), "places-written")
    gone = None
    for unit in units:
        others = [u for u in units if u != unit]
        keyed = names.select(*others, F.col(unit).alias("name"), "n", F.explode(_forms(F.col(unit))).alias("form"))
        usual = keyed.select(*others, "form", F.col("name").alias("other"), F.col("n").alias("m"))
        near = keyed.join(usual, [*others, "form"]).where("m >= 20 * n and name <> other").where(_within_one(F.col("name"), F.col("other")))
        typed = near.select(*others, F.col("name").alias(unit)).select(*units).distinct()
        gone = typed if gone is None else gone.unionByName(typed)
    kept = names.join(gone.distinct(), units, "left_anti")
    if (n := kept.count()) > MOST_PLACES:
        raise ValueError(f"{n} administrative units are more than {MOST_PLACES}")
    return [tuple(r) for r in kept.select(*units, "n").collect()]


class Gazetteer:
    """Place names seen fully written (province, city, district with their suffixes)."""

    def __init__(self, rows: list[tuple[str, str, str, int]]):
        self.provinces, self.cities, self.districts = ({r[i] for r in rows} for i in range(3))
        best: dict[str, tuple[int, str]] = {}
        for _, city, district, n in rows:
            best[district] = max(best.get(district, (0, "")), (n, city))
        self.city_of = {d: c for d, (_, c) in best.items()}
        self.latin_city = {s: c for c in self.cities if (s := spell(c))}
        self.latin_district = {s: d for d in self.districts if (s := spell(d))}
        self.widths = [sorted({len(x) for x in names}, reverse=True) for names in (self.provinces, self.cities, self.districts)]

    def take(self, s: str, level: int, suffix: str) -> tuple[str | None, str]:
        names = (self.provinces, self.cities, self.districts)[level]
        for w in self.widths[level]:
            if s[:w] in names:
                rest = s[w:]
                return s[:w], rest[1:] if rest[:1] and rest[:1] in suffix else rest
        return None, s


def _near(name: str, names: set[str]) -> str | None:
    """The only one of names within one typed character of name."""
    found = [x for x in names if abs(len(x) - len(name)) <= 1 and within_one(x, name)]
    return found[0] if len(found) == 1 else None


def within_one(a: str, b: str) -> bool:
    """Equal up to one character replaced, left out, added, or two neighbours exchanged."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    if len(b) - len(a) == 1:
        return a[i:] == b[i + 1 :]
    return len(a) == len(b) and (a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]))


def parse_address(raw: str | None, g: Gazetteer) -> tuple | None:
    """(province, city, district, road name, kind, number, latin) or null where it has no road and number."""
    if not raw or not raw.strip():
        return None
    if re.search("[A-Za-z]{4}", raw) and not re.search("[一-鿿]{4}", raw):
        s = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", raw).lower().replace(",", " , "))
        m = _EN.search(s.replace(" ,", ","))
        if not m or not (m[1] or m[4]):
            return None
        words = [w for w in re.sub(r"[^a-z ]", " ", m[5]).split() if w not in ("district", "city", "county", "province", "china")]
        district = next((g.latin_district[w] for w in words if w in g.latin_district), None)
        city = next((g.latin_city[w] for w in words if w in g.latin_city and g.latin_city[w] != district), None)
        return None, city or g.city_of.get(district), district, m[2].replace(" ", ""), _KIND_OF[m[3]], int(m[1] or m[4]), True
    s = plain_address(raw)
    m = _ROAD.search(s)
    if not m:
        return None
    number = _value(m[3])
    if number is None:
        return None
    head = m[1]
    province, head = g.take(head, 0, "省")
    city, head = g.take(head, 1, "市")
    district, head = g.take(head, 2, "区县旗")
    if city is None and (t := re.match(r"([一-鿿]{2,4}?)市(?=[一-鿿]{2})", head)):
        city, head = _near(t[1], g.cities), head[t.end() :]
        district, head = g.take(head, 2, "区县旗") if district is None else (district, head)
    if district is None and (t := re.match(r"([一-鿿]{2,4}?)[区县旗](?=[一-鿿]{2})", head)):
        district, head = _near(t[1], g.districts) or t[1], head[t.end() :]
    if not head:
        return None
    return province, city or g.city_of.get(district), district, head, m[2], number, False


def _full_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [m.groups()[:3] for raw in batch.column(0).to_pylist() if raw and (m := _FULL.match(plain_address(raw)))]
        columns = zip(*rows) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["province", "city", "district"])


def _postcode(raw: str) -> str | None:
    m = _POSTCODE.search(unicodedata.normalize("NFKC", raw))
    return m and (m[1] or m[2])


def _parse(g: Gazetteer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string())
        names = ["raw", "province", "city", "district", "name", "kind", "number", "latin", "postcode"]
        for batch in batches:
            rows = [(raw, *p, _postcode(raw)) for raw in batch.column(0).to_pylist() if (p := parse_address(raw, g))]
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names)

    return run


def deletions(name: str) -> set[str]:
    """name and each form of it with one character left out."""
    return {name} | {name[:i] + name[i + 1 :] for i in range(len(name))}


#: Characters that tell roads of one name apart (体育东路 and 体育西路 are two).
BEARINGS = "东西南北中上下前后左右内外新老一二三四五六七八九十"
_NO_BEARING = str.maketrans("", "", BEARINGS)


def other_bearing(a: str, b: str) -> bool:
    """Whether two names of one length differ in such characters only."""
    return a != b and len(a) == len(b) and a.translate(_NO_BEARING) == b.translate(_NO_BEARING) and sorted(a) != sorted(b)


def _other_bearing(a: Column, b: Column) -> Column:
    """other_bearing as an expression, for names one typed character apart."""
    bare = lambda c: F.translate(c, BEARINGS, "")
    return (F.length(a) == F.length(b)) & (bare(a) == bare(b)) & (F.array_sort(F.split(a, "")) != F.array_sort(F.split(b, "")))


def _within_one(a: Column, b: Column) -> Column:
    """within_one as an expression."""
    swapped = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b
    exchanged = (F.length(a) == F.length(b)) & (F.length(a) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), swapped)
    return (F.levenshtein(a, b, 1) >= 0) | exchanged


def _forms(name: Column) -> Column:
    """deletions as an expression."""
    cut = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1)))
    return F.array_distinct(F.concat(F.array(name), cut))


def usual_names(roads: DataFrame) -> DataFrame:
    """roads (city, district, name, kind, latin, n) with usual: the far more frequent road one typed character away, or itself.

    A deletion-neighbourhood index: each spelling is joined with those of its city and kind that share a form with one
    character left out. A spelling with a district looks at roads of that district only.
    """
    keyed = roads.where("not latin").withColumn("form", F.explode(_forms(F.col("name"))))
    x = keyed.select("city", "kind", "form", "district", "name", "n")
    y = keyed.where("district <> ''").select("city", "kind", "form", F.col("district").alias("d"), F.col("name").alias("other"), F.col("n").alias("m"))
    met = x.join(y, ["city", "kind", "form"]).where("m >= greatest(3, 3 * n) and (district = '' or district = d) and name <> other").where(_within_one(F.col("name"), F.col("other")) & ~_other_bearing(F.col("name"), F.col("other")))
    best = met.groupBy("city", "kind", "district", "name").agg(F.max(F.struct("m", "other")).alias("b")).select("city", "kind", "district", "name", F.col("b.other").alias("usual"), F.lit(False).alias("latin"))
    on = ["city", "district", "name", "kind", "latin"]
    return roads.join(best, on, "left").select(*on, F.coalesce("usual", "name").alias("usual"))


#: Cost of a road of its own, of one without a district, of a typed character, and of a typed error more frequent than its road.
OPEN, NO_DISTRICT, TYPED, RARER = 3.0, 1.0, 1.0, 0.5


def _centres(rows: list[tuple]) -> list[dict[int, float]]:
    """For each spelling the spellings it may stand for, with the cost; itself among them.

    Vetoes: a spelling with a district stands only for one of the same district, and none for one of another bearing. Equal names, equal usual names and
    equal Latin letters cost nothing, a typed character TYPED.
    """
    index = defaultdict(list)
    for i, (_, name, latin, _, usual) in enumerate(rows):
        forms = {("l", name)} if latin else {("c", d) for d in deletions(name)} | {("u", usual)} | {("l", s) for x in (name, usual) if (s := spell(x))}
        for form in forms:
            index[form].append(i)
    options: list[dict[int, float]] = [{i: 0.0} for i in range(len(rows))]
    for (script, _), members in index.items():
        for i in members:
            for j in members:
                if i == j or (rows[i][0] and rows[i][0] != rows[j][0]):
                    continue
                if script in "lu" or (within_one(rows[i][1], rows[j][1]) and not other_bearing(rows[i][1], rows[j][1])):
                    cost = (0.0 if script in "lu" or rows[i][1] == rows[j][1] else TYPED) + (RARER if rows[j][3] < rows[i][3] else 0.0) - 1e-6 * math.log1p(rows[j][3])
                    options[i][j] = min(cost, options[i].get(j, math.inf))
    return options


def assign_exactly(options: list[dict[int, float]], opening: list[float]) -> list[int]:
    """The centre of each node: least sum of the costs of the assignment and of opening the centres used.

    Branch and bound over nodes, those with the fewest choices first; the bound is what the rest costs with every centre
    open. A centre is its own. The first of equally good assignments in the order of nodes and costs is taken.
    """
    order = sorted(range(len(options)), key=lambda i: (len(options[i]), i))
    least = [min(options[i].values()) for i in order]
    rest = [sum(least[k:]) for k in range(len(order) + 1)]
    best, chosen = [math.inf], [list(range(len(options)))]
    taken: dict[int, int] = {}
    opened: dict[int, int] = {}

    def go(k: int, cost: float) -> None:
        if cost + rest[k] >= best[0] - 1e-12:
            return
        if k == len(order):
            if all(taken[c] == c for c in opened):
                best[0], chosen[0] = cost, [taken[i] for i in range(len(options))]
            return
        i = order[k]
        ways = sorted((options[i][c] + (0.0 if c in opened else opening[c]), c not in opened, c) for c in options[i])
        for price, _, c in ways:
            if (c != i and taken.get(c, c) != c) or (c != i and i in opened):
                continue
            taken[i] = c
            opened[c] = opened.get(c, 0) + 1
            go(k + 1, cost + price)
            opened[c] -= 1
            if not opened[c]:
                del opened[c]
            del taken[i]

    go(0, 0.0)
    return chosen[0]


def place_heads(rows: list[tuple]) -> list[str]:
    """For each (district, name, latin, n, usual) of one city, number and kind a label of its road.

    Each spelling stands for one road: the assignment of least cost (assign_exactly), found on its own in every connected
    part. Spellings of different districts never share a road.
    """
    options = _centres(rows)
    up = list(range(len(rows)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, choices in enumerate(options):
        for j in choices:
            up[find(i)] = find(j)
    parts = defaultdict(list)
    for i in range(len(rows)):
        parts[find(i)].append(i)
    heads = [""] * len(rows)
    for part in parts.values():
        at = {i: k for k, i in enumerate(part)}
        opening = [OPEN + (0.0 if rows[i][0] else NO_DISTRICT) - 1e-6 * math.log1p(rows[i][3]) for i in part]
        for i, c in zip(part, assign_exactly([{at[j]: x for j, x in options[i].items()} for i in part], opening)):
            heads[i] = rows[part[c]][1] + "|" + (rows[part[c]][0] or "")
    return heads


def assign_places(group: pd.DataFrame) -> pd.DataFrame:
    """group with the column road: place_heads of each city, number and kind in it."""
    blocks = defaultdict(list)
    for i, key in enumerate(zip(group["city"], group["number"], group["kind"])):
        blocks[key].append(i)
    rows = list(group[["district", "name", "latin", "n", "usual"]].itertuples(index=False, name=None))
    road = [""] * len(rows)
    for members in blocks.values():
        for i, head in zip(members, place_heads([rows[i] for i in members])):
            road[i] = head
    out = group[["city", "district", "name", "kind", "number", "latin"]].copy()
    out["road"] = road
    return out


def same_places(records: DataFrame, key: str = "record_id", extra: str = "extra") -> DataFrame:
    """(key, city, road, kind, number) of each record whose map `extra` holds an address; equal rows mean the same place.

    Every value of the map is tried, except under keys that name a contact or a remark. Building, floor and room don't
    count; road kind and house number must agree; city and district must agree where both are written, a missing city
    is taken from the district, and where both are missing they are what the written postcode mostly goes with. Addresses without a road, a number or any locality give no row, null and empty maps none;
    a record may have several rows; repeated rows count once.

    Each distinct address text is parsed once, so a text that a third of all rows share costs one parse. The names of
    provinces, cities and districts come from the fully written addresses of all data (written_places). Spellings of a
    road are joined by their deletion forms; groups for the assignment (a city and a 64th of the house numbers) hold
    distinct spellings, not records.
    """
    texts = (
        records.select(F.col(key).alias("__key"), F.explode(extra).alias("k", "raw"))
        .where(~F.lower("k").isin(*SKIPPED_KEYS) & F.col("raw").rlike(r"[0-9０-９零一二三四五六七八九十百]"))
        .select("__key", "raw")
        .distinct()
    )
    texts = durable(texts, "address-texts")
    counted = texts.groupBy("raw").agg(F.count("*").alias("n"))
    tight = spread(counted.select("raw"), "raw")
    full = tight.mapInArrow(_full_names, "province string, city string, district string")
    parsed = durable(tight.mapInArrow(_parse(Gazetteer(written_places(full))), _PARSED), "addresses")
    by_code = parsed.where("postcode is not null and city is not null and district is not null").groupBy("postcode", "city", "district").agg(F.count("*").alias("n"))
    usual_of = by_code.groupBy("postcode").agg(F.max(F.struct("n", "city", "district")).alias("c"))
    coded = parsed.join(usual_of, "postcode", "left").withColumn("coded", F.col("city").isNull() & F.col("district").isNull())
    coded = coded.withColumns({c: F.when(F.col("coded"), F.col(f"c.{c}")).otherwise(F.col(c)) for c in ("city", "district")})
    parts = coded.where("city is not null").withColumn("district", F.coalesce("district", F.lit("")))
    spellings = parts.join(counted, "raw").groupBy("city", "district", "name", "kind", "number", "latin").agg(F.sum("n").alias("n"))
    roads = durable(spellings.groupBy("city", "district", "name", "kind", "latin").agg(F.sum("n").alias("n")), "roads")
    spellings = spellings.join(usual_names(roads), ["city", "district", "name", "kind", "latin"]).withColumn("block", F.pmod("number", F.lit(64)))
    schema = "city string, district string, name string, kind string, number int, latin boolean, road string"
    places = durable(spread(spellings, "city", "block").groupBy("city", "block").applyInPandas(assign_places, schema), "places")
    on = ["city", "district", "name", "kind", "number", "latin"]
    return texts.join(parts, "raw").join(places, on).select(F.col("__key").alias(key), "city", "road", "kind", "number").distinct()


def pairs_of(places: DataFrame, key: str = "record_id") -> DataFrame:
    """(key_a, key_b) of any two records of one place, the smaller first by code point."""
    on = ["city", "road", "kind", "number"]
    a, b = (places.select(*on, F.col(key).alias(f"{key}_{s}")) for s in "ab")
    return a.join(b, on).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b").distinct()
