"""Variant spellings of organisation and person names: canonical rewritings, exploded and joined, scored by rarity."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import durable, spread
from .addresses import within_one

#: Traditional characters frequent in company names, and their simplified forms.
_VARIANTS = str.maketrans(
    "匯載創華裝備設機電儀錶器網絡統環醫療業務動術聯達馳飛騰龍遠寶廣東興榮豐順鑫實際經維綱紀綸鎮鐵鋒銳錦鈞鋼鍵鏡偉國優衛導壽靈賢資質貿賽輝軒輪運進遷選長門開關陽陸險隨難靜頂項順領頤顯風養駿驍點齊齡創凱勝勵區協單衆"
    "嶸嶺峯帥師幣廠彈後從德態應戰擇擔據攜數斷無時晉暉曉書會東極構樂樓標樁橋檢權歐歷殼氣決溝滿漢潤濟灣烏煉熱爾獎環現産産畫異當發皓盤盡監確碼禮種稱穩窮競筆節範築簡糧紅純納級紙細終組結統絲綜綠緯緒線締編緣練縣績織繡繩繼續罷羅習聖聞聲職聽肅脈腦臺舉興藍藝藥蘇號術衝補裏複製見規視覽觀",
    "汇载创华装备设机电仪表器网络统环医疗业务动术联达驰飞腾龙远宝广东兴荣丰顺鑫实际经维纲纪纶镇铁锋锐锦钧钢键镜伟国优卫导寿灵贤资质贸赛辉轩轮运进迁选长门开关阳陆险随难静顶项顺领颐显风养骏骁点齐龄创凯胜励区协单众"
    "嵘岭峰帅师币厂弹后从德态应战择担据携数断无时晋晖晓书会东极构乐楼标桩桥检权欧历壳气决沟满汉润济湾乌炼热尔奖环现产产画异当发皓盘尽监确码礼种称稳穷竞笔节范筑简粮红纯纳级纸细终组结统丝综绿纬绪线缔编缘练县绩织绣绳继续罢罗习圣闻声职听肃脉脑台举兴蓝艺药苏号术冲补里复制见规视览观",
)
#: Trades in company names; the longest that fits counts.
TRADES = (
    "建设工程 机电设备 医疗器械 信息技术 网络系统 智能装备 物业服务 环境工程 仪器仪表 自动化 电子 科技 建筑工程 工程咨询 系统集成 软件 物流 贸易 商贸 药业 "
    "化工 能源 电气 通信 机械 装饰 园林 安防 实业 环保 咨询 服务 技术 工程 设备 "
    "信息 网络 控股 投资 制造 电器 仪器 材料 新材料 智能科技 生物科技 生物 医药 食品 农业 纺织 服装 印刷 包装 广告 传媒 文化 教育 旅游 餐饮 酒店 物业 置业 地产 房地产 "
    "市政工程 消防工程 水利工程 路桥 钢结构 建材 建筑 建设 电力 水务 燃气 矿业 冶金 钢铁 光电 半导体 微电子 检测 测绘 设计 监理 招标代理 供应链 运输 汽车 租赁 劳务 人力资源"
).split()
TRADES.sort(key=len, reverse=True)
_LEGAL = re.compile(r"\(?(?:集团)?\)?(?:股份)?(?:有限)?(?:责任)?(?:总)?公司$|\(?集团\)?$")
_LEGAL_RUN = re.compile(r"[有限责任股份集团总公司()]*[公司]$")
#: Trades in Latin letters, each with the ways to write it (joined, without blanks).
LATIN_TRADES = {
    "medicaldevices": ("medicaldevices", "meddevices"),
    "internationaltrading": ("internationaltrading", "intltrading"),
    "systemsandnetworks": ("systemsandnetworks", "systemsnetworks"),
    "informationtechnology": ("informationtechnology", "infotech"),
    "technology": ("technology", "technologies", "tech"),
    "engineering": ("engineering", "engineers", "eng"),
    "instruments": ("instruments", "instr"),
    "machinery": ("machinery", "mach"),
    "electronics": ("electronics", "electr"),
    "construction": ("construction", "constr"),
    "manufacturing": ("manufacturing", "mfg"),
    "communications": ("communications", "comms"),
    "pharmaceuticals": ("pharmaceuticals", "pharma"),
    "environmental": ("environmental", "environ"),
    "automation": ("automation", "autom"),
    "consulting": ("consulting", "consultants"),
    "industries": ("industries", "industrial"),
    "materials": ("materials",),
    "equipment": ("equipment", "equip"),
    "chemicals": ("chemicals", "chemical", "chem"),
    "logistics": ("logistics",),
    "solutions": ("solutions",),
    "electric": ("electric", "electrical"),
    "services": ("services", "service"),
    "holdings": ("holdings", "holding"),
    "software": ("software",),
    "trading": ("trading", "traders"),
    "textiles": ("textiles", "textile"),
    "systems": ("systems", "syst"),
    "energy": ("energy",),
    "group": ("group",),
}
_LATIN_LEGAL = re.compile(r"(?:companylimited|coltd|limited|ltd|corporation|corp|incorporated|inc|llc|gmbh|plc|company)$")
_SHORT_TRADE = re.compile(r"\b(?:" + "|".join(f for forms in LATIN_TRADES.values() for f in forms if len(f) < 7) + r")\b")
#: Nicknames that don't begin like the name they stand for, and how those names begin in European languages.
NICKNAMES = {
    nick: tuple(stems.split())
    for line in """bill billy will willy willie liam:wil|bob bobby robin:rob|dick rick ricky richie:ric|jim jimmy jamie:jam jac|jack johnny jon hans jan:joh|ted teddy:the ed
    ned:ed|tony:ant|tom tommy:tho|mike mick mickey:mic|nick klaus:nic nik|steve:ste|dave:dav|joe joey josie jo:jos|kate katie kathy kat kasia kitty cathy katya:kat cat|
    liz lizzie beth betty lisa elsa ella lily:eli|maggie meg peggy greta madge margie rita polly molly:mar|sasha sandy xander lex:ale|andy drew:and|freddy freddie:fre alf|fritz:fri fre|
    charlie chuck:cha|hank harry:hen har|larry:lau law|gus:aug|abe:abr|becky:reb|cindy:cyn|gene:eug|gerry jerry:ger jer|jeff:jef geo|jenny:jen|lenny:leo|mandy:ama|nancy:ann|
    nell nelly:ele hel|pete:pet|sally:sar|sue suzy:sus|tina:chr|vicky:vic|walt wally:wal|zack:zac|lena:hel mag|matt:mat|paddy:pat|eddie:ed|benny:ben|danny:dan|ronnie:ron|bess:eli""".replace("\n", "|").split("|")
    if ":" in line
    for nicks, stems in [line.split(":")]
    for nick in nicks.split()
}
#: Weight of each rewriting (a moved character leaves all characters, so it tells more than a replaced one); those in NEEDS_UNIQUE count only where one organisation alone has the form.
WEIGHTS = {"legal": 110, "full": 100, "joined": 95, "nick": 90, "moved": 87, "typo": 85, "no_town": 80, "initial": 75, "no_trade": 70}
NEEDS_UNIQUE = ("no_town", "initial", "no_trade")
_FORMS = "id string, form string, kind string, body string, side string"


def plain_name(name: str) -> str:
    return unicodedata.normalize("NFKC", name).translate(_VARIANTS).strip()


def split_company(s: str, towns: set[str]) -> tuple[str, str, str, str]:
    """(town, brand, trade, legal form) of a Chinese company name without blanks; parts that are missing are empty."""
    town = ""
    if m := re.match(r"(.+?)\(([一-鿿]{2,3})\)(.*)$", s):
        if m[2] in towns:
            town, s = m[2], m[1] + m[3]
    if not town and (m := re.match(r"([一-鿿]{2,3}?)市(?=.{2})", s)) and m[1] in towns:
        town, s = m[1], s[m.end() :]
    if not town:
        for w in (3, 2):
            if s[:w] in towns and len(s) >= w + 2:
                town, s = s[:w], s[w:]
                break
    m = _LEGAL.search(s)
    if m and m.start() >= 2:
        s, legal = s[: m.start()], m[0]
    elif (m := _LEGAL_RUN.search(s)) and m.start() >= 2:
        s, legal = s[: m.start()], "公司"
    else:
        legal = ""
    s = re.sub(r"[()]", "", s)
    for trade in TRADES:
        if s.endswith(trade) and len(s) - len(trade) >= 2:
            return town, s[: -len(trade)], trade, legal
    for trade in TRADES:  # mistyped by one character
        for w in (len(trade), len(trade) - 1, len(trade) + 1):
            if w >= 1 and len(s) - w in (2, 3) and (w >= 2 or len(s) == 4) and within_one(s[-w:], trade):
                return town, s[:-w], trade, legal
    return town, s, "", legal


def split_latin(name: str) -> tuple[str, str] | None:
    """(brand, trade) of a company name in Latin letters whatever its token order; null for a person's name."""
    low = re.sub(r"\([^)]*\)", " ", name.lower()).replace("&", " and ")
    words = re.sub(r"[^a-z0-9]+", " ", low)
    s, short = words.replace(" ", ""), bool(_SHORT_TRADE.search(words))
    company = False
    while m := _LATIN_LEGAL.search(s):
        if m.start() < 3:
            break
        company, s = True, s[: m.start()]
    for trade, forms in LATIN_TRADES.items():
        for form in forms:
            if len(form) < 7 and not (short or company):
                continue
            if s.endswith(form) and len(s) > len(form) + 2:
                return s[: -len(form)], trade
            if s.startswith(form) and len(s) > len(form) + 2:
                return s[len(form) :], trade
    return (s, "") if company and len(words.split()) > 1 and re.search(r"\b(?:co|company|ltd|limited|corp|corporation|inc|llc)\b", words) else None


def split_person(name: str) -> tuple[str, str] | None:
    """(first name or initial, last name) of a person's name of two parts, in whatever order it was typed."""
    tokens = [t for t in re.split(r"[\s,.·]+", name) if t]
    if len(tokens) != 2 or not all(re.fullmatch(r"[A-Za-z'-]+", t) for t in tokens):
        return None
    first, last = tokens
    if "," in name or len(last) == 1 or (first.isupper() and len(first) > 1 and not last.isupper()):
        first, last = last, first
    return first.lower(), last.lower()


def typo_forms(head: str, body: str, tail: str) -> set[tuple[str, str, str, str]]:
    """Forms equal for two bodies exactly where they differ by one character replaced, left out, added, or moved.

    A replaced character leaves equal rests, place and length; a moved one equal rests and the same character; for one
    left out the whole of one side is the other's rest, so either side gives both under names that only the other side asks for.
    """
    out = {(f"{head}~w|{body}|{tail}", "k"), (f"{head}~x|{body}|{tail}", "u")}
    for i, c in enumerate(body):
        rest = body[:i] + body[i + 1 :]
        out |= {(f"{head}~{i}/{len(body)}|{rest}|{tail}", "b"), (f"{head}~m{c}|{rest}|{tail}", "m"), (f"{head}~x|{rest}|{tail}", "k"), (f"{head}~w|{rest}|{tail}", "u")}
    return {(form, "moved", "", "b") if side == "m" else (form, "typo", "", side) for form, side in out}


def first_name_forms(first: str, last: str) -> set[tuple[str, str, str, str]]:
    """Forms of nicknames and initials: the short side asks for a name that begins so, the long side for any short of it."""
    if len(first) == 1:
        return {(f"Pi{first}|{last}", "initial", "", "u"), (f"Pj{first}|{last}", "initial", "", "k"), (f"Pk{first}|{last}", "initial", "", "b")}
    out = {(f"Pj{first[0]}|{last}", "initial", "", "u"), (f"Pi{first[0]}|{last}", "initial", "", "k")}
    shorts = {first, *NICKNAMES.get(first, ())} if len(first) <= 6 else set()
    for short in shorts:
        out |= {(f"Pn{short}|{last}", "nick", "", "u"), (f"Pl{short}|{last}", "nick", "", "k")}
    if first not in NICKNAMES:
        for n in range(2, min(len(first), 7)):
            out |= {(f"Pl{first[:n]}|{last}", "nick", "", "u"), (f"Pn{first[:n]}|{last}", "nick", "", "k")}
    return out


def name_forms(name: str, towns: set[str]) -> set[tuple[str, str, str, str]]:
    """(form, kind, body, side): every canonical rewriting of one typed name. body is, for the kinds in NEEDS_UNIQUE, the part
    that the form leaves out, empty where the name has none. side is u or k for forms that count only while the
    name is looked up or only while it is looked for, b for both."""
    s = plain_name(name)
    both = lambda rows: {(form, kind, body, "b") for form, kind, body in rows}
    if re.search("[一-鿿]{2}", s):
        town, brand, trade, legal = split_company(re.sub(r"\s", "", s), towns)
        if len(brand) < 2:
            return set()
        out = set()
        if trade:
            out |= both([(f"C*|{brand}|{trade}", "no_town", town)])
        if town:
            out |= both([(f"C{town}|{brand}|*", "no_trade", trade)])
        if trade and (town or legal):
            core = re.sub("责任|[()]", "", legal)
            out |= both([(f"C{town}|{brand}|{trade}", "full", ""), (f"C{town}|{brand}|{trade}|{core}", "legal", "")])
            out |= typo_forms(f"C{town}|", brand, trade)
        if not trade and not town:
            out |= both([(f"C{brand}", "full", "")])
        return out
    if company := split_latin(s):
        brand, trade = company
        if len(brand) < 3:
            return set()
        out = both([(f"E{brand}|*", "no_trade", trade)])
        if trade:
            out |= both([(f"E{brand}|{trade}", "full", "")]) | typo_forms("E", brand, trade)
        return out
    joined = re.sub(r"[^a-z]", "", s.lower())
    if len(joined) < 5:
        return set()
    person = split_person(s)
    if person and len(person[0]) == 1:
        return first_name_forms(*person)
    out = both([(f"P{joined}", "joined", "")])
    if not person and re.fullmatch(r"[A-Za-z\s]+", s):  # blanks inside the parts: a nickname may be any start of the whole
        for n in range(2, min(7, len(joined) - 3)):
            out |= {f for f in first_name_forms(joined[:n], joined[n:]) if f[0][:2] == "Pn"}
    if person:
        first, last = person
        out |= both([(f"P{first}{last}", "joined", ""), (f"P{last}{first}", "joined", ""), (f"P{first}|{last}", "full", "")]) | first_name_forms(first, last)
        out |= typo_forms("P1", first, last) | typo_forms("P2", last, first)
    return out


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = (c.to_pylist() for c in batch.columns[:3])
        rows = [(i, *f) for i, n, towns in zip(*columns) for f in sorted(name_forms(n, set(towns or ())))]
        out = zip(*rows) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in out], ["id", "form", "kind", "body", "side"])


def _with_towns(names: DataFrame) -> DataFrame:
    """names and the towns each of them may begin with or hold in brackets.

    A town is what any name of the table writes with the suffix 市. Names and towns are joined as tables: the pieces of a name
    that could be a town are two or three characters at its start or in brackets.
    """
    tight = F.regexp_replace("name", r"(?U)\s", "")
    towns = names.select(F.regexp_extract(tight, r"^([一-鿿]{2,3}?)[市巿](?=..)", 1).alias("town")).where("town <> ''").distinct()
    pieces = F.array(F.substring(tight, 1, 2), F.substring(tight, 1, 3), F.regexp_extract(tight, r"[(（]([一-鿿]{2,3})[)）]", 1))
    found = names.select("id", "name", F.explode(F.array_distinct(pieces)).alias("town")).join(towns, "town").groupBy("id", "name").agg(F.collect_set("town").alias("towns"))
    return names.join(found, ["id", "name"], "left").select("id", "name", "towns")


def _best(unknown: DataFrame, known: DataFrame, others: DataFrame | None = None, own: bool = False) -> DataFrame:
    """(id, label) of each unknown id whose best rewriting belongs to one label of known only.

    The score of a form is its weight less ten for each doubling of the labels that share it, counted over known and others.
    Labels that share a form have the same score by it, so a form of several labels can only tie: each form is one
    row, with how many labels have it and the label where it is one, and is joined once however crowded it is.
    A name that has the part a form leaves out needs a label that has the same one, or none.
    own: the unknown ids are themselves among the labels; none meets itself or counts for its own rarity.
    """
    tagged = known.select("form", "label", "body", "side", F.lit(1).alias("is_known"))
    if others is not None:
        tagged = tagged.unionAll(others.select("form", "label", "body", "side", F.lit(0)))
    per = tagged.where("side <> 'u'").groupBy("form", "label").agg(F.array_remove(F.collect_set("body"), "").alias("bodies"), F.max("is_known").alias("is_known"))
    candidate = F.when(F.col("is_known") == 1, F.struct("label", "bodies"))
    held = per.groupBy("form").agg(F.count("*").alias("rarity"), F.sum("is_known").alias("n"), F.min(candidate).alias("lo"), F.max(candidate).alias("hi")).where("n > 0")
    asked = unknown.where("side <> 'k'").select("id", "form", "kind", "body").distinct()
    met = asked.join(held, "form").withColumn("o", F.col("lo"))
    if own:  # a form may be one that only the looking side has; then the id itself isn't among its labels
        mine = known.where("side <> 'u'").select(F.col("label").alias("id"), "form", F.lit(1).alias("mine")).distinct()
        met = met.join(mine, ["id", "form"], "left").withColumn("mine", F.coalesce("mine", F.lit(0)))
        other = F.when((F.col("mine") == 1) & (F.col("lo.label") == F.col("id")), F.col("hi")).otherwise(F.col("lo"))
        met = met.withColumns({"rarity": F.col("rarity") - F.col("mine"), "n": F.col("n") - F.col("mine"), "o": other}).where("n > 0")
    agree = (F.col("body") == "") | (F.size("o.bodies") == 0) | F.array_contains("o.bodies", F.col("body"))
    met = met.where(~F.col("kind").isin(*NEEDS_UNIQUE) | ((F.col("rarity") == 1) & agree))
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("kind"))
    scored = met.select("id", (weight - 10 * F.log2(F.col("rarity").cast("double"))).alias("score"), (F.col("rarity") > 1).alias("tied"), "o.label")
    by = scored.groupBy("id", "score").agg(F.bool_or("tied").alias("tied"), F.min("label").alias("label"), F.max("label").alias("last"))
    best = by.groupBy("id").agg(F.max_by(F.struct("tied", "label", "last"), "score").alias("b"))
    return best.where("not b.tied and b.label = b.last").select("id", "b.label")


def link_names(records: DataFrame) -> DataFrame:
    """(id, label): the ids of one organisation or person share a label, which is one of the ids.

    records: bidder_id, bidder_name, bidder_aliases and credit_code, one row an occurrence. Every name and alias is
    rewritten to all its canonical forms (town, brand, trade and legal form of companies; first and last name,
    nickname and initial of persons; one typed error in the brand or a name) and the forms are joined for equality.
    Ids with a registration code (the smallest of several) are organisations of their own: two of them never join, which
    is the exact check. An id without one gets the label of its best form, if that is one label only; then ids that only
    resemble such a variant follow it; the rest join one another where a whole name is equal or, by all forms, where the
    best one leads to a single other of the rest; chains of such ids are one.

    Blank ids and names count for nothing, null alias lists are empty, rows repeated at will count once, an id without
    any usable name is its own label, an empty table gives an empty result, other columns don't matter. Rows are reduced
    to distinct (id, name) before anything else, so an id that holds a third of all rows is a handful of names; a form that
    any number of labels share is one row.
    """
    named = records.where(F.col("bidder_id").rlike(r"(?U)\S"))
    squeezed = lambda c: F.regexp_replace(F.trim(c), r"(?U)\s+", " ")
    names = named.select(F.col("bidder_id").alias("id"), squeezed(F.col("bidder_name")).alias("name")).distinct()
    aliases = named.select(F.col("bidder_id").alias("id"), F.explode("bidder_aliases").alias("name")).select("id", squeezed(F.col("name")).alias("name"))
    names = durable(names.unionAll(aliases).where("name is not null and name <> ''").distinct(), "names")
    code = F.min(F.when(F.col("credit_code").rlike(r"(?U)\S"), F.trim("credit_code")))
    ids = durable(named.groupBy(F.col("bidder_id").alias("id")).agg(code.alias("code")), "ids")
    exploded = spread(_with_towns(names), "id", "name").mapInArrow(_explode, _FORMS).distinct()
    forms = durable(exploded.join(ids.select("id", F.col("code").isNotNull().alias("coded")), "id"), "forms")
    shape = ("form", "kind", "body", "side")
    known = forms.where("coded").select("id", *shape, F.col("id").alias("label"))
    unknown = forms.where("not coded").select("id", *shape)
    first = durable(_best(unknown, known), "labels1")
    variants = unknown.join(first, "id")
    open_ = unknown.join(first, "id", "left_anti")
    second = durable(_best(open_, variants, known), "labels2")
    rest = open_.join(second, "id", "left_anti")
    whole = rest.where(F.col("kind").isin("full", "legal", "joined"))
    heads = whole.groupBy("form").agg(F.min("id").alias("head"), F.count_distinct("id").alias("n")).where("n > 1")
    same = connected_components(whole.join(heads, "form"), "id", "head").select("id", F.col("component").alias("label"))
    left = rest.join(same, "id", "left").select(F.coalesce("label", "id").alias("id"), *shape).distinct()
    left = durable(left.withColumn("label", F.col("id")), "left")
    others = known.unionByName(variants).unionByName(open_.join(second, "id")).select("label", *shape).distinct()
    everyone = others.unionByName(left.drop("id"))
    alike = _best(left, everyone, own=True).join(left.select("label").distinct(), "label", "left_semi")
    third = connected_components(same.unionByName(alike), "id", "label").select("id", F.col("component").alias("label"))
    labels = first.unionAll(second).unionAll(third)
    return ids.select("id").join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def linked_pairs(labels: DataFrame) -> DataFrame:
    """(bidder_id_a, bidder_id_b) of any two ids with one label, the smaller first by code point."""
    a, b = (labels.select("label", F.col("id").alias(f"bidder_id_{s}")) for s in "ab")
    return a.join(b, "label").where("bidder_id_a < bidder_id_b").select("bidder_id_a", "bidder_id_b").distinct()
