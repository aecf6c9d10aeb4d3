"""Personal information in free text: spans by type, and typed placeholders with format-preserving pseudonyms."""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TYPES = ("EMAIL", "ID_NUMBER", "ADDRESS", "PHONE", "PERSON")  # where spans overlap the earlier type wins
_SPANS = "doc_id bigint, pii_type string, start_pos bigint, end_pos bigint, value string"

#: Family names of two characters, and of one (the most frequent and some rare ones).
COMPOUND = "欧阳 司马 上官 诸葛 夏侯 东方 皇甫 尉迟 公孙 慕容 令狐 宇文 长孙 司徒 司空 轩辕 端木 百里 呼延 南宫 西门 独孤 闻人 澹台 赫连 太史 申屠 公羊 濮阳 淳于 万俟 单于 钟离 拓跋".split()
SINGLE = (
    "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜"
    "范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
    "亓乜仉佴宓桓洹笪缑蒯訾逄郏鄢阙闫隗庞樊兰殷施陶洪翟安颜倪严牛芦季俞章鲁葛伍韦申尤毕聂丛焦柳邢岳齐沿梅莫庄辛管祝左涂谷祁舒耿牟卜詹苗凌费纪靳盛童欧甄项游阳裴席卫屈鲍位覃霍翁隋植甘景薄司柏宁柯阮桂闵解柴华冉辜吉饶刁瞿戚丘古米滕晋苑邬臧畅宫"
)
#: Words that follow a label of a person without being a name.
NOT_NAMES = "采购人 投标人 供应商 承包方 专家组 审计组 详见附件 见附件 同上 待定 无 另行通知 代理机构 监理单位 设计单位".split()

_CN = r"(?:(?:" + "|".join(COMPOUND) + r")[ 　]?[一-鿿]{1,2}|[" + SINGLE + r"][ 　]?[一-鿿]{1,2})"
_ANY = r"(?:(?:" + "|".join(COMPOUND) + r")[ 　]?[一-鿿]{1,2}|[一-鿿][ 　]?[一-鿿]{1,2})"
_LATIN = r"(?:[A-Z][a-z]+(?:-[A-Z][a-z]+)?(?:, ?| |·|•)[A-Z][a-z]+|(?:[A-Z]\. ?){1,2}[A-Z][a-z]+|[A-Z][a-z]+,? [A-Z]\.)"
_NAME = rf"(?:{_CN}|{_LATIN})"
_EACH = rf"{_ANY}(?:、{_ANY})*"
_PHONE_NEXT = r"[\s|，,、:：]{1,3}(?=[(（+＋]?[\d])"

_LABELS = "联系人|负责人|经办人|记录人|收件人|联络人|代表人|授权代表|委托人?|被授权人|受托人|项目经理|技术顾问|外方代表|签字人|申请人姓名|姓名"
#: How words for offices, roles and parties end, which a label may name instead of a person.
_OFFICE = r"(?:部|处|科|司|局|院|厅|办|站|所|组|队|室|方|中心|单位|公司|人员|代表|经理|电话|手机|邮箱|地址|日期|签字|盖章|职务|身份|证件|附件|信息|方式|名单|如下)"
_NOT_A_NAME = re.compile(rf"^(?:{'|'.join(NOT_NAMES)}|.*{_OFFICE})$|^(?:联系|电话|手机|身份|姓名|签字|盖章|日期|地址|不|未|均|为|由|及|与|或|已|应|须|需)")
#: (words one of which a text must have, a pattern it must hold, the pattern with the name in group 1, whether it lists several names)
PERSONS = [
    ((), re.compile(rf"(?:{_LABELS})[:： ]?[ 　]?({_NAME})(?=[，,。；;（(\s、]|$|联系|电话|手机|身份|证件|已)"), False),
    ((":", "："), re.compile(rf"(?:{_LABELS})[:：][ 　]?({_ANY})(?=[，,。；;（(\s]|$)"), False),
    ((), re.compile(rf"(?:监理工程师|总监|工程师|专家)({_CN})(?=已|签字|确认|到场)"), False),
    ((), re.compile(rf"(?:与会人员|参会人员|出席人员|签到|评委|与会者|参会者)[:： ][ 　]?({_EACH})(?=[。；;，,\s]|$|[A-Za-z])"), True),
    ((), re.compile(rf"(?:请与|会上|由|经|请|向|随|和|与)({_CN})(?=工程师|经理|先生|女士|复核|老师|主任|教授|处长|科长|同志)"), False),
    (("先生收", "女士收", "（收）", "(收)", "收。", "收，", "收；", "收\n", "收 ", "收　", "收\r", "收\t"), re.compile(rf"({_CN})(?=先生收|女士收|（收）|\(收\)|收[。，；\s])"), False),
    ((), re.compile(rf"(?:^|[\s。；;，,|！？）)])({_CN}){_PHONE_NEXT}", re.M), False),
    (("\t", "|"), re.compile(rf"({_CN})[\t|](?=[(（+＋]?\d[\d ()（）-]{{6}})"), False),
    (("Mr", "Ms", "Miss", "Dr", "Prof"), re.compile(rf"\b(?:Mr|Ms|Mrs|Miss|Dr|Prof)\.? ?({_LATIN})"), False),
    (("Contact", "Attn", "Name", "by", "for", "to", "Dear"), re.compile(rf"(?:Contact|Attn|Name|Signed by|Prepared by|ask for|belongs to|signed by|prepared by|Dear):? ?({_LATIN})"), False),
    ((" holds ", " approved ", " attended ", " signed ", " confirmed ", " reviewed ", " prepared "), re.compile(rf"({_LATIN})(?= (?:holds|approved|attended|signed|confirmed|reviewed|prepared) (?:the|this|a)\b)"), False),
    ((" phone ", " tel ", " tel. ", " at "), re.compile(rf"({_LATIN})(?=,? (?:phone|tel\.?|at) [(+\d])"), False),
]
_AT_SIGNS = ("@", "＠", "[at]", "(at)", "（at）", "[AT]", "(AT)", "#at#")
EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9][A-Za-z0-9._%+-]{0,63})( ?(?:@|＠|\[at\]|\(at\)|（at）|\[AT\]|\(AT\)|#at#) ?)([A-Za-z0-9][A-Za-z0-9-]*(?:\.[A-Za-z0-9-]+)+)"
)
_EXT = r"(?: ?(?:-|－|转|ext\.?|Ext\.?|x|#|分机) ?\d{2,6}(?!\d))?"
PHONE = re.compile(
    r"(?<![\d.A-Za-z/_])(?:[(（][+＋]?[8８][6６][)）][- ]?|(?:[+＋]|[0０]{2})[8８][6６][- ]?)?"
    rf"(?:[1１][3-9３-９]\d(?:[- ]?\d{{4}}){{2}}{_EXT}|(?:[(（][0０]?\d{{2,3}}[)）][- ]?|[0０]\d{{2,3}}[- ]?)\d{{7,8}}{_EXT})(?![\d]|[.．]\d|元)"
)
#: Runs that a number can begin in, found without a look at every character.
_NUMBER_RUN = re.compile(r"[(（+＋0０1１][\d()（）+＋ -]{5,}")
_NOT_PHONE = re.compile(r"(?:序列号|编号|出厂码|账面数|账号|凭证号?|Serial|serial|Contract no\.|no\.|金额|号码段|订单号?)[:： ]{0,2}$")
ID_NUMBER = re.compile(
    r"(?:身份证(?:件)?(?:号码|号)?|公民身份号码|证件(?:号码|号)?|持证|护照(?:号码|号)?|通行证(?:号码|号)?|ID (?:no|number|card)\.?|[Pp]assport(?: no\.?| number)?)[:： ]{0,3}"
    r"((?:\d{6} ?\d{8} ?\d{3}[\dXxＸｘ]|\d{15}|[A-Z]{1,2}\d{7,8})(?![\dA-Za-z]))"
)
#: An 18-digit number that its date and check character prove to be a personal one, whatever stands before it.
_PLAIN_ID = re.compile(r"\d{6} ?\d{8} ?\d{3}[\dXxＸｘ](?![\dA-Za-z])")
#: First two digits of the regions that give identity numbers.
PROVINCES = "11 12 13 14 15 21 22 23 31 32 33 34 35 36 37 41 42 43 44 45 46 50 51 52 53 54 61 62 63 64 65 71 81 82".split()
_HOUSE = r"\d{1,5}(?:-\d{1,4})?号(?:院|\d{1,3}(?:号楼|栋|幢|座)(?:\d{1,3}单元)?(?:\d{1,4}[室层])?|[A-Z]座(?:\d{1,4}室?)?|\d{1,3}[层室])?"
ADDRESS = re.compile(
    r"(?:地址|住址|寄至|寄往|送至|送达|家住|现住|居住于|，住|,住|住在|位于|住)[:： ]{0,2}(?=[一-鿿])"
    r"((?:中国)?(?:[一-鿿]{2,4}(?:省|自治区))?[ 　]?(?:[一-鿿]{2,4}市)?[ 　]?(?:[一-鿿]{2,5}[区县旗])?[ 　]?(?:[一-鿿]{1,6}[镇乡])?[一-鿿]{2,8}(?:路|街|大道|巷|道|胡同|弄)"
    rf"(?:门牌)?{_HOUSE})"
)
ADDRESS_EN = re.compile(
    r"\b((?:No\. ?)?\d{1,5},? (?:[A-Z][a-z]+ ){1,3}(?:Street|Road|Avenue|Lane|Ave\.?|St\.?|Rd\.?|Blvd\.?)(?:, (?:[A-Z][a-z]+ (?:District|County), )?[A-Z][a-z]+(?: City| Province)?)?)"
)


def _cut_email(m: re.Match) -> tuple[int, int] | None:
    """The span of an address; its domain ends before a label in another letter case ("mail.test.Lot")."""
    labels = m[3].split(".")
    keep = [labels[0]]
    for label in labels[1:]:
        if not label or (label[:1].isupper() and not (keep[-1].isupper() or keep[-1].isdigit())):
            break
        keep.append(label)
    if len(keep) < 2 or not re.fullmatch(r"[A-Za-z]{2,12}", keep[-1]):
        return None
    return m.start(), m.start(3) + len(".".join(keep))


def _phones(text: str) -> Iterator[tuple[int, int]]:
    last = 0
    for run in _NUMBER_RUN.finditer(text):
        for at in range(max(run.start(), last), run.end()):
            if text[at] in "(（+＋0０1１" and at >= last and (m := PHONE.match(text, at)):
                last = m.end()
                if not _NOT_PHONE.search(text, max(0, at - 14), at):
                    yield m.span()


def valid_id(number: str) -> bool:
    """Whether 18 characters are an identity number: an existing day of 1900 to 2099 and the right check character."""
    plain = unicodedata.normalize("NFKC", number).replace(" ", "").upper()
    return "1900" <= plain[6:10] <= "2099" and _day(plain[6:14]) is not None and _check_digit(plain[:17]) == plain[17]


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of each personal item of one text, in order, without overlaps."""
    found: list[tuple[int, int, int]] = []
    if any(sign in text for sign in _AT_SIGNS):
        for m in EMAIL.finditer(text):
            if span := _cut_email(m):
                found.append((0, *span))
    for m in ID_NUMBER.finditer(text):
        found.append((1, *m.span(1)))
    for m in _PLAIN_ID.finditer(text):
        if valid_id(m[0]) and not (m.start() and (text[m.start() - 1].isdigit() or text[m.start() - 1].isascii() and text[m.start() - 1].isalpha())):
            found.append((1, *m.span()))
    for m in ADDRESS.finditer(text):
        found.append((2, *m.span(1)))
    if any(word in text for word in ("Street", "Road", "Avenue", "Lane", "Ave", "St", "Rd", "Blvd")):
        for m in ADDRESS_EN.finditer(text):
            found.append((2, *m.span(1)))
    found += [(3, s, e) for s, e in _phones(text)]
    for words, pattern, several in PERSONS:
        if words and not any(word in text for word in words):
            continue
        for m in pattern.finditer(text):
            at = m.start(1)
            for name in m[1].split("、") if several else [m[1]]:
                if not _NOT_A_NAME.match(name):
                    found.append((4, at, at + len(name)))
                at += len(name) + 1
    used: list[tuple[int, int, int]] = []  # by place, without overlaps
    for kind, s, e in sorted(set(found), key=lambda x: (x[0], x[1], -x[2])):
        k = bisect.bisect_left(used, (s, e))
        if (k == 0 or used[k - 1][1] <= s) and (k == len(used) or used[k][0] >= e):
            used.insert(k, (s, e, kind))
    return [(TYPES[kind], s, e) for s, e, kind in used]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns: list[list] = [[], [], [], [], []]
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = text.as_py()
            for kind, s, e in find_spans(t) if t else ():
                for c, x in zip(columns, (doc_id, kind, s, e, t[s:e])):
                    c.append(x)
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "pii_type", "start_pos", "end_pos", "value"])


def personal_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, pii_type, start_pos, end_pos, value) of every personal item in text; 0-based code points, exclusive end.

    Each text is searched as a whole where it is read, nothing is shuffled. Null or empty texts and null doc_ids have
    none; equal rows give equal rows; other columns don't matter.
    """
    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(_run, _SPANS)


def _round(key: bytes, label: bytes, i: int, half: int) -> int:
    return int.from_bytes(hashlib.blake2b(label + bytes([i]) + half.to_bytes(16, "big"), key=key, digest_size=16).digest(), "big")


def permute(value: int, size: int, key: bytes, label: str, rounds: int = 8) -> int:
    """Keyed permutation of 0..size-1: a balanced Feistel network over the next even power of two, walked into range."""
    if size <= 1:
        return 0
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    while True:
        left, right = value >> bits, value & mask
        for i in range(rounds):
            left, right = right, left ^ (_round(key, label.encode(), i, right) & mask)
        value = left << bits | right
        if value < size:
            return value


def _digits(text: str) -> str:
    return "".join(str(unicodedata.digit(c)) for c in text if c.isdigit())


def _permute_digits(digits: str, key: bytes, label: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{label}{len(digits)}")).zfill(len(digits)) if digits else ""


def _permute_above(digits: str, low: int, high: int, key: bytes, label: str) -> str:
    """Keyed permutation of the numbers of this length whose first digit lies in low..high; others permute all digits."""
    if not digits or not low <= int(digits[0]) <= high:
        return _permute_digits(digits, key, label)
    unit = 10 ** (len(digits) - 1)
    return str(permute(int(digits) - low * unit, (high - low + 1) * unit, key, f"{label}{low}{len(digits)}") + low * unit)


_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2099, 12, 31)


def permute_date(day: datetime.date, key: bytes, first: datetime.date = _FIRST_DAY, last: datetime.date = _LAST_DAY) -> datetime.date:
    """Keyed permutation of the days of 1900 to 2099 (or first to last); others stay."""
    size = (last - first).days + 1
    at = (day - first).days
    return first + datetime.timedelta(permute(at, size, key, f"date{size}")) if 0 <= at < size else day


def _permute_region(region: str, key: bytes) -> str:
    """Keyed permutation of the regions made of a known province, a prefecture of 01 to 70 and a county of 01 to 99."""
    prefecture, county = int(region[2:4]), int(region[4:])
    if region[:2] not in PROVINCES or not 1 <= prefecture <= 70 or not county:
        return _permute_digits(region, key, "region")
    at = permute((PROVINCES.index(region[:2]) * 70 + prefecture - 1) * 99 + county - 1, len(PROVINCES) * 70 * 99, key, "region")
    return f"{PROVINCES[at // 99 // 70]}{at // 99 % 70 + 1:02d}{at % 99 + 1:02d}"


_CHECKS = "10X98765432"


def _check_digit(first17: str) -> str:
    """Check character of an 18-digit identity number (ISO 7064 MOD 11-2)."""
    total = sum(int(d) * pow(2, 17 - i, 11) for i, d in enumerate(first17))
    return _CHECKS[total % 11]


def _day(text: str) -> datetime.date | None:
    try:
        return datetime.date(int(text[:4]), int(text[4:6]), int(text[6:]))
    except ValueError:
        return None


def pseudonym(kind: str, value: str, key: bytes) -> str:
    """The same for equal values however they are written, different for different ones; of a number's own format.

    Mobile numbers permute among those that begin with 13 to 19, fixed ones behind their area code, beginning with 2 to 8.
    Identity numbers of 18 digits permute the region among known ones, the birth date among dates and the serial; the check
    character is off the right one by as much as it was, so valid numbers stay valid and others don't meet them. Those of
    15 digits permute region, date and serial; other numbers their digits. E-mail addresses, street addresses and names,
    which have no closed format, become a keyed tag of 128 bits.
    """
    text = unicodedata.normalize("NFKC", value)
    if kind == "PHONE":
        body, _, extension = re.sub(r"(?:转|ext\.?|Ext\.?|x|#|分机)", "~", text).partition("~")
        if not extension and (m := re.search(r"(?<=\d{7})-(\d{2,6})$", body)) and not re.match(r"\D*1", body):
            body, extension = body[: m.start()], m[1]
        d = re.sub(r"^(?:00)?86(?=1\d{10}$|0\d{9,11}$)", "", _digits(body))
        tail = "-" + _permute_digits(_digits(extension), key, "ext") if extension else ""
        if re.fullmatch(r"1[3-9]\d{9}", d):
            return "1" + _permute_above(d[1:], 3, 9, key, "mobile") + tail
        head = 3 if re.match(r"0(?:10|2\d)", d) else 4
        return d[:head] + _permute_above(d[head:], 2, 8, key, "phone") + tail
    if kind == "ID_NUMBER":
        plain = re.sub(r"\s", "", text).upper()
        if re.fullmatch(r"\d{17}[\dX]", plain) and (day := _day(plain[6:14])):
            first = _permute_region(plain[:6], key) + permute_date(day, key).strftime("%Y%m%d") + _permute_digits(plain[14:17], key, "serial")
            off = _CHECKS.index(plain[17]) - _CHECKS.index(_check_digit(plain[:17]))
            return first + _CHECKS[(_CHECKS.index(_check_digit(first)) + off) % 11]
        if re.fullmatch(r"\d{15}", plain) and (day := _day("19" + plain[6:12])):
            moved = permute_date(day, key, datetime.date(1900, 1, 1), datetime.date(1999, 12, 31))
            return _permute_region(plain[:6], key) + moved.strftime("%y%m%d") + _permute_digits(plain[12:], key, "serial15")
        return re.sub(r"\d+", lambda m: _permute_digits(m[0], key, "id"), plain)
    plain = re.sub(r"\s|　", "", text).casefold()
    if kind == "EMAIL":
        plain = re.sub(r"\[at\]|\(at\)|#at#", "@", plain)
    return hashlib.blake2b(f"{kind}:{plain}".encode(), key=key, digest_size=16).hexdigest()


def redact(text: str, key: bytes) -> str:
    """text with each personal item replaced by [TYPE:pseudonym]."""
    out, last = [], 0
    for kind, s, e in find_spans(text):
        out += [text[last:s], f"[{kind}:{pseudonym(kind, text[s:e], key)}]"]
        last = e
    return "".join([*out, text[last:]])


def redact_texts(documents: DataFrame, key: bytes) -> DataFrame:
    """documents with text redacted (null stays null); every other column and row stays as it is.

    The pseudonyms depend on the key and the value only, so equal values stay linked across documents and runs of one key,
    which must be secret (16 to 64 bytes; a ValueError says so).
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key for pseudonyms must have 16 to 64 bytes")
    names = documents.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([redact(t, key) if t else t for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names)

    return documents.mapInArrow(run, documents.schema)
