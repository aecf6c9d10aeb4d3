import datetime
import random
import re

import pytest

from clueforge.llm.pii import PROVINCES, find_spans, permute, permute_date, personal_spans, pseudonym, redact, redact_texts, valid_id

FOUND = [
    ("邮箱：a.b-c@mail.example.com。", [("EMAIL", "a.b-c@mail.example.com")]), ("邮箱为X_Y＠corp.test.Lot B", [("EMAIL", "X_Y＠corp.test")]), ("write to x1[at]office.invalid or", [("EMAIL", "x1[at]office.invalid")]),
    ("mail a (at) b.example now", [("EMAIL", "a (at) b.example")]), ("规格@345V，频率51Hz", []), ("拨打138 1234 5678或", [("PHONE", "138 1234 5678")]), ("传真(029)1557393。", [("PHONE", "(029)1557393")]),
    ("电话021-15524690转2364，", [("PHONE", "021-15524690转2364")]), ("tel. +86-13812345678.", [("PHONE", "+86-13812345678")]), ("电话１３８１２３４５６７８）", [("PHONE", "１３８１２３４５６７８")]), ("ext 0571-1552192-7919. ", [("PHONE", "0571-1552192-7919")]),
    ("序列号13888062535，已登记", []), ("Serial 13889945466 applies", []), ("账面数18743059011.37元", []), ("合同编号：027760884656235574。", []), ("编号13888062535123", []),
    ("身份证880223197303092638）", [("ID_NUMBER", "880223197303092638")]), ("证件号码 780239 19690802 787X，", [("ID_NUMBER", "780239 19690802 787X")]), ("ID no. 720974198107162739 belongs to R. Mubagil.", [("ID_NUMBER", "720974198107162739"), ("PERSON", "R. Mubagil")]),
    ("身份证件 XU5904681，住枫泽省阁荻市宁棉嘉县岩棠麦街18号3号楼1407室。", [("ID_NUMBER", "XU5904681"), ("ADDRESS", "枫泽省阁荻市宁棉嘉县岩棠麦街18号3号楼1407室")]), ("收件地址 霜墨碧县枫冬路4号，谢谢", [("ADDRESS", "霜墨碧县枫冬路4号")]),
    ("材料寄至麦苇乐区沙鹭赤街62-5号。", [("ADDRESS", "麦苇乐区沙鹭赤街62-5号")]), ("or visit No. 13, Suliaoning Street, Muping. T", [("ADDRESS", "No. 13, Suliaoning Street, Muping")]), ("visit 179 Tiedanhe Ave., Shixue City. C", [("ADDRESS", "179 Tiedanhe Ave., Shixue City")]),
    ("现场踏勘定于79号厂区，采用双回路工艺", []), ("联系人：濮阳祎曜 手机:13812345678", [("PERSON", "濮阳祎曜"), ("PHONE", "13812345678")]), ("联系人：详见附件。负责人：采购人。", []), ("签到：洹栩樾、逄　蓁、桓笙琬。", [("PERSON", "洹栩樾"), ("PERSON", "逄　蓁"), ("PERSON", "桓笙琬")]),
    ("由缑霁先生保管钥匙", [("PERSON", "缑霁")]), ("请与张三工程师联系", [("PERSON", "张三")]), ("法定代表人王小明，身份证", [("PERSON", "王小明")]), ("Attn: Mr. Pelozok, Samuelle, phone 16352187282.", [("PERSON", "Pelozok, Samuelle"), ("PHONE", "16352187282")]),
    ("技术顾问：Josephane·Nesodas，已授权", [("PERSON", "Josephane·Nesodas")]), ("Contact: see annex.", []), ("The supplier holds the keys.", []), ("", []), ("@" * 50, []),
]


@pytest.mark.parametrize("text, want", FOUND)
def test_spans(text, want):
    assert [(k, text[s:e]) for k, s, e in find_spans(text)] == want


def test_spans_of_tables(spark):
    schema = "doc_id bigint, text string, value string, pii_type string"
    rows = [(1, "拨打13812345678", "v", "t"), (1, "拨打13812345678", "v", "t"), (2, None, "", ""), (3, "", "", ""), (None, "拨打13812345678", "", ""), (4, "字" * 200_000 + "，拨打13812345678", "", "")]
    out = sorted((r["doc_id"], r["start_pos"], r["value"]) for r in personal_spans(spark.createDataFrame(rows, schema)).collect())
    assert out == [(1, 2, "13812345678")] * 2 + [(4, 200_003, "13812345678")]
    assert personal_spans(spark.createDataFrame([], schema)).count() == 0
    red = redact_texts(spark.createDataFrame(rows, schema), b"kkkkkkkkkkkkkkkk")
    assert red.columns == ["doc_id", "text", "value", "pii_type"] and red.count() == len(rows)
    assert {r["text"] for r in red.where("doc_id = 2").collect()} == {None}


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one_to_one(size):
    assert sorted(permute(v, size, b"key", "x") for v in range(size)) == list(range(size))
    if size > 90:
        assert [permute(v, size, b"key", "x") for v in range(size)] != [permute(v, size, b"other", "x") for v in range(size)]


def test_pseudonyms_link_equal_values_and_keep_formats():
    same = {pseudonym("PHONE", t, b"kkkkkkkkkkkkkkkk") for t in ("13812345678", "138 1234 5678", "+86-13812345678", "008613812345678", "１３８１２３４５６７８", "(86)13812345678")}
    assert len(same) == 1 and re.fullmatch(r"1\d{10}", same.pop())
    land = {pseudonym("PHONE", t, b"kkkkkkkkkkkkkkkk") for t in ("(029)15573930", "029-15573930", "02915573930")}
    assert len(land) == 1 and land.pop().startswith("029")
    assert pseudonym("PHONE", "029-15573930转12", b"kkkkkkkkkkkkkkkk") == pseudonym("PHONE", "029-15573930-12", b"kkkkkkkkkkkkkkkk") != pseudonym("PHONE", "029-15573930", b"kkkkkkkkkkkkkkkk")
    one, two = pseudonym("ID_NUMBER", "88022319730309263X", b"kkkkkkkkkkkkkkkk"), pseudonym("ID_NUMBER", "880223 19730309 263x", b"kkkkkkkkkkkkkkkk")
    assert one == two and re.fullmatch(r"\d{17}[\dX]", one)
    datetime.datetime.strptime(one[6:14], "%Y%m%d")
    assert re.fullmatch(r"XU\d{7}", pseudonym("ID_NUMBER", "XU5904681", b"kkkkkkkkkkkkkkkk"))
    assert pseudonym("EMAIL", "A@b.test", b"kkkkkkkkkkkkkkkk") == pseudonym("EMAIL", "a[at]B.test", b"kkkkkkkkkkkkkkkk") != pseudonym("EMAIL", "a@c.test", b"kkkkkkkkkkkkkkkk")
    assert pseudonym("PERSON", "逄　蓁", b"kkkkkkkkkkkkkkkk") == pseudonym("PERSON", "逄蓁", b"kkkkkkkkkkkkkkkk") != pseudonym("PERSON", "逄蓁", b"jjjjjjjjjjjjjjjj")
    days = {permute_date(datetime.date(2000, 1, 1) + datetime.timedelta(n), b"kkkkkkkkkkkkkkkk") for n in range(3000)}
    assert len(days) == 3000 and permute_date(datetime.date(1800, 1, 1), b"kkkkkkkkkkkkkkkk") == datetime.date(1800, 1, 1)


def test_redaction_keeps_the_rest():
    out = redact("联系人：王小明，电话13812345678。谢谢", b"kkkkkkkkkkkkkkkk")
    assert re.fullmatch(r"联系人：\[PERSON:[0-9a-f]{32}\]，电话\[PHONE:1\d{10}\]。谢谢", out)


def test_pseudonyms_are_valid_and_apart():
    rnd, key = random.Random(4), b"k" * 16
    mobiles = sorted({f"1{rnd.randrange(3, 10)}{rnd.randrange(10**9):09d}" for _ in range(2000)})
    got = {pseudonym("PHONE", m, key) for m in mobiles}
    assert len(got) == len(mobiles) and all(re.fullmatch(r"1[3-9]\d{9}", g) for g in got)
    firsts = [f"{rnd.choice(PROVINCES)}{rnd.randrange(1, 70):02d}{rnd.randrange(1, 99):02d}{rnd.randrange(1950, 2005)}{rnd.randrange(1, 13):02d}{rnd.randrange(1, 29):02d}{rnd.randrange(1000):03d}" for _ in range(500)]
    valid = [f + c for f in firsts for c in "0123456789X" if valid_id(f + c)]
    new = [pseudonym("ID_NUMBER", v, key) for v in valid]
    assert len(valid) == 500 and len(set(new)) == len(set(valid)) and all(valid_id(n) and n[:2] in PROVINCES for n in new)
    every = {pseudonym("ID_NUMBER", firsts[0] + c, key) for c in "0123456789X"}  # a wrong check character doesn't meet the right one
    assert len(every) == 11 and sum(valid_id(e) for e in every) == 1
    old = {pseudonym("ID_NUMBER", f"110101{d:%y%m%d}123", key) for d in (datetime.date(1960, 1, 1) + datetime.timedelta(n) for n in range(400))}
    assert len(old) == 400


def test_short_keys_are_refused(spark):
    with pytest.raises(ValueError):
        redact_texts(spark.createDataFrame([], "doc_id bigint, text string"), b"short")


def test_names_and_numbers_outside_the_lists():
    """Hand-labelled: family names that no list holds, numbers that only their digits prove."""
    cases = [
        ("联系人:暴小明。", [("PERSON", "暴小明")]),
        ("项目负责人：麴义，电话", [("PERSON", "麴义")]),
        ("联系人：采购部，电话见下。", []),
        ("联系人：同上。", []),
        ("负责人：项目经理，", []),
        ("本人11010519491231002X于当日到场", [("ID_NUMBER", "11010519491231002X")]),
        ("批号110105194912310021入库", []),  # wrong check character, no label
        ("合同号88110105194912310021X", []),
        ("Reply-to tagi.so377#at#mail.example.org. Then", [("EMAIL", "tagi.so377#at#mail.example.org")]),
    ]
    for text, want in cases:
        assert [(k, text[s:e]) for k, s, e in find_spans(text)] == want, text


def test_many_spans_in_one_text_are_not_quadratic():
    text = "拨打13812345678；" * 30_000
    assert len(find_spans(text)) == 30_000
