import itertools
import random

import pytest

from clueforge.llm.addresses import Gazetteer, assign_exactly, deletions, pairs_of, parse_address, place_heads, same_places, within_one
from clueforge.llm.names import link_names, linked_pairs, name_forms, split_company, split_latin, split_person

G = Gazetteer([("枫泽", "阁荻", "荷静祥", 9), ("松塔", "桐平", "辰蓼霞", 9), ("松塔", "桐平", "丹宁鹭", 9)])
SPELLINGS = [
    "枫泽省阁荻市荷静祥区铁福雅路69号", "荷静祥区铁福雅路六十九号B座719", "枫泽 阁荻市 荷静祥 铁福雅路门牌６９號", "铁福雅路No.69（枫泽省阁荻市荷静祥区）", "69#-320,铁福雅路,荷静祥区,阁荻市,枫泽省", "中国枫泽省-阁荻-荷静祥区-铁福雅路69号--864",
    "邮编771234 阁荻市荷静祥铁福雅路69#（近秋苇站）", "No.69，4栋25层,铁福雅路,荷静祥区,枫泽省", "枫泽省阁荻市荷静祥區鐵福雅路69号院内",
]


@pytest.mark.parametrize("raw", SPELLINGS)
def test_addresses_of_one_place(raw):
    assert parse_address(raw, G)[1:] == ("阁荻", "荷静祥", "铁福雅", "路", 69, False)


def test_latin_missing_and_unreadable_addresses():
    for raw in ("No. 69 Tiefuya Rd., Hejingxiang District, Gedi", "69# TIEFUYA RD.,Hejingxiang,Gedi", "Tiefuya Road 69, Hejingxiang County, Gedi City"):
        assert parse_address(raw, G) == (None, "阁荻", "荷静祥", "tiefuya", "路", 69, True)
    assert parse_address("阁荻市铁福雅路69号", G)[1:3] == ("阁荻", None)
    for raw in ("同上", "详见附件", "-", "", " ", None, "荷静祥区铁福雅路", "铁福雅路" * 10_000):
        assert parse_address(raw, G) is None


def test_one_typed_error():
    for a, b, want in (("abc", "abc", True), ("abc", "ab", True), ("abc", "abxc", True), ("abc", "axc", True), ("abc", "bac", True), ("abc", "cba", False), ("abcd", "badc", False), ("", "a", True)):
        assert within_one(a, b) is want and within_one(b, a) is want
        assert not want or deletions(a) & deletions(b)


RECORD = "record_id string, extra map<string,string>, n string, raw string, city string"


def places(spark, rows):
    return same_places(spark.createDataFrame([(i, {"地址": a} if isinstance(a, str) else a, "n", "r", "c") for i, a in rows], RECORD))


def test_places_typos_vetoes_and_missing_parts(spark):
    full = ["枫泽省阁荻市荷静祥区铁福雅路1号", "松塔省桐平市辰蓼霞区铁福雅路2号", "松塔省桐平市丹宁鹭区桑榆云路3号", "枫泽省阁荻市荷静祥区桑榆云路4号"]
    rows = [(f"g{n}-{k}", a) for n, a in enumerate(full) for k in range(4)]
    same = SPELLINGS[:4] + ["阁荻市铁福雅路69号5号楼", "荷静祥区铁雅路69号", "荷静祥区铁福福雅路69号", "荷静祥区福铁雅路69号", "荷静祥区铁福稚路69号", "69# TIEFUYA RD.,Hejingxiang,Gedi"]
    other = ["荷静祥区铁福雅路96号", "荷静祥区铁福雅街69号", "辰蓼霞区铁福雅路69号", "荷静祥区桑榆云路69号"]
    rows += [(f"s{n:02d}", a) for n, a in enumerate(same)] + [(f"x{n}", a) for n, a in enumerate(other)]
    rows += [("s00", same[0]), ("none", None), ("empty", {}), ("null", {"地址": None}), ("remark", {"备注": same[0]}), ("two", {"address": same[0], "地址": other[0]})]
    got = {tuple(r) for r in pairs_of(places(spark, rows)).collect()}
    good = {f"s{n:02d}" for n in range(len(same))} | {"two"}
    assert {p for p in got if set(p) <= good} == set(itertools.combinations(sorted(good), 2))
    assert {p for p in got if set(p) & good and not set(p) <= good} == {("two", "x0")}
    assert places(spark, []).count() == 0 and places(spark, [("a", None), ("b", {})]).count() == 0


def test_assignment_costs_least():
    """Equal to trying every assignment in which each centre is its own."""
    rnd = random.Random(8)
    for _ in range(150):
        n = rnd.randrange(1, 6)
        options = [{i: 0.0} | {j: rnd.choice([0.0, 1.0, 1.5]) for j in range(n) if j != i and rnd.random() < 0.5} for i in range(n)]
        opening = [rnd.choice([1.0, 3.0, 4.0]) for _ in range(n)]
        cost = lambda a: sum(options[i][c] for i, c in enumerate(a)) + sum(opening[c] for c in set(a))  # noqa: B023, E731
        every = [a for a in itertools.product(*[list(o) for o in options]) if all(a[c] == c for c in a)]
        got = assign_exactly(options, opening)
        assert tuple(got) in every and cost(got) == pytest.approx(min(map(cost, every)))


def test_an_earlier_join_does_not_decide_later_ones():
    """A chain a-b-c of typed errors is not one road where both ends are roads of their own; districts are a veto."""
    rows = [("甲", "铁福雅", False, 50, "铁福雅"), ("甲", "铁福桥", False, 1, "铁福桥"), ("甲", "银福桥", False, 50, "银福桥"), ("乙", "铁福雅", False, 50, "铁福雅"), ("", "银福桥", False, 2, "银福桥")]
    heads = place_heads(rows)
    assert heads[0] != heads[2] and heads[0] != heads[3] and heads[4] == heads[2] and heads[1] in (heads[0], heads[2])
    many = [("甲", "铁福雅", False, 99, "铁福雅")] + [("甲", "铁福" + chr(0x4E00 + k), False, 1, "铁福雅") for k in range(60)]
    assert len(set(place_heads(many))) == 1


def test_places_outside_the_test_tables(spark):
    """Hand-labelled addresses of real cities, with a postcode in place of the locality, and a mistyped district."""
    full = ["广东省广州市天河区体育东路138号", "湖北省武汉市洪山区珞喻路1037号", "四川省成都市武侯区人民南路17号", "湖南省长沙市岳麓区麓山南路932号"]
    groups = [
        [full[0], "邮编510620 广东省广州市天河区体育东路138号5楼", "邮编510620 体育东路138号", "广州天河体育东路一百三十八号", "体育东路138号1201室（广东省广州市天河区）", "广州市天河区体肓东路138号"],
        [full[1], "武汉市洪山区珞喻路1037号", "洪山区珞喻路1037号图书馆", "中国湖北省武汉市洪山区珞瑜路1037号"],
        [full[2], "成都市武侯区人民南路十七号", "四川 成都市 武侯 人民南路17号", "17号,人民南路,武侯区,成都市,四川省"],
        [full[3], "长沙市岳麓区麓山南路932号", "岳麓区麓山南路門牌932號"],
    ]
    rows = [(f"{g}-{k}", a) for g, members in enumerate(groups) for k, a in enumerate(members)]
    rows += [("x1", "广东省广州市天河区体育西路138号"), ("x2", "广东省广州市天河区体育东路183号"), ("x3", "湖南省长沙市岳麓区珞喻路1037号")] + [(f"f{k}{n}", a.rsplit("路", 1)[0] + f"路{n}号") for k, a in enumerate(full) for n in (2, 5, 8)]
    got = {tuple(r) for r in pairs_of(places(spark, rows)).collect()}
    want = {p for members in groups for p in itertools.combinations(sorted(f"{groups.index(members)}-{k}" for k in range(len(members))), 2)}
    assert len(got & want) >= 0.9 * len(want), want - got
    assert not {p for p in got - want if p[0][0] in "0123" or p[1][0] in "x"}


def test_names_apart():
    towns = {"平蓼", "暮平"}
    assert split_company("平蓼市力限工物业服务(集团)有限公司", towns) == ("平蓼", "力限工", "物业服务", "(集团)有限公司")
    assert split_company("力限工(平蓼)物业服有限公司", towns)[:3] == ("平蓼", "力限工", "物业服务")
    assert split_company("平蓼力限工", towns) == ("平蓼", "力限工", "", "")
    assert split_latin("Medical Devices Brebresapem Limited (Muping)") == ("brebresapem", "medicaldevices")
    assert split_latin("Vebrejo zot Eng. Co., Ltd.") == ("vebrejozot", "engineering") and split_latin("Dafasativ T ech Co Ltd") == ("dafasativ", "technology")
    assert split_latin("Josephane Lorijosot") is None
    assert split_person("LORIJOSOT Josephane") == split_person("Lorijosot, Josephane") == split_person("Josephane Lorijosot") == ("josephane", "lorijosot")
    assert split_person("Lorijosot J.") == split_person("J. Lorijosot") == ("j", "lorijosot")
    assert name_forms("", towns) == name_forms(" . ", towns) == set() and name_forms("字" * 5000, towns) is not None


NAMES = "bidder_id string, bidder_name string, bidder_aliases array<string>, credit_code string, id string, label string, code string"


def labels(spark, rows):
    return link_names(spark.createDataFrame([(*r, "i", "l", "c") for r in rows], NAMES))


def test_variants_are_linked_and_neighbours_are_not(spark):
    base = [("平蓼市力限工物业服务有限公司", "C1"), ("暮平市力限工物业服务有限公司", "C2"), ("平蓼市力限工电子有限公司", "C3"), ("平蓼市善鼎沃科技集团有限公司", "C4"), ("Bamiminus Technology Ltd.", "C5"), ("Bamiminus Instruments Ltd.", "C6"), ("Josephane Lorijosot", "C7"),
            ("Josephane Rigigipex", "C8"), ("暮平市启实毅机电设备有限公司", "C9"), ("Rigigipex Machinery Ltd.", "D1")]
    rows = [(f"b{n}", name, None, code) for n, (name, code) in enumerate(base)] + [(f"t{n}", f"{t}市某某{c}科技有限公司", None, f"T{n}") for n, (t, c) in enumerate(itertools.product(("平蓼", "暮平"), "甲乙丙"))]
    variants = {
        "平蓼市力限工物业服务（集团）有限公司": 0, "力限工（平蓼）物业服务有限责任公司": 0, "平蓼市力力限工物业服务有限公司": 0, "平蓼市限力工物业 服务有限公司": 0, "平蓼市力限工物业服務有限公司": 0, "暮平力限工": 1, "力限工电子有限公司": 2, "平蓼善鼎沃": 3, "平蓼市善鼎沃科技": 3,
        "BAMIMINUS TECH CO LTD": 4, "Technology Bamiminus Ltd. (Muping)": 4, "Bamimnius Technology": 4, "Bamiminus Instr. Ltd.": 5, "LORIJOSOT Josephane": 6, "Lorijosot J.": 6, "Jo Lorijosot": 6, "Josephnae Lorijosot": 6, "R igigipex, Josephane": 7, "启实毅机电设备": 8,
    }
    rows += [(f"v{n:02d}", name, [], " ") for n, name in enumerate(variants)]
    lone = ["力限工物业服务有限公司", "平蓼力限工", "Katarzine Lorijosot", "石雪市启实毅机电设备有限公司"]  # of two towns, of two trades, another person, another town
    rows += [(f"x{n}", name, None, None) for n, name in enumerate(lone)]
    rows += [("alias", "平蓼市全新名科技有限公司", None, None), ("b3", "平蓼市善鼎沃科技集团有限公司", ["平蓼市全新名科技有限公司", None, ""], "C4")]
    rows += [("u2", "无牌号实业有限公司", None, None), ("u1", "无牌号实业有限公司", None, None), ("nameless", None, None, None), (None, "平蓼市善鼎沃科技", None, None), (" ", "x", None, None)] + rows[:5]
    got = {r["id"]: r["label"] for r in labels(spark, rows).collect()}
    for n, (name, b) in enumerate(variants.items()):
        assert got[f"v{n:02d}"] == f"b{b}", name
    for n in range(len(base)):
        assert got[f"b{n}"] == f"b{n}"
    assert [got[f"x{n}"] for n in range(4)] == [f"x{n}" for n in range(4)]
    assert got["alias"] == "b3" and got["u2"] == got["u1"] == "u1" and got["nameless"] == "nameless" and None not in got and " " not in got
    pairs = {tuple(r) for r in linked_pairs(labels(spark, rows)).collect()}
    assert ("alias", "b3") in pairs and ("u1", "u2") in pairs and all(a < b for a, b in pairs)
    assert labels(spark, []).count() == 0


def test_names_outside_the_test_tables(spark):
    """Hand-labelled everyday names: nicknames, initials, order, typed errors, abbreviations, legal forms."""
    coded = ["William Turner", "Robert Baker", "Elizabeth Marlowe", "Katherine Osborne", "Margaret Whitfield", "Theodore Quimby", "James Hathaway", "Alexander Prescott", "Frederick Langley", "Samuel Ashdown",
             "Northgate Consulting Limited", "Silverlake Manufacturing Inc.", "Hanbury Electric Co., Ltd.", "广州市宏远达建筑工程有限公司", "武汉市长江源环保科技有限公司", "成都市蜀锦天软件股份有限公司"]
    typed = {
        "Bill Turner": 0, "Turner, Will": 0, "Wiliam Turner": 0, "Bob Baker": 1, "Rob Baker": 1, "BAKER Robert": 1, "Liz Marlowe": 2, "Beth Marlowe": 2, "Kate Osborne": 3, "O sborne Katherine": 3, "Maggie Whitfield": 4, "Peggy Whitfield": 4,
        "Ted Quimby": 5, "Theo Quimby": 5, "Jim Hathaway": 6, "Hathaway J.": 6, "Alex Prescott": 7, "Sasha Prescott": 7, "Alexanedr Prescott": 7, "Fred Langley": 8, "Sam Ashdown": 9, "Northgate Consultants Ltd.": 10, "NORTHGATE CONSULTING": 10,
        "Silverlake Mfg Inc": 11, "Silverlkae Manufacturing Inc.": 11, "Hanbury Electrical Company Limited": 12, "宏远达建筑工程有限公司": 13, "广州宏远达": 13, "广州市宏達远建筑工程有限公司": 13, "长江源(武汉)环保科技有限责任公司": 14, "武汉市长江元环保科技有限公司": 14, "成都市蜀锦天软件公司": 15,
    }
    apart = ["Brian Turner", "Roland Baker", "Edith Marlowe", "Kevin Osborne", "Southgate Consulting Limited", "广州市宏远达电子有限公司", "长沙市长江源环保科技有限公司"]
    rows = [(f"b{n:02d}", name, None, f"C{n}") for n, name in enumerate(coded)] + [(f"v{n:02d}", name, None, None) for n, name in enumerate(typed)] + [(f"x{n}", name, None, None) for n, name in enumerate(apart)]
    got = {r["id"]: r["label"] for r in labels(spark, rows).collect()}
    wrong = {name: got[f"v{n:02d}"] for n, (name, b) in enumerate(typed.items()) if got[f"v{n:02d}"] != f"b{b:02d}"}
    assert len(wrong) <= 0.1 * len(typed), wrong
    assert [got[f"x{n}"] for n in range(len(apart))] == [f"x{n}" for n in range(len(apart))]


def test_crowded_forms_are_joined(spark):
    """A rare form decides although another form is shared by hundreds of labels."""
    rows = [(f"k{n:03d}", f"平蓼市{chr(0x4E00 + n)}宏泰科技有限公司", None, f"C{n}") for n in range(300)]
    rows += [("k999", "平蓼市安宏泰科技股份有限公司", None, "D"), ("v1", "平蓼市安宏泰科技股份公司", None, None), ("v2", "平蓼市宏泰科技有限公司", None, None)]
    got = {r["id"]: r["label"] for r in labels(spark, rows).collect()}
    assert got["v1"] == "k999" and got["v2"] == "v2"


def test_random_single_errors_stay_linked(spark):
    rnd = random.Random(3)
    letters = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥"
    names = sorted({"".join(rnd.sample(letters, 3)) for _ in range(40)})
    names = [a for k, a in enumerate(names) if not any(within_one(a, b) or len(deletions(a) & deletions(b)) for b in names[:k])]
    rows = [(f"b{n}", f"平蓼市{x}科技有限公司", None, f"C{n}") for n, x in enumerate(names)]
    for n, x in enumerate(names):
        k = rnd.randrange(3)
        typed = rnd.choice([x[:k] + x[k + 1 :], x[:k] + "鑫" + x[k + 1 :], x[:k] + x[k] + x[k:], x[1] + x[0] + x[2]])
        rows.append((f"v{n}", f"平蓼市{typed}科技有限公司", None, None))
    got = {r["id"]: r["label"] for r in labels(spark, rows).collect()}
    assert sum(got[f"v{n}"] == f"b{n}" for n in range(len(names))) >= 0.9 * len(names)
    assert sum(got[f"v{n}"] not in (f"b{n}", f"v{n}") for n in range(len(names))) <= 1  # one error from two names at once
