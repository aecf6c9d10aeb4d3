"""Ids without a registration code among themselves."""

import itertools

from clueforge.llm.names import linked_pairs

from .test_entities import labels


def linked(spark, rows):
    return {tuple(r) for r in linked_pairs(labels(spark, [(i, n, a, None) for i, n, a in rows])).collect()}


def test_chain_of_whole_names_is_one(spark):
    one, two, three = "无牌号实业有限公司", "新门面商贸有限公司", "旧招牌物流有限公司"
    rows = [("a", one, None), ("b", one, [two]), ("c", two, None), ("d", three, [two]), ("e", three, None), ("z", "另一家电子有限公司", None)]
    assert linked(spark, rows) == set(itertools.combinations("abcde", 2))


def test_rewritings_join_uncoded_names(spark):
    towns = [(f"t{n}", f"{t}市某某{c}科技有限公司", None) for n, (t, c) in enumerate(itertools.product(("平蓼", "暮平"), "甲乙丙"))]
    groups = [
        ["平蓼市力限工物业服务有限公司", "平蓼市力限公物业服务有限公司"],  # one typed error
        ["平蓼市善鼎沃科技集团有限公司", "善鼎沃科技有限公司"],  # no town
        ["平蓼市启实毅机电设备有限公司", "平蓼启实毅"],  # no trade
        ["Josephane Lorijosot", "Lorijosot J."],  # initial
        ["Bamiminus Technology Ltd.", "Bamimnius Technology"],
    ]
    lone = ["平蓼市全新名能源有限公司", "暮平市全新名能源有限公司", "Katarzine Rigigipex", "Karolina Rigigipex", "Dafasativ Software Ltd.", "Dafasativ Logistics Ltd."]
    rows = towns + [(f"g{n}{k}", name, None) for n, g in enumerate(groups) for k, name in enumerate(g)] + [(f"x{n}", name, None) for n, name in enumerate(lone)]
    got = linked(spark, rows)
    assert {p for p in got if p[0][0] == "g"} == {(f"g{n}0", f"g{n}1") for n in range(len(groups))}
    assert not {i for p in got for i in p if i[0] == "x"}
