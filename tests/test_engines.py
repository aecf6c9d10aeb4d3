"""Behaviour of the record engines on small fixtures."""


import pytest

from clueforge.operators import cooccurrence as c
from clueforge.operators import documents as o
from clueforge.operators import ingest as i
from clueforge.operators import links as k
from clueforge.operators import model as m
from clueforge.operators import quotes as q
from clueforge.operators.components import connected_components
from clueforge.operators.ranks import dense_ranks

RECORD = """record_id string, record_type string, project_id string, bidder_id string, bidder_name string, amount string, control_amount string, amount_unit string, quote_scope string,
 currency string, item_code string, unit_price string, ip_address string, device_id string, account_id string, network_role string, is_public_exit boolean, file_sha256 string, author string,
 pdf_producer string, created_at string, modified_at string, uploaded_at string, event_time string, agency_id string, is_winner boolean, bid_rank int, extra map<string,string>"""
FIELDS = [f.split()[0] for f in RECORD.replace("\n", " ").split(", ")]


def records(spark, *rows):
    base = {"record_type": "quote", "project_id": "p"}
    return spark.createDataFrame([tuple({**base, "record_id": str(n), **r}.get(f) for f in FIELDS) for n, r in enumerate(rows)], RECORD)


def fired(spark, *rows):
    out = q.signal_instances(q.quote_rows(records(spark, *rows))).collect()
    return {r["signal_type"] for r in out}


def amounts(*values, **more):
    return [{"bidder_id": f"b{n}", "amount": str(v), **more} for n, v in enumerate(values)]


@pytest.mark.parametrize(
    "values, want, never",
    [
        ((100_000, 110_000, 120_000), {"fixed_difference", "staircase_quote"}, {"fixed_ratio"}),
        ((100_000, 110_000, 121_000), {"fixed_ratio"}, {"fixed_difference"}),
        ((100_000, 145_000, 220_000), set(), {"fixed_difference", "fixed_ratio", "pairwise_price_distance"}),
        ((100_000, 100_100), {"pairwise_price_distance"}, {"control_price_ratio"}),
        ((100_000, 101_000, 102_000, 1_000_000), {"median_deviation"}, set()),
        ((510_123, 620_123, 740_123), {"repeated_price_tail"}, set()),
        ((80_000, 99_500, 100_000, 100_400), {"accompaniment_structure"}, set()),
    ],
)
def test_price_patterns(spark, values, want, never):
    got = fired(spark, *amounts(*values))
    assert want <= got and not never & got


def test_units_conflicts_and_control(spark):
    rows = q.quote_rows(
        records(
            spark, {"bidder_id": "a", "amount": "100", "amount_unit": "万元"}, {"bidder_id": "b", "amount": "1000000", "control_amount": "1010000"}, {"bidder_id": "c", "amount": "5", "amount_unit": "箱"},
            {"bidder_id": "d", "amount": "7"}, {"bidder_id": "d", "amount": "8"}, {"bidder_id": "e"}, {"bidder_id": "e"}, {"bidder_id": " ", "amount": "9"}, {"bidder_id": None, "amount": "9"},
        )
    )
    states = {r["bidder_id"]: (r["state"], r["amount"]) for r in q.totals(rows).collect()}
    assert states == {"a": ("compared", 1e6), "b": ("compared", 1e6), "c": ("excluded", None), "d": ("excluded", None), "e": ("missing", None)}
    frame = {(r["bidder_a"], r["bidder_b"], r["signal_type"]): r["status"] for r in q.quote_frame(rows).collect()}
    assert frame["a", "b", "pairwise_price_distance"] == "triggered" and frame["a", "b", "control_price_ratio"] == "triggered"
    assert frame["a", "c", "pairwise_price_distance"] == "excluded" and frame["a", "e", "pairwise_price_distance"] == "not_provided"
    assert frame["a", "b", "median_deviation"] == "not_provided" and frame["a", "b", "item_price_correlation"] == "not_provided"


def test_item_prices_move_together(spark):
    rows = [{"bidder_id": b, "quote_scope": "item", "item_code": f"i{n}", "unit_price": str(p * f)} for b, f in (("a", 1), ("b", 1.1)) for n, p in enumerate((100, 200, 300))]
    got = fired(spark, *rows)
    assert {"item_price_correlation", "item_rank_consistency"} <= got
    assert not fired(spark, *[r | {"unit_price": "5"} for r in rows])  # no variance, no correlation


def link(spark, *rows):
    frame = k.link_frame(k.link_rows(records(spark, *rows)))
    return {r["signal_type"]: r["status"] for r in frame.collect()}


def test_shared_address_public_exit_and_subnet(spark):
    a, b = {"bidder_id": "a", "ip_address": "10.0.0.1"}, {"bidder_id": "b", "ip_address": "10.0.0.1"}
    assert link(spark, a, b)["shared_full_ip"] == "triggered"
    out = {"is_public_exit": True}
    assert link(spark, a | out, b | out)["shared_full_ip"] == "excluded"
    assert link(spark, a | {"network_role": "Agency"}, b | out)["shared_full_ip"] == "excluded"
    b = b | {"ip_address": "10.0.0.9"}
    at = lambda r, t: r | {"event_time": f"2025-01-01 {t}:00"}
    assert link(spark, at(a, "10:00"), at(b, "13:00"))["shared_subnet_time"] == "no_signal"
    assert link(spark, at(a, "10:00"), at(b, "10:30"))["shared_subnet_time"] == "triggered"
    assert link(spark, at(a, "10:00"), at(b, "10:31"))["shared_subnet_time"] == "no_signal"


@pytest.mark.parametrize(
    "row, status",
    [
        ({"network_role": "platform"}, "excluded"), ({"network_role": "采购单位"}, "excluded"), ({"network_role": "proxy"}, "triggered"), ({"extra": {"ip_role": "agency_exit"}}, "excluded"), ({"extra": {"owner_type": "Procurement"}}, "excluded"),
        ({"extra": {"public_exit": "是"}}, "excluded"), ({"extra": {"is_public_exit": "no"}}, "triggered"), ({"network_role": "office", "extra": {"network_role": "platform"}}, "triggered"),
    ],
)
def test_public_exits_by_role_flag_and_extra(spark, row, status):
    a, b = ({"bidder_id": x, "ip_address": "198.51.100.10", "record_id": f"r{x}"} | row for x in "ab")
    got = link(spark, a, b)
    assert got["shared_full_ip"] == status


def test_excluded_addresses_and_lineage(spark):
    rows = [{"bidder_id": x, "ip_address": "203.0.113.8", "device_id": "d", "record_id": f"r{n}"} for n, x in enumerate("aab")]
    listed = k.link_rows(records(spark, *rows), ("203.0.113.8",))
    frame = {r["signal_type"]: r["status"] for r in k.link_frame(listed).collect()}
    assert frame["shared_full_ip"] == "excluded" and frame["shared_device"] == "triggered"
    lines = {(r["signal_type"], r["record_id"]) for r in k.link_lineage(k.link_rows(records(spark, *rows))).collect()}
    assert lines == {(s, f"r{n}") for s in ("shared_full_ip", "shared_device") for n in range(3)}


def test_values_times_and_missing(spark):
    a = {"bidder_id": "a", "device_id": "D1 ", "account_id": "x", "created_at": "2025-01-01 10:00:00", "author": "Li"}
    b = {"bidder_id": "b", "device_id": "d1", "account_id": "y", "created_at": "2025-01-01 10:04:00"}
    got = link(spark, a, b)
    assert got["shared_device"] == "triggered" and got["shared_account"] == "no_signal" and got["created_time_close"] == "triggered"
    assert got["shared_author"] == got["shared_file_creator"] == got["modified_time_close"] == "not_provided"
    assert set(link(spark, {"bidder_id": "a"}, {"bidder_id": "b"}).values()) == {"not_provided"}


def test_meetings_runs_winners_and_groups(spark):
    rows = []
    for n, (winner, day) in enumerate([("a", 20), ("b", 10), ("a", 1)]):
        rows += [
            {"project_id": f"p{n}", "bidder_id": x, "is_winner": x == winner, "event_time": f"2025-01-{day:02d} 10:00:00", "agency_id": "g", "bid_rank": 1} for x in "abc"
        ]
    r = records(spark, *rows)
    met = c.meetings(c.memberships(r), c.projects(r))
    ab = "bidder_a = 'a' and bidder_b = 'b'"
    assert c.longest_runs(met).where(ab).first()["longest_run"] == 3
    assert c.outcomes(met).where(ab).first()["switches"] == 2
    f = c.pair_features(r)
    assert {"stable_cooccurrence", "same_agency", "alternating_winner"} <= set(f.where(ab).first()["signals"].split(","))
    g = c.groups(f, c.memberships(r)).collect()
    assert len(g) == 1 and g[0]["members"] == 3 and g[0]["common_projects"] == 3 and g[0]["stable"]


def test_single_meeting_and_identifier_across_projects(spark):
    one = c.pair_features(records(spark, {"bidder_id": "a"}, {"bidder_id": "b"})).first()
    assert (one["together"], one["score"], one["level"]) == (1, 0, "none")
    far = c.pair_features(records(spark, {"bidder_id": "a", "device_id": "d", "project_id": "x"}, {"bidder_id": "b", "device_id": "d", "project_id": "y"})).first()
    assert (far["together"], far["signals"]) == (0, "shared_device")
    assert c.pair_features(records(spark, {"bidder_id": "a", "device_id": "d"}, {"bidder_id": "b", "device_id": "d"})).first()["signals"] == ""


def test_components_of_a_long_chain(spark):
    chain = [(f"n{n:03d}", f"n{n + 1:03d}") for n in range(40)] + [("z1", "z2"), ("z2", "z2"), (None, "z3")]
    out = connected_components(spark.createDataFrame(chain, "a string, b string"), "a", "b").collect()
    assert {r["id"]: r["component"] for r in out} == {f"n{n:03d}": "n000" for n in range(41)} | {"z1": "z1", "z2": "z1"}
    assert connected_components(spark.createDataFrame([], "a string, b string"), "a", "b").count() == 0


def test_dense_ranks(spark):
    values = [f"v{n:04d}" for n in range(500)]
    df = spark.createDataFrame([(v,) for v in values[::-1] * 2], "v string")
    assert {r["v"]: r["id"] for r in dense_ranks(df, "v").collect()} == {v: n for n, v in enumerate(values)}
    assert dense_ranks(df.limit(0), "v").count() == 0


DOC = "doc_id bigint, text string, project_id string, bidder_id string"
PASSAGE = "本项目的实施方案由甲方与乙方共同编制完成并经专家组审查通过后方可执行，任何一方不得擅自更改其中的技术路线与进度安排，违者承担相应责任。"


def test_entities_similarity_and_passages(spark):
    docs = [(1, PASSAGE * 2 + "电话13812345678。", "p", "a"), (2, PASSAGE * 2 + "致电13812345678。", "p", "b"), (3, "无关文字" * 30, "p", "c"), (4, None, "p", "d"), (5, "", "p", "e"), (6, PASSAGE, None, "f")]
    df = spark.createDataFrame(docs, DOC)
    found = o.entities(df)
    assert {(r["doc_id"], r["kind"], r["value"]) for r in found.collect()} == {(1, "phone", "13812345678"), (2, "phone", "13812345678")}
    assert [tuple(r) for r in o.shared_entities(found).collect()] == [("p", 1, 2, "phone", 1)]
    pairs = o.similar_documents(df, 0.75).collect()
    assert [(r["doc_a"], r["doc_b"]) for r in pairs] == [(1, 2)] and 0.75 <= pairs[0]["similarity"] <= 1
    assert o.similar_documents(df.limit(0)).count() == 0


def test_similarity_equals_all_pairs(spark):
    import itertools
    import math
    import random
    from collections import Counter

    rnd = random.Random(5)
    base = ["".join(rnd.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(120)) for _ in range(4)]
    texts = [(n, (lambda s: s[: rnd.randrange(60, 120)] + base[n % 3][: rnd.randrange(0, 60)])(base[n % 4]), "p", None) for n in range(24)]
    grams = {n: Counter(t[k : k + 3] for k in range(len(t) - 2)) for n, t, _, _ in texts}
    df = Counter(g for c_ in grams.values() for g in c_)
    vec = {}
    for n, c_ in grams.items():
        v = {g: (1 + math.log(tf)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, tf in c_.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[n] = {g: x / norm for g, x in v.items()}
    for t in (0.4, 0.75):
        want = {(a, b): sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) for a, b in itertools.combinations(sorted(vec), 2)}
        want = {p: s for p, s in want.items() if s >= t}
        got = {(r["doc_a"], r["doc_b"]): r["similarity"] for r in o.similar_documents(spark.createDataFrame(texts, DOC), t).collect()}
        assert got == pytest.approx(want)


def test_pages_are_cleaned(spark):
    body = "\n".join(f"正文第{n}行内容各不相同" for n in range(8))
    pages = [(1, n, f"公司投标文件\n{body}{n}\n- {n} -") for n in (1, 2, 3)] + [(1, 4, f"公司投标文件\n{body}3\n- 3 -"), (2, 1, None), (2, 2, "重复的一行文字\n重复的一行文字")]
    out = {(r["doc_id"], r["page_number"]): r for r in o.clean_pages(spark.createDataFrame(pages, "doc_id bigint, page_number int, text string")).collect()}
    assert out[1, 1]["cleaned_text"].startswith("公司投标文件") and "- 1 -" not in out[1, 1]["cleaned_text"]
    assert "公司投标文件" not in out[1, 2]["cleaned_text"]
    assert out[1, 4]["duplicate"] and out[1, 4]["cleaned_text"] == ""
    assert out[2, 2]["cleaned_text"] == "重复的一行文字" and (2, 1) not in out


def test_canonical_rows_and_issues(spark):
    raw = spark.createDataFrame([("quotes", "甲", "-10", "x1", "soon"), ("quote", " ", "", None, None)], "`记录类型` string, `投标人` string, total_price string, mystery string, event_time string")
    rows = i.canonical(raw)
    first = rows.first()
    assert first["bidder_name"] == "甲" and first["amount"] == "-10" and first["extra"] == {"mystery": "x1"}
    codes = [set(r[0]) for r in rows.select(i.issue_codes(rows)).collect()]
    assert codes[0] == {"unknown_record_type", "missing_project", "invalid_amount", "invalid_time"}
    assert codes[1] == {"missing_project", "missing_bidder", "missing_amount"}


def test_model_ranks_the_odd_pair_first(spark):
    rows = records(spark, *[{"bidder_id": f"b{n}", "device_id": "d" if n < 2 else f"d{n}", "amount": str(90_000 + n * n * 7_003), "project_id": p} for p in ("p", "r", "s", "t") for n in range(5)])
    matrix = m.pair_matrix(k.link_instances(k.link_rows(rows)), q.signal_instances(q.quote_rows(rows)), q.pairs_in(q.quote_rows(rows)))
    best = m.score(matrix, m.fit(matrix), m.PAIR).orderBy("score", ascending=False).first()
    assert (best["bidder_a"], best["bidder_b"]) == ("b0", "b1")
    made = m.benchmark(matrix)
    assert made.count() == matrix.count() * len(m.TRANSFORMS)
    assert made.groupBy("project_id").agg({"split": "min"}).count() == 4 and made.select("project_id", "split").distinct().count() == 4
    ev = {r["transform"]: r for r in m.evaluate(matrix).collect()}
    assert ev["nothing"]["fp"] == 0 and ev["everything"]["recall"] == 1.0 and ev["only_repeated_segment_count"]["fp"] == 0
    folds = m.cross_validate(matrix, 2).collect()
    assert len(folds) == 2 and all(r["train"] == r["test"] for r in folds)
