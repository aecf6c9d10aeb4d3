import itertools
import random

import numpy as np
import pytest

from clueforge.llm.codepoints import inside, plain, points, sliding, window_hashes
from clueforge.llm.leaks import SURE, find_leaks, greedy_tiles, reordered, whole_runs
from clueforge.llm.mixing import compose, mix, pivot, plan_rates, shares
from clueforge.llm.splitting import boundary_classes, split_texts
from clueforge.llm.tokens import VOCABULARY, encode, with_token_counts

DOCS = "doc_id bigint, text string, source string, n_tokens string, classes string"
ITEMS = "item_id bigint, item_text string, doc_id string"


def plainly(s):
    return "".join(map(chr, plain(points([s])[0])[0]))


def test_window_hashes_and_sliding_minima():
    rnd = np.random.default_rng(1)
    chars = rnd.integers(0, 5, 400).astype(np.uint32)
    for width in (1, 2, 3, 15, 60, 120, 400, 401):
        h = window_hashes(chars, width)
        assert len(h) == max(0, 401 - width)
        seen = {}
        for i in range(len(h)):
            assert seen.setdefault(chars[i : i + width].tobytes(), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)
    x = rnd.integers(0, 99, 50)
    for width in (1, 2, 7, 50):
        assert sliding(x, width).tolist() == [x[i : i + width].min() for i in range(51 - width)]
    assert inside(np.array([0, 3, 3, 7]), 7, 3).tolist() == [True, False, False, True, True]
    assert plainly("ＡＢＣ，１２３ x!") == "abc123x" and plainly("") == ""


def longest_common(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else 0)
        best, row = max(best, *new), new
    return best


def test_leaks_equal_brute_force(spark):
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("甲乙丙丁戊己庚辛壬癸abc") for _ in range(n))
    items = [(i, word(80)) for i in range(6)] + [(6, None), (7, ""), (8, "short"), (None, word(80)), (9, "ABC" * 12)]
    docs = []
    for d in range(40):
        i, k = rnd.randrange(6), rnd.randrange(10, 70)
        piece = items[i][1][:k]
        docs.append((d, word(30) + "，".join(piece) + " \n" + word(10) if d % 3 else word(30) + piece.upper() + word(20)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[1][1][40:] + word(5) + items[1][1][:40]), (102, items[1][1][40:] + word(5)), (103, "ａｂｃ" * 12)]
    df = spark.createDataFrame([(d, t, "s", "n", "c") for d, t in docs], DOCS)
    want = {}
    for (d, t), (i, x) in itertools.product(docs, items):
        n = longest_common(plainly(t or ""), plainly(x or ""))
        if d is not None and i is not None and n >= SURE:
            want[d, i] = max(n, want.get((d, i), 0))
    found = find_leaks(df, spark.createDataFrame([(i, x, "clash") for i, x in items], ITEMS)).collect()
    got = {}
    for r in found:
        got[r["doc_id"], r["item_id"]] = max(r["longest"], got.get((r["doc_id"], r["item_id"]), 0))
    assert got == want
    moved = next(r for r in found if r["doc_id"] == 102 and r["item_id"] == 1 and r["tiles"] == 2)
    assert moved["covered"] == 80 and moved["longest"] < 80  # passages in another order
    assert all(r["covered"] <= r["item_chars"] for r in found)


def tiles_by_hand(doc, item, least):
    """Greedy string tiling with three loops."""
    used_d, used_i, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and d + n not in used_d and i + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return out
        out.append((d, i, n))
        used_d |= set(range(d, d + n))
        used_i |= set(range(i, i + n))


def test_greedy_tiles_equal_three_loops():
    rnd = random.Random(5)
    for case in range(60):
        letters = "ab" if case % 3 else "abcdefgh"
        item = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 40)))
        parts = [item[a : a + rnd.randrange(1, 20)] for a in (rnd.randrange(len(item)) for _ in range(rnd.randrange(4)))]
        doc = "".join(rnd.choice(letters) * rnd.randrange(6) + p for p in [*parts, ""])
        for least in (2, 4, 7):
            got = greedy_tiles(*[np.array([ord(c) for c in x], np.uint32) for x in (doc, item)], least)
            assert got == tiles_by_hand(doc, item, least), (doc, item, least)
    same = np.full(20_000, 97, np.uint32)
    assert greedy_tiles(same, same[:9000]) == [(0, 0, 9000)]  # repetitive texts are not quadratic


def test_reordered_passages_are_found_by_coverage(spark):
    """Planted: an item's quarters in another order are no run of half the item, yet cover all of it."""
    rnd = random.Random(9)
    item = "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(120))
    quarter = [item[k : k + 30] for k in range(0, 120, 30)]
    filler = lambda: "".join(chr(0x7000 + rnd.randrange(2000)) for _ in range(25))
    docs = [
        (1, "。".join([filler(), quarter[3], filler(), quarter[1], quarter[0], filler(), quarter[2]])),
        (2, filler() + item[:70] + filler()),
        (3, filler() + quarter[2] + filler()),
        (4, filler() * 9),
    ]
    found = find_leaks(spark.createDataFrame([(d, t, "s", "n", "c") for d, t in docs], DOCS), spark.createDataFrame([(7, item, "")], ITEMS))
    assert [tuple(r) for r in reordered(found).collect()] == [(1, 7, 120, 30, 120, 4)]
    assert [tuple(r) for r in whole_runs(found).collect()] == [(2, 7, 120, 70, 70, 1)]
    assert found.count() == 3


def test_many_items_in_one_document_and_no_broadcast(spark, monkeypatch):
    rnd = random.Random(11)
    items = [(i, "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(40)), "") for i in range(150)]
    dump = [(1, "。".join(x[1] for x in items), "s", "n", "c"), (2, items[3][1] * 2, "s", "n", "c")]
    for most in (10**9, 0):
        monkeypatch.setattr("clueforge.llm.leaks.MOST_SENT", most)
        found = find_leaks(spark.createDataFrame(dump, DOCS), spark.createDataFrame(items, ITEMS)).collect()
        assert sorted((r["doc_id"], r["item_id"], r["longest"]) for r in found) == sorted([(1, i, 40) for i in range(150)] + [(2, 3, 40)])


def test_leaks_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert find_leaks(docs, items).count() == 0
    assert find_leaks(spark.createDataFrame([(1, "x" * 99, "", "", "")], DOCS), items).count() == 0
    assert find_leaks(docs, spark.createDataFrame([(1, "x" * 99, "")], ITEMS)).count() == 0


def test_pivot_keeps_mass_and_rounds():
    rnd = np.random.default_rng(4)
    total = np.zeros(40)
    p, size = np.full(40, 0.37), rnd.integers(1, 100, 40)
    for _ in range(2000):
        out = pivot(p, size, rnd)
        assert ((out > 0) & (out < 1)).sum() <= 1
        assert (out * size).sum() == pytest.approx((p * size).sum())
        total += out
    assert np.abs(total / 2000 - 0.37).max() < 0.06
    assert pivot(np.array([0.0, 1.0]), np.array([5, 5]), rnd).tolist() == [0, 1] and len(pivot(np.empty(0), np.empty(0), rnd)) == 0


def test_plan_rates():
    s = [{"source": "a", "target_share": 0.5, "max_repeats": 2, "n_tokens": 1000}, {"source": "b", "target_share": 0.4, "max_repeats": 3, "n_tokens": 100}, {"source": "c", "target_share": 0.1, "max_repeats": 9, "n_tokens": 0}]
    assert plan_rates(s) == pytest.approx({"a": 0.375, "b": 3.0})
    assert plan_rates(s, 2000) == pytest.approx({"a": 1.7, "b": 3.0})
    assert plan_rates(s, 10**9) == {"a": 2.0, "b": 3.0} and plan_rates([]) == {}


def test_mix_reaches_its_shares(spark):
    rnd = random.Random(6)
    rows = [(d, "词 and " * rnd.randrange(1, 60), "big" if d % 10 else "small", "", "") for d in range(6000)]
    rows += [(9001, None, "big", "", ""), (9002, "", "big", "", ""), (9003, "x", None, "", ""), (9004, "x", "other", "", ""), (None, "x", "big", "", ""), rows[0], rows[1]]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.7, 2, "x"), ("small", 0.2, 4, "x"), ("absent", 0.1, 3, "x"), (None, 0.5, 1, "x")], "source string, target_share double, max_repeats int, n_tokens string")
    got = mix(docs, targets)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, mix(docs.repartition(3), targets).collect()))
    caps = {"big": 2, "small": 4}
    assert all(1 <= r["copies"] <= caps[r["source"]] for r in got.collect()) and got.count() == got.select("doc_id").distinct().count()
    out = {r["source"]: r for r in shares(got, targets.where("source is not null")).collect()}
    assert out["absent"]["actual_share"] == 0 and out["big"]["actual_share"] == pytest.approx(7 / 9, abs=2e-3)
    assert compose(docs, got).count() == got.selectExpr("sum(copies)").first()[0]
    assert mix(docs.limit(0), targets).count() == 0 and mix(docs, targets.limit(0)).count() == 0
    fixed = mix(docs, targets, total_tokens=20_000).selectExpr("sum(copies * n_tokens)").first()[0]
    assert abs(fixed - 20_000) < 300


TEXT = "第一章 总则\n本项目由甲方组织实施，乙方配合。The bidder shall comply; see annex 3.\n\n" * 20 + "无标点" * 400 + "😀🎉" * 60


def test_token_counts_and_boundaries(spark):
    df = spark.createDataFrame([(1, TEXT, "", "", ""), (2, None, "", "", ""), (3, "", "", "", ""), (4, "\x00 ok", "", "", "")], DOCS)
    got = {r["doc_id"]: r["n_tokens"] for r in with_token_counts(df, ["doc_id"]).collect()}
    assert got[1] == len(encode(VOCABULARY, TEXT)) and got[2] == got[3] == 0
    classes, at = boundary_classes(TEXT)
    assert len(classes) == got[1] and at[0] == 0 and at[-1] == len(TEXT)
    assert all(TEXT[at[i + 1] - 1] == "\n" for i, c in enumerate(classes.decode()) if c == "p")


LIMITS = "profile string, max_tokens int, overlap_tokens int, doc_id string"


def test_pieces_fit_cover_and_overlap(spark):
    rnd = random.Random(8)
    texts = [TEXT, "短", "", None, "\n" * 900, " " * 900, "a" * 5000, "漢字かな交じり文。" * 300, "".join(chr(rnd.randrange(0x4E00, 0x9FFF)) for _ in range(3000)), "한국어 문장입니다. " * 200, "é" * 700]
    df = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(texts)] + [(None, TEXT, "", "", "")], DOCS)
    limits = {"small": (64, 8), "none": (100, 0), "large": (400, 50)}
    rows = split_texts(df, spark.createDataFrame([(p, *l, "x") for p, l in limits.items()] + [("small", 999, 8, "x"), (None, 5, 1, "x")], LIMITS)).collect()
    by = {}
    for r in rows:
        by.setdefault((r["profile"], r["doc_id"]), []).append(r)
    for (profile, doc), pieces in by.items():
        limit, overlap = limits[profile]
        text, end = texts[doc], 0
        pieces.sort(key=lambda r: r["piece"])
        assert pieces[0]["start_pos"] == 0 and pieces[-1]["end_pos"] == len(text)
        for k, r in enumerate(pieces):
            assert len(encode(VOCABULARY, text[r["start_pos"] : r["end_pos"]])) <= r["tokens"] <= limit
            assert k == 0 or (r["start_pos"] <= end and overlap <= r["overlap"] <= overlap + 3)
            assert r["end_pos"] > end
            end = r["end_pos"]
    want = {(p, d) for p, (limit, _) in limits.items() for d, t in enumerate(texts) if t and len(encode(VOCABULARY, t)) > limit}
    assert set(by) == want
    ends = [TEXT[r["end_pos"] - 1] for r in by["large", 0] if r["end_pos"] < TEXT.index("无标点")]
    assert set(ends) == {"\n"}


def test_pieces_of_nothing_and_of_impossible_limits(spark):
    docs, limits = spark.createDataFrame([], DOCS), spark.createDataFrame([("p", 64, 8, "")], LIMITS)
    assert split_texts(docs, limits).count() == 0 and split_texts(docs, limits.limit(0)).count() == 0
    with pytest.raises(ValueError, match="too little room"):
        split_texts(docs, spark.createDataFrame([("p", 10, 9, "")], LIMITS))
