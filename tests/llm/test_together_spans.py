import itertools
import random
from collections import Counter, defaultdict

import pytest

from clueforge.llm import spans, together
from clueforge.llm.spans import shared_share, shared_spans
from clueforge.llm.together import pairs_together

BASKETS = "basket string, item string, id bigint, n bigint, size string"


def brute_pairs(rows, least, lift):
    members = {(b, i) for b, i in rows if b and b.strip() and i and i.strip()}
    by, n = defaultdict(set), Counter()
    for b, i in members:
        by[b].add(i)
        n[i] += 1
    together_ = Counter(p for items in by.values() for p in itertools.combinations(sorted(items), 2))
    return {(a, b, c) for (a, b), c in together_.items() if c >= least and c * len(by) >= lift * n[a] * n[b]}


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_pairs_equal_brute_force(spark, seed):
    rnd = random.Random(seed)
    items = [f"i{k}" for k in range(30)]
    rows = []
    for b in range(60):
        size = 25 if b % 8 == 0 else rnd.randrange(1, 7)  # some baskets are far larger than the others
        for i in rnd.sample(items, size) + ["i1", "i2"] * (b % 7 == 0) + ["i0"] * (b % 3 == 0):
            rows.append((f"b{b}", i))
    rows += rows[:40] + [(None, "i1"), ("b1", None), (" ", "i1"), ("b2", "　")]
    df = spark.createDataFrame([(*r, 1, 2, "clash") for r in rows], BASKETS)
    got = pairs_together(df, "basket", "item", least=3, lift=1.5).collect()
    assert {(r["item_a"], r["item_b"], r["n_ab"]) for r in got} == brute_pairs(rows, 3, 1.5)
    assert all(r["log_odds_se"] > 0 for r in got)


def test_pairs_of_nothing(spark):
    assert pairs_together(spark.createDataFrame([], BASKETS), "basket", "item").count() == 0


def test_run_lengths_span_batches(spark):
    rows = [(k % 5, 1) for k in range(20_000)]
    df = spark.createDataFrame(rows, "code bigint, n bigint").repartition(7)
    assert {r["code"]: r["n"] for r in together.count_codes(df).collect()} == {k: 4000 for k in range(5)}


TEXTS = "doc_id bigint, part bigint, text string, mark string, at string, v string"


def brute_spans(rows, least):
    seen = defaultdict(set)
    for d, _, t in rows:
        for i in range(len(t or "") - least + 1):
            seen[t[i : i + least]].add(d)
    out = set()
    for d, p, t in rows:
        covered = set()
        for i in range(len(t or "") - least + 1):
            if d is not None and len(seen[t[i : i + least]] - {None}) > 1:
                covered.update(range(i, i + least))
        edges = sorted(covered)
        for _, g in itertools.groupby(enumerate(edges), lambda x: x[1] - x[0]):
            g = [x for _, x in g]
            out.add((d, p, g[0], g[-1] + 1))
    return out


def texts(seed):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("甲乙丙丁ab 😀") for _ in range(n))
    shared = [word(n) for n in (20, 24, 25, 60, 200)]
    rows = [(d, d % 2, word(rnd.randrange(0, 80)) + rnd.choice(shared) + word(rnd.randrange(0, 40)) + rnd.choice(shared)[3:50]) for d in range(40)]
    rows += [(1, 7, rows[2][2]), (90, 0, rows[2][2]), (91, 0, "x" * 300), (92, 0, "x" * 260 + "y"), (93, 0, None), (94, 0, ""), (95, 0, "short"), (1, 7, rows[2][2])]
    return rows


@pytest.mark.parametrize("seed, least, most", [(1, 24, 2_000_000), (2, 25, 0), (3, 40, 0), (4, 120, 2_000_000)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, least, most):
    monkeypatch.setattr(spans, "MOST_SENT", most)  # 0: the way without any broadcast
    rows = texts(seed)
    df = spark.createDataFrame([(*r, "m", "a", "v") for r in rows], TEXTS)
    got = [tuple(r) for r in shared_spans(df, least).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_spans(rows, least)


def test_spans_of_long_and_empty_tables(spark):
    rnd = random.Random(9)
    long = "".join(rnd.choice("abcdefgh") for _ in range(300_000))
    df = spark.createDataFrame([(1, 0, long, "", "", ""), (2, 0, "z" * 50 + long[1000:250_000], "", "", ""), (None, 0, long, "", "", "")], TEXTS)
    found = shared_spans(df, 120)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 1000, 250_000), (2, 0, 50, 249_050)]
    share = {r["doc_id"]: (r["n_chars"], r["shared_chars"]) for r in shared_share(df, found).collect()}
    assert share[1] == (300_000, 249_000) and share[2] == (249_050, 249_000)
    assert shared_spans(df.limit(0), 120).count() == 0
