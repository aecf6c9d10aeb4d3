"""Similarity by blocks: equal texts and copies, many blocks, vectors from a join, repeated windows."""

import itertools
import random

import pytest

from clueforge.operators import documents as o
from clueforge.operators import similar as s

from .test_engines import DOC, PASSAGE
from .test_model_documents import cosines


def made(n, seed=3):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(150)) for _ in range(6)]
    return {k: base[k % 6][: rnd.randrange(100, 150)] + base[(k + 1) % 6][: rnd.randrange(0, 80)] + str(k) for k in range(n)}


def pairs(df):
    return {(r["doc_a"], r["doc_b"]): r["similarity"] for r in df.collect()}


def test_equal_texts_are_findings(spark, tmp_path):
    from clueforge.plans.documents import QUERIES

    near = PASSAGE * 2
    docs = [(1, near + "甲", "p", "a"), (2, near + "甲 ", "p", "b"), (3, near + "乙", "p", "c"), (4, near + "甲", "p", "d"), (5, near + "甲", "r", "e"), (6, "无", "r", "f"), (7, "无", "r", "g"), (8, None, "r", "h")]
    spark.createDataFrame(docs, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_a"], r["doc_b"]): r for r in QUERIES["docs_findings"](spark, str(tmp_path)).collect()}
    assert set(got) == set(itertools.combinations((1, 2, 3, 4), 2)) and all(r["finding"] for r in got.values())
    assert [got[p]["similarity"] for p in ((1, 2), (1, 4), (2, 4))] == [1, 1, 1]
    assert 0.75 <= got[1, 3]["similarity"] == got[2, 3]["similarity"] == got[3, 4]["similarity"] < 1
    assert pairs(QUERIES["docs_similar"](spark, str(tmp_path))) == {(1, 3): pytest.approx(got[1, 3]["similarity"], abs=1e-4)}


@pytest.mark.parametrize("held", [None, 0])
@pytest.mark.parametrize("block", [7, 4096])
def test_blocks_lose_nothing(spark, monkeypatch, block, held):
    monkeypatch.setattr(s, "BLOCK_DOCS", block)
    monkeypatch.setattr(s.meeting, "__defaults__", (block,))
    monkeypatch.setattr(o, "BIDDER_DOCS", block)
    monkeypatch.setattr(s, "HELD_GRAMS", s.HELD_GRAMS if held is None else held)
    texts = made(80)
    df = spark.createDataFrame([(n, t, "p", f"b{n % 30}") for n, t in texts.items()] + [(100, None, "p", "z")], DOC)
    every = cosines(texts)
    want = {p: c for p, c in every.items() if c >= 0.6}
    assert pairs(o.similar_documents(df, 0.6)) == pytest.approx(want) and want
    got = {(r["bidder_a"], r["bidder_b"]): r["similarity"] for r in o.bidder_similarities(df).collect()}
    largest = {("z", f"b{n}")[::-1]: 0.0 for n in range(30)}
    for (i, j), c in every.items():
        a, b = sorted((f"b{i % 30}", f"b{j % 30}"))
        if a != b:
            largest[a, b] = max(c, largest.get((a, b), 0))
    assert got == pytest.approx(largest)


def test_kernels_equal_all_pairs():
    import numpy as np

    texts = list(made(150).values())
    every = cosines(dict(enumerate(texts)))
    grams = [set(s._codes(t)) for t in texts]
    df = {g: sum(g in x for x in grams) for g in set().union(*grams)}
    known = sorted(g for g, n in df.items() if n > 1)
    vectors = s.Weights(np.array(known), np.array([df[g] for g in known]), len(texts)).vectors(texts)
    for a, b in ((np.arange(150), None), (np.arange(70), np.arange(70, 150))):
        x, y = s._sides(vectors, a, b)
        second = a if b is None else b
        want = {(int(i), int(j)): every[int(i), int(j)] for i in a for j in second if i < j}
        got = {(int(a[i]), int(second[j])): c[i - lo, j] for lo, hi, c in s.cosines(x, y) for i in range(lo, hi) for j in range(len(second)) if a[i] < second[j]}
        assert got == pytest.approx(want)
        near = {(int(a[i]), int(second[j])): c for p in s._similar(x, y, 0.5) for i, j, c in zip(*p)}
        assert near == pytest.approx({p: c for p, c in want.items() if c >= 0.5}) and near


@pytest.mark.parametrize("held", [4_000_000, 0])
def test_repeated_windows_equal_all(spark, held):
    texts = made(20)
    df = spark.createDataFrame([(n, t, "p", None) for n, t in texts.items()] + [(30, PASSAGE, "p", None), (31, PASSAGE, "r", None), (31, PASSAGE, "p", None), (32, "𠀀" + PASSAGE, "p", None), (33, "𠀀" + PASSAGE, "p", None)], DOC)
    rows = lambda w: {(r["segment"], r["doc_id"], r["start"]) for r in w.collect()}
    every, got = rows(o.windows(df.dropDuplicates(["doc_id"]))), rows(o.repeated_windows(df, held))
    count = {seg: sum(x[0] == seg for x in every) for seg in {x[0] for x in every}}
    assert {x for x in every if count[x[0]] > 1} <= got <= every and any(n > 1 for n in count.values())
