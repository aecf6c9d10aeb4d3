"""The pair model over documents: every feature of document pairs by bidder pair."""

import itertools
import math
from collections import Counter

import pytest

from clueforge.operators import documents as o
from clueforge.operators import links as k
from clueforge.operators import model as m
from clueforge.operators import quotes as q

from .test_engines import DOC, PASSAGE, records


def cosines(texts):
    grams = {n: Counter(t[i : i + 3] for i in range(len(t) - 2)) for n, t in texts.items()}
    df = Counter(g for c in grams.values() for g in c)
    vec = {}
    for n, c in grams.items():
        v = {g: (1 + math.log(tf)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, tf in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vec[n] = {g: x / norm for g, x in v.items()}
    return {(a, b): sum(x * vec[b].get(g, 0) for g, x in vec[a].items()) for a, b in itertools.combinations(sorted(vec), 2)}


def test_matrix_holds_document_features(spark):
    alone = "其他事项与本项目的实施方案并不相干，投标人自行负责编制。"
    docs = [(1, PASSAGE * 2 + "电话13812345678。联系人：王小明，", "p", "b0"), (2, PASSAGE * 2 + "致电13812345678。联系人：王小明，", "p", "b1"), (3, alone, "p", "b2"), (4, alone, "p", "b3"), (5, alone[:20], "p", "b0")]
    df = spark.createDataFrame(docs, DOC)
    rows = records(spark, *[{"bidder_id": f"b{n}", "device_id": f"d{n}", "amount": str(90_000 + n * n * 7_003)} for n in range(4)])
    quotes = q.quote_rows(rows)
    matrix = m.pair_matrix(k.link_instances(k.link_rows(rows)), q.signal_instances(quotes), q.pairs_in(quotes), m.document_features(df))
    got = {(r["bidder_a"], r["bidder_b"]): r for r in matrix.collect()}
    assert len(got) == 6
    want = cosines({n: t for n, t, _, _ in docs if n != 4})  # 4 is a copy of 3
    assert got["b0", "b1"]["similarity"] == pytest.approx(want[1, 2])
    assert 0 < got["b0", "b2"]["similarity"] == pytest.approx(max(want[1, 3], want[3, 5]))  # the largest, and any
    assert got["b1", "b2"]["similarity"] == pytest.approx(want[2, 3]) and 0 < want[2, 3] < 0.75  # under the threshold of docs_similar
    assert got["b2", "b3"]["similarity"] == 1.0
    row = got["b0", "b1"]
    assert (row["shared_phones_count"], row["shared_contacts_count"], row["shared_emails_count"], row["shared_entity_type_count"]) == (1, 1, 0, 2)
    parts = o.segment_pairs(o.shared_segments(df)).where("doc_a = 1 and doc_b = 2").first()
    assert (row["repeated_segment_count"], row["repeated_segment_chars_k"]) == (parts["segments"], pytest.approx(parts["chars"] / 1000)) and row["repeated_segment_count"] > 0
    assert all(r["bidder_a"] < r["bidder_b"] for r in got.values())


def test_registered_model_reads_documents(spark, tmp_path):
    from clueforge.plans.model import QUERIES

    rows = records(spark, *[{"bidder_id": f"b{n}", "amount": str(90_000 + n)} for n in range(2)])
    rows.write.parquet(f"{tmp_path}/audit_records.parquet")
    docs = [(1, PASSAGE, "r", "b5"), (2, PASSAGE, "r", "b6"), (3, PASSAGE, "r", "b6"), (4, PASSAGE, None, "b7")]
    spark.createDataFrame(docs, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["project_id"], r["bidder_a"], r["bidder_b"]): r["similarity"] for r in QUERIES["model_whole_matrix"](spark, str(tmp_path)).collect()}
    assert got == {("p", "b0", "b1"): 0.0, ("r", "b5", "b6"): 1.0}
    sums = QUERIES["model_benchmark"](spark, str(tmp_path)).where("transform = 'nothing'").agg({"rows": "sum", "similarity": "sum"}).first()
    assert sums["sum(rows)"] == 2 and sums["sum(similarity)"] == pytest.approx(0.08 + 0.3)


def test_fit_takes_exact_medians(spark):
    import random
    import statistics

    from clueforge.schemas import MAD_TO_SIGMA, MODEL_FEATURES

    rnd = random.Random(4)
    rows = [(n % 2, *[round(rnd.random() ** 3, 9) if k < 2 else float(rnd.random() < 0.5) if k == 2 else 0.0 for k in range(len(MODEL_FEATURES))]) for n in range(30_000)]
    df = spark.createDataFrame(rows, "part int, " + ", ".join(f"{f} double" for f in MODEL_FEATURES)).repartition(5)
    for by in ((), ("part",)):
        got = {(*[r[b] for b in by], r["feature"]): r for r in m.fit(df, *by).collect()}
        assert len(got) == len(MODEL_FEATURES) * (2 if by else 1)
        for key, r in got.items():
            values = [x[1 + list(MODEL_FEATURES).index(key[-1])] for x in rows if not by or x[0] == key[0]]
            middle = statistics.median(values)
            mad = statistics.median(abs(v - middle) for v in values) * MAD_TO_SIGMA
            assert r["median"] == pytest.approx(middle, abs=1e-15)
            assert r["scale"] == pytest.approx(mad if mad >= 0.01 else max(statistics.pstdev(values), 1.0))


def matrix_rows(seed=7, n=600):
    import random

    from clueforge.schemas import MODEL_FEATURES

    rnd = random.Random(seed)
    value = lambda k: rnd.choice([0.0, 0.066, rnd.random() ** 2]) if not k else rnd.choice([1.0, rnd.random() * 30]) if rnd.random() < (0.6 if k in (4, 11) else 0.1) else 0.0
    return [(f"p{i % 11:02}", f"a{i}", f"b{i}", *[value(k) for k in range(len(MODEL_FEATURES))]) for i in range(n)]


def plain_model(rows):
    import statistics

    from clueforge.schemas import MAD_TO_SIGMA

    out = []
    for values in zip(*[r[3:] for r in rows]):
        middle = statistics.median(values)
        mad = statistics.median(abs(v - middle) for v in values) * MAD_TO_SIGMA
        out.append((middle, mad if mad >= 0.01 else max(statistics.pstdev(values), 1.0)))
    return out


def plain_score(row, model):
    from clueforge.schemas import MODEL_FEATURES

    return round(100 * (1 - math.exp(-sum(w * max((v - a) / b, 0) for v, (a, b), w in zip(row[3:], model, MODEL_FEATURES.values())) / 5)), 4)


def plain_threshold(scores):
    s, at = sorted(scores), 0.95 * (len(scores) - 1)
    low = int(at)
    return max(40.0, s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low))


def test_folds_and_evaluation_count_rows_without_repeating_them(spark, monkeypatch):
    from clueforge.schemas import MODEL_FEATURES

    rows = matrix_rows()
    df = spark.createDataFrame(rows, "project_id string, bidder_a string, bidder_b string, " + ", ".join(f"{f} double" for f in MODEL_FEATURES)).repartition(3)
    monkeypatch.setattr(m, "UNIT", 5)  # few buckets, divided until they are values
    monkeypatch.setattr(m, "DIVIDED", 40)
    monkeypatch.setattr(m, "LISTED", 9)
    got = {r["fold"]: r for r in m.cross_validate(df, 2).collect()}
    for fold in (0, 1):
        train, test = ([r for r in rows if (int(r[0][1:]) % 2 == fold) is own] for own in (False, True))
        model = plain_model(train)
        limit = plain_threshold([plain_score(r, model) for r in train])
        r = got[fold]
        assert (r["train"], r["test"]) == (len(train), len(test)) and r["threshold"] == pytest.approx(limit, abs=2e-4)
        assert r["flagged"] == sum(plain_score(t, model) >= limit for t in test)
    alike = m.counted_benchmark(df)
    assert alike.agg({"n": "sum"}).first()[0] == len(rows) * len(m.TRANSFORMS) > 2 * alike.count()
    made = [(r["split"], r["transform"], r["label"], "", "", *[r[f] for f in MODEL_FEATURES]) for r in m.benchmark(df).collect()]
    train = [r[2:] for r in made if r[0] == "train" and not r[2]]
    model = plain_model(train)
    limit = plain_threshold([plain_score(r, model) for r in train])
    ev = {r["transform"]: r for r in m.evaluate(df).collect()}
    for name, label, _ in m.TRANSFORMS:
        flags = [plain_score(r[2:], model) >= limit for r in made if r[0] == "test" and r[1] == name]
        assert (ev[name]["tp"] + ev[name]["fp"], ev[name]["fn"] + ev[name]["tn"]) == (sum(flags), len(flags) - sum(flags)), (name, label)
