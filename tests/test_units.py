from datetime import datetime
from decimal import Decimal

import numpy as np
import pytest

from clueforge.functions.money import stated_scale, with_sum
from clueforge.operators.units import exact_segments, hidden_units, to_common_unit, typed_sums, unit_changes

SCHEMA = "record_id string, amount string, control_amount string, amount_unit string, currency string, source_system string, extra map<string,string>, ingested_at timestamp, day int, number string"
NOW = datetime(2025, 1, 1)


def row(i, amount=None, unit=None, currency="CNY", extra=None, control=None, source="s", at=NOW):
    return (i, amount, control, unit, currency, source, extra, at, 7, "clash")


@pytest.mark.parametrize(
    "text, number, factor",
    [
        ("12.5", "12.5", None), ("１２．５万元", "12.5", "10000"), ("136万8351元", "1368351", "1"), ("RMB 1,461,000元", "1461000", "1"), ("¥1,412,650", "1412650", "1"),
        ("95.5 k CNY", "95.5", "1000"), ("2.5 million yuan", "2.5", "1000000"), ("0.02825945亿元", "0.02825945", "100000000"), ("3.09E5", "309000", None), ("0.0040686016亿", "0.0040686016", "100000000"), ("94.8（万元）", "94.8", "10000"),
        ("人民币壹佰陆拾贰万叁仟柒佰贰拾玖元伍角壹分", "1623729.51", "1"), ("大写：肆佰零柒万零玖佰柒拾柒元零肆分", "4070977.04", "1"), ("拾万元整", "100000", "1"), ("9万元整", "9", "10000"),
        ("待定", None, None), ("-5", None, None), ("下浮9.9%", None, None), ("壹批", None, None), ("", None, None), (None, None, None), ("5 apples", None, None),
    ],
)
def test_sums_as_typed(spark, text, number, factor):
    out = with_sum(spark.createDataFrame([(text,)], "t string"), "t", "number", "factor").first()
    want = lambda x: None if x is None else Decimal(x)
    assert out["number"] == want(number)
    if number is not None:
        assert out["factor"] == want(factor)


@pytest.mark.parametrize(
    "extra, factor",
    [
        ({"备注": "金额单位：万元"}, "10000"), ({"表头": "投标报价（千元）"}, "1000"), ({"表头": "投标报价/百万元"}, "1000000"), ({"unit_note": "amounts in 10k CNY"}, "10000"), ({"unit_note": "figures in CNY million"}, "1000000"),
        ({"计价单位": "元"}, "1"), ({"备注": "含税"}, None), ({}, None), (None, None),
    ],
)
def test_units_stated_in_extra(spark, extra, factor):
    df = spark.createDataFrame([(extra,)], "extra map<string,string>")
    assert df.select(stated_scale(df["extra"])).first()[0] == (None if factor is None else Decimal(factor))


def test_precedence_and_cases_left_out(spark):
    rows = [
        row("own", "2万元", "千元"), row("unit", "2", "千元", extra={"备注": "金额单位：万元"}), row("extra", "2", " ", extra={"备注": "金额单位：万元"}), row("yuan", "2", None), row("fen", "250", "分"),
        row("no-money", "2", "折"), row("own-beats-odd-unit", "2元", "批"), row("usd", "2", "元", "USD"), row("lower", "2", "元", "cny"), row("blank-currency", "2", "元", " "), row("null-currency", "2", "元", None),
        row("zero", "0", "元"), row("fine", "0.0040686016", "亿"), row("control", None, "万元", control="3"), row("nothing"), row("no-time", "5", None, at=None, source=None),
    ]
    out = to_common_unit(spark.createDataFrame(rows, SCHEMA))
    found = {(r["record_id"], r["field_name"]): r["value_fen"] for r in out.where("value_fen is not null").collect()}
    assert found == {
        ("own", "amount"): 2_000_000, ("unit", "amount"): 200_000, ("fine", "amount"): 40_686_016, ("extra", "amount"): 2_000_000, ("yuan", "amount"): 200, ("fen", "amount"): 250, ("own-beats-odd-unit", "amount"): 200,
        ("lower", "amount"): 200, ("blank-currency", "amount"): 200, ("null-currency", "amount"): 200, ("control", "control_amount"): 3_000_000, ("no-time", "amount"): 500,
    }
    assert to_common_unit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_exact_segments_equal_exhaustive_search():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        for least in (1, 2):
            x = rng.normal(size=n).round(2) + (np.arange(n) > n // 2) * rng.integers(0, 4)
            one = np.ones(n)
            got = exact_segments(one, x, x * x, 0.5, least)

            def cost(cuts):
                return sum(((x[i:j] - x[i:j].mean()) ** 2).sum() + 0.5 for i, j in cuts)

            best = None
            for mask in range(1 << (n - 1)):
                ends = [k + 1 for k in range(n - 1) if mask >> k & 1] + [n]
                cuts = list(zip([0, *ends[:-1]], ends))
                if all(j - i >= least for i, j in cuts) or len(cuts) == 1:
                    best = min(best, cost(cuts)) if best is not None else cost(cuts)
            assert got[0][0] == 0 and got[-1][1] == n
            assert cost(got) == pytest.approx(best)
    assert exact_segments(*[np.empty(0)] * 3, 1.0, 2) == []


def test_unit_change_in_a_history_is_reversed(spark):
    rng = np.random.default_rng(3)
    rows = []
    for day in range(60):
        for k in range(8):
            value = 10 ** rng.normal(5, 0.2) * (1e-4 if 20 <= day < 35 else 1)
            rows.append(row(f"{day}-{k}", f"{value:.6f}", at=datetime(2025, 1, 1 + day % 28, k) if day < 28 else datetime(2025, 2 + (day - 28) // 28, 1 + (day - 28) % 28, k)))
    df = spark.createDataFrame(rows, SCHEMA)
    moved = unit_changes(typed_sums(df)).where("shift <> 0").collect()
    assert [r["shift"] for r in moved] == [-4]
    fixed = {r["record_id"]: r["value_fen"] for r in to_common_unit(df).collect()}
    assert min(v for k, v in fixed.items() if k.startswith("25-")) > 1_000_000


def plain_programme(n, s, q, penalty, least):
    """Cost of the best segmentation by plain dynamic programming over all starts."""
    c, t, k = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, s, q))
    best = np.full(len(n) + 1, np.inf)
    best[0] = -penalty
    for j in range(least, len(n) + 1):
        i = np.arange(0, j - least + 1)
        best[j] = (best[i] + k[j] - k[i] - (t[j] - t[i]) ** 2 / (c[j] - c[i]) + penalty).min()
    return best[-1]


def test_pruned_search_equals_plain_programme_on_random_histories():
    rng = np.random.default_rng(7)
    for _ in range(2000):
        least = int(rng.integers(1, 7))
        size = int(rng.integers(2 * least, 70))
        n = rng.integers(1, 5, size).astype(float)
        s = n * (np.repeat(rng.normal(0, 2, 12), 6)[:size] * rng.integers(0, 2) + rng.normal(0, 0.7, size))
        q, penalty = s * s / n + rng.random(size), float(rng.choice([0.1, 0.5, 2, 8, 30]))
        cuts = exact_segments(n, s, q, penalty, least)
        cost = sum(q[i:j].sum() - s[i:j].sum() ** 2 / n[i:j].sum() + penalty for i, j in cuts) - penalty
        assert cuts[0][0] == 0 and cuts[-1][1] == size and min(j - i for i, j in cuts) >= least
        assert cost == pytest.approx(plain_programme(n, s, q, penalty, least), abs=1e-7)


def planted(seed=5, days=40):
    """One source that types yuan, then without any unit in ten thousands, with its stated values beside."""
    rng, rows = np.random.default_rng(seed), []
    for day in range(days):
        at = datetime(2025, 1 + day // 28, 1 + day % 28)
        for k in range(12):
            yuan = 10 ** rng.normal(6, 0.2)
            rows.append(row(f"p{day}-{k}", f"{yuan:.2f}", "元", at=at))
            rows.append(row(f"w{day}-{k}", f"{yuan / 1e4:.6f}", "万元", at=at))
            rows.append(row(f"u{day}-{k}", f"{yuan / (1e4 if day >= days // 2 else 1):.6f}", at=at))
    return rows


def no_search(sums, **_):
    return unit_changes(sums.where("false"))


def test_rows_need_the_search(spark):
    """Planted shift of unstated values: reversed by the search, left wrong without it."""
    df = spark.createDataFrame(planted(), SCHEMA)
    found, off = (to_common_unit(df, search=s).select("record_id", "value_fen", "agrees").collect() for s in (unit_changes, no_search))
    assert min(r["value_fen"] for r in found) > 10_000_000
    wrong = {r["record_id"] for r in off if r["value_fen"] < 10_000_000}
    assert wrong == {f"u{d}-{k}" for d in range(20, 40) for k in range(12)}
    assert all(r["agrees"] for r in found if r["record_id"][0] in "pw")


def test_hidden_units_are_recovered(spark):
    df = spark.createDataFrame(planted(), SCHEMA).where("record_id not like 'u%'")
    got = {r["power"]: (r["values"], r["found"]) for r in hidden_units(df).collect()}
    assert got == {0: (480, 480), 4: (480, 480)}
    assert hidden_units(df, search=no_search).count() == 0
    assert hidden_units(spark.createDataFrame([], SCHEMA)).count() == 0


def test_unstated_values_beside_another_unit_stay(spark):
    """A few unstated values next to the segment of another unit don't take that unit's shift."""
    rows = [r for r in planted() if r[0][0] == "w"] + [row(f"x{k}", "2500000", at=datetime(2025, 2, 1 + k)) for k in range(3)]
    out = {r["record_id"]: r["value_fen"] for r in to_common_unit(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {out[f"x{k}"] for k in range(3)} == {250_000_000}
