"""Sums of money typed in many units, brought to one unit; unit changes found in each source's history."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import filled, is_blank
from ..functions.money import scale_of, stated_scale, with_sum
from ..session import durable

FIELDS = ("amount", "control_amount")
#: Powers of ten between two recorded units that count as a change of unit (those of the money words, both ways).
KNOWN_SHIFTS = (-8, -6, -4, -3, -2, 2, 3, 4, 6, 8)
#: A history is ordered by kind (the power of ten of the stated unit, unstated values first), then by day.
KIND_DAYS = 1_000_000
_HISTORY = "source string, field_name string, first_at bigint, last_at bigint, level double, base double, shift int, values bigint, agreeing bigint"


def typed_sums(records: DataFrame, key: str = "record_id") -> DataFrame:
    """One row for each non-blank value: key, field_name, source, day, number, factor, stated, cny.

    factor is the unit in the value's own text, else amount_unit, else one stated in extra; stated is false where
    none of them names one. factor is null where amount_unit is what counts but is no unit of money.
    """
    long = records.select(
        F.col(key).alias("__key"),
        F.coalesce(filled(F.col("source_system")), F.lit("")).alias("source"),
        F.unix_date(F.to_date("ingested_at")).alias("day"),
        (is_blank(F.col("currency")) | (F.upper(F.trim("currency")) == "CNY")).alias("cny"),
        filled(F.col("amount_unit")).alias("__unit"),
        "extra",
        F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), filled(F.col(f)).alias("raw")) for f in FIELDS])).alias("e"),
    ).where("e.raw is not null")
    long = long.select("__key", "source", "day", "cny", "__unit", "extra", "e.field_name", "e.raw")
    parsed = with_sum(long, "raw", "number", "__own").withColumn(
        "__extra", F.when(F.col("__own").isNull() & F.col("__unit").isNull(), stated_scale(F.col("extra")))
    )
    factor = F.when(F.col("__own").isNotNull(), F.col("__own")).when(F.col("__unit").isNotNull(), scale_of(F.col("__unit"))).otherwise(F.col("__extra"))
    return parsed.withColumn("factor", factor).select(
        F.col("__key").alias(key),
        "field_name",
        "source",
        "day",
        "raw",
        "number",
        "factor",
        (F.col("__own").isNotNull() | F.col("__unit").isNotNull() | F.col("__extra").isNotNull()).alias("stated"),
        "cny",
    )


def exact_segments(count: np.ndarray, total: np.ndarray, square: np.ndarray, penalty: float, least: int) -> list[tuple[int, int]]:
    """Optimal segmentation of bins under a Gaussian cost plus a penalty a segment (pruned exact linear time search).

    The bins carry count, sum and sum of squares, so a segment's cost is its exact squared error over all values.
    Segments hold at least `least` bins (a shorter history is one). A start that loses at j to a cut at j can't win at any
    end from j + least on, where the segment after that cut is long enough; until then it stays. Half-open index ranges.
    """
    n = len(count)
    if n == 0:
        return []
    if n < 2 * least:
        return [(0, n)]
    c, t, q = (np.concatenate([[0.0], np.cumsum(x)]) for x in (count, total, square))
    best, back = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
    best[0] = -penalty
    starts, until = np.array([0]), np.array([n + 1])
    for j in range(least, n + 1):
        if j - least >= least:
            starts, until = np.append(starts, j - least), np.append(until, n + 1)
        held = until > j
        starts, until = starts[held], until[held]
        sums = t[j] - t[starts]
        value = best[starts] + q[j] - q[starts] - sums * sums / np.maximum(c[j] - c[starts], 1e-12) + penalty
        k = int(np.argmin(value))
        best[j], back[j] = value[k], starts[k]
        until[value - penalty > best[j] + 1e-9 * (1 + abs(best[j]))] = np.minimum(until, j + least)[value - penalty > best[j] + 1e-9 * (1 + abs(best[j]))]
    out, j = [], n
    while j > 0:
        out.append((int(back[j]), j))
        j = int(back[j])
    return out[::-1]


def _segment_history(penalty_scale: float, least: int, tolerance: float):
    def run(history: pd.DataFrame) -> pd.DataFrame:
        h = history.sort_values("at")
        n, s, q, known = (h[x].to_numpy(float) for x in ("n", "s", "q", "known"))
        everything = max(n.sum(), 1.0)
        spread = max(float(((q - s**2 / n).sum()) / everything), 1e-6)
        found = exact_segments(n, s, q, penalty_scale * spread * math.log(everything + 1), least)
        stated = ~np.isnan(known)
        levels = [s[i:j].sum() / n[i:j].sum() for i, j in found]
        # The level of sums in yuan: that of the values with a stated unit, brought to yuan; else of the heaviest segment.
        base = (s + np.where(stated, known, 0) * n)[stated].sum() / n[stated].sum() if stated.any() else levels[int(np.argmax([n[i:j].sum() for i, j in found]))]
        at, rows = h["at"].to_numpy(), []

        def shift_of(level: float) -> int:
            near = min(KNOWN_SHIFTS, key=lambda k: abs(level - base - k))
            return near if abs(level - base - near) <= tolerance else 0

        edge = int(np.searchsorted(at, KIND_DAYS))  # a segment over the edge is two, and both parts must show its shift
        parts = [(p, level) for (i, j), level in zip(found, levels) for p in ([(i, edge), (edge, j)] if i < edge < j else [(i, j)])]
        for (i, j), whole in parts:
            level = s[i:j].sum() / n[i:j].sum()
            shift = shift_of(level) if shift_of(level) == shift_of(whole) else 0
            agreeing = n[i:j][np.where(stated[i:j], known[i:j], 0) == -shift].sum()
            rows.append((at[i], at[j - 1], level, base, shift, int(n[i:j].sum()), int(agreeing)))
        out = pd.DataFrame(rows, columns=["first_at", "last_at", "level", "base", "shift", "values", "agreeing"])
        out.insert(0, "field_name", h["field_name"].iloc[0])
        out.insert(0, "source", h["source"].iloc[0])
        return out

    return run


def _placed(sums: DataFrame) -> DataFrame:
    """sums with known (the power of ten of the stated unit, null where none is) and at, the place in its history."""
    known = F.when(F.col("stated"), F.round(F.log10(F.col("factor").cast("double"))).cast("int"))
    kind = F.coalesce(F.col("known") + 10, F.lit(0)).cast("bigint")
    return sums.withColumn("known", known).withColumn("at", kind * KIND_DAYS + F.col("day"))


def unit_changes(sums: DataFrame, penalty_scale: float = 12.0, least_bins: int = 5, tolerance: float = 0.15, hide: bool = False) -> DataFrame:
    """Level segments of every (source, field) history of all its values as typed.

    sums: rows of typed_sums. A history holds log10 of the typed numbers, ordered by stated unit (unstated values
    first) and day, as one bin for each unit and day (count, sum and sum of squares), so a source that holds a third
    of all rows reaches its one task as at most a few rows a day; the exact penalised search runs over the bins.
    The base is the level of the source's sums in yuan, from its values with a stated unit. A segment whose level differs
    from it by a known power of ten (within tolerance) has that power as shift, all others 0; a segment that holds both unstated and
    stated values is given as two, each with the shift only where its own level shows it too. agreeing counts the values
    whose stated unit (yuan where none is) is what the shift says. Values in other currencies, not positive, without an
    arrival time or of no unit of money belong to no history. No such values: empty result. hide: every stated unit but yuan
    is kept from the search (base and agreeing know only yuan); it still orders the history.
    """
    value = F.log10(F.col("number").cast("double"))
    known = F.when(F.col("known") == 0, F.col("known")) if hide else F.col("known")
    bins = (
        _placed(sums.where("number > 0 and cny and day is not null and (not stated or factor is not null)"))
        .groupBy("source", "field_name", "at")
        .agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(value * value).alias("q"), F.first(known).cast("double").alias("known"))
    )
    return bins.groupBy("source", "field_name").applyInPandas(_segment_history(penalty_scale, least_bins, tolerance), _HISTORY)


def to_common_unit(records: DataFrame, key: str = "record_id", search=unit_changes) -> DataFrame:
    """(key, field_name, raw, number, factor, shift, agrees, cny, value_fen) for each non-blank value of amount and control_amount.

    value_fen is the sum in 1/100 yuan. Every value lies in a segment of its source's history (unit_changes): the segment's
    shift is the unit that the history shows. A stated unit decides (agrees says whether the history confirms it); a
    value without one is divided by the power of ten of its segment's shift, which is 1 where the history shows none.
    It is null for foreign currencies, texts that aren't one positive sum, and amount_units that aren't money. Null source
    systems form one history; rows without an arrival time have no segment. Extra columns are ignored; a repeated
    row gives a repeated result row.
    """
    sums = typed_sums(records, key)
    segments = durable(search(sums), "unit-changes")
    s, m = _placed(sums).alias("s"), segments.alias("m")
    joined = s.join(
        m,
        (F.col("s.source") == F.col("m.source")) & (F.col("s.field_name") == F.col("m.field_name")) & F.col("s.at").between(F.col("m.first_at"), F.col("m.last_at")),
        "left",
    ).select("s.*", F.coalesce("m.shift", F.lit(0)).alias("shift"))
    factor = F.when(F.col("stated"), F.col("factor")).otherwise(F.pow(F.lit(10.0), -F.col("shift").cast("double")).cast("decimal(24,10)"))
    fen: Column = F.round(F.col("number") * factor.cast("decimal(24,10)") * 100, 0)
    return joined.select(
        key,
        "field_name",
        "raw",
        "number",
        "factor",
        "shift",
        (F.coalesce("known", F.lit(0)) == -F.col("shift")).alias("agrees"),
        "cny",
        F.when(F.col("cny") & (F.col("number") > 0), fen.cast("bigint")).alias("value_fen"),
    )


def hidden_units(records: DataFrame, search=unit_changes) -> DataFrame:
    """(source, field_name, power, values, found): how many values of each stated unit the search recovers with the units hidden.

    Each source's values keep their order by unit, which makes a history of as many regimes as it has units, but none but
    yuan is told to the search (unit_changes with hide). power is the hidden unit's power of ten,
    found counts the values whose segment's shift is its opposite.
    """
    sums = typed_sums(records).where("number > 0 and cny and day is not null and (not stated or factor is not null)")
    segments = durable(search(sums, hide=True), "hidden-units")
    s, m = _placed(sums).alias("s"), segments.alias("m")
    on = (F.col("s.source") == F.col("m.source")) & (F.col("s.field_name") == F.col("m.field_name")) & F.col("s.at").between(F.col("m.first_at"), F.col("m.last_at"))
    power = F.coalesce("s.known", F.lit(0)).alias("power")
    by = s.join(m, on).groupBy("s.source", "s.field_name", power)
    return by.agg(F.count("*").alias("values"), F.count_if(F.col("m.shift") == -F.coalesce("s.known", F.lit(0))).alias("found"))
