"""Exact quantiles without funnelling a column into one task.

Spark's exact ``percentile`` keeps every distinct value of the column in one
aggregation buffer, merged in a single final task.  ``quantiles`` selects the wanted
order statistics by radix instead: a DOUBLE is an integer of 64 bits that grows with it,
and each job counts the values by the next ``BITS`` bits, in the cells only that hold a
wanted rank, until a cell holds a single value.  So it takes at most five rounds whatever the
values are (infinite ones, tiny and huge ones, one value held by a third of all
rows), for all columns together, and there is one path for every size.

The driver receives at most ``2**BITS`` counts per wanted rank and job.  Interpolation is
linear between neighbouring order statistics (pandas/numpy ``linear``); an order
statistic that is hit exactly is returned as it is, also beside an infinite one.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 12
#: The first job takes the bits above this one: sign, exponent and four bits of the mantissa.
FIRST = 48
_MANTISSA = 52


def _guess(x: Column) -> Column:
    """The exponent of a number, or one beside it; NULL for 0."""
    return F.greatest(F.lit(-1022), F.least(F.lit(1023), F.floor(F.log2(F.abs(x)))))


def _part(x: Column, guess: Column) -> Column:
    return F.abs(x) / F.pow(F.lit(2.0), guess.cast("double"))  # exact: a power of two


def ordered_bits(x: Column, guess: Column | None = None, part: Column | None = None) -> Column:
    """A DOUBLE without NaN as a BIGINT that grows with it: the bits of its amount, with its
    sign (both zeros are 0).  ``guess`` and ``part`` save the logarithm and the power where
    they are columns already."""
    size = F.abs(x)
    guess = _guess(x) if guess is None else guess
    part = _part(x, guess) if part is None else part
    unit = F.lit(1 << _MANTISSA)

    def whole(exponent, mantissa):  # mantissa in [1, 2)
        return (exponent + 1022) * unit + (mantissa * unit.cast("double")).cast("bigint")

    normal = F.when(part >= 2, whole(guess + 1, part / 2)).when(part < 1, whole(guess - 1, part * 2)).otherwise(whole(guess, part))
    small = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")  # below the normal numbers
    bits = F.when(size == float("inf"), F.lit(2047 << _MANTISSA)).when(size >= 2.0**-1022, normal).otherwise(small)
    return F.when(x < 0, -bits).otherwise(bits)


def _between(a: float, b: float, share: float) -> float:
    return a if share == 0 or a == b else a + (b - a) * share


def _column(name: str) -> Column:
    x = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(x), x)


def quantiles_of(df: DataFrame, wanted: Mapping[str, Sequence[float]]) -> dict[str, list[float | None]]:
    """Quantiles of the non-NULL, non-NaN values of several columns (None for a column
    without any), all columns in one job a round."""
    names = list(wanted)
    if not names:
        return {}
    values = df.select(*[_column(c).alias(f"v{i}") for i, c in enumerate(names)])
    values = values.withColumns({f"g{i}": _guess(F.col(f"v{i}")) for i in range(len(names))})
    values = values.withColumns({f"p{i}": _part(F.col(f"v{i}"), F.col(f"g{i}")) for i in range(len(names))})
    found: dict[tuple[int, int], float] = {}  # (column, rank): value
    cells: dict[tuple[int, int], tuple[int, set[int]]] = {}  # (column, leading bits): rank of the first value, wanted ranks
    sizes: dict[int, int] = {}
    shift = FIRST
    for at in range(FIRST, -1, -BITS):
        parts = []
        for i in range(len(names)):
            v = F.col(f"v{i}")
            bits = ordered_bits(v, F.col(f"g{i}"), F.col(f"p{i}"))
            open_cells = [cell for column, cell in cells if column == i]
            inside = v.isNotNull() if at == FIRST else F.shiftright(bits, shift).isin(open_cells) if open_cells else None
            if inside is not None:
                parts.append(F.when(inside, F.struct(F.lit(i).alias("i"), F.shiftright(bits, at).alias("cell"), v.alias("v"))))
        if not parts:
            break
        # no lambda here: generated code works out each number's bits once
        rows = values.select(F.explode(F.array(*parts)).alias("x")).where("x is not null").groupBy("x.i", "x.cell").agg(
            F.count(F.lit(1)).alias("n"), F.min("x.v").alias("a"), F.max("x.v").alias("b")).collect()
        if at == FIRST:
            for i, c in enumerate(names):
                n = sizes[i] = sum(r["n"] for r in rows if r["i"] == i)
                ranks = {int(f((n - 1) * p)) for p in wanted[c] for f in (math.floor, math.ceil)} if n else set()
                cells[i, 0] = 0, ranks
        after: dict[tuple[int, int], tuple[int, set[int]]] = {}
        before: dict[tuple[int, int], int] = {}
        for r in sorted(rows, key=lambda r: (r["i"], r["cell"])):
            outer = r["i"], 0 if at == FIRST else r["cell"] >> (shift - at)
            first, ranks = cells[outer]
            first += before.get(outer, 0)
            before[outer] = before.get(outer, 0) + r["n"]
            here = {k for k in ranks if first <= k < first + r["n"]}
            if r["a"] == r["b"]:
                found.update({(r["i"], k): r["a"] for k in here})
            elif here:
                after[r["i"], r["cell"]] = first, here
        cells, shift = after, at
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(names):
        at_rank = [(sizes[i] - 1) * float(p) for p in wanted[c]]
        out[c] = [_between(found[i, math.floor(h)], found[i, math.ceil(h)], h - math.floor(h)) if sizes[i] else None for h in at_rank]
    return out


def quantiles(df: DataFrame, col: str, probs: Sequence[float], *, exact: bool = True,
              accuracy: int = 100_000) -> list[float | None]:
    """Quantiles of the non-NULL, non-NaN values of ``col`` (None if there are none)."""
    if exact:
        return quantiles_of(df, {col: list(probs)})[col]
    v = df.select(_column(col).alias("_v")).where(F.col("_v").isNotNull())
    q = v.agg(F.percentile_approx("_v", [float(p) for p in probs], accuracy).alias("q")).first()["q"]
    return list(q) if q is not None else [None] * len(probs)
