"""Sums of doubles that do not depend on the order of the rows.

Adding doubles rounds at every step, so the last digits of a sum follow the order in which
parts arrive, and two equal groups may differ. Here each number is cut into whole multiples of
a few powers of two, which a bigint adds without rounding; only the finished sum becomes a
double again. Any partitioning gives the same bits, and equal sums are equal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderline.functions import present

# Multiples of 2**-80, 2**-49, 2**-18, 2**13 and 2**44, 31 bits of each: a bigint holds the
# sum over 2**32 rows. The parts of a number are added up where it is below 2**75 (3.8e22).
BITS = 31
MASK, PAIR = 2**BITS - 1, 2 ** (2 * BITS) - 1
TOP, MIDDLE, LOWEST = 44, -18, -80
LIMIT = 2.0**75


def _col(name: str, c: str) -> Column:
    return F.col(f"`_{name}_{c}`")


def _named(name: str, c: str, made: Column) -> Column:
    return made.alias(f"_{name}_{c}")


def _kept(df: DataFrame, columns: Sequence[str], old: Sequence[str], make) -> DataFrame:
    """All columns but ``old`` parts, with new ones.

    Each step is a projection of its own: as one expression a sum would hold thousands of terms.
    """
    gone = {f"_{name}_{c}" for name in old for c in columns}
    rest = [F.col(f"`{name}`") for name in df.columns if name not in gone]
    return df.select(*rest, *[made for c in columns for made in make(c)])


# What a state holds of each column: count, sum of what is beyond the parts, and the parts.
STATE = ["n", "beyond", "p0", "p1", "p2", "p3", "p4"]


def exact_totals(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Sum and count of double columns per key, as ``_sum_<column>`` and ``_n_<column>``.

    The sum is missing if all values are; NaN counts as missing. Digits below 2**-80 (8e-25) are
    left out. Numbers of 2**75 or more and infinities are beyond the parts; they are added
    as usual. ``also`` are further aggregates of the same grouping.
    """
    return totals_of_states(exact_states(df, keys, columns, also), columns)


def _split(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each number cut up: ``_x_``, ``_beyond_``, ``_top_``, ``_mid_``, ``_low_``."""
    inside = {c: F.abs(_col("x", c)) < F.lit(LIMIT) for c in columns}
    df = df.withColumns({f"_x_{c}": present(df, c).cast("double") for c in columns})
    df = _kept(df, columns, [], lambda c: [
        _named("in", c, F.when(inside[c], _col("x", c))), _named("beyond", c, F.when(~inside[c], _col("x", c))),
    ])
    df = _kept(df, columns, [], lambda c: [
        _named("top", c, (_col("in", c) * F.lit(2.0**-TOP)).cast("bigint")),
    ])
    df = _kept(df, columns, ["in"], lambda c: [
        _named("below", c, _col("in", c) - _col("top", c) * F.lit(2.0**TOP)),
    ])
    df = _kept(df, columns, [], lambda c: [
        _named("mid", c, (_col("below", c) * F.lit(2.0**-MIDDLE)).cast("bigint")),
    ])
    df = _kept(df, columns, ["below"], lambda c: [
        _named("low", c, ((_col("below", c) - _col("mid", c) * F.lit(2.0**MIDDLE))
                         * F.lit(2.0**-LOWEST)).cast("bigint")),
    ])
    return df


def _parts(c: str) -> dict[str, Column]:
    """What one row adds to the whole numbers of a state, out of :func:`_split`."""
    return {
        "p0": _col("low", c).bitwiseAND(F.lit(MASK)),
        "p1": F.shiftright(_col("low", c), BITS),
        "p2": _col("mid", c).bitwiseAND(F.lit(MASK)),
        "p3": F.shiftright(_col("mid", c), BITS),
        "p4": _col("top", c),
    }


def row_states(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with the state of every single row instead of the columns, for sums that run."""
    cut = _split(df, columns)
    states = _kept(cut, columns, ["x", "beyond", "top", "mid", "low"], lambda c: [
        _named("n", c, _col("x", c).isNotNull().cast("bigint")),
        _named("beyond", c, _col("beyond", c)),
        *[_named(p, c, made) for p, made in _parts(c).items()],
    ])
    return states.drop(*columns)


def exact_states(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """The parts of the sums per key: whole numbers that can be stored, and added up later."""
    return _split(df, columns).groupBy(*keys).agg(
        *[made.alias(name) for name, made in (also or {}).items()],
        *[made for c in columns for made in [
            _named("n", c, F.count(_col("x", c))),
            _named("beyond", c, F.sum(_col("beyond", c))),
            *[_named(p, c, F.sum(part)) for p, part in _parts(c).items()],
        ]],
    )


def state_sums(columns: Sequence[str]) -> list[Column]:
    """Aggregates that add up states of finer groups, or of several stored tables."""
    return [F.sum(_col(name, c)).alias(f"_{name}_{c}") for c in columns for name in STATE]


def merged_states(states: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """States of coarser groups: the same as from the rows, for up to 2**32 rows a group."""
    return states.groupBy(*keys).agg(*state_sums(columns))


def carried(sums: DataFrame, columns: Sequence[str]) -> DataFrame:
    """States whose lower parts are within 31 bits: equal sums have equal parts."""
    for i in range(4):
        this, following = f"p{i}", f"p{i + 1}"
        sums = _kept(sums, columns, [this, following], lambda c: [
            _named(this, c, _col(this, c).bitwiseAND(F.lit(MASK))),
            _named(following, c, _col(following, c) + F.shiftright(_col(this, c), BITS)),
        ])
    return sums


def totals_of_states(sums: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sums and counts out of states, as :func:`exact_totals` names them."""
    sums = carried(sums, columns)
    sums = _kept(sums, columns, ["p0", "p1", "p2", "p3"], lambda c: [
        _named("low", c, _col("p1", c) * F.lit(2**BITS) + _col("p0", c)),
        _named("mid", c, _col("p3", c) * F.lit(2**BITS) + _col("p2", c)),
    ])
    # Below zero the opposite number is rounded: the parts of -1 are -2**44 and nearly 2**44.
    borrowed = {c: (_col("low", c) > 0).cast("bigint") for c in columns}
    sums = _kept(sums, columns, ["low", "mid", "p4"], lambda c: [
        _named("sign", c, F.when(_col("p4", c) < 0, -1.0).otherwise(1.0)),
        _named("top", c, F.when(_col("p4", c) < 0, -_col("p4", c) - (_col("mid", c) + borrowed[c] > 0).cast("bigint"))
              .otherwise(_col("p4", c))),
        _named("mid", c, F.when(_col("p4", c) < 0, (F.lit(PAIR + 1) - _col("mid", c) - borrowed[c])
                               .bitwiseAND(F.lit(PAIR))).otherwise(_col("mid", c))),
        _named("low", c, F.when(_col("p4", c) < 0, (F.lit(PAIR + 1) - _col("low", c)).bitwiseAND(F.lit(PAIR)))
              .otherwise(_col("low", c))),
    ])

    def total(c: str) -> list[Column]:
        rounded = _col("sign", c) * (
            (_col("top", c) * F.lit(2.0**TOP) + _col("mid", c) * F.lit(2.0**MIDDLE))
            + _col("low", c) * F.lit(2.0**LOWEST)
        )
        beyond = _col("beyond", c)
        both = F.when(beyond.isNull(), rounded).otherwise(F.coalesce(rounded, F.lit(0.0)) + beyond)
        return [_named("sum", c, both)]

    return _kept(sums, columns, ["sign", "top", "mid", "low", "beyond"], total)
