"""Cohorts from a table of many rules, by an index of elementary intervals.

The ends of all rules, sorted, cut a measure into points and open intervals between them: its
cells. Rows and ends are sorted together, so that each row finds the last end before it. A rule
covers a range of cells, stated by the few nodes of a tree over the cells that make up the
range; a row belongs to the nodes above its cell. Rows and rules meet on nodes, so the plan has
the same size for ten rules and for ten thousand, and both sides grow with the logarithm of the
number of rules. Means are differences of running sums along each node, without the pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.functions import present
from larderline.operators.aggregates import class_means
from larderline.operators.exact import BITS, LIMIT, MASK, carried, row_states, totals_of_states
from larderline.operators.missing import carry_forward
from larderline.operators.spread import chunk_count, global_row_number, in_chunks, same_keys
from larderline.session import staged

RULE = ["cohort", "sex", "age_lo", "age_lo_incl", "age_hi", "age_hi_incl",
        "e_lo", "e_lo_incl", "e_hi", "e_hi_incl"]


# Every node has four children: rows have half as many nodes above them as with two, and rules
# that are made of more nodes are fewer than rows.
CHILDREN = 4
# Rows without a value: only rules without any end on the measure hold for them.
MISSING = -1


def _levels(ends: int) -> Column:
    """The levels of a tree over the cells that so many ends make."""
    level = 0
    while CHILDREN**level < 2 * ends + 1:
        level += 1
    return F.sequence(F.lit(0), F.lit(level))


def _node(level: Column, number: Column) -> Column:
    return F.struct(level.cast("int").alias("level"), number.cast("bigint").alias("number"))


def _cover(ends: int, low: Column, high: Column, everything: Column) -> Column:
    """The nodes that make up the cells from ``low`` to ``high``: six a level at most."""

    def at(level: Column) -> Column:
        def bounds(k: Column) -> tuple[Column, Column]:
            width = F.pow(F.lit(float(CHILDREN)), k)
            return F.ceil(low / width).cast("bigint"), F.floor((high + 1) / width).cast("bigint")

        def nodes(start: Column, end: Column) -> Column:
            numbers = F.when(start < end, F.sequence(start, end - 1)).otherwise(F.array().cast("array<bigint>"))
            return F.transform(numbers, lambda n: _node(level, n))

        # What the next level does not take in whole.
        (left, right), (above_left, above_right) = bounds(level), bounds(level + 1)
        first_end = F.least(right, above_left * CHILDREN)
        last_start = F.greatest(first_end, above_right * CHILDREN)
        return F.concat(nodes(left, first_end), nodes(last_start, right))

    nodes = F.flatten(F.transform(_levels(ends), at))
    missing = F.array(F.when(everything, _node(F.lit(MISSING), F.lit(0))))
    return F.filter(F.concat(nodes, missing), lambda n: n.isNotNull())


def _above(ends: int, value: Column, cell: Column) -> Column:
    """The nodes over a value's cell."""
    over = F.transform(
        _levels(ends), lambda k: _node(k, F.floor(cell / F.pow(F.lit(float(CHILDREN)), k)))
    )
    return F.when(value.isNull(), F.array(_node(F.lit(MISSING), F.lit(0)))).otherwise(over)


def _inside(value: str, low: str, high: str) -> Column:
    v, lo, hi = F.col(value), F.col(low), F.col(high)
    above = lo.isNull() | (v > lo) | (F.col(low + "_incl") & (v == lo))
    below = hi.isNull() | (v < hi) | (F.col(high + "_incl") & (v == hi))
    return above & below


def _named_rules(rules: DataFrame) -> DataFrame:
    rules = rules.select(*RULE).withColumnsRenamed({c: "_r_" + c for c in RULE})
    for c in [c for c in rules.columns if c.endswith("_incl")]:
        rules = rules.withColumn(c, F.coalesce(F.col(c).cast("boolean"), F.lit(False)))
    return rules


def _numbered_ends(rules: DataFrame) -> DataFrame:
    """The distinct ends of the rules' age bands with their ``_place``, from 1, least first."""
    ends = F.array(F.col("_r_age_lo").cast("double"), F.col("_r_age_hi").cast("double"))
    ends = rules.select(F.explode(ends).alias("_end")).where("_end is not null").distinct()
    # NaN is the greatest end: missing, and so last, in descending order of the opposite.
    down = ends.withColumn("_down", -F.col("_end"))
    numbered = global_row_number(down, "_down", [], "_place", descending=True)
    return staged(numbered.select("_end", F.col("_place").cast("bigint").alias("_place")), "rule-ends")


def _placed(rules: DataFrame, ends: DataFrame, count: int) -> DataFrame:
    """Rules with each ``_node`` of their age band."""
    for c in ("_r_age_lo", "_r_age_hi"):
        mine = ends.select(F.col("_end").alias("_same"), F.col("_place").alias(c + "_place"))
        rules = rules.join(mine, F.col(c).cast("double") == F.col("_same"), "left").drop("_same")

    def cell(c: str, opened: int, missing: int) -> Column:
        point = 2 * F.col(c + "_place") - 1
        return F.when(F.col(c).isNull(), F.lit(missing)).otherwise(
            F.when(F.col(c + "_incl"), point).otherwise(point + opened)
        )

    everything = F.col("_r_age_lo").isNull() & F.col("_r_age_hi").isNull()
    return (
        rules.withColumns({"_low": cell("_r_age_lo", 1, 0), "_high": cell("_r_age_hi", -1, 2 * count)})
        .withColumn("_node", F.explode(_cover(count, F.col("_low"), F.col("_high"), everything)))
        .withColumn("_r_any", F.col("_r_sex").isNull())
        .drop("_low", "_high", "_r_age_lo_place", "_r_age_hi_place")
    )


def _looked_for(df: DataFrame, ends: DataFrame, count: int, sex: str, age: str) -> DataFrame:
    """Rows with each node above their cell as ``_at``, under each group of ``_asked``.

    Rows and ends are sorted together in chunks, and the last end is carried to the rows behind.
    """
    rows = df.withColumns({"_value": F.col(age).cast("double"), "_row": F.lit(1)})
    last = F.struct(F.col("_place").alias("place"), F.col("_end").alias("end")).alias("_last")
    marks = ends.select(F.col("_end").alias("_value"), F.lit(0).alias("_row"), last)
    both = rows.unionByName(marks, allowMissingColumns=True)
    found = carry_forward(both, "_last", ["_value", "_row"]).where("_row = 1").drop("_row")
    equal = F.col("_last.end") == F.col("_value")
    cell = F.when(F.col("_last").isNull(), F.lit(0)).otherwise(
        2 * F.col("_last.place") - equal.cast("int")
    )
    # A row is looked for under its own group and under "everyone".
    group = df.schema[sex].dataType
    asked = F.array(
        F.struct(F.lit(False).alias("any"), F.col(sex).alias("group")),
        F.struct(F.lit(True).alias("any"), F.lit(None).cast(group).alias("group")),
    )
    return (
        found.withColumn("_at", F.explode(_above(count, F.col("_value"), cell)))
        .withColumn("_asked", F.explode(asked))
        .drop("_last", "_value")
    )


def assign_by_index(
    df: DataFrame,
    rules: DataFrame,
    sex: str,
    age: str,
    energy: str | None = None,
    out: str = "cohort",
) -> DataFrame:
    """One row per row and cohort it belongs to, for a table of rules with the columns ``RULE``.

    The same memberships as ``cohorts.assign_cohorts``: a missing end is unbounded, a missing
    ``sex`` is everyone, an end without its ``_incl`` flag is open. The band on ``age`` is
    indexed, the one on ``energy`` is tested on what the index finds; hand in the narrower
    one as ``age``. Rules that share all their bounds each give a row.
    """
    rules = _named_rules(rules)
    ends = _numbered_ends(rules)
    count = ends.count()
    placed = _placed(rules, ends, count)
    rows = _looked_for(df, ends, count, sex, age)
    meets = (
        (F.col("_at.level") == F.col("_node.level"))
        & (F.col("_at.number") == F.col("_node.number"))
        & (F.col("_asked.any") == F.col("_r_any"))
        & F.col("_asked.group").eqNullSafe(F.col("_r_sex").cast(df.schema[sex].dataType))
    )
    found = rows.join(placed, meets)
    if energy is not None:
        found = found.where(_inside(energy, "_r_e_lo", "_r_e_hi"))
    kept = [F.col(f"`{c}`") for c in df.columns if c != out]
    return found.select(*kept, F.col("_r_cohort").alias(out))


def indexed_cohort_means(
    df: DataFrame,
    rules: DataFrame,
    sex: str,
    age: str,
    energy: str | None,
    measures: Sequence[str],
    classes: Sequence[str] = (),
) -> DataFrame:
    """Mean of every measure per cohort and class for a table of rules.

    No pair of a row and a rule is made, as their number grows with the product of both tables. Under
    each node of the age index the rows are sorted by energy, together with both ends of the
    energy bands of the node's rules; exact sums run along that order, and what a rule's
    rows hold is the sum at its upper end less the one at its lower end. Only rows with a
    number of 2**75 or more, which has no exact parts, meet their rules in pairs, as do all rows where
    a measure is neither a whole nor a floating number. The running sums are exact for up to
    2**32 rows times levels.
    """
    exact = (T.IntegralType, T.FloatType, T.DoubleType)
    if not all(isinstance(df.schema[m].dataType, exact) for m in measures):
        return class_means(assign_by_index(df, rules, sex, age, energy), ["cohort", *classes], measures)
    ms, cs = [f"m{i}" for i in range(len(measures))], [f"_c{i}" for i in range(len(classes))]
    df = df.select(
        F.col(sex).alias("_sex"),
        F.col(age).alias("_age"),
        (F.lit(0) if energy is None else F.col(energy)).alias("_e"),
        *[F.col(c).alias(n) for c, n in zip(classes, cs)],
        *[present(df, m).cast("double").alias(n) for m, n in zip(measures, ms)],
    )
    tested = None if energy is None else "_e"
    sums = _sums_in_bands(df, rules, tested, ms, cs)
    far = F.lit(False)
    for m in ms:
        far = far | F.coalesce(F.abs(m) >= LIMIT, F.lit(False))
    beyond = df.where(far)
    parts = {m: F.when(F.abs(m) >= LIMIT, F.col(m)) for m in ms}
    names = ["cohort", *cs]
    if beyond.isEmpty():
        sums = sums.withColumns({f"_beyond_{m}": F.lit(None).cast("double") for m in ms})
    else:
        pairs = assign_by_index(beyond, rules, "_sex", "_age", tested).groupBy(*names)
        pairs = pairs.agg(*[F.sum(p).alias(f"_beyond_{m}") for m, p in parts.items()])
        pairs = pairs.withColumnsRenamed({n: n + "_b" for n in names})
        sums = sums.join(pairs, same_keys(names, "_b"), "left").drop(*[n + "_b" for n in names])
    means = totals_of_states(sums, ms)
    return means.select(
        "cohort",
        *[F.col(n).alias(c) for n, c in zip(cs, classes)],
        *[F.try_divide(f"_sum_{n}", f"_n_{n}").alias(f"mean_{m}") for n, m in zip(ms, measures)],
    )


def _sums_in_bands(
    df: DataFrame, rules: DataFrame, energy: str | None, measures: Sequence[str], classes: Sequence[str]
) -> DataFrame:
    """Exact states, but for what is beyond them, per cohort and class that has rows."""
    rules = _named_rules(rules)
    ends = _numbered_ends(rules)
    count = ends.count()
    node = ["_any", "_group", "_level", "_number"]
    # Along a node: ends of unbounded bands (0), values and ends (1), upper ends of bands that
    # hold values only (2), rows without a value (3), upper ends that hold those too (4). Among
    # equal values: ends before the rows (0), rows (1), ends behind them (2).
    rows = _looked_for(df, ends, count, "_sex", "_age").select(
        F.col("_asked.any").alias("_any"),
        F.col("_asked.group").alias("_group"),
        F.col("_at.level").alias("_level"),
        F.col("_at.number").alias("_number"),
        *classes,
        F.when(F.col("_e").isNull(), 3).otherwise(1).alias("_part"),
        "_e",
        F.lit(1).alias("_side"),
        F.lit(0).alias("_sign"),
        *measures,
    )
    placed = _placed(rules, ends, count)
    if energy is None:
        placed = placed.withColumns({c: F.lit(None).cast("int") for c in ("_r_e_lo", "_r_e_hi")})
    low, high = F.col("_r_e_lo"), F.col("_r_e_hi")
    closed = F.col("_r_e_lo_incl") & F.col("_r_e_hi_incl")
    # A band that holds nothing would be taken off.
    placed = placed.where(low.isNull() | high.isNull() | (low < high) | (closed & (low == high)))

    def marks(at: Column, part: Column, behind: Column, sign: int) -> DataFrame:
        return placed.select(
            F.col("_r_any").alias("_any"),
            F.col("_r_sex").cast(df.schema["_sex"].dataType).alias("_group"),
            F.col("_node.level").alias("_level"),
            F.col("_node.number").alias("_number"),
            part.alias("_part"),
            at.alias("_e"),
            F.when(behind, 2).otherwise(0).alias("_side"),
            F.lit(sign).alias("_sign"),
            F.col("_r_cohort").alias("cohort"),
        )

    lower = marks(low, F.when(low.isNull(), 0).otherwise(1), ~F.col("_r_e_lo_incl"), -1)
    open_end = F.when(low.isNull(), 4).otherwise(2)
    upper = marks(high, F.when(high.isNull(), open_end).otherwise(1), F.col("_r_e_hi_incl"), 1)
    bands = lower.unionByName(upper)
    if classes:
        kinds = rows.select(*node, *classes).distinct().withColumnsRenamed({n: n + "_k" for n in node})
        bands = bands.join(kinds, same_keys(node, "_k")).drop(*[n + "_k" for n in node])
    both = rows.unionByName(bands, allowMissingColumns=True)

    order = [F.col(c) for c in [*node, *classes, "_part", "_e", "_side"]]
    both = in_chunks(both, order, chunk_count(both), "bands")
    held = ["_rows", *[f"_{p}_{m}" for m in measures for p in ("n", "p0", "p1", "p2", "p3", "p4")]]
    states = row_states(both, measures).withColumn("_rows", F.when(F.col("_sign") == 0, 1).otherwise(0).cast("bigint"))
    so_far = Window.partitionBy("_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = states.groupBy("_chunk").agg(*[F.sum(h).alias(h) for h in held])
    # One row a chunk.
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    shift = totals.select(
        F.col("_chunk").alias("_behind"),
        *[F.coalesce(F.sum(h).over(before), F.lit(0)).alias(h + "_before") for h in held],
    )
    keys = ["cohort", *classes]
    running = states.select(
        *keys, "_sign", "_chunk", *[F.coalesce(F.sum(h).over(so_far), F.lit(0)).alias(h) for h in held]
    ).where("_sign <> 0")
    running = running.join(shift, F.col("_chunk") == F.col("_behind")).select(
        *keys, "_sign", *[(F.col(h) + F.col(h + "_before")).alias(h) for h in held]
    )
    # Parts of 31 bits, the top one in two, so that no sum over many ends is too large.
    running = carried(running, measures).withColumns({f"_p5_{m}": F.shiftright(f"_p4_{m}", BITS) for m in measures})
    running = running.withColumns({f"_p4_{m}": F.col(f"_p4_{m}").bitwiseAND(F.lit(MASK)) for m in measures})
    held += [f"_p5_{m}" for m in measures]
    sums = running.groupBy(*keys).agg(*[F.sum(F.col("_sign") * F.col(h)).alias(h) for h in held])
    joined = {f"_p4_{m}": F.col(f"_p4_{m}") + F.col(f"_p5_{m}") * F.lit(2**BITS) for m in measures}
    return sums.where("_rows > 0").withColumns(joined).drop("_rows", *[f"_p5_{m}" for m in measures])
