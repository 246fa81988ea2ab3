"""Mixing sources to target weights by Pareto order sampling.

Every document is taken a certain number of whole times, and once more with a probability.
Pareto sampling ranks the documents of a source by random odds divided by inclusion odds and
takes the first ones until the source's words are reached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larderline.session import staged

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; a missing text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def uniform(*parts: Column) -> Column:
    """A number strictly between 0 and 1 that depends on the given columns only."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(2**53))


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float):
    """Words wanted of each source. ``sizes`` has one row per source: source, source_size.

    Sources in code point order, missing last, get the weights in turn. A target stops at
    ``most`` times the source's size and its excess goes to the others by weight. Sources
    stop in the order of limit over weight, so one running sum over the sorted sources finds
    the level at which the remaining ones share the rest.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    limit = F.col("source_size") * F.lit(float(most))
    rows = sizes.withColumn("_weight", F.get(cycle, turn % len(weights))).withColumns(
        {"_limit": limit, "_stops": limit / F.col("_weight")}
    )
    everything = Window.partitionBy()
    ordered = Window.orderBy("_stops", F.col("source").asc_nulls_last())
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(
        F.sum("_limit").over(before), F.lit(0.0)
    )
    open_weight = F.sum("_weight").over(
        ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    rows = rows.withColumn("_level", left / open_weight)
    # Stopping a source below the level raises it, stopping one above lowers it: the right
    # level is the highest.
    target = F.least("_limit", F.col("_weight") * F.max("_level").over(everything))
    return rows.withColumn("target", target).select("source", "source_size", "_docs", "target")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: float = 2.0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: Sequence[str] = (),
    seed: int = 0,
) -> DataFrame:
    """Copies of each document so that every source's words come to its target.

    Returns one row per input row: ``doc_id``, ``source``, ``size`` (words), ``source_size``,
    ``target`` (its source's), ``copies`` and ``taken`` (words, repeats counted), then the
    columns named in ``keep``. ``share`` is the size of the mix as a part of all words.

    A document's expected copies are target / source_size. Their whole part is certain. The
    rest is its inclusion probability for one more copy: documents are ranked by Pareto odds
    and taken from the front while they fit; the last place goes to the document behind them
    that brings the source closest to its target. Random numbers are hashes of id and text, so
    reruns agree.

    Missing or empty text: size 0, taken 0. A missing source is a source, the last one.
    Repeated rows are ranked one after the other. An empty table gives no rows. Other columns
    of ``docs`` are not looked at, whatever their names.

    A source is never sorted as a whole: its ranks are cut into about sqrt(rows) ranges, the
    words of the ranges are summed, and only the range in which the target falls is sorted.
    """
    kept = {c: F.col(c) for c in keep}
    sized = staged(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            uniform(F.lit(seed), F.col(doc_id), F.col(text)).alias("_u"),
            F.monotonically_increasing_id().alias("_row"),
            F.struct(*[c.alias(n) for n, c in kept.items()] or [F.lit(True)]).alias("_kept"),
        ),
        "mix",
    )
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_docs")
    )
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    plan = source_targets(sums, weights, share, most).withColumn("_whole", F.floor(rate))
    plan = plan.withColumn("_part", rate - F.col("_whole"))
    plan = plan.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    plan = staged(plan.withColumn("_ranges", F.ceil(F.sqrt("_docs"))), "mix-plan")

    def with_plan(rows: DataFrame) -> DataFrame:
        side = plan.withColumnRenamed("source", "_source")
        joined = rows.join(side, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        odds = F.col("_u") / (1 - F.col("_u")) * (1 - F.col("_part")) / F.col("_part")
        odds = F.when(F.col("_part") > 0, odds)
        place = odds / (1 + odds)
        return joined.withColumns(
            {"_odds": odds, "_range": F.floor(place * F.col("_ranges")).cast("bigint")}
        )

    ranked = with_plan(sized.drop("_kept"))
    sums = ranked.where("_part > 0").groupBy("source", "_range", "_rest").agg(
        F.sum("size").alias("_words")
    )
    up_to = Window.partitionBy("source").orderBy("_range")
    cut = (
        sums.withColumn("_to", F.sum("_words").over(up_to))
        .where(F.col("_to") > F.col("_rest"))
        .groupBy("source")
        .agg(F.min("_range").alias("_cut"), F.min(F.col("_to") - F.col("_words")).alias("_from"))
    )
    cut = staged(cut.withColumnRenamed("source", "_source"), "mix-cut")

    def with_cut(rows: DataFrame, how: str) -> DataFrame:
        return rows.join(cut, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")

    behind = with_cut(ranked, "inner").where(F.col("_range") >= F.col("_cut"))
    order = ["_odds", "doc_id", "size", "_row"]
    running = F.sum("size").over(
        Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = behind.where(F.col("_range") == F.col("_cut")).withColumn(
        "_fits", F.col("_from") + running <= F.col("_rest")
    )
    inside = staged(inside.select("source", "_row", "size", "_fits", "_rest", "_from"), "mix-in")
    gaps = inside.groupBy("source", "_rest", "_from").agg(
        F.sum(F.when(F.col("_fits"), F.col("size")).otherwise(0)).alias("_fitted")
    )
    gaps = gaps.select(
        F.col("source").alias("_source"),
        (F.col("_rest") - F.col("_from") - F.col("_fitted")).alias("_gap"),
    )
    taken = inside.where("_fits").select("_row")
    free = (
        behind.join(taken, "_row", "left_anti")
        .join(gaps, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("_off", F.abs(F.col("size") - F.col("_gap")))
        .where(F.col("_off") < F.col("_gap"))
    )
    last = free.groupBy("source").agg(
        F.min_by("_row", F.struct("_off", *order)).alias("_row")
    )
    extra = taken.unionByName(last.select("_row")).withColumn("_more", F.lit(1))
    whole = with_cut(with_plan(sized), "left").join(extra, "_row", "left")
    # Without a cut the whole source lies before it.
    first = F.when(F.col("_part") > 0, F.coalesce(F.col("_range") < F.col("_cut"), F.lit(True)))
    copies = F.col("_whole") + F.coalesce(first.cast("int"), F.lit(0))
    copies = (copies + F.coalesce(F.col("_more"), F.lit(0))).cast("bigint")
    return whole.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("size")).alias("taken"),
        *[F.col("_kept").getField(n).alias(n) for n in kept],
    )
