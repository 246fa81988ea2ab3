"""Keyword flags and the labels made from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larderline.functions import first_label, matches_any
from larderline.operators.spread import same_keys
from larderline.session import staged

# {flag: {text column: keywords}}; a flag is set when any of its columns matches.
FlagRules = Mapping[str, Mapping[str, Sequence[str]]]


def flag_columns(rules: FlagRules, **match_options) -> dict[str, Column]:
    """One boolean expression per flag, for ``withColumns``."""
    return {
        flag: reduce(
            lambda a, b: a | b,
            [matches_any(c, words, **match_options) for c, words in tests.items()],
        )
        for flag, tests in rules.items()
    }


def add_flags(df: DataFrame, rules: FlagRules, **match_options) -> DataFrame:
    return df.withColumns(flag_columns(rules, **match_options))


def add_flags_by_text(df: DataFrame, rules: FlagRules, **match_options) -> DataFrame:
    """:func:`add_flags`, testing each distinct text once and looking the flags up.

    Pays off when few texts recur over many rows. The list of texts is staged, so its size is
    known: Spark broadcasts it when that is small enough and joins by shuffle otherwise.
    """
    texts = list(dict.fromkeys(c for tests in rules.values() for c in tests))
    seen = staged(add_flags(df.select(*texts).distinct(), rules, **match_options), "texts")
    lookup = seen.withColumnsRenamed({c: c + "_t" for c in texts})
    return df.join(lookup, same_keys(texts, "_t"), "left").drop(*[c + "_t" for c in texts])


def add_label(
    df: DataFrame, out: str, cases: Sequence[tuple[str, str]], default: str
) -> DataFrame:
    """First flag that is set decides: ``cases`` is ``[(flag column, label), ...]``."""
    return df.withColumn(out, first_label([(F.col(flag), label) for flag, label in cases], default))
