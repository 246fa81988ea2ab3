"""Quality rules as weak supervision.

Each rule looks at a document and votes good, bad, or not at all. How often a rule is right is
not known; expectation-maximisation estimates it from how the rules agree over all documents,
and a document's probability of being good follows from its votes. Documents are reduced
to vote patterns, of which there are at most 3 to the number of rules, so counting them is one
aggregate and the estimate itself takes a few array operations.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.functions import ratio
from larderline.llm import words as W
from larderline.llm.runs import gram_ids, numbered

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MARK = re.compile(r"[#*$%&|<>]")
SENTENCE_ENDS = frozenset(".!?…。！？")
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_distinct", "n_shouted", "n_ends", "n_alphabetic", "n_marked_lines",
)
BAD, NONE, GOOD = 0, 1, 2


def counts_of(text: str | None) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for a text; all 0 for a missing one.

    Words, characters in words, symbols, lines equal to an earlier one, words in three-word
    windows that stand twice or more, lines with a word, different words, words in capitals,
    words that end a sentence, words of letters only, lines with a symbol.
    """
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    grams = gram_ids(numbered(words))
    repeated = 0
    if len(grams):
        _, which, times = np.unique(grams, return_inverse=True, return_counts=True)
        at = np.flatnonzero(times[which] > 1)
        inside = np.zeros(len(words), dtype=bool)
        for step in range(3):
            inside[at + step] = True
        repeated = int(inside.sum())
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(set(words)),
        sum(map(str.isupper, words)),
        sum(word[-1] in SENTENCE_ENDS for word in words),
        sum(map(str.isalpha, words)),
        sum(map(bool, map(MARK.search, lines))),
    )


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without their texts, and with the columns of ``COUNTS``.

    Missing, empty and blank texts have no words and no lines. Repeated rows are counted one by
    one. Columns of ``docs`` with an added name are replaced. The whole of every text is read.
    """
    other = [f for f in docs.schema.fields if f.name != text and f.name not in COUNTS]
    names = [f.name for f in other]
    schema = T.StructType([*other, *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            found = [counts_of(value) for value in batch.column(text).to_pylist()]
            table = np.array(found, dtype=np.int64).reshape(-1, len(COUNTS))
            added = [pa.array(np.ascontiguousarray(c)) for c in table.T]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], *added], names=schema.names
            )

    return docs.select(*[F.col(f"`{n}`") for n in [*names, text]]).mapInArrow(count, schema)


def _share(part: str, whole: str = "n_words") -> Column:
    return ratio(part, whole)


def _vote(bad: Column, good: Column) -> Column:
    vote = F.when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(NONE))
    return F.coalesce(vote, F.lit(NONE))


def rules() -> dict[str, Column]:
    """Votes of the rules on the columns of ``COUNTS``. A rule that cannot tell abstains."""
    length, upper = _share("word_chars"), _share("n_shouted")
    many = F.col("n_words") >= 20
    return {
        "size": _vote(F.col("n_words") < 20, F.col("n_words").between(50, 100_000)),
        "word_length": _vote((length < 2.5) | (length > 12), length.between(3.5, 9)),
        "symbols": _vote(_share("n_symbols") > 0.2, _share("n_symbols") < 0.03),
        "repeated_lines": _vote(
            _share("n_dup_lines", "n_lines") > 0.3,
            (F.col("n_lines") > 1) & (_share("n_dup_lines", "n_lines") < 0.1),
        ),
        "repeated_words": _vote(
            _share("n_repeat_words") > 0.4, many & (_share("n_repeat_words") < 0.15)
        ),
        "variety": _vote(
            many & F.when(F.col("n_words") < 2000, _share("n_distinct") < 0.15),
            many & (_share("n_distinct") > 0.3),
        ),
        "capitals": _vote(many & (upper > 0.3), many & (upper < 0.1)),
        "sentences": _vote(
            many & ((_share("n_ends") < 0.005) | (_share("n_ends") > 0.5)),
            many & _share("n_ends").between(0.02, 0.3),
        ),
        "letters": _vote(
            many & (_share("n_alphabetic") < 0.4), many & (_share("n_alphabetic") > 0.65)
        ),
        "marked_lines": _vote(
            many & (_share("n_marked_lines", "n_lines") > 0.3),
            many & (_share("n_marked_lines", "n_lines") < 0.1),
        ),
    }


@dataclass(frozen=True)
class RuleModel:
    """Share of good documents, and for each rule the odds of its votes.

    ``weights[rule][vote]`` is the logarithm of P(vote | good) / P(vote | bad).
    """

    good: float
    weights: Mapping[str, tuple[float, float, float]]


# What a rule is taken for before any document is seen, and how many documents that is worth. A
# document is bad for one reason of many: most rules find it good, so their bad votes say far more
# than their good ones. Starting there keeps "good" and "bad" from changing places.
PRIOR_VOTES = 20.0
PRIOR = np.array([[0.3, 0.1, 0.6], [0.01, 0.29, 0.7]])  # rows: bad, good documents
PRIOR_GOOD = 0.8


def _backwards(chance: np.ndarray) -> np.ndarray:
    """Votes that are likelier on the documents they speak against."""
    out = np.zeros(chance.shape, dtype=bool)
    out[:, :, BAD] = (chance[:, 0, BAD] < chance[:, 1, BAD])[:, None]
    out[:, :, GOOD] = (chance[:, 0, GOOD] > chance[:, 1, GOOD])[:, None]
    return out


def estimate(
    patterns: np.ndarray, times: np.ndarray, rounds: int = 200, least_change: float = 1e-9
) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over vote patterns (one row each) that stand ``times`` times.

    Returns the share of good documents and P(vote | bad or good) as (rule, class, vote).
    """
    n_rules = patterns.shape[1]
    votes = (patterns[:, :, None] == np.arange(3)).astype(np.float64)
    chance = np.repeat(PRIOR[None], n_rules, axis=0)
    good = PRIOR_GOOD
    for _ in range(rounds):
        log = np.log(chance)
        fit = np.einsum("prv,rcv->pc", votes, log) + np.log([1 - good, good])
        belief = np.exp(fit - fit.max(axis=1, keepdims=True))
        belief *= (times / belief.sum(axis=1))[:, None]
        counted = np.einsum("pc,prv->rcv", belief, votes) + PRIOR_VOTES * PRIOR[None]
        chance = counted / counted.sum(axis=2, keepdims=True)
        # A bad vote never speaks for a document, a good one never against it.
        chance = np.where(_backwards(chance), chance.mean(axis=1, keepdims=True), chance)
        chance /= chance.sum(axis=2, keepdims=True)
        before = good
        good = (belief[:, 1].sum() + PRIOR_VOTES * PRIOR_GOOD) / (times.sum() + PRIOR_VOTES)
        if abs(good - before) < least_change:
            break
    return float(good), chance


def with_votes(counted: DataFrame) -> DataFrame:
    """Adds ``votes``: a struct with one vote a rule."""
    return counted.withColumn("votes", F.struct(*[c.alias(n) for n, c in rules().items()]))


def fit_rules(voted: DataFrame) -> RuleModel:
    """Learns from the votes of all documents.

    Only the counts of different patterns come to the driver, at most 3 to the number of rules.
    No documents give the prior.
    """
    names = list(rules())
    seen = voted.groupBy(*[F.col(f"votes.{n}").alias(n) for n in names]).count().toPandas()
    seen = seen.sort_values(names)
    good, chance = estimate(
        seen[names].to_numpy(dtype=np.int64).reshape(-1, len(names)),
        seen["count"].to_numpy(dtype=np.float64),
    )
    odds = np.log(chance[:, 1]) - np.log(chance[:, 0])
    return RuleModel(good, {n: tuple(map(float, w)) for n, w in zip(names, odds)})


def probability(model: RuleModel) -> Column:
    """Posterior probability that a document with these ``votes`` is good."""
    sum_of = F.lit(float(np.log(model.good) - np.log(1 - model.good)))
    for name, weights in model.weights.items():
        vote = F.col(f"votes.{name}")
        sum_of = sum_of + F.when(vote == BAD, weights[BAD]).when(vote == GOOD, weights[GOOD]).otherwise(
            weights[NONE]
        )
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-sum_of))


def judge_quality(counted: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds ``base_failed``, ``quality`` (0 to 1) and ``kept`` to the rows of ``text_counts``.

    The base rule fails documents of fewer than 50 words and those half of whose words stand in
    repeated windows. ``kept`` is false for them, else true if the quality is at least
    ``least``. ``counted`` is read twice; hand in a staged table. Tables without rows stay so.
    """
    voted = with_votes(counted)
    model = fit_rules(voted)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        voted.withColumn("base_failed", failed)
        .withColumn("quality", probability(model))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
        .drop("votes")
    )
