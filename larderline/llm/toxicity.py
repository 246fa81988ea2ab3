"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in shards.

A word is embedded as the sum of three hashed rows: of itself and of its first 4 and 5 bytes.
Filters of several widths slide over the words of a text; each filter's maximum over the whole
text goes into a logistic layer. Thresholds are calibrated by language, which is
guessed from the text's function words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.llm import words as W
from larderline.session import discard, staged

BUCKETS = 1 << 15
WIDE = 16
FILTERS = 16
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
CUT = 0.7
BATCH_WORDS = 50_000
# Logits are counted in bins of 1/256.
BINS, BIN_LIMIT = 256, 64

# Frequent function words by language (fixed values).
FUNCTION_WORDS = {
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "en": "the of and to that was it for on are as with they at be this have from or had by",
    "es": "de que el la los del las por una con no su para es al lo como más se pero",
    "fr": "le les des et est une dans qui pour pas sur avec au par du ce que plus ou mais",
}
GUESSES = [*FUNCTION_WORDS, "other"]


def hashes_of(texts: Sequence[str]) -> np.ndarray:
    return W.words_of(pa.array(texts, pa.string())).hash


_guess_hash, _guess_of = (
    np.concatenate([hashes_of(v.split()) for v in FUNCTION_WORDS.values()]),
    np.repeat(np.arange(len(FUNCTION_WORDS)), [len(v.split()) for v in FUNCTION_WORDS.values()]),
)
_order = np.argsort(_guess_hash, kind="stable")
_guess_hash, _guess_of = _guess_hash[_order], _guess_of[_order]


def guessed_languages(words: W.Words) -> np.ndarray:
    """The language with most function words in each text; the last number for none.

    A word of two languages counts for the first of them.
    """
    at = np.minimum(np.searchsorted(_guess_hash, words.hash), len(_guess_hash) - 1)
    hit = np.flatnonzero(_guess_hash[at] == words.hash)
    langs = len(FUNCTION_WORDS)
    votes = np.bincount(
        words.row()[hit] * langs + _guess_of[at[hit]], minlength=len(words) * langs
    ).reshape(len(words), langs)
    return np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), langs)


def word_rows(words: W.Words) -> np.ndarray:
    """Three embedding rows for each word, each in a range of its own."""
    parts = [words.hash]
    for size in (4, 5):
        end = np.minimum(words.start + size, words.end)
        parts.append(W.span_hashes(words.data, words.start, end))
    rows = np.stack([(p >> np.uint64(40)) % np.uint64(BUCKETS) for p in parts], axis=1)
    return rows.astype(np.int32) + np.arange(3, dtype=np.int32) * BUCKETS


# All parameters lie in one row of numbers: embedding, filters, bias, weight, offset.
SHAPES = [(3 * BUCKETS, WIDE), *[(w, WIDE, FILTERS) for w in WIDTHS]]
SHAPES += [(len(WIDTHS) * FILTERS,), (len(WIDTHS) * FILTERS,), (1,)]
ENDS = np.cumsum([int(np.prod(s)) for s in SHAPES])
BLOCK = 4096


@dataclass
class ToxicityModel:
    embedding: np.ndarray
    filters: list[np.ndarray]  # width x WIDE x FILTERS
    bias: np.ndarray
    weight: np.ndarray
    offset: np.ndarray
    thresholds: np.ndarray  # logit from which on a text is toxic, by guessed language


def model_of(numbers: np.ndarray) -> ToxicityModel:
    """The parameters as views of the numbers."""
    parts = [v.reshape(s) for v, s in zip(np.split(numbers, ENDS[:-1]), SHAPES)]
    filters = parts[1 : 1 + len(WIDTHS)]
    return ToxicityModel(parts[0], filters, *parts[1 + len(WIDTHS) :], np.zeros(len(GUESSES)))


def first_numbers(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    scales = [0.1, *[0.3] * len(WIDTHS), 0.0, 0.1, 0.0]
    drawn = [rng.normal(0, scale, s).ravel() for scale, s in zip(scales, SHAPES)]
    return np.concatenate(drawn).astype(np.float32)


def padded(rows: np.ndarray, counts: np.ndarray, embedding: np.ndarray):
    """Word vectors of texts one after the other, each followed by empty words, and where
    each text starts."""
    first = np.concatenate([[0], np.cumsum(counts + PAD)])
    out = np.zeros((first[-1], WIDE), dtype=np.float32)
    at = np.arange(len(rows)) + np.repeat(np.arange(len(counts)) * PAD, counts)
    out[at] = embedding[rows[:, 0]]
    out[at] += embedding[rows[:, 1]]
    out[at] += embedding[rows[:, 2]]
    return out, first, at


def convolved(model: ToxicityModel, vectors: np.ndarray) -> np.ndarray:
    out = np.empty((len(vectors), len(WIDTHS) * FILTERS), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        part = out[:, k * FILTERS : (k + 1) * FILTERS]
        part[:] = vectors @ model.filters[k][0]
        for j in range(1, width):
            part[:-j] += vectors[j:] @ model.filters[k][j]
    return out


def logits(model: ToxicityModel, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    vectors, first, _ = padded(rows, counts, model.embedding)
    best = np.maximum.reduceat(convolved(model, vectors), first[:-1], axis=0)
    return np.maximum(best + model.bias, 0) @ model.weight + model.offset[0]


def learn(
    numbers: np.ndarray,
    squares: np.ndarray,
    texts: pa.Array,
    toxic: np.ndarray,
    copies: np.ndarray,
    turns: range,
    seed: Sequence[int],
) -> None:
    """Go through the texts by Adagrad on small batches, in place.

    A text weighs as much as the rows that have it.
    """
    words = W.words_of(texts)
    rows, sizes, starts = word_rows(words), words.counts, words.first
    del words
    model, square = model_of(numbers), model_of(squares)

    def pick(chosen):
        counts = sizes[chosen]
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return rows[at + np.repeat(starts[chosen], counts)], counts

    def step(value, grad, squared, rate):
        squared += grad * grad
        value -= rate * grad / np.sqrt(squared)

    for turn in turns:
        rate = 0.05 / (1 + 0.5 * turn)
        order = np.random.default_rng([*seed, turn]).permutation(len(texts))
        # A batch has 32 texts, or fewer where they are long.
        group = np.maximum(np.arange(len(order)) // 32, np.cumsum(sizes[order]) // BATCH_WORDS)
        cuts = np.flatnonzero(np.diff(group)) + 1
        for chosen in np.split(order, cuts) if len(order) else []:
            part, counts = pick(chosen)
            vectors, first, _ = padded(part, counts, model.embedding)
            made = convolved(model, vectors)
            best = np.stack([made[a:b].argmax(axis=0) + a for a, b in zip(first, first[1:])])
            top = np.take_along_axis(made, best, axis=0) + model.bias
            high = np.maximum(top, 0)
            out = high @ model.weight + model.offset[0]
            off = (1 / (1 + np.exp(-out)) - toxic[chosen]) * copies[chosen]
            off = (off / copies[chosen].sum()).astype(np.float32)
            back = (off[:, None] * model.weight) * (top > 0)
            step(model.weight, high.T @ off, square.weight, rate)
            step(model.offset, off.sum(), square.offset, rate)
            step(model.bias, back.sum(axis=0), square.bias, rate)
            # Only the places of the maxima carry a gradient.
            flat, grads = [], []
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                place, g = best[:, own], back[:, own]
                for j in range(width):
                    at = np.minimum(place + j, len(vectors) - 1)
                    flat.append(at.ravel())
                    grads.append((g[:, :, None] * model.filters[k][j].T[None]).reshape(-1, WIDE))
                for j in range(width):
                    at = np.minimum(place + j, len(vectors) - 1)
                    grad = np.einsum("df,dfw->wf", g, vectors[at])
                    step(model.filters[k][j], grad, square.filters[k][j], rate)
            at, g = np.concatenate(flat), np.concatenate(grads)
            live = np.abs(g).sum(axis=1) > 0
            word_at = np.full(len(vectors), -1, dtype=np.int64)
            word_at[np.arange(len(part)) + np.repeat(np.arange(len(counts)) * PAD, counts)] = (
                np.arange(len(part))
            )
            word = word_at[at]
            live &= word >= 0
            touched = part[word[live]]
            slots, inverse = np.unique(touched.ravel(), return_inverse=True)
            total = np.zeros((len(slots), WIDE), dtype=np.float32)
            np.add.at(total, inverse.ravel(), np.repeat(g[live], 3, axis=0))
            grown = square.embedding[slots] + total * total
            square.embedding[slots] = grown
            model.embedding[slots] -= 2 * rate * total / np.sqrt(grown)


def best_threshold(
    toxic: np.ndarray, rows: np.ndarray, least: np.ndarray, most: np.ndarray
) -> float:
    """The middle of the gap between bins of logits that gives the best F1; bins ascend."""
    total = toxic.sum()
    if not total or total == rows.sum():
        return 0.0
    hits = total - (np.cumsum(toxic) - toxic)
    f1 = 2 * hits / (rows.sum() - (np.cumsum(rows) - rows) + total)
    best = int(np.argmax(f1))
    below = most[best - 1] if best else least[best] - 1
    return float((least[best] + below) / 2)


def calibrated(model: ToxicityModel, apart: DataFrame) -> np.ndarray:
    """Thresholds by guessed language from all rows kept apart.

    Only counts of bins of logits, with their ends, come to the driver.
    """
    shared = apart.sparkSession.sparkContext.broadcast(model)
    schema = "guess int, logit double, toxic int, copies bigint"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            words = W.words_of(batch.column("text"))
            found = logits(shared.value, word_rows(words), words.counts).astype(np.float64)
            guess = pa.array(guessed_languages(words).astype(np.int32))
            columns = [guess, pa.array(found), batch.column("toxic"), batch.column("copies")]
            yield pa.RecordBatch.from_arrays(columns, names=["guess", "logit", "toxic", "copies"])

    place = F.floor(F.least(F.greatest("logit", F.lit(-BIN_LIMIT)), F.lit(BIN_LIMIT)) * BINS)
    bins = (
        apart.select("text", "toxic", "copies").mapInArrow(measure, schema)
        .groupBy("guess", place.alias("bin"))
        .agg(
            F.sum(F.col("toxic") * F.col("copies")).alias("toxic"),
            F.sum("copies").alias("rows"),
            F.min("logit").alias("least"),
            F.max("logit").alias("most"),
        )
        .toPandas()
        .sort_values(["bin", "guess"])
    )
    alike = bins.groupby("bin", sort=True).agg(
        {"toxic": "sum", "rows": "sum", "least": "min", "most": "max"}
    )

    def threshold(of) -> float:
        return best_threshold(*(of[c].to_numpy() for c in ["toxic", "rows", "least", "most"]))

    out = np.full(len(GUESSES), threshold(alike))
    for g, own in bins.groupby("guess"):
        if min(own.toxic.sum(), (own.rows - own.toxic).sum()) >= 50:
            out[g] = threshold(own)
    return out


def _round(
    shards: DataFrame, numbers: np.ndarray, squares: np.ndarray, turns: range, seed: int
) -> tuple[np.ndarray, np.ndarray]:
    """Every shard goes on from the same numbers; what they changed is averaged.

    A number moves by the mean over the shards that moved it.
    """
    start = shards.sparkSession.sparkContext.broadcast((numbers, squares))

    def moved(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("text", "ascending"), ("toxic", "ascending")])
        old, old_squares = start.value
        new, new_squares = old.copy(), old_squares.copy()
        texts = rows.column("text").combine_chunks()
        toxic = rows.column("toxic").to_numpy().astype(np.float32)
        shard = key[0].as_py()
        learn(new, new_squares, texts, toxic, rows.column("copies").to_numpy(), turns, (seed, shard))
        cut = range(BLOCK, len(new), BLOCK)
        by, grown = np.split(new - old, cut), np.split(new_squares - old_squares, cut)
        live = [i for i, g in enumerate(grown) if g.any()]
        return pa.table({
            "block": pa.array(live, pa.int32()),
            "shard": pa.array([shard] * len(live), pa.int64()),
            "moved": pa.array([by[i].tobytes() for i in live], pa.binary()),
            "grown": pa.array([grown[i].tobytes() for i in live], pa.binary()),
        })

    def mean(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("shard")
        sums = 0.0
        for by, grown in zip(rows.column("moved"), rows.column("grown")):
            by = np.frombuffer(by.as_buffer(), np.float32).astype(np.float64)
            grown = np.frombuffer(grown.as_buffer(), np.float32).astype(np.float64)
            sums = sums + np.stack([by, grown, grown > 0])
        by, grown = (sums[:2] / np.maximum(sums[2], 1)).astype(np.float32)
        return pa.table({
            "block": rows.column("block").slice(0, 1),
            "moved": pa.array([by.tobytes()], pa.binary()),
            "grown": pa.array([grown.tobytes()], pa.binary()),
        })

    steps = shards.groupBy("shard").applyInArrow(
        moved, "block int, shard bigint, moved binary, grown binary"
    )
    means = steps.groupBy("block").applyInArrow(mean, "block int, moved binary, grown binary")
    numbers, squares = numbers.copy(), squares.copy()
    for block, by, grown in means.collect():
        own = slice(block * BLOCK, (block + 1) * BLOCK)
        numbers[own] += np.frombuffer(by, np.float32)
        squares[own] += np.frombuffer(grown, np.float32)
    return numbers, squares


def train_toxicity(
    labelled: DataFrame,
    text: str = "text",
    toxic: str = "toxic",
    shard_bytes: int = 16 << 20,
    shown: int = 24_000,
    seed: int = 5,
) -> ToxicityModel:
    """Fit on all rows with a text and a label: four fifths of the texts teach, all others set
    the thresholds.

    The texts are dealt by their hash to shards of about ``shard_bytes``, as many as it takes. In
    each turn every shard goes through its texts, starting from the same numbers, and the
    changes are averaged; a single shard takes all turns at once. There are 2 to 6 turns: few
    texts are gone through more often, until ``shown`` were shown. Rows with the same text and
    label are shown once, with their number as weight.

    Rows without text or label teach nothing. With labels of one kind only, everything scores
    the same.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(toxic).cast("int").alias("toxic"))
    rows = rows.where(F.col("text").isNotNull() & F.col("toxic").isin(0, 1))
    rows = rows.groupBy("text", "toxic").agg(F.count(F.lit(1)).alias("copies"))
    mark = F.xxhash64(F.lit(23), "text")
    rows = staged(rows.withColumn("mark", mark), "toxicity-rows")
    teaching = F.pmod("mark", F.lit(5)) != 0
    found = rows.where(teaching).agg(
        F.count(F.lit(1)).alias("texts"), F.sum(F.octet_length("text").cast("bigint")).alias("bytes")
    ).first()
    count = max(-(-(found["bytes"] or 0) // shard_bytes), 1)
    turns = range(min(max(shown // max(found["texts"], 1), 2), 6))
    shard = F.pmod(F.shiftright("mark", 8), F.lit(count)).cast("bigint")
    shards = rows.where(teaching).select("text", "toxic", "copies", shard.alias("shard"))
    numbers = first_numbers(seed)
    squares = np.full_like(numbers, 1e-4)
    for some in [turns] if count == 1 else [range(t, t + 1) for t in turns]:
        numbers, squares = _round(shards, numbers, squares, some, seed)
    model = model_of(numbers)
    model.thresholds = calibrated(model, rows.where(~teaching))
    discard(rows)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from 0.7 on) to every row.

    The whole text is read. The score is the logistic of the logit, moved so that the threshold
    of the text's guessed language comes to 0.7. Missing and empty texts are scored as a
    text without words. Repeated rows score the same. Columns of ``docs`` with an added name are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    names = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in W.pieces(batches, text):
            words = W.words_of(batch.column(text))
            found = logits(known, word_rows(words), words.counts).astype(np.float64)
            found -= known.thresholds[guessed_languages(words)]
            moved = 1 / (1 + np.exp(-(found + np.log(CUT / (1 - CUT)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(moved)], names=names)

    scored = docs.mapInArrow(score, schema)
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
