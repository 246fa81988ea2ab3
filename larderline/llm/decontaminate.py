"""Benchmark decontamination with suffix arrays over the training words.

Each task cuts its documents into shards, sorts the word suffixes of a shard, and looks every
suffix of the benchmark up by binary search. The range found holds all places where its first
words stand verbatim; neighbouring places on one diagonal join to the longest matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.llm import words as W
from larderline.session import staged

SHARD_WORDS = 1_000_000
BLOCK_BYTES = 32 << 20


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their first ``depth`` numbers or more. Numbers are below 2**21 or
    else are replaced by their rank; the sequence ends as if by smaller ones.

    Ranks of 1 number give ranks of 3, then doubling gives 6, 12, ... in one sort each.
    """

    def ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        in_order = key[order]
        rank = np.empty(len(key), dtype=np.uint64)
        rank[order] = np.cumsum(np.concatenate([[1], in_order[1:] != in_order[:-1]]))
        return order, rank

    def ahead(rank: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(len(rank), dtype=np.uint64)
        out[: max(len(rank) - by, 0)] = rank[by:]
        return out

    first = sequence.astype(np.uint64) + np.uint64(1)
    if len(first) and first.max() < 2**21:
        key = first << np.uint64(42) | ahead(first, 1) << np.uint64(21) | ahead(first, 2)
        reach = 3
    else:
        key, reach = first, 1
    order, rank = ranked(key)
    while reach < depth and len(rank) and rank[order[-1]] < len(rank):
        order, rank = ranked(rank << np.uint64(32) | ahead(rank, reach))
        reach *= 2
    return order


def narrowed(sequence, order, low, high, at, wanted):
    """Parts of the ranges [low, high) in which the number ``at`` places on is the wanted one."""

    def bound(above: bool) -> np.ndarray:
        lo, hi = low.copy(), high.copy()
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            found = sequence[np.minimum(order[mid] + at, len(sequence) - 1)]
            right = found <= wanted[open_] if above else found < wanted[open_]
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]

    return bound(False), bound(True)


class Windows:
    """The distinct windows of the benchmark and the items they come from."""

    def __init__(self, texts: list[str], window: int):
        words = W.words_of(pa.array(texts, pa.string()))
        counts = words.counts
        n = np.where(counts >= window, counts - window + 1, np.minimum(counts, 1))
        item = np.repeat(np.arange(len(texts)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        length = np.minimum(counts, window)[item]
        grid = np.zeros((len(item), window), dtype=np.uint64)
        for j in range(window):
            has = length > j
            grid[has, j] = words.hash[words.first[item[has]] + place[has] + j]
        keyed = np.column_stack([length.astype(np.uint64), grid])
        distinct, self.of = np.unique(keyed, axis=0, return_inverse=True)
        self.of = self.of.ravel()
        self.length = distinct[:, 0].astype(np.int64)
        self.words = distinct[:, 1:]
        # One place for each window of an item: repeats inside an item add no document word.
        _, once = np.unique(np.column_stack([item, self.of]), axis=0, return_index=True)
        once = once[np.argsort(self.of[once], kind="stable")]
        self.item, self.place, window_of = item[once], place[once], self.of[once]
        self.first = np.searchsorted(window_of, np.arange(len(distinct) + 1))
        self.depth = window


def occurrences(tests: Windows, hashes: np.ndarray, first: np.ndarray):
    """(window, position) of all occurrences in a shard; positions count the shard's words."""
    none = np.zeros(0, dtype=np.int64)
    if not len(hashes) or not len(tests.length):
        return none, none
    known, ids = np.unique(hashes, return_inverse=True)
    # A zero behind each document keeps matches inside it.
    docs = len(first) - 1
    sequence = np.zeros(len(hashes) + docs, dtype=np.int64)
    real = np.arange(len(hashes)) + np.repeat(np.arange(docs), np.diff(first))
    sequence[real] = ids.ravel() + 1
    back = np.zeros(len(sequence), dtype=np.int64)
    back[real] = np.arange(len(hashes))
    at = np.searchsorted(known, tests.words)
    at = np.minimum(at, len(known) - 1)
    needed = np.arange(tests.depth)[None, :] < tests.length[:, None]
    found = (known[at] == tests.words) | ~needed
    possible = np.flatnonzero(found.all(axis=1))
    if not len(possible):
        return none, none
    order = suffix_array(sequence, tests.depth)
    low = np.zeros(len(possible), dtype=np.int64)
    high = np.full(len(possible), len(order), dtype=np.int64)
    for j in range(tests.depth):
        live = np.flatnonzero(needed[possible, j] & (low < high))
        low[live], high[live] = narrowed(
            sequence, order, low[live], high[live], j, at[possible[live], j] + 1
        )
    n = high - low
    spot = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    return np.repeat(possible, n), back[order[spot]]


def _lists(values: pa.Array, owner: np.ndarray, rows: int) -> pa.ListArray:
    """Values, sorted by owner, as one list for each row."""
    return pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), values
    )


def shard_columns(tests: Windows, item_ids: pa.Array, hashes: np.ndarray, first: np.ndarray):
    """n_hit, hits, items, matches of each document of a shard."""
    docs = len(first) - 1
    window, position = occurrences(tests, hashes, first)
    length = tests.length[window]
    edge = np.zeros(len(hashes) + 1, dtype=np.int64)
    np.add.at(edge, position, 1)
    np.add.at(edge, position + length, -1)
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    n_hit = total[first[1:]] - total[first[:-1]]
    # Each occurrence with each item that has the window.
    n = tests.first[window + 1] - tests.first[window]
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    entry += np.repeat(tests.first[window], n)
    item, place = tests.item[entry], tests.place[entry]
    position, length = np.repeat(position, n), np.repeat(length, n)
    doc = np.searchsorted(first, position, "right") - 1
    order = np.lexsort([position, position - place, item, doc])
    doc, item, position, length = doc[order], item[order], position[order], length[order]
    diagonal = position - place[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (
        (doc[1:] != doc[:-1])
        | (item[1:] != item[:-1])
        | (diagonal[1:] != diagonal[:-1])
        | (position[1:] != position[:-1] + 1)
    )
    starts = np.flatnonzero(new)
    ends = np.concatenate([starts[1:], [len(doc)]]) - 1 if len(doc) else starts
    m_doc, m_item = doc[starts], item[starts]
    matches = pa.StructArray.from_arrays(
        [
            item_ids.take(pa.array(m_item)),
            pa.array(position[starts] - first[m_doc]),
            pa.array(position[starts] - diagonal[starts]),
            pa.array(position[ends] + length[ends] - position[starts]),
        ],
        names=["item_id", "start", "item_start", "words"],
    )
    pair = np.ones(len(m_doc), dtype=bool)
    pair[1:] = (m_doc[1:] != m_doc[:-1]) | (m_item[1:] != m_item[:-1])
    return (
        pa.array(n_hit),
        _lists(item_ids.take(pa.array(m_item[pair])), m_doc[pair], docs),
        _lists(matches, m_doc, docs),
    )


def find_contamination(
    docs: DataFrame,
    tests: DataFrame,
    window: int = 10,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Adds to every document where the benchmark stands in it verbatim.

    ``n_words``; ``n_hit``, its words inside any occurrence of a window; ``items``, the ids of
    items with occurring windows; ``matches``, the longest verbatim matches (item, first word
    in the document and in the item, words). A window is ``window`` consecutive words of an
    item; an item of fewer words is one window, an item without words is none. Words are
    those of ``words.py``; equal 64-bit hashes count as equal words.

    Missing and empty texts have no words and no hits. Items with a missing id hit, but are
    not listed; repeated items are listed once for each different id. Repeated documents are
    judged one by one. With an empty benchmark nothing is hit. Columns of ``docs`` with an
    added name are replaced.

    The benchmark is cut by hash into blocks of about 32 MB; each block is broadcast and is
    one pass over the documents inside the same stage, so its size has a bound. Documents are
    never shuffled.
    """
    added = ["n_words", "n_hit", "items", "matches"]
    items = staged(
        tests.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
        .where("text is not null").distinct(),
        "benchmark",
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    kind = items.schema["item_id"].dataType
    out = docs.drop(*added)
    plain = out.schema
    match = T.StructType(
        [
            T.StructField("item_id", kind),
            T.StructField("start", T.LongType()),
            T.StructField("item_start", T.LongType()),
            T.StructField("words", T.LongType()),
        ]
    )
    parts = []
    for block in range(blocks):
        here = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block)
        chunk = here.toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(
            (chunk.column("item_id").combine_chunks(), chunk.column("text").to_pylist())
        )
        names = [f"_{block}_{c}" for c in added]
        kinds = [T.LongType(), T.LongType(), T.ArrayType(kind), T.ArrayType(match)]
        schema = T.StructType([*out.schema.fields, *map(T.StructField, names, kinds)])
        out = out.mapInArrow(_searched(shared, window, text, schema.names), schema)
        parts.append(names)

    def merged(i: int):
        return F.array_distinct(F.flatten(F.array(*[F.col(p[i]) for p in parts])))

    if blocks == 1:
        out = out.withColumnsRenamed(dict(zip(parts[0], added)))
    else:
        matches = merged(3)
        words = F.flatten(F.transform(matches, lambda m: F.sequence(
            m["start"], m["start"] + m["words"] - 1)))
        out = out.select(
            *plain.names,
            F.col(parts[0][0]).alias("n_words"),
            F.size(F.array_distinct(words)).cast("bigint").alias("n_hit"),
            merged(2).alias("items"),
            matches.alias("matches"),
        )
    return out.withColumn("items", F.array_distinct(F.array_compact("items")))


def _searched(shared, window: int, text: str, names: list[str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shared.value
        tests = Windows(texts, window)

        def done(held) -> Iterator[pa.RecordBatch]:
            first = np.concatenate([[0], np.cumsum(np.concatenate([c for _, _, c in held]))])
            hashes = np.concatenate([h for _, h, _ in held])
            n_hit, items, matches = shard_columns(tests, ids, hashes, first)
            at = 0
            for batch, _, counts in held:
                n = batch.num_rows
                columns = [pa.array(counts), n_hit.slice(at, n), items.slice(at, n)]
                columns = [*batch.columns, *columns, matches.slice(at, n)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                at += n

        held, size = [], 0
        for batch in W.pieces(batches, text):
            words = W.words_of(batch.column(text))
            held.append((batch, words.hash, words.counts.astype(np.int64)))
            size += len(words.hash)
            if size >= SHARD_WORDS:
                yield from done(held)
                held, size = [], 0
        if held:
            yield from done(held)

    return search


def decontaminated(docs: DataFrame, tests: DataFrame, window: int = 10, **columns) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with their own columns."""
    found = find_contamination(docs, tests, window, **columns)
    return found.where("n_hit = 0").select(*docs.columns)
