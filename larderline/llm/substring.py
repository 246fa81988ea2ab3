"""Substring dedup: repeated paragraphs and repeated passages are kept once.

Paragraphs (lines) are compared by MinHash bands and exact Jaccard similarity; those that
are alike form components, of which the first document keeps its own. Passages that lie inside
paragraphs have no borders to compare, so verbatim ones are found by windows of words chosen by
their content; a shared window is a seed that is extended word by word to the whole shared run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.llm import near
from larderline.llm import words as W
from larderline.session import discard, staged

HASHES = 64
STEPS = (16, 32, 64)
WINDOW = 24
LEFT, RIGHT = 1, 2


def tuned_bands(hashes: int, threshold: float, missed: float = 1e-3) -> tuple[int, int]:
    """Bands and rows: the widest bands with which a pair at the threshold is missed with a
    probability of at most ``missed``."""
    rows = 1
    while (1 - threshold ** (rows + 1)) ** (hashes // (rows + 1)) <= missed:
        rows += 1
    return hashes // rows, rows


def lines_of(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first and last byte (behind) of every line that has a word."""
    breaks = np.flatnonzero(words.data == 10)
    edges = np.union1d(words.offsets, breaks + 1)
    owner = np.searchsorted(words.offsets, edges[:-1], "right") - 1
    stop = edges[1:].copy()
    if len(words.data):
        stop -= words.data[np.maximum(stop - 1, 0)] == 10
    return owner, edges[:-1], stop


def chosen_windows(words: W.Words, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of windows of ``size`` words: the least of every ``reach``
    neighbours. Texts that share size + reach - 1 words in a row share such a window."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    long_enough = words.counts >= size + reach - 1
    if not long_enough.any():
        return none
    values, first = W.shingles(words, size)
    least = W.least_in_run(values, reach)
    owner = np.repeat(np.arange(len(words)), np.diff(first))
    inside = (owner[: len(least)] == owner[reach - 1 :]) & long_enough[owner[: len(least)]]
    # A window is chosen if it is the least of some run it is in: the largest minimum of the
    # runs around it is its own value.
    least = np.where(inside, least, np.uint64(0))
    edge = np.zeros(reach - 1, dtype=np.uint64)
    around = ~W.least_in_run(~np.concatenate([edge, least, edge]), reach)
    at = np.flatnonzero((around == values) & (around > 0))
    return at - first[owner[at]] + words.first[owner[at]], values[at]


PARTS = pa.schema(
    [("doc_id", pa.int64()), ("mark", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
     ("at", pa.int32()), ("to", pa.int32()), ("window", pa.int64()), ("node", pa.binary()),
     ("shingles", pa.int32()), ("sketch", pa.binary())]
)


def _parts(docs: DataFrame, size: int, least_words: int, passage: int) -> DataFrame:
    """Paragraphs (with ``node``) and chosen windows (with ``window``) of all documents: bytes from
    ``start`` to ``stop``, words from ``at`` to ``to``, both of paragraphs only but ``at``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            words = W.words_of(batch.column("text"))
            owner, start, stop = lines_of(words)
            a, b = np.searchsorted(words.start, start), np.searchsorted(words.start, stop)
            enough = b - a >= least_words
            owner, start, stop, a, b = (x[enough] for x in (owner, start, stop, a, b))
            # The chosen lines as texts of their own; they are in order and never overlap.
            n = b - a
            pick = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
            first = np.concatenate([[0], np.cumsum(n)])
            lines = W.Words(
                words.start[pick], words.end[pick], words.hash[pick], first, words.data,
                words.offsets,
            )
            values, groups = W.shingles(lines, size)
            base = words.first[owner]
            yield _rows(
                batch, owner,
                start=pa.array((start - words.offsets[owner]).astype(np.int32)),
                stop=pa.array((stop - words.offsets[owner]).astype(np.int32)),
                at=pa.array((a - base).astype(np.int32)),
                to=pa.array((b - base).astype(np.int32)),
                node=near.binary_column(near.node_ids(lines)),
                shingles=pa.array(np.diff(groups).astype(np.int32)),
                sketch=near.binary_column(W.min_hashes(values, groups, HASHES)),
            )
            at, value = chosen_windows(words, WINDOW, passage - WINDOW + 1)
            owner = np.searchsorted(words.first, at, "right") - 1
            yield _rows(
                batch, owner,
                at=pa.array((at - words.first[owner]).astype(np.int32)),
                window=pa.array(value.view(np.int64)),
            )

    kinds = "doc_id bigint, mark int, start int, stop int, at int, to int, window bigint, node binary"
    return docs.select("doc_id", "mark", "text").mapInArrow(
        cut, kinds + ", shingles int, sketch binary"
    )


def _rows(batch, owner, **columns) -> pa.RecordBatch:
    known = {
        "doc_id": batch.column("doc_id").take(pa.array(owner)),
        "mark": batch.column("mark").take(pa.array(owner)),
        **columns,
    }
    return pa.RecordBatch.from_arrays(
        [known.get(f.name, pa.nulls(len(owner), f.type)) for f in PARTS], schema=PARTS
    )


def _banded(nodes: DataFrame, bands: int, rows: int) -> DataFrame:
    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = near.matrix(pa.chunked_array([batch.column("sketch")]), np.uint16)
            keys = near.band_keys(sketch, bands, rows)
            lists = near.list_column(keys, np.ones(len(keys), dtype=bool))
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], ["node", "bands"])

    return nodes.select("node", "sketch").mapInArrow(band, "node binary, bands array<bigint>")


def _paragraph_texts(texts: DataFrame) -> DataFrame:
    """The stretch from ``start`` to ``stop`` (bytes) of each text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            data, offsets = W.text_bytes(batch.column("text"))
            start = batch.column("start").to_numpy() + offsets[:-1]
            stop = batch.column("stop").to_numpy() + offsets[:-1]
            parts = [data[a:b].tobytes().decode() for a, b in zip(start, stop)]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(parts, pa.string()))

    return texts.mapInArrow(cut, texts.schema)


def repeated_parts(
    docs: DataFrame, size: int, threshold: float, least_words: int, passage: int
) -> DataFrame:
    """What repeats: ``doc_id``, ``mark``, ``start``, ``stop``, ``keeper`` (the document that
    keeps it) and ``part`` (the paragraph's class; missing for passages). Limits of paragraphs are
    bytes, those of passages words."""
    parts = staged(_parts(docs, size, least_words, passage), "parts")
    paragraphs = parts.where("node is not null")
    nodes = staged(
        paragraphs.groupBy("node").agg(
            F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id")
        ),
        "paragraphs",
    )
    first = staged(
        paragraphs.join(nodes.select("node", "doc_id"), ["node", "doc_id"], "left_semi")
        .dropDuplicates(["node"]),
        "first",
    )
    groups = staged(near.sharing_groups(_banded(first, *tuned_bands(HASHES, threshold))), "groups")
    plan = near.matches_needed(threshold, 1e-6, STEPS)
    edges = near.pruned_edges(groups.join(first.select("node", "sketch"), "node"), plan)
    rows = near.components(edges).join(first.drop("sketch", "window"), "node")
    components = staged(rows.withColumn("copies", F.lit(1).cast("bigint")), "components")
    blocks = components.join(near.block_counts(components), "component")
    blocks = staged(blocks, "blocks")
    # Holds for all rows; see the Jaccard join.
    rows = blocks.where("_blocks >= 1")
    texts = docs.select("doc_id", "mark", "text").join(rows, ["doc_id", "mark"])
    found = staged(near.verified(_paragraph_texts(texts), size, threshold), "links")
    classes = near.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = staged(
        nodes.join(classes, "node", "left")
        .where((F.col("copies") > 1) | F.col("component").isNotNull())
        .select("node", "doc_id", "copies", F.coalesce("component", "node").alias("part")),
        "classes",
    )
    keepers = known.groupBy("part").agg(F.min("doc_id").alias("keeper"))
    known = staged(known.select("node", "part", "copies").join(keepers, "part"), "keepers")
    known = known.where("copies >= 1")
    lines = paragraphs.select("node", "doc_id", "mark", "start", "stop", "at", "to").join(
        known, "node"
    )
    lines = staged(lines.drop("node", "copies"), "lines")
    discard(nodes, first, groups, components, blocks, found)
    windows = parts.where("window is not null").select("window", "doc_id", "mark", "at")
    twice = windows.groupBy("window").agg(
        F.min("doc_id").alias("_first"), F.max("doc_id").alias("_last")
    )
    twice = staged(twice.where("_first < _last"), "windows").where("_first < _last")
    seeds = windows.join(twice.select("window"), "window")
    runs = shared_runs(docs, seeds, lines, passage - WINDOW, done=parts)
    columns = ["doc_id", "mark", "start", "stop", "keeper", "part"]
    return lines.select(*columns).unionByName(
        runs.select(
            "doc_id", "mark", F.col("at").alias("start"), F.col("to").alias("stop"), "keeper",
            F.lit(None).cast("binary").alias("part"),
        )
    )


def not_kept(doc: int, lines: list[dict]) -> list[dict]:
    """Those of a document's alike paragraphs that are cut: it keeps the first of each class that
    it is the keeper of."""
    kept, gone = set(), []
    for line in sorted(lines, key=lambda x: x["start"]):
        if line["keeper"] == doc and line["part"] not in kept:
            kept.add(line["part"])
        else:
            gone.append(line)
    return gone


def _covered(held, words: int | None = None) -> np.ndarray:
    """Which words some stretches cover: a mask of ``words`` words or up to the last stretch."""
    if words is None:
        words = max((to for _, to in held), default=0)
    steps = np.zeros(words + 1, dtype=np.int32)
    for at, to in held:
        steps[min(at, words)] += 1
        steps[min(to, words)] -= 1
    return np.cumsum(steps[:-1]) > 0


def shared_runs(
    docs: DataFrame, seeds: DataFrame, lines: DataFrame, around: int, done: DataFrame
) -> DataFrame:
    """Runs of words that an earlier document has and keeps: ``doc_id``, ``mark``, ``at``, ``to``
    (words) and ``keeper``. ``done`` is the staged table of the seeds; it goes when they are dealt
    out by document.

    ``seeds`` are the windows that several documents have. Only stretches that no paragraph cut
    covers keep anything, so each cut word stands in an earlier document, and there, if it is
    cut too, in a still earlier one. A seed is extended to the sides on which something stays
    within ``around`` words: by what it shares with the first keeper of its window, and, where that
    ends, by the longest run it shares with any other earlier keeper.
    """
    by = ["doc_id", "mark"]
    cuts = lines.groupBy(*by).agg(
        F.collect_list(F.struct("start", "at", "to", "keeper", "part")).alias("lines")
    )
    found = seeds.groupBy(*by).agg(F.collect_list(F.struct("window", "at")).alias("seeds"))
    held = found.join(cuts, by, "left")

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                [{"at": x["at"], "to": x["to"]} for x in not_kept(doc, part or [])]
                for doc, part in zip(
                    batch.column("doc_id").to_pylist(), batch.column("lines").to_pylist()
                )
            ]
            kind = pa.list_(pa.struct([("at", pa.int32()), ("to", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (*by, "seeds")), pa.array(out, kind)],
                names=[*by, "seeds", "gone"],
            )

    held = staged(
        held.mapInArrow(
            gone,
            "doc_id bigint, mark int, seeds array<struct<window: bigint, at: int>>, "
            "gone array<struct<at: int, to: int>>",
        ),
        "seeds",
    )
    discard(done)
    single = held.select(*by, "gone", F.explode("seeds").alias("s")).select(
        *by, "s.window", "s.at",
        (~F.exists("gone", lambda g: (g["at"] < F.col("s.at") + WINDOW) & (g["to"] > F.col("s.at"))))
        .alias("whole"),
    )
    keepers = single.where("whole").groupBy("window").agg(F.min("doc_id").alias("keeper"))
    same = staged(single.drop("whole").join(keepers, "window").where("keeper < doc_id"), "same")
    whole = same.groupBy(*by).agg(F.collect_list(F.struct("window", "at")).alias("shared"))

    def open_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows, sides = [], []
            for part, cut in zip(
                batch.column("shared").to_pylist(), batch.column("gone").to_pylist()
            ):
                mask = _covered(
                    [(x["at"], x["at"] + WINDOW) for x in part]
                    + [(x["at"], x["to"]) for x in cut or []]
                )
                bare = np.concatenate([[0], np.cumsum(~mask)])
                for x in part:
                    low, end = max(x["at"] - around, 0), x["at"] + WINDOW
                    high = end + around
                    if bare[x["at"]] > bare[low]:
                        windows.append(x["window"])
                        sides.append(LEFT)
                    if high > len(mask) or bare[high] > bare[end]:
                        windows.append(x["window"])
                        sides.append(RIGHT)
            yield pa.RecordBatch.from_arrays(
                [pa.array(windows, pa.int64()), pa.array(sides, pa.int32())],
                names=["window", "side"],
            )

    wanted = whole.join(held.select(*by, "gone"), by).mapInArrow(
        open_sides, "window bigint, side int"
    )
    wanted = staged(
        wanted.groupBy("window").agg(F.collect_set("side").alias("sides")), "open"
    )
    extended = single.join(wanted, "window").groupBy(*by).agg(
        F.collect_list(F.struct("window", "at", "sides")).alias("seeds"),
        F.count(F.lit(1)).alias("_n"),
    )
    extended = staged(extended.join(held.select(*by, "gone"), by), "extended")
    # The condition holds for all rows; see the Jaccard join.
    texts = docs.select(*by, "text").join(extended.where("_n >= 1"), by)
    near_by = staged(_surroundings(texts, around), "surroundings")
    first = near_by.groupBy("window", "side").agg(
        F.min(F.when(F.col("whole"), F.struct(*by, F.col("places")[0], "words", "free")))
        .alias("first"),
        F.count(F.lit(1)).alias("others"),
    )
    pairs = near_by.join(first.where("first is not null"), ["window", "side"]).select(
        *PLACES, "words", "free", "whole", "others", F.col("first.doc_id").alias("keeper"),
        F.col("first.words").alias("words_2"), F.col("first.free").alias("free_2"),
    )
    reach = staged(_reached(pairs), "reach")
    discard(near_by, extended)
    longest = _longest_runs(reach).withColumn("at", F.explode("places"))
    start = F.when(F.col("side") == LEFT, F.col("at") - F.col("n")).otherwise(F.col("at"))
    stop = F.when(F.col("side") == LEFT, F.lit(0)).otherwise(F.col("n"))
    runs = same.select(*by, "at", (F.col("at") + WINDOW).alias("to"), "keeper")
    return runs.unionByName(
        longest.select(*by, start.alias("at"), (F.col("at") + WINDOW + stop).alias("to"), "keeper")
    )


# Places of one document that are alike: same window, side, words and limits.
PLACES = ["window", "side", "doc_id", "mark", "places"]


def _longest_runs(reach: DataFrame) -> DataFrame:
    """The longest run of each row of ``reach``: its places, ``n`` words and their ``keeper``.

    Whoever shares more words with a seed than the first keeper does, shares as many with the first
    keeper as the seed. So the key of one more word tells which seeds go on together. Those
    have a key for each further word; of all who keep the words of a key the first is their
    keeper, and the longest key with an earlier one is the run.
    """
    going = reach.where("key is not null")
    together = going.groupBy("key").agg(
        F.min(F.when(F.col("gives"), F.col("doc_id"))).alias("_giver"),
        F.max("doc_id").alias("_last"),
    )
    mine = going.join(together.where("_giver < _last").select("key"), "key", "left_semi")
    mine = staged(_further_keys(mine), "further")
    row = ["window", "side", "doc_id", "mark", "place"]
    keys = mine.select(*row, "n", "kept", F.posexplode("keys").alias("_more", "key"))
    keys = keys.withColumn("n", F.col("n") + F.col("_more") + 1)
    givers = keys.groupBy("key").agg(
        F.min(F.when(F.col("n") <= F.col("kept"), F.col("doc_id"))).alias("giver"),
        F.max("doc_id").alias("_last"),
    )
    givers = staged(givers.where("giver < _last").select("key", "giver"), "givers")
    farther = keys.select(*row, "n", "key").join(givers, "key").where("giver < doc_id")
    farther = farther.groupBy(*row).agg(F.max(F.struct("n", "giver")).alias("far"))
    reach = reach.withColumn("place", F.col("places")[0])
    found = reach.join(farther, row, "left").select(
        *PLACES,
        F.coalesce("far.n", "best_n").alias("n"),
        F.coalesce("far.giver", "best_keeper").alias("keeper"),
    )
    return found.where("keeper is not null")


def _further_keys(going: DataFrame) -> DataFrame:
    """The keys of more than ``n`` words, one word more each, and how many words the row's
    document ``kept`` (0 if it gives none)."""

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = near.matrix(pa.chunked_array([batch.column("words")]), np.uint64)
            n = batch.column("n").to_numpy()
            there = np.logical_and.accumulate(words > 0, axis=1)
            there &= np.arange(words.shape[1]) >= n[:, None]
            keys = np.stack(list(_stretch_keys(batch, words)), axis=1)
            offsets = np.concatenate([[0], np.cumsum(there.sum(axis=1))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(keys[there].view(np.int64))
            )
            gives = batch.column("gives").to_numpy(zero_copy_only=False)
            kept = np.where(gives, batch.column("free").to_numpy(), 0).astype(np.int32)
            names = ["window", "side", "doc_id", "mark", "place", "n"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(kept), lists],
                names=[*names, "kept", "keys"],
            )

    rows = going.select(
        "window", "side", "doc_id", "mark", F.col("places")[0].alias("place"), "n", "words",
        "gives", "free",
    )
    return rows.mapInArrow(
        further,
        "window bigint, side int, doc_id bigint, mark int, place int, n int, kept int, "
        "keys array<bigint>",
    )


def _surroundings(texts: DataFrame, around: int) -> DataFrame:
    """Each seed and wanted side with the hashes of the words there, outwards (0: no word), how many
    of them no paragraph cut covers, and whether it covers the seed itself. Places of a document
    that are alike in all this are one row."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            words = W.words_of(batch.column("text"))
            cut = np.zeros(len(words.hash) + 1, dtype=bool)
            own, at, window, sides = [], [], [], []
            seeds, gone = batch.column("seeds").to_pylist(), batch.column("gone").to_pylist()
            for i, (part, lost) in enumerate(zip(seeds, gone)):
                low, high = words.first[i], words.first[i + 1]
                cut[low:high] = _covered([(x["at"], x["to"]) for x in lost or []], high - low)
                for x in part:
                    own += [i] * len(x["sides"])
                    at += [x["at"]] * len(x["sides"])
                    window += [x["window"]] * len(x["sides"])
                    sides += x["sides"]
            own, at = np.array(own, dtype=np.int64), np.array(at, dtype=np.int64)
            sides = np.array(sides, dtype=np.int32)
            begin = words.first[own] + at
            whole = ~cut[begin[:, None] + np.arange(WINDOW)].any(axis=1)
            out = np.arange(around)
            places = np.where(
                (sides == LEFT)[:, None], begin[:, None] - 1 - out, begin[:, None] + WINDOW + out
            )
            there = (places >= words.first[own][:, None]) & (places < words.first[own + 1][:, None])
            spot = np.where(there, places, 0)
            hashes = np.where(there, np.maximum(words.hash[spot], np.uint64(1)), np.uint64(0))
            free = np.logical_and.accumulate(there & ~cut[spot], axis=1).sum(axis=1)
            window = np.array(window, dtype=np.int64)
            alike = W.mixed(window.view(np.uint64) + sides.astype(np.uint64))
            for j in range(around):
                alike = W.mixed(alike * W.STEPS[0] + hashes[:, j])
            alike = W.mixed(alike * W.STEPS[0] + (2 * free + whole).astype(np.uint64))
            order = np.lexsort((at, alike, own))
            new = np.ones(len(order), dtype=bool)
            new[1:] = np.diff(own[order]) != 0
            new[1:] |= alike[order][1:] != alike[order][:-1]
            begin = np.flatnonzero(new)
            one = order[begin]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(window[one]),
                    pa.array(sides[one]),
                    batch.column("doc_id").take(pa.array(own[one])),
                    batch.column("mark").take(pa.array(own[one])),
                    pa.ListArray.from_arrays(
                        pa.array(np.append(begin, len(order)).astype(np.int32)),
                        pa.array(at[order].astype(np.int32)),
                    ),
                    near.binary_column(hashes[one]),
                    pa.array(free[one].astype(np.int32)),
                    pa.array(whole[one]),
                ],
                names=[*PLACES, "words", "free", "whole"],
            )

    return texts.mapInArrow(
        look,
        "window bigint, side int, doc_id bigint, mark int, places array<int>, words binary, "
        "free int, whole boolean",
    )


def _stretch_keys(batch: pa.RecordBatch, words: np.ndarray) -> Iterator[np.ndarray]:
    """For 1, 2, ... words: one hash of window, side and so many words outwards."""
    side = batch.column("side").to_numpy().astype(np.uint64)
    value = W.mixed(batch.column("window").to_numpy().view(np.uint64) + side)
    for j in range(words.shape[1]):
        value = W.mixed(value * W.STEPS[0] + words[:, j])
        yield value


def _reached(pairs: DataFrame) -> DataFrame:
    """How many words each row shares with its first keeper (``n``; ``best_n`` and ``best_keeper``
    if that is an earlier document) and, where it goes on, the key of one more word, whether its
    document keeps those (``gives``), and the row's words for comparing it further."""
    names = [*PLACES, "n", "key", "gives", "best_n", "best_keeper", "words", "free"]

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
            one = near.matrix(pa.chunked_array([batch.column("words")]), np.uint64)
            two = near.matrix(pa.chunked_array([batch.column("words_2")]), np.uint64)
            alike = np.logical_and.accumulate((one == two) & (one > 0), axis=1).sum(axis=1)
            n = np.minimum(alike, get("free_2"))
            key, goes_on = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=bool)
            for j, value in enumerate(_stretch_keys(batch, one)):
                key = np.where(n == j, value, key)
                goes_on |= (n == j) & (one[:, j] > 0)
            goes_on &= get("others") > 2
            earlier = pa.array(get("keeper") < get("doc_id"))
            length = pa.array(n.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in PLACES),
                    length,
                    pa.array(key.view(np.int64), mask=~goes_on),
                    pa.array(get("whole") & (get("free") > n)),
                    pc.if_else(earlier, length, None),
                    pc.if_else(earlier, batch.column("keeper"), None),
                    pc.if_else(pa.array(goes_on), batch.column("words"), None),
                    batch.column("free"),
                ],
                names=names,
            )

    return pairs.mapInArrow(
        reach,
        "window bigint, side int, doc_id bigint, mark int, places array<int>, n int, key bigint, "
        "gives boolean, best_n int, best_keeper bigint, words binary, free int",
    )


def dedup_substrings(
    docs: DataFrame,
    size: int = 5,
    threshold: float = 0.8,
    least_words: int = 40,
    passage: int = 50,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Documents without the parts that an earlier document has, all columns kept.

    Paragraphs of at least ``least_words`` words whose sets of ``size``-word shingles have a
    Jaccard similarity of ``threshold`` or more are alike; components of alike paragraphs stay
    in the document of least id, once. Bands are tuned so that a pair at the threshold is missed
    with a probability of at most 1 in 1000; colliding paragraphs whose MinHash values
    cannot reach it are dropped, the others are checked exactly. Passages: any run of
    ``passage`` words that two documents share verbatim contains a window of 24 words that both
    have chosen; from there it is extended to the whole run, which is cut from a document if an
    earlier one has it outside the paragraphs that are cut there.

    The text column holds what is left; a paragraph goes with its line break. Added columns:
    ``n_removed`` (separate stretches), ``removed_chars`` and ``kept_in`` (ids of the documents
    of which it is a repeat, sorted; one that lost its own copy names a still earlier one). Shorter repeats stay. Missing and empty texts come back as
    they are, and so do rows without an id. Rows with one id and one text have one outcome; rows
    with one id and different texts count as one document where passages are kept. Columns of
    ``docs`` that have an added name are replaced. An empty table gives no rows.
    """
    added = ["n_removed", "removed_chars", "kept_in"]
    docs = docs.drop(*added)
    named = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        F.hash(text).alias("mark"),
        F.col(text).alias("text"),
    ).where("doc_id is not null and text is not null")
    parts = repeated_parts(named, size, threshold, least_words, passage)
    cuts = parts.groupBy("doc_id", "mark").agg(
        F.collect_list(F.struct("start", "stop", "keeper", "part")).alias("_cuts")
    )
    cuts = staged(cuts.withColumnsRenamed({"doc_id": "_doc_id", "mark": "_mark"}), "cuts")
    same = (F.col(doc_id) == F.col("_doc_id")) & (F.hash(text) == F.col("_mark"))
    joined = docs.join(cuts, same, "left").drop("_mark")
    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("n_removed", T.LongType()),
            T.StructField("removed_chars", T.LongType()),
            T.StructField("kept_in", T.ArrayType(T.LongType())),
        ]
    )
    names, text_at = docs.columns, docs.columns.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            texts, removed, chars, kept = [], [], [], []
            values = batch.column(text).to_pylist()
            own = batch.column("_doc_id").to_pylist()
            lists = in_bytes(batch.column(text), batch.column("_cuts").to_pylist())
            for value, doc, cuts in zip(values, own, lists):
                left, n, ids = without(value, doc, cuts) if cuts else (value, 0, [])
                texts.append(left)
                removed.append(n)
                chars.append(len(value or "") - len(left or ""))
                kept.append(ids)
            columns = [batch.column(c) for c in names]
            columns[text_at] = pa.array(texts, pa.string())
            columns += [pa.array(removed, pa.int64()), pa.array(chars, pa.int64())]
            columns.append(pa.array(kept, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return joined.mapInArrow(cut, schema)


def in_bytes(texts: pa.Array, lists: list) -> list:
    """The lists of cuts with the limits of passages in bytes, as those of paragraphs are."""
    some = [i for i, cuts in enumerate(lists) if cuts and any(c["part"] is None for c in cuts)]
    words = W.words_of(texts.take(pa.array(some, pa.int64())))
    for k, i in enumerate(some):
        base = words.offsets[k]
        passages = [c for c in lists[i] if c["part"] is None]
        inside = _covered([(c["start"], c["stop"]) for c in passages])
        for c in passages:
            first, behind = words.first[k] + c["start"], words.first[k] + c["stop"]
            # What stands between two cuts that touch goes with them.
            touches = c["stop"] < len(inside) and inside[c["stop"]]
            end = words.start[behind] if touches else words.end[behind - 1]
            c["start"], c["stop"] = int(words.start[first] - base), int(end - base)
    return lists


def without(text: str, doc: int, cuts: list[dict]) -> tuple[str, int, list[int]]:
    """The text without its cuts, how many stretches that were, and who keeps them."""
    raw = text.encode()
    gone = not_kept(doc, [c for c in cuts if c["part"] is not None])
    gone += [c for c in cuts if c["part"] is None]
    ids, spans = {c["keeper"] for c in gone}, []
    for c in gone:
        start, stop, line = c["start"], c["stop"], c["part"] is not None
        if line and stop < len(raw):
            stop += 1
        elif line and start:
            start -= 1
        spans.append((start, stop))
    merged: list[list[int]] = []
    for start, stop in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], stop)
        else:
            merged.append([start, stop])
    at, left = 0, []
    for start, stop in merged:
        left.append(raw[at:start])
        at = max(at, stop)
    left.append(raw[at:])
    return b"".join(left).decode(), len(merged), sorted(ids)
