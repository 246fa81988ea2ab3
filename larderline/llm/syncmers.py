"""Document fingerprints from closed syncmers.

A k-mer of characters is an anchor if the least hash of its inner s-mers is that of the first
or the last one. Whether it is depends on the k-mer alone, so an edit elsewhere
moves no anchor. A fingerprint keeps the anchors of least hash with their places.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.llm import words as W

K, S = 16, 8
# Texts shorter than this use shorter k-mers.
SHORT, SHORT_K, SHORT_S = 48, 5, 2
KEPT = 64
U64 = np.uint64


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, dtype=np.uint32), np.concatenate([[0], np.cumsum(sizes)])


def anchors(texts: list[str], k: int, s: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and places of the closed syncmers of each text; short texts have short k-mers."""
    found = _anchors(texts, k, s)
    short = [i for i, t in enumerate(texts) if len(t) < SHORT and SHORT_K < k]
    for i, f in zip(short, _anchors([texts[i] for i in short], SHORT_K, SHORT_S)):
        found[i] = f
    return found


def _anchors(texts: list[str], k: int, s: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Anchors of one length.

    A text of fewer than ``k`` characters, but not none, is one anchor as a whole.
    """
    codes, first = code_points(texts)
    n = len(codes)
    up, down = W.powers(n + 1)
    sums = np.concatenate([[U64(0)], np.cumsum(W.mixed(codes.astype(U64) + U64(1)) * up[:n])])
    found = [(np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))] * len(texts)
    if n >= k:
        small = W.mixed((sums[s:] - sums[:-s]) * down[: n - s + 1])
        least = W.least_in_run(small, k - s + 1)
        closed = (least == small[: len(least)]) | (least == small[k - s : k - s + len(least)])
        at = np.flatnonzero(closed)
        owner = np.searchsorted(first, at, "right") - 1
        inside = at + k <= first[owner + 1]
        at, owner = at[inside], owner[inside]
        value = W.mixed((sums[at + k] - sums[at]) * down[at])
        value = (value >> U64(32)).astype(np.uint32)
        limits = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        low, high = first[i], first[i + 1]
        if 0 < high - low < k:
            whole = W.mixed((sums[high : high + 1] - sums[low : low + 1]) * down[low : low + 1])
            found[i] = ((whole >> U64(32)).astype(np.uint32), np.zeros(1, dtype=np.int64))
        elif high > low:
            part = slice(limits[i], limits[i + 1])
            found[i] = (value[part], at[part] - low)
    return found


def kept_anchors(found, kept: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``kept`` anchors of least hash, each at its first place, in order of the hashes."""
    values, place = np.unique(found[0], return_index=True)
    return values[:kept], found[1][place[:kept]]


def as_text(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """``hash:place`` in hexadecimal for each anchor, least hash first."""
    return " ".join(f"{h:08x}:{p:x}" for h, p in zip(print_[0].tolist(), print_[1].tolist()))


def likeness(one, two, kept: int) -> float:
    """Share of the anchors of two fingerprints that match in hash and order of place.

    Of the least ``kept`` hashes of both together, those in both count if their places
    keep the same order in both texts (the longest such series). Dice's measure of
    the estimated resemblance; 1 for equal fingerprints, two empty ones included.
    """
    if len(one[0]) == len(two[0]) and (one[0] == two[0]).all() and (one[1] == two[1]).all():
        return 1.0
    if not len(one[0]) or not len(two[0]):
        return 0.0
    union = np.union1d(one[0], two[0])
    if len(one[0]) == kept or len(two[0]) == kept:
        # Beyond the lesser of the largest hashes a full fingerprint is silent.
        ends = [p[0][-1] for p in (one, two) if len(p[0]) == kept]
        union = union[union <= min(ends)]
    both, a, b = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    inside = both <= union[-1] if len(union) else np.zeros(len(both), dtype=bool)
    a, b = one[1][a[inside]], two[1][b[inside]]
    order = np.argsort(a, kind="stable")
    series: list[int] = []
    for x in b[order].tolist():
        at = int(np.searchsorted(series, x, "left")) if series else 0
        series[at : at + 1] = [x]
    if not len(union):
        return 0.0
    jaccard = len(series) / len(union)
    return 2 * jaccard / (1 + jaccard)


def fingerprints(
    docs: DataFrame, text: str = "text", k: int = K, s: int = S, kept: int = KEPT
) -> DataFrame:
    """Adds ``fingerprint`` to every row; equal texts have equal fingerprints.

    Missing and empty texts have an empty one. A column of that name is replaced.
    """
    docs = docs.drop("fingerprint")
    schema = T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.StringType())])
    names = schema.names

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, text):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            prints = [as_text(kept_anchors(f, kept)) for f in anchors(texts, k, s)]
            columns = [*batch.columns, pa.array(prints, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(make, schema)


def range_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are below the value, by bisection; 0 for a missing value."""
    table = F.array(*[F.lit(c) for c in cuts])
    steps = [2**i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    if not steps:
        return F.lit(0)

    def step(below: Column, width: Column) -> Column:
        reach = below + width
        fits = (reach <= len(cuts)) & (F.get(table, reach - 1) < value)
        return F.when(fits, reach).otherwise(below)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def by_neighbours(docs: DataFrame) -> DataFrame:
    """Deals documents (``doc_id``, ``text``) out by ranges of ids, in order.

    Rows come sorted by ``_chunk``, ``_guest``, ``doc_id`` (missing first), ``_tie``. The first
    document of each chunk is also sent to the chunk before it, as a guest (that of the first
    chunk to the last one), so that every document finds its successor behind it in its own
    chunk. Ranges are found from the ids alone; each text is moved once.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    cuts = docs.agg(F.percentile_approx("doc_id", shares, F.lit(20 * parts))).first()[0]
    chunk = range_of(F.col("doc_id"), sorted(set(cuts or [])))
    rows = docs.withColumns({"_chunk": chunk, "_tie": F.xxhash64("text")})
    firsts = rows.groupBy("_chunk").agg(F.min(F.struct("doc_id")).alias("_first")).collect()
    firsts = sorted((r["_chunk"], r["_first"]["doc_id"]) for r in firsts)
    kind = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_to", T.IntegerType())])
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    # One row for each chunk, so four for each shuffle partition at most: safe to broadcast, and
    # then the texts are not moved for it.
    guests = F.broadcast(docs.sparkSession.createDataFrame(before, kind))
    rows = rows.join(guests, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    own = F.struct(F.col("_chunk"), F.lit(0).alias("_guest"))
    guest = F.struct(F.col("_to").alias("_chunk"), F.lit(1).alias("_guest"))
    place = F.explode(F.when(F.col("_to").isNull(), F.array(own)).otherwise(F.array(own, guest)))
    rows = rows.select("doc_id", "text", "_tie", place.alias("_place"))
    rows = rows.select("_place._chunk", "_place._guest", "doc_id", "_tie", "text")
    return rows.repartition(parts // 4, "_chunk").sortWithinPartitions(
        "_chunk", "_guest", "doc_id", "_tie"
    )


def compared_with_edits(docs: DataFrame, k: int = K, s: int = S, kept: int = KEPT) -> DataFrame:
    """Fingerprints of all documents and of edited texts, and how alike they are.

    ``docs`` has ``doc_id`` and ``text``; a missing text is empty. The edited text is the
    document's with its last floor(n / 4) code points replaced by as many of the first ones
    of the next document (or all it has), in order of ids; the last document is followed by the
    first. Rows without an id come first, repeated ids in order of a hash of the text.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor: chunk, guest, id, text, print

        for batch in W.pieces(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            prints = [kept_anchors(f, kept) for f in anchors(texts, k, s)]
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("_chunk", "_guest", "doc_id")),
                            texts, prints))
            rows = rows if held is None else [held, *rows]
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if a[0] == b[0] and not a[1]]
            edited = []
            for one, two in pairs:
                q = len(one[3]) // 4
                edited.append(one[3][: len(one[3]) - q] + two[3][:q])
            changed = [kept_anchors(f, kept) for f in anchors(edited, k, s)]
            yield pa.RecordBatch.from_pylist(
                [
                    {
                        "doc_id": one[2],
                        "n_chars": len(one[3]),
                        "edited_sha256": hashlib.sha256(
                            text.encode("utf-8", "surrogatepass")
                        ).hexdigest(),
                        "fingerprint": as_text(one[4]),
                        "edited_fingerprint": as_text(new),
                        "near_edited": likeness(one[4], new, kept),
                        "near_next": likeness(one[4], two[4], kept),
                    }
                    for (one, two), text, new in zip(pairs, edited, changed)
                ],
                schema=COMPARED,
            )

    kinds = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string"
    kinds += ", edited_fingerprint string, near_edited double, near_next double"
    return by_neighbours(docs).mapInArrow(compare, kinds)


COMPARED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
     ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
     ("near_edited", pa.float64()), ("near_next", pa.float64())]
)
