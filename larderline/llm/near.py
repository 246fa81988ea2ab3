"""Near-duplicate search: MinHash bands, candidate groups, exact checks, components.

Items are nodes: one per different text, however many copies it has. Work on a group of items
is cut into pairs of blocks of bounded size, each a task of its own, and a block
returns a spanning forest and counts, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larderline.llm import words as W
from larderline.session import staged

SKETCH_BLOCK = 1024
TEXT_BLOCK = 128
BLOCK_SHINGLES = 1_000_000


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    cut = sketch[:, : bands * rows].reshape(len(sketch), bands, rows).astype(np.uint64)
    keys = np.arange(1, bands + 1, dtype=np.uint64) * W.STEPS[63]
    keys = np.broadcast_to(keys, (len(sketch), bands)).copy()
    for j in range(rows):
        keys += W.mixed(cut[:, :, j] + np.uint64(1)) * W.STEPS[j]
    return W.mixed(keys).view(np.int64)


def node_ids(words: W.Words) -> np.ndarray:
    """16 bytes for the word sequence of each text, as rows of two numbers."""
    one = W.group_hash(words.hash, words.first)
    two = W.group_hash(words.hash ^ np.uint64(0xA5A5A5A5A5A5A5A5), words.first)
    return np.stack([one, two], axis=1)


def text_nodes(words: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Node ids of texts, by their words or else by their bytes; empty texts have none."""
    ids = node_ids(words)
    sizes = np.diff(words.offsets)
    bare = np.flatnonzero((words.counts == 0) & (sizes > 0))
    for i in bare:
        raw = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes()
        ids[i] = np.frombuffer(hashlib.md5(raw).digest(), dtype=np.uint64)
    return ids, sizes > 0


def binary_column(rows: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The bytes of each row of an array, as Spark's binary type."""
    rows = np.ascontiguousarray(rows)
    width = rows.dtype.itemsize * (rows.shape[1] if rows.ndim > 1 else 1)
    fixed = pa.FixedSizeBinaryArray.from_buffers(
        pa.binary(width), len(rows), [None, pa.py_buffer(rows)]
    ).cast(pa.binary())
    if valid is None:
        return fixed
    return pc.if_else(pa.array(valid), fixed, pa.scalar(None, pa.binary()))


def list_column(rows: np.ndarray, valid: np.ndarray) -> pa.Array:
    """Rows of numbers as lists; empty lists where not valid."""
    sizes = np.where(valid, rows.shape[1], 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows[valid].ravel()))


def matrix(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """Binary values of one width as a matrix."""
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]]
    return np.frombuffer(flat.tobytes(), dtype=dtype).reshape(len(column), -1)


def sharing_groups(nodes: DataFrame) -> DataFrame:
    """Groups of nodes that share a band key: ``bucket``, ``node``, ``_size``.

    ``nodes`` has ``node`` and ``bands``. Keys of one node only lead nowhere. Keys with the
    same members, as most of the keys of one pair are, count once. Only keys and 64-bit hashes of
    nodes are moved for all bands (two nodes of one hash join the same groups).
    """
    mark = F.xxhash64("node").alias("mark")
    keyed = nodes.select(mark, F.explode("bands").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"))
    members = staged(keyed.join(sizes.where("_size > 1"), "bucket"), "members")
    groups = members.groupBy("bucket", "_size").agg(
        F.bit_xor("mark").alias("_xor"), F.min("mark").alias("_low"), F.max("mark").alias("_high")
    )
    groups = groups.groupBy("_size", "_xor", "_low", "_high").agg(F.min("bucket").alias("bucket"))
    members = members.join(groups.select("bucket"), "bucket")
    return members.join(nodes.select("node", mark), "mark").select("bucket", "node", "_size")


def in_block_pairs(rows: DataFrame, blocks, node: str = "node") -> DataFrame:
    """Deals each group into ``blocks`` blocks by node, then repeats a row for each pair of
    blocks that its own is part of: ``_block``, ``_one`` <= ``_two``."""
    own = F.pmod(F.xxhash64(node, F.lit(5)), F.col("_blocks")).cast("int")
    rows = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_block", own)
    other = F.sequence(F.lit(0), F.col("_blocks") - 1)
    rows = rows.withColumn("_other", F.explode(other))
    return rows.withColumns(
        {"_one": F.least("_block", "_other"), "_two": F.greatest("_block", "_other")}
    ).drop("_other", "_blocks")


@lru_cache
def matches_needed(
    threshold: float, tolerance: float, steps: tuple[int, ...]
) -> list[tuple[int, int, int]]:
    """(from, to, least matches): after ``to`` compared values a pair with fewer matches has a
    posterior probability under ``tolerance`` of reaching the threshold.

    With a uniform prior, m matches among n give a Beta(m + 1, n - m + 1) posterior, and
    P(similarity >= t) equals P(Binomial(n + 1, t) <= m).
    """
    plan, before = [], 0
    for n in steps:
        chance, below = (1 - threshold) ** (n + 1), 0.0
        for m in range(n + 1):
            below += chance
            if below >= tolerance:
                break
            chance *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
        plan.append((before, n, m))
        before = n
    return plan


def plausible(one: np.ndarray, others: np.ndarray, plan) -> np.ndarray:
    """Which rows may be as similar as asked to ``one``; compares values a few at a time."""
    alive = np.arange(len(others))
    got = np.zeros(len(others), dtype=np.int32)
    for low, high, need in plan:
        got = got + (others[alive, low:high] == one[low:high]).sum(axis=1)
        keep = got >= need
        alive, got = alive[keep], got[keep]
        if not len(alive):
            break
    return alive


def pruned_edges(members: DataFrame, plan) -> DataFrame:
    """Edges (``a``, ``b``) that connect whatever is plausibly similar inside each group.

    ``members`` has ``bucket``, ``node``, ``_size`` and ``sketch``. Inside a block pair the
    similar ones are found breadth-first: each reached node is compared with those not reached
    yet. So a block of near copies costs one pass, and nothing is linked by its group alone.
    """

    def forest(table: pa.Table) -> pa.Table:
        sketch = matrix(table.column("sketch"), np.uint16)
        rest = np.arange(len(sketch))
        a, b = [], []
        while len(rest) > 1:
            root, rest = rest[0], rest[1:]
            queue = [root]
            while queue and len(rest):
                hit = plausible(sketch[queue.pop()], sketch[rest], plan)
                queue.extend(rest[hit])
                a.extend(rest[hit])
                b.extend([root] * len(hit))
                rest = np.delete(rest, hit)
        node = table.column("node")
        return pa.table({"a": node.take(pa.array(a, pa.int64())),
                         "b": node.take(pa.array(b, pa.int64()))})

    blocks = F.ceil(F.col("_size") / F.lit(SKETCH_BLOCK))
    dealt = in_block_pairs(members, blocks).select("bucket", "_one", "_two", "node", "sketch")
    edges = dealt.groupBy("bucket", "_one", "_two").applyInArrow(forest, "a binary, b binary")
    return edges.distinct()


def star_edges(members: DataFrame) -> DataFrame:
    """Edges from each node to the least node of its group."""
    least = members.groupBy("bucket").agg(F.min("node").alias("b"))
    edges = members.select("bucket", F.col("node").alias("a")).join(least, "bucket")
    return edges.where("a <> b").select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Connected components: ``node``, ``component`` (its least node), for nodes with edges.

    Alternates two kinds of steps on a table of edges until nothing changes. A large step
    links all greater neighbours of a node to its least neighbour, a small step links the
    smaller ones and the node itself. The least neighbour is an aggregate, so a node
    that a third of all edges meet in is never gathered in one place; every round is written
    to the shared folder.
    """
    edges = staged(edges.where("a <> b").select("a", "b"), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first, so that the join has an exchange of its own on both sides and the rows
        # of a hot node can be split.
        least = both.groupBy("a").agg(F.min("b").alias("_m"))
        least = staged(least.select("a", F.least("a", "_m").alias("_m")), "least")
        large = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.col("_m").alias("b")
        ).distinct()
        # Every edge now points from the greater node to the smaller one.
        least = large.groupBy("a").agg(F.min("b").alias("_m"))
        linked = large.join(least, "a")
        small = (
            linked.where("b <> _m").select(F.col("b").alias("a"), F.col("_m").alias("b"))
            .unionByName(least.select("a", F.col("_m").alias("b")))
            .distinct()
        )
        edges = staged(small, "edges")
        now = edges.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")
        ).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = now


def intersections(sets: Sequence[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted sets, by products of incidence parts."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[sizes[0], both], [both, sizes[1]]])
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = np.bincount(at, minlength=len(values)) > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    at, owner = column[at[keep]], owner[keep]
    out = np.zeros((m, m), dtype=np.float64)
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    width = 4096
    for low in range(0, int(shared.sum()), width):
        s, e = np.searchsorted(at, [low, low + width])
        part = np.zeros((m, width), dtype=np.float32)
        part[owner[s:e], at[s:e] - low] = 1
        out += part @ part.T
    out = np.rint(out).astype(np.int64)
    np.fill_diagonal(out, sizes)
    return out


def shingle_sets(words: W.Words, size: int) -> list[np.ndarray]:
    values, first = W.shingles(words, size)
    return [np.unique(values[first[i] : first[i + 1]]) for i in range(len(words))]


def verified(members: DataFrame, size: int, threshold: float) -> DataFrame:
    """Exact check of all pairs inside each candidate component.

    ``members`` has ``component``, ``node``, ``text``, ``copies`` and ``_blocks``. Returns
    ``node``, ``root`` and ``links``: the copies of similar nodes (each pair of nodes is
    counted in one pair of blocks only), and edges node - root that span what is similar.
    """

    def check(table: pa.Table) -> pa.Table:
        words = W.words_of(table.column("text"))
        sets = shingle_sets(words, size)
        copies = table.column("copies").to_numpy()
        block = table.column("_block").to_numpy()
        sizes = np.array([len(s) for s in sets])
        both = intersections(sets)
        # In whole numbers up to the last step: both / union >= threshold.
        similar = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        similar &= both > 0
        np.fill_diagonal(similar, False)
        if (block != block[0]).any():
            similar &= block[:, None] != block[None, :]
        links = similar @ copies
        root = np.arange(len(sets))
        while True:
            least = np.where(similar, root[None, :], len(sets)).min(axis=1)
            least = np.minimum(least, root)
            least = least[least]
            if (least == root).all():
                break
            root = least
        touched = links > 0
        node = table.column("node")
        return pa.table({"node": node.filter(pa.array(touched)),
                         "root": node.take(pa.array(root[touched])),
                         "links": pa.array(links[touched].astype(np.int64))})

    dealt = in_block_pairs(members, F.col("_blocks"))
    dealt = dealt.select("component", "_one", "_two", "_block", "node", "copies", "text")
    return dealt.groupBy("component", "_one", "_two").applyInArrow(
        check, "node binary, root binary, links bigint"
    )


def block_counts(rows: DataFrame) -> DataFrame:
    """Blocks per component, from its nodes and its shingles: ``component``, ``_blocks``."""
    return rows.groupBy("component").agg(
        F.ceil(
            F.greatest(
                F.count(F.lit(1)) / F.lit(TEXT_BLOCK), F.sum("shingles") / F.lit(BLOCK_SHINGLES)
            )
        ).alias("_blocks")
    )
