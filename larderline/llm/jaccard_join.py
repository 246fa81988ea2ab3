"""N-gram Jaccard join with Bayesian pruning of candidates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.llm import near
from larderline.llm import words as W
from larderline.session import staged

HASHES, BANDS, ROWS = 128, 25, 5
STEPS = (16, 32, 64, 128)


def jaccard_join(
    docs: DataFrame,
    size: int = 5,
    threshold: float = 0.8,
    tolerance: float = 1e-6,
    doc_id: str = "doc_id",
    text: str = "text",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Documents whose sets of ``size``-word shingles have a Jaccard similarity of at least
    ``threshold``: ``doc_id``, ``class_id``, ``n_links``.

    A class is what links connect, named by its least id; ``n_links`` counts the other rows
    that a row is linked with, copies one by one. Texts with the same words are one node with
    several copies. Nodes that agree in one of 25 bands of 5 MinHash values (a pair at
    the threshold is missed with probability 5e-5) are compared on 16, 32, 64 and 128 MinHash
    values and dropped as soon as the posterior probability of reaching the threshold
    is below ``tolerance``. Inside each group that the survivors connect all pairs are checked
    exactly on their full shingle sets, so links that the bands missed are found there too.

    A text with fewer words than ``size`` has one shingle of all of them. Texts without words
    are linked with equal texts only; missing and empty ones with nothing. Rows without an id
    stay alone and have no class. Repeated rows are copies. An empty table gives no rows;
    other columns are not looked at, and only those in ``keep`` are returned with their row.
    """
    kept = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in keep]).alias("_kept")
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), kept)
    sketch = staged(_sketches(named, size), "sketch")
    nodes = sketch.where("node is not null and doc_id is not null").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"),
        F.count(F.lit(1)).alias("copies"),
        F.first("shingles").alias("shingles"),
    )
    nodes = staged(nodes, "nodes")
    first = sketch.join(
        nodes.select("node", "doc_id"), ["node", "doc_id"], "left_semi"
    ).dropDuplicates(["node"])
    first = staged(first.where("shingles > 0").select("node", "sketch", "bands"), "first")
    groups = staged(near.sharing_groups(first), "groups")
    plan = near.matches_needed(threshold, tolerance, STEPS)
    edges = near.pruned_edges(groups.join(first.select("node", "sketch"), "node"), plan)
    rows = staged(near.components(edges).join(nodes, "node"), "components")
    rows = staged(rows.join(near.block_counts(rows), "component"), "blocks")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # The condition holds for all rows; it tells Spark that the keys are worth a filter on the
    # scan of the texts, of which few are wanted.
    wanted = texts.join(rows.where("_blocks >= 1"), "doc_id")
    found = staged(near.verified(_same_node(wanted), size, threshold), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = near.components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_node = (
        nodes.where("copies > 1").select("node").unionByName(links.select("node")).distinct()
        .join(nodes.select("node", "doc_id", "copies"), "node")
        .join(classes, "node", "left")
        .join(links, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
    )
    of_node = staged(of_node, "nodes")
    names = of_node.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    of_node = of_node.join(names, "component").select(
        "node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    key = F.when(F.col("doc_id").isNotNull(), F.col("node"))
    own = sketch.select("doc_id", key.alias("node"), "_kept")
    return own.join(of_node, "node", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        *[F.col("_kept").getField(c).alias(c) for c in keep],
    )


def _sketches(docs: DataFrame, size: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            words = W.words_of(batch.column("text"))
            values, first = W.shingles(words, size)
            n = np.diff(first)
            hashes = W.min_hashes(values, first, HASHES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    near.binary_column(*near.text_nodes(words)),
                    pa.array(n.astype(np.int64)),
                    near.binary_column(hashes),
                    near.list_column(near.band_keys(hashes, BANDS, ROWS), n > 0),
                    batch.column("_kept"),
                ],
                names=["doc_id", "node", "shingles", "sketch", "bands", "_kept"],
            )

    made = T.StructType(
        [
            docs.schema["doc_id"],
            T.StructField("node", T.BinaryType()),
            T.StructField("shingles", T.LongType()),
            T.StructField("sketch", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
            docs.schema["_kept"],
        ]
    )
    return docs.mapInArrow(sketch, made)


def _same_node(rows: DataFrame) -> DataFrame:
    """Rows whose text is the node's: an id may come with several texts, of which one is meant."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text"):
            ids, valid = near.text_nodes(W.words_of(batch.column("text")))
            own = near.binary_column(ids, valid)
            yield batch.filter(pc.fill_null(pc.equal(own, batch.column("node")), False))

    return rows.mapInArrow(check, rows.schema)
