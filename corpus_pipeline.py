"""From raw documents to a training mix, in five stages.

Each stage takes what its predecessor kept and, but for the last, returns the columns of
``documents``. All columns of the input are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderline.llm import decontaminate, jaccard_join, language, mixing, substring
from larderline.queries.registry import table
from larderline.session import prepare, staged

LEAST_SHARE = 0.3


def _apart(docs: DataFrame, *own: str) -> DataFrame:
    """The named columns, and the others as one struct that no added column can clash with."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(F.lit(0).alias("_"), *rest).alias("_doc"))


def _together(found: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of ``docs`` again."""
    return found.select(
        *[F.col(c) if c in own else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    )


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and one language that has 3 in 10 of their words: mixed texts stay,
    texts without letters and jumbles of many languages go. Without labelled rows all stay."""
    model = language.train_languages(docs.select("text", "lang"))
    if not model.languages:
        return docs
    found = language.label_languages(_apart(docs, "text"), model)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SHARE))
    return _together(kept, docs, "text")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of least id.

    Documents without an id are in no class and stay. Rows of one id are dropped each by its own
    text. Of rows with the same id and text one stays.
    """
    apart = _apart(docs, "doc_id", "text").withColumn("_mark", F.xxhash64("text"))
    classes = staged(
        jaccard_join.jaccard_join(apart.select("doc_id", "text", "_mark"), keep=["_mark"]),
        "classes",
    )
    # Merge joins at every size: the texts are moved once, the ids never broadcast.
    key = ["doc_id", "_mark"]
    gone = classes.where("doc_id <> class_id").select(*key).distinct().hint("merge")
    kept = apart.join(gone, key, "left_anti")
    repeated = staged(
        classes.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
        .select("doc_id"),
        "repeated",
    )
    if not repeated.isEmpty():
        once = kept.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        kept = kept.join(repeated, "doc_id", "left_anti").unionByName(once)
    return _together(kept, docs, "doc_id", "text")


def drop_repeated_parts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the parts an earlier one has; those of which nothing is left go."""
    found = substring.dedup_substrings(_apart(docs, "doc_id", "text"))
    cut = F.col("n_removed") > 0
    found = found.where(~cut | (F.trim("text") != ""))
    if "n_chars" not in docs.columns:
        return _together(found, docs, "doc_id", "text")
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    found = found.withColumn("n_chars", F.when(cut, length).otherwise(F.col("_doc.n_chars")))
    return _together(found, docs, "doc_id", "text", "n_chars")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark stands verbatim."""
    benchmark = table(spark, sf_dir, "benchmark")
    return _together(decontaminate.decontaminated(_apart(docs, "text"), benchmark), docs, "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix with their copies and words, then their other columns.

    A column named like a figure of the mix gets ``_document`` behind its name.
    """
    own, made = ["doc_id", "source"], ["size", "source_size", "target", "copies", "taken"]
    names = {}
    for c in docs.columns:
        new = c
        while new in made or (new != c and new in docs.columns):
            new += "_document"
        names[c] = new
    docs = docs.withColumnsRenamed(names)
    keep = [c for c in docs.columns if c not in own]
    return mixing.mix_sources(docs, keep=keep).where("copies > 0")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", drop_repeated_parts),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix),
]
# Language models and similarity classes are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder for the next."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
