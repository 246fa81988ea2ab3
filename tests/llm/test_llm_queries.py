"""The registered queries and the pipeline on small tables."""

import os

import pytest
from compare import differences, duck
from conftest import rows
from pyspark.sql import functions as F

import corpus_pipeline
from larderline.llm.queries import REGISTRY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="benchmark tables not present")
COLUMNS = {
    "op1": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op2": "doc_id class_id n_links",
    "op3": "doc_id text n_removed removed_chars kept_in",
    "op4": "page_id url text n_chars",
    "op5": "doc_id held_out score predicted",
    "op6": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op7": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op8": "doc_id held_out lang_pred score",
    "op9": "page_id host path rule verdict",
    "op10": "doc_id size source_size target taken",
    "op12": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op13": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept quality",
}


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_same_result_as_sql(spark, name):
    q = REGISTRY[name]
    assert differences(q.run(spark, SF), duck(SF).execute(q.sql)) == []


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if not q.sql])
def test_one_row_for_each_input_row(spark, name):
    got = REGISTRY[name].run(spark, SF)
    assert got.columns == COLUMNS[name.split("_")[0]].split()
    source = "pages" if name.startswith("op4") else "documents"
    assert got.count() == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in REGISTRY) == list(range(1, 14))


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.withColumns({"score": F.lit("x"), "_doc": F.lit(1), "n_hit": F.lit(2), "target": F.lit(3)})
    odd = spark.createDataFrame(
        [(10**6, None, "en", "src1"), (10**6 + 1, "", None, None), (10**6 + 2, "12 34", "en", "src1"),
         (None, "the and of to in that was", "en", "src1")],
        "doc_id bigint, text string, lang string, source string",
    )
    now = extra.unionByName(odd, allowMissingColumns=True)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == extra.columns
            now = out
    assert not seen["language ID"] & {10**6, 10**6 + 1, 10**6 + 2} and None in seen["language ID"]
    classes = REGISTRY["op2_jaccard_join"].run(spark, SF).collect()
    gone = {r.doc_id for r in classes if r.doc_id != r.class_id}
    assert seen["language ID"] - seen["n-gram Jaccard join"] == gone & seen["language ID"]
    hit = {r.doc_id for r in REGISTRY["op7_contamination"].run(spark, SF).collect() if r.contaminated}
    left = seen["benchmark decontamination"]
    assert not left & hit or all(d not in left for d in hit & seen["substring dedup"])
    assert None in left


def test_rows_of_one_id_go_by_their_own_text(spark):
    copied = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"other{i * 7}" for i in range(60))
    docs = spark.createDataFrame(
        [(1, copied, "a"), (2, copied, "b"), (2, other, "c"), (2, other, "c"), (3, None, None)],
        "doc_id bigint, text string, _mark string",
    )
    kept = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id", "_mark") == [(1, copied, "a"), (2, other, "c"), (3, None, None)]


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame(
        [(i, "some words here", "s", i, "t", "u") for i in range(20)],
        "doc_id bigint, text string, source string, size int, target string, target_document string",
    )
    mixed = corpus_pipeline.mix(spark, docs, SF)
    assert {"size_document", "target_document_document", "target_document", "text"} <= set(mixed.columns)
    for r in mixed.collect():
        assert (r.size, r.size_document, r.target_document_document, r.target_document) == (3, r.doc_id, "t", "u")


def test_pipeline_of_empty_tables(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        assert now.count() == 0


def test_run_chains_the_stages(spark):
    mixed = corpus_pipeline.run(spark, SF)
    sums = mixed.groupBy("source", "target").agg(F.sum("taken").alias("taken"), F.max("copies").alias("c"))
    for r in sums.collect():
        assert abs(r.taken - r.target) < max(0.2 * r.target, 200) and r.c <= 2
    assert mixed.where("taken <> copies * size").count() == 0


def test_entry_points_have_them(spark):
    import __spark_entry__ as entry

    assert set(REGISTRY) | {"pipeline"} <= set(entry.queries())
    assert {n for n, q in REGISTRY.items() if q.sql} <= set(entry.oracle_sql())
    assert rows(spark.range(1)) == [(0,)]
