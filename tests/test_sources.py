import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larderline.operators.projection import cast_numbers, drop_matching
from larderline.plans.diary import ingest
from larderline.session import scratch_path, shared_dir, staged
from larderline.sources import (
    files_named,
    number_lines,
    read_aligned,
    read_csv,
    read_delimited,
    read_named,
    read_table,
    write_csv,
    write_table,
)


@pytest.fixture
def waves(tmp_path):
    (tmp_path / "yr9_foodlevel.tab").write_bytes(
        "id\tfood\tgrams\n1\tCrème brûlée\t10\n2\tNA\t\n".encode("latin-1")
    )
    (tmp_path / "yr10_foodlevel.tab").write_bytes(
        "id\tgrams\n3\tx\n4\t7.5\n".encode("latin-1")
    )
    (tmp_path / "yr1_foodlevel_20210910.tab").write_text("id\tgrams\n9\t1\n")
    (tmp_path / "indiv.tab").write_text("id\tage\n1\t30\n2\tNA\n")
    return tmp_path


def test_anchored_pattern_finds_waves_only(spark, waves):
    found = files_named(spark, str(waves), "*foodlevel*", r"yr(9|10|11)(?!\d)")
    assert [p.rsplit("/", 1)[1] for p in found] == ["yr10_foodlevel.tab", "yr9_foodlevel.tab"]
    loose = files_named(spark, str(waves), "*foodlevel*", "9|10|11")
    assert len(loose) == 3  # digits of the date match as well


def test_latin1_text_and_both_kinds_of_missing(spark, waves):
    df = read_delimited(spark, str(waves / "yr9_foodlevel.tab"))
    assert {f.dataType for f in df.schema.fields} == {T.StringType()}
    assert rows(df) == [("1", "Crème brûlée", "10"), ("2", None, None)]


def test_waves_with_other_headers_align_by_name(spark, waves):
    files = [str(waves / f) for f in ("yr9_foodlevel.tab", "yr10_foodlevel.tab")]
    both = cast_numbers(read_aligned(spark, files), ["grams"])
    assert rows(both, "id") == [
        ("1", "Crème brûlée", 10.0),
        ("2", None, None),
        ("3", None, None),
        ("4", None, 7.5),
    ]


def test_a_file_laid_out_otherwise_is_refused(spark, tmp_path):
    (tmp_path / "a.tab").write_text("id\tgrams\n1\t2\n")
    (tmp_path / "b.tab").write_text("grams\tid\n2\t1\n")
    mixed = read_delimited(spark, [str(tmp_path / "a.tab"), str(tmp_path / "b.tab")])
    with pytest.raises(Exception, match="(?i)header"):
        mixed.collect()


def test_inferred_types(spark, waves):
    df = read_delimited(spark, str(waves / "indiv.tab"), infer=True)
    assert dict(df.dtypes) == {"id": "int", "age": "int"}
    assert rows(df) == [(1, 30), (2, None)]


def test_blank_headers_are_dropped(spark, tmp_path):
    (tmp_path / "d.csv").write_text('code, coef,,\n"A ""x"", y",0.5,,\nB,,,\n')
    df = drop_matching(read_csv(spark, str(tmp_path / "d.csv")))
    assert df.columns == ["code", "coef"]
    assert rows(df) == [('A "x", y', 0.5), ("B", None)]


def test_csv_round_trip(spark):
    df = spark.createDataFrame(
        [(1, 'say "hi", you', 1.5), (2, None, None), (3, "ünï", -1.0)], "i int, t string, x double"
    )
    path = scratch_path(spark, "test")
    write_csv(df, path)
    assert rows(read_csv(spark, path, df.schema)) == rows(df)


def test_numbered_csv(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", 1.0)], "k string, x double")
    path = scratch_path(spark, "test")
    write_csv(df, path, number_by=["x", "k"])
    assert rows(read_csv(spark, path), "row") == [(1, "c", 1.0), (2, "a", 2.0), (3, "b", 2.0)]


def test_lines_keep_file_order(spark, tmp_path):
    (tmp_path / "l.csv").write_text("k\n" + "\n".join(f"r{i}" for i in range(50)) + "\n")
    numbered = number_lines(read_delimited(spark, str(tmp_path / "l.csv"), ","))
    got = [r.k for r in numbered.orderBy("_file", "_block", "_line").collect()]
    assert got == [f"r{i}" for i in range(50)]


def test_tables_by_partition(spark):
    df = spark.createDataFrame([("9", 1), ("10", 2)], "SurveyYear string, i int")
    path = scratch_path(spark, "test")
    write_table(df, path, ["SurveyYear"])
    only = read_table(spark, path).where(F.col("SurveyYear") == "9")
    assert [r.i for r in only.collect()] == [1]


def test_staged_table_is_the_same_table(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, t string")
    again = staged(df.where("i > 0"))
    assert rows(again) == rows(df) and again.schema == df.schema
    assert staged(df.where("i > 5")).count() == 0
    assert shared_dir(spark)


def test_diary_files_to_deduplicated_rows(spark, tmp_path):
    keys = ["seriali", "SurveyYear", "DayNo", "AgeR", "Sex", "Country", "FoodName", "FoodNumber"]
    keys += ["SubFoodGroupCode", "SubFoodGroupDesc", "MainFoodGroupCode", "MainFoodGroupDesc"]
    base = "p1\t9\t1\t3\t2\tE\tÉclair\t77\t50E\tsub\t50\tmain"
    lines = ["\t".join([*keys, "TotalGrams", "Proteing", "Energykcal"])]
    lines += [f"{base}\t100\t4\t{e}" for e in ("50", "bad", "NA")]
    lines += [f"{base}\t200\t8\t150".replace("Éclair", "Tea")]
    (tmp_path / "yr9.tab").write_bytes(("\n".join(lines) + "\n").encode("latin-1"))
    path = str(tmp_path / "yr9.tab")
    got = ingest(spark, [path], positions=(14, 15)).orderBy("FoodName")
    assert [(r.FoodName, r.AgeR, r.TotalGrams, r.Proteing, r.Energykcal) for r in got.collect()] == [
        ("Tea", 3, 200.0, 8.0, 150.0),
        ("Éclair", 3, 100.0, 4.0, 50.0),
    ]
    summed = ingest(spark, [path], how="sum", positions=(14, 15)).orderBy("FoodName")
    assert [(r.Proteing, r.Energykcal) for r in summed.collect()] == [(8.0, 150.0), (12.0, 50.0)]


def test_line_breaks_survive_with_defaults(spark):
    df = spark.createDataFrame([(1, 'two\nlines, "quoted"'), (2, "one")], "i int, t string")
    path = scratch_path(spark, "breaks")
    write_csv(df, path)
    assert rows(read_csv(spark, path)) == rows(df)


def test_rows_of_another_width_are_reported(spark, tmp_path):
    file = tmp_path / "odd.csv"
    file.write_text("a,b\n1,2\n1,2,EXTRA\n3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_csv(spark, str(file)).collect()
    kept = read_csv(spark, str(file), malformed="report")
    assert kept.where("_malformed is null").select("a", "b").collect() == [(1, 2)]
    bad = kept.where("_malformed is not null").select("a", "_malformed")
    assert rows(bad) == [(1, "1,2,EXTRA"), (3, "3")]


def test_named_files_are_read_by_one_scan(spark, tmp_path):
    for name, i in (("yr9_food", 1), ("yr10_food", 2), ("yr2_food_20101109", 3)):
        (tmp_path / f"{name}.tab").write_text(f"id\tgrams\n{i}\t5\n")
    found = read_named(spark, str(tmp_path), r"yr(9|10|11)(?!\d)", glob="*food*")
    assert rows(found) == [("1", "5"), ("2", "5")]


def test_compressed_files_read_back_alike(spark, tmp_path):
    df = spark.range(2000).selectExpr("cast(id % 7 as string) as a", "concat('café ', id % 3) as b")
    for kind in ("none", "gzip"):
        write_csv(df, f"{tmp_path}/{kind}", sep="\t", encoding="ISO-8859-1", compression=kind)
        assert rows(read_delimited(spark, f"{tmp_path}/{kind}")) == rows(df)
    size = {k: sum(f.stat().st_size for f in (tmp_path / k).glob("*.csv*")) for k in ("none", "gzip")}
    assert size["gzip"] < size["none"] / 3
