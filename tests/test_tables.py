import json
from concurrent.futures import ThreadPoolExecutor
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from fabtrace.operators import annotations, quality, workbook
from fabtrace.sources import annotations as records
from fabtrace.sources import commits, files
from fabtrace.sources.scratch import shared_folder
from fabtrace.sources.tables import query
from fabtrace.sources.workbook import catalogue, read_sheet, read_sheets, unreadable, write_sheet
from tests.helpers import rows_of

COLUMNS = records.ANNOTATION_COLUMNS


def notes(spark, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"`{c}` string" for c in COLUMNS))


def test_records_file(spark, tmp_path):
    path = tmp_path / "notes.json"
    path.write_text(json.dumps([{"LOT NUMBER": "L", "OPERATION": 12, "ISSUE": "nan", "DESCRIPTION": "a/b"}], indent=2))
    assert rows_of(records.read_records(spark, str(path))) == {("L", "12", "a/b", "", ""): 1}
    assert records.read_records(spark, str(tmp_path / "none.json")).count() == 0
    path.write_text("[{broken")
    assert records.read_records(spark, str(path)).count() == 0
    assert [r["record"] for r in records.record_errors(spark, str(path)).collect()] == ["[{broken"]


def test_saving_over_what_is_read(spark, tmp_path):
    path = str(tmp_path / "notes")
    assert records.read_saved(spark, path).count() == 0
    records.save(notes(spark, ("L", "1", "d", "", "")), path)
    more = annotations.append(records.read_saved(spark, path), notes(spark, ("M", "2", "e", "—", "—")))
    records.save(more, path)
    both = {("L", "1", "d", "", ""): 1, ("M", "2", "e", "", ""): 1}
    assert rows_of(records.read_saved(spark, path)) == both
    records.add(notes(spark, ("N", "3", "f", "", "")), path)
    assert rows_of(records.read_saved(spark, path)) == both | {("N", "3", "f", "", ""): 1}
    records.save(records.read_saved(spark, path).where("OPERATION = '0'"), path)
    assert records.read_saved(spark, path).count() == 0


def test_damaged_saved_records_are_an_error(spark, tmp_path):
    path = str(tmp_path / "notes")
    records.save(notes(spark, ("L", "1", "d", "", "")), path)
    version = next((tmp_path / "notes" / "data").iterdir())
    (version / "part-extra.json").write_text("{damaged\n")
    with pytest.raises(Exception, match="MALFORMED"):
        records.read_saved(spark, path).collect()


def test_append_then_delete(spark):
    old = notes(spark, ("L", "1", "a", "", ""), ("L", "1", "a", "", ""), ("L", "2", "b", "x", ""), (None, "1", "c", "", ""))
    keys = spark.createDataFrame([("L", "1"), ("N", "9")], "lot string, op string")
    added = annotations.append(old, notes(spark, ("N", "9", "n", "—", "r")))
    assert rows_of(annotations.lookup(added, keys)) == {("L", "1", "a", "", ""): 2, ("N", "9", "n", "", "r"): 1}
    left = annotations.delete(added, keys)
    assert rows_of(left) == {("L", "2", "b", "x", ""): 1, (None, "1", "c", "", ""): 1}


def test_categories(spark):
    df = notes(spark, ("L", "1", "a", "", ""), ("L", "2", "b", None, ""), ("L", "3", "c", "Batching", ""))
    assert [tuple(r) for r in annotations.categories(df).collect()] == [("Batching", 1), ("Uncategorized", 2)]
    assert rows_of(annotations.by_category(df), "CATEGORY", "RECORDS") == {("Batching", 1): 1, ("Uncategorized", 2): 2}
    assert annotations.of_category(df, "Uncategorized").count() == 2


def test_a_large_category_is_dealt_over_tasks(spark):
    ids = spark.range(4000)
    df = notes(spark).unionByName(
        ids.selectExpr("'L' AS `LOT NUMBER`", "'1' AS OPERATION", "string(id) AS DESCRIPTION", "if(id < 3900, '', 'x') AS ISSUE", "'' AS REMARKS")
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        own = annotations.with_size(df)
        parts = own.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert max(r["count"] for r in parts) < 1000 and sum(r["count"] for r in parts) == 4000
        assert rows_of(own, "CATEGORY", "RECORDS") == {("Uncategorized", 3900): 3900, ("x", 100): 100}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lot_lists(spark):
    df = spark.createDataFrame([(1, " VA1, ,VA2 ,"), (2, "")], "id int, lots string")
    assert rows_of(workbook.lots_from_text(df, "lots")) == {(1, "VA1"): 1, (1, "VA2"): 1}
    assert workbook.lots_from_text(df, "lots", keep_empty=True).count() == 5


def test_workbook(spark, tmp_path):
    root, name = str(tmp_path / "book"), "s" * 40
    write_sheet(spark.createDataFrame([(1, "x")], "k int, v string"), root, "VA1", name)
    write_sheet(spark.createDataFrame([("two", 3.5)], "k string, w double"), root, "VA2", name)
    write_sheet(spark.createDataFrame([(1, "x")], "k int, v string"), root, "VA2", "")
    (tmp_path / "book" / "of_lot=VA3").mkdir()
    (tmp_path / "book" / "of_lot=VA3" / "bad.json").write_text("{broken\n")
    back = read_sheets(spark, root)
    assert rows_of(back, "lot", "sheet", "k", "v", "w") == {
        ("VA1", name, "1", "x", None): 1,
        ("VA2", name, "two", None, "3.5"): 1,
        ("VA2", "Sheet1", "1", "x", None): 1,
    }
    assert [tuple(r) for r in unreadable(spark, root).collect()] == [("bad.json", "{broken")]


def test_a_sheet_has_the_columns_of_its_own_files(spark, tmp_path):
    root = str(tmp_path / "book")
    write_sheet(spark.createDataFrame([(1, None)], "`b.c` int, a string"), root, "VA1", "S")
    write_sheet(spark.createDataFrame([(1.5, "x", "y")], "z double, a string, `b.c` string"), root, "VA2", "S")
    write_sheet(spark.createDataFrame([], "only int"), root, "VA2", "T")
    sheet = read_sheet(spark, root, "S")
    assert sheet.columns == ["lot", "sheet", "b.c", "a", "z"]  # a column of nulls is still one
    assert rows_of(sheet) == {("VA1", "S", "1", None, None): 1, ("VA2", "S", "y", "x", "1.5"): 1}
    assert len({f.rsplit("/", 2)[1] for f in sheet.inputFiles()}) == 2
    assert read_sheet(spark, root, "T").columns == ["lot", "sheet", "only"]
    assert read_sheet(spark, root, "U").columns == ["lot", "sheet"]
    assert [tuple(r) for r in catalogue(spark, root).orderBy("sheet", "ordinal").collect()] == [
        ("S", 1, "b.c"), ("S", 2, "a"), ("S", 3, "z"), ("T", 1, "only"),
    ]
    assert read_sheets(spark, root).columns == ["lot", "sheet", "b.c", "a", "z", "only"]


# ---- versions --------------------------------------------------------------------------------


def test_two_writers(spark, tmp_path):
    path = str(tmp_path / "notes")
    records.save(notes(spark, ("L", "1", "old", "", "")), path)
    runs = []

    def change(saved):
        runs.append(saved.count())
        if len(runs) == 1:  # another writer is faster
            records.add(notes(spark, ("M", "2", "new", "", "")), path)
        return saved.withColumn("ISSUE", F.lit("seen"))

    records.update(spark, path, change)
    assert runs == [1, 2]
    assert rows_of(records.read_saved(spark, path)) == {("L", "1", "old", "seen", ""): 1, ("M", "2", "new", "seen", ""): 1}
    runs.clear()
    with pytest.raises(commits.Conflict):
        records.update(spark, path, change, tries=1)
    assert rows_of(records.read_saved(spark, path), "ISSUE") == {("seen",): 2, ("",): 1}


def test_many_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "notes")
    with ThreadPoolExecutor(6) as pool:
        list(pool.map(lambda i: records.add(notes(spark, ("L", str(i), "d", "", "")), path), range(18)))
    assert [e.version for e in commits.entries(spark, path)] == list(range(1, 19))
    assert rows_of(records.read_saved(spark, path), "OPERATION") == {(str(i),): 1 for i in range(18)}


def test_a_version_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "notes")
    records.save(notes(spark, ("L", "1", "d", "", "")), path)
    before = records.read_saved(spark, path)
    records._write_part(notes(spark, ("M", "2", "e", "", "")), path)  # a writer that never came to its entry
    assert rows_of(records.read_saved(spark, path)) == rows_of(before)
    records.save(notes(spark), path)
    assert rows_of(before) == {("L", "1", "d", "", ""): 1}  # a reader keeps the version it began with
    assert not commits.commit(spark, path, commits.Entry(2, "data/x"))
    assert not any(p.name.startswith(".") and not p.name.endswith(".crc") for p in (tmp_path / "notes" / "log").iterdir())


def test_a_book_of_unreadable_files(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{broken\n")
    with pytest.raises(ValueError):
        read_sheets(spark, str(tmp_path))
    assert unreadable(spark, str(tmp_path)).count() == 1


def test_profile(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "k int, `v.x` string")
    assert rows_of(quality.table_profile(df)) == {
        (1, "k", "int", 3, 0, "1", "2", 2): 1,
        (2, "v.x", "string", 3, 1, "a", "b", 2): 1,
    }
    assert rows_of(quality.columns_of(df)) == {(1, "k", "int"): 1, (2, "v.x", "string"): 1}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("t"))
    base = quality.table_fingerprint(df).first()
    assert quality.table_fingerprint(df.orderBy(F.rand(1))).first() == base
    assert quality.table_fingerprint(df.where("id != 5")).first() != base
    assert quality.table_fingerprint(df.withColumn("t", F.coalesce("t", F.lit("")))).first() != base
    assert quality.table_fingerprint(df.unionAll(df.limit(1)).unionAll(df.limit(1))).first() != base
    assert quality.table_fingerprint(df.where("id < 0")).first()["row_count"] == 0
    pairs = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("\x00", "x"), ("-", "x"), ("", "x")]
    texts = spark.createDataFrame(pairs, "a string, b string")
    assert texts.select(quality.row_fingerprint(texts)).distinct().count() == len(pairs)


def test_triage(spark):
    runs = [
        ("x IllegalOptionException ConfigurationAreaChecker", 0, True, "invalid option / blocked profile"),
        ("another process has locked a portion of the file", 1, False, "workspace locked"),
        ("EXCEPTION_ACCESS_VIOLATION", 0, True, "runtime crash"),
        ("DB Connection no longer available", 0, True, "database lost"),
        ("created an empty data table", 1, False, "no data for lot"),
        ("created an empty data table", 1, True, "failed"),
        ("", 0, False, "no output"),
        ("fine", 0, True, "ok"),
    ]
    df = spark.createDataFrame(runs, "log_text string, exit_code int, has_output boolean, expected string")
    got = df.select(quality.triage(F.col("log_text"), F.col("exit_code"), F.col("has_output")), "expected").collect()
    assert all(r[0] == r[1] for r in got)
    assert quality.triage_counts(df).count() == 8


def test_csv_and_json(spark, tmp_path):
    df = spark.createDataFrame([("a,\"b\"\nc", None, 1.5), ("", "x", None)], "s string, `t.u` string, d double")
    files.write_csv(df, str(tmp_path / "csv"))
    assert rows_of(files.read_csv(spark, str(tmp_path / "csv"), df.schema)) == rows_of(df.select("s", "`t.u`", "d"))
    files.write_json(df, str(tmp_path / "json"))
    assert rows_of(files.read_json(spark, str(tmp_path / "json"), df.schema)) == rows_of(df.select("s", "`t.u`", "d"))


def test_query_with_parameters(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert query(spark, "SELECT id FROM five WHERE id = :wanted", wanted=3).first()[0] == 3


def test_shared_folder_is_read_from_the_session():
    def session(master, **conf):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)),
            sparkContext=SimpleNamespace(master=master),
        )

    assert shared_folder(session("yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"
    with pytest.raises(ValueError):
        shared_folder(session("yarn"))
