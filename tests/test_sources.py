"""Round trips of readers and writers."""

import os

import pytest
from pyspark.sql import functions as F

from hearthstat.operators.scale import literal_table
from hearthstat.plans import tracts
from hearthstat.sources import io, raw, versions

LINES = ['GEO_ID,NAME,B19013_001E,B19013_001M,', 'Geography,Geographic Area Name,Estimate,Margin,',
         '0100000US,United States,60000,100,',
         '1400000US17019000200,"Census Tract 2, Some County, Illinois",21385,3000,',
         '1400000US17019005301,"Census Tract 53.01; Some County; Illinois","250,000+",**,',
         '1400000US17031000100,"Census Tract 1, Other County, Illinois",5,1,']


@pytest.fixture()
def raw_folder(tmp_path):
    folder = tmp_path / "Income(B19013)_2023_2019"
    folder.mkdir()
    for year in (2019, 2021):
        (folder / f"ACSDT5Y{year}.B19013-Data.csv").write_text("﻿" + "\n".join(LINES) + "\n", encoding="utf-8")
    (folder / "ACSDT5Y2019.B19013-Column-Metadata.csv").write_text("a\n")
    (folder / "ACSDT5Y2019.B19013-Table-Notes.txt").write_text("a\n")
    (folder / "readme.txt").write_text("no table\n")
    return str(tmp_path)


def test_inventory_and_completeness(spark, raw_folder):
    inventory = io.file_inventory(spark, raw_folder)
    rows = {(r.year, r.table_code, r.source_type, r.file_kind, r.table_family) for r in inventory.collect()}
    assert (2019, "B19013", "DT", "Table-Notes", "Detailed Table") in rows and len(rows) == 4
    reports = tracts.file_reports(inventory, [2019, 2021, 2022])
    assert {(r.year, r.status, r.missing_components) for r in reports["missing"].collect()} == {
        (2021, "year_present_but_missing_components", "Column-Metadata,Table-Notes"),
        (2022, "missing_year_entirely", "Column-Metadata,Data,Table-Notes")}
    assert {(r.year, r.has_data, r.has_table_notes) for r in reports["summary"].collect()} == {(2019, 1, 1), (2021, 1, 0)}


def test_text_scan_keeps_everything(spark, raw_folder):
    inventory = io.file_inventory(spark, raw_folder)
    df = raw.read_inventory_table(spark, inventory, "b19013")
    assert df.where(f"{raw.MALFORMED} is not null").count() == 0
    assert {t for _, t in df.drop("year").dtypes} == {"string"} and df.count() == 10
    assert df.columns[:5] == ["geo_id", "name", "b19013_001e", "b19013_001m", "unnamed_4"]
    with pytest.raises(FileNotFoundError):
        raw.read_inventory_table(spark, inventory, "b99999")


def test_files_of_different_headers_are_one_scan(spark, tmp_path):
    folder = tmp_path / "a table" / "ACSST5Y2021.S1901-Data.csv"
    folder.mkdir(parents=True)
    (tmp_path / "ACSST5Y2019.S1901-Data.csv").write_text('GEO_ID,NAME,A,B\n1,"x, ""y""",5,6\n2,plain,7\n\n3,"open,8,9\nGEO_ID,NAME,A,B\n4,z,1,2,3\n')
    (folder / "part-1.csv").write_text("B,GEO_ID,C,NAME\r\nb1,5,c1,n5\r\nb2,6,c2,n6\r\n")
    (folder / "part-2.csv").write_text("B,GEO_ID,C,NAME\nb3,7,c3,n7\n")
    (tmp_path / "ACSST5Y2022.S1901-Data.csv").write_text("")
    files = raw.data_files(io.file_inventory(spark, str(tmp_path)), "s1901")
    assert files.count() == 3  # an empty file is no table
    df = raw.read_aligned(spark, files.where("year < 2022"))
    assert df.columns == ["geo_id", "name", "a", "b", "c", "year", "table_code", raw.MALFORMED]
    got = {r.geo_id: tuple(r)[1:6] for r in df.collect()}
    assert got["1"] == ("x, \"y\"", "5", "6", None, 2019) and got["5"] == ("n5", None, "b1", "c1", 2021) and got["7"] == ("n7", None, "b3", "c3", 2021)
    bad = {r.geo_id: r[raw.MALFORMED] for r in df.where(f"{raw.MALFORMED} is not null").collect()}
    assert bad == {"2": "2,plain,7", "3": '3,"open,8,9', "4": "4,z,1,2,3"}
    assert raw.shared_columns(spark, files.where("year < 2022")) == ["geo_id", "name", "b"]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("text\n") == 1
    assert {tuple(r) for r in raw.line_report(df).collect()} == {(2019, "S1901", 4, 3), (2021, "S1901", 3, 0)}
    with pytest.raises(ValueError, match="\\['b'\\]"):
        raw.read_aligned(spark, files.where("year < 2022").withColumn("a", F.lit(1)).withColumnRenamed("a", "b").withColumn("year", F.lit(1)))


def test_versions_of_a_table(spark, tmp_path):
    root = f"{tmp_path}/table"
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root)
    one = literal_table(spark, [(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    assert versions.replace(one, root, "first") == 1
    old = versions.read(spark, root)
    two = old.where("id <> 1").withColumn("v", F.when(F.col("id") == 2, "B").otherwise(F.col("v"))).unionByName(literal_table(spark, [(9, "z")], "id int, v string"))
    assert versions.replace(two, root, expect=1) == 2  # made from the table itself
    assert {tuple(r) for r in versions.read(spark, root).collect()} == {(2, "B"), (3, "c"), (9, "z")}
    assert {tuple(r) for r in versions.read(spark, root, 1).collect()} == {tuple(r) for r in old.collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in versions.changes(spark, root, 1, 2, ["id"]).collect()} == {(1, "removed"), (2, "changed"), (9, "added")}
    with pytest.raises(versions.VersionConflict):
        versions.replace(one, root, expect=1)
    with pytest.raises(versions.VersionConflict):
        versions._publish(spark, root, {"version": 2})
    broken = one.withColumn("v", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        versions.replace(broken, root)
    assert [(r.version, r.row_count, r.parent, r.note) for r in versions.history(spark, root).orderBy("version").collect()] == [(1, 3, 0, "first"), (2, 3, 1, "")]
    assert versions.restore(spark, root, 1) == 3
    assert versions.read(spark, root).count() == 3 and versions.read(spark, root).where("v = 'b'").count() == 1
    assert versions.forget(spark, root, 1) == [1, 2]
    assert {tuple(r) for r in versions.read(spark, root).collect()} == {(1, "a"), (2, "b"), (3, "c")}  # its files are version 1's
    with pytest.raises(FileNotFoundError):
        versions.read(spark, root, 2)
    empty = one.where("false")
    assert versions.replace(empty, root) == 4 and versions.read(spark, root).schema == one.schema and versions.read(spark, root).count() == 0


def test_staging_and_typing(spark, raw_folder):
    path = io.file_inventory(spark, raw_folder).where("file_kind = 'Data' and year = 2019").first().path
    table = io.read_text_table(spark, path)
    staged = tracts.stage_table(table, "b19013", 2019, "Detailed Table", "DT", "17", "019")
    assert {"geo_id_2", "name_2", "unnamed_4"} <= set(staged.columns)
    typed = {r.tract_geoid: r for r in tracts.typed_table([staged], "b19013").collect()}
    assert set(typed) == {"17019000200", "17019005301"}
    assert typed["17019000200"].median_household_income == 21385.0
    assert typed["17019005301"].median_household_income is None and typed["17019005301"].has_income_metric == 0


def test_names():
    assert io.unique_names(["GEO_ID", "geo id", "2019%", "", "__a--b__", "_c7"]) == [
        "geo_id", "geo_id_2", "col_2019", "col", "a_b", "unnamed_7"]
    assert [io.microdata_name(n) for n in ("ST", "TYPE", "YBL", "ACCESS", "WGTP")] == [
        "state", "typehugq", "yrblt", "accessinet", "wgtp"]
    assert io.measure_columns(["b1_002e", "b1_001e", "b1_001m", "b1_name", "x_001e"], "b1") == [
        "b1_001e", "b1_001m", "b1_002e", "b1_name"]
    columns = ["Poverty_Rate_long", "POVERTY_RATE", "pct_senior", "pct_65_plus_x", "x"]
    assert io.matching_metrics(columns) == {"poverty_rate": "POVERTY_RATE", "population_65_plus_share": "pct_65_plus_x"}
    assert io.matching_metrics(columns, {"a": ["none", "x$"], "b": ["none"]}) == {"a": "x"}
    assert io.resolve_column(["Year", "B"], ["year"]) == "Year" and io.resolve_column(["a"], ["b"]) is None
    with pytest.raises(KeyError):
        io.resolve_column(["a"], ["b"], required=True)


def test_partitioned_write_keeps_keys(spark, tmp_path):
    df = literal_table(spark, [(2019, "007", 1.5), (2021, "010", None)], "year int, k string, v double")
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        io.write_dataset(df, path, ["year"], fmt, ["k"])
        assert sorted(d for d in os.listdir(path) if d.startswith("year=")) == ["year=2019", "year=2021"]
        reader = spark.read.schema(df.schema)
        back = reader.csv(path, header=True) if fmt == "csv" else reader.parquet(path)
        assert sorted(map(tuple, back.select("year", "k", "v").collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_report_is_ordered(spark, tmp_path):
    df = spark.range(20).select((F.lit(100) - F.col("id")).alias("v"))
    io.write_report(df, str(tmp_path / "r"), ["v"])
    lines = [line for f in sorted((tmp_path / "r").glob("part-*")) for line in f.read_text().split() if line != "v"]
    assert list(map(int, lines)) == sorted(100 - i for i in range(20))


def test_snapshot_is_not_overwritten(spark, tmp_path):
    df = spark.range(3)
    path = io.write_snapshot(df, str(tmp_path / "t"), "before_fix")
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception):
        io.write_snapshot(df, str(tmp_path / "t"), "before_fix")


def test_fallback_chain_and_views(spark):
    df = literal_table(spark, [(2019, "a", 1), (2023, "a", 1), (2023, "b", 0)], "year int, t string, is_stable_all_4_years int")
    views = io.named_views(df, "vw_profile")
    assert {n: spark.table(n).count() for n in views} == {
        "vw_profile_all_years": 3, "vw_profile_2023": 2, "vw_profile_stable_4yr": 2}

    def missing():
        return spark.read.parquet("/nowhere/at/all")

    assert io.first_available(spark, [missing, "no_such_table", "vw_profile_2023"]).count() == 2
    with pytest.raises(FileNotFoundError, match="no_such_table"):
        io.first_available(spark, ["no_such_table", missing])

    def broken():
        raise ValueError("unreadable")

    with pytest.raises(ValueError, match="unreadable"):
        io.first_available(spark, [broken, "vw_profile_2023"])
    assert "vw_profile_2023" in io.discover_tables(spark, "^vw_profile_")


def test_typed_reader_and_dictionary(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2.5\n")
    df = io.read_typed_table(spark, str(tmp_path / "x.csv"), "a int, b double")
    assert df.first() == (1, 2.5) and io.header_of(spark, str(tmp_path / "x.csv")) == ["a", "b"]
    assert [tuple(r) for r in io.column_dictionary(df).collect()] == [(1, "a", "int"), (2, "b", "double")]
    assert io.numeric_columns(df, ["a"]) == ["b"] and io.text_columns(df) == []
    assert io.preview(spark.range(9), 2, ["id"]).count() == 2
    with pytest.raises(ValueError, match="zz"):
        io.require_columns(df, ["a", "zz"])


def test_catalog_table_is_replaced(spark):
    try:
        io.write_table(spark.range(3), "t_replace")
        io.write_table(spark.range(2), "t_replace")
        assert spark.table("t_replace").count() == 2
    finally:
        spark.sql("DROP TABLE IF EXISTS t_replace")
