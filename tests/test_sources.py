from __future__ import annotations

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakemart import sources
from lakemart.session import scratch_path

from helpers import row_set


@pytest.fixture
def folder(spark, tmp_path):
    """A flat folder with two Parquet files, a nested one, a partition-like one and a stray file."""
    spark.range(2).coalesce(1).write.parquet(str(tmp_path / "staging0"))
    files = sorted((tmp_path / "staging0").glob("*.parquet"))
    root = tmp_path / "data"
    for target in ("a.parquet", "b.parquet", "c.data", "nested/d.parquet", "k=1/e.parquet"):
        path = root / target
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(files[0].read_bytes())
    return str(root)


def fresh(label):
    return f"{label}_{uuid.uuid4().hex}"


def test_scan_reads_matching_files_of_one_folder(spark, folder):
    found = sources.scan(spark, folder)
    assert found.columns == ["id"]
    assert found.count() == 4


def test_scan_pattern(spark, folder):
    assert sources.scan(spark, folder, "a*.parquet").count() == 2
    assert sources.scan(spark, folder, "*.data").count() == 2


def test_scan_recursive(spark, folder):
    assert sources.scan(spark, folder, recursive=True).count() == 8


def test_scan_reads_dataset_folders(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "t.parquet"))
    assert sources.scan(spark, str(tmp_path), "t*.parquet").count() == 10


def test_scan_without_match_fails(spark, folder):
    with pytest.raises(PySparkException):
        sources.scan(spark, folder, "nothing*").count()


def test_register_source_joins_location_and_subpath(spark, folder):
    sources.register_source(spark, "sampledata", folder + "/", "/nested/")
    assert spark.table("sampledata").count() == 2


def test_external_table_stays_in_place(spark, folder):
    name = fresh("ext")
    sources.create_external_table(spark, name, folder, "nested")
    assert sources.entity(spark, name).count() == 2
    assert sources.entity(spark, name, "default").count() == 2
    spark.sql(f"DROP TABLE {name}")
    assert sources.scan(spark, folder + "/nested").count() == 2


def test_append_creates_then_adds(spark):
    name, path = fresh("t"), scratch_path(spark, "append")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id bigint, name string")
    sources.append(df, name, path=path)
    assert spark.table(name).count() == 2
    sources.append(df, name, path=path)
    assert row_set(spark.table(name)) == [(1, "a"), (1, "a"), (2, "b"), (2, "b")]


def test_append_is_unpartitioned_snappy(spark, tmp_path):
    name, path = fresh("t"), str(tmp_path / "t")
    sources.append(spark.range(3), name, path=path)
    files = [p.name for p in (tmp_path / "t").iterdir() if p.name.endswith(".parquet")]
    assert files and all(".snappy." in f for f in files)
    assert spark.catalog.listColumns(name)[0].isPartition is False


def test_append_matches_by_name_and_converts(spark):
    name, path = fresh("t"), scratch_path(spark, "append")
    sources.append(spark.createDataFrame([(1, "a")], "id bigint, name string"), name, path=path)
    sources.append(spark.createDataFrame([("b", "7")], "name string, id string"), name, path=path)
    assert row_set(spark.table(name)) == [(1, "a"), (7, "b")]


def test_append_refuses_text_that_is_no_number(spark):
    name, path = fresh("t"), scratch_path(spark, "append")
    sources.append(spark.createDataFrame([(1,)], "id bigint"), name, path=path)
    with pytest.raises(PySparkException):
        sources.append(spark.createDataFrame([("x",)], "id string"), name, path=path)
    assert row_set(spark.table(name)) == [(1,)]


def test_append_to_warehouse_table(spark):
    name = fresh("managed")
    sources.append(spark.range(2), name)
    assert spark.table(name).count() == 2
    spark.sql(f"DROP TABLE {name}")


def schema(**columns):
    return T.StructType([T.StructField(n, t) for n, t in columns.items()])


def test_convert_truncates(spark):
    df = spark.createDataFrame([(2.9,), (-2.9,), (None,)], "x double")
    assert row_set(sources.convert(df, schema(x=T.LongType()))) == [(-2,), (2,), (None,)]
    decimals = df.select(F.col("x").cast("decimal(5,1)").alias("x"))
    assert row_set(sources.convert(decimals, schema(x=T.LongType()))) == [(-2,), (2,), (None,)]


def test_convert_overflow_raises(spark):
    df = spark.createDataFrame([(1e30,)], "x double")
    with pytest.raises(PySparkException):
        sources.convert(df, schema(x=T.LongType())).collect()


def test_convert_refuses_boolean_as_number_while_planning(spark):
    df = spark.createDataFrame([(True,)], "x boolean")
    for number in (T.LongType(), T.IntegerType(), T.DoubleType(), T.DecimalType(5, 1)):
        with pytest.raises(TypeError):
            sources.convert(df, schema(x=number))
    assert row_set(sources.convert(df, schema(x=T.StringType()))) == [("true",)]
    assert row_set(sources.convert(df, schema(x=T.BooleanType()))) == [(True,)]


def test_convert_selects_sink_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert sources.convert(df, schema(c=T.LongType(), a=T.LongType())).columns == ["c", "a"]
    with pytest.raises(ValueError, match="missing"):
        sources.convert(df, schema(z=T.LongType()))


def test_scratch_path_uses_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(shared)
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


@pytest.mark.parametrize("kind", ["array<{}>", "map<string,{}>", "struct<a:string,b:array<{}>>"])
def test_nested_booleans_do_not_become_numbers(spark, kind):
    df = spark.createDataFrame([], "v " + kind.format("boolean"))
    want = spark.createDataFrame([], "v " + kind.format("int")).schema
    with pytest.raises(TypeError, match="boolean"):
        sources.convert(df, want)
    assert sources.convert(df, df.schema).schema == df.schema
