import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeclerk.functions.sizing import shared_folder
from lakeclerk.operators import file_inventory
from lakeclerk.plans import copy_table
from lakeclerk.sinks import merge_files, overwrite, overwrite_partitions, write_csv
from lakeclerk.sources import check_schema, read_csv, read_parquet, text_schema

AWKWARD = [
    (1, None, None),
    (2, "", 1.5),
    (3, ' pad "q" \\ b,c\nx', 2.0),
    (4, "ends in backslash\\", 0.1),
    (5, 'ends in quote"', -1.0),
    (6, '\\"', 1e300),
    (7, "\\\\", 3.0),
    (8, "tab\tand\r\nreturn", 4.0),
    (9, ",", 5.0),
    (10, "#not a comment", 6.0),
    (11, "é中🙂", 7.0),
]
AWKWARD_DDL = "i int, s string, v double"


def same(left, right):
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def files_of(spark, path, glob="*.parquet"):
    return file_inventory(spark, path, glob).count()


def test_quoted_text_round_trip(spark, folder):
    df = spark.createDataFrame(AWKWARD, AWKWARD_DDL)
    write_csv(df, f"{folder}/t", null_value="\\N")
    back = read_csv(spark, f"{folder}/t", schema=df.schema, null_value="\\N", multi_line=True)
    assert same(df, back)


def test_every_field_is_quoted(spark, folder):
    write_csv(spark.createDataFrame([(1, "a")], "x int, y string").coalesce(1), f"{folder}/t")
    lines = [row.value for row in spark.read.text(f"{folder}/t").collect()]
    assert sorted(lines) == ['"1","a"', '"x","y"']


def test_header_names_awkward_columns(spark, folder):
    df = spark.createDataFrame([("a", 1)], ["Sex ratio (m per 100 f, 2017)", "% of x.y: z"])
    write_csv(df, f"{folder}/t")
    assert read_csv(spark, f"{folder}/t").columns == df.columns


def test_all_columns_are_strings_by_default(spark, folder):
    write_csv(spark.createDataFrame([(1, 2.5)], "a int, b double"), f"{folder}/t")
    back = read_csv(spark, f"{folder}/t")
    assert back.dtypes == [("a", "string"), ("b", "string")]
    assert back.collect() == [("1", "2.5")]
    assert text_schema(["a", "b"]) == back.schema


def test_inference_widens_with_the_data(spark, folder):
    rows = [(1, 2254252000), (2, 5)]
    write_csv(spark.createDataFrame(rows, "a bigint, b bigint"), f"{folder}/t")
    back = read_csv(spark, f"{folder}/t", infer=True)
    assert back.dtypes == [("a", "int"), ("b", "bigint")]


def test_schema_and_inference_exclude_each_other(spark, folder):
    with pytest.raises(ValueError):
        read_csv(spark, folder, schema="a int", infer=True)


def test_schema_must_fit_the_header(spark, folder):
    write_csv(spark.createDataFrame([(1, 2)], "a int, b int"), f"{folder}/t")
    with pytest.raises(Exception, match="header"):
        read_csv(spark, f"{folder}/t", schema="b int, a int").collect()


def test_declared_columns_can_be_pruned(spark, folder):
    write_csv(spark.createDataFrame([(1, 2, "x")], "a int, b int, c string"), f"{folder}/t")
    df = read_csv(spark, f"{folder}/t", schema="a int, b int, c string").select("c", "a")
    assert df.collect() == [("x", 1)]
    assert df.count() == 1


def test_null_token_is_off_unless_asked_for(spark, folder):
    write_csv(spark.createDataFrame([("-99",), ("5",)], "gdp string"), f"{folder}/t")
    plain = read_csv(spark, f"{folder}/t", schema="gdp int")
    token = read_csv(spark, f"{folder}/t", schema="gdp int", null_value="-99")
    assert {row.gdp for row in plain.collect()} == {-99, 5}
    assert {row.gdp for row in token.collect()} == {None, 5}


def test_partition_discovery_and_recursive_reading(spark, folder):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "a", "y")], "i int, k string, m string")
    overwrite(df, f"{folder}/t", partition_by=["k", "m"])
    assert same(read_parquet(spark, f"{folder}/t").select("i", "k", "m"), df)
    below = read_parquet(spark, f"{folder}/t/k=a", base_path=f"{folder}/t")
    assert sorted(row.i for row in below.filter("k = 'a'").collect()) == [1, 3]
    flat = read_parquet(spark, f"{folder}/t", recursive=True, glob="*.parquet")
    assert flat.columns == ["i"] and flat.count() == 3


def test_check_schema(spark):
    df = spark.createDataFrame([(1, "a")], "i int, s string")
    assert check_schema(df, df.schema) is df
    assert check_schema(df, T.StructType([])) is df
    for other in ("s string, i int", "i bigint, s string", "i int"):
        with pytest.raises(ValueError):
            check_schema(df, T.StructType.fromDDL(other))


def test_overwrite_replaces_rows_and_schema(spark, folder):
    overwrite(spark.range(5).toDF("a"), f"{folder}/t")
    overwrite(spark.createDataFrame([("x", 1.0)], "b string, c double"), f"{folder}/t")
    back = read_parquet(spark, f"{folder}/t")
    assert back.dtypes == [("b", "string"), ("c", "double")] and back.count() == 1


def test_overwrite_is_whole_even_in_dynamic_sessions(spark, folder, conf):
    conf("spark.sql.sources.partitionOverwriteMode", "dynamic")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "i int, k string")
    overwrite(rows, f"{folder}/t", partition_by=["k"])
    overwrite(rows.filter("k = 'a'"), f"{folder}/t", partition_by=["k"])
    assert read_parquet(spark, f"{folder}/t").count() == 1


def test_dynamic_overwrite_leaves_other_partitions(spark, folder):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "i int, k string")
    overwrite(rows, f"{folder}/t", partition_by=["k"])
    overwrite_partitions(rows.filter("i = 2").withColumn("i", F.lit(9)), f"{folder}/t", ["k"])
    back = {(row.i, row.k) for row in read_parquet(spark, f"{folder}/t").collect()}
    assert back == {(1, "a"), (9, "b")}
    with pytest.raises(ValueError):
        overwrite_partitions(rows, f"{folder}/t", [])


def test_partitioned_write_gathers_small_and_splits_hot_values(spark, folder, conf):
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 7))
    df = spark.range(0, 300_000, numPartitions=8).select("id", F.md5(F.col("id").cast("string")).alias("t"), hot.alias("k"))
    overwrite(df, f"{folder}/t", partition_by=["k"])
    n_files = {
        row.key: row.n
        for row in file_inventory(spark, f"{folder}/t", "*.parquet")
        .groupBy(F.regexp_extract("path", "k=([^/]+)/", 1).alias("key"))
        .agg(F.count("*").alias("n"))
        .collect()
    }
    assert n_files["hot"] >= 4
    assert same(read_parquet(spark, f"{folder}/t").select("id", "t", "k"), df)
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m")
    overwrite(df, f"{folder}/u", partition_by=["k"])
    assert files_of(spark, f"{folder}/u") == 8


@pytest.mark.parametrize("n_files", [1, 3])
def test_merge_writes_the_files_asked_for(spark, folder, n_files):
    source = overwrite(spark.range(0, 1000, numPartitions=8).toDF("i"), f"{folder}/t")
    assert files_of(spark, source) == 8
    path = merge_files(spark, source, f"{folder}/some", n_files=n_files)
    assert files_of(spark, path) == n_files
    assert same(read_parquet(spark, source), read_parquet(spark, path))


def test_merge_stays_parallel_by_default(spark, folder, conf):
    conf("spark.sql.files.openCostInBytes", "64m")
    source = overwrite(spark.range(0, 1000, numPartitions=8).toDF("i"), f"{folder}/t")
    path = merge_files(spark, source, f"{folder}/some")
    assert files_of(spark, path) > 1


def test_copy_converts_and_quotes(spark, folder):
    df = spark.createDataFrame(
        [(1.9, True, "a"), (-1.9, False, "b"), (None, None, "a")], "x double, f boolean, k string"
    )
    source = overwrite(df, f"{folder}/t", partition_by=["k"])
    copy_table(
        spark,
        source,
        f"{folder}/c",
        {"x": "bigint", "f": "string"},
        null_value="\\N",
        n_files=1,
        extension="txt",
    )
    assert files_of(spark, f"{folder}/c", "*.txt") == 1
    back = read_csv(spark, f"{folder}/c", null_value="\\N")
    assert {tuple(row) for row in back.collect()} == {
        ("1", "true", "a"),
        ("-1", "false", "b"),
        (None, None, "a"),
    }


def test_copy_of_nested_folders(spark, folder):
    for i, part in enumerate(("2024/01", "2024/02")):
        overwrite(spark.createDataFrame([(i,)], "i int"), f"{folder}/t/{part}")
    copy_table(spark, f"{folder}/t", f"{folder}/c", recursive=True, glob="*.parquet")
    assert sorted(row.i for row in read_csv(spark, f"{folder}/c").collect()) == ["0", "1"]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
