import pytest
from pyspark.sql import functions as F

import registry
from lakeclerk import Catalog
from lakeclerk.operators import column_profile, column_sketches, merged_statistics
from lakeclerk.sinks import overwrite


def test_profile(spark):
    df = spark.createDataFrame(
        [(1, "b", None), (None, "a", [1.0]), (3, None, [2.0])], "n int, s string, a array<float>"
    )
    rows = [tuple(row) for row in column_profile(df).orderBy("ordinal").collect()]
    assert rows == [
        (1, "n", 3, 1, "1", "3"),
        (2, "s", 3, 1, None, None),
        (3, "a", 3, 1, None, None),
    ]
    named = {row.column_name: row.least for row in column_profile(df, ranges=["s"]).collect()}
    assert named == {"n": None, "s": "a", "a": None}
    with pytest.raises(ValueError):
        column_profile(df, ranges=["x"])


def test_ranges_keep_every_digit(spark):
    df = spark.sql("SELECT 9007199254740993 AS b, 1234567890123456789.01BD AS d")
    rows = {row.column_name: row.greatest for row in column_profile(df).collect()}
    assert rows == {"b": "9007199254740993", "d": "1234567890123456789.01"}


def test_counts_alone_read_no_ranges(spark):
    df = spark.createDataFrame([("x", 1)], "t string, i int")
    plan = column_profile(df, ranges=False)._jdf.queryExecution().executedPlan().toString()
    assert "min(" not in plan and "max(" not in plan


def test_profile_of_an_empty_table(spark):
    df = spark.createDataFrame([], "`x.y` int")
    assert [tuple(row) for row in column_profile(df).collect()] == [(1, "x.y", 0, 0, None, None)]


def test_distinct_estimate_is_close(spark):
    df = spark.range(50_000).select(F.col("id"), (F.col("id") % 100).alias("m"))
    rows = {row.column_name: row.n_distinct for row in column_profile(df, 0.01).collect()}
    assert rows["id"] == pytest.approx(50_000, rel=0.05)
    assert rows["m"] == pytest.approx(100, rel=0.05)


def test_profile_of_awkward_names(spark):
    df = spark.createDataFrame([(1, 2)], ["it's a.b\\", "c`d"])
    names = [row.column_name for row in column_profile(df, 0.05).orderBy("ordinal").collect()]
    assert names == df.columns


def test_merged_sketches_equal_those_of_the_whole(spark):
    df = spark.range(4_000).select(
        (F.col("id") % 5).alias("k"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 700).alias("n"),
        (F.col("id") / 4).alias("d"),
        F.concat(F.lit("t"), F.col("id") % 50).alias("s"),
        (F.lit(9007199254740993) + F.col("id")).alias("b"),
        F.timestamp_seconds("id").cast("timestamp_ntz").alias("t"),
        F.lit(None).cast("int").alias("none"),
    )
    parts = column_sketches(df, ["k"])
    assert parts.count() == 5 * 7
    rows = {r.column_name: r for r in merged_statistics(parts, ["column_name"]).collect()}
    exact = {r.column_name: r for r in column_profile(df).collect()}
    for name, row in rows.items():
        assert (row.n_rows, row.n_nulls, row.least, row.greatest) == exact[name][2:6]
        distinct = df.agg(F.count_distinct(name)).first()[0]
        assert abs(row.n_distinct - distinct) <= 5 * 0.01625 * distinct + 1
    assert rows["d"].quantiles == pytest.approx([250, 500, 750], abs=1000 * 0.0165)
    assert rows["none"].quantiles is None and rows["s"].quantiles is None
    one = {r.column_name: r for r in merged_statistics(column_sketches(df), ["column_name"]).collect()}
    assert one["s"].n_distinct == rows["s"].n_distinct


def test_sketches_of_an_empty_table(spark):
    df = spark.createDataFrame([], "`x.y` int, p string")
    assert column_sketches(df, ["p"]).collect() == []


def test_a_rerun_reads_its_partition_only(spark, folder):
    rows = [("a", 1, None), ("a", 2, "x"), ("b", 30, "y"), ("c/%=d", -4, "z"), (None, 7, "z")]
    df = spark.createDataFrame(rows, "k string, n int, s string")
    overwrite(df, f"{folder}/t", partition_by=["k"])
    catalog = Catalog(spark, f"{folder}/catalog")

    def statistics(partitions=None):
        stored = spark.read.parquet(f"{folder}/t").select("n", "s", "k")
        found = catalog.update_statistics("t", stored, ["k"], partitions).collect()
        return {r.column_name: (r.n_rows, r.n_nulls, r.least, r.greatest, r.n_distinct) for r in found}

    assert statistics() == {
        "n": (5, 0, "-4", "30", 5), "s": (5, 1, None, None, 3), "k": (5, 1, None, None, 3),
    }
    # The files of the others are gone: they are not read.
    new = spark.createDataFrame([("a", 100, "w")], df.schema)
    overwrite(new, f"{folder}/t", partition_by=["k"])
    assert statistics(["k=a"])["n"] == (4, 0, "-4", "100", 4)
    # A partition without rows leaves; a null and an awkward value are names too.
    assert statistics(["k=b", "k=c%2F%25%3Dd"])["n"] == (2, 0, "7", "100", 2)
    assert statistics(["k=__HIVE_DEFAULT_PARTITION__"])["s"] == (1, 0, None, None, 1)
    entity = catalog.read("entities").filter("name = 'n'").first()
    assert (entity.attributes["n_rows"], entity.attributes["type"]) == ("1", "int")
    assert entity.attributes["quantiles"] == "[100.0, 100.0, 100.0]"


def test_exact_figures_count_each_column_alone(spark):
    df = spark.range(300).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 70).alias("n"),
        (F.col("id") % 7).cast("decimal(18,2)").alias("d"),
        F.lit(None).cast("int").alias("none"),
        F.concat(F.lit("t"), F.col("id") % 5).alias("s"),
    )
    found = registry.exact_figures(df, {"n": 34.0, "d": 3.0, "none": None, "s": None})
    exact = df.agg(
        F.count_distinct("n"), F.avg((F.col("n") < 34).cast("int")), F.avg((F.col("n") <= 34).cast("int")),
        F.count_distinct("d"), F.avg((F.col("d") < 3).cast("int")), F.avg((F.col("d") <= 3).cast("int")),
    ).first()
    rows = {row.column_name: tuple(row)[1:] for row in found.collect()}
    assert rows == {"n": exact[:3], "d": exact[3:], "none": (0, None, None), "s": (5, None, None)}
    # Distinct counts side by side would repeat every row for each of the columns.
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
