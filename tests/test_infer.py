"""Inferred types against those Spark infers."""

import csv

import pytest
from pyspark.sql import functions as F

import registry
from lakeclerk.operators import as_inferred, inferred_types, merged_type_counts, type_counts
from lakeclerk.sources import read_csv

VALUES = [
    "7", " 7", "+7", "-7", "0007", "2147483647", "2147483648", "-2147483649", "9223372036854775807",
    "9223372036854775808", "-99999999999999999999", "1" * 38, "1" * 39, "7.0", "7.", ".5", "1e3", "1d",
    "0x1p3", "NaN", "Inf", "-Inf", "Infinity", "nan", "2024", "2024-01", "2024-01-01", "2024-1-1",
    "2024-01-01 10:00:00", "2024-01-01T10:00:00.5", "2024-01-01 10:00:00Z", "10:00", "2024-13-01",
    "2024-01-01 25:00:00", "12/31/2024", "true", "TRUE", "t", " true", "1,5", "", "x", "-", "1_0", "--5",
]
PAIRS = [
    ("1", "2024-01-01"), ("1", "true"), ("1", "1.5"), ("9223372036854775808", "1.5"), ("1", "2147483648"),
    ("2024-01-01", "2024-01-01 10:00:00"), ("9223372036854775808", "1"), ("true", "x"), ("1.5", "NaN"),
    ("1.5", "2024-01-01"), ("true", "2024-01-01"), ("1", ""), ("2024-01-01", ""),
]


def put(folder, columns):
    """One file with a column for each list of values."""
    with open(f"{folder}/a.csv", "w", newline="") as out:
        rows = csv.writer(out, quoting=csv.QUOTE_ALL)
        rows.writerow([f"c{i}" for i in range(len(columns))])
        rows.writerows(zip(*columns))
    return f"{folder}/a.csv"


def both(spark, path, **options):
    """(column, type) as Spark infers them and as found here."""
    text = read_csv(spark, path, **options)
    found = inferred_types(type_counts(text)).orderBy("ordinal").collect()
    return read_csv(spark, path, infer=True, **options).dtypes, [(r.column_name, r.data_type) for r in found]


@pytest.mark.parametrize("columns", [[[v] for v in VALUES], PAIRS])
def test_types_equal_sparks(spark, folder, columns):
    spark_types, found = both(spark, put(folder, columns))
    assert list(zip(columns, found)) == list(zip(columns, spark_types))


@pytest.mark.parametrize("name", [n for n in registry.TABLES if n != "embeddings"])
def test_text_twins_of_all_tables(spark, folder, name):
    rows = registry.table(spark, "/root/testdata/sf0.001", name)
    rows.write.option("header", True).option("quoteAll", True).csv(f"{folder}/t")
    spark_types, found = both(spark, f"{folder}/t", multi_line=True)
    assert found == spark_types


def test_one_scan_and_no_exceptions(spark, folder):
    text = read_csv(spark, put(folder, PAIRS))
    counts = type_counts(text)
    assert counts._jdf.queryExecution().executedPlan().toString().count("Scan csv") == 1
    row = counts.filter("column_name = 'c4'").first()
    assert (row.n_rows, row.n_values, row.n_int, row.n_bigint, row.digits) == (2, 2, 1, 2, 10)


def test_counts_of_parts_add_up(spark, folder):
    text = read_csv(spark, put(folder, [[str(i), f"{i}.5" if i % 3 else "", "t"] * 5 for i in range(15)]))
    merged = merged_type_counts(type_counts(text, F.pmod(F.xxhash64("c0", "c1"), F.lit(3))))
    assert sorted(merged.collect()) == sorted(type_counts(text).select(*merged.columns).collect())


def test_empty_table_and_typed_frame(spark, folder):
    text = read_csv(spark, put(folder, [["1", "-3"], ["2024-01-01", ""], ["x", "1"]]))
    types = inferred_types(type_counts(text))
    assert as_inferred(text, types).dtypes == [("c0", "int"), ("c1", "date"), ("c2", "string")]
    assert [r.c0 for r in as_inferred(text, types).collect()] == [1, -3]
    none = inferred_types(type_counts(text.limit(0))).collect()
    assert {(r.data_type, r.n_rows, r.misfits["int"]) for r in none} == {("string", 0, 0)}
