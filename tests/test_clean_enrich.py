import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeclerk.functions.casting import guarded_cast
from lakeclerk.functions import conversion_losses, convert, named, select_strict, tolerant_cast
from lakeclerk.operators import (
    ColumnRule,
    clean,
    enrich,
    likely_partners,
    rename_columns,
    unmatched_keys,
)


def test_clean_keeps_renames_casts_and_fills(spark):
    df = spark.createDataFrame(
        [("1", "~0", "p", None), ("x", "3.5", "q", "z")], ["a b", "Other.x", "drop", "d"]
    )
    rules = [
        ColumnRule("Other.x", "area", "double"),
        ColumnRule("a b", "n", "int"),
        ColumnRule("d", default="none"),
    ]
    result = clean(df, rules)
    assert result.dtypes == [("area", "double"), ("n", "int"), ("d", "string")]
    assert {tuple(row) for row in result.collect()} == {(None, 1, "none"), (3.5, None, "z")}


def test_missing_columns_are_errors(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="gone"):
        clean(df, [ColumnRule("gone")])
    with pytest.raises(ValueError, match="gone"):
        rename_columns(df, {"gone": "b"})
    with pytest.raises(ValueError, match="gone"):
        select_strict(df, ["a", "gone"])


def test_names_are_literal(spark):
    df = spark.createDataFrame([(1, 2)], ["a.b", "c`d"])
    assert df.select(named("a.b"), named("c`d")).collect() == [(1, 2)]


def test_tolerant_cast_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([("1.5",), ("...",), ("",), (None,), ("-99",)], "s string")
    values = [row.v for row in df.select(tolerant_cast(F.col("s"), "double").alias("v")).collect()]
    assert values == [1.5, None, None, None, -99.0]


def test_convert_truncates_toward_zero(spark):
    df = spark.createDataFrame([(1.9,), (-1.9,), (1e30,), (None,)], "x double")
    cut = convert(df, {"x": "bigint"}, on_misfit="null")
    assert [row.x for row in cut.collect()] == [1, -1, None, None]
    with pytest.raises(Exception, match="does not fit"):
        convert(df, {"x": "bigint"}).collect()


MISFITS = [
    ("1e20D", "bigint", True),
    ("'12.7'", "int", False),
    ("'-12.7'", "int", False),
    ("'12x'", "int", True),
    ("70000", "smallint", True),
    ("12.9BD", "int", False),
]
STRICT = [
    ("9007199254740993", "double", True),
    ("9007199254740992", "double", False),
    ("1.239BD", "decimal(10,2)", True),
    ("1.230BD", "decimal(10,2)", False),
    ("timestamp'2024-01-01 10:00:00'", "date", True),
    ("timestamp'2024-01-01 00:00:00'", "date", False),
    ("'12.7'", "int", True),
    ("1.5D", "int", True),
    ("70000", "smallint", True),
]


@pytest.mark.parametrize("allow, cases", [(True, MISFITS), (False, STRICT)])
def test_values_that_do_not_fit_are_counted(spark, allow, cases):
    df = spark.sql("SELECT " + ", ".join(f"{v} AS c{i}" for i, (v, _, _) in enumerate(cases)))
    targets = {f"c{i}": target for i, (_, target, _) in enumerate(cases)}
    found = {row.column_name: row.n_misfits for row in conversion_losses(df, targets, allow).collect()}
    assert found == {f"c{i}": int(misfit) for i, (_, _, misfit) in enumerate(cases)}
    row = convert(df, targets, allow, on_misfit="null").first()
    assert [row[i] is None for i in range(len(cases))] == [misfit for _, _, misfit in cases]
    if allow:
        assert (row[1], row[2], row[5]) == (12, -12, 12)


def test_convert_can_refuse_truncation(spark):
    whole = spark.createDataFrame([(1.0,), (None,)], "x double")
    assert [row.x for row in convert(whole, {"x": "int"}, allow_truncation=False).collect()] == [1, None]
    for value in (1.5, 1e30):
        df = spark.createDataFrame([(value,)], "x double")
        with pytest.raises(Exception, match="does not fit"):
            convert(df, {"x": "int"}, allow_truncation=False).collect()


def test_convert_booleans(spark):
    df = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert [row.f for row in convert(df, {"f": "string"}).collect()] == ["true", "false", None]
    with pytest.raises(ValueError):
        convert(df, {"f": "int"})
    numbers = convert(df, {"f": "bigint"}, boolean_as_number=True)
    assert [row.f for row in numbers.collect()] == [1, 0, None]


def test_join_order_nulls_and_duplicates(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "a")], "x int, k string")
    right = spark.createDataFrame([("a", 10), ("a", 11), ("c", 12), (None, 13)], "k string, y int")
    result = enrich(left, right, "k")
    assert result.columns == ["k", "x", "y"]
    assert {tuple(row) for row in result.collect()} == {
        ("a", 1, 10),
        ("a", 1, 11),
        ("a", 4, 10),
        ("a", 4, 11),
    }


def test_unmatched_keys_count_rows_on_both_sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "x int, k string")
    right = spark.createDataFrame([("a",), ("c",), (None,), (None,)], "k string")
    assert {tuple(row) for row in unmatched_keys(left, right, "k").collect()} == {
        ("left", "b", 2),
        ("right", "c", 1),
        ("left", None, 1),
        ("right", None, 2),
    }


def test_unmatched_keys_of_several_columns(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b")], "n int, k string")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "n int, k string")
    assert {tuple(row) for row in unmatched_keys(left, right, ["n", "k"]).collect()} == {
        ("left", 1, "b", 1),
        ("right", 2, "b", 1),
    }


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_likely_partners_match_all_pairs(spark):
    draw = random.Random(5)
    words = ["".join(draw.choice("abé") for _ in range(draw.randint(0, 14))) for _ in range(160)]
    left, right = [*words[:100], None, "", "aaaaaaaaaaaa"], [*words[70:], None, "aabaaaaaabaaa", "x"]
    found = likely_partners(
        spark.createDataFrame([(w, 1) for w in left + left[:5]], "`a.k` string, key int"),
        spark.createDataFrame([(w,) for w in right], "`a.k` string"),
        "a.k",
        max_edits=3,
        max_share=0.4,
    ).collect()
    known = {w for w in right if w is not None}
    expected = set()
    for word in {w for w in left if w is not None} - known:
        near = [(_distance(word, w), w) for w in known]
        near = [(d, w) for d, w in near if d <= min(3, int(0.4 * max(len(word), len(w))))]
        edits, partner = min(near, default=(None, None))
        expected.add((word, (left + left[:5]).count(word), partner, edits))
    assert len(found) == len(expected) and {tuple(row) for row in found} == expected
    assert {row.edits for row in found} == {None, 1, 2, 3}


def test_likely_partners_of_nothing(spark):
    none = spark.createDataFrame([], "k string")
    some = spark.createDataFrame([("a",), (None,)], "k string")
    assert likely_partners(none, some, "k").isEmpty()
    assert likely_partners(some, none, "k").collect() == [("a", 1, None, None)]
    assert likely_partners(some, none, "k", max_edits=0).collect() == [("a", 1, None, None)]
    with pytest.raises(ValueError, match="max_share"):
        likely_partners(some, none, "k", max_share=0.5)


def test_hot_join_key_is_split(spark, conf):
    """A key with a third of the rows does not stay in one task."""
    conf("spark.sql.autoBroadcastJoinThreshold", "-1")
    conf("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "200k")
    conf("spark.sql.adaptive.skewJoin.skewedPartitionFactor", "2")
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    left = spark.range(0, 300_000, numPartitions=8).select(
        key.alias("k"), F.md5(F.col("id").cast("string")).alias("t")
    )
    right = spark.range(0, 300_000, 1, 8).select(
        F.col("id").alias("k"), (F.col("id") * 2).alias("y")
    )
    joined = enrich(left, right, "k")
    assert joined.agg(F.count("*")).first()[0] == 300_000
    # The plan is final once the join itself has run.
    rows = joined.collect()
    assert len(rows) == 300_000
    assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


TEXTS = [
    None, "", " ", "7", " 7 ", "+7", "-7", "--7", "7.", ".7", ".", "7.9", "-7.9", "1e3", "1e-3", "1e400",
    "1e", "0x1F", "0x1p3", "1d", "1.5f", "NaN", "nan", "Infinity", "-inf", "inf", "information", "~0", "...",
    "127", "128", "-128", "-129", "32767", "32768", "2147483647", "2147483648", "-2147483648",
    "9223372036854775807", "9223372036854775808", "-9223372036854775808", "99999999999999999999999",
    "000000000000000000000000000000000012", "12 34", "1_000", "1,5", "\t5\n", "\u0661", "five", "true",
]


@pytest.mark.parametrize("target", ["tinyint", "smallint", "int", "bigint", "double", "float", "decimal(10,2)"])
def test_guarded_casts_of_text_equal_plain_ones(spark, target):
    df = spark.createDataFrame([(t,) for t in TEXTS], "x string")
    guarded = guarded_cast(F.col("x"), T.StringType(), T.DataType.fromDDL(target))
    rows = df.select("x", F.col("x").try_cast(target).alias("a"), guarded.alias("b")).collect()
    assert [(r.x, str(r.b)) for r in rows] == [(r.x, str(r.a)) for r in rows]


SATURATING = {("double", "bigint"), ("float", "bigint")}


@pytest.mark.parametrize("source", ["tinyint", "smallint", "int", "bigint", "double", "float", "decimal(22,3)"])
@pytest.mark.parametrize("target", ["tinyint", "smallint", "int", "bigint"])
def test_guarded_casts_of_numbers_equal_plain_ones(spark, source, target):
    numbers = [0, 0.999, -0.999, float("nan"), float("inf"), -float("inf"), None]
    for bits in (7, 15, 31, 63):
        numbers += [sign * 2.0**bits + more for sign in (1, -1) for more in (-1.0, -0.5, 0.0, 0.5, 1.0)]
    kind = T.DataType.fromDDL(source)
    values = spark.createDataFrame([(None if n is None else float(n),) for n in numbers], "v double")
    df = values.select(F.col("v").try_cast(kind).alias("x")).filter("x IS NOT NULL")
    target_type = T.DataType.fromDDL(target)
    # Plain casts saturate in places: at 2**63, and decimals, whose whole part is compared.
    df = df.filter(F.col("x") < 2.0**63) if (source, target) in SATURATING else df
    plain = F.col("x").try_cast(target_type)
    if source.startswith("decimal"):
        plain = F.when(F.col("x") >= 0, F.floor("x")).otherwise(F.ceil("x")).try_cast(target_type)
    rows = df.select("x", plain.alias("a"), guarded_cast(F.col("x"), kind, target_type).alias("b")).collect()
    assert rows and [(r.x, r.b) for r in rows if r.x == r.x] == [(r.x, r.a) for r in rows if r.x == r.x]
    assert all(r.b is None for r in rows if r.x != r.x)
