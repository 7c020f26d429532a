import pytest
from pyspark.sql import functions as F

from lakeclerk import Catalog
from lakeclerk.operators import read_table
from lakeclerk.plans import EXTENDED_SCHEMA, CopyLineage, copy_table, vaccination_enrichment
from lakeclerk.sinks import write_csv
from lakeclerk.sources import check_schema, read_csv

VACCINE_HEADER = [
    "Country",
    "Doses administered per 100 people",
    "Total doses administered",
    "% of population vaccinated",
    "% of population fully vaccinated",
]
COUNTRY_HEADER = [
    "Country",
    "Region",
    "Surface area (km2)",
    "Population in thousands (2017)",
    "Sex ratio (m per 100 f, 2017)",
    "GDP: Gross domestic product (million current US$)",
    "Other.x",
]


@pytest.fixture
def raw(spark, folder):
    vaccine = [
        ("Aland", "6", "2369625", "2.2", "1.1"),
        ("Bland", "166", "2254252000", "88.0", None),
        ("Côte X", "10", "5", "1.0", "2.0"),
        ("Nowhere", "1", "1", "1.0", "1.0"),
        (None, "1", "1", "1.0", "1.0"),
    ]
    country = [
        ("Aland", "North", "100", "12", "99.5", "-99", "u"),
        ("Bland", "South, far", "~0", "1", "101.0", "7", "v"),
        ("Côte X", "West", "...", "2", "100.1", "8", "w"),
        ("Côte X", "West", None, "3", "100.2", "9", "w"),
        ("Elsewhere", "East", "5", "4", "100.0", "10", "x"),
        (None, "East", "5", "4", "100.0", "10", "x"),
    ]
    write_csv(spark.createDataFrame(vaccine, VACCINE_HEADER), f"{folder}/raw/v")
    write_csv(spark.createDataFrame(country, COUNTRY_HEADER), f"{folder}/raw/c")
    return read_csv(spark, f"{folder}/raw/v"), read_csv(spark, f"{folder}/raw/c")


def test_golden_schema(raw):
    extended, _, _ = vaccination_enrichment().transform(*raw)
    assert [(f.name, f.dataType) for f in extended.schema] == [
        (f.name, f.dataType) for f in EXTENDED_SCHEMA
    ]


def test_rows(raw):
    extended, left, right = vaccination_enrichment().transform(*raw)
    assert left.count() == 5 and right.count() == 6
    assert {tuple(row) for row in extended.collect()} == {
        ("Aland", 6, 2369625, 2.2, 1.1, "North", 100.0, 12, 99.5, -99),
        ("Bland", 166, 2254252000, 88.0, None, "South, far", None, 1, 101.0, 7),
        ("Côte X", 10, 5, 1.0, 2.0, "West", None, 2, 100.1, 8),
        ("Côte X", 10, 5, 1.0, 2.0, "West", None, 3, 100.2, 9),
    }


def test_unused_columns_are_not_read(raw):
    _, _, right = vaccination_enrichment().transform(*raw)
    plan = right._jdf.queryExecution().executedPlan().toString()
    assert "Other.x" not in plan.split("ReadSchema")[1]


def test_run_writes_zones_and_catalogue(spark, folder, raw):
    base = f"{folder}/lake"
    plan = vaccination_enrichment()
    for _ in range(2):
        result = plan.run(*raw, base, scan_level="Incremental", n_files=1)
    master = result.master
    check_schema(master, EXTENDED_SCHEMA)
    assert master.count() == 4 and len(master.inputFiles()) == 1
    catalog = Catalog(spark, f"{base}/catalog")
    source = master.inputFiles()[0].rsplit("/", 1)[0]
    copy_table(
        spark,
        source,
        f"{folder}/text",
        schema=EXTENDED_SCHEMA,
        n_files=1,
        lineage=CopyLineage(catalog, "copy", "master_extended_vaccine", "extended_vaccine_text"),
    )
    assert read_csv(spark, f"{folder}/text").columns == EXTENDED_SCHEMA.names
    other = result.right.inputFiles()[0].rsplit("/", 1)[0]
    with pytest.raises(ValueError):
        copy_table(spark, other, f"{folder}/no", schema=EXTENDED_SCHEMA)

    assert {tuple(row) for row in result.unmatched.collect()} == {
        ("left", "Nowhere", 1),
        ("left", None, 1),
        ("right", "Elsewhere", 1),
        ("right", None, 1),
    }

    kinds = {
        row.type_name: row["count"]
        for row in catalog.read("entities").groupBy("type_name").count().collect()
    }
    assert kinds.pop("azure_datalake_gen2_resource_set") >= 4
    assert kinds == {"custom_delta_table": 7, "column": 53, "custom_spark_job_process": 5}
    assert catalog.read("columns").count() == 53
    assert catalog.read("relationships").count() == 53
    process = catalog.read("entities").filter("type_name = 'custom_spark_job_process'").first()
    assert process.attributes == {"job_type": "batch", "schedule": "adHoc"}
    target = catalog.read("entities").filter(
        (F.col("name") == "extended_vaccine_text") & (F.col("type_name") == "custom_delta_table")
    )
    origins = catalog.origins(target.select(F.col("guid").alias("node")))
    names = origins.join(
        catalog.read("entities").select(F.col("guid").alias("origin"), "name"), "origin"
    )
    assert {(row.name, row.n_hops) for row in names.collect()} == {
        ("copy", 1),
        ("master_extended_vaccine", 2),
        ("vaccination_master", 3),
        ("extended_vaccine", 4),
        ("vaccination", 5),
        ("clean_country", 6),
        ("clean_vaccine", 6),
        ("vaccination_clean_country", 7),
        ("vaccination_clean_vaccine", 7),
        ("raw_clean_country", 8),
        ("raw_clean_vaccine", 8),
    }
    # The second run wrote new folders; the old ones stay until they are removed.
    assert {row.change for row in result.scanned.select("change").collect()} == {"added"}


def test_rerun_of_a_partition_leaves_the_others(spark, folder, raw):
    plan, base = vaccination_enrichment(), f"{folder}/lake"
    def files(df):
        rows = df.select("Region", F.input_file_name().alias("f")).distinct().collect()
        return {(row.Region, row.f) for row in rows}

    first = plan.run(*raw, base, partition_by=["Region"])
    before = files(first.master)
    vaccine = raw[0].withColumn("Doses administered per 100 people", F.lit("7"))
    country = raw[1].filter("Region = 'North'")
    options = {"partition_by": ["Region"], "partitions": ["Region=North"]}
    again = plan.run(vaccine.filter("Country = 'Aland'"), country, base, **options)
    assert {row[0] for row in before & files(again.master)} == {"South, far", "West"}
    doses = {row.Country: row.Doses_administered_per_100_people for row in again.master.collect()}
    assert doses == {"Aland": 7, "Bland": 166, "Côte X": 10}
    # The clean zone keeps what was not run again, and so do the keys left out.
    assert again.left.count() == 5 and again.right.count() == 6
    assert {tuple(row) for row in again.unmatched.collect()} == {
        ("left", "Nowhere", 1), ("left", None, 1), ("right", "Elsewhere", 1), ("right", None, 1),
    }
    # A partition that has no row left goes; a row of another one fails the run.
    gone = plan.run(vaccine.filter("false"), country.filter("false"), base, **options)
    assert {row.Region for row in gone.master.collect()} == {"South, far", "West"}
    with pytest.raises(Exception, match="rows outside"):
        plan.run(*raw, base, **options)


def test_failed_run_keeps_the_old_tables(spark, folder, raw):
    plan, base = vaccination_enrichment(), f"{folder}/lake"
    first = plan.run(*raw, base)
    broken = raw[1].withColumn("Region", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        plan.run(raw[0], broken, base)
    assert first.master.count() == 4
    assert read_table(spark, f"{base}/clean", "clean_country_data").count() == 6
