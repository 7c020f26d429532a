"""The vaccine and country tables as one enrichment."""

from __future__ import annotations

from pyspark.sql import types as T

from lakeclerk.operators.clean import ColumnRule
from lakeclerk.plans.enrichment import Enrichment

# Header names, clean names and types of the two tables.
VACCINE_RULES = [
    ColumnRule("Country"),
    ColumnRule("Doses administered per 100 people", "Doses_administered_per_100_people", "int"),
    ColumnRule("Total doses administered", "Total_doses_administered", "bigint"),
    ColumnRule("% of population vaccinated", "Percentage_population_vaccinated", "double"),
    ColumnRule(
        "% of population fully vaccinated", "Percentage_population_fully_vaccinated", "double"
    ),
]
COUNTRY_RULES = [
    ColumnRule("Country"),
    ColumnRule("Region"),
    ColumnRule("Surface area (km2)", "Surface_area", "double"),
    ColumnRule("Population in thousands (2017)", "Population_in_thousands", "int"),
    ColumnRule("Sex ratio (m per 100 f, 2017)", "Sex_ratio", "double"),
    ColumnRule("GDP: Gross domestic product (million current US$)", "GDP", "int"),
]
EXTENDED_SCHEMA = T.StructType(
    [
        T.StructField("Country", T.StringType()),
        T.StructField("Doses_administered_per_100_people", T.IntegerType()),
        T.StructField("Total_doses_administered", T.LongType()),
        T.StructField("Percentage_population_vaccinated", T.DoubleType()),
        T.StructField("Percentage_population_fully_vaccinated", T.DoubleType()),
        T.StructField("Region", T.StringType()),
        T.StructField("Surface_area", T.DoubleType()),
        T.StructField("Population_in_thousands", T.IntegerType()),
        T.StructField("Sex_ratio", T.DoubleType()),
        T.StructField("GDP", T.IntegerType()),
    ]
)


def vaccination_enrichment(name: str = "vaccination") -> Enrichment:
    return Enrichment(
        name=name,
        left_name="clean_vaccine",
        left_rules=VACCINE_RULES,
        right_name="clean_country",
        right_rules=COUNTRY_RULES,
        on="Country",
        extended_name="extended_vaccine",
    )
