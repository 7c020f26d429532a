"""The registered queries over the given tables, each with its check in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeclerk import Catalog
from lakeclerk.functions import (
    conversion_losses,
    convert,
    entity_guid,
    new_folder,
    remove_folder,
    select_strict,
    tolerant_cast,
)
from lakeclerk.operators import (
    ColumnRule,
    apply_attribute_rules,
    cardinality_violations,
    clean,
    column_profile,
    compare_snapshots,
    delete_entities,
    enrich,
    entity_rows,
    file_inventory,
    inferred_types,
    inherited_type_defs,
    latest_by_key,
    likely_partners,
    lineage_hops,
    merged_type_counts,
    pattern_sets,
    publish_table,
    read_table,
    record_lineage,
    register_resource_sets,
    register_tables,
    relationship_rows,
    relationships_by_guid,
    rename_columns,
    replace_by_key,
    resolve,
    resource_sets,
    schema_rows,
    shallow_origins,
    statistics_rows,
    trace_origins,
    type_counts,
    type_definitions,
    unmatched_keys,
    upsert,
    with_members,
)
from lakeclerk.operators.profile import DISTINCT_RSD, QUANTILE_ERROR
from lakeclerk.plans import Enrichment, copy_table
from lakeclerk.sinks import merge_files, overwrite, overwrite_partitions, write_csv
from lakeclerk.sources import check_schema, read_csv, read_parquet, text_schema
from lakeclerk.streaming import FULL, INCREMENTAL, scan

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

# The given tables and the type names a registration reports for them.
TABLES = {
    "region": {"r_regionkey": "int", "r_name": "string"},
    "nation": {"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"},
    "customer": {
        "c_custkey": "bigint",
        "c_name": "string",
        "c_nationkey": "int",
        "c_acctbal": "double",
        "c_mktsegment": "string",
    },
    "supplier": {
        "s_suppkey": "bigint",
        "s_name": "string",
        "s_nationkey": "int",
        "s_acctbal": "double",
    },
    "part": {
        "p_partkey": "bigint",
        "p_name": "string",
        "p_brand": "string",
        "p_type": "string",
        "p_size": "int",
        "p_retailprice": "double",
    },
    "orders": {
        "o_orderkey": "bigint",
        "o_custkey": "bigint",
        "o_orderstatus": "string",
        "o_totalprice": "double",
        "o_orderdate": "timestamp_ntz",
        "o_orderpriority": "string",
    },
    "lineitem": {
        "l_orderkey": "bigint",
        "l_partkey": "bigint",
        "l_suppkey": "bigint",
        "l_linenumber": "int",
        "l_quantity": "double",
        "l_extendedprice": "double",
        "l_discount": "double",
        "l_tax": "double",
        "l_returnflag": "string",
        "l_linestatus": "string",
        "l_shipdate": "timestamp_ntz",
    },
    "events": {
        "event_id": "bigint",
        "ts": "timestamp_ntz",
        "user_id": "bigint",
        "event_type": "string",
        "value": "double",
        "props": "string",
    },
    "documents": {
        "doc_id": "bigint",
        "text": "string",
        "lang": "string",
        "source": "string",
        "n_chars": "bigint",
    },
    "embeddings": {"vec_id": "bigint", "embedding": "array<float>", "label": "int"},
    "pages": {"page_id": "bigint", "url": "string", "html": "string"},
    "benchmark": {"item_id": "bigint", "text": "string"},
    "labels": {"doc_id": "bigint", "quality": "int", "toxic": "int"},
    "conversations": {
        "conv_id": "bigint",
        "turn": "bigint",
        "role": "string",
        "text": "string",
    },
}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL twin if any."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def keyed(kind: str, key: str):
    """Qualified name of a data row taken as an entity."""
    return F.concat(F.lit(f"{kind}://"), F.col(key).cast("string"))


def as_entities(df: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    """Rows of ``df`` as entities of one type, without a time."""
    no_time = F.lit(None).cast("timestamp")
    return entity_rows(df, kind, keyed(kind, key), F.col(name), updated_at=no_time)


# ---------------------------------------------------------------- sources


@query(
    """
    SELECT c_custkey::INTEGER AS c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment
    FROM customer
    """
)
def csv_scan_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_csv(table(spark, sf_dir, "customer"), new_folder(spark, "csv"), quote_all=False)
    return read_csv(spark, path, infer=True)


@query(
    """
    SELECT l_orderkey::VARCHAR AS l_orderkey, l_partkey::VARCHAR AS l_partkey,
           l_suppkey::VARCHAR AS l_suppkey, l_linenumber::VARCHAR AS l_linenumber,
           l_quantity::VARCHAR AS l_quantity, l_extendedprice::VARCHAR AS l_extendedprice,
           l_discount::VARCHAR AS l_discount, l_tax::VARCHAR AS l_tax,
           l_returnflag, l_linestatus,
           strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%g') AS l_shipdate
    FROM lineitem
    """
)
def csv_scan_all_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = table(spark, sf_dir, "lineitem")
    path = write_csv(lineitem, new_folder(spark, "csv"), quote_all=False)
    return read_csv(spark, path, schema=text_schema(lineitem.columns))


# Tables whose text twins have no line break.
TEXT_TWINS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels")


def inferred_sql() -> str:
    """Types by the given ones: whole numbers are as narrow as their values."""
    parts = []
    for name in TEXT_TWINS:
        for ordinal, (column, data_type) in enumerate(TABLES[name].items(), start=1):
            kind, whole = "'string'", "0"
            if data_type in ("int", "bigint"):
                kind = f"CASE WHEN max(abs({column})) < 2147483648 THEN 'int' ELSE 'bigint' END"
                whole = f"count(*) FILTER (abs({column}) < 2147483648)"
            elif data_type == "double":
                kind = "'double'"
            elif data_type == "timestamp_ntz":
                kind = "'timestamp'"
            parts.append(
                f"SELECT '{name}' AS table_name, {ordinal} AS ordinal, '{column}' AS column_name, "
                f"CASE WHEN count({column}) = 0 THEN 'string' ELSE {kind} END AS data_type, "
                f"count({column}) AS n_values, count({column}) - {whole} AS n_not_int FROM {name}"
            )
    return " UNION ALL ".join(parts)


@query(inferred_sql())
def csv_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of text files from counts of one scan, those of two halves of each table added up."""
    path = new_folder(spark, "twins")
    found = []
    for name in TEXT_TWINS:
        write_csv(table(spark, sf_dir, name), f"{path}/{name}")
        text = read_csv(spark, f"{path}/{name}")
        counts = type_counts(text, F.pmod(F.xxhash64(text.columns[0]), F.lit(2)))
        found.append(inferred_types(merged_type_counts(counts)).withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, found).select(
        "table_name",
        "ordinal",
        "column_name",
        "data_type",
        "n_values",
        F.col("misfits")["int"].alias("n_not_int"),
    )


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus,
           CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS o_totalprice
    FROM orders
    """
)
def csv_null_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown prices are stored as the token -99."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") == "P", F.lit("-99"))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("o_totalprice"),
    )
    path = write_csv(orders, new_folder(spark, "csv"))
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double"
    return read_csv(spark, path, schema=schema, null_value="-99")


# Text with line breaks is read one file per task, so files are cut by rows.
FILE_ROWS = 100


def in_bounded_files(back: DataFrame) -> DataFrame:
    """``back`` with whether no file has more than FILE_ROWS rows, and enough files are there."""
    sizes = back.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    found = sizes.agg(F.max("n"), F.count("*"), F.sum("n")).first()
    bounded = found[0] <= FILE_ROWS and found[1] >= -(-found[2] // FILE_ROWS)
    return back.withColumn("files_are_bounded", F.lit(bounded))


@query("SELECT doc_id, text, lang, source, n_chars, true AS files_are_bounded FROM documents")
def csv_quoted_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with line breaks and quotes survive quoted text files."""
    documents = table(spark, sf_dir, "documents")
    path = write_csv(
        documents, new_folder(spark, "csv"), null_value="\\N", file_rows=FILE_ROWS
    )
    back = read_csv(spark, path, schema=documents.schema, null_value="\\N", multi_line=True)
    return in_bounded_files(back)


@query("SELECT page_id, url, html, true AS files_are_bounded FROM pages")
def csv_quoted_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup is dense in quotes, backslashes and delimiters."""
    pages = table(spark, sf_dir, "pages")
    path = write_csv(pages, new_folder(spark, "csv"), null_value="\\N", file_rows=FILE_ROWS)
    back = read_csv(spark, path, schema=pages.schema, null_value="\\N", multi_line=True)
    return in_bounded_files(back)


@query("SELECT * FROM lineitem")
def parquet_partitioned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = overwrite(
        table(spark, sf_dir, "lineitem"),
        new_folder(spark, "partitioned"),
        partition_by=["l_returnflag", "l_linestatus"],
    )
    return read_parquet(spark, path)


@query("SELECT * EXCLUDE (o_orderstatus) FROM orders")
def parquet_recursive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at any depth; directory names carry no columns in this mode."""
    path = overwrite(
        table(spark, sf_dir, "orders"),
        new_folder(spark, "partitioned"),
        partition_by=["o_orderstatus"],
    )
    return read_parquet(spark, path, recursive=True, glob="*.parquet")


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def parquet_declared_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = T.StructType(
        [
            T.StructField("p_partkey", T.LongType()),
            T.StructField("p_name", T.StringType()),
            T.StructField("p_brand", T.StringType()),
            T.StructField("p_type", T.StringType()),
            T.StructField("p_size", T.IntegerType()),
            T.StructField("p_retailprice", T.DoubleType()),
        ]
    )
    check_schema(table(spark, sf_dir, "part"), declared)
    return read_parquet(spark, f"{sf_dir}/part.parquet", schema=declared)


@query("SELECT * FROM orders")
def parquet_wildcard_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wildcard below the table; the base path keeps the partition column."""
    path = overwrite(
        table(spark, sf_dir, "orders"),
        new_folder(spark, "partitioned"),
        partition_by=["o_orderstatus"],
    )
    return read_parquet(spark, f"{path}/o_orderstatus=*", base_path=path)


# ------------------------------------------------------------------ sinks


@query(
    """
    SELECT o_orderkey AS order_key, o_totalprice AS price, o_orderpriority AS priority FROM orders
    """
)
def overwrite_replaces_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = overwrite(orders, new_folder(spark, "overwritten"))
    overwrite(
        orders.select(
            F.col("o_orderkey").alias("order_key"),
            F.col("o_totalprice").alias("price"),
            F.col("o_orderpriority").alias("priority"),
        ),
        path,
    )
    return read_parquet(spark, path)


@query("SELECT * FROM lineitem WHERE l_returnflag <> 'R' OR l_quantity > 25")
def dynamic_partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace the R partition by its large orders; the others stay."""
    lineitem = table(spark, sf_dir, "lineitem")
    path = overwrite(
        lineitem, new_folder(spark, "partitioned"), partition_by=["l_returnflag"]
    )
    replacement = lineitem.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25))
    overwrite_partitions(replacement, path, ["l_returnflag"])
    return read_parquet(spark, path)


@query("SELECT *, 3::BIGINT AS n_files FROM orders")
def merged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table of eight files, merged to the three asked for."""
    source = overwrite(
        table(spark, sf_dir, "orders").repartition(8, "o_orderkey"), new_folder(spark, "parts")
    )
    path = merge_files(spark, source, new_folder(spark, "merged"), n_files=3)
    n_files = file_inventory(spark, path, "*.parquet").count()
    return read_parquet(spark, path).withColumn("n_files", F.lit(n_files).cast("bigint"))


@query(
    """
    SELECT o_orderkey, trunc(o_totalprice)::BIGINT AS o_totalprice, o_orderpriority,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END AS is_urgent,
           o_orderstatus, 2::BIGINT AS n_files
    FROM orders
    """
)
def copy_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet folder with partitions to quoted text, with conversions."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_totalprice",
        "o_orderpriority",
        (F.col("o_orderpriority") == "1-URGENT").alias("is_urgent"),
        "o_orderstatus",
    )
    source = overwrite(orders, new_folder(spark, "parts"), partition_by=["o_orderstatus"])
    path = new_folder(spark, "copied")
    copy_table(
        spark,
        source,
        path,
        {"o_totalprice": "bigint", "is_urgent": "string"},
        glob="*.parquet",
        n_files=2,
        extension="txt",
    )
    n_files = file_inventory(spark, path, "*.txt").count()
    schema = (
        "o_orderkey bigint, o_totalprice bigint, o_orderpriority string, "
        "is_urgent string, o_orderstatus string"
    )
    back = read_csv(spark, path, schema=schema)
    return back.withColumn("n_files", F.lit(n_files).cast("bigint"))


@query(
    """
    SELECT '"' || o_orderkey || '","' || o_totalprice || '","' || o_orderpriority || '"' AS line
    FROM orders
    """
)
def quoted_text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written text itself: every field is quoted."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    path = write_csv(orders, new_folder(spark, "csv"))
    header = '"o_orderkey","o_totalprice","o_orderpriority"'
    lines = spark.read.text(path).withColumnRenamed("value", "line")
    return lines.filter(F.col("line") != header)


# --------------------------------------------------- projections and joins


@query(
    """
    SELECT l_orderkey AS order_key, l_partkey AS part_key, l_quantity AS quantity,
           l_discount AS discount_share, l_tax AS tax_rate
    FROM lineitem
    """
)
def project_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Awkward headers, one with a dot, to identifiers."""
    raw = table(spark, sf_dir, "lineitem").withColumnsRenamed(
        {
            "l_orderkey": "Order key",
            "l_quantity": "Quantity (units, 1998)",
            "l_discount": "% of discount",
            "l_tax": "Tax.rate",
        }
    )
    kept = select_strict(
        raw, ["Order key", "l_partkey", "Quantity (units, 1998)", "% of discount", "Tax.rate"]
    )
    return rename_columns(
        kept,
        {
            "Order key": "order_key",
            "l_partkey": "part_key",
            "Quantity (units, 1998)": "quantity",
            "% of discount": "discount_share",
            "Tax.rate": "tax_rate",
        },
    )


@query(
    """
    SELECT o_orderkey,
           TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN '...'
                         WHEN o_orderpriority = '5-LOW' THEN '~0'
                         ELSE o_totalprice::VARCHAR END AS DOUBLE) AS o_totalprice
    FROM orders
    """
)
def tolerant_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = (
        F.when(F.col("o_orderstatus") == "P", F.lit("..."))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("~0"))
        .otherwise(F.col("o_totalprice").cast("string"))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", tolerant_cast(text, "double", T.StringType()).alias("o_totalprice")
    )


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS l_quantity,
           trunc(l_extendedprice)::INTEGER AS l_extendedprice,
           l_discount::VARCHAR AS l_discount, (l_linestatus = 'F')::INTEGER AS is_final
    FROM lineitem
    """
)
def convert_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities must be whole; prices may lose cents; a flag becomes 1 or 0."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        (F.col("l_linestatus") == "F").alias("is_final"),
    )
    whole = convert(lines, {"l_quantity": "bigint"}, allow_truncation=False)
    return convert(
        whole,
        {"l_extendedprice": "int", "l_discount": "string", "is_final": "int"},
        boolean_as_number=True,
    )


@query(
    """
    SELECT 'key' AS column_name, count(*) FILTER (l_orderkey > 32767) AS n_misfits FROM lineitem
    UNION ALL SELECT 'price', count(*) FILTER (trunc(l_extendedprice * 100000) > 2147483647)
    FROM lineitem
    UNION ALL SELECT 'text', count(*) FILTER (l_returnflag = 'R') FROM lineitem
    UNION ALL SELECT 'tax', count(*) FILTER (round(l_tax, 1) <> l_tax) FROM lineitem
    """
)
def conversion_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that overflow, lose digits or do not parse; a text fraction is cut."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"),
        (F.col("l_extendedprice") * 100000).alias("price"),
        F.when(F.col("l_returnflag") == "R", F.lit("..."))
        .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".7")))
        .alias("text"),
        F.col("l_tax").cast("decimal(6,2)").alias("tax"),
    )
    cut = conversion_losses(lines, {"key": "smallint", "price": "int", "text": "int"})
    exact = conversion_losses(lines, {"tax": "decimal(6,1)"}, allow_truncation=False)
    return cut.unionByName(exact)


@query(
    """
    SELECT l_orderkey, l_linenumber,
           CASE WHEN l_returnflag <> 'R' THEN l_quantity::INTEGER END AS quantity,
           CASE WHEN l_partkey <= 127 THEN l_partkey::TINYINT END AS part
    FROM lineitem
    """
)
def conversion_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that do not fit become null where that is asked for."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", F.lit("..."))
        .otherwise(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".7")))
        .alias("quantity"),
        F.col("l_partkey").alias("part"),
    )
    return convert(lines, {"quantity": "int", "part": "tinyint"}, on_misfit="null")


@query(
    """
    SELECT o_orderkey AS order_key,
           CASE WHEN o_orderstatus = 'P' THEN 0.0::DOUBLE ELSE o_totalprice END AS price,
           CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'none'
                ELSE o_orderpriority END AS priority
    FROM orders
    """
)
def clean_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices that do not parse and priorities that are absent get a default."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("Order key"),
        F.when(F.col("o_orderstatus") == "P", F.lit("pending"))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("Price, total"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias(
            "Order.priority"
        ),
    )
    return clean(
        orders,
        [
            ColumnRule("Order key", "order_key", "bigint"),
            ColumnRule("Price, total", "price", "double", default=0.0),
            ColumnRule("Order.priority", "priority", default="none"),
        ],
    )


@query(
    """
    SELECT l_partkey AS partkey, l_orderkey, l_linenumber, l_quantity, p_name, p_brand
    FROM lineitem JOIN part ON l_partkey = p_partkey
    """
)
def inner_join_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("partkey"), "l_orderkey", "l_linenumber", "l_quantity"
    )
    parts = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partkey"), "p_name", "p_brand"
    )
    return enrich(lines, parts, "partkey")


@query(
    """
    SELECT 'left' AS side, doc_id, count(*) AS n_rows FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id
    UNION ALL
    SELECT 'right', doc_id, count(*) FROM labels
    WHERE doc_id NOT IN (SELECT doc_id FROM documents) GROUP BY doc_id
    """
)
def join_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unmatched_keys(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id"
    )


@query(
    """
    SELECT 'left' AS side, user_id, count(*) AS n_rows FROM events
    WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)
    GROUP BY user_id
    UNION ALL
    SELECT 'right', c_custkey, count(*) FROM customer
    WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)
    GROUP BY c_custkey
    """
)
def join_unmatched_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few users own all events; most customers have none."""
    return unmatched_keys(
        table(spark, sf_dir, "events"),
        table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "user_id"),
        "user_id",
    )


# A part's name and brand as one text, and the same as others spell it.
PART_LABEL = "p_name || ' ' || p_brand"
PART_SPELT = f"""
    CASE p_partkey % 7
        WHEN 0 THEN replace({PART_LABEL}, 'Brand#', 'Br#')
        WHEN 1 THEN replace({PART_LABEL}, 'l', 'll')
        WHEN 2 THEN replace({PART_LABEL}, ' Brand', '. Brand')
        WHEN 3 THEN substring({PART_LABEL}, 2)
        WHEN 4 THEN upper({PART_LABEL})
        ELSE {PART_LABEL}
    END
"""


@query(
    f"""
    WITH spelt AS (SELECT {PART_SPELT} AS label, count(*) AS n_rows FROM part GROUP BY 1),
    known AS (SELECT DISTINCT {PART_LABEL} AS label FROM part WHERE p_partkey % 7 > 2),
    wanted AS (SELECT * FROM spelt WHERE label NOT IN (SELECT label FROM known)),
    pairs AS (
        SELECT w.label, k.label AS partner, levenshtein(w.label, k.label) AS edits
        FROM wanted w JOIN known k ON abs(length(w.label) - length(k.label)) <= 3
        WHERE levenshtein(w.label, k.label)
            <= least(3, floor(0.25 * greatest(length(w.label), length(k.label))))
    ),
    best AS (
        SELECT label, unnest(min(struct_pack(edits := edits, partner := partner)))
        FROM pairs GROUP BY label
    )
    SELECT w.label AS key, w.n_rows, b.partner, b.edits::INTEGER AS edits
    FROM wanted w LEFT JOIN best b USING (label)
    """
)
def join_likely_partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that others spell differently, and the known label each stands for."""
    part = table(spark, sf_dir, "part")
    return likely_partners(
        part.select(F.expr(PART_SPELT).alias("label")),
        part.where("p_partkey % 7 > 2").select(F.expr(PART_LABEL).alias("label")),
        "label",
        max_edits=3,
    )


ORDER_RULES = [
    ColumnRule("Customer key", "custkey", "bigint"),
    ColumnRule("Order key", "order_key", "bigint"),
    ColumnRule("Order status", "order_status"),
    ColumnRule("Total price (USD)", "total_price", "double"),
]
CUSTOMER_RULES = [
    ColumnRule("c_custkey", "custkey", "bigint"),
    ColumnRule("c_mktsegment", "market_segment"),
    ColumnRule("c_acctbal", "account_balance", "double"),
]
EXTENDED_ORDERS = Enrichment(
    name="extended_orders",
    left_name="clean_orders",
    left_rules=ORDER_RULES,
    right_name="clean_customers",
    right_rules=CUSTOMER_RULES,
    on="custkey",
    extended_name="extended_orders",
)
EXTENDED_ORDERS_SQL = """
    SELECT c_custkey AS custkey, o_orderkey AS order_key, o_orderstatus AS order_status,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS total_price,
           c_mktsegment AS market_segment, c_acctbal AS account_balance
    FROM orders JOIN customer ON o_custkey = c_custkey
"""


def raw_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as delivered: awkward names, and a price that may not be a number."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("Customer key"),
        F.col("o_orderkey").alias("Order key"),
        F.col("o_orderstatus").alias("Order status"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit("..."))
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("Total price (USD)"),
        F.col("o_orderdate").alias("Other.date"),
    )


@query(EXTENDED_ORDERS_SQL)
def extended_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean two tables and join them."""
    extended, _, _ = EXTENDED_ORDERS.transform(
        raw_orders(spark, sf_dir), table(spark, sf_dir, "customer")
    )
    return extended


@query(EXTENDED_ORDERS_SQL)
def extended_orders_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run: text files in, clean and master tables and metadata out."""
    base = new_folder(spark, "zones")
    write_csv(raw_orders(spark, sf_dir), f"{base}/raw/orders")
    write_csv(table(spark, sf_dir, "customer"), f"{base}/raw/customer")
    result = EXTENDED_ORDERS.run(
        read_csv(spark, f"{base}/raw/orders"),
        read_csv(spark, f"{base}/raw/customer"),
        base,
        scan_level=INCREMENTAL,
    )
    return result.master


@query(
    """
    SELECT 'left' AS side, o_custkey AS custkey, count(*) AS n_rows FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    GROUP BY o_custkey
    UNION ALL
    SELECT 'right', c_custkey, count(*) FROM customer
    WHERE c_acctbal > 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY c_custkey
    """
)
def extended_orders_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the stored run's join left out: customers in debt are not delivered."""
    base = new_folder(spark, "zones")
    customers = table(spark, sf_dir, "customer").filter(F.col("c_acctbal") > 0)
    result = EXTENDED_ORDERS.run(raw_orders(spark, sf_dir), customers, base)
    return result.unmatched


@query(
    """
    WITH clean AS (
        SELECT o_custkey AS custkey, o_orderkey AS order_key, o_orderstatus AS order_status,
               CASE WHEN o_orderstatus = 'P' THEN -1.0::DOUBLE
                    WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice END AS total_price
        FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0)
    ), customers AS (
        SELECT c_custkey AS custkey, c_mktsegment AS market_segment,
               CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
                    THEN 0.0::DOUBLE ELSE c_acctbal END AS account_balance
        FROM customer
    ), joined AS (
        -- What is not run again keeps the customers as they were.
        SELECT custkey, order_key, order_status, total_price, c_mktsegment AS market_segment,
               CASE WHEN order_status = 'P' THEN 0.0::DOUBLE ELSE c_acctbal END AS account_balance
        FROM clean JOIN customer ON custkey = c_custkey
    )
    SELECT 'clean_left' AS zone, *, NULL::VARCHAR AS market_segment,
           NULL::DOUBLE AS account_balance, NULL::BIGINT AS n_rows FROM clean
    UNION ALL
    SELECT 'clean_right', custkey, NULL, NULL, NULL, market_segment, account_balance, NULL
    FROM customers
    UNION ALL SELECT 'extended', *, NULL FROM joined
    UNION ALL SELECT 'master', *, NULL FROM joined
    UNION ALL
    SELECT 'unmatched left', custkey, NULL, NULL, NULL, NULL, NULL, count(*) FROM clean
    WHERE custkey NOT IN (SELECT custkey FROM customers) GROUP BY custkey
    UNION ALL
    SELECT 'unmatched right', custkey, NULL, NULL, NULL, NULL, NULL, count(*) FROM customers
    WHERE custkey NOT IN (SELECT custkey FROM clean) GROUP BY custkey
    """
)
def extended_orders_rerun(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One partition is run again with half of its orders, other prices and other balances.

    The clean, extended and master tables keep the other partitions, and the
    keys left out are those of the whole clean zone.
    """
    base = new_folder(spark, "zones")
    orders, customers = raw_orders(spark, sf_dir), table(spark, sf_dir, "customer")
    keys = ["order_status"]
    EXTENDED_ORDERS.run(orders, customers, base, partition_by=keys)
    pending = orders.filter(F.col("Order status") == "P")
    theirs = customers.join(
        pending.select(F.col("Customer key").alias("c_custkey")), "c_custkey", "left_semi"
    ).withColumn("c_acctbal", F.lit(0.0))
    pending = pending.filter(F.col("Order key") % 2 == 1).withColumn(
        "Total price (USD)", F.lit("-1")
    )
    again = EXTENDED_ORDERS.run(
        pending, theirs, base, partition_by=keys, partitions=["order_status=P"]
    )
    zones = {
        "clean_left": again.left,
        "clean_right": again.right,
        "extended": again.extended,
        "master": again.master,
    }
    found = [df.withColumn("zone", F.lit(name)) for name, df in zones.items()]
    side = F.concat(F.lit("unmatched "), F.col("side")).alias("zone")
    found.append(again.unmatched.select(side, "custkey", "n_rows"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found)


@query(
    """
    SELECT 'raw_clean_orders' AS origin, count(*) AS n_rows FROM orders
    UNION ALL SELECT 'raw_clean_customers', count(*) FROM customer
    UNION ALL SELECT 'clean_orders', count(*) FROM orders
    UNION ALL SELECT 'clean_customers', count(*) FROM customer
    UNION ALL SELECT 'extended_orders', count(*)
    FROM orders JOIN customer ON o_custkey = c_custkey
    """
)
def extended_orders_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of the master table back to the raw ones, from the catalogue of the run."""
    base = new_folder(spark, "zones")
    result = EXTENDED_ORDERS.run(
        raw_orders(spark, sf_dir), table(spark, sf_dir, "customer"), base
    )
    catalog = Catalog(spark, f"{base}/catalog")
    names = catalog.read("entities").select(F.col("guid").alias("origin"), "type_name", "name")
    is_table = F.col("type_name") == "custom_delta_table"
    target = names.filter(is_table & (F.col("name") == EXTENDED_ORDERS.master_name))
    origins = catalog.origins(target.select(F.col("origin").alias("node")))
    counts = reduce(
        DataFrame.union,
        [
            counted(raw_orders(spark, sf_dir), "raw_clean_orders"),
            counted(table(spark, sf_dir, "customer"), "raw_clean_customers"),
            counted(result.left, "clean_orders"),
            counted(result.right, "clean_customers"),
            counted(result.extended, "extended_orders"),
        ],
    )
    found = origins.join(names.filter(is_table), "origin").select(F.col("name").alias("origin"))
    return found.join(counts, "origin")


def counted(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("origin"), "n_rows")


# -------------------------------------------------------------- catalogue

COLUMN_CATALOG_SQL = " UNION ALL ".join(
    f"""
    SELECT md5('column|pyapache://{name}_delta_table_column_{column}') AS guid,
           md5('custom_delta_table|pyapache://{name}_delta_table') AS table_guid,
           {ordinal} AS ordinal, '{column}' AS name, '{data_type}' AS data_type,
           'Column {column} has type {data_type}' AS description,
           count(*) AS n_rows, count(*) - count({column}) AS n_nulls
    FROM {name}
    """
    for name, columns in TABLES.items()
    for ordinal, (column, data_type) in enumerate(columns.items(), start=1)
)


@query(COLUMN_CATALOG_SQL)
def column_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered columns of all tables, with row and null counts."""
    frames = {name: table(spark, sf_dir, name) for name in TABLES}
    registration = register_tables(
        schema_rows(spark, frames), statistics=statistics_rows(frames)
    )
    statistics = registration.entities.filter(F.col("type_name") == "column").select(
        "guid",
        F.col("attributes")["n_rows"].cast("bigint").alias("n_rows"),
        F.col("attributes")["n_nulls"].cast("bigint").alias("n_nulls"),
    )
    return registration.columns.join(statistics, "guid")


REGISTERED_DATASETS_SQL = " UNION ALL ".join(
    f"""
    SELECT 'azure_datalake_gen2_resource_set' AS type_name, 'lake://{name}' AS qualified_name,
           md5('azure_datalake_gen2_resource_set|lake://{name}') AS guid, '{name}' AS name,
           count(*) AS n_rows, {len(columns)}::BIGINT AS n_columns
    FROM {name}
    """
    for name, columns in TABLES.items()
)


@query(REGISTERED_DATASETS_SQL)
def registered_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource sets with the columns reached through their schema entities."""
    frames = {name: table(spark, sf_dir, name) for name in TABLES}
    registration = register_resource_sets(
        schema_rows(spark, frames), {name: f"lake://{name}" for name in frames}
    )
    links = registration.relationships
    of_schema = links.filter(F.col("type_name") == "tabular_schema").select(
        F.col("end1_guid").alias("guid"), F.col("end2_guid").alias("schema_guid")
    )
    n_columns = (
        links.filter(F.col("type_name") == "composeSchema")
        .groupBy(F.col("end1_guid").alias("schema_guid"))
        .agg(F.count("*").alias("n_columns"))
    )
    sizes = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        sizes = one if sizes is None else sizes.union(one)
    return (
        registration.entities.join(of_schema, "guid")
        .join(n_columns, "schema_guid")
        .join(sizes, "name")
        .select("type_name", "qualified_name", "guid", "name", "n_rows", "n_columns")
    )


@query(
    """
    SELECT 'part' AS type_name, 'part://' || p_partkey AS qualified_name, p_name AS name,
           md5('part|part://' || p_partkey) AS guid FROM part
    UNION ALL SELECT 'supplier', 'supplier://' || s_suppkey, s_name,
           md5('supplier|supplier://' || s_suppkey) FROM supplier
    UNION ALL SELECT 'customer', 'customer://' || c_custkey, c_name,
           md5('customer|customer://' || c_custkey) FROM customer
    UNION ALL SELECT 'order', 'order://' || o_orderkey, o_orderpriority,
           md5('order|order://' || o_orderkey) FROM orders
    """
)
def entity_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(name: str, kind: str, key: str, label: str) -> DataFrame:
        return as_entities(table(spark, sf_dir, name), kind, key, label)

    entities = (
        of("part", "part", "p_partkey", "p_name")
        .union(of("supplier", "supplier", "s_suppkey", "s_name"))
        .union(of("customer", "customer", "c_custkey", "c_name"))
        .union(of("orders", "order", "o_orderkey", "o_orderpriority"))
    )
    return entities.select("type_name", "qualified_name", "name", "guid")


@query(
    """
    SELECT event_id, ts, user_id, event_type, value, props FROM events
    QUALIFY row_number() OVER (
        PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
    """
)
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_by_key(
        table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]
    )


@query(
    """
    SELECT event_type AS type_name, 'user://' || user_id AS qualified_name,
           md5(event_type || '|user://' || user_id) AS guid,
           ts AS seen_at, value AS seen_value, props->>'k' AS k
    FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC) = 1
    """
)
def entity_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two published versions: the first events of the month, then the rest."""
    events = table(spark, sf_dir, "events")
    entities = events.select(
        entity_guid(F.col("event_type"), keyed("user", "user_id")).alias("guid"),
        F.col("event_type").alias("type_name"),
        keyed("user", "user_id").alias("qualified_name"),
        F.col("user_id").cast("string").alias("name"),
        F.from_json("props", "map<string,string>").alias("attributes"),
        F.struct("ts", "value").alias("updated_at"),
    )
    is_early = F.col("updated_at.ts") < F.lit("2024-01-10").cast("timestamp_ntz")
    base = new_folder(spark, "catalog")
    first = publish_table(upsert(None, entities.filter(is_early)).merged, base, "entities")
    second = publish_table(upsert(first, entities.filter(~is_early)).merged, base, "entities")
    return second.select(
        "type_name",
        "qualified_name",
        "guid",
        F.col("updated_at.ts").alias("seen_at"),
        F.col("updated_at.value").alias("seen_value"),
        F.col("attributes")["k"].alias("k"),
    )


@query(
    """
    SELECT event_id, props->>'k' AS k FROM events
    WHERE event_type IN ('view', 'error') OR user_id IS NULL
    """
)
def entity_upsert_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack a part of the key are handed back with what they hold."""
    events = table(spark, sf_dir, "events")
    entities = events.select(
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("type_name"),
        F.when(F.col("event_type") != "view", keyed("user", "user_id")).alias("qualified_name"),
        "event_id",
        F.from_json("props", "map<string,string>").alias("attributes"),
        F.col("ts").alias("updated_at"),
    )
    rejected = upsert(None, entities).rejected
    return rejected.select("event_id", F.col("attributes")["k"].alias("k"))


@query(
    """
    SELECT DISTINCT 'part' AS type_name, 'part://' || l_partkey AS qualified_name,
           md5('part|part://' || p_partkey) AS guid, p_name AS name
    FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
    UNION ALL
    SELECT DISTINCT 'label', 'label://' || d.doc_id,
           md5('label|label://' || l.doc_id), l.quality::VARCHAR
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
    """
)
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look up the part of every line and the label of every document."""
    entities = as_entities(table(spark, sf_dir, "part"), "part", "p_partkey", "p_name").union(
        as_entities(
            table(spark, sf_dir, "labels").withColumn("name", F.col("quality").cast("string")),
            "label",
            "doc_id",
            "name",
        )
    )
    of_lines = table(spark, sf_dir, "lineitem").select(
        F.lit("part").alias("type_name"), keyed("part", "l_partkey").alias("qualified_name")
    )
    of_documents = table(spark, sf_dir, "documents").select(
        F.lit("label"), keyed("label", "doc_id")
    )
    requests = of_lines.union(of_documents)
    return resolve(requests, entities)


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships supplier -> part, once per pair that occurs in a line."""
    pairs = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return relationship_rows(
        pairs,
        "supplies",
        entity_guid(F.lit("supplier"), keyed("supplier", "l_suppkey")),
        entity_guid(F.lit("part"), keyed("part", "l_partkey")),
    )


SUPPLIES_SQL = """
    SELECT DISTINCT md5('supplier|supplier://' || l_suppkey) AS end1_guid,
           md5('part|part://' || l_partkey) AS end2_guid
    FROM lineitem
"""


@query(
    f"""
    WITH links AS ({SUPPLIES_SQL}), gone AS (
        SELECT md5('part|part://' || p_partkey) AS guid FROM part WHERE p_size < 10)
    SELECT 'entity' AS kind, md5('part|part://' || p_partkey) AS guid, p_name AS other
    FROM part WHERE NOT p_size < 10
    UNION ALL
    SELECT 'relationship', end1_guid, end2_guid FROM links
    WHERE end2_guid NOT IN (SELECT guid FROM gone)
    UNION ALL
    SELECT DISTINCT 'edge', md5('order|order://' || l_orderkey), md5('part|part://' || l_partkey)
    FROM lineitem WHERE md5('part|part://' || l_partkey) NOT IN (SELECT guid FROM gone)
    """
)
def entity_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete the small parts, and what touches them."""
    parts = table(spark, sf_dir, "part")
    entities = as_entities(parts, "part", "p_partkey", "p_name")
    gone = as_entities(parts.filter(F.col("p_size") < 10), "part", "p_partkey", "p_name")
    edges = (
        table(spark, sf_dir, "lineitem")
        .select(
            entity_guid(F.lit("order"), keyed("order", "l_orderkey")).alias("process_guid"),
            F.lit("input").alias("direction"),
            entity_guid(F.lit("part"), keyed("part", "l_partkey")).alias("entity_guid"),
        )
        .distinct()
    )
    kept, links, kept_edges = delete_entities(gone, entities, supplies(spark, sf_dir), edges)
    return (
        kept.select(F.lit("entity").alias("kind"), "guid", F.col("name").alias("other"))
        .union(links.select(F.lit("relationship"), "end1_guid", "end2_guid"))
        .union(kept_edges.select(F.lit("edge"), "process_guid", "entity_guid"))
    )


@query(
    """
    SELECT md5('part|part://' || p_partkey) AS guid FROM part
    WHERE p_size % 2 = 1 OR p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)
    UNION ALL SELECT DISTINCT md5('brand|brand://' || p_brand) FROM part
    WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)
    """
)
def entity_delete_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand contains its parts of even size, which go with it; others it only names."""
    parts = table(spark, sf_dir, "part")
    brands = parts.select("p_brand").distinct()
    entities = as_entities(parts, "part", "p_partkey", "p_name").unionByName(
        as_entities(brands, "brand", "p_brand", "p_brand")
    )
    links = parts.select(
        F.when(F.col("p_size") % 2 == 0, F.lit("custom_delta_table_columns"))
        .otherwise(F.lit("names"))
        .alias("type_name"),
        entity_guid(F.lit("brand"), keyed("brand", "p_brand")).alias("end1_guid"),
        entity_guid(F.lit("part"), keyed("part", "p_partkey")).alias("end2_guid"),
    )
    large = parts.filter(F.col("p_size") == 50).select("p_brand").distinct()
    named = as_entities(large, "brand", "p_brand", "p_brand").select("guid")
    gone = with_members(named, links, type_definitions(spark))
    no_edges = spark.createDataFrame([], "process_guid string, direction string, entity_guid string")
    kept, _, _ = delete_entities(gone, entities, links, no_edges)
    return kept.select("guid")


@query(
    """
    SELECT DISTINCT md5('supplies|' || md5('supplier|supplier://' || l_suppkey) || '|'
                        || md5('part|part://' || l_partkey)) AS guid,
           md5('supplier|supplier://' || l_suppkey) AS end1_guid,
           md5('part|part://' || l_partkey) AS end2_guid
    FROM lineitem
    WHERE (l_suppkey, l_partkey) IN (
        SELECT (l_suppkey, l_partkey) FROM lineitem WHERE l_returnflag = 'R')
    """
)
def relationship_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read the relationships that a returned line refers to."""
    returned = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    wanted = relationship_rows(
        returned.select("l_suppkey", "l_partkey").distinct(),
        "supplies",
        entity_guid(F.lit("supplier"), keyed("supplier", "l_suppkey")),
        entity_guid(F.lit("part"), keyed("part", "l_partkey")),
    )
    found = relationships_by_guid(wanted, supplies(spark, sf_dir))
    return found.select("guid", "end1_guid", "end2_guid")


@query(
    """
    SELECT event_id,
           CASE WHEN event_type = 'view' THEN 'custom_delta_table'
                ELSE 'custom_spark_job_process' END AS type_name,
           CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS job_type,
           CASE event_type WHEN 'signup' THEN 'daily' WHEN 'view' THEN NULL
                ELSE 'adHoc' END AS schedule,
           props->>'k' AS k,
           event_type <> 'error' AS accepted,
           CASE WHEN event_type = 'error' THEN 'job_type' ELSE '' END AS missing
    FROM events
    """
)
def attribute_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as tables, other events as processes; errors lack their job type."""
    event_type = F.col("event_type")
    given = F.map_concat(
        F.from_json("props", "map<string,string>"),
        F.create_map(F.lit("job_type"), F.when(event_type != "error", event_type)),
    )
    entities = entity_rows(
        table(spark, sf_dir, "events"),
        F.when(event_type == "view", F.lit("custom_delta_table")).otherwise(
            F.lit("custom_spark_job_process")
        ),
        keyed("event", "event_id"),
        F.col("event_id").cast("string"),
        F.when(
            event_type == "signup",
            F.map_concat(given, F.create_map(F.lit("schedule"), F.lit("daily"))),
        ).otherwise(given),
    )
    checked = apply_attribute_rules(entities, type_definitions(spark))
    return checked.select(
        F.col("name").cast("bigint").alias("event_id"),
        "type_name",
        F.col("attributes")["job_type"].alias("job_type"),
        F.col("attributes")["schedule"].alias("schedule"),
        F.col("attributes")["k"].alias("k"),
        (F.size("missing") == 0).alias("accepted"),
        F.concat_ws(",", "missing").alias("missing"),
    )


@query(
    """
    WITH brands AS (
        SELECT p_brand AS name, count(*) AS n_parts FROM part GROUP BY p_brand
    ), kinds AS (SELECT p_type AS name, count(*) AS n_parts FROM part GROUP BY p_type)
    SELECT name, 'brand' AS category, n_parts FROM brands
    WHERE name NOT IN (SELECT DISTINCT p_brand FROM part WHERE p_size = 50)
    UNION ALL SELECT p_brand, 'brand of large parts', count(*)
    FROM part WHERE p_size = 50 GROUP BY p_brand
    UNION ALL SELECT name, 'kind', n_parts FROM kinds
    """
)
def type_definition_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type per brand; then types per kind, and a forced update of some brands."""
    parts = table(spark, sf_dir, "part")

    def definitions(df: DataFrame, name: str, category: str) -> DataFrame:
        return (
            df.groupBy(F.col(name).alias("name"))
            .agg(F.count("*").cast("string").alias("n_parts"))
            .select(
                "name",
                F.lit(category).alias("category"),
                F.create_map(F.lit("n_parts"), F.col("n_parts")).alias("options"),
            )
        )

    base = new_folder(spark, "catalog")
    first = publish_table(definitions(parts, "p_brand", "brand"), base, "type_defs")
    update = definitions(parts, "p_type", "kind").union(
        definitions(parts.filter(F.col("p_size") == 50), "p_brand", "brand of large parts")
    )
    publish_table(replace_by_key(first, update, ["name"]), base, "type_defs")
    return read_table(spark, base, "type_defs").select(
        "name", "category", F.col("options")["n_parts"].cast("bigint").alias("n_parts")
    )


@query(
    """
    SELECT 'custom_delta_table_columns' AS type_name,
           md5('part|part://' || l_partkey) AS end2_guid,
           count(DISTINCT l_suppkey) AS n_containers
    FROM lineitem WHERE l_returnflag <> 'N'
    GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 1
    """
)
def relationship_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that would be members of more than one supplier.

    Lines of the flag N form links of a type without a definition, and so
    without a rule.
    """
    links = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", F.lit("unrestricted"))
        .otherwise(F.lit("custom_delta_table_columns"))
        .alias("type_name"),
        entity_guid(F.lit("supplier"), keyed("supplier", "l_suppkey")).alias("end1_guid"),
        entity_guid(F.lit("part"), keyed("part", "l_partkey")).alias("end2_guid"),
    )
    return cardinality_violations(links, type_definitions(spark))


@query(
    """
    WITH a AS (
        SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem
        WHERE l_returnflag = 'A' AND l_quantity <= 3
    ), r AS (
        SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM lineitem
        WHERE l_returnflag = 'R' AND l_quantity <= 3
    ), kept AS (
        SELECT * FROM a WHERE p IN (SELECT p FROM a GROUP BY p HAVING count(*) = 1)
    ), clash AS (
        SELECT p FROM (SELECT * FROM r UNION SELECT * FROM kept) GROUP BY p HAVING count(*) > 1
    ), late AS (
        SELECT s, p FROM r WHERE p NOT IN (SELECT p FROM clash)
    ), told AS (
        SELECT 'stored' AS kind, s, p FROM kept UNION SELECT 'stored', s, p FROM late
        UNION ALL SELECT 'refused first', s, p FROM a WHERE (s, p) NOT IN (SELECT (s, p) FROM kept)
        UNION ALL SELECT 'refused later', s, p FROM r
        WHERE p IN (SELECT p FROM clash) AND (s, p) NOT IN (SELECT (s, p) FROM kept)
    )
    SELECT kind, md5('supplier|supplier://' || s) AS end1_guid, md5('part|part://' || p) AS end2_guid
    FROM told
    """
)
def relationship_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writes of links under a rule of one supplier for a part: what is stored, what refused."""
    catalog = Catalog(spark, new_folder(spark, "catalog"))
    catalog.define_types()
    lines = table(spark, sf_dir, "lineitem").filter(F.col("l_quantity") <= 3)

    def put(flag: str) -> DataFrame:
        pairs = lines.filter(F.col("l_returnflag") == flag).select("l_suppkey", "l_partkey")
        return catalog.put_relationships(
            relationship_rows(
                pairs,
                "custom_delta_table_columns",
                entity_guid(F.lit("supplier"), keyed("supplier", "l_suppkey")),
                entity_guid(F.lit("part"), keyed("part", "l_partkey")),
            )
        )

    found = {"refused first": put("A"), "refused later": put("R")}
    found["stored"] = catalog.read("relationships")
    return reduce(
        DataFrame.union,
        [df.select(F.lit(kind).alias("kind"), "end1_guid", "end2_guid") for kind, df in found.items()],
    )


@query(
    """
    SELECT event_id, event_type AS type_name,
           CASE WHEN event_type = 'error' THEN NULL ELSE props->>'k' END AS k,
           CASE WHEN event_type = 'click' THEN 'hourly' ELSE 'adHoc' END AS schedule,
           CASE WHEN event_type IN ('click', 'view') THEN 'web' END AS channel,
           concat_ws(',', CASE WHEN event_type = 'error' THEN 'k' END,
                     CASE WHEN event_type IN ('click', 'view') AND event_id % 3 = 0
                          THEN 'session' END) AS missing
    FROM events
    """
)
def inherited_attribute_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types under rules of their super types, two levels up.

    All need ``k`` and have a schedule, from the type at the top; clicks and
    views are on the web, where a session is needed, and clicks have another
    schedule of their own.
    """

    def rule(name: str, is_optional: bool, default: str | None = None) -> str:
        value = "NULL" if default is None else f"'{default}'"
        return f"named_struct('name', '{name}', 'is_optional', {str(is_optional).lower()}, 'default_value', {value})"

    def rules(*some: str) -> str:
        return f"CAST(array({', '.join(some)}) AS array<struct<name:string,is_optional:boolean,default_value:string>>)"

    top = rules(rule("k", False), rule("schedule", True, "adHoc"))
    web = rules(rule("session", False), rule("channel", True, "web"))
    by_name = (
        f"CASE name WHEN 'top' THEN {top} WHEN 'web' THEN {web} "
        f"WHEN 'click' THEN {rules(rule('schedule', True, 'hourly'))} ELSE {rules()} END"
    )
    above = "CASE WHEN name = 'top' THEN array() WHEN name IN ('click', 'view') THEN array('web') ELSE array('top') END"
    events = table(spark, sf_dir, "events")
    names = events.select(F.col("event_type").alias("name")).distinct()
    names = names.union(spark.sql("SELECT explode(array('top', 'web'))"))
    empty = type_definitions(spark).limit(0)
    definitions = empty.unionByName(
        names.select(
            "name",
            F.lit("ENTITY").alias("category"),
            F.expr(above).cast("array<string>").alias("super_types"),
            F.expr(by_name).alias("attribute_defs"),
        ),
        allowMissingColumns=True,
    )
    given = F.from_json("props", "map<string,string>")
    session = F.when(F.col("event_id") % 3 != 0, F.lit("s"))
    given = F.map_concat(
        F.map_filter(given, lambda key, _: (key == "k") & (F.col("event_type") != "error")),
        F.create_map(F.lit("session"), session),
    )
    entities = entity_rows(
        events, F.col("event_type"), keyed("event", "event_id"), F.col("event_id").cast("string"), given
    )
    checked = apply_attribute_rules(entities, inherited_type_defs(definitions))
    return checked.select(
        F.col("name").cast("bigint").alias("event_id"),
        "type_name",
        *[F.col("attributes")[name].alias(name) for name in ("k", "schedule", "channel")],
        F.concat_ws(",", F.sort_array("missing")).alias("missing"),
    )


# ---------------------------------------------------------------- lineage


@query(
    """
    SELECT md5('order|order://' || l_orderkey) AS process_guid, 'input' AS direction,
           md5('part|part://' || p_partkey) AS entity_guid
    FROM lineitem JOIN part ON l_partkey = p_partkey
    UNION
    SELECT md5('order|order://' || o_orderkey), 'output', md5('customer|customer://' || c_custkey)
    FROM orders JOIN customer ON o_custkey = c_custkey
    """
)
def lineage_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order takes parts in and gives to a customer."""
    references = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_orderkey").cast("string").alias("process_name"),
            F.lit("input").alias("direction"),
            F.lit("part").alias("type_name"),
            keyed("part", "l_partkey").alias("qualified_name"),
        )
        .union(
            table(spark, sf_dir, "orders").select(
                F.col("o_orderkey").cast("string"),
                F.lit("output"),
                F.lit("customer"),
                keyed("customer", "o_custkey"),
            )
        )
    )
    entities = as_entities(table(spark, sf_dir, "part"), "part", "p_partkey", "p_name").union(
        as_entities(table(spark, sf_dir, "customer"), "customer", "c_custkey", "c_name")
    )
    return record_lineage(references, entities, process_type="order", scheme="order").edges


@query(
    """
    SELECT 'edge' AS kind, md5('check|check://' || doc_id) AS process, direction,
           md5(kind || '|' || kind || '://' || doc_id) AS entity
    FROM documents, (VALUES ('input', 'document'), ('output', 'label')) AS v(direction, kind)
    WHERE doc_id IN (SELECT doc_id FROM labels)
    UNION ALL
    SELECT 'unresolved', doc_id::VARCHAR, 'output', 'label://' || doc_id
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    """
)
def lineage_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is checked into a label; those without one are refused."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").withColumn("name", F.col("quality").cast("string"))
    sides = F.array(
        F.struct(
            F.lit("input").alias("direction"),
            F.lit("document").alias("type_name"),
            keyed("document", "doc_id").alias("qualified_name"),
        ),
        F.struct(
            F.lit("output").alias("direction"),
            F.lit("label").alias("type_name"),
            keyed("label", "doc_id").alias("qualified_name"),
        ),
    )
    references = documents.select(
        F.col("doc_id").cast("string").alias("process_name"), F.inline(sides)
    )
    entities = as_entities(documents, "document", "doc_id", "lang").union(
        as_entities(labels, "label", "doc_id", "name")
    )
    lineage = record_lineage(references, entities, process_type="check", scheme="check")
    return lineage.edges.select(
        F.lit("edge").alias("kind"),
        F.col("process_guid").alias("process"),
        "direction",
        F.col("entity_guid").alias("entity"),
    ).union(
        lineage.unresolved.select(
            F.lit("unresolved"), "process_name", "direction", "qualified_name"
        )
    )


ORIGIN_HOPS_SQL = """
    WITH RECURSIVE hops AS (
        SELECT 'order://' || o_orderkey AS node, 'customer://' || o_custkey AS origin FROM orders
        UNION SELECT 'customer://' || c_custkey, 'nation://' || c_nationkey FROM customer
        UNION SELECT 'supplier://' || s_suppkey, 'nation://' || s_nationkey FROM supplier
        UNION SELECT 'nation://' || n_nationkey, 'region://' || n_regionkey FROM nation
    ), reached AS (
        SELECT node, origin, 1 AS n_hops FROM hops
        UNION
        SELECT reached.node, hops.origin, n_hops + 1
        FROM reached JOIN hops ON reached.origin = hops.node
    )
    SELECT node, origin, min(n_hops) AS n_hops FROM reached
"""


def origin_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders come from customers, these and suppliers from nations, of regions."""

    def hops(name: str, node: str, node_key: str, origin: str, origin_key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            keyed(node, node_key).alias("node"), keyed(origin, origin_key).alias("origin")
        )

    return (
        hops("orders", "order", "o_orderkey", "customer", "o_custkey")
        .union(hops("customer", "customer", "c_custkey", "nation", "c_nationkey"))
        .union(hops("supplier", "supplier", "s_suppkey", "nation", "s_nationkey"))
        .union(hops("nation", "nation", "n_nationkey", "region", "n_regionkey"))
    )


@query(ORIGIN_HOPS_SQL + "WHERE node LIKE 'order://%' GROUP BY node, origin")
def lineage_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All origins of the orders, over all hops."""
    targets = table(spark, sf_dir, "orders").select(keyed("order", "o_orderkey").alias("node"))
    return trace_origins(origin_hops(spark, sf_dir), targets)


@query(
    ORIGIN_HOPS_SQL
    + "WHERE n_hops <= 2 AND (node LIKE 'customer://%' OR node LIKE 'supplier://%') "
    "GROUP BY node, origin"
)
def lineage_shallow_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions of customers and suppliers, by one recursive query."""
    targets = table(spark, sf_dir, "customer").select(keyed("customer", "c_custkey").alias("node"))
    targets = targets.union(
        table(spark, sf_dir, "supplier").select(keyed("supplier", "s_suppkey").alias("node"))
    )
    return shallow_origins(origin_hops(spark, sf_dir), targets, 2)


@query(
    """
    SELECT 'rejected' AS kind, doc_id::VARCHAR AS name FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'unresolved', doc_id::VARCHAR FROM documents
    WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    """
)
def lineage_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes that lack a required attribute are handed back, and no edge is stored."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = table(spark, sf_dir, "labels").withColumn("name", F.col("quality").cast("string"))
    catalog = Catalog(spark, new_folder(spark, "catalog"))
    required = type_definitions(spark).withColumn(
        "attribute_defs",
        F.when(
            F.col("name") == "custom_spark_job_process",
            F.transform(
                "attribute_defs",
                lambda rule: F.struct(
                    F.lit("owner").alias("name"),
                    F.lit(False).alias("is_optional"),
                    F.lit(None).cast("string").alias("default_value"),
                ),
            ),
        ).otherwise(F.col("attribute_defs")),
    )
    catalog.define_types(required)
    catalog.put_entities(
        as_entities(documents, "document", "doc_id", "lang").unionByName(
            as_entities(labels, "label", "doc_id", "name")
        )
    )
    references = documents.select(
        F.col("doc_id").cast("string").alias("process_name"),
        F.inline(
            F.array(
                F.struct(
                    F.lit("input").alias("direction"),
                    F.lit("document").alias("type_name"),
                    keyed("document", "doc_id").alias("qualified_name"),
                ),
                F.struct(
                    F.lit("output").alias("direction"),
                    F.lit("label").alias("type_name"),
                    keyed("label", "doc_id").alias("qualified_name"),
                ),
            )
        ),
    )
    recorded = catalog.record_references(references)
    stored = catalog.read("lineage_edges").select(F.lit("edge"), "process_guid")
    return (
        recorded.rejected.select(F.lit("rejected").alias("kind"), "name")
        .union(recorded.unresolved.select(F.lit("unresolved"), "process_name"))
        .union(stored)
    )


@query(ORIGIN_HOPS_SQL + "WHERE node LIKE 'supplier://%' GROUP BY node, origin")
def lineage_of_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The origins of the suppliers only; other nodes are not traced."""
    targets = table(spark, sf_dir, "supplier").select(keyed("supplier", "s_suppkey").alias("node"))
    return trace_origins(origin_hops(spark, sf_dir), targets)


# -------------------------------------------------------------- inventory


@query(
    """
    SELECT name, n_files, n_bytes FROM (
        SELECT 'parts' AS name, 4::BIGINT AS n_files, sum(strlen(p_name) + 1)::BIGINT AS n_bytes
        FROM part
        UNION ALL SELECT 'customers', 2, sum(strlen(c_name) + 1)::BIGINT FROM customer
    )
    """
)
def inventory_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes of two text tables; a line has its bytes and a line feed."""
    path, base = new_folder(spark, "lines"), new_folder(spark, "inventory")
    table(spark, sf_dir, "part").select("p_name").repartition(4).write.text(f"{path}/parts")
    table(spark, sf_dir, "customer").select("c_name").repartition(2).write.text(f"{path}/customers")
    files = scan(spark, path, base, FULL, "*.txt", "lines")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("name")).agg(
        F.count("*").alias("n_files"), F.sum("n_bytes").alias("n_bytes")
    )


# As many folders as the listing is dealt over several times.
FOLDERS = 1200


@query(
    f"""
    SELECT k AS folder, 1::BIGINT AS n_files, n AS n_events, true AS is_stored FROM (
        SELECT event_id % {FOLDERS} AS k, count(*) AS n FROM events GROUP BY k
    )
    """
)
def inventory_of_many_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a thousand folders listed by many tasks; every file is one that holds its events."""
    path = new_folder(spark, "folders")
    events = table(spark, sf_dir, "events").select(
        "event_id", (F.col("event_id") % FOLDERS).alias("k")
    )
    overwrite(events.repartition(8, "k"), path, partition_by=["k"], even=False)
    files = file_inventory(spark, path, "*.parquet", tasks=32)
    rows = (
        read_parquet(spark, path)
        .groupBy(F.col("_metadata.file_path").alias("stored"), F.col("_metadata.file_size").alias("size"))
        .agg(F.count("*").alias("n_events"))
    )
    # Both sides name a local file with one or three slashes.
    bare = lambda name: F.regexp_replace(name, "^file:/+", "/")
    found = files.join(rows, bare("path") == bare("stored"), "full")
    return found.groupBy(
        F.regexp_extract("path", r"/k=(\d+)/[^/]*$", 1).cast("bigint").alias("folder")
    ).agg(
        F.count("path").alias("n_files"),
        F.sum("n_events").alias("n_events"),
        F.min(F.col("n_bytes").eqNullSafe(F.col("size"))).alias("is_stored"),
    )


@query(
    """
    WITH numbered AS (
        SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day, dayofyear(ts) % 4 AS place FROM events
    )
    SELECT 0::BIGINT AS batch, day, 'added' AS change FROM numbered WHERE place <> 0
    UNION ALL SELECT 1, day, 'added' FROM numbered WHERE place = 0
    UNION ALL SELECT 1, day, 'changed' FROM numbered WHERE place = 1
    UNION ALL SELECT 2, day, 'removed' FROM numbered WHERE place = 2
    """
)
def inventory_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three triggers of a scan as a stream, begun anew each time: added, changed, removed.

    The folders are the days of the events, one file each. A quarter of them
    comes late, one grows, and one is removed.
    """
    path, base = new_folder(spark, "days"), new_folder(spark, "inventory")
    lines = table(spark, sf_dir, "events").select(
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        (F.dayofyear("ts") % 4).alias("place"),
        F.col("event_id").cast("string").alias("line"),
    )

    def put(rows: DataFrame) -> None:
        text = rows.select("day", "line").repartition(4, "day")
        text.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "day"
        ).text(path)

    put(lines.filter("place <> 0"))
    scan(spark, path, base, name="days")
    put(lines.filter("place = 0"))
    put(lines.filter("place = 1").withColumn("line", F.concat("line", F.lit(" and more"))))
    scan(spark, path, base, name="days")
    for row in lines.filter("place = 2").select("day").distinct().collect():
        remove_folder(spark, f"{path}/day={row.day}")
    scan(spark, path, base, name="days")
    changes = spark.read.parquet(f"{base}/days/changes")
    # A file written anew has another name: in its folder one goes and one comes.
    return (
        changes.groupBy("batch", F.regexp_extract("path", r"day=([^/]+)", 1).alias("day"))
        .agg(F.collect_set("change").alias("kinds"), F.max("change").alias("change"))
        .select(
            F.col("batch").cast("bigint").alias("batch"),
            "day",
            F.when(F.size("kinds") == 2, "changed").otherwise(F.col("change")).alias("change"),
        )
    )


@query(
    """
    SELECT 'lineitem' AS name, count(*) AS n_directories FROM (
        SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)
    UNION ALL SELECT 'orders', count(DISTINCT o_orderstatus) FROM orders
    UNION ALL SELECT 'events', 1 FROM events HAVING count(*) > 0
    """
)
def scanned_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanned resource sets are entities that a lookup by the default type finds."""
    path, catalog = new_folder(spark, "sets"), Catalog(spark, new_folder(spark, "catalog"))
    for name, keys in (
        ("lineitem", ["l_returnflag", "l_linestatus"]),
        ("orders", ["o_orderstatus"]),
        ("events", []),
    ):
        overwrite(table(spark, sf_dir, name), f"{path}/{name}", partition_by=keys)
    files = catalog.scan(path, FULL, "*.parquet", "sets")
    sets = resource_sets(files)
    found = catalog.resolve(sets.select(F.col("resource_set").alias("qualified_name")))
    return found.filter(F.col("guid").isNotNull()).join(
        sets, F.col("qualified_name") == F.col("resource_set")
    ).select("name", "n_directories")


# Files of a table that does not exist, made up from the rows of one that does.
EVENT_FILES_SQL = """
    SELECT 'lake/events/event_type=' || event_type || '/day=' || strftime(ts, '%Y-%m-%d')
               || '/part-' || event_id AS path,
           'lake/events' AS resource_set,
           event_type || '/' || strftime(ts, '%Y-%m-%d') AS directory,
           ts AS modified_at, user_id AS n_bytes
    FROM events
"""


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.concat_ws(
            "/",
            F.lit("lake/events"),
            F.concat(F.lit("event_type="), "event_type"),
            F.concat(F.lit("day="), F.date_format("ts", "yyyy-MM-dd")),
            F.concat(F.lit("part-"), F.col("event_id").cast("string")),
        ).alias("path"),
        F.col("ts").alias("modified_at"),
        F.col("user_id").alias("n_bytes"),
    )


@query(
    f"""
    SELECT resource_set, count(DISTINCT directory) AS n_directories, count(*) AS n_files,
           sum(n_bytes)::BIGINT AS n_bytes, max(modified_at) AS modified_at
    FROM ({EVENT_FILES_SQL}) GROUP BY resource_set
    """
)
def resource_set_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partitioned table of very many part files, shown as one asset."""
    return resource_sets(event_files(spark, sf_dir))


@query(
    """
    WITH files AS (
        SELECT 'lake/raw/' || event_type || '/{date}/part-{n}-{id}.json' AS pattern,
               event_type || strftime(ts, '%Y-%m-%d') AS directory, user_id AS n_bytes,
               ts AS modified_at
        FROM events
        UNION ALL
        SELECT 'lake/orders_v{n}/status={value}/' || lower(o_orderpriority[3:]) || '_{date}.csv',
               o_orderstatus || o_orderkey % 3, o_custkey, o_orderdate
        FROM orders
    )
    SELECT pattern, count(DISTINCT directory) AS n_directories, count(*) AS n_files,
           sum(n_bytes)::BIGINT AS n_bytes, max(modified_at) AS modified_at
    FROM files GROUP BY pattern
    """
)
def resource_sets_by_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of daily folders, hashed names, versions and partitions, found to be few assets."""
    events = table(spark, sf_dir, "events").select(
        F.concat(
            F.lit("lake/raw/"),
            "event_type",
            F.date_format("ts", "'/'yyyy-MM-dd'/part-'"),
            F.lpad(F.col("event_id").cast("string"), 9, "0"),
            F.lit("-"),
            F.md5(F.col("event_id").cast("string")),
            F.lit(".json"),
        ).alias("path"),
        F.col("ts").alias("modified_at"),
        F.col("user_id").alias("n_bytes"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.concat(
            F.lit("lake/orders_v"),
            (F.col("o_orderkey") % 3).cast("string"),
            F.lit("/status="),
            "o_orderstatus",
            F.lit("/"),
            F.lower(F.substring("o_orderpriority", 3, 99)),
            F.date_format("o_orderdate", "_yyyyMMdd'.csv'"),
        ).alias("path"),
        F.col("o_orderdate").alias("modified_at"),
        F.col("o_custkey").alias("n_bytes"),
    )
    return pattern_sets(events.unionByName(orders))


@query(
    """
    SELECT 'order-' || o_orderkey AS path,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'added'
                WHEN o_orderpriority = '5-LOW' THEN 'removed' ELSE 'changed' END AS change,
           CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderdate END AS modified_at,
           CASE WHEN o_orderpriority <> '5-LOW'
                THEN o_custkey + (o_orderstatus = 'P')::INTEGER END AS n_bytes
    FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '5-LOW') OR o_orderstatus = 'P'
    """
)
def inventory_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots made of orders: urgent files are new, low ones gone, pending ones grew."""
    orders = table(spark, sf_dir, "orders")
    files = orders.select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderdate").alias("modified_at"),
        F.col("o_custkey").alias("n_bytes"),
        "o_orderpriority",
        (F.col("o_orderstatus") == "P").cast("int").alias("grown"),
    )
    before = files.filter(F.col("o_orderpriority") != "1-URGENT")
    after = files.filter(F.col("o_orderpriority") != "5-LOW").withColumn(
        "n_bytes", F.col("n_bytes") + F.col("grown")
    )
    return compare_snapshots(before, after)


@query(
    """
    SELECT scan, 'event_type=' || event_type AS directory, min(change) AS change FROM (
        SELECT 'late' AS scan, event_type, 'added' AS change FROM events
        WHERE event_type = 'purchase'
        UNION ALL SELECT 'other', event_type, 'added' FROM events WHERE event_type = 'purchase'
    ) GROUP BY scan, event_type
    """
)
def inventory_new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incremental scans of two paths under two names do not disturb each other."""
    events = table(spark, sf_dir, "events")
    path, base = new_folder(spark, "partitioned"), new_folder(spark, "inventory")
    purchases = F.col("event_type") == "purchase"
    found = None
    for name in ("late", "other"):
        overwrite(events.filter(~purchases), f"{path}/{name}", partition_by=["event_type"])
        scan(spark, f"{path}/{name}", base, INCREMENTAL, "*.parquet", name)
        overwrite_partitions(events.filter(purchases), f"{path}/{name}", ["event_type"])
    for name in ("late", "other"):
        files = scan(spark, f"{path}/{name}", base, INCREMENTAL, "*.parquet", name)
        files = files.select(
            F.lit(name).alias("scan"),
            F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("directory"),
            "change",
        ).distinct()
        found = files if found is None else found.unionByName(files)
    return found


# ---------------------------------------------------------------- profile


def profile_sql(name: str) -> str:
    parts = []
    for ordinal, (column, data_type) in enumerate(TABLES[name].items(), start=1):
        ordered = data_type != "string"
        # Only the digits of a double are written in different ways.
        text = "::DECIMAL(18,2)::VARCHAR" if data_type == "double" else "::VARCHAR"
        parts.append(
            f"""
            SELECT {ordinal} AS ordinal, '{column}' AS column_name, count(*) AS n_rows,
                   count(*) - count({column}) AS n_nulls,
                   {f'min({column}){text}' if ordered else 'NULL::VARCHAR'} AS least,
                   {f'max({column}){text}' if ordered else 'NULL::VARCHAR'} AS greatest
            FROM {name}
            """
        )
    return " UNION ALL ".join(parts)


@query(profile_sql("lineitem"))
def column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact whole numbers, decimals and times; free text has no range."""
    lines = table(spark, sf_dir, "lineitem")
    doubles = [name for name, data_type in lines.dtypes if data_type == "double"]
    exact = lines.withColumns({name: F.col(name).cast("decimal(18,2)") for name in doubles})
    return column_profile(exact)


@query(
    " UNION ALL ".join(
        f"SELECT {i} AS ordinal, '{column}' AS column_name, count(*) AS n_rows, true AS is_close "
        "FROM orders"
        for i, column in enumerate(TABLES["orders"], start=1)
    )
)
def column_distinct_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates within five standard deviations of the exact counts."""
    orders, rsd = table(spark, sf_dir, "orders"), 0.02
    exact = orders.agg(*[F.count_distinct(c).alias(c) for c in orders.columns])
    counts = exact.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_exact"))
                    for c in orders.columns
                ]
            )
        )
    )
    close = F.abs(F.col("n_distinct") - F.col("n_exact")) <= 5 * rsd * F.col("n_exact")
    return (
        column_profile(orders, distinct_rsd=rsd)
        .join(counts, "column_name")
        .select("ordinal", "column_name", "n_rows", close.alias("is_close"))
    )


def kept_statistics_sql() -> str:
    """Of the rows that are left after the rerun: returned lines of more than 25 pieces."""
    kept = "l_returnflag <> 'R' OR l_quantity > 25"
    return (
        profile_sql("lineitem")
        .replace("FROM lineitem", f"FROM lineitem WHERE {kept}")
        .replace(" AS n_nulls,", " AS n_nulls, true AS distinct_is_close, true AS median_is_close,")
    )


def exact_figures(df: DataFrame, medians: dict[str, float | None]) -> DataFrame:
    """Distinct values of every column, and the shares of values below and up to its median.

    Each column is counted by value on its own: a task reads that column alone
    and shuffles a row per value it has seen, where distinct counts together
    would repeat every row for each column.
    """
    found = []
    for name in df.columns:
        counts = df.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
        value, n = F.col("value"), F.when(F.col("value").isNotNull(), F.col("n"))
        below = above = F.lit(None).cast("double")
        if medians[name] is not None:
            number = value.cast("double")
            below = F.sum(F.when(number < medians[name], n).otherwise(0)) / F.sum(n)
            above = F.sum(F.when(number <= medians[name], n).otherwise(0)) / F.sum(n)
        found.append(
            counts.agg(F.count("value").alias("n_exact"), below.alias("below"), above.alias("above"))
            .select(F.lit(name).alias("column_name"), "n_exact", "below", "above")
        )
    return reduce(DataFrame.unionByName, found)


@query(kept_statistics_sql())
def merged_column_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics after a rerun of one partition, merged from sketches and read from the catalogue.

    Estimates are held against exact figures of the whole stored table: five
    standard deviations for distinct counts, the rank error for the median.
    """
    path, catalog = new_folder(spark, "lines"), Catalog(spark, new_folder(spark, "catalog"))
    lines = table(spark, sf_dir, "lineitem")
    doubles = [name for name, data_type in lines.dtypes if data_type == "double"]
    lines = lines.withColumns({name: F.col(name).cast("decimal(18,2)") for name in doubles})
    keys, order = ["l_returnflag"], lines.columns
    overwrite(lines, path, partition_by=keys)
    stored = read_parquet(spark, path).select(*order)
    catalog.update_statistics("lines", stored, keys)
    returned = lines.filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 25))
    overwrite_partitions(returned, path, keys)
    stored = read_parquet(spark, path).select(*order)
    merged = catalog.update_statistics("lines", stored, keys, ["l_returnflag=R"])
    told = catalog.read("entities").join(merged.select("guid", "ordinal"), "guid").select(
        "ordinal",
        F.col("name").alias("column_name"),
        *[F.col("attributes")[n].alias(n) for n in ("n_rows", "n_nulls", "least", "greatest")],
        F.col("attributes")["n_distinct"].cast("bigint").alias("n_distinct"),
        F.from_json(F.col("attributes")["quantiles"], "array<double>")[1].alias("median"),
    )
    medians = {row.column_name: row.median for row in told.select("column_name", "median").collect()}
    exact = exact_figures(stored, medians)
    close = F.abs(F.col("n_distinct") - F.col("n_exact")) <= F.greatest(
        5 * DISTINCT_RSD * F.col("n_exact"), F.lit(1)
    )
    middle = (F.col("below") <= 0.5 + QUANTILE_ERROR) & (F.col("above") >= 0.5 - QUANTILE_ERROR)
    return told.join(exact, "column_name").select(
        "ordinal",
        "column_name",
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("n_nulls").cast("bigint").alias("n_nulls"),
        close.alias("distinct_is_close"),
        F.coalesce(middle, F.lit(True)).alias("median_is_close"),
        "least",
        "greatest",
    )
