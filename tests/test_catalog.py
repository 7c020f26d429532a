import hashlib
import json
from datetime import datetime
from pathlib import Path

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeclerk import Catalog
from lakeclerk.catalog import Job
from lakeclerk.operators import store
from lakeclerk.operators import (
    apply_attribute_rules,
    cardinality_violations,
    delete_entities,
    inherited_type_defs,
    latest_by_key,
    lineage_references,
    profile_attributes,
    column_profile,
    publish_table,
    read_table,
    record_lineage,
    relationship_rows,
    register_resource_sets,
    register_tables,
    relationships_by_guid,
    replace_by_key,
    resolve,
    schema_rows,
    statistics_rows,
    type_definitions,
    upsert,
)
from lakeclerk.operators.catalog import ENTITIES_DDL, TYPE_DEFS_DDL


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture
def languages(spark):
    rows = [("Java", 20000), ("Python", 100000), ("Scala", 3000)]
    return spark.createDataFrame(rows, "language string, users_count bigint")


def test_register_table(spark, languages):
    registration = register_tables(schema_rows(spark, {"lang": languages}))
    table_name = "pyapache://lang_delta_table"
    table = md5(f"custom_delta_table|{table_name}")
    entities = {row.qualified_name: row for row in registration.entities.collect()}
    assert set(entities) == {
        table_name,
        f"{table_name}_column_language",
        f"{table_name}_column_users_count",
    }
    assert entities[table_name].guid == table
    column = entities[f"{table_name}_column_users_count"]
    assert column.type_name == "column" and column.name == "users_count"
    assert column.attributes == {
        "type": "bigint",
        "description": "Column users_count has type bigint",
    }
    columns = registration.columns.orderBy("ordinal").collect()
    assert [(c.ordinal, c.name, c.table_guid) for c in columns] == [
        (1, "language", table),
        (2, "users_count", table),
    ]
    links = registration.relationships.collect()
    assert {link.end1_guid for link in links} == {table}
    assert {link.end2_guid for link in links} == {c.guid for c in columns}
    assert {link.type_name for link in links} == {"custom_delta_table_columns"}


def test_scheme_is_a_parameter(spark, languages):
    registration = register_tables(schema_rows(spark, {"lang": languages}), scheme="lake")
    assert registration.entities.filter("qualified_name LIKE 'lake://lang%'").count() == 3


def test_register_resource_set_has_three_levels(spark, languages):
    registration = register_resource_sets(
        schema_rows(spark, {"input1": languages}), {"input1": "lake://input1"}
    )
    kinds = {row.type_name: row["count"] for row in registration.entities.groupBy("type_name").count().collect()}
    assert kinds == {"azure_datalake_gen2_resource_set": 1, "tabular_schema": 1, "column": 2}
    links = {(row.type_name, row.end1_guid, row.end2_guid) for row in registration.relationships.collect()}
    top = md5("azure_datalake_gen2_resource_set|lake://input1")
    schema = md5("tabular_schema|lake://input1_tabular_schema")
    assert ("tabular_schema", top, schema) in links
    for name in ("language", "users_count"):
        assert ("composeSchema", schema, md5(f"column|lake://input1_column_{name}")) in links


def test_type_names_of_test_data_types(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01' AS t, array(1.0f) AS a")
    rows = schema_rows(spark, {"t": df}).orderBy("ordinal").collect()
    assert [row.data_type for row in rows] == ["timestamp_ntz", "array<float>"]


def entity(kind, name, attributes, day):
    guid = md5(f"{kind}|{name}")
    return (guid, kind, name, name, attributes, datetime(2024, 1, day))


def test_upsert_takes_the_latest(spark):
    current = spark.createDataFrame(
        [entity("t", "a", {"v": "old"}, 1), entity("t", "b", {"v": "kept"}, 5)], ENTITIES_DDL
    )
    incoming = spark.createDataFrame(
        [
            entity("t", "a", {"v": "new"}, 1),
            entity("t", "b", {"v": "late arrival"}, 2),
            entity("t", "c", {}, 1),
            entity("u", "a", {"v": "other type"}, 1),
        ],
        ENTITIES_DDL,
    )
    merged = upsert(current, incoming).merged
    assert merged.columns == current.columns
    found = {(row.type_name, row.name): row.attributes for row in merged.collect()}
    assert found == {
        ("t", "a"): {"v": "new"},
        ("t", "b"): {"v": "kept"},
        ("t", "c"): {},
        ("u", "a"): {"v": "other type"},
    }
    again = upsert(merged, incoming).merged
    assert again.columns == current.columns
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(again) == rows(merged)


TIMES = st.one_of(st.none(), st.integers(1, 4).map(lambda d: datetime(2024, 1, d)))
VERSIONS = st.lists(st.tuples(st.sampled_from("abc"), TIMES, st.integers(0, 9)), max_size=8)


@settings(
    max_examples=4,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
@given(first=VERSIONS, second=VERSIONS)
def test_upsert_matches_brute_force(spark, first, second):
    """Against picking the latest time in a loop."""
    ddl = "k string, updated_at timestamp, v int"
    early = datetime(1970, 1, 1)
    one = {}
    for k, t, v in first:
        one[k] = max(one.get(k, (early, -1)), (t or early, v))
    two = {}
    for k, t, v in second:
        two.setdefault(k, []).append((t or early, v))
    current = spark.createDataFrame(
        [(k, None if t == early else t, v) for k, (t, v) in one.items()], ddl
    )
    incoming = spark.createDataFrame(second, ddl)
    rows = upsert(current, incoming, ["k"]).merged.collect()
    assert sorted(row.k for row in rows) == sorted({*one, *two})
    for row in rows:
        time = row.updated_at or early
        newest = max((t for t, _ in two.get(row.k, [])), default=None)
        if newest is None or (row.k in one and one[row.k][0] > newest):
            assert (time, row.v) == one[row.k]
        else:
            assert time == newest and (time, row.v) in two[row.k]


def test_upsert_hands_null_keys_back(spark):
    rows = [entity("t", "a", {}, 1), entity("t", "b", {"v": "x"}, 1)]
    nameless = ("g", "t", None, "n", {}, datetime(2024, 1, 1))
    current = spark.createDataFrame(rows[:1], ENTITIES_DDL)
    result = upsert(current, spark.createDataFrame([*rows, nameless, nameless], ENTITIES_DDL))
    assert sorted(row.name for row in result.merged.collect()) == ["a", "b"]
    assert [row.name for row in result.rejected.collect()] == ["n", "n"]


def test_upsert_is_one_join_without_hints(spark):
    current = spark.createDataFrame([entity("t", "a", {}, 1)], ENTITIES_DDL)
    plan = upsert(current, current).merged._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join") == 1 and "Hint" not in plan


def test_small_put_keeps_the_others(spark, folder):
    catalog = Catalog(spark, folder)
    catalog.put_entities(
        spark.createDataFrame([entity("t", str(i), {"v": "x"}, 1) for i in range(100)], ENTITIES_DDL)
    )
    catalog.put_entities(spark.createDataFrame([entity("t", "7", {"v": "y"}, 2)], ENTITIES_DDL))
    found = {row.name: row.attributes["v"] for row in catalog.read("entities").collect()}
    assert len(found) == 100 and found["7"] == "y" and found["8"] == "x"


def test_unchanged_types_are_not_written(spark, folder):
    catalog = Catalog(spark, folder)
    catalog.define_types()
    versions = lambda: spark.read.json(f"{folder}/versions").count()
    before = versions()
    catalog.define_types()
    assert versions() == before


def test_types_are_single(spark, folder):
    catalog = Catalog(spark, folder)
    twice = type_definitions(spark).unionByName(type_definitions(spark))
    catalog.define_types(twice)
    assert catalog.type_defs().count() == 4
    other = twice.withColumn("category", F.concat("category", F.rand().cast("string")))
    with pytest.raises(Exception, match="ambiguous key"):
        catalog.define_types(spark.createDataFrame(other.collect(), other.schema))


def test_the_last_versions_are_kept(spark, folder, monkeypatch):
    monkeypatch.setattr(store, "KEPT", 3)
    publish_table(spark.range(9).toDF("i"), folder, "u")
    frames = [publish_table(spark.range(n).toDF("i"), folder, "t") for n in range(1, 7)]
    assert [df.count() for df in frames[-3:]] == [4, 5, 6]
    assert read_table(spark, folder, "t").count() == 6
    assert read_table(spark, folder, "u").count() == 9
    assert len(list(Path(folder, "versions").glob("entry=*"))) == 3
    assert len(list(Path(folder, "t").glob("version=*"))) == 3


def test_upsert_compares_missing_times(spark):
    rows = lambda v, t: [("g", "t", "a", "a", {"v": v}, t)]
    day = datetime(2024, 1, 1)
    for old, new, winner in ((None, None, "new"), (day, None, "old"), (None, day, "new")):
        current = spark.createDataFrame(rows("old", old), ENTITIES_DDL)
        incoming = spark.createDataFrame(rows("new", new), ENTITIES_DDL)
        assert upsert(current, incoming).merged.first().attributes == {"v": winner}


def test_upsert_ties_do_not_depend_on_row_order(spark):
    rows = [entity("t", "a", {"v": str(i), "w": "x"}, 1) for i in range(20)]
    one = upsert(None, spark.createDataFrame(rows, ENTITIES_DDL)).merged.collect()
    two = upsert(None, spark.createDataFrame(rows[::-1], ENTITIES_DDL).repartition(5)).merged.collect()
    assert one == two


def test_latest_by_key_matches_brute_force(spark):
    rows = [(i % 7, (i * 37) % 101, i, f"v{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t int, i int, v string")
    best = {}
    for k, t, i, v in rows:
        best[k] = max(best.get(k, (-1, -1, "")), (t, i, v))
    found = {row.k: (row.t, row.i, row.v) for row in latest_by_key(df, ["k"], ["t", "i"]).collect()}
    assert found == best


def test_latest_by_key_reduces_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS t", "string(id) AS v")
    plan = latest_by_key(df, ["k"], ["t"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan


def test_replace_by_key(spark):
    current = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    incoming = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string")
    rows = {tuple(row) for row in replace_by_key(current, incoming, ["k"]).collect()}
    assert rows == {(1, "x"), (1, "y"), (2, "c"), (3, "z")}


def test_versions(spark, folder):
    assert read_table(spark, folder, "t") is None
    first = publish_table(spark.range(3).toDF("i"), folder, "t")
    second = publish_table(first.union(spark.range(5).toDF("i")), folder, "t")
    assert first.count() == 3 and second.count() == 8
    assert read_table(spark, folder, "t").count() == 8


def test_unfinished_version_is_ignored_and_replaced(spark, folder):
    publish_table(spark.range(3).toDF("i"), folder, "t")
    spark.range(99).toDF("i").write.parquet(f"{folder}/t/version=2")
    assert read_table(spark, folder, "t").count() == 3
    publish_table(spark.range(4).toDF("i"), folder, "t")
    assert read_table(spark, folder, "t").count() == 4


def test_resolve(spark, languages):
    entities = register_tables(schema_rows(spark, {"a": languages, "b": languages})).entities
    requests = spark.createDataFrame(
        [("pyapache://a_delta_table",), ("pyapache://a_delta_table",), ("pyapache://zz",)],
        "qualified_name string",
    )
    rows = {row.qualified_name: row for row in resolve(requests, entities, "custom_delta_table").collect()}
    assert rows["pyapache://a_delta_table"].name == "a"
    assert rows["pyapache://zz"].guid is None and len(rows) == 2
    # The default type is another one.
    assert resolve(requests, entities).filter("guid IS NOT NULL").isEmpty()


def test_attribute_rules(spark):
    entities = spark.createDataFrame(
        [
            entity("custom_spark_job_process", "full", {"job_type": "join", "schedule": "daily"}, 1),
            entity("custom_spark_job_process", "filled", {"job_type": "batch"}, 1),
            entity("custom_spark_job_process", "null default", {"job_type": "b", "schedule": None}, 1),
            entity("custom_spark_job_process", "lacking", {}, 1),
            entity("custom_spark_job_process", "null", {"job_type": None}, 1),
            entity("custom_delta_table", "table", {}, 1),
            entity("unknown", "free", {"x": None}, 1),
        ],
        ENTITIES_DDL,
    )
    rows = {row.name: row for row in apply_attribute_rules(entities, type_definitions(spark)).collect()}
    assert rows["full"].attributes == {"job_type": "join", "schedule": "daily"}
    assert rows["filled"].attributes == {"job_type": "batch", "schedule": "adHoc"}
    assert rows["null default"].attributes["schedule"] == "adHoc"
    assert rows["lacking"].missing == ["job_type"] and rows["null"].missing == ["job_type"]
    assert rows["table"].missing == [] and rows["free"].attributes == {"x": None}


def test_cardinality(spark):
    links = spark.createDataFrame(
        [
            ("1", "custom_delta_table_columns", "t1", "c1"),
            ("2", "custom_delta_table_columns", "t1", "c2"),
            ("3", "custom_delta_table_columns", "t2", "c2"),
            ("4", "custom_delta_table_columns", "t2", "c2"),
            ("5", "other", "t1", "c9"),
            ("6", "other", "t2", "c9"),
        ],
        "guid string, type_name string, end1_guid string, end2_guid string",
    )
    rows = cardinality_violations(links, type_definitions(spark)).collect()
    assert [(row.end2_guid, row.n_containers) for row in rows] == [("c2", 2)]


def test_delete_takes_what_touches_it(spark):
    entities = spark.createDataFrame([entity("t", n, {}, 1) for n in "abc"], ENTITIES_DDL)
    guid = {row.name: row.guid for row in entities.collect()}
    links = spark.createDataFrame(
        [("1", "r", guid["a"], guid["b"]), ("2", "r", guid["b"], guid["c"]), ("3", "r", guid["b"], "x")],
        "guid string, type_name string, end1_guid string, end2_guid string",
    )
    edges = spark.createDataFrame(
        [("p", "input", guid["a"]), ("p", "output", guid["b"]), (guid["c"], "input", guid["b"])],
        "process_guid string, direction string, entity_guid string",
    )
    gone = spark.createDataFrame([(guid["a"],), (guid["c"],), (guid["a"],), ("?",)], "guid string")
    kept, links, edges = delete_entities(gone, entities, links, edges)
    assert [row.name for row in kept.collect()] == ["b"]
    assert [row.guid for row in links.collect()] == ["3"]
    assert [tuple(row) for row in edges.collect()] == [("p", "output", guid["b"])]


def test_lineage_needs_all_references(spark, languages):
    entities = register_tables(
        schema_rows(spark, {n: languages for n in ("in1", "in2", "out1")})
    ).entities
    requests = spark.createDataFrame(
        [
            ("good", ["in1", "in2", "in1"], ["out1"]),
            ("bad", ["in1", "unknown"], ["out1"]),
        ],
        "name string, inputs array<string>, outputs array<string>",
    )
    lineage = record_lineage(lineage_references(requests), entities)
    good = md5("custom_spark_job_process|pyapacheatlas://good")
    table = lambda n: md5(f"custom_delta_table|pyapache://{n}_delta_table")
    assert {tuple(row) for row in lineage.edges.collect()} == {
        (good, "input", table("in1")),
        (good, "input", table("in2")),
        (good, "output", table("out1")),
    }
    assert [(row.guid, row.attributes) for row in lineage.processes.collect()] == [
        (good, {"job_type": "batch"})
    ]
    missing = lineage.unresolved.collect()
    assert [(m.process_name, m.qualified_name) for m in missing] == [
        ("bad", "pyapache://unknown_delta_table")
    ]


def test_stored_catalogue_life_cycle(spark, folder, languages):
    catalog = Catalog(spark, folder)
    assert catalog.read("entities").isEmpty()
    catalog.define_types()
    catalog.define_types()
    assert catalog.type_defs().count() == 4
    for _ in range(2):
        catalog.register_resource_sets(
            {n: languages.alias(n) for n in ("input1", "output1")},
            {n: f"lake://{n}DF" for n in ("input1", "output1")},
        )
    assert catalog.read("entities").count() == 8
    assert catalog.read("relationships").count() == 6
    requests = spark.createDataFrame([("lake://input1DF",)], "qualified_name string")
    found = catalog.resolve(requests).first()
    assert found.guid == md5("azure_datalake_gen2_resource_set|lake://input1DF")

    references = spark.createDataFrame(
        [
            ("test_job", "input", "azure_datalake_gen2_resource_set", "lake://input1DF"),
            ("test_job", "output", "azure_datalake_gen2_resource_set", "lake://output1DF"),
        ],
        "process_name string, direction string, type_name string, qualified_name string",
    )
    recorded = catalog.record_references(references, job_type="join")
    assert recorded.unresolved.isEmpty() and recorded.rejected.isEmpty()
    process = catalog.read("entities").filter("name = 'test_job'").first()
    assert process.attributes == {"job_type": "join", "schedule": "adHoc"}
    origins = catalog.origins(spark.createDataFrame(
        [(md5("azure_datalake_gen2_resource_set|lake://output1DF"),)], "node string"
    ))
    assert {(row.origin, row.n_hops) for row in origins.collect()} == {
        (process.guid, 1),
        (found.guid, 2),
    }
    link = catalog.read("relationships").first()
    wanted = spark.createDataFrame([(link.guid,)], "guid string")
    assert catalog.relationships(wanted).collect() == [link]
    assert catalog.cardinality_violations().isEmpty()

    catalog.delete(spark.createDataFrame([(found.guid,)], "guid string"))
    assert catalog.read("entities").count() == 8
    assert catalog.read("lineage_edges").count() == 1
    assert catalog.read("relationships").count() == 5
    assert catalog.resolve(requests).first().guid is None


def test_statistics_become_column_attributes(spark, folder, languages):
    catalog = Catalog(spark, folder)
    catalog.define_types()
    catalog.register_tables({"lang": languages}, with_statistics=True)
    column = catalog.read("entities").filter("name = 'users_count'").first()
    assert column.attributes["n_nulls"] == "0" and column.attributes["type"] == "bigint"
    assert column.attributes["greatest"] == "100000"


def test_statistics_are_not_computed_for_columns_and_links(spark, languages):
    schemas = schema_rows(spark, {"lang": languages})
    registration = register_tables(schemas, statistics=statistics_rows({"lang": languages}))
    for df in (registration.columns, registration.relationships):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_rejected_entities_are_returned(spark, folder):
    catalog = Catalog(spark, folder)
    catalog.define_types()
    rows = spark.createDataFrame(
        [entity("custom_spark_job_process", "ok", {"job_type": "x"}, 1), entity("custom_spark_job_process", "bad", {}, 1)],
        ENTITIES_DDL,
    )
    rejected = catalog.put_entities(rows)
    assert [(row.name, row.missing) for row in rejected.collect()] == [("bad", ["job_type"])]
    assert [row.name for row in catalog.read("entities").collect()] == ["ok"]


def test_lineage_with_unknown_table_records_nothing(spark, folder, languages):
    catalog = Catalog(spark, folder)
    catalog.define_types()
    catalog.register_tables({"a": languages})
    missing = catalog.record_lineage("job", ["a"], ["nope"]).unresolved
    assert missing.count() == 1
    assert catalog.read("lineage_edges").isEmpty()
    assert catalog.read("entities").filter("name = 'job'").isEmpty()


def test_profile_becomes_attributes(spark, languages):
    rows = {row.column_name: row.attributes for row in profile_attributes(column_profile(languages)).collect()}
    assert rows["users_count"]["n_rows"] == "3" and rows["users_count"]["least"] == "3000"
    assert "least" not in rows["language"]


def test_relationship_lookup(spark):
    links = spark.createDataFrame(
        [("1", "r", "a", "b"), ("2", "r", "b", "c")],
        "guid string, type_name string, end1_guid string, end2_guid string",
    )
    wanted = spark.createDataFrame([("2",), ("2",), ("9",)], "guid string")
    assert [row.guid for row in relationships_by_guid(wanted, links).collect()] == ["2"]


def test_rejected_process_has_no_edges(spark, folder, languages):
    catalog = Catalog(spark, folder)
    owner = type_definitions(spark).filter("name = 'custom_spark_job_process'").withColumn(
        "attribute_defs",
        F.expr("array(named_struct('name', 'owner', 'is_optional', false, 'default_value', string(null)))"),
    )
    catalog.define_types(owner)
    catalog.register_tables({"a": languages, "b": languages})
    recorded = catalog.record_lineage("job", ["a"], ["b"])
    assert recorded.unresolved.isEmpty()
    assert [(row.name, row.missing) for row in recorded.rejected.collect()] == [("job", ["owner"])]
    assert catalog.read("lineage_edges").isEmpty()


def test_deleted_table_takes_its_columns_along(spark, folder, languages):
    catalog = Catalog(spark, folder)
    catalog.define_types()
    catalog.register_tables({"a": languages, "b": languages})
    gone = catalog.read("entities").filter("name = 'a'").select("guid")
    catalog.delete(gone)
    assert sorted(row.name for row in catalog.read("entities").collect()) == [
        "b",
        "language",
        "users_count",
    ]
    assert catalog.read("columns").count() == 2 and catalog.read("relationships").count() == 2


def test_registering_fewer_columns_drops_the_others(spark, folder, languages):
    catalog = Catalog(spark, folder)
    catalog.define_types()
    catalog.register_tables({"a": languages, "b": languages})
    catalog.register_tables({"a": languages.select("language")})
    assert sorted(row.name for row in catalog.read("columns").collect()) == [
        "language",
        "language",
        "users_count",
    ]
    assert catalog.read("relationships").count() == 3
    assert catalog.read("entities").filter("type_name = 'column'").count() == 3


def test_resource_sets_need_names(spark, folder, languages):
    with pytest.raises(ValueError, match="no qualified name"):
        Catalog(spark, folder).register_resource_sets({"a": languages}, {"b": "lake://b"})
    schemas = schema_rows(spark, {"a": languages})
    with pytest.raises(Exception, match="no qualified name"):
        register_resource_sets(schemas, {"b": "lake://b"}).entities.collect()


def test_no_frames(spark, folder):
    assert schema_rows(spark, {}).isEmpty()
    assert Catalog(spark, folder).register_tables({}).isEmpty()


def test_run_of_several_jobs_is_one_version(spark, folder, languages):
    catalog = Catalog(spark, folder)
    frames = {name: languages for name in ("raw", "clean", "out")}
    catalog.record_run(frames, [Job("wash", ["raw"], ["clean"]), Job("copy", ["clean"], ["out"])])
    assert spark.read.json(f"{folder}/versions").count() == 1
    target = catalog.read("entities").filter("name = 'out'").select(F.col("guid").alias("node"))
    names = catalog.read("entities").select(F.col("guid").alias("origin"), "name")
    found = catalog.origins(target).join(names, "origin")
    assert {(row.name, row.n_hops) for row in found.collect()} == {
        ("copy", 1),
        ("clean", 2),
        ("wash", 3),
        ("raw", 4),
    }


def definition(name, above=(), rules=()):
    row = {
        "name": name, "category": "ENTITY", "super_types": list(above),
        "attribute_defs": [
            {"name": n, "is_optional": optional, "default_value": default} for n, optional, default in rules
        ],
    }
    return json.dumps(row)


def definitions(spark, *lines):
    df = spark.createDataFrame([(line,) for line in lines], "line string")
    return df.select(F.inline(F.array(F.from_json("line", TYPE_DEFS_DDL))))


def test_rules_are_inherited_from_all_super_types(spark, folder):
    defs = definitions(
        spark,
        definition("top", ["DataSet"], [("a", False, None), ("b", True, "top"), ("c", True, "top")]),
        definition("left", ["top"], [("b", True, "left")]),
        definition("right", ["top"], [("b", True, "right"), ("d", False, None)]),
        definition("low", ["right", "left"], [("c", True, "low")]),
        definition("alone", [], [("e", False, None)]),
    )
    rules = {
        row.name: {(r.name, r.is_optional, r.default_value) for r in row.attribute_defs}
        for row in inherited_type_defs(defs).collect()
    }
    assert rules["low"] == {("a", False, None), ("b", True, "left"), ("c", True, "low"), ("d", False, None)}
    assert rules["left"] == {("a", False, None), ("b", True, "left"), ("c", True, "top")}
    assert rules["alone"] == {("e", False, None)}
    catalog = Catalog(spark, folder)
    catalog.define_types(defs)
    rows = [entity("low", "1", {"a": "x"}, 1), entity("low", "2", {"a": "x", "d": "y"}, 1)]
    rejected = catalog.put_entities(spark.createDataFrame(rows, ENTITIES_DDL))
    assert [(row.qualified_name, row.missing) for row in rejected.collect()] == [("1", ["d"])]
    assert catalog.read("entities").first().attributes == {"a": "x", "d": "y", "b": "left", "c": "low"}
    # A new rule of the type at the top holds for those below it.
    catalog.define_types(definitions(spark, definition("top", [], [("z", False, None)])))
    rejected = catalog.put_entities(spark.createDataFrame(rows[1:], ENTITIES_DDL))
    assert [row.missing for row in rejected.collect()] == [["z"]]


def test_circular_super_types_are_refused(spark, folder):
    circle = definitions(spark, definition("p", ["q"]), definition("q", ["r"]), definition("r", ["p"]))
    with pytest.raises(ValueError, match="'p', 'q', 'r'"):
        inherited_type_defs(circle)
    catalog = Catalog(spark, folder)
    with pytest.raises(ValueError, match="themselves"):
        catalog.define_types(definitions(spark, definition("p", ["p"])))
    assert catalog.type_defs().isEmpty()


def test_links_are_held_to_their_cardinality(spark, folder):
    catalog = Catalog(spark, folder)
    catalog.define_types()
    kind = "custom_delta_table_columns"

    def put(*pairs):
        rows = spark.createDataFrame([(kind if t else "free", a, b) for t, a, b in pairs], "t string, a string, b string")
        links = relationship_rows(rows, kind, F.col("a"), F.col("b")).limit(0)
        for name in (kind, "free"):
            links = links.unionByName(
                relationship_rows(rows.filter(F.col("t") == name), name, F.col("a"), F.col("b"))
            )
        return {(row.end1_guid, row.end2_guid) for row in catalog.put_relationships(links).collect()}

    assert put((1, "t1", "c1"), (1, "t1", "c2"), (1, "t1", "c1"), (1, "t1", "c3"), (1, "t2", "c3")) == {
        ("t1", "c3"), ("t2", "c3"),
    }
    assert put((1, "t2", "c1"), (1, "t1", "c2"), (1, "t2", "c4"), (0, "t1", "c9"), (0, "t2", "c9")) == {("t2", "c1")}
    stored = {(row.end1_guid, row.end2_guid) for row in catalog.read("relationships").collect()}
    assert stored == {("t1", "c1"), ("t1", "c2"), ("t2", "c4"), ("t1", "c9"), ("t2", "c9")}
    assert catalog.cardinality_violations().isEmpty()
