from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lakeclerk.operators import lineage_hops, shallow_origins, trace_origins
from lakeclerk.operators.lineage import next_origins

DDL = "node string, origin string"


def brute_force(edges):
    parents = {}
    for node, origin in edges:
        parents.setdefault(node, set()).add(origin)
    found = {}
    for start in parents:
        frontier, depth = {start}, 0
        while frontier:
            depth += 1
            frontier = {o for n in frontier for o in parents.get(n, ())}
            frontier = {o for o in frontier if (start, o) not in found}
            found.update({(start, o): depth for o in frontier})
    return found


def every_node(spark, edges):
    return spark.createDataFrame([(n,) for n in {e[0] for e in edges if e[0]}], "node string")


def traced(df):
    rows = df.collect()
    found = {(row.node, row.origin): row.n_hops for row in rows}
    assert len(found) == len(rows)
    return found


def test_cycle_and_two_paths(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("d", "c"), ("a", "b")]
    assert traced(
        trace_origins(spark.createDataFrame(edges, DDL), every_node(spark, edges))
    ) == brute_force(edges)


@settings(
    max_examples=4,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)
@given(st.lists(st.tuples(st.sampled_from("abcdef"), st.sampled_from("abcdef")), min_size=1, max_size=9))
def test_any_graph(spark, edges):
    assert traced(
        trace_origins(spark.createDataFrame(edges, DDL), every_node(spark, edges))
    ) == brute_force(edges)


def test_targets(spark, folder):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(6)] + [("z", "n5")]
    df = spark.createDataFrame(edges, DDL)
    targets = spark.createDataFrame([("n3",), ("n3",)], "node string")
    wanted = {k: v for k, v in brute_force(edges).items() if k[0] == "n3"}
    assert traced(trace_origins(df, targets, folder)) == wanted


def test_hops_without_an_end_are_left_out(spark):
    edges = [("a", "b"), ("b", "a"), ("b", None), (None, "a")]
    whole = brute_force(edges[:2])
    assert traced(trace_origins(spark.createDataFrame(edges, DDL), every_node(spark, edges))) == whole


def test_no_edges(spark):
    targets = spark.createDataFrame([("a",)], "node string")
    assert trace_origins(spark.createDataFrame([], DDL), targets).isEmpty()


def test_hops_go_through_the_process(spark):
    edges = spark.createDataFrame(
        [("p", "input", "a"), ("p", "input", "b"), ("p", "output", "c")],
        "process_guid string, direction string, entity_guid string",
    )
    hops = {(row.node, row.origin) for row in lineage_hops(edges).collect()}
    assert hops == {("p", "a"), ("p", "b"), ("c", "p")}


def test_both_ways_find_the_same_origins(spark):
    edges = [(f"n{i}", f"n{(i * 7 + 3) % 40}") for i in range(40)] + [("n1", "n2"), ("n2", "n5"), ("n1", "n5")]
    df = spark.createDataFrame(edges + [(None, "n1"), ("n1", None)], DDL)
    targets = spark.createDataFrame([("n1",), ("n2",), ("n9",), ("n1",)], "node string")
    rounds = traced(trace_origins(df, targets))
    for depth in (1, 3):
        near = {pair: n for pair, n in rounds.items() if n <= depth}
        assert near and traced(shallow_origins(df, targets, depth)) == near


def test_a_round_shuffles_new_pairs_only(spark, folder, conf):
    conf("spark.sql.adaptive.enabled", "false")
    rows = spark.range(100).selectExpr("cast(id AS string) AS node", "cast(id + 1 AS string) AS origin")
    rows.write.bucketBy(8, "node").option("path", f"{folder}/h").saveAsTable("some_hops")
    rows.write.bucketBy(8, "node", "origin").option("path", f"{folder}/p").saveAsTable("some_pairs")
    try:
        latest = spark.createDataFrame([("5", "6")], DDL)
        plan = next_origins(latest, spark.table("some_hops"), spark.table("some_pairs"))
        text = plan._jdf.queryExecution().executedPlan().toString()
        exchanges = [line for line in text.splitlines() if "Exchange " in line]
        # One to meet the hops, one to meet the found pairs; neither table moves.
        assert len(exchanges) == 2 and text.count("Bucketed: true") == 2
    finally:
        spark.sql("DROP TABLE some_hops")
        spark.sql("DROP TABLE some_pairs")


def test_shallow_origins_have_no_bound_on_rows(spark, conf):
    conf("spark.sql.cteRecursionRowLimit", "10")
    edges = [(f"n{i}", f"m{i % 3}") for i in range(20)] + [(f"m{i}", "r") for i in range(3)]
    df = spark.createDataFrame(edges, DDL)
    near = {pair: n for pair, n in brute_force(edges).items() if n <= 2}
    assert len(near) == 43 and traced(shallow_origins(df, every_node(spark, edges), 2)) == near
