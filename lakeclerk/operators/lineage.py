"""Lineage of jobs: which entities a process reads and writes, over many hops."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeclerk.functions import identity as ids
from lakeclerk.functions.sizing import new_folder, written
from lakeclerk.operators.catalog import ENTITY_KEY, entity_rows

EDGES_DDL = "process_guid string, direction string, entity_guid string"
REQUESTS_DDL = "name string, inputs array<string>, outputs array<string>"


@dataclass(frozen=True)
class Lineage:
    """Accepted processes and their edges, and the references not found."""

    processes: DataFrame
    edges: DataFrame
    unresolved: DataFrame


def lineage_references(requests: DataFrame, scheme: str = ids.TABLE_SCHEME) -> DataFrame:
    """One row per input and output of each requested process.

    ``requests`` has ``name`` and the arrays ``inputs`` and ``outputs`` of table
    names. The result has ``process_name, direction, type_name,
    qualified_name``.
    """
    sides = F.array(
        F.struct(F.lit("input").alias("direction"), F.col("inputs").alias("tables")),
        F.struct(F.lit("output").alias("direction"), F.col("outputs").alias("tables")),
    )
    return (
        requests.select(F.col("name").alias("process_name"), F.inline(sides))
        .select("process_name", "direction", F.explode("tables").alias("table"))
        .select(
            "process_name",
            "direction",
            F.lit(ids.TABLE_TYPE).alias("type_name"),
            ids.table_name_of(F.col("table"), scheme).alias("qualified_name"),
        )
    )


def record_lineage(
    references: DataFrame,
    entities: DataFrame,
    job_type: str = "batch",
    process_type: str = ids.PROCESS_TYPE,
    scheme: str = ids.PROCESS_SCHEME,
    updated_at: Column | None = None,
    work: str | None = None,
) -> Lineage:
    """Processes and edges for references to entities that exist.

    All references are looked up in one join, however many processes there
    are, and the outcome is written once, below ``work``, for the three results. A process with
    a reference that is not found is left out whole, and the reference is
    reported. Repeated references collapse before the join; an entity that
    very many processes use is a hot join key, whose partition adaptive
    execution splits.
    """
    process_name = ids.process_name_of(F.col("process_name"), scheme)
    wanted = references.select("process_name", "direction", *ENTITY_KEY).distinct()
    found = written(
        wanted.join(
            entities.select(*ENTITY_KEY, F.col("guid").alias("entity_guid")),
            on=list(ENTITY_KEY),
            how="left",
        ),
        "references",
        work,
    )
    unresolved = found.filter(F.col("entity_guid").isNull()).drop("entity_guid")
    accepted = found.join(unresolved.select("process_name"), "process_name", "left_anti")
    edges = accepted.select(
        ids.entity_guid(F.lit(process_type), process_name).alias("process_guid"),
        "direction",
        "entity_guid",
    )
    processes = entity_rows(
        accepted.select("process_name").distinct(),
        process_type,
        process_name,
        F.col("process_name"),
        F.create_map(F.lit("job_type"), F.lit(job_type)),
        updated_at,
    )
    return Lineage(processes, edges, unresolved)


def lineage_hops(edges: DataFrame) -> DataFrame:
    """Edges as hops ``node <- origin``.

    A process is a node between its inputs and outputs, so the number of hops
    is the number of edges; inputs are never paired with outputs.
    """
    is_input = F.col("direction") == "input"
    return edges.select(
        F.when(is_input, F.col("process_guid")).otherwise(F.col("entity_guid")).alias("node"),
        F.when(is_input, F.col("entity_guid")).otherwise(F.col("process_guid")).alias("origin"),
    )


def trace_origins(hops: DataFrame, targets: DataFrame, work: str | None = None) -> DataFrame:
    """All direct and indirect origins of ``targets``: ``node, origin, n_hops`` (the least).

    ``targets`` has a column ``node``. The result has a row for each of them and
    each of its origins, so its size is the caller's choice; ask for few.

    Every round joins the pairs found last with the hops and keeps pairs not
    seen before, so cycles end and a pair is followed once however many paths
    lead to it. A hop that lacks an end is none. Hops lie in buckets of their
    node and found pairs in buckets of both ends, so a round shuffles what it
    has found and nothing else: earlier pairs and the hops are read where they
    are. Each round is written below ``work``, by default the shared folder:
    lost executors cost one round at most, and the plan stays short. Rounds end
    by themselves, however deep the origins are.
    """
    spark = hops.sparkSession
    folder = new_folder(spark, "origins", work)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"lakeclerk_origins_{folder.rsplit('-', 1)[1]}"
    steps, pairs = f"{name}_hops", f"{name}_pairs"
    schema = "node string, origin string, n_hops int"

    def add(df: DataFrame, n_hops: int) -> DataFrame:
        """Append a round's pairs; returns them."""
        (
            df.select("node", "origin", F.lit(n_hops).alias("n_hops"))
            .write.mode("append")
            .partitionBy("n_hops")
            .bucketBy(buckets, "node", "origin")
            .option("path", f"{folder}/pairs")
            .saveAsTable(pairs)
        )
        return spark.table(pairs).where(F.col("n_hops") == n_hops)

    try:
        (
            hops.select("node", "origin")
            .dropna()
            .write.bucketBy(buckets, "node")
            .option("path", f"{folder}/hops")
            .saveAsTable(steps)
        )
        wanted = targets.select("node").distinct()
        latest = add(spark.table(steps).join(wanted, "node", "left_semi").distinct(), 1)
        n_rounds = 1
        while not latest.isEmpty():
            n_rounds += 1
            latest = add(next_origins(latest, spark.table(steps), spark.table(pairs)), n_rounds)
    finally:
        # The tables are names of the folders' buckets; the files stay.
        for table in (steps, pairs):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
    return spark.read.schema(schema).parquet(f"{folder}/pairs").select("node", "origin", "n_hops")


def next_origins(latest: DataFrame, steps: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs one hop beyond ``latest`` that are not among those found.

    The hints keep the joins in the buckets of ``steps`` and ``found``, which
    are not shuffled.
    """
    parents = steps.select(F.col("node").alias("origin"), F.col("origin").alias("next_origin"))
    reached = latest.select("node", "origin").join(parents.hint("merge"), "origin")
    reached = reached.select("node", F.col("next_origin").alias("origin"))
    known = found.select("node", "origin").hint("merge")
    return reached.join(known, ["node", "origin"], "left_anti").distinct()


def shallow_origins(hops: DataFrame, targets: DataFrame, max_hops: int) -> DataFrame:
    """Origins of ``targets`` at most ``max_hops`` away: ``node, origin, n_hops`` (the least).

    One recursive query that writes nothing. It follows every path, so it is
    for shallow lineage: paths multiply, and a cycle is followed to the bound.
    ``LIMIT ALL`` lifts Spark's limit on the rows of a recursion, for this query
    alone: the bound on hops ends it, and a level is a distributed join.
    """
    if max_hops < 1:
        raise ValueError("max_hops should be at least 1")
    return hops.sparkSession.sql(
        f"""
        WITH RECURSIVE steps AS (
            SELECT DISTINCT node, origin FROM {{hops}}
            WHERE node IS NOT NULL AND origin IS NOT NULL
        ), reached(node, origin, n_hops) MAX RECURSION LEVEL {max_hops + 1} AS (
            SELECT s.node, s.origin, 1 FROM steps s LEFT SEMI JOIN {{targets}} t ON s.node = t.node
            UNION ALL
            SELECT r.node, s.origin, r.n_hops + 1
            FROM reached r JOIN steps s ON r.origin = s.node WHERE r.n_hops < {max_hops}
        )
        SELECT node, origin, min(n_hops) AS n_hops FROM reached GROUP BY node, origin
        LIMIT ALL
        """,
        hops=hops,
        targets=targets,
    )
