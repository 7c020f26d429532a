"""Joining two cleaned tables, and reporting what the join leaves out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeclerk.functions.columns import named, require_columns
from lakeclerk.functions.sizing import written

GRAM = 2  # letters of a gram; an edit touches no more grams than this


def enrich(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Inner equi-join; the key comes first, then left, then right columns.

    Null keys never match and duplicate keys multiply. No hint is given: Spark
    broadcasts a side only if its size is below the broadcast threshold, by
    estimate or as measured after the shuffle, and otherwise adaptive
    execution splits the partitions of hot keys.
    """
    return left.join(right, on=_names(on), how="inner")


def unmatched_keys(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keys the inner join drops: ``side``, the key columns, ``n_rows``.

    Both sides go through one grouped count instead of two anti joins. Rows
    are counted per key before the shuffle, so a key that holds much of a
    table costs one row per task. Null keys count as unmatched.
    """
    keys = _names(on)
    require_columns(left, keys)
    require_columns(right, keys)
    key_columns = [named(key) for key in keys]

    def marked(df: DataFrame, in_left: int, in_right: int) -> DataFrame:
        return df.select(
            *key_columns, F.lit(in_left).alias("n_left"), F.lit(in_right).alias("n_right")
        )

    counts = (
        marked(left, 1, 0)
        .union(marked(right, 0, 1))
        .groupBy(*key_columns)
        .agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    )
    key_is_null = F.lit(False)
    for key in key_columns:
        key_is_null = key_is_null | key.isNull()
    unmatched = counts.filter((F.col("n_left") == 0) | (F.col("n_right") == 0) | key_is_null)
    sides = F.array(
        F.struct(F.lit("left").alias("side"), F.col("n_left").alias("n_rows")),
        F.struct(F.lit("right").alias("side"), F.col("n_right").alias("n_rows")),
    )
    return unmatched.select(
        F.inline(F.filter(sides, lambda side: side["n_rows"] > 0)), *key_columns
    ).select("side", *key_columns, "n_rows")


def likely_partners(
    left: DataFrame,
    right: DataFrame,
    on: str,
    max_edits: int = 2,
    max_share: float = 0.25,
) -> DataFrame:
    """The right key that each left key without a match most likely stands for.

    One row for each distinct text key of ``left`` that is not in ``right``:
    ``key``, ``n_rows`` it has, ``partner`` and ``edits``. The partner is the right
    key at the least edit distance, ties going to the smaller key; it is null
    where none is within ``max_edits`` edits and ``max_share`` of the longer
    key's letters. Null keys have no row. ``max_share`` stays below one in GRAM.

    Keys meet in an index of their grams, so no pair is formed of keys that have
    no rare gram in common. Of two keys ``d`` edits apart either has at most
    ``GRAM * d`` grams the other lacks, so the rarest one they share is among the
    first ``GRAM * d + 1`` of both in order of frequency. It exists, as a key has
    more grams than ``max_share`` of it can touch. Keys one edit apart are looked
    for first; only keys still without a partner go on to the next round, with a
    longer part of their grams.
    """
    if not 0 <= max_share < 1 / GRAM:
        raise ValueError(f"max_share must be below {1 / GRAM}: {max_share}")
    require_columns(left, [on])
    require_columns(right, [on])
    key = named(on).cast("string").alias("key")
    # One grouped count over both sides, as for all unmatched keys.
    counts = (
        left.select(key, F.lit(1).alias("n_left"), F.lit(0).alias("n_right"))
        .union(right.select(key, F.lit(0).alias("n_left"), F.lit(1).alias("n_right")))
        .where(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    )
    counts = written(counts, "key-counts")
    indexed = written(_grams_by_rarity(counts), "key-grams")
    wanted = indexed.where(F.col("n_right") == 0)
    known = indexed.where(F.col("n_right") > 0)
    partners = []
    for edits in range(1, max_edits + 1):
        taken = GRAM * edits + 1

        def entries(keys: DataFrame, name: str, taken: int = taken) -> DataFrame:
            gram = F.explode(F.slice("grams", 1, taken)).alias("gram")
            return keys.select(F.col("key").alias(name), F.length("key").alias(f"{name}_size"), gram)

        longer = F.greatest("key_size", "partner_size")
        near = (
            entries(wanted, "key")
            .join(entries(known, "partner"), "gram")
            .where(F.abs(F.col("key_size") - F.col("partner_size")) <= edits)
            .where(F.floor(longer * F.lit(float(max_share))) >= edits)
            # Before any shuffle, so that only found partners leave the join.
            .where(F.levenshtein("key", "partner", edits) == edits)
            .groupBy("key")
            .agg(F.min("partner").alias("partner"))
            .withColumn("edits", F.lit(edits))
        )
        near = written(near, "key-partners")
        partners.append(near)
        wanted = wanted.join(near.select("key"), "key", "left_anti")
    every = counts.where(F.col("n_right") == 0).select("key", F.col("n_left").alias("n_rows"))
    if not partners:
        none = F.lit(None)
        return every.select("*", none.cast("string").alias("partner"), none.cast("int").alias("edits"))
    return every.join(reduce(DataFrame.unionByName, partners), "key", "left")


def _grams_by_rarity(keys: DataFrame) -> DataFrame:
    """``keys`` with ``grams``, the distinct grams of each key, the rarest first.

    A control character stands at either end, so the empty key has a gram too.
    """
    marked = F.concat(F.lit("\x02"), F.col("key"), F.lit("\x03"))
    grams = F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.length("key") + 1), lambda at: F.substring(marked, at, F.lit(GRAM))
        )
    )
    rows = keys.select("key", "n_right", F.explode(grams).alias("gram"))
    often = rows.groupBy("gram").agg(F.count("*").alias("n"))
    # Few bytes, but much work for whoever joins them: not to be put in one task.
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.join(often, "gram")
        .repartition(tasks, "key")
        .groupBy("key", "n_right")
        .agg(F.array_sort(F.collect_list(F.struct("n", "gram"))).alias("grams"))
        .withColumn("grams", F.col("grams.gram"))
    )


def _names(on: str | Sequence[str]) -> list[str]:
    return [on] if isinstance(on, str) else list(on)
