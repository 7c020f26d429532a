"""Token ids in training order, in shards of fixed stride (operator 3).

Every text becomes sequences of equally many ids. A sequence's place among all
is mapped to a global slot by a keyed Feistel network over the next power of
four; a value beyond the last sequence is sent through the network again until
it falls inside, so slots are a permutation without gaps. Ranges of slots are
written as shards: shard s holds the slots from s * SHARD on, in order, each as
one record of the same number of bytes. A reader goes through the shards in
order and can resume at any slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeclerk.llm.bpe import read_ranks
from lakeclerk.llm.scratch import in_chunks, map_frames, new_path, ship, written
from lakeclerk.llm.words import mixed

LENGTH = 1024  # ids of a sequence
SHARD = 16_384  # slots of a shard
END = 50_256  # id after the last of a text, and of the padding
ROUNDS = 6
KEY = 20_240_601
TOGETHER = 1 << 20
BROADCAST_TASKS = 1_000_000  # offsets of more tasks are joined by shuffle

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    if ranks_path not in _encodings:
        _encodings[ranks_path] = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={}
        )
    return _encodings[ranks_path]


def _network(values: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    """One pass through the Feistel network over numbers of 2 * bits bits."""
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = values >> shift, values & mask
    rounds = range(ROUNDS)
    for number in reversed(rounds) if back else rounds:
        secret = mixed(np.array([key * ROUNDS + number], np.uint64))
        if back:
            left, right = right ^ (mixed(left ^ secret) & mask), left
        else:
            left, right = right, left ^ (mixed(right ^ secret) & mask)
    return (left << shift) | right


def permuted(places: np.ndarray, count: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The slots of places among ``count``; with ``back`` the places of slots."""
    bits = max(1, -(-max(1, count - 1).bit_length() // 2))
    values = _network(places.astype(np.uint64), bits, key, back)
    outside = np.flatnonzero(values >= count)
    while len(outside):
        values[outside] = _network(values[outside], bits, key, back)
        outside = outside[values[outside] >= count]
    return values.astype(np.int64)


def sequences(
    documents: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, ``part``, ``n_ids``, ``ids``, ``task``, ``local``): the sequences of every text.

    ``ids`` are LENGTH little-endian unsigned 16-bit ids; an end mark follows a
    text's last id and fills its last sequence. ``n_ids`` counts the ids of the
    text and the first end mark. A null or empty text has no sequence. The two
    last columns number the sequences of a task.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, local = encoding(ranks_path, pattern), 0
        for frame in frames:
            for part in in_chunks(frame, "seq_text", TOGETHER):
                rows = []
                for name, task, value in zip(part["seq_key"], part["task"], part["seq_text"]):
                    ids = [*encoder.encode_ordinary(value), END]
                    for number, begin in enumerate(range(0, len(ids), LENGTH)):
                        cut = ids[begin : begin + LENGTH]
                        full = cut + [END] * (LENGTH - len(cut))
                        data = np.array(full, "<u2").tobytes()
                        rows.append((name, number, len(cut), data, task, local))
                        local += 1
                yield pd.DataFrame(rows, columns=[key, "part", "n_ids", "ids", "task", "local"])

    rows = documents.select(
        documents[key].cast("string").alias("seq_key"),
        documents[text].alias("seq_text"),
        F.spark_partition_id().alias("task"),
    ).where(F.length("seq_text") > 0)
    found = map_frames(
        rows, run, f"`{key}` string, part int, n_ids int, ids binary, task int, local bigint"
    )
    return found.withColumn(key, F.col(key).cast(kind))


def write_training_order(
    documents: DataFrame,
    path: str,
    ranks_path: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    permutation_key: int = KEY,
    shard: int = SHARD,
) -> int:
    """Write the sequences of all texts in training order and return their number.

    Ids are computed once and stored; the number of sequences of every task
    gives each a place among all without a sort. A task writes whole shards, so
    the files below ``shard=s`` hold its slots in order and no other's. Rows
    with a repeated or null key each have their own sequences.
    """
    spark: SparkSession = documents.sparkSession
    ship(spark)
    made = sequences(documents, ranks_path, pattern, key, text)
    stored = written(made, "sequences", "zstd")
    sizes = stored.groupBy("task").agg(F.count("*").alias("size"))
    # One row for each task that wrote sequences.
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("task", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("offset"))
    offsets = written(offsets, "offsets")
    count = stored.count()
    # A row of 16 bytes for each task: the sequences need not be shuffled for it.
    if offsets.count() <= BROADCAST_TASKS:
        offsets = F.broadcast(offsets)

    @F.pandas_udf("bigint")
    def slot(places: pd.Series) -> pd.Series:
        return pd.Series(permuted(places.to_numpy(np.int64), count, permutation_key))

    placed = stored.join(offsets, "task").withColumn("slot", slot(F.col("offset") + F.col("local")))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard).cast("long"))
    shards = max(1, -(-count // shard))
    (
        placed.select("slot", key, "part", "n_ids", "ids", "shard")
        .repartitionByRange(shards, "shard")
        .sortWithinPartitions("shard", "slot")
        .write.option("compression", "zstd")
        .partitionBy("shard")
        .parquet(path)
    )
    return count


def read_training_order(
    spark: SparkSession, path: str, first_slot: int = 0, shard: int = SHARD
) -> DataFrame:
    """Sequences from ``first_slot`` on; shards before it are not opened."""
    rows = spark.read.parquet(path)
    return rows.where((F.col("shard") >= first_slot // shard) & (F.col("slot") >= first_slot))


def sequence_digests(documents: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Write the training order to the shared folder and describe what was written."""
    path = new_path(documents.sparkSession, "training-order")
    if not write_training_order(documents, path, ranks_path, pattern):
        return documents.sparkSession.createDataFrame(
            [], "slot bigint, shard bigint, doc_id bigint, part int, n_ids int, ids_sha256 string"
        )
    rows = read_training_order(documents.sparkSession, path)
    return rows.select(
        "slot",
        F.col("shard").cast("long").alias("shard"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "part",
        "n_ids",
        F.sha2("ids", 256).alias("ids_sha256"),
    )
