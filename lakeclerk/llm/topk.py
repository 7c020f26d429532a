"""Exact top-k by inner product with the bounds of sorted lists (operator 9).

For a block of vectors the values of each dimension are sorted, as a list that
a query would read from the end that promises most: from the top where its
component is positive, from the bottom where it is negative. The lists serve as
thresholds only: the values at which they stand at fixed shares of their length.
No list is read entry by entry, and bounds and scores are products of matrices
over the whole rows of the block. A value beyond the threshold counts as read;
what has been read of a vector and the thresholds bound its score from below
and above, and a vector whose upper bound is under the k-th best lower bound is
out. Those that are left are scored by their whole rows.

Many queries and vectors are worked on at a time. They meet as a grid of
bounded parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeclerk.llm.scratch import map_frames, ship, written

PART = 8192  # vectors of a part of the table, about
QUERIES = 2048  # queries of a part, about
BLOCK = 2048  # vectors whose lists are read together
ROUNDS = (0.5, 0.75, 1.0)  # share of every list that is read after each round
EXACT = 1 << 24  # sums below are exact as 32-bit floats


class Lists:
    """The sorted lists of a block of vectors, cut into rounds."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, kind: type):
        self.ids, self.kind = ids, kind
        self.rows = values.astype(kind)
        ordered = np.sort(values, axis=0)
        self.low, self.high = ordered[0].astype(kind), ordered[-1].astype(kind)
        # Value at which a list stands when a share of it has been read from the
        # bottom and from the top. Equal values count as read together.
        size = len(ids)
        depth = [min(size, max(1, round(share * size))) for share in ROUNDS]
        self.up = [ordered[d - 1].astype(kind) for d in depth]
        self.down = [ordered[size - d].astype(kind) for d in depth]

    def upper(self, queries: np.ndarray, number: int) -> np.ndarray:
        """Upper bounds of all scores after a round, query by vector.

        What is read counts with its value, and the rest with the value at
        which its list stands: no entry further on promises more.
        """
        most = np.maximum(queries, 0) @ np.maximum(self.rows, self.down[number]).T
        most += np.minimum(queries, 0) @ np.minimum(self.rows, self.up[number]).T
        return most

    def lower(self, queries: np.ndarray, number: int) -> np.ndarray:
        """Lower bounds: what is not read counts with the last value of its list."""
        least = np.maximum(queries, 0) @ np.where(
            self.rows >= self.down[number], self.rows, self.low
        ).T
        least += np.minimum(queries, 0) @ np.where(
            self.rows <= self.up[number], self.rows, self.high
        ).T
        return least

def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of every row, or the least there can be."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]


def search_block(
    lists: Lists, own: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of all pairs that may be among a query's k best.

    ``own`` are the queries' ids, whose vectors are no candidates; ``floor`` are
    the scores that k vectors of other blocks have reached already.
    """
    same = own[:, None] == lists.ids[None, :]
    alive = ~same
    for number in range(len(ROUNDS) - 1):
        bar = floor
        if not np.isfinite(floor).all():
            # No k scores are known yet: the k-th lower bound is the bar.
            least = lists.lower(queries, number)
            least[same] = -np.inf
            bar = np.maximum(floor, _best(least, k))
        alive &= lists.upper(queries, number) >= bar[:, None]
        if not alive.any():
            break
    # The lists are read to the end for what is left: all entries are known.
    left = np.flatnonzero(alive.any(axis=0))
    if not len(left):
        none = np.zeros(0, np.int64)
        return none, none, none
    scores = queries @ lists.rows[left].T
    masked = np.where(alive[:, left], scores, -np.inf)
    bar = floor if np.isfinite(floor).all() else np.maximum(floor, _best(masked, k))
    # A bar of -inf, where fewer than k are known, takes in no vector that is out.
    query, vector = np.nonzero((masked >= bar[:, None]) & alive[:, left])
    vector = left[vector]
    return query, vector, scores[query, np.searchsorted(left, vector)].astype(np.int64)


def _kind(dimensions: int, queries: np.ndarray, values: np.ndarray) -> type:
    """The number type in which all sums of a block are exact."""
    reach = dimensions * float(np.abs(queries).max(initial=0)) * float(np.abs(values).max(initial=0))
    if reach < EXACT:
        return np.float32
    if reach < 2**53:
        return np.float64
    raise OverflowError("scores beyond 2**53 are not exact")


def _cut_ties(
    query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of every query, greatest score and then least id first."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    begin = np.searchsorted(query, query)
    kept = np.arange(len(query)) - begin < k
    return query[kept], ids[kept], score[kept]


def search_part(
    own: np.ndarray, queries: np.ndarray, ids: np.ndarray, values: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector id, score) of the k best of a part for each of its queries."""
    kind = _kind(queries.shape[1], queries, values)
    asked, found = queries.astype(kind), (np.zeros(0, np.int64),) * 3
    floor = np.full(len(own), -np.inf)
    for at in range(0, len(ids), BLOCK):
        lists = Lists(ids[at : at + BLOCK], values[at : at + BLOCK], kind)
        query, vector, score = search_block(lists, own, asked, floor, k)
        found = _cut_ties(
            np.concatenate([found[0], query]),
            np.concatenate([found[1], lists.ids[vector]]),
            np.concatenate([found[2], score]),
            k,
        )
        full = np.bincount(found[0], minlength=len(own)) >= k
        last = np.searchsorted(found[0], np.arange(len(own)), "right") - 1
        floor[full] = found[2][last[full]]
    return found


def _packed(rows: DataFrame, name: str, size: int, count: int) -> tuple[DataFrame, int]:
    """Rows dealt to parts of about ``size`` and packed, and the number of parts.

    A row's part follows from its place in the table, so that repeated ids are
    spread too.
    """
    ship(rows.sparkSession)
    parts = max(1, -(-count // size))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["vec_id", "row"])
        values = np.array(frame["value"].tolist(), np.float64).reshape(len(frame), -1)
        return pd.DataFrame(
            {
                "dimensions": [values.shape[1]],
                name: frame["part"][:1].to_numpy(),
                f"{name}_row": [frame["row"].to_numpy("<i8").tobytes()],
                f"{name}_id": [frame["vec_id"].to_numpy("<i8").tobytes()],
                f"{name}_value": [values.astype("<f8").tobytes()],
            }
        )

    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
    packed = dealt.groupBy("dimensions", "part").applyInPandas(
        pack,
        f"dimensions int, {name} int, {name}_row binary, {name}_id binary, {name}_value binary",
    )
    return packed, parts


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: int = 64,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """The k greatest inner products of every query with all other vectors.

    Components x count as floor(scale * x). Returns ``query_id``, ``rank`` from
    1, ``vec_id`` and ``score``; ties go to the smaller id. With fewer than k
    other vectors all are returned. Null vectors, vectors with a null or a
    component that is not finite, and rows without a key take no part; empty
    vectors neither. Vectors of another length than the query's are none of its
    candidates. Every row is a vector of its own: of a repeated key each row is
    a candidate and, as a query, gives a list; no row of the query's own key is
    a candidate.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fit = F.forall(
        x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    rows = vectors.where(F.col(key).isNotNull() & (F.size(vector) > 0) & fit).select(
        F.col(key).cast("long").alias("vec_id"),
        F.transform(x, lambda v: F.floor(v * scale).cast("double")).alias("value"),
        F.size(vector).alias("dimensions"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "vectors")
    asking = rows.where("asks")
    table, table_parts = _packed(rows.drop("asks"), "part", PART, rows.count())
    asked, asked_parts = _packed(asking.drop("asks"), "ask", QUERIES, asking.count())
    # A grid: every part of the table meets every part of the queries once.
    table = table.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(asked_parts - 1))))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(table_parts - 1))))
    cells = table.join(asked, ["dimensions", "part", "ask"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for cell in frame.itertuples(index=False):
                width = cell.dimensions
                own = np.frombuffer(cell.ask_id, "<i8")
                asked = np.frombuffer(cell.ask_value, "<f8").reshape(-1, width)
                ids = np.frombuffer(cell.part_id, "<i8")
                values = np.frombuffer(cell.part_value, "<f8").reshape(-1, width)
                query, vector, score = search_part(own, asked, ids, values, k)
                row = np.frombuffer(cell.ask_row, "<i8")
                yield pd.DataFrame(
                    {"row": row[query], "query_id": own[query], "vec_id": vector, "score": score}
                )

    found = map_frames(cells, run, "row bigint, query_id bigint, vec_id bigint, score bigint")
    # At most k rows of a query from each part of the table.
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
