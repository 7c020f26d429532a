"""Hard negatives of anchor vectors from products of integer tiles (operator 11).

Anchors and all rows are dealt to parts that meet as a grid, tile by tile. The
scores of a tile are an integer matrix product by Strassen's recursion: seven
products of quarter tiles instead of eight, with zeros where a side does not
halve. Integer additions lose nothing, so the scores are exact; the products run
in doubles where no number on the way can reach 2**53. A first pass keeps the
best rows of an anchor's label in a heap, a second one a heap for the score
window below each of them; a row below the last of a full heap is passed over.
Heaps of tiles, of tasks and of the whole table merge into one another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeclerk.llm.scratch import map_frames, ship, written

ROWS = 4096  # rows of a part of the table, at least about
ANCHORS = 2048  # anchors of a part, at least about
LARGER = 8  # times that, where the grid has cells enough
CELLS = 16  # of the grid for each core
TILE = 512  # rows and anchors of a tile
LEAF = 16  # sides up to this are multiplied directly
DOUBLE_LEAF = 32  # in doubles, which are quicker to multiply than to add up
HELD = 1 << 20  # entries of heaps a task holds before it hands them on
LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of two int64 matrices, exact modulo 2**64."""
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    depth = _depth(min(m, k, n), DOUBLE_LEAF)
    # A level doubles the numbers of both sides at most, and adds up four products.
    most = float(_largest(a)) * float(_largest(b)) * k * 16.0**depth
    if most < 2.0**53:
        a, b = a.astype(np.float64), b.astype(np.float64)
    else:
        depth = _depth(min(m, k, n), LEAF)
    whole = 1 << depth
    a = np.pad(a, ((0, -m % whole), (0, -k % whole)))
    b = np.pad(b, ((0, -k % whole), (0, -n % whole)))
    return _halved(a, b, depth)[:m, :n].astype(np.int64)


def _depth(side: int, leaf: int) -> int:
    depth = 0
    while side > leaf:
        side, depth = -(-side // 2), depth + 1
    return depth


def _largest(a: np.ndarray) -> int:
    """The greatest distance from zero; no number is turned round, as -2**63 has no opposite."""
    return max(int(a.max(initial=0)), -int(a.min(initial=0)))


def _halved(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    if not depth:
        return a @ b
    m, k, n = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:m, :k], a[:m, k:], a[m:, :k], a[m:, k:]
    b11, b12, b21, b22 = b[:k, :n], b[:k, n:], b[k:, :n], b[k:, n:]
    # Added up in place: one product at a time is held beside the result.
    product = _halved(a11 + a22, b11 + b22, depth - 1)
    out = np.empty((2 * m, 2 * n), product.dtype)
    out11, out12, out21, out22 = out[:m, :n], out[:m, n:], out[m:, :n], out[m:, n:]
    out11[:] = out22[:] = product
    out21[:] = product = _halved(a21 + a22, b11, depth - 1)
    out22 -= product
    out12[:] = product = _halved(a11, b12 - b22, depth - 1)
    out22 += product
    product = _halved(a22, b21 - b11, depth - 1)
    out11 += product
    out21 += product
    product = _halved(a11 + a12, b22, depth - 1)
    out11 -= product
    out12 += product
    out22 += _halved(a21 - a11, b11 + b12, depth - 1)
    out11 += _halved(a12 - a22, b21 + b22, depth - 1)
    return out


def scores_of(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all anchors with all rows; an error if one is no 64-bit number."""
    scores = strassen(anchors, np.ascontiguousarray(rows.T))
    if _largest(anchors) * anchors.shape[1] * _largest(rows) >= 2**62:
        # Sums are exact modulo 2**64 only: see that they are in range.
        about = anchors.astype(float) @ rows.astype(float).T
        if np.abs(about).max(initial=0) > 2.0**63 * (1 - 1e-9):
            raise OverflowError("a score does not fit 64 bits")
    return scores


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, column) of entries that hold the k greatest allowed ones of every line.

    Ties with the k-th are all given.
    """
    if scores.shape[1] > k:
        # Complements keep every 64-bit number in range and turn the order round.
        key = np.where(allowed, ~scores, np.iinfo(np.int64).max)
        bar = np.partition(key, k - 1, axis=1)[:, k - 1 : k]
        allowed = allowed & (key <= bar)
    return np.nonzero(allowed)


class Heaps:
    """The k best entries of each group: greatest score, then least id, then least row."""

    def __init__(self, k: int):
        self.k = k
        self.columns = [np.zeros(0, np.int64) for _ in range(4)]

    def merge(self, group: np.ndarray, score: np.ndarray, key: np.ndarray, row: np.ndarray) -> None:
        group, score, key, row = (
            np.concatenate(pair) for pair in zip(self.columns, (group, score, key, row))
        )
        order = np.lexsort((row, key, ~score, group))
        group, score, key, row = group[order], score[order], key[order], row[order]
        kept = np.arange(len(group)) - np.searchsorted(group, group) < self.k
        self.columns = [group[kept], score[kept], key[kept], row[kept]]

    def bars(self, groups: np.ndarray) -> np.ndarray:
        """The least score of each group's heap where it is full: what is less is none of the best."""
        group, score = self.columns[:2]
        if len(group) < self.k:
            return np.full(groups.shape, LEAST)
        end = np.searchsorted(group, groups, "right")
        full = end - np.searchsorted(group, groups) == self.k
        return np.where(full, score[np.maximum(end, 1) - 1], LEAST)


class _Tiled(dict):
    """Heaps of a task by tile of anchors, so that what is merged is as short as a tile."""

    def __init__(self, k: int):
        self.k = k

    def __missing__(self, tile: tuple) -> Heaps:
        self[tile] = Heaps(self.k)
        return self[tile]

    def held(self) -> int:
        return sum(len(heaps.columns[0]) for heaps in self.values())

    def columns(self) -> list[np.ndarray]:
        empty = np.zeros(0, np.int64)
        return [
            np.concatenate([empty, *(heaps.columns[x] for heaps in self.values())])
            for x in range(4)
        ]


def _tiles(count: int) -> Iterator[slice]:
    for begin in range(0, count, TILE):
        yield slice(begin, begin + TILE)


class _Part:
    """The columns of a packed part."""

    def __init__(self, cell: tuple, name: str):
        self.key, self.row, self.label = (
            np.frombuffer(getattr(cell, f"{name}_{c}"), "<i8") for c in ("key", "row", "label")
        )
        value = getattr(cell, f"{name}_value")
        size = len(value) // (len(self.key) * cell.dimensions)
        value = np.frombuffer(value, f"<i{size}").astype(np.int64)
        self.value = value.reshape(len(self.key), cell.dimensions)


def _packed(values: np.ndarray) -> bytes:
    """As few bytes a number as all of them have room in."""
    least, most = values.min(initial=0), values.max(initial=0)
    size = next(
        x for x in (1, 2, 4, 8) if np.iinfo(f"i{x}").min <= least and most <= np.iinfo(f"i{x}").max
    )
    return values.astype(f"<i{size}").tobytes()


def _positives_of(cell: tuple, tiled: _Tiled) -> None:
    """Rows of the anchors' labels; a group is the anchor's row number."""
    asks, rows = _Part(cell, "ask"), _Part(cell, "part")
    for i in _tiles(len(asks.key)):
        heaps = tiled[cell.dimensions, cell.ask, i.start]
        for j in _tiles(len(rows.key)):
            scores = scores_of(asks.value[i], rows.value[j])
            same = asks.label[i][:, None] == rows.label[j][None]
            same &= scores >= heaps.bars(asks.row[i])[:, None]
            same &= asks.row[i][:, None] != rows.row[j][None]
            a, b = best(scores, same, heaps.k)
            if len(a):
                heaps.merge(asks.row[i][a], scores[a, b], rows.key[j][b], rows.row[j][b])


def _negatives_of(cell: tuple, tiled: _Tiled, percent: int) -> None:
    """Rows of other labels in the window of each positive score; a group is a positive's number."""
    asks, rows = _Part(cell, "ask"), _Part(cell, "part")
    number = np.frombuffer(cell.ask_number, "<i8").reshape(len(asks.key), -1)
    most = np.frombuffer(cell.ask_score, "<i8").reshape(number.shape)
    hundreds, units = np.divmod(most, 100)
    least = percent * hundreds - (-percent * units) // 100  # rounded up, nothing overflows
    for i in _tiles(len(asks.key)):
        heaps = tiled[cell.dimensions, cell.ask, i.start]
        numbers, high, absent = number[i], most[i], number[i] < 0
        for j in _tiles(len(rows.key)):
            scores = scores_of(asks.value[i], rows.value[j])
            low = np.maximum(least[i], heaps.bars(numbers))
            # The windows of an anchor lie in one span, in which few rows are left.
            other = asks.label[i][:, None] != rows.label[j][None]
            other &= scores >= np.where(absent, -(LEAST + 1), low).min(axis=1, keepdims=True)
            other &= scores <= np.where(absent, LEAST, high).max(axis=1, keepdims=True)
            many = np.count_nonzero(other) > 4 * heaps.k * len(numbers)
            a, b = (None, None) if many else np.nonzero(other)
            found = []
            for place in range(numbers.shape[1]):
                if many:
                    inside = other & (scores >= low[:, place : place + 1])
                    inside &= scores <= high[:, place : place + 1]
                    inside &= ~absent[:, place : place + 1]
                    x, y = best(scores, inside, heaps.k)
                else:
                    inside = (scores[a, b] >= low[a, place]) & (scores[a, b] <= high[a, place])
                    inside &= ~absent[a, place]
                    x, y = a[inside], b[inside]
                found.append((numbers[x, place], scores[x, y], rows.key[j][y], rows.row[j][y]))
            if sum(len(x[0]) for x in found):
                heaps.merge(*(np.concatenate(x) for x in zip(*found)))


def _merged(cells: DataFrame, work, k: int) -> DataFrame:
    """``work`` on every cell, and the k best of each group in one heap after the other."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tiled = _Tiled(k)
        for frame in frames:
            for cell in frame.itertuples(index=False):
                work(cell, tiled)
                if tiled.held() > HELD:
                    yield pd.DataFrame(dict(zip(names, tiled.columns())))
                    tiled = _Tiled(k)
        yield pd.DataFrame(dict(zip(names, tiled.columns())))

    names = ["group", "score", "key", "row"]
    found = map_frames(cells, run, "group bigint, score bigint, key bigint, row bigint")
    # At most k entries of a group from each task; the last merge is Spark's.
    order = Window.partitionBy("group").orderBy(F.desc("score"), "key", "row")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k)


def _dealt(n_rows: int, n_anchors: int, cores: int) -> tuple[int, int]:
    """Numbers of the parts of the table and of the anchors.

    Every part goes beside all of the other side, so large ones are copied less
    often; they are as large as leaves each core its cells.
    """
    times = LARGER
    while True:
        n_parts, n_asks = (
            max(1, -(-n // (size * times))) for n, size in ((n_rows, ROWS), (n_anchors, ANCHORS))
        )
        if times == 1 or n_parts * n_asks >= CELLS * cores:
            return n_parts, n_asks
        times //= 2


def _parts(rows: DataFrame, name: str, count: int, extra: list[str]) -> DataFrame:
    """Rows dealt to ``count`` parts and packed."""
    columns = ["key", "row", "label", *extra]

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "row"])
        packed = {"dimensions": [len(frame["value"].iloc[0])], name: frame["part"][:1].to_numpy()}
        for column in columns:
            values = np.array(frame[column].tolist(), "<i8")
            packed[f"{name}_{column}"] = [values.tobytes()]
        packed[f"{name}_value"] = [_packed(np.stack(frame["value"].tolist()).astype("<i8"))]
        return pd.DataFrame(packed)

    ship(rows.sparkSession)
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(count)).cast("int"))
    schema = ", ".join(f"{name}_{column} binary" for column in [*columns, "value"])
    return dealt.groupBy("dimensions", "part").applyInPandas(
        pack, f"dimensions int, {name} int, {schema}"
    )


def _grid(parts: DataFrame, n_parts: int, asks: DataFrame, n_asks: int) -> DataFrame:
    """Every part of the table beside every part of the anchors, once.

    Joined by shuffle at every size: Spark's estimate is that of the compressed
    file and knows nothing of the copies, so it would have the driver hold them.
    """
    parts = parts.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(n_asks - 1))))
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    return parts.join(asks.hint("merge"), ["dimensions", "part", "ask"])


def hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    percent: int = 80,
) -> DataFrame:
    """The first negatives of every anchor and positive.

    Components x count as floor(scale * x); a row's score is its inner product
    with the anchor. Higher scores come first, ties by the smaller key. An
    anchor's positives are its first ``positives`` other rows of the same
    label; for each the first ``negatives`` rows of another label are given
    whose score is at most the positive's and at least ``percent`` hundredths
    of it. Returns ``anchor_id, positive_id, rank`` (from 1 among those
    returned)``, negative_id, positive_score, negative_score``.

    Rows without a key, a label or a vector take no part, nor do empty vectors
    and those with a null or a component that is not finite. Vectors of another
    length than the anchor's are no rows of it. Every row is a vector of its
    own: of a repeated key each row is an anchor, a positive and a negative,
    and only the anchor's very row is left out; equal scores of one key are in
    the order of the rows. A component or a score beyond 64 bits fails the job.
    """
    x = F.transform(F.col(vector), lambda v: v.cast("double") * scale)
    fit = F.forall(
        F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    )
    beyond = F.raise_error(F.lit("a component does not fit 64 bits")).cast("bigint")
    rows = vectors.where(
        F.col(key).isNotNull() & label.isNotNull() & (F.size(vector) > 0) & fit
    ).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).cast("long").alias("key"),
        label.cast("long").alias("label"),
        F.transform(x, lambda v: F.when(F.abs(v) < 2.0**63, F.floor(v)).otherwise(beyond)).alias(
            "value"
        ),
        F.size(vector).alias("dimensions"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    )
    rows = written(rows, "negative-rows")
    asking = rows.where("asks").drop("asks")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_parts, n_asks = _dealt(rows.count(), asking.count(), cores)
    packed = written(_parts(rows.drop("asks"), "part", n_parts, []), "negative-parts")
    asks = _parts(asking, "ask", n_asks, [])
    near = written(_merged(_grid(packed, n_parts, asks, n_asks), _positives_of, positives), "positives")
    # The positives of an anchor by rank, each with a number of its own.
    ranked = near.select(
        F.col("group").alias("row"),
        F.struct(
            F.col("rank"),
            (F.col("group") * positives + F.col("rank") - 1).alias("number"),
            F.col("score"),
            F.col("key"),
        ).alias("positive"),
    )
    lists = ranked.groupBy("row").agg(F.sort_array(F.collect_list("positive")).alias("found"))
    absent = F.sequence(F.size("found"), F.lit(positives - 1))
    absent = F.when(F.size("found") < positives, absent).otherwise(F.array().cast("array<int>"))
    padding = F.transform(absent, lambda _: F.lit(-1).cast("bigint"))
    with_windows = asking.join(lists.hint("merge"), "row").select(
        *asking.columns,
        F.concat(F.col("found.number"), padding).alias("number"),
        F.concat(F.col("found.score"), padding).alias("score"),
    )
    asks = _parts(written(with_windows, "negative-asks"), "ask", n_asks, ["number", "score"])
    cells = _grid(packed, n_parts, asks, n_asks)
    far = _merged(cells, lambda cell, tiled: _negatives_of(cell, tiled, percent), negatives)
    known = near.select(
        (F.col("group") * positives + F.col("rank") - 1).alias("number"),
        F.col("group").alias("anchor"),
        F.col("key").alias("positive_id"),
        F.col("score").alias("positive_score"),
    )
    anchors = asking.select(F.col("row").alias("anchor"), F.col("key").alias("anchor_id"))
    return (
        far.select(
            F.col("group").alias("number"),
            "rank",
            F.col("key").alias("negative_id"),
            F.col("score").alias("negative_score"),
        )
        .join(known.hint("merge"), "number")
        .join(anchors.hint("merge"), "anchor")
        .select(
            "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
        )
    )
