"""Hard negatives against brute force and SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeclerk.llm import hard_negatives as hn
from lakeclerk.llm.queries import ORACLE_SQL, op11_hard_negatives

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<double>, label int"


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 70, 5), (64, 64, 64), (130, 33, 257), (17, 200, 90)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    draw = np.random.default_rng(sum(shape))
    a = draw.integers(-(2**27), 2**27, (m, k))
    b = draw.integers(-(2**27), 2**27, (k, n))
    expected = [[sum(int(x) * int(y) for x, y in zip(row, col)) for col in b.T] for row in a[:4]]
    assert hn.strassen(a, b)[:4].tolist() == expected
    assert (hn.strassen(a, b) == a @ b).all()


def test_scores_near_and_beyond_64_bits():
    big = np.array([[2**31, 2**30]])
    assert hn.scores_of(big, np.array([[2**31, -(2**31)]])).tolist() == [[2**62 - 2**61]]
    with pytest.raises(OverflowError):
        hn.scores_of(np.array([[2**40]]), np.array([[2**30]]))


def test_heaps_merge_in_any_order():
    draw = random.Random(1)
    entries = [(draw.randrange(4), draw.randrange(-5, 5), draw.randrange(9), i) for i in range(300)]
    expected = []
    for group in range(4):
        mine = [e for e in entries if e[0] == group]
        expected += sorted(mine, key=lambda e: (-e[1], e[2], e[3]))[:6]
    for cut in (1, 7, 300):
        draw.shuffle(entries)
        heaps = hn.Heaps(6)
        for at in range(0, len(entries), cut):
            heaps.merge(*np.array(entries[at : at + cut]).T)
        assert list(zip(*(c.tolist() for c in heaps.columns))) == expected


def brute(rows, every=100, scale=256, positives=5, negatives=5, percent=80):
    fit = []
    for place, (key, vector, label) in enumerate(rows):
        if key is None or label is None or not vector:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        fit.append((place, key, [math.floor(scale * x) for x in vector], label))
    out = []
    for place, key, vector, label in fit:
        if key % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(vector, v)), k, p, m)
            for p, k, v, m in fit
            if p != place and len(v) == len(vector)
        ]
        same = sorted(s for s in scored if s[3] == label)[:positives]
        for positive, positive_id, *_ in same:
            inside = [
                s for s in scored
                if s[3] != label and percent * -positive <= 100 * -s[0] <= 100 * -positive
            ]
            for rank, (score, negative_id, *_) in enumerate(sorted(inside)[:negatives], 1):
                out.append((key, positive_id, rank, negative_id, -positive, -score))
    return sorted(out)


def found(spark, rows, **options):
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = hn.hard_negatives(vectors, F.col("vec_id") % 100 == 0, F.col("label"), **options)
    assert out.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    ]
    return sorted(tuple(r) for r in out.collect())


def random_rows(seed, count, ids=None):
    draw = random.Random(seed)
    return [
        (
            ids[i] if ids else i,
            [draw.choice([-0.5, 0.0, 0.25, 0.3, 1.0]) for _ in range(6)],
            draw.randrange(3),
        )
        for i in range(count)
    ]


def test_many_parts_and_ties(spark, monkeypatch):
    monkeypatch.setattr(hn, "ROWS", 50)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    monkeypatch.setattr(hn, "TILE", 16)
    monkeypatch.setattr(hn, "HELD", 10)
    rows = random_rows(4, 700)
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, positives=2, negatives=7, percent=50) == brute(
        rows, positives=2, negatives=7, percent=50
    )


def test_odd_rows(spark):
    rows = random_rows(5, 320)
    rows += [(None, [1.0] * 6, 1), (400, None, 1), (500, [1.0] * 6, None), (600, [], 1)]
    rows += [(700, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (800, [math.nan] + [1.0] * 5, 1)]
    rows += [(900, [math.inf] + [1.0] * 5, 1), (1000, [1.0, 2.0], 1), (1001, [2.0, 1.0], 1)]
    rows += [(1002, [1.0, 1.0], 2), (-100, [0.5] * 6, 2), (1100, [1.0] * 6, 9)]
    rows += [(1200, [1e6, 3.7e6], 1), (1201, [2e7, 1e7], 1), (1202, [1.9e7, 1e7], 0)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(100, [1.0], 1)]) == []


def test_repeated_rows(spark):
    rows = random_rows(6, 120, [100 * (i % 4) + i // 40 for i in range(120)])
    # Rows of one key with equal scores are alike in the result, whatever their order.
    assert found(spark, rows) == brute(rows)


def test_a_component_beyond_64_bits_fails(spark):
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(100, [1e30], 1), (1, [1.0], 1)])


def test_extra_columns(spark):
    rows = random_rows(8, 150)
    vectors = spark.createDataFrame(
        [(*r, 1, "x", 5) for r in rows], SCHEMA + ", row int, value string, rank int"
    )
    out = hn.hard_negatives(vectors, F.col("vec_id") % 100 == 0, F.col("label"))
    assert sorted(tuple(r) for r in out.collect()) == brute(rows)


def test_query(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SMALL}/embeddings.parquet'")
    out = op11_hard_negatives(spark, SMALL)
    names = ", ".join(out.columns)
    expected = db.execute(f"SELECT {names} FROM ({ORACLE_SQL['op11_hard_negatives']})").fetchall()
    assert expected and sorted(tuple(r) for r in out.collect()) == sorted(expected)


def test_the_grid_is_never_broadcast(spark):
    # The copies of a part are no part of Spark's estimate; a driver would have to hold all of them.
    parts = spark.createDataFrame([(2, x, b"1") for x in range(5)], "dimensions int, part int, part_value binary")
    asks = spark.createDataFrame([(2, x, b"2") for x in range(3)], "dimensions int, ask int, ask_value binary")
    cells = hn._grid(parts, 5, asks, 3)
    assert sorted((r.part, r.ask) for r in cells.collect()) == [(x, y) for x in range(5) for y in range(3)]
    assert "Broadcast" not in cells._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_table():
    assert hn._dealt(0, 0, 6) == (1, 1) and hn._dealt(51_282, 513, 6) == (13, 1)
    for rows, anchors in ((615_384, 6_156), (15_000_000, 150_000), (100_000, 100_000)):
        n_parts, n_asks = hn._dealt(rows, anchors, 6)
        assert n_parts * n_asks >= 96 and n_parts * hn.ROWS * hn.LARGER >= rows
        assert n_asks * hn.ANCHORS * hn.LARGER >= anchors
        # Copies of either side: fewer than with the least parts.
        assert rows * n_asks + anchors * n_parts <= rows * -(-anchors // hn.ANCHORS) + anchors * -(-rows // hn.ROWS)


@pytest.mark.parametrize("reach", [100, 2**20, 2**25, 2**30])
def test_products_in_doubles_and_in_integers_are_the_same(reach):
    draw = np.random.default_rng(reach)
    a, b = draw.integers(-reach, reach, (70, 64)), draw.integers(-reach, reach, (90, 64))
    assert (hn.strassen(a, b.T.copy()) == a @ b.T).all()
    values = np.concatenate([a, b]).astype("<i8")
    size = len(hn._packed(values)) // values.size
    assert (np.frombuffer(hn._packed(values), f"<i{size}") == values.ravel()).all() and size == (1 if reach == 100 else 4)


def test_bars_are_the_last_of_full_heaps():
    heaps = hn.Heaps(2)
    heaps.merge(*np.array([(3, 9, 1, 1), (3, 7, 2, 2), (3, 8, 3, 3), (5, 4, 4, 4)]).T)
    assert heaps.bars(np.array([[3, 5], [4, -1]])).tolist() == [[8, hn.LEAST], [hn.LEAST, hn.LEAST]]
