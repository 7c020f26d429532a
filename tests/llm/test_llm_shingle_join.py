"""The n-gram Jaccard join against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from lakeclerk.llm import shingle_join
from lakeclerk.llm.queries import op13_ngram_jaccard_join

SMALL = "/root/testdata/sf0.001"


def brute(rows, percent=80):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        size = min(5, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return sorted(
        ((key, len(sets[i]), least.get(find(i))) for i, (key, _) in enumerate(rows)), key=str
    )


def found(spark, rows, percent=80, parts=3):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    out = shingle_join.shingle_components(docs, percent=percent)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def words(draw, n, alphabet=400):
    return [f"w{draw.randrange(alphabet)}" for _ in range(n)]


def variant(draw, base, edits):
    base = list(base)
    for _ in range(edits):
        at = draw.randrange(len(base))
        base[at : at + 1] = draw.choice([[], [f"x{draw.random()}"], [base[at], "more"]])
    return base


def collection(seed, families=12, size=12):
    draw = random.Random(seed)
    line = words(draw, 30)
    rows = []
    for _ in range(families):
        base = words(draw, draw.choice([6, 9, 20, 40, 90, 200]))
        if draw.random() < 0.5:
            base = line + base
        for _ in range(size):
            rows.append(" ".join(variant(draw, base, draw.randrange(4))))
    rows += [" ".join(words(draw, 60)) for _ in range(30)]
    draw.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed", range(2))
def test_families_of_variants(spark, seed):
    rows = collection(seed)
    assert found(spark, rows) == brute(rows)


def test_frequent_keys_go_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SMALL", 4)
    monkeypatch.setattr(shingle_join, "BLOCK", 8)
    monkeypatch.setattr(shingle_join, "RARE", 3)
    rows = collection(7, families=4, size=40)
    assert found(spark, rows) == brute(rows)


def test_another_bar(spark):
    rows = collection(9, families=6)
    assert found(spark, rows, percent=60) == brute(rows, 60)


def test_odd_rows(spark):
    long = " ".join(words(random.Random(3), 5_000, 50_000))
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo"), (6, "one two three"),
        (7, "a b c d e"), (8, "A B  C D E"), (9, "É b c d e"), (10, "é b c d e"),
        (None, "a b c d e"), (None, "alone with no key at all"), (7, "a b c d e"), (7, "other text"),
        (11, long), (12, long + " more"), (13, "x y"), (13, "x y"),
        (20, "p q r s t u v w"), (21, "p q r s t u v w z"), (22, "nothing"),
    ]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_clashing_names(spark):
    schema = "doc_id bigint, text string, row int, same string, key string, n int"
    none = spark.createDataFrame([], schema)
    assert shingle_join.shingle_components(none).collect() == []
    one = spark.createDataFrame([(5, "a b", 1, "s", "k", 2), (4, "a b", 1, "s", "k", 2)], schema)
    out = {tuple(r) for r in shingle_join.shingle_components(one).collect()}
    assert out == {(5, 1, 4), (4, 1, 4)}


def test_keys_meet_for_every_similar_pair():
    """Without Spark: two similar sets share a key whatever the numbers of holders."""
    draw = np.random.default_rng(5)
    for _ in range(400):
        n = int(draw.integers(4, 200))
        a = np.unique(draw.integers(0, 2**63, n).astype(np.uint64))
        gone = int(draw.integers(0, len(a) // 5 + 1))
        b = np.unique(np.concatenate([
            draw.permutation(a)[gone:], draw.integers(0, 2**63, gone // 2).astype(np.uint64)
        ]))
        both = len(np.intersect1d(a, b))
        if both * 100 < 80 * (len(a) + len(b) - both):
            continue
        every = np.union1d(a, b)
        holders = 2 + draw.integers(0, 30, len(every))
        keys = []
        for s in (a, b):
            first, _ = shingle_join.leading(s, 80)
            count = holders[np.searchsorted(every, first)]
            count[~np.isin(first, np.intersect1d(a, b))] = 1
            keys.append(shingle_join.index_keys(first, count, len(s), 80))
        assert len(np.intersect1d(*keys))


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    out = sorted((tuple(r) for r in op13_ngram_jaccard_join(spark, SMALL).collect()), key=str)
    assert out == brute([(r.doc_id, r.text) for r in docs])
