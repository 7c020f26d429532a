"""Operators that bring rows together: near copies, passages, leaks, top-k, order."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F

from lakeclerk.llm import decontam, neardup, passages, topk, training_order
from lakeclerk.llm.graph import components
from lakeclerk.llm.queries import RANKS
from lakeclerk.llm.scratch import map_frames

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, doc string, same int"


def prose(count, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 9))) for _ in range(count)]


def edited(words, every, seed):
    draw = random.Random(seed)
    return [w if i % every else prose(1, draw.random())[0] for i, w in enumerate(words, 1)]


def frame(spark, rows):
    return spark.createDataFrame([(key, text, "clash", 1) for key, text in rows], DOCS)


def words_of(text):
    return regex.findall(r"[\p{L}\p{M}\p{N}]+", (text or "").lower())


# ---------------------------------------------------------- components


def test_components_match_union_find(spark):
    draw = random.Random(4)
    edges = [(draw.randint(0, 60), draw.randint(0, 60)) for _ in range(45)]
    edges += [(100 + i, 101 + i) for i in range(25)] + [(200, 200 + i) for i in range(1, 40)]
    edges += [(5, 5), (None, 3), (7, None), edges[0]]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    found = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {row.node: row.component for row in found} == {x: root(x) for x in parent}
    assert len(found) == len(parent)


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).isEmpty()


# --------------------------------------------------------- near copies


def test_classes_of_planted_copies(spark):
    a, b = prose(300, 1), prose(200, 2)
    rows = [
        (1, " ".join(a)),
        (2, " ".join(a).upper() + "!"),
        (3, " ".join(edited(a, 30, 3))),
        (4, " ".join(edited(a, 25, 4))),
        (10, " ".join(b)),
        (11, " ".join(b[100:] + b[:100])),
        (12, " ".join(prose(200, 5))),
        (20, None),
        (21, None),
        (22, ""),
        (23, "!!"),
        (24, "!!"),
        (25, "one two"),
        (26, "one two"),
        (27, "one three"),
        (30, " ".join(prose(20_000, 6))),
        (31, " ".join(edited(prose(20_000, 6), 50, 7))),
        (None, " ".join(a)),
        (40, " ".join(b[:150])),
        (40, " ".join(prose(150, 8))),
    ]
    found = neardup.near_duplicates(frame(spark, rows))
    assert found.columns == ["doc_id", "class_id", "n_links"] and found.count() == len(rows)
    classes = {row.doc_id: row.class_id for row in found.collect()}
    assert [classes[k] for k in (1, 2, 3, 4)] == [1, 1, 1, 1]
    assert [classes[k] for k in (10, 11, 12)] == [10, 11, 12]
    assert [classes[k] for k in (20, 21, 22, 23, 24)] == [20, 21, 22, 23, 23]
    assert [classes[k] for k in (25, 26, 27)] == [25, 25, 27]
    assert classes[30] == classes[31] == 30 and classes[None] is None and classes[40] == 40
    kept = neardup.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "doc", "same"]
    ids = [row.doc_id for row in kept.collect()]
    assert not {2, 3, 4, 24, 26, 31} & set(ids) and ids.count(40) == 2 and None in ids


def test_near_copies_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    words = {row.doc_id: words_of(row.text) for row in docs.collect()}
    code = {}
    arrays = {
        k: np.array([code.setdefault(w, len(code)) for w in v], np.uint32) for k, v in words.items()
    }
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()}
    keys = sorted(k for k, v in words.items() if len(v) >= 15)
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :]]
    most = [int(0.2 * max(len(words[a]), len(words[b])) + 1e-9) for a, b in pairs]
    near = neardup.distances([(arrays[a], arrays[b]) for a, b in pairs], most)
    linked = [pair for pair, found in zip(pairs, near) if found is not None]
    assert linked and all(classes[a] == classes[b] for a, b in linked)
    for key, name in classes.items():
        if key != name and len(words[key]) >= 15:
            assert any(key in pair for pair in linked)


def test_links_under_a_first_text_like_neither(spark, monkeypatch):
    a, b = prose(100, 60), prose(100, 61)
    # Each holds all of a text and is too long to be like it, or like another one.
    rows = [(k, " ".join(a + prose(32, 100 + k))) for k in range(60)]
    rows += [(100, " ".join(a)), (101, " ".join(edited(a, 10, 62)))]
    rows += [(k, " ".join(b + prose(32, 200 + k))) for k in range(200, 240)]
    rows += [(300 + k, " ".join(edited(b, 9 + k, 63 + k))) for k in range(6)]
    wanted = {k: k for k, _ in rows} | {101: 100} | {300 + k: 300 for k in range(6)}
    for block in (neardup.BLOCK, 3):
        monkeypatch.setattr(neardup, "BLOCK", block)
        found = neardup.near_duplicates(frame(spark, rows)).collect()
        assert {r.doc_id: r.class_id for r in found} == wanted
        assert {r.doc_id for r in found if r.n_links} == {100, 101, *range(300, 306)}


def test_a_text_of_four_words_is_like_one_of_five(spark):
    words = prose(5, 64)
    rows = [(1, " ".join(words)), (2, " ".join(words[:2] + words[3:])), (3, " ".join(prose(4, 65)))]
    rows += [(4, " ".join([*words[:2], "other", *words[3:]])), (5, " ".join(words[:3]))]
    classes = {r.doc_id: r.class_id for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5}


def test_bags_rule_no_link_out():
    draw = np.random.default_rng(8)
    for _ in range(300):
        a = draw.integers(0, 2**64, 30, np.uint64)[draw.integers(0, 30, draw.integers(5, 600))]
        b = a[draw.random(len(a)) > 0.1]
        b[draw.random(len(b)) < 0.08] = np.uint64(7)
        size = max(len(a), len(b))
        near = neardup.distances([(a, b)], [int(0.2 * size + 1e-9)])[0] is not None
        bags = [neardup._counts([neardup.bag_of(x).tobytes()]) for x in (a, b)]
        for some in (bags, [neardup._rough(x) for x in bags]):
            passed = neardup.bags_near(*some, np.array([len(a)]), np.array([len(b)]), 0.8)[0]
            assert passed or not near


def test_a_pair_of_a_group_leaves_python_once(spark, monkeypatch):
    made = []

    def kept(*args):
        made.append(map_frames(*args))
        return made[-1]

    monkeypatch.setattr(neardup, "map_frames", kept)
    # A passage holds all together; the same words follow in orders of their own.
    passage, words, draw = prose(40, 70), prose(60, 71), np.random.default_rng(72)
    rows = [(k, " ".join([*passage, *draw.permutation(words)])) for k in range(40)]
    near = prose(100, 73)
    rows += [(100 + k, " ".join(edited(near, 20, 74 + k))) for k in range(20)]
    described = neardup._described(neardup._texts(frame(spark, rows), "doc_id", "text")).cache()
    _, shared = neardup._candidates(neardup._entry_rows(described))
    alone = spark.createDataFrame([], "node bigint, component bigint")
    for block in (neardup.BLOCK, 7):
        monkeypatch.setattr(neardup, "BLOCK", block)
        found = neardup._across(neardup._between(shared, alone), described.drop("same"), 0.8).collect()
        together = {(100 + b, 100 + a) for a in range(20) for b in range(a + 1, 20)}
        # The words of the first ones do not tell them apart: 780 pairs, which dozens of groups hold.
        same = {(b, a) for a in range(40) for b in range(a + 1, 40)}
        assert {(r.doc, r.leader) for r in found} == same | together
        assert made[-1].count() == len(found)


def test_no_documents(spark):
    assert neardup.near_duplicates(frame(spark, [])).isEmpty()
    assert passages.repeated_passages(frame(spark, [])).isEmpty()


def test_sketches_find_edits_by_order():
    a = np.array([hash((1, w)) & (2**63 - 1) for w in prose(400, 9)], np.uint64)
    swapped = np.concatenate([a[200:], a[:200]])
    few = a.copy()
    few[::40] += np.uint64(1)
    same = lambda b: int((neardup.sketch(a) == neardup.sketch(b)).sum())
    assert same(a) == neardup.ENTRIES and same(few) > same(swapped)
    assert len(neardup.sketch(a[:4])) == 0 and len(neardup.sketch(a[:5])) == neardup.ENTRIES
    again = neardup.labelled(np.array([5, 5, 7], np.uint64))
    assert len(set(again.tolist())) == 3


# ------------------------------------------------------------- passages


def best_chain(runs):
    """All chains, by trying every predecessor."""
    order = sorted(range(len(runs)), key=lambda r: runs[r][0])
    best = {}
    for r in order:
        i, j, n = runs[r]
        gains = [
            best[q] - passages.GAP_COST * (i - runs[q][0] - runs[q][2] + j - runs[q][1] - runs[q][2])
            for q in best
            if runs[q][0] + runs[q][2] <= i and runs[q][1] + runs[q][2] <= j
        ]
        best[r] = n + max([0.0, *gains])
    return max(best.values())


def test_fenwick_chains_are_the_best():
    draw = random.Random(6)
    for _ in range(60):
        runs = np.array(
            [[draw.randint(0, 90), draw.randint(0, 90), draw.randint(1, 12)] for _ in range(draw.randint(1, 12))]
        )
        chain = passages.chains(runs)[0]
        rows = [tuple(runs[r].tolist()) for r in chain]
        score = rows[0][2]
        for (i, j, n), (k, m, size) in zip(rows, rows[1:]):
            assert i + n <= k and j + n <= m
            score += size - passages.GAP_COST * (k - i - n + m - j - n)
        assert score == pytest.approx(best_chain([tuple(x) for x in runs.tolist()]))
        every = sorted(r for c in passages.chains(runs) for r in c)
        assert every == list(range(len(runs)))


def test_planted_passages(spark):
    p, q = prose(60, 20), prose(80, 21)
    text = lambda n, seed: prose(n, seed)
    rows = [
        (1, text(90, 22) + p + text(40, 23)),
        (2, text(10, 24) + p + text(70, 25)),
        (3, text(33, 26) + edited(p, 21, 27) + text(20, 28) + q),
        (4, q + text(200, 29)),
        (5, text(300, 30)),
        (6, p[:30] + text(100, 31)),
        (8, text(10, 24) + p + text(70, 25)),
    ]
    rows = [(key, " ".join(words)) for key, words in rows]
    rows += [(None, rows[0][1]), (9, None), (10, ""), (11, "a b c"), (12, "a b c")]
    found = passages.repeated_passages(frame(spark, rows)).collect()
    near = {(r.doc_id, r.source_id) for r in found}
    assert near == {(2, 1), (3, 1), (4, 3), (8, 2)}
    at = {r.doc_id: (r.word_begin, r.word_end, r.source_begin, r.similarity) for r in found}
    assert at[2] == (10, 70, 90, 1.0) and at[4] == (0, 80, 113, 1.0) and at[8][:2] == (0, 140)
    assert at[3][0] == 33 and at[3][1] in range(90, 94) and 0.9 < at[3][3] < 1
    cut = passages.cut_passages(
        frame(spark, rows), passages.repeated_passages(frame(spark, rows))
    )
    assert cut.columns == ["doc_id", "text", "doc", "same"] and cut.count() == len(rows)
    texts = {row.doc_id: row.text for row in cut.collect()}
    assert words_of(texts[2]) == prose(10, 24) + prose(70, 25)
    assert words_of(texts[4]) == prose(200, 29) and texts[9] is None


def test_passages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    words = {row.doc_id: words_of(row.text) for row in docs.collect()}
    runs = defaultdict(set)
    for key, some in words.items():
        for i in range(len(some) - 49):
            # One word over and over again has too few places to begin.
            if len(set(some[i : i + 50])) > 10:
                runs[tuple(some[i : i + 50])].add(key)
    wanted = set().union(*[keys - {min(keys)} for keys in runs.values()])
    found = {r.doc_id for r in passages.repeated_passages(docs).collect()}
    assert wanted and wanted <= found


def test_passages_beyond_the_first_holders_of_their_seeds(spark):
    # Every seed of p stands first in a text that has too little of it.
    p, text = prose(60, 50), prose
    rows = [
        (1, text(30, 51) + p[:40] + text(30, 52)),
        (2, text(20, 53) + p[20:] + text(40, 54)),
        *((key, text(25, 55 + key) + p[10:50] + text(25, 75 + key)) for key in range(3, 9)),
        (9, text(50, 100) + p + text(10, 101)),
        (10, text(5, 102) + p + text(50, 103)),
        (11, text(9, 104) + p[:50] + text(50, 105)),
    ]
    found = passages.repeated_passages(frame(spark, [(key, " ".join(words)) for key, words in rows])).collect()
    near = {(r.doc_id, r.source_id) for r in found}
    assert (10, 9) in near and {key for key, _ in near} == {10, 11}
    assert [r[1:3] for r in found if r.doc_id == 10] == [(5, 65)]


def hashed(words):
    return np.array([hash(("w", w)) & (2**63 - 1) for w in words], np.uint64)


def test_a_run_of_a_passage_has_a_spot():
    for seed in range(80):
        p = prose(48, 200 + seed)
        keys = []
        for side in (1, 2):
            words = hashed(prose(40 * side, 300 * side + seed) + p + prose(60, 700 * side + seed))
            keys.append(set(passages.spots(*passages.minimizers(words), 48)[0].tolist()))
        assert keys[0] & keys[1]


def test_passages_of_words_that_repeat_in_the_source():
    p, q = prose(60, 900), prose(20, 901)
    a, b = hashed(p), hashed(p[:30] + q + p + q + p[10:])
    assert passages.common_passages(a, b)[0][:2] == (0, 60)
    # One word over and over: all of it is in passages, few of them.
    a, b = hashed(["x"] * 500 + q), hashed(q + ["x"] * 60 + prose(9, 902))
    found = passages.common_passages(a, b)
    assert set().union(*(range(x[0], x[1]) for x in found)) >= set(range(500)) and len(found) < 20


def test_edited_passages_of_short_matches():
    draw, found = np.random.default_rng(7), 0
    for seed in range(60):
        p = prose(60, 1000 + seed)
        other = list(p)
        for x in draw.choice(60, 6, replace=False):
            other[x] = f"other{x}"
        found += bool(passages.common_passages(hashed(prose(9, seed) + p), hashed(other + prose(5, seed + 500))))
    assert found > 48


# ---------------------------------------------------------------- leaks


def test_leaks_match_containment(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = {r.item_id: words_of(r.text) for r in bench.collect()}
    item = next(k for k, v in items.items() if len(v) >= 30)
    changed = [w if i % 6 else "zz" for i, w in enumerate(items[item], 1)]
    loose = [w if i % 3 else "zz" for i, w in enumerate(items[item][:-12], 1)] + items[item][-12:]
    planted = [
        (-1, " ".join(prose(60, 40) + items[item] + prose(40, 41)).upper()),
        (-2, " ".join(prose(30, 42) + changed + prose(40, 43))),
        (-3, " ".join(prose(25, 44) + loose + prose(40, 45))),
        (-4, " ".join(prose(300, 46))),
        (-5, None),
        (-6, ""),
        (None, " ".join(items[item])),
        (-7, " ".join(items[item])),
        (-7, " ".join(items[item])),
    ]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema)).withColumn(
        "item_id", F.lit("clash")
    )
    odd = spark.createDataFrame([(None, "x"), (90, None), (91, ""), (92, "the of")], bench.schema)
    rows = decontam.benchmark_leaks(docs, bench.unionByName(odd)).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    wanted = {
        (r.doc_id, k)
        for r in docs.collect()
        for k, v in items.items()
        if r.doc_id is not None and " " + " ".join(v) + " " in " " + " ".join(words_of(r.text)) + " "
    }
    assert wanted and wanted <= found
    assert {(-2, item), (-3, item)} <= found and len([r for r in rows if r.doc_id == -7]) == 2
    assert not [pair for pair in found if pair[0] in (-4, -5, -6, None)]
    assert {pair for pair in found - wanted if pair[0] >= 0} == set()
    left = decontam.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    kept = [r.doc_id for r in left.collect()]
    assert {-4, -5, -6, None} <= set(kept) and not {k for k, _ in found} & set(kept)


def test_leaks_of_empty_tables(spark):
    docs = frame(spark, [(1, "a b c")])
    bench = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id bigint, text string")
    assert decontam.benchmark_leaks(docs.limit(0), bench).isEmpty()
    assert decontam.benchmark_leaks(docs, bench.limit(0)).isEmpty()


def test_common_subsequence():
    draw = random.Random(1)
    for _ in range(100):
        a, b = ([draw.randint(0, 4) for _ in range(draw.randint(1, 20))] for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
            row = new
        assert decontam.common_subsequence(a, b) == row[-1]


# ---------------------------------------------------------------- top-k


def test_topk_matches_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    data = [(r.vec_id, np.floor(64 * np.array(r.embedding, float)).astype(int)) for r in rows.collect()]
    found = defaultdict(list)
    for r in topk.top_inner_products(rows, F.col("vec_id") % 20 == 0).collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    for key, vector in data:
        if key % 20 == 0:
            best = sorted((-int(vector @ other), k) for k, other in data if k != key)[:20]
            wanted = [(i, k, -s) for i, (s, k) in enumerate(best, 1)]
            assert sorted(found.pop(key)) == wanted
    assert not found


def test_rounds_bound_and_ties_hold():
    draw = np.random.default_rng(3)
    values = draw.integers(-4, 5, (700, 6)).astype(float)
    asked = draw.integers(-4, 5, (30, 6)).astype(float)
    ids, own = np.arange(700) * 2, np.arange(30) * 2
    lists = topk.Lists(ids, values, np.float64)
    scores = asked @ values.T
    for number in range(len(topk.ROUNDS)):
        assert (lists.lower(asked, number) <= scores).all()
        assert (lists.upper(asked, number) >= scores).all()
    query, vector, score = topk.search_part(own, asked, ids, values, 20)
    for i in range(30):
        best = sorted((-s, k) for k, s in zip(ids, scores[i]) if k != own[i])[:20]
        mine = query == i
        assert list(zip(-score[mine], vector[mine])) == best


def test_topk_of_odd_rows(spark):
    rows = spark.createDataFrame(
        [
            (1, [1.0, 2.0]),
            (2, [1.0, 2.0]),
            (20, [1.0, None]),
            (None, [1.0, 1.0]),
            (40, [1.0, 1.0]),
            (40, [2.0, 1.0]),
            (60, None),
            (80, []),
            (100, [1.0]),
            (120, [float("nan"), 1.0]),
            (140, [float("inf"), 1.0]),
        ],
        "vec_id bigint, embedding array<double>",
    ).withColumn("score", F.lit("clash"))
    found = topk.top_inner_products(rows, F.col("vec_id") % 20 == 0)
    assert sorted(tuple(r) for r in found.collect()) == [
        (40, 1, 1, 12288),
        (40, 1, 1, 16384),
        (40, 2, 2, 12288),
        (40, 2, 2, 16384),
    ]
    assert topk.top_inner_products(rows.limit(0), F.col("vec_id") % 20 == 0).isEmpty()


# ------------------------------------------------------- training order


@pytest.mark.parametrize("count", [1, 2, 3, 16, 17, 1000, 4097])
def test_slots_are_a_permutation(count):
    places = np.arange(count)
    slots = training_order.permuted(places, count)
    assert sorted(slots.tolist()) == places.tolist()
    assert (training_order.permuted(slots, count, back=True) == places).all()
    if count > 100:
        other = training_order.permuted(places, count, key=1)
        assert (slots != places).mean() > 0.9 and (slots != other).mean() > 0.9


def test_shards_hold_every_sequence_in_order(spark, folder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame(
        [(None, "no key"), (-1, None), (-2, ""), (-3, "twice"), (-3, "twice")], docs.schema
    )
    docs = docs.unionByName(extra).withColumn("slot", F.lit("clash"))
    path = f"{folder}/order"
    count = training_order.write_training_order(
        docs, path, RANKS, public_tokenizers.PATTERN, shard=64
    )
    rows = training_order.read_training_order(spark, path, shard=64).collect()
    assert sorted(r.slot for r in rows) == list(range(count))
    assert {len(r.ids) for r in rows} == {2 * training_order.LENGTH}
    assert all(r.shard == r.slot // 64 for r in rows)
    library = training_order.encoding(RANKS, public_tokenizers.PATTERN)
    texts = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.part):
        ids = np.frombuffer(r.ids, "<u2")
        assert (ids[r.n_ids :] == training_order.END).all()
        texts[r.doc_id].append(ids[: r.n_ids].tolist())
    for r in docs.where("doc_id is null or doc_id >= 0").collect():
        ids = [i for part in texts.pop(r.doc_id) for i in part]
        assert ids == [*library.encode_ordinary(r.text), training_order.END]
    assert list(texts) == [-3] and len(texts[-3]) == 2
    # One file a shard, its slots in order; a late start opens the last ones only.
    later = training_order.read_training_order(spark, path, count - 70, shard=64)
    assert later.count() == 70
    for number in range(-(-count // 64)):
        shard = spark.read.parquet(f"{path}/shard={number}")
        assert len(shard.inputFiles()) == 1
        slots = [r.slot for r in shard.coalesce(1).collect()]
        assert slots == sorted(slots) and slots[0] == number * 64


def test_order_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert training_order.sequence_digests(empty, RANKS, public_tokenizers.PATTERN).isEmpty()
