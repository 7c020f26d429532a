"""Each operator does its whole job where a cut once left some out."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakeclerk.llm import decontam, license_scan, neardup, topk

SMALL = "/root/testdata/sf0.001"

DOCS = "doc_id bigint, text string"
ITEMS = "item_id bigint, text string"


def prose(count, seed):
    draw = random.Random(seed)
    return ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 9))) for _ in range(count)]


def frame(spark, rows):
    return spark.createDataFrame([(key, " ".join(words)) for key, words in rows], DOCS)


def found_leaks(docs, bench):
    return {(r.doc_id, r.item_id) for r in decontam.benchmark_leaks(docs, bench).collect()}


# ---------------------------------------------------------------- leaks


def test_an_item_in_a_third_of_the_documents_is_found(spark):
    item = prose(30, 1)
    loose = [w if i % 3 else "zz" for i, w in enumerate(item[:-8], 1)] + item[-8:]
    rows = [(k, prose(40, 100 + k) + item + prose(40, 200 + k)) for k in range(60)]
    rows += [(k, prose(110, 100 + k)) for k in range(60, 180)]
    rows += [(900, prose(40, 3) + loose + prose(40, 4))]
    bench = spark.createDataFrame([(7, " ".join(item))], ITEMS)
    assert found_leaks(frame(spark, rows), bench) == {(k, 7) for k in [*range(60), 900]}


def test_an_item_is_found_in_a_table_of_three_documents(spark):
    item = prose(20, 5)
    rows = [(1, prose(30, 6) + item + prose(30, 7)), (2, prose(80, 8)), (3, item)]
    bench = spark.createDataFrame([(7, " ".join(item))], ITEMS)
    rows_found = decontam.benchmark_leaks(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.lcs_share) for r in rows_found} == {(1, 1.0), (3, 1.0)}


def test_candidates_are_near_in_the_latent_space(spark, monkeypatch):
    item, short = prose(30, 31), prose(6, 32)
    rows = [(1, prose(40, 33) + item + prose(40, 34)), (2, prose(40, 35) + short + prose(40, 36))]
    rows += [(k, prose(90, k)) for k in range(40, 60)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(short))], ITEMS)
    assert found_leaks(frame(spark, rows), bench) == {(1, 7), (2, 8)}
    # Where every vector points away from the items, no window is a candidate.
    describe = decontam.describe_items

    def away(*given):
        items = describe(*given)
        items.vectors = -items.vectors
        return items

    monkeypatch.setattr(decontam, "describe_items", away)
    assert found_leaks(frame(spark, rows), bench) == set()


def test_directions_are_fitted_on_every_document(spark, monkeypatch):
    docs = spark.range(4_500).select(
        F.when(F.col("id") % 3 == 0, "one and the same text")
        .otherwise(F.concat(F.lit("text number "), "id"))
        .alias("text")
    )
    fitted = []

    def times(texts, weights, right):
        fitted.append(texts.count())
        return right

    monkeypatch.setattr(decontam, "_gram_times", times)
    decontam.latent_directions(docs, np.ones(decontam.BUCKETS))
    assert fitted == [4_500]


def test_directions_are_those_of_a_full_decomposition(spark):
    topics = [prose(12, k) for k in range(3)]
    draw = random.Random(9)
    rows = [(k, [draw.choice(topics[k % 3]) for _ in range(48)]) for k in range(90)]
    docs, weights = frame(spark, rows), np.ones(decontam.BUCKETS)
    gram = np.zeros((decontam.BUCKETS, 90))
    for k, words in rows:
        ids = decontam.buckets(decontam.scan_words([" ".join(words)]).hashes)
        np.add.at(gram[:, k], ids, 1 / np.sqrt(48))
    found = decontam.latent_directions(docs, weights)
    left, size, _ = np.linalg.svd(gram, full_matrices=False)
    rank = int((size > 1e-4 * size[0]).sum())
    exact = left[:, decontam.COMMON : rank]
    exact /= np.maximum(np.linalg.norm(exact, axis=1, keepdims=True), 1e-9)
    held = np.abs(gram).sum(axis=1) > 0
    assert np.allclose((found @ found.T)[held][:, held], (exact @ exact.T)[held][:, held], atol=0.05)


def test_short_and_very_long_items_are_found(spark):
    five, seven, long = prose(5, 21), prose(7, 22), prose(10_000, 23)
    rows = [
        (1, prose(30, 24) + five + prose(30, 25)),
        (2, prose(30, 26) + seven + prose(9, 27)),
        (3, prose(30, 28) + five[:4] + prose(9, 29) + seven[:3] + ["zz"] + seven[3:]),
        (4, long),
        (5, five[:2]),
        (6, five[2:]),
    ]
    bench = spark.createDataFrame(
        [(i, " ".join(x)) for i, x in enumerate([five, seven, long, long, prose(4, 24)[:4]])], ITEMS
    )
    assert found_leaks(frame(spark, rows), bench) == {(1, 0), (2, 1), (4, 2), (4, 3)}


def test_matrices_of_tasks_add_up_in_levels(spark, monkeypatch):
    docs = frame(spark, [(k, prose(50, k)) for k in range(24)]).select("text")
    weights = np.ones(decontam.BUCKETS)
    right = np.random.default_rng(1).standard_normal((decontam.BUCKETS, 3))
    once = decontam._gram_times(docs.coalesce(1), weights, right)
    monkeypatch.setattr(decontam, "LEVEL", 2)
    many = decontam._gram_times(docs.repartition(7), weights, right)
    assert np.abs(once).max() > 0 and np.allclose(once, many, atol=1e-4)


# ------------------------------------------------------------- licences


def test_the_sample_is_bounded_with_copies(spark, monkeypatch):
    total = 5 * license_scan.SAMPLE
    docs = spark.range(total).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "one and the same text")
        .otherwise(F.concat(F.lit("text number "), "id"))
        .alias("text"),
    )
    counts = {}

    class Taken(Exception):
        pass

    def taken(df, purpose):
        counts["all"] = df.count()
        counts["copies"] = df.where("text = 'one and the same text'").count()
        raise Taken

    monkeypatch.setattr(license_scan, "written", taken)
    with pytest.raises(Taken):
        license_scan.fit(docs)
    assert abs(counts["all"] - license_scan.SAMPLE) < 0.1 * license_scan.SAMPLE
    assert abs(counts["copies"] - license_scan.SAMPLE / 3) < 0.1 * license_scan.SAMPLE


def test_the_unknown_class_is_fitted_on_every_paragraph(spark, monkeypatch):
    total = 3 * license_scan.SAMPLE
    docs = spark.range(total).select(
        F.col("id").alias("doc_id"),
        F.concat(F.lit("the work of "), "id", F.lit("\nunder the terms of "), "id").alias("text"),
    )
    rows = {}
    write = license_scan.written

    def counted(df, purpose):
        found = write(df, purpose)
        if purpose == "paragraphs":
            rows.update({r.fold: r.n for r in found.groupBy("fold").agg(F.sum("n").alias("n")).collect()})
        return found

    monkeypatch.setattr(license_scan, "written", counted)
    model = license_scan.fit(docs)
    assert sum(rows.values()) == 2 * total and min(rows.values()) > 0.9 * total
    assert license_scan.license_notices(docs, model=model).isEmpty()


def test_the_bar_is_passed_by_few(spark):
    rows = spark.createDataFrame(
        [((0.99995, "a"), 1), ((0.91234, "a"), 9), ((0.7, "b"), 20), ((0.1, "b"), 9_970)],
        "best struct<p: double, family: string>, n bigint",
    )
    assert license_scan._bar(rows) == 0.7001
    assert license_scan._bar(rows.where("best.p < 0.5")) == license_scan.LEAST_BAR
    assert license_scan._bar(rows.limit(0)) == license_scan.LEAST_BAR


# ------------------------------------------------------------- pipeline


def staged(spark, rows):
    docs = [(k, t, "en", "s", len(t)) for k, t in rows]
    return spark.createDataFrame(docs, spark.read.parquet(f"{SMALL}/documents.parquet").schema)


def test_near_copies_go_by_row(spark):
    a, b, c, d = (" ".join(prose(60, seed)) for seed in (11, 12, 13, 14))
    rows = [(None, a), (1, a), (None, b), (None, b), (None, b), (2, c), (2, d), (3, c)]
    left = corpus_pipeline.near_duplicates(spark, staged(spark, rows), SMALL)
    assert left.columns == corpus_pipeline.COLUMNS
    kept = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert kept == sorted([(1, a), (None, b), (2, c), (2, d)], key=repr)


def test_leaks_go_by_row(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    leak = " ".join(prose(40, 15)) + " " + bench[0].text
    clean, other = (" ".join(prose(60, seed)) for seed in (16, 17))
    rows = [(None, leak), (None, clean), (4, leak), (4, other), (5, leak)]
    left = corpus_pipeline.decontamination(spark, staged(spark, rows), SMALL)
    assert left.columns == corpus_pipeline.COLUMNS
    kept = {(r.doc_id, r.text) for r in left.collect()}
    assert kept == {(None, clean), (4, other)}


# --------------------------------------------------------- near copies


@pytest.mark.parametrize(
    "size, edits", [(400, 80), (400, 64), (100, 20), (51, 10), (30, 6), (20, 4), (10, 2), (10, 1), (5, 1)]
)
@pytest.mark.parametrize("change", ["replaced", "deleted"])
def test_scattered_edits_share_an_entry(size, edits, change):
    if size == 5 and change == "deleted":
        pytest.skip("a text of four words has no entries")
    draw = np.random.default_rng(size + edits)
    trials = shared = 0
    for _ in range(100):
        a = draw.integers(1, 2**63, size).astype(np.uint64)
        place = draw.choice(size, edits, replace=False)
        b = np.delete(a, place)
        if change == "replaced":
            b = a.copy()
            b[place] = draw.integers(1, 2**63, edits)
        trials += 1
        shared += bool((neardup.sketch(a) == neardup.sketch(b)).any())
    assert shared >= 0.97 * trials


def test_copies_with_scattered_edits_are_one_class(spark):
    draw = random.Random(30)
    rows = []
    for k in range(20):
        words = prose(100, 300 + k)
        other = list(words)
        for i in draw.sample(range(100), 20):
            other[i] = "zz" + str(i)
        rows += [(2 * k, words), (2 * k + 1, other)]
    found = neardup.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.class_id for r in found} == {k: k - k % 2 for k in range(40)}


# ---------------------------------------------------------------- top-k


@pytest.mark.parametrize("count", [1, 2, 10, 20, 21])
def test_no_query_is_its_own_hit_in_a_small_block(count):
    draw = np.random.default_rng(count)
    values = draw.integers(-4, 5, (count, 6)).astype(float)
    ids = np.arange(count)
    query, vector, score = topk.search_part(ids, values, ids, values, 20)
    for i in range(count):
        best = sorted((-int(values[i] @ values[k]), k) for k in ids if k != i)[:20]
        mine = query == i
        assert list(zip((-score[mine]).tolist(), vector[mine].tolist())) == best


def test_small_tables_and_rare_lengths_have_no_own_hits(spark):
    rows = [(20 * k, [1.0, float(k)]) for k in range(4)] + [(20 * k, [9.0]) for k in range(5, 8)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = topk.top_inner_products(table, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.vec_id) for r in found) == sorted(
        (a, b) for a, x in rows for b, y in rows if a != b and len(x) == len(y)
    )
