import hashlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from lakeclerk.llm import queries
from lakeclerk.llm.decontam import drop_leaking_rows
from lakeclerk.llm.langid import fit
from lakeclerk.llm.neardup import drop_near_rows
from lakeclerk.llm.scratch import BATCH, ROWS, given_back, map_batches, map_frames, numbered

SMALL = "/root/testdata/sf0.001"
ODD = [
    (-1, None, "en", "s", 0),
    (-2, "", None, None, None),
    (-3, "12 !!", "en", "s", 1),
    (None, "the of and", "en", "s", 1),
    (-4, "the of and password = abcdefgh1 for that", "en", "s", 10),
    (-5, "the words of this text and that one for you", None, None, None),
    (-5, "the words of this text and that one for you", None, None, None),
]


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame(ODD, docs.schema)).withColumn(
        "_lang", F.lit("clash")
    )
    found = {"documents": docs.cache()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL).cache()
        found[name] = docs
    return found


def test_stages_keep_the_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id",
        "near_duplicates",
        "decontamination",
        "secrets",
        "token_ids",
    ]
    for name, docs in list(stages.items())[1:-1]:
        assert docs.columns == corpus_pipeline.COLUMNS, name


def test_each_stage_does_its_part_and_no_more(stages):
    ids = {name: [r.doc_id for r in df.select("doc_id").collect()] for name, df in stages.items()}
    plain = [k for k in ids["documents"] if k is not None and k >= 0]
    # Every given document has letters; those without go.
    assert sorted(k for k in ids["language_id"] if k is not None and k >= 0) == sorted(plain)
    assert {k for k in ids["language_id"] if k is None or k < 0} == {None, -4, -5}
    assert set(ids["near_duplicates"]) < set(ids["language_id"])
    assert ids["near_duplicates"].count(-5) == 1  # repeated rows are copies
    gone = set(ids["near_duplicates"]) - set(ids["decontamination"])
    assert gone and {-4, -5} <= set(ids["decontamination"])
    for name in ("secrets", "token_ids"):
        assert sorted(ids[name], key=repr) == sorted(ids["decontamination"], key=repr)
    texts = {r.doc_id: r for r in stages["secrets"].collect()}
    assert texts[-4].text == "the of and [SECRET] for that"
    assert all(r.n_chars == len(r.text) for r in texts.values())
    for row in stages["token_ids"].collect():
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].text.encode()).hexdigest()


def test_rows_of_files_are_numbered_where_they_are(spark, folder):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{folder}/docs")
    stored = spark.read.parquet(f"{folder}/docs").select("doc_id", "text")
    twice = [numbered(stored, "rows", "_row") for _ in range(2)]
    assert "_metadata" in twice[0]._jdf.queryExecution().analyzed().toString()
    assert twice[0].exceptAll(twice[1]).isEmpty()
    assert twice[0].select("_row").distinct().count() == stored.count()
    for other in (stored.unionByName(stored), stored.crossJoin(spark.range(2))):
        assert numbered(other, "rows", "_row").select("_row").distinct().count() == 2 * stored.count()


def test_a_column_of_the_caller_may_have_the_name_of_the_row(spark):
    rows = [(k, f"text number {k} of its own words {k * k}", 7) for k in range(4)] + [(9, "text number 0 of its own words 0", 8)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row int")
    kept = drop_near_rows(docs)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(rows[:4])
    bench = spark.createDataFrame([(1, "of its own words 9 text number 3 of its own")], "item_id bigint, text string")
    assert sorted(map(tuple, drop_leaking_rows(docs, bench).collect())) == sorted(rows)


def test_python_is_handed_a_bounded_number_of_texts(spark, conf):
    import pandas as pd
    import pyarrow as pa

    def sizes(frames):
        for frame in frames:
            yield pd.DataFrame({"n": [len(frame)]})

    def sizes_of_batches(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    rows = spark.range(0, 25_000, 1, 2)
    for given, most in (("10000", ROWS), ("500", 500)):
        conf(BATCH, given)
        for found in (map_frames(rows, sizes, "n bigint"), map_batches(rows, sizes_of_batches, "n bigint")):
            counts = [r.n for r in found.collect()]
            assert sum(counts) == 25_000 and max(counts) == most


def test_a_task_gives_its_memory_back():
    def resident():
        return int(Path("/proc/self/statm").read_text().split()[1]) * 4096

    stays = []

    def run():
        rows = [bytes(1_000) for _ in range(200_000)]
        stays.append(bytes(1_000))  # above the rows: what is below it is kept for later use
        yield resident()
        del rows

    (most,) = given_back(run())
    assert resident() < most - 150_000_000


def test_a_model_keeps_its_grams_in_one_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = fit(docs, order=F.col("doc_id"))
    assert model.gram_scores.shape == (len(model.grams), len(model.languages))
    assert sorted(model.grams.values()) == list(range(len(model.grams)))
    rows = {gram: model.gram_scores[row] for gram, row in model.grams.items()}
    for word in ("qthe", "xyzza", "a"):
        marked = f"<{word}>"
        cut = [[marked[at : at + size] for at in range(len(marked) - size + 1)] for size in range(min(4, len(marked)), 0, -1)]
        known = next(grams for grams in cut if rows.keys() & grams)
        assert (model.back_off(word) == np.mean([rows[gram] for gram in known if gram in rows], axis=0)).all()


def test_registered(spark):
    known = __spark_entry__.queries()
    for number in range(1, 11):
        assert [name for name in known if name.startswith(f"op{number}_")]
    assert known["pipeline"] is corpus_pipeline.run
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).isEmpty()
