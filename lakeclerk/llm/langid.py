"""Language of a text, word first, then character n-grams (operator 4).

A known word is scored by its log frequency in every language. An unseen word
falls back to the longest of its character n-grams that the model knows: their
mean log frequency stands in for the word's. The scores of all words add up,
and the posterior of equally likely languages is the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeclerk.llm.scratch import in_chunks, map_batches, map_frames, written
from lakeclerk.llm.words import scan_words

UNDETERMINED = "und"
FIT_ROWS = 6_000  # labelled rows that a model is fitted on, about
RARE_WORD = 1 / 40_000  # least share of a language's words that the model keeps
RARE_GRAM = 1 / 8_000  # least share of a language's n-grams of one length
LONGEST = 4  # characters of the longest n-gram, word marks included
TOGETHER = 1 << 20  # characters that are scored together
REMEMBERED = 500_000  # unseen words that a worker remembers


@dataclass
class LanguageModel:
    """Log frequencies by language; of bounded size, as the rows it is fitted on are.

    At most 40,000 words and four times 8,000 n-grams of a language have the
    shares that the model keeps.
    """

    languages: list[str]
    words: np.ndarray  # sorted hashes
    word_scores: np.ndarray  # by word and language
    grams: dict[str, int]  # row of ``gram_scores``: a row of its own for each would take several times the memory
    gram_scores: np.ndarray  # by n-gram and language

    def back_off(self, word: str) -> np.ndarray:
        """Mean score of the known n-grams of the greatest length that has any."""
        marked = f"<{word}>"
        for size in range(min(LONGEST, len(marked)), 0, -1):
            found = [
                self.grams[gram]
                for at in range(len(marked) - size + 1)
                if (gram := marked[at : at + size]) in self.grams
            ]
            if found:
                return self.gram_scores[found].mean(axis=0)
        return np.zeros(len(self.languages))

    def scores(self, texts: list[str | None], memory: dict[int, np.ndarray]) -> np.ndarray:
        """Sum over the words of every text, by language; NaN where there is no letter."""
        found = scan_words(texts, letters_only=True)
        total = np.full((len(texts), len(self.languages)), np.nan)
        if not len(found.hashes) or not self.languages:
            return total
        unique, example, which = np.unique(
            found.hashes, return_index=True, return_inverse=True
        )
        at = np.minimum(np.searchsorted(self.words, unique), max(0, len(self.words) - 1))
        known = self.words[at] == unique if len(self.words) else np.zeros(len(unique), bool)
        value = np.zeros((len(unique), len(self.languages)))
        value[known] = self.word_scores[at[known]]
        text_of = np.searchsorted(found.first, example, "right") - 1
        for i in np.flatnonzero(~known).tolist():
            key = int(unique[i])
            if key not in memory:
                if len(memory) >= REMEMBERED:
                    memory.clear()
                begin, end = found.begin[example[i]], found.end[example[i]]
                memory[key] = self.back_off(texts[text_of[i]][begin:end].lower())
            value[i] = memory[key]
        sizes = np.diff(found.first)
        some = np.flatnonzero(sizes)
        total[some] = np.add.reduceat(value[which], found.first[some], axis=0)
        return total

    def predict(
        self, texts: list[str | None], memory: dict[int, np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray]:
        """Language and posterior of every text."""
        texts = [value or "" for value in texts]
        total = self.scores(texts, memory)
        lost = np.isnan(total).any(axis=1) if total.size else np.ones(len(texts), bool)
        best, score = np.full(len(texts), len(self.languages)), np.zeros(len(texts))
        if not lost.all():
            some = total[~lost]
            best[~lost] = some.argmax(axis=1)
            gap = some - some.max(axis=1, keepdims=True)
            score[~lost] = 1 / np.exp(gap).sum(axis=1)
        return np.array([*self.languages, UNDETERMINED], object)[best], score


def log_frequencies(counts: DataFrame) -> DataFrame:
    """Counts by (lang, kind, key) to log frequencies, as a list over the languages.

    Kind 0 are words, kind n are n-grams of n characters. One is added to every
    count, so a word that a language lacks has a finite score there.
    """
    totals = counts.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, ["lang", "kind"])
    least = F.when(F.col("kind") == 0, RARE_WORD).otherwise(RARE_GRAM)
    kept = shares.where(F.col("n") >= least * F.col("total"))
    # A key that one language keeps is scored in all of them.
    return shares.join(kept.select("kind", "key").distinct(), ["kind", "key"]).groupBy(
        "kind", "key"
    ).agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))


def fit(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    order: Column | None = None,
    fit_rows: int = FIT_ROWS,
) -> LanguageModel:
    """Fit a model on about ``fit_rows`` of the rows with text and language.

    Rows are taken by a hash of ``order``, by default of the text, so the same
    rows are taken again after a lost executor; with fewer rows all are taken.
    Rows without a language or text are left out. An empty table gives a model
    that knows no language and calls every text undetermined.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    total = rows.count()
    if total > fit_rows:
        by = order if order is not None else F.col(text)
        share = fit_rows / total
        rows = rows.where(F.pmod(F.xxhash64(by), F.lit(1 << 40)) < int(share * (1 << 40)))
    words = (
        rows.select(
            F.col(lang).alias("lang"),
            F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{M}]+"), F.lit(0))).alias("key"),
        )
        .groupBy("lang", "key")
        .agg(F.count("*").alias("n"))
    )
    words = written(words, "language-words")
    marked = F.concat(F.lit("<"), "key", F.lit(">"))
    grams = words.select(
        "lang",
        "n",
        F.explode(
            F.flatten(
                F.array(
                    *[
                        F.transform(
                            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - (size - 1))),
                            lambda at, size=size: F.struct(
                                F.lit(size).alias("kind"),
                                F.substring(marked, at, F.lit(size)).alias("key"),
                            ),
                        )
                        for size in range(1, LONGEST + 1)
                    ]
                )
            )
        ).alias("gram"),
    )
    grams = (
        grams.select("lang", "gram.kind", "gram.key", "n")
        .where(F.length("key") == F.col("kind"))
        .groupBy("lang", "kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    counts = written(
        words.select("lang", F.lit(0).alias("kind"), "key", "n").unionByName(grams),
        "language-counts",
    )
    totals = {
        (row.lang, row.kind): row.total
        for row in counts.groupBy("lang", "kind").agg(F.sum("n").alias("total")).collect()
    }
    languages = sorted({lang for lang, _ in totals})
    place = {name: i for i, name in enumerate(languages)}
    words_kept, word_scores, grams_kept, gram_scores = [], [], {}, []
    for row in log_frequencies(counts).toLocalIterator():
        total = np.array([totals.get((name, row.kind), 0) for name in languages], float)
        score = np.zeros(len(languages))
        for name, n in row.n.items():
            score[place[name]] = n
        score = np.log((score + 0.5) / (total + 1))
        if row.kind == 0:
            words_kept.append(row.key)
            word_scores.append(score)
        else:
            grams_kept[row.key] = len(gram_scores)
            gram_scores.append(score)
    found = scan_words(words_kept, letters_only=True)
    whole = np.diff(found.first) == 1
    hashes = found.hashes[found.first[:-1][whole]] if len(words_kept) else found.hashes
    scores = np.array(word_scores).reshape(len(words_kept), len(languages))[whole]
    order_by = np.argsort(hashes)
    gram_scores = np.array(gram_scores).reshape(len(gram_scores), len(languages))
    return LanguageModel(languages, hashes[order_by], scores[order_by], grams_kept, gram_scores)


def predict(
    documents: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The key, ``lang_pred`` and ``score`` of every whole text.

    A null text, or one without a letter, is ``und`` with score 0. Ties go to
    the language that comes first by name. Nothing but the text is used.
    """
    kind = documents.schema[key].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, memory = shared.value, {}
        for frame in frames:
            for part in in_chunks(frame, "lang_text", TOGETHER):
                names, score = model.predict(list(part["lang_text"]), memory)
                yield pd.DataFrame({key: part["lang_key"], "lang_pred": names, "score": score})

    found = map_frames(
        documents.select(
            documents[key].cast("string").alias("lang_key"), documents[text].alias("lang_text")
        ),
        run,
        f"`{key}` string, lang_pred string, score double",
    )
    return found.withColumn(key, F.col(key).cast(kind))


def relabel(
    documents: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """``documents`` with ``lang`` predicted, without those of no language.

    Rows go through as they are but for that column, so there is no join.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = shared.value, {}
        for batch in batches:
            names = []
            frame = pd.DataFrame({"t": batch.column(text).to_pylist()}, dtype=object)
            for part in in_chunks(frame, "t", TOGETHER):
                names += list(model.predict(list(part["t"]), memory)[0])
            place = batch.schema.get_field_index(lang)
            batch = batch.set_column(place, lang, pa.array(names, pa.string()))
            yield batch.filter(pa.array([name != UNDETERMINED for name in names], pa.bool_()))

    return map_batches(documents, run, documents.schema)


def held_out(doc_id: Column) -> Column:
    """The fourth of the documents that a model never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify(documents: DataFrame) -> DataFrame:
    """Fit on the documents that are not held out and predict all.

    Returns ``doc_id``, ``held_out``, ``lang_pred`` and ``score``.
    """
    model = fit(documents.where(~held_out(F.col("doc_id"))), order=F.col("doc_id"))
    found = predict(documents, model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
