"""Benchmark passages in documents, found in a latent space (operator 1).

Passages of the corpus are TF-IDF vectors over hashed words. A distributed
randomised SVD gives the leading directions they share. Items and windows of
all texts are vectors in that space, and only the windows of a cosine of
LEAST_COSINE or more to an item are its candidates; cosines are left out where a
bound by counts of words rules a leak out anyway. A candidate is confirmed on
the words themselves: the longest common subsequence covers most of the item,
or, for a paraphrase, a good part of it and the item's answer.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeclerk.llm.scratch import in_chunks, map_frames, numbered, row_name
from lakeclerk.llm.words import Words, scan_words

BUCKETS = 1 << 14  # hashed words
LATENT = 64  # directions that are kept
COMMON = 4  # leading directions that are left out: what whole languages share
BLOCK = 6  # words that are summed first
WINDOWS = (2, 3, 4, 5, 7, 9, 12)  # blocks of a window
STEPS = (1, 1, 1, 1, 2, 2, 3)  # blocks from one window to the next
PASSAGE = 48  # words of a passage that the directions are fitted on
LEAST_COSINE = 0.5  # of an item and a window of its length, less for a longer window
LEAST_WORDS = 5  # items with fewer words are too common to be looked for
LOOSE_WORDS = 8  # items with fewer words are found as whole runs of words only
SLOTS = 4  # entries of a row of the random test matrix
COPIED = 0.8  # share of an item's words that a copy has in order
PARAPHRASED = 0.6  # the same where the answer is there too
ANSWER = 0.25  # share of an item, at its end, that is its answer
LEVEL = 64  # matrices of tasks that are added up by one task
ITEMS = 2_000  # parts of items that are searched for in one pass
TOGETHER = 1 << 20
ROWS = 4_096  # rows of a product that are added up together, few enough for the cache
SEARCHED = 1 << 18  # characters that are searched together, few enough for the cache
STARTS = 4_096  # windows that are searched together


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(50)).astype(np.int64)


def word_weights(documents: DataFrame, text: str = "text") -> np.ndarray:
    """Inverse frequency of every bucket over all words of all texts, always above 0."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(BUCKETS, np.int64)
        for frame in frames:
            for part in in_chunks(frame, "text", TOGETHER // 4):
                found = scan_words(part["text"].tolist())
                counts += np.bincount(buckets(found.hashes), minlength=BUCKETS)
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"bucket": some, "n": counts[some]})

    texts = documents.select(documents[text].alias("text")).where(F.length("text") > 0)
    found = map_frames(texts, run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS)
    for row in found.collect():  # at most BUCKETS
        counts[row.bucket] = row.n
    total = max(1.0, counts.sum())
    return np.log1p(total / (1 + counts))


def _passages(found: Words, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, passage and normed weight of every word."""
    ids = buckets(found.hashes)
    sizes = np.diff(found.first)
    in_text = np.arange(len(ids)) - np.repeat(found.first[:-1], sizes)
    new = in_text % PASSAGE == 0
    passage = np.cumsum(new) - 1
    value = weights[ids]
    norm = np.sqrt(np.bincount(passage, value * value))
    return ids, passage, value / np.maximum(norm[passage], 1e-9)


def _gram_times(texts: DataFrame, weights: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The passages' Gram matrix over buckets times ``right``, summed by tasks.

    Rows of ``right`` with few entries cost little: only these are added up.
    A task holds one matrix of BUCKETS rows; parts of it are added up by group,
    at most LEVEL together, in as many levels as the number of tasks asks for.
    """
    context = texts.sparkSession.sparkContext
    width, rows = right.shape[1], 1024
    # Of every row its entries other than zero, filled up with zeros: (column, value).
    slots = max(1, int((right != 0).sum(axis=1).max()))
    column = np.argsort(right == 0, axis=1, kind="stable")[:, :slots]
    entry = np.take_along_axis(right, column, axis=1)
    shared = context.broadcast((weights, column.T.copy(), entry.T.copy()))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, column, entry = shared.value
        total = np.zeros((BUCKETS, width), np.float32)
        for frame in frames:
            for part in in_chunks(frame, "text", 4 * TOGETHER):
                found = scan_words(part["text"].tolist())
                if not len(found.hashes):
                    continue
                ids, passage, value = _passages(found, weights)
                left = np.zeros((passage[-1] + 1) * width)
                for to, times in zip(column, entry):
                    left += np.bincount(passage * width + to[ids], times[ids] * value, len(left))
                left = left.astype(np.float32).reshape(-1, width)
                # Numbers of 16 bits are put in order digit by digit.
                order = np.argsort(ids.astype(np.uint16), kind="stable")
                ids = ids[order]
                passage, value = passage[order], value[order].astype(np.float32)
                for at in range(0, len(ids), ROWS):
                    parts = left.take(passage[at : at + ROWS], axis=0)
                    parts *= value[at : at + ROWS, None]
                    some = ids[at : at + ROWS]
                    begin = np.flatnonzero(np.diff(some, prepend=-1)).tolist()
                    # Sums of slices take less time than np.add.reduceat.
                    for bucket, a, b in zip(some[begin].tolist(), begin, [*begin[1:], len(some)]):
                        total[bucket] += parts[a] if b == a + 1 else parts[a:b].sum(axis=0)
        task = TaskContext.get().partitionId()
        for at in range(0, BUCKETS, rows):
            yield pd.DataFrame(
                {"at": [at], "task": [task], "part": [total[at : at + rows].tobytes()]}
            )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in frame["part"])
        return frame[:1].assign(part=[total.astype(np.float32).tobytes()])

    schema = "at int, task int, part binary"
    parts = map_frames(texts, run, schema)
    tasks = max(1, texts.rdd.getNumPartitions())
    while tasks > 1:
        tasks = -(-tasks // LEVEL)
        parts = parts.withColumn("task", F.col("task") % tasks)
        parts = parts.groupBy("at", "task").applyInPandas(add, schema)
    result = np.zeros((BUCKETS, width))
    for row in parts.collect():  # one row for each part of the matrix
        result[row["at"] : row["at"] + rows] = np.frombuffer(row.part, np.float32).reshape(-1, width)
    return result


def latent_directions(documents: DataFrame, weights: np.ndarray, text: str = "text") -> np.ndarray:
    """Projection of buckets to the latent space, word weights included.

    Fitted on all documents in one pass of a randomised SVD. The Gram matrix G
    has no negative eigenvalue, so its product with a sparse random test matrix T
    is enough: G is close to (G T) (T' G T)^-1 (G T)', whose eigenvectors are the
    left singular vectors of G T (T' G T)^-1/2. A word's direction has length 1
    before its weight is applied, so that rare words, of which the leading
    directions hold little, count as their weight says.
    """
    texts = documents.select(documents[text].alias("text")).where(F.length("text") > 0)
    draw, width = np.random.default_rng(7), LATENT + COMMON
    test = np.zeros((BUCKETS, width))
    column = np.argsort(draw.random((BUCKETS, width)), axis=1)[:, :SLOTS]
    np.put_along_axis(test, column, draw.choice([-1.0, 1.0], (BUCKETS, SLOTS)), axis=1)
    image = _gram_times(texts, weights, test)
    inner = test.T @ image
    size, turn = np.linalg.eigh((inner + inner.T) / 2)
    some = size > 1e-6 * max(size.max(), 1e-300)
    found = image @ (turn[:, some] / np.sqrt(size[some]))
    found = np.linalg.svd(found, full_matrices=False)[0][:, COMMON:]
    return (_unit(found) * weights[:, None]).astype(np.float32)


@dataclass
class Items:
    """Parts of benchmark items, about ITEMS at most, with their windows."""

    ids: list[int]
    words: list[np.ndarray]
    scale: np.ndarray  # place in WINDOWS
    vectors: np.ndarray
    many: np.ndarray  # words by part and bucket; the last bucket is none's


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def word_vectors(directions: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Vectors of LATENT numbers that those of windows and items are sums of.

    A word's latent direction by the square root of its weight, so that a cosine
    has the weight once: an item of frequent words would else be lost among the
    rare words beside it. A corpus with fewer directions is filled up with fixed
    random ones, and a word that no direction holds has a random vector, so that
    the cosine of equal words is 1 in any space.
    """
    kept = directions.shape[1]
    found = np.random.default_rng(11).choice([-1.0, 1.0], (BUCKETS, LATENT)) / np.sqrt(LATENT)
    some = np.linalg.norm(directions, axis=1) > 1e-6
    found[some, :kept] = _unit(directions[some]) * np.sqrt(kept / LATENT)
    return (found * np.sqrt(weights)[:, None]).astype(np.float32)


def describe_items(rows: list[tuple[int, str | None]], directions: np.ndarray) -> Items:
    """Items too long for the largest window are looked for in parts."""
    found = scan_words([text for _, text in rows])
    longest = BLOCK * WINDOWS[-1]
    ids, words = [], []
    for (item, _), begin, end in zip(rows, found.first[:-1], found.first[1:]):
        if end - begin >= LEAST_WORDS:
            parts = -(-(end - begin) // longest)
            for part in np.array_split(found.hashes[begin:end], parts):
                ids.append(item)
                words.append(part)
    most = BLOCK * np.array(WINDOWS)
    scale = np.array([int(np.searchsorted(most, len(x))) for x in words], np.int64)
    vectors = np.zeros((len(words), directions.shape[1]))
    many = np.zeros((len(words), BUCKETS + 1), np.uint8)
    for i, part in enumerate(words):
        vectors[i] = directions[buckets(part)].sum(axis=0)
        np.add.at(many[i], buckets(part), 1)
    return Items(ids, words, scale, _unit(vectors).astype(np.float32), many)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by rows of bits."""
    places: dict[int, int] = defaultdict(int)
    for i, word in enumerate(a):
        places[word] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        both = row & places.get(word, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def judge(item: np.ndarray, region: np.ndarray) -> tuple[float, float]:
    """Shares of the item's words, and of its answer's, in order in the region."""
    if np.isin(item, region).sum() < PARAPHRASED * len(item):
        return 0.0, 0.0
    words, around = item.tolist(), region.tolist()
    share = common_subsequence(words, around) / len(words)
    answer = words[-max(3, round(ANSWER * len(words))) :]
    return share, common_subsequence(answer, around) / len(answer)


def is_leak(share: float, answer: float) -> bool:
    return share >= COPIED or (share >= PARAPHRASED and answer >= COPIED)


def sums_of_neighbours(count: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``size`` rows from each row on, made of sums of 1, 2, 4 and more rows."""
    rows = len(count) - size + 1
    result, done, power, width = np.zeros((rows, count.shape[1]), count.dtype), 0, count, 1
    while True:
        if size & width:
            result += power[done : done + rows]
            done += width
        if 2 * width > size:
            return result
        power = power[:-width] + power[width:]
        width *= 2


def holds_run(words: np.ndarray, item: np.ndarray) -> bool:
    """Whether the words hold the item's, one after the other."""
    if len(words) < len(item):
        return False
    runs = np.lib.stride_tricks.sliding_window_view(words, len(item))
    return bool((runs == item).all(axis=1).any())


def search(
    documents: DataFrame, items: Items, directions: np.ndarray, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, item_id, cosine, lcs_share, answer_share) of the leaks of the items.

    One pass over whole texts; only leaks leave a task.
    """
    shared = documents.sparkSession.sparkContext.broadcast((items, directions))
    kind = documents.schema[key].dataType.simpleString()

    def candidates(
        found: Words, items: Items, directions: np.ndarray, holds: list[np.ndarray]
    ) -> Iterator[tuple]:
        """(text, part, cosine, words): regions of windows near a part of an item.

        A region is a window and what the next ones begin with. The number of
        its words that the part has too bounds their common subsequence: cosines
        are not computed where it is too small for a leak.
        """
        ids, many = buckets(found.hashes), items.many.reshape(-1)
        sizes = np.diff(found.first)
        in_text = np.arange(len(ids)) - np.repeat(found.first[:-1], sizes)
        begin = np.flatnonzero(in_text % BLOCK == 0)
        text = np.searchsorted(found.first, begin, "right") - 1
        first = np.searchsorted(begin, found.first)  # blocks before a text
        in_text = in_text[begin] // BLOCK
        # Ids by block, filled up with the bucket that no part holds.
        column = begin[:, None] + np.arange(BLOCK)
        blocks = np.where(
            column < found.first[text + 1][:, None],
            ids.take(column, mode="clip"),
            BUCKETS,
        )
        for scale, (size, step) in enumerate(zip(WINDOWS, STEPS)):
            which = np.flatnonzero(items.scale == scale)
            if not len(which):
                continue
            lengths = np.array([len(items.words[i]) for i in which])
            # Of an item that is found as a whole run only, every word.
            least = np.where(
                lengths < LOOSE_WORDS, lengths, np.ceil(lengths * PARAPHRASED - 1e-9)
            ).astype(np.int32)
            # A window that holds the item and other words beside it is further off.
            bar = LEAST_COSINE * np.sqrt(lengths / (BLOCK * size))
            every = np.flatnonzero(in_text % step == 0)
            margin = step + 1
            for at in range(0, len(every), STARTS):
                start = every[at : at + STARTS]
                low = np.maximum(first[text[start]], start - margin)
                high = np.minimum(first[text[start] + 1], start + size + margin)
                # Words of every block that each part has, then of regions. These may
                # reach into the next text: the counts below are of the text's own.
                rows = blocks.take(
                    np.arange(start[0] - margin, start[-1] + size + margin), axis=0, mode="clip"
                )
                count = holds[scale].take(rows[:, 0], axis=0)
                for place in range(1, BLOCK):
                    count += holds[scale].take(rows[:, place], axis=0)
                total = sums_of_neighbours(count, size + 2 * margin)
                enough = total.take(start - start[0], axis=0) >= least.astype(np.uint8)
                near, part = np.nonzero(enough)
                for some in range(0, len(near), 4096):
                    region, item = near[some : some + 4096], part[some : some + 4096]
                    # Words of every region in question, once for all parts that it may hold.
                    new = np.diff(region, prepend=-1) != 0
                    once, of = region[new], np.cumsum(new) - 1
                    place = low[once, None] + np.arange(size + 2 * margin)
                    held = blocks.take(place, axis=0, mode="clip")
                    held[place >= high[once, None]] = BUCKETS
                    held = held.reshape(len(once), -1)
                    # A word that is there more often than in the part counts as often as there.
                    order = np.sort(held, axis=1)
                    across = np.arange(order.shape[1])
                    start_ = np.ones(order.shape, bool)
                    np.not_equal(order[:, 1:], order[:, :-1], out=start_[:, 1:])
                    nth = across - np.maximum.accumulate(np.where(start_, across, 0), axis=1)
                    nth = np.minimum(nth, 255).astype(np.uint8)
                    row = (which[item] * (BUCKETS + 1))[:, None]
                    shared_ = nth.take(of, axis=0) < many.take(order.take(of, axis=0) + row)
                    for i in np.flatnonzero(shared_.sum(axis=1) >= least[item]).tolist():
                        r, p = region[i], int(which[item[i]])
                        c = begin[start[r]]
                        d = min(c + BLOCK * size, int(found.first[text[start[r]] + 1]))
                        window = directions[ids[c:d]].sum(axis=0)
                        cosine = window @ items.vectors[p] / max(np.linalg.norm(window), 1e-9)
                        if cosine >= bar[item[i]]:
                            a = begin[low[r]]
                            words = found.hashes[a : a + int((held[of[i]] < BUCKETS).sum())]
                            yield int(text[start[r]]), p, float(cosine), words

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, directions = shared.value
        # By scale, a row for each bucket.
        holds = [
            np.ascontiguousarray((items.many[items.scale == scale] > 0).T.astype(np.uint8))
            for scale in range(len(WINDOWS))
        ]
        for frame in frames:
            rows = []
            for chunk in in_chunks(frame, "leak_text", SEARCHED):
                found = scan_words(chunk["leak_text"].tolist())
                if not len(found.hashes) or not items.ids:
                    continue
                keys, best = chunk["leak_key"].tolist(), {}
                for text, part, cosine, words in candidates(found, items, directions, holds):
                    item = items.words[part]
                    if len(item) < LOOSE_WORDS:
                        share = answer = float(holds_run(words, item))
                    else:
                        share, answer = judge(item, words[items.many[part, buckets(words)] > 0])
                    if is_leak(share, answer):
                        name = (text, items.ids[part])
                        best[name] = max(best.get(name, (0, 0, 0)), (share, answer, cosine))
                rows += [(keys[text], item, c, s, a) for (text, item), (s, a, c) in best.items()]
            yield pd.DataFrame(
                rows, columns=[key, "item_id", "cosine", "lcs_share", "answer_share"]
            )

    texts = documents.select(documents[key].alias("leak_key"), documents[text].alias("leak_text"))
    return map_frames(
        texts.where((F.length("leak_text") > 0) & F.col("leak_key").isNotNull()),
        run,
        f"`{key}` {kind}, item_id bigint, cosine double, lcs_share double, answer_share double",
    )


def benchmark_leaks(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """One row for each document and benchmark item found in it.

    Windows of a latent cosine of LEAST_COSINE or more are looked at (of less, if
    longer than the item, by the square root of both lengths); an item of frequent
    words beside rare ones may be further off in every window, and is missed.
    ``cosine`` is that of the best window, ``lcs_share`` the share of the item's
    words found in order near it, ``answer_share`` that of its answer, taken to
    be the item's last quarter. Long items are looked for in parts; a row tells
    of the best part. Items of LEAST_WORDS words and more are found, those with
    fewer than LOOSE_WORDS word for word only. Null or empty texts, documents
    without a key, shorter items and those with a null id give no rows; repeated rows
    and repeated item ids give repeated finds once for each row of a document.
    """
    weights = word_weights(documents, text)
    directions = word_vectors(latent_directions(documents, weights, text), weights)
    wanted = benchmark.select(
        F.col(item_key).cast("long").alias("item"), F.col(item_text).alias("item_text")
    ).where(F.col("item").isNotNull() & (F.length("item_text") > 0)).distinct()
    # A word and its end are two characters at least, which bounds the parts of an item.
    parts = 1 + F.floor(F.length("item_text") / (2 * BLOCK * WINDOWS[-1]))
    passes = max(1, -(-(wanted.agg(F.sum(parts)).first()[0] or 0) // ITEMS))
    found = None
    for number in range(passes):
        rows = wanted.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(passes)) == number)
        items = describe_items([tuple(row) for row in rows.collect()], directions)
        leaks = search(documents, items, directions, key, text)
        found = leaks if found is None else found.unionByName(leaks)
    return found


def drop_leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id") -> DataFrame:
    """``documents`` without those that hold a benchmark item."""
    gone = benchmark_leaks(documents, benchmark, key).select(F.col(key).alias("_gone")).distinct()
    return documents.join(gone, documents[key] == gone["_gone"], "left_anti")


def drop_leaking_rows(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows that hold an item, each judged by its own text.

    A row without a key is searched too, and rows that share a key do not share
    their fate.
    """
    row = row_name(documents)
    rows = numbered(documents, "leak-rows", row)
    gone = benchmark_leaks(rows, benchmark, row).select(F.col(row).alias("_gone")).distinct()
    left = rows.join(gone, rows[row] == gone["_gone"], "left_anti")
    return left.select(*documents.columns)
