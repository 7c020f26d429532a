"""Stretches of words that repeat with a period (operator 12).

The texts of a batch are one sequence of word numbers, those of different texts
apart, with a suffix array sorted by doubling. A run of period q holds a block
of words that starts at a multiple of its own length, the greatest power of two
up to q, and occurs again q words on. So every such block asks for its
occurrences in the window one to two lengths on: range successors in a wavelet
tree over the block's interval of the suffix array. By what is known of blocks
that overlap their own copies, the occurrences in a window are an arithmetic
progression: two questions and its difference give all of them, the candidate
periods. Each is extended both ways by the common blocks of the doubling, and
what repeats often enough is a run.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeclerk.llm.scratch import map_batches

LEAST_LENGTH = 6  # words of a run
LEAST_PERIODS = 4  # whole periods of a run
TOGETHER = 1 << 21  # bytes of text worked on together


class Runs(NamedTuple):
    """Runs of several texts by text, start and period; places count from the text's start."""

    text: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


class WaveletTree:
    """Numbers below ``2**bits`` as one stable partition for each bit, the highest first."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for bit in range(self.bits - 1, -1, -1):
            one = ((values >> bit) & 1).astype(bool)
            ones = np.zeros(len(values) + 1, np.int32)
            np.cumsum(one, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[~one], values[one]])

    def _below(self, begin: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many numbers of every interval are less than its bound."""
        count = np.zeros(len(begin), np.int32)
        over = bound >> self.bits > 0
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((bound >> (self.bits - 1 - level)) & 1).astype(bool)
            b, e = ones[begin], ones[end]
            count += np.where(one, (end - e) - (begin - b), 0)
            begin = np.where(one, zeros + b, begin - b)
            end = np.where(one, zeros + e, end - e)
        return np.where(over, np.iinfo(np.int32).max, count)

    def successor(self, begin: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The least number of every interval that is not below its bound, or -1."""
        place = self._below(begin, end, bound)
        some = np.flatnonzero(place < end - begin)
        begin, end, place = begin[some], end[some], place[some]
        value = np.zeros(len(some), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            b, e = ones[begin], ones[end]
            low = (end - e) - (begin - b)
            one = place >= low
            place = np.where(one, place - low, place)
            begin = np.where(one, zeros + b, begin - b)
            end = np.where(one, zeros + e, end - e)
            value = value * 2 + one
        found = np.full(len(bound), -1, np.int64)
        found[some] = value
        return found


def sorted_suffixes(words: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array as far as blocks of ``most`` words tell, and the ranks by doubling.

    ``ranks[k][i]`` is the place in the suffix array of the first suffix whose
    first ``2**k`` words are those at ``i``: equal ranks are equal blocks, and
    the block's interval begins there. A block that would pass the end of its
    text is equal to no other. Only suffixes that are not yet alone are sorted
    again, so plain prose takes few rounds. ``words`` differ between texts.
    """
    order = np.argsort(words, kind="stable")
    ranks = [_group_starts(words[order], order)]
    block = 1
    while 2 * block <= most:
        rank = ranks[-1]
        size = np.bincount(rank, minlength=len(rank))
        open_ = size[rank[order]] > 1
        if not open_.any():
            break
        places = np.flatnonzero(open_)
        suffix = order[places]
        after = suffix + block
        follow = np.where(after < len(words), rank[np.minimum(after, len(words) - 1)] + 1, 0)
        key = rank[suffix].astype(np.int64) * (len(words) + 1) + follow
        by = np.argsort(key, kind="stable")
        order = order.copy()
        order[places] = suffix[by]
        key = key[by]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        rank = rank.copy()
        rank[suffix[by]] = places[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        ranks.append(rank)
        block *= 2
    return order, ranks


def _group_starts(ordered: np.ndarray, order: np.ndarray) -> np.ndarray:
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(ordered), np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))
    return rank


def _extended(
    ranks: list[np.ndarray], low: np.ndarray, high: np.ndarray, step: int
) -> np.ndarray:
    """How many words from two places on are equal: forwards, or backwards before them.

    Blocks of ever smaller powers of two are compared; the greatest ones as
    often as they are equal. Texts share no word, so none is left.
    """
    total = np.zeros(len(low), np.int64)
    size = len(ranks[0])
    for level in range(len(ranks) - 1, -1, -1):
        block, rank = 1 << level, ranks[level]
        going = np.arange(len(low))
        while len(going):
            if step > 0:
                a, b = low[going] + total[going], high[going] + total[going]
            else:
                a, b = low[going] - total[going] - block, high[going] - total[going] - block
            inside = (a >= 0) & (b < size)
            going, a, b = going[inside], a[inside], b[inside]
            going = going[rank[a] == rank[b]]
            total[going] += block
            if level < len(ranks) - 1:
                break
    return total


def _candidates(
    tree: WaveletTree, ranks: list[np.ndarray], offset: np.ndarray
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, distance) of aligned blocks and occurrences one to two lengths on.

    ``offset`` is every word's place in its text. The first two occurrences are
    candidates. With a third their difference is the block's own period, and
    the block lies in one stretch of that period, its occurrences in another.
    A run of a greater period holds both stretches and moves the end of one to
    the end of the other, so the distance of the ends is the only candidate
    among all further occurrences; within one stretch there is none.
    """
    for level, rank in enumerate(ranks):
        block = 1 << level
        size = np.bincount(rank, minlength=len(rank))
        place = np.flatnonzero((size[rank] > 1) & (offset % block == 0))
        begin = rank[place]
        end = begin + size[begin]
        first = tree.successor(begin, end, place + block)
        hit = (first >= 0) & (first < place + 2 * block)
        place, begin, end, first = place[hit], begin[hit], end[hit], first[hit]
        yield place, first - place
        second = tree.successor(begin, end, first + 1)
        hit = (second >= 0) & (second < place + 2 * block)
        place, first, second = place[hit], first[hit], second[hit]
        yield place, second - place
        gap = second - first
        third = second + gap
        hit = third < np.minimum(place + 2 * block, len(rank))
        hit[hit] = rank[third[hit]] == rank[place[hit]]
        place, first, gap = place[hit], first[hit], gap[hit]
        here = place + _extended(ranks, place, place + gap, 1)
        there = first + _extended(ranks, first, first + gap, 1)
        distance = there - here
        hit = (distance >= block) & (distance < 2 * block)
        yield place[hit], distance[hit]


def find_runs(words: np.ndarray, text: np.ndarray, offset: np.ndarray) -> Runs:
    """All runs of the texts, whose words are numbers that no two texts share.

    ``text`` and ``offset`` are the text of every word and its place there.
    """
    none = np.zeros(0, np.int64)
    if not len(words):
        return Runs(none, none, none, none)
    most = max(1, (int(offset.max()) + 1) // LEAST_PERIODS)
    order, ranks = sorted_suffixes(words, most)
    tree = WaveletTree(order.astype(np.int64))
    begin, end, period = [none], [none], [none]
    for place, distance in _candidates(tree, ranks, offset):
        before = _extended(ranks, place, place + distance, -1)
        after = _extended(ranks, place, place + distance, 1)
        length = before + after + distance
        long = (length >= LEAST_LENGTH) & (length >= LEAST_PERIODS * distance)
        begin.append((place - before)[long])
        end.append((place - before + length)[long])
        period.append(distance[long])
    begin, end, period = np.concatenate(begin), np.concatenate(end), np.concatenate(period)
    # Of one stretch the least period: the others are multiples of it.
    by = np.lexsort((period, end, begin))
    begin, end, period = begin[by], end[by], period[by]
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    begin, end, period = begin[new], end[new], period[new]
    by = np.lexsort((period, begin))
    begin, end, period = begin[by], end[by], period[by]
    return Runs(text[begin], offset[begin], end - begin, period)


def repeated_tail(key: int | None, n: int) -> np.ndarray | None:
    """Word numbers of the text whose tail repeats, for one key in ten; else None.

    With ``h`` the CRC-32 of the key in decimal and ``g = h // 10``: where ``h``
    ends in 0 the words from ``a = g % n`` on repeat the first ``p`` of them,
    ``p = 1 + (n - a) // (3 + g % 8)``.
    """
    if key is None or not n:
        return None
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


def _described(texts: list[list[bytes]]) -> list[tuple]:
    """The columns of the result for texts given as their words."""
    numbers, sizes, base = [], [len(words) for words in texts], 0
    for words in texts:
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        numbers.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)) + base)
        base += len(known)
    first = np.cumsum([0] + sizes)
    every = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(every)) - first[text]
    runs = find_runs(every, text, offset)
    cut = np.searchsorted(runs.text, np.arange(len(texts) + 1))
    rows = []
    for number, words in enumerate(texts):
        at = slice(cut[number], cut[number + 1])
        start, length, period = runs.start[at], runs.length[at], runs.period[at]
        found = zip(start.tolist(), length.tolist(), period.tolist())
        lines = "".join(f"{s},{l},{p}\n" for s, l, p in found)
        longest, kept = (None,) * 4, words
        if len(start):
            best = np.lexsort((period, start, -length))[0]
            s, l, p = int(start[best]), int(length[best]), int(period[best])
            longest = (s, l, p, 1000 * l // p)
            covered = np.zeros(len(words) + 1, np.int64)
            np.add.at(covered, start + period, 1)
            np.add.at(covered, start + length, -1)
            kept = compress(words, (np.cumsum(covered[:-1]) == 0).tolist())
        collapsed = b" ".join(kept)
        rows.append((len(start), *longest, lines, collapsed))
    return rows


def run_rows(
    documents: DataFrame, key: str = "doc_id", text: str = "text", repeat_tails: bool = False
) -> DataFrame:
    """The runs of every text and the text without their repetitions.

    Words are parted by the six ASCII blanks and numbered from 0. A run is a
    stretch of at least 6 words and 4 times its least period q, words q apart
    being the same, that cannot be longer. Returns per row ``key``, ``n_runs``,
    the longest run (``start``, ``length``, ``period``, ``exponent_milli``;
    ties to the least start, then period; nulls without a run), ``runs`` as
    lines ``start,length,period`` by start and period, and ``collapsed``, the
    words that no run holds after its first q, joined by one space.

    ``repeat_tails`` gives one key in ten a text whose tail repeats, see
    ``repeated_tail``; a row without a key stays as it is. A null text counts
    as empty. Every row is one text, also with a repeated key. Keys are whole
    numbers; other columns are ignored. An empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.binary_length(batch.column(1)).to_pylist()
            begin = total = 0
            for end in range(batch.num_rows + 1):
                length = (size[end] or 0) if end < batch.num_rows else TOGETHER + 1
                if end > begin and total + length > TOGETHER:
                    yield described(batch.slice(begin, end - begin))
                    begin, total = end, 0
                total += length

    def described(part: pa.RecordBatch) -> pa.RecordBatch:
        keys, texts = part.column(0).to_pylist(), []
        for name, content in zip(keys, part.column(1).to_pylist()):
            words = content.split() if content else []
            tail = repeated_tail(name, len(words)) if repeat_tails else None
            texts.append(words if tail is None else [words[i] for i in tail.tolist()])
        columns = list(zip(*_described(texts)))
        kinds = [pa.int64()] * 5 + [pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(c, kind) for c, kind in zip(columns, kinds))],
            ["key", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed"],
        )

    rows = documents.select(
        documents[key].cast("long").alias("key"), documents[text].cast("binary").alias("text")
    )
    found = map_batches(
        rows,
        work,
        "key bigint, n_runs bigint, start bigint, length bigint, period bigint, "
        "exponent_milli bigint, runs string, collapsed binary",
    )
    return found.select(
        F.col("key").alias(key),
        *(name for name in found.columns if name not in ("key", "collapsed")),
        F.decode("collapsed", "UTF-8").alias("collapsed"),
    )


def run_digests(documents: DataFrame) -> DataFrame:
    """The runs of ``documents`` with repeated tails, their texts as digests."""
    found = run_rows(documents, repeat_tails=True)
    return found.select(
        "doc_id",
        "n_runs",
        "start",
        "length",
        "period",
        "exponent_milli",
        F.sha2(F.col("runs").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
