"""Near-duplicate documents by order min hash (operator 6).

The shingles of a text are its runs of five words, each labelled with the
number of times it has occurred before, so that all are distinct. A sketch
takes, for each of several hash functions, the few shingles with the least
hashes and keeps them in the order of the text. Texts that share an entry are
candidates: they share shingles in the same order. Each is compared with the
first of its group; then the texts of a group that are not in one class yet are
compared with each other, two texts in one of the groups that they share. Counts
of words, which bound the edit distance, rule most false candidates out, and an
alignment of the whole word sequences decides: an edit similarity of 0.8 or more
makes a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeclerk.llm.align import distances
from lakeclerk.llm.graph import components
from lakeclerk.llm.scratch import consumed, in_chunks, map_frames, numbered, row_name, written
from lakeclerk.llm.words import BASE, mixed, scan_words, shingles

SHINGLE = 5  # words
SIMILARITY = 0.8
COUNTS = (48, 24, 24)  # hash functions of each kind of entry
ENTRIES = sum(COUNTS)
SAMPLE = 1024  # shingles of least hash that the entries are chosen from
TOGETHER = 1 << 20  # characters or words that are worked on together
BAG = 1_024  # counts of hashed words of a text, two in a byte
ROUGH = 8  # counts of a bag that are added up for a first look
BLOCK = 4_096  # texts of a group that one task compares with as many others


def labelled(values: np.ndarray) -> np.ndarray:
    """Hashes that also tell how often the value has occurred before."""
    if not len(values):
        return values
    order = np.argsort(values, kind="stable")
    sorted_ = values[order]
    new = np.empty(len(values), bool)
    new[0] = True
    np.not_equal(sorted_[1:], sorted_[:-1], out=new[1:])
    place = np.arange(len(values))
    seen = place - np.maximum.accumulate(np.where(new, place, 0))
    result = np.empty_like(values)
    result[order] = mixed(sorted_ + seen.astype(np.uint64) * BASE)
    return result


def sketch(words: np.ndarray) -> np.ndarray:
    """Entries of a text, each a hash of its least shingles in text order.

    Shingles of least hash are a sample that near copies share; the sample of
    a text with at most SAMPLE shingles is all of them. A text of fewer than
    five words has no entries.

    Scattered edits leave few long shingles, so only the first kind is of long
    ones. The others change at different lengths, so that copies of different
    lengths have at least one of them in common.
    """
    if len(words) < SHINGLE:
        return np.zeros(0, np.uint64)
    return _sketch(words)


def _sketch(words: np.ndarray) -> np.ndarray:
    """Entries of a text of four words or more: one of four can be like one of five."""
    parts, first = [], 1
    for (size, taken), count in zip(kinds(len(words)), COUNTS):
        some = labelled(shingles(words, min(size, len(words))))
        parts.append(_entries(some, taken, first, count))
        first += count
    return np.concatenate(parts)


def kinds(length: int) -> tuple[tuple[int, int], ...]:
    """Words of a shingle and shingles of an entry, by kind, for a text of so many words."""
    return (SHINGLE, 3), (4 if length > 20 else 2, 1), (3, 2 if length > 50 else 1)


def _entries(values: np.ndarray, taken: int, first: int, count: int) -> np.ndarray:
    """Entries by ``count`` hash functions from the ``first`` on."""
    if len(values) > SAMPLE:
        place = np.sort(np.argpartition(values, SAMPLE)[:SAMPLE])
        values = values[place]
    taken = min(taken, len(values))
    factor = mixed(np.arange(first, first + count, dtype=np.uint64)) | np.uint64(1)
    rank = values[None, :] * factor[:, None]
    rank ^= rank >> np.uint64(32)
    rank *= BASE
    least = np.empty((count, taken), np.int64)
    every = np.arange(count)
    for step in range(taken):
        least[:, step] = rank.argmin(axis=1)
        if step + 1 < taken:
            rank[every, least[:, step]] = np.uint64(2**64 - 1)
    least.sort(axis=1)  # by place in the text
    entry = np.full(count, taken, np.uint64)
    for step in range(taken):
        entry = entry * BASE + values[least[:, step]]
    return mixed(entry)


def bag_of(words: np.ndarray) -> np.ndarray:
    """Counts of a text's words by hash, up to 15, two in a byte."""
    counts = np.bincount((words >> np.uint64(54)).astype(np.int64), minlength=BAG)
    counts = np.minimum(counts, 15).astype(np.uint8)
    return counts[::2] | counts[1::2] << 4


def _counts(bags: pd.Series) -> np.ndarray:
    """Bags as rows of counts."""
    both = np.frombuffer(b"".join(bags), np.uint8).reshape(-1, BAG // 2)
    return np.stack([both & 15, both >> 4], axis=2).reshape(-1, BAG)


def _rough(counts: np.ndarray) -> np.ndarray:
    return counts.reshape(len(counts), -1, ROUGH).sum(axis=2, dtype=np.int16)


def bags_near(
    bags: np.ndarray, others: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, similarity: float
) -> np.ndarray:
    """Whether two texts may have the similarity, by their bags and their words' numbers.

    An edit takes at most one word off what both have, so the counts of texts
    with ``d`` edits differ by 2 d less the difference of their sizes at most.
    """
    most = ((1 - similarity) * np.maximum(sizes, lengths) + 1e-9).astype(np.int64)
    # Counts of a byte are below 16, and so are their differences in eight bits.
    kind = np.int8 if bags.dtype == np.uint8 else bags.dtype
    differ = np.abs(bags.astype(kind) - others.astype(kind)).sum(axis=1, dtype=np.int32)
    return differ <= 2 * most - np.abs(sizes - lengths)


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    rows = documents.select(documents[key].cast("long").alias("doc"), documents[text].alias("text"))
    return rows.where(F.col("doc").isNotNull() & (F.length("text") > 0))


def _described(texts: DataFrame) -> DataFrame:
    """(``doc``, ``same``, ``entries``, ``size``, ``bag``) of every text.

    ``same`` tells texts of equal words apart from all others; a text without a
    word counts as its characters. An entry is kept as 32 bits. ``bag`` counts
    the ``size`` words by hash.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in in_chunks(frame, "text", TOGETHER):
                found = scan_words(part["text"].tolist())
                same, entries, size, bag = [], [], [], []
                for text, begin, end in zip(part["text"], found.first[:-1], found.first[1:]):
                    words = found.hashes[begin:end]
                    content = words.tobytes() or text.encode("utf-8", "replace")
                    same.append(hashlib.blake2b(content, digest_size=16).digest())
                    some = _sketch(words) if len(words) >= SHINGLE - 1 else words[:0]
                    entries.append((some >> np.uint64(32)).astype("<u4").tobytes())
                    size.append(len(words))
                    bag.append(bag_of(words).tobytes())
                yield pd.DataFrame(
                    {"doc": part["doc"], "same": same, "entries": entries, "size": size, "bag": bag}
                )

    return map_frames(texts, run, "doc bigint, same binary, entries binary, size bigint, bag binary")


def _entry_rows(sketches: DataFrame) -> DataFrame:
    """(``doc``, ``entry``, ``next``) for every entry of every sketch.

    The entry's place in the sketch is in front of it, above its 32 bits, so two
    texts are in one group wherever their sketches are equal and nowhere else;
    ``next`` is the entry that follows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = np.arange(ENTRIES, dtype=np.int64) << 32
        for frame in frames:
            some = frame[frame["entries"].str.len() > 0]
            for begin in range(0, len(some), 512):
                part = some.iloc[begin : begin + 512]
                entry = np.frombuffer(b"".join(part["entries"]), "<u4").reshape(-1, ENTRIES)
                after = np.roll(entry, -1, axis=1).view(np.int32)
                yield pd.DataFrame(
                    {
                        "doc": np.repeat(part["doc"].to_numpy(), ENTRIES),
                        "entry": (entry.astype(np.int64) | place).ravel(),
                        "next": after.ravel(),
                    }
                )

    return map_frames(sketches.select("doc", "entries"), run, "doc bigint, entry bigint, next int")


def _candidates(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Written distinct pairs (``doc``, ``leader``): every text with the least of those it shares an entry with.

    The second frame, written too, has the rows of entries that texts share.

    A group of any size gives one pair for each member, never all pairs. Two
    groupings give two leaders: by one entry, and by one entry and the next
    together, which parts a group that only a common passage holds together.
    Least and greatest are reduced in each task before the shuffle. This join and
    those of the texts are by shuffle at every size, as neither side is bounded.
    """

    def shared(rows: DataFrame, by: list[str]) -> DataFrame:
        least = rows.groupBy(*by).agg(F.min("doc").alias("leader"), F.max("doc").alias("other"))
        some = least.where(F.col("leader") < F.col("other")).drop("other")
        return rows.join(some.hint("merge"), by)

    single = written(shared(entries, ["entry"]), "shared-entries")
    fine = shared(single.drop("leader"), ["entry", "next"])
    both = single.select("doc", "leader").unionByName(fine.select("doc", "leader"))
    return written(both.where(F.col("doc") > F.col("leader")).distinct(), "pairs"), single


def _close(pairs: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``doc``, ``leader``) that may have the similarity by their bags."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            near = bags_near(
                _counts(frame["bag"]),
                _counts(frame["others"]),
                frame["size"].to_numpy(),
                frame["length"].to_numpy(),
                similarity,
            )
            yield frame.loc[near, ["doc", "leader"]]

    leaders = bags.select(
        F.col("doc").alias("leader"), F.col("size").alias("length"), F.col("bag").alias("others")
    )
    rows = pairs.join(bags.hint("merge"), "doc").join(leaders.hint("merge"), "leader")
    # Lengths alone rule many out.
    longer = F.greatest("size", "length")
    near = F.abs(F.col("size") - F.col("length")) <= (1 - similarity) * longer + 1e-6
    rows = rows.where(near).select("doc", "leader", "size", "length", "bag", "others")
    return map_frames(rows, run, "doc bigint, leader bigint").distinct()


def _between(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """(``part``, ``place``, ``side``, ``doc``, ``component``): texts to be compared for being in different classes.

    Rows of a part are compared with each other where their components differ,
    and of two sides only across (``side`` is 2 where a part has one); ``place``
    is that of the group's entry in the sketches. Only groups with texts of
    several components are left. A group of more than
    BLOCK texts is dealt out in blocks, every two of them a part: a component of
    more texts than that has blocks of its own, which need not meet each other.
    """
    name = classes.select(F.col("node").alias("doc"), "component")
    members = shared.join(name.hint("merge"), "doc", "left").select(
        "entry", "doc", F.coalesce("component", "doc").alias("component")
    )
    least, most = F.min("component"), F.max("component")
    mixed = members.groupBy("entry").agg(least.alias("low"), most.alias("high")).where("low < high")
    members = written(members.join(mixed.select("entry").hint("merge"), "entry"), "mixed-groups")
    sizes = members.groupBy("entry", "component").agg(F.count("*").alias("texts"))
    large = F.col("texts") > BLOCK
    rest = F.sum(F.when(large, 0).otherwise(F.col("texts")))
    sizes = sizes.join(sizes.groupBy("entry").agg(rest.alias("rest")).hint("merge"), "entry")
    sizes = sizes.select(
        "entry",
        "component",
        F.when(large, F.col("component")).alias("own"),
        F.ceil(F.when(large, F.col("texts")).otherwise(F.col("rest")) / BLOCK).alias("blocks"),
    )
    number = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    placed = members.join(sizes.hint("merge"), ["entry", "component"]).withColumn(
        "block", F.concat_ws("/", F.coalesce(F.col("own").cast("string"), F.lit("")), number)
    )
    blocks = placed.select("entry", "own", "block").distinct()
    others = blocks.select("entry", F.col("own").alias("other_own"), F.col("block").alias("other"))
    one = F.coalesce(F.col("own") == F.col("other_own"), F.lit(False))
    parts = blocks.join(others.hint("merge"), "entry").where((F.col("block") <= F.col("other")) & ~one)
    alone = F.col("block") == F.col("other")
    parts = parts.withColumn("part", F.xxhash64("entry", "block", "other"))
    sides = parts.select("entry", "block", "part", F.when(alone, 2).otherwise(0).alias("side")).unionByName(
        parts.where(~alone).select("entry", F.col("other").alias("block"), "part", F.lit(1).alias("side"))
    )
    rows = placed.join(sides.hint("merge"), ["entry", "block"])
    return rows.select("part", F.shiftright("entry", 32).alias("place"), "side", "doc", "component")


def _turn(docs: np.ndarray, others: np.ndarray, entries: np.ndarray, more: np.ndarray) -> np.ndarray:
    """The place at which two texts are compared, -1 where their sketches share no entry.

    It is the first shared one, counted from a place that depends on the two
    documents, so that the pairs of a large group are dealt out over its texts'
    other groups. ``entries`` are rows of sketches; those of zeros are of texts
    that have none.
    """
    ends = np.minimum(docs, others).view(np.uint64), np.maximum(docs, others).view(np.uint64)
    start = (mixed(ends[0] * BASE + ends[1]) % np.uint64(ENTRIES)).astype(np.int16)
    turn = (np.arange(ENTRIES, dtype=np.int16) - start[:, None]) % ENTRIES
    shared = (entries == more) & entries.any(axis=1, keepdims=True)
    found = np.where(shared, turn, ENTRIES).argmin(axis=1)
    return np.where(shared.any(axis=1), found, -1)


def _across(rows: DataFrame, bags: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (``doc``, ``leader``) of the rows of ``_between`` that may have the similarity.

    Texts of a part come by length: each meets those only that are longer by no
    more than the similarity allows. Of the groups that two texts share, one
    looks at them, so a pair leaves once however many entries it shares; texts
    of a key that has several may meet where their own sketches share none.
    """

    def near(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        part, size, doc = (frame[name].to_numpy() for name in ("part", "size", "doc"))
        side, component, bags = frame["side"].to_numpy(), frame["component"].to_numpy(), _counts(frame["bag"])
        group = frame["place"].to_numpy()
        entries = b"".join(x or bytes(4 * ENTRIES) for x in frame["entries"])
        entries = np.frombuffer(entries, "<u4").reshape(-1, ENTRIES)
        rough = _rough(bags)
        place = np.cumsum(np.diff(part, prepend=part[:1]) != 0) << 32
        longest = ((size + 1e-6) / similarity).astype(np.int64)
        begin = np.arange(1, len(part) + 1)
        ends = np.searchsorted(place + size, place + longest, "right")
        total = np.cumsum(ends - begin)
        at = 0
        while at < len(part):
            # Some texts with all their partners; of one text there are two blocks at most.
            to = int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER // 128, "right"))
            to = max(at + 1, to)
            count = (ends - begin)[at:to]
            first = np.repeat(np.arange(at, to), count)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
            asked = (component[first] != component[second]) & (doc[first] != doc[second])
            asked &= (side[first] != side[second]) | (side[first] == 2)
            first, second = first[asked], second[asked]
            kept = bags_near(rough[first], rough[second], size[first], size[second], similarity)
            first, second = first[kept], second[kept]
            turn = _turn(doc[first], doc[second], entries[first], entries[second])
            kept = (turn == group[first]) | (turn < 0)
            first, second = first[kept], second[kept]
            kept = bags_near(bags[first], bags[second], size[first], size[second], similarity)
            both = doc[first[kept]], doc[second[kept]]
            found = pd.DataFrame({"doc": np.maximum(*both), "leader": np.minimum(*both)})
            yield found.drop_duplicates()
            at = to

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for frame in frames:
            frame = frame if left is None else pd.concat([left, frame], ignore_index=True)
            last = int((frame["part"].to_numpy() != frame["part"].iloc[-1]).sum()) if len(frame) else 0
            if last:
                yield from near(frame[:last])
            left = frame[last:]
        if left is not None and len(left):
            yield from near(left)

    dealt = rows.join(bags.hint("merge"), "doc").repartition("part").sortWithinPartitions("part", "size")
    return map_frames(dealt, run, "doc bigint, leader bigint").distinct()


def _words(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(``doc``, ``words``) of the documents in the pairs, a word as 32 bits."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part in in_chunks(frame, "text", TOGETHER):
                found = scan_words(part["text"].tolist())
                words = (found.hashes >> np.uint64(32)).astype("<u4")
                cut = zip(found.first[:-1], found.first[1:])
                yield pd.DataFrame(
                    {"doc": part["doc"], "words": [words[a:b].tobytes() for a, b in cut]}
                )

    members = pairs.select("doc").unionByName(pairs.select(F.col("leader").alias("doc"))).distinct()
    return map_frames(texts.join(members.hint("merge"), "doc", "left_semi"), run, "doc bigint, words binary")


def _verified(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``doc``, ``leader``) whose alignment has the similarity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            kept, group, size = [], [], 0

            def judge() -> None:
                both = [(np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")) for _, _, a, b in group]
                most = [int((1 - similarity) * max(len(a), len(b)) + 1e-9) for a, b in both]
                for row, found in zip(group, distances(both, most)):
                    if found is not None:
                        kept.append(row[:2])

            for row in zip(frame["doc"], frame["leader"], frame["words"], frame["others"]):
                group.append(row)
                size += len(row[2]) + len(row[3])
                if size > 4 * TOGETHER:
                    judge()
                    group, size = [], 0
            judge()
            yield pd.DataFrame(kept, columns=["doc", "leader"])

    leaders = words.select(F.col("doc").alias("leader"), F.col("words").alias("others"))
    # The leader of a large group joins a great many rows; adaptive execution
    # splits that partition.
    rows = pairs.join(words.hint("merge"), "doc").join(leaders.hint("merge"), "leader")
    return map_frames(
        rows.select("doc", "leader", "words", "others"), run, "doc bigint, leader bigint"
    )


def _links(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Written distinct links (``doc``, ``leader``) among written pairs, which are removed."""
    words = written(_words(texts, pairs), "words")
    links = written(_verified(pairs, words, similarity).distinct(), "links")
    consumed(words)
    consumed(pairs)
    return links


def near_duplicates(
    documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """One row for each document: the key, ``class_id`` and ``n_links``.

    ``class_id`` is the least key of the class; ``n_links`` counts the verified
    links between the document's text and others plus, for an exact copy, the one
    to its representative: links to the first ones of the groups it is in or
    leads, and those that join classes beyond these. Documents of the same words
    are one text from the start, whatever their number. Links are closed
    transitively.

    Null and empty texts are a class each; so is a row without a key, with a
    null class. Texts without words are copies only if equal; texts with fewer
    than four words only if their words are equal. Rows with a repeated key
    are one document that has the texts of all. Keys are integers.

    Texts share an entry with a probability, near 1 for an edit similarity of
    0.8 whose edits are at random places; the README has simulated figures. Any
    two texts that share one are in one class or were compared. Texts that the
    first ones have brought into one class are not compared again, so ``n_links``
    does not count every member of the class that is near.
    """
    texts = _texts(documents, key, text)
    described = written(_described(texts), "sketches")
    alike = described.groupBy("same").agg(
        F.min("doc").alias("least"), F.min_by("entries", "doc").alias("entries")
    )
    pairs, shared = _candidates(_entry_rows(alike.select(F.col("least").alias("doc"), "entries")))
    bags = described.select("doc", "size", "bag", "entries")
    close = written(_close(pairs, bags.select("doc", "size", "bag"), similarity), "close-pairs")
    consumed(pairs)
    links = _links(texts, close, similarity)
    # Copies hang on one representative: only links between texts need rounds.
    edges = links.select(F.col("doc").alias("a"), F.col("leader").alias("b"))
    found = written(components(edges), "classes")
    rows = _between(shared, found)
    close = written(_across(rows, bags, similarity), "close-pairs")
    consumed(shared)
    if not close.isEmpty():
        more = _links(texts, close, similarity)
        edges = more.select(F.col("doc").alias("a"), F.col("leader").alias("b"))
        known = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = written(components(known.unionByName(edges)), "classes")
        links = links.unionByName(more).distinct()
    alike = described.groupBy("same").agg(F.min("doc").alias("least"))
    copies = (
        described.select("doc", "same")
        .join(alike, "same")
        .where(F.col("doc") != F.col("least"))
        .select(F.col("doc").alias("a"), F.col("least").alias("b"))
        .distinct()
    )
    ends = links.select(F.explode(F.array("doc", "leader")).alias("node"))
    own = ends.groupBy("node").agg(F.count("*").alias("links"))
    of_copy = copies.join(found, copies["b"] == found["node"], "left").select(
        F.col("a").alias("node"), F.coalesce("component", "b").alias("component")
    )
    classes = (
        found.select("node", "component")
        .unionByName(of_copy)
        .groupBy("node")
        .agg(F.min("component").alias("component"), F.count("*").alias("ways"))
    )
    copied = copies.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("copies"))
    facts = classes.join(own, "node", "left").join(copied, "node", "left")
    ids = documents.select(documents[key].cast("long").alias(key))
    return ids.join(facts, ids[key] == facts["node"], "left").select(
        key,
        F.coalesce("component", F.col(key)).alias("class_id"),
        (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("n_links"),
    )


def drop_near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one document of each class: the one with the least key."""
    found = near_duplicates(documents, key, text)
    gone = found.where(F.col("class_id") != F.col(key)).select(F.col(key).alias("_gone")).distinct()
    return documents.join(gone.hint("merge"), documents[key] == gone["_gone"], "left_anti")


def drop_near_rows(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with one row of each class, decided by rows instead of keys.

    Of a class the row with the least key stays, the first one of repeated
    rows; a row without a key stays only where the class has none with one.
    Rows that share a key are judged each by its own text.
    """
    row = row_name(documents)
    rows = numbered(documents, "near-rows", row)
    classes = near_duplicates(rows.select(row, text), row, text).select(row, "class_id")
    keys = rows.select(row, F.col(key).cast("long").alias("key"))
    members = written(classes.join(keys.hint("merge"), row), "near-members")
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", row)
    first = members.groupBy("class_id").agg(F.min(place).alias("first"))
    kept = first.select("class_id", F.col("first")[row].alias("_kept"))
    gone = members.join(kept.hint("merge"), "class_id").where(F.col(row) != F.col("_kept"))
    gone = gone.select(F.col(row).alias("_gone"))
    left = rows.join(gone.hint("merge"), rows[row] == gone["_gone"], "left_anti")
    return left.select(*documents.columns)
