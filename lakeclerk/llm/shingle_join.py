"""Documents whose word 5-grams overlap, by prefixes of tokens and of token pairs (operator 13).

A document is the set of its distinct shingles. Two sets whose Jaccard
similarity reaches the bar differ in so few shingles that the first ones of
both, in any common order, share some. Here the order begins with shingles no
other document has, which need no index, then rare ones, then frequent ones. A
rare shingle of a prefix is an index key by itself; frequent shingles are keys
in pairs, and the prefix is longer in return. Documents that share a key are
verified by their whole sets, and the links are closed transitively.

Why no link is lost: let ``tau`` be the most shingles of a set that a similar
one can lack. Frequent shingles are parted into groups by hash. A prefix gives
a unit for every single shingle and for every frequent one but the first of
its group, and ends at ``tau + 1`` units. Take two similar sets and the prefix
that ends first in the order. At most ``tau`` of its shingles are missing from
the other set, so a single shingle or two of one group are left, and they
precede the end of the other prefix too: both have that key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeclerk.llm.graph import components
from lakeclerk.llm.scratch import map_batches, written
from lakeclerk.llm.words import BASE, mixed, shingles
from lakeclerk.llm.words import _powers as powers

SHINGLE = 5  # words
PERCENT = 80  # least Jaccard similarity
PARTS, COUNTED = 1024, 308  # so many of 1,024 shingles, by hash, come first and are counted
BITS = 1 << 26  # bits of the table by which a second reading leaves most texts out
RARE = 8  # documents of a shingle that is a key by itself
GROUP = 10  # a set of n shingles has about n / GROUP groups of frequent ones
SMALL = 64  # documents of a key that are paired as rows; beyond it blocks are compared
BLOCK = 128  # documents that are compared at a time
TOGETHER = 1 << 21  # bytes of text worked on together


def shingle_sets_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """The distinct shingles of every text, in order; under five words the sequence is one.

    Words and shingles are 64-bit hashes, found for all texts together.
    """
    code = np.frombuffer(b"\n".join(text or b"" for text in texts).lower() + b"\n", np.uint8)
    inside = ~((code == 32) | ((code >= 9) & (code <= 13)))
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin = edges[::2]
    starts = np.cumsum([0] + [len(text or b"") + 1 for text in texts])
    first = np.searchsorted(begin, starts)
    if not len(begin):
        return [np.zeros(0, np.uint64)] * len(texts)
    up, down = powers(1 << (len(code) - 1).bit_length())
    value = np.where(inside, code.astype(np.uint64) + np.uint64(1), np.uint64(0))
    value *= up[: len(code)]
    words = mixed(np.add.reduceat(value, begin) * down[begin])
    runs = shingles(words, SHINGLE)
    sets = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= SHINGLE:
            found = np.sort(runs[i : j - SHINGLE + 1])
            new = np.ones(len(found), bool)
            np.not_equal(found[1:], found[:-1], out=new[1:])
            sets.append(found[new])
        else:
            sets.append(shingles(words[i:j], j - i) if j > i else np.zeros(0, np.uint64))
    return sets


def missing(n: int, percent: int) -> int:
    """The most shingles of a set of ``n`` that a similar set can lack."""
    return n - -(-percent * n // 100)


def levels(n: int, percent: int) -> range:
    """Scales (powers of two) of a set of ``n`` shingles and of similar ones that are larger.

    Two sets meet on the scale of the larger one.
    """
    return range(n.bit_length() - 1, (100 * n // percent).bit_length())


def groups(level: int) -> int:
    return max(1, (1 << level) // GROUP)


def counted(values: np.ndarray) -> np.ndarray:
    """Whether shingles belong to those that come first and whose documents are counted."""
    return (values & np.uint64(PARTS - 1)) < COUNTED


def leading(values: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """A sorted set in two: what a prefix may have of it, and the rest.

    All counted shingles, and as many of the others as make up the units of
    the longest prefix.
    """
    first = counted(values)
    n = len(values)
    if n:
        need = missing(n, percent) + 1 + groups(levels(n, percent)[-1])
        others = np.flatnonzero(~first)[: max(0, need - int(first.sum()))]
        first[others] = True
    return values[first], values[~first]


def index_keys(values: np.ndarray, count: np.ndarray, n: int, percent: int) -> np.ndarray:
    """The index keys of a set from its leading shingles and their numbers of documents."""
    kind = np.where(count == 1, 0, np.where(count <= RARE, 1, 2))
    kind[~counted(values)] = 3
    frequent = kind == 2
    scales = levels(n, percent)
    if not frequent.any():
        scales = scales[:1]  # no group, so one order for all
    keys = []
    for level in scales:
        group = np.where(frequent, mixed(values ^ BASE) % np.uint64(groups(level)), np.uint64(0))
        order = np.lexsort((values, group, kind))
        k, g, v, c = kind[order], group[order], values[order], count[order]
        opens = k == 2  # the first shingle of its group gives no unit
        opens[1:] &= (k[1:] != k[:-1]) | (g[1:] != g[:-1])
        end = int(np.searchsorted(np.cumsum(~opens), missing(n, percent) + 1)) + 1
        k, g, v, c = k[:end], g[:end], v[:end], c[:end]
        keys.append(v[(k != 2) & (c > 1)])
        g, v = g[k == 2], v[k == 2]
        salt = mixed(np.array([level + 1], np.uint64))
        for part in np.split(v, np.flatnonzero(g[1:] != g[:-1]) + 1):
            a, b = np.triu_indices(len(part), 1)
            keys.append(mixed((part[a] * BASE + part[b]) ^ salt))
    return np.unique(np.concatenate(keys))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    """A column of lists of 64-bit numbers."""
    ends = np.cumsum([0] + [len(part) for part in parts]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _chunks(batch: pa.RecordBatch, size: pa.Array) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about TOGETHER bytes, by the rows' sizes."""
    begin = total = 0
    for end, length in enumerate(size.to_pylist()):
        if end > begin and total + (length or 0) > TOGETHER:
            yield batch.slice(begin, end - begin)
            begin, total = end, 0
        total += length or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _texts(documents: DataFrame, key: str, text: str) -> DataFrame:
    return documents.select(
        F.monotonically_increasing_id().alias("row"),
        documents[key].cast("long").alias("doc"),
        documents[text].cast("binary").alias("text"),
    )


def shingle_sets(texts: DataFrame, percent: int) -> DataFrame:
    """(``row``, ``doc``, ``n``, ``same``, ``first``) of every row.

    ``same`` is a digest of the set; ``first`` are the shingles a prefix may have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _chunks(batch, pa.compute.binary_length(batch.column(2))):
                sets = shingle_sets_of(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) for s in sets], pa.binary()),
                        _lists([leading(s, percent)[0] for s in sets]),
                    ],
                    ["row", "doc", "n", "same", "first"],
                )

    return map_batches(
        texts, run, "row bigint, doc bigint, n bigint, same binary, first array<bigint>"
    )


def _places(digests: list[bytes]) -> np.ndarray:
    """Places of digests in the table of bits: their first four bytes."""
    whole = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 16)
    return whole[:, :4].copy().view(">u4").ravel().astype(np.int64) % BITS


def _bit_table(digests: DataFrame) -> bytes:
    """A table of BITS bits in which those of all digests (``same``) are set.

    Its size is fixed: however many digests there are, it lets all of them
    through, and of others the fewer the fewer they are.
    """
    place = F.conv(F.substring(F.hex("same"), 1, 8), 16, 10).cast("bigint") % BITS
    words = (
        digests.select(place.alias("place"))
        .groupBy(F.floor(F.col("place") / 32).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, CAST(place % 32 AS int)))").alias("bits"))
    )
    found = words.toPandas()
    table = np.zeros(BITS // 32, np.uint32)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.uint64).astype(np.uint32)
    return table.tobytes()


def _whole_sets(texts: DataFrame, open_rows: DataFrame, percent: int) -> DataFrame:
    """(``row``, ``n``, ``first``, ``rest``) of some rows, from a second reading of the texts.

    Kept whole sets of all texts would be several times as large as the texts;
    those of the few that may have partners are small. A set is known by its
    digest ``same``, and each task gives it once.
    """
    bits = texts.sparkSession.sparkContext.broadcast(_bit_table(open_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = np.frombuffer(bits.value, np.uint32), set()
        for batch in batches:
            for part in _chunks(batch, pa.compute.binary_length(batch.column(0))):
                sets = shingle_sets_of(part.column(0).to_pylist())
                named = {_digest(s): s for s in sets if len(s)}
                place = _places(list(named))
                set_ = (table[place // 32] >> (place % 32).astype(np.uint32)) & 1
                some = [d for d, bit in zip(named, set_.tolist()) if bit and d not in seen]
                seen.update(some)
                both = [leading(named[digest], percent) for digest in some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(some, pa.binary()),
                        _lists([a for a, _ in both]),
                        _lists([b for _, b in both]),
                    ],
                    ["same", "first", "rest"],
                )

    found = map_batches(
        texts.select("text"), run, "same binary, first array<bigint>, rest array<bigint>"
    )
    found = found.groupBy("same").agg(F.first("first").alias("first"), F.first("rest").alias("rest"))
    return open_rows.join(found.hint("merge"), "same").select("row", "n", "first", "rest")


def _shared_shingles(sets: DataFrame) -> DataFrame:
    """(``row``, null, how many shingles it alone leads with), and (null, ``value``, ``holders``).

    The holders of a shingle are counted over all rows, copies too: any fixed
    order will do. The counts of the shingles of one row only are added up
    where they arise, so no more than the shared ones are written.
    """
    held = sets.select("row", F.explode("first").alias("value")).groupBy("value")
    held = held.agg(F.count("*").alias("holders"), F.min("row").alias("row"))
    alone = F.col("holders") == 1
    return (
        held.select(
            F.when(alone, F.col("row")).alias("row"),
            F.when(~alone, F.col("value")).alias("value"),
            "holders",
        )
        .groupBy("row", "value")
        .agg(F.sum("holders").alias("holders"))
    )


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column of 64-bit numbers, without copying them."""
    flat = column.values.to_numpy()
    ends = column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _with_keys(open_rows: DataFrame, percent: int) -> DataFrame:
    """(``key``, ``row``, ``n``) of every index key of some rows.

    The rows come with ``first``, and with ``values`` and ``holders``: those of
    them that are shared, in any order, and their numbers of documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            sizes = batch.column(1).to_pylist()
            lists = (_arrays(batch.column(i)) for i in (2, 3, 4))
            for n, first, shared, holders in zip(sizes, *lists):
                values = np.sort(first.view(np.uint64))
                count = np.ones(len(values), np.int64)
                count[np.searchsorted(values, shared.view(np.uint64))] = holders
                keys.append(index_keys(values, count, n, percent))
            if keys:
                repeats = [len(found) for found in keys]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.repeat(batch.column(0).to_numpy(), repeats)),
                        pa.array(np.repeat(batch.column(1).to_numpy(), repeats)),
                    ],
                    ["key", "row", "n"],
                )

    columns = open_rows.select("row", "n", "first", "values", "holders")
    return map_batches(columns, run, "key bigint, row bigint, n bigint")


def _alike(n: str, other: str, percent: int):
    """Whether the sizes of two sets allow the similarity."""
    return (F.least(n, other) * 100) >= (F.greatest(n, other) * percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose whole sets have the similarity."""
    left = sets.select(F.col("row").alias("a"), F.col("values").alias("_a"))
    right = sets.select(F.col("row").alias("b"), F.col("values").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    either = F.size("_a") + F.size("_b") - both
    rows = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return rows.where(both * 100 >= either * percent).select("a", "b")


def block_links(
    a: list[np.ndarray], b: list[np.ndarray], percent: int, within: bool
) -> list[tuple[int, int]]:
    """Links between two blocks of sets, as few as connect what all of them connect.

    Sets are numbered through, those of ``b`` after those of ``a``; ``within``
    tells that both are the same block. Intersections are products of 0/1
    matrices over the shingles that both blocks have.
    """
    common = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)))

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        marks = np.zeros((len(sets), len(common)), np.float32)
        for i, values in enumerate(sets):
            at = np.searchsorted(common, values)
            at = np.minimum(at, max(0, len(common) - 1))
            if len(common):
                marks[i, at[common[at] == values]] = 1
        return marks

    x = matrix(a)
    both = (x @ (x if within else matrix(b)).T).astype(np.int64)
    either = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None] - both
    linked = np.argwhere(both * 100 >= either * percent)
    root = list(range(len(a) if within else len(a) + len(b)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    links = []
    for i, j in linked.tolist():
        j = j if within else j + len(a)
        p, q = find(i), find(j)
        if p != q:
            root[q] = p
            links.append((i, j))
    return links


def _blocks(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of frequent keys dealt to blocks, and the blocks with their sets.

    A document lies with others of its most frequent key, so a family of
    variants fills few blocks. A key's documents are dealt by hash to as many
    blocks as they need.
    """
    home = members.groupBy("row").agg(F.max(F.struct("holders", "key")).alias("home"))
    home = home.select("row", F.col("home.key").alias("home"))
    size = home.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    dealt = home.join(size, "home").select(
        "row", F.xxhash64("home", F.pmod(F.xxhash64("row"), F.col("parts"))).alias("block")
    )
    dealt = written(dealt, "shingle-blocks")
    packed = (
        sets.join(dealt.hint("merge"), "row")
        .groupBy("block")
        .agg(F.sort_array(F.collect_list(F.struct("row", "values"))).alias("sets"))
    )
    return dealt, written(packed, "shingle-blocks")


def _frequent_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) between documents that share a frequent key, block by block.

    Two blocks meet once however many keys their documents share, and give a
    forest of links at most, so no pair of documents is ever a row.
    """
    dealt, packed = _blocks(members, sets)
    held = written(
        members.join(dealt.hint("merge"), "row").select("key", "block").distinct(), "shingle-blocks"
    )
    cells = held.select("key", F.col("block").alias("a")).join(
        held.select("key", F.col("block").alias("b")).hint("merge"), "key"
    )
    cells = cells.where(F.col("a") <= F.col("b")).select("a", "b").distinct()
    left = packed.select(F.col("block").alias("a"), F.col("sets").alias("left"))
    right = packed.select(F.col("block").alias("b"), F.col("sets").alias("right"))

    def unpacked(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        structs = column.values.slice(column.offsets[0].as_py(), len(column.flatten()))
        sets = [values.view(np.uint64) for values in _arrays(structs.field("values"))]
        return structs.field("row").to_numpy(), sets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                cell = batch.slice(at, 1)
                rows, sets_a = unpacked(cell.column(2))
                within = cell.column(0)[0] == cell.column(1)[0]
                sets_b = sets_a
                if not within:
                    more, sets_b = unpacked(cell.column(3))
                    rows = np.concatenate([rows, more])
                links = np.array(block_links(sets_a, sets_b, percent, within), np.int64)
                links = links.reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[links[:, 0]]), pa.array(rows[links[:, 1]])], ["a", "b"]
                )

    rows = cells.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    # Few cells make an Arrow batch: each holds the sets of two blocks.
    return map_batches(rows.select("a", "b", "left", "right"), run, "a bigint, b bigint")


def similar_sets(texts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that connect all rows of similar sets that differ.

    ``sets`` is a written result of ``shingle_sets`` on ``texts``. Of equal
    sets the least row stands for all.
    """
    chosen = sets.groupBy("same").agg(F.min("row").alias("row"), F.first("n").alias("n"))
    facts = written(_shared_shingles(sets), "shingle-counts")
    alone = facts.where(F.col("row").isNotNull()).select("row", F.col("holders").alias("alone"))
    lacking = F.col("n") - F.ceil(F.col("n") * percent / 100)
    # A set with more shingles of its own than a similar one may lack has no partner.
    open_rows = (
        chosen.join(alone.hint("merge"), "row", "left")
        .where((F.col("n") > 0) & (F.coalesce("alone", F.lit(0)) <= lacking))
        .select("row", "n", "same")
    )
    open_rows = written(open_rows, "shingle-open")
    left = written(_whole_sets(texts, open_rows, percent), "shingle-whole")
    shared = facts.where(F.col("value").isNotNull()).select("value", "holders")
    known = (
        left.select("row", F.explode("first").alias("value"))
        .join(shared.hint("merge"), "value")
        .groupBy("row")
        .agg(F.collect_list(F.struct("value", "holders")).alias("known"))
        .select("row", F.col("known.value").alias("values"), F.col("known.holders").alias("holders"))
    )
    with_known = left.select("row", "n", "first").join(known.hint("merge"), "row")
    keys = written(_with_keys(with_known, percent), "shingle-keys")
    held = keys.groupBy("key").agg(F.count("*").alias("holders"), F.min("row").alias("leader"))
    members = written(
        keys.join(held.where(F.col("holders") > 1).hint("merge"), "key"), "shingle-keys"
    )
    few = members.where(F.col("holders") <= SMALL)
    many = members.where(F.col("holders") > SMALL)
    whole = left.select("row", F.concat("first", "rest").alias("values"))
    # First every document with the first one of each of its keys.
    sizes = left.select(F.col("row").alias("leader"), F.col("n").alias("m"))
    stars = (
        few.where(F.col("row") > F.col("leader"))
        .groupBy("row", "leader")
        .agg(F.first("n").alias("n"))
        .join(sizes.hint("merge"), "leader")
        .where(_alike("n", "m", percent))
        .select(F.col("leader").alias("a"), F.col("row").alias("b"))
    )
    stars = written(stars, "shingle-stars")
    links = _verified(stars, whole, percent).unionByName(_frequent_links(many, whole, percent))
    links = written(links, "shingle-links")
    # Then what shares a key and is not connected by now, but no pair again.
    place = written(components(links), "shingle-components")
    of = place.select(F.col("node").alias("row"), "component")
    apart = few.where(F.col("holders") > 2).join(of.hint("merge"), "row", "left")
    apart = apart.select("key", "row", "n", F.coalesce("component", "row").alias("component"))
    open_keys = (
        apart.groupBy("key")
        .agg(F.min("component").alias("least"), F.max("component").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select("key")
    )
    apart = written(apart.join(open_keys.hint("merge"), "key"), "shingle-apart")
    one = apart.select("key", F.col("row").alias("a"), "n", F.col("component").alias("_one"))
    two = apart.select(
        "key", F.col("row").alias("b"), F.col("n").alias("m"), F.col("component").alias("_two")
    )
    pairs = (
        one.join(two.hint("merge"), "key")
        .where((F.col("a") < F.col("b")) & (F.col("_one") != F.col("_two")))
        .where(_alike("n", "m", percent))
        .select("a", "b")
        .distinct()
        .join(stars.hint("merge"), ["a", "b"], "left_anti")
    )
    more = written(_verified(pairs, whole, percent), "shingle-links")
    return links.unionByName(more)


def shingle_components(
    documents: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT
) -> DataFrame:
    """One row per document: the key, ``n_shingles`` and ``component_id``.

    Letters A-Z are lower-cased; words are parted by the six ASCII blanks. The
    shingles of a text are its distinct runs of five words; fewer words are one
    shingle together; a null or empty text, or one of blanks, has none and is
    linked with nothing. Two documents link when 100 times the size of their
    intersection is at least ``percent`` times that of their union.
    ``component_id`` is the least key that links lead to, the own one included.

    Every row counts as a document of its own, also with a repeated key; a row
    without a key has the component of those it is linked with, null without
    any. Keys are whole numbers; other columns are ignored. Shingles are 64-bit
    hashes. An empty table gives an empty result.
    """
    texts = _texts(documents, key, text)
    sets = written(shingle_sets(texts, percent), "shingle-sets")
    found = written(components(similar_sets(texts, sets, percent)), "shingle-components")
    alike = sets.groupBy("same").agg(F.min("row").alias("row"), F.min("doc").alias("doc"))
    placed = alike.join(found, alike["row"] == found["node"], "left").select(
        "same", "doc", F.coalesce("component", "row").alias("component")
    )
    placed = written(placed, "shingle-components")
    least = placed.groupBy("component").agg(F.min("doc").alias("component_id"))
    classes = placed.join(least.hint("merge"), "component").select("same", "component_id")
    return sets.select("doc", "n", "same").join(classes.hint("merge"), "same").select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"),
    )
