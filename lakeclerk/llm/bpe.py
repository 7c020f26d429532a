"""Byte-level BPE by a tree of joins, forth and back (operator 5).

Encoding halves a piece until the parts are short, merges those directly, and
joins neighbours up the tree: a window of tokens around the seam is encoded
anew and grows until its outermost tokens come out as they were. In the result
every two neighbours then are neighbours that some encoding of theirs gave, so
a larger window would change nothing. Decoding concatenates byte strings up a
tree of the same kind.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeclerk.llm.pieces import split
from lakeclerk.llm.scratch import in_chunks, map_frames

LEAF = 16  # bytes that are merged directly
KNOWN = 400_000  # encoded pieces a worker remembers
BLOCK = 1 << 18  # bytes that are merged together
TOGETHER = 1 << 20  # characters that are encoded together
NONE = 1 << 40  # no token


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a tiktoken file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class TreeBpe:
    """Encodes and decodes with the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values()) + 1)
        pairs = {}
        for data, rank in ranks.items():
            self.token[rank] = data
            for cut in range(1, len(data)):
                left, right = ranks.get(data[:cut]), ranks.get(data[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self._byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self._pairs = np.array([-1, *sorted(pairs)], np.int64)
        self._ranks = np.array([NONE, *(pairs[x] for x in sorted(pairs))], np.int64)
        self._known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that two neighbours form, or NONE."""
        wanted = left << 32 | right
        at = np.searchsorted(self._pairs, wanted, "right") - 1
        return np.where(self._pairs[at] == wanted, self._ranks[at], NONE)

    def _merge_block(self, parts: list[bytes]) -> list[list[int]]:
        sizes = np.array([len(part) for part in parts])
        width = int(sizes.max()) + 1  # one column stays free, so that rows can shift
        column = np.arange(width)
        token = np.full((len(parts), width), -1, np.int64)
        token[column < sizes[:, None]] = self._byte[np.frombuffer(b"".join(parts), np.uint8)]
        rank = np.full((len(parts), width), NONE, np.int64)
        inner = column[:-1] < sizes[:, None] - 1
        rank[:, :-1][inner] = self._rank(token[:, :-1][inner], token[:, 1:][inner])
        done: list[list[int]] = [[]] * len(parts)
        row = np.arange(len(parts))
        while len(row):
            at = rank.argmin(1)
            every = np.arange(len(row))
            least = rank[every, at]
            ended = least == NONE
            if ended.any():
                for i in np.flatnonzero(ended).tolist():
                    done[row[i]] = token[i, : sizes[i]].tolist()
                kept = ~ended
                row, token, rank, sizes = row[kept], token[kept], rank[kept], sizes[kept]
                at, least, every = at[kept], least[kept], every[: kept.sum()]
                if not len(row):
                    break
            take = np.minimum(column + (column > at[:, None]), width - 1)
            token = np.take_along_axis(token, take, 1)
            rank = np.take_along_axis(rank, take, 1)
            token[every, at] = least
            sizes = sizes - 1
            right = at + 1 < sizes
            rank[every, at] = NONE
            rank[every[right], at[right]] = self._rank(least[right], token[every, at + 1][right])
            left = at > 0
            rank[every[left], at[left] - 1] = self._rank(
                token[every[left], at[left] - 1], least[left]
            )
        return done

    def merge(self, parts: list[bytes]) -> list[list[int]]:
        """Of every byte string: merge the neighbours of lowest rank, the leftmost
        first, until no two neighbours form a token."""
        order = sorted(range(len(parts)), key=lambda i: len(parts[i]))
        done: list[list[int]] = [[]] * len(parts)
        begin = 0
        while begin < len(order):
            end = begin + 1  # rows of about the same length, of bounded size together
            size = max(1, len(parts[order[begin]]))
            while (
                end < len(order)
                and len(parts[order[end]]) <= size + 4
                and (end - begin) * (size + 4) < BLOCK
            ):
                end += 1
            block = order[begin:end]
            for i, ids in zip(block, self._merge_block([parts[i] for i in block])):
                done[i] = ids
            begin = end
        return done

    def join(self, sides: list[tuple[list[int], list[int]]]) -> list[list[int]]:
        """Of every two encoded neighbours the tokens of their concatenation."""
        token = self.token
        done: list[list[int]] = [[]] * len(sides)
        reach = {i: (min(2, len(a)), min(2, len(b))) for i, (a, b) in enumerate(sides)}
        while reach:
            windows = [
                b"".join(token[x] for x in sides[i][0][-a:] + sides[i][1][:b])
                for i, (a, b) in reach.items()
            ]
            merged, more = self.merge(windows), {}
            for (i, (a, b)), window in zip(reach.items(), merged):
                left, right = sides[i]
                # A side that is taken whole has nothing outside to disagree with.
                left_done = a == len(left) or window[0] == left[-a]
                right_done = b == len(right) or window[-1] == right[b - 1]
                if left_done and right_done:
                    done[i] = left[: len(left) - a] + window + right[b:]
                else:
                    more[i] = (
                        a if left_done else min(len(left), 2 * a),
                        b if right_done else min(len(right), 2 * b),
                    )
            reach = more
        return done

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of matches of the split pattern; a piece that is a token is that token.

        The trees of all pieces grow together, level by level: leaves of LEAF
        bytes are merged, then neighbours are joined until one is left of each.
        """
        ranks = self.ranks
        found: list[list[int]] = [[ranks[p]] if p in ranks else [] for p in pieces]
        cut = [
            (i, piece[at : at + LEAF])
            for i, piece in enumerate(pieces)
            if not found[i]
            for at in range(0, len(piece), LEAF)
        ]
        trees: dict[int, list[list[int]]] = {}
        for (i, _), ids in zip(cut, self.merge([leaf for _, leaf in cut])):
            trees.setdefault(i, []).append(ids)
        while trees:
            for i in [i for i, level in trees.items() if len(level) == 1]:
                found[i] = trees.pop(i)[0]
            seams = [
                (i, level[at : at + 2])
                for i, level in trees.items()
                for at in range(0, len(level), 2)
            ]
            joined = iter(self.join([tuple(x) for _, x in seams if len(x) == 2]))
            trees = {}
            for i, sides in seams:
                trees.setdefault(i, []).append(next(joined) if len(sides) == 2 else sides[0])
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text as little-endian unsigned 32-bit integers."""
        if len(self._known) >= KNOWN:
            self._known.clear()
        known = self._known
        cut = [split(text) for text in texts]
        new = list({piece for pieces in cut for piece in pieces if piece not in known})
        ids = self.encode_pieces([piece.encode("utf-8", "replace") for piece in new])
        known.update((p, np.array(x, "<u4").tobytes()) for p, x in zip(new, ids))
        return [b"".join([known[piece] for piece in pieces]) for pieces in cut]

    def decode(self, ids: bytes) -> bytes:
        """Bytes of the ids, concatenated up a tree."""
        token = self.token
        level = [token[i] for i in np.frombuffer(ids, "<u4").tolist()]
        while len(level) > 1:
            level = [b"".join(level[i : i + 32]) for i in range(0, len(level), 32)]
        return level[0] if level else b""


_encoders: dict[str, TreeBpe] = {}


def encoder(path: str) -> TreeBpe:
    """The encoder of a rank file, read once in every worker."""
    if path not in _encoders:
        _encoders[path] = TreeBpe(read_ranks(path))
    return _encoders[path]


def encode_documents(
    documents: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every text and decode it again.

    Returns the key, ``ids`` (little-endian unsigned 32-bit), ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256``. A null or empty text has no ids and
    the digests of no bytes; the key is passed on as it is, null or repeated.
    The rank file is read on each executor from ``ranks_path``. One row in, one
    row out: there is no shuffle. A single piece of any length takes memory in
    proportion to it.
    """
    kind = documents.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(ranks_path)
        for frame in frames:
            for part in in_chunks(frame, "bpe_text", TOGETHER):
                ids = bpe.encode([value or "" for value in part["bpe_text"]])
                yield pd.DataFrame(
                    {
                        key: part["bpe_key"],
                        "ids": ids,
                        "n_tokens": [len(x) // 4 for x in ids],
                        "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                        "decoded_sha256": [
                            hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids
                        ],
                    }
                )

    found = map_frames(
        documents.select(
            documents[key].cast("string").alias("bpe_key"), documents[text].alias("bpe_text")
        ),
        run,
        f"`{key}` string, ids binary, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    )
    return found.withColumn(key, F.col(key).cast(kind))
