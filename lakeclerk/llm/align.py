"""Alignment of sequences of word hashes, by rows of bits or in a band."""

from __future__ import annotations

import numpy as np

CELLS = 1 << 20  # cells of all pairs that are worked on at a time
BITS = 1 << 18  # words of a sequence up to which a row of bits is as fast as a band


def _trim(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sequences without what they share at the begin and the end."""
    size = min(len(a), len(b))
    same = a[:size] == b[:size]
    head = size if same.all() else int(same.argmin())
    a, b, size = a[head:], b[head:], size - head
    if size:
        same = a[::-1][:size] == b[::-1][:size]
        tail = size if same.all() else int(same.argmin())
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    return a, b


def _by_bits(a: list[int], b: list[int]) -> int:
    """Edit distance, a row of the whole table at a time.

    Neighbouring cells of a row differ by at most one: ``up`` has the places
    where they grow, ``down`` those where they shrink (Myers, Hyyro).
    """
    places: dict[int, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(a)) - 1
    up, down = full, 0
    for word in b:
        same = places.get(word, 0)
        level = (((same & up) + up) ^ up) | same | down
        same |= down
        grows = down | (full & ~(level | up))
        shrinks = (up & level) << 1
        grows = grows << 1 | 1
        up = (shrinks | ~(same | grows)) & full
        down = grows & same & full
    return len(b) + up.bit_count() - down.bit_count()


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distances within a band of so many diagonals to either side.

    Exact where the result is not beyond ``band``; else above ``band``. The
    lengths of a pair differ by at most ``band``. All pairs advance row by row
    together.
    """
    n = max(len(a) for a, _ in pairs)
    m = max(len(b) for _, b in pairs)
    width = 2 * band + 1
    code_a = np.zeros((len(pairs), n), pairs[0][0].dtype)
    code_b = np.zeros((len(pairs), m + n + 2 * width), pairs[0][0].dtype)
    len_a = np.array([len(a) for a, _ in pairs])
    len_b = np.array([len(b) for _, b in pairs])
    for i, (a, b) in enumerate(pairs):
        code_a[i, : len(a)] = a
        code_b[i, band : band + len(b)] = b
    far = np.int32(1 << 28)
    column = np.arange(width, dtype=np.int32)
    # Cell k of row i is column i + k - band of the whole table.
    row = np.where(column >= band, column - band, far).astype(np.int32)
    row = np.where(column - band <= len_b[:, None], row, far)
    found = np.where(len_a == 0, row[np.arange(len(pairs)), np.minimum(len_b + band, width - 1)], far)
    for i in range(1, n + 1):
        place = column + (i - band)
        cost = (code_b[:, i - 1 : i - 1 + width] != code_a[:, i - 1 : i]).astype(np.int32)
        new = row + cost
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new = np.where((place >= 0) & (place <= len_b[:, None]), new, far)
        if i <= band:
            new[:, band - i] = i
        # Insertions run along the row: a running minimum of cost less place.
        row = np.minimum.accumulate(new - column, axis=1) + column
        ended = np.flatnonzero(len_a == i)
        if len(ended):
            at = len_b[ended] - i + band
            found[ended] = row[ended, np.clip(at, 0, width - 1)]
    return found


def distances(
    pairs: list[tuple[np.ndarray, np.ndarray]], most: list[int]
) -> list[int | None]:
    """Edit distance of every pair, or None where it is beyond its ``most``.

    Sequences of more than BITS words are aligned in a band that starts narrow
    and grows for the pairs that it is too narrow for, so close pairs of very
    long sequences stay cheap.
    """
    result: list[int | None] = [None] * len(pairs)
    open_, band = [], 8
    for i, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > most[i]:
            continue
        a, b = _trim(a, b)
        if not len(a) or not len(b):
            result[i] = max(len(a), len(b))
            continue
        # Every edit changes at most one word of either bag.
        values, counts = np.unique(a, return_counts=True)
        other, others = np.unique(b, return_counts=True)
        _, at, to = np.intersect1d(values, other, assume_unique=True, return_indices=True)
        common = int(np.minimum(counts[at], others[to]).sum())
        if max(len(a), len(b)) - common > most[i]:
            continue
        if max(len(a), len(b)) > BITS:
            open_.append((i, a, b))
            continue
        # The fewer rows, the better.
        found = _by_bits(a.tolist(), b.tolist()) if len(a) > len(b) else _by_bits(b.tolist(), a.tolist())
        if found <= most[i]:
            result[i] = found
    while open_:
        ready = [x for x in open_ if abs(len(x[1]) - len(x[2])) <= band]
        later = [x for x in open_ if abs(len(x[1]) - len(x[2])) > band]
        ready.sort(key=lambda x: len(x[1]))
        begin = 0
        while begin < len(ready):
            end = begin + 1
            while end < len(ready) and (
                (end - begin) * (len(ready[end][1]) + 4 * band + 2) < CELLS
                and len(ready[end][1]) <= 2 * len(ready[begin][1]) + 16
            ):
                end += 1
            block = ready[begin:end]
            for (i, a, b), found in zip(block, _banded([x[1:] for x in block], band).tolist()):
                if found <= min(band, most[i]):
                    result[i] = found
                elif band < most[i]:
                    later.append((i, a, b))
            begin = end
        open_, band = later, 4 * band
    return result
