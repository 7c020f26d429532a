"""Words of whole texts as 64-bit hashes, found with array operations."""

from __future__ import annotations

import unicodedata
from functools import lru_cache
from typing import NamedTuple

import numpy as np

LAST = 0x323B0  # no letter or digit is assigned above
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
# Texts are scanned together up to this many characters; longer ones alone.
TOGETHER = 1 << 20


class Words(NamedTuple):
    """Words of several texts in order; ``first[i]:first[i + 1]`` are those of text i."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


@lru_cache(None)
def _tables(letters_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """For every code point: is it part of a word, and its lower case."""
    part, lower = np.zeros(LAST + 1, bool), np.arange(LAST + 1, dtype=np.uint32)
    for code in range(LAST):
        char = chr(code)
        kind = unicodedata.category(char)[0]
        part[code] = kind in "LM" or (kind == "N" and not letters_only)
        small = char.lower()
        if small != char and len(small) == 1:
            lower[code] = ord(small)
    return part, lower


@lru_cache(2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE), np.full(size, INVERSE)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def _scan(texts: list[str], letters_only: bool) -> Words:
    part, lower = _tables(letters_only)
    blob = ("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass")
    code = np.minimum(np.frombuffer(blob, np.uint32), LAST)
    inside = part[code]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edges[::2], edges[1::2]
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(text) + 1 for text in texts], out=starts[1:])
    first = np.searchsorted(begin, starts)
    if not len(begin):
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, first)
    up, down = _powers(1 << (len(code) - 1).bit_length())
    value = np.where(inside, lower[code], np.uint32(0)).astype(np.uint64)
    value *= up[: len(code)]
    hashes = mixed(np.add.reduceat(value, begin) * down[begin])
    shift = np.repeat(starts[:-1], np.diff(first))
    return Words(hashes, begin - shift, end - shift, first)


def scan_words(texts: list[str | None], letters_only: bool = False) -> Words:
    """All words of all texts: runs of letters, marks and digits, in lower case.

    ``letters_only`` ends words at digits. A null text has no words. Offsets
    count code points from the start of the text.
    """
    texts = [text or "" for text in texts]
    parts, group, size = [], [], 0
    for text in texts:
        if group and size + len(text) > TOGETHER:
            parts.append(_scan(group, letters_only))
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    parts.append(_scan(group, letters_only))
    if len(parts) == 1:
        return parts[0]
    shift, first = 0, [np.zeros(1, np.int64)]
    for found in parts:
        first.append(found.first[1:] + shift)
        shift += len(found.hashes)
    return Words(
        np.concatenate([p.hashes for p in parts]),
        np.concatenate([p.begin for p in parts]),
        np.concatenate([p.end for p in parts]),
        np.concatenate(first),
    )


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` neighbouring words of one text."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    value, span = hashes, 1
    # By doubling: what a step for each word gives, modulo 2**64.
    for bit in bin(size)[3:]:
        value = value[:-span] * np.uint64(pow(int(BASE), span, 2**64)) + value[span:]
        span *= 2
        if bit == "1":
            value = value[:-1] * BASE + hashes[span:]
            span += 1
    return mixed(value)
