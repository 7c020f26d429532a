"""Cut texts into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import regex

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
CODES = 0x110000


@lru_cache(None)
def _classes() -> np.ndarray:
    """The class of every code point, as the split pattern sees it."""
    kinds = np.full(CODES, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        # Surrogates are no text: they stay OTHER.
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, CODES)]))
        for match in regex.finditer(pattern, every):
            begin, end = match.span()
            shift = 0x800
            low, high = min(begin, 0xD800), min(end, 0xD800)
            kinds[low:high] = kind
            low, high = max(begin, 0xD800), max(end, 0xD800)
            kinds[low + shift : high + shift] = kind
    return kinds


def _starts(text: str) -> np.ndarray:
    """Where pieces of a text begin."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[code]
    change = np.empty(len(code), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    starts = change.copy()
    # White space before a word: its last character is a piece of its own, and
    # a blank joins the word.
    last = np.flatnonzero(change[1:] & (kind[:-1] == SPACE))
    starts[last] = True
    blank = last[code[last] == 32]
    starts[blank + 1] = False
    # A contraction is split off where the run of other characters is one
    # apostrophe that begins a piece.
    mark = np.flatnonzero((code == 39) & starts)
    mark = mark[mark + 1 < len(code)]
    for at in mark[kind[mark + 1] == LETTER].tolist():
        if text[at + 1] in "stmd":
            size = 2
        elif text[at + 1 : at + 3] in ("re", "ve", "ll"):
            size = 3
        else:
            continue
        starts[at + 1] = False
        if at + size < len(code):
            starts[at + size] = True
    return np.flatnonzero(starts)


def split(text: str) -> list[str]:
    """Pieces in order; joined they are the text."""
    if not text:
        return []
    bounds = _starts(text).tolist()
    return [text[a:b] for a, b in zip(bounds, [*bounds[1:], len(text)])]
