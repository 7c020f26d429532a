import random
import re

import numpy as np
import public_tokenizers
import regex

from lakeclerk.llm import align, bpe
from lakeclerk.llm.align import distances
from lakeclerk.llm.pieces import split
from lakeclerk.llm.words import scan_words, shingles

ALPHABET = "ab's  \n\t  éßÀ字12½²_!’'tllveré😀K\x85"


def texts(count, seed=3):
    draw = random.Random(seed)
    return ["".join(draw.choice(ALPHABET) for _ in range(draw.randint(0, 60))) for _ in range(count)]


def test_words_match_a_regular_expression():
    some = [*texts(300), "", "x" * 5000, "İstanbul ΑΣ naïve éa"]
    found = scan_words([*some, None])
    seen = {}
    for i, text in enumerate(some):
        spans = [m.span() for m in regex.finditer(r"[\p{L}\p{M}\p{N}]+", text)]
        part = slice(found.first[i], found.first[i + 1])
        assert list(zip(found.begin[part].tolist(), found.end[part].tolist())) == spans
        for (a, b), value in zip(spans, found.hashes[part].tolist()):
            word = "".join(c.lower() if len(c.lower()) == 1 else c for c in text[a:b])
            assert seen.setdefault(word, value) == value
    assert len(set(seen.values())) == len(seen)
    assert found.first[-1] == found.first[-2]


def test_texts_beyond_a_block_are_whole():
    long = "word " * 400_000
    found = scan_words(["a", long, "b"])
    assert np.diff(found.first).tolist() == [1, 400_000, 1]
    assert len(set(found.hashes[1:-1].tolist())) == 1


def test_shingles_depend_on_order():
    found = scan_words(["a b c d e f"]).hashes
    assert len(set(shingles(found, 5).tolist())) == 2 and len(shingles(found[:4], 5)) == 0


def test_split_is_the_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    for text in [*texts(3000), "", "don't 'sure 'tis  'll", "\n's", " 's", "''s", "a  \n b"]:
        assert split(text) == pattern.findall(text), text


def brute_force(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_is_the_edit_distance():
    draw = random.Random(5)
    pairs, most = [], []
    for _ in range(150):
        a = [draw.randint(1, 6) for _ in range(draw.randint(0, 70))]
        b = list(a)
        for _ in range(draw.randint(0, 20)):
            at = draw.randint(0, len(b))
            b[at : at + draw.randint(0, 1)] = [draw.randint(1, 6)] * draw.randint(0, 1)
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        most.append(draw.choice([0, 3, 10, 30, 80]))
    for (a, b), limit, found in zip(pairs, most, distances(pairs, most)):
        wanted = brute_force(a.tolist(), b.tolist())
        assert found == (wanted if wanted <= limit else None)


def test_a_wide_alignment_takes_one_row_of_bits_a_word(monkeypatch):
    # A band is not begun for sequences of usual length, whatever their distance.
    monkeypatch.setattr(align, "_banded", None)
    draw = np.random.default_rng(9)
    a = draw.integers(0, 900, 3000).astype("<u4")
    b = a[draw.random(3000) > 0.05]
    b[::10] = 1000
    most = int(0.2 * len(a))
    found = distances([(a, b)], [most])[0]
    assert found == brute_force(a.tolist(), b.tolist()) <= most
    monkeypatch.undo()
    monkeypatch.setattr(align, "BITS", 100)
    assert distances([(a, b), (b, a)], [most] * 2) == [found] * 2


def test_tree_bpe_is_the_library_encoding():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.TreeBpe(bpe.read_ranks(path))
    library = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={}
    )
    draw = random.Random(1)
    some = [*texts(1500, 8), "", "a" * 3000, "!" * 900, " " * 500, "ab" * 700]
    some += ["".join(draw.choice("abcdeth") for _ in range(400)) for _ in range(20)]
    for text, ids in zip(some, own.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text
        assert own.decode(ids) == text.encode()


def test_joins_grow_until_tokens_outside_stay():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    own = bpe.TreeBpe(bpe.read_ranks(path))
    draw = random.Random(2)
    for _ in range(200):
        a, b = (bytes(draw.choice(b"aeinrst") for _ in range(draw.randint(0, 40))) for _ in "ab")
        whole, left, right = own.merge([a + b or b"x", a or b"x", b or b"x"])
        if a and b:
            assert own.join([(left, right)])[0] == whole


def test_word_pattern_of_python_agrees_on_plain_text():
    text = "The quick brown fox, it's 42 times."
    found = scan_words([text])
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text)]
    assert list(zip(found.begin.tolist(), found.end.tolist())) == spans
