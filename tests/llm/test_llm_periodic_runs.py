"""Runs of repeated words against brute force."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from lakeclerk.llm import periodic_runs
from lakeclerk.llm.queries import op12_periodic_runs

SMALL = "/root/testdata/sf0.001"


def brute_runs(words):
    """(start, length, period) of all runs, by every period from the least on."""
    n, found, seen = len(words), [], set()
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and (i, length) not in seen:
                seen.add((i, length))
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_row(words):
    runs = brute_runs(words)
    drop = {i for s, l, q in runs for i in range(s + q, s + l)}
    kept = [w for i, w in enumerate(words) if i not in drop]
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (len(runs), *longest, "".join(f"{s},{l},{q}\n" for s, l, q in runs), b" ".join(kept))


def found(words_of_texts):
    return periodic_runs._described([[w.encode() for w in t] for t in words_of_texts])


def expected(words_of_texts):
    rows = []
    for t in words_of_texts:
        *rest, kept = brute_row([w.encode() for w in t])
        rows.append((*rest, kept))
    return rows


def periodic(draw, alphabet, roots):
    """Words with runs beside and inside each other."""
    text = []
    for _ in range(draw.randint(1, 4)):
        root = [draw.choice(alphabet) for _ in range(draw.randint(1, roots))]
        if draw.random() < 0.5:
            root = root * draw.randint(1, 5) + [draw.choice(alphabet)]
        text += root * draw.randint(1, 7) + root[: draw.randint(0, len(root))]
        text += [draw.choice(alphabet) for _ in range(draw.randint(0, 5))]
    return text


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(seed):
    draw = random.Random(seed)
    texts = [periodic(draw, "ab" if i % 3 else "abcdefgh", 2 + i % 9) for i in range(120)]
    texts += [[draw.choice("ab") for _ in range(draw.randint(0, 90))] for _ in range(60)]
    assert found(texts) == expected(texts)


def test_runs_of_runs():
    inner = list("aaaaaaab")
    nested = (inner * 4 + ["c"]) * 5 + list("aaaaaaaaa") + list("abababababab") * 2
    long = (list("ab" * 20) + ["x"]) * 4 + (list("ab" * 20) + ["y"]) * 9
    texts = [nested, long, ["w"] * 500, ["w"] * 5, ["w"] * 6, list("ab") * 3, list("ab") * 4]
    assert found(texts) == expected(texts)


def test_neighbouring_texts_do_not_join():
    texts = [["a"] * 4, ["a"] * 4, [], ["a"] * 7, ["a", "b"] * 3, ["a", "b"] * 3]
    assert found(texts) == expected(texts)


def test_long_texts_take_no_square_of_time():
    n = 200_000
    ramp = [f"w{i % 50_000}" for i in range(n)]
    texts = [["w"] * n, ramp, (["a"] * 400 + ["b"]) * 500]
    started = time.perf_counter()
    rows = found(texts)
    assert time.perf_counter() - started < 60
    assert rows[0][:5] == (1, 0, n, 1, 1000 * n)
    assert rows[1][:5] == (1, 0, n, 50_000, 4000)
    assert rows[2][:5] == (501, 0, 401 * 500, 401, 500_000)


def test_wavelet_tree_finds_successors():
    draw = np.random.default_rng(1)
    values = draw.permutation(300)
    tree = periodic_runs.WaveletTree(values)
    for _ in range(300):
        b, e = sorted(draw.integers(0, 301, 2))
        bound = int(draw.integers(0, 700))
        least = min((v for v in values[b:e].tolist() if v >= bound), default=-1)
        assert tree.successor(np.array([b]), np.array([e]), np.array([bound]))[0] == least


def contract(key, text):
    words = text.encode().split() if text else []
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    *rest, lines, kept = brute_row(words)
    digests = (hashlib.sha256(x).hexdigest() for x in (lines.encode(), kept))
    return (key, *rest, *digests)


COLUMNS = [
    "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256",
]


def digests(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key int, runs string, start int")
    out = periodic_runs.run_digests(docs.repartition(3))
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_odd_rows(spark):
    draw = random.Random(2)
    rows = [(k, " ".join(periodic(draw, "abc", 6)), 1, "r", 2) for k in range(60)]
    rows += [(None, "a a a a a a a", 1, "", 0), (5, None, 1, "", 0), (6, "", 1, "", 0)]
    rows += [(7, " \t\r\n\x0b\x0c ", 1, "", 0), (8, "é x é x é x é x ", 1, "", 0)]
    rows += [(9, "same same", 1, "", 0)] * 2 + [(-4, "a\x1cb " * 9, 1, "", 0)]
    rows += [(70, " ".join(["w"] * 30_000), 1, "", 0)]
    assert digests(spark, rows) == sorted((contract(k, t) for k, t, *_ in rows), key=str)
    assert digests(spark, []) == []


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 6_000}
    out = {tuple(r) for r in op12_periodic_runs(spark, SMALL).select(*COLUMNS).collect()}
    assert len(out) == len(docs)
    assert {r for r in out if r[0] in short} == {contract(k, t) for k, t in short.items()}
