"""Periodic runs against the definition, on words and on small tables."""

import hashlib
import random
import zlib

import pytest

from tests.llm.test_operators import docs_of
from tripfold.llm import queries, runs


def by_definition(words, least, times):
    n, found = len(words), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            run = words[start : start + length]
            smaller = any(all(run[x] == run[x + d] for x in range(length - d)) for d in range(1, q))
            if length >= max(least, times * q) and not smaller:
                found.add((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def periodic_words(rng, most=90):
    n, letters, words = rng.randint(0, most), rng.choice([1, 2, 2, 3, 5]), []
    while len(words) < n:
        if words and rng.random() < 0.3:
            p = rng.randint(1, min(len(words), 12))
            words += [words[-p + i % p] if p <= len(words) else b"x" for i in range(rng.randint(1, 6 * p))][:n]
        else:
            words.append(bytes([97 + rng.randrange(letters)]))
    return words[:n]


@pytest.mark.parametrize("least,times", [(24, 3), (3, 3), (10, 4)])
def test_runs_are_those_of_the_definition(least, times):
    rng = random.Random(least)
    for _ in range(800):
        words = periodic_words(rng)
        want = by_definition(words, least, times)
        assert [tuple(r) for r in runs.word_runs(words, least, times).tolist()] == want
        # Without the search for stretches: trees of the whole text.
        codes = [w[0] - 96 for w in words]
        assert [tuple(r) for r in runs.runs_of(codes, least, times).tolist()] == want


def test_common_prefixes():
    rng = random.Random(3)
    for _ in range(100):
        text = [rng.randint(1, 3) for _ in range(rng.randint(2, 40))]
        tree = runs.SuffixTree(text)
        ends = [text[i:] + [0] for i in range(len(text) + 1)]
        assert tree.order.tolist() == sorted(range(len(text) + 1), key=lambda i: ends[i])
        import numpy as np

        a, b = (np.array(x) for x in zip(*[(i, j) for i in range(len(ends)) for j in range(len(ends)) if i != j], strict=True))
        for i, j, n in zip(a, b, tree.common(a, b), strict=True):
            same = 0
            while same < min(len(ends[i]), len(ends[j])) and ends[i][same] == ends[j][same]:
                same += 1
            assert n == same


def expected(doc_id, text):
    """The row of op11 by its definition."""
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = by_definition(words, 24, 3)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_rows(spark, tmp_path):
    rng = random.Random(8)
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\v", "en", "a"), (4, "word", "en", "a"),
        (5, "a b " * 12, "en", "a"), (6, "a b " * 11 + "a", "en", "a"), (7, "a " * 24 + "b " * 24, "en", "b"),
        (8, "x y z " * 30, "fr", "b"), (9, "a b c d e f g h i " * 30, None, "b"), (9, "a b c d e f g h i " * 30, None, "b"),
        (None, "q " * 30, "en", None),
    ]
    rows += [(i, b" ".join(periodic_words(rng)).decode(), "en", "a") for i in range(100, 260)]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op11_runs(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    assert got == sorted((expected(i, t) for i, t, _, _ in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 20 and any(r[1] > 1 for r in got)
    docs_of(spark, rows).limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op11_runs(spark, f"{tmp_path}/none").count() == 0


def test_a_long_text():
    rng = random.Random(5)
    words = [str(rng.randrange(5000)).encode() for _ in range(30_000)]
    words += words[-4_000:] * 3 + [b"end"]
    found = runs.word_runs(words)
    assert [tuple(r) for r in found.tolist()] == [(26_000, 16_000, 4_000)]
    assert len(runs.kept_words(words, found)) == 30_001
