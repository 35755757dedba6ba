"""Periodic runs of words: suffix trees of a text and of its reversal, Lyndon roots extended both ways.

A run of period q holds a Lyndon word of q words, and from the place where that starts it is the
longest Lyndon word, in one of two opposite orders of words. So the longest Lyndon words of all places
in both orders, two a place, are all candidates there can be. Each is extended to the left and to the
right by longest common extensions, which are lowest common ancestors in the suffix trees: the least
depth between two leaves on an Euler tour.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripfold.llm.common import table

#: The least length of a run in words, and how often its period fits in at least.
LEAST, TIMES = 24, 3

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class SuffixTree:
    """Ukkonen's tree of a list of codes above 0, with its Euler tour.

    order[r] is the suffix of rank r; the empty suffix, number len(codes), is the least.
    """

    def __init__(self, codes: Sequence[int]) -> None:
        text = [*codes, 0]
        n, width = len(text), max(text) + 1
        begin, end, link, suffix = array("q", [0]), array("q", [0]), array("q", [0]), array("q", [-1])
        child: dict[int, int] = {}
        node = edge = length = waiting = leaves = 0
        for i, code in enumerate(text):
            waiting += 1
            fresh = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(i), end.append(n), link.append(0), suffix.append(leaves)
                    leaves += 1
                    if fresh:
                        link[fresh] = node
                        fresh = 0
                else:
                    first = begin[below]
                    held = min(end[below], i + 1) - first
                    if length >= held:
                        edge, length, node = edge + held, length - held, below
                        continue
                    if text[first + length] == code:
                        if fresh:
                            link[fresh] = node
                        length += 1
                        break
                    # The edge is parted: a new node with the old one and a new leaf below.
                    middle = len(begin)
                    begin.append(first), end.append(first + length), link.append(0), suffix.append(-1)
                    child[key] = middle
                    begin[below] = first + length
                    child[middle * width + text[first + length]] = below
                    child[middle * width + code] = middle + 1
                    begin.append(i), end.append(n), link.append(0), suffix.append(leaves)
                    leaves += 1
                    if fresh:
                        link[fresh] = middle
                    fresh = middle
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._tour(n, width, child, np.array(end) - np.array(begin), np.array(suffix))

    def _tour(self, n: int, width: int, child: dict[int, int], size: np.ndarray, suffix: np.ndarray) -> None:
        keys = np.fromiter(child.keys(), np.int64, len(child))
        ids = np.fromiter(child.values(), np.int64, len(child))
        by_code = np.argsort(keys)
        parent = np.zeros(len(size), np.int64)
        parent[ids] = keys // width
        kids = ids[by_code].tolist()
        at = np.searchsorted(keys[by_code] // width, np.arange(len(size) + 1)).tolist()
        stop, tour, way = at[1:], [], [0]
        while way:
            node = way[-1]
            tour.append(node)
            k = at[node]
            if k < stop[node]:
                at[node] = k + 1
                way.append(kids[k])
            else:
                way.pop()
        tour = np.array(tour)
        came, gone = tour[1:], tour[:-1]
        steps = np.where(parent[came] == gone, size[came], -size[gone])
        # The root is its own parent, so a step up to it must not count as one down.
        steps[came == 0] = -size[gone[came == 0]]
        self.depth = np.concatenate([[0], np.cumsum(steps)])
        leaf = np.flatnonzero(suffix[tour] >= 0)
        self.order = suffix[tour[leaf]]
        self.first = np.empty(n, np.int64)
        self.first[self.order] = leaf

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lengths of the longest common prefixes of suffixes a and b (a != b)."""
        a, b = self.first[a], self.first[b]
        return least_between(self.depth, np.minimum(a, b), np.maximum(a, b))


def least_between(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least of values[low..high] for each pair, in two looks at a table of doubled widths.

    All questions are known, so that one width of the table is held at a time.
    """
    width = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), values.dtype)
    for j in range(int(width.max(initial=0)) + 1):
        span = 1 << j
        if j:
            values = np.minimum(values[: -(span >> 1)], values[span >> 1 :])
        asked = np.flatnonzero(width == j)
        out[asked] = np.minimum(values[low[asked]], values[high[asked] - span + 1])
    return out


def _next_less(ranks: list[int]) -> list[int]:
    """For each place the next one of lower rank, or the end."""
    after, open_ = [len(ranks)] * len(ranks), []
    for i, rank in enumerate(ranks):
        while open_ and ranks[open_[-1]] > rank:
            after[open_.pop()] = i
        open_.append(i)
    return after


def runs_of(codes: Sequence[int], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs of a list of codes above 0, as rows of start, length, period, by start and period.

    The longest Lyndon word of a place ends before the next suffix that is less. In the opposite
    order a suffix counts as less than its own prefixes; that only matters for words up to the end of
    the text, which are no candidates there: runs up to the end are found in the first order.
    """
    n = len(codes)
    if n < least:
        return np.empty((0, 3), np.int64)
    forward = SuffixTree(codes)
    rank = np.empty(n + 1, np.int64)
    rank[forward.order] = np.arange(n + 1)
    ranks = rank[:n]
    upward, downward = (np.array(_next_less(r.tolist())) for r in (ranks, -ranks))
    inside = np.flatnonzero(downward < n)
    start = np.concatenate([np.arange(n), inside])
    root_end = np.concatenate([upward, downward[inside]])
    right = forward.common(start, root_end)
    del forward
    left = SuffixTree(codes[::-1]).common(n - start, n - root_end)
    period = root_end - start
    length = left + period + right
    found = np.stack([start - left, length, period], axis=1)[length >= np.maximum(least, times * period)]
    return found[np.unique(found[:, [0, 2]], axis=0, return_index=True)[1]]


def _stretches(codes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """Where runs may be: [start, end) of the stretches whose word sequences all come twice.

    In a run of `length` and period q every sequence of at most length - 2 q + 1 words comes again
    q words before or after. The least such number over all runs sought is `width`, so a sequence of
    `width` words that the text has once is in no run, and a run is wholly inside a stretch between
    such sequences. Sequences are compared by hash: one that is taken for another only makes a
    stretch longer.
    """
    width = min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))
    n = len(codes) - width + 1
    if len(codes) < least:
        return []
    hashes = np.zeros(n, np.uint64)
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        hashes = hashes * np.uint64(0xD6E8FEB86659FD93) + mixed[k : k + n]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(n + 2, np.int8)
    twice[order[1:][same] + 1] = 1
    twice[order[:-1][same] + 1] = 1
    change = np.flatnonzero(np.diff(twice))
    pairs = zip(change[::2].tolist(), change[1::2].tolist(), strict=True)
    return [(a, b + width - 1) for a, b in pairs if b + width - 1 - a >= least]


def word_runs(words: Sequence[bytes], least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """All runs of a text's words, as `runs_of`."""
    if len(words) < least:
        return np.empty((0, 3), np.int64)
    names: dict[bytes, int] = {}
    codes = np.array([names.setdefault(w, len(names)) for w in words])
    found = []
    for begin, end in _stretches(codes, least, times):
        part = np.unique(codes[begin:end], return_inverse=True)[1] + 1
        runs = runs_of(part.tolist(), least, times)
        runs[:, 0] += begin
        found.append(runs)
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def kept_words(words: Sequence[bytes], runs: np.ndarray) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not len(runs):
        return list(words)
    held = np.zeros(len(words) + 1, np.int64)
    np.add.at(held, runs[:, 0] + runs[:, 2], 1)
    np.add.at(held, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(held[:-1]) == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(batches: Iterator[pa.RecordBatch], least: int, times: int, rewrite: Rewrite | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, runs, texts = [], [], []
        for key, text in zip(batch["key"].to_pylist(), batch["text"], strict=True):
            words = (text.as_py() or b"").split()
            if rewrite is not None:
                words = rewrite(key, words)
            found = word_runs(words, least, times)
            keys.append(key)
            runs.append([{"start": s, "length": n, "period": p} for s, n, p in found.tolist()])
            texts.append(b" ".join(kept_words(words, found)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, batch["key"].type), pa.array(runs, pa.list_(_RUN)), pa.array(texts, pa.binary())],
            names=["key", "runs", "collapsed"],
        )


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least: int = LEAST,
    times: int = TIMES,
    rewrite: Rewrite | None = None,
) -> DataFrame:
    """One row per row of docs: key, `runs` (start, length, period in words, by start and period) and
    `collapsed`, the words that no run holds after its first period, joined by one space.

    A run is a stretch of at least `least` words and `times` periods that no neighbouring word extends;
    periods are the smallest. A text is read as its words between blanks and x09 to x0D, whatever its
    length; NULL has no words. Rows with equal or NULL keys stay rows of their own. `rewrite` may
    change the words before (it gets the key). A document is one task's: its trees take some 400 bytes
    a word of those stretches that may hold runs.
    """
    if times < 3:
        raise ValueError("a run must hold its period three times at least")
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    work = partial(_find, least=least, times=times, rewrite=rewrite)
    made = f"key {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary"
    found = rows.mapInArrow(work, made)
    return found.select(F.col("key").alias(key), "runs", F.col("collapsed").cast("string").alias("collapsed"))


def repeat_tail(key: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, by crc32 of their id, with all words from a place on made periodic."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def document_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, their tails rewritten by `repeat_tail`: counts, the strongest, digests."""
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeat_tail)
    stronger = """array_sort(runs, (a, b) -> CASE
        WHEN a.length * b.period <> b.length * a.period THEN IF(a.length * b.period > b.length * a.period, -1, 1)
        WHEN a.start <> b.start THEN IF(a.start < b.start, -1, 1)
        ELSE int(a.period - b.period) END)"""
    lines = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    best = F.get(F.expr(stronger), 0)
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.expr(lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
