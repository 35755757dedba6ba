"""SimHash fingerprints of word shingles, linked through Gray-ordered hierarchical indexes.

Two fingerprints that differ in at most `distance` bits agree on at least one of `distance + 1`
blocks of their bits, so the distinct fingerprints are dealt out once per block. Whatever shares a
block's bits lies in one task, sorted by Gray rank: neighbours in that order differ in few bits, so
the bits that all fingerprints of a run share (a mask and a pattern) make a good upper node. Two
runs are compared by the bits both share; the differences gathered on the way down only grow, and a
pair of runs is dropped as soon as they exceed the distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import checkpoint, utf8_words
from tripfold.llm.components import connected_components

SEED = 42
#: Shingles whose bits are unpacked at once.
BLOCK = 1 << 16
#: Children of a node of the index.
FANOUT = 8
#: Pairs of nodes taken apart at once.
FRONT = 1 << 14


def shingle_hashes(words: list[bytes], length: int) -> np.ndarray:
    """XXH64 of every run of `length` words, repeats included; fewer words make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= length:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    spans = map(slice, starts[: len(words) - length + 1].tolist(), ends[length - 1 :].tolist())
    hashes = map(xxhash.xxh64_intdigest, map(joined.__getitem__, spans), repeat(SEED))
    return np.fromiter(hashes, np.uint64, len(words) - length + 1)


def fingerprint(text: str | None, length: int) -> int:
    """64 bits, each the majority of that bit over the hashes of the shingles; 0 without words."""
    hashes = shingle_hashes(utf8_words(text), length)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at : at + BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes)).view(">u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """`doc_id, body, fp`: a row per row; body is a hash of the text, fp a signed long.

    A NULL or empty text has fingerprint 0. Keys are carried along as they are, NULL included.
    """

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            prints = [fingerprint(x.as_py(), shingle) for x in part.column(2)]
            signed = np.array(prints, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(signed)], names=["doc_id", "body", "fp"]
            )

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.xxhash64(text).alias("body"), F.col(text).alias("text")
    )
    return rows.mapInArrow(batch, "doc_id long, body long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Upper nodes over fingerprints sorted by group and Gray rank; every group has one root.

    levels[0] are the fingerprints; a node of a higher level stands for a run of nodes below:
    `first` (its first child), `shared` (bits alike in all below) and `pattern` (those bits).
    """

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        everything = np.full(len(codes), ~np.uint64(0))
        self.levels = [(np.empty(0, np.int64), everything, codes)]
        while True:
            _, shared, pattern = self.levels[-1]
            new_group = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            if len(new_group) == len(group):
                break
            place = np.arange(len(group)) - np.repeat(
                new_group, np.diff(np.r_[new_group, len(group)])
            )
            first = np.flatnonzero(place % FANOUT == 0)
            low = np.bitwise_and.reduceat(pattern, first)
            high = np.bitwise_or.reduceat(pattern, first)
            alike = np.bitwise_and.reduceat(shared, first) & ~(low ^ high)
            self.levels.append((np.r_[first, len(group)], alike, low & alike))
            group = group[first]

    def links(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of fingerprints of one group, in pairs, that differ in at most `distance` bits."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][1]))
        stack = [(top, roots, roots)]
        while stack:
            level, a, b = stack.pop()
            if level == 0:
                if len(a):
                    yield a, b
                continue
            if len(a) > FRONT:
                half = len(a) // 2
                stack += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            first = self.levels[level][0]
            _, shared, pattern = self.levels[level - 1]
            wide = first[b + 1] - first[b]
            count = (first[a + 1] - first[a]) * wide
            pair = np.repeat(np.arange(len(a)), count)
            nth = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            left = first[a][pair] + nth // wide[pair]
            right = first[b][pair] + nth % wide[pair]
            differ = np.bitwise_count(
                (pattern[left] ^ pattern[right]) & shared[left] & shared[right]
            )
            keep = (left <= right if level > 1 else left < right) & (differ <= distance)
            stack.append((level - 1, left[keep], right[keep]))


def spanning_links(group: np.ndarray, codes: np.ndarray, distance: int) -> np.ndarray:
    """Rows (code, first code of what it is linked with in its group), each code but the first."""
    order = np.lexsort((gray_rank(codes), group))
    group, codes = group[order], codes[order]
    label = np.arange(len(codes))
    for a, b in GrayIndex(group, codes).links(distance) if len(codes) else ():
        while len(a):
            low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
            apart = low != high
            a, b = a[apart], b[apart]
            np.minimum.at(label, high[apart], low[apart])
            while not np.array_equal(label, further := label[label]):
                label = further
    inner = label != np.arange(len(codes))
    return np.stack([codes[inner], codes[label[inner]]], axis=1)


def bit_blocks(mask: int, parts: int) -> list[int]:
    """The bits that a mask leaves free, dealt into `parts` masks of nearly even size."""
    free = [k for k in range(63, -1, -1) if not mask >> k & 1]
    cuts = [round(i * len(free) / parts) for i in range(parts + 1)]
    return [sum(1 << k for k in free[i:j]) for i, j in zip(cuts, cuts[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Each row once per mask that refines the row's own: `mask, shared, fp`."""
    finer: Column | None = None
    for mask, subs in masks.items():
        options = F.array(*(F.lit(_signed(s)).cast("long") for s in subs))
        case = F.col("mask") == F.lit(_signed(mask))
        finer = F.when(case, options) if finer is None else finer.when(case, options)
    out = rows.select("fp", F.explode(finer).alias("mask"))
    return out.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("shared"), "fp")


def close_links(
    prints: DataFrame,
    distance: int = 3,
    hot_rows: int = 2_000,
    task_rows: int = 200_000,
    depth: int = 3,
) -> DataFrame:
    """`a, b`: links between distinct fingerprints (`fp`), enough to connect all that are close.

    Groups that share a block's bits are dealt out again by blocks of their other bits while they
    hold more than `hot_rows`, or a thousandth of all rows; such groups number a thousand per
    block at most, however large the input. A pair differs on the other bits only, so the argument
    above holds at every step. After `depth` steps a group agrees on more than half of its bits and
    is left to one task's index, as it may be one cluster that no bits part.
    """
    spark = prints.sparkSession
    whole = prints.select("fp", F.lit(0).cast("long").alias("mask"))
    masks = {0: bit_blocks(0, distance + 1)}
    rows = _dealt(whole, masks)
    ready: DataFrame | None = None
    limit = 0
    while True:
        counts = checkpoint(rows.groupBy("mask", "shared").count())
        total = counts.agg(F.sum("count")).first()[0] or 0
        limit = limit or max(hot_rows, total // 1000)
        hot = [tuple(r) for r in counts.where(F.col("count") > limit).select("mask", "shared").collect()]
        if not hot or not depth:
            break
        depth -= 1
        keys = F.broadcast(spark.createDataFrame(hot, "mask long, shared long"))
        cool = rows.join(keys, ["mask", "shared"], "left_anti")
        ready = cool if ready is None else ready.unionByName(cool)
        masks = {
            m: [m | x for x in bit_blocks(m, distance + 1)]
            for m in {a & ((1 << 64) - 1) for a, _ in hot}
        }
        rows = checkpoint(_dealt(rows.join(keys, ["mask", "shared"], "left_semi"), masks))
    ready = rows if ready is None else ready.unionByName(rows)

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [x for x in parts if x.num_rows]
        if not held:
            return
        mask, shared, fp = (
            np.concatenate([x.column(i).to_numpy().view(np.uint64) for x in held]) for i in range(3)
        )
        _, group = np.unique(np.stack([mask, shared], axis=1), axis=0, return_inverse=True)
        group = group.reshape(-1)
        alone = np.bincount(group)[group] > 1
        found = spanning_links(group[alone], fp[alone], distance).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"]
        )

    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ready.repartition(max(width, total // task_rows), "mask", "shared")
    return placed.mapInArrow(batch, "a long, b long")


def components(docs: DataFrame, key: str, text: str, shingle: int, distance: int) -> DataFrame:
    """`doc_id, body, fp, component, component_id`, a row per document.

    `component` is one fingerprint of the component, so that it tells components apart even where
    rows that repeat a doc_id give two of them the same smallest doc_id.
    """
    prints = checkpoint(fingerprints(docs, key, text, shingle))
    lowest = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    linked = connected_components(close_links(lowest.select("fp"), distance))
    members = checkpoint(
        linked.join(lowest, linked["node"] == lowest["fp"]).select("fp", "label", "low")
    )
    roots = checkpoint(members.groupBy("label").agg(F.min("low").alias("root")))
    reached = checkpoint(members.join(roots, "label").select("fp", "label", "root"))
    ids = checkpoint(
        lowest.join(reached, "fp", "left").select(
            "fp",
            F.coalesce("label", "fp").alias("component"),
            F.coalesce("root", "low").alias("component_id"),
        )
    )
    return prints.join(ids, "fp").select("doc_id", "body", "fp", "component", "component_id")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3
) -> DataFrame:
    """`doc_id, fingerprint, component_id`, a row per document, other columns not read.

    component_id is the smallest doc_id in reach over links of at most `distance` bits, itself
    included. Texts without words (NULL and empty too) share fingerprint zero. Rows that repeat a
    doc_id give a row each. A NULL doc_id is kept, and is nobody's component_id; a component
    without any other has component_id NULL. An empty table gives no rows.
    """
    return components(docs, key, text, shingle, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = 3, distance: int = 3) -> DataFrame:
    """One document of each component: that of the smallest doc_id, NULL last.

    Of rows with this doc_id but different texts, that of the smaller text hash stays; of rows
    that agree in both, one.
    """
    found = components(docs, "doc_id", "text", shingle, distance)
    counted = found.groupBy("component", "doc_id", "body").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "body", "copies")
    stay = checkpoint(
        counted.groupBy("component")
        .agg(F.min(order).alias("stay"))
        .select(
            F.col("stay.doc_id").alias("stay_id"),
            F.col("stay.body").alias("stay_body"),
            F.col("stay.copies").alias("copies"),
        )
    )
    # Whole rows in one column, so that no other name of theirs meets the names made here.
    rows = docs.select("doc_id", F.xxhash64("text").alias("body"), F.struct("*").alias("doc"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("stay_id")) & (F.col("body") == F.col("stay_body"))
    single = rows.join(stay.where("copies = 1"), same).select("doc.*")
    repeated = stay.where("copies > 1")
    if repeated.isEmpty():
        return single
    firsts = rows.join(repeated, same).dropDuplicates(["stay_id", "stay_body"])
    return single.unionByName(firsts.select("doc.*"))
