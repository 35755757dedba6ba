"""A log-bilinear language model trained by noise-contrastive estimation.

The model knows classes: the commonest words are one each, and all other words share classes by
their ending. How many words are classes of their own grows with the square root of the training
tokens, up to the size a task can hold; the pair counts and the training steps grow with it. For
each of the places before a word there is a model of its own: the dot product of a context vector
and a target vector, plus the target's bias, normalised over all classes. Both and the plain
distribution of classes are mixed with fixed weights, so that the mixture is normalised as well. A
word's probability is its class's, times its own smoothed share of the class.

Every pair of classes that the training texts hold is counted and trained on, weighted by its count.
Pairs are dealt by their context, so that a context's vector is one shard's; targets are averaged
between rounds. Neither depends on how the rows lie. Words themselves are unbounded: the commonest
are broadcast, the others meet their counts in a join.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tripfold.llm.common import by_bytes, checkpoint, sigmoid, utf8_words

#: The end of a text among the words, which are never empty.
END = b""
#: Distinct words a task holds before it passes them on.
HELD = 300_000


@dataclass(frozen=True)
class Shape:
    """Sizes of the model.

    `frequent` words are classes at least; from `growth` times the root of the training tokens on it
    is that many, `most` at most, which bounds the broadcast model to some 35 MB and keeps a pair of
    classes within 32 bits. A shard is dealt the pairs of `shard_tokens` or 64 tokens per class; it
    makes a pass a round, in `steps` steps at least.
    """

    head: int = 100_000
    frequent: int = 1_024
    growth: float = 2.0
    most: int = 65_280
    endings: int = 256
    dim: int = 32
    #: Weights of the model of the word before, of the one before that, and of the plain distribution.
    mix: tuple[float, ...] = (0.55, 0.4, 0.05)
    shard_tokens: int = 4_000_000
    rounds: int = 2
    steps: int = 60
    batch: int = 1_024
    noise: int = 64

    @property
    def places(self) -> int:
        return len(self.mix) - 1

    def shards(self, tokens: int) -> int:
        """Shards of a place: its pairs are no more than the tokens, nor than the classes squared."""
        return max(1, -(-min(tokens, self.classes**2) // max(self.shard_tokens, 64 * self.classes)))

    def grown(self, tokens: int) -> Shape:
        return replace(self, frequent=max(self.frequent, min(self.most, int(self.growth * math.sqrt(tokens)))))

    @property
    def classes(self) -> int:
        return self.frequent + self.endings

    def ending(self, word: bytes) -> int:
        return self.frequent + zlib.crc32(word[-3:]) % self.endings


@dataclass
class Vocabulary:
    shape: Shape
    #: Training tokens, and distinct ones.
    tokens: int
    distinct: int
    #: Commonest words and their counts; the first `frequent` are classes, number 0 the end.
    words: list[bytes]
    counts: np.ndarray
    #: Of each ending class: tokens and distinct words that are not classes of their own.
    class_tokens: np.ndarray
    class_distinct: np.ndarray

    @property
    def base_total(self) -> float:
        return math.log10(self.tokens + 0.5 * (self.distinct + 1))

    def class_totals(self) -> np.ndarray:
        """log10 of what a word's smoothed count is divided by inside its class; 0 for class words."""
        out = np.zeros(self.shape.classes)
        out[self.shape.frequent :] = np.log10(self.class_tokens + 0.5 * (self.class_distinct + 1))
        return out


def count_words(texts: DataFrame) -> DataFrame:
    """`word, n` over all rows of `text`, ends of texts included; counted before the shuffle."""

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            words, counts = list(found), list(found.values())
            found.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"]
            )

        for part in parts:
            for text in part.column(0):
                found.update(utf8_words(text.as_py()))
                found[END] += 1
                if len(found) > HELD:
                    yield out()
        yield out()

    counted = texts.select("text").mapInArrow(batch, "word binary, n long")
    return checkpoint(counted.groupBy("word").agg(F.sum("n").alias("n")))


def commonest(counts: DataFrame, limit: int) -> list[Row]:
    """The most frequent words, `limit` at most, by count and word.

    Counts are taken in steps of a sixteenth of a binary order, a few hundred in all, and words from
    the top in whole steps, as many as fit; so only the words that are wanted reach the driver.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)
    total, lowest = 0, None
    for at, n in sizes:
        total += n
        if total > limit:
            break
        lowest = at
    if lowest is None:
        return []
    return sorted(counts.where(step >= lowest).collect(), key=lambda r: (-r["n"], bytes(r["word"])))


def vocabulary(counts: DataFrame, shape: Shape) -> Vocabulary:
    tokens, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    shape = shape.grown(tokens or 0)
    ordinary = counts.where(F.length("word") > 0)
    head = commonest(ordinary, shape.head)
    end = (tokens or 0) - (ordinary.agg(F.sum("n")).first()[0] or 0)
    words = [END, *(bytes(r["word"]) for r in head)]
    # The end is class 0; with it the classes of single words are full.
    single = counts.sparkSession.createDataFrame([(w,) for w in words[: shape.frequent]], "word binary")
    ending = F.crc32(F.substring("word", -3, 3)) % shape.endings
    rest = ordinary.join(F.broadcast(single), "word", "left_anti")
    sums = rest.groupBy(ending.alias("ending")).agg(F.sum("n"), F.count("*")).collect()
    class_tokens, class_distinct = np.zeros(shape.endings), np.zeros(shape.endings)
    for at, n, kinds in sums:
        class_tokens[at], class_distinct[at] = n, kinds
    return Vocabulary(
        shape, tokens or 0, distinct, words, np.array([end, *(r["n"] for r in head)], np.int64), class_tokens, class_distinct
    )


class Places(dict):
    """Word to its place among the broadcast words, or -1 - class; holds a bounded number of others."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__((w, i) for i, w in enumerate(vocabulary.words))
        self.shape, self.free = vocabulary.shape, 200_000

    def __missing__(self, word: bytes) -> int:
        place = -1 - self.shape.ending(word)
        if self.free:
            self.free -= 1
            self[word] = place
        return place

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def class_table(vocab: Vocabulary) -> np.ndarray:
    """Class of each broadcast word."""
    shape = vocab.shape
    return np.array(
        [i if i < shape.frequent else shape.ending(w) for i, w in enumerate(vocab.words)], np.int64
    )


def classes_of(places: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Classes of words."""
    return np.where(places < 0, -1 - places, table[np.maximum(places, 0)])


def targets(size: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words and ends of texts that lie one behind the other, each with the end before it
    (at `starts`) and behind; and for each of them the start of its text."""
    first = np.repeat(starts, np.diff(np.r_[starts, size]))
    at = np.flatnonzero(first != np.arange(size))
    return at, first[at]


def shard_of(context: np.ndarray, shards: int) -> np.ndarray:
    """A number below `shards` for each context, the same in every task."""
    x = context.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def pair_counts(texts: DataFrame, vocab: Vocabulary) -> DataFrame:
    """`place, shard, steps, n`: how often a class follows another, over all rows, packed.

    A row has the pairs of a shard in one block of texts. A pair is before * C + class, less than 2^32;
    they ascend, and `steps` are their differences.
    """
    shape, shards = vocab.shape, vocab.shape.shards(vocab.tokens)
    shared = texts.sparkSession.sparkContext.broadcast(vocab)

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, table = Places(shared.value), class_table(shared.value)
        held: list[list[np.ndarray]] = [[] for _ in range(shape.places)]
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for place, codes in enumerate(held):
                pairs, n = np.unique(np.concatenate([np.empty(0, np.int64), *codes]), return_counts=True)
                codes.clear()
                shard = shard_of(pairs // shape.classes, shards)
                order = np.argsort(shard, kind="stable")
                pairs, n = pairs[order], n[order].astype(np.uint32)
                ends = np.cumsum(np.bincount(shard, minlength=shards))
                made = [(i, a, b) for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([place] * len(made), pa.int32()),
                        pa.array([place * shards + i for i, _, _ in made], pa.int64()),
                        pa.array([np.diff(pairs[a:b], prepend=0).astype(np.uint32).tobytes() for _, a, b in made], pa.binary()),
                        pa.array([n[a:b].tobytes() for _, a, b in made], pa.binary()),
                    ],
                    names=["place", "shard", "steps", "n"],
                )

        for part in parts:
            for block in by_bytes((t.as_py() for t in part.column(0)), 1 << 20):
                found = [utf8_words(t) for t in block]
                for text in found:
                    text.append(END)
                sizes = np.array([len(w) for w in found], np.int64)
                starts = np.cumsum(sizes) - sizes
                words = places.of(list(chain.from_iterable(found)))
                c = np.insert(classes_of(words, table), starts, 0)
                at, first = targets(len(c), starts + np.arange(len(starts)))
                for place, codes in enumerate(held):
                    codes.append(c[np.maximum(at - 1 - place, first)] * shape.classes + c[at])
                size += len(c)
                if size > 1 << 21:
                    yield from out()
                    size = 0
        yield from out()

    return texts.select("text").mapInArrow(batch, "place int, shard long, steps binary, n binary")


def summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids, and the sums of their rows."""
    order = np.argsort(ids, kind="stable")
    ranked = ids.take(order)
    starts = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    return ranked[starts], np.add.reduceat(rows.take(order, axis=0), starts, axis=0)


@dataclass
class Bilinear:
    """The model of one place: vectors of contexts and targets, and biases of targets."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, noise: np.ndarray, dim: int, seed: int) -> Bilinear:
        rng = np.random.default_rng(seed)
        draw = lambda: rng.normal(0, 0.1, (len(noise), dim)).astype(np.float32)
        return cls(draw(), draw(), np.log(noise).astype(np.float32))

    def packed(self) -> bytes:
        return np.concatenate([self.context.ravel(), self.target.ravel(), self.bias]).astype(np.float32).tobytes()

    @classmethod
    def unpacked(cls, data: np.ndarray, classes: int) -> Bilinear:
        dim = (len(data) // classes - 1) // 2
        a, b = classes * dim, 2 * classes * dim
        return cls(data[:a].reshape(classes, dim).copy(), data[a:b].reshape(classes, dim).copy(), data[b:].copy())

    def raw(self, first: int, last: int) -> np.ndarray:
        """Scores of all classes behind the contexts first to last - 1: one matrix product."""
        return (self.context[first:last] @ self.target.T + self.bias).astype(np.float64)

    def totals(self, first: int, last: int) -> np.ndarray:
        """Logarithms of what the probabilities behind the contexts first to last - 1 are divided by."""
        raw = self.raw(first, last)
        top = raw.max(axis=1)
        return top + np.log(np.exp(raw - top[:, None]).sum(axis=1))

    def log10(self) -> np.ndarray:
        """Normalised log10 probabilities, a row per context."""
        n = len(self.context)
        return (self.raw(0, n) - self.totals(0, n)[:, None]) / math.log(10)

    def train(self, before: np.ndarray, after: np.ndarray, n: np.ndarray, noise: np.ndarray, shape: Shape, seed: int, rate: float) -> None:
        """One pass of noise-contrastive estimation over all pairs, weighted by their counts.

        A step tells a batch of true pairs from `shape.noise` classes drawn from `noise`, which its
        pairs share, so that all their scores are one matrix product. Counts over 16 are split, so that
        no pair outweighs its step; few pairs are passed over again until `shape.steps` are made.
        """
        rng = np.random.default_rng(seed)
        times = -(-n // 16)
        weight = np.repeat(n / times, times)
        weight = (weight / weight.mean()).astype(np.float32)
        pairs, words = np.repeat(np.arange(len(n)), times), np.cumsum(noise)
        words /= words[-1]
        odds = np.log(shape.noise * noise).astype(np.float32)
        squares = [np.full(len(noise), 1e-6, np.float32) for _ in range(3)]

        def move(value: np.ndarray, square: np.ndarray, ids: np.ndarray, grad: np.ndarray, speed: float) -> None:
            square[ids] += np.einsum("ij,ij->i", grad, grad) / grad.shape[1]
            value[ids] -= grad * (speed / np.sqrt(square[ids]))[:, None]

        made, total = 0, max(shape.steps, -(-len(pairs) // shape.batch))
        while made < max(1, shape.steps):
            order = rng.permutation(len(pairs))
            for at in range(0, len(order), shape.batch):
                made += 1
                speed = rate * max(0.3, 1 - 0.7 * made / total)
                some = order[at : at + shape.batch]
                h, w, much = before[pairs[some]], after[pairs[some]], weight[some]
                k = np.minimum(np.searchsorted(words, rng.random(shape.noise)), len(noise) - 1)
                c, t, z = self.context.take(h, axis=0), self.target.take(w, axis=0), self.target[k]
                true = np.einsum("ij,ij->i", c, t) + self.bias[w] - odds[w]
                g_true = ((sigmoid(true) - 1) * much).astype(np.float32)
                # The same of the noise, written over its scores: weight / (1 + exp(-score)).
                g_false = c @ -z.T
                g_false += odds[k] - self.bias[k]
                np.minimum(g_false, 60, out=g_false)
                np.exp(g_false, out=g_false)
                g_false += 1
                np.divide(much[:, None], g_false, out=g_false)
                t *= g_true[:, None]
                t += g_false @ z
                move(self.context, squares[0], *summed(h, t), speed)
                # Targets and their biases are summed together; the bias is the last column.
                moves = np.empty((len(w) + len(k), c.shape[1] + 1), np.float32)
                np.multiply(g_true[:, None], c, out=moves[: len(w), :-1])
                np.matmul(g_false.T, c, out=moves[len(w) :, :-1])
                moves[: len(w), -1], moves[len(w) :, -1] = g_true, g_false.sum(axis=0)
                ids, grad = summed(np.r_[w, k], moves)
                move(self.target, squares[1], ids, grad[:, :-1], speed)
                move(self.bias[:, None], squares[2], ids, grad[:, -1:], speed / 4)


@dataclass
class Model:
    """A log-bilinear model per place, their normalisers, and the plain distribution of classes."""

    places: list[Bilinear]
    totals: list[np.ndarray]
    plain: np.ndarray
    mix: tuple[float, ...]

    def log10(self, c: np.ndarray) -> float:
        """log10 probability of a text's classes, which come with the end before and behind."""
        return float(self.words_log10(c, np.zeros(1, np.int64)).sum())

    def words_log10(self, c: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """log10 probability of each word of some texts and of their ends, a text behind the other.

        `c` has the classes of all texts, each with the end before and behind; `starts` are their places.
        """
        at, first = targets(len(c), starts)
        out = np.empty(len(at))
        for i in range(0, len(at), 1 << 13):
            some = slice(i, i + (1 << 13))
            after = c[at[some]]
            total = self.mix[-1] * self.plain[after]
            for place, (model, norm) in enumerate(zip(self.places, self.totals, strict=True)):
                h = c[np.maximum(at[some] - 1 - place, first[some])]
                raw = np.einsum("ij,ij->i", model.context.take(h, axis=0), model.target.take(after, axis=0))
                total += self.mix[place] * np.exp(raw + model.bias[after] - norm[h])
            out[some] = np.log10(total)
        return out


def blocks_of(classes: int, size: int) -> list[tuple[int, int]]:
    return [(at, min(classes, at + size)) for at in range(0, classes, size)]


def mean_rows(part: pd.DataFrame) -> pd.DataFrame:
    """Moves of one place and block as their mean, weighted for each class, and the weights' sums.

    Contexts (block -1) are one shard's and stay as they are.
    """
    if part["block"].iloc[0] < 0:
        return part
    part = part.sort_values(["deal", "shard"])
    first = part.iloc[0]
    total = sum(np.frombuffer(w, np.float32).astype(np.float64) for w in part["weight"])
    rows = sum(
        np.frombuffer(w, np.float32).astype(np.float64)[:, None] * np.frombuffer(r, np.float16).reshape(len(total), -1)
        for w, r in zip(part["weight"], part["rows"], strict=True)
    )
    total, rows = total.astype(np.float32), (rows / total[:, None]).astype(np.float16)
    fields = {"place": first["place"], "block": first["block"], "deal": first["deal"], "shard": 0}
    return pd.DataFrame({k: [v] for k, v in {**fields, "weight": total.tobytes(), "rows": rows.tobytes()}.items()})


ROWS = "place int, block int, deal long, shard long, weight binary, rows binary"


def shortest(x: np.ndarray) -> np.ndarray:
    """The same numbers in four bytes each, if they fit."""
    return x.astype(np.int32) if not len(x) or x.max() < 1 << 31 else x.astype(np.int64)


def dealt_pairs(pairs: DataFrame, shape: Shape, shards: int) -> DataFrame:
    """`place, shard, before, times, after, n`: the pairs of a shard in one row, written down.

    All pairs of a context are one shard's, at most one per class; `times` is how many. `n` has four
    or eight bytes for each of `after`'s four. Blocks are summed as they come, so that a task holds a
    shard's distinct pairs and a bounded number of others.
    """

    def row(place: int, shard: int, codes: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        before, times = np.unique(codes // shape.classes, return_counts=True)
        cells = {"before": before, "times": times, "after": codes % shape.classes, "n": n}
        fields = {"place": place, "shard": shard} | {k: shortest(v).tobytes() for k, v in cells.items()}
        return pd.DataFrame({k: [v] for k, v in fields.items()})

    def packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: tuple[int, int] | None = None
        codes, n, fresh = [], [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            return summed(np.concatenate(codes), np.concatenate(n))

        for part in parts:
            for r in part.itertuples(index=False):
                if now and now[1] != r.shard:
                    yield row(*now, *total())
                    codes, n, fresh = [], [], 0
                now = r.place, r.shard
                codes.append(np.cumsum(np.frombuffer(r.steps, np.uint32), dtype=np.int64))
                n.append(np.frombuffer(r.n, np.uint32).astype(np.int64))
                fresh += len(n[-1])
                if fresh > max(1 << 22, len(n[0])):
                    (codes, n), fresh = ([x] for x in total()), 0
        if now:
            yield row(*now, *total())

    dealt = pairs.repartition(shards * shape.places, "shard").sortWithinPartitions("shard")
    kinds = "place int, shard long, before binary, times binary, after binary, n binary"
    return checkpoint(dealt.mapInPandas(packed, kinds))


def train_pairs(pairs: DataFrame, vocab: Vocabulary) -> Model:
    """Rounds in which every shard of the pair counts trains on from what all have made so far.

    A context's vector comes from the shard that holds its pairs, a target's is the shards' mean,
    weighted by how often they hold it. One shard of each place goes first, so that the others turn
    their contexts towards the same targets. The driver receives one model a round, not one per shard.
    """
    shape, classes = vocab.shape, vocab.shape.classes
    noise = np.full(classes, 0.5)
    single = vocab.counts[: shape.frequent]
    noise[: len(single)] += single
    noise[shape.frequent :] += vocab.class_tokens
    noise /= noise.sum()
    models = [Bilinear.fresh(noise, shape.dim, seed=1 + place) for place in range(shape.places)]
    spark = pairs.sparkSession
    shards = shape.shards(vocab.tokens)
    dealt = dealt_pairs(pairs, shape, shards)
    blocks = blocks_of(classes, 512)

    def trainer(start: Broadcast, rate: float, turn: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def trained(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for r in part.itertuples(index=False):
                    place, shard = r.place, r.shard
                    own = Bilinear.unpacked(np.frombuffer(start.value[place], np.float32), classes)
                    ids, times, after = (np.frombuffer(x, np.int32) for x in (r.before, r.times, r.after))
                    n = np.frombuffer(r.n, np.int32 if len(r.n) == len(r.after) else np.int64).astype(np.int64)
                    own.train(np.repeat(ids, times), after, n, noise, shape, turn * 1_000_003 + shard, rate)
                    made = [(place, -1, shard, shard, ids.tobytes(), own.context[ids].tobytes())]
                    # How far targets moved goes out in two bytes a number: this grows with shards and classes.
                    weight = (np.bincount(after, n, classes) + 1e-3).astype(np.float32)
                    old = Bilinear.unpacked(np.frombuffer(start.value[place], np.float32), classes)
                    rows = np.concatenate([own.target - old.target, (own.bias - old.bias)[:, None]], axis=1).astype(np.float16)
                    for block, (a, b) in enumerate(blocks):
                        made.append((place, block, shard % 32, shard, weight[a:b].tobytes(), rows[a:b].tobytes()))
                    yield pd.DataFrame(made, columns=["place", "block", "deal", "shard", "weight", "rows"])

        return trained

    ahead = [dealt.where(F.col("shard") % shards == 0)] if shards > 1 else []
    for turn, some in enumerate(ahead + [dealt] * shape.rounds):
        start = spark.sparkContext.broadcast([m.packed() for m in models])
        made = some.mapInPandas(trainer(start, 0.1 / (1 + max(0, turn - len(ahead))), turn), ROWS)
        some = made.groupBy("place", "block", "deal").applyInPandas(mean_rows, ROWS)
        block = F.when(F.col("block") < 0, F.col("deal")).otherwise(-1).alias("alone")
        whole = some.groupBy("place", "block", block).applyInPandas(mean_rows, ROWS)
        for r in whole.collect():
            model = models[r["place"]]
            if r["block"] < 0:
                ids = np.frombuffer(bytes(r["weight"]), np.int32)
                model.context[ids] = np.frombuffer(bytes(r["rows"]), np.float32).reshape(len(ids), -1)
                continue
            a, b = blocks[r["block"]]
            moves = np.frombuffer(bytes(r["rows"]), np.float16).astype(np.float32).reshape(b - a, -1)
            model.target[a:b] += moves[:, :-1]
            model.bias[a:b] += moves[:, -1]
    return Model(models, normalisers(spark, models), noise, shape.mix)


def normalisers(spark: SparkSession, models: list[Bilinear]) -> list[np.ndarray]:
    """For each place the totals of all contexts, in blocks that Spark deals to its tasks."""
    classes = len(models[0].bias)
    shared = spark.sparkContext.broadcast([m.packed() for m in models])
    blocks = [(place, a, b) for place in range(len(models)) for a, b in blocks_of(classes, 256)]

    def totals(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [Bilinear.unpacked(np.frombuffer(m, np.float32), classes) for m in shared.value]
        for part in parts:
            for i in part["id"]:
                place, a, b = blocks[i]
                yield pd.DataFrame({"id": [i], "totals": [own[place].totals(a, b).tobytes()]})

    tasks = max(1, min(len(blocks), spark.sparkContext.defaultParallelism * 2))
    out = [np.empty(classes) for _ in models]
    for r in spark.range(0, len(blocks), 1, tasks).mapInPandas(totals, "id long, totals binary").collect():
        place, a, b = blocks[r["id"]]
        out[place][a:b] = np.frombuffer(bytes(r["totals"]), np.float64)
    return out


PARTS = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, "
    "word binary, n long"
)


def score_texts(texts: DataFrame, counts: DataFrame, vocab: Vocabulary, model: Model) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, base_score, score` for each row of doc_id, held_out, text.

    A task knows the counts of the broadcast words. It gives a row per text with all that needs no
    other count, under a key that is no word, and a row per other word of the text; a left join adds
    those counts, and sums per text follow.
    """
    shared = texts.sparkSession.sparkContext.broadcast((vocab, model))

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = shared.value
        places, table = Places(vocab), class_table(vocab)
        # What a word of known place adds to either score, behind its class; an ending's words share the last.
        base = np.r_[np.log10(vocab.counts + 0.5), 0.0]
        inside = np.where(np.arange(len(base)) < vocab.shape.frequent, 0.0, base)
        seen = np.r_[vocab.counts > 0, False]
        totals = vocab.class_totals()
        row = TaskContext.get().partitionId() << 33
        for part in parts:
            ids, held, texts = (part.column(i) for i in range(3))
            at = 0
            for block in by_bytes((t.as_py() for t in texts), 1 << 20):
                found = [utf8_words(t) for t in block]
                sizes = np.array([len(w) + 1 for w in found], np.int64)
                ends = np.cumsum(sizes)
                for text in found:
                    text.append(END)
                words = list(chain.from_iterable(found))
                place = np.maximum(numbers := places.of(words), -1)
                starts = ends - sizes
                classes = classes_of(numbers, table)
                c = np.insert(classes, starts, 0)
                score = model.words_log10(c, starts + np.arange(len(sizes)))
                score += inside[place] - totals[classes]
                rest = np.flatnonzero(place < 0)
                cuts = np.searchsorted(rest, np.r_[starts, len(words)])
                others = [words[i] for i in rest.tolist()]
                rare = [Counter(others[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                kinds = np.array([len(r) for r in rare], np.int64)
                rows = np.arange(row, row + len(sizes))
                cells = {
                    "n_tokens": sizes,
                    "n_known": np.add.reduceat(seen[place], starts, dtype=np.int64),
                    "base": np.add.reduceat(base[place], starts) - vocab.base_total * sizes,
                    "model": np.add.reduceat(score, starts),
                }
                none = pa.nulls(int(kinds.sum()))
                both = lambda x, kind: pa.concat_arrays([x.cast(kind), none.cast(kind)])
                long = pa.int64()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[rows, np.repeat(rows, kinds)]),
                        both(ids.slice(at, len(block)), long),
                        both(held.slice(at, len(block)), pa.bool_()),
                        *(both(pa.array(x), long if x.dtype == np.int64 else pa.float64()) for x in cells.values()),
                        pa.array([*(b" %d" % r for r in rows.tolist()), *chain.from_iterable(rare)], pa.binary()),
                        pa.array([*([0] * len(rows)), *chain.from_iterable(r.values() for r in rare)], long),
                    ],
                    names=["row", "doc_id", "held_out", *cells, "word", "n"],
                )
                row += len(block)
                at += len(block)

    parts = texts.select("doc_id", "held_out", "text").mapInArrow(batch, PARTS)
    rare = counts.select("word", F.col("n").alias("c"))
    some = F.coalesce("c", F.lit(0))
    extra = F.col("n") * F.log10(some + F.lit(0.5))
    joined = parts.join(rare, "word", "left").select(
        "row", "doc_id", "held_out", "n_tokens",
        F.coalesce("n_known", F.when(some > 0, F.col("n")).otherwise(0)).alias("n_known"),
        F.coalesce("base", extra).alias("base"),
        F.coalesce("model", extra).alias("model"),
    )
    return joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base_score"),
        F.sum("model").alias("score"),
    ).drop("row")


def score_documents(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", shape: Shape = Shape()) -> DataFrame:
    """`doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score` for every row.

    Learns from all rows whose held_out is not true (NULL counts as false). Tokens are the words and
    one end; NULL and empty texts are an end alone. `base_score` sums smoothed unigram log10
    probabilities, `score` the model's. Rows repeating an id are scored each, NULL ids are kept, an
    empty table gives no rows; without training rows, every token is unseen and has a score.
    """
    texts = docs.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text")
    )
    learn = texts.where(~F.col("held_out"))
    counts = count_words(learn)
    vocab = vocabulary(counts, shape)
    scored = score_texts(texts, counts, vocab, train_pairs(pair_counts(learn, vocab), vocab))
    return scored.withColumn("train_tokens", F.lit(vocab.tokens).cast("long"))
