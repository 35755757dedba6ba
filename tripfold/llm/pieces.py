"""Pieces of a SentencePiece vocabulary: sampled segmentations of texts, and their decoding.

A text's segmentations are the paths of a lattice; a path weighs the product of its pieces'
weights. Gumbel top-k draws k distinct paths as if one after another without replacement: every
path gets its log probability plus Gumbel noise, and the k largest sums win. The search is A* from
the top: a cell of paths has the largest perturbed sum of its paths as its bound, drawn at once
from the cell's total probability; opening the best cell draws its best path, and what else the
cell holds becomes cells with bounds below. The first bound that is left over when k paths are out
is the threshold that turns probabilities into inclusion scores.

Pieces do not reach over the start of a blank run, so the lattice is a chain of small ones, one per
blank run and word; equal ones share their tables, and equal ends their nodes. Draws depend on seed,
row key, sample, place of the word and step only, never on which other rows are in a task.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import accumulate, count, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = 0x2581
#: Stands for a literal U+2581 in a text; no piece has it.
LITERAL = 0x110001
_CHUNK = re.compile(" +[^ ]*")
#: Characters whose lattices are built together.
BLOCK = 1 << 20
#: Characters of words whose lattices are kept for the next block.
KEPT = 1 << 20
#: Characters equally far from their chunks' ends that are compared with each other, at least.
FEW = 64
#: Paths drawn together, few enough that their numbers stay near.
WALKS = 1 << 14
_STEP = 0x9E3779B97F4A7C15
_ONES = np.frombuffer(b"".join((b"\xff" * n).ljust(8, b"\0") for n in range(9)), np.uint64)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def steps(n: int) -> np.uint64:
    """n golden steps, as 64 bits."""
    return np.uint64(_STEP * n & (1 << 64) - 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function."""
    out = x >> np.uint64(30)
    out ^= x
    out *= _MIX[0]
    out ^= out >> np.uint64(27)
    out *= _MIX[1]
    out ^= out >> np.uint64(31)
    return out


def uniform(seed: np.ndarray, nth: int) -> np.ndarray:
    """In (0, 1), by seed and number."""
    at = mixed(seed + steps(nth + 1))
    at >>= np.uint64(11)
    out = at.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


def index_type(n: int) -> type:
    """The narrowest kind of number for places among n."""
    return np.int32 if n < 1 << 31 else np.int64


def picked(of: np.ndarray, at: np.ndarray) -> np.ndarray:
    """`of[at]` for places that are there, without numpy's second look at them."""
    return of.take(at, mode="clip")


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Ranges of these sizes, one behind the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Vocabulary:
    """Piece texts as a trie in a hash table, and what each piece weighs and decodes to."""

    keys: np.ndarray
    nodes: np.ndarray
    piece_at: np.ndarray
    longest: int
    weight: np.ndarray
    raw: list[bytes]
    #: How many bytes each piece has, and by eights these bytes, with zeros behind.
    size: np.ndarray
    eights: list[np.ndarray]
    byte_id: np.ndarray
    byte_weight: float
    #: Pieces of the characters that have been spelt in bytes so far.
    spelt: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        """Weights fall with the piece's rank in the vocabulary, as words' do in a language.

        The vocabulary was made by merges, so it has ranks and no probabilities. Pieces with a
        blank behind another character are not used, nor are control pieces.
        """
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        raw, weight = [b""] * n, np.full(n, -np.inf)
        children: dict[tuple[int, int], int] = {}
        ends = {}
        byte_id = np.zeros(256, np.int64)
        made, longest = 1, 1
        for i in range(n):
            if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                continue
            text = model.id_to_piece(i)
            if model.is_byte(i):
                byte_id[int(text[3:5], 16)] = i
                raw[i] = bytes([int(text[3:5], 16)])
                continue
            if chr(BLANK) in text.lstrip(chr(BLANK)):
                continue
            raw[i] = text.replace(chr(BLANK), " ").encode()
            weight[i] = -np.log(10.0 + i)
            longest = max(longest, len(text))
            at = 0
            for c in text:
                if (at, ord(c)) not in children:
                    children[at, ord(c)] = made
                    made += 1
                at = children[at, ord(c)]
            ends[at] = i
        byte_weight = float(weight[np.isfinite(weight)].min())
        weight[byte_id] = byte_weight
        piece_at = np.full(made, -1, np.int32)
        piece_at[list(ends)] = list(ends.values())
        keys, nodes = np.full(1 << 18, -1, np.int64), np.zeros(1 << 18, np.int32)
        while len(keys) < 3 * len(children):
            keys, nodes = np.full(2 * len(keys), -1, np.int64), np.zeros(2 * len(keys), np.int32)
        for (at, c), to in children.items():
            key = at << 21 | c
            slot = int(cls._slot(np.array([key]), len(keys))[0])
            while keys[slot] >= 0:
                slot = (slot + 1) % len(keys)
            keys[slot], nodes[slot] = key, to
        size = np.fromiter(map(len, raw), np.int64, n)
        size = size.astype(np.min_scalar_type(size.max()))
        parts = (b"".join(r[a : a + 8].ljust(8, b"\0") for r in raw) for a in range(0, int(size.max()), 8))
        eights = [np.frombuffer(p, np.uint64) for p in parts]
        return cls(keys, nodes, piece_at, longest, weight, raw, size, eights, byte_id, byte_weight)

    @staticmethod
    def _slot(key: np.ndarray, size: int) -> np.ndarray:
        """The highest bits of the key times an odd number."""
        slot = key.astype(np.uint64)
        slot *= np.uint64(_STEP)
        slot >>= np.uint64(65 - size.bit_length())
        return slot.view(np.int64)

    def child(self, at: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Trie node below `at` by `char`, -1 if there is none."""
        key = at.astype(np.int64)
        key <<= 21
        key |= char
        slot = self._slot(key, len(self.keys))
        found = picked(self.keys, slot)
        out = picked(self.nodes, slot)
        other = np.flatnonzero(found != key)
        out[other] = -1
        open_ = other[found[other] >= 0]
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.nodes[slot[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def decode(self, ids: Sequence[int]) -> str:
        """The text of a segmentation; bytes that are no UTF-8 become U+FFFD."""
        joined = b"".join(map(self.raw.__getitem__, ids))
        return joined[1:].decode("utf-8", "replace") if joined[:1] == b" " else joined.decode("utf-8", "replace")


    def spelling(self, char: int) -> np.ndarray:
        if char not in self.spelt:
            self.spelt[char] = self.byte_id[list(chr(char).encode("utf-8", "surrogatepass"))]
        return self.spelt[char]

    def spells(self, ids: np.ndarray, text: str, eights: np.ndarray | None = None) -> bool:
        """Whether a segmentation decodes to the text: by its bytes, and where they differ by `decode`.

        `eights` are the text's `in_eights`, for many segmentations of one text.
        """
        whole = in_eights(text) if eights is None else eights
        every, ids = ids, ids.astype(np.intp)
        size = picked(self.size, ids)
        at = np.cumsum(size, dtype=np.intp)
        if len(ids) and at[-1] == len(whole):
            at -= size
            for part in self.eights:
                differ = picked(whole, at)
                differ ^= picked(part, ids)
                differ &= picked(_ONES, np.minimum(size, 8))
                if differ.any():
                    break
                far = np.flatnonzero(size > 8)
                if not len(far):
                    return True
                ids, at, size = ids[far], at[far] + 8, size[far] - 8
        found = b"".join(map(self.raw.__getitem__, every.tolist()))
        return (found[1:] if found[:1] == b" " else found) == text.encode("utf-8", "surrogatepass") or self.decode(every.tolist()) == text


def in_eights(text: str) -> np.ndarray:
    """For every byte of a blank and the text the eight bytes from there, with zeros behind the end."""
    whole = b" " + text.encode("utf-8", "surrogatepass")
    return np.ndarray(len(whole), np.uint64, whole + bytes(8), 0, (1,)).copy()


def chunks(text: str) -> list[str]:
    """The text behind a first blank, cut before every run of blanks. Nothing for an empty text."""
    return _CHUNK.findall(" " + text) if text else []


def plain(text: str) -> bool:
    """Whether every blank is one between two chunks."""
    return bool(text) and text[0] != " " and "  " not in text


class Lattices:
    """The lattices of distinct chunks: a node per rest of a chunk, edges to shorter ones or the end (-1).

    `log_prob[e]` is the log probability to leave the edge's node by it, so that a path's
    probability is the product over its edges, given its chunk; `before[e]` is the probability to
    leave the node by an edge in front.
    """

    def __init__(self, distinct: Sequence[str], vocab: Vocabulary):
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        kind = index_type(int(sizes.sum()) * vocab.longest)
        ends = np.cumsum(sizes).astype(kind)
        starts = ends - sizes.astype(kind)
        joined = "".join(distinct).encode("utf-32-le", "surrogatepass")
        chars = np.frombuffer(joined, np.int32)
        chars = np.where(chars == BLANK, LITERAL, np.where(chars == 32, BLANK, chars))
        far = np.repeat(ends, sizes) - np.arange(len(chars), dtype=kind)
        longest = int(far.max()) if len(far) else 0
        by_far = np.argsort(far.astype(np.uint16) if longest < 1 << 16 else far, kind="stable")
        cuts = np.searchsorted(picked(far, by_far), np.arange(1, longest + 2))
        # A node for every distinct rest of a chunk, from the last characters to the first: by its node behind and character.
        # So far from the ends that few chunks are as long, every character has its own.
        of, shown, bounds, done = np.zeros(len(chars), kind), [], [0], 0
        for a, b in pairwise(cuts.tolist()):
            if b - a < FEW:
                break
            here, done = by_far[a:b], b
            key = picked(chars, here).astype(np.int64)
            if a:
                key |= picked(of, here + 1).astype(np.int64) << 21
            order = np.argsort(key)
            key = picked(key, order)
            fresh = np.append(True, key[1:] != key[:-1])
            of[picked(here, order)] = bounds[-1] - 1 + np.cumsum(fresh)
            shown.append(picked(here, picked(order, np.flatnonzero(fresh))))
            bounds.append(bounds[-1] + len(shown[-1]))
        own = by_far[done:]
        of[own] = bounds[-1] + np.arange(len(own))
        shown.append(own)
        bounds += (cuts[cuts > done] - done + bounds[-1]).tolist()
        self.start = picked(of, starts)
        where = np.concatenate(shown)
        far = picked(far, where)
        at, node = np.arange(len(where)), np.zeros(len(where), np.int32)
        hits = []
        for size in range(1, vocab.longest + 1):
            if size > 1:
                inside = np.flatnonzero(picked(far, at) >= size)
                at, node = picked(at, inside), picked(node, inside)
            node = vocab.child(node, picked(chars, picked(where, at) + (size - 1)))
            there = np.flatnonzero(node >= 0)
            at, node = picked(at, there), picked(node, there)
            known = picked(vocab.piece_at, node)
            hit = np.flatnonzero(known >= 0)
            hits.append((size, picked(at, hit), picked(known, hit)))
        # Characters without a piece are spelt in bytes: one edge, its piece -1 - character, or the one byte's.
        lacking = np.ones(len(where), bool)
        lacking[hits[0][1]] = False
        strange = np.flatnonzero(lacking)
        literal = picked(chars, picked(where, strange))
        literal = np.where(literal == LITERAL, BLANK, literal)
        hits.append((1, strange, np.where(literal < 0x80, vocab.byte_id[literal & 0x7F], -1 - literal).astype(np.int32)))
        degree = np.bincount(np.concatenate([source for _, source, _ in hits]), minlength=len(where))
        self.first = np.zeros(len(where) + 1, kind)
        np.cumsum(degree, out=self.first[1:])
        self.to, self.piece = np.empty(self.first[-1], kind), np.empty(self.first[-1], np.int32)
        free = self.first[:-1].copy()
        for size, source, piece in hits:
            edge = picked(free, source)
            free[source] = edge + 1
            self.to[edge] = np.where(picked(far, source) == size, -1, picked(of, picked(where, source) + size))
            self.piece[edge] = piece
        weight = picked(vocab.weight, self.piece)
        strange = np.flatnonzero(self.piece < 0)
        literal = -1 - self.piece[strange]
        weight[strange] = (2 + (literal >= 0x800).astype(int) + (literal >= 0x10000)) * vocab.byte_weight
        # Log sums of all ways to the end; the end's is 0.
        total = np.zeros(len(where) + 1)
        to = np.where(self.to < 0, len(where), self.to)
        for a, b in pairwise(bounds):
            here, many = slice(self.first[a], self.first[b]), degree[a:b]
            value, head = weight[here], self.first[a:b] - self.first[a]
            value += picked(total, to[here])
            top = np.maximum.reduceat(value, head)
            power = value - np.repeat(top, many)
            np.exp(power, out=power)
            total[a:b] = top = top + np.log(np.add.reduceat(power, head))
            value -= np.repeat(top, many)
        self.log_prob = weight
        self.before = np.zeros(len(weight))
        prob = np.exp(self.log_prob)
        edge, size = self.first[:-1], np.diff(self.first)
        nth = 1
        while len(edge):
            more = np.flatnonzero(size > nth)
            edge, size = picked(edge, more), picked(size, more)
            at = edge + (nth - 1)
            self.before[edge + nth] = picked(self.before, at) + picked(prob, at)
            nth += 1

    def with_more(self, more: Lattices) -> Lattices:
        """These, and those of other chunks behind them."""
        out = object.__new__(Lattices)
        nodes, edges = len(self.first) - 1, len(self.to)
        kind = index_type(max(nodes + len(more.first), edges + len(more.to)))
        out.start = np.concatenate((self.start, more.start.astype(kind) + nodes))
        out.first = np.concatenate((self.first[:-1], more.first.astype(kind) + edges))
        out.to = np.concatenate((self.to, np.where(more.to < 0, -1, more.to.astype(kind) + nodes)))
        for name in ("piece", "log_prob", "before"):
            setattr(out, name, np.concatenate((getattr(self, name), getattr(more, name))))
        return out

    def only(self, chosen: np.ndarray) -> Lattices:
        """Those of the chosen chunks, in their order."""
        out = object.__new__(Lattices)
        kind = self.first.dtype
        seen, degree = np.zeros(len(self.first) - 1, bool), np.diff(self.first)
        front = picked(self.start, chosen)
        while len(front):
            seen[front] = True
            front = picked(self.to, ranges(picked(self.first, front), picked(degree, front)))
            front = front[front >= 0]
            front = np.unique(front[~seen[front]])
        nodes = np.flatnonzero(seen)
        new = (np.cumsum(seen) - 1).astype(kind)
        degree = degree[nodes]
        edges = ranges(self.first[nodes], degree)
        out.start = new[self.start[chosen]]
        out.first = np.append(0, np.cumsum(degree)).astype(kind)
        to = self.to[edges]
        out.to = np.where(to < 0, -1, new[to])
        for name in ("piece", "log_prob", "before"):
            setattr(out, name, getattr(self, name)[edges])
        return out

    def around(self, edge: int) -> range:
        """All edges of an edge's node."""
        node = int(np.searchsorted(self.first, self.first.dtype.type(edge), "right"))
        return range(int(self.first[node - 1]), int(self.first[node]))

    def walk(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A drawn path from each node to its chunk's end: all edges in order, and each one's count."""
        parts = [self._walk(node[at : at + WALKS], seed[at : at + WALKS]) for at in range(0, len(node), WALKS)]
        edges, counts = zip(*parts, strict=True) if parts else ((), ())
        return np.concatenate([np.empty(0, self.to.dtype), *edges]), np.concatenate([np.empty(0, np.int64), *counts])

    def _walk(self, node: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = np.zeros(len(node), np.int64)
        taken = []
        live = np.flatnonzero(node >= 0)
        node, seed = picked(node, live), picked(seed, live)
        while len(live):
            rest = uniform(seed, len(taken))
            # The last edges are the longest pieces, and mostly the likeliest.
            edge = picked(self.first[1:], node)
            edge -= 1
            look = np.flatnonzero(rest < picked(self.before, edge))
            while len(look):
                now = picked(edge, look) - 1
                edge[look] = now
                look = look[np.flatnonzero(picked(rest, look) < picked(self.before, now))]
            taken.append((live, edge))
            node = picked(self.to, edge)
            counts[picked(live, np.flatnonzero(node < 0))] = len(taken)
            on = np.flatnonzero(node >= 0)
            live, node, seed = picked(live, on), picked(node, on), picked(seed, on)
        heads = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), self.to.dtype)
        for nth, (live, edge) in enumerate(taken):
            out[picked(heads, live) + nth] = edge
        return out, counts


@dataclass
class Sample:
    """A segmentation: edges, the word each belongs to, log probabilities, and the perturbed one."""

    edges: np.ndarray
    words: np.ndarray
    #: Log probability of the path up to each edge; one more than there are edges.
    sums: np.ndarray
    perturbed: float

    @property
    def log_prob(self) -> float:
        return float(self.sums[-1])


@dataclass
class Cell:
    """The paths that follow `path` up to an edge from `at` on and then leave it, but for `gone`."""

    path: Sample
    at: int
    gone: list[tuple[int, int, float]]

    def left(self) -> float:
        """Probability of its paths together, given the path up to `at`."""
        base = self.path.sums[self.at]
        return float(-np.expm1(self.path.sums[-1] - base) - sum(np.exp(x - base) for *_, x in self.gone))

    def ways(self, lattices: Lattices) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Every place and edge to leave the path by, and how likely, given the path up to `at`."""
        gone = {(a, b) for a, b, _ in self.gone}
        out, odds = [], []
        for at in range(self.at, len(self.path.edges)):
            for edge in lattices.around(self.path.edges[at]):
                if edge != self.path.edges[at] and (at, edge) not in gone:
                    out.append((at, edge))
                    odds.append(np.exp(self.path.sums[at] - self.path.sums[self.at]) * np.exp(lattices.log_prob[edge]))
        return out, np.array(odds)

    def log_mass(self, lattices: Lattices) -> float:
        """Of its paths together; -inf if none is left. Summed way by way where little is left."""
        left = self.left()
        if left < 1e-6:
            left = float(self.ways(lattices)[1].sum())
        return float(self.path.sums[self.at] + np.log(left)) if left > 0 else -np.inf

    def drawn(self, lattices: Lattices, draws: Iterator[float]) -> tuple[int, int]:
        """Where to leave the path, and the other edge, by probability; again if those paths are gone."""
        if self.left() < 1e-3:
            ways, odds = self.ways(lattices)
            return ways[min(int(np.searchsorted(np.cumsum(odds), next(draws) * odds.sum(), "right")), len(ways) - 1)]
        base, end = self.path.sums[self.at], self.path.sums[-1]
        gone = {(a, b) for a, b, _ in self.gone}
        while True:
            share = -np.expm1(end - base) * next(draws)
            kept = base + np.log1p(-share)
            tail = self.path.sums[self.at + 1 :]
            at = self.at + min(int(np.searchsorted(-tail, -kept)), len(tail) - 1)
            own = int(self.path.edges[at])
            others = lattices.around(own)
            if len(others) == 1:
                continue
            odds = np.exp(lattices.log_prob[others.start : others.stop]).tolist()
            del odds[own - others.start]
            odds = list(accumulate(odds))
            edge = others.start + min(bisect_right(odds, next(draws) * odds[-1]), len(odds) - 1)
            edge += edge >= own
            if (at, edge) not in gone:
                return at, edge


def below(location: float, limit: float, u: float) -> float:
    """Gumbel noise around `location`, given that it stays below `limit`."""
    return location - float(np.logaddexp(location - limit, np.log(-np.log(u))))


def stream(seed: int) -> Iterator[float]:
    """The numbers `uniform` gives for one seed, one after another."""
    full, (a, b) = (1 << 64) - 1, map(int, _MIX)
    for n in count(1):
        x = seed + _STEP * n & full
        x = (x ^ x >> 30) * a & full
        x = (x ^ x >> 27) * b & full
        yield ((x ^ x >> 31) >> 11) * 2.0**-53 + 2.0**-54


class Known:
    """Chunks met so far, by number, and their lattices; when they are many, those met once are forgotten."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        #: By a chunk's bytes behind its first blank.
        self.numbers: dict[bytes, int] = defaultdict(count().__next__)
        self.lattices: Lattices | None = None
        self.again = np.zeros(0, bool)

    def forget(self) -> None:
        """Keeps what more than one block had since the last time."""
        kept = np.flatnonzero(self.again)
        words = list(self.numbers)
        self.numbers = defaultdict(count(len(kept)).__next__, zip(map(words.__getitem__, kept.tolist()), count()))
        self.lattices = self.lattices.only(kept) if len(kept) else None
        self.again = np.zeros(len(kept), bool)

    def numbered(self, texts: Sequence[str]) -> list[np.ndarray]:
        if self.lattices is not None and len(self.lattices.first) > KEPT:
            self.forget()
        had = len(self.numbers)
        each = pa.array([t.encode("utf-8", "surrogatepass") if plain(t) else None for t in texts], pa.large_binary())
        cut = pc.split_pattern(each, b" ")
        coded = cut.flatten().dictionary_encode()
        met = [np.fromiter(map(self.numbers.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)), np.int64)]
        at, words = cut.offsets.to_numpy(), met[0][coded.indices.to_numpy()]
        out = [words[a:b] for a, b in pairwise(at.tolist())]
        for n, text in enumerate(texts):
            if not plain(text):
                keys = (c[1:].encode("utf-8", "surrogatepass") for c in chunks(text))
                out[n] = np.fromiter(map(self.numbers.__getitem__, keys), np.int64)
                met.append(out[n])
        for words in met:
            self.again[words[words < had]] = True
        if len(self.numbers) > had:
            new = Lattices([" " + w.decode("utf-8", "surrogatepass") for w in islice(self.numbers, had, None)], self.vocab)
            self.lattices = new if self.lattices is None else self.lattices.with_more(new)
            self.again = np.concatenate((self.again, np.zeros(len(self.numbers) - had, bool)))
        return out


def sample_block(texts: Sequence[str], seeds: np.ndarray, k: int, known: Known) -> tuple[list[tuple[list[Sample], float]], Lattices | None]:
    """For each text its k samples (all segmentations, if fewer), largest first, and the next bound."""
    words = known.numbered(texts)
    lattices = known.lattices
    if lattices is None:
        return [([Sample(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(1), 0.0)], -np.inf) for _ in texts], None
    nodes = picked(lattices.start, np.concatenate(words))
    ends = np.cumsum([len(w) for w in words])

    def paths(parts: list[tuple[int, int, int]], nth: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For (text, its first word to draw, an edge to it or -1): edges, their words and log probabilities."""
        text, word, edge = np.array(parts).T
        sizes = np.array([len(words[i]) for i in text.tolist()]) - word
        after = np.cumsum(sizes)
        node = picked(nodes, ranges(ends[text] - sizes, sizes))
        led = np.flatnonzero(edge >= 0)
        node[after[led] - sizes[led]] = lattices.to[edge[led]]
        place = ranges(word, sizes)
        seed = np.repeat(seeds[text] + steps((nth + 1) << 40), sizes)
        seed += np.uint64(_STEP) * place.astype(np.uint64)
        edges, counts = lattices.walk(node, mixed(seed))
        of, logs = np.repeat(place.astype(np.int32), counts), picked(lattices.log_prob, edges)
        cuts = np.append(0, np.cumsum(counts))[np.append(0, after)].tolist()
        return [(edges[a:b], of[a:b], logs[a:b]) for a, b in pairwise(cuts)]

    def sums(base: np.ndarray, *logs: np.ndarray) -> np.ndarray:
        """`base`, and the sums of its last with the log probabilities one by one."""
        out = np.concatenate((base, *logs))
        more = out[len(base) - 1 :]
        np.cumsum(more, out=more)
        return out

    draws = [stream(int(s)) for s in mixed(seeds ^ np.uint64(_STEP))]
    first = paths([(i, 0, -1) for i in range(len(texts))], 0)
    found = [[Sample(e, w, sums(np.zeros(1), x), -float(np.log(-np.log(next(d)))))] for (e, w, x), d in zip(first, draws, strict=True)]
    heaps: list[list[tuple[float, int, Cell]]] = [[] for _ in texts]
    order = count()

    def push(i: int, cell: Cell, limit: float) -> None:
        mass = cell.log_mass(lattices)
        if mass > -np.inf:
            heapq.heappush(heaps[i], (-below(mass, limit, next(draws[i])), next(order), cell))

    for i, (only,) in enumerate(found):
        push(i, Cell(only, 0, []), only.perturbed)
    for nth in range(1, k):
        opened = []
        for i, heap in enumerate(heaps):
            if heap:
                bound, _, cell = heapq.heappop(heap)
                opened.append((i, -bound, cell, *cell.drawn(lattices, draws[i])))
        if not opened:
            break
        parts = [(i, int(cell.path.words[at]), edge) for i, _, cell, at, edge in opened]
        for (i, bound, cell, at, edge), (edges, of, logs) in zip(opened, paths(parts, nth), strict=True):
            path = cell.path
            new = Sample(
                np.concatenate((path.edges[:at], np.array([edge], edges.dtype), edges)),
                np.concatenate((path.words[: at + 1], of)),
                sums(path.sums[: at + 1], lattices.log_prob[edge : edge + 1], logs),
                bound,
            )
            found[i].append(new)
            push(i, Cell(path, cell.at, [*cell.gone, (at, edge, float(new.sums[at + 1]))]), bound)
            push(i, Cell(new, at + 1, []), bound)
    return [(f, -h[0][0] if h else -np.inf) for f, h in zip(found, heaps, strict=True)], lattices


def piece_ids(sample: Sample, lattices: Lattices | None, vocab: Vocabulary) -> np.ndarray:
    if lattices is None or not len(sample.edges):
        return np.empty(0, np.int32)
    ids = picked(lattices.piece, sample.edges)
    strange = np.flatnonzero(ids < 0)
    if len(strange):
        spelt = [vocab.spelling(-1 - c) for c in ids[strange].tolist()]
        times = np.ones(len(ids), np.int64)
        times[strange] = [len(s) for s in spelt]
        ids = np.repeat(ids, times)
        ids[ids < 0] = np.concatenate(spelt)
    return ids.astype(np.int32, copy=False)


def inclusion(log_prob: float, threshold: float) -> float:
    """Probability that a path's perturbed sum exceeds the threshold; 1 if all paths are out."""
    return 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(log_prob - threshold, 700.0))))


def sampled(rows: Iterable[tuple[int | None, str | None]], k: int, seed: str, vocab: Vocabulary) -> Iterator[list[tuple[int, np.ndarray, float, float, float]]]:
    """For each (key, text): (rank, ids, log probability, perturbed, inclusion) of its samples."""
    held: list[tuple[int | None, str]] = []
    known = Known(vocab)

    def out() -> Iterator[list[tuple[int, np.ndarray, float, float, float]]]:
        seeds = np.array([xxhash.xxh64_intdigest(f"{seed}:{key}") for key, _ in held], np.uint64)
        found, lattices = sample_block([t for _, t in held], seeds, k, known)
        for samples, threshold in found:
            yield [
                (n, piece_ids(s, lattices, vocab), s.log_prob, s.perturbed, inclusion(s.log_prob, threshold))
                for n, s in enumerate(samples, 1)
            ]

    size = 0
    for key, text in rows:
        held.append((key, text or ""))
        size += len(text or "")
        if size > BLOCK:
            yield from out()
            held, size = [], 0
    if held:
        yield from out()


_SHARED = "doc_id long, sample int, log_prob double, perturbed double, inclusion double, n_pieces long"


def _mapped(docs: DataFrame, key: str, text: str, k: int, seed: str, model: str, digest: bool) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(model))
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
    kinds += [pa.string(), pa.bool_()] if digest else [pa.list_(pa.int32())]
    names = ["doc_id", "sample", "log_prob", "perturbed", "inclusion", "n_pieces"]
    names += ["ids_digest", "decoded"] if digest else ["ids"]

    def batch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = shared.value
        for part in parts:
            keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            rows: list[tuple] = []
            held = 0
            for doc_id, body, samples in zip(keys, texts, sampled(zip(keys, texts, strict=True), k, seed, vocab), strict=True):
                eights = in_eights(body or "") if digest else None
                for n, ids, log_prob, perturbed, inside in samples:
                    row = (doc_id, n, log_prob, perturbed, inside, len(ids))
                    if digest:
                        ok = vocab.spells(ids, body or "", eights)
                        row += (xxhash.xxh64_hexdigest(ids.tobytes()), ok)
                    else:
                        row += (ids,)
                        held += len(ids)
                    rows.append(row)
                if held > 1 << 22:
                    yield made(rows)
                    rows, held = [], 0
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(batch, f"{_SHARED}, " + ("ids_digest string, decoded boolean" if digest else "ids array<int>"))


def segmentations(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, seed: str = "pieces", model: str = MODEL) -> DataFrame:
    """`doc_id, sample, log_prob, perturbed, inclusion, n_pieces, ids`: k distinct samples per row.

    A text with fewer segmentations gives all it has; NULL and empty texts have one, without
    pieces. Every sample decodes to its text exactly: blanks are pieces' first characters, and
    characters that no piece has, U+2581 among them, are spelt in bytes. Rows that repeat key and
    text give the same samples each; a NULL key is a key like others. No rows give no rows.
    """
    return _mapped(docs, key, text, k, seed, model, digest=False)


def segmentation_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 2, seed: str = "pieces", model: str = MODEL) -> DataFrame:
    """The same rows with XXH64 of the ids (int32) and whether they decode to the text, not the ids."""
    return _mapped(docs, key, text, k, seed, model, digest=True)


def decode(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """Rows with `ids`, with their text added as `decoded_text`; NULL ids decode to NULL."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @F.pandas_udf("string")
    def decoded(parts):
        return parts.map(lambda ids: None if ids is None else shared.value.decode(list(ids)))

    return rows.withColumn("decoded_text", decoded("ids"))
