"""Exact top-k by integer inner product on a bit-sliced index.

Every component is a column of integers, kept as bitmaps over the rows: one per binary digit. A
score is a sum of columns times the query's integers, made by adding bitmaps digit by digit for all
rows at once; the sum is a column of bitmaps itself, and the best rows are picked from its most
significant digit down.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.llm.vectors import KEYS, best, dealt, distinct_ids, in_blocks, matrix, one_row_each, one_vector_each, per_block, shard_count, usable

#: Scaled components below this keep sums and differences of two of them in a long.
MOST = float(1 << 61)
FOUND = "query_id long, vec_id long, score long"


def add(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The sum of two columns of bitmaps, digit first, cut to `bits` digits."""
    out = np.zeros((bits, *b.shape[1:]), np.uint64)
    carry = np.zeros(b.shape[1:], np.uint64)
    none = np.zeros_like(carry)
    for i in range(bits):
        x = a[i] if i < len(a) else none
        y = b[i] if i < len(b) else None
        if y is None:
            out[i] = x ^ carry
            carry = x & carry
        else:
            differ = x ^ y
            out[i] = differ ^ carry
            carry = (x & y) | (carry & differ)
    return out


def add_to(total: np.ndarray, part: np.ndarray) -> None:
    """total += part in place; both digit first."""
    carry = np.zeros(total.shape[1:], np.uint64)
    differ, both = np.empty_like(carry), np.empty_like(carry)
    for i in range(len(total)):
        digit = total[i]
        if i < len(part):
            np.bitwise_xor(digit, part[i], out=differ)
            np.bitwise_and(digit, part[i], out=both)
            np.bitwise_xor(differ, carry, out=digit)
            carry &= differ
            carry |= both
        else:
            np.bitwise_and(digit, carry, out=both)
            digit ^= carry
            carry, both = both, carry


class Slices:
    """The index of a shard: `digits[j]` are component j's bitmaps, of its value less `low[j]`."""

    def __init__(self, values: np.ndarray):
        self.rows = len(values)
        self.words = -(-self.rows // 64)
        self.low = values.min(axis=0)
        above = values - self.low
        self.digits = [
            np.stack([self.bitmap(column >> i & 1) for i in range(int(column.max()).bit_length())])
            if column.max()
            else np.zeros((0, self.words), np.uint64)
            for column in above.T
        ]

    def bitmap(self, flags: np.ndarray) -> np.ndarray:
        packed = np.zeros(self.words * 8, np.uint8)
        packed[: -(-self.rows // 8)] = np.packbits(flags.astype(bool), bitorder="little")
        return packed.view(np.uint64)

    def multiples(self, j: int, factors: np.ndarray, bits: int) -> np.ndarray:
        """Component j (its complement for negative factors) times |factor|, one per factor."""
        digits = self.digits[j]
        out = np.zeros((len(factors), bits, self.words), np.uint64)
        for negative in (False, True):
            base = ~digits if negative else digits
            known = {0: np.zeros((0, self.words), np.uint64)}

            def times(m: int, base: np.ndarray = base, known: dict = known) -> np.ndarray:
                if m not in known:
                    low = (m & -m).bit_length() - 1
                    shifted = np.concatenate([np.zeros((low, self.words), np.uint64), base])
                    width = min(bits, len(base) + m.bit_length())
                    known[m] = add(times(m & (m - 1)), shifted, width)
                return known[m]

            for n, factor in enumerate(factors.tolist()):
                if (factor < 0) == negative and len(digits):
                    made = times(abs(factor))
                    out[n, : len(made)] = made
        return out

    def sums(self, queries: np.ndarray) -> np.ndarray:
        """Scores of all rows for each query, but for a constant of the query: (digit, query, word)."""
        sizes = np.array([(1 << len(d)) - 1 for d in self.digits], dtype=object)
        top = max((int(x) for x in (abs(queries).astype(object) * sizes).sum(axis=1)), default=0)
        total = np.zeros((top.bit_length(), len(queries), self.words), np.uint64)
        for j in range(queries.shape[1]):
            factors, which = np.unique(queries[:, j], return_inverse=True)
            most = int(abs(factors).max()) * ((1 << len(self.digits[j])) - 1)
            if not most:
                continue
            table = self.multiples(j, factors, most.bit_length())
            for at in range(0, len(queries), 64):
                part = table[which[at : at + 64]].transpose(1, 0, 2)
                add_to(total[:, at : at + 64], part)
        return total


def select_top(total: np.ndarray, eligible: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps per query: rows surely among the k best, and those tied at the boundary."""

    def count(bitmap: np.ndarray) -> np.ndarray:
        return np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)

    edge = eligible.copy()
    sure = np.zeros_like(edge)
    wanted = np.minimum(k, count(eligible))
    for digit in total[::-1]:
        ones = edge & digit
        more = sure | ones
        n = count(more)
        over = (n > wanted)[:, None]
        sure = np.where(over, sure, more)
        edge = np.where(over, ones, np.where((n < wanted)[:, None], edge & ~digit, np.uint64(0)))
    return sure, edge


def search(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
    """Each query's k best rows of a shard whose ids ascend; ties at the boundary go to small ids."""
    index = Slices(values)
    eligible = np.tile(index.bitmap(np.ones(index.rows)), (len(queries), 1))
    own = np.searchsorted(ids, query_ids)
    here = (own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == query_ids)
    word, bit = own[here] // 64, (own[here] % 64).astype(np.uint64)
    eligible[np.flatnonzero(here), word] &= ~(np.uint64(1) << bit)
    sure, edge = select_top(index.sums(queries), eligible, k)

    def rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))

    parts = []
    for i in range(len(queries)):
        picked = rows(sure[i])
        picked = np.r_[picked, rows(edge[i])[: k - len(picked)]].astype(np.int64)
        # Of longs, so a product or sum on the way may leave the range, and the end is right if it is in it.
        score = values[picked] @ queries[i]
        about = values[picked].astype(np.float64) @ queries[i].astype(np.float64)
        if (abs(about) > 1.01 * 2.0**63).any() or (abs(about - score) > 2.0**62).any():
            raise OverflowError("an inner product is no long")
        parts.append((np.full(len(picked), query_ids[i]), ids[picked], score))
    columns = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))


def top_products(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    scale: int = 256,
    key: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 1 << 16,
    block_rows: int = 1 << 10,
) -> DataFrame:
    """`query_id, rank, vec_id, score`: each query's k rows of largest inner product, exactly.

    Components count as floor(scale * x). A query meets rows of its own length but not those of its
    own id. Ties go to the smaller vec_id. An id that repeats counts once, with its smallest
    vector. Rows without id, with a NULL or empty vector, or with a component that is NULL or not
    finite take no part; nor do those with one that is 2^61 or more when scaled, which is no long in
    a score with any but tiny others. A score among the k best that is no long fails. Fewer candidates than k are all returned; empty
    tables give no rows. Rows are dealt by id over shards, and every block of queries goes to every
    shard; a task holds one shard and one block.
    """
    rows = one_row_each(usable(vectors, key, vector, MOST / scale, zero=True))
    shards = shard_count(rows, shard_rows)
    asked, blocks = in_blocks(one_vector_each(usable(queries, key, vector, MOST / scale, zero=True)), shards, block_rows)

    def scored(data: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(data) or not len(wanted):
            return pd.DataFrame(columns=["query_id", "vec_id", "score"]).astype("int64")
        data = distinct_ids(data)
        whole = np.floor(matrix(data["vec"]) * scale).astype(np.int64)
        asks = np.floor(matrix(wanted["vec"]) * scale).astype(np.int64)
        return search(data["vec_id"].to_numpy(), whole, wanted["vec_id"].to_numpy(), asks, k)

    placed = per_block(dealt(rows, shards), blocks)
    found = placed.groupBy(*KEYS).cogroup(asked.groupBy(*KEYS)).applyInPandas(scored, FOUND)
    return best(found, k, nearest=False)


PRODUCTS_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM pairs)
WHERE rank <= 5
"""
