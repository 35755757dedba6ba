"""Language of a text by cross-parsing: how few phrases of a language's text it can be put together from.

A suffix automaton of labelled text per language accepts every sequence that occurs in it. A text is
parsed from the left: each phrase is the longest one the automaton accepts, or a single byte that the
language's text lacks. Phrases times the logarithm of the language's text, by the length of the text,
estimate the entropy of the text given the language; the least one wins.
"""

from __future__ import annotations

import math
import uuid
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.broadcast import Broadcast
from pyspark.sql import functions as F

from tripfold.llm.common import id_fold, table

#: Bytes that all languages together may learn from, and one of them at most.
MOST_BYTES, MOST_OF_ONE = 1_000_000, 60_000
#: A text is learned from in pieces of so many bytes, and parsed in pieces of so many.
LEARNED, PIECE = 600, 512
#: Pieces that are parsed side by side.
SIDE_BY_SIDE = 4_096

_BLANKS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def letters(text: str | None) -> bytes:
    """Lower-case UTF-8 with one blank for each run of ASCII characters that are no letters."""
    if text is None:
        return b""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANKS).split())


def has_letter(text: str | None, plain: bytes) -> bool:
    """Whether a character of the text is a letter; `plain` is its `letters`."""
    if text is None or not plain:
        return False
    return any(97 <= b < 123 for b in plain[:64]) or any(c.isalpha() for c in text)


def automaton(text: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix automaton of a text: its transitions as arrays of source, symbol, target.

    States are numbered from 0, the start; there are fewer than twice the text's length.
    """
    link, longest = array("q", [-1]), array("q", [0])
    moves: list[dict[int, int]] = [{}]
    last = 0
    for symbol in text:
        state = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and symbol not in moves[at]:
            moves[at][symbol] = state
            at = link[at]
        if at >= 0:
            target = moves[at][symbol]
            if longest[at] + 1 == longest[target]:
                link[state] = target
            else:
                twin = len(moves)
                moves.append(dict(moves[target]))
                longest.append(longest[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(symbol) == target:
                    moves[at][symbol] = twin
                    at = link[at]
                link[target] = link[state] = twin
        last = state
    count = [len(m) for m in moves]
    source = np.repeat(np.arange(len(moves), dtype=np.int32), count)
    symbol = np.fromiter((s for m in moves for s in m), np.uint8, len(source))
    target = np.fromiter((t for m in moves for t in m.values()), np.int32, len(source))
    return source, symbol, target


class LanguageModel:
    """Languages, those with more text first, and their automata as lists of transitions.

    `learned` has for each name the bytes learned from and the automaton, `held` the bytes there were.
    """

    def __init__(self, learned: dict[str, tuple[int, np.ndarray, np.ndarray, np.ndarray]], held: dict[str, int]) -> None:
        self.names = sorted(learned, key=lambda name: (-held[name], name))
        self.number = uuid.uuid4().hex
        self.bits = np.array([math.log2(learned[n][0] + 1) for n in self.names])
        self.parts = [learned[n][1:] for n in self.names]

    def dense(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A table of states by symbols, the symbol of each byte, and each language's first state.

        An entry is the place of the next state's row, doubled, plus one where a phrase starts: at a
        byte that cannot continue the phrase, and at any byte after the start. Symbol 0 is the end of
        a piece, symbol 1 a byte that no language has.
        """
        bytes_seen = np.unique(np.concatenate([symbol for _, symbol, _ in self.parts]))
        symbols = np.ones(256, np.int64)
        symbols[bytes_seen] = np.arange(2, 2 + len(bytes_seen))
        width, sizes = 2 + len(bytes_seen), [int(s.max(initial=0)) + 1 for s, _, _ in self.parts]
        sizes = [max(n, int(t.max(initial=0)) + 1) for n, (_, _, t) in zip(sizes, self.parts, strict=True)]
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        made = np.empty((sum(sizes), width), np.int32)
        for begin, size, (source, symbol, target) in zip(first.tolist(), sizes, self.parts, strict=True):
            restart = np.full(width, begin * width * 2 + 1, np.int32)
            restart[0] = begin * width * 2
            at_start = source == 0
            restart[symbols[symbol[at_start]]] = (begin + target[at_start]) * width * 2 + 1
            made[begin : begin + size] = restart
            made[begin + source[~at_start], symbols[symbol[~at_start]]] = (begin + target[~at_start]) * width * 2
        return made.reshape(-1), symbols, first * width


_DENSE: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _dense(model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The model's table, made once in a Python worker."""
    if model.number not in _DENSE:
        _DENSE.clear()
        _DENSE[model.number] = model.dense()
    return _DENSE[model.number]


def phrases(model: LanguageModel, texts: Sequence[bytes]) -> np.ndarray:
    """How many phrases of each language (columns) the texts (rows) are parsed into.

    A text is parsed in pieces of PIECE bytes, all of them, and no phrase crosses from one to the
    next, so that many pieces and long texts go forward together.
    """
    made, symbols, first = _dense(model)
    total = np.zeros((len(texts), len(model.names)), np.int64)
    pieces = [(i, t[p : p + PIECE]) for i, t in enumerate(texts) for p in range(0, len(t), PIECE)]
    # Pieces of like length go together, so that none waits for longer ones.
    pieces.sort(key=lambda piece: len(piece[1]))
    for begin in range(0, len(pieces), SIDE_BY_SIDE):
        group = pieces[begin : begin + SIDE_BY_SIDE]
        longest = len(group[-1][1])
        joined = b"".join(p.ljust(longest, b"\0") for _, p in group)
        grid = symbols[np.frombuffer(joined, np.uint8).reshape(len(group), longest)]
        # No byte of a text is 0; this one stands for the end.
        grid[np.frombuffer(joined, np.uint8).reshape(grid.shape) == 0] = 0
        state = np.repeat(first, len(group)).reshape(len(first), len(group))
        count = np.zeros(state.shape, np.int64)
        for column in np.ascontiguousarray(grid.T):
            step = made.take(state + column).astype(np.int64)
            count += step & 1
            state = step >> 1
        np.add.at(total, [i for i, _ in group], count.T)
    return total


def identify(model: LanguageModel, texts: Sequence[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of each text, and a score: the runner-up's part of the two least entropies.

    The score is 0.5 where two languages do equally well and nearer to 1 the clearer the winner is; it
    is 1 where only one language is learned. Ties go to the language with more labelled text, then to
    the lesser name. A text without letters is `und`, with score 0, and so is everything where nothing
    is learned.
    """
    plain = [letters(t) for t in texts]
    known = np.array([has_letter(t, p) for t, p in zip(texts, plain, strict=True)], bool)
    names, score = np.full(len(texts), "und", object), np.zeros(len(texts))
    if not model.names or not known.any():
        return names.tolist(), score
    asked = np.flatnonzero(known)
    cost = phrases(model, [plain[i] for i in asked]) * model.bits
    names[asked] = np.array(model.names, object)[np.argmin(cost, axis=1)]
    if len(model.names) == 1:
        score[asked] = 1.0
    else:
        least = np.partition(cost, 1, axis=1)[:, :2]
        score[asked] = least[:, 1] / least.sum(axis=1)
    return names.tolist(), score


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for name, body in batch[["name", "body"]].itertuples(index=False):
            plain = letters(body)
            out += [(name, plain[p : p + LEARNED]) for p in range(0, len(plain), LEARNED)]
        yield pd.DataFrame(out, columns=["name", "piece"])


def _learned(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """The automaton of a language, from its pieces in order of their hash up to `most` bytes."""
    group = group.sort_values(["order", "piece"], kind="stable")
    text = b" ".join(group["piece"])[:most]
    made = automaton(text)
    return pd.DataFrame([(group["name"].iloc[0], len(text), *(a.tobytes() for a in made))], columns=_MODEL)


_MODEL = ["name", "size", "source", "symbol", "target"]


def train(
    docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", most: int = MOST_BYTES, most_of_one: int = MOST_OF_ONE
) -> LanguageModel:
    """A model from the rows for which `learn` holds and lang is not NULL.

    Each language learns from an equal number of bytes, as far as it has them: `most_of_one` at most,
    and `most` for all languages together. They are drawn by hash, first texts and then pieces of
    texts, equal texts once; a language with less text gives all of it. Sizes are counted over all
    rows. Empty and NULL texts teach nothing. The automata come to the driver, 30 bytes for each byte
    learned at most, and from there to all tasks.
    """
    rows = docs.where(F.coalesce(learn, F.lit(False)) & F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("name"), F.col(text).alias("body")
    )
    held = rows.groupBy("name").agg(F.sum(F.octet_length("body").cast("long")).alias("held"))
    counted = held.agg(F.count("*")).first()[0]
    if not counted:
        return LanguageModel({}, {})
    each = max(1, min(most_of_one, most // counted))

    def drawn(rows: DataFrame, column: str, salt: str, size: Column) -> DataFrame:
        """Rows of each language that hold about `size` bytes of `held`, by the hash of a column."""
        place = F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(1 << 30)) / F.lit(1 << 30)
        return rows.where(place < size / F.col("held")).withColumn("order", place)

    # Texts of twenty times what is learned, so that a few long texts are not all of it.
    sized = rows.join(F.broadcast(held) if counted <= 10_000 else held, "name")
    texts = drawn(sized, "body", "texts", F.lit(20.0 * each))
    texts = texts.select("name", "body").distinct()
    pieces = texts.mapInPandas(_pieces, "name string, piece binary").distinct()
    pieces = pieces.join(pieces.groupBy("name").agg(F.sum(F.octet_length("piece").cast("long")).alias("held")), "name")
    chosen = drawn(pieces, "piece", "pieces", F.lit(1.3 * each) + 10 * LEARNED).select("name", "piece", "order")
    made = chosen.groupBy("name").applyInPandas(
        lambda group: _learned(group, each), "name string, size long, source binary, symbol binary, target binary"
    )
    found = made.join(held, "name").collect()
    learned = {
        r["name"]: (r["size"], np.frombuffer(r["source"], np.int32), np.frombuffer(r["symbol"], np.uint8), np.frombuffer(r["target"], np.int32))
        for r in found
    }
    return LanguageModel(learned, {r["name"]: r["held"] for r in found})


def language_column(text: Column, model: Broadcast) -> Column:
    """lang_pred and score of a text as a struct; see `identify`."""

    @F.pandas_udf("lang_pred string, score double")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            names, score = identify(model.value, part.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": score})

    return told(text)


def document_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; two thirds of the ids are learned from. A NULL id is not."""
    docs = table(spark, sf_dir, "documents")
    fold = id_fold("doc_id", 3)
    model = spark.sparkContext.broadcast(train(docs, fold != 1))
    told = docs.select("doc_id", language_column(F.col("text"), model).alias("told"))
    return told.select("doc_id", F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "told.lang_pred", "told.score")
