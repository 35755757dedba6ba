"""A convolutional text classifier on hashed word embeddings, trained in numpy.

Few labelled texts are learned from at once. Many are dealt into shards: in each round every shard goes on
from the same network over its own texts, and the networks' mean is what the next round starts from. A
word's vector is averaged over the shards that have the word, by how often they moved it.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tripfold.llm.common import by_bytes, checkpoint, one_text_each, sigmoid, utf8_words

#: Buckets of words and of their beginnings; a word's vector is the sum of both.
WORDS, STEMS = 1 << 14, 1 << 12
STEM = 4
DIM, FILTERS, WIDTHS = 16, 12, (1, 2, 3)
#: Rows without a word behind every text, so that no filter reaches into the next one.
PAD = max(WIDTHS) - 1
#: Characters scored at once.
BLOCK = 1 << 20
#: Texts of one step, passes over all shards, and tasks that train them at most.
BATCH, ROUNDS, TASKS = 32, 6, 256
#: Logits of many texts are told apart to a 1024th when thresholds are looked for.
CELLS = 1 << 10
_EDGES = b".,;:!?\"'()[]{}*$%&#|"


class Buckets(dict):
    """Word to its two buckets in one number; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        core = word.strip(_EDGES) or word
        stem = core.decode("utf-8", "replace")[:STEM].encode()
        code = zlib.crc32(core) % WORDS * STEMS + zlib.crc32(stem, 1) % STEMS
        self[word] = code
        return code


def codes(text: str | None, buckets: Buckets) -> np.ndarray:
    words = utf8_words(text)
    return np.fromiter(map(buckets.__getitem__, words), np.int32, len(words))


def joined(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All codes with padding (-1) behind each text, and where each text starts."""
    sizes = np.array([len(t) + PAD for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    out = np.full(int(sizes.sum()) + PAD, -1, np.int32)
    for start, text in zip(starts, texts, strict=True):
        out[start : start + len(text)] = text
    return out, starts


@dataclass
class Network:
    words: np.ndarray
    stems: np.ndarray
    filters: list[np.ndarray]
    out: np.ndarray
    bias: float = 0.0

    @classmethod
    def fresh(cls, rng: np.random.Generator) -> Network:
        def drawn(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        return cls(
            drawn(WORDS + 1, DIM, scale=0.1),
            drawn(STEMS + 1, DIM, scale=0.1),
            [drawn(k, DIM, FILTERS, scale=1 / math.sqrt(k * DIM)) for k in WIDTHS],
            drawn(FILTERS * len(WIDTHS), scale=0.3),
        )

    def vectors(self, text: np.ndarray) -> np.ndarray:
        """The last row of either table is zero: padding."""
        x = self.words[np.where(text < 0, WORDS, text // STEMS)]
        x += self.stems[np.where(text < 0, STEMS, text % STEMS)]
        x[text < 0] = 0
        return x

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        n = len(x) - PAD
        return [sum(x[t : t + n] @ w[t] for t in range(len(w))) for w in self.filters]

    def pooled(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Each filter's largest response in each text, 0 at least."""
        x = self.vectors(text)
        made = self.responses(x)
        tops = [np.maximum.reduceat(r, starts, axis=0) for r in made]
        return np.maximum(np.concatenate(tops, axis=1), 0), x, made

    def logits(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        return (self.pooled(*joined(texts))[0] @ self.out + self.bias).astype(np.float64)


class Adam:
    def __init__(self, rate: float):
        self.rate, self.seen, self.state = rate, 0, {}

    def move(self, name: str, value: np.ndarray, grad: np.ndarray) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        size = self.rate * math.sqrt(1 - 0.99**self.seen) / (1 - 0.9**self.seen)
        value -= size * m / (np.sqrt(v) + 1e-8)


def fresh_squares() -> dict[str, np.ndarray]:
    return {"words": np.full(WORDS + 1, 1e-6, np.float32), "stems": np.full(STEMS + 1, 1e-6, np.float32)}


def descend(
    net: Network, squares: dict[str, np.ndarray], texts: Sequence[np.ndarray], marks: np.ndarray, share: float, passes: int, rng: np.random.Generator, batch: int = BATCH
) -> dict[str, np.ndarray]:
    """Moves the network by passes over the texts; how often each word and stem was moved.

    Logistic loss, the rarer label weighted up; gradients flow through each filter's best place.
    """
    adam = Adam(0.01)
    moves = {"words": np.zeros(WORDS + 1, np.float32), "stems": np.zeros(STEMS + 1, np.float32)}
    bias = np.array([net.bias])
    for _ in range(passes):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            adam.seen += 1
            text, starts = joined([texts[i] for i in some])
            top, x, made = net.pooled(text, starts)
            wanted = marks[some]
            weight = np.where(wanted, 0.5 / share, 0.5 / (1 - share))
            error = (weight * (sigmoid(top @ net.out + bias[0]) - wanted) / len(some)).astype(np.float32)
            back = error[:, None] * net.out * (top > 0)
            adam.move("out", net.out, top.T @ error + 1e-4 * net.out)
            adam.move("bias", bias, np.array([error.sum()]))
            dx = np.zeros_like(x)
            sizes = np.diff(np.r_[starts, len(text) - PAD])
            which = np.repeat(np.arange(len(some)), sizes)
            for f, w in enumerate(net.filters):
                lanes = slice(f * FILTERS, (f + 1) * FILTERS)
                place, lane = np.nonzero((made[f] == top[:, lanes][which]) & (back[:, lanes][which] != 0))
                _, once = np.unique(which[place] * FILTERS + lane, return_index=True)
                place, lane = place[once], lane[once]
                g = back[:, lanes][which[place], lane]
                dw = np.zeros_like(w)
                for t in range(len(w)):
                    np.add.at(dw[t].T, lane, g[:, None] * x[place + t])
                    np.add.at(dx, place + t, g[:, None] * w[t][:, lane].T)
                adam.move(f"filter{f}", w, dw + 1e-4 * w)
            live = np.flatnonzero(dx.any(axis=1) & (text >= 0))
            for name, rows in (("words", text[live] // STEMS), ("stems", text[live] % STEMS)):
                table = getattr(net, name)
                used, back_to = np.unique(rows, return_inverse=True)
                grad = np.zeros((len(used), DIM), np.float32)
                np.add.at(grad, back_to, dx[live])
                moves[name][used] += 1
                squares[name][used] += (grad**2).mean(axis=1)
                table[used] -= 0.05 * grad / np.sqrt(squares[name][used])[:, None]
    net.bias = float(bias[0])
    return moves


def balance(marks_mean: float) -> float:
    return min(0.9, max(0.1, marks_mean))


def train_network(texts: Sequence[np.ndarray], marks: np.ndarray, epochs: int = 6, steps: int = 800, batch: int = BATCH, seed: int = 3) -> Network:
    """At least `epochs` passes, and as many as `steps` batches take."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    share = balance(float(marks.mean()))
    net.bias = math.log(share / (1 - share))
    descend(net, fresh_squares(), texts, marks, share, max(epochs, -(-steps * batch // len(texts))), rng, batch)
    return net


def threshold(logits: np.ndarray, marks: np.ndarray, default: float) -> float:
    """Where the fewest marks are wrong, a missed one counting twice; the widest such gap's middle.

    `default` where only one label is seen.
    """
    if not len(logits) or marks.all() or not marks.any():
        return default
    order = np.argsort(logits, kind="stable")
    ranked, hits = logits[order], marks[order]
    wrong = np.r_[0, 2 * np.cumsum(hits)] + np.r_[np.cumsum(~hits[::-1])[::-1], 0]
    edges = np.r_[ranked[0] - 1, (ranked[1:] + ranked[:-1]) / 2, ranked[-1] + 1]
    room = np.r_[0, np.diff(ranked), 0]
    best = np.flatnonzero(wrong == wrong.min())
    return float(edges[best[np.argmax(room[best])]])


def cells_threshold(cells: pd.DataFrame, default: float) -> float:
    """The same of counted cells (`low, high, hits, n`, ascending): between two of them, or outside."""
    low, high, hits = cells["low"].to_numpy(), cells["high"].to_numpy(), cells["hits"].to_numpy()
    misses = cells["n"].to_numpy() - hits
    if not len(low) or not hits.any() or not misses.any():
        return default
    wrong = np.r_[0, 2 * np.cumsum(hits)] + np.r_[np.cumsum(misses[::-1])[::-1], 0]
    edges = np.r_[low[0] - 1, (low[1:] + high[:-1]) / 2, high[-1] + 1]
    room = np.r_[0, low[1:] - high[:-1], 0]
    best = np.flatnonzero(wrong == wrong.min())
    return float(edges[best[np.argmax(room[best])]])


@dataclass
class ToxicityModel:
    network: Network
    #: Logit that gets `at` as score, for all texts alike.
    cut: float
    #: Scores from which a text of a language is called toxic.
    by_language: dict[str, float]
    at: float

    def scores(self, texts: Sequence[np.ndarray]) -> np.ndarray:
        return sigmoid(self.network.logits(texts) - self.cut + math.log(self.at / (1 - self.at)))


def one_sided(toxic: bool, at: float, seed: int) -> ToxicityModel:
    """Where one label is all there is: every score lies on its side."""
    net = Network.fresh(np.random.default_rng(seed))
    net.out[:] = 0
    net.bias = 1.0 if toxic else -1.0
    return ToxicityModel(net, 0.0, {}, at)


def fit(texts: Sequence[np.ndarray], marks: np.ndarray, languages: Sequence[str | None], at: float = 0.7, seed: int = 3) -> ToxicityModel:
    """A network, and thresholds from a fifth of the texts that it is not trained on.

    Without both labels the network is not trained and every score lies on the only label's side.
    """
    rng = np.random.default_rng(seed)
    if not len(texts) or marks.all() or not marks.any():
        return one_sided(bool(len(texts) and marks.all()), at, seed)
    aside = rng.random(len(texts)) < 0.2
    if not (marks[aside].any() and marks[~aside].any() and not marks[~aside].all()):
        aside[:] = False
    net = train_network([t for t, a in zip(texts, aside, strict=True) if not a], marks[~aside], seed=seed)
    judged = aside if aside.any() else ~aside
    logits = net.logits([t for t, j in zip(texts, judged, strict=True) if j])
    known = marks[judged]
    cut = threshold(logits, known, 0.0)
    names = np.array([str(x) for x, j in zip(languages, judged, strict=True) if j])
    shift = math.log(at / (1 - at)) - cut
    by_language = {
        str(name): float(sigmoid(np.array([threshold(logits[names == name], known[names == name], cut) + shift]))[0])
        for name in np.unique(names)
    }
    return ToxicityModel(net, cut, by_language, at)


def blocks(parts: Iterator[pd.DataFrame], most_words: int) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[str]]]:
    """Shard, codes, marks and languages of consecutive rows of a shard, about `most_words` at most."""
    held: list[tuple] = []
    shard, words = -1, 0
    for part in parts:
        for row in zip(part["shard"], part["codes"], part["mark"], part["language"], strict=True):
            if held and (row[0] != shard or words + len(row[1]) > most_words):
                yield _block(held)
                held, words = [], 0
            held.append(row)
            shard, words = row[0], words + len(row[1])
    if held:
        yield _block(held)


def _block(held: list[tuple]) -> tuple[int, list[np.ndarray], np.ndarray, list[str]]:
    shards, texts, marks, languages = zip(*held, strict=True)
    return shards[0], [np.asarray(t, np.int32) for t in texts], np.array(marks) == 1, list(languages)


def packed(net: Network, squares: dict[str, np.ndarray], moves: dict[str, np.ndarray], weight: float) -> list[np.ndarray]:
    """Rows times their weight, with the weight behind them: words, stems, and one row of what is left."""
    out = []
    for name in ("words", "stems"):
        w = moves[name].astype(np.float64)[:, None]
        out.append(np.hstack([getattr(net, name) * w, squares[name][:, None] * w, w]))
    dense = np.concatenate([*(f.ravel() for f in net.filters), net.out, [net.bias]]).astype(np.float64)
    return [*out, np.r_[dense * weight, weight][None]]


def unpack(net: Network, squares: dict[str, np.ndarray], sums: Sequence[np.ndarray]) -> None:
    """Sums of what `packed` gives become the network; words that no shard moved stay."""
    for name, total in zip(("words", "stems"), sums, strict=False):
        live = np.flatnonzero(total[:, -1] > 0)
        mean = total[live, :-1] / total[live, -1:]
        getattr(net, name)[live], squares[name][live] = mean[:, :-1], mean[:, -1]
    dense = sums[2][0, :-1] / sums[2][0, -1]
    at = 0
    for w in net.filters:
        w[:] = dense[at : at + w.size].reshape(w.shape)
        at += w.size
    net.out[:], net.bias = dense[at:-1], float(dense[-1])


def one_round(rows: DataFrame, net: Network, squares: dict[str, np.ndarray], share: float, most_words: int, nth: int, seed: int) -> None:
    """Every shard's texts once, each shard from the network given; it becomes their networks' mean.

    A task sums its shards, and the tasks' sums meet table block by table block.
    """
    shared = rows.sparkSession.sparkContext.broadcast((net, squares))

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: list[np.ndarray] = []
        first = -1
        for n, (shard, texts, marks, _) in enumerate(blocks(parts, most_words)):
            own, own_squares = copy.deepcopy(shared.value)
            moves = descend(own, own_squares, texts, marks, share, 1, np.random.default_rng([seed, nth, shard, n]))
            found = packed(own, own_squares, moves, len(texts))
            first = shard if n == 0 else first
            sums = [a + b for a, b in zip(sums, found, strict=True)] if sums else found
        for table, total in enumerate(sums):
            for at, block in enumerate(np.array_split(total, min(len(total), 16))):
                yield pd.DataFrame({"kind": [table], "at": [at], "shard": [first], "body": [block.astype(np.float32).tobytes()]})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        total: np.ndarray | float = 0.0
        for body in group.sort_values("shard")["body"]:
            total = total + np.frombuffer(body, np.float32).astype(np.float64)
        return pd.DataFrame({"kind": group["kind"].iloc[:1], "at": group["at"].iloc[:1], "body": [np.asarray(total).tobytes()]})

    each = rows.mapInPandas(learn, "kind int, at int, shard long, body binary")
    found = each.groupBy("kind", "at").applyInPandas(merged, "kind int, at int, body binary").collect()
    ordered = sorted((r["kind"], r["at"], np.frombuffer(r["body"])) for r in found)
    widths = (DIM + 2, DIM + 2, -1)
    sums = [np.concatenate([body for kind, _, body in ordered if kind == k]) for k in range(3)]
    unpack(net, squares, [x.reshape(1, -1) if w < 0 else x.reshape(-1, w) for x, w in zip(sums, widths, strict=True)])
    shared.unpersist()


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Rows by shard, in an order of their own; a fifth is marked as not to be trained on."""
    drawn = {name: F.pmod(F.xxhash64("labelled", F.lit(name)), F.lit(n)) for name, n in (("shard", shards), ("aside", 5))}
    marked = rows.select("*", drawn["shard"].alias("shard"), (drawn["aside"] == 0).alias("aside"))
    return marked.repartition(min(shards, TASKS), "shard").sortWithinPartitions("shard", "labelled")


def fit_shards(rows: DataFrame, at: float, most_words: int, seed: int = 3) -> ToxicityModel:
    """The same as `fit` from any number of dealt texts; all that are not aside are trained on in each round.

    The rounds start from a network of the first shard's texts, the thresholds come from all texts aside.
    """
    counts = {(r["aside"], r["mark"]): r["count"] for r in rows.groupBy("aside", F.col("mark").cast("int").alias("mark")).count().collect()}
    toxic, total = sum(n for (_, m), n in counts.items() if m), sum(counts.values())
    if toxic in (0, total):
        return one_sided(bool(toxic), at, seed)
    parted = all(counts.get(k, 0) for k in ((True, 1), (False, 0), (False, 1)))
    learned, judged = (rows.where("NOT aside"), rows.where("aside")) if parted else (rows, rows)
    trained = {k: n for k, n in counts.items() if not (parted and k[0])}
    share = balance(sum(n for (_, m), n in trained.items() if m) / sum(trained.values()))

    so_far = F.sum(F.size("codes").cast("long")).over(Window.partitionBy("shard").orderBy("labelled"))
    first = learned.where("shard = 0").withColumn("so_far", so_far).where(F.col("so_far") <= most_words).toPandas()
    marks = first["mark"].to_numpy() == 1
    if marks.any() and not marks.all():
        net = fit([np.asarray(c, np.int32) for c in first["codes"]], marks, first["language"].tolist(), at, seed).network
    else:
        net = Network.fresh(np.random.default_rng(seed))
        net.bias = math.log(share / (1 - share))
    squares = fresh_squares()
    for nth in range(ROUNDS):
        one_round(learned, net, squares, share, most_words, nth, seed)

    shared = rows.sparkSession.sparkContext.broadcast(net)

    def judge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, texts, marks, languages in blocks(parts, BLOCK >> 3):
            yield pd.DataFrame({"language": languages, "logit": shared.value.logits(texts), "hit": marks.astype(np.int64)})

    told = judged.withColumn("language", F.coalesce("language", F.lit("None"))).mapInPandas(judge, "language string, logit double, hit long")
    cell = F.floor(F.col("logit") * CELLS).alias("cell")
    sums = F.min("logit").alias("low"), F.max("logit").alias("high"), F.sum("hit").alias("hits"), F.count("*").alias("n")
    cells = told.groupBy("language", cell).agg(*sums).toPandas().sort_values("cell")
    whole = cells.groupby("cell", as_index=False).agg({"low": "min", "high": "max", "hits": "sum", "n": "sum"})
    cut = cells_threshold(whole, 0.0)
    shift = math.log(at / (1 - at)) - cut
    by_language = {
        str(name): float(sigmoid(np.array([cells_threshold(own, cut) + shift]))[0]) for name, own in cells.groupby("language")
    }
    return ToxicityModel(net, cut, by_language, at)


def train(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    language: str = "lang",
    limit: int = 5_000,
    at: float = 0.7,
    most_words: int = 20_000_000,
) -> ToxicityModel:
    """A model from all labelled documents, whole ones of any length.

    Up to `limit` of them with at most `most_words` words are fitted at once, on the driver, as bucket numbers.
    More are dealt into shards of about that size at most, which tasks train. Labels other than 0 and 1
    and NULL keys count for nothing; of several labels the largest counts, of rows that repeat an id
    that of the smallest text hash.
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull())
        .groupBy(F.col(key).alias("labelled"))
        .agg(F.max(label).alias("mark"))
    )
    rows = docs.select(F.col(key).alias("labelled"), F.col(text).alias("body"), F.col(language).cast("string").alias("language"))

    @F.pandas_udf("array<int>")
    def coded(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for part in parts:
            yield pd.Series([codes(t, buckets) for t in part])

    columns = ["labelled", "mark", "language", "codes"]
    shards = -(-known.count() // limit)
    if shards > 1:  # too many ids to broadcast: numbers move instead of texts, one row per id
        rows = rows.where("labelled IS NOT NULL").select("labelled", F.xxhash64("body").alias("hash"), coded("body").alias("codes"), "language")
        first = F.min(F.struct("hash", "codes", "language")).alias("first")
        once = rows.groupBy("labelled").agg(first).select("labelled", "first.codes", "first.language")
        chosen = checkpoint(dealt(once.join(known, "labelled").select(columns), shards))
        return fit_shards(chosen, at, most_words)
    joined = one_text_each(rows.join(F.broadcast(known), "labelled"), ["labelled", "mark"], "body", "language")
    chosen = checkpoint(joined.select("labelled", "mark", "language", coded("body").alias("codes")))
    total = chosen.agg(F.sum(F.size("codes").cast("long"))).first()[0] or 0
    if total > most_words:
        return fit_shards(checkpoint(dealt(chosen, -(-total // most_words))), at, most_words)
    found = chosen.toPandas().sort_values("labelled", kind="stable")
    texts = [np.asarray(c, np.int32) for c in found["codes"]]
    return fit(texts, found["mark"].to_numpy() == 1, found["language"].tolist(), at)


def score_column(text: Column, model: ToxicityModel) -> Column:
    """0 to 1, higher for texts likelier toxic; NULL and empty texts have a score as well."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        buckets = Buckets()
        for part in parts:
            blocks = by_bytes(part, BLOCK)
            made = [model.scores([codes(t, buckets) for t in block]) for block in blocks]
            yield pd.Series(np.concatenate([np.empty(0), *made]))

    return scored(text)


def flagged(score: Column, language: Column, model: ToxicityModel) -> Column:
    """1 where the score reaches the threshold of the text's language; an unknown one has `at`."""
    limit = F.lit(model.at)
    for name, value in sorted(model.by_language.items()):
        limit = F.when(language == name, F.lit(value)).otherwise(limit)
    return (score >= limit).cast("int")
