"""The language model's scores against every probability written out, and on other layouts of the rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import docs_of
from tripfold.llm import lm
from tripfold.llm.common import id_fold

SHAPE = lm.Shape(head=60, frequent=24, growth=0.0, endings=8, dim=8, shard_tokens=1, steps=20, batch=128, noise=16)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "re") for b in ("ben", "dor", "fil", "gam", "hun", "jas")]
    others = [w[::-1] for w in words]

    def line(i):
        some = words if i % 2 else others
        return " ".join(rng.choice(some) if rng.random() < 0.95 else f"x{rng.randint(0, 99)}" for _ in range(rng.randint(1, 40)))

    rows = [(i, line(i), "en", "a") for i in range(300)]
    rows += [(301, None, None, None), (302, "", "en", "a"), (None, words[0], "en", "a"), (5, "Twice twice", "en", "a")]
    return docs_of(spark, rows)


def test_score_is_the_sum_of_normalised_token_probabilities(docs):
    out = id_fold("doc_id", 5) == 1
    texts = docs.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "text")
    learn = texts.where(~F.col("held_out"))
    counts = lm.count_words(learn)
    vocab = lm.vocabulary(counts, SHAPE)
    model = lm.train_pairs(lm.pair_counts(learn, vocab), vocab)
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    tables = [10.0 ** m.log10() for m in model.places]
    assert all(np.allclose(t.sum(axis=1), 1) for t in tables) and math.isclose(model.plain.sum(), 1)
    single = {w: i for i, w in enumerate(vocab.words[: SHAPE.frequent])}
    shared = [w for w in n if w not in single]

    def probability(words, at):
        def number(w):
            return single.get(w, SHAPE.ending(w))

        word = words[at]
        before = [number(words[at - 1 - place]) if at > place else 0 for place in range(SHAPE.places)]
        mine = number(word)
        total = SHAPE.mix[-1] * model.plain[mine] + sum(m * t[b, mine] for m, t, b in zip(SHAPE.mix, tables, before))
        if word in single:
            return total
        alike = [w for w in shared if SHAPE.ending(w) == mine]
        return total * (n.get(word, 0) + 0.5) / (sum(n[w] for w in alike) + 0.5 * (len(alike) + 1))

    got = lm.score_documents(docs, out, shape=SHAPE).collect()
    want = []
    for r in texts.collect():
        words = [*(r.text or "").encode().lower().split(), b""]
        want.append((r.doc_id or -1, len(words), sum(math.log10(probability(words, at)) for at in range(len(words)))))
    found = sorted((r.doc_id or -1, r.n_tokens, r.score) for r in got)
    assert len(found) == len(want) == 304
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:2] == b[:2] and math.isclose(a[2], b[2], rel_tol=1e-4)


def test_scores_do_not_depend_on_the_layout_and_gain_on_the_base(docs):
    out = id_fold("doc_id", 5) == 1
    made = [lm.score_documents(docs.repartition(parts), out, shape=SHAPE).collect() for parts in (1, 2, 8)]
    lists = [sorted((r.doc_id or -1, r.n_tokens, round(r.score, 6)) for r in rows) for rows in made]
    assert lists[0] == lists[1] == lists[2]
    held = [r for r in made[0] if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_long_texts_are_scored_in_parts_alike():
    rng = np.random.default_rng(2)
    models = [lm.Bilinear.fresh(np.full(12, 1 / 12), 4, seed=s) for s in (1, 2)]
    model = lm.Model(models, [m.totals(0, 12) for m in models], np.full(12, 1 / 12), (0.5, 0.4, 0.1))
    c = np.r_[0, rng.integers(0, 12, 70_000), 0]
    tables = [10.0 ** m.log10() for m in models]
    two = np.r_[0, c[:-2]]
    want = np.log10(0.5 * tables[0][c[:-1], c[1:]] + 0.4 * tables[1][two, c[1:]] + 0.1 / 12).sum()
    assert math.isclose(model.log10(c), want, rel_tol=1e-6)


def test_the_model_grows_with_the_tokens():
    shape = lm.Shape()
    sizes = [shape.grown(n).frequent for n in (0, 1_000_000, 100_000_000, 10**13)]
    assert sizes == [1_024, 2_000, 20_000, shape.most]
