"""What learns or searches does so over all that it is given."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from tripfold.llm import pieces, queries, toxicity


def made_word(kind, i):
    return hashlib.sha256(f"{kind}{i}".encode()).hexdigest()[:10]


def texts_with_rare_words(n, words):
    """(id, text, toxic): every fourth text is toxic and has one of many words, each in two texts only."""
    calm = ["river", "stone", "green", "walks", "under", "seven"]
    for i in range(n):
        toxic = int(i % 4 == 0)
        own = made_word("vile" if toxic else "calm", i // 4 % words if toxic else i % (3 * words))
        yield i, " ".join([*(calm[(i + j) % 6] for j in range(8)), own, own]), toxic


def test_toxicity_learns_from_all_labels(spark):
    """Words of a few texts each are known wherever those texts lie; a sample of `limit` texts lacks most."""
    rows = list(texts_with_rare_words(1200, 150))
    table = spark.createDataFrame([(i, t, "en" if i % 3 else None, m) for i, t, m in rows], "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(table.repartition(5), table.select("doc_id", "toxic"), limit=200)
    buckets = toxicity.Buckets()
    scores = model.scores([toxicity.codes(t, buckets) for _, t, _ in rows])
    marks = np.array([m for *_, m in rows]) == 1
    assert ((scores >= 0.7) == marks).mean() > 0.9 and (scores >= 0.7)[marks].mean() > 0.8
    assert set(model.by_language) == {"None", "en"}
    # The same from other partitions.
    again = toxicity.train(table.repartition(2), table.select("doc_id", "toxic"), limit=200)
    assert np.allclose(again.scores([toxicity.codes(t, buckets) for _, t, _ in rows]), scores, atol=1e-5)


def test_toxicity_thresholds_come_from_all_texts_aside(spark, monkeypatch):
    rows = list(texts_with_rare_words(1200, 150))
    table = spark.createDataFrame([(i, t, "en", m) for i, t, m in rows], "doc_id long, text string, lang string, toxic int")
    seen, find = [], toxicity.cells_threshold
    monkeypatch.setattr(toxicity, "cells_threshold", lambda c, d: seen.append((c["n"].sum(), c["hits"].sum())) or find(c, d))
    toxicity.train(table, table.select("doc_id", "toxic"), limit=200)
    aside = table.where(F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(5)) == 0)
    assert seen == 2 * [(aside.count(), aside.where("toxic = 1").count())]


def test_toxicity_cells_give_the_threshold_of_single_logits():
    import pandas as pd

    rng = np.random.default_rng(1)
    logits, marks = np.sort(rng.normal(size=300)), rng.random(300) < 0.3
    cells = pd.DataFrame({"low": logits, "high": logits, "hits": marks.astype(int), "n": 1})
    assert toxicity.cells_threshold(cells, 9.0) == toxicity.threshold(logits, marks, 9.0)
    assert toxicity.cells_threshold(cells[marks], 9.0) == 9.0


def test_toxicity_of_shards_with_repeats_and_one_label(spark):
    """An id that repeats counts once; labels of one kind give that side, also when there are many."""
    rows = [(1, f"copy {i % 7}") for i in range(100)] + [(i, f"text {i}") for i in range(2, 60)] + [(None, "nobody")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.range(1, 60).select(F.col("id").alias("doc_id"), F.lit(1).alias("toxic"))
    model = toxicity.train(docs, labels, limit=10)
    assert (model.scores([toxicity.codes(t, toxicity.Buckets()) for t in ("text 3", "")]) >= 0.7).all()
    none = toxicity.train(docs, labels.withColumn("toxic", F.lit(0)), limit=10)
    assert (none.scores([toxicity.codes("text 3", toxicity.Buckets())]) < 0.7).all()


def test_op9_query_as_registered(spark, tmp_path):
    rows = list(texts_with_rare_words(400, 10))
    table = spark.createDataFrame([(i, t, "en", m) for i, t, m in rows], "doc_id long, text string, lang string, toxic int")
    table.select("doc_id", "text", "lang").write.parquet(f"{tmp_path}/documents.parquet")
    table.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op9_toxicity(spark, str(tmp_path)).join(table, "doc_id").collect()
    assert len(got) == 400 and np.mean([r.predicted == r.toxic for r in got if r.held_out]) > 0.9


def test_op10_query_chooses_among_cells(spark, tmp_path):
    """Four samples: from the third on the search has several cells to choose from."""
    rows = [(1, "the cat sat on a mat"), (2, None), (3, ""), (4, "a" * 40), (None, "é ▁ 🎉  two words"), (6, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op10_pieces(spark, str(tmp_path)).collect()
    assert all(r.decoded for r in got)
    for i, n in ((1, 4), (2, 1), (3, 1), (4, 4), (None, 4), (6, 2)):
        mine = sorted((r for r in got if r.doc_id == i), key=lambda r: r.sample)
        assert [r.sample for r in mine] == list(range(1, len(mine) + 1)) and len({r.ids_digest for r in mine}) == len(mine)
        assert len(mine) == n and [r.perturbed for r in mine] == sorted((r.perturbed for r in mine), reverse=True)


def test_pieces_third_draw_is_without_replacement():
    vocab = pieces.Vocabulary.load()
    (every,) = pieces.sampled([(0, "cats")], 1000, "z", vocab)
    p = {tuple(r[1].tolist()): float(np.exp(r[2])) for r in every}
    assert abs(sum(p.values()) - 1) < 1e-9
    n, third = 4000, dict.fromkeys(p, 0.0)
    for samples in pieces.sampled(((i, "cats") for i in range(n)), 4, "z", vocab):
        third[tuple(samples[2][1].tolist())] += 1 / n
    for key in sorted(p, key=p.get)[-3:]:
        others = [(a, b) for a in p for b in p if len({a, b, key}) == 3]
        want = sum(p[a] * p[b] / (1 - p[a]) * p[key] / (1 - p[a] - p[b]) for a, b in others)
        assert abs(third[key] - want) < 0.03


def test_pieces_do_not_depend_on_blocks(monkeypatch):
    """Lattices are kept from block to block; samples are those of one block with its own."""
    vocab = pieces.Vocabulary.load()
    rows = [(i, f"word{i % 7} é▁{i} 🎉 the  cat {'y' * (i % 5)}") for i in range(60)] + [(99, None)]

    def found():
        return [[(r[0], r[1].tobytes(), *r[2:]) for r in s] for s in pieces.sampled(rows, 4, "z", vocab)]

    whole = found()
    for block, kept, walks in ((50, 1 << 19, 7), (50, 100, 1 << 14)):
        monkeypatch.setattr(pieces, "BLOCK", block)
        monkeypatch.setattr(pieces, "KEPT", kept)
        monkeypatch.setattr(pieces, "WALKS", walks)
        assert found() == whole
    assert vocab.spells(np.array([], np.int32), "") and not vocab.spells(np.array([], np.int32), "a")


def test_pieces_of_words_met_again_are_not_built_again(monkeypatch):
    """when lattices are many, only words of one block are forgotten; common ones are built once."""
    vocab, built, real = pieces.Vocabulary.load(), [], pieces.Lattices.__init__

    def counted(self, distinct, vocab):
        built.extend(distinct)
        real(self, distinct, vocab)

    common = "the cat sat on a mat, é ▁ 🎉"
    rows = [(i, f"{common} rare{i}{'q' * (i % 3)}  two {i * i}") for i in range(80)] + [(99, None), (None, "x")]
    whole = [[(r[0], r[1].tobytes(), *r[2:]) for r in s] for s in pieces.sampled(rows, 4, "z", vocab)]
    monkeypatch.setattr(pieces, "BLOCK", 100)
    monkeypatch.setattr(pieces, "KEPT", 150)
    monkeypatch.setattr(pieces.Lattices, "__init__", counted)
    found = [[(r[0], r[1].tobytes(), *r[2:]) for r in s] for s in pieces.sampled(rows, 4, "z", vocab)]
    assert found == whole
    assert max(built.count(" " + w) for w in common.split(" ")) == 1 and built.count(" rare5qq") == 1


def test_pieces_lattices_chosen_are_those_built_alone():
    vocab = pieces.Vocabulary.load()
    words = [" the", "  cat", " é▁🎉\n", " ", " internationalization", " \ud800x", " zzz", *(f" w{i}ing" for i in range(200))]
    every = pieces.Lattices(words[:4], vocab).with_more(pieces.Lattices(words[4:], vocab))
    for chosen in ([0, 2, 5], [6], list(range(207)), [3, 1, *range(9, 200, 7)]):
        drawn = []
        for some in (every.only(np.array(chosen)), pieces.Lattices([words[i] for i in chosen], vocab)):
            edges, counts = some.walk(some.start.repeat(200), pieces.mixed(np.arange(200 * len(chosen), dtype=np.uint64)))
            drawn.append([x.tolist() for x in (counts, some.piece[edges], some.log_prob[edges], some.before[edges])])
        assert drawn[0] == drawn[1]


def test_pieces_walk_is_the_plain_draw():
    """Edge by edge from the first: the one within whose probability the number falls."""
    vocab = pieces.Vocabulary.load()
    words = [" the", " international\n", " é▁🎉", " aaaaaaaaaaaaaaaa"] * 300
    lattices = pieces.Lattices(words, vocab)
    seed = pieces.mixed(np.arange(len(words), dtype=np.uint64))
    edges, counts = lattices.walk(lattices.start, seed)
    want = []
    for node, s in zip(lattices.start.tolist(), seed, strict=True):
        draws = pieces.stream(int(s))
        while node >= 0:
            left, edge = next(draws), int(lattices.first[node])
            while edge < lattices.first[node + 1] - 1 and left >= np.exp(lattices.log_prob[edge]):
                left -= np.exp(lattices.log_prob[edge])
                edge += 1
            want.append(edge)
            node = int(lattices.to[edge])
    assert edges.tolist() == want and counts.sum() == len(want)


def test_pieces_spelling_is_compared_byte_by_byte():
    vocab = pieces.Vocabulary.load()
    for text in ("the internationalization of é▁🎉\n  ok", " ", "x" * 100, "responsibility\x00", "\ud800 lone"):
        ((first, *_),) = pieces.sampled([(1, text)], 1, "z", vocab)
        ids = first[1]
        assert vocab.spells(ids, text) and vocab.spells(ids, text, pieces.in_eights(text))
        for n in range(1, len(text) + 1):
            assert not vocab.spells(ids, text[: n - 1] + chr(ord(text[n - 1]) ^ 1) + text[n:])
        assert not vocab.spells(ids, text + "a") and not vocab.spells(ids, text[:-1]) and not vocab.spells(ids[:-1], text)
