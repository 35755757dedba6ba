"""Vectors far from the origin or of wide values; WARC files that do not depend on how rows lie; long labelled texts."""

import gzip
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import vectors
from tripfold.llm import bitslice, graph, toxicity, warc


@pytest.mark.parametrize("move", ["offset 1e3", "offset 1e4", "scale 1e20", "scale 1e-30", "far points"])
def test_graph_recall_wherever_the_points_lie(spark, move):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3_000, 16))
    kind, _, by = move.partition(" ")
    x = x + float(by) if kind == "offset" else x * float(by) if kind == "scale" else np.r_[x, rng.normal(size=(5, 16)) * 1e20]
    rows = vectors(spark, [(i, v.tolist(), 1, "s") for i, v in enumerate(x)])
    got = graph.nearest(rows, rows.where("vec_id % 20 = 0"), k=10).collect()
    assert len(got) == 10 * len(range(0, len(x), 20))
    hits = 0
    for q in range(0, len(x), 20):
        gap = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        gap[q] = np.inf
        mine = [r for r in got if r.query_id == q]
        assert all(r.score == gap[r.vec_id] or abs(r.score / gap[r.vec_id] - 1) < 1e-12 for r in mine)
        hits += len({r.vec_id for r in mine} & set(np.argsort(gap, kind="stable")[:10].tolist()))
    assert hits / len(got) >= 0.9


def test_wide_components_are_searched(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 4)) * rng.choice([1, 1e3, 3e6, 1e9], size=(200, 1))
    x[17] = [2.0**40, -1.5, 0, 3e6]
    x[18] = [-(2.0**40), 1.5, 1, 3e6]
    rows = vectors(spark, [(i, v.tolist(), 1, "s") for i, v in enumerate(x)])
    small = rows.where("forall(embedding, x -> abs(x) < 4)").select("vec_id")
    asked = rows.join(small, "vec_id").select(*rows.columns)
    got = bitslice.top_products(rows, asked, k=5).collect()
    whole = [[int(np.floor(c * 256)) for c in v] for v in x]
    queries = [r.vec_id for r in small.collect()]
    assert len(got) == 5 * len(queries) and len(queries) > 20
    for q in queries:
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in enumerate(whole) if i != q)[:5]
        assert sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) == [(n, i, -s) for n, (s, i) in enumerate(scored, 1)]


def test_a_score_that_is_no_long_fails(spark):
    rows = vectors(spark, [(i, [2.0**40, 2.0**40], 1, "s") for i in range(4)])
    with pytest.raises(Exception, match="no long"):
        bitslice.top_products(rows, rows, k=2).collect()


def test_warc_bytes_do_not_depend_on_the_layout(spark, tmp_path):
    """More rows than a range partitioner looks at; a third of them in one corner of the ids."""
    made = spark.range(50_000).selectExpr("IF(id % 3 = 0, id, id * id * 1000) AS page_id", "concat('u', id) AS url", "concat('<p>', id % 9000) AS html")
    made.write.parquet(str(tmp_path / "pages"))
    ids = spark.read.parquet(str(tmp_path / "pages"))
    names = []
    for n, layout in enumerate((ids, ids.repartition(7, "html"))):
        folder = tmp_path / str(n)
        names.append(sorted((r.name, r.records, r.bytes) for r in warc.write_pages(layout, str(folder), roll_bytes=400_000, shards=3).collect()))
    assert names[0] == names[1]
    for name, _, _ in names[0]:
        assert (tmp_path / "0" / name).read_bytes() == (tmp_path / "1" / name).read_bytes()
    held = [sum(r for name, r, _ in names[0] if name.startswith(f"pages-{s:06d}")) for s in range(3)]
    assert sum(held) == 50_000 and max(held) - min(held) <= 3


def test_cut_files_fail(spark, tmp_path):
    pages = spark.range(50).selectExpr("id AS page_id", "'u' AS url", "concat('<p>', id) AS html")
    manifest = warc.write_pages(pages, str(tmp_path / "w"), shards=1)
    (name,) = [r.name for r in manifest.collect()]
    assert warc.read_pages(manifest, str(tmp_path / "w")).count() == 50
    whole = (tmp_path / "w" / name).read_bytes()
    # Members of gzip, once: any reader of WARC files finds the records.
    assert gzip.decompress(whole).startswith(b"WARC/1.1\r\n") and gzip.decompress(whole).count(b"WARC-Type: response") == 50
    (tmp_path / "w" / name).write_bytes(whole[:-10])
    with pytest.raises(Exception, match="bytes of the manifest"):
        warc.read_pages(manifest, str(tmp_path / "w")).collect()
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.members(io.BytesIO(whole[:-10])))


def test_long_labelled_texts_are_learned_from(spark):
    """A text of more than 20,000 words is the only toxic one; the model knows its word."""
    rows = [(i, "calm words only here", "en", "a") for i in range(40)]
    rows += [(100, "calm " * 20_100 + "vile vile", "en", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") == 100).cast("int").alias("toxic"))
    model = toxicity.train(docs, labels)
    buckets = toxicity.Buckets()
    scores = model.scores([toxicity.codes(t, buckets) for t in ("vile vile", "calm words only here")])
    assert scores[0] > scores[1]
