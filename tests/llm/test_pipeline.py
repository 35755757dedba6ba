"""The pipeline on a small table, each stage against plain code over what its predecessor kept."""

import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_print, docs_of
from tripfold.llm import mixing, pieces

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Calm texts and loud ones, exact and near copies, secrets, NULLs, empty texts, repeated rows."""
    rng, folder = random.Random(3), tmp_path_factory.mktemp("corpus")
    words = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so", "ta") for b in ("ben", "dor", "fil", "gam", "hun", "jas")]
    calm = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(30, 90))) + ".", "en", f"s{i % 4}") for i in range(90)]
    loud = [(200 + i, f"LOUD!! WORDS!! {i}!! {i}!! *** $$$", "en", "s1") for i in range(40)]
    copies = [(300 + i, calm[i][1], "en", "s2") for i in range(10)] + [(320 + i, calm[40][1], "en", "s0") for i in range(15)]
    secret = [(400 + i, calm[60 + i][1] + f" password = hunter{i}secret42 and more of it", "en", "s3") for i in range(6)]
    odd = [(500, None, "en", "s1"), (501, "", "en", None), (None, calm[70][1] + " without id", "en", "s1"), (5, calm[5][1], "en", "s1")]
    rows = calm + loud + copies + secret + odd
    docs_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    marks = [(i, 1, 0) for i, *_ in calm] + [(i, 0, 0) for i, *_ in loud]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows


def stage(spark, folder, name, docs):
    """A stage's rows, written and read again as the pipeline does."""
    made = dict(corpus_pipeline.STAGES)[name](spark, docs, folder)
    path = f"{folder}/out-{name}"
    made.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def bag(rows):
    return Counter((r.doc_id, r.text) for r in rows)


def test_stages_and_run_against_plain_code(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    good = stage(spark, folder, "quality", docs)
    assert good.columns == docs.columns
    kept = good.collect()
    ids = {r.doc_id for r in kept}
    assert not ids & set(range(200, 240)) and set(range(90)) <= ids

    alone = stage(spark, folder, "near_duplicates", good).collect()
    prints = sorted({brute_print(r.text, 3) for r in kept})
    group = {p: {p} for p in prints}
    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3 and group[a] is not group[b]:
                group[a] |= group[b]
                for p in group[a]:
                    group[p] = group[a]
    assert len(alone) == len({id(group[p]) for p in prints}) < len(kept)
    assert len({id(group[brute_print(r.text, 3)]) for r in alone}) == len(alone)

    unique = spark.read.parquet(f"{folder}/out-near_duplicates")
    clean = stage(spark, folder, "secrets", unique).collect()
    pattern = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]{6,})"
    want = Counter((r.doc_id, r.text and re.sub(pattern, "<SECRET>", r.text)) for r in alone)
    assert bag(clean) == want and any(t and "<SECRET>" in t for _, t in want)

    mixed = stage(spark, folder, "mixing", spark.read.parquet(f"{folder}/out-secrets")).collect()
    frame = pd.DataFrame([(r.doc_id, r.text, r.source) for r in clean], columns=["doc_id", "text", "source"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", frame)
    taken = {None if pd.isna(i) else int(i): (n, t) for i, n, t in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.TAKEN_SQL})").fetchall()}
    expected = Counter()
    for r in clean:
        size, words = taken[r.doc_id]
        if size:
            expected[r.doc_id, r.text] += words // size
            if words % size:
                expected[r.doc_id, " ".join(re.findall(WORD, r.text)[: words % size])] += 1
    assert bag(mixed) == +expected and max(expected.values()) > 1

    cut = pieces.decode(stage(spark, folder, "pieces", spark.read.parquet(f"{folder}/out-mixing"))).collect()
    texts = Counter((r.doc_id, r.decoded_text) for r in cut if r.sample == 1)
    assert texts == Counter((i, t or "") for i, t in bag(mixed).elements())

    whole = pieces.decode(corpus_pipeline.run(spark, folder)).collect()
    assert Counter((r.doc_id, r.sample, r.decoded_text) for r in whole) == Counter((r.doc_id, r.sample, r.decoded_text) for r in cut)


def test_an_empty_table(spark, corpus, tmp_path):
    folder, _ = corpus
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
