"""Cross-parsing against the definition, and languages held out."""

import random

import pytest

from tests.llm.test_operators import docs_of
from tripfold.llm import language, queries


def parsed(learned, text):
    """Phrases of a text: the longest that `learned` holds, or a byte that it lacks."""
    at = count = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in learned:
            end += 1
        at, count = end, count + 1
    return count


def test_phrases_are_those_of_the_definition(monkeypatch):
    rng = random.Random(2)
    monkeypatch.setattr(language, "PIECE", 16)
    monkeypatch.setattr(language, "SIDE_BY_SIDE", 7)
    for _ in range(200):
        learned = {k: bytes(rng.choice(b"abc ") for _ in range(rng.randint(1, 60))) for k in ("x", "y", "z")}
        automata = {k: (len(v), *language.automaton(v)) for k, v in learned.items()}
        model = language.LanguageModel(automata, {k: 1 for k in learned})
        texts = [bytes(rng.choice(b"abcd ") for _ in range(rng.randint(0, 50))) for _ in range(12)]
        for text, found in zip(texts, language.phrases(model, texts).tolist(), strict=True):
            pieces = [text[p : p + 16] for p in range(0, len(text), 16)]
            assert found == [sum(parsed(learned[k], p) for p in pieces) for k in model.names]


WORDS = {
    "en": "the quick brown fox jumps over lazy dogs while others watch from behind some old wooden fence",
    "de": "der schnelle braune fuchs springt über faule hunde während andere hinter einem alten zaun zuschauen",
}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(4, 60))), lang, "a")
            for i in range(300) for lang in [("en", "en", "de")[i % 3]]]
    rows += [(1000, None, "en", "a"), (1001, "", "de", "a"), (1002, "12 !? 34", "en", "a"), (1003, "12 é", None, "a"),
             (1004, "The Fox" * 20_000, "en", "a"), (None, "the old fence", "en", "a"), (1005, "Ω漢字", "en", None)]
    rows += [(1006, "the lazy dogs", "de", "b")] * 40 + [(1007, "the lazy dogs", None, "b")] * 3
    return docs_of(spark, rows)


def test_languages_held_out(spark, spoken, tmp_path):
    spoken.write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op12_language(spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = found.collect()
    assert len(rows) == spoken.count() and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, queries.op12_language(spark, str(tmp_path)).collect()), key=repr)
    told = {r.doc_id: r for r in rows}
    lang = {r.doc_id: r.lang for r in spoken.collect()}
    held = [r for r in rows if r.held_out and r.doc_id < 300]
    assert len(held) > 60 and all(r.lang_pred == lang[r.doc_id] for r in held)
    assert [told[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and told[1000].score == 0
    assert told[1003].lang_pred in WORDS and told[1005].lang_pred in WORDS and told[1004].lang_pred == "en"
    assert told[None].held_out is False and all(0 <= r.score <= 1 for r in rows)


def test_little_to_learn_from(spark, spoken):
    from pyspark.sql import functions as F

    nothing = language.train(spoken, F.lit(False))
    assert language.identify(nothing, ["the fox", None])[0] == ["und", "und"]
    one = language.train(spoken, F.col("lang") == "en")
    names, score = language.identify(one, ["the fox", "Ω", "", "--"])
    assert names == ["en", "en", "und", "und"] and score.tolist() == [1, 1, 0, 0]
    assert language.train(spoken.limit(0), F.lit(True)).names == []
    few = language.train(spoken, F.lit(True), most=400, most_of_one=300)
    assert sorted(few.names) == ["de", "en"] and max(few.bits) <= 8


def test_no_bytes_beyond_the_limit(spark, spoken):
    from pyspark.sql import functions as F

    model = language.train(spoken, F.lit(True), most_of_one=1_000)
    assert max(model.bits) <= 10 and all(len(source) < 3_000 for source, _, _ in model.parts)
