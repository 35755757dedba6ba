"""Examples and credentials, told by repositories and owners in both directions."""

import pytest

from tests.llm.test_operators import docs_of
from tripfold.llm import secrets

TOKEN = "aB3dE5fG7hJ9kL1mN3pQ5"


def table(spark, held):
    """held: value -> (number of repositories, owners in turn); and 600 documents without any."""
    rows = [(10_000 + i, f"plain text {i}", "en", f"s{i % 9}") for i in range(600)]
    for n, (value, (repos, owners)) in enumerate(held.items()):
        rows += [(1_000 * n + i, f"password = {value} end", "en", owners[i % len(owners)]) for i in range(repos)]
    return docs_of(spark, rows)


@pytest.mark.parametrize(
    "repos, owners, live",
    [
        (1, ["s1"], True),
        # Copied by its owner, or to a few places of several owners: still a credential.
        (6, ["s1"], True),
        (6, ["s1", "s2"], True),
        (3, ["s1", "s2", "s3"], True),
        # In many repositories of several owners: an example.
        (6, ["s1", "s2", "s3"], False),
        (30, ["s1", "s2", "s3", None], False),
        # So common that no one owns it, even in a single source.
        (40, ["s1"], False),
    ],
)
def test_what_counts_as_copied(spark, repos, owners, live):
    found = secrets.find_secrets(table(spark, {"hunter2secret": (repos, owners)})).where("n_assign > 0").collect()
    assert len(found) == repos and {r.n_live > 0 for r in found} == {live}
    # Base spans stay either way.
    assert {r.spans for r in found} == {"assign:0:24"}


def test_limits_grow_with_the_corpus():
    rule = secrets.Copied()
    assert rule.limits(100, 4) == (5, 3, 5)
    assert rule.limits(10**8, 10**6) == (500, 500, 10**6)


def test_tokens_and_redaction_follow(spark):
    docs = table(spark, {TOKEN: (2, ["s1"]), TOKEN[::-1]: (20, ["s1", "s2", "s3"])})
    texts = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert texts[0] == "<SECRET> end" and texts[1_000] == f"password = {TOKEN[::-1]} end"
    assert texts[10_000] == "plain text 0" and len(texts) == 622


def test_nulls_repeats_and_long_texts(spark):
    value = "password = hunter2secret"
    rows = [(None, value, "en", None), (None, value, "en", None), (5, value, None, "a"), (5, value, None, "a"), (6, None, "en", "a"),
            (7, "", "en", "a"), (8, "x " * 100_000 + value, "en", "b")]
    found = secrets.find_secrets(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id or 0, r.n_assign, r.n_live) for r in found) == [(0, 1, 1), (0, 1, 1), (5, 1, 1), (5, 1, 1), (6, 0, 0), (7, 0, 0), (8, 1, 1)]
    assert [r.spans for r in found if r.doc_id == 8] == ["assign:200000:200024"]
    assert secrets.find_secrets(docs_of(spark, rows).limit(0)).count() == 0
