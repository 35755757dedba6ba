"""Merkle trees and proofs against plain loops."""

import hashlib
import random
import zlib

import pytest

from tests.llm.test_operators import docs_of
from tripfold.llm import merkle, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(leaves):
    found = [leaves]
    while len(found[-1]) > 1:
        found.append([sha("".join(found[-1][i : i + 2])) for i in range(0, len(found[-1]), 2)])
    return found


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def siblings(tree, at):
    """(sibling or None, whether it stands on the left) for each level."""
    found = []
    for level in tree[:-1]:
        found.append((level[at ^ 1] if at ^ 1 < len(level) else None, at % 2 == 1))
        at //= 2
    return found


def expected(rows):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, by the definition."""
    groups = {}
    for i, text, lang, source in rows:
        n = None if text is None else len(text)
        groups.setdefault(lang, []).append((i, leaf(i, source, lang, n, text), leaf(i, source, lang, None if n is None else n + 1, text)))
    names = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    for group in groups.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {name: levels([r[1] for r in groups[name]]) for name in names}
    top = levels([trees[name][-1][0] for name in names])
    out = []
    for t, name in enumerate(names):
        for at, (i, own, other) in enumerate(groups[name]):
            way = siblings(trees[name], at) + siblings(top, t)
            digest = other if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else own
            for sibling, left in way:
                digest = sha(digest if sibling is None else sibling + digest if left else digest + sibling)
            proof = sha("".join(s for s, _ in way if s))
            out.append((i, own, trees[name][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return out


def check(spark, rows, folder):
    docs_of(spark, rows).write.parquet(f"{folder}/documents.parquet")
    found = queries.op13_merkle(spark, str(folder))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(expected(rows), key=repr)


def test_manifest_of_a_hard_table(spark, tmp_path):
    rng = random.Random(1)
    rows = [(1, None, None, None), (2, "", "en", ""), (3, "é🎉 x", "en", "a"), (3, "é🎉 x", "en", "a"), (3, "other", "en", "a"),
            (None, "no id", "en", "a"), (None, None, None, "a"), (-5, "t" * 200_000, "é", "b"), (14, "x", "", "a")]
    rows += [(rng.randrange(10**12), f"text {i}", rng.choice(["de", "de", "de", "fr"]), "s") for i in range(700)]
    check(spark, rows, tmp_path)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 257])
def test_manifest_of_n_rows(spark, tmp_path, n):
    check(spark, [(i, f"t{i}", "en", "a") for i in range(n)], tmp_path)


def test_deep_trees_in_small_steps(spark, tmp_path, monkeypatch):
    """Blocks of four and chunks of two make every kind of join at a small size; half the rows are equal."""
    monkeypatch.setattr(merkle, "STEP", 2)
    monkeypatch.setattr(merkle, "CHUNK", 1)
    rows = [(i, f"t{i}", "en", "a") for i in range(150)] + [(7, "same", "en", "a")] * 170 + [(5, "x", None, None)]
    check(spark, rows, tmp_path)


def test_empty_table(spark, tmp_path):
    docs_of(spark, [(1, "a", "en", "a")]).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_merkle(spark, str(tmp_path)).count() == 0
