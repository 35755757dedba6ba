"""Secrets in texts, told from copied examples by how many repositories and owners hold them."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripfold.llm.common import checkpoint

KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
_DIGIT = re.compile("[0-9]")
_MIXED = (re.compile("[a-z]"), re.compile("[A-Z]"), _DIGIT)
#: Bits per character from which a token looks drawn at random.
ENTROPY = 3.5

FOUND = "array<struct<start:long,kind:int,end:long,hash:string>>"


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value), by start and kind, of the three plain patterns."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [
            (m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6
        ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(found)


def token_spans(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Long tokens of mixed characters that look random and touch no span in `taken`."""
    if not any(len(w) >= 20 and _DIGIT.search(w) for w in text.split()):
        return []
    return [
        (m.start(), 3, m.end(), m[0])
        for m in _TOKEN.finditer(text)
        if all(p.search(m[0]) for p in _MIXED)
        and entropy(m[0]) >= ENTROPY
        and not any(s < m.end() and m.start() < e for s, _, e, _ in taken)
    ]


def span_list(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end, _ in spans)


def _scanned(text: str | None) -> tuple:
    base = base_spans(text or "")
    counts = Counter(kind for _, kind, _, _ in base)
    digest = hashlib.sha256(span_list(base).encode()).hexdigest()
    found = [
        {"start": s, "kind": k, "end": e, "hash": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()}
        for s, k, e, v in base + token_spans(text or "", base)
    ]
    return counts[0], counts[1], counts[2], digest, found


def scan(docs: DataFrame, key: str, text: str, owner: str, repo: str) -> DataFrame:
    """Candidates of every row, values as SHA-256 only, under a row number of their own."""
    columns = ["n_assign", "n_access", "n_hex", "base_sha256", "found"]

    def batch(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            made = pd.DataFrame([_scanned(t) for t in part["body"]], columns=columns)
            yield pd.concat([part[["doc_id", "owner", "repo", "body_hash"]].reset_index(drop=True), made], axis=1)

    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        F.col(owner).cast("string").alias("owner"),
        F.col(repo).cast("string").alias("repo"),
        F.xxhash64(F.col(text)).alias("body_hash"),
        F.col(text).alias("body"),
    )
    made = rows.mapInPandas(
        batch,
        "doc_id long, owner string, repo string, body_hash long, n_assign long, n_access long, "
        f"n_hex long, base_sha256 string, found {FOUND}",
    )
    return checkpoint(made.withColumn("row", F.monotonically_increasing_id()))


def ownership(candidates: DataFrame) -> DataFrame:
    """`hash, owners, repos`: who holds each candidate, over the whole corpus.

    Three groupings, each combined before its shuffle, so that a candidate found everywhere costs
    a row per task. A NULL owner or repository counts as one owner or repository.
    """
    held = candidates.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))


@dataclass(frozen=True)
class Copied:
    """When a candidate is a widely copied example, and not the credential of some owner.

    It is one if it is in many repositories of several owners: `least_repos` and `least_owners`, or
    `repo_root` and `owner_root` times the square root of the corpus' repositories and owners where
    those are more. So a credential that someone copied to a few places stays one, and what counts as
    many grows with the corpus. And it is one, whoever owns it, in `everywhere` of all repositories.
    """

    least_repos: int = 5
    least_owners: int = 3
    repo_root: float = 0.05
    owner_root: float = 0.5
    everywhere: float = 0.01

    def limits(self, repos: int, owners: int) -> tuple[int, int, int]:
        """Repositories and owners that make an example together, and repositories that do alone."""
        many = max(self.least_repos, math.ceil(self.repo_root * math.sqrt(repos)))
        several = max(self.least_owners, math.ceil(self.owner_root * math.sqrt(owners)))
        return many, several, max(many, math.ceil(self.everywhere * repos))


def totals(scanned: DataFrame) -> tuple[int, int]:
    """Repositories and owners of the corpus, counted to about a hundredth, the same on each run."""
    # A NULL counts as one, as in `ownership`.
    known = [F.approx_count_distinct(F.struct(c), 0.01).alias(c) for c in ("repo", "owner")]
    row = scanned.agg(*known).first()
    return row["repo"] or 0, row["owner"] or 0


def find_secrets(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    owner: str = "source",
    repo: str = "doc_id",
    copied: Copied = Copied(),
) -> DataFrame:
    """A row per row: counts and digest of the base spans, all spans, and which are live.

    A candidate is judged by its repositories and owners (see `Copied`): a copied example, or it looks
    live. Base spans are kept either way; a random-looking token is a span only if it looks live. `live` lists
    (start, end) of the spans that look live. NULL and empty texts have no span and empty lists;
    repeated rows give a row each; an empty table gives none. Other columns are not read.
    """
    scanned = scan(docs, key, text, owner, repo)
    each = scanned.select("row", "owner", "repo", F.explode("found").alias("s")).select(
        "row", "owner", "repo", "s.*"
    )
    stats = checkpoint(ownership(each))
    many, several, everywhere = copied.limits(*totals(scanned))
    example = ((F.col("repos") >= many) & (F.col("owners") >= several)) | (F.col("repos") >= everywhere)
    judged = each.join(stats, "hash").withColumn("is_live", ~example)
    judged = judged.where((F.col("kind") < 3) | F.col("is_live"))
    lists = checkpoint(
        judged.groupBy("row").agg(
            F.sort_array(F.collect_list(F.struct("start", "kind", "end", "is_live"))).alias("all")
        )
    )
    names = F.array(*map(F.lit, KINDS))
    shown = F.transform(
        "all",
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    live = F.transform(
        F.filter("all", lambda s: s["is_live"]),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
    )
    return scanned.join(lists, "row", "left").select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(F.array_join(shown, ","), F.lit("")).alias("spans"),
        F.coalesce(F.size(F.filter("all", lambda s: s["kind"] == 3)), F.lit(0)).cast("long").alias("n_token"),
        F.coalesce(F.size(live), F.lit(0)).cast("long").alias("n_live"),
        F.coalesce(live, F.array().cast("array<struct<start:long,end:long>>")).alias("live"),
        "body_hash",
    )


def cut_out(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """Text with every span replaced by `mark`; spans that touch or overlap give one mark."""
    out, at, open_end = [], 0, -1
    for start, end in sorted(spans):
        if start > open_end:
            out += [text[at:start], mark]
        open_end = max(open_end, end)
        at = open_end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "<SECRET>", copied: Copied = Copied()) -> DataFrame:
    """Documents without the secrets that look live; n_chars follows the text."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series(
            [cut_out(t, [(s["start"], s["end"]) for s in ss], mark) for t, ss in zip(texts, spans, strict=True)]
        )

    found = find_secrets(docs, copied=copied).where("n_live > 0")
    marks = checkpoint(
        found.groupBy(F.col("doc_id").alias("marked_id"), F.col("body_hash").alias("marked_text")).agg(
            F.first("live").alias("marked_spans")
        )
    )
    # Whole rows in one column, so that no other name of theirs meets the names made here.
    rows = docs.select(F.struct("*").alias("doc"))
    same = F.col("doc.doc_id").eqNullSafe(F.col("marked_id")) & (F.xxhash64("doc.text") == F.col("marked_text"))
    joined = rows.join(marks, same, "left")
    hit = F.col("marked_spans").isNotNull()
    body = F.col("doc.text")
    text = F.when(hit & body.isNotNull(), cleaned(F.coalesce(body, F.lit("")), F.coalesce("marked_spans", F.array().cast("array<struct<start:long,end:long>>")))).otherwise(body)
    new = joined.select("doc", hit.alias("hit"), text.alias("cleaned"))
    columns = {
        "text": F.col("cleaned"),
        "n_chars": F.when(F.col("hit"), F.length("cleaned").cast("long")).otherwise(F.col("doc.n_chars")),
    }
    return new.select(*(columns[c].alias(c) if c in columns else F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
