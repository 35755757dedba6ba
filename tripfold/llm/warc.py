"""A sharded WARC writer whose output depends on the records only, and its reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as store
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tripfold.llm.common import checkpoint, shared_dir

DATE = "2020-01-01T00:00:00Z"
MANIFEST = "name string, temporary string, records long, bytes long, first_id long, last_id long"
RECORDS = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
)


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own; the member carries no time."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    head = "\r\n".join(lines) + "\r\n\r\n"
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def page_record(page_id: int | None, nth: int, url: str, html: bytes, refers: tuple[int, str] | None) -> bytes:
    """A response with the payload, or a revisit with the HTTP headers only."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(html)}\r\n\r\n"
    ).encode()
    block = http if refers else http + html
    headers = [
        ("WARC-Type", "revisit" if refers else "response"),
        ("WARC-Record-ID", f"<urn:page:{'none' if page_id is None else page_id}:{nth}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        ("WARC-Payload-Digest", f"sha1:{sha1_base32(html)}"),
    ]
    if refers:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<urn:page:{refers[0]}:0>"),
            ("WARC-Refers-To-Target-URI", refers[1]),
        ]
    return record(headers, block)


def _plain(url: str | None) -> str:
    """A URL that cannot end its header line."""
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


def _fs(uri: str) -> tuple[store.FileSystem, str]:
    return store.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class Roller:
    """Writes records one after another into files of about `limit` compressed bytes."""

    def __init__(self, folder: str, shard: int, limit: int):
        self.fs, self.path = _fs(folder)
        self.shard, self.limit = shard, limit
        self.attempt = f"_temporary/{shard:06d}-{uuid.uuid4().hex}"
        self.fs.create_dir(f"{self.path}/{self.attempt}", recursive=True)
        self.out = None
        self.rolls = 0

    def add(self, data: bytes, page_id: int | None) -> dict | None:
        """Writes; the finished file's manifest row, if this record filled it."""
        if self.out is None:
            name = f"pages-{self.shard:06d}-{self.rolls:05d}.warc.gz"
            self.row = dict(
                name=name, temporary=f"{self.attempt}/{name}", records=0, bytes=0, first_id=page_id
            )
            self.out = self.fs.open_output_stream(f"{self.path}/{self.row['temporary']}", compression=None)
            self._write(record([
                ("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", DATE),
                ("WARC-Filename", name), ("Content-Type", "application/warc-fields"),
            ], b"format: WARC File Format 1.1\r\n"))
        self._write(data)
        self.row |= {"records": self.row["records"] + 1, "last_id": page_id}
        return self.close() if self.row["bytes"] >= self.limit else None

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.row["bytes"] += len(data)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out, self.rolls = None, self.rolls + 1
        return self.row


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """`page_id, sha, refers_to, refers_url` of the pages whose payload a larger page_id holds.

    Pages of a payload are counted and their largest id taken before any row moves; only payloads
    held more than once are joined back.
    """
    digests = checkpoint(
        pages.where("page_id IS NOT NULL").select(
            "page_id", "url", "sha", F.octet_length("html").alias("size")
        )
    )
    groups = digests.where(F.col("size") >= min_bytes).groupBy("sha").agg(
        F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("top")
    )
    many = checkpoint(
        groups.where("n > 1").select(
            "sha", F.col("top.page_id").alias("refers_to"), F.col("top.url").alias("refers_url")
        )
    )
    found = digests.select("page_id", "sha").join(many, "sha")
    return found.where("page_id < refers_to").distinct()


def shard_starts(pages: DataFrame, shards: int) -> list[int]:
    """The least page_id of each shard, so that shards hold about equal numbers of pages.

    An id's shard follows from the exact number of pages with smaller ids, whatever way the rows lie.
    Ids are counted first, and their running sum is made per range and then over the ranges' sums.
    """
    counts = pages.where("page_id IS NOT NULL").groupBy("page_id").count()
    placed = checkpoint(counts.repartitionByRange("page_id").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum("count").alias("held"))
    # A row for each partition.
    starts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    total = parts.agg(F.sum("held")).first()[0] or 0
    inside = Window.partitionBy("part").orderBy("page_id").rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.coalesce(F.sum("count").over(inside), F.lit(0))
    ranked = placed.withColumn("smaller", smaller).join(F.broadcast(starts), "part")
    shard = F.floor((F.col("smaller") + F.col("start")) * shards / total).alias("shard")
    return sorted(r["least"] for r in ranked.groupBy(shard).agg(F.min("page_id").alias("least")).collect())


def shard_of(page_id: Column, starts: list[int]) -> Column:
    """How many shards start after the first up to an id; 0 for a NULL id."""
    if len(starts) < 2:
        return F.lit(0)
    later = F.lit(np.array(starts[1:], np.int64))
    return F.coalesce(F.size(F.filter(later, lambda start: start <= page_id)), F.lit(0))


def write_pages(
    pages: DataFrame, folder: str, min_bytes: int = 0, roll_bytes: int = 64 << 20, shards: int | None = None
) -> DataFrame:
    """Writes `page_id, url, html` as WARC files; returns the manifest.

    Records are sorted by range over the shards, with exact bounds (see `shard_starts`). A task writes under names of its attempt and
    reports them; once all tasks are done, the files that the manifest names get their final names,
    by tasks that may run again, and then the manifest is written. What a lost attempt left is
    in no manifest. Runs over the same pages write the same bytes if they use as many shards.

    Of the pages with equal payloads of at least `min_bytes`, that with the largest page_id is a
    response and the others revisit it; of rows that also share that page_id the first is. NULL
    payloads are empty, NULL URLs empty; rows without page_id are responses that nothing refers to.
    No pages give an empty manifest.
    """
    spark = pages.sparkSession
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html")
    ).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    marks = revisits(rows, min_bytes).select(
        "page_id", F.lit(0).alias("what"), F.col("refers_url").alias("url"), F.lit(None).cast("string").alias("html"), "sha", "refers_to"
    )
    both = rows.withColumn("what", F.lit(1)).withColumn("refers_to", F.lit(None).cast("long")).unionByName(marks)
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = both.withColumn("shard", shard_of(F.col("page_id"), shard_starts(rows, n)))
    placed = both.repartitionById(n, "shard").sortWithinPartitions("shard", "page_id", "what", "url", "sha")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = None
        schema = pa.schema([
            ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()),
            ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
        ])
        done: list[dict | None] = []
        current, nth, refers, seen = object(), 0, {}, {}
        for part in parts:
            for row in part.to_pylist():
                page_id, sha = row["page_id"], row["sha"]
                if roller is None or roller.shard != row["shard"]:
                    done.append(roller and roller.close())
                    roller = Roller(folder, row["shard"], roll_bytes)
                if page_id != current:
                    current, nth, refers, seen = page_id, 0, {}, {}
                if not row["what"]:
                    refers[sha] = (row["refers_to"], _plain(row["url"]))
                    continue
                html, url = row["html"].encode("utf-8", "surrogatepass"), _plain(row["url"])
                to = refers.get(sha)
                if to is None and page_id is not None and len(html) >= min_bytes:
                    if sha in seen:
                        to = (page_id, seen[sha])
                    else:
                        seen[sha] = url
                done.append(roller.add(page_record(page_id, nth, url, html, to), page_id))
                nth += 1
        done.append(roller and roller.close())
        yield pa.RecordBatch.from_pylist([x for x in done if x], schema=schema)

    columns = placed.select("shard", "page_id", "what", "url", "html", "sha", "refers_to")
    manifest = checkpoint(columns.mapInArrow(write, MANIFEST))

    def commit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        for part in parts:
            for row in part.to_pylist():
                old, new = (f"{path}/{row[k]}" for k in ("temporary", "name"))
                if fs.get_file_info(old).type != store.FileType.NotFound:
                    fs.move(old, new)
                elif fs.get_file_info(new).size != row["bytes"]:
                    raise FileNotFoundError(old)
            yield part

    final = checkpoint(manifest.mapInArrow(commit, MANIFEST))
    final.drop("temporary").write.mode("overwrite").parquet(f"{folder}/manifest")
    return final.drop("temporary")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, one at a time; fails where a file ends inside one."""
    press, held, data = zlib.decompressobj(31), [], b""
    while data := data or stream.read(1 << 20):
        held.append(press.decompress(data))
        data = press.unused_data
        if press.eof:
            yield b"".join(held)
            press, held = zlib.decompressobj(31), []
    if held:
        raise ValueError("a file ends inside a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block."""
    head, _, rest = member.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    headers = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def _number(urn: str) -> int | None:
    part = urn.split(":")[2]
    return None if part == "none" else int(part)


def page_row(headers: dict[str, str], block: bytes) -> dict:
    """What a record says of its page; digests and lengths must hold where they can be checked."""
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))[15:])
    if headers["warc-block-digest"] != f"sha1:{sha1_base32(block)}":
        raise ValueError("a block's digest is wrong")
    if kind == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError("a payload's digest or length is wrong")
    refers = headers.get("warc-refers-to")
    return {
        "page_id": _number(headers["warc-record-id"]),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": _number(refers) if refers else None,
    }


def read_pages(manifest: DataFrame, folder: str) -> DataFrame:
    """A row per page record of the files that the manifest names, a file at a time in a task.

    Fails where a file has other numbers of bytes or records than the manifest says.
    """

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _fs(folder)
        schema = pa.schema([
            ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
            ("record_type", pa.string()), ("refers_to", pa.int64()),
        ])
        for part in parts:
            for name, size, records in zip(*(part[c].to_pylist() for c in ("name", "bytes", "records")), strict=True):
                rows, seen = [], 0
                if fs.get_file_info(f"{path}/{name}").size != size:
                    raise ValueError(f"{name} does not have the {size} bytes of the manifest")
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for headers, block in map(parse, members(stream)):
                        if headers["warc-type"] != "warcinfo":
                            rows.append(page_row(headers, block))
                            seen += 1
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows = []
                if seen != records:
                    raise ValueError(f"{name} has {seen} records, the manifest {records}")
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = manifest.select("name", "bytes", "records").repartition(
        int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )
    return files.mapInArrow(read, RECORDS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """The pages written to a new folder in the shared one, and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return read_pages(write_pages(pages, folder), folder)


PAGES_SQL = """
WITH bodies AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages),
tops AS (
  SELECT page_id, encode(body) AS raw, max(page_id) OVER (PARTITION BY body) AS top FROM bodies),
hashed AS (
  SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, top, sha1(raw) AS hex FROM tops)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (
    ((('0x' || substr(hex, (i * 5 // 4 + 1)::INT, 2))::INT
      // (CASE i % 4 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 1 END)) % 32) + 1)::INT, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM hashed
"""
