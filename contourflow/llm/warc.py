"""A deterministic sharded WARC writer, and the reader of what it wrote.

Records are dealt into shards by ranges of the page id with about equal bytes (boundaries from a sample of ids chosen by their hashes) and sorted within, a task a shard;
a shard's file rolls when its compressed size reaches the limit. Headers, record ids and digests are made anew from the
payload, so reruns write equal bytes. A task writes under a temporary name and renames; a rerun of a lost task replaces a
file by its equal. The manifest, written last, names the files of the tasks that succeeded; readers open no others.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from contourflow.llm.common import materialize, partitions, shared_path, unit_hash, utf8
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROLL_BYTES = 64 << 20
SHARD_BYTES = 256 << 20
LEVEL = 5
DATE = "2020-01-01T00:00:00Z"
#: Bytes of a record besides its payload, about.
RECORD_BYTES = 700
#: Page ids that the shard boundaries are drawn from, about.
BOUNDARY_SAMPLE = 20_000
#: Payloads that occur more than once, up to which their table is broadcast; more are joined by shuffle.
BROADCAST_ROWS = 20_000
READ_BYTES = 1 << 20

MANIFEST = "file string, shard int, part int, records long, bytes long, sha256 string"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space of URLs


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, payload_digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page_id}:{payload_digest}')}>"


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return b"WARC/1.1\r\n" + head.encode() + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One response, or a revisit without its payload; both carry the digest and length of the full payload."""
    mark = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, mark)), ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url)))
    headers += [("WARC-Payload-Digest", f"sha1:{mark}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, mark)), ("X-Refers-To-Page-ID", str(refers_to))]
    return _record(headers, block)


def _member(record: bytes, level: int) -> bytes:
    made = zlib.compressobj(level, zlib.DEFLATED, 31)
    return made.compress(record) + made.flush()


class _Roller:
    """The files of one shard, in turn."""

    def __init__(self, folder: str, shard: int, roll: int, level: int) -> None:
        self.fs, self.folder = _fs(folder)
        self.shard, self.roll, self.level, self.part, self.out = shard, roll, level, 0, None
        self.done: list[tuple[str, int, int, int, int, str]] = []

    def add(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.records, self.size, self.hash = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            info = f"software: contourflow\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self.shard}\r\n".encode()
            self._put(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_NAMES, self.name)}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))
        self._put(record)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def _put(self, record: bytes) -> None:
        data = _member(record, self.level)
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.folder}/{self.name}")
            self.done.append((self.name, self.shard, self.part, self.records, self.size, self.hash.hexdigest()))
            self.out, self.part = None, self.part + 1


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_revisit: int = 0, roll: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, level: int = LEVEL) -> DataFrame:
    """Write a record for each row into folder/*.warc.gz and return the manifest, which lies in folder/manifest.

    Of rows with equal payloads of at least least_revisit bytes, those with the smallest id are responses and the others revisits to it;
    smaller payloads, and groups whose ids are all null, are responses. A null payload is empty, a null url leaves its header out. Repeated rows of the
    smallest id are all responses. A very long payload is one record, in memory once; rows of one id share a shard. An empty table writes no file and an empty manifest.
    """
    spark = pages.sparkSession
    where, path = _fs(folder)
    where.create_dir(path, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), utf8(payload_col).alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("n", F.octet_length("payload"))

    groups = rows.groupBy("sha1").agg(F.min("id").alias("first"), F.count("*").alias("copies"), F.sum("n").alias("bytes"))
    groups = materialize(groups, "payloads")
    total, n_rows = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("copies"), F.lit(0))).first()
    again = groups.filter("copies > 1 AND first IS NOT NULL").select("sha1", "first")
    if again.count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    rows = rows.join(again, "sha1", "left")
    revisit = F.col("first").isNotNull() & (F.col("n") >= least_revisit) & ~F.col("id").eqNullSafe(F.col("first"))
    rows = rows.withColumn("revisit", revisit)

    n_shards = max(2 * partitions(spark), -(-total // shard_bytes))
    share = min(1.0, BOUNDARY_SAMPLE / max(1, n_rows))
    drawn = rows.filter(F.col("id").isNotNull() & (unit_hash(F.col("id"), seed="warc") < share)).groupBy("id").agg(F.sum(F.when(F.col("revisit"), 0).otherwise(F.col("n")) + RECORD_BYTES).alias("n"))
    drawn = sorted((r["id"], r["n"]) for r in drawn.collect())
    upto = np.cumsum([n for _, n in drawn], dtype=np.int64)
    at = np.searchsorted(upto, upto[-1] * np.arange(1, n_shards) // n_shards) if drawn else []
    cuts = np.unique(np.array([drawn[k][0] for k in at], dtype=np.int64))

    @F.pandas_udf("int")
    def shard_of(batch: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, batch.to_numpy(dtype=np.int64), side="right"), dtype="int32")

    rows = rows.withColumn("shard", shard_of(F.coalesce("id", F.lit(-(1 << 63)).cast("long"))))
    # A task a shard: what a task reads hangs on shard_bytes, not on the input.
    ordered = rows.select("shard", "id", "url", "payload", "first", "revisit", "sha1").repartitionById(len(cuts) + 1, "shard").sortWithinPartitions("shard", "id", "sha1", "url")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Roller | None = None
        done: list[tuple] = []
        for pdf in batches:
            first = pdf["first"].astype(object).where(pdf["first"].notna(), None)
            ids = pdf["id"].astype(object).where(pdf["id"].notna(), None)
            for shard, page, url, payload, ref, revisit in zip(pdf["shard"].tolist(), ids, pdf["url"], pdf["payload"], first, pdf["revisit"].tolist(), strict=True):
                if now is None or now.shard != shard:
                    if now is not None:
                        now.close()
                        done += now.done
                    now = _Roller(folder, shard, roll, level)
                now.add(page_record(None if page is None else int(page), url, bytes(payload), None if ref is None else int(ref), bool(revisit)))
        if now is not None:
            now.close()
            done += now.done
        yield pd.DataFrame(done, columns=["file", "shard", "part", "records", "bytes", "sha256"]).astype({"shard": "int32", "part": "int32", "records": "int64", "bytes": "int64"})

    ordered.mapInPandas(put, MANIFEST).write.parquet(f"{folder}/.manifest.tmp")
    where.move(f"{path}/.manifest.tmp", f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def members(path: str) -> Iterator[bytes]:
    """The records of a file of gzip members, one at a time."""
    where, own = _fs(path)
    with where.open_input_stream(own, compression=None) as source:
        made, parts, rest = zlib.decompressobj(31), [], b""
        while data := rest or source.read(READ_BYTES):
            parts.append(made.decompress(data))
            rest = b""
            if made.eof:
                yield b"".join(parts)
                rest, made, parts = made.unused_data, zlib.decompressobj(31), []
        if any(parts):
            raise ValueError(f"{path} ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block; the declared length must be the block's."""
    head, _, rest = record.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header's")
    return headers, rest[:n]


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of the files that the manifest names.

    payload_bytes and payload_digest of a response are measured on what was read, and a digest that differs from the header's is an error; a revisit's, whose payload is null,
    come from its header.
    """
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file").repartition(2 * partitions(spark), "file")
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def rows_of(name: str) -> Iterator[tuple]:
        for record in members(f"{folder}/{name}"):
            headers, block = parse(record)
            kind = headers["warc-type"]
            if kind not in ("response", "revisit"):
                continue
            page, ref = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
            mark, n, payload = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"]), None
            if kind == "response":
                payload = block.partition(b"\r\n\r\n")[2]
                if (digest(payload), len(payload)) != (mark, n):
                    raise ValueError(f"{name}: the payload of page {page} differs from its digest")
            yield page and int(page), headers.get("warc-target-uri"), payload, n, mark, kind, ref and int(ref)

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name in pdf["file"]:
                rows, size = [], 0
                for row in rows_of(name):
                    rows.append(row)
                    size += len(row[2] or b"")
                    if size > 16 << 20 or len(rows) >= 5000:
                        yield _frame(rows, names)
                        rows, size = [], 0
                yield _frame(rows, names)

    return files.mapInPandas(get, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "payload_bytes": "int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame, **options: object) -> DataFrame:
    """Write the pages into a new folder below the shared one and read them back."""
    folder = shared_path(pages.sparkSession, "warc")
    write(pages, folder, **options)
    return read(pages.sparkSession, folder)
