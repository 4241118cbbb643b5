"""Deterministic sharded WARC writer and its reader (operator 6).

Records are range-sorted by page id. Each task writes its range as gzip members, one a record, and starts another file
when the compressed size reaches ROLL_BYTES. Headers, record ids and digests are made from the row alone, so that a
task that runs again writes the same bytes. A file is written under a temporary name, renamed when complete and then
listed; the list of files is the manifest, itself written by Spark, and only files that it lists count.

Of records with equal payloads of at least REVISIT_BYTES, that with the largest page id is a ``response``; the others
are ``revisit`` records without a payload that refer to it. Digests alone are moved to find them.

Defined results: a null payload is empty; a null page id sorts first and is written as such; of rows that tie for the
largest id one is the response; a null url is written as ``urn:none``; a table without rows gives an empty manifest;
other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, shared_dir

REVISIT_BYTES = 1000
ROLL_BYTES = 8 << 20
#: Compressed bytes that the reader looks at together.
SLICE = 1 << 14
#: Date of every record: the tables have none, and a clock would make the files differ from run to run.
DATE = "1970-01-01T00:00:00Z"

_FILES = "path string, file_no int, first_id long, last_id long, n_records long, compressed_bytes long, sha256 string"
_RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def _urn(page_id: int | None, sha1: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{sha1}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of one record, before compression. ``refers_to``: the page of the response, for a revisit."""
    sha1 = hashlib.sha1(payload).hexdigest()
    block = b"" if refers_to is not None else payload
    clean = "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url) if url else "urn:none"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id, sha1)}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{sha1}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
        f"Page-ID: {'' if page_id is None else page_id}",
        f"Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines[6:6] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to, sha1)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _file_system(uri: str):
    """Whatever store the shared folder is in; a path without scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class _Roller:
    """Files of one task: written under a temporary name, renamed when complete."""

    def __init__(self, folder: str, part: int):
        uri = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
        self.fs, self.folder = _file_system(uri)
        self.uri, self.part, self.no, self.done = uri, part, 0, []
        self.fs.create_dir(self.folder, recursive=True)
        self.out = None

    def add(self, page_id: int | None, raw: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.part:06d}-{self.no:05d}.warc.gz"
            self.temp = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.sha = self.fs.open_output_stream(self.temp), 0, hashlib.sha256()
            self.first, self.n = page_id, 0
        member = gzip.compress(raw, compresslevel=6, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size, self.n, self.last = self.size + len(member), self.n + 1, page_id
        if self.size >= ROLL_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            try:
                self.fs.move(self.temp, f"{self.folder}/{self.name}")
            except OSError:  # a store that doesn't replace: an earlier attempt has left the same bytes
                self.fs.delete_file(f"{self.folder}/{self.name}")
                self.fs.move(self.temp, f"{self.folder}/{self.name}")
            self.done.append((f"{self.uri}/{self.name}", self.part * 100_000 + self.no, self.first, self.last, self.n, self.size, self.sha.hexdigest()))
            self.out, self.no = None, self.no + 1


def _write(folder: str):
    """Rows sorted by page id, digest and kind: a row that only tells the response comes before the rows that it is for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files = _Roller(folder, TaskContext.get().partitionId())
        told: tuple = ()
        for batch in batches:
            for page_id, sha1, kind, response, url, html in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if kind == 0:
                    told = (page_id, sha1, response)
                    continue
                refers = told[2] if told[:2] == (page_id, sha1) else None
                if refers is not None and refers == page_id:  # this row is the response; rows that tie with it are not
                    told, refers = (page_id, sha1, -1), None
                elif refers == -1:
                    refers = page_id
                files.add(page_id, record(page_id, url, html or b"", refers))
        files.close()
        columns = list(zip(*files.done)) if files.done else [()] * 7
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "file_no", "first_id", "last_id", "n_records", "compressed_bytes", "sha256"])

    return run


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, response) for pages whose payload, of REVISIT_BYTES at least, others have too. Payloads do not move."""
    keys = pages.select("page_id", F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary")).alias("sha1"), F.octet_length(F.coalesce(F.col("html"), F.lit(""))).alias("_n"))
    keys = keys.filter(F.col("_n") >= REVISIT_BYTES).select("page_id", "sha1")
    groups = keys.groupBy(F.col("sha1").alias("_sha1")).agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").drop("_c")
    return keys.join(groups, F.col("sha1") == F.col("_sha1")).select("page_id", "sha1", "response").distinct()


def write(pages: DataFrame, at: str) -> DataFrame:
    """Write the archives below ``at``/warc and the manifest at ``at``/manifest; returns the manifest."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.sha1(html).alias("sha1"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("response"), "url", html.alias("html"))
    told = responses(pages).select("page_id", "sha1", F.lit(0).alias("kind"), "response", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("html"))
    ranged = rows.unionByName(told).repartitionByRange(partitions(spark), "page_id", "sha1").sortWithinPartitions("page_id", "sha1", "kind", "url")
    ranged.mapInArrow(_write(f"{at}/warc"), _FILES).write.parquet(f"{at}/manifest")
    return spark.read.parquet(f"{at}/manifest")


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members of ``data``, each fed by slices, so that the rest of the file is not copied for every record."""
    view, at = memoryview(data), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a record")
            some = view[at : at + SLICE]
            parts.append(z.decompress(some))
            at += len(some) - len(z.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of one record; checks its digests."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if not head.startswith(b"WARC/") or rest[len(block) :] != b"\r\n\r\n" or hashlib.sha1(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError("a record does not match its header")
    page, refers = fields["Page-ID"], fields.get("Refers-To-Page-ID")
    return (int(page) if page else None, int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], int(refers) if refers else None, fields["WARC-Target-URI"], None if refers else block)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    for batch in batches:
        for content, sha in zip(batch.column(0), batch.column(1).to_pylist()):
            data = content.as_py()
            if hashlib.sha256(data).hexdigest() != sha:
                raise ValueError("an archive does not match the manifest")
            rows: list[tuple] = []
            size = 0
            for raw in members(data):
                rows.append(parse(raw))
                size += len(raw)
                if size > ROLL_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read(spark: SparkSession, at: str) -> DataFrame:
    """All records of the archives that the manifest lists, each file checked against it. A file is about ROLL_BYTES large."""
    manifest = spark.read.parquet(f"{at}/manifest")
    if not manifest.limit(1).count():
        return spark.createDataFrame([], _RECORDS)
    name = F.element_at(F.split("path", "/"), -1)
    listed = manifest.select(name.alias("_name"), "sha256")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(f"{at}/warc").select(name.alias("name"), "content")
    listed = F.broadcast(listed) if manifest.count() <= 100_000 else listed
    return files.join(listed, F.col("name") == F.col("_name")).select("content", "sha256").mapInArrow(_read, _RECORDS)


def op6(pages: DataFrame) -> DataFrame:
    at = shared_dir(pages.sparkSession)
    write(pages, at)
    return read(pages.sparkSession, at).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB: the rows of op6.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS m, count(*) AS c FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN strlen(html) >= 1000 AND c > 1 AND page_id <> m THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(html) >= 1000 AND c > 1 AND page_id <> m THEN m END AS refers_to
FROM p JOIN g USING (h)
"""
