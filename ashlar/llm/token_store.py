"""Content-addressed store of token ids (operator 2).

Folder layout, all Parquet files written by Spark:

* ``chunks``: digest (16 bytes), n_ids, payload (little-endian ids of two bytes each, or four if the vocabulary has more than 65,536). Each distinct chunk is stored once.
* ``recipes``: for each document in ascending id order, its start, n_tokens, the digests and lengths of its chunks and
  the Merkle root over them; ``file_no`` orders the files.
* ``manifest``: for each recipe file its first and last id, ids held, and the Merkle root over its documents' roots.

A rolling hash over the last GEAR_WINDOW ids cuts the stream where its top bits are zero, so that equal passages give
equal chunks wherever they stand; MIN_CHUNK and MAX_CHUNK bound a chunk. Reading checks every chunk against its
digest, every recipe against its Merkle root and every file against the manifest, and fails where one does not match.

Defined results: a null text is empty (its document is the end id alone); equal rows are documents of their own, one
after the other; a table without rows makes an empty store; other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import tokens
from .common import partitions, prefix_sums, release, shared_dir, stored

END = 2
#: A cut where the hash of the last 16 ids has its CUT_BITS top bits zero: every 2**CUT_BITS ids on average.
GEAR_WINDOW, CUT_BITS = 16, 10
MIN_CHUNK, MAX_CHUNK = 256, 8192

_RAW = "kind string, key binary, doc_id long, mark long, n_tokens long, digests array<binary>, lengths array<int>, root binary, n_ids int, payload binary"
_RAW_ARROW = pa.schema([
    ("kind", pa.string()), ("key", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.list_(pa.binary())),
    ("lengths", pa.list_(pa.int32())), ("root", pa.binary()), ("n_ids", pa.int32()), ("payload", pa.binary()),
])


def _scrambled(ids: np.ndarray) -> np.ndarray:
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream. The hash at i is the sum of scrambled ids i - GEAR_WINDOW + 1 .. i, each doubled for each id after it."""
    n = len(ids)
    h, k = _scrambled(ids), 1
    while k < GEAR_WINDOW:  # sums over k ids become sums over 2 k
        h[k:] += h[:-k] << np.uint64(k)
        k *= 2
    ends, last = [], 0
    for at in (np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + 1).tolist():
        while at - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if at - last >= MIN_CHUNK:
            ends.append(at)
            last = at
    while n - last > MAX_CHUNK:
        last += MAX_CHUNK
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node at the end of a level goes up as it is."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=16).digest()
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + level[i] + level[i + 1], digest_size=16).digest() for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) - len(level) % 2 :]
    return level[0]


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _ids(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` ids of a payload, whose size tells how wide they are."""
    return np.frombuffer(raw, dtype={2 * n: "<u2", 4 * n: "<u4"}[len(raw)])


def _encode(path: str, end: int, wide: bool = False):
    """Rows of kind ``chunk`` (the first of its digest in this task) and ``recipe``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, "words", wide)
        close = np.array([end], dtype=encoder.dtype).tobytes()
        width = len(close)
        seen: set[bytes] = set()
        for batch in batches:
            docs, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            rows = []
            for doc, text, packed in zip(docs, texts, encoder.encode(texts)):
                raw = packed + close
                ids = np.frombuffer(raw, dtype=encoder.dtype)
                digests, lengths, last = [], [], 0
                for to in cuts(ids):
                    part = raw[width * last : width * to]
                    d = _digest(part)
                    digests.append(d)
                    lengths.append(to - last)
                    if d not in seen:
                        if len(seen) > 300_000:
                            seen.clear()
                        seen.add(d)
                        rows.append(("chunk", d, None, None, None, None, None, None, to - last, part))
                    last = to
                mark = zlib.crc32(text)
                rows.append(("recipe", (doc or 0).to_bytes(8, "little", signed=True) + mark.to_bytes(4, "little"), doc, mark, len(ids), digests, lengths, merkle(digests), None, None))
            for i in range(0, len(rows), 2000):
                columns = list(zip(*rows[i : i + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RAW_ARROW)], schema=_RAW_ARROW)
        seen.clear()
        release()

    return run


def write(docs: DataFrame, path: str, at: str, end: int = END, wide: bool = False) -> None:
    """Encode every text once and write the store at ``at``.

    Chunks meet their copies in one shuffle by digest, in which only the first of each task takes part: a chunk that
    a third of the documents share comes once from each task. Recipes ride in the same shuffle, dealt by document.
    """
    spark = docs.sparkSession
    raw = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_encode(path, end, wide), _RAW)
    met = raw.repartition(partitions(spark), "kind", "key")
    no = F.row_number().over(Window.partitionBy("kind", "key").orderBy("n_ids"))
    met.withColumn("_no", no).filter("kind = 'recipe' or _no = 1").drop("_no").write.partitionBy("kind").parquet(f"{at}/chunks_and_recipes")
    recipes = spark.read.schema(_RAW).parquet(f"{at}/chunks_and_recipes").filter("kind = 'recipe'").select("doc_id", "mark", "n_tokens", "digests", "lengths", "root")
    ordered = prefix_sums(recipes, [F.col("doc_id"), F.col("mark"), F.col("root")], "n_tokens", "start", f"{at}/ordered")
    final = ordered.repartitionByRange(partitions(spark), "doc_id", "start").sortWithinPartitions("doc_id", "start").withColumn("file_no", F.spark_partition_id())
    final = stored(final, f"{at}/recipes")
    _file_roots(final).write.parquet(f"{at}/manifest")


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by file and start: a row for each file, from hashing its documents' roots one after the other."""
    now, state, first, last, docs, ids = None, None, None, None, 0, 0
    out: list[tuple] = []

    def close() -> None:
        if now is not None:
            out.append((now, first, last, docs, ids, state))

    for batch in batches:
        for file_no, doc, n, root in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if file_no != now:
                close()
                now, state, first, docs, ids = file_no, b"", doc, 0, 0
            state, last, docs, ids = _digest(b"\1" + state + root), doc, docs + 1, ids + n
    close()
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    columns = list(zip(*out)) if out else [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["file_no", "first_id", "last_id", "n_docs", "n_ids", "root"])


def _file_roots(recipes: DataFrame) -> DataFrame:
    """The documents of a file are one range of ids, as large as a partition."""
    rows = recipes.select("file_no", "doc_id", "n_tokens", "root", "start").repartition(partitions(recipes.sparkSession), "file_no").sortWithinPartitions("file_no", "doc_id", "start")
    return rows.select("file_no", "doc_id", "n_tokens", "root").mapInArrow(_roots, "file_no int, first_id long, last_id long, n_docs long, n_ids long, root binary")


def _checked_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_ids, crc32 of the ids as four bytes each) of stored chunks that match their digests."""
    for batch in batches:
        keys, counts, crcs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for key, n, raw in zip(keys, counts, batch.column(2).to_pylist()):
            if _digest(raw) != key or len(raw) not in (2 * n, 4 * n):
                raise ValueError(f"chunk {key.hex()} does not match its digest")
            crcs.append(zlib.crc32(_ids(raw, n).astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(crcs, pa.int64())], ["key", "n_ids", "crc"])


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


def _zero_operators() -> list[list[int]]:
    """Operators of 2**k zero bytes on a CRC-32 register, each the square of the one before."""
    bit = [0xEDB88320] + [1 << (i - 1) for i in range(1, 32)]
    square = lambda m: [_times(m, x) for x in m]
    byte = square(square(square(bit)))
    out = [byte]
    for _ in range(40):
        out.append(square(out[-1]))
    return out


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """crc32 of byte strings one after the other, from (crc32, bytes) of each."""
    operators, total = _zero_operators_kept(), 0
    for crc, size in parts:
        k = 0
        while size and total:
            if size & 1:
                total = _times(operators[k], total)
            size >>= 1
            k += 1
        total ^= crc
    return total


_OPERATORS: list[list[list[int]]] = []


def _zero_operators_kept() -> list[list[int]]:
    if not _OPERATORS:
        _OPERATORS.append(_zero_operators())
    return _OPERATORS[0]


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, starts, totals, roots = (batch.column(k).to_pylist() for k in range(4))
        crcs = []
        for doc, total, root, parts in zip(docs, totals, roots, batch.column(4).to_pylist()):
            if merkle([p["key"] for p in parts]) != root or sum(p["n_ids"] for p in parts) != total:
                raise ValueError(f"the recipe of document {doc} does not match its Merkle root")
            crcs.append(joined_crc([(p["crc"], 4 * p["n_ids"]) for p in parts]))
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(totals, pa.int64()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def _parts_of(spark: SparkSession, at: str) -> DataFrame:
    """(doc_id, start, n_tokens, root, no, key) of every chunk of every recipe."""
    recipes = spark.read.parquet(f"{at}/recipes")
    return recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("no", "key"))


def read(spark: SparkSession, at: str) -> DataFrame:
    """Read the store back: doc_id, start, n_tokens and ids_crc32 of every document, all of it verified.

    Each stored chunk is read and hashed once; what moves to the documents that it belongs to is its checksum, and
    checksums of parts make up that of the whole.
    """
    held = _file_roots(spark.read.parquet(f"{at}/recipes")).withColumnRenamed("root", "found")
    wrong = spark.read.parquet(f"{at}/manifest").join(held.select("file_no", "found", F.col("n_docs").alias("d")), "file_no", "full").filter("not (root <=> found and n_docs <=> d)")
    if wrong.limit(1).count():
        raise ValueError("a recipe file does not match the manifest")
    chunks = spark.read.schema(_RAW).parquet(f"{at}/chunks_and_recipes").filter("kind = 'chunk'").select("key", "n_ids", "payload").mapInArrow(_checked_chunks, "key binary, n_ids int, crc long")
    parts = _parts_of(spark, at).join(chunks, "key")
    rows = parts.groupBy("start", "doc_id", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("no", "key", "n_ids", "crc"))).alias("parts"))
    return rows.select("doc_id", "start", "n_tokens", "root", "parts").mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(spark: SparkSession, at: str, docs: DataFrame) -> DataFrame:
    """The ids themselves (array<int>) of the documents in ``docs`` (doc_id), rebuilt from the store."""
    chunks = spark.read.schema(_RAW).parquet(f"{at}/chunks_and_recipes").filter("kind = 'chunk'").select("key", "n_ids", "payload")
    parts = _parts_of(spark, at).join(docs.select("doc_id").distinct(), "doc_id", "left_semi").join(chunks, "key")
    rows = parts.groupBy("start", "doc_id").agg(F.sort_array(F.collect_list(F.struct("no", "n_ids", "payload"))).alias("parts"))

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([_ids(p["payload"], p["n_ids"]) for p in parts]).astype(np.int32) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return rows.select("doc_id", "start", "parts").mapInArrow(rebuilt, "doc_id long, start long, ids array<int>")


def op2(docs: DataFrame, path: str) -> DataFrame:
    spark = docs.sparkSession
    at = shared_dir(spark)
    write(docs, path, at)
    return read(spark, at)
