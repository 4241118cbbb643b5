"""Packing token sequences with minimum bin slack (operator 5).

Documents are cut into full windows and one remainder each; full windows are sequences of their own. Remainders are
packed by length alone: how many there are of each length (at most one count for each length below the capacity, so of
a fixed size) goes to the driver. There a subset-sum table over bit sets finds the multiset of remaining lengths that
fills a window closest to capacity; backtracking gives its counts, and the pattern is repeated for as many windows as
the remaining counts allow. What is left of a length is then less than one window uses, so the number of patterns
is bounded by the lengths, not by the documents. Pieces get their window by their rank within their length.

Defined results: a null text is empty, so its document is the end id alone; equal rows are documents of their own;
lengths that tie are told apart by document, digest and start; a table without rows gives no pieces; other columns are
not read. A window is padded to its capacity unless its length is a power of two.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import prefix_sums, shared_dir, stored

CAPACITY = 2048
END = 1

PIECES = "doc_id long, text_crc long, start long, length int, ids_crc32 long, doc_tokens long"


def _pieces(path: str, capacity: int, end: int, lean: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path, "spaced")
        close = np.array([end], dtype=encoder.dtype).tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or b"" for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for doc, text, packed in zip(ids, texts, encoder.encode(texts)):
                whole = np.frombuffer(packed + close, dtype=encoder.dtype).astype("<u4")
                mark = zlib.crc32(text)
                for start in range(0, len(whole), capacity):
                    piece = whole[start : start + capacity]
                    rows.append((doc, mark, start, len(piece), zlib.crc32(piece.tobytes()), len(whole)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "text_crc", "start", "length", "ids_crc32", "doc_tokens"])
        if lean:
            encoder.done()

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, lean: bool = False) -> DataFrame:
    """Cut the ids of every text, with the end id, into pieces of at most ``capacity``.

    ``lean``: workers forget encoded words after each task, which takes a fifth more time and leaves room for others.
    """
    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(_pieces(path, capacity, end, lean), PIECES)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of the lengths on hand whose sum comes closest to ``capacity`` from below, as length -> times.

    Bit s of a table says that sum s can be made; a table is kept for each doubling of a length, for backtracking.
    Longer lengths are tried first, so that short ones are left to fill later windows.
    """
    keep = (1 << (capacity + 1)) - 1
    made, steps = 1, []
    for length in sorted(counts, reverse=True):
        left, times = min(counts[length], capacity // length), 1
        while left and not made >> capacity & 1:
            take = min(times, left)
            steps.append((length, take, made))
            made |= made << take * length & keep
            left, times = left - take, times * 2
        if made >> capacity & 1:
            break
    total, used = made.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= take * length
    return used


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(windows, length -> times in each) until no length is left."""
    counts = {k: n for k, n in counts.items() if n}
    found = []
    while counts:
        used = fullest(counts, capacity)
        windows = min(counts[k] // n for k, n in used.items())
        found.append((windows, used))
        for k, n in used.items():
            counts[k] -= n * windows
            if not counts[k]:
                del counts[k]
    return found


def _slots(found: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, rank after the last, first window, times in a window, offset in it) of each pattern's lengths."""
    rows, window, taken = [], 0, {}
    for windows, used in found:
        offset = 0
        for length, times in sorted(used.items(), reverse=True):
            first = taken.get(length, 0)
            rows.append((length, first, first + windows * times, window, times, offset))
            taken[length] = first + windows * times
            offset += times * length
        window += windows
    return rows


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (pieces, written) with sequence_id and offset.

    Full pieces are numbered after the windows of the remainders. The table of patterns is joined by broadcast: it
    has at most some dozens of rows for each length below ``capacity``, whatever the number of documents.
    """
    spark = cut.sparkSession
    at = shared_dir(spark)
    order = [F.col(c) for c in ("length", "doc_id", "text_crc", "start", "ids_crc32")]
    ranked = prefix_sums(cut.withColumn("_one", F.lit(1)), order, "_one", "_rank", f"{at}/ranked", group="length").drop("_one")
    counts = {r[0]: r[1] for r in cut.filter(F.col("length") < capacity).groupBy("length").count().collect()}  # below `capacity` rows
    found = patterns(counts, capacity)
    slots = spark.createDataFrame(_slots(found), "_length int, _from long, _to long, _window long, _times long, _offset long")
    windows = sum(n for n, _ in found)
    on = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))
    joined = ranked.join(F.broadcast(slots), on, "left")
    step = F.col("_rank") - F.col("_from")
    full = F.col("_length").isNull()
    return joined.select(
        "doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens",
        F.when(full, F.lit(windows) + F.col("_rank")).otherwise(F.col("_window") + F.expr("(_rank - _from) div _times")).cast("long").alias("sequence_id"),
        F.when(full, F.lit(0)).otherwise(F.col("_offset") + F.pmod(step, F.col("_times")) * F.col("length")).cast("long").alias("offset"),
    )


def op5(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, lean: bool = False) -> DataFrame:
    spark = docs.sparkSession
    return pack(stored(pieces(docs, path, capacity, end, lean), f"{shared_dir(spark)}/pieces"), capacity)
