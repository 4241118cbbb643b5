"""Removal of repeated substrings by bucket-pointer refinement (operator 9).

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. Suffixes are sorted only as deep as
that, and only where they can tie:

1. Initial buckets. Every Q-gram has a bucket pointer. Of the Q-grams of every string of LENGTH bytes the one of the
   least pointer (the leftmost of equals) is its anchor, so equal strings have equal anchors at equal offsets, and the
   strings of one anchor start next to each other. Anchors are sorted into the buckets of their Q-grams.
2. Refinement by later pointers. A bucket of one anchor holds nothing that repeats. Others are sorted on the bucket
   pointers at the offsets Q, 2Q ... of the bytes under all strings of the anchor: where all are equal, all strings
   repeat. Only a bucket that this splits is refined further, by one anchor for each part.
3. Recursive refinement. The strings of those anchors are sorted on the pairs (own bucket, bucket at the offset of the
   depth so far). The new buckets are written back and are the pointers of the next round, so that the depth doubles
   up to LENGTH. Buckets without company are closed and not sorted again. Strings with company at full depth repeat.

Buckets are dealt out by ranges of their pointer, as arrays: about one anchor for every 85 bytes. What one task holds
twice it settles itself and sends once, so that a passage in a third of all texts comes once from each task. A bucket
that step 2 splits into more than CROWD parts does not go to one task: its strings are dealt out one by one, by the
pointers at all their offsets, and those with company at once have full depth. Tasks tell of Q-grams that have many
unlike surroundings; where these are more than HOT in all, the bucket is dealt out by the later pointers from the start. Equal texts are one text with copies, all of whose strings repeat.
Texts are shuffled for step 3 and for the result.

Pointers are 64-bit hashes of Q bytes; two strings are taken for equal only if the pointers of all their Q-grams are. Texts are
told apart by 128 bits. Defined results: a null text is empty, a text shorter than LENGTH has
no string that could repeat; equal rows repeat each other wholly; overlapping repeats within one text count; a table
without rows gives none; other columns are kept by :func:`remove`, under any names, and not read by :func:`op9`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, free_shuffles, partitions, release, shared_dir, stored

LENGTH, Q = 200, 32
WINDOW = LENGTH - Q + 1
#: Bytes that are looked at together: short texts one after the other, long ones in pieces that overlap by LENGTH - 1.
SEGMENT = 1 << 18
#: Anchors that a task holds before it settles and sends them.
FLUSH = 400_000
#: Bytes of text for each range of buckets, and of contexts for each range of step 3.
RANGE_BYTES, CONTEXT_BYTES = 16 << 20, 2 << 20
#: Parts of a bucket whose strings meet in one task, and whose anchors do.
CROWD, HOT = 2000, 200_000
#: Buckets that are dealt out in parts (8 bytes each in every worker); HOT is doubled until they are no more.
MOST_HOT = 1_000_000

_U = np.uint64
_ROOT = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ENTRY = np.dtype([("gram", "<u8"), ("span", "<u8"), ("text", "<i8"), ("first", "<u4"), ("count", "u1"), ("depth", "u1"), ("twice", "u1")])
_TABLES: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of an odd number and of its inverse modulo 2**64."""
    if not _TABLES:
        letters = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)), dtype="<u8")
        size = SEGMENT + 2 * LENGTH
        powers = lambda r: np.concatenate([[_U(1)], np.cumprod(np.full(size, r, dtype=_U))])
        _TABLES.append((letters, powers(_ROOT), powers(_BACK)))
    return _TABLES[0]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _sums(data: np.ndarray) -> np.ndarray:
    letters, up, _ = _tables()
    out = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum(letters[data] * up[: len(data)], out=out[1:])
    return out


def _hash(sums: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Of the bytes from ``at`` up to ``to``, the same wherever they stand."""
    return (sums[to] - sums[at]) * _tables()[2][at]


def _folded(pointers: np.ndarray, first: np.ndarray, sizes: np.ndarray, start: np.ndarray, root: np.uint64 = _U(0xA24BAED4963EE407)) -> np.ndarray:
    """One number for the bucket pointers at the offsets 0, Q, 2Q ... and at the last one of ``sizes`` bytes from ``first``."""
    out = _mixed(start * root)
    for offset in range(0, int(sizes.max(initial=0)) - Q + 1, Q):
        at = np.minimum(offset, sizes - Q) + first
        more = offset < sizes
        out = np.where(more, _mixed(out * root + pointers[at]), out)
    return _mixed(out * root + pointers[first + sizes - Q])


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` keys, from minima before and after block bounds."""
    n = len(keys) - width + 1
    full = np.full(-(-len(keys) // width) * width, np.iinfo(_U).max, dtype=_U)
    full[: len(keys)] = keys
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(pieces: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Entries of all strings of LENGTH bytes in ``pieces`` (text key, offset in the text, bytes), SEGMENT bytes or so in all."""
    pieces = [p for p in pieces if len(p[2]) >= LENGTH]
    if not pieces:
        return np.zeros(0, dtype=_ENTRY)
    data = np.frombuffer(b"".join(p[2] for p in pieces), dtype=np.uint8)
    sizes = np.array([len(p[2]) for p in pieces])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    sums = _sums(data)
    at = np.arange(len(data) - Q + 1)
    grams = _mixed(_hash(sums, at, at + Q))
    least = _least((grams >> _U(24) << _U(24)) | at.astype(_U), WINDOW)
    inside = np.zeros(len(least), dtype=bool)
    for start, size in zip(starts.tolist(), sizes.tolist()):
        inside[start : start + size - LENGTH + 1] = True
    first = np.flatnonzero(inside)
    anchor = (least[first] & _U((1 << 24) - 1)).astype(np.int64)
    new = np.ones(len(first), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(first)))
    first, anchor = first[heads], anchor[heads]
    last = first + counts - 1
    piece = np.searchsorted(starts, first, side="right") - 1
    out = np.zeros(len(first), dtype=_ENTRY)
    out["gram"] = grams[anchor]
    out["span"] = _folded(grams, first, counts - 1 + LENGTH, (counts * 256 + anchor - first).astype(_U))
    out["text"] = np.array([p[0] for p in pieces], dtype=np.int64)[piece]
    out["first"] = first - starts[piece] + np.array([p[1] for p in pieces])[piece]
    out["count"], out["depth"] = counts, anchor - first
    return out


def _groups(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``entries`` sorted and without repeats of one text's own; for each its span's size (2 at least if seen twice)."""
    entries = entries[np.lexsort((1 - entries["twice"], entries["first"], entries["text"], entries["span"], entries["gram"]))]
    if len(entries) > 1:
        same = (entries["span"][1:] == entries["span"][:-1]) & (entries["text"][1:] == entries["text"][:-1]) & (entries["first"][1:] == entries["first"][:-1])
        entries = entries[np.concatenate([[True], ~same])]
    new = np.ones(len(entries), dtype=bool)
    new[1:] = (entries["span"][1:] != entries["span"][:-1]) | (entries["gram"][1:] != entries["gram"][:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(entries)))
    twice = np.maximum.reduceat(entries["twice"], heads) if len(heads) else np.zeros(0, np.uint8)
    repeated = (sizes > 1) | (twice > 0)
    return entries, heads, repeated


_FOUND = "kind string, gram long, text long, first int, count int, depth int"
_FOUND_ARROW = pa.schema([("kind", pa.string()), ("gram", pa.int64()), ("text", pa.int64()), ("first", pa.int32()), ("count", pa.int32()), ("depth", pa.int32())])
_SENT = "range int, entries binary, kind string, gram long, text long, first int, count int, depth int"
_SENT_ARROW = pa.schema([("range", pa.int32()), ("entries", pa.binary()), *_FOUND_ARROW])


def _found(kind: str, entries: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([kind] * len(entries), pa.string()), pa.array(entries["gram"].view(np.int64) if entries["gram"].flags.c_contiguous else entries["gram"].astype(np.int64))]
    columns += [pa.array(entries["text"].astype(np.int64)), *(pa.array(entries[c].astype(np.int32)) for c in ("first", "count", "depth"))]
    return pa.RecordBatch.from_arrays(columns, schema=_FOUND_ARROW)


def _range_of(grams: np.ndarray, ranges: int) -> np.ndarray:
    """Anchors are least hashes, so these are mixed once more to deal them out evenly."""
    return ((_mixed(grams + _ROOT) >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int32)


def _collect(ranges: int, least: int):
    """Entries of the task's texts: blobs for each range; runs that the task itself finds repeated; Q-grams of ``least`` parts or more."""

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entries, heads, repeated = _groups(np.concatenate(held))
        if not len(entries):
            return
        sizes = np.diff(np.append(heads, len(entries)))
        own = np.repeat(repeated & (sizes > 1), sizes)
        runs = entries[own]
        for i in range(0, len(runs), 20_000):
            found = _found("run", runs[i : i + 20_000])
            n = found.num_rows
            yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *found.columns], schema=_SENT_ARROW)
        entries = entries[heads]
        entries["twice"] = repeated
        grams, parts = np.unique(entries["gram"], return_counts=True)
        many = np.zeros(int((parts >= least).sum()), dtype=_ENTRY)
        if len(many):
            many["gram"], many["first"] = grams[parts >= least], parts[parts >= least]
            found = _found("many", many)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(many), pa.int32()), pa.nulls(len(many), pa.binary()), *found.columns], schema=_SENT_ARROW)
        to = _range_of(entries["gram"], ranges)
        order = np.argsort(to, kind="stable")
        to, entries = to[order], entries[order]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        ends = np.append(cut[1:], len(entries))
        blobs = [entries[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist())]
        n = len(blobs)
        yield pa.RecordBatch.from_arrays([pa.array(to[cut]), pa.array(blobs, pa.binary()), *(pa.nulls(n, f.type) for f in _FOUND_ARROW)], schema=_SENT_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()
        pieces, size = [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key in seen:
                    continue
                seen.add(key)
                text = text.as_py()
                for at in range(0, max(len(text) - LENGTH + 1, 0), SEGMENT - LENGTH):
                    piece = text[at : at + SEGMENT - 1]
                    if size + len(piece) > SEGMENT:
                        held.append(anchors(pieces))
                        n += len(held[-1])
                        pieces, size = [], 0
                    pieces.append((key, at, piece))
                    size += len(piece)
                if n > FLUSH:
                    yield from send(held)
                    held, n = [], 0
            if len(seen) > 1_000_000:
                seen.clear()
        held.append(anchors(pieces))
        yield from send(held)
        release()

    return run


def _apart(ranges: int, hot: np.ndarray):
    """Entries of the Q-grams in ``hot`` (sorted) are dealt out by their spans, in blobs of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for r, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                entries = np.frombuffer(blob, dtype=_ENTRY)
                at = np.minimum(np.searchsorted(hot, entries["gram"]), len(hot) - 1)
                mine = hot[at] == entries["gram"]
                if not mine.any():
                    rows.append((r, False, blob))
                    continue
                rows.append((r, False, entries[~mine].tobytes()))
                some = entries[mine]
                to = _range_of(some["span"], ranges)
                rows += [(int(k), True, some[to == k].tobytes()) for k in np.unique(to)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 3, (pa.int32(), pa.bool_(), pa.binary()))], ["range", "hot", "entries"])

    return run


def _settle(entries: np.ndarray, crowd: int = CROWD, apart: bool = False) -> list[pa.RecordBatch]:
    """Buckets of one range: anchors whose spans repeat (run), and of buckets with unlike spans one anchor for each (ask, or crowd if they are more than ``crowd``).

    ``apart``: the buckets are known to be hot, and what is here is a part of each.
    """
    entries, heads, repeated = _groups(entries)
    if not len(entries):
        return []
    sizes = np.diff(np.append(heads, len(entries)))
    out = [_found("run", entries[np.repeat(repeated, sizes)])]
    grams = entries["gram"][heads]
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    bucket = np.cumsum(new) - 1
    spans, open_spans = np.bincount(bucket), np.bincount(bucket, weights=~repeated)
    ask, crowded = ((spans > 1) & (open_spans > 0))[bucket], (spans > crowd)[bucket]
    if apart:
        ask = crowded = np.ones(len(bucket), dtype=bool)
    out.append(_found("ask", entries[heads[ask & ~crowded]]))
    out.append(_found("crowd", entries[heads[ask & crowded]]))
    return out


def _blobs(table: pa.Table, column: str) -> list[bytes]:
    return [b for b in table.column(column).to_pylist() if b]


def _refine(crowd: int):
    def run(table: pa.Table) -> pa.Table:
        apart = bool(table.num_rows and table.column("hot")[0].as_py())
        found = _settle(np.frombuffer(b"".join(_blobs(table, "entries")), dtype=_ENTRY).copy(), crowd, apart)
        return pa.Table.from_batches(found, schema=_FOUND_ARROW)

    return run


_CONTEXT = np.dtype([("text", "<i8"), ("first", "<u4"), ("count", "u1")])
_STRING = np.dtype([("pointer", "<u8"), ("other", "<u8"), ("text", "<i8"), ("first", "<u4"), ("twice", "u1")])
_ASKED = "range int, heads binary, bodies binary, strings binary"
_ASKED_ARROW = pa.schema([("range", pa.int32()), ("heads", pa.binary()), ("bodies", pa.binary()), ("strings", pa.binary())])


def _strings(held: list[np.ndarray]) -> np.ndarray:
    """Sorted, one for each distinct string, with ``twice`` if there are more; a string comes from one place once."""
    entries = np.concatenate(held)
    entries = entries[np.lexsort((1 - entries["twice"], entries["first"], entries["text"], entries["other"], entries["pointer"]))]
    same = (entries["pointer"][1:] == entries["pointer"][:-1]) & (entries["other"][1:] == entries["other"][:-1])
    again = same & (entries["text"][1:] == entries["text"][:-1]) & (entries["first"][1:] == entries["first"][:-1])
    entries = entries[np.concatenate([[True], ~again])] if len(entries) else entries
    return entries


def _companies(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heads of equal strings in sorted ``entries``, and for each entry whether its string repeats."""
    new = np.ones(len(entries), dtype=bool)
    new[1:] = (entries["pointer"][1:] != entries["pointer"][:-1]) | (entries["other"][1:] != entries["other"][:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(entries)))
    twice = np.maximum.reduceat(entries["twice"], heads) if len(heads) else np.zeros(0, np.uint8)
    return heads, np.repeat((sizes > 1) | (twice > 0), sizes)


def _each_string(key: int, data: np.ndarray, first: int, count: int) -> np.ndarray:
    """The strings of one anchor of a crowd, by the pointers at all their offsets."""
    part = data[first : first + count - 1 + LENGTH]
    sums = _sums(part)
    at = np.arange(len(part) - Q + 1)
    pointers = _mixed(_hash(sums, at, at + Q))
    starts, size, zero = np.arange(count), np.full(count, LENGTH), np.zeros(count, dtype=_U)
    out = np.zeros(count, dtype=_STRING)
    out["pointer"], out["other"] = _folded(pointers, starts, size, zero), _folded(pointers, starts, size, zero + _U(1), _U(0xD1B54A32D192ED03))
    out["text"], out["first"] = key, first + starts
    return out


def _contexts(ranges: int):
    """For each range: the bytes under the strings of the anchors that are asked for; strings of crowds, one by one."""

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        entries = _strings(held)
        heads, repeated = _companies(entries)
        # All that the task holds twice is settled here and comes back as runs (range null); one of each goes on.
        runs = _runs_of(entries["text"][repeated], entries["first"][repeated].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([runs.tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], schema=_ASKED_ARROW)
        some = entries[heads]
        some["twice"] = repeated[heads]
        to = _range_of(some["pointer"], ranges)
        order = np.argsort(to, kind="stable")
        to, some = to[order], some[order]
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.zeros(0, np.int64)
        blobs = [some[a:b].tobytes() for a, b in zip(cut.tolist(), np.append(cut[1:], len(some)).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(to[cut], pa.int32()), pa.nulls(len(blobs), pa.binary()), pa.nulls(len(blobs), pa.binary()), pa.array(blobs, pa.binary())], schema=_ASKED_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            by: dict[int, tuple[list, list]] = {}
            for key, text, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data, asked = text.as_py(), asked.as_py()
                to = _range_of(np.array([x["gram"] for x in asked], dtype=np.int64).view(_U), ranges).tolist()
                for r, x in zip(to, asked):
                    if x["crowd"]:
                        held.append(_each_string(key, np.frombuffer(data, dtype=np.uint8), x["first"], x["count"]))
                        n += x["count"]
                        continue
                    heads, bodies = by.setdefault(r, ([], []))
                    heads.append((key, x["first"], x["count"]))
                    bodies.append(data[x["first"] : x["first"] + x["count"] - 1 + LENGTH])
            rows = [(r, np.array(h, dtype=_CONTEXT).tobytes(), b"".join(b)) for r, (h, b) in by.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.nulls(len(rows), pa.binary())], schema=_ASKED_ARROW)
            if n > FLUSH:
                yield from send(held)
                held, n = [], 0
        if held:
            yield from send(held)
        release()

    return run


def _runs_of(texts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Entries (text, first, count) of strings that start next to each other, of at most 255 strings each."""
    order = np.lexsort((firsts, texts))
    texts, firsts = texts[order], firsts[order]
    new = np.ones(len(texts), dtype=bool)
    new[1:] = (texts[1:] != texts[:-1]) | (firsts[1:] != firsts[:-1] + 1)
    step = np.arange(len(texts)) - np.maximum.accumulate(np.where(new, np.arange(len(texts)), 0)) if len(texts) else firsts
    at = np.flatnonzero(new | (step % 255 == 0))
    out = np.zeros(len(at), dtype=_ENTRY)
    out["text"], out["first"] = texts[at], firsts[at]
    out["count"] = np.diff(np.append(at, len(texts)))
    return out


def _sorted_buckets(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the number of its bucket (of equal keys), and whether that has company."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    number = np.cumsum(new) - 1
    bucket = np.empty(len(order), dtype=np.int64)
    bucket[order] = number
    return bucket, (np.bincount(number, minlength=1) > 1)[bucket] if len(order) else np.zeros(0, dtype=bool)


def refined(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which strings of LENGTH bytes have company: for contexts of ``sizes`` bytes at ``starts``, whose first ``counts`` places each start a string.

    A flag for each string, context by context. Bucket numbers of each round are the pointers of the next.
    """
    n = len(data)
    room = np.zeros(n, dtype=np.int64)  # bytes from here to the end of the context
    room[:] = np.repeat(starts + sizes, sizes) - np.arange(n)
    pointers = np.zeros(n, dtype=_U)
    for a in range(0, n, SEGMENT):
        part = data[a : a + SEGMENT + Q - 1]
        at = np.arange(len(part) - Q + 1)
        pointers[a : a + len(at)] = _mixed(_hash(_sums(part), at, at + Q)) if len(at) else 0
    places = np.flatnonzero(room >= Q)
    bucket, company = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=bool)
    bucket[places], company[places] = _sorted_buckets(pointers[places])
    del pointers
    depth = Q
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        open_ = np.flatnonzero(company & (room >= depth + step))
        open_ = open_[company[open_ + step]]  # a later bucket without company closes this one
        found, more = _sorted_buckets(bucket[open_], bucket[open_ + step])
        bucket, company = np.full(n, -1, dtype=np.int64), np.zeros(n, dtype=bool)
        bucket[open_], company[open_] = found, more
        depth += step
    begin = np.repeat(starts, counts) + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return company[begin]


def _deepest(table: pa.Table) -> pa.Table:
    """Strings of one range in buckets at full depth: runs of those with company."""
    out = [np.frombuffer(b, dtype=_ENTRY) for r, b in zip(table.column("range").to_pylist(), table.column("heads").to_pylist()) if r == -1]
    if out:
        return pa.Table.from_batches([_found("run", np.concatenate(out).copy())], schema=_FOUND_ARROW)
    runs = []
    if strings := [np.frombuffer(b, dtype=_STRING) for b in _blobs(table, "strings")]:
        entries = _strings(strings)
        repeated = _companies(entries)[1]
        runs.append(_runs_of(entries["text"][repeated], entries["first"][repeated].astype(np.int64)))
    if heads := [np.frombuffer(b, dtype=_CONTEXT) for b in _blobs(table, "heads")]:
        head, data = np.concatenate(heads), np.frombuffer(b"".join(_blobs(table, "bodies")), dtype=np.uint8)
        counts = head["count"].astype(np.int64)
        sizes = counts + LENGTH - 1
        starts = np.cumsum(sizes) - sizes
        order = np.lexsort((head["first"], head["text"]))
        again = np.zeros(len(head), dtype=bool)  # one anchor that copies of a text have asked for more than once
        again[order[1:]] = (head["text"][order][1:] == head["text"][order][:-1]) & (head["first"][order][1:] == head["first"][order][:-1])
        if again.any():
            data = data[np.repeat(~again, sizes)]
            head, counts, sizes = head[~again], counts[~again], sizes[~again]
            starts = np.cumsum(sizes) - sizes
        hit = refined(data, starts, sizes, counts)
        who = np.repeat(np.arange(len(head)), counts)
        place = head["first"][who].astype(np.int64) + np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
        runs.append(_runs_of(head["text"][who[hit]], place[hit]))
    return pa.Table.from_batches([_found("run", np.concatenate(runs))] if runs else [], schema=_FOUND_ARROW)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _data (the text's bytes), _key and _twin: 64 bits each by which texts are told apart."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.withColumn("_data", data).withColumns({"_key": F.xxhash64("_data"), "_twin": F.xxhash64(F.lit(7), F.crc32("_data"), "_data")})


def _addressed(keyed: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """``keyed`` with one key: _key, or _twin for the few texts that have the _key of another."""
    if clashes is None:
        return keyed.drop("_twin")
    clash = F.broadcast(clashes.select(F.col("_key").alias("_clash")))
    return keyed.join(clash, F.col("_key") == F.col("_clash"), "left").withColumn("_key", F.when(F.col("_clash").isNull(), F.col("_key")).otherwise(F.col("_twin"))).drop("_clash", "_twin")


def _hot(sent: DataFrame, most: int) -> np.ndarray:
    """Q-grams of which tasks have told more than ``most`` parts in all: MOST_HOT of them at most."""
    sums = sent.filter("kind = 'many'").groupBy("gram").agg(F.sum(F.col("first").cast("long")).alias("parts")).filter(F.col("parts") > most)
    found = sums.groupBy(F.floor(F.log2(F.col("parts") / most)).cast("int").alias("k")).count().collect()  # some dozens of rows
    total, lowest = 0, 0
    for k, n in sorted(found, reverse=True):
        total += n
        if total > MOST_HOT:
            lowest = k + 1
            break
    return np.sort(np.array([r[0] for r in sums.filter(F.floor(F.log2(F.col("parts") / most)) >= lowest).select("gram").collect()], dtype=np.int64).view(_U))


def repeats(docs: DataFrame, at: str, crowd: int = CROWD, hot: int = HOT) -> tuple[DataFrame, DataFrame | None]:
    """(text key, copied, runs): of every text with repeated strings, where they start; ``copied`` if the text itself repeats.

    A run is (first, count): ``count`` strings of LENGTH bytes that start at ``first`` and next to each other. And the
    keys that are no address of one text, or None (of 10**10 texts, some two pairs).
    """
    spark = docs.sparkSession
    keyed = _keyed(docs.select("doc_id", "text")).select("doc_id", "_key", "_twin", "_data")
    texts = stored(keyed.groupBy("_key", "_twin").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("one"), F.max(F.octet_length("_data")).alias("size")), f"{at}/texts")
    clashes = stored(texts.groupBy("_key").count().filter("count > 1").select("_key"), f"{at}/clashes")
    clashes = clashes if clashes.limit(1).count() else None
    keyed, texts = _addressed(keyed, clashes), _addressed(texts, clashes)
    total = texts.agg(F.sum("size")).first()[0] or 0
    ranges = max(partitions(spark), total // RANGE_BYTES + 1)

    long_ones = keyed.filter(F.octet_length("_data") >= LENGTH)
    sent = stored(long_ones.select("_key", "_data").mapInArrow(_collect(ranges, max(2, min(64, hot // 64))), _SENT), f"{at}/sent")
    dealt, many = sent.filter("entries is not null").select("range", F.lit(False).alias("hot"), "entries"), _hot(sent, hot)
    if len(many):
        dealt = dealt.select("range", "entries").mapInArrow(_apart(ranges, many), "range int, hot boolean, entries binary")
    settled = dealt.groupBy("range", "hot").applyInArrow(_refine(crowd), _FOUND)
    settled = stored(settled, f"{at}/settled")
    own = stored(sent.filter("kind = 'run'").select("text", "first", "count"), f"{at}/own")
    discard(spark, f"{at}/sent")
    free_shuffles(spark)

    asked = settled.filter("kind <> 'run'").groupBy("text").agg(F.collect_list(F.struct("gram", "first", "count", (F.col("kind") == "crowd").alias("crowd"))).alias("asked"))
    asked = asked.join(texts.filter("copies > 1").select(F.col("_key").alias("_k"), "one"), F.col("text") == F.col("_k"), "left").select("text", "asked", "one")
    asked = stored(asked, f"{at}/asked")
    moved = asked.agg(F.sum(F.aggregate("asked", F.lit(0).cast("long"), lambda n, x: n + F.when(x["crowd"], x["count"] * 30).otherwise(x["count"] + LENGTH)))).first()[0] or 0
    deals = max(partitions(spark), moved // CONTEXT_BYTES + 1)
    asking = long_ones.join(asked.hint("shuffle_hash"), F.col("_key") == F.col("text")).filter("one is null or doc_id = one")
    deep = asking.select("_key", "_data", "asked").mapInArrow(_contexts(deals), _ASKED)
    # Runs that a task has settled itself (range -1) are many rows of their own, not one group.
    deep = deep.groupBy("range", F.when(F.col("range") == -1, F.xxhash64("heads")).alias("own")).applyInArrow(_deepest, _FOUND)
    deep = stored(deep, f"{at}/deep")
    free_shuffles(spark)

    runs = own.unionByName(settled.filter("kind = 'run'").select("text", "first", "count")).unionByName(deep.select("text", "first", "count"))
    runs = runs.groupBy("text").agg(F.collect_list(F.struct("first", "count")).alias("runs"))
    copied = texts.filter("copies > 1").select(F.col("_key").alias("_k"))
    both = runs.join(copied, F.col("text") == F.col("_k"), "full")
    found = stored(both.select(F.coalesce("text", "_k").alias("text"), F.col("_k").isNotNull().alias("copied"), "runs"), f"{at}/repeats")
    for name in ("settled", "own", "asked", "deep"):
        discard(spark, f"{at}/{name}")
    return found, clashes


def spans_of(size: int, copied: bool, runs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of bytes to remove, (from, to)."""
    if size < LENGTH:
        return []
    if copied:
        return [(0, size)]
    out: list[tuple[int, int]] = []
    for first, to in sorted((x["first"], x["first"] + x["count"] - 1 + LENGTH) for x in runs or []):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], to))
        else:
            out.append((first, to))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def whole_characters(data: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``spans`` without characters of which some bytes stay."""
    out = []
    for a, b in spans:
        while a < b and a < len(data) and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, copied, runs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
            data = text.as_py()
            spans = spans_of(len(data), bool(copied), runs.as_py())
            rows.append((doc, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest()))
        columns = list(zip(*rows)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, data, copied, runs) -> (row, kept)."""
    for batch in batches:
        kept = []
        for text, copied, runs in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
            data = text.as_py()
            kept.append(without(data, whole_characters(data, spans_of(len(data), bool(copied), runs.as_py()))).decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["row", "kept"])


def _joined(docs: DataFrame, keep: Column, name: str, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    """``keep`` under ``name``, with _data, _copied and _runs; other columns of ``docs`` can have any names."""
    found, clashes = repeats(docs.select("doc_id", "text"), shared_dir(docs.sparkSession), crowd, hot)
    found = found.withColumnsRenamed({"text": "_text", "copied": "_copied", "runs": "_runs"})
    keyed = _addressed(_keyed(docs.select(keep.alias(name), "text")), clashes)
    return keyed.join(found.hint("shuffle_hash"), F.col("_key") == F.col("_text"), "left").select(name, "_data", "_copied", "_runs")


def op9(docs: DataFrame, crowd: int = CROWD, hot: int = HOT) -> DataFrame:
    return _joined(docs, F.col("doc_id"), "doc_id", crowd, hot).mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings taken out of ``text``, whole characters only; all columns stay, and a null text stays null."""
    row = F.struct(F.struct(*[c for c in docs.columns if c != "text"]).alias("others"), F.col("text").isNull().alias("missing"))
    schema = T.StructType([T.StructField("row", docs.select(row.alias("row")).schema["row"].dataType), T.StructField("kept", T.StringType())])
    left = _joined(docs, row, "row").mapInArrow(_texts, schema)
    return left.select(*[F.when(~F.col("row")["missing"], F.col("kept")).alias(c) if c == "text" else F.col("row")["others"][c].alias(c) for c in docs.columns])
