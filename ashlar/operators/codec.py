"""Chunk framing and LZH decompression of archive entries, and a scoreboard of codec parameters.

Chunks are decoded on their own: each begins with empty history. Framing is sequential within an entry.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.classify import format_of, leaf_extension
from ..functions.rows import flat_map
from ..sources.shared import stored
from . import stats

MAGIC, MOST_CHUNKS = b"LZ2K", 1 << 20
#: Raw bytes of a chunk that is not the last; entropies of chunks that are summed up.
CHUNK_RAW, ENTROPY_CHUNKS = 0x8000, 4000
# Name, bits of the dictionary, bits of a count of position codes.
PARAMETERS = (("lh5", 13, 4), ("lh6", 15, 5), ("lh7", 16, 5))
CHAR_CODES, CHAR_BITS, TEMP_CODES, TEMP_BITS, LONGEST_CODE = 510, 9, 19, 5, 16


class Broken(ValueError):
    """Input that no encoder writes."""


def frames(entry: bytes, expected: int | None) -> tuple[list[tuple[int, int, int]], int, str | None]:
    """([(header offset, raw size, packed size)], bytes left over, failure or None)."""
    if not entry[:12]:
        return [], 0, "too small for a chunk header"
    found, at, total = [], 0, 0
    while len(entry) - at >= 12:
        magic, raw, packed = entry[at : at + 4], *struct.unpack_from("<II", entry, at + 4)
        if magic != MAGIC:
            if not found:
                return found, len(entry), "no LZ2K magic at the start"
            break
        if not raw or not packed:
            return found, len(entry) - at, "zero raw or packed size"
        if at + 12 + packed > len(entry):
            return found, len(entry) - at, "payload runs past the entry"
        if len(found) == MOST_CHUNKS:
            return found, len(entry) - at, "too many chunks"
        found.append((at, raw, packed))
        at, total = at + 12 + packed, total + raw
    left = len(entry) - at
    if not found:
        return found, left, "too small for a chunk header"
    if expected is not None and total != expected:
        return found, left, "raw sizes do not add up to the expected size"
    return found, left, "bytes left after the last chunk" if left else None


class Bits:
    """Most significant bit first; zeros past the end, which ``short`` tells. A window of 64 bits or more is held at a time, so a read takes the same time wherever it is."""

    STEP = 64

    def __init__(self, data: bytes):
        self.data, self.size = data, 8 * len(data)
        self.word, self.held, self.next = 0, 0, 0  # bits that are held, how many, next byte

    def fill(self) -> None:
        part = self.data[self.next : self.next + self.STEP]
        self.word = (self.word << 8 * self.STEP) | (int.from_bytes(part, "big") << 8 * (self.STEP - len(part)))
        self.held, self.next = self.held + 8 * self.STEP, self.next + self.STEP

    def get(self, n: int) -> int:
        if self.held < n:
            self.fill()
        self.held = held = self.held - n
        v = self.word >> held
        self.word &= (1 << held) - 1
        return v

    @property
    def at(self) -> int:
        return 8 * self.next - self.held

    @property
    def short(self) -> bool:
        return self.at > self.size


class Codes:
    """Canonical prefix code, as tables over the next ``longest`` bits; a single symbol takes no bits."""

    def __init__(self, lengths: list[int] | None, only: int | None = None):
        self.longest, self.symbol, self.length = 0, [only], [0]
        if lengths is None:
            return
        # Symbols in the order of their codes; a code of n bits stands for 2 ** (longest - n) words.
        ordered = sorted([(n, symbol) for symbol, n in enumerate(lengths) if n])
        longest = ordered[-1][0] if ordered else 0
        if not ordered or sum([1 << (longest - n) for n, _ in ordered]) != 1 << longest:
            raise Broken("code lengths do not make a full code")
        self.longest, self.symbol, self.length = longest, [], []
        for n, symbol in ordered:
            self.symbol += [symbol] * (1 << (longest - n))
            self.length += [n] * (1 << (longest - n))

    def read(self, bits: Bits) -> int:
        if bits.held < self.longest:
            bits.fill()
        word = bits.word >> (bits.held - self.longest)
        bits.held = held = bits.held - self.length[word]
        bits.word &= (1 << held) - 1
        return self.symbol[word]


def _short_codes(bits: Bits, codes: int, width: int, gap: int | None) -> Codes:
    """The code of the lengths, or of the positions. After ``gap`` lengths come up to three zeros, as far as the alphabet goes."""
    n = bits.get(width)
    if n == 0:
        if (only := bits.get(width)) >= codes:
            raise Broken("the only symbol is not in the alphabet")
        return Codes(None, only)
    if n > codes:
        raise Broken("too many code lengths")
    lengths: list[int] = []
    while len(lengths) < n:
        length = bits.get(3)
        if length == 7:
            while bits.get(1):
                length += 1
                if length > LONGEST_CODE:
                    raise Broken("code length above the limit")
        lengths.append(length)
        if len(lengths) == gap:
            lengths += [0] * min(bits.get(2), codes - len(lengths))
        if bits.short:
            raise Broken("input ends within a table")
    return Codes(lengths)


def _char_codes(bits: Bits, temp: Codes) -> Codes:
    n = bits.get(CHAR_BITS)
    if n == 0:
        if (only := bits.get(CHAR_BITS)) >= CHAR_CODES:
            raise Broken("the only symbol is not in the alphabet")
        return Codes(None, only)
    if n > CHAR_CODES:
        raise Broken("too many code lengths")
    lengths: list[int] = []
    while len(lengths) < n:
        s = temp.read(bits)
        lengths += [0] if s == 0 else [0] * (bits.get(4) + 3) if s == 1 else [0] * (bits.get(CHAR_BITS) + 20) if s == 2 else [s - 2]
        if len(lengths) > CHAR_CODES:
            raise Broken("run of zeros past the alphabet")
        if bits.short:
            raise Broken("input ends within a table")
    return Codes(lengths)


def lzh(data: bytes, size: int, dictionary: int = 13, positions: int = 4, opening: list | None = None) -> dict:
    """Decode ``size`` bytes: output, ok, failure, blocks, codes that the last block still has, and bytes of input left over.

    What the first block has before its positions is the same for all parameter sets: an empty list ``opening`` takes
    it, and it is not read again when the list comes with the same data.
    """
    bits, out, n, blocks, failure, left = Bits(data), bytearray(), 0, 0, None, 0
    try:
        while n < size and not failure:
            if not left:
                if opening and not blocks:
                    left, chars, bits.word, bits.held, bits.next = opening
                    blocks = 1
                else:
                    left = bits.get(16)
                    if not left:
                        raise Broken("block of no symbols")
                    blocks += 1
                    temp = _short_codes(bits, TEMP_CODES, TEMP_BITS, 3)
                    chars = _char_codes(bits, temp)
                    if opening is not None and blocks == 1:
                        opening += [left, chars, bits.word, bits.held, bits.next]
                places = _short_codes(bits, dictionary + 1, positions, None)
            # Most of the time goes here: what is held is in local names, without calls.
            symbols, lengths, longest = chars.symbol, chars.length, chars.longest
            slots, slot_lengths, slot_longest = places.symbol, places.length, places.longest
            word, held, past = bits.word, bits.held, 8 * bits.next - bits.size
            while left and n < size:
                if held < 64:  # a code, a slot and its further bits are at most 47
                    bits.word, bits.held = word, held
                    bits.fill()
                    word, held, past = bits.word, bits.held, 8 * bits.next - bits.size
                left -= 1
                at = word >> (held - longest)
                held -= lengths[at]
                word &= (1 << held) - 1
                symbol = symbols[at]
                if symbol < 256:
                    out.append(symbol)
                    n += 1
                else:
                    at = word >> (held - slot_longest)
                    held -= slot_lengths[at]
                    word &= (1 << held) - 1
                    length, slot = symbol - 253, slots[at]
                    distance = 1 + slot
                    if slot > 1:
                        held -= slot - 1
                        distance = 1 + (1 << (slot - 1)) + (word >> held)
                        word &= (1 << held) - 1
                    if distance > n:
                        failure = "match reaches before the chunk"
                        break
                    if n + length > size:
                        failure = "match runs past the declared raw size"
                        break
                    part = out[n - distance : n - distance + length]
                    out += part if distance >= length else (part * (length // distance + 1))[:length]
                    n += length
                if held < past:
                    failure = "input ends before the output is full"
                    break
            bits.word, bits.held = word, held
    except Broken as e:
        failure = str(e)
    return {"output": bytes(out), "ok": failure is None, "failure": failure, "blocks": blocks, "codes_left": left, "left": len(data) - -(-bits.at // 8)}


def decompress(entry: bytes, expected: int) -> tuple[bytes, str | None]:
    found, _, failure = frames(entry, expected)
    if failure:
        return b"", failure
    out = []
    for at, raw, packed in found:
        payload = entry[at + 12 : at + 12 + packed]
        if raw == packed:
            out.append(payload)
            continue
        got = lzh(payload, raw)
        if not got["ok"]:
            return b"", got["failure"]
        out.append(got["output"])
    return b"".join(out), None


def _chunk_rows(key: str, entry: bytes | None, expected: int | None) -> Iterator[dict]:
    found, left, failure = frames(entry or b"", expected)
    if failure or not found:
        yield {"key": key, "chunk_no": None, "header_offset": None, "raw_size": None, "packed_size": None, "payload": None, "left": left, "failure": failure}
    for k, (at, raw, packed) in enumerate(found):
        yield {"key": key, "chunk_no": k, "header_offset": at, "raw_size": raw, "packed_size": packed, "payload": entry[at + 12 : at + 12 + packed], "left": left, "failure": failure}


def chunks(entries: DataFrame) -> DataFrame:
    """Chunks of ``entries`` (key, entry, expected); an entry with a failure has a row without chunk that tells it."""
    return flat_map(entries, ["key", "entry", "expected"], _chunk_rows, "key string, chunk_no int, header_offset long, raw_size long, packed_size long, payload binary, left long, failure string")


def decompressed(entries: DataFrame) -> DataFrame:
    """(key, output, failure) of ``entries`` (key, entry, expected)."""

    def one(key: str, entry: bytes | None, expected: int) -> Iterator[dict]:
        out, failure = decompress(entry or b"", expected)
        yield {"key": key, "output": out, "failure": failure}

    return flat_map(entries, ["key", "entry", "expected"], one, "key string, output binary, failure string")


def scoreboard(entries: DataFrame) -> DataFrame:
    """Entries (key, entry, expected) decoded with each of the parameter sets; those whose framing is invalid do not count.

    Of each set: entries, entries_ok, chunks that are not verbatim, how many decode, how many end on the last byte, bytes
    left over (slack) and failures as maps to their counts, and the first failure of each kind by key and chunk.
    """

    def tried(key: str, entry: bytes | None, expected: int | None) -> Iterator[dict]:
        found, _, failure = frames(entry or b"", expected)
        if failure:
            return
        good, sizes = {p: True for p, _, _ in PARAMETERS}, {p: 0 for p, _, _ in PARAMETERS}
        for no, (at, raw, packed) in enumerate(found):
            payload, opening = entry[at + 12 : at + 12 + packed], []
            for name, dictionary, positions in PARAMETERS:
                if raw == packed:
                    sizes[name] += raw
                    continue
                got = lzh(payload, raw, dictionary, positions, opening)
                good[name], sizes[name] = good[name] and got["ok"], sizes[name] + len(got["output"])
                yield {"key": key, "chunk_no": no, "parameters": name, "ok": got["ok"], "left": got["left"] if got["ok"] else None, "failure": got["failure"], "entry_ok": None}
        for name, _, _ in PARAMETERS:
            yield {"key": key, "chunk_no": None, "parameters": name, "ok": None, "left": None, "failure": None, "entry_ok": good[name] and sizes[name] == expected}

    rows = flat_map(entries, ["key", "entry", "expected"], tried, "key string, chunk_no int, parameters string, ok boolean, left long, failure string, entry_ok boolean")
    # Entries are decoded once: what is left of them are counts and the first key and chunk of each outcome.
    known = rows.groupBy("parameters", "ok", "left", "failure", "entry_ok").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "chunk_no")).alias("first"))
    known = stored(known)
    many = lambda which: F.coalesce(F.sum(F.when(which, F.col("n"))), F.lit(0).cast("bigint"))
    entry_ok, ok = F.col("entry_ok"), F.col("ok")
    totals = known.groupBy("parameters").agg(
        many(entry_ok.isNotNull()).alias("entries"), many(entry_ok).alias("entries_ok"), many(ok.isNotNull()).alias("chunks"), many(ok).alias("ok"), many(F.col("left") == 0).alias("exact_end"),
    )
    to_map = lambda key, value: F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value))))
    slack = known.filter("left is not null").groupBy("parameters", "left").agg(many(F.lit(True)).alias("n")).groupBy(F.col("parameters").alias("_s")).agg(to_map("left", "n").alias("slack"))
    failed = known.filter("failure is not null").groupBy("parameters", "failure").agg(many(F.lit(True)).alias("n"), F.min("first").alias("first"))
    failed = failed.groupBy(F.col("parameters").alias("_f")).agg(to_map("failure", "n").alias("failures"), to_map("failure", "first").alias("first_failures"))
    return totals.join(slack, F.col("parameters") == F.col("_s"), "left").join(failed, F.col("parameters") == F.col("_f"), "left").drop("_s", "_f")


def sniffs(entries: DataFrame, most: int = 3, head: int = 48) -> DataFrame:
    """Of each parameter set and extension of ``entries`` (key, path, entry, expected) the first ``most`` that decode: head and format of the output."""

    def tried(key: str, path: str, entry: bytes | None, expected: int | None) -> Iterator[dict]:
        found, _, failure = frames(entry or b"", expected)
        for name, dictionary, positions in [] if failure else PARAMETERS:
            parts = [(entry[at + 12 : at + 12 + packed], raw, packed) for at, raw, packed in found]
            whole = [{"ok": True, "output": part} if raw == packed else lzh(part, raw, dictionary, positions) for part, raw, packed in parts]
            if all(w["ok"] for w in whole):
                yield {"key": key, "path": path, "parameters": name, "output": b"".join(w["output"] for w in whole)[:4096]}

    rows = flat_map(entries, ["key", "path", "entry", "expected"], tried, "key string, path string, parameters string, output binary")
    rows = rows.select("parameters", leaf_extension(F.element_at(F.split("path", "/"), -1)).alias("extension"), "key", F.substring("output", 1, head).alias("head"), format_of(F.col("output")).alias("format"))
    return stats.first_n(rows, ["parameters", "extension"], ["key"], most)


def framing_failures(found: DataFrame, examples: int = 5) -> DataFrame:
    """Entries (of :func:`chunks`) by what is wrong with their framing, with the first ``examples`` keys of each. Failures are of a fixed number."""
    bad = found.filter("failure is not null").select("failure", "key").distinct()
    counts = bad.groupBy("failure").agg(F.count(F.lit(1)).alias("entries"))
    few = stats.first_n(bad, ["failure"], ["key"], examples).groupBy(F.col("failure").alias("_f")).agg(F.sort_array(F.collect_list("key")).alias("examples"))
    return counts.join(few, F.col("failure") == F.col("_f")).drop("_f")


def chunk_counts(found: DataFrame, by: list[str] | None = None, key: str = "key", most: int = 16) -> DataFrame:
    """Entries by how many chunks they have, those of more than ``most`` in one class, and the largest number in each class."""
    by = by or []
    per = found.groupBy(*by, *([key] if isinstance(key, str) else key)).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by, F.least("n", F.lit(most + 1)).alias("chunks")).agg(F.count(F.lit(1)).alias("entries"), F.max("n").alias("most"))


def framing_report(found: DataFrame, most: int = 16) -> DataFrame:
    """Entries whose framing is valid by how many chunks they have."""
    return chunk_counts(found.filter("chunk_no is not null and failure is null"), most=most)


def with_last(found: DataFrame) -> DataFrame:
    """Chunks of valid entries with ``is_last``."""
    good = found.filter("chunk_no is not null and failure is null")
    last = good.groupBy(F.col("key").alias("_k")).agg(F.max("chunk_no").alias("_last"))
    return good.join(last, F.col("key") == F.col("_k")).withColumn("is_last", F.col("chunk_no") == F.col("_last")).drop("_k", "_last")


def size_counts(found: DataFrame) -> DataFrame:
    """One row: chunks, last ones of more than CHUNK_RAW raw bytes, those that packing did not make smaller, those of equal sizes."""
    return with_last(found).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("is_last") & (F.col("raw_size") > CHUNK_RAW)).alias("last_above"),
        F.count_if(F.col("packed_size") >= F.col("raw_size")).alias("packed_at_least_raw"), F.count_if(F.col("packed_size") == F.col("raw_size")).alias("packed_equals_raw"),
    )


def raw_sizes(found: DataFrame) -> DataFrame:
    """Raw sizes of the chunks that are not the last of their entry."""
    return with_last(found).filter("not is_last").groupBy("raw_size").agg(F.count(F.lit(1)).alias("chunks"))


def first_bytes(found: DataFrame, n: int = 24) -> DataFrame:
    """The most frequent first bytes of payloads."""
    first = F.conv(F.hex(F.substring("payload", 1, 1)), 16, 10).cast("bigint")
    return stats.top_overall(found.filter("chunk_no is not null and failure is null").select(first.alias("first_byte")), "first_byte", n, "chunks")


def entropies(found: DataFrame, most: int = ENTROPY_CHUNKS) -> DataFrame:
    """Mean, least and largest entropy of the first ``most`` chunks by key and number; 0, 9 and 0 without any."""
    few = found.filter("chunk_no is not null and failure is null").orderBy("key", "chunk_no").limit(most)
    e = few.select(stats.entropy_udf()(F.col("payload")).alias("e"))
    return e.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.avg("e"), F.lit(0.0)).alias("mean"), F.coalesce(F.min("e"), F.lit(9.0)).alias("least"), F.coalesce(F.max("e"), F.lit(0.0)).alias("largest"))


def ratio(packed, raw):
    """Packed to raw bytes, 0 where there are no raw ones."""
    return F.coalesce(F.try_divide(packed.cast("double"), raw.cast("double")), F.lit(0.0))


def ratios(entries: DataFrame, n: int = 30) -> DataFrame:
    """Entries, raw and packed bytes and their ratio by extension of ``entries`` (name, raw, packed): the ``n`` largest by raw bytes, the later extension first among equals."""
    sums = entries.groupBy(leaf_extension(F.col("name")).alias("extension")).agg(F.count(F.lit(1)).alias("entries"), F.sum("raw").alias("raw"), F.sum("packed").alias("packed"))
    return sums.withColumn("ratio", ratio(F.col("packed"), F.col("raw"))).orderBy(F.col("raw").desc(), F.col("extension").desc()).limit(n)


def smallest(found: DataFrame, n: int = 24, head: int = 128) -> DataFrame:
    """The ``n`` smallest chunks of valid entries by raw size, packed size and place, in a total order, with the first bytes of their payloads."""
    few = found.filter("chunk_no is not null and failure is null").orderBy("raw_size", "packed_size", "key", "chunk_no").limit(n)
    return few.withColumn("head", F.substring("payload", 1, head)).drop("payload")
