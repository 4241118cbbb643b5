"""Binary files made from table rows, for queries that read them back: archives, packed entries, zips, executables, geometry."""

from __future__ import annotations

import heapq
import struct
import zlib
from collections import Counter
from collections.abc import Iterable

from ..operators import codec

WINDOW, LONGEST, MOST_CODES = 8192, 256, 60_000


class Bits:
    def __init__(self):
        self.parts: list[str] = []

    def put(self, value: int, n: int) -> None:
        if n:
            self.parts.append(format(value, f"0{n}b"))

    def bytes(self) -> bytes:
        bits = "".join(self.parts)
        bits += "0" * (-len(bits) % 8)
        return int(bits or "0", 2).to_bytes(len(bits) // 8, "big")


def code_lengths(counts: dict[int, int], alphabet: int) -> list[int]:
    """Lengths of a full code of at most 16 bits; frequencies are halved until it fits."""
    while True:
        heap = [(n, s, k) for k, (s, n) in enumerate(counts.items())]
        heapq.heapify(heap)
        above = list(range(len(heap)))  # node -> the one above it, a later one; the last is above all
        while len(heap) > 1:
            n, _, a = heapq.heappop(heap)
            m, s, b = heap[0]
            above[a] = above[b] = len(above)
            heapq.heapreplace(heap, (n + m, s, len(above)))
            above.append(0)
        depth = [0] * len(above)
        for k in range(len(above) - 2, -1, -1):
            depth[k] = depth[above[k]] + 1
        if max(depth) <= codec.LONGEST_CODE:
            lengths = [0] * alphabet
            for s, n in zip(counts, depth):
                lengths[s] = n
            return lengths
        counts = {s: (n + 1) // 2 for s, n in counts.items()}


def codes_of(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, bits), canonical."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        out[s], last = (code, n), n
        code += 1
    return out


def _table(counts: dict[int, int], alphabet: int) -> tuple[list[int] | None, dict[int, tuple[int, int]]]:
    """Lengths and codes; a single symbol has no lengths and a code of no bits."""
    if len(counts) < 2:
        return None, {s: (0, 0) for s in counts}
    lengths = code_lengths(counts, alphabet)
    return lengths, codes_of(lengths)


def _texts(codes: dict[int, tuple[int, int]]) -> dict[int, str]:
    return {s: format(code, f"0{n}b") if n else "" for s, (code, n) in codes.items()}


def _put_short(bits: Bits, lengths: list[int] | None, counts: dict[int, int], width: int, gap: int | None) -> None:
    if lengths is None:
        bits.put(0, width)
        bits.put(next(iter(counts), 0), width)
        return
    n = max(s for s, x in enumerate(lengths) if x) + 1
    bits.put(n, width)
    at = 0
    while at < n:
        x = lengths[at]
        bits.put(min(x, 7), 3)
        if x >= 7:
            bits.put((1 << (x - 6)) - 2, x - 6)
        at += 1
        if at == gap:
            zeros = 0
            while zeros < 3 and at + zeros < n and not lengths[at + zeros]:
                zeros += 1
            bits.put(zeros, 2)
            at += zeros


def _runs(lengths: list[int]) -> list[tuple[int, int, int]]:
    """(symbol, value, bits of the value) of the lengths up to the last that is not zero."""
    n, out, at = max(s for s, x in enumerate(lengths) if x) + 1, [], 0
    while at < n:
        zeros = 0
        while at + zeros < n and not lengths[at + zeros]:
            zeros += 1
        if zeros >= 20:
            zeros = min(zeros, 531)
            out.append((2, zeros - 20, codec.CHAR_BITS))
        elif zeros >= 3:
            zeros = min(zeros, 18)
            out.append((1, zeros - 3, 4))
        elif zeros:
            zeros = 1
            out.append((0, 0, 0))
        else:
            out.append((lengths[at] + 2, 0, 0))
        at += max(zeros, 1)
    return out


def _matches(raw: bytes) -> list[tuple[int, int]]:
    """(symbol, distance - 1) by the latest place of the next three bytes; literals have no distance."""
    seen: dict[bytes, int] = {}
    out, at = [], 0
    keys = [raw[i : i + 3] for i in range(len(raw) - 2)]
    while at < len(keys):
        k = seen.get(keys[at])
        if k is None or at - k > WINDOW:
            out.append((raw[at], -1))
            seen[keys[at]] = at
            at += 1
            continue
        best, most = 3, min(LONGEST, len(raw) - at)
        while best < most and raw[k + best] == raw[at + best]:
            best += 1
        out.append((best + 253, at - k - 1))
        end = at + best
        seen.update(zip(keys[at:end], range(at, end)))
        at = end
    return out + [(x, -1) for x in raw[at:]]


def lzh_encoded(raw: bytes) -> bytes:
    """A stream of the smallest dictionary that :func:`ashlar.operators.codec.lzh` decodes."""
    bits, all_codes = Bits(), _matches(raw)
    for start in range(0, len(all_codes), MOST_CODES):
        some = all_codes[start : start + MOST_CODES]
        bits.put(len(some), 16)
        chars, places = Counter(s for s, _ in some), Counter(d.bit_length() for _, d in some if d >= 0)
        char_lengths, char_codes = _table(chars, codec.CHAR_CODES)
        place_lengths, place_codes = _table(places, 14)
        if char_lengths is None:
            _put_short(bits, None, {}, codec.TEMP_BITS, 3)
            bits.put(0, codec.CHAR_BITS)
            bits.put(next(iter(chars)), codec.CHAR_BITS)
        else:
            runs = _runs(char_lengths)
            temp = Counter(s for s, _, _ in runs)
            temp_lengths, temp_codes = _table(temp, codec.TEMP_CODES)
            _put_short(bits, temp_lengths, temp, codec.TEMP_BITS, 3)
            bits.put(max(s for s, x in enumerate(char_lengths) if x) + 1, codec.CHAR_BITS)
            for s, value, n in runs:
                bits.put(*temp_codes[s])
                bits.put(value, n)
        _put_short(bits, place_lengths, places, 4, None)
        char_bits, place_bits = _texts(char_codes), _texts(place_codes)
        # A distance's bits after the first, which its slot tells.
        bits.parts += [char_bits[s] if d < 0 else char_bits[s] + place_bits[d.bit_length()] + bin(d)[3:] for s, d in some]
    return bits.bytes()


def frame(raw_size: int, payload: bytes) -> bytes:
    return codec.MAGIC + struct.pack("<II", raw_size, len(payload)) + payload


def packed_entry(raw: bytes, chunk: int = codec.CHUNK_RAW) -> bytes:
    """Chunks of ``raw``, each encoded, or verbatim where that does not make it smaller."""
    out = b""
    for at in range(0, len(raw), chunk):
        part = raw[at : at + chunk]
        payload = lzh_encoded(part)
        out += frame(len(part), payload if len(payload) < len(part) else part)
    return out


HEADER = 0x100


def archive(entries: Iterable[dict]) -> bytes:
    """An archive of entries (path or None for an entry without a name, data, b, c, low, middle), whose header reads ``negated<<8``.

    Data stands in the order of entries, at multiples of 16. Nodes: directories before what they have; an entry with ``again`` has a second node.
    """
    body, records = bytearray(HEADER), []
    nodes, blob, folders = [(0, 0, 0, 0xFFFF, 0)], bytearray(b"\0"), {}

    def add(name: str, parent: int, link: int) -> int:
        at = len(blob)
        blob.extend(name.encode("latin-1") + b"\0")
        nodes.append((link, 0, at, parent, 0))
        return len(nodes) - 1

    again = []
    for id_, e in enumerate(entries):
        offset = len(body)
        records.append((offset >> 8, e["b"], e["c"], ((offset & 255) << 24) | (e["middle"] << 8) | e["low"]))
        body.extend(e["data"] + b"\0" * (-len(e["data"]) % 16))
        if e["path"] is None:
            continue
        *dirs, leaf = e["path"].split("/")
        parent, at = 0, ""
        for d in dirs:
            at += f"{d}/"
            if at not in folders:
                folders[at] = add(d, parent, 1)
            parent = folders[at]
        add(leaf, parent, -id_)
        again += [id_] if e.get("again") else []
    for id_ in again:
        add("again", 0, -id_)
    body.extend(b"\0" * (-len(body) % 256))
    table = struct.pack("<II", 0xFFFFFFFA, len(records)) + b"".join(struct.pack("<4I", *r) for r in records)
    table += struct.pack("<I", len(nodes)) + b"".join(struct.pack("<hHIHH", *n) for n in nodes) + struct.pack("<I", len(blob)) + bytes(blob)
    struct.pack_into("<II", body, 0, ~((len(body) - HEADER) >> 8) & 0xFFFFFFFF, len(table))
    return bytes(body) + table


def zipped(entries: Iterable[tuple[str, bytes, int]]) -> bytes:
    """Stored entries (name, data, flags) with a central directory."""
    local, central, n = b"", b"", 0
    for name, data, flags in entries:
        raw = name.encode()
        head = struct.pack("<HHHHHIIIHH", 20, flags, 0, 0, 0, zlib.crc32(data), len(data), len(data), len(raw), 0)
        central += b"PK\1\2" + struct.pack("<H", 20) + head + struct.pack("<HHHII", 0, 0, 0, 0, len(local)) + raw
        local += b"PK\3\4" + head + raw + data
        n += 1
    return local + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, n, n, len(central), len(local), 0)


def pe(machine: int, libraries: list[str]) -> bytes:
    """One section at the address 0x1000 has the import table and the names."""
    size = 20 * (len(libraries) + 1)
    names, table, at = b"", b"", 0x1000 + size
    for name in libraries:
        table += struct.pack("<IIIII", 1, 0, 0, at, 1)
        names += name.encode() + b"\0"
        at += len(name) + 1
    section = table + b"\0" * 20 + names
    out = bytearray(0x400)
    out[:2], out[0x80:0x84] = b"MZ", b"PE\0\0"
    struct.pack_into("<I", out, 0x3C, 0x80)
    struct.pack_into("<HHIIIHH", out, 0x84, machine, 1, 0, 0, 0, 240, 0)
    struct.pack_into("<H", out, 0x98, 0x20B)
    struct.pack_into("<I", out, 0x98 + 108, 16)
    struct.pack_into("<II", out, 0x98 + 120, 0x1000, size)
    struct.pack_into("<IIII", out, 0x98 + 240 + 8, len(section), 0x1000, len(section), 0x400)
    return bytes(out) + section


def elf(machine: int, libraries: list[str], little: bool = True, wide: bool = True) -> bytes:
    """A loaded segment at 0x400000 holds all; the dynamic table names the libraries."""
    order, base = "<" if little else ">", 0x400000
    strings, needed = b"\0", []
    for name in libraries:
        needed.append(len(strings))
        strings += name.encode() + b"\0"
    head, entry = (64, 56) if wide else (52, 32)
    pair = order + ("qQ" if wide else "iI")
    dynamic_at = head + 2 * entry
    count = len(needed) + 3
    strings_at = dynamic_at + count * struct.calcsize(pair)
    dynamic = b"".join(struct.pack(pair, 1, n) for n in needed) + struct.pack(pair, 5, base + strings_at) + struct.pack(pair, 10, len(strings)) + struct.pack(pair, 0, 0)
    total = strings_at + len(strings)
    ident = b"\x7fELF" + bytes((2 if wide else 1, 1 if little else 2, 1)) + b"\0" * 9
    if wide:
        top = ident + struct.pack(order + "HHIQQQIHHHHHH", 3, machine, 1, 0, head, 0, 0, head, entry, 2, 0, 0, 0)
        segment = lambda kind, at, n: struct.pack(order + "IIQQQQQQ", kind, 0, at, base + at, 0, n, n, 8)
    else:
        top = ident + struct.pack(order + "HHIIIIIHHHHHH", 3, machine, 1, 0, head, 0, 0, head, entry, 2, 0, 0, 0)
        segment = lambda kind, at, n: struct.pack(order + "IIIIIIII", kind, at, base + at, 0, n, n, 0, 4)
    return top + segment(1, 0, total) + segment(2, dynamic_at, len(dynamic)) + dynamic + strings


def mach(cpu: int, libraries: list[str], little: bool = True) -> bytes:
    order, commands = "<" if little else ">", b""
    for name in libraries:
        raw = name.encode() + b"\0"
        size = (24 + len(raw) + 7) // 8 * 8
        commands += (struct.pack(order + "IIIIII", 0x0C, size, 24, 0, 0, 0) + raw).ljust(size, b"\0")
    return struct.pack(order + "I", 0xFEEDFACF) + struct.pack(order + "IIIIIII", cpu, 0, 2, len(libraries), len(commands), 0, 0) + commands


def fat(cpus: list[int]) -> bytes:
    return struct.pack(">II", 0xCAFEBABE, len(cpus)) + b"".join(struct.pack(">IIIII", c, 0, 4096 * (k + 1), 16, 12) for k, c in enumerate(cpus))


def geometry(points: list[tuple[float, float, float]], w: float, triangles: list[int], version: int) -> bytes:
    """A container with one inline vertex buffer of half floats and one index buffer."""
    objects = b"HSEM" + struct.pack(">I", version)
    objects += struct.pack(">II", 0x502, len(points)) + b"DXTV" + struct.pack(">II", 169, 1) + bytes((0, 6, 0)) + b"\0" * 6
    objects += b"".join(struct.pack("<4e", *p, w) for p in points)
    objects += struct.pack(">III", 0x102, len(triangles), 2) + struct.pack(f"<{len(triangles)}H", *triangles)
    resh = b".CC4HSERHSER".ljust(40, b"\0")
    nu20 = struct.pack(">II", 12 + len(objects), 1) + b"02UN" + struct.pack(">I", 78) + objects
    return struct.pack(">I", len(resh)) + resh + nu20 + b"\0" * 124 + b"META"
