"""Binary fixtures, built in memory."""

import struct


def dat_file(table_offset: int, table: bytes, body: dict[int, bytes] | None = None) -> bytes:
    """An archive whose header reads ``negated<<8``."""
    out = bytearray(table_offset)
    struct.pack_into("<II", out, 0, (~((table_offset - 0x100) >> 8)) & 0xFFFFFFFF, len(table))
    for at, data in (body or {}).items():
        out[at : at + len(data)] = data
    return bytes(out) + table


def table(records: list[tuple[int, int, int, int]], trailing: bytes = b"") -> bytes:
    return struct.pack("<II", 0xFFFFFFFA, len(records)) + b"".join(struct.pack("<4I", *r) for r in records) + trailing


NAMES = b"\0\0a.txt\0\0sub\0\0b.ogg\0"
NODES = ((1, 0, 0xDEADBEEF, 0xFFFF), (3, 0, 0, 0), (-1, 0, 2, 1), (4, 2, 9, 1), (0, 0, 14, 3))


def name_tree() -> bytes:
    nodes = b"".join(struct.pack("<hHIHH", link, prev, name, parent, 0) for link, prev, name, parent in NODES)
    return struct.pack("<I", len(NODES)) + nodes + struct.pack("<I", len(NAMES)) + NAMES + b"\0" * 8


def payload(n: int) -> bytes:
    return bytes((i * 29 + 7) & 0xFF for i in range(n))


def frame(raw: int, data: bytes) -> bytes:
    return b"LZ2K" + struct.pack("<II", raw, len(data)) + data


class BitWriter:
    def __init__(self):
        self.bits = ""

    def put(self, value: int, n: int) -> None:
        self.bits += format(value, f"0{n}b")

    def bytes(self) -> bytes:
        bits = self.bits + "0" * (-len(self.bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")


def lh5_stream() -> bytes:
    """Decodes to ABCCCC."""
    w = BitWriter()
    w.put(4, 16)
    w.put(12, 5)
    for i in range(12):
        if i == 3:
            w.put(0, 2)
        w.put(1 if i in (3, 11) else 0, 3)
    w.put(257, 9)
    for _ in range(256):
        w.put(1, 1)
    w.put(0, 1)
    w.put(0, 4)
    w.put(0, 4)
    return w


def lh5_bytes() -> bytes:
    w = lh5_stream()
    for ch in b"ABC":
        w.put(256 + ch, 9)
    w.put(0, 1)
    return w.bytes()


def zip_file(entries: list[tuple[str, bytes, int]]) -> bytes:
    local, central = b"", b""
    for name, data, flags in entries:
        raw = name.encode()
        head = struct.pack("<HHHHHIIIHH", 20, flags, 0, 0, 0, 0, len(data), len(data), len(raw), 0)
        central += b"PK\1\2" + struct.pack("<H", 20) + head + struct.pack("<HHHII", 0, 0, 0, 0, len(local)) + raw
        local += b"PK\3\4" + head + raw + data
    return local + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(central), len(local), 0)


def pe_file() -> bytes:
    """PE32+ that imports d3d11.dll."""
    out = bytearray(0x600)
    out[:2] = b"MZ"
    struct.pack_into("<I", out, 0x3C, 0x80)
    out[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<HHIIIHH", out, 0x84, 0x8664, 1, 0, 0, 0, 240, 0)
    optional = 0x98
    struct.pack_into("<H", out, optional, 0x20B)
    struct.pack_into("<I", out, optional + 108, 16)
    struct.pack_into("<II", out, optional + 120, 0x1000, 40)
    struct.pack_into("<IIII", out, optional + 240 + 8, 0x200, 0x1000, 0x200, 0x400)
    struct.pack_into("<IIIII", out, 0x400, 0x1040, 0, 0, 0x1060, 0x1040)
    out[0x460:0x46A] = b"d3d11.dll\0"
    return bytes(out)


def mach_file() -> bytes:
    name = b"/System/Library/Frameworks/Metal.framework/Metal\0"
    size = (24 + len(name) + 7) // 8 * 8
    command = struct.pack("<IIIIII", 0x0C, size, 24, 0, 0, 0) + name
    return b"\xcf\xfa\xed\xfe" + struct.pack("<IIIIIII", 0x0100000C, 0, 2, 1, size, 0, 0) + command.ljust(size, b"\0")


def geometry_file(w: int) -> bytes:
    halves = lambda *v: struct.pack("<4e", *v[:3], 0)[:6] + struct.pack("<H", v[3])
    objects = b"HSEM" + struct.pack(">I", 175)
    objects += struct.pack(">II", 0x502, 3) + b"DXTV" + struct.pack(">II", 169, 1) + bytes((0, 6, 0)) + b"\0" * 6
    objects += halves(0, 0, 0, 0x3C00) + halves(1, 0, 0, 0x3C00) + halves(0, 2, -1, w)
    objects += struct.pack(">III", 0x102, 3, 2) + struct.pack("<HHH", 0, 1, 2)
    resh = b".CC4HSERHSER".ljust(40, b"\0")
    nu20 = struct.pack(">II", 12 + len(objects), 1) + b"02UN" + struct.pack(">I", 78) + objects
    return struct.pack(">I", len(resh)) + resh + nu20 + b"\0" * 124 + b"META"
