"""Zip central directories."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.classify import path_extension
from ..functions.rows import flat_map

MOST_ENTRIES, MOST_NAMES, TAIL = 10_000, 100, 65_557
_CENTRAL = struct.Struct("<4sHHHHHHIIIHHHHHII")


def _printed(raw: bytes) -> str:
    return "".join(chr(b) if 32 <= b < 127 else "?" for b in raw.split(b"\0", 1)[0])


def directory(data: bytes) -> tuple[dict, list[dict]]:
    """(summary, entries). The end record is the last whose comment reaches the end of the file exactly."""
    summary = {"parsed": False, "zip64": False, "truncated": False, "declared": 0, "note": ""}
    at = len(data) - 22
    while at >= max(0, len(data) - TAIL):
        if data[at : at + 4] == b"PK\5\6" and at + 22 + struct.unpack_from("<H", data, at + 20)[0] == len(data):
            break
        at -= 1
    else:
        return summary | {"note": "no end of central directory"}, []
    _, _, _, count, size, offset = struct.unpack_from("<HHHHII", data, at + 4)
    if count == 0xFFFF or size == 0xFFFFFFFF or offset == 0xFFFFFFFF:
        summary["zip64"] = True
        locator = at - 20
        if locator < 0 or data[locator : locator + 4] != b"PK\6\7":
            return summary | {"note": "zip64 locator missing"}, []
        (end,) = struct.unpack_from("<Q", data, locator + 8)
        if data[end : end + 4] != b"PK\6\6" or end + 56 > len(data):
            return summary | {"note": "zip64 end record missing"}, []
        count, size, offset = struct.unpack_from("<QQQ", data, end + 32)
    summary |= {"parsed": True, "declared": count, "truncated": count > MOST_ENTRIES}
    entries = []
    while len(entries) < min(count, MOST_ENTRIES):
        if offset + 46 > len(data) or data[offset : offset + 4] != b"PK\1\2":
            summary["note"] = "central directory ends early"
            break
        f = _CENTRAL.unpack_from(data, offset)
        name = data[offset + 46 : offset + 46 + f[10]]
        entries.append({"no": len(entries), "name": _printed(name), "flags": f[3], "packed": f[8], "size": f[9]})
        offset += 46 + f[10] + f[11] + f[12]
    return summary, entries


def entries(files: DataFrame) -> DataFrame:
    """Entries of zip ``files`` (path, content); a file without a directory has a row that tells why."""

    def parse(path: str, content: bytes | None) -> Iterator[dict]:
        summary, found = directory(content or b"")
        base = {"path": path, **summary, "no": None, "name": None, "flags": None, "packed": None, "size": None}
        yield from ([base | e for e in found] or [base])

    return flat_map(files, ["path", "content"], parse, "path string, parsed boolean, zip64 boolean, truncated boolean, declared long, note string, no long, name string, flags int, packed long, size long")


def summaries(found: DataFrame) -> DataFrame:
    """One row a file: entry_count (as declared beyond the limit), encrypted_count, up to MOST_NAMES names."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("no"))
    named = found.withColumn("_rn", rank)
    return named.groupBy("path").agg(
        F.first("parsed").alias("parsed"), F.first("zip64").alias("zip64"), F.first("truncated").alias("truncated"),
        F.when(F.first("truncated"), F.first("declared")).otherwise(F.count("no")).alias("entry_count"),
        F.count_if(F.col("flags").bitwiseAND(F.lit(1)) == 1).alias("encrypted_count"),
        F.transform(F.sort_array(F.collect_list(F.when(F.col("no").isNotNull() & (F.col("_rn") <= MOST_NAMES), F.struct("no", "name")))), lambda x: x["name"]).alias("sample_names"),
        F.first("note").alias("note"),
    )


def extensions(found: DataFrame) -> DataFrame:
    """Entries of each file and extension; folders, which end with a separator, do not count."""
    real = (F.col("name") != "") & ~F.regexp_like("name", F.lit("[/\\\\]$"))
    return found.filter(F.col("no").isNotNull() & real).groupBy("path", path_extension(F.col("name")).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def extension_totals(found: DataFrame) -> DataFrame:
    """Histograms of all files added up."""
    return extensions(found).groupBy("extension").agg(F.sum("n").alias("n"))
