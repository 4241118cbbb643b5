"""Geometry containers: header check, object scan, vertex positions, bounds, rendering.

Headers and object fields are big-endian, vertex and index data little-endian. The scan is greedy and resynchronises
byte by byte, so it is one pass over a file; parallelism is across files.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binexpr import exact, uint
from ..functions.rows import flat_map

# Bytes of each vertex element type.
ELEMENT_BYTES = {5: 4, 6: 8, 7: 4, 8: 4, 9: 4}
TRAILER, LEAST_FILE, MOST_ELEMENTS, MOST_VERSION, ONE = 128, 144, 16, 0x1000, 0x3C00


def container(content: Column) -> dict[str, Column]:
    """nu20_offset, nu20_size, valid and failure, as expressions: the sizes must reach the end of the file exactly."""
    head = uint(content, 0, 4, little=False)
    at = head + 4
    size = uint(content, at, 4, little=False)
    whole = F.octet_length(content)
    resh = exact(content, 8, 8) == F.lit(b"HSERHSER")
    nu20 = (uint(content, at + 4, 4, little=False) == 1) & (exact(content, at + 8, 4) == F.lit(b"02UN"))
    failure = (
        F.when(content.isNull() | (whole < LEAST_FILE), "too small")
        .when(~F.coalesce(resh, F.lit(False)), "no RESH header")
        .when(~F.coalesce(nu20, F.lit(False)), "no NU20 block")
        .when(~F.coalesce(at + 4 + size + TRAILER == whole, F.lit(False)), "NU20 does not reach the trailer")
    )
    return {"nu20_offset": at, "nu20_size": size, "valid": failure.isNull(), "failure": failure}


def container_report(files: DataFrame) -> DataFrame:
    """Files by what is wrong with their container; null: nothing."""
    return files.groupBy(container(F.col("content"))["failure"].alias("failure")).agg(F.count(F.lit(1)).alias("files"))


def _vertex_buffer(data: bytes, at: int, end: int) -> tuple[dict, int] | None:
    if at + 20 > end or data[at : at + 4] != b"\0\0\5\2" or data[at + 8 : at + 12] != b"DXTV":
        return None
    count, version, n = struct.unpack_from(">I", data, at + 4)[0], *struct.unpack_from(">II", data, at + 12)
    body = at + 20 + 3 * n + 6
    if not count or not 1 <= n <= MOST_ELEMENTS or body > end:
        return None
    elements = [{"usage": u, "stream": m >> 5, "type": m & 31, "offset": o} for u, m, o in struct.iter_unpack("BBB", data[at + 20 : at + 20 + 3 * n])]
    own = [e["offset"] + ELEMENT_BYTES.get(e["type"], 0) for e in elements if e["stream"] == 0]
    stride, odd = max(own, default=0), any(e["type"] not in ELEMENT_BYTES for e in elements)
    inline = all(e["stream"] == 0 for e in elements) and not odd and stride > 0 and body + stride * count <= end
    row = {"kind": "vertices", "marker_offset": at, "count": count, "version": version, "stride": stride, "inline": inline, "unknown_type": odd, "data_offset": body, "elements": elements}
    return row, body + stride * count if inline else body


def _index_buffer(data: bytes, at: int, end: int) -> tuple[dict, int] | None:
    if at + 12 > end or data[at : at + 4] != b"\0\0\1\2":
        return None
    count, size = struct.unpack_from(">II", data, at + 4)
    body = at + 12
    if not count or count % 3 or size not in (2, 4) or body + count * size > end:
        return None
    top = int(np.frombuffer(data, dtype=f"<u{size}", count=count, offset=body).max())
    return {"kind": "indices", "marker_offset": at, "count": count, "index_size": size, "data_offset": body, "max_index": top}, body + count * size


def _tag(data: bytes, at: int, end: int) -> tuple[dict, int] | None:
    name = data[at : at + 4]
    if at + 8 > end or not all(48 <= b <= 57 or 65 <= b <= 90 for b in name):
        return None
    (version,) = struct.unpack_from(">I", data, at + 4)
    return ({"kind": "tag", "marker_offset": at, "tag": name.decode(), "version": version}, at + 8) if version < MOST_VERSION else None


_EMPTY = dict.fromkeys(("path", "kind", "marker_offset", "count", "version", "stride", "inline", "unknown_type", "data_offset", "elements", "index_size", "max_index", "tag", "w_not_one", "positions"))
OBJECTS = (
    "path string, kind string, marker_offset long, count long, version long, stride long, inline boolean, unknown_type boolean, data_offset long, "
    "elements array<struct<usage int, stream int, type int, offset int>>, index_size int, max_index long, tag string, w_not_one long, positions array<array<float>>"
)


def positions(data: bytes, buffer: dict) -> tuple[list[list[float]], int]:
    """x, y, z of each vertex from the last element of usage 0, stream 0 and type 6; and how many have a fourth value other than one."""
    at = next((e["offset"] for e in reversed(buffer["elements"]) if (e["usage"], e["stream"], e["type"]) == (0, 0, 6)), None)
    if at is None or not buffer["inline"] or not buffer["count"]:
        return [], 0
    raw = np.frombuffer(data, dtype=np.uint8, count=buffer["stride"] * buffer["count"], offset=buffer["data_offset"]).reshape(buffer["count"], buffer["stride"])
    halves = np.ascontiguousarray(raw[:, at : at + 8]).view("<f2")
    return halves[:, :3].astype(np.float32).tolist(), int((np.ascontiguousarray(halves[:, 3]).view("<u2") != ONE).sum())


def scan_objects(path: str, data: bytes, nu20: int, end: int) -> Iterator[dict]:
    at = nu20 + 12
    while at + 8 <= end:
        found = _vertex_buffer(data, at, end) or _index_buffer(data, at, end) or _tag(data, at, end)
        if not found:
            at += 1
            continue
        row, at = found
        if row["kind"] == "vertices":
            row["positions"], row["w_not_one"] = positions(data, row)
        yield _EMPTY | {"path": path} | row


def objects(files: DataFrame) -> DataFrame:
    """Vertex buffers, index buffers and tags of ``files`` (path, content) whose container is valid."""
    head = container(F.col("content"))
    good = files.withColumns({k: v for k, v in head.items()}).filter("valid").withColumn("end", F.col("nu20_offset") + 4 + F.col("nu20_size"))
    return flat_map(good, ["path", "content", "nu20_offset", "end"], lambda p, c, a, e: scan_objects(p, c, a, min(e, len(c))), OBJECTS)


def totals(found: DataFrame) -> DataFrame:
    """One row over all files. Buffers that are not inline count as streamed, whatever keeps them from being read."""
    vertices, placed = F.col("kind") == "vertices", (F.col("kind") == "vertices") & (F.size("positions") > 0)
    largest = found.groupBy("path").agg(F.max(F.when(placed, F.col("count"))).alias("_largest"), F.count_if(F.col("kind") == "indices").alias("_indices"))
    counts = found.join(largest, "path").agg(
        F.count_if(vertices).alias("buffers"), F.count_if(vertices & F.col("inline")).alias("inline"), F.count_if(vertices & ~F.col("inline")).alias("streamed"), F.count_if(vertices & F.col("unknown_type")).alias("unknown"),
        F.count_if(placed).alias("position_buffers"), F.sum(F.when(placed, F.size("positions"))).alias("positions"), F.sum("w_not_one").alias("w_not_one"),
        F.count_if((F.col("kind") == "indices") & (F.col("max_index") < F.col("_largest"))).alias("indices_fit"), F.count_if(F.col("kind") == "indices").alias("indices"),
        F.count_distinct(F.when((F.col("_largest") > 0) & (F.col("_indices") > 0), F.col("path"))).alias("files_with_geometry"),
    )
    return counts.fillna(0)


def strides(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'vertices' and inline").groupBy("stride").agg(F.count(F.lit(1)).alias("buffers"))


def element_kinds(found: DataFrame) -> DataFrame:
    """Vertex elements by usage, type and stream."""
    return found.filter("kind = 'vertices'").select(F.inline("elements")).groupBy("usage", "type", "stream").agg(F.count(F.lit(1)).alias("n"))


def tag_versions(found: DataFrame) -> DataFrame:
    """Count of each tag and its versions, the last of each file; vertex buffers count as DXTV without one."""
    named = found.filter("kind in ('tag', 'vertices')").select("path", F.coalesce("tag", F.lit("DXTV")).alias("tag"), F.when(F.col("kind") == "tag", F.col("version")).alias("version"), "marker_offset")
    last = named.groupBy("path", "tag").agg(F.count(F.lit(1)).alias("n"), F.max_by("version", F.when(F.col("version").isNotNull(), F.col("marker_offset"))).alias("version"))
    return last.groupBy("tag").agg(F.sum("n").alias("n"), F.sort_array(F.collect_set("version")).alias("versions"))


def bounds(points: DataFrame, by: list[str], least: float = 1e-6) -> DataFrame:
    """Smallest and largest x, y, z of each group and the extent of each axis, ``least`` at least."""
    ends = [f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return points.groupBy(*by).agg(*ends).withColumns({f"extent_{c}": F.greatest(F.col(f"max_{c}") - F.col(f"min_{c}"), F.lit(least)) for c in "xyz"})


def png(width: int, height: int, rgb: bytes) -> bytes | None:
    """Eight-bit RGB with stored blocks; None if the pixels are not as many as they should be."""
    if width <= 0 or height <= 0 or len(rgb) != 3 * width * height:
        return None
    lines = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    blocks = [lines[i : i + 65535] for i in range(0, len(lines), 65535)]
    body = b"\x78\x01" + b"".join(struct.pack("<BHH", i == len(blocks) - 1, len(b), len(b) ^ 0xFFFF) + b for i, b in enumerate(blocks)) + struct.pack(">I", zlib.adler32(lines))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


VIEW, MARGIN = 400, 20
#: Axes across and up of the three views.
VIEWS = ((0, 1), (2, 1), (0, 2))


def render(buffers: list[np.ndarray], triangles: np.ndarray | None = None) -> bytes:
    """Three orthographic views side by side, as PNG: edges of ``triangles`` (of the only buffer), then all points.

    ``buffers`` have the shape (n, 3); all share one scale, the largest extent of any axis.
    """
    canvas = np.full((VIEW, VIEW * len(VIEWS), 3), 24, dtype=np.uint8)
    points = np.concatenate([np.asarray(b, dtype=np.float32) for b in buffers]) if buffers else np.zeros((0, 3), np.float32)
    if len(points):
        low = points.min(axis=0)
        extent = max(np.float32(1e-6), (points.max(axis=0) - low).max())
        unit = (points - low) / extent

        def plot(view: int, u: np.ndarray, v: np.ndarray, colour: tuple[int, int, int]) -> None:
            x, y = (MARGIN + u * (VIEW - 2 * MARGIN)).astype(np.int64), (VIEW - MARGIN - v * (VIEW - 2 * MARGIN)).astype(np.int64)
            inside = (x >= 0) & (x < VIEW) & (y >= 0) & (y < VIEW)
            canvas[y[inside], x[inside] + view * VIEW] = colour

        for view, (across, up) in enumerate(VIEWS):
            for a, b, c in [] if triangles is None or len(buffers) != 1 else triangles.tolist():
                for i, j in ((a, b), (b, c), (c, a)):
                    u, v = unit[[i, j], across], unit[[i, j], up]
                    steps = max(2, int(np.hypot(u[1] - u[0], v[1] - v[0]) * VIEW))
                    t = np.arange(steps + 1, dtype=np.float32) / np.float32(steps)
                    plot(view, u[0] + (u[1] - u[0]) * t, v[0] + (v[1] - v[0]) * t, (90, 140, 200))
            plot(view, unit[:, across], unit[:, up], (255, 210, 60))
    return png(VIEW * len(VIEWS), VIEW, canvas.tobytes())


def renders(files: DataFrame) -> DataFrame:
    """(path, points, triangles, image) of every file (path, content) with positions: its buffers in one picture, with the
    triangles whose indices fit where there is one buffer. A file is one task's row."""
    head = container(F.col("content"))
    good = files.withColumns(head).filter("valid").withColumn("end", F.col("nu20_offset") + 4 + F.col("nu20_size"))

    def draw(path: str, data: bytes, nu20: int, end: int) -> Iterator[dict]:
        found = list(scan_objects(path, data, nu20, min(end, len(data))))
        buffers = [np.array(o["positions"], dtype=np.float32) for o in found if o["kind"] == "vertices" and o["positions"]]
        corners = [np.zeros((0, 3), np.int64)]
        if len(buffers) == 1:
            for o in found:
                if o["kind"] == "indices" and o["max_index"] < len(buffers[0]):
                    corners.append(np.frombuffer(data, dtype=f"<u{o['index_size']}", count=o["count"], offset=o["data_offset"]).astype(np.int64).reshape(-1, 3))
        triangles = np.concatenate(corners)
        if buffers:
            yield {"path": path, "points": sum(map(len, buffers)), "triangles": len(triangles), "image": render(buffers, triangles)}

    return flat_map(good, ["path", "content", "nu20_offset", "end"], draw, "path string, points long, triangles long, image binary")
