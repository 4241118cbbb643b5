"""Archives, codecs, executables, zips, geometry and scenes on hand-made bytes."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

import fixtures as X
from ashlar.functions import binexpr, classify
from ashlar.operators import archive, codec, executables, geometry, inspect, scene, stats, zipdir
from ashlar.sources import files as sources


def frame_of(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary").withColumn("length", F.octet_length("content").cast("bigint"))


def test_header_readings(spark):
    body = {i: bytes([(i * 37) & 0xFF]) for i in range(0x100, 0x3100)}
    good = X.dat_file(0x3100, struct.pack("<I", 0x12345678) + b"\0" * 0x8C, body)
    got = {r.path: r for r in archive.probe(frame_of(spark, [("good", good), ("longer", good + b"\xee" * 17), ("short", b"\1\2\3")])).collect()}
    assert (got["good"].transform, got["good"].offset, got["good"].field1) == ("negated<<8", 0x3100, 0x90)
    assert got["longer"].offset is None and "did not match" in got["longer"].error
    assert got["short"].error == "file too small for a DAT header"


def test_record_table_and_rules(spark):
    t = X.table([(0x100, 16, 16, 0x90000000), (0x110, 8, 32, 0x95000002), (0x114, 4, 4, 0x11000000)], b"a.tex\0")
    rows = spark.createDataFrame([("t", bytearray(b"\0" * 0x200 + t), 0x200, len(t)), ("big", bytearray(struct.pack("<II", 0, 1000)), 0, 8)], "path string, content binary, offset long, size long")
    got = {r.path: r for r in archive.tables(rows).collect()}
    assert [r.a for r in got["t"].records] == [0x100, 0x110, 0x114] and bytes(got["t"].trailing) == b"a.tex\0"
    assert got["big"].error == "declared count * 16 does not fit in the table"
    one = spark.createDataFrame([(0x12, 0x34000002)], "a long, flags long")
    assert sorted(r.offset for r in archive.with_rules(one).collect()) == [0x12, 0x1200, 0x1234]


def test_intervals(spark):
    spans = spark.createDataFrame([(0, 10), (5, 8), (20, 30), (40, 40)], "a long, b long").withColumn("g", F.lit(1))
    r = stats.interval_union(spans, ["g"], "a", "b").first()
    assert (r.covered, r.overlaps, r.max_gap) == (20, 1, 10)


def test_name_tree(spark):
    rows = spark.createDataFrame([("t", bytearray(X.name_tree()), 2)], "path string, trailing binary, entries long")
    nodes = archive.name_nodes(rows)
    c = archive.tree_checks(nodes, 2).first()
    assert (c.bytes_after, c.bad_name_offsets, c.files, c.dirs, c.missing_ids, c.duplicate_ids) == (8, 0, 2, 2, 0, 0)
    names = {r.idx: r.full for r in archive.paths(nodes).collect()}
    ids = {r.id: names[r.idx] for r in archive.file_nodes(nodes).collect()}
    assert ids == {0: "sub/b.ogg", 1: "a.txt"}


def test_listing_and_plan(spark):
    t = X.table([(1, 4, 4, 0), (1, 4, 16, 0x10000002)], X.name_tree())
    good = X.dat_file(0x200, t, {0x100: b"OggS", 0x110: b"LZ2K"})
    entries = archive.listing(frame_of(spark, [("a.dat", good), ("b.dat", b"\x5a" * 0x400)])).cache()
    s = archive.listing_summary(entries).first()
    assert (s.entries, s.stored, s.lz2k, s.unnamed, s.out_of_bounds, s.original_bytes) == (2, 1, 1, 0, 0, 20)
    assert sorted(r.offset for r in entries.filter("error is null").collect()) == [0x100, 0x110]
    assert entries.filter("archive = 'b.dat'").first().error
    status = {r.path: (r.status, r.planned_bytes) for r in archive.plan(entries).collect()}
    assert status == {"sub/b.ogg": ("written", 4), "a.txt": ("skipped_compressed", 0)}
    labels = {(r.extension, r.label) for r in archive.with_labels(entries, frame_of(spark, [("a.dat", good)])).collect()}
    assert labels == {(".ogg", "ogg"), (".txt", "packed:LZ2K")}


@pytest.mark.parametrize("entry, expected, chunks, left, failure", [
    (X.frame(0x8000, X.payload(40)) + X.frame(100, X.payload(9)), 32868, 2, 0, None),
    (X.frame(500, X.payload(20)), 501, 1, 0, "add up"),
    (X.frame(500, X.payload(20)) + b"\0" * 5, 500, 1, 5, "bytes left"),
    (b"XXXX" + b"\0" * 20, 0, 0, 24, "no LZ2K magic"),
    (X.frame(500, X.payload(20))[:-1], 500, 0, 31, "past"),
    (X.frame(0, X.payload(4)), 0, 0, 16, "zero raw"),
    (b"LZ2K", 0, 0, 4, "too small"),
])
def test_framing(entry, expected, chunks, left, failure):
    found, rest, why = codec.frames(entry, expected)
    assert (len(found), rest) == (chunks, left)
    assert why is None if failure is None else failure in why


def test_decoder():
    data = X.lh5_bytes()
    got = codec.lzh(data, 6)
    assert got["ok"] and got["output"] == b"ABCCCC" and (got["blocks"], got["left"]) == (1, 0)
    assert not codec.lzh(data, 5)["ok"] and not codec.lzh(data[:10], 6)["ok"]


def test_decompress_mixes_packed_and_verbatim():
    entry = X.frame(6, X.lh5_bytes()) + X.frame(3, b"xyz")
    assert codec.decompress(entry, 9) == (b"ABCCCCxyz", None)
    assert codec.decompress(entry, 10)[0] == b""


def test_decompress_verbatim(spark):
    entry = X.frame(5, b"world") + X.frame(3, b"xyz")
    rows = spark.createDataFrame([("a", bytearray(entry), 8), ("b", bytearray(entry), 9)], "key string, entry binary, expected long")
    got = {r.key: r for r in codec.decompressed(rows).collect()}
    assert bytes(got["a"].output) == b"worldxyz" and got["a"].failure is None
    assert bytes(got["b"].output) == b"" and "add up" in got["b"].failure
    board = {r.parameters: (r.entries, r.entries_ok, r.chunks, r.ok) for r in codec.scoreboard(rows).collect()}
    assert board == {p: (1, 1, 0, 0) for p in ("lh5", "lh6", "lh7")}  # verbatim chunks are not tried


def test_scoreboard(spark):
    good, broken = X.frame(6, X.lh5_bytes()) + X.frame(3, b"xyz"), X.frame(6, X.lh5_bytes()[:10])
    rows = spark.createDataFrame([("a", "n/a.tex", bytearray(good), 9), ("b", "b.tex", bytearray(broken), 6), ("c", "c.tex", bytearray(b"junk"), 6)], "key string, path string, entry binary, expected long")
    r = {x.parameters: x for x in codec.scoreboard(rows).collect()}["lh5"]
    assert (r.entries, r.entries_ok, r.chunks, r.ok, r.exact_end) == (2, 1, 2, 1, 1) and r.slack == {0: 1}
    assert len(r.failures) == 1 and sum(r.failures.values()) == 1 and [(f.key, f.chunk_no) for f in r.first_failures.values()] == [("b", 0)]
    sniffed = codec.sniffs(rows).filter("parameters = 'lh5'").collect()
    assert [(x.extension, x.key, bytes(x.head), x.format) for x in sniffed] == [(".tex", "a", b"ABCCCCxyz", "unknown")]


def test_scoreboard_decodes_once(spark):
    entry = X.frame(6, X.lh5_bytes())
    rows = spark.createDataFrame([("a", bytearray(entry), 6)], "key string, entry binary, expected long")
    board = codec.scoreboard(rows)
    assert board.filter("parameters = 'lh5'").first().slack == {0: 1}
    assert "MapInArrow" not in board._jdf.queryExecution().toString()  # the counts that follow do not decode anew


def test_first_block_is_read_once_for_all_parameters():
    data = X.lh5_bytes()
    for stream in (data, data[:10], b"", data + b"\0" * 3):
        opening = []
        for _, dictionary, positions in codec.PARAMETERS:
            assert codec.lzh(stream, 6, dictionary, positions, opening) == codec.lzh(stream, 6, dictionary, positions)
    opening = []
    assert codec.lzh(data, 6, opening=opening)["ok"] and opening


def test_tables_are_as_long_as_their_codes():
    codes = codec.Codes([2, 1, 0, 2])
    assert (codes.symbol, codes.length) == ([1, 1, 0, 3], [1, 1, 2, 2])
    assert (codec.Codes(None, 7).symbol, codec.Codes(None, 7).length) == ([7], [0])


def test_tables_of_codes():
    w = X.BitWriter()
    for value, n in ((1, 16), (0, 5), (31, 5)):
        w.put(value, n)
    assert "alphabet" in codec.lzh(w.bytes() + b"\0" * 20, 4)["failure"]
    w = X.BitWriter()  # 19 lengths; the zeros after the third do not go past the alphabet
    for value, n in ((1, 16), (3, 5), (1, 3), (2, 3), (2, 3), (3, 2)):
        w.put(value, n)
    assert codec._short_codes(codec.Bits(w.bytes()[2:] + b"\0" * 8), 4, 5, 3).length[0] == 1


def test_encoded_texts_decode(spark):
    from ashlar.plans import builders

    for raw in (b"", b"a", b"abababababababab" * 40, bytes(range(256)) * 9, "naïve façade ".encode() * 200, np.random.default_rng(0).bytes(5000)):
        entry = builders.packed_entry(raw, 4096)
        assert codec.decompress(entry, len(raw)) == (raw, None) if raw else entry == b""
        for at, size, packed in codec.frames(entry, len(raw))[0] if raw else []:
            if size != packed:
                got = codec.lzh(entry[at + 12 : at + 12 + packed], size)
                assert got["ok"] and got["left"] == 0


def test_chunk_statistics(spark):
    entry = X.frame(0x8000, X.payload(40)) + X.frame(9, X.payload(9))
    rows = spark.createDataFrame([("a", bytearray(entry), 0x8009), ("b", bytearray(X.frame(0x9000, X.payload(8))), 0x9000), ("c", bytearray(entry), 5), ("d", bytearray(b"x"), 1)], "key string, entry binary, expected long")
    found = codec.chunks(rows).cache()
    assert codec.size_counts(found).first().asDict() == {"chunks": 3, "last_above": 1, "packed_at_least_raw": 1, "packed_equals_raw": 1}
    assert [tuple(r) for r in codec.raw_sizes(found).collect()] == [(0x8000, 1)]
    assert sorted(tuple(r) for r in codec.framing_report(found).collect()) == [(1, 1, 1), (2, 1, 2)]
    assert {r.failure: (r.entries, r.examples) for r in codec.framing_failures(found).collect()} == {"raw sizes do not add up to the expected size": (1, ["c"]), "too small for a chunk header": (1, ["d"])}
    assert [tuple(r) for r in codec.first_bytes(found).select("first_byte", "chunks").collect()] == [(7, 3)]
    e = codec.entropies(found).first()
    assert e.chunks == 3 and 3 == round(e.least) and e.largest > 5 and codec.entropies(found.filter("false")).first().asDict() == {"chunks": 0, "mean": 0.0, "least": 9.0, "largest": 0.0}
    small = codec.smallest(found, 2).collect()
    assert [(r.raw_size, bytes(r.head)) for r in small] == [(9, X.payload(9)), (0x8000, X.payload(40))]
    r = codec.ratios(spark.createDataFrame([("a.tex", 10, 5), ("b.TEX", 10, 6), ("c", 0, 3)], "name string, raw long, packed long")).collect()
    assert [(x.extension, x.entries, x.ratio) for x in r] == [(".tex", 2, 0.55), ("(none)", 1, 0.0)]


def test_executables():
    pe, mach = executables.executable(X.pe_file()), executables.executable(X.mach_file())
    assert (pe["kind"], pe["arch"], pe["libraries"]) == ("pe", "x64", ["d3d11.dll"])
    assert (mach["kind"], mach["arch"]) == ("mach-o", "arm64") and "Metal.framework" in mach["libraries"][0]
    fat = b"\xca\xfe\xba\xbe" + struct.pack(">I", 2) + struct.pack(">IIIII", 0x0100000C, 0, 0, 0, 0) + struct.pack(">IIIII", 0x01000007, 0, 0, 0, 0)
    assert executables.executable(fat)["fat_archs"] == ["arm64", "x64"]
    assert executables.executable(b"MZ")["kind"] == "dos-stub" and executables.executable(b"\x7fELF")["kind"] == "elf" and executables.executable(b"") is None


def test_zip(spark):
    z = X.zip_file([("textures/hero.dds", b"x", 0), ("scripts/boot.lua", b"y", 0), ("secret.bin", b"z", 1)])
    found = zipdir.entries(frame_of(spark, [("z", z), ("bad", b"PK\3\4")])).cache()
    s = {r.path: r for r in zipdir.summaries(found).collect()}
    assert (s["z"].entry_count, s["z"].encrypted_count, s["z"].sample_names[0]) == (3, 1, "textures/hero.dds")
    assert not s["bad"].parsed and s["bad"].note
    assert {r.extension: r.n for r in zipdir.extensions(found).collect()} == {".dds": 1, ".lua": 1, ".bin": 1}


def test_geometry(spark):
    rows = [("ones", X.geometry_file(0x3C00)), ("zero", X.geometry_file(0)), ("longer", X.geometry_file(0) + b"x"), ("tiny", b"0123456789")]
    found = geometry.objects(frame_of(spark, rows)).cache()
    v = {r.path: r for r in found.filter("kind = 'vertices'").collect()}
    assert set(v) == {"ones", "zero"} and (v["ones"].w_not_one, v["zero"].w_not_one) == (0, 1)
    assert v["ones"].stride == 8 and v["ones"].inline and v["ones"].positions == [[0, 0, 0], [1, 0, 0], [0, 2, -1]]
    assert found.filter("kind = 'indices' and path = 'ones'").first().max_index == 2
    t = geometry.totals(found.filter("path = 'ones'")).first()
    assert (t.inline, t.positions, t.indices_fit) == (1, 3, 1)
    assert {r.tag: r.versions for r in geometry.tag_versions(found).collect()} == {"HSEM": [175], "DXTV": []}
    t = geometry.totals(found).first()
    assert (t.buffers, t.inline, t.streamed, t.position_buffers, t.w_not_one, t.files_with_geometry) == (2, 2, 0, 2, 1, 2)
    assert [tuple(r) for r in geometry.strides(found).collect()] == [(8, 2)] and [tuple(r) for r in geometry.element_kinds(found).collect()] == [(0, 6, 0, 2)]
    assert {r.failure: r.files for r in geometry.container_report(frame_of(spark, rows)).collect()} == {None: 2, "NU20 does not reach the trailer": 1, "too small": 1}
    picture = geometry.renders(frame_of(spark, rows[:1])).first()
    assert (picture.points, picture.triangles) == (3, 1)
    pixels = decoded_png(bytes(picture.image))
    assert pixels.shape == (400, 1200, 3) and tuple(pixels[0, 0]) == (24, 24, 24)
    # (0, 0, 0) (1, 0, 0) (0, 2, -1): extent 2; points, the middle of an edge, and the second view along z.
    assert tuple(pixels[380, 20]) == (255, 210, 60) and tuple(pixels[380, 200]) == (255, 210, 60) and tuple(pixels[20, 20]) == (255, 210, 60)
    assert tuple(pixels[380, 100]) == (90, 140, 200) and tuple(pixels[200, 20]) == (90, 140, 200) and tuple(pixels[380, 400 + 20 + 180]) == (255, 210, 60)
    empty = bytearray(X.geometry_file(0x3C00))
    at = empty.index(b"\0\0\5\2")
    empty[at + 4 : at + 8] = b"\0\0\0\0"
    assert geometry.objects(frame_of(spark, [("e", bytes(empty))])).filter("kind = 'vertices'").count() == 0
    assert geometry.png(3, 2, b"\xc8" * 12) is None and geometry.png(2, 2, b"\xc8" * 12)


def decoded_png(data):
    import zlib

    assert data[:8] == b"\x89PNG\r\n\x1a\n"
    at, body = 8, b""
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        assert struct.unpack_from(">I", data, at + 8 + size)[0] == zlib.crc32(data[at + 4 : at + 8 + size])
        if kind == b"IHDR":
            width, height = struct.unpack_from(">II", data, at + 8)
        body += data[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(body), dtype=np.uint8).reshape(height, 1 + 3 * width)
    assert not lines[:, 0].any()
    return lines[:, 1:].reshape(height, width, 3)


def test_halves(spark):
    h = spark.createDataFrame([(x,) for x in (0x3C00, 0xC000, 0x3800, 1, 0x7C00)], "h long").select(classify.half_to_float(F.col("h")).alias("v"))
    got = [r.v for r in h.collect()]
    assert got[:3] == [1.0, -2.0, 0.5] and np.isclose(got[3], 5.9604645e-8) and got[4] == float("inf")


def test_scene(spark):
    mesh = "named_struct('positions', array(0f,0f,0f,1f,0f,0f,0f,1f,0f), 'normals', array(), 'uvs', array(), 'indices', array(0,1,9))"
    r = spark.range(1).select(
        scene.mesh(F.expr(mesh)).alias("m"),
        scene.skeleton(F.expr("named_struct('names', array('a','b'), 'parents', array(1, 0), 'binds', array())")).alias("cycle"),
        scene.skeleton(F.expr("named_struct('names', array('a','b'), 'parents', array(-1, 0), 'binds', array())")).alias("fine"),
        scene.skeleton(F.expr("named_struct('names', array('a','b'), 'parents', array(-5, 0), 'binds', array())")).alias("below"),
        scene.mesh(F.expr(mesh.replace("array(0,1,9)", "array()"))).alias("no_faces"), scene.clip(F.expr("named_struct('duration', float('inf'), 'joints', 1)")).alias("endless"),
        scene.box(F.expr("named_struct('low', array(0f, float('nan'), 0f), 'high', array(1f, 1f, 1f))")).alias("nan"),
        scene.skeleton(F.expr("named_struct('names', transform(sequence(1, 500), x -> 'j'), 'parents', transform(sequence(0, 499), x -> x - 1), 'binds', array())")).alias("chain"),
    ).first()
    assert (r.m, r.cycle, r.fine) == ("index out of range", "joints form a cycle", None)
    assert (r.below, r.no_faces, r.endless, r.nan, r.chain) == ("parent is not another joint", "indices are not triangles", "bad duration", "bad box", None)


def test_report(spark, tmp_path):
    mystery = bytes(i & 0xFF for i in range(4096))
    z = X.zip_file([("textures/hero.dds", b"x", 0), ("folder/", b"", 0), ("b.dds", b"y", 1)])
    rows = frame_of(spark, [("a.png", b"\x89PNG\r\n\x1a\n"), ("m.bin", b"\xab\xab" + mystery[2:]), ("x.exe", X.pe_file()), ("q", b"QZ9\x01" + b"\xab" * 44), ("z", z)])
    reports = inspect.report(rows).cache()
    got = {r.path: r for r in reports.collect()}
    assert got["a.png"].format == "png" and got["a.png"].recognized and got["a.png"].header_hex is None
    assert not got["m.bin"].recognized and "ab ab" in got["m.bin"].header_hex and got["m.bin"].header_hex.count("\n") == 4
    assert "unknown layout: not guessed" in got["m.bin"].notes and "high entropy: compressed or encrypted" in got["m.bin"].notes
    assert "unknown layout: not guessed" in got["q"].notes and len(got["q"].notes) == 2
    assert (got["x.exe"].format, got["x.exe"].arch, got["x.exe"].graphics_apis) == ("pe", "x64", ["directx11"])
    assert got["x.exe"].graphics_evidence == ["d3d11.dll", "d3d11.dll import"]
    assert "51 5a 39 01" in got["q"].header_hex and "QZ9." in got["q"].header_hex and 0 < got["q"].entropy < 2
    assert [(r.extension, r.n) for r in inspect.by_zip_extension(reports).collect()] == [(".dds", 2)]
    import json

    fields = [json.loads(r.value) for r in inspect.as_json(reports).collect()]
    assert [f["path"] for f in fields] == sorted(got) and all(len(f) == 10 for f in fields)
    errors = spark.createDataFrame([("p", "cannot open p")], "path string, error string")
    inspect.write_reports(reports, errors, True, str(tmp_path / "r"), json=True)
    text = {name: "".join(r.value + "\n" for r in spark.read.text(str(tmp_path / "r" / name)).collect()) for name in ("report", "unknown", "summary", "errors", "json")}
    assert "file: a.png\n" in text["report"] and "zip_extensions: .dds=2" in text["report"] and "  b.dds" in text["report"] and "header:\n" in text["report"]
    assert text["unknown"].count("file: ") == 2 and text["errors"] == "error: cannot open p\n"
    assert text["summary"].startswith("files: 5\nunknown: 2\nopen_errors: 1\nhit_file_cap: yes\nby_format:\n") and "  .dds 2" in text["summary"] and "  directx11 1" in text["summary"]


def test_tree_of_copies(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    (tmp_path / "in/sample.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    (tmp_path / "in/sub/mystery.bin").write_bytes(b"\xab\xab" + bytes(i & 0xFF for i in range(2, 4096)))
    reports, errors, capped = inspect.inspect_tree(spark, str(tmp_path / "in"), str(tmp_path / "out"), copy=True)
    got = {r.path.rsplit("/", 1)[-1]: r.recognized for r in reports.collect()}
    assert got == {"sample.png": True, "mystery.bin": False} and errors.count() == 0 and not capped
    assert (tmp_path / "out/copies/sub/mystery.bin").read_bytes() == (tmp_path / "in/sub/mystery.bin").read_bytes()
    assert inspect.inspect_tree(spark, str(tmp_path / "in"))[0].count() == 2


def test_paths_and_extensions(spark):
    good, bad = ["audio/vo/dx_line.ogg"], ["../evil.txt", "a/../../b", "/abs/path", "c:/windows/x", "dir/con.txt", "dir//x", "trailing./x", ""]
    got = spark.createDataFrame([(p,) for p in good + bad], "p string").select("p", classify.path_check(F.col("p")).alias("why")).collect()
    assert {r.p for r in got if r.why is None} == set(good)
    names = spark.createDataFrame([("B.OGG",), (".gitignore",), ("a.b/c",), ("x.",)], "n string").select(classify.leaf_extension(F.col("n")).alias("x"), classify.path_extension(F.col("n")).alias("y")).collect()
    assert [r.x for r in names] == [".ogg", ".gitignore", ".b/c", "(none)"] and [r.y for r in names] == [".ogg", "(none)", "(none)", "(none)"]
    e = spark.range(1).select(classify.parse_extensions(F.lit("DDS,,.png,dds")).alias("e"), classify.parse_count(F.lit("18446744073709551616")).alias("c")).first()
    assert e.e == [".dds", ".png"] and e.c is None


def test_first_fault_of_a_path(spark):
    want = {"a/../b?": "empty or dot component", "a?/../b": "forbidden character", "con/x|": "reserved name", "x /y": "trailing space or dot", "é" * 121: "empty or too long", "a" * 240: None}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", classify.path_check(F.col("p")).alias("why")).collect()
    assert {r.p: r.why for r in got} == want


def test_imports_and_rows(spark):
    r = spark.range(1).select(
        classify.imported_graphics(F.array(F.lit("D3D9.dll"), F.lit("d3d9x"), F.lit("libGLESv2.so"), F.lit("vulkan"))).alias("a"), classify.imported_evidence(F.array(F.lit("D3D9.dll"))).alias("e"),
        *[classify.detail_row({"id": F.lit(7), "compression_code": F.lit(c), "stored_size": F.lit(100), "original_size": F.lit(2048), "offset": F.lit(300), "in_bounds": F.lit(c != 1)}).alias(f"d{c}") for c in range(3)],
    ).first()
    assert r.a == ["directx9", "opengles"] and r.e == ["d3d9.dll import"]
    assert (r.d0, r.d1, r.d2) == ("#7  stored  100 B  @0x12C", "#7  unknown  100 B -> 2.0 KiB (code 1)  @0x12C  out of bounds", "#7  LZ2K  100 B -> 2.0 KiB  @0x12C")


def tree_rows(spark, nodes):
    rows = [("t", i, 0, 0, 0, p, 0, n, len(nodes), 0, None) for i, (p, n) in enumerate(nodes)]
    return spark.createDataFrame(rows, "path string, idx long, link int, prev_sibling int, name_offset long, parent int, extra int, name string, node_count long, bytes_after long, error string")


def test_paths_of_any_depth(spark):
    nodes = [(65535, None), *((i - 1 if i > 1 else 0, f"n{i}") for i in range(1, 201)), (202, "x"), (201, "y"), (202, "z"), (0, "")]
    tree = tree_rows(spark, nodes)
    got = {r.idx: r.full for r in archive.paths(tree).collect()}
    assert got[200] == "/".join(f"n{i}" for i in range(1, 201)) and got[1] == "n1" and got[204] == "" and [got[i] for i in (201, 202, 203)] == [None] * 3
    checks = archive.tree_checks(tree, 3).first()
    assert (checks.cycles, checks.nodes, checks.missing_ids) == (3, 205, 2)
    only_root = archive.tree_checks(tree_rows(spark, nodes[:1]), 3).first()
    assert (only_root.files, only_root.missing_ids) == (0, 3)


def test_names_need_a_terminator(spark):
    blob = struct.pack("<I", 3) + b"".join(struct.pack("<hHIHH", *n, 0) for n in ((0, 0, 0, 0xFFFF), (0, 0, 1, 0), (-1, 0, 5, 0))) + struct.pack("<I", 7) + b"\0abc\0de"
    nodes = archive.name_nodes(spark.createDataFrame([("t", bytearray(blob), 2), ("none", bytearray(struct.pack("<II", 0, 0)), 0)], "path string, trailing binary, entries long"))
    assert {r.idx: r.name for r in nodes.filter("path = 't' and idx > 0").collect()} == {1: "abc", 2: None}
    assert nodes.filter("path = 'none'").first().error and archive.tree_checks(nodes.filter("path = 't'"), 2).first().bad_name_offsets == 1


def extraction_file():
    packed = X.frame(5, b"world")
    broken = X.frame(99, b"abcd")
    names = b"\0greeting.txt\0packed.tex\0..\0bad.tex\0"
    at = [names.index(n) for n in (b"greeting", b"packed", b"..", b"bad")]
    nodes = [(0, 0, 0, 0xFFFF, 0), *((-i, 0, a, 0, 0) for i, a in enumerate(at))]
    trailing = struct.pack("<I", 5) + b"".join(struct.pack("<hHIHH", *n) for n in nodes) + struct.pack("<I", len(names)) + names
    t = X.table([(1, 5, 5, 0), (2, len(packed), 5, 2), (1, 5, 5, 0), (2, len(broken), 64, 0x40000002)], trailing)
    return X.dat_file(0x300, t, {0x100: b"hello", 0x200: packed, 0x240: broken})


@pytest.mark.parametrize("by_position", [False, True])
def test_extraction(spark, tmp_path, by_position):
    (tmp_path / "game").mkdir()
    (tmp_path / "game/a.dat").write_bytes(extraction_file())
    files = sources.archives(spark, str(tmp_path / "game")) if by_position else frame_of(spark, [("a.dat", extraction_file())])
    entries = archive.listing(files).cache()
    stats_of = lambda **o: archive.extract_stats(archive.extract(entries, files, str(tmp_path / "out"), **o)).first().asDict()
    counters = dict.fromkeys(("written", "reused", "bytes", "decompressed", "skipped_compressed", "skipped_filter", "rejected", "errors"), 0)
    assert stats_of(dry_run=True) == counters | {"written": 1, "bytes": 5, "skipped_compressed": 2, "rejected": 1}
    assert not (tmp_path / "out").exists()
    assert stats_of() == counters | {"written": 1, "bytes": 5, "skipped_compressed": 2, "rejected": 1}
    assert stats_of() == counters | {"reused": 1, "skipped_compressed": 2, "rejected": 1}
    assert stats_of(extensions=[".tex"], decompress=True) == counters | {"written": 1, "bytes": 5, "decompressed": 1, "errors": 1, "skipped_filter": 2}
    assert (tmp_path / "out/greeting.txt").read_bytes() == b"hello" and (tmp_path / "out/packed.tex").read_bytes() == b"world"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["greeting.txt", "packed.tex"]
    manifest = archive.extract(entries, files, str(tmp_path / "again"), decompress=True)
    rows = sorted(tuple(r) for r in archive.manifest_rows(manifest).collect())
    assert rows == [(0, "greeting.txt", 5, "text", "written"), (1, "packed.tex", 5, "text", "decompressed")]
    assert {r.id: r.error for r in manifest.filter("error is not null").collect()}.keys() == {2, 3}
    planned = archive.plan(entries).agg(F.sum("planned_bytes")).first()[0], archive.plan(entries, decompress=True).agg(F.sum("planned_bytes")).first()[0]
    assert planned == (10, 10 + 5 + 64)


def test_archive_beyond_two_gigabytes(spark, tmp_path):
    """A sparse file: the table, the labels and an entry are read by position."""
    t, at = X.table([(0x100 >> 8, 5, 5, 0), (0x90000000 >> 8, 6, 6, 0)], X.name_tree()), 0x90000100
    with open(tmp_path / "big.dat", "wb") as f:
        f.write(struct.pack("<II", (~((at - 0x100) >> 8)) & 0xFFFFFFFF, len(t)))
        for place, data in ((0x100, b"hello"), (0x90000000, b"far on"), (at, t)):
            f.seek(place)
            f.write(data)
    files = sources.archives(spark, str(tmp_path))
    entries = archive.listing(files).cache()
    assert {r.path: (r.offset, r.in_bounds) for r in entries.collect()} == {"sub/b.ogg": (0x100, True), "a.txt": (0x90000000, True)}
    archive.extract(entries, files, str(tmp_path / "out"))
    assert (tmp_path / "out/a.txt").read_bytes() == b"far on" and (tmp_path / "out/sub/b.ogg").read_bytes() == b"hello"
    (tmp_path / "big.dat").unlink()


def test_record_analysis(spark):
    t = X.table([(0x100, 16, 16, 0x90000000), (0x110, 8, 32, 0x95000002), (0x114, 4, 4, 0x11000000)], b"a.tex\0")
    raw = bytearray(0x200)
    raw[0x100:0x108], raw[0x110:0x114] = b"\x89PNG\r\n\x1a\n", b"LZ2K"
    struct.pack_into("<II", raw, 0, (~((0x200 - 0x100) >> 8)) & 0xFFFFFFFF, len(t))
    facts, rules, labels = archive.analysis(frame_of(spark, [("t", bytes(raw) + t)]), 100)
    f = facts.first()
    assert (f.trailing_bytes, f.printable, f.equal_low0, f.differ_low, f.entries, f.data_bytes, f.preamble) == (6, 1.0, 2, 1, 3, 0x100, 0xFFFFFFFA)
    r = {x.rule: x for x in rules.collect()}
    assert (r["a"].out_of_bounds, r["a"].overlaps, r["a<<8"].out_of_bounds) == (0, 1, 3)
    found = {(x.kind, x.label): x.n for x in labels.filter("rule = 'a'").collect()}
    assert found[("stored", "png")] == 1 and sum("LZ2K" in k[1] for k in found if k[0] == "compressed") == 1 and len(found) == 3


def test_packed_entries_by_stride(spark):
    rows = spark.createDataFrame([(a, i, 2 if i % 2 else 0, True, None) for a in ("x", "y") for i in range(10)], "archive string, id long, compression int, in_bounds boolean, error string")
    assert sorted((r.archive, r.id) for r in archive.packed_entries(rows, 3).collect()) == [("x", 1), ("x", 7), ("y", 3), ("y", 9)]


def test_leading_zeros_counts_whole_blocks(spark):
    rows = frame_of(spark, [("short", b"\0" * 4000), ("long", b"\1" * 8 + b"\0" * 5000)])
    assert {r.path: r.z for r in rows.select("path", binexpr.leading_zeros(F.col("content")).alias("z")).collect()} == {"short": 0, "long": 4096}


def broken_parts():
    yield b"some"
    raise OSError("no more")


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, data in (("a.DAT", b"one"), ("b.txt", b"two"), ("sub/c.ghg", b"three"), ("d.data", b"x")):
        (tmp_path / name).write_bytes(data)
    found, capped = sources.tree(spark, str(tmp_path), most=3)
    assert found.count() == 3 and capped
    assert sources.archives(spark, str(tmp_path)).count() == 2 and sources.geometry(spark, str(tmp_path)).count() == 1
    spark.dataSource.register(sources.RangedFile)
    parts = spark.read.format("ranged_file").option("rangeBytes", "2").load(str(tmp_path / "sub/c.ghg")).orderBy("start").collect()
    assert b"".join(bytes(p.data) for p in parts) == b"three" and len(parts) == 3
    store, folder = sources.opened(str(tmp_path / "out"))
    with pytest.raises(OSError):
        sources.written(store, f"{folder}/x/y", broken_parts())
    assert not list((tmp_path / "out/x").iterdir())
    done = {r.path: r for r in sources.copied(found.select("path"), str(tmp_path), str(tmp_path / "copies"), 2).collect()}
    assert len(done) == 3 and not any(r.error for r in done.values()) and (tmp_path / "copies/a.DAT").read_bytes() == b"one"
    self_copy = sources.copied(found.select("path"), str(tmp_path), str(tmp_path)).collect()
    assert all("itself" in r.error for r in self_copy) and (tmp_path / "a.DAT").read_bytes() == b"one"
    assert "leave" in sources.copied(found.select("path").limit(1), str(tmp_path / "sub"), str(tmp_path / "copies")).first().error
    one, more = sources.tree(spark, str(tmp_path / "b.txt"))
    assert [bytes(r.content) for r in one.collect()] == [b"two"] and not more
    (tmp_path / "out-of").mkdir()
    (tmp_path / "out-of/e.txt").write_bytes(b"e")
    names = lambda df: {r.path.rsplit("/", 1)[-1] for r in df.select("path").collect()}
    assert "e.txt" in names(sources.tree(spark, str(tmp_path), outside=str(tmp_path / "out"))[0])
    for name in (".hidden.dat", "Game10.dat", "game9.DAT"):
        (tmp_path / "out-of" / name).write_bytes(b"x")
    assert [r.path.rsplit("/", 1)[-1] for r in sources.documents(spark, str(tmp_path / "out-of")).collect()] == ["game9.DAT", "Game10.dat"]
    assert sources.inside(str(tmp_path / "sub"), str(tmp_path)) and not sources.inside(str(tmp_path), str(tmp_path / "sub"))


def test_stream(spark, tmp_path):
    from ashlar.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(b"\x89PNG\r\n\x1a\n")
    for n in (1, 1, 2):
        if n == 2:
            (tmp_path / "in/b.gz").write_bytes(b"\x1f\x8b\x08")
        ingest.run_once(ingest.formats(spark, str(tmp_path / "in")), str(tmp_path / "table"), str(tmp_path / "state"))
        assert spark.read.parquet(str(tmp_path / "table")).count() == n
