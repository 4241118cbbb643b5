"""The training-data operators against SQL, brute force or exact round trips, on the smallest tables and on odd rows."""

import collections
import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from ashlar.llm import decontaminate, html_blocks, html_extract, language, packing, placement, quality, queries, shingle_join, substrings, token_store, tokens, warc
from ashlar.llm.common import ship, table

SF = "/root/testdata/sf0.001"
WORDS = tokens.vocabulary("word_bpe_49k.json")
BYTES = tokens.vocabulary("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _key string, node int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def odd_rows() -> list[tuple]:
    """Nulls everywhere, empty, blank and long texts, repeated rows, ties, and extra columns with clashing names."""
    r = random.Random(5)
    prose = " ".join("".join(r.choice("abcdeé") for _ in range(4)) for _ in range(3000))
    texts = [None, "", " \n\t", "one", "Two words", "a b c d e", "A B C D E", "a  b\nc d e", prose, prose, prose + " tail", "Ünï çødé 日本語 " * 30, "x" * 5000, "don't <|endoftext|> stop.\nNow"]
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, None, "clash", 1) for i, t in enumerate(texts)]
    return [*rows, rows[8], rows[3], (None, "null id", "en", "s", 1, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows_of(got, *columns) == sorted((tuple(r[k] for k in at) for r in want.fetchall()), key=repr)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)] += [d] if d is not None else []
    return sorted(((d, len(sets[i]), min(least[root(i)], default=None) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def test_join_on_sample(spark, duck):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert rows_of(shingle_join.op1(table(spark, SF, "documents")), "doc_id", "n_shingles", "component_id") == brute_classes(rows)


def test_join_on_odd_rows(odd, empty):
    assert rows_of(shingle_join.op1(odd), "doc_id", "n_shingles", "component_id") == brute_classes([(r[0], r[1]) for r in odd_rows()])
    assert shingle_join.op1(empty).count() == 0
    kept = shingle_join.keep_one(odd)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == odd.columns and len(rows) == len(set(rows)) and {d for d, _ in rows} == {None, *{c for _, _, c in brute_classes([(r[0], r[1]) for r in odd_rows() if r[0] is not None])}}


def test_join_of_a_crowd(spark):
    """More near copies of one text than a crowd has, some too far from all others."""
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(120)], []
    for i in range(shingle_join.CROWD * 2):
        w = list(base)
        for _ in range(r.choice((0, 1, 1, 2, 3))):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    got = shingle_join.op1(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == brute_classes(rows)


def test_join_of_crowds_that_drift(spark):
    """Texts that each change a little of the one before, so that only neighbours link, and clusters of one opening."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, w = [], [word() for _ in range(150)]
    for i in range(180):
        rows.append((i, " ".join(w)))
        if i % 3 == 0:
            w[r.randrange(len(w))] = word()
        if i == 90:
            w[10:40] = [word() for _ in range(30)]  # a gap
    opening, bases = [word() for _ in range(60)], [[word() for _ in range(60)] for _ in range(6)]
    for i in range(300):
        w = opening + bases[i % 6]
        for _ in range(r.choice((0, 1, 2, 3, 4))):
            w[r.randrange(len(w))] = word()
        rows.append((1000 + i, " ".join(w)))
    got = shingle_join.op1(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute_classes(rows)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want and len({c for _, _, c in want}) > 3


def test_overlap_by_fragments():
    r = np.random.default_rng(0)
    a = np.unique(r.integers(0, 1 << 63, 400, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:380], r.integers(0, 1 << 63, 20, dtype=np.uint64)]))
    c = np.unique(np.concatenate([a[100:200], b[300:]]))
    sets, pairs = {5: a, 7: b, 9: c}, [(5, 7), (5, 9), (7, 9)]
    total = np.zeros(3, dtype=np.int64)
    for k in range(shingle_join.PARTS):
        part = {n: x[shingle_join._bounds(x)[k] : shingle_join._bounds(x)[k + 1]] for n, x in sets.items()}
        total += shingle_join.partial_overlaps(part, *map(list, zip(*pairs)))
        two = {n: part[n] for n in (5, 7)}
        assert shingle_join.partial_overlaps(two, [5], [7])[0] == len(np.intersect1d(*two.values()))
    assert total.tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in pairs]
    both = len(np.intersect1d(a, b))
    assert shingle_join._matrix([a], [b, a]).tolist() == [[both, len(a)]]


def test_fragments_are_even_pieces_of_the_order():
    r = np.random.default_rng(1)
    sizes = r.integers(1, 600, 2000)
    common = np.unique(r.integers(0, 1 << 48, 500, dtype=np.uint64))
    ranks = r.integers(5, 12, 500).astype(np.int32)
    edges = shingle_join.cuts([(int(n), 1) for n in sizes], common, ranks, 64)
    assert (np.diff(edges.astype(np.float64)) > 0).all()
    sent = np.concatenate([np.sort(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))[: shingle_join.prefix_length(n)] for n in sizes.tolist()])
    counts = np.bincount(np.searchsorted(edges, sent >> np.uint64(8), side="right"), minlength=64)[:64]
    assert counts.max() <= 2 * counts.mean()


def test_join_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", 1, 2, 3, 4), (2, "A b  c", 1, 2, 3, 4), (3, "d", 1, 2, 3, 4), (3, "d", 1, 2, 3, 4)], "doc_id long, text string, _id int, _text int, _row int, row int")
    left = shingle_join.keep_one(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [(1, "a b c", 1, 2, 3, 4), (3, "d", 1, 2, 3, 4)]


@pytest.mark.parametrize("path, kind", [(WORDS, "words"), (BYTES, "spaced")])
def test_encoder_is_the_library(path, kind, duck):
    e = tokens.Encoder(path, kind)
    texts = [t.encode() for (t,) in duck.sql("SELECT text FROM documents").fetchall()] + [(r[1] or "").encode() for r in odd_rows()]
    texts += [b" ", b"  a  b ", b"a\nb\n\nc ", b"x\xc2\xa0 y \xc2\xa0z", b"a \tb", b"WE'LL 12 3a.b", b"\n a\r\n", "é İ Σas".encode(), b" \x1c a\x1cb", b"\xe2\x80\x83a b\xe2\x80\x83 c", b"a, b; c!? d...", b"(a) [b] {c}~"]
    for most in (tokens.MOST_PARTS, 3):
        tokens.MOST_PARTS, kept = most, tokens.MOST_PARTS
        try:
            got = e.encode(texts)
        finally:
            tokens.MOST_PARTS = kept
        want = [np.array(x.ids, dtype="<u2").tobytes() for x in e.library.encode_batch([t.decode() for t in texts], add_special_tokens=False)]
        assert got == want


@pytest.mark.parametrize("path, kind", [(WORDS, "words"), (BYTES, "spaced")])
def test_literals_of_added_tokens(path, kind):
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a<|endoftext|>\n<|startoftext|> b", "<|ENDOFTEXT|> a", "<|endoftext |> <|endoftext|", " <|startoftext|>é ", "x <|<|endoftext|>|> y"]
    want = [np.array(Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids, dtype="<u2").tobytes() for t in texts]
    assert tokens.Encoder(path, kind).encode([t.encode() for t in texts]) == want


def brute_ids(path, rows, end):
    lib = tokens.Encoder(path, "words").library
    return [(d, np.array(lib.encode(t or "", add_special_tokens=False).ids + [end], dtype="<u4")) for d, t in rows]


def test_token_store(spark, duck, odd, empty):
    rows = duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    want, start = [], 0
    for d, ids in brute_ids(WORDS, rows, token_store.END):
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert rows_of(token_store.op2(table(spark, SF, "documents"), WORDS), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_store.op2(empty, WORDS).count() == 0
    got = rows_of(token_store.op2(odd, WORDS), "doc_id", "n_tokens", "ids_crc32")
    assert got == sorted(((d, len(i), zlib.crc32(i.tobytes())) for d, i in brute_ids(WORDS, [(r[0], r[1]) for r in odd_rows()], token_store.END)), key=repr)


def test_token_store_rebuilds_and_checks(spark, tmp_path):
    docs, at = table(spark, SF, "documents"), str(tmp_path / "store")
    token_store.write(docs, WORDS, at)
    some = docs.filter("doc_id < 20")
    ids = {r.doc_id: r.ids for r in token_store.ids_of(spark, at, some).collect()}
    assert ids == {d: i.tolist() for d, i in brute_ids(WORDS, [(r.doc_id, r.text) for r in some.collect()], token_store.END)}
    chunks = spark.read.parquet(f"{at}/chunks_and_recipes").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    parts = [b"abc", b"", b"0123456789" * 50]
    assert token_store.joined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))


def test_language(spark, duck, odd, empty):
    got = language.op3(table(spark, SF, "documents")).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97
    odd_got = language.op3(odd).collect()
    assert len(odd_got) == len(odd_rows()) and {r.lang_pred for r in odd_got if r.doc_id in (0, 1, 2)} == {"und"}
    assert language.op3(empty).count() == 0
    assert {r.lang_pred for r in language.op3(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_decontamination_by_items_without_id(spark):
    item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(None, item), (None, "lone words"), (1, item + " more"), (2, "other words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "the lone words"), (3, "other words"), (4, "nothing"), (5, "lone words or other words")], "doc_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        con.register(name, df.toArrow())
    want = con.sql(decontaminate.ORACLE)
    got = rows_of(decontaminate.op4(docs, items), *want.columns)
    assert got == sorted(want.fetchall(), key=repr) and [r[2] for r in sorted(got)] == [20, 2, 2, 0, 4]
    assert [r.doc_id for r in decontaminate.remove_documents(docs, items).collect()] == [4]


def test_decontamination_on_odd_rows(spark, odd, empty):
    long_item = " ".join(f"w{i}" for i in range(20))
    items = spark.createDataFrame([(1, long_item), (2, "one"), (3, None), (4, "..."), (5, "Two words")], "item_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100, f"x {long_item.upper()} y"), (101, "w0 w1 w2")], "doc_id long, text string"))
    got = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontaminate.op4(docs, items).collect()}
    assert got[100] == (20, 1, True) and got[101] == (0, 0, False) and got[3] == (1, 1, True) and got[4] == (2, 1, True)
    assert decontaminate.op4(docs, items).count() == docs.count()
    assert decontaminate.op4(empty, items).count() == 0
    none = decontaminate.op4(docs, items.filter("false")).collect()
    assert {(r.n_hit, r.items_sha256) for r in none} == {(0, hashlib.sha256(b"").hexdigest())}
    left = decontaminate.remove_documents(odd, items)
    assert left.columns == odd.columns and not {3, 4} & {r.doc_id for r in left.collect()} and left.filter("doc_id is null").count() == 2


def check_packing(rows, pieces):
    lib = tokens.Encoder(BYTES, "spaced").library
    whole = sorted(((d, np.array(lib.encode(t or "", add_special_tokens=False).ids + [packing.END], dtype="<u4")) for d, t in rows), key=lambda x: repr(x[0]))
    found = collections.Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces)
    want = collections.Counter((d, s, len(i[s : s + 2048]), zlib.crc32(i[s : s + 2048].tobytes()), len(i)) for d, i in whole for s in range(0, len(i), 2048))
    assert found == want
    windows = collections.defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append((p.offset, p.length))
    for spans in windows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    return sum(map(len, (i for _, i in whole))) / (2048 * len(windows))


def test_packing(spark, duck, odd, empty):
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert check_packing(rows, packing.op5(table(spark, SF, "documents"), BYTES).collect()) > 0.85
    check_packing([(r[0], r[1]) for r in odd_rows()], packing.op5(odd, BYTES).collect())
    assert packing.op5(empty, BYTES).count() == 0


def test_fullest_window_is_the_best():
    r = random.Random(3)
    for _ in range(40):
        counts = {r.randint(1, 40): r.randint(1, 4) for _ in range(r.randint(1, 5))}
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        used = packing.fullest(counts, 50)
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= 50) and all(n <= counts[k] for k, n in used.items())


def test_warc_on_odd_rows(spark, tmp_path):
    long = "<p>é</p>" * 300
    rows = [(1, "u", long), (2, None, long), (2, None, long), (3, "u v\r\n", "short"), (4, "u", "short"), (5, "u", None), (None, "u", long), (6, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit(7))
    got = rows_of(warc.op6(pages), "page_id", "payload_bytes", "record_type", "refers_to")
    n = len(long.encode())
    assert got == sorted([(1, n, "revisit", 2), (2, n, "response", None), (2, n, "revisit", 2), (3, 5, "response", None), (4, 5, "response", None), (5, 0, "response", None), (None, n, "revisit", 2), (6, 0, "response", None)], key=repr)
    assert warc.op6(pages.filter("false")).count() == 0
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sums = [sorted(r.sha256 for r in warc.write(pages, at).collect()) for at in (a, b)]
    assert sums[0] == sums[1]
    assert {bytes(r.payload) for r in warc.read(spark, a).collect() if r.payload is not None} == {long.encode(), b"short", b""}


def test_placement(odd, empty):
    names = placement.shard_names(16)
    full, less = placement.lookup_table(names), placement.lookup_table(names[:-1])
    sizes = collections.Counter(full).values()
    assert max(sizes) - min(sizes) <= 1
    assert sum(a != b for a, b in zip(full, less) if a != 15) < 0.1 * len(full)
    placed = placement.place(odd, "doc_id", names)
    assert placed.count() == len(odd_rows()) and {r.shard for r in placed.filter("doc_id = 8").collect()} == {r.shard for r in placed.filter("doc_id = 8").limit(1).collect()}
    assert placement.place(empty, "doc_id", names).count() == 0


def test_quality_on_odd_rows(spark, odd, empty):
    got = {(r.doc_id, r.n_words, r.base_failed) for r in quality.op8(odd).collect()}
    assert {(0, 0, True), (1, 0, True), (2, 0, True), (8, 3000, False), (11, 90, True)} <= got
    assert quality.op8(odd).count() == len(odd_rows()) and quality.op8(empty).count() == 0
    kept = quality.keep(odd)
    assert {r.doc_id for r in kept.collect()} <= {8, 9, 10} and kept.columns == odd.columns
    texts = ["a b c a b c", "a b c d a b c", "a a a a", "a b c d e"]
    want = []
    for t in texts:
        w = t.split()
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        want.append(len({i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}))
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert [r.n_repeat_words for r in quality.op8(docs).orderBy("doc_id").collect()] == want


def test_quality_rejects_symbols_and_keeps_good_rows(spark):
    large = SF.replace("0.001", "0.1")  # groups of 37 to 322 rows
    rows = quality.op8(table(spark, large, "documents")).filter("not base_failed").join(table(spark, large, "labels"), "doc_id", "left").collect()
    laden = [r for r in rows if 100 <= 1000 * r.n_symbols // max(r.word_chars, 1) <= 120]
    assert laden and not any(r.kept for r in laden)
    good = [r for r in rows if r.quality == 1]
    assert good and all(r.kept for r in good)


def test_quality_pools_small_and_junk_heavy_groups(spark):
    r = random.Random(7)
    words = lambda w: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(4, 6))) + w for _ in range(60))
    groups = [("en", f"s{k}", "good") for k in range(4) for _ in range(60)] + [("en", "hot", "junk")] * 40 + [("en", "hot", "good")] * 30
    groups += [("en", "rare", "junk"), ("en", "rare", "good"), ("xx", "s0", "junk"), ("xx", "s1", "good"), (None, None, "junk"), (None, None, "good")]
    docs = spark.createDataFrame([(i, words(" |" if kind == "junk" else ""), lang, source) for i, (lang, source, kind) in enumerate(groups)], "doc_id long, text string, lang string, source string")
    assert {x.doc_id for x in quality.op8(docs).filter("kept").collect()} == {i for i, g in enumerate(groups) if g[2] == "good"}


def brute_fences(rows):
    """(lang, source) -> the eight fences, from rows of (lang, source, four values), by sorting whole groups."""
    pools = collections.defaultdict(list)
    for lang, source, *values in rows:
        for key in ((), (lang,), (lang, source)):
            pools[key].append(values)

    def bin_ends(v):
        if v < quality.LEAST:
            return 0, quality.LEAST - 1
        step = 1 << (v.bit_length() - 1 - quality.BITS)
        return v // step * step, v // step * step + step - 1

    def own(key, m, level, factor, low):
        v = sorted(x[m] for x in pools[key])
        hi, lo = v[-(-level * len(v) // 100) - 1], v[-(-(100 - level) * len(v) // 100) - 1]
        return bin_ends(hi)[1] * factor // 10, -(-bin_ends(lo)[0] * 10 // factor) if low else 0

    out = {}
    for key in [k for k in pools if len(k) == 2]:
        limits = []
        for m, (level, factor, low) in enumerate(quality.MEASURES.values()):
            chain = [k for k in (key, key[:1]) if len(pools[k]) * (100 - level) >= 100 * quality.BEYOND]
            used = [own(k, m, level, factor, low) for k in (chain if low and chain else [*chain, ()])]
            limits += [max(x[1] for x in used), min(x[0] for x in used)]
        out[key] = limits
    return out


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_quality_fences_by_brute_force(spark, sf):
    valued = quality.measures_of(table(spark, SF.replace("0.001", sf), "documents"), f"{quality.shared_dir(spark)}/measures")
    rows = [tuple(r) for r in valued.select("lang", "source", *quality.MEASURES).collect()]
    for some in (rows, [(r[0], None if r[1] > "src3" else r[1], *r[2:]) for r in rows]):  # many small groups; a few large ones
        frame = spark.createDataFrame(some, "lang string, source string, " + ", ".join(f"{m} long" for m in quality.MEASURES))
        limits = quality.fences(quality.sketches(frame)).collect()
        want = brute_fences(some)
        assert len(limits) == len(want)
        assert {(r.lang, r.source): [r[f"{m}_{e}"] for m in quality.MEASURES for e in ("lo", "hi")] for r in limits} == want
        assert {r.symbols_from for r in limits} <= {0, 1, 2}


def test_quality_sketch_error(spark):
    """Bins are in the order of values and at most 1/32 of them wide; sketches merge by adding counts."""
    values = [0, 1, 49, 50, 51, 63, 64, 65, 1000, 4095, 4096, 10**6, 10**9, 2**40]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality.bin_of(F.col("v")).alias("_bin"))
    got = rows.select("v", "_bin", quality._edge(F.col("_bin"), False).alias("a"), quality._edge(F.col("_bin"), True).alias("b")).orderBy("v").collect()
    assert [r._bin for r in got] == sorted(r._bin for r in got)
    assert all(r.a <= r.v <= r.b and (r.v < quality.LEAST or 32 * (r.b - r.a) <= r.v) for r in got)
    some = table(spark, SF, "documents")
    valued = quality.measures_of(some, f"{quality.shared_dir(spark)}/measures")
    one, two = (quality.sketches(valued.filter(F.col("doc_id") % 2 == k)) for k in (0, 1))
    merged = one.unionByName(two).groupBy("lang", "source", "measure", "bin").agg(F.sum("n").alias("n"))
    assert rows_of(merged, "lang", "source", "measure", "bin", "n") == rows_of(quality.sketches(valued), "lang", "source", "measure", "bin", "n")


def test_quality_keeps_columns_of_any_name(spark):
    text = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "s", 1, 2, 3), (2, "short", "en", "s", 1, 2, 3)], "doc_id long, text string, lang string, source string, _row int, symbols int, _by_lang int")
    left = quality.keep(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, text, "en", "s", 1, 2, 3)]


def test_repeated_words_of_a_wide_text(spark):
    """More words than the packed numbers hold."""
    r = random.Random(6)
    words = [f"w{r.randrange(3000)}" for _ in range(quality.PACKED_WORDS + 5000)]
    c = collections.Counter(zip(words, words[1:], words[2:]))
    want = len({i + k for i in range(len(words) - 2) if c[tuple(words[i : i + 3])] > 1 for k in range(3)})
    docs = spark.createDataFrame([(1, " ".join(words), "en", "s")], "doc_id long, text string, lang string, source string")
    assert [(x.n_words, x.n_repeat_words) for x in quality.op8(docs).collect()] == [(len(words), want)]


def brute_removed(rows):
    seen = collections.Counter(b[k : k + 200] for b in ((t or "").encode() for _, t in rows) for k in range(len(b) - 199))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                gone[k : k + 200] = b"\1" * 200
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


def test_substrings(spark, duck, odd, empty):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    rows = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    assert rows_of(substrings.op9(table(spark, SF, "documents")), *columns) == brute_removed(rows)
    assert rows_of(substrings.op9(odd), *columns) == brute_removed([(r[0], r[1]) for r in odd_rows()])
    assert substrings.op9(empty).count() == 0
    left = substrings.remove(odd)
    assert left.columns == odd.columns and left.count() == len(odd_rows())


def test_substrings_at_bounds(spark):
    """Passages of just under, at and over the length, within one text, at its ends, and in a text longer than a segment."""
    r = random.Random(2)
    some = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    p199, p200, p300 = some(199), some(200), some(300)
    long = some(substrings.SEGMENT + 5000)
    rows = [(1, some(300) + p199 + some(50)), (2, p199 + some(400)), (3, some(120) + p200), (4, p200 + some(130)), (5, p300 + some(90) + p300), (6, "ab" * 400), (7, long), (8, some(100) + long[substrings.SEGMENT - 150 : substrings.SEGMENT + 150] + some(60))]
    got = substrings.op9(spark.createDataFrame(rows, "doc_id long, text string"))
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removed(rows)


def test_whole_characters():
    data = "aé日b".encode()
    assert substrings.whole_characters(data, [(2, 5)]) == [] and substrings.whole_characters(data, [(1, 5)]) == [(1, 3)]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>
<!-- note --><div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><article><h1>A  title &amp; more</h1><p><b>First line.<br>Second<p>Third&nbsp;paragraph with <a href=#>a link</a> in it.</p></article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>Other story</a></li></ul></aside><section class="comments"><p>Great read, thanks!</p></section><footer>&copy; Site</footer></body></html>"""


def test_blocks():
    texts = [b.text for b in html_blocks.blocks(PAGE)]
    assert texts[:4] == ["Home", "About us", "We use cookies.", "Accept"] and "A title & more" in texts and "First line. Second" in texts and "Third paragraph with a link in it." in texts
    assert html_blocks.blocks("") == [] and [b.text for b in html_blocks.blocks("<p>open <b>bold</p></div>tail <script>x")] == ["open bold", "tail"]


def test_main_text(spark):
    page = "A title & more\nFirst line. Second\nThird paragraph with a link in it."
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (1, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = rows_of(html_extract.op10(rows), "page_id", "text", "n_chars")
    assert got == sorted([(1, page, len(page)), (1, page, len(page)), (2, "", 0), (3, "", 0)], key=repr)
    assert html_extract.op10(rows.filter("false")).count() == 0


def test_labeller_on_unseen_pages():
    pages, wanted = html_extract.labelled_pages(60, 12345)
    scored = html_extract.labeller().scores(pages)
    right = sum(int((s > 0.5) == bool(w)) for a, b in zip(scored, wanted) for s, w in zip(a, b))
    assert right / sum(map(len, wanted)) > 0.98


def test_main_text_of_sample(spark):
    import html
    import re

    for r in html_extract.op10(table(spark, SF, "pages")).join(table(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        want = [re.sub(r"\s+", " ", html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x)))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in want if x)


def test_members_in_linear_time():
    """Twice the records take about twice the time; a file that ends within a record is an error."""
    import gzip
    import time

    r = random.Random(4)
    one = gzip.compress(bytes(r.randrange(256) for _ in range(2800)), mtime=0)
    took = []
    for n in (2000, 4000):
        best = []
        for _ in range(3):
            began = time.perf_counter()
            assert sum(1 for _ in warc.members(one * n)) == n
            best.append(time.perf_counter() - began)
        took.append(min(best))
    assert took[1] <= 2.5 * took[0]
    assert list(warc.members(gzip.compress(b"a" * 50_000) + gzip.compress(b""))) == [b"a" * 50_000, b""]
    with pytest.raises(ValueError):
        list(warc.members(one[:-5]))


def test_decontamination_in_parts(spark, duck):
    """A benchmark in several broadcast parts, with short items, gives what one part gives; each part is within the bound."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abc") for _ in range(2))
    items = [(i, " ".join(word() for _ in range(r.choice((1, 2, 3, 5, 12, 13, 14, 40, 230))))) for i in range(30)]
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 60))) + " " + items[i % 30][1][: r.randint(0, 300)]) for i in range(90)]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        con.register(name, df.toArrow())
    want = con.sql(decontaminate.ORACLE)
    rows = sorted(want.fetchall(), key=repr)
    n = decontaminate.windows_of(benchmark).count()
    for most in (n, n - 1, n // 5):
        most, decontaminate.hits.__defaults__ = decontaminate.hits.__defaults__, (most,)
        try:
            assert rows_of(decontaminate.op4(docs, benchmark), *want.columns) == rows
        finally:
            decontaminate.hits.__defaults__ = most


def test_decontamination_plan_is_small(spark):
    items = spark.range(1000).selectExpr("id AS item_id", "array_join(transform(sequence(1, 60), k -> concat('w', id * 60 + k)), ' ') AS text")
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(600, 640))), (2, "nothing")], "doc_id long, text string")
    got = decontaminate.op4(docs, items)
    assert {r.doc_id: r.n_hit for r in got.collect()} == {1: 39, 2: 0}
    assert len(got._jdf.queryExecution().toString()) < 200_000


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 1, 2, 3, 4), (2, "c", 1, 2, 3, 4)], "doc_id long, text string, _x int, _y int, _id int, row int")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    left = decontaminate.remove_documents(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "c", 1, 2, 3, 4)]


def test_refinement_by_brute_force():
    r = np.random.default_rng(3)
    base = r.integers(97, 100, 2000).astype(np.uint8)
    parts = [base[a : a + n].copy() for a, n in zip(r.integers(0, 1500, 60), r.integers(200, 369, 60))]
    for p in parts[::3]:
        p[r.integers(0, len(p))] = 65
    counts = np.array([len(p) - 199 for p in parts])
    sizes = np.array([len(p) for p in parts])
    got = substrings.refined(np.concatenate(parts), np.cumsum(sizes) - sizes, sizes, counts)
    strings = [p[k : k + 200].tobytes() for p in parts for k in range(len(p) - 199)]
    seen = collections.Counter(strings)
    assert got.tolist() == [seen[x] > 1 for x in strings] and 0 < got.sum() < len(got)


def test_substrings_of_a_crowd(spark):
    """A Q-gram with more unlike surroundings than meet in one task, some of which repeat."""
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    common, tails = some(150), [some(120) for _ in range(5)]
    rows = [(i, some(90) + common + (tails[i % 5] if i % 3 else some(100)) + some(40)) for i in range(60)] + [(100, None), (101, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    want = brute_removed(rows)
    assert sum(x[2] for x in want) > 0
    kinds = {k for b in substrings._settle(substrings.anchors([(i, 0, t.encode()) for i, t in rows if t]), 3) for k in b.column(0).to_pylist()}
    assert "crowd" in kinds
    for crowd, hot in ((1, substrings.HOT), (3, 5), (substrings.CROWD, 20), (substrings.CROWD, substrings.HOT)):
        assert rows_of(substrings.op9(docs, crowd, hot), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_substrings_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a" * 500, 1, 2, 3, 4), (2, None, 1, 2, 3, 4)], "doc_id long, text string, _null int, missing int, _key int, row int")
    left = substrings.remove(docs)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect())) == [(1, "", 1, 2, 3, 4), (2, None, 1, 2, 3, 4)]


def test_blocks_of_broken_markup():
    texts = lambda page: [(b.text, b.links) for b in html_blocks.blocks(page)]
    assert texts("<p don't>hello</p><p>world</p><p>isn't</p>") == [("hello", 0), ("world", 0), ("isn't", 0)]
    assert texts("<a href=/foo/>Home page</a>") == [("Home page", 9)] and texts("<div/>a<div>b") == [("a", 0), ("b", 0)]
    assert texts('<p title="a > b" x=\'<p>\'>one</p>') == [("one", 0)] and texts("x<svg><path d=1/><g/>no</svg>y<svg/>z") == [("x", 0), ("y", 0), ("z", 0)]


@pytest.mark.parametrize("page", ["<b></i>" * 50_000, "<div>x" * 50_000, "<p><div>" + "<b>" * 50_000 + "<h1>x</h1>" * 50_000, "<li><td>x" * 50_000, '<div class="a b">x' * 50_000])
def test_blocks_in_linear_time(page):
    import time

    began = time.perf_counter()
    found = html_blocks.blocks(page)
    features = html_extract.Features()
    for b in found:
        features(b)
    assert time.perf_counter() - began < 4  # seconds: a quadratic reader takes minutes


def brute_language(profiles_, text):
    """By letters and words, with plain dictionaries."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = collections.Counter()
    for w in words:
        padded = f" {w} "
        for n in (1, 2, 3):
            counts.update(g for i in range(len(padded) - n + 1) if len((g := padded[i : i + n]).strip()) >= n - 1 and g.strip())
    if not counts:
        return "und", 0.0
    key = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    mine = sorted(counts, key=lambda g: (-counts[g], key(g)))[: language.PROFILE]
    best = None
    for name in sorted(profiles_):
        ranks = {g: k for k, g in enumerate(profiles_[name])}
        d = sum(abs(ranks[key(g)] - k) if key(g) in ranks else language.PROFILE for k, g in enumerate(mine))
        best = min(best or (d, name), (d, name))
    return best[1], 1 - best[0] / (language.PROFILE * len(mine))


def test_language_by_brute_force(spark, duck):
    docs = table(spark, SF, "documents")
    known = language.profiles(docs.filter(~language.held_out(F.col("doc_id"))))
    texts = dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.op3(docs).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        name, score = brute_language(known, text or "")
        assert got[doc][0] == name and abs(got[doc][1] - score) < 1e-9
    counts = collections.defaultdict(collections.Counter)
    for lang, text in duck.sql("SELECT lang, text FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL").fetchall():
        counts[lang].update(np.asarray(language.grams(text)).tolist())
    all_of = language.profiles(docs)
    assert all_of == {k: sorted(c, key=lambda g: (-c[g], g))[: language.PROFILE] for k, c in counts.items()}


def test_placement_table_by_brute_force():
    """Whole permutations, and shards that take turns to claim the next free slot of theirs."""
    for n, slots in ((1, 7), (3, 13), (16, 4093), (5, 5)):
        names = placement.shard_names(n)
        lists = []
        for name in names:
            h = hashlib.md5(name.encode()).hexdigest()
            offset, skip = int(h[:16], 16) % slots, int(h[16:], 16) % (slots - 1) + 1
            lists.append([(offset + j * skip) % slots for j in range(slots)])
        owner, nexts = [-1] * slots, [0] * n
        free, turn = slots, 0
        while free:
            s = turn % n
            while owner[lists[s][nexts[s]]] >= 0:
                nexts[s] += 1
            owner[lists[s][nexts[s]]] = s
            free, turn = free - 1, turn + 1
        assert placement.lookup_table(names, slots) == owner


def test_placement_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, 5, "x")], "doc_id long, slot int, Shard string")
    got = placement.place(docs, "doc_id", placement.shard_names(4)).first()
    assert (got.slot, got.Shard) == (5, "x") and got.slot_ == int(hashlib.md5(b"1").hexdigest()[:15], 16) % placement.SLOTS and 0 <= got.shard_ < 4


def test_patterns_leave_the_least_slack():
    """Each window of a pattern is as full as any choice of the lengths on hand could make it, and all are used up."""
    r = random.Random(12)
    for _ in range(15):
        counts = {r.randint(1, 49): r.randint(1, 6) for _ in range(r.randint(1, 6))}
        left = dict(counts)
        for windows, used in packing.patterns(dict(counts), 50):
            for _ in range(windows):
                sums = {0}
                for k, n in left.items():
                    sums = {s + k * i for s in sums for i in range(n + 1)}
                assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= 50)
                for k, n in used.items():
                    left[k] -= n
        assert not any(left.values())


def test_wide_ids(spark, tmp_path):
    """Four bytes an id, as a vocabulary of more than 65,536 needs."""
    docs, at = table(spark, SF, "documents").filter("doc_id < 40"), str(tmp_path / "wide")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(brute_ids(WORDS, rows, token_store.END))
    e = tokens.Encoder(WORDS, "words", wide=True)
    assert e.dtype == "<u4" and all(e.one((t or "").encode()) == want[d][:-1].tobytes() for d, t in rows)
    token_store.write(docs, WORDS, at, wide=True)
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_store.read(spark, at).collect()}
    assert got == {d: (len(i), zlib.crc32(i.tobytes())) for d, i in want.items()}
    assert {r.doc_id: r.ids for r in token_store.ids_of(spark, at, docs).collect()} == {d: i.tolist() for d, i in want.items()}
