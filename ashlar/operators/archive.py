"""Game archives: header hypotheses, record table, name tree, catalogue, extraction.

Layout: two u32 at the start lead to a table of records (u32 a, b, c, flags) with a name tree behind it. Every parser
gives a row with a status for what it cannot read; nothing fails a job.

Archives are rows (path, length): only the ranges that are asked for are read, by position, so that an archive can be of
any size and none is ever moved. Rows with ``content`` (binary) are looked at as they are.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.binexpr import inverted32, lead_key, negated32, uint
from ..functions.classify import format_of, label_entry, leaf_extension, path_check
from ..functions.rows import flat_map
from ..sources.files import opened, written
from ..sources.shared import stored
from . import codec, stats

TABLE_BYTES = 64 << 20
TRANSFORMS = ("raw", "negated", "inverted", "raw<<8", "negated<<8", "inverted<<8", "size-field1")


def candidates(df: DataFrame, field0: Column, field1: Column, size: Column) -> DataFrame:
    """Seven readings of the header for each row: transform, offset, in_file, table_fits, ends_at_eof, and which is chosen."""
    neg, inv = negated32(field0), inverted32(field0)
    offsets = (field0, neg, inv, field0 * 256, neg * 256, inv * 256, size - field1)
    names = [f"_o{k}" for k in range(len(offsets))]
    df = df.withColumns(dict(zip(names, (o.cast("bigint") for o in offsets))))
    ends = lambda o: (F.col(o) >= 8) & (F.col(o) < size) & (F.col(o) + field1 == size)
    first = F.coalesce(*[F.when(ends(o), F.lit(k)) for k, o in enumerate(names[:-1])], F.lit(-1))
    readings = [F.struct(F.lit(k).alias("no"), F.lit(t).alias("transform"), F.col(o).alias("offset")) for k, (t, o) in enumerate(zip(TRANSFORMS, names))]
    kept = [c for c in df.columns if c not in names]
    rows = df.withColumn("_first", first).select(*kept, "_first", F.inline(F.array(*readings)))
    in_file, end = (F.col("offset") >= 8) & (F.col("offset") < size), F.col("offset") + field1
    return rows.withColumns({"in_file": in_file, "table_fits": in_file & (end <= size), "ends_at_eof": in_file & (end == size), "chosen": F.col("no") == F.col("_first")}).drop("_first")


def _reading(path: str, content: bytes | None = None) -> Callable[[int, int], bytes]:
    """Bytes from a place on, as many as there are: of ``content``, or of the file."""
    if content is not None:
        return lambda at, n: content[at : at + n]
    store, name = opened(path)
    file = store.open_input_file(name)
    size = file.size()
    return lambda at, n: file.read_at(max(0, min(n, size - at)), at) if 0 <= at < size else b""


def _by_position(df: DataFrame, columns: list[str], parse: Callable, schema: str) -> DataFrame:
    """``parse(read, *columns)`` for each row, where ``read`` reads the archive ``path``."""

    def run(path: str, *values) -> Iterator[dict]:
        content, rest = (values[0], values[1:]) if held else (None, values)
        try:
            read = _reading(path, content if not held or content is not None else b"")
        except OSError as e:
            read = _unreadable(e)
        yield from parse(read, path, *rest)

    held = "content" in df.columns
    return flat_map(df, ["path", *(["content"] if held else []), *columns], run, schema)


def _unreadable(e: OSError) -> Callable[[int, int], bytes]:
    return lambda at, n: b""


def _with_length(files: DataFrame) -> DataFrame:
    return files if "length" in files.columns else files.withColumn("length", F.octet_length("content").cast("bigint"))


def probe(files: DataFrame) -> DataFrame:
    """(path, size, field0, field1, offset, transform, error) of ``files``."""
    heads = _by_position(_with_length(files), ["length"], lambda read, path, length: iter([{"path": path, "size": length, "head": read(0, 8)}]), "path string, size long, head binary")
    read = heads.select("path", "size", uint(F.col("head"), 0, 4).alias("field0"), uint(F.col("head"), 4, 4).alias("field1"))
    found = candidates(read.filter("field1 is not null"), F.col("field0"), F.col("field1"), F.col("size")).groupBy("path", "size", "field0", "field1").agg(
        F.max(F.when(F.col("chosen"), F.col("offset"))).alias("offset"), F.max(F.when(F.col("chosen"), F.col("transform"))).alias("transform")
    )
    short = read.filter("field1 is null").select("path", "size", "field0", "field1", F.lit(None).cast("bigint").alias("offset"), F.lit(None).cast("string").alias("transform"))
    error = F.when(F.col("field1").isNull(), "file too small for a DAT header").when(F.col("offset").isNull(), "table offset rule did not match: no reading ends at the end of the file")
    return found.unionByName(short).withColumn("error", error)


def _table(read, path: str, offset: int | None, size: int | None) -> Iterator[dict]:
    row = {"path": path, "preamble": None, "records": [], "trailing": None, "error": None}
    if offset is None or not 8 <= size <= TABLE_BYTES:
        yield row | {"error": "table size outside 8 B .. 64 MiB"}
        return
    data = read(offset, size)
    if len(data) < size:
        row["error"] = "table unreadable"
    else:
        row["preamble"], count = struct.unpack_from("<II", data)
        if 8 + 16 * count > size:
            row["error"] = "declared count * 16 does not fit in the table"
        else:
            row["records"] = [{"id": i, "a": a, "b": b, "c": c, "flags": f} for i, (a, b, c, f) in enumerate(struct.iter_unpack("<4I", data[8 : 8 + 16 * count]))]
            row["trailing"] = data[8 + 16 * count :]
    yield row


def tables(files: DataFrame) -> DataFrame:
    """(path, preamble, records, trailing, error) of ``files`` (path, offset, size)."""
    return _by_position(files, ["offset", "size"], _table, "path string, preamble long, records array<struct<id long, a long, b long, c long, flags long>>, trailing binary, error string")


def records(blobs: DataFrame, keys: list[str], blob: str = "blob") -> DataFrame:
    """Fixed records of 16 bytes as rows, by column expressions alone."""
    n = F.floor(F.octet_length(blob) / 16).cast("int")
    at = F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(blob), i * 16 + 1, F.lit(16)))).alias("id", "_r")
    rows = blobs.filter(F.octet_length(blob) >= 16).select(*keys, at)
    return rows.select(*keys, F.col("id").cast("bigint").alias("id"), *[uint(F.col("_r"), 4 * k, 4).alias(c) for k, c in enumerate(("a", "b", "c", "flags"))])


def offset_rules(a: Column, flags: Column) -> dict[str, Column]:
    return {"a": a, "a<<8": F.shiftleft(a, 8), "(a<<8)|(flags>>24)": F.shiftleft(a, 8).bitwiseOR(F.shiftrightunsigned(flags, 24))}


def with_rules(df: DataFrame) -> DataFrame:
    """A row for each record and offset rule (a, flags -> rule, offset)."""
    rules = [F.struct(F.lit(k).alias("rule"), v.alias("offset")) for k, v in offset_rules(F.col("a"), F.col("flags")).items()]
    return df.select("*", F.inline(F.array(*rules)))


def is_stored(flags: Column, b: Column, c: Column) -> Column:
    return (flags.bitwiseAND(F.lit(255)) == 0) & (b == c)


def in_bounds(offset: Column, b: Column, size: Column) -> Column:
    return (offset <= size) & (b <= size - offset)


NODE = struct.Struct("<hHIHH")


def _nodes(path: str, trailing: bytes | None, entries: int) -> Iterator[dict]:
    data = trailing or b""
    row = {"path": path, "idx": None, "link": None, "prev_sibling": None, "name_offset": None, "parent": None, "extra": None, "name": None, "node_count": None, "bytes_after": None, "error": None}
    if len(data) < 8:
        yield row | {"error": "trailing region shorter than 8 bytes"}
        return
    (count,) = struct.unpack_from("<I", data)
    if not count or 8 + 12 * count > len(data):
        yield row | {"error": "node count * 12 does not fit"}
        return
    (size,) = struct.unpack_from("<I", data, 4 + 12 * count)
    start = 8 + 12 * count
    if start + size > len(data):
        yield row | {"error": "name block size exceeds the trailing region"}
        return
    names = data[start : start + size]
    for i, (link, prev, name, parent, extra) in enumerate(NODE.iter_unpack(data[4 : 4 + 12 * count])):
        end = names.find(b"\0", name) if name < size else -1
        text = names[name:end].decode("latin-1") if end >= 0 else None  # a name needs a zero behind it
        yield row | {"idx": i, "link": link, "prev_sibling": prev, "name_offset": name, "parent": parent, "extra": extra, "name": text, "node_count": count, "bytes_after": len(data) - start - size}


def name_nodes(tables_: DataFrame) -> DataFrame:
    """Nodes of the name tree behind each record table (path, trailing, entries)."""
    return flat_map(tables_, ["path", "trailing", "entries"], _nodes, "path string, idx long, link int, prev_sibling int, name_offset long, parent int, extra int, name string, node_count long, bytes_after long, error string")


def _parents(nodes: DataFrame, keys: list[str], idx: str, parent: str) -> DataFrame:
    return nodes.select(*[F.col(k).alias(f"_p_{k}") for k in keys], F.col(parent).alias("_p_idx")).distinct()


def _is_parent(keys: list[str], idx: str) -> Column:
    on = F.col(idx) == F.col("_p_idx")
    for k in keys:
        on = on & (F.col(k) == F.col(f"_p_{k}"))
    return on


def parents_of(nodes: DataFrame, keys: list[str], idx: str, parent: str) -> DataFrame:
    """Nodes that some node of the same tree names as its parent: directories."""
    return nodes.join(_parents(nodes, keys, idx, parent), _is_parent(keys, idx), "left_semi")


def leaves_of(nodes: DataFrame, keys: list[str], idx: str, parent: str) -> DataFrame:
    """Nodes that no node of the same tree names as its parent: files."""
    return nodes.join(_parents(nodes, keys, idx, parent), _is_parent(keys, idx), "left_anti")


def directories(nodes: DataFrame) -> DataFrame:
    """Node 0 is a sentinel."""
    return parents_of(nodes.filter("idx > 0"), ["path"], "idx", "parent")


def file_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes without a child, with their file id; of several for one id the first stays and ``duplicate`` marks the others."""
    leaves = leaves_of(nodes.filter("idx > 0"), ["path"], "idx", "parent").withColumn("id", -F.col("link").cast("bigint"))
    first = stats.first_wins(leaves, ["path", "id"], "idx").select(F.col("path").alias("_a"), F.col("id").alias("_i"), F.col("first").alias("_first"))
    return leaves.join(first, (F.col("path") == F.col("_a")) & (F.col("id") == F.col("_i"))).withColumn("duplicate", F.col("idx") != F.col("_first")).drop("_a", "_i", "_first")


def missing(ids: DataFrame, id_: str, total: int) -> DataFrame:
    """Numbers 0 .. ``total`` - 1 (``id``) that ``ids`` has not."""
    return ids.sparkSession.range(total).join(ids.select(F.col(id_).alias("_k")), F.col("id") == F.col("_k"), "left_anti")


def tree_checks(nodes: DataFrame, entries: int | Column) -> DataFrame:
    """Counters of each tree: sanity of its fields, directories, files, duplicate and missing ids, nodes whose walk up never ends."""
    real = (F.col("idx") > 0) & F.col("idx").isNotNull()
    basic = nodes.groupBy("path").agg(
        F.max("node_count").alias("nodes"), F.max("bytes_after").alias("bytes_after"),
        F.count_if(real & F.col("name").isNull()).alias("bad_name_offsets"),
        F.count_if(real & (F.col("parent") >= F.col("node_count"))).alias("parent_out_of_range"),
        F.count_if(real & (F.col("parent") >= F.col("idx")) & (F.col("parent") < F.col("node_count"))).alias("parent_not_earlier"),
        F.count_if(real & (F.col("prev_sibling") >= F.col("node_count"))).alias("prev_out_of_range"),
        F.count_if(real & (F.col("extra") != 0)).alias("extra_not_zero"),
        F.first("error", ignorenulls=True).alias("error"), F.max(F.lit(entries) if isinstance(entries, int) else entries).alias("_total"),
    )
    total = F.lit(entries) if isinstance(entries, int) else entries
    files = file_nodes(nodes).withColumn("_ok", (F.col("id") >= 0) & (F.col("id") < total))
    of_files = files.groupBy("path").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("_ok")).alias("ids_out_of_range"), F.count_if(F.col("_ok") & F.col("duplicate")).alias("duplicate_ids"), F.count_if(F.col("_ok") & ~F.col("duplicate")).alias("_named"),
    )
    of_dirs = directories(nodes).groupBy("path").agg(F.count(F.lit(1)).alias("dirs"))
    tree = nodes.filter(real).select("path", F.col("idx").alias("id"), F.col("parent").cast("bigint").alias("parent"))
    cycles = steps_up(tree, MOST_NODES, ["path"]).filter(F.col("steps") >= MOST_NODES).groupBy("path").agg(F.count(F.lit(1)).alias("cycles"))
    out = basic.join(of_files, "path", "left").join(of_dirs, "path", "left").join(cycles, "path", "left")
    counted = [c for c in out.columns if c not in ("path", "error")]
    out = out.fillna(0, subset=counted).withColumn("missing_ids", F.when(F.col("error").isNull(), F.col("_total") - F.col("_named")).otherwise(0))
    return out.drop("_total", "_named")


#: Above the number of nodes that a tree of 16-bit parents can have.
MOST_NODES = 1 << 16


def steps_up(nodes: DataFrame, bound: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, id, steps): parents above each node of (keys, id, parent), exact below ``bound``; at or above it for longer walks and cycles.

    Every round doubles how far each node looks, so there are log2(bound) rounds at most, and fewer where all walks have
    ended. A round is a join and a written table.
    """
    keys = keys or []
    same = lambda a: [F.col(k) == F.col(f"{a}{k}") for k in keys]
    known = nodes.select(F.col("id").alias("_id"), *[F.col(k).alias(f"_k_{k}") for k in keys])
    on = [F.col("parent") == F.col("_id"), *same("_k_")]
    far = stored(nodes.join(known, on, "left").select(*keys, "id", F.col("_id").alias("to"), F.when(F.col("_id").isNull(), 0).otherwise(1).cast("bigint").alias("steps")))
    reach = 1
    while reach < bound and far.filter("to is not null").limit(1).count():
        next_ = far.select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("steps").alias("_steps"), *[F.col(k).alias(f"_k_{k}") for k in keys])
        on = [F.col("to") == F.col("_id"), *same("_k_")]
        far = stored(far.join(next_, on, "left").select(*keys, "id", F.col("_to").alias("to"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))
        reach *= 2
    return far.select(*keys, "id", "steps")


def paths_up(nodes: DataFrame, keys: list[str], separator: str = "/") -> DataFrame:
    """(keys, id, full): names from the root down to each node of (keys, id, parent, name), empty ones left out.

    Of any depth: every round puts the path of the node that a path ends at before it, so that lengths double. Nodes on or
    below a cycle, which are told first, by numbers alone, get a null ``full``.
    """
    steps = stored(steps_up(nodes.select(*keys, "id", "parent"), MOST_NODES, keys))
    held = [F.col(k) == F.col(f"_k_{k}") for k in keys]
    as_key = lambda df, *cols: df.select(*cols, *[F.col(k).alias(f"_k_{k}") for k in keys])
    depth = steps.filter(F.col("steps") < MOST_NODES).agg(F.max("steps")).first()[0] or 0
    ends = as_key(steps.filter(F.col("steps") < MOST_NODES), F.col("id").alias("_id"), F.col("steps").alias("_steps"))
    now = stored(nodes.join(ends, [F.col("id") == F.col("_id"), *held]).select(*keys, "id", F.when(F.col("_steps") > 0, F.col("parent")).alias("up"), F.coalesce("name", F.lit("")).alias("full")))
    reach = 1
    while reach <= depth:
        above = as_key(now, F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("full").alias("_full"))
        both = F.when(F.col("_full").isNull() | (F.col("_full") == ""), F.col("full")).when(F.col("full") == "", F.col("_full")).otherwise(F.concat("_full", F.lit(separator), "full"))
        now = stored(now.join(above, [F.col("up") == F.col("_id"), *held], "left").select(*keys, "id", F.col("_up").alias("up"), both.alias("full")))
        reach *= 2
    cyclic = steps.filter(F.col("steps") >= MOST_NODES).select(*keys, "id", F.lit(None).cast("string").alias("full"))
    return now.select(*keys, "id", "full").unionByName(cyclic)


def paths(nodes: DataFrame) -> DataFrame:
    """(path, idx, full) of name nodes; node 0 is the root and has no name."""
    real = nodes.filter("idx > 0").select("path", F.col("idx").alias("id"), F.col("parent").cast("bigint").alias("parent"), "name")
    return paths_up(real, ["path"]).withColumnRenamed("id", "idx")


def named(entries: DataFrame, names: DataFrame, on: Column, name: Column, id_: str) -> DataFrame:
    """``entries`` with the columns of ``names`` and ``name``; an entry without one is ``(unnamed <id>)``, and ``unnamed``."""
    rows = entries.join(names, on, "left")
    return rows.withColumn("unnamed", name.isNull()).withColumn("name", F.coalesce(name, F.concat(F.lit("(unnamed "), F.col(id_).cast("string"), F.lit(")"))))


def opened_tables(files: DataFrame) -> DataFrame:
    """(path, size, table_offset, preamble, records, trailing, error) of every archive, with the reason of those that cannot be read."""
    head = stored(probe(files))
    sized = _with_length(files).join(head.filter("error is null").select("path", "offset", F.col("field1").alias("size")), "path")
    read = tables(sized)
    good = read.join(head.select("path", F.col("size").alias("file_size"), F.col("offset").alias("table_offset")), "path")
    bad = head.filter("error is not null").select("path", F.col("size").alias("file_size"), "error")
    return stored(good.unionByName(bad, allowMissingColumns=True))


def listing(files: DataFrame) -> DataFrame:
    """Catalogue of ``files``: archive, id, path, offset, stored_size, original_size, compression, flags, in_bounds; archives that cannot be read give a row with ``error``."""
    table = opened_tables(files)
    rows = table.filter("error is null").select("path", "file_size", F.inline("records"))
    entry = rows.select(F.col("path").alias("archive"), "file_size", "id", offset_rules(F.col("a"), F.col("flags"))["(a<<8)|(flags>>24)"].alias("offset"), F.col("b").alias("stored_size"), F.col("c").alias("original_size"), F.col("flags").bitwiseAND(F.lit(255)).alias("compression"), "flags")
    nodes = stored(name_nodes(table.filter("error is null").select("path", "trailing", F.size("records").cast("long").alias("entries"))))
    broken = nodes.filter("error is not null").select(F.col("path").alias("_b"))
    entry = entry.join(broken, F.col("archive") == F.col("_b"), "left_anti")
    ids = file_nodes(nodes.filter("idx is not null")).filter("not duplicate").select(F.col("path").alias("_a"), F.col("id").alias("_id"), "idx")
    full = paths(nodes.filter("idx is not null")).select(F.col("path").alias("_f"), F.col("idx").alias("_i"), "full")
    names = ids.join(full, (F.col("_a") == F.col("_f")) & (F.col("idx") == F.col("_i"))).select("_a", "_id", "full")
    joined = named(entry, names, (F.col("archive") == F.col("_a")) & (F.col("id") == F.col("_id")), F.col("full"), "id")
    good = joined.select(
        "archive", "id", F.col("name").alias("path"), "offset", "stored_size", "original_size", "compression", "flags",
        in_bounds(F.col("offset"), F.col("stored_size"), F.col("file_size")).alias("in_bounds"), F.lit(None).cast("string").alias("error"),
    )
    failed = table.filter("error is not null").select("path", "error").unionByName(nodes.filter("error is not null").select("path", F.concat(F.lit("name table: "), "error").alias("error")))
    return good.unionByName(failed.select(F.col("path").alias("archive"), "error"), allowMissingColumns=True)


def _is_named(entries: DataFrame) -> DataFrame:
    """Named entries with the extension of their last component."""
    return entries.filter("error is null and not startswith(path, '(unnamed ')").withColumn("extension", leaf_extension(F.element_at(F.split("path", "/"), -1)))


def listing_summary(entries: DataFrame) -> DataFrame:
    return entries.filter("error is null").groupBy("archive").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("compression") == 0).alias("stored"), F.count_if(F.col("compression") == 2).alias("lz2k"),
        F.count_if(~F.col("compression").isin(0, 2)).alias("unknown"), F.count_if(F.startswith("path", F.lit("(unnamed "))).alias("unnamed"),
        F.count_if(~F.col("in_bounds")).alias("out_of_bounds"), F.sum("original_size").alias("original_bytes"),
    )


def total_entries(entries: DataFrame) -> DataFrame:
    return entries.filter("error is null").agg(F.count(F.lit(1)).alias("entries"))


def search(entries: DataFrame, text: str, column: str = "path") -> DataFrame:
    """Entries whose path has ``text``, in any ASCII case; all of them for an empty one."""
    from ..functions.classify import ascii_lower

    return entries.filter(F.contains(ascii_lower(F.col(column)), F.lit(text.lower()))) if text else entries


def packed_entries(entries: DataFrame, stride: int = 1) -> DataFrame:
    """Compressed entries that lie in their archive: every ``stride``-th by archive and id, over all archives."""
    found = entries.filter("error is null and compression = 2 and in_bounds")
    if stride <= 1:
        return found
    order = F.row_number().over(Window.partitionBy("archive").orderBy("id"))
    counts = found.groupBy("archive").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.partitionBy(F.lit(0)).orderBy("archive").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each archive
    numbered = found.withColumn("_own", order - 1).join(before.select(F.col("archive").alias("_a"), "_before"), F.col("archive") == F.col("_a"))
    return numbered.filter((F.col("_own") + F.col("_before")) % stride == 0).drop("_own", "_before", "_a")


def _asked(entries: DataFrame, files: DataFrame, columns: list[str]) -> DataFrame:
    """Rows (path, content if ``files`` has it, asked) with the entries of an archive in parts of at most 10,000."""
    part = F.floor(F.row_number().over(Window.partitionBy("archive").orderBy("offset", "id")) / 10_000)
    grouped = entries.withColumn("_part", part).groupBy("archive", "_part").agg(F.collect_list(F.struct(*columns)).alias("asked"))
    if "content" in files.columns:
        return files.select("path", "content").join(grouped, F.col("path") == F.col("archive")).select("path", "content", "asked")
    return grouped.select(F.col("archive").alias("path"), "asked")


def entry_bytes(entries: DataFrame, files: DataFrame, most: int | None = None) -> DataFrame:
    """(archive, id, data): the stored bytes of entries, the first ``most`` of them at most; null if they are not all there."""

    def read_all(read, path: str, asked: list[dict]) -> Iterator[dict]:
        for e in asked:
            want = e["stored_size"] if most is None else min(most, e["stored_size"])
            data = read(e["offset"], want)
            yield {"archive": path, "id": e["id"], "data": data if len(data) == want else None}

    return _by_position(_asked(entries, files, ["id", "offset", "stored_size"]), ["asked"], read_all, "archive string, id long, data binary")


def with_labels(entries: DataFrame, files: DataFrame, most: int = 2000) -> DataFrame:
    """Labels by content of the first ``most`` named entries of each archive and extension, as (archive, extension, label, n). 64 bytes an entry are read."""
    few = stored(stats.first_n(_is_named(entries), ["archive", "extension"], ["id"], most))
    heads = entry_bytes(few, files, 64).select(F.col("archive").alias("_a"), F.col("id").alias("_i"), "data")
    label = label_entry(F.col("data"), is_stored(F.col("flags"), F.col("stored_size"), F.col("original_size")))
    return few.join(heads, (F.col("archive") == F.col("_a")) & (F.col("id") == F.col("_i"))).groupBy("archive", "extension", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


def extension_stats(entries: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Named entries of each archive (or of ``by``) and extension: how many, stored, compressed, and their original bytes."""
    whole = is_stored(F.col("flags"), F.col("stored_size"), F.col("original_size"))
    return _is_named(entries).groupBy(*(["archive"] if by is None else by), "extension").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(whole).alias("stored"), F.count_if(~whole).alias("compressed"), F.sum("original_size").alias("original_bytes")
    )


def top_extensions(entries: DataFrame, n: int = 40) -> DataFrame:
    """The ``n`` extensions of most original bytes over all archives, the later one first among equals."""
    return extension_stats(entries, []).orderBy(F.col("original_bytes").desc(), F.col("extension").desc()).limit(n)


#: Bytes of the header, below which no entry should start; bytes of an entry that are looked at.
HEADER_BYTES, HEAD = 0x100, 64


def analysis(files: DataFrame, cap: int = 4000) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the record tables of ``files`` tell: (facts, rules, labels).

    facts: a row for each archive: counts of equal and unequal sizes by low byte, distinct flag bytes, what lies behind the
    records. rules: for each archive and offset rule, entries out of bounds, below the header, covered bytes, overlaps and largest gap. labels: for each archive, rule
    and kind (stored or compressed) the formats or first bytes of its first ``cap`` entries of four bytes or more.
    """
    table = opened_tables(files)
    good = table.filter("error is null")
    rows = good.select("path", "table_offset", F.inline("records"))
    flags = F.col("flags")
    facts = rows.groupBy("path").agg(
        F.count(F.lit(1)).alias("entries"), *stats.contingency(F.col("b"), F.col("c"), flags.bitwiseAND(F.lit(255))),
        F.count_distinct(flags.bitwiseAND(F.lit(255))).alias("low_bytes"), F.count_distinct(F.shiftrightunsigned(flags, 8).bitwiseAND(F.lit(65535))).alias("middles"), F.count_distinct(F.shiftrightunsigned(flags, 24)).alias("high_bytes"),
    )
    tail = F.col("trailing")
    behind = good.select(
        "path", "preamble", F.octet_length(tail).cast("bigint").alias("trailing_bytes"), stats.printable_ratio(tail).alias("printable"), F.greatest(F.col("table_offset") - HEADER_BYTES, F.lit(0)).alias("data_bytes"),
        F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: uint(tail, 4 * i, 4)).alias("lead_words"),
    )
    behind = behind.withColumn("lead_words", F.filter("lead_words", lambda x: x.isNotNull()))
    facts = behind.join(facts, "path", "left").fillna(0, [c for c in facts.columns if c != "path"])
    placed = with_rules(rows).withColumn("inside", F.col("offset") + F.col("b") <= F.col("table_offset")).withColumn("end", F.col("offset") + F.col("b"))
    checks = placed.groupBy("path", "rule").agg(F.count_if(~F.col("inside")).alias("out_of_bounds"), F.count_if(F.col("inside") & (F.col("offset") < HEADER_BYTES) & (F.col("b") != 0)).alias("below_header"))
    union = stats.interval_union(placed.filter("inside"), ["path", "rule"], "offset", "end").withColumnsRenamed({"path": "_p", "rule": "_r"})
    rules = checks.join(union, (F.col("path") == F.col("_p")) & (F.col("rule") == F.col("_r")), "left").drop("_p", "_r").fillna(0)
    kinds = placed.filter(F.col("inside") & (F.col("b") >= 4)).withColumn("kind", F.when(is_stored(flags, F.col("b"), F.col("c")), F.lit("stored")).otherwise(F.lit("compressed")))
    few = stored(stats.first_n(kinds, ["path", "rule", "kind"], ["id"], cap).select(F.col("path").alias("archive"), "rule", "kind", F.struct("rule", "id").alias("_key"), "id", "offset", F.col("b").alias("stored_size")))
    asked = few.select("archive", "id", "offset", "stored_size").distinct()
    heads = entry_bytes_at(asked, files, HEAD).select(F.col("archive").alias("_a"), F.col("id").alias("_i"), F.col("offset").alias("_o"), "data")
    found = format_of(F.col("data"))
    label = F.when((F.col("kind") == "stored") & (found != "unknown"), found).otherwise(lead_key(F.col("data")))
    labels = few.join(heads, (F.col("archive") == F.col("_a")) & (F.col("id") == F.col("_i")) & (F.col("offset") == F.col("_o"))).groupBy(F.col("archive").alias("path"), "rule", "kind", label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return facts, rules, labels


def entry_bytes_at(asked: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """(archive, id, offset, data): up to ``most`` bytes of (archive, id, offset, stored_size)."""

    def read_all(read, path: str, asked: list[dict]) -> Iterator[dict]:
        for e in asked:
            yield {"archive": path, "id": e["id"], "offset": e["offset"], "data": read(e["offset"], min(most, e["stored_size"]))}

    return _by_position(_asked(asked, files, ["id", "offset", "stored_size"]), ["asked"], read_all, "archive string, id long, offset long, data binary")


def planned(rows: DataFrame, stored_: Column, packed: Column, wanted: Column, reason: Column, stored_size: Column, original_size: Column, decompress: bool = False, dry_run: bool = False) -> DataFrame:
    """``rows`` with status, reason and planned_bytes. Statuses exclude each other, in this order.

    Bytes are planned before paths are looked at, so those of rejected entries count.
    """
    take = stored_ | (packed & F.lit(decompress))
    status = F.when(~wanted, "skipped_filter").when(~take, "skipped_compressed").when(reason.isNotNull(), "rejected").otherwise("dry-run" if dry_run else F.when(stored_, "written").otherwise("decompressed"))
    planned_ = F.when(wanted & stored_, stored_size).when(wanted & packed & F.lit(decompress), original_size).otherwise(0)
    return rows.withColumn("status", status).withColumn("reason", F.when(F.col("status") == "rejected", reason)).withColumn("planned_bytes", planned_.cast("bigint"))


def plan(entries: DataFrame, extensions: list[str] | None = None, decompress: bool = False, dry_run: bool = False) -> DataFrame:
    """What extraction does with each named entry: status, reason, planned_bytes."""
    rows = _is_named(entries)
    wanted = F.col("extension").isin(extensions) if extensions else F.lit(True)
    whole = is_stored(F.col("flags"), F.col("stored_size"), F.col("original_size"))
    return planned(rows, whole, F.col("compression") == 2, wanted, path_check(F.col("path")), F.col("stored_size"), F.col("original_size"), decompress, dry_run)


#: Bytes that are copied at a time.
COPY = 1 << 20


def extract(entries: DataFrame, files: DataFrame, out: str, extensions: list[str] | None = None, decompress: bool = False, dry_run: bool = False) -> DataFrame:
    """Write the entries that :func:`plan` takes below ``out`` and give the manifest: a row for each named entry.

    Bytes are read by position, decompressed, written under a temporary name and renamed. A file that has the right size
    already is ``reused`` and not read. Entries of one path go to one task, in the order of archives and ids, so that the
    later ones find the file of the first. ``out`` is a folder that all executors share. A task that runs again finds what
    it has written as reused.
    """
    todo = plan(entries, extensions, decompress, dry_run)
    take = F.col("status").isin("dry-run", "written", "decompressed")
    skipped = todo.filter(~take).select("archive", "id", "path", F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("label"), "status", F.when(F.col("status") == "rejected", F.concat(F.lit("rejected path '"), "path", F.lit("': "), "reason")).alias("error"))
    rows = todo.filter(take).select("archive", "id", "path", "offset", "stored_size", "original_size", "status", is_stored(F.col("flags"), F.col("stored_size"), F.col("original_size")).alias("whole"))
    held = "content" in files.columns
    if held:
        rows = rows.join(files.select(F.col("path").alias("_p"), "content"), F.col("archive") == F.col("_p")).drop("_p")
    else:
        rows = rows.withColumn("content", F.lit(None).cast("binary"))
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # stated, as few bytes of rows can be much work
    rows = rows.repartition(parts, "path").sortWithinPartitions("path", "archive", "id")

    def pieces(read, offset: int, size: int) -> Iterator[bytes]:
        """The range in pieces of COPY bytes, however large it is."""
        for at in range(0, size, COPY):
            some = read(offset + at, min(COPY, size - at))
            if len(some) < min(COPY, size - at):
                raise OSError("the archive ends within the entry")
            yield some

    def one(store, folder: str, read, path: str, offset: int, packed: int, size: int, whole: bool, status: str) -> tuple:
        """(bytes, head of the content, status, error)"""
        if status == "dry-run":
            return size, read(offset, min(HEAD, packed)) if whole else b"", status, None
        target = f"{folder}/{path.replace(chr(92), '/')}"
        info = store.get_file_info(target)
        if info.type.name == "File" and info.size == size:
            return size, None, "reused", None
        head, parts = (read(offset, min(HEAD, packed)), pieces(read, offset, packed)) if whole else (None, None)
        if not whole:
            data, failure = codec.decompress(read(offset, packed), size)
            if failure:
                return None, None, "error", f"cannot decompress {path}: {failure}"
            head, parts = data[:HEAD], iter([data])
        try:
            written(store, target, parts)
        except OSError as e:
            return None, None, "error", f"cannot write {path}: {e}"
        return size, head, status, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(out)
        readers: dict[str, Callable] = {}
        names = ["archive", "id", "path", "bytes", "head", "status", "error", "whole"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.bool_()]
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["archive"] not in readers:
                    if len(readers) > 64:
                        readers.clear()
                    readers[r["archive"]] = _reading(r["archive"], r["content"] if held else None)
                size = r["stored_size"] if r["whole"] else r["original_size"]
                done.append((r["archive"], r["id"], r["path"], *one(store, folder, readers[r["archive"]], r["path"], r["offset"], r["stored_size"], size, r["whole"], r["status"]), r["whole"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done) if done else [()] * 8, kinds)], names)

    found = rows.select("archive", "id", "path", "offset", "stored_size", "original_size", "status", "whole", "content").mapInArrow(run, "archive string, id long, path string, bytes long, head binary, status string, error string, whole boolean")
    label = F.when(F.col("status") == "reused", "-").when((F.col("status") == "dry-run") & ~F.col("whole"), "lz2k").when(F.col("head").isNotNull(), label_entry(F.col("head"), F.lit(True)))
    return stored(found.select("archive", "id", "path", "bytes", label.alias("label"), "status", "error").unionByName(skipped))


def extract_stats(manifest: DataFrame) -> DataFrame:
    """The eight counters over a manifest; what a dry run would write counts as written."""
    made = F.col("status").isin("written", "decompressed", "dry-run")
    count = lambda status: F.count_if(F.col("status") == status)
    return manifest.agg(
        F.count_if(made).alias("written"), count("reused").alias("reused"), F.coalesce(F.sum(F.when(made, F.col("bytes"))), F.lit(0)).alias("bytes"), count("decompressed").alias("decompressed"),
        count("skipped_compressed").alias("skipped_compressed"), count("skipped_filter").alias("skipped_filter"), count("rejected").alias("rejected"), count("error").alias("errors"),
    )


def manifest_rows(manifest: DataFrame) -> DataFrame:
    """The rows of the manifest file: what was or would be written, or was there: id, path, bytes, label, status."""
    return manifest.filter(F.col("status").isin("dry-run", "reused", "decompressed", "written")).select("id", "path", "bytes", "label", "status")


def listing_rows(entries: DataFrame, more: list[str] | None = None) -> DataFrame:
    """The rows of the listing file, after the columns ``more``."""
    name = F.when(F.startswith("path", F.lit("(unnamed ")), F.lit("(unnamed)")).otherwise(F.col("path"))
    return entries.filter("error is null").select(*(more or []), "id", name.alias("path"), "offset", F.col("stored_size").alias("stored"), F.col("original_size").alias("original"), "compression")
