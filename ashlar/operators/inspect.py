"""File reports: what every file of a tree is, the histograms over them, and the report texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.binexpr import clamped, hex_dump
from ..functions.classify import family_of, format_of, graphics_evidence, graphics_in, imported_evidence, imported_graphics
from ..sources import files as sources
from ..sources.shared import stored
from . import executables, zipdir
from .stats import entropy_udf

HEADER_BYTES, HIGH_ENTROPY = 64, 7.5
_NONE = "array<string>"


def _notes(*cases: tuple[Column, Column]) -> Column:
    return F.filter(F.array(*[F.when(when, note) for when, note in cases]), lambda x: x.isNotNull())


def report(files: DataFrame) -> DataFrame:
    """A row for each of ``files`` (path, length, content). A format's name wins over the executable kind; a DOS stub is not recognised."""
    exe = executables.executables(files).withColumnRenamed("path", "_e")
    found = zipdir.entries(files.withColumn("_f", format_of(F.col("content"))).filter("_f = 'zip'").select("path", "content"))
    kinds = zipdir.extensions(found).groupBy(F.col("path").alias("_k")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("extension", "n")))).alias("extensions"))
    zips = zipdir.summaries(found).join(kinds, F.col("path") == F.col("_k"), "left").drop("_k").withColumnRenamed("path", "_z")
    content = F.col("content")
    base = files.select(
        "path", F.col("length").alias("size"), format_of(content).alias("_format"), family_of(content).alias("_family"), graphics_in(content).alias("_scan"), graphics_evidence(content).alias("_seen"),
        F.round(entropy_udf()(content), 6).alias("entropy"), hex_dump(content, HEADER_BYTES).alias("_dump"),
    )
    joined = base.join(exe, F.col("path") == F.col("_e"), "left").join(zips, F.col("path") == F.col("_z"), "left")
    known_exe = F.col("kind").isNotNull() & (F.col("kind") != "dos-stub")
    known_format = F.col("_format") != "unknown"
    known = known_format | known_exe
    libraries = F.coalesce("libraries", F.array().cast(_NONE))
    notes = _notes(
        (~known_format & known_exe, F.lit("executable container: architecture and libraries read")),
        (~known_format & ~known_exe, F.lit("no documented signature at the start")),
        (known_format, F.concat(F.lit("signature of "), F.col("_format"))),
        (F.col("note") != "", F.col("note")),
        (~known, F.lit("unknown layout: not guessed")),
        (~known & (F.col("entropy") > HIGH_ENTROPY), F.lit("high entropy: compressed or encrypted")),
    )
    return joined.select(
        "path", "size", F.coalesce("kind", F.lit("none")).alias("binary_kind"), F.coalesce("arch", F.lit("unknown")).alias("arch"), F.coalesce("endian", F.lit("unknown")).alias("endian"),
        F.coalesce("fat_archs", F.array().cast(_NONE)).alias("fat_archs"),
        F.when(known_format, F.col("_format")).when(known_exe, F.col("kind")).otherwise("unknown").alias("format"),
        F.when(known_format, F.col("_family")).when(known_exe, F.lit("executable")).otherwise("unknown").alias("family"),
        known.alias("recognized"), libraries.alias("libraries"), F.array_union(F.col("_scan"), imported_graphics(libraries)).alias("graphics_apis"),
        F.array_union(F.col("_seen"), imported_evidence(libraries)).alias("graphics_evidence"), "entropy",
        F.when(~known, F.col("_dump")).alias("header_hex"), notes.alias("notes"),
        F.struct("parsed", "zip64", "truncated", "entry_count", "encrypted_count", "sample_names", "extensions", "note").alias("zip"),
    )


def inspect_tree(spark: SparkSession, root: str, out: str | None = None, copy: bool = False, most: int | None = sources.MOST_FILES) -> tuple[DataFrame, DataFrame, bool]:
    """(reports by path, errors (path, error), whether the walk was cut off) of the files below ``root``, or of one file.

    With ``copy`` the files are copied to ``out``/copies first and the copies are looked at; a file that cannot be copied
    is an error, and the walk goes on. Files below ``out`` do not count.
    """
    files, capped = sources.tree(spark, root, most, out)
    if not copy:
        return report(files).orderBy("path"), spark.createDataFrame([], "path string, error string"), capped
    if not out:
        raise ValueError("copies need a folder")
    store, folder = sources.opened(f"{out}/copies")
    store.create_dir(folder, recursive=True)
    done = stored(sources.copied(files.select("path"), root, f"{out}/copies"))
    copies = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{out}/copies").select(F.regexp_replace("path", "^file:/*", "/").alias("copy"), "length", "content")
    found = done.filter("error is null").join(copies, "copy")
    return report(found.select("path", "length", "content")).orderBy("path"), done.filter("error is not null").select("path", "error"), capped


def by_format(reports: DataFrame) -> DataFrame:
    return reports.groupBy("format").agg(F.count(F.lit(1)).alias("n")).orderBy("format")


def by_arch(reports: DataFrame) -> DataFrame:
    return reports.filter("arch <> 'unknown'").groupBy("arch").agg(F.count(F.lit(1)).alias("n")).orderBy("arch")


def by_graphics(reports: DataFrame) -> DataFrame:
    return reports.select(F.explode("graphics_apis").alias("api")).groupBy("api").agg(F.count(F.lit(1)).alias("n")).orderBy("api")


def unknown_log(reports: DataFrame) -> DataFrame:
    return reports.filter("not recognized").select("path", "size", "entropy", "header_hex", "notes").orderBy("path")


def as_json(reports: DataFrame) -> DataFrame:
    """One JSON object a file, of ten fields."""
    fields = ("path", "size", "binary_kind", "arch", "format", "family", "recognized", "entropy", "graphics_apis", "libraries")
    return reports.select("path", F.to_json(F.struct(*fields)).alias("value")).orderBy("path").select("value")


def by_zip_extension(reports: DataFrame) -> DataFrame:
    """Extensions of the entries of all zip files, added up."""
    return reports.filter("zip.parsed").select(F.explode("zip.extensions").alias("extension", "n")).groupBy("extension").agg(F.sum("n").alias("n")).orderBy("extension")


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _listed(name: str, values: Column) -> Column:
    return F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(values, " ")))


def report_lines(reports: DataFrame) -> DataFrame:
    """(path, value): the lines of a file's report as one text, in the order of paths."""
    zip_ = F.col("zip")
    parsed = F.coalesce(zip_["parsed"], F.lit(False))
    kinds = F.transform(F.map_entries(F.coalesce(zip_["extensions"], F.create_map().cast("map<string,bigint>"))), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    lines = F.concat(
        F.array(
            _line("file", F.col("path")), _line("size", F.col("size")), _line("binary", F.col("binary_kind")), _line("arch", F.col("arch")), _line("endian", F.col("endian")), _listed("fat_arch", F.col("fat_archs")),
            _line("format", F.col("format")), _line("family", F.col("family")), F.when(F.col("recognized"), F.lit("recognized: yes")).otherwise("recognized: no"), _line("entropy64k", F.col("entropy")),
            _listed("libraries", F.col("libraries")), _listed("graphics", F.col("graphics_apis")), _listed("graphics_evidence", F.col("graphics_evidence")),
            F.when(parsed, _line("zip_entries_seen", zip_["entry_count"])), F.when(parsed, _line("zip_encrypted", zip_["encrypted_count"])),
            F.when(parsed, F.concat(F.lit("zip_extensions: "), F.array_join(kinds, " "))), F.when(parsed & (F.size(zip_["sample_names"]) > 0), F.lit("zip_sample:")),
        ),
        F.when(parsed, F.transform(zip_["sample_names"], lambda n: F.concat(F.lit("  "), n))).otherwise(F.array().cast(_NONE)),
        F.transform("notes", lambda n: F.concat(F.lit("note: "), n)),
        F.array(F.when(~F.col("recognized"), F.concat(F.lit("header:\n"), F.col("header_hex")))),
    )
    return reports.select("path", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n").alias("value")).orderBy("path")


def summary_lines(reports: DataFrame, errors: DataFrame, capped: bool) -> list[str]:
    """The summary, from histograms of a bounded number of names."""
    out = [f"files: {reports.count()}", f"unknown: {reports.filter('not recognized').count()}", f"open_errors: {errors.count()}", f"hit_file_cap: {'yes' if capped else 'no'}"]
    for title, histogram in (("by_format", by_format), ("by_arch", by_arch), ("by_graphics", by_graphics), ("zip_extensions", by_zip_extension)):
        out += [f"{title}:", *(f"  {r[0]} {r[1]}" for r in histogram(reports).collect())]
    return out


def write_reports(reports: DataFrame, errors: DataFrame, capped: bool, out: str, json: bool = False) -> None:
    """Folders of text below ``out``: report, unknown, summary, errors, and json on demand."""
    spark = reports.sparkSession
    report_lines(reports).select("value").write.mode("overwrite").text(f"{out}/report")
    unknown = unknown_log(reports)
    unknown.select(F.concat_ws("\n", _line("file", F.col("path")), _line("size", F.col("size")), _line("entropy64k", F.col("entropy")), "header_hex").alias("value")).write.mode("overwrite").text(f"{out}/unknown")
    errors.select(F.concat(F.lit("error: "), F.col("error")).alias("value")).write.mode("overwrite").text(f"{out}/errors")
    spark.createDataFrame([(x,) for x in summary_lines(reports, errors, capped)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
    if json:
        as_json(reports).write.mode("overwrite").text(f"{out}/json")


def byte_head(df: DataFrame, raw: str, n: int) -> DataFrame:
    return df.withColumn("head", clamped(F.col(raw), 0, n))
