"""Files as rows, whole or by byte range, and what is written back."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

MOST_FILES = 20_000


def tree(spark: SparkSession, root: str, most: int | None = MOST_FILES, outside: str | None = None) -> tuple[DataFrame, bool]:
    """(files below ``root``, or the file ``root``, as path, length, content; whether there are more than ``most``; None: no limit). Files below ``outside`` do not count; order is by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).withColumn("path", F.regexp_replace("path", "^file:/*", "/"))
    if outside:
        files = files.filter(~F.startswith("path", F.lit(outside.removeprefix("file:").rstrip("/") + "/")))
    if most is None:
        return files.select("path", "length", "content"), False
    capped = files.select("path").limit(most + 1).count() > most
    few = files.select("path").orderBy("path").limit(most)
    return files.join(few, "path", "left_semi").select("path", "length", "content"), capped


def archives(spark: SparkSession, root: str) -> DataFrame:
    """Files right in a folder whose extension starts with ``.dat``, in any case, or the one file ``root`` of any name: (path, length). Their content is read by position, whatever their size."""
    store, name = opened(root.removeprefix("file:") if root.startswith("file:/") else root) if "://" not in root else (None, root)
    if store is not None and store.get_file_info(name).type.name == "File":
        return spark.read.format("binaryFile").load(root).select("path", "length")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[dD][aA][tT]*").load(root).select("path", "length")
    return files.filter(F.regexp_like("path", F.lit("\\.[dD][aA][tT][^./]*$")))


def natural_key(name: Column) -> Column:
    """Sorts names as people do: digits count as numbers (of at most 20 digits), letter case does not."""
    padded = F.regexp_replace(F.lower(name), "([0-9]+)", "00000000000000000000$1")
    return F.regexp_replace(padded, "0*([0-9]{20})", "$1")


def documents(spark: SparkSession, root: str) -> DataFrame:
    """Archives of a folder that are not hidden, in the natural order of their names, with their ``place`` (1, 2 ...). A row for each archive meets in one task."""
    name = F.element_at(F.split("path", "/"), -1)
    found = archives(spark, root).filter(~F.startswith(name, F.lit(".")))
    return found.withColumn("place", F.row_number().over(Window.orderBy(natural_key(name), "path")).cast("bigint")).orderBy("place")


def geometry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ghg").load(root).select("path", "length", "content")


def opened(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{os.path.abspath(path)}")


def copied(files: DataFrame, root: str, out: str, buffer: int = 1 << 20) -> DataFrame:
    """(path, copy, error): stream each of ``files`` (path) to the same place below ``out`` as it has below ``root``.

    A file is copied ``buffer`` bytes at a time under a temporary name and renamed. A copy onto itself or out of ``out`` is refused.
    """
    base, top = root.removeprefix("file:"), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = opened(top)
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                relative = os.path.relpath(path, base) if path != base.rstrip("/") else os.path.basename(path)
                target, error = f"{folder}/{relative}", None
                if ".." in relative.split("/"):
                    error = "copy would leave the folder"
                elif os.path.realpath(path) == os.path.realpath(target):
                    error = "copy onto itself"
                else:
                    partial = f"{target}.{uuid.uuid4().hex}.part"
                    try:
                        source, name = opened(path)
                        store.create_dir(os.path.dirname(target), recursive=True)
                        with source.open_input_stream(name) as read, store.open_output_stream(partial) as write:
                            while some := read.read(buffer):
                                write.write(some)
                        store.move(partial, target)
                    except OSError as e:
                        error = f"cannot copy: {e}"
                        if store.get_file_info(partial).type.name == "File":
                            store.delete_file(partial)
                rows.append((path, None if error else target, error))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 3)], ["path", "copy", "error"])

    return files.select("path").mapInArrow(run, "path string, copy string, error string")


class _Range(InputPartition):
    def __init__(self, path: str, start: int, size: int):
        self.path, self.start, self.size = path, start, size


class RangedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("rangebytes", 64 << 20))

    def _open(self):
        return opened(self.path)

    def partitions(self) -> list[InputPartition]:
        store, path = self._open()
        size = store.get_file_info(path).size
        return [_Range(self.path, at, min(self.step, size - at)) for at in range(0, size, self.step)]

    def read(self, part: _Range) -> Iterator[tuple]:
        store, path = self._open()
        with store.open_input_file(path) as f:
            yield (part.path, part.start, f.read_at(part.size, part.start))


class RangedFile(DataSource):
    """``spark.read.format("ranged_file").option("rangeBytes", n).load(path)``: (path, start, data), a task for each range, for files beyond the two gigabytes of binaryFile."""

    @classmethod
    def name(cls) -> str:
        return "ranged_file"

    def schema(self) -> str:
        return "path string, start long, data binary"

    def reader(self, schema) -> DataSourceReader:
        return RangedReader(self.options)


def inside(path: str, folder: str) -> bool:
    """Whether ``path`` is ``folder`` or below it, links resolved."""
    path, folder = os.path.realpath(path), os.path.realpath(folder)
    return os.path.commonpath([path, folder]) == folder


def check_room(folder: str, planned: int, dry_run: bool = False) -> None:
    """Fail unless the planned bytes, a twentieth more and 256 MiB are free."""
    if not dry_run and shutil.disk_usage(folder).free < planned + planned // 20 + (256 << 20):
        raise OSError("not enough free space for the planned bytes")


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def written(store, target: str, parts: Iterator[bytes]) -> None:
    """Write ``parts`` under a temporary name of its own and rename it; nothing stays of a write that fails."""
    partial = f"{target}.{uuid.uuid4().hex}.part"
    try:
        store.create_dir(os.path.dirname(target), recursive=True)
        with store.open_output_stream(partial) as f:
            for part in parts:
                f.write(part)
        store.move(partial, target)
    except OSError:
        if store.get_file_info(partial).type.name == "File":
            store.delete_file(partial)
        raise
