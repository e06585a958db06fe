"""Counter archives packed from the derived counter rows, as an ingest input that grows with the tables."""

from __future__ import annotations

import functools
import hashlib
import itertools
import operator
import os
import struct
import tarfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from radiokpi.tables import Tables

ORDERS_PER_ARCHIVE = 4000
# Lines packed by one task.
LINES_PER_TASK = 500_000
HEADER = ["CollectTime", " ANI", "SBNID", "eNBid", "ENODEBID", "CellID", "MEID", "SystemMode", "NOISE", "DetectPort",
          "c373424610", "C373424609", "C373424610"]


@functools.lru_cache(maxsize=4096)
def _entry(member: str, size: int) -> bytes:
    entry = tarfile.TarInfo(member)
    entry.size = size
    return entry.tobuf()


def _padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % tarfile.BLOCKSIZE)


_HEAD = ",".join(HEADER)
# What follows the first member is the same in every archive.
_OTHERS = {"data/PM_B.CSV": f"{_HEAD}\n".encode(), "notes.txt": b"x"}
_REST = b"".join(_entry(member, len(data)) + _padded(data) for member, data in _OTHERS.items()) + bytes(2 * tarfile.BLOCKSIZE)


def _packed(data: bytes, wbits: int) -> bytes:
    """Deflated with little memory, as suits a few kilobytes: most of the time would go into making it ready."""
    pack = zlib.compressobj(3, zlib.DEFLATED, wbits, 4)
    return pack.compress(data) + pack.flush()


def _zip_parts(member: str, data: bytes) -> tuple[bytes, bytes]:
    """What stands before a member's place in the directory of a zip archive and what follows it, and the member itself."""
    content = _packed(data, -zlib.MAX_WBITS)
    name, method = member.encode(), 8
    if len(content) >= len(data):
        content, method = data, 0
    # Version, flags, method, time and day (1 January 1980), checksum, sizes, length of the name, no extra field.
    fields = struct.pack("<5H3L2H", 20, 0, method, 0, 33, zlib.crc32(data), len(content), len(data), len(name), 0)
    return b"PK\1\2" + struct.pack("<H", 20) + fields + bytes(10), b"PK\3\4" + fields + name + content


_ZIP_OTHERS = {member: _zip_parts(member, data) for member, data in _OTHERS.items()}


def _pack(name: str, lines) -> bytes:
    """Two CSV members, one of them empty but for its header, and a text member that is to be left alone."""
    first = ("\ufeff" + "\n".join([_HEAD, *lines]) + "\n").encode()
    if not name.endswith(".zip"):
        return _packed(_entry("data/pm_a.csv", len(first)) + _padded(first) + _REST, 16 + zlib.MAX_WBITS)
    out, directory, parts = b"", b"", {"data/pm_a.csv": _zip_parts("data/pm_a.csv", first), **_ZIP_OTHERS}
    for member, (entry, stored) in parts.items():
        directory += entry + struct.pack("<L", len(out)) + member.encode()
        out += stored
    return out + directory + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, len(parts), len(parts), len(directory), len(out), 0)


def written_file(path: str) -> pa.NativeFile:
    """A new file at ``path``, in any store pyarrow knows; its folder is made where it is missing."""
    store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    store.create_dir(os.path.dirname(inside), recursive=True)
    return store.open_output_stream(inside, compression=None)


def csv_rows(tables: Tables, tasks: int) -> DataFrame:
    """One CSV line per counter row with the archive it goes into; the lines of an archive are in one of ``tasks`` partitions.

    Numbers are moved, of which names and lines are made where they arrive.

    An archive takes the rows of one family and interval and of at most
    ``ORDERS_PER_ARCHIVE`` orders, so its size does not grow with the tables;
    the number of archives does. The order block is the revision in its name.
    """
    block = F.floor(F.col("l_orderkey") / ORDERS_PER_ARCHIVE)
    read = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "dataset_family", "collect_time"]
    moved = tables.pm_base.select(*read).repartition(tasks, block, "collect_time", F.col("l_partkey") % 2)
    rows = moved.join(tables.archive_prefix, F.col("dataset_family").eqNullSafe(F.col("prefix_family")))
    name = F.concat("prefix", F.date_format("collect_time", "yyyyMMdd_HHmm"), F.lit("_R"), block.cast("string"),
                    F.when(F.col("l_partkey") % 2 == 0, ".zip").otherwise(".tar.gz"))
    number = F.col("l_quantity").cast("int").cast("string")
    supp = F.col("l_suppkey").cast("string")

    def node(family: str):
        return F.when(F.col("dataset_family") == family, F.concat(F.lit(" "), supp, F.lit(" "))).otherwise("")

    time = F.when((F.col("l_orderkey") % 500 == 123) & (F.col("l_linenumber") == 2), "badtime").otherwise(
        F.concat(F.date_format("collect_time", "yyyyMMddHHmmss"), F.lit(" ")))
    cells = [
        time, F.concat(F.lit("ANI_"), supp), (F.col("l_suppkey") % 7).cast("string"), node("PM/itbbu/ltefdd"),
        node("PM/sdr/ltefdd"), (F.col("l_linenumber") % 3 + 1).cast("string"), node("PM/itbbu/itbbuplat"), F.lit("FDD"), F.lit("x"),
        F.lit("1"), F.lit("999"),
        F.when(F.col("l_linenumber") == 7, "n/a").when(F.col("l_linenumber") == 6, "  ").otherwise(F.concat(number, F.lit("5e-1"))), number]
    return rows.select(name.alias("source_file"), F.concat_ws(",", *cells).alias("line"))


def archives(tables: Tables, folder: str, *, copies: str | None = None) -> DataFrame:
    """Archives (path, source_file, file_hash) written below ``folder``/in.

    With ``copies``, which is put before their names, some are there once more, those of equal name below ``folder``/more. The archives
    are tiny and as many as there are lines for a few each, so those of a task lie one behind the other in one container
    file. A task holds the lines of one archive at a time; one that is repeated writes the same bytes again.
    """
    def written(batches):
        part = f"{TaskContext.get().partitionId():06d}"
        files, places = {}, {}

        def kept(place: str, content: bytes) -> str:
            if place not in files:
                files[place], places[place] = written_file(f"{folder}/{place}/{part}"), 0
            files[place].write(content)
            start, places[place] = places[place], places[place] + len(content)
            return f"{folder}/{place}/{part}#{start}+{len(content)}"

        def records():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())

        def batch_of(rows):
            return pa.record_batch([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 3)], names=["path", "source_file", "file_hash"])

        rows = []
        for name, lines in itertools.groupby(records(), operator.itemgetter(0)):
            content = _pack(name, [line for _, line in lines])
            place = kept("in", content)
            found = [f"{place}/{name}"]
            if copies is not None and name.startswith("UMEID_LTEFDD") and name.endswith(".zip"):
                # A copy of another name is one more name of the same bytes.
                found.append(f"{place if copies else kept('more', content)}/{copies}{name}")
            rows += [(path, os.path.basename(path), hashlib.sha256(content).hexdigest()) for path in found]
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        for file in files.values():
            file.close()  # before the last rows are handed on: what is listed is there
        yield batch_of(rows)

    # Packing is work per archive, not per byte: keep every core busy although the data are small.
    spark = tables.lineitem.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, tables.lineitem.count() // LINES_PER_TASK)
    sorted_rows = csv_rows(tables, tasks).sortWithinPartitions("source_file", "line")
    listing = sorted_rows.mapInArrow(written, "path string, source_file string, file_hash string")
    listing.write.option("compression", "zstd").parquet(f"{folder}/listing")
    return spark.read.parquet(f"{folder}/listing")


def small_files(paths: DataFrame) -> DataFrame:
    """A file of one byte at every ``path``, written by the tasks that hold it; returns the paths."""
    def written(batches):
        made = set()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder = os.path.dirname(path)
                store, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
                if folder not in made:
                    store.create_dir(os.path.dirname(inside), recursive=True)
                    made.add(folder)
                with store.open_output_stream(inside, compression=None) as file:
                    file.write(b"x")
            yield batch

    return paths.select("path").mapInArrow(written, "path string")
