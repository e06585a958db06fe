"""Counter archives to fact rows.

Archives stay files: tasks open them by path, in any store pyarrow knows, so no archive is ever a value of a row.
``archive_spans`` cuts each into spans of members, which are dealt to tasks by themselves; a span is read as a stream
of Arrow batches of bounded size. So one huge zip archive is read by many tasks, and what a task holds depends neither
on the archive nor on a member. A gzipped tar archive has no index and is one span, read as a stream as well.
Very many small archives may lie one behind the other in container files; their paths say where.

A member's header is sent once, on its marker row; records carry their dimensions as columns and their counters as an
array in the order of the header. ``layouts`` has one row for each different header and names the counters.
"""

from __future__ import annotations

import csv
import functools
import gzip
import hashlib
import io
import itertools
import operator
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from radiokpi.functions import blank_to_null, stamp, strip_space
from radiokpi.schemas import FACT_COLUMNS, KEPT_DIMENSIONS, KNOWN_COLUMNS, TIME_COLUMN
from radiokpi.sources.manifest import with_archive_fields

_DIMENSIONS = [name.lower() for name in KEPT_DIMENSIONS]
_HEAD = ["path", "source_file", "csv_name", "member_no", "row_no", "layout", "names", TIME_COLUMN.lower(), *_DIMENSIONS, "problem"]
_KINDS = {"member_no": pa.int32(), "row_no": pa.int64(), "layout": pa.int64(), "names": pa.list_(pa.string())}
_SQL = {"member_no": "int", "row_no": "bigint", "layout": "bigint", "names": "array<string>"}
# What the name of an archive tells. It is read once for an archive, not for each of its records.
_NAMED = {"dataset_family": pa.string(), "interval_start": pa.timestamp("us"), "revision": pa.int32()}
EXPANDED = ", ".join(f"{c} {_SQL.get(c, 'string')}" for c in _HEAD) + (
    ", counters array<double>, dataset_family string, interval_start timestamp_ntz, revision int")
SPANS = "path string, source_file string, first int, last int"
_BATCH_CELLS, _BATCH_ROWS = 500_000, 20_000
# Unpacked size and number of members that make one span.
SPAN_BYTES, SPAN_MEMBERS = 64 << 20, 2_000
_CHUNK = 1 << 20
# A path inside a container file: the container, the place and length of the archive in it, and the archive's name.
_INSIDE = re.compile(r"^(.*)#(\d+)\+(\d+)/[^/]+$", re.S)
# The most that a compressed byte unpacks to, and the least bytes of a member of a zip archive.
_MOST_UNPACKED, _LEAST_MEMBER = 1032, 76
_COUNTER = r"^C[0-9]+$"


# --- files ----------------------------------------------------------------------------------

class _Window(io.RawIOBase):
    """A stretch of a container file as a file of its own."""

    def __init__(self, file: pa.NativeFile, start: int, length: int) -> None:
        self._file, self._start, self._length, self._at = file, start, length, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self._at = offset + {io.SEEK_SET: 0, io.SEEK_CUR: self._at, io.SEEK_END: self._length}[whence]
        return self._at

    def readinto(self, buffer) -> int:
        self._file.seek(self._start + self._at)
        data = self._file.read(max(0, min(len(buffer), self._length - self._at)))
        buffer[:len(data)] = data
        self._at += len(data)
        return len(data)

    def close(self) -> None:
        self._file.close()
        super().close()


def _whole(path: str) -> pa.NativeFile:
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:", "", path))
    store, inside = fs.FileSystem.from_uri(path)
    return store.open_input_file(inside)


def opened(path: str) -> pa.NativeFile | io.IOBase:
    """The file at ``path`` for random access, or the archive at ``container#place+length/name`` inside a container file.

    Of files up to a megabyte the bytes are read at once.
    """
    inside = _INSIDE.match(path)
    if not inside:
        file = _whole(path)
        if file.size() > _CHUNK:
            return file
        with file:
            return io.BytesIO(file.read())
    start, length = int(inside[2]), int(inside[3])
    file = _whole(inside[1])
    if length > _CHUNK:
        return io.BufferedReader(_Window(file, start, length))
    with file:
        file.seek(start)
        return io.BytesIO(file.read(length))


def _small(path: str, held: dict[str, pa.NativeFile]) -> bytes | None:
    """The bytes of an archive of up to a megabyte inside a container file; ``held`` keeps the container of the one before open."""
    inside = _INSIDE.match(path)
    if not inside or int(inside[3]) > _CHUNK:
        return None
    if inside[1] not in held:
        for file in held.values():
            file.close()
        held.clear()
        held[inside[1]] = _whole(inside[1])
    return held[inside[1]].read_at(int(inside[3]), int(inside[2]))


def _size(path: str) -> int:
    inside = _INSIDE.match(path)
    if inside:
        return int(inside[3])
    with _whole(path) as file:
        return file.size()


def located(archives: DataFrame) -> DataFrame:
    """Archives with ``path``; where a listing has none, the name is the path."""
    return archives if "path" in archives.columns else archives.withColumn("path", F.col("source_file"))


def archive_files(files: DataFrame) -> DataFrame:
    """Archives (path, source_file, file_hash) of a listing with ``path``, such as a ``binaryFile`` scan.

    The hash is taken from the file in pieces; the listing's ``content`` is not asked for.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with opened(path) as file:
                    while piece := file.read(_CHUNK):
                        digest.update(piece)
                digests.append(digest.hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.string())], names=["path", "file_hash"])

    return files.select("path").mapInArrow(hashed, "path string, file_hash string").select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("source_file"), "file_hash")


# --- expansion ------------------------------------------------------------------------------

def _is_csv(name: str) -> bool:
    return name[-4:].lower() == ".csv"


def _spans(path: str, most: int) -> list[tuple[int, int]]:
    """First and last member of each span; an archive too small for two is not looked into."""
    size = _size(path)
    if size * _MOST_UNPACKED < SPAN_BYTES and size // _LEAST_MEMBER < most:
        return [(1, 0)]
    with opened(path) as file:
        return list(_listed_spans(file, most))


def _listed_spans(file: pa.NativeFile | io.IOBase, most: int) -> Iterator[tuple[int, int]]:
    """The leading bytes say what the archive is, not its name."""
    if file.read(2) != b"PK":
        yield 1, 0  # read to its end
        return
    file.seek(0)
    first, size, no = 1, 0, 0
    for entry in zipfile.ZipFile(file).infolist():
        if entry.is_dir() or not _is_csv(entry.filename):
            continue
        no, size = no + 1, size + entry.file_size
        if size >= SPAN_BYTES or no - first + 1 >= most:
            yield first, no
            first, size = no + 1, 0
    if first <= no:
        yield first, no


def archive_spans(archives: DataFrame, span_members: int = SPAN_MEMBERS) -> DataFrame:
    """Spans (path, source_file, first, last member) of archives; an archive that cannot be listed is one span."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, name in zip(*(column.to_pylist() for column in batch.columns)):
                try:
                    rows += [(path, name, first, last) for first, last in _spans(path, span_members)]
                except Exception:  # the reader of the span meets the same error and reports it
                    rows.append((path, name, 1, 0))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32()))],
                                  names=["path", "source_file", "first", "last"])

    return located(archives).select("path", "source_file").mapInArrow(cut, SPANS)


def _unzipped(file: pa.NativeFile | io.IOBase) -> io.IOBase:
    """The plain bytes behind a gzip file: at once where it is whole and they are few, else as a stream."""
    if isinstance(file, io.BytesIO):
        unpack = zlib.decompressobj(31)
        try:
            plain = unpack.decompress(file.getbuffer(), _CHUNK)
        except zlib.error:
            plain = None  # the stream meets the same error where it comes
        if plain is not None and unpack.eof and not unpack.unused_data:
            return io.BytesIO(plain)
    return gzip.GzipFile(fileobj=file)


def _members(file: pa.NativeFile | io.IOBase, first: int, last: int) -> Iterator[tuple[int, str, io.TextIOWrapper]]:
    """Number, name and text of the CSV members of a span, byte-order mark removed."""
    def text(stream) -> io.TextIOWrapper:
        return io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")

    lead = file.read(2)
    file.seek(0)
    if lead == b"PK":
        with zipfile.ZipFile(file) as box:
            entries = [e for e in box.infolist() if not e.is_dir() and _is_csv(e.filename)]
            for no in range(first, (last or len(entries)) + 1):
                yield no, entries[no - 1].filename, text(box.open(entries[no - 1]))
    elif lead == b"\x1f\x8b":
        no = 0
        with _unzipped(file) as plain, tarfile.open(fileobj=plain, mode="r:") as box:
            while entry := box.next():
                box.members.clear()  # else it keeps a record of every member
                if entry.isfile() and _is_csv(entry.name):
                    no += 1
                    yield no, entry.name, text(box.extractfile(entry))
    else:
        raise ValueError("neither a zip nor a gzipped tar archive")


_ZIP_END, _ZIP_ENTRY = struct.Struct("<4s4H2LH"), struct.Struct("<4s6H3L5H2L")


def _zip_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Names and plain bytes of the CSV members of a zip archive in its plainest form; anything else is an error."""
    sign, disk, start, here, entries, length, place, comment = _ZIP_END.unpack_from(data, len(data) - _ZIP_END.size)
    if sign != b"PK\5\6" or disk or start or here != entries or comment or place + length != len(data) - _ZIP_END.size:
        raise ValueError
    room = _CHUNK
    for _ in range(entries):
        sign, _, needed, flags, method, _, _, crc, packed, size, named, extra, noted, _, _, _, at = _ZIP_ENTRY.unpack_from(data, place)
        name = data[place + _ZIP_ENTRY.size:][:named]
        place += _ZIP_ENTRY.size + named
        room -= size
        same = data[at:at + 4] == b"PK\3\4" and data[at + 6:at + 10] == struct.pack("<2H", flags, method) and data[at + 26:at + 30 + named] == struct.pack("<2H", named, 0) + name
        if sign != b"PK\1\2" or needed > 20 or flags or method not in (0, 8) or extra or noted or room < 0 or not same or b"\0" in name:
            raise ValueError
        if not _is_csv(name := name.decode("ascii")):
            continue
        plain = data[at + 30 + named:][:packed]
        if method:
            unpack = zlib.decompressobj(-15)
            plain = unpack.decompress(plain, size + 1)
            if not unpack.eof or unpack.unused_data:
                raise ValueError
        if len(plain) != size or zlib.crc32(plain) != crc:
            raise ValueError
        yield name, plain


@functools.lru_cache(maxsize=4096)
def _tar_entry(block: bytes) -> tuple[str, int]:
    """Name and size of a plain file by its header; anything else is an error."""
    name, size, sums = block[:100].rstrip(b"\0"), block[124:136], block[148:156]
    if sum(block) - sum(sums) + 256 != int(sums.rstrip(b"\0 "), 8) or block[156:157] not in b"0\0" or block[345:500].strip(b"\0") or name[-1:] in b"/":
        raise ValueError
    if b"\0" in name or not size.rstrip(b"\0 ").isdigit():
        raise ValueError
    return name.decode("ascii"), int(size.rstrip(b"\0 "), 8)


def _tar_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Names and plain bytes of the CSV members of a gzipped tar archive in its plainest form; anything else is an error."""
    unpack = zlib.decompressobj(31)
    plain, place = unpack.decompress(data, _CHUNK), 0
    if not unpack.eof or unpack.unused_data:
        raise ValueError
    while (block := plain[place:place + 512]) != bytes(512):
        name, size = _tar_entry(block)
        place += 512
        if place + size > len(plain):
            raise ValueError
        if _is_csv(name):
            yield name, plain[place:place + size]
        place += -(-size // 512) * 512


def _few_members(data: bytes) -> list[tuple[str, list, list]] | None:
    """Name, header and records of each CSV member of a small archive that is whole and has no feature out of the ordinary.

    Of any other there is None: the readers that know all forms then tell how far it can be read.
    """
    try:
        found = []
        for name, content in (_zip_members if data[:2] == b"PK" else _tar_members)(data):
            reader = csv.reader(io.StringIO(content.decode("utf-8-sig"), newline=""))
            header = next(reader, [])
            found.append((name, header, list(filter(None, reader))))
        return found
    except Exception:
        return None


def _number(text: str | None) -> float | None:
    try:
        return float(text)
    except (TypeError, ValueError):
        return None


def _numbers(texts: tuple) -> list[float | None]:
    try:
        return list(map(float, texts))
    except (TypeError, ValueError):
        return list(map(_number, texts))


def _picker(places: list[int]) -> Callable[[list], tuple]:
    if len(places) < 2:
        return lambda record: tuple(record[p] for p in places)
    return operator.itemgetter(*places)


@functools.lru_cache(maxsize=256)
def _header(header: tuple[str, ...]) -> tuple:
    """Of a header: names, layout, places of the dimensions and of the counters, and what is wrong with it."""
    # Names are compared trimmed and upper-cased; of equal ones the last column counts.
    place = {h.strip().upper(): i for i, h in enumerate(header) if h}
    names = list(place)
    layout = int.from_bytes(hashlib.sha256("\0".join(names).encode()).digest()[:8], signed=True)
    # A column that is missing is read from the place behind the last, which is empty.
    dims = [place.get(name, -1) for name in (TIME_COLUMN, *KEPT_DIMENSIONS)]
    cells = [i for name, i in place.items() if re.match(_COUNTER, name)]
    return names, layout, dims, cells, None if TIME_COLUMN in place else f"Missing required columns: {TIME_COLUMN}"


class _Rows:
    """Columns of the rows waiting to be sent; records of many small archives share a batch."""

    def __init__(self) -> None:
        self.head: list[tuple] = []
        self.offsets, self.values = [0], []
        # Records of members added whole, column by column.
        self.columns: list[list] = [[] for _ in _HEAD]
        self.lengths, self.cells = [], []
        # What is added belongs to an archive of this name.
        self.named: tuple = (None,) * len(_NAMED)
        self.names: list[list] = [[] for _ in _NAMED]
        self.head_names: list[tuple] = []

    def add(self, head: tuple, values: list | tuple = ()) -> None:
        self.head.append(head)
        self.head_names.append(self.named)
        self.values += values
        self.offsets.append(len(self.values))

    def add_member(self, source: tuple[str, str], member: str, member_no: int, header: list, records: list[list]) -> None:
        """The marker and all records of a member."""
        names, layout, dims, cells, problem = _header(tuple(header))
        self.mark(source, member, member_no, layout, names)
        count, width = len(records), len(header)
        if not count:
            return
        for record in records:
            if len(record) < width:
                record += [None] * (width - len(record))
        read = list(zip(*records))
        missing = [None] * count
        same = [[value] * count for value in (*source, member, member_no)]
        rest = [read[p] if p >= 0 else missing for p in dims]
        for column, more in zip(self.columns, (*same, range(1, count + 1), [layout] * count, missing, *rest, [problem] * count)):
            column += more
        for column, value in zip(self.names, self.named):
            column += [value] * count
        self.cells += itertools.chain.from_iterable(zip(*(_numbers(read[p]) for p in cells)))
        self.lengths += [len(cells)] * count

    def mark(self, source: tuple[str, str], member: str | None, member_no: int, layout: int | None = None, names: list | None = None,
             problem: str | None = None) -> None:
        self.add((*source, member, member_no, 0, layout, names, *[None] * (1 + len(_DIMENSIONS)), problem))

    @property
    def full(self) -> bool:
        return len(self.values) + len(self.cells) >= _BATCH_CELLS or len(self) >= _BATCH_ROWS

    def __len__(self) -> int:
        return len(self.head) + len(self.lengths)

    def take(self) -> pa.RecordBatch:
        for column, more in zip(self.columns, zip(*self.head)):
            column += more
        for column, more in zip(self.names, zip(*self.head_names)):
            column += more
        columns = [pa.array(c, _KINDS.get(name, pa.string())) for name, c in zip(_HEAD, self.columns)]
        named = [pa.array(c, kind) for kind, c in zip(_NAMED.values(), self.names)]
        offsets = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
        offsets = np.concatenate([offsets, offsets[-1] + np.asarray(self.offsets[1:], dtype=np.int64)])
        counters = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(self.cells + self.values, pa.float64()))
        held = self.named
        self.__init__()
        self.named = held
        return pa.record_batch([*columns, counters, *named], names=[*_HEAD, "counters", *_NAMED])


def _read_span(source: tuple[str, str], first: int, last: int, rows: _Rows,
               held: dict[str, pa.NativeFile] | None = None) -> Iterator[pa.RecordBatch]:
    member, member_no = None, first - 1
    try:
        data = _small(source[0], {} if held is None else held) if (first, last) == (1, 0) else None
        found = None if data is None else _few_members(data)
        if found is not None:
            for member_no, (member, header, records) in enumerate(found, start=1):
                rows.add_member(source, member, member_no, header, records)
            if rows.full:
                yield rows.take()
            return
        with opened(source[0]) as file:
            for member_no, member, text in _members(file, first, last):
                reader = csv.reader(text)
                try:
                    header = next(reader, [])
                except Exception:
                    rows.mark(source, member, member_no)
                    raise
                names, layout, dims, cells, problem = _header(tuple(header))
                dims, cells = _picker(dims), _picker(cells)
                rows.mark(source, member, member_no, layout, names)
                width = len(header)
                for row_no, record in enumerate(filter(None, reader), start=1):
                    record += [None] * (width + 1 - len(record)) if len(record) <= width else [None]
                    rows.add((*source, member, member_no, row_no, layout, None, *dims(record), problem), list(map(_number, cells(record))))
                    if rows.full:
                        yield rows.take()
    except Exception as error:  # an unreadable archive fails as a file, not as a job
        rows.mark(source, member, member_no + 1, problem=str(error) or type(error).__name__)


def expand_archives(archives: DataFrame, span_members: int = SPAN_MEMBERS) -> DataFrame:
    """Archives (path, source_file) to one row per CSV record; the files are read by path.

    A file is known by its path from here on; files of equal name in different folders are different files.

    Row number 0 marks a member (also one without records) and holds its column names or, with ``problem`` set, the
    point where the archive could not be read. Counter text is a number, or NULL where blank or unreadable.
    """
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = _Rows(), {}
        for batch in batches:
            for path, name, first, last, *named in zip(*(column.to_pylist() for column in batch.columns)):
                rows.named = tuple(named)
                yield from _read_span((path, name), first, last, rows, held)
        if len(rows):
            yield rows.take()

    # Rows are few and small, what they stand for is not: they are dealt out evenly, by number and not by size.
    # A task takes those of a container file one after the other, so it opens each container once.
    tasks = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = archive_spans(archives, span_members).repartition(tasks).sortWithinPartitions("path", "first")
    return with_archive_fields(spans, "source_file").select(*spans.columns, *_NAMED).mapInArrow(expand, EXPANDED)


# --- duplicates -----------------------------------------------------------------------------

def skip_duplicate_files(archives: DataFrame, audit: DataFrame) -> DataFrame:
    """Archives with ``duplicate_of`` set where the bytes were loaded before or come earlier in this batch.

    'audit' stands for a hash already loaded, otherwise the name of the batch file with the same bytes, whose path
    is ``duplicate_path``. The first path of a group stays, whatever the names. Content is not needed and best left out.
    """
    archives = located(archives)
    loaded = audit.where("status = 'SUCCESS' and file_hash is not null").select("file_hash").distinct()
    loaded = loaded.withColumn("_loaded", F.lit("audit"))
    first = archives.groupBy("file_hash").agg(F.min(F.struct("path", "source_file")).alias("_first"))
    marked = archives.join(first, "file_hash").join(loaded, "file_hash", "left")
    again = F.when(F.col("path") != F.col("_first.path"), F.col("_first"))
    fresh = F.col("_loaded").isNull()
    return marked.select(*archives.columns, F.coalesce("_loaded", again["source_file"]).alias("duplicate_of"),
                         F.when(fresh, again["path"]).alias("duplicate_path"))


# --- rows -----------------------------------------------------------------------------------

def parse_pm_rows(expanded: DataFrame) -> DataFrame:
    """Collect time, dimensions and counters per CSV record; ``problem`` where the record or archive is bad.

    Member markers stay, as they carry the number of CSV members and their column names.
    """
    text = F.col(TIME_COLUMN.lower())
    time, collect_time = F.col("_time"), F.col("collect_time")
    problem = F.when(text.isNull(), F.lit("COLLECTTIME has no value")).when(
        collect_time.isNull(), F.concat(F.lit("time data '"), time, F.lit("' does not match format '%Y%m%d%H%M%S'")))
    # Step by step, so that each is computed once.
    timed = expanded.withColumn("_time", strip_space(text)).withColumn("collect_time", F.when(F.length(time) == 14, stamp(time)))
    named = [c for c in _NAMED if c in expanded.columns]
    return timed.select(
        "path", "source_file", "csv_name", "member_no", "row_no", "collect_time",
        *[blank_to_null(name).alias(name) for name in _DIMENSIONS], "counters", "layout", "names",
        F.coalesce("problem", F.when(F.col("row_no") > 0, problem)).alias("problem"), *named)


def layouts(parsed: DataFrame) -> DataFrame:
    """(layout, counter_ids): the counters of each different header, read from the member markers alone."""
    marked = parsed.where("row_no = 0 and layout is not null").select(
        "layout", F.filter("names", lambda name: name.rlike(_COUNTER)).alias("counter_ids"))
    return marked.dropDuplicates(["layout"])


def failed_files(parsed: DataFrame) -> DataFrame:
    """First bad record of every file that has one. Any bad record fails the whole file."""
    place = F.struct("member_no", "row_no")
    return parsed.where("problem is not null").groupBy("path", "source_file").agg(
        F.min(place).alias("failed_at"), F.min_by("problem", place).alias("error_message"))


def good_rows(parsed: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Records of files without a bad record.

    ``failed`` is the result of ``failed_files`` where the caller has stored it. Spark
    then knows how small it is and need not shuffle the records to leave them out.
    """
    failed = failed_files(parsed) if failed is None else failed
    return parsed.where("row_no > 0").join(failed.select("path"), "path", "left_anti")


def unpivot_counters(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """One fact row per counter cell of ``rows``, named by ``headers`` (from ``layouts``).

    A blank or unreadable value is NULL and still a row. Where the caller has stored ``headers``, Spark knows how
    small it is and broadcasts it by its size.
    """
    named = rows.join(headers, "layout")
    if not set(_NAMED) <= set(rows.columns):
        named = with_archive_fields(named, "source_file")
    cells = named.select("*", F.posexplode("counters").alias("_place", "counter_value"))
    return cells.withColumn("counter_id", F.get("counter_ids", F.col("_place"))).select(*FACT_COLUMNS)


def unknown_columns(parsed: DataFrame) -> DataFrame:
    """Per file the columns that are neither a known dimension nor a counter, of members that have records.

    Read from the member markers; of the records only their numbers per member are needed.
    """
    extra = F.array_except("names", F.array(*[F.lit(c) for c in KNOWN_COLUMNS]))
    unknown = F.filter(extra, lambda name: ~name.rlike(_COUNTER))
    markers = parsed.where("row_no = 0 and names is not null").select("path", "source_file", "member_no", unknown.alias("unknown"))
    filled = parsed.where("row_no > 0").groupBy("path", "member_no").agg(F.count("*").alias("records"))
    names = markers.where(F.size("unknown") > 0).join(filled, ["path", "member_no"], "left_semi").select(
        "path", "source_file", F.explode("unknown").alias("name")).distinct()
    return names.groupBy("path", "source_file").agg(F.array_sort(F.collect_list("name")).alias("unknown_columns"))


def ingest_summary(archives: DataFrame, parsed: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row per archive (with duplicate_of and duplicate_path from S10), by path.

    A failed file counts what came before its first bad record and inserts nothing;
    a copy of a failed file has failed as well; other duplicates count nothing.
    """
    bad = failed_files(parsed) if failed is None else failed
    seen = parsed.join(bad.select("path", "failed_at"), "path", "left")
    place = F.struct("member_no", "row_no")
    seen = seen.where(F.col("failed_at").isNull() | (place <= F.col("failed_at")))
    is_row, used = F.col("row_no") > 0, (F.col("row_no") > 0) & F.col("problem").isNull()
    empty = F.size("counters") - F.size(F.array_compact("counters"))
    stats = seen.groupBy("path").agg(
        F.count_if((F.col("row_no") == 0) & F.col("problem").isNull()).alias("csv_files_found"),
        F.count_if(is_row).alias("input_rows_read"),
        F.sum(F.when(used, F.size("counters"))).alias("normalized_rows_emitted"),
        F.sum(F.when(used, empty)).alias("null_counter_values"))
    names = unknown_columns(seen.where("problem is null"))
    joined = (
        archives.select("path", "source_file", "file_hash", "duplicate_of", "duplicate_path").join(stats, "path", "left")
        .join(names.drop("source_file"), "path", "left").join(bad.drop("source_file"), "path", "left")
        .join(bad.select(F.col("path").alias("duplicate_path"), F.col("error_message").alias("_same_error")),
              "duplicate_path", "left"))
    error = F.coalesce("error_message", "_same_error")
    status = F.when(error.isNotNull(), "FAILED").when(F.col("duplicate_of").isNotNull(), "SKIPPED_DUPLICATE").otherwise("SUCCESS")
    emitted = F.coalesce("normalized_rows_emitted", F.lit(0))
    return joined.select(
        "path", "source_file", "file_hash", status.alias("status"),
        F.coalesce("csv_files_found", F.lit(0)).alias("csv_files_found"),
        F.coalesce("input_rows_read", F.lit(0)).alias("input_rows_read"),
        emitted.alias("normalized_rows_emitted"), F.when(status == "SUCCESS", emitted).otherwise(0).alias("rows_inserted"),
        F.coalesce("null_counter_values", F.lit(0)).alias("null_counter_values"),
        F.coalesce("unknown_columns", F.array().cast("array<string>")).alias("unknown_columns"),
        error.alias("error_message"))
