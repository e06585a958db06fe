"""Archive names, listings and discovery rules."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from datetime import date, datetime, time, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radiokpi.functions import first_per, stamp
from radiokpi.schemas import ARCHIVE_PREFIXES, FAMILIES, INTERVAL_MINUTES, REVISION_POLICIES
from radiokpi.tables import shared_folder, stored

# Archive file name pattern.
NAME = r"(?i)^(UMEID(?:_ITBBU)?(?:_ITBBUPLAT|_LTEFDD)?_PM_COMMON_ZTE_)(\d{8})_(\d{4})(?:_R(\d+))?\.(tar\.gz|zip)$"


def with_archive_fields(frame: DataFrame, name: str = "path") -> DataFrame:
    """Add filename, dataset_family, interval_start, revision and extension read from an archive name.

    All but filename are NULL where the name is none, or its eight digits are no date.
    Each step binds the result of the one before as a lambda argument, so a filter
    pushed through these columns does not multiply the pattern match.
    """
    families = F.create_map(*[F.lit(x) for pair in ARCHIVE_PREFIXES.items() for x in pair])

    def bind(value: Column, build) -> Column:
        return F.get(F.transform(F.array(value), build), F.lit(0))

    def fields(parts: Column) -> Column:
        return F.struct(
            F.try_element_at(families, F.upper(F.get(parts, F.lit(0)))).alias("dataset_family"),
            stamp(F.get(parts, F.lit(1))).alias("interval_start"),
            F.coalesce(F.nullif(F.get(parts, F.lit(2)), F.lit("")).try_cast("int"), F.lit(0)).alias("revision"),
            F.lower(F.get(parts, F.lit(3))).alias("extension"))

    def known(read: Column) -> Column:
        return F.when(read["dataset_family"].isNotNull() & read["interval_start"].isNotNull(), read)

    file = F.when(F.contains(F.col(name), F.lit("/")), F.regexp_extract(name, r"([^/]+)/*$", 1)).otherwise(F.col(name))
    parts = F.split(F.regexp_replace(file, NAME, "$1|$2$3|$4|$5"), r"\|")
    read = bind(bind(parts, fields), known)
    return frame.select(*frame.columns, file.alias("filename"), read.alias("_archive")).select(
        *frame.columns, "filename", "_archive.dataset_family", "_archive.interval_start", "_archive.revision", "_archive.extension")


def archive_manifest(listing: DataFrame) -> DataFrame:
    """Listing (column path, others kept) with the parsed name. Names of no known family drop out."""
    return with_archive_fields(listing).where("dataset_family is not null")


def filter_time_range(frame: DataFrame, start: datetime | None = None, end: datetime | None = None,
                      column: str = "interval_start") -> DataFrame:
    """half-open range, either bound optional."""
    if start is not None:
        frame = frame.where(F.col(column) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        frame = frame.where(F.col(column) < F.lit(end).cast("timestamp_ntz"))
    return frame


def check_families(families: Sequence[str] | None) -> None:
    unknown = sorted(set(families or ()) - set(FAMILIES))
    if unknown:
        raise ValueError(f"unsupported dataset families: {', '.join(unknown)}")


def filter_families(frame: DataFrame, families: Sequence[str] | None) -> DataFrame:
    """F2."""
    check_families(families)
    return frame if families is None else frame.where(F.col("dataset_family").isin(*families))


def revision_policy(frame: DataFrame, policy: str) -> DataFrame:
    """additive keeps all, base-only revision 0, revisions-only the others, latest-only the highest per interval."""
    if policy not in REVISION_POLICIES:
        raise ValueError(f"unsupported revision policy: {policy}")
    if policy == "base-only":
        return frame.where("revision = 0")
    if policy == "revisions-only":
        return frame.where("revision > 0")
    if policy == "latest-only":
        order = [F.col("revision"), *([F.col("path")] if "path" in frame.columns else [])]
        return first_per(frame, ["dataset_family", "interval_start"], largest=order)
    return frame


def aligned_interval(column="interval_start") -> Column:
    """on a quarter of an hour exactly."""
    column = F.col(column) if isinstance(column, str) else column
    return (F.minute(column) % INTERVAL_MINUTES == 0) & (F.date_trunc("minute", column) == column)


def select_archives(listing: DataFrame, *, start: datetime | None = None, end: datetime | None = None,
                    families: Sequence[str] | None = None, policy: str = "additive") -> DataFrame:
    """S1, F2, F1 and F3 in a row over any listing."""
    parsed = filter_families(archive_manifest(listing), families)
    return revision_policy(filter_time_range(parsed, start, end), policy)


LISTING = "path string, remote_size_bytes bigint, remote_modified_at timestamp, root_family string"
_ENTRIES = "path string, remote_size_bytes bigint, remote_modified_at timestamp, folder boolean"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies in each folder, a folder at a time, in any store pyarrow knows. Names that begin with ``.`` or ``_`` are none."""
    schema = pa.schema([("path", pa.string()), ("remote_size_bytes", pa.int64()), ("remote_modified_at", pa.timestamp("us", "UTC")), ("folder", pa.bool_())])
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            store, inside = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
            found = [i for i in store.get_file_info(fs.FileSelector(inside)) if not i.base_name.startswith((".", "_"))]
            yield pa.record_batch([
                pa.array([f"{folder.rstrip('/')}/{i.base_name}" for i in found], pa.string()), pa.array([i.size for i in found], pa.int64()),
                pa.array([i.mtime for i in found], schema.field("remote_modified_at").type),
                pa.array([i.type == fs.FileType.Directory for i in found], pa.bool_())], schema=schema)


def listed(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """The files below each family root that are not empty, by their names alone: no file is opened.

    Folders are listed by tasks, one level of the tree at a time, each level a table in the shared folder. Nothing
    passes through the driver but whether a level holds folders.
    """
    state, listing = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}", spark.createDataFrame([], LISTING)
    for number, (family, root) in enumerate(roots.items()):
        folders, level = spark.createDataFrame([(root,)], "path string"), 0
        while level == 0 or not folders.isEmpty():
            path = f"{state}/{number}/level={level}"
            tasks = spark.sparkContext.defaultParallelism * 4 if level else 1
            folders.repartition(tasks).mapInArrow(_entries, _ENTRIES).write.parquet(path)
            folders, level = spark.read.schema(_ENTRIES).parquet(path).where("folder").select("path"), level + 1
        files = spark.read.schema(_ENTRIES).parquet(*[f"{state}/{number}/level={n}" for n in range(level)])
        listing = listing.unionByName(files.where("not folder and remote_size_bytes > 0").drop("folder").withColumn("root_family", F.lit(family)))
    return listing


def discover_files(spark: SparkSession, roots: dict[str, str], *, families: Sequence[str] | None = None,
                   start: datetime | None = None, end: datetime | None = None, policy: str = "additive") -> DataFrame:
    """Files below each family root whose name says that family. File contents are not read; empty files are none."""
    check_families(families)
    return discovered(listed(spark, {family: roots[family] for family in families or roots}), start=start, end=end, policy=policy)


def discover_new_files(spark: SparkSession, roots: dict[str, str], state: str, *, run_id: str, families: Sequence[str] | None = None,
                       start: datetime | None = None, end: datetime | None = None, policy: str = "additive") -> DataFrame:
    """S2 for files that no earlier run has taken.

    What a run finds is written below its id and stays there, so a scan is never lost between runs; a run made again with
    the same id adds what it had not taken yet. A run is new files only: the scan meets the paths of all runs in one
    anti join. Policies apply to the new files.
    """
    check_families(families)
    found = f"{state}/found"
    taken = stored(spark, found, LISTING).select("path")
    fresh = listed(spark, {family: roots[family] for family in families or roots}).join(taken, "path", "left_anti")
    # Spread by number, not by bytes: names are short, and reading them is what costs.
    fresh.repartition(4 * spark.sparkContext.defaultParallelism, "path").write.mode("append").parquet(f"{found}/run={run_id}")
    listing = stored(spark, f"{found}/run={run_id}", LISTING)
    return discovered(listing, start=start, end=end, policy=policy)


def discovered(listing: DataFrame, *, start: datetime | None = None, end: datetime | None = None,
               policy: str = "additive") -> DataFrame:
    """S2 on a listing that carries root_family."""
    own = archive_manifest(listing).where("dataset_family = root_family").drop("root_family")
    return revision_policy(filter_time_range(own, start, end), policy)


# --- F4: arguments to a time window ---------------------------------------------------------

_EXACT = ("%Y%m%d%H%M", "%Y%m%d_%H%M", "%Y-%m-%d %H:%M")


def _moment(text: str) -> tuple[datetime, bool]:
    for pattern in (*_EXACT, "%Y-%m-%d"):
        try:
            return datetime.strptime(text, pattern), pattern == "%Y-%m-%d"
        except ValueError:
            pass
    raise ValueError(f"Unsupported datetime format: {text}")


def time_window_args(start: str | None = None, end: str | None = None) -> tuple[datetime | None, datetime | None]:
    """command-line texts to a half-open window; an exact end covers its minute, a date its whole day."""
    lower = _moment(start)[0] if start is not None else None
    if end is None:
        return lower, None
    upper, whole_day = _moment(end)
    return lower, upper + (timedelta(days=1) if whole_day else timedelta(minutes=1))


def request_window(interval_start: datetime | None = None, start: date | datetime | None = None,
                   end: date | datetime | None = None) -> tuple[datetime | None, datetime | None]:
    """request values to a window; one interval is a quarter of an hour, an end date closes with its last microsecond."""
    if interval_start is not None:
        return interval_start, interval_start + timedelta(minutes=INTERVAL_MINUTES)

    def edge(value, at):
        return value if value is None or isinstance(value, datetime) else datetime.combine(value, at)

    return edge(start, time.min), edge(end, time.max)
