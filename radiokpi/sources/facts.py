"""Fact table on storage (S9) and the batch job that fills it."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from radiokpi.functions import logical_entity_key
from radiokpi.operators.activity import counter_activity, entity_activity
from radiokpi.operators.entities import entity_shapes, keyed_facts, sync_entities
from radiokpi.operators.records import records, unpivoted
from radiokpi.operators.topology import entity_places
from radiokpi.schemas import FACT_COLUMNS
from radiokpi.sources.archives import (
    expand_archives, failed_files, good_rows, ingest_summary, layouts, located, parse_pm_rows, skip_duplicate_files, unpivot_counters,
)
from radiokpi.sources.manifest import with_archive_fields
from radiokpi.tables import Tables, stored

AUDIT_SCHEMA = """
    source_file string, file_hash string, run_id string, trigger_type string, source_type string,
    processed_at timestamp_ntz, status string, csv_files_found bigint, input_rows_read bigint,
    normalized_rows_emitted bigint, rows_inserted bigint, unknown_columns array<string>, null_counter_values bigint,
    lifecycle_status string, lifecycle_action string, normalization_status string, normalized_at timestamp_ntz,
    normalization_error string, final_file_path string, error_message string
"""


FACT_SCHEMA = """
    source_file string, dataset_family string, interval_start timestamp_ntz, revision int, csv_name string,
    collect_time timestamp_ntz, trncmeid string, ani string, sbnid string, enbid string, enodebid string, cellid string,
    meid string, systemmode string, midflag string, netype string, counter_id string, counter_value double,
    load string, collect_date date
"""
ACTIVITY = {
    "entity_activity": """dataset_family string, logical_entity_key string, interval_start timestamp_ntz,
        collect_time timestamp_ntz, source_file string, revision int, row_count bigint, value_count bigint, load string""",
    "counter_activity": """dataset_family string, interval_start timestamp_ntz, collect_time timestamp_ntz,
        source_file string, counter_id string, row_count bigint, value_count bigint, load string""",
}
# Records whose facts one task sorts: of a few hundred bytes each in memory, twelve a record, a share of an executor.
RECORDS_PER_FILE = 200_000
FACTS_PER_FILE = 12 * RECORDS_PER_FILE
SHAPES = """dataset_family string, sbnid string, enbid string, enodebid string, cellid string, meid string, ani string,
    row_count bigint, load string"""


def write_facts(facts: DataFrame, path: str, *, load_id: int | str) -> None:
    """Write one load below ``path/load=<id>``, partitioned by family and day.

    The rebalance hint lets AQE cut a family-day that holds most rows into several
    files and merge the small ones; sorting by counter inside a file gives row groups
    narrow counter ranges to skip. A load replaces only itself, so a rerun is safe.
    """
    dated = facts.withColumn("collect_date", F.to_date("collect_time"))
    spread = dated.hint("rebalance", "dataset_family", "collect_date")
    spread.sortWithinPartitions("dataset_family", "collect_date", "counter_id", "collect_time").write.mode(
        "overwrite").partitionBy("dataset_family", "collect_date").parquet(f"{path}/load={load_id}")


def write_records(tables: Tables, path: str, *, load_id: int | str) -> None:
    """S9 of facts held as records: the same table, of which no fact is moved.

    Records go to ranges of family, day and time, each of about ``RECORDS_PER_FILE``, whose facts one task sorts in memory.
    """
    wide, counters = records(tables)
    dated = wide.drop("logical_entity_key").withColumn("collect_date", F.to_date("collect_time"))
    count, cores = wide.count(), wide.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-count // RECORDS_PER_FILE), min(cores, count // 25_000))
    spread = dated.repartitionByRange(ranges, "dataset_family", "collect_date", "collect_time", F.xxhash64("source_file", "csv_name", "ani"))
    unpivoted(spread, counters).sortWithinPartitions("dataset_family", "collect_date", "counter_id", "collect_time").write.mode(
        "overwrite").partitionBy("dataset_family", "collect_date").parquet(f"{path}/load={load_id}")


def write_parsed(rows: DataFrame, headers: DataFrame, path: str, *, load_id: int | str) -> None:
    """S9 of parsed records (``good_rows``) and their ``layouts``: the same table, of which no fact is moved.

    Records go to ranges as those of ``write_records`` do, which follow the number of their facts.
    """
    count, cores = rows.agg(F.sum(F.size("counters"))).first()[0] or 0, rows.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-count // FACTS_PER_FILE), min(cores, count // 300_000))
    named = rows if "interval_start" in rows.columns else with_archive_fields(rows, "source_file").drop("filename", "extension")
    spread = named.drop("path", "member_no", "row_no", "names", "problem").repartitionByRange(
        ranges, "dataset_family", F.to_date("collect_time"), "collect_time", F.xxhash64("source_file", "csv_name", "ani"))
    facts = unpivot_counters(spread, headers).withColumn("collect_date", F.to_date("collect_time"))
    facts.sortWithinPartitions("dataset_family", "collect_date", "counter_id", "collect_time").write.mode("overwrite").option(
        "compression", "zstd").partitionBy("dataset_family", "collect_date").parquet(f"{path}/load={load_id}")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Fact table; ``collect_date`` stays beside the fact columns for partition pruning."""
    return stored(spark, path, FACT_SCHEMA).select(*FACT_COLUMNS, "collect_date")


def read_load(spark: SparkSession, root: str, load_id: int | str) -> DataFrame:
    """Facts of one load below ``root``/facts."""
    return stored(spark, f"{root}/facts/load={load_id}", FACT_SCHEMA).drop("load")


def read_loaded_facts(spark: SparkSession, root: str) -> DataFrame:
    """Facts of the loads that the audit below ``root`` names; those of a load that broke off before it are left out."""
    runs = read_audit(spark, f"{root}/audit").select(F.col("run_id").substr(F.lit(6), F.lit(1000)).alias("load")).distinct()
    return stored(spark, f"{root}/facts", FACT_SCHEMA).join(runs, "load", "left_semi").select(*FACT_COLUMNS, "collect_date")


def store_activity(tables: Tables, root: str, *, load_id: int | str = 0) -> Tables:
    """Write the aggregates of one load's facts and hand back ``Tables`` whose reports read all loads.

    The aggregates add up across loads, so a load writes its own share below ``load=<id>`` and never
    rebuilds or overwrites another's. Stored aggregates in ``tables`` are not read, only its facts.
    """
    facts = Tables(pm_sample=tables.pm_sample)
    if records(tables) is not None:
        facts["pm_records"] = tables["pm_records"]
    for name, build in {"entity_activity": entity_activity, "counter_activity": counter_activity, "entity_shapes": entity_shapes}.items():
        build(facts).write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/{name}/load={load_id}")
    return tables.updated(**read_activity(tables.pm_sample.sparkSession, root))


def read_activity(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Both activity aggregates of all loads below ``root``, one row per load and key.

    Reports sum counts and count distinct values, so they take the rows of several loads as they are: each report
    aggregates once, and nothing is brought together before it.
    """
    return {name: stored(spark, f"{root}/{name}", schema).drop("load") for name, schema in ACTIVITY.items()}


def sync_new_loads(spark: SparkSession, root: str, identity: DataFrame, *, after: str | None, folder: str) -> DataFrame:
    """A9 for the loads that the syncs up to ``after`` have not seen: writes the identity table to ``folder`` and reads it back.

    Beside it goes the list of the loads it holds, so a sync knows by the folder of the one before what is new. Only
    the shapes of new loads are read; the loads are folders, and their ids a filter on these.
    """
    runs = read_audit(spark, f"{root}/audit").select(F.col("run_id").substr(F.lit(6), F.lit(1000)).alias("load")).distinct()
    known = stored(spark, f"{after}/synced", "load string") if after else spark.createDataFrame([], "load string")
    new = [r[0] for r in runs.join(known, "load", "left_anti").collect()]  # one small row a load since the last sync
    shapes = stored(spark, f"{root}/entity_shapes", SHAPES).where(F.col("load").isin(new))
    tables = Tables(entity_identity=identity, entity_shapes=shapes)
    sync_entities(tables, new_only=True).write.mode("overwrite").parquet(f"{folder}/entity_identity")
    runs.union(known).distinct().write.mode("overwrite").parquet(f"{folder}/synced")
    return spark.read.parquet(f"{folder}/entity_identity")


def store_by_entity(tables: Tables, root: str, *, buckets: int) -> Tables:
    """Write the facts, keyed, and the entity dimension in equal buckets of the entity key, and hand them back in ``Tables``.

    Joins on the key and aggregates by it then find their rows in place: no query moves the facts for them. A bucket is
    one file; ``buckets`` is chosen so that one fits a task. Of facts held as records the records are stored, and no fact
    is moved or written.
    """
    key = "logical_entity_key"
    held = {"pm_sample": keyed_facts(tables)} if records(tables) is None else {"pm_records": tables["pm_records"]}
    for name, frame in {**held, "entity_places": entity_places(tables)}.items():
        own = f"{name}_{uuid.uuid4().hex}"
        # A key that follows from the dimensions is made where its row arrives, so it is not moved.
        made = {} if key in frame.columns else {key: logical_entity_key()}
        dealt = frame.repartition(buckets, made.get(key, F.col(key))).withColumns(made)
        dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{name}").option("compression", "zstd").saveAsTable(own)
        frame.sparkSession.sql(f"DROP TABLE {own}")  # of the catalog; the files stay
    return tables.updated(**read_by_entity(tables.pm_sample.sparkSession, root, buckets=buckets))


def read_by_entity(spark: SparkSession, root: str, *, buckets: int) -> dict[str, DataFrame]:
    """The tables of ``store_by_entity``, in a session that need not be the one that wrote them."""
    found = {}
    for name in ("pm_sample", "pm_records", "entity_places"):
        try:
            schema = spark.read.parquet(f"{root}/{name}").schema
        except AnalysisException as error:
            if name == "entity_places" or "PATH_NOT_FOUND" not in str(error):
                raise
            continue  # facts are stored as facts or as records
        own = f"{name}_{uuid.uuid4().hex}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(f"CREATE TABLE {own} ({columns}) USING parquet CLUSTERED BY (logical_entity_key) SORTED BY (logical_entity_key) "
                  f"INTO {int(buckets)} BUCKETS LOCATION '{root}/{name}'")
        found[name] = spark.table(own)
    if "pm_records" in found:
        found["pm_sample"] = unpivoted(*records(Tables(pm_records=found["pm_records"])))
    return found


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(AUDIT_SCHEMA).option("recursiveFileLookup", "true").parquet(path)
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], AUDIT_SCHEMA)


def ingest_batch(archives: DataFrame, root: str, *, load_id: int | str, processed_at: datetime, trigger_type: str = "batch",
                 source_type: str = "local") -> None:
    """S4–S10 and G11 for one batch of archives (path, source_file, file_hash), read by path.

    Parsed records are written once to a staging table below ``root``; facts and
    audit both read that, so nothing is unpacked twice and a lost executor repeats
    single tasks only. Files with a bad record never reach the fact table. Facts are
    written before the audit that says they are loaded, and both under the load id.
    What was staged is given up once the audit is there.
    """
    spark = archives.sparkSession
    staging = f"{root}/staging/load={load_id}"
    # Hashes already loaded by other loads; this load's own audit must not count when it is rerun.
    audit = read_audit(spark, f"{root}/audit").where(F.col("run_id") != f"load-{load_id}")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").option("compression", "zstd").parquet(f"{staging}/{name}")
        return spark.read.parquet(f"{staging}/{name}")

    # Hashes are taken once; duplicates are decided on the list of files.
    listing = kept(located(archives).select("path", "source_file", "file_hash"), "listing")
    files = kept(skip_duplicate_files(listing, audit), "files")
    parsed = kept(parse_pm_rows(expand_archives(files.where("duplicate_of is null"))), "records")
    failed, headers = kept(failed_files(parsed), "failed"), kept(layouts(parsed), "layouts")

    write_parsed(good_rows(parsed, failed), headers, f"{root}/facts", load_id=load_id)
    store_activity(Tables(pm_sample=read_load(spark, root, load_id)), root, load_id=load_id)
    summary = ingest_summary(files, parsed, failed).select(
        "*", F.col("path").alias("final_file_path"), F.lit(f"load-{load_id}").alias("run_id"), F.lit(trigger_type).alias("trigger_type"),
        F.lit(source_type).alias("source_type"), F.lit(processed_at).cast("timestamp_ntz").alias("processed_at"),
        F.lit("COMPLETED").alias("lifecycle_status"), F.lit("PENDING").alias("normalization_status"))
    empty = spark.createDataFrame([], AUDIT_SCHEMA)
    empty.unionByName(summary.drop("path"), allowMissingColumns=True).write.mode("overwrite").option("compression", "zstd").parquet(
        f"{root}/audit/load={load_id}")
    for name in ("listing", "files", "records", "failed", "layouts"):
        spark.range(0).write.mode("overwrite").parquet(f"{staging}/{name}")  # an empty table, by Spark as all that lies there
