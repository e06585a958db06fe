"""Named tables handed to every operator."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


class Tables(dict):
    """Mapping from table name to DataFrame with attribute access.

    Operators take one ``Tables`` and return one DataFrame; they run no action.
    ``tables.updated(name=df)`` gives a copy, so an upsert never changes the
    tables another operator is reading.
    """

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(f"table {name!r} was not provided") from None

    def updated(self, **frames: DataFrame) -> "Tables":
        return Tables(self.without_stale(frames))

    def without_stale(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """``frames`` over these tables. Records describe the facts they came with, so new facts do away with them."""
        kept = {**self, **frames}
        if "pm_sample" in frames and "pm_records" not in frames:
            kept.pop("pm_records", None)
        return kept

    @classmethod
    def from_directory(cls, spark: SparkSession, directory: str, names: list[str]) -> "Tables":
        return cls({name: spark.read.parquet(f"{directory}/{name}") for name in names})


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet folder by its schema; a folder that is not there yet has no rows."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the session names none (single-machine tests) one is made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    import tempfile

    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", made)
    return made
