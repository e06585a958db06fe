"""Token counts as delta-maintained rollups.

Documents change by inserts, deletes and revised counts. A batch of changes is turned into signed ledger entries: a
delete retracts the live entry of a document, a revision retracts it and adds the new one. Totals by source,
language and tokenizer version are sums of signed entries, so a batch only adds its own small delta; nothing is
rebuilt. A batch is committed once: everything it writes lies below its id, and the commit marker is written last.
A batch that was lost midway is written again from its start; one that is committed is left alone.

Entries are kept by batch. To find the live entries of the documents it changes, a batch sums the ledger of all batches
before it, so it costs as much as that history; ``compacted`` folds old batches into one. Batches are applied one after
the other: two that change one document at the same time would both retract its entry.

Defined results: null text has 0 tokens; null source, language and doc_id are values of their own; several changes of
one document in a batch count in order of ``seq``, the last wins; a delete of an unknown document and a repeated
insert of an equal one change nothing; an empty batch commits an empty delta; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radiokpi.llm.common import WORD, documents, staged, text_of
from radiokpi.tables import shared_folder

ENTRY = ("doc_id", "source", "lang", "tokenizer", "tokens")
KEYS = ("source", "lang", "tokenizer")
LEDGER = "doc_id long, source string, lang string, tokenizer string, tokens long, sign int, batch string"
DELTA = "source string, lang string, tokenizer string, documents long, tokens long, batch string"
# Tokenizer versions that Spark counts itself.
WORDS, PIECES = "words-1", "pieces-2"
TOKENIZERS: dict[str, Callable[[], Column]] = {
    WORDS: lambda: F.regexp_count(text_of(), F.lit(WORD)).cast("long"),
    PIECES: lambda: F.regexp_count(text_of(), F.lit(r"[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]")).cast("long"),
}


def changes(docs: DataFrame, op: str, tokenizer: str, seq: int = 0) -> DataFrame:
    """Change rows for ``docs``: op is "insert", "revise" or "delete"."""
    tokens = TOKENIZERS[tokenizer]() if op != "delete" else F.lit(0).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.lit(tokenizer).alias("tokenizer"),
                       tokens.alias("tokens"), F.lit(op).alias("op"), F.lit(seq).alias("seq"))


class TokenRollup:
    """A rollup stored below ``folder``, which all executors must reach."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        """The rows of committed batches only."""
        made = [f"{self.folder}/{part}/batch={b}" for b in self.batches()]
        if not made:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{part}").parquet(*made)

    def _path(self, name: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def batches(self) -> list[str]:
        """Ids of the committed batches (one marker file each)."""
        path, files = self._path("commits")
        return sorted(f.getPath().getName() for f in files.listStatus(path)) if files.exists(path) else []

    def live(self) -> DataFrame:
        """The entries that add up: one row per document that is in."""
        rows = self._read("ledger", LEDGER).groupBy(*ENTRY).agg(F.sum("sign").alias("n"))
        return rows.where("n > 0").select(*ENTRY)

    def apply(self, batch: str, change: DataFrame) -> bool:
        """Commits ``change`` as ``batch``; False if that batch is committed already."""
        marker, files = self._path(f"commits/{batch}")
        if files.exists(marker):
            return False
        # Of the changes of one document the last counts; ties in seq fall to the largest row.
        after = F.struct("seq", "op", *ENTRY[1:])
        last = change.groupBy("doc_id").agg(F.max(after).alias("c")).select("doc_id", "c.*")
        old = self.live().join(last.select(F.col("doc_id").alias("id")), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
        signed = old.withColumn("sign", F.lit(-1)).union(
            last.where("op <> 'delete'").select(*ENTRY, F.lit(1).alias("sign")))
        net = signed.groupBy(*ENTRY).agg(F.sum("sign").cast("int").alias("sign")).where("sign <> 0")
        net.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
        written = self.spark.read.schema(LEDGER.rpartition(",")[0]).parquet(f"{self.folder}/ledger/batch={batch}")
        delta = written.groupBy(*KEYS).agg(F.sum("sign").alias("documents"), F.sum(F.col("sign") * F.col("tokens")).alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={batch}")
        files.create(marker, True).close()
        return True

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, documents, tokens): sums of the deltas; groups without documents are left out."""
        rows = self._read("deltas", DELTA).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return rows.where("documents <> 0")

    def compacted(self, folder: str) -> "TokenRollup":
        """A rollup in ``folder`` whose first batch holds what all batches here add up to."""
        other = TokenRollup(self.spark, folder)
        rows = self.live()
        other.apply("compacted", rows.withColumns({"op": F.lit("insert"), "seq": F.lit(0)}))
        return other


def op9_token_rollup(spark: SparkSession, directory: str) -> DataFrame:
    """Three batches over all documents: everything comes in, exact copies go, what is left is counted anew.

    The second batch is sent twice, as a retry would.
    """
    docs = documents(spark, directory)
    rollup = TokenRollup(spark, f"{shared_folder(spark)}/rollup/{uuid.uuid4().hex}")
    rollup.apply("0001", changes(docs, "insert", WORDS))
    digest = docs.withColumn("h", F.sha2(text_of(), 256))
    copies = digest.join(digest.groupBy("h").agg(F.min("doc_id").alias("first")), "h").where("doc_id > first")
    for _ in range(2):
        rollup.apply("0002", changes(copies, "delete", WORDS))
    # Counts are stored before they meet the ids that are left: texts are not shuffled for it.
    counted = staged(changes(docs, "revise", PIECES), "counted")
    kept = rollup.live().select(F.col("doc_id").alias("kept"))
    rollup.apply("0003", counted.join(kept, F.col("doc_id").eqNullSafe(F.col("kept")), "left_semi"))
    return rollup.totals()


SQL = {"op9_token_rollup": r"""
with kept as (select * from documents qualify row_number() over (partition by ifnull(text, '') order by doc_id) = 1)
select source, lang, 'pieces-2' as tokenizer, count(*) as documents,
  cast(sum(len(regexp_extract_all(ifnull(text, ''), '[A-Za-z]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D]'))) as bigint) as tokens
from kept group by source, lang"""}

QUERIES = {"op9_token_rollup": op9_token_rollup}
