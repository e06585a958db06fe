"""I-Match document fingerprints (only DataFrame functions).

Terms inside a band of inverse document frequency form the lexicon. Randomised sub-lexicons (by bits of a term's
hash) are hashed one by one over a document's sorted distinct terms; the fingerprint is the list of these hashes, so
an edit disturbs some of them only. A long document is seen through thinner sub-lexicons, chosen so that each holds
one or two of its terms: level ``g`` keeps one term in 2^g for each sub-lexicon. Two adjacent levels are kept, and
likeness compares a common level: the share of sub-lexicons with equal hashes among those not empty in both.

The lexicon is joined, never broadcast, and only the terms that a document's sub-lexicons can hold are sent to it.

Defined results: null and empty texts have the fingerprint of no terms; a document none of whose candidate terms (those
that its sub-lexicons can hold) lie in the band is hashed over all its terms at once; equal texts have equal fingerprints; repeated rows and equal doc_ids are
ordered by a hash of their text, null doc_ids first; no rows give no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from radiokpi.llm.common import documents, staged, text_of

# Band of document frequency: at least this many documents and this share, at most that share.
LEAST_DOCUMENTS = 2
LEAST_SHARE = 1e-5
MOST_SHARE = 0.05
LEXICONS = 16
LOWEST = 4
# Rows of one ordering bucket, and the most buckets.
BUCKET = 500
MOST_BUCKETS = 4096
STEP = 64


def terms(text: Column) -> Column:
    """Distinct lower-cased runs of letters and digits."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))


def lexicon(docs: DataFrame, rows: int) -> DataFrame:
    """(h): hashes of the terms whose document frequency lies in the band."""
    each = docs.select(F.explode(terms(text_of())).alias("term")).where("term <> ''")
    least, most = max(LEAST_DOCUMENTS, rows * LEAST_SHARE), max(LEAST_DOCUMENTS, rows * MOST_SHARE)
    return each.select(F.xxhash64("term").alias("h")).groupBy("h").count().where(F.col("count").between(least, most)).select("h")


def _bucket(bounds: list[int]) -> Column:
    """Number of ``bounds`` below doc_id, in two short searches."""
    if not bounds:
        return F.lit(0)
    steps = bounds[STEP - 1::STEP]
    below = lambda x: x < F.col("doc_id")
    coarse = F.size(F.filter(F.lit(steps), below)) if steps else F.lit(0)
    return F.coalesce(coarse * STEP + F.size(F.filter(F.slice(F.lit(bounds), coarse * STEP + 1, F.lit(STEP)), below)), F.lit(0))


def with_next(docs: DataFrame) -> DataFrame:
    """(pos, doc_id, text, next_text): pos from 1 by doc_id; the last row is followed by the first.

    Rows are dealt to buckets of neighbouring doc_ids, whose bounds and counts (at most ``MOST_BUCKETS`` numbers) are
    all the driver sees. Each bucket also gets the first row of the bucket behind it, so one shuffle of the text does.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    total = rows.count()
    wanted = min(MOST_BUCKETS, total // BUCKET)
    cuts = [k / wanted for k in range(1, wanted)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, F.lit(100_000))).first()[0] if cuts else []
    rows = rows.withColumn("bucket", _bucket(sorted(set(bounds or []))))
    counts = {r[0]: (r[1], r[2]) for r in rows.groupBy("bucket").agg(F.count("*"), F.min("doc_id")).collect()}
    here = sorted(counts)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    offsets, at = {}, 0
    for b in here:
        offsets[b] = at
        at += counts[b][0]
    firsts = [counts[b][1] for b in here if b in counts and counts[b][1] is not None]
    heads = rows.where(F.col("doc_id").isin(firsts) | F.col("doc_id").isNull())
    heads = heads.withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy(*order))).where("n = 1")
    before = F.create_map(*[F.lit(x) for k, b in enumerate(here) for x in (b, here[k - 1])]) if here else F.lit(None)
    if here:
        heads = heads.withColumn("bucket", F.array_max(F.map_values(F.map_filter(before, lambda k, v: k == F.col("bucket")))))
    both = rows.withColumn("tail", F.lit(0)).union(heads.select("doc_id", "text", "bucket", F.lit(1).alias("tail")))
    inside = Window.partitionBy("bucket").orderBy("tail", *order)
    both = both.withColumns({"next_text": F.lead("text").over(inside), "n": F.row_number().over(inside)}).where("tail = 0")
    start = F.element_at(F.lit([offsets.get(b, 0) for b in range(max(here, default=0) + 1)]), F.col("bucket") + 1)
    return both.select((start + F.col("n")).cast("long").alias("pos"), "doc_id", "text", "next_text", F.lit(total).cast("long").alias("rows"))


def _level(n: Column) -> Column:
    """Level at which a sub-lexicon holds one or two of ``n`` terms."""
    return F.when(n > 2 << LOWEST, F.ceil(F.log2(n / 2))).otherwise(LOWEST).cast("int")


def _low(h: Column, bits: Column) -> Column:
    """The ``bits`` bits of a term's hash that say in which sub-lexicon it may be."""
    return F.pmod(F.shiftrightunsigned(h, 20), F.pow(F.lit(2.0), bits).cast("long"))


def _described(text: str, name: str) -> dict[str, Column]:
    """Level, candidate terms and the hash over all terms of one text column, in steps that Spark keeps apart."""
    return {f"{name}_terms": F.transform(F.filter(terms(F.col(text)), lambda t: t != ""), lambda t: F.xxhash64(t))}


def prints(docs: DataFrame) -> DataFrame:
    """One row per document: pos, doc_id, n_chars, edited_sha256, and for doc and edited a level and hash lists."""
    rows = docs.count()
    band = lexicon(docs, rows)
    ordered = with_next(docs)
    chars = F.length("text")
    swap = F.floor(chars / 4).cast("int")
    ordered = ordered.withColumn("edited", F.concat(F.substring("text", F.lit(1), chars - swap), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), swap)))
    each = ordered.select(
        "pos", "doc_id", "rows", chars.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("sha"),
        *[column.alias(name) for part in (_described("text", "a"), _described("edited", "b")) for name, column in part.items()])
    each = each.withColumns({f"{x}_level": _level(F.size(f"{x}_terms")) for x in "ab"} | {f"{x}_all": F.xxhash64(F.sort_array(f"{x}_terms")) for x in "ab"})

    def candidates(x: str, which: int) -> Column:
        level = F.col(f"{x}_level")
        kept = F.filter(f"{x}_terms", lambda h: _low(h, level) < LEXICONS)
        return F.transform(kept, lambda h: F.struct(F.lit(which).alias("which"), h.alias("h"), F.lit(None).cast(HEAD).alias("head")))

    head = F.struct(*[F.col(c) for c in ("doc_id", "rows", "n_chars", "sha", "a_level", "a_all", "b_level", "b_all")])
    header = F.array(F.struct(F.lit(0).alias("which"), F.xxhash64("pos").alias("h"), head.alias("head")))
    sent = each.select("pos", F.explode(F.concat(header, candidates("a", 1), candidates("b", 2))).alias("t")).select("pos", "t.*")
    found = sent.join(band.withColumn("hit", F.lit(True)), "h", "left").where("which = 0 or hit")
    grouped = found.groupBy("pos").agg(
        F.max("head").alias("head"), F.sort_array(F.collect_list(F.when(F.col("which") == 1, F.col("h")))).alias("a"),
        F.sort_array(F.collect_list(F.when(F.col("which") == 2, F.col("h")))).alias("b")).select("pos", "head.*", "a", "b")

    def hashes(x: str) -> Column:
        """Hashes of the sub-lexicons at the document's level and at the next; 0 for an empty one."""
        level = F.col(f"{x}_level")

        def held(up: int, k: int) -> Column:
            return F.filter(x, lambda h: _low(h, level + up) == k)

        parts = [held(up, k) for up in (0, 1) for k in range(LEXICONS)]
        return F.array(*[F.when(F.size(p) > 0, F.xxhash64(p).bitwiseAND(0x7FFFFFFF).cast("int") + 1).otherwise(0) for p in parts])

    return grouped.select(
        "pos", "doc_id", "rows", "n_chars", F.col("sha").alias("edited_sha256"),
        *[column for x in "ab" for column in (
            F.when(F.size(x) > 0, F.col(f"{x}_level")).otherwise(0).alias(f"{x}_level"),
            F.when(F.size(x) > 0, hashes(x)).otherwise(F.array(F.col(f"{x}_all").bitwiseAND(0x7FFFFFFF).cast("int"))).alias(f"{x}_hashes"))])


HEAD = T.StructType([T.StructField(n, t) for n, t in (
    ("doc_id", T.LongType()), ("rows", T.LongType()), ("n_chars", T.LongType()), ("sha", T.StringType()), ("a_level", T.IntegerType()),
    ("a_all", T.LongType()), ("b_level", T.IntegerType()), ("b_all", T.LongType()))])


def shown(level: str, hashes: str) -> Column:
    """The fingerprint as text: level, then hexadecimal hashes."""
    return F.concat(F.col(level), F.lit(":"), F.array_join(F.transform(hashes, lambda h: F.lower(F.hex(h))), "."))


def likeness(level: Column, hashes: Column, other_level: Column, other: Column) -> Column:
    """Share of equal hashes among sub-lexicons not empty in both, at a common level; without one 1 if equal, else 0."""
    gap = other_level - level
    low = F.slice(hashes, F.when(gap > 0, LEXICONS + 1).otherwise(1), F.lit(LEXICONS))
    high = F.slice(other, F.when(gap < 0, LEXICONS + 1).otherwise(1), F.lit(LEXICONS))
    pairs = F.filter(F.zip_with(low, high, lambda x, y: F.when((x != 0) | (y != 0), (x == y).cast("int"))), lambda v: v.isNotNull())
    share = F.aggregate(pairs, F.lit(0), lambda s, v: s + v) / F.size(pairs)
    comparable = (level > 0) & (other_level > 0) & (F.abs(gap) <= 1) & (F.size(pairs) > 0)
    return F.when((level == other_level) & (hashes == other), 1.0).when(comparable, share).otherwise(0.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document with its own and its edited text's fingerprint, and how alike they and its successor's are."""
    found = staged(prints(docs), "prints")
    after = found.select(F.when(F.col("pos") == 1, F.col("rows")).otherwise(F.col("pos") - 1).alias("pos"),
                         F.col("a_level").alias("n_level"), F.col("a_hashes").alias("n_hashes"))
    return found.join(after, "pos").select(
        "doc_id", "n_chars", "edited_sha256", shown("a_level", "a_hashes").alias("fingerprint"), shown("b_level", "b_hashes").alias("edited_fingerprint"),
        likeness(F.col("a_level"), F.col("a_hashes"), F.col("b_level"), F.col("b_hashes")).alias("near_edited"),
        likeness(F.col("a_level"), F.col("a_hashes"), F.col("n_level"), F.col("n_hashes")).alias("near_next"))


def op1_imatch(spark: SparkSession, directory: str) -> DataFrame:
    return fingerprints(documents(spark, directory))


QUERIES = {"op1_imatch": op1_imatch}
