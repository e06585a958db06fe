"""SimHash near-dedup: 64-bit fingerprints linked at a few differing bits by bit-sliced comparison.

Fingerprints within two bits agree on at least four of six bit ranges, so every link lies inside one of fifteen
bucket families. Inside a bucket the fingerprints stand as vertical bit planes: one XOR compares a plane of 64
fingerprints with one bit of a query, two carry-save words per lane count differing bits, and a block is given up
once all its lanes exceed the radius. Only a spanning set of links leaves a bucket, never all pairs. A bucket holds
distinct fingerprints that differ in at most 22 bits, so its size is bounded whatever the table holds.

Defined results: null or blank texts have fingerprint zero and are linked like any other; texts of one or two words
are one shingle; equal fingerprints share a component; repeated rows are kept; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from radiokpi.llm.common import components, documents, staged, text_of

RADIUS = 2
SHINGLE = 3
SEED = 42
# Bit ranges of the buckets: six blocks, of which four are kept.
EDGES = (0, 11, 22, 33, 44, 54, 64)
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
SHORT = 64


def _masks() -> list[int]:
    blocks = [sum(1 << k for k in range(a, b)) for a, b in zip(EDGES, EDGES[1:])]
    return [sum(kept) for kept in combinations(blocks, len(blocks) - RADIUS)]


def fingerprint(text: bytes) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = [e + k for k, e in enumerate(accumulate(map(len, words)))]
        starts = [0, *[e + 1 for e in ends]]
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1:])]
    set_bits = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        some = np.array(hashes[k:k + 65536], "<u8")
        set_bits += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): one row per document, fp as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.encode(text_of(), "UTF-8").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _planes(values: np.ndarray, bits: list[int]) -> np.ndarray:
    """[bit, word]: bit ``k`` of word ``w`` belongs to value ``64 w + k``."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:len(values)] = values
    out = np.empty((len(bits), words), np.uint64)
    for at, bit in enumerate(bits):
        out[at] = np.packbits(((padded >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
    return out


def _within(differing: Iterator[np.ndarray], shape: tuple, radius: int = RADIUS) -> np.ndarray:
    """Lanes in which at most ``radius`` (two) of the planes are set, by carry-save counters."""
    ones, twos, over = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
    for at, plane in enumerate(differing):
        carry = ones & plane
        ones ^= plane
        over |= twos & carry
        twos ^= carry
        if at % 4 == 3:
            over |= ones & twos
            if (over == ONES).all():
                break
    return ~(over | (ones & twos))


def _unpack(words: np.ndarray, size: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), bitorder="little")[:size]


def _long_run(values: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one bucket: breadth-first, 64 queries at a time, only lanes not yet reached."""
    size = len(values)
    planes = _planes(values, bits)
    fresh = np.packbits(np.arange(planes.shape[1] * 64) < size, bitorder="little").view("<u8").copy()
    child, parent = [], []
    while fresh.any():
        word = int(np.flatnonzero(fresh)[0])
        root = 64 * word + int(np.flatnonzero(_unpack(fresh[word:word + 1], 64))[0])
        fresh[root // 64] &= ~(np.uint64(1) << np.uint64(root % 64))
        queue = np.array([root])
        while len(queue):
            some, queue = queue[:64], queue[64:]
            asked = [np.where((values[some] >> np.uint64(b)) & np.uint64(1), ONES, np.uint64(0))[:, None] for b in bits]
            near = _within((planes[k][None, :] ^ asked[k] for k in range(len(bits))), (len(some), planes.shape[1]))
            reached = np.bitwise_or.reduce(near, axis=0) & fresh
            fresh &= ~reached
            new = np.flatnonzero(_unpack(reached, size))
            child.append(new)
            parent.append(np.full(len(new), root))
            queue = np.concatenate([queue, new])
    return np.concatenate(child), np.concatenate(parent)


def _short_runs(values: np.ndarray, run: np.ndarray, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of many small buckets at once: rows against the rows ``d`` places on, for every ``d``."""
    label = np.arange(len(values))
    left, right = [], []
    for d in range(1, SHORT):
        ok = np.flatnonzero(run[d:] == run[:-d])
        if not len(ok):
            break
        a, b = _planes(values[ok], bits), _planes(values[ok + d], bits)
        near = _within((a[k] ^ b[k] for k in range(len(bits))), a.shape[1:])
        hit = ok[_unpack(near, len(ok)).astype(bool)]
        left.append(hit)
        right.append(hit + d)
    if not left:
        return label[:0], label[:0]
    left, right = np.concatenate(left), np.concatenate(right)
    while True:
        lower = np.minimum(label[left], label[right])
        if (label[left] == lower).all() and (label[right] == lower).all():
            break
        np.minimum.at(label, left, lower)
        np.minimum.at(label, right, lower)
    child = np.flatnonzero(label != np.arange(len(label)))
    return child, label[child]


def bucket_links(family: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by (family, kept bits): pairs of row numbers, at most one per row."""
    masks = np.array(_masks(), np.uint64)
    kept = values & masks[family]
    starts = np.flatnonzero(np.r_[True, (kept[1:] != kept[:-1]) | (family[1:] != family[:-1])])
    sizes = np.diff(np.r_[starts, len(values)])
    number = np.repeat(np.arange(len(starts)), sizes)
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for one in np.unique(family):
        bits = [b for b in range(64) if not int(masks[one]) >> b & 1]
        for k in np.flatnonzero((sizes > SHORT) & (family[starts] == one)):
            child, parent = _long_run(values[starts[k]:starts[k] + sizes[k]], bits)
            pairs.append((child + starts[k], parent + starts[k]))
        rows = np.flatnonzero((family == one) & (sizes[number] > 1) & (sizes[number] <= SHORT))
        if len(rows):
            child, parent = _short_runs(values[rows], number[rows], bits)
            pairs.append((rows[child], rows[parent]))
    return tuple(np.concatenate(x) for x in zip(*pairs))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct fingerprints ``fp`` within the radius of one another."""
    families = F.array(*[F.struct(F.lit(k).cast("int").alias("family"), (F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))).alias("kept"))
                         for k, m in enumerate(_masks())])
    rows = prints.select("fp", F.explode(families).alias("b")).select("b.family", "b.kept", "fp")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(family: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
            child, parent = bucket_links(family, values)
            signed = values.view(np.int64)
            return pa.record_batch([pa.array(signed[child]), pa.array(signed[parent])], names=["a", "b"])

        family, kept, values = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            family = np.r_[family, batch.column(0).to_numpy()]
            kept = np.r_[kept, batch.column(1).to_numpy()]
            values = np.r_[values, batch.column(2).to_numpy().view(np.uint64)]
            if len(values) < 200_000:
                continue
            # The last bucket may go on in the next batch.
            last = np.flatnonzero((kept != kept[-1]) | (family != family[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield pairs(family[:cut], values[:cut])
                family, kept, values = family[cut:], kept[cut:], values[cut:]
        if len(values):
            yield pairs(family, values)

    return rows.repartition(parts, "family", "kept").sortWithinPartitions("family", "kept", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links of the radius reach."""
    prints = staged(fingerprints(docs), "fingerprints")
    distinct = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "distinct")
    found = components(staged(links(distinct), "links")).select(F.col("node").alias("fp"), "root")
    labelled = staged(distinct.join(found, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root")), "labelled")
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = labelled.join(least, "root").select("fp", "component_id")
    return prints.join(classes, "fp")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents of the smallest doc_id of every component, one row for each such id, columns as they came.

    A document without doc_id can't be told from others and stays.
    """
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*[F.col(f"`{c}`") for c in docs.columns])
    return named.union(docs.where(F.col("doc_id").isNull()))


def op10_simhash(spark: SparkSession, directory: str) -> DataFrame:
    return near_duplicates(documents(spark, directory)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}
