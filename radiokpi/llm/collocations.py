"""Phrase collocations from depth-truncated suffix trees, built group by group (vertical partitioning).

Every word starts a suffix that ends with its piece of text or after ``DEPTH`` words. Equal suffixes of a stretch of
documents are counted together and stored, with the stretch's own words, as compressed runs of numbers. Vertical
partitioning starts from one-word prefixes: a prefix under which more suffix rows lie than the memory budget allows is
extended by a word, again up to the full depth. Prefixes are dealt to bins by hash, and neighbouring bins are joined to
groups up to the budget. Each group is one task, which holds its suffixes, sorts them and reads its subtree off: nodes
are where sorted suffixes branch, and a node's count is the total of the leaves below it. Nodes above an extended prefix
lie in several groups and their parts add up.

The budget is ``BUDGET`` suffix rows, or the share of one of ``BINS`` bins where the corpus is so large that there would
be more groups than bins. So there are at most ``BINS`` extended prefixes of each length and ``BINS`` bins, which is
what the driver sees and hands out. Suffixes meet by hashes of their prefixes, which only decide where they are counted;
counts are of the words themselves.

Defined results: null text counts as empty; null lang is ``und``; documents without words add nothing; repeated rows
count as often as they stand there; no rows give no rows; extra columns are not read; ties in score and count fall to
the phrase that is smaller in UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from radiokpi.llm.common import documents, staged, text_of

DEPTH = 3
LEAST = 10
TOP = 2000
UNKNOWN = "und"
# Suffix rows in a group, and bins that prefixes are dealt to.
BUDGET = 1_500_000
BINS = 1 << 20
# Bytes of text split at once, and suffixes counted together before they are handed on.
SLICE = 1 << 22
STRETCH = 1 << 22
# Different words of a stretch: ids of three words share 63 bits.
WORD_BITS = 21
# Candidates ranked in one task of the first of two rankings.
RANKED = 200_000
# What ends a piece of text becomes a word of its own, a tab becomes a space.
END = b"."
MARKS = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\t", END * 10 + b" ")
WORDS = [f"w{k + 1}" for k in range(DEPTH)]
RUN = "lang string, size long, letters long, words binary, numbers binary"
CODEC = pa.Codec("zstd")


def slices(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """(words, starts) of stretches of ``text``: suffixes start at the first ``starts`` words, the rest is what follows."""
    carried: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            end = text.find(b" ", end)
        last = end < 0 or end >= len(text)
        part = text[at:] if last else text[at:end]
        words = carried + part.lower().translate(MARKS).replace(END, b" . ").split()
        if last:
            yield words, len(words)
            return
        yield words, max(0, len(words) - DEPTH + 1)
        carried = words[max(0, len(words) - DEPTH + 1):]
        at = end


# --- runs of suffixes -----------------------------------------------------------------------

def packed(lang: str, words: list[bytes], columns: list[np.ndarray], n: np.ndarray) -> tuple:
    """A run: suffixes as numbers of ``words`` (0: none; the first word has number 1) with their counts, compressed."""
    joined = b" ".join(words)
    # Bytes of equal weight lie together, which is what compresses.
    planes = [np.ascontiguousarray(c, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in (*columns, n)]
    return lang, len(n), len(joined), CODEC.compress(joined, asbytes=True), CODEC.compress(b"".join(planes), asbytes=True)


def unpacked(size: int, letters: int, words: bytes, numbers: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    held = CODEC.decompress(words, letters, asbytes=True).split(b" ") if letters else []
    planes = np.frombuffer(CODEC.decompress(numbers, 4 * size * (DEPTH + 1), asbytes=True), np.uint8).reshape(DEPTH + 1, 4, size)
    # Numbers of words fit 32 bits, counts are added up in 64.
    columns = [np.ascontiguousarray(p.T).view("<i4")[:, 0] for p in planes[:DEPTH]]
    return held, columns, np.ascontiguousarray(planes[DEPTH].T).view("<u4")[:, 0].astype(np.int64)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


class Numbers(dict):
    """Words to numbers from 1; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) batches to runs: truncated suffixes of a stretch with their counts."""
    numbers, keys, pending = Numbers({END: 0}), {}, 0

    def made() -> pa.RecordBatch:
        rows, words = [], list(numbers)[1:]
        for lang, parts in keys.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            if len(codes):
                columns = [(codes >> (WORD_BITS * (DEPTH - 1 - k)) & (1 << WORD_BITS) - 1).astype(np.int32) for k in range(DEPTH)]
                rows.append(part_of(lang, words, columns, n, slice(None)))
        return batch_of(rows, RUN)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            for words, starts in slices(text):
                ids = np.zeros(len(words) + DEPTH - 1, np.int64)
                ids[:len(words)] = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
                code = within = ids[:starts]
                for k in range(1, DEPTH):
                    within = np.where(within > 0, ids[k:k + starts], 0)
                    code = code << WORD_BITS | within
                keys.setdefault(lang, []).append(code[ids[:starts] > 0])
                pending += starts
                if pending > STRETCH or len(numbers) > (1 << WORD_BITS - 1):
                    yield made()
                    numbers, keys, pending = Numbers({END: 0}), {}, 0
    yield made()


def part_of(lang: str, words: list[bytes], columns: list[np.ndarray], n: np.ndarray, rows) -> tuple:
    """The run of some rows of another, with the words that these hold."""
    columns = [c[rows] for c in columns]
    used = np.unique(np.concatenate([*columns, np.zeros(1, columns[0].dtype)]))
    return packed(lang, [words[k - 1] for k in used[1:].tolist()], [np.searchsorted(used, c) for c in columns], n[rows])


def suffixes(docs: DataFrame) -> DataFrame:
    """Runs of the suffixes of all texts; a suffix stands in several of them."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    return docs.select(lang, text_of().alias("text")).mapInArrow(counted, RUN)


# --- vertical partitioning ------------------------------------------------------------------

def prefix_hashes(lang: str, words: list[bytes], columns: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the prefixes of one to DEPTH words of every suffix."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    own = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words)], np.uint64)
    out, h = [], np.zeros(len(columns[0]), np.uint64)
    for column in columns:
        h = (h ^ own[column]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        out.append(h)
    return out


def prefix_lengths(hashes: list[np.ndarray], heavy: list[np.ndarray]) -> np.ndarray:
    """Words of the prefix that decides on the group; ``heavy``: sorted hashes of extended prefixes by length."""
    length = np.ones(len(hashes[0]), np.int64)
    for k, extended in enumerate(heavy):
        length += (length == k + 1) & np.isin(hashes[k], extended)
    return length


def weights(runs: DataFrame, heavy: list[np.ndarray]) -> DataFrame:
    """(h, rows): suffix rows by prefix, of the prefixes that extend those of ``heavy``, all of one length."""
    depth = len(heavy)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, *held in zip(*(c.to_pylist() for c in batch.columns)):
                words, columns, _ = unpacked(*held)
                hashes = prefix_hashes(lang, words, columns)
                chosen = hashes[depth][prefix_lengths(hashes, heavy) > depth] if depth else hashes[0]
                h, rows = np.unique(chosen, return_counts=True)
                yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(rows)], names=["h", "rows"])

    return runs.mapInArrow(run, "h long, rows long").groupBy("h").agg(F.sum("rows").alias("rows"))


def partition(runs: DataFrame, least: int = BUDGET) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of extended prefixes by length, and the group of each bin."""
    here = staged(weights(runs, []), "prefixes")
    total = here.agg(F.sum("rows")).first()[0] or 0
    budget = max(least, -(-total // BINS))
    heavy, weight = [], np.zeros(BINS, np.int64)
    while True:
        whole = here
        if len(heavy) < DEPTH - 1:
            # Fewer than BINS prefixes can be heavier than a bin's share of all rows.
            found = np.sort(np.array([r[0] for r in here.where(F.col("rows") > budget).select("h").collect()], np.int64).view(np.uint64))
            whole = here.where(F.col("rows") <= budget)
        else:
            found = np.zeros(0, np.uint64)
        bins = whole.groupBy(F.shiftrightunsigned("h", 64 - (BINS - 1).bit_length()).cast("int").alias("bin"))
        for row in bins.agg(F.sum("rows")).toLocalIterator():  # at most BINS rows
            weight[row[0]] += row[1]
        if not len(found):
            break
        heavy.append(found)
        here = staged(weights(runs, heavy), "prefixes")
    return heavy, np.unique(np.cumsum(weight) // budget, return_inverse=True)[1]


def grouped(runs: DataFrame, heavy: list[np.ndarray], group: np.ndarray) -> DataFrame:
    """Runs (with ``part``) of the suffixes of one group each."""
    shared = runs.sparkSession.sparkContext.broadcast((heavy, group.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heavy, group = shared.value
        for batch in batches:
            for lang, *held in zip(*(c.to_pylist() for c in batch.columns)):
                words, columns, n = unpacked(*held)
                hashes = prefix_hashes(lang, words, columns)
                length = prefix_lengths(hashes, heavy)
                h = np.choose(length - 1, hashes)
                part = group[(h >> np.uint64(64 - (BINS - 1).bit_length())).astype(np.int64)]
                order = np.argsort(part, kind="stable")
                cuts = np.flatnonzero(np.diff(part[order])) + 1
                rows = [(int(part[some[0]]), *part_of(lang, words, columns, n, some)) for some in np.split(order, cuts)]
                yield batch_of(rows, f"part int, {RUN}")

    return runs.mapInArrow(run, f"part int, {RUN}")


# --- subtrees -------------------------------------------------------------------------------

class Subtree:
    """The suffixes of one group with their counts, as numbers of the words seen so far."""

    def __init__(self) -> None:
        self.numbers = Numbers({b"": 0})
        # Numbers of the words (32 bits) by depth, and last the counts (64 bits).
        self.columns = [np.zeros(0, np.int32)] * DEPTH + [np.zeros(0, np.int64)]
        self.more: list[list[np.ndarray]] = []
        self.pending = 0

    def add(self, words: list[bytes], columns: list[np.ndarray], n: np.ndarray) -> None:
        own = np.array([0, *map(self.numbers.__getitem__, words)], np.int32)
        self.more.append([*(own[c] for c in columns), n])
        self.pending += len(n)
        if self.pending > max(BUDGET // 2, len(self.columns[0])):
            self.settle()

    def settle(self) -> None:
        """Sorts the suffixes and adds up equal ones, one column after the other."""
        columns = []
        for k in range(DEPTH + 1):
            columns.append(np.concatenate([self.columns[k], *(part[k] for part in self.more)]))
            self.columns[k] = columns[k][:0]
            for part in self.more:
                part[k] = None
        self.more, self.pending = [], 0
        order = np.lexsort(columns[DEPTH - 1::-1])
        for k in range(DEPTH + 1):
            columns[k] = columns[k][order]
        first = np.flatnonzero(branches(columns)[-1])
        for k in range(DEPTH):
            self.columns[k], columns[k] = columns[k][first], None
        self.columns[DEPTH] = np.add.reduceat(columns[DEPTH], first) if len(first) else columns[DEPTH]

    def nodes(self, lang: str, heavy: list[np.ndarray], least: int) -> Iterator[pa.RecordBatch]:
        """(lang, w1, w2, w3, f): nodes that occur ``least`` times, and the parts of those above extended prefixes."""
        self.settle()
        rows, words = self.columns, list(self.numbers)
        length = prefix_lengths(prefix_hashes(lang, words[1:], rows[:DEPTH]), heavy)
        for depth, new in enumerate(branches(rows), start=1):
            starts = np.flatnonzero(new)
            if not len(starts):
                continue
            f = np.add.reduceat(rows[DEPTH], starts)
            keep = ((f >= least) | (length[starts] > depth)) & (rows[depth - 1][starts] > 0)
            at, f = starts[keep], f[keep]
            path = [[words[k].decode() for k in rows[d][at].tolist()] if d < depth else [""] * len(at) for d in range(DEPTH)]
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), *(pa.array(p, pa.string()) for p in path), pa.array(f)],
                                  names=["lang", *WORDS, "f"])


def branches(rows: list[np.ndarray]) -> list[np.ndarray]:
    """For each depth, where a sorted suffix differs from the one before within its first words."""
    new = np.zeros(len(rows[0]), bool)
    new[:1] = True
    out = []
    for depth in range(DEPTH):
        new = new.copy()
        new[1:] |= rows[depth][1:] != rows[depth][:-1]
        out.append(new)
    return out


def phrase_counts(docs: DataFrame, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, f) of all phrases of at most DEPTH words that occur ``least`` times, and (lang, n)."""
    runs = staged(suffixes(docs), "runs")
    heavy, group = partition(runs, budget)
    shared = runs.sparkSession.sparkContext.broadcast(heavy)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Subtree] = {}
        for batch in batches:
            for _, lang, *held in zip(*(c.to_pylist() for c in batch.columns)):
                trees.setdefault(lang, Subtree()).add(*unpacked(*held))
        for lang, tree in trees.items():
            yield from tree.nodes(lang, shared.value, least)

    schema = ", ".join(["lang string", *(f"{w} string" for w in WORDS), "f long"])
    # One partition for each group, and no other group in it.
    nodes = grouped(runs, heavy, group).repartitionById(int(group.max()) + 1, "part").mapInArrow(grow, schema)
    whole = nodes.groupBy("lang", *WORDS).agg(F.sum("f").alias("f")).where(F.col("f") >= least)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of([(lang, int(unpacked(*held)[2].sum())) for lang, *held in zip(*(c.to_pylist() for c in batch.columns))], "lang string, n long")

    return staged(whole, "nodes"), runs.mapInArrow(occurrences, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


# --- phrases --------------------------------------------------------------------------------

def scored(nodes: DataFrame) -> DataFrame:
    """Candidates of two and three words with the cut that scores lowest: (lang, w1, w2, w3, a, l, r, score)."""
    one = nodes.where("w2 = ''")
    two = nodes.where("w2 <> '' AND w3 = ''")

    def part(frame: DataFrame, taken: list[str], name: str) -> DataFrame:
        return frame.select("lang", *(F.col(w).alias(t) for w, t in zip(WORDS, taken)), F.col("f").alias(name))

    pairs = two.withColumnRenamed("f", "a").join(part(one, ["w1"], "l1"), ["lang", "w1"]).join(part(one, ["w2"], "r1"), ["lang", "w2"])
    pairs = pairs.select("lang", *WORDS, "a", F.array(F.struct(F.col("l1").alias("l"), F.col("r1").alias("r"))).alias("cuts"))
    long = nodes.where("w3 <> ''").withColumnRenamed("f", "a")
    long = long.join(part(one, ["w1"], "l1"), ["lang", "w1"]).join(part(two, ["w2", "w3"], "r1"), ["lang", "w2", "w3"])
    long = long.join(part(two, ["w1", "w2"], "l2"), ["lang", "w1", "w2"]).join(part(one, ["w3"], "r2"), ["lang", "w3"])
    long = long.select("lang", *WORDS, "a", F.array(*(F.struct(F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2))).alias("cuts"))
    # 19 digits hold any count, 38 the products of all counts below 10^15.
    score = "transform(cuts, (c, k) -> struct((1000000 * wide * wide) div (cast(c.l AS decimal(19,0)) * c.r) AS score, k, c.l AS l, c.r AS r))"
    best = pairs.union(long).withColumn("wide", F.col("a").cast("decimal(15,0)")).withColumn("cut", F.array_min(F.expr(score)))
    return best.select("lang", *WORDS, "a", "cut.l", "cut.r", "cut.score")


def not_inside(candidates: DataFrame) -> DataFrame:
    """Candidates without those that a longer one covers in at least half of their occurrences."""
    long = candidates.where("w3 <> ''")
    inner = long.select("lang", F.explode(F.array(F.struct("w1", "w2"), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"), "a")
    longest = inner.groupBy("lang", "p.w1", "p.w2").agg(F.max("a").alias("longer"))
    short = candidates.where("w3 = ''").join(longest, ["lang", "w1", "w2"], "left")
    return long.union(short.where("longer IS NULL OR 100 * longer < 50 * a").select(*long.columns))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, budget: int = BUDGET) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` candidates of every language."""
    nodes, n = phrase_counts(docs, least, budget)
    found = not_inside(staged(scored(nodes), "candidates"))
    found = found.select("lang", F.concat_ws(" ", *(F.when(F.col(w) != "", F.col(w)) for w in WORDS)).alias("phrase"), "a", "l", "r", "score")
    found = staged(found, "kept")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # Ranked in parts first, so that no task sorts all candidates of a language.
    parts = found.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(found.count() // RANKED + 1)))
    first = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, directory: str) -> DataFrame:
    return collocations(documents(spark, directory))


SQL = {"op11_collocations": r"""
with pieces as (
  select doc_id, ifnull(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(ifnull(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from pieces),
starts as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from words),
suffixes as (select lang, ws[i] as w1, ws[i + 1] as w2, ws[i + 2] as w3 from starts),
n as (select lang, count(*) as n from suffixes group by lang),
one as (select lang, w1, count(*) as f from suffixes group by all),
two as (select lang, w1, w2, count(*) as f from suffixes where w2 is not null group by all),
three as (select lang, w1, w2, w3, count(*) as f from suffixes where w3 is not null group by all having count(*) >= 10),
cuts as (
  select t.lang, t.w1, t.w2, null as w3, t.f as a, 1 as k, l.f as l, r.f as r
  from two t join one l on l.lang = t.lang and l.w1 = t.w1 join one r on r.lang = t.lang and r.w1 = t.w2 where t.f >= 10
  union all
  select t.lang, t.w1, t.w2, t.w3, t.f, 1, l.f, r.f from three t join one l on l.lang = t.lang and l.w1 = t.w1
  join two r on r.lang = t.lang and r.w1 = t.w2 and r.w2 = t.w3
  union all
  select t.lang, t.w1, t.w2, t.w3, t.f, 2, l.f, r.f from three t join two l on l.lang = t.lang and l.w1 = t.w1 and l.w2 = t.w2
  join one r on r.lang = t.lang and r.w1 = t.w3),
scores as (select *, cast((1000000::hugeint * a * a) // (l::hugeint * r) as bigint) as score from cuts),
best as (select * from scores qualify row_number() over (partition by lang, w1, w2, w3 order by score, k) = 1),
kept as (
  select * from best b where w3 is not null or not exists (
    select 1 from three t where t.lang = b.lang and 100 * t.f >= 50 * b.a
    and ((t.w1 = b.w1 and t.w2 = b.w2) or (t.w2 = b.w1 and t.w3 = b.w2)))),
named as (select lang, concat_ws(' ', w1, w2, w3) as phrase, a, l, r, score from kept)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from named join n using (lang)
qualify rank <= 2000"""}

QUERIES = {"op11_collocations": op11_collocations}
