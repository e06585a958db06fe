"""Spelling variants: words one edit apart, found by a bidirectional FM-index with search schemes of two halves.

Of two words that differ by one inserted, deleted or replaced code point, one half of either stands whole in the
other, at the same end. So each word is searched twice: one scheme matches its second half exactly, from the end of a
word, and goes on to the left allowing one error; the other matches the first half and goes on to the right. Both run
on suffix-rank intervals of an index over the delimited words: that of the words for the first scheme, that of the
mirrored words for the second. Intervals are narrowed for many words at once.

Words meet by their halves: a word is sought under its own two halves and can be found under the halves that words
one letter shorter or longer would share with it, four keys at most. Keys are dealt to bins by hash, neighbouring
bins make one index up to the memory budget, and a bin above the budget is cut into several indexes, each searched by
all words of the bin. So an index is bounded by the budget, or the share of one of ``BINS`` bins in all words where
these are so many that there would be more indexes than bins, and no pair is lost.

Defined results: null text holds no words; a null doc_id is an empty text in the number that decides on a deletion;
repeated rows count as often as they stand there; no words give no rows; extra columns are not read; ties in n fall
to the word that is smaller in code points.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from radiokpi.llm.common import documents, staged, text_of

LEAST_LETTERS = 7
LEAST_COUNT = 2
# One in so many (document, word) pairs loses a letter.
DROPPED = 31
# A form occurs at least so many times as often as its variant.
RATIO = 10
# Symbols of one index, and bins that halves are dealt to.
BUDGET = 600_000
BINS = 1 << 16
# Words counted together before they are handed on, and words searched side by side.
STRETCH = 300_000
SEARCHED = 20_000
# Intervals up to this size are listed, wider ones asked for each symbol.
LISTED = 64


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) batches to (word, n): runs of letters, some of them without one letter."""
    long = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}").findall
    total: Counter = Counter()

    def made() -> pa.RecordBatch:
        return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for run, n in Counter(long(text.lower().decode())).items():
                h = zlib.crc32(run.encode(), start)
                if h % DROPPED:
                    total[run] += n
                elif len(run) > LEAST_LETTERS:
                    at = h % len(run)
                    total[run[:at] + run[at + 1:]] += n
            if len(total) > STRETCH:
                yield made()
                total.clear()
    yield made()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of at least LEAST_LETTERS letters that occur LEAST_COUNT times over all texts."""
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).mapInArrow(runs, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Index:
    """FM-index over different words, searched from their ends."""

    def __init__(self, words: list[str]) -> None:
        self.words = sorted(words)
        text = np.frombuffer(("\0" + "\0".join(self.words) + "\0").encode("utf-32-le"), np.uint32)
        self.letters, text = np.unique(text, return_inverse=True)
        size = len(text)
        # The k-th delimiter counts as the k-th smallest symbol, which makes every suffix different.
        ends = np.flatnonzero(text == 0)
        rank = text + len(ends)
        rank[ends] = np.arange(len(ends))
        reach = 1
        while True:
            after = np.zeros(size, np.int64)
            after[:size - reach] = rank[reach:] + 1
            after[ends] = 0
            key = rank * np.int64(max(size, int(rank.max())) + 2) + after
            order = np.argsort(key, kind="stable")
            key = key[order]
            rank = np.empty(size, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            if rank[order[-1]] == size - 1:
                break
            reach *= 2
        self.before = text[order - 1]  # before the first delimiter stands the last
        self.stride = size + 1
        self.ranks = np.sort(self.before * np.int64(self.stride) + np.arange(size))
        self.delimiters = len(ends)

    def step(self, symbol: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """The rank that ``rank`` becomes when ``symbol`` is put before a pattern."""
        return np.searchsorted(self.ranks, symbol * np.int64(self.stride) + rank)

    def wider(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, symbol, low, high) of all letters that stand before the interval at each place."""
        pair, place = np.unique(low * np.int64(self.stride) + high, return_inverse=True)
        lows, highs = pair // self.stride, pair % self.stride
        short = np.flatnonzero(highs - lows <= LISTED)
        count = (highs - lows)[short]
        row = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lows[short], count)
        found = np.unique(np.repeat(short, count) * np.int64(len(self.letters)) + self.before[row])
        at, symbol = found // len(self.letters), found % len(self.letters)
        long = np.flatnonzero(highs - lows > LISTED)
        every = np.arange(1, len(self.letters))
        at = np.concatenate([at, np.repeat(long, len(every))])
        symbol = np.concatenate([symbol, np.tile(every, len(long))])
        at, symbol = at[symbol > 0], symbol[symbol > 0]
        new_low, new_high = self.step(symbol, lows[at]), self.step(symbol, highs[at])
        keep = new_high > new_low
        at, symbol, new_low, new_high = (x[keep] for x in (at, symbol, new_low, new_high))
        # Back from different intervals to all places that hold them.
        order = np.argsort(at, kind="stable")
        first, last = np.searchsorted(at[order], place), np.searchsorted(at[order], place, "right")
        count = last - first
        pick = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)]
        return np.repeat(np.arange(len(low)), count), symbol[pick], new_low[pick], new_high[pick]

    def search(self, queries: list[str], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) places: words one edit from a query whose last ``exact`` letters they end with."""
        sizes = np.array([len(q) for q in queries])
        flat = np.frombuffer("".join(queries).encode("utf-32-le"), np.uint32)
        code = np.searchsorted(self.letters, flat)
        # A letter that no word here holds gets a symbol before which nothing stands.
        strange = self.letters[np.minimum(code, len(self.letters) - 1)] != flat
        code[strange] = len(self.letters)
        base = np.cumsum(sizes) - sizes
        query = np.arange(len(queries))
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), self.delimiters, np.int64)
        for k in range(int(exact.max(initial=0))):
            now = np.flatnonzero(exact[query] > k)
            symbol = code[base[query[now]] + sizes[query[now]] - 1 - k]
            low[now], high[now] = self.step(symbol, low[now]), self.step(symbol, high[now])
            alive = high > low
            query, low, high = query[alive], low[alive], high[alive]
        left = (sizes - exact)[query]
        wrong = []  # (query, letters left, low, high) after the one error
        while len(query):
            place, symbol, new_low, new_high = self.wider(low, high)
            more = left > 0
            own = np.where(more, code[base[query] + np.maximum(left, 1) - 1], -1)
            wrong.append((query[place], left[place], new_low, new_high))
            other = (symbol != own[place]) & more[place]
            wrong.append((query[place][other], left[place][other] - 1, new_low[other], new_high[other]))
            wrong.append((query[more], left[more] - 1, low[more], high[more]))
            same = symbol == own[place]
            query, left, low, high = query[place][same], left[place][same] - 1, new_low[same], new_high[same]
        if not wrong:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        query, left, low, high = (np.concatenate(x) for x in zip(*wrong))
        ready = []
        while len(query):
            done = left == 0
            ready.append((query[done], low[done], high[done]))
            query, left, low, high = (x[~done] for x in (query, left, low, high))
            symbol = code[base[query] + left - 1]
            low, high = self.step(symbol, low), self.step(symbol, high)
            alive = high > low
            query, left, low, high = query[alive], left[alive] - 1, low[alive], high[alive]
        query, low, high = (np.concatenate(x) for x in zip(*ready))
        # Rank 0 is the delimiter that ends the last word, so the k-th word's own has the next rank.
        word, end = self.step(np.zeros(len(low), np.int64), low) - 1, self.step(np.zeros(len(high), np.int64), high) - 1
        whole = end > word
        pair = np.unique(query[whole] * np.int64(self.delimiters) + word[whole])
        return pair // self.delimiters, pair % self.delimiters


def neighbours(words: list[str], queries: list[str], mirrored: bool) -> Iterator[tuple[str, list[str]]]:
    """(query, its near words among ``words``) by the scheme that matches first halves (mirrored) or second halves.

    A pair that shares both halves belongs to the first scheme.
    """
    if not words:
        return
    index = Index([w[::-1] for w in words] if mirrored else words)
    for at in range(0, len(queries), SEARCHED):
        some = queries[at:at + SEARCHED]
        sizes = np.array([len(q) for q in some])
        half = sizes // 2 if mirrored else sizes - sizes // 2
        query, word = index.search([q[::-1] for q in some] if mirrored else some, half)
        cuts = np.searchsorted(query, np.arange(len(some) + 1)).tolist()
        word = word.tolist()
        for k, q in enumerate(some):
            if cuts[k] < cuts[k + 1]:
                found = [index.words[w] for w in word[cuts[k]:cuts[k + 1]]]
                if mirrored:
                    yield q, [w[::-1] for w in found]
                elif found := [w for w in found if not w.startswith(q[:len(q) // 2])]:
                    yield q, found


def searched(table: pa.Table) -> pa.Table:
    """One index: rows (mirrored, word, n, sought, held) to (word, n_near, form_n, form)."""
    mirrored = table.column("mirrored")[0].as_py()
    words, n = table.column("word").to_pylist(), table.column("n").to_pylist()
    count = {w: k for w, k, held in zip(words, n, table.column("held").to_pylist()) if held}
    queries = sorted({w for w, sought in zip(words, table.column("sought").to_pylist()) if sought})
    out = [[], [], [], []]
    for q, found in neighbours(list(count), queries, mirrored):
        form = min(found, key=lambda w: (-count[w], w))
        for column, value in zip(out, (q, len(found), count[form], form)):
            column.append(value)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], names=["word", "n_near", "form_n", "form"])


def dealt(words: DataFrame, least: int = BUDGET) -> DataFrame:
    """Rows (group, mirrored, word, n, sought, held) for every index: its words and the words to be sought in it."""
    near = (-1, 0, 1)  # how much longer a word may be that is sought
    first = F.array(*(F.expr(f"(length(word) + {by}) div 2") for by in near))
    second = F.array(*(F.expr(f"(length(word) + {by + 1}) div 2") for by in near))
    shared = words.select("word", "n", F.explode(F.array(
        F.struct(F.lit(True).alias("mirrored"), F.array_distinct(first).alias("sizes")),
        F.struct(F.lit(False).alias("mirrored"), F.array_distinct(second).alias("sizes")))).alias("s"))
    shared = shared.select("word", "n", "s.mirrored", F.explode("s.sizes").alias("half"))
    whole = F.when(F.col("mirrored"), F.expr("length(word) div 2")).otherwise(F.expr("length(word) - length(word) div 2"))
    key = F.when(F.col("mirrored"), F.expr("left(word, int(half))")).otherwise(F.expr("right(word, int(half))"))
    bins = F.pmod(F.xxhash64(key), F.lit(BINS // 2)) + F.when(F.col("mirrored"), 0).otherwise(BINS // 2)
    keyed = shared.withColumns({"sought": F.col("half") == whole, "bin": bins.cast("int")})
    # A word under two keys of one bin is one row.
    rows = staged(keyed.groupBy("bin", "mirrored", "word").agg(F.max("n").alias("n"), F.max("sought").alias("sought")), "keyed")
    weights = {r[0]: r[1] for r in rows.groupBy("bin").agg(F.sum(F.length("word") + 1)).collect()}  # at most BINS rows
    budget = max(least, -(-sum(weights.values()) // BINS))
    table, group, filled, last = [], -1, budget + 1, 0
    for b in sorted(weights):
        parts = -(-weights[b] // budget)
        if parts > 1 or filled + weights[b] > budget or b >= BINS // 2 > last:
            group, filled = group + 1, 0
        table.append((b, group, parts))
        filled += weights[b]
        if parts > 1:
            group, filled = group + parts - 1, budget + 1
        last = b
    spark = words.sparkSession
    # The hint is safe: one row for each bin.
    placed = rows.join(F.broadcast(spark.createDataFrame(table, "bin int, first int, parts int")), "bin")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    goes = F.when(F.col("sought"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(part))
    placed = placed.withColumns({"own": part, "part": F.explode(goes)})
    return placed.select((F.col("first") + F.col("part")).alias("group"), "mirrored", "word", "n", "sought", (F.col("own") == F.col("part")).alias("held"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last. Each form occurs RATIO times as often, so chains are short."""
    chain = staged(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "chain")
    while True:
        further = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        chain = staged(chain.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chain")
        if chain.where("moved").isEmpty():
            return chain.select("word", "root")
        chain = chain.drop("moved")


def variants(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``docs``."""
    words = staged(vocabulary(docs), "words")
    schema = "word string, n_near long, form_n long, form string"
    found = dealt(words, budget).groupBy("group").applyInArrow(searched, schema)
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct(-F.col("form_n"), "form")).alias("best"))
    joined = words.join(best.select("word", "n_near", F.negative(F.col("best.col1")).alias("near_n"), F.col("best.form").alias("near")), "word", "left")
    enough = F.col("near_n") >= RATIO * F.col("n")
    forms = staged(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                 F.when(enough, F.col("near")).alias("form"), F.when(enough, F.col("near_n")).alias("form_n")), "forms")
    return forms.join(rooted(forms), "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op13_spelling(spark: SparkSession, directory: str) -> DataFrame:
    return variants(documents(spark, directory))


QUERIES = {"op13_spelling": op13_spelling}
