"""Best-fit packing by patterns: non-negative least squares over the length histogram, residuals by best fit.

Documents are tokenized, ended with id 0 and cut only where they are longer than a sequence. The histogram of piece
lengths (at most ``capacity`` rows) is all that the driver sees. Patterns of up to three lengths that fill a sequence
exactly get repeat counts by non-negative least squares, rounded down and trimmed to what exists; best fit packs the
rest, still on the histogram. The plan says for each length which ranks go to which sequences, so that every piece
finds its place from its length and its rank among equal lengths.

Defined results: null or empty text is one piece of length 1 (the closing id); repeated rows are packed separately;
no rows give no rows; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from radiokpi.llm.common import block_ranks, documents, staged, text_of

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
SPLITS = 64
ROUNDS = 150
# Words kept with their ids by one worker, and the longest word kept.
CACHE = 400_000
LONGEST = 64
# Below this code point lower case maps single characters to single characters and composition changes nothing.
PLAIN = "\u0130"
# How the tokenizer's file splits lower-cased text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = "</w>"


class Encoder:
    """Ids of whole texts as little-endian 32-bit bytes.

    The tokenizer treats each piece of its split on its own and never joins characters across white space. So
    white-space chunks and their pieces are remembered with their ids, and only new pieces go to the tokenizer, many
    in one string: the last id of a piece is an end-of-word token, which tells where the next begins. Texts with
    characters beyond ``PLAIN`` or with what may be a special token keep their case, and their chunks go to the
    tokenizer as they are.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(END)]] = True
        self.split = regex.compile(SPLIT).findall
        self.beyond = re.compile(f"[{PLAIN}-\U0010ffff]").search
        self.chunks: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _each(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _new_pieces(self, pieces: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(pieces):
            raw, at = ids.tobytes(), 0
            for piece, cut in zip(pieces, (4 * cuts).tolist()):
                self.pieces[piece] = raw[at:cut]
                at = cut
        else:
            self.pieces.update(zip(pieces, self._each(pieces)))

    def encode(self, text: str) -> bytes:
        plain = "<|" not in text and not self.beyond(text)
        words = (text.lower() if plain else text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = self.chunks if plain else {}
        missing = list(set(words).difference(known))
        if missing and not plain:
            known.update(zip(missing, self._each(missing)))
        elif missing:
            parts = [self.split(w) for w in missing]
            new = list(set().union(*parts).difference(self.pieces))
            if new:
                self._new_pieces(new)
            found = {w: b"".join([self.pieces[p] for p in some]) for w, some in zip(missing, parts)}
            if max(map(len, missing)) > LONGEST:  # long chunks are not kept
                whole = {w: found[w] if w in found else known[w] for w in words}
                found = {w: ids for w, ids in found.items() if len(w) <= LONGEST}
            else:
                whole = known
            known.update(found)
            known = whole
        ids = b"".join(map(known.__getitem__, words))
        for kept in (self.chunks, self.pieces):
            if len(kept) > CACHE:
                kept.clear()
        return ids


@cache
def encoder(path: str) -> Encoder:
    """One encoder for a worker process, so that tasks that follow each other share what it remembers."""
    return Encoder(path)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every document."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path).encode
        for batch in batches:
            found = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at:at + 4 * capacity]
                    for column, value in zip(found, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(found, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def full_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """[pattern, 3]: all multisets of one to three of ``lengths`` that sum to ``capacity`` (0: no document)."""
    here = np.zeros(capacity + 1, bool)
    here[lengths[lengths <= capacity]] = True
    here[0] = True
    values = np.flatnonzero(here)
    rows = []
    for low in values:
        middle = values[(values >= low) & (2 * values <= capacity - low)]
        high = capacity - low - middle
        middle = middle[here[high]]
        rows.append(np.stack([np.full(len(middle), low), middle, capacity - low - middle], axis=1))
    return np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)


def repeat_counts(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares ``min |A x - counts|`` by accelerated projected gradient, rounded and trimmed.

    Rows of short lengths weigh less: what is left of them fits almost anywhere.
    """
    if not len(patterns):
        return np.zeros(0, np.int64)
    size = len(counts)
    weight = np.minimum(1.0, np.arange(size) / (size / 16))
    weight[0] = 0.0
    target = weight * counts
    uses = np.bincount(patterns.ravel(), minlength=size)
    step = 1.0 / max(1.0, 9.0 * float((weight ** 2 * uses).max()))
    # Columns are scaled by how contested their lengths are, which is what makes few rounds enough.
    scale = 1.0 / np.maximum(1.0, (weight[patterns] ** 2 * uses[patterns]).max(axis=1))
    x = np.zeros(len(patterns))
    ahead, pace = x, 1.0
    for _ in range(rounds):
        made = np.bincount(patterns.ravel(), np.repeat(ahead, 3), size) * weight
        slope = (weight * (made - target))[patterns].sum(axis=1)
        new = np.maximum(0.0, ahead - np.maximum(step, scale / 3) * slope)
        paced = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = new + (pace - 1) / paced * (new - x)
        x, pace = new, paced
    left = counts.astype(np.int64).copy()
    taken = np.zeros(len(patterns), np.int64)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        parts, need = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
        taken[k] = min(int(np.floor(x[k] + 0.5)), int((left[parts] // need).min()))
        left[parts] -= need * taken[k]
    return taken


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """[row, 6] (length, first rank, ranks, first sequence, per sequence, offset), ranks and sequences from 0.

    Ranks ``first + i`` of a length go to sequence ``first sequence + i // per sequence`` at
    ``offset + i % per sequence * length``.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, count in counts.items():
        left[length] += count
    rank = np.zeros(capacity + 1, np.int64)
    rows, sequences = [], 0

    def place(length: int, bins: int, each: int, sequence: int, offset: int) -> None:
        rows.append((length, rank[length], bins * each, sequence, each, offset))
        rank[length] += bins * each
        left[length] -= bins * each

    patterns = full_patterns(np.flatnonzero(left), capacity)
    for pattern, count in zip(patterns, repeat_counts(patterns, left)):
        if count:
            offset = 0
            for length, each in zip(*np.unique(pattern[pattern > 0], return_counts=True)):
                place(int(length), int(count), int(each), sequences, offset)
                offset += int(length * each)
            sequences += int(count)
    # Best fit, longest first, on groups of equally filled sequences: free space -> [(first sequence, how many)].
    free: dict[int, list] = {}
    for length in range(capacity, 0, -1):
        while left[length]:
            space = min((s for s in free if s >= length), default=None)
            if space is None:
                each = min(capacity // length, int(left[length]))
                bins = int(left[length]) // each
                place(length, bins, each, sequences, 0)
                free.setdefault(capacity - each * length, []).append((sequences, bins))
                sequences += bins
                continue
            first, bins = free[space].pop()
            if not free[space]:
                del free[space]
            each = min(space // length, int(left[length]))
            used = min(bins, int(left[length]) // each)
            place(length, used, each, first, capacity - space)
            free.setdefault(space - each * length, []).append((first, used))
            if used < bins:
                free.setdefault(space, []).append((first + used, bins - used))
    return np.array(rows, np.int64).reshape(-1, 6)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (as from ``pieces``, stored) with sequence_id and offset."""
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    rows = plan(counts, capacity)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    keyed = cut.withColumn("__order", F.xxhash64("doc_id", "piece")).withColumn("__block", F.pmod("__order", F.lit(SPLITS)))
    ranked = block_ranks(keyed, ["length"], "__block", [F.col("__order"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "__rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = rows[:, 0] * (1 << 40) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy() - 1
            at = np.searchsorted(starts, length * (1 << 40) + rank, "right") - 1
            found = rows[at]
            i = rank - found[:, 1]
            each = np.maximum(found[:, 4], 1)
            yield pa.record_batch([*batch.columns[:5], pa.array(found[:, 3] + i // each), pa.array(found[:, 5] + i % each * length)],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "__rank").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    return pack(staged(pieces(docs, capacity, path), "pieces"), capacity)


def op7_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packed(documents(spark, directory))


QUERIES = {"op7_packing": op7_packing}
