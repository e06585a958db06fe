"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary.

Each language has a probability for every piece of a public vocabulary. The probability of a word is the sum, by the
forward algorithm, over all ways to cut it into pieces; a text's is the product over its words, and the languages'
shares of all documents are the prior. Piece probabilities are learned by expectation maximisation over the counts
of all words of all labelled training documents: Spark counts words by language once, and each round runs the
forward-backward algorithm where the counts lie and adds up expected piece counts. What the driver sees and hands
out is one number for each piece and language, whatever the corpus.

Words are runs of letters, lower-cased, behind the vocabulary's mark of a word start; a letter outside the
vocabulary is one unknown piece. Other characters say nothing of a language.

Defined results: null text and text without a letter are ``und`` with score 0; without training rows so is
everything; rows with null lang teach nothing, and null doc_ids are not held out; repeated rows teach as often as
they stand there; no rows give no rows; extra columns are not read; equal scores fall to the smaller language name.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radiokpi.llm.common import documents, staged, text_of

VOCABULARY = "piece_bpe_32k.model"
ROUNDS = 3
# What each piece gets beside its expected count, so that unseen pieces stay possible.
SMOOTHING = 0.1
UNKNOWN = "und"
START = "▁"
LETTERS = regex.compile(r"\p{L}+")
# Words kept with their probabilities by one worker, and words counted together before they are handed on.
CACHE = 300_000
STRETCH = 200_000
# Letters of texts predicted together.
TEXT = 1 << 22
# Words of the counts handled together in a round.
BLOCK = 100_000
# Cells of one forward table: words of equal length are computed side by side.
CELLS = 1 << 18
# So few words of one length are looked up one by one: the same pieces, sooner for a very long word.
FEW = 24
# Words of so many letters have probabilities far above the smallest double.
SHORT = 24


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """Numbers of the pieces that a lower-cased word can be cut into; 0 is the unknown piece.

    Pieces are found by a 64-bit hash of their letters, in tables of one entry a slot: what a slot has no room for
    goes to the next table, so that words of equal length are looked up side by side.
    """

    SLOTS = 18
    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.number = {p: i for i, p in enumerate(names) if i and LETTERS.fullmatch(p.removeprefix(START) or "a")}
        self.size = len(names)
        self.longest = max(map(len, self.number))
        self.tables = []
        left = [(self.hashed(np.array([[ord(c)] for c in p], np.uint64))[0], i) for p, i in self.number.items()]
        while left:
            held = {}
            for h, i in left:
                held.setdefault(int(self.slot(np.array([h], np.uint64), len(self.tables))[0]), (h, i))
            keys, numbers = np.zeros(1 << self.SLOTS, np.uint64), np.zeros(1 << self.SLOTS, np.int32)
            for at, (h, i) in held.items():
                keys[at], numbers[at] = h, i
            self.tables.append((keys, numbers))
            placed = {i for _, i in held.values()}
            left = [(h, i) for h, i in left if i not in placed]

    def hashed(self, codes: np.ndarray) -> np.ndarray:
        h = np.zeros(codes.shape[1], np.uint64)
        for row in codes:
            h = (h ^ row) * self.BASE
            h ^= h >> np.uint64(29)
        return h

    def slot(self, h: np.ndarray, table: int) -> np.ndarray:
        return (h * np.uint64(0xBF58476D1CE4E5B9 + 2 * table) >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def found(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.int32)
        for k, (keys, numbers) in enumerate(self.tables):
            at = self.slot(h, k)
            out += np.where(keys[at] == h, numbers[at], 0)
        return out

    def steps(self, words: list[str]) -> list[tuple[int, int, slice | np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) for words of equal length: which of them have which piece there, by end."""
        length, few, number = len(words[0]), len(words) < FEW, self.number.get
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).T.astype(np.uint64)
        out = []
        for start in range(length):
            h = np.zeros(len(words), np.uint64)
            for end in range(start + 1, min(length, start + self.longest) + 1):
                if few:
                    found = [number(w[start:end], 0) for w in words]
                    if end - start > 1 and not any(found):
                        continue
                    found = np.array(found)
                else:
                    h = (h ^ codes[end - 1]) * self.BASE
                    h ^= h >> np.uint64(29)
                    found = self.found(h)
                if end - start == 1:
                    out.append((start, end, slice(None), found))
                elif len(rows := np.flatnonzero(found)):
                    out.append((start, end, rows, found[rows]))
        return sorted(out, key=lambda step: step[1])


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str]) -> Iterator[list[int]]:
    """Places of words of one length, in blocks of a bounded table."""
    groups = defaultdict(list)
    for k, w in enumerate(words):
        groups[len(w)].append(k)
    for length, places in groups.items():
        block = max(1, CELLS // length)
        for at in range(0, len(places), block):
            yield places[at:at + block]


def forward(steps: list, shape: tuple[int, int], reach: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha[place, word, language] over exp(scale), and that scale, for (words, letters) as ``shape``.

    Words of at most ``SHORT`` letters are scaled at their end alone; in longer ones, values that can still be read
    (``reach`` letters back) are brought to a common scale at every letter, so that none vanishes.
    """
    words, length = shape
    alpha = np.zeros((length + 1, words, p.shape[1]))
    scale = np.zeros_like(alpha)
    alpha[0] = 1.0
    shift = np.zeros((words, p.shape[1]))

    def settle(end: int, low: int) -> None:
        top = alpha[end].copy()
        alpha[low:end + 1] /= top
        np.add(shift, np.log(top), out=shift)
        scale[low:end + 1] = shift

    done = 0
    for start, end, rows, found in steps:
        while length > SHORT and done < end - 1:
            done += 1
            settle(done, max(0, done - reach + 1))
        alpha[end][rows] += alpha[start][rows] * p[found]
    settle(length, length)
    return alpha, scale


def word_scores(words: list[str], table: Pieces, p: np.ndarray) -> np.ndarray:
    """[word, language]: logarithm of the sum over all segmentations."""
    out = np.zeros((len(words), p.shape[1]))
    marked = [START + w for w in words]
    for places in by_length(marked):
        some = [marked[k] for k in places]
        out[places] = forward(table.steps(some), (len(some), len(some[0])), table.longest, p)[1][-1]
    return out


def expected(words: list[str], n: np.ndarray, table: Pieces, p: np.ndarray) -> np.ndarray:
    """[piece]: expected counts over all segmentations of words that occur ``n`` times, under one language's ``p``."""
    out = np.zeros(table.size)
    marked = [START + w for w in words]
    for places in by_length(marked):
        some = [marked[k] for k in places]
        length = len(some[0])
        steps = table.steps(some)
        alpha, scale = forward(steps, (len(some), length), table.longest, p[:, None])
        alpha, scale = alpha[:, :, 0], scale[:, :, 0]
        # beta[place]: probability of the rest, times exp(scale[place]), over that of the whole word.
        beta = np.zeros_like(alpha)
        beta[-1] = n[places]
        seen, values = [], []
        for start, end, rows, found in sorted(steps, key=lambda s: -s[0]):
            rest = p[found] * beta[end][rows]
            if length > SHORT or end == length:
                rest *= np.exp(scale[start][rows] - scale[end][rows])
            beta[start][rows] += rest
            seen.append(found)
            values.append(alpha[start][rows] * rest)
        out += np.bincount(np.concatenate(seen), np.concatenate(values), table.size)
    return out


def letters(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over all texts of ``docs`` (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)

        def made() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()),
                                       pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[lang].update(letters(text))
                if sum(map(len, seen.values())) > STRETCH:
                    yield from made()
                    seen.clear()
        yield from made()

    counted = docs.select(F.col("lang").cast("string").alias("lang"), text_of().alias("text")).mapInArrow(run, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


class Model:
    """Languages in order of name, logarithms of their shares, and [piece, language] probabilities."""

    def __init__(self, path: str, languages: list[str], prior: np.ndarray, p: np.ndarray) -> None:
        self.path, self.languages, self.prior, self.p = path, languages, prior, p
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(languages)))

    def __getstate__(self) -> tuple:
        return self.path, self.languages, self.prior, self.p

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, share) of every text; a stretch of texts is held as words at a time."""
        out, first, held = [], 0, 0
        for k, text in enumerate(texts):
            held += len(text)
            if held > TEXT or k == len(texts) - 1:
                out += self._predict(texts[first:k + 1])
                first, held = k + 1, 0
        return out

    def _predict(self, texts: list[str]) -> list[tuple[str, float]]:
        found = [letters(t) for t in texts]
        if len(self.known) > CACHE:
            self.known, self.scores = {}, self.scores[:0]
        new = list(set().union(*found).difference(self.known)) if found else []
        if new:
            at = len(self.known)
            self.known.update((w, at + k) for k, w in enumerate(new))
            made = word_scores(new, pieces(self.path), self.p)
            if len(self.known) > len(self.scores):
                # Grown by doubling: a batch copies no more than it adds on average.
                grown = np.zeros((max(2 * len(self.scores), len(self.known)), len(self.languages)))
                grown[:at] = self.scores[:at]
                self.scores = grown
            self.scores[at:at + len(new)] = made
        out = []
        for words in found:
            if not words or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.prior + self.scores[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))].sum(axis=0)
            share = np.exp(total - total.max())
            best = int(share.argmax())
            out.append((self.languages[best], float(share[best] / share.sum())))
        return out


def fit(train: DataFrame, rounds: int = ROUNDS, path: str | None = None) -> Model:
    """A model of the languages in ``train`` (lang, text), read whole."""
    path = path or vocabulary_path()
    train = train.where("lang IS NOT NULL")
    counts = staged(word_counts(train), "words")
    shares = {r[0]: r[1] for r in train.groupBy(F.col("lang").cast("string").alias("lang")).count().collect()}
    languages = sorted(shares)
    table = pieces(path)
    number = {lang: k for k, lang in enumerate(languages)}
    prior = np.log(np.array([shares[lang] for lang in languages], float) / max(1, sum(shares.values())))
    p = np.full((table.size, len(languages)), 1.0 / table.size)
    for _ in range(rounds if languages else 0):
        model = counts.sparkSession.sparkContext.broadcast(p)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(model.value.shape)

            def add(frame: pd.DataFrame) -> None:
                for lang, rows in frame.groupby("lang", sort=False):
                    k = number[lang]
                    total[:, k] += expected(rows["word"].tolist(), rows["n"].to_numpy(), pieces(path), np.ascontiguousarray(model.value[:, k]))

            held, size = [], 0
            for frame in frames:
                held.append(frame)
                size += len(frame)
                if size >= BLOCK:
                    add(pd.concat(held))
                    held, size = [], 0
            if held:
                add(pd.concat(held))
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "language": lang, "n": total[piece, lang]})

        # One row for each piece and language at most.
        rows = counts.mapInPandas(run, "piece long, language long, n double").groupBy("piece", "language").agg(F.sum("n").alias("n"))
        found = rows.toPandas().sort_values(["piece", "language"])
        new = np.full(p.shape, SMOOTHING)
        new[found["piece"], found["language"]] += found["n"]
        p = new / new.sum(axis=0)
        model.destroy()
    return Model(path, languages, prior, p)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; columns of these names give way."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict(texts.tolist()), columns=["lang_pred", "score"])

    kept = docs.drop("lang_pred", "score")
    return kept.withColumn("__found", predict(text_of())).select(*kept.columns, "__found.*")


def held_out(doc_id: str = "doc_id") -> Column:
    """The quarter of the documents that the model may not learn from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op12_language(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    model = fit(docs.where(~held_out()).select("lang", "text"))
    return identified(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


QUERIES = {"op12_language": op12_language}
