"""Personal data by fixed patterns and a skip-chain conditional random field.

The patterns give the base spans of four kinds. The field labels word tokens: neighbouring tokens share a
transition potential, and equal or similar tokens of one document, however far apart, share a skip potential that
rewards the same label, so that a value recognised in one place is found where its surroundings break the pattern.
Loopy message passing gives each token's marginals; tokens labelled with confidence become spans unless they touch a
base span of their kind. Tokens without a digit or an at sign can't be personal data of these kinds: their label is
fixed to "none", which cuts the graph and leaves the marginals of the others exact for the model. Repeats are chained
one to the next, so that the graph grows with the text and not with its square.

The field is fitted to the base spans of at most ``FIT_ROWS`` documents by pseudo-likelihood.

Defined results: null text counts as empty and has no spans; repeated rows get equal results; no rows give no rows;
extra columns are not read by the query and pass through ``masked`` untouched.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from radiokpi.llm.common import documents, text_of

KINDS = ("email", "ip", "card", "phone")
FIT_ROWS = 3000
# Labels: none, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
ROUNDS = 12
STEPS = 300
RATE = 0.1
RIDGE = 1e-3
CONFIDENCE = 0.9
SHORTEST = 4  # shortest token, without punctuation, that repeats can link

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "+(<"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """(start, end) of each kind in order, leftmost and without overlaps inside a kind."""
    found: list[list[tuple[int, int]]] = [[], [], [], []]
    last, at = 0, text.find("@")
    while at >= 0:
        # Leftmost match: all local characters before the sign that no earlier match has taken.
        start = at
        while start > last and _LOCAL_END.match(text, start - 1):
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found[0].append((start, match.end()))
            last = match.end()
        else:
            last = at + 1  # no later match can reach back over the sign
        at = text.find("@", max(at + 1, last))
    if not _MARK.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or "0") <= 255 for part in m.group().split(".")):
            found[1].append(m.span())
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found[2].append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found[3].append(m.span())
    return found


def tokens_of(text: str) -> list[tuple[int, int, int]]:
    """(start, end, run) of the tokens with a digit or at sign; tokens of one run follow each other directly.

    Punctuation around a token is left out, but for a plus sign or bracket before it.
    """
    out, run, before = [], -1, -1
    mark = _MARK.search(text)
    while mark:
        start = mark.start()
        while start > 0 and not _BLANK.match(text, start - 1):
            start -= 1
        end = _TOKEN.match(text, start).end()
        a, b = start, end
        while a < b and not text[a].isalnum() and text[a] not in _EDGE:
            a += 1
        while b > a and not text[b - 1].isalnum() and text[b - 1] != ")":
            b -= 1
        if before < 0 or text[before:start].strip(" \t\n\r\x0b\x0c"):
            run += 1
        if a < b:
            out.append((a, b, run))
        before = end
        mark = _MARK.search(text, end)
    return out


NAMES = ("bias", "at", "dots1", "dots3", "plus", "bracket", "dash", "letters", "digits1-2", "digits3", "digits4", "digits5-8", "digits9-12",
         "digits13-19", "digits20+", "luhn", "octets", "domain", "first", "after letters", "hex", "quote")


def features(text: str, start: int, end: int, first: bool) -> list[int]:
    """Numbers of the features of a token that are set."""
    token = text[start:end]
    digits = "".join(c for c in token if "0" <= c <= "9")
    n, dots = len(digits), token.count(".")
    plain = all(c.isdigit() or c in "-" for c in token)
    flags = (
        True, "@" in token, dots == 1, dots == 3, token[0] == "+", "(" in token, "-" in token, any(c.isalpha() for c in token), 1 <= n <= 2,
        n == 3, n == 4, 5 <= n <= 8, 9 <= n <= 12, 13 <= n <= 19, n > 19, plain and 13 <= n <= 19 and luhn(digits),
        dots == 3 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in token.split(".")),
        "@" in token and _DOMAIN.fullmatch(token, token.rfind("@") + 1) is not None, first,
        start > 0 and text[start - 1].isalpha(), n > 3 and n < len(token) and re.fullmatch("[0-9a-fA-F]+", token) is not None, '"' in token)
    return [k for k, flag in enumerate(flags) if flag]


@dataclass
class Graph:
    """Tokens of some documents: feature matrix, chain pairs, skip pairs, and where each token is."""

    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    places: list[tuple[int, int, int]]


def graph_of(texts: list[str]) -> Graph:
    rows, chain, skip, places = [], [], [], []
    for number, text in enumerate(texts):
        seen: dict[str, int] = {}
        before = None
        for start, end, run in tokens_of(text):
            node = len(rows)
            first = before is None or before[0] != run
            row = np.zeros(len(NAMES))
            row[features(text, start, end, first)] = 1.0
            rows.append(row)
            places.append((number, start, end))
            if not first:
                chain.append((before[1], node))
            before = (run, node)
            # Similar tokens: equal once case and punctuation are gone.
            same = "".join(c for c in text[start:end].lower() if c.isalnum() or c == "@")
            if len(same) >= SHORTEST:
                if same in seen:
                    skip.append((seen[same], node))
                seen[same] = node
    as_pairs = lambda pairs: np.array(pairs, np.int64).reshape(-1, 2)
    return Graph(np.array(rows).reshape(-1, len(NAMES)), as_pairs(chain), as_pairs(skip), places)


def base_labels(graph: Graph, texts: list[str]) -> np.ndarray:
    """Labels that the base spans give the tokens; a token may stick out by punctuation only."""
    spans = [base_spans(t) for t in texts]
    labels = np.zeros(len(graph.places), np.int64)
    for node, (number, start, end) in enumerate(graph.places):
        for kind, found in enumerate(spans[number]):
            for a, b in found:
                if a < end and start < b:
                    labels[node] = 1 + 2 * kind + (start > a)
    return labels


@dataclass(frozen=True)
class Field:
    """Log potentials: ``unary`` [feature, label], ``chain`` [label, label], ``skip`` [label, label] (symmetric)."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy belief propagation, all messages at once, over chain and skip edges alike."""
        size = len(graph.x)
        score = graph.x @ self.unary
        if not size or not len(graph.chain) + len(graph.skip):
            return _normal(score)
        source = np.concatenate([graph.chain[:, 0], graph.chain[:, 1], graph.skip[:, 0], graph.skip[:, 1]])
        target = np.concatenate([graph.chain[:, 1], graph.chain[:, 0], graph.skip[:, 1], graph.skip[:, 0]])
        c, s = len(graph.chain), len(graph.skip)
        back = np.concatenate([np.arange(c) + c, np.arange(c), np.arange(s) + 2 * c + s, np.arange(s) + 2 * c])
        parts = [(slice(0, c), np.exp(self.chain)), (slice(c, 2 * c), np.exp(self.chain.T)), (slice(2 * c, None), np.exp(self.skip))]
        message = np.full((len(source), LABELS), 1.0 / LABELS)
        for _ in range(rounds):
            logs = np.log(message)
            belief = score.copy()
            np.add.at(belief, target, logs)
            cavity = _normal(belief[source] - logs[back])
            new = np.concatenate([cavity[rows] @ weight for rows, weight in parts])
            message = 0.5 * message + 0.5 * np.maximum(new / new.sum(1, keepdims=True), 1e-12)
        belief = score.copy()
        np.add.at(belief, target, np.log(message))
        return _normal(belief)


def _normal(logs: np.ndarray) -> np.ndarray:
    e = np.exp(logs - logs.max(1, keepdims=True)) if len(logs) else logs
    return e / e.sum(1, keepdims=True) if len(e) else e


def fit(texts: list[str]) -> Field:
    """Pseudo-likelihood: each token's label given its features and its neighbours' labels, by Adam steps."""
    graph = graph_of(texts)
    labels = base_labels(graph, texts)
    hot = np.eye(LABELS)[labels].reshape(-1, LABELS)
    n = len(labels)
    before, after, alike = np.zeros((n, LABELS)), np.zeros((n, LABELS)), np.zeros((n, LABELS))
    np.add.at(before, graph.chain[:, 1], hot[graph.chain[:, 0]])
    np.add.at(after, graph.chain[:, 0], hot[graph.chain[:, 1]])
    np.add.at(alike, graph.skip[:, 1], hot[graph.skip[:, 0]])
    np.add.at(alike, graph.skip[:, 0], hot[graph.skip[:, 1]])
    weights = [np.zeros((len(NAMES), LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1 if n else 1):
        unary, chain, skip = weights
        p = _normal(graph.x @ unary + before @ chain + after @ chain.T + alike @ skip)
        error = (p - hot) / n
        slopes = [graph.x.T @ error + RIDGE * unary, before.T @ error + error.T @ after + RIDGE * chain, alike.T @ error + RIDGE * skip]
        slopes[2] = (slopes[2] + slopes[2].T) / 2
        for k, slope in enumerate(slopes):
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.999 * second[k] + 0.001 * slope * slope
            weights[k] = weights[k] - RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Field(*weights)


def added_spans(texts: list[str], field: Field, base: list[list[list[tuple[int, int]]]]) -> list[list[list[tuple[int, int]]]]:
    """For each text and kind the confident spans that touch no base span of any kind."""
    out = [[[], [], [], []] for _ in texts]
    graph = graph_of(texts)
    if not len(graph.places):
        return out
    marginals = field.marginals(graph)
    best, sure = marginals.argmax(1), marginals.max(1)
    follows = {int(b): int(a) for a, b in graph.chain}
    open_spans: dict[int, list] = {}
    for node, (number, start, end) in enumerate(graph.places):
        if not best[node] or sure[node] < CONFIDENCE:
            continue
        kind, inside = divmod(int(best[node]) - 1, 2)
        before = open_spans.get(follows.get(node, -1))
        if inside and before is not None and before[0] == kind:
            before[3] = end
            open_spans[node] = before
        elif not inside:
            open_spans[node] = [kind, number, start, end]
    done = {id(s): s for s in open_spans.values()}
    for kind, number, start, end in done.values():
        if not any(a < end and start < b for found in base[number] for a, b in found):
            out[number][kind].append((start, end))
    return out


def written(spans: list[list[tuple[int, int]]]) -> str:
    return ",".join(f"{name}:{a}:{b}" for name, found in zip(KINDS, spans) for a, b in sorted(found))


def trained(docs: DataFrame, rows: int = FIT_ROWS) -> Field:
    """A field fitted to at most ``rows`` documents that hold a digit or an at sign, in a fixed pseudo-random choice."""
    chosen = docs.where(text_of().rlike("[0-9@]")).select("doc_id").where("doc_id is not null").distinct()
    chosen = chosen.orderBy(F.xxhash64(F.lit(5), F.col("doc_id")), "doc_id").limit(rows)
    # The hint is safe: at most ``rows`` numbers.
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    return fit([r[1] for r in sorted(sample.collect(), key=lambda r: r[0])])


def span_column(spark: SparkSession, field: Field, text: str = "text") -> Column:
    """Struct of the base counts, the digest of the base spans, all spans, and the text with all spans masked."""
    shared = spark.sparkContext.broadcast(field)  # a few hundred weights

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, masked string")
    def spans(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for some in texts:
            some = list(some)
            base = [base_spans(t) for t in some]
            more = added_spans(some, shared.value, base)
            rows = []
            for text, fixed, extra in zip(some, base, more):
                every = [a + b for a, b in zip(fixed, extra)]
                rows.append((*map(len, fixed), hashlib.sha256(written(fixed).encode()).hexdigest(), written(every), mask(text, every)))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "masked"])

    return spans(text_of(text))


def mask(text: str, spans: list[list[tuple[int, int]]]) -> str | None:
    """The text with ``[KIND]`` for every span; overlapping spans are masked once. None: nothing to mask."""
    flat = sorted((a, -b, name) for name, found in zip(KINDS, spans) for a, b in found)
    if not flat:
        return None
    out, at = [], 0
    for a, b, name in flat:
        if a >= at:
            out += [text[at:a], f"[{name.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """All documents with their spans masked in ``text``, ``n_chars`` (where it is there) counted anew for these."""
    found = docs.withColumn("__masked", span_column(docs.sparkSession, trained(docs))["masked"])
    changed = {"text": F.coalesce("__masked", "text"), "n_chars": F.when(F.col("__masked").isNull(), F.col("n_chars")).otherwise(F.length("__masked"))}
    changed = {c: changed[c].alias(c) for c in changed if c in docs.columns}
    return found.select(*[changed.get(c, F.col(f"`{c}`")) for c in docs.columns])


def op5_pii(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory)
    found = docs.select("doc_id", span_column(spark, trained(docs)).alias("s"))
    return found.select("doc_id", *[f"s.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")])


QUERIES = {"op5_pii": op5_pii}
