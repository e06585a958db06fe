import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from radiokpi.llm import packing


def check_places(rows, capacity):
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_round_trip_through_the_tokenizer(docs, awkward):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    texts = [*awkward, "It's WE'LL  don't!! 12,5 ªµß İstanbul ΣΑΣ", "é café\u0085x y", "x" * 300 + " y"]
    frame = docs([t if isinstance(t, tuple) else (200 + k, t, "s") for k, t in enumerate(texts)])
    expected = Counter()
    for k, t in enumerate(texts):
        doc_id, text = (t[0], t[1]) if isinstance(t, tuple) else (200 + k, t)
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            expected[doc_id, piece, at, len(ids[at:at + 2048]), zlib.crc32(ids[at:at + 2048].tobytes())] += 1
    rows = packing.packed(frame).collect()
    assert Counter(tuple(r)[:5] for r in rows) == expected
    check_places(rows, 2048)


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_length_once_and_packs_tightly(seed):
    rng = np.random.default_rng(seed)
    lengths = np.clip(rng.lognormal(3.5, 1.2, 5000).astype(int) + 1, 1, 256)
    counts = Counter(lengths.tolist())
    rows = packing.plan(counts, 256)
    got = Counter()
    for length, first, ranks, *_ in rows:
        assert first == got[length]
        got[int(length)] += int(ranks)
    assert got == counts
    bins = defaultdict(int)
    for length, _, ranks, sequence, each, _ in rows:
        for i in range(ranks):
            bins[sequence + i // each] += length
    assert max(bins.values()) <= 256
    assert len(bins) <= 1.01 * -(-lengths.sum() // 256) + 1


def test_patterns_fill_a_sequence():
    patterns = packing.full_patterns(np.array([2, 3, 5, 8, 10]), 10)
    assert {tuple(p) for p in patterns} == {(0, 0, 10), (0, 2, 8), (0, 5, 5), (2, 3, 5)}
    counts = np.zeros(11, np.int64)
    counts[[5, 2, 8, 3]] = [9, 4, 4, 1]
    taken = packing.repeat_counts(patterns, counts)
    used = sum(np.bincount(p[p > 0], minlength=11) * t for p, t in zip(patterns, taken))
    assert (used <= counts).all() and taken.sum() >= 6


def test_empty_table_and_hot_length(docs):
    assert packing.packed(docs([])).count() == 0
    rows = packing.packed(docs(["same words here"] * 500)).collect()
    assert check_places(rows, 2048) == -(-sum(r["length"] for r in rows) // (2048 // rows[0]["length"] * rows[0]["length"]))
