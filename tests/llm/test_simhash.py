import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from radiokpi.llm import simhash
from radiokpi.llm.common import components


def plain(text):
    from xxhash import xxh64_intdigest
    import re

    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(values):
    """Smallest reachable position within two bits."""
    group = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2 and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    return group


def test_fingerprints(docs, awkward):
    frame = docs([t if isinstance(t, tuple) else (k, t, "s") for k, t in enumerate(awkward)])
    got = sorted(r["fp"] & (2 ** 64 - 1) for r in simhash.fingerprints(frame).collect())
    assert got == sorted(plain(t[1] if isinstance(t, tuple) else t) for t in awkward)


def noisy(rng, centres, each, flips):
    out = set()
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(each):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, flips)):
                value ^= 1 << bit
            out.add(value)
    return sorted(out)


@pytest.mark.parametrize("centres, each, flips", [(30, 8, 3), (2, 150, 2), (1, 300, 4)])
def test_links_against_all_pairs(spark, centres, each, flips):
    values = noisy(random.Random(centres), centres, each, flips)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    links = simhash.links(frame).collect()
    at = {v: k for k, v in enumerate(values)}
    group = list(range(len(values)))
    for a, b in ((at[x & (2 ** 64 - 1)], at[y & (2 ** 64 - 1)]) for x, y in links):
        assert (values[a] ^ values[b]).bit_count() <= 64
        low, high = sorted((group[a], group[b]))
        group = [low if g == high else g for g in group]
    assert group == classes(values)


def test_long_buckets_are_found_by_planes():
    rng = np.random.default_rng(1)
    bits = list(range(22))
    values = np.unique(rng.integers(0, 1 << 22, 500).astype(np.uint64))
    child, parent = simhash._long_run(values, bits)
    group = list(range(len(values)))
    for a, b in zip(child, parent):
        low, high = sorted((group[a], group[b]))
        group = [low if g == high else g for g in group]
    assert group == classes([int(v) for v in values])


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_and_what_stays(docs, awkward):
    rng = random.Random(2)
    base = [t for t in awkward if isinstance(t, str)][:20]
    texts = [*awkward, *[t + " " + rng.choice("abc") for t in base]]
    texts = [t if isinstance(t, tuple) else (1000 + k, t, "s") for k, t in enumerate(texts)]
    named = [t for t in texts if t[0] is not None]
    got = simhash.near_duplicates(docs(texts)).where("doc_id is not null").collect()
    assert len(got) == len(named)
    ids = [t[0] for t in named]
    prints = [plain(t[1]) for t in named]
    group = classes(prints)
    expected = {ids[k]: min(ids[j] for j in range(len(ids)) if group[j] == group[k]) for k in range(len(ids))}
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    frame = docs(texts)
    kept = simhash.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.where(F.col("doc_id").isNotNull()).collect()) == sorted(set(expected.values()))
    assert simhash.near_duplicates(docs([])).count() == 0
