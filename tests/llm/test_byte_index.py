"""Fingerprints and their links against plain versions over all pairs."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from runlens.llm import byte_index_dedup as bi


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=2):
    """Smallest member of each value's component, over all pairs."""
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    values = list(root)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def signed(v):
    return v - 2**64 if v >> 63 else v


def cluster(rng, size, spread):
    centre = rng.getrandbits(64)
    out = {centre}
    while len(out) < size:
        v = rng.choice(sorted(out)) if rng.random() < 0.5 else centre
        for b in rng.sample(range(64), rng.randint(1, spread)):
            v ^= 1 << b
        out.add(v)
    return out


@pytest.mark.parametrize("radius", [1, 2])
def test_components_of_random_fingerprints(spark, radius):
    rng = random.Random(radius)
    values = {rng.getrandbits(64) for _ in range(200)} | {0, 2**64 - 1, 2**63, 1}
    for _ in range(8):
        values |= cluster(rng, 40, 4)
    centre = rng.getrandbits(64)
    # A long list: many fingerprints that differ in one byte only.
    values |= {centre ^ (k << 16) for k in rng.sample(range(256), 120)}
    index = bi.ByteIndex(radius=radius)
    bits = spark.createDataFrame([(signed(v),) for v in values], "bits long").repartition(3)
    company = bi.with_company(bits, index)
    found = {(r["a"] % 2**64, r["b"] % 2**64) for r in bi.links(company, index).collect()}
    assert all(1 <= (a ^ b).bit_count() <= radius for a, b in found)
    assert plain_links(values, found) == plain_components(values, radius)


def plain_links(values, links):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {v: find(v) for v in values}


def test_every_pair_meets_in_a_list():
    for radius in (1, 2, 3):
        for spoilt in [set(c) for r in range(radius + 1) for c in itertools.combinations(range(8), r)]:
            assert any(not spoilt & set(c) for c in bi.fine_choices(radius))
            assert any(not spoilt & set(c) for c in bi.coarse_choices(radius))
    assert len(bi.coarse_choices(2)) == 6 and len(bi.fine_choices(2)) == 28


def test_lists_cut_by_batches(spark):
    """A list that spans Arrow batches stays whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        values = {5 ^ (k << 8) for k in range(100)} | {1 << b for b in range(64)}
        bits = spark.createDataFrame([(signed(v),) for v in values], "bits long")
        found = {(r["a"] % 2**64, r["b"] % 2**64) for r in bi.links(bits).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plain_links(values, found) == plain_components(values)


def plain_rows(pairs):
    prints = [(i, plain_fingerprint(t)) for i, t in pairs]
    of = plain_components({f for _, f in prints})
    least = {}
    for i, f in prints:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    return [(i, f"{f:016x}", least.get(of[f])) for i, f in prints]


def by_text(rows):
    return sorted(map(tuple, rows), key=str)


def test_odd_rows(spark, frame, odd_pairs):
    rng = random.Random(6)
    base = "the house walks under the old bright window while morning light falls on quiet road and winter garden again".split()
    pairs = list(odd_pairs)
    for i in range(60):
        words = base * 6
        words[rng.randrange(len(words))] = "other"
        pairs.append((50 + i, " ".join(words)))
    pairs = [(i, None if t is None else t[:60_000]) for i, t in pairs]
    got = bi.near_duplicates(frame(pairs))
    assert by_text(got.collect()) == by_text(plain_rows(pairs))
    assert bi.near_duplicates(frame(pairs).limit(0)).count() == 0
    alone = frame([(None, "one two three four"), (None, None)])
    assert {r["component_id"] for r in bi.near_duplicates(alone).collect()} == {None}


def test_the_smallest_table(spark, corpus):
    from runlens.llm.queries import op13_byte_index_dedup

    assert by_text(op13_byte_index_dedup(spark, "/root/testdata/sf0.001").collect()) == by_text(plain_rows(corpus[0]))


def test_votes_of_many_shingles():
    words = [b"w%d" % (k % 977) for k in range(150_000)]
    text = b" ".join(words)
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)], np.uint64)
    expected = sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))
    assert bi.fingerprint_of(text, bi.ByteIndex()) == expected
