"""Runs against their definition, word by word."""

import hashlib
import random
import zlib

import pytest

from runlens.llm import periodic_runs as pr


def plain_runs(words, copies=4, least=6):
    """All (start, length, period): for each period, maximal stretches where words a period apart agree, kept if no smaller period fits."""
    n, found = len(words), []
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            stretch = words[i : j + q]
            smaller = any(stretch[d:] == stretch[:-d] for d in range(1, q))
            if len(stretch) >= max(least, copies * q) and not smaller:
                found.append((i, len(stretch), q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def random_words(rng):
    words = []
    while len(words) < rng.randint(5, 90):
        root = [rng.choice("abc") for _ in range(rng.randint(1, 6))]
        words += (root * rng.randint(1, 9))[: rng.randint(1, 60)]
    return words


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_random_words(seed):
    rng = random.Random(seed)
    for _ in range(150):
        words = random_words(rng)
        assert pr.runs_in([w.encode() for w in words], pr.Runs()) == plain_runs(words)
        assert pr.runs_of([ord(w) for w in words], pr.Runs(copies=3, least_words=2)) == plain_runs(words, 3, 2)


def test_common_extensions():
    rng = random.Random(1)
    letters = [rng.choice([1, 2]) for _ in range(120)]
    lce = pr.Extensions(*pr.SuffixTree(letters).tour())
    for i in range(120):
        for j in range(i + 1, 121):
            k = 0
            while j + k < 120 and letters[i + k] == letters[j + k]:
                k += 1
            import numpy as np

            assert lce(np.array([i]), np.array([j]))[0] == k


def test_leaves_are_in_both_orders():
    rng = random.Random(4)
    letters = [rng.choice([1, 2, 3]) for _ in range(60)]
    tree = pr.SuffixTree(letters)
    assert tree.tour()[0].tolist() == sorted(range(61), key=lambda i: letters[i:])
    assert tree.tour(descending=True)[0].tolist() == sorted(range(61), key=lambda i: [-x for x in letters[i:]])


def test_long_powers():
    assert pr.runs_in([b"x"] * 50_000, pr.Runs()) == [(0, 50_000, 1)]
    assert pr.runs_in([b"x", b"y", b"x"] * 5_000, pr.Runs()) == [(0, 15_000, 3)]


def test_odd_rows_and_planted_ends(spark, frame, odd_pairs):
    rng = random.Random(8)
    pairs = [p for p in odd_pairs if p[0] != 6] + [(100 + i, " ".join(random_words(rng))) for i in range(300)]
    got = pr.digest(pr.find_runs(pr.plant_repeats(frame(pairs)))).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted([plain_row(*p) for p in pairs], key=key)
    assert pr.digest(pr.find_runs(pr.plant_repeats(frame(pairs).limit(0)))).count() == 0


def test_the_smallest_table(spark, corpus):
    from runlens.llm.queries import op12_periodic_runs

    got = {r["doc_id"]: tuple(r) for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    short = [d for d in corpus[0] if len(d[1] or "") < 6000]
    assert len(got) == len(corpus[0]) and all(got[i] == plain_row(i, t) for i, t in short)
