"""Near-duplicates, fingerprints, secrets, rules and sharding against plain versions on small tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from runlens.llm import components, guess_cost, minhash_dedup, quality_rules, queries, range_sharding, secret_scan, simhash
from runlens.llm.common import WordHashes
from .conftest import prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_sets(pairs, n):
    out = []
    for i, t in pairs:
        w = WORD.findall(lower(t))
        k = min(n, len(w))
        out.append((i, frozenset(tuple(w[a : a + k]) for a in range(len(w) - k + 1)) if w else frozenset()))
    return out


def plain_components(sets, percent=80):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for a, (i, s) in enumerate(sets):
        least[find(a)].append(i)
    return [(i, len(s), min((x for x in least[find(a)] if x is not None), default=None)) for a, (i, s) in enumerate(sets)]


def near_copies():
    rng = random.Random(9)
    pairs, n = [], 0

    def add(t):
        nonlocal n
        pairs.append((n, t))
        n += 1

    shared = prose(rng, 120)
    for _ in range(40):  # a shared passage in different texts
        add(prose(rng, 150) + " " + shared)
    for _ in range(12):
        base = prose(rng, 200).split()
        for _ in range(8):
            w = list(base)
            for at in rng.sample(range(200), rng.choice([1, 2, 4, 6, 9, 12])):
                w[at] = "new" + str(rng.randint(0, 999))
            add(" ".join(w))
    base = prose(rng, 300).split()
    for _ in range(60):  # a chain: each a little further away
        base[rng.randrange(300)] = "step" + str(n)
        base[rng.randrange(300)] = "step" + str(n)
        add(" ".join(base))
    for _ in range(30):
        add("exactly the same words in each of these")
    add("short one")
    add("Short ONE")
    rng.shuffle(pairs)
    return pairs


def compare_dedup(frame, pairs, words):
    got = minhash_dedup.near_duplicates(frame(pairs), minhash_dedup.NearDup(words=words)).collect()
    want = plain_components(shingle_sets(pairs, words))
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None) == sorted(
        w for w in want if w[0] is not None
    )
    assert len(got) == len(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates(frame):
    compare_dedup(frame, near_copies(), 4)


def test_near_duplicates_of_odd_rows(frame, odd_pairs):
    compare_dedup(frame, odd_pairs, 4)
    assert minhash_dedup.near_duplicates(frame([])).count() == 0
    assert minhash_dedup.near_duplicates(frame([(1, None), (2, "")])).where("kept").count() == 2


def test_many_outsiders_share_a_bucket(frame):
    """With one-row bands every text that shares a passage meets in a few buckets; all pairs must still be compared."""
    rng = random.Random(4)
    shared = prose(rng, 100)
    pairs = [(i, shared + " " + prose(rng, 80)) for i in range(60)]
    pairs += [(100 + i, t + " more") for i, t in pairs[40:]]
    s = minhash_dedup.NearDup(words=4, rows=1, bands=112)
    got = minhash_dedup.near_duplicates(frame(pairs), s).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(plain_components(shingle_sets(pairs, 4)))


def test_packed_signatures_estimate_similarity(spark):
    from pyspark.sql import functions as F

    s = minhash_dedup.NearDup()
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, s.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, s.minima, dtype=np.uint64)
    items = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for common in (0, 1000, 1800, 2000):
        x, y = items[:2000], np.concatenate([items[:common], items[2000 : 4000 - common]])[:2000]
        truth = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        low = [minhash_dedup.mix64(minhash_dedup.min_values(np.unique(v), a, b)) & np.uint64(15) for v in (x, y)]
        p = [minhash_dedup.pack(v, s.bits, s.longs).view(np.int64).tolist() for v in low]
        equal = int((low[0] == low[1]).sum())
        row = spark.createDataFrame([p], "x array<long>, y array<long>").select(minhash_dedup.estimate(F.col("x"), F.col("y"), s).alias("e")).first()
        assert row["e"] == pytest.approx((equal / s.minima - 1 / 16) / (15 / 16))
        assert abs(row["e"] - truth) < 0.2


def test_components(spark):
    rng = random.Random(5)
    links = [(a, a + 1) for a in range(0, 60)] + [(100, 100 + i) for i in range(50)] + [(300, 300), (7, 7)]
    links += [(rng.randint(400, 460), rng.randint(400, 460)) for _ in range(40)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    rng.shuffle(links)
    got = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for e in links for x in e if e[0] != e[1]}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash(frame, odd_pairs, corpus):
    rows = {}
    for pairs in (odd_pairs, corpus[0]):
        got = simhash.compare_successors(frame(pairs)).collect()
        assert len(got) == len(pairs)
        if pairs is odd_pairs:
            assert {r["fingerprint"] for r in got if r["n_chars"] == 0} == {"0" * 32}
            continue
        rows = {r["doc_id"]: r for r in got}
    texts = [t for _, t in corpus[0]]
    hashes = WordHashes()
    for i, (doc, text) in enumerate(corpus[0]):
        after = texts[(i + 1) % len(texts)]
        n = len(text) // 4
        changed = text[: len(text) - n] + after[:n]
        r = rows[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == simhash.fingerprint(text.encode(), hashes).hex()
        assert r["edited_fingerprint"] == simhash.fingerprint(changed.encode(), hashes).hex()
        assert r["near_next"] == simhash.likeness(bytes.fromhex(r["fingerprint"]), simhash.fingerprint(after.encode(), hashes))
    long = [r for r in rows.values() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] for r in long]) > np.mean([r["near_next"] for r in long]) + 0.3
    one = simhash.compare_successors(frame([(5, "alone in the table")])).first()
    assert one["near_next"] == 1.0
    assert simhash.compare_successors(frame([])).count() == 0


def test_fingerprints_within_radius(spark):
    rng = random.Random(8)
    prints = []
    for _ in range(40):
        base = rng.getrandbits(128)
        for _ in range(5):
            x = base
            for b in rng.sample(range(128), rng.randint(0, 4)):
                x ^= 1 << b
            prints.append(f"{x:032x}")
    prints += prints[:10]
    got = simhash.within_radius(
        spark.createDataFrame([(p,) for p in prints], "fingerprint string"), spark.createDataFrame([(p,) for p in prints[::7]], "fingerprint string"),
    ).collect()
    want = {q: sum((int(q, 16) ^ int(p, 16)).bit_count() <= 3 for p in prints) for q in prints[::7]}
    assert {r["fingerprint"]: r["n_within"] for r in got} == want


def test_near_copies_are_found(spark, tmp_path):
    rng = random.Random(21)
    docs, twins = [], {}
    for i in range(0, 600, 50):
        words = [f"w{rng.randint(0, 5000)}" for _ in range(100)]
        docs.append((i, " ".join(words)))
        for k in (1, 2):  # two and four of 99 pairs changed
            words[20 * k] = f"new{i}"
            docs.append((i + k, " ".join(words)))
        docs.append((i + 3, docs[-1][1]))
        twins[i] = [i, i + 1, i + 2, i + 3]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op6_simhash(spark, str(tmp_path)).collect()}
    assert len(got) == len(docs)
    prints = {d: int(r["fingerprint"], 16) for d, r in got.items()}
    for d, r in got.items():
        if d % 50:
            assert r["within"] is None and r["n_within"] is None
            continue
        close = [x for x in prints if (prints[d] ^ prints[x]).bit_count() <= 32]
        assert r["within"] == sorted({got[x]["fingerprint"] for x in close}) and r["n_within"] == len(close)
        assert set(twins[d]) <= {x for x in got if got[x]["fingerprint"] in r["within"]}


def test_block_radii_reach_the_radius():
    for radius in (0, 3, 7, 23, 32, 128):
        radii = simhash.block_radii(radius)
        assert len(radii) == 8 and sum(r + 1 for r in radii) == radius + 1 and max(radii) - min(radii) <= 1
    assert [len(simhash.masks(16, r)) for r in (-1, 0, 1, 3)] == [0, 1, 17, 697]


def test_search_in_small_blocks(spark):
    rng = random.Random(22)
    base = [rng.getrandbits(128) for _ in range(12)]
    prints = [f"{x ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 30))):032x}" for x in base for _ in range(20)]
    got = simhash.within_radius(
        spark.createDataFrame([(p,) for p in prints], "fingerprint string"), spark.createDataFrame([(p,) for p in prints[::3]], "fingerprint string"),
        simhash.Search(radius=32, classes=10, queries=5),
    ).collect()
    want = {q: sorted({p for p in prints if (int(q, 16) ^ int(p, 16)).bit_count() <= 32}) for q in prints[::3]}
    assert {r["fingerprint"]: r["within"] for r in got} == want


SECRETS = [
    'token = "2abc3ff2ca8fb1e4c565a0eb" and', "API_KEY: 'Zz9+/_=.-' PASSWORD:short", "passwd=abcde token:abcdef", "AKIA" + "B7" * 8 + " AKIAXX",
    "deadbeef" * 3, "é日 secret= x.y-z_w=1 🙂 token=token=abcdefg", "ſecret=abcdefgh toKen=abcdefgh", "token=token:abcdefg", None, "",
]


def plain_spans(text):
    """The contract's patterns, applied as they are written."""
    found = []
    kinds = (
        ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+"),
    )
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= (6, 20, 24)[k]:
                found.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


def test_secrets(frame, odd_pairs, corpus):
    pairs = list(enumerate(SECRETS)) + [(100 + i, t) for i, t in corpus[0]] + [(900 + n, t) for n, (_, t) in enumerate(odd_pairs)]
    got = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.scan(frame(pairs), queries.scanner())).collect()}
    for i, t in pairs:
        spans = plain_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("password")] == spans
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex"))
    assert secret_scan.scan(frame([]), queries.scanner()).count() == 0


def test_guess_costs_and_context():
    s = queries.scanner()
    cost = {v: secret_scan.guess_cost(v, s) for v in ("password", "aaaaaaaaaaaa", "qwertyuiop", "1987-03-12", "house2009", "abcabcabcabc", "xK9#vQ2!mZ7w", "")}
    assert cost[""] == 0 and cost["xK9#vQ2!mZ7w"] > 12
    assert all(v < 9 for k, v in cost.items() if k != "xK9#vQ2!mZ7w")
    kinds = [f[0] for f in secret_scan.spans_of(b"my pwd: xK9#vQ2!mZ7w and the password is required, passphrase is House", s)]
    assert kinds == ["password"]
    assert secret_scan.redacted(b"my pwd: xK9#vQ2!mZ7w; token=abcdefgh.", s) == b"my pwd: [REDACTED]; token=[REDACTED]"
    assert secret_scan.redacted("nothing à voir".encode(), s) == "nothing à voir".encode()


def test_whole_values_are_secret():
    s = queries.scanner()
    run = b"0123456789abcdef01234567"
    for text, value, clean in (
        (b"my password: hunter2!$xyz, ok", b"hunter2!$xyz", b"my password: [REDACTED], ok"),
        (b"password: hunter2!$ ok", b"hunter2!$", b"password: [REDACTED] ok"),  # cheap, yet half of it is a secret already
        (b"pwd: xK9#vQ" + run + b"!mZ7w end", b"xK9#vQ" + run + b"!mZ7w", b"pwd: [REDACTED] end"),
    ):
        spans = secret_scan.spans_of(text, s)
        assert len(spans) == 2 and [text[f[3] : f[4]] for f in spans if f[0] == "password"] == [value]
        assert secret_scan.redacted(text, s) == clean
    assert [f[0] for f in secret_scan.spans_of(b"password: abcdefgh. And token=" + run + b".", s)] == ["assign", "assign", "hex"]


def plain_repetitions(text):
    """All maximal stretches with their smallest period, which they hold twice or more."""
    out = set()
    for a in range(len(text)):
        for b in range(a + 2, len(text) + 1):
            p = next(p for p in range(1, b - a + 1) if all(text[k] == text[k + p] for k in range(a, b - p)))
            if b - a >= 2 * p and (a == 0 or text[a - 1] != text[a - 1 + p]) and (b == len(text) or text[b] != text[b - p]):
                out.add((a, b, p))
    return sorted(out)


def plain_cost(value, ranks, charge):
    """The least over all cuts of a short value, each part costing the least of its five readings."""
    low, n = value.lower(), len(value)

    def brute(part):
        return sum(map(guess_cost.character_cost, part))

    def part_cost(a, b):
        part, costs = value[a:b], [brute(value[a:b])]
        if len(part) >= 3:
            costs.append(guess_cost.word_cost(part, ranks))
            if all(guess_cost.is_step(low[k], low[k + 1]) for k in range(a, b - 1)):
                costs.append(np.log10(47) + 0.3 + np.log10(b - a))
        for form in (r"YYYY-?MM-?DD", r"DD-?MM-?YYYY", r"YYYY"):
            rule = form.replace("-", "[-/.]").replace("YYYY", "(19|20)[0-9]{2}").replace("MM", "(0[1-9]|1[0-2])").replace("DD", "(0[1-9]|[12][0-9]|3[01])")
            if re.fullmatch(rule, part):
                costs.append(np.log10(120 * (366 if "MM" in form else 1)))
        p = next((p for p in range(1, b - a) if (b - a) % p == 0 and low[a : b - p] == low[a + p : b]), None)
        if p and (p > 1 or b - a >= 3):
            left = a
            while left and low[left - 1] == low[left - 1 + p]:
                left -= 1
            unit = least(value[left : left + p]) + (np.log10(p) if (a - left) % p else 0)
            costs.append(min(unit, brute(low[a : a + p])) + np.log10((b - a) // p))
        return min(costs)

    def least(text):
        return plain_cost(text, ranks, charge) if text != value else INF

    INF, best = float("inf"), [0.0] + [float("inf")] * n
    for b in range(1, n + 1):
        best[b] = min(best[a] + (charge if a else 0) + part_cost(a, b) for a in range(b))
    return best[n]


def test_guess_cost_is_the_least():
    rng = random.Random(31)
    ranks = secret_scan.word_ranks(queries.scanner().words)
    few = {"aba": 3, "bab": 40, "was": 2, "ess": 9, "abab": 11, "qwe": 5000}
    values = ["treehouz", "zlamp", "kphouse", "mwinterk", "asdfghome", "Was1999", "x0x0x0", "19990101", "0101199", "p@ssP@ss", "aaaaaa", "İab", ""]
    for letters in ("ab", "aB0", "qwes", "1290", "abs1@q", "19/02"):
        values += ["".join(rng.choices(letters, k=rng.randint(1, 10))) for _ in range(150)]
    for value in values:
        for words in (few, ranks):
            assert guess_cost.guess_cost(value, words, 0.7) == pytest.approx(plain_cost(value, words, 0.7)), value


def test_repetitions_of_values():
    rng = random.Random(32)
    for letters in ("a", "ab", "abc"):
        for _ in range(120):
            text = "".join(rng.choices(letters, k=rng.randint(0, 24)))
            assert guess_cost.repetitions(text) == plain_repetitions(text), text


def test_long_repeats_are_cheap():
    s = queries.scanner()
    assert secret_scan.guess_cost("x0" * 1000, s) == pytest.approx(guess_cost.character_cost("x") + 1 + 3)
    assert secret_scan.guess_cost("changeme!" * 20, s) == pytest.approx(secret_scan.guess_cost("changeme!", s) + np.log10(20))
    assert secret_scan.spans_of(b"passphrase is " + b"winter-" * 20, s) == []
    assert secret_scan.guess_cost("a" * 50_000, s) < 7
    mixed = "".join(random.Random(33).choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=20_000))
    assert 20_000 < secret_scan.guess_cost(mixed, s) <= sum(map(guess_cost.character_cost, mixed))


def plain_rules(text):
    text = text or ""
    w = WORD.findall(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_quality_rules(spark, frame, odd_pairs, corpus):
    docs, labels = corpus
    table = frame(docs)
    model = quality_rules.fit(table, spark.createDataFrame(labels, "doc_id long, quality int"))
    for pairs in (docs, odd_pairs):
        got = quality_rules.apply_rules(frame(pairs), model).collect()
        counts = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got]
        assert sorted(counts, key=str) == sorted([(i, *plain_rules(t)) for i, t in pairs], key=str)
        for r in got:
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert r["kept"] == (not r["base_failed"] and r["log_ratio"] >= model.threshold)
    quality = dict(labels)
    assert model.threshold <= -0.1
    verdict = [(quality[r["doc_id"]], r["kept"]) for r in quality_rules.apply_rules(table, model).collect() if r["doc_id"] in quality and not r["base_failed"]]
    assert np.mean([q == k for q, k in verdict]) > 0.95
    # The scores follow from counts over every document, by the formula.
    n, bits = 4, quality_rules.Rules().bits
    raw = sum(np.bincount(quality_rules.ngram_buckets((t or "").encode(), n, bits), minlength=1 << bits) for _, t in docs)
    good = sum(np.bincount(quality_rules.ngram_buckets((t or "").encode(), n, bits), minlength=1 << bits) for i, t in docs if quality.get(i) == 1)
    assert np.allclose(model.log_ratio, np.log((good + 2) / (raw * (good.sum() / raw.sum()) + 2)), atol=1e-6)
    for i, t in docs[:20]:
        r = quality_rules.apply_rules(frame([(i, t)]), model).first()
        assert r["log_ratio"] == pytest.approx(model.log_ratio[quality_rules.ngram_buckets(t.encode(), n, bits)].mean(), abs=1e-5)
        break
    nothing = quality_rules.fit(frame([]), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality_rules.apply_rules(frame([]), nothing).count() == 0


def check_shards(rows, pairs, shards):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in rows), key=str) == sorted(
        ((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs), key=str
    )
    slots, sizes = defaultdict(list), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    total, most = sum(sizes.values()), max((r["size"] for r in rows), default=0)
    assert all(abs(sizes[k] - total / shards) <= most for k in range(shards))


def test_sharding(frame, odd_pairs, corpus):
    for pairs in (odd_pairs, corpus[0]):
        check_shards(range_sharding.shard(frame(pairs)).collect(), pairs, 40)
    assert range_sharding.shard(frame([])).count() == 0


def test_overfull_ranges_are_split(frame):
    rng = random.Random(6)
    pairs = [(None, "the same row") for _ in range(700)] + [(i, "same text") for i in range(500)] + [(1000 + i, prose(rng, 20)) for i in range(800)]
    s = range_sharding.Sharding(shards=7, sample=512, ranges=16, range_rows=100)
    from runlens.llm.common import stored

    placed = stored(range_sharding.in_ranges(stored(range_sharding.records(frame(pairs), s)), s))
    assert placed.groupBy("range", "part").count().agg({"count": "max"}).first()[0] < 300
    order = placed.orderBy("range", "part", *range_sharding.KEY).select(*range_sharding.KEY).collect()
    assert order == sorted(order, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    check_shards(range_sharding.shard(frame(pairs), s).collect(), pairs, 7)
    rows = range_sharding.shard(frame(pairs), s).where("text_crc32 = " + str(zlib.crc32(b"same text"))).select("shard").distinct().count()
    assert rows <= 2  # equal texts lie side by side


def test_pairs_under_the_limit_do_not_meet_their_sets(spark):
    s = minhash_dedup.NearDup()
    rng = np.random.default_rng(4)
    sets, pairs = [], []
    for common in [100] * 40 + [120, 128, 134, 140]:
        x = rng.integers(0, 2**64, 150, dtype=np.uint64)
        y = np.concatenate([x[:common], rng.integers(0, 2**64, 150 - common, dtype=np.uint64)])
        pairs.append((len(sets), len(sets) + 1, common))
        sets += [np.unique(x), np.unique(y)]
    # Signatures that rule nothing out.
    rows = [(i, len(v), [0] * s.longs, minhash_dedup.parities(v, s.cells).tolist()) for i, v in enumerate(sets)]
    classes = spark.createDataFrame(rows, "id long, n_shingles long, packed array<long>, parity array<long>")
    got = minhash_dedup._likely(spark.createDataFrame([p[:2] for p in pairs], "a long, b long"), classes, s).collect()
    # 134 of 166 are more than 0.8; at 100 and 120 of 200 and 180 sets are never made again.
    assert sorted((r.a, r.b) for r in got) == [p[:2] for p in pairs if p[2] >= 134]


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for size in (1, 30, 3_000):
        x, y = (np.unique(rng.integers(0, 2 * size, size).astype(np.uint64)) for _ in range(2))
        unlike = np.bitwise_xor(minhash_dedup.parities(x, 1024), minhash_dedup.parities(y, 1024))
        assert np.unpackbits(unlike.view(np.uint8)).sum() <= len(np.setxor1d(x, y))


def test_pairs_that_meet_in_buckets_are_compared_there(spark):
    """Of texts that share a bucket, those that parities or signatures rule out make no row of the join."""
    s = minhash_dedup.NearDup()
    rng = np.random.default_rng(6)
    whole = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [whole] + [np.concatenate([whole[: 300 - k], rng.integers(0, 2**64, k, dtype=np.uint64)]) for k in (10, 20, 90, 120, 150)]
    clear = [0] * s.longs
    rows = [(i, len(v), clear, minhash_dedup.parities(np.unique(v), s.cells).tolist(), [7, 8 + i]) for i, v in enumerate(sets)]
    rows.append((9, 300, [-1] * s.longs, rows[0][3], [7]))  # all minima differ from those of the others
    classes = spark.createDataFrame(rows, "id long, n_shingles long, packed array<long>, parity array<long>, bands array<long>")
    state = classes.selectExpr("7L key", "id", "-1L first", "false used", "n_shingles", "n_shingles most", "1L weight", "id part", "-1L main")
    pivots = state.where("id = 0").selectExpr("key", "id p_id", "part p_part", "n_shingles p_n", "most p_most")
    got = minhash_dedup._pairs(state, pivots, classes, s).collect()
    assert sorted(map(tuple, got)) == [(0, 1), (0, 2)]


def test_rounds_look_at_waiting_classes_only(frame, monkeypatch):
    """Signatures of texts that meet nobody are not joined again in each round."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    base = [word() for _ in range(120)]
    # Alike enough to share buckets, not enough to be linked.
    near = [[word() if rng.random() < 0.04 else w for w in base] for _ in range(10)]
    docs = [(i, " ".join(t)) for i, t in enumerate(near)] + [(100 + i, " ".join(word() for _ in range(30))) for i in range(60)]
    looked, pairs = [], minhash_dedup._pairs
    monkeypatch.setattr(minhash_dedup, "_pairs", lambda rows, pivots, classes, s: looked.append(classes.count()) or pairs(rows, pivots, classes, s))
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(frame(docs), minhash_dedup.NearDup()).collect()}
    assert looked and max(looked) <= len(near)
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    assert all(got[i] <= j for i in got for j in got if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]))


def test_classes_of_a_bitmap(spark):
    s = minhash_dedup.NearDup()
    classes = spark.range(1_000).selectExpr("id", "array(id, id + 1) AS bands", "id * 2 AS n_shingles")
    for some in ([3, 500, 999, 3, None], []):
        got = minhash_dedup._those(classes, spark.createDataFrame([(x,) for x in some], "id long"), s)
        assert got.columns == classes.columns
        rows = {r["id"]: (r["bands"], r["n_shingles"]) for r in got.collect()}
        assert {x for x in some if x is not None} <= rows.keys() and len(rows) < 20
        assert all(v == ([k, k + 1], 2 * k) for k, v in rows.items())
    full = minhash_dedup._those(classes, classes, minhash_dedup.NearDup(filter_bits=7))
    assert full.count() == 1_000
