"""Language model, classifier and pipeline: plain versions, held-out accuracy, kept rows."""

import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from runlens.llm import hmm_lm, minhash_dedup, quality_classifier, queries, secret_scan
from runlens.llm.common import crc_mod, give_back
from .test_documents import lower, plain_components, shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def remainder(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


SMALL = hmm_lm.Model(states=3, own=40, groups=16, known=60, parts=2)


def plain_base(pairs):
    train = Counter()
    for i, t in pairs:
        if remainder(i, 5) != 1:
            train.update(WORD.findall(lower(t)))
            train[None] += 1
    n, v = sum(train.values()), len(train)
    out = []
    for i, t in pairs:
        tokens = [*WORD.findall(lower(t)), None]
        score = sum(math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)
        out.append((i, remainder(i, 5) == 1, len(tokens), sum(train[w] > 0 for w in tokens), n, round(score, 5)))
    return out


@pytest.mark.parametrize("model", [SMALL, hmm_lm.Model(parts=2)])
def test_base_scores(frame, odd_pairs, corpus, model):
    for pairs in (odd_pairs, corpus[0]):
        got = hmm_lm.score(frame(pairs), model).collect()
        mine = [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got]
        want = plain_base(pairs)
        assert [x[:5] for x in sorted(mine, key=str)] == [x[:5] for x in sorted(want, key=str)]
        assert np.allclose([x[5] for x in sorted(mine, key=str)], [x[5] for x in sorted(want, key=str)], atol=1e-3, rtol=1e-9)
        assert all(r["score"] < 0 or r["n_tokens"] == 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_no_training_rows(frame):
    held = [(i, "a text") for i in range(60) if remainder(i, 5) == 1]
    got = hmm_lm.score(frame(held), SMALL).collect()
    assert len(got) == len(held) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in got)
    assert hmm_lm.score(frame([]), SMALL).count() == 0


def some_states(seed=3, k=3, symbols=5):
    rng = np.random.default_rng(seed)
    emit = rng.random((symbols, k))
    move = rng.random((k, k))
    start = rng.random(k)
    return hmm_lm.States(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def paths(row, s):
    """Every path of states with its probability."""
    for path in itertools.product(range(len(s.start)), repeat=len(row)):
        p = s.start[path[0]] * s.emit[row[0], path[0]]
        for a, b, x in zip(path, path[1:], row[1:]):
            p *= s.move[a, b] * s.emit[x, b]
        yield path, p


def test_recursions_equal_sums_over_paths():
    s = some_states()
    rows = [np.array(r, np.uint16) for r in ([4, 0, 1, 1, 2], [0, 3, 2, 4], [1, 1], [2])]
    counts = hmm_lm.States(np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)))
    total = hmm_lm.expected(rows, s, counts)
    want = hmm_lm.States(np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)))
    log = 0.0
    for row in rows:
        each = list(paths(row, s))
        p = sum(x for _, x in each)
        log += math.log(p)
        for path, x in each:
            want.start[path[0]] += x / p
            for a, b in zip(path, path[1:]):
                want.move[a, b] += x / p
            for state, symbol in zip(path, row):
                want.emit[symbol, state] += x / p
    assert total == pytest.approx(log)
    assert np.allclose(counts.start, want.start) and np.allclose(counts.move * s.move, want.move) and np.allclose(counts.emit, want.emit)
    table, active = hmm_lm.padded(rows)
    assert hmm_lm.forward(table, active, s, keep=False)[0].sum() == pytest.approx(log)


def test_steps_raise_the_likelihood(frame, corpus):
    from runlens.llm.common import stored

    docs = frame(corpus[0]).select("doc_id", "text", F.lit(False).alias("held_out"))
    m = hmm_lm.Model(states=4, own=200, groups=32, prior=0.01)
    v = hmm_lm.vocabulary(hmm_lm.count_words(docs, m), m)
    coded = stored(hmm_lm.encode(docs, v, m))
    states, seen = hmm_lm.first_states(v, m), []
    for _ in range(4):
        counts, log = hmm_lm.baum_welch_step(coded, states, m)
        seen.append(log)
        states = hmm_lm.maximised(counts, v, m)
    assert seen == sorted(seen) and seen[-1] > seen[0]
    got = {r["row"]: r["log10"] for r in hmm_lm.likelihoods(coded, states).collect()}
    assert sum(got.values()) * math.log(10) >= seen[-1]


def test_training_takes_every_text_and_settles(frame, corpus, monkeypatch):
    from runlens.llm.common import stored

    docs = frame(corpus[0]).select("doc_id", "text", F.lit(False).alias("held_out"))
    m = hmm_lm.Model(states=3, own=40, groups=16, known=60)
    v = hmm_lm.vocabulary(hmm_lm.count_words(docs, m), m)
    coded = stored(hmm_lm.encode(docs, v, m))
    step, seen, logs = hmm_lm.baum_welch_step, [], []

    def watched(part, *args):
        seen.append({r["row"] for r in part.select("row").collect()})
        out = step(part, *args)
        logs.append(out[1])
        return out

    monkeypatch.setattr(hmm_lm, "baum_welch_step", watched)
    hmm_lm.train(coded.select("row", "symbols"), v, m)
    every = {r["row"] for r in coded.select("row").collect()}
    full = [log for rows, log in zip(seen, logs) if rows == every]
    assert sorted(x for rows in seen[: -len(full)] for x in rows) == sorted(every)
    assert len(full) >= 2 and full[-1] - full[-2] <= 1e-3 * abs(full[-2])


def test_model_is_a_distribution():
    """Probabilities of all known words and one unknown word in each group add up to 1 in each state."""
    s = some_states(symbols=4)
    assert np.allclose(s.emit.sum(axis=0), 1)
    words = Counter({"a": 3, "b": 2, "c": 1})
    c, v = sum(words.values()), len(words)
    inside = [(n + 0.5) / (c + 0.5 * (v + 1)) for n in words.values()] + [0.5 / (c + 0.5 * (v + 1))]
    assert sum(inside) == pytest.approx(1)


def test_classifier_on_held_out_labels(spark):
    root = "/root/testdata/sf0.01"
    rows = queries.op9_quality_classifier(spark, root).join(spark.read.parquet(f"{root}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert len(rows) > 50 and (rows["predicted"] == rows["quality"]).mean() > 0.93
    assert rows["score"].between(0, 1).all()
    good, bad = rows["score"][rows["quality"] == 1], rows["score"][rows["quality"] == 0]
    assert np.mean([(bad < g).mean() for g in good]) > 0.97


def test_classifier_defined_results(spark, frame, odd_pairs, corpus):
    s = quality_classifier.Settings(unit_bits=8, dims=8, epochs=3)
    none = spark.createDataFrame([], "doc_id long, quality int")
    vectors, net = quality_classifier.fit(frame(odd_pairs), none, queries.learns, s)
    got = quality_classifier.score(frame(odd_pairs), vectors, net, s).collect()
    assert len(got) == len(odd_pairs) and all(r["score"] == 0.5 for r in got)
    vectors, net = quality_classifier.fit(frame(corpus[0]), spark.createDataFrame(corpus[1], "doc_id long, quality int"), queries.learns, s)
    twice = [quality_classifier.score(frame(p), vectors, net, s).collect() for p in (odd_pairs, odd_pairs)]
    assert sorted(map(str, twice[0])) == sorted(map(str, twice[1]))
    assert all(0 <= r["score"] <= 1 for r in twice[0])
    assert quality_classifier.score(frame([]), vectors, net, s).count() == 0


def test_context_sums_equal_plain_sums(frame, corpus):
    s = quality_classifier.Settings(unit_bits=6, dims=4)
    docs = corpus[0][:30]
    got = quality_classifier.context_sums(frame(docs), s)
    want, hashes = np.zeros((64, 4)), quality_classifier.WordHashes()
    for _, t in docs:
        words = t.encode().split()
        if not words:
            continue
        whole, ending, h = quality_classifier.units(words, hashes, s)
        entries = quality_classifier.index_entries(h, s)
        index = np.zeros((len(words), 4))
        for place, sign in entries:
            np.add.at(index, (np.arange(len(words)), place), sign)
        for i in range(len(words)):
            around = sum(index[j] for j in range(max(0, i - 2), min(len(words), i + 3)) if j != i) + np.zeros(4)
            want[whole[i]] += around
            want[ending[i]] += around
    assert np.allclose(got, want, atol=0.5, rtol=1e-5)


def test_pipeline(spark):
    import corpus_pipeline
    from runlens.session import cut_lineage

    root = "/root/testdata/sf0.01"
    docs = corpus_pipeline.documents(spark, root)
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut_lineage(stage(spark, before, root))
        seen[name] = (before, docs)
        assert name == "harmonic_packing" or docs.columns == columns
    before, after = seen["quality_rules"]
    kept = queries.op8_quality_rules(spark, root).where("kept").select("doc_id")
    assert sorted(kept.collect()) == sorted(after.select("doc_id").collect())
    before, after = seen["minhash_dedup"]
    pairs = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    want = {c for _, _, c in plain_components(shingle_sets(pairs, 5))}
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == want
    before, after = seen["secret_scan"]
    texts = {r["doc_id"]: r for r in after.collect()}
    for r in before.collect():
        clean = secret_scan.redacted(r["text"].encode(), queries.scanner()).decode()
        assert texts[r["doc_id"]]["text"] == clean and texts[r["doc_id"]]["n_chars"] == len(clean)
    before, after = seen["harmonic_packing"]
    assert {r[0] for r in after.select("doc_id").distinct().collect()} == set(texts)


def test_stages_take_odd_rows(spark, odd_pairs):
    import corpus_pipeline

    rows = [(i, t, None, None, None) for i, t in odd_pairs]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("score", F.lit(1))
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0
        if name == "secret_scan":
            assert got.count() == len(rows)
        if name == "minhash_dedup":
            # Of the three equal rows of 7 and 8 one stays; 8 has another text, which stays too.
            left = sorted((r["doc_id"], r["text"]) for r in got.where("doc_id in (7, 8)").collect())
            assert left == [(7, "same text here twice now"), (8, "other text")]
            ids = sorted(r["doc_id"] for r in got.where("doc_id is not null").collect())
            assert ids == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13]
        if name != "harmonic_packing":
            assert got.columns == docs.columns


@pytest.mark.parametrize("most", [1, 7, 50, 333, 5_000])
def test_most_frequent_words(spark, most):
    rng = random.Random(most)
    rows = [(rng.getrandbits(63) - 2**62, 1, int(2000 * rng.random() ** 6) + 1) for _ in range(1_500)]
    counts = spark.createDataFrame(rows, "word long, `group` int, n long").repartition(5)
    got = hmm_lm.most_frequent(counts, most)
    assert list(zip(got["word"], got["n"])) == [(w, n) for w, _, n in sorted(rows, key=lambda r: (-r[2], r[0]))[:most]]


def test_one_row_of_each_group_stays(frame):
    import corpus_pipeline

    rng = random.Random(17)
    t, u, v, w = (" ".join(f"w{rng.randint(0, 9999)}" for _ in range(60)) for _ in range(4))
    near = t.rsplit(" ", 2)[0]  # shares 54 of 56 shingles
    pairs = [
        (7, t), (8, t), (8, u), (7, t), (9, near), (None, t),  # t once, of id 7; u stays
        (3, v), (3, v), (None, v), (None, w), (None, w), (1, ""), (2, None), (2, None),
    ]
    docs = frame(pairs)
    got = corpus_pipeline.keep_one_of_each_group(docs.sparkSession, docs, "")
    assert got.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert left == sorted([(7, t), (8, u), (3, v), (None, w), (1, ""), (2, None), (2, None)], key=str)


def test_held_out_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long").select("doc_id", crc_mod(F.col("doc_id"), 5).alias("r"))
    assert all(r["r"] == remainder(r["doc_id"], 5) for r in df.collect())


def test_near_dup_defaults():
    s = minhash_dedup.NearDup()
    assert (s.words, s.percent) == (5, 80) and 0.55 < s.least_estimate < 0.65


def test_emissions_are_looked_up_once_for_both_directions(monkeypatch):
    rng = np.random.default_rng(6)
    s = hmm_lm.States(np.full(3, 1 / 3), np.full((3, 3), 1 / 3), rng.dirichlet(np.ones(9), 3).T)
    rows = [rng.integers(0, 9, n) for n in (7, 5, 5, 1)]
    counts = hmm_lm.States(np.zeros(3), np.zeros((3, 3)), np.zeros((9, 3)))
    taken, take = [], np.take
    monkeypatch.setattr(np, "take", lambda a, *x, **y: (taken.append(a is s.emit), take(a, *x, **y))[1])
    log = hmm_lm.expected(rows, s, counts)
    assert taken == [True]
    assert counts.emit.sum() == pytest.approx(18)
    assert log == pytest.approx(hmm_lm.forward(*hmm_lm.padded(rows), s, keep=False)[0].sum())


def test_freed_memory_is_given_back():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    texts = [os.urandom(3_000) for _ in range(40_000)]
    few = texts[::997]
    full = held()
    del texts
    give_back()
    assert len(few) and full - held() > 60_000_000


def test_words_are_hashed_once_for_many_texts(monkeypatch):
    """Counting and coding look at the distinct words of some texts, not at each text's words."""
    import pyarrow as pa
    from unittest import mock

    made, seen = [], []
    hashed = hmm_lm.xxhash.xxh64_intdigest
    monkeypatch.setattr(hmm_lm, "map_arrow", lambda df, fn, schema: made.append(fn) or mock.MagicMock())
    monkeypatch.setattr(hmm_lm, "F", mock.MagicMock())
    monkeypatch.setattr(hmm_lm, "TaskContext", mock.MagicMock(get=lambda: mock.Mock(partitionId=lambda: 2)))
    monkeypatch.setattr(hmm_lm.xxhash, "xxh64_intdigest", lambda w, *more: seen.append(bytes(w)) or hashed(w, *more))
    m = hmm_lm.Model(states=2, own=1, groups=8, known=2)
    docs = mock.MagicMock()
    hmm_lm.count_words(docs, m)
    texts = ["  Often rareword\x0b\n", None, "", "rareword often often \x1c \u2003 Éa éA", "\t "] + ["rareword often OFTEN"] * 50
    counts = {}
    for rows in made[0](iter([pa.record_batch({"text": pa.array(texts, pa.string())})])):
        for r in rows.to_pylist():
            counts[r["word"]] = counts.get(r["word"], 0) + r["n"]
    plain = [w for t in texts for w in (t or "").encode().lower().split()]
    number = lambda w: int(hmm_lm.signed(np.array([hashed(w)], np.uint64))[0])
    assert counts == {number(w): plain.count(w) for w in set(plain)} | {number(b" "): len(texts)}
    frequent = np.sort(np.array([number(b"often"), number("\u2003".encode())], np.int64))
    docs.sparkSession.sparkContext.broadcast.return_value.value = hmm_lm.Vocabulary(
        frequent, np.array([5, 6]), np.array([1, 2]), np.array([0, -1]), np.zeros(8), 100, 10, len(texts), None
    )
    hmm_lm.encode(docs, docs.sparkSession.sparkContext.broadcast.return_value.value, m)
    seen.clear()
    rows = pa.record_batch({"doc_id": pa.array(range(len(texts))), "text": pa.array(texts, pa.string()), "held_out": pa.array([False] * len(texts))})
    got = [r for b in made[1](iter([rows])) for r in b.to_pylist()]
    assert seen.count(b"rareword") == 1
    for k, (r, t) in enumerate(zip(got, texts, strict=True)):
        words = [number(w) for w in (t or "").encode().lower().split()]
        rare = sorted(set(words) - set(frequent.tolist()))
        assert (r["row"], r["doc_id"], r["n_tokens"], r["rare"]) == ((2 << 33) + k, k, len(words) + 1, rare)
        assert r["times"] == [words.count(x) for x in rare]
        assert r["n_known"] == sum(w not in rare for w in words) + 1
        symbols = np.frombuffer(r["symbols"], np.uint16)
        assert len(symbols) == len(words) + 1 and symbols[-1] == m.own
