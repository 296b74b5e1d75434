"""Byte BPE, Elias-Fano files and packing against the libraries and exact round trips."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runlens.llm import bpe_codec, elias_fano, harmonic_packing, queries, tokenizing

VOCABULARY = bpe_codec.Vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe_codec.load_ranks(VOCABULARY.path), special_tokens={}
)
CODEC = bpe_codec.Codec(VOCABULARY)
SPACES = tokenizing.SpacePieces(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = tokenizing.WordPieces(public_tokenizers.path("word_bpe_49k.json"))
TEXT = st.text(alphabet=list("aAbéB \n\t\x1c\x85\xa0’'s12!?-日́🙂¶ ſ"), max_size=60) | st.text(max_size=40)


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


BYTE_LIBRARY, WORD_LIBRARY = library("byte_bpe_50k.json"), library("word_bpe_49k.json")


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_segment_tree_equals_library(text):
    ids = CODEC.encode(text)
    assert ids == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_long_pieces_and_ties():
    for text in ("a" * 3000, "ab" * 1500, "!" * 999, " " * 500 + "x", "aaa", "the" * 700):
        assert CODEC.encode(text) == REFERENCE.encode_ordinary(text)


def plain_merges(piece, ranks):
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, i = min(found)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=40))
def test_merges_equal_plain_search(piece):
    assert bpe_codec.merge_pairs(piece, CODEC.ranks) == plain_merges(piece, CODEC.ranks)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_remembered_pieces_equal_library(texts):
    got = [np.frombuffer(x, np.uint16).tolist() for x in SPACES.encode(texts)]
    assert got == [BYTE_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(x, np.uint16).tolist() for x in WORDS.encode([t.encode() for t in texts])]
    assert got == [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|END", " ", "ab", "a\n", "é"]), max_size=8).map("".join), max_size=5))
def test_special_strings_become_what_the_library_makes_of_them(texts):
    got = [np.frombuffer(x, np.uint16).tolist() for x in SPACES.encode(texts)]
    assert got == [BYTE_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    got = [np.frombuffer(x, np.uint16).tolist() for x in WORDS.encode([t.encode() for t in texts])]
    assert got == [WORD_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_pieces_are_forgotten_by_size():
    r = tokenizing.Recent(1_000, most=100)
    for k in range(50):
        for x in r.missing([[f"{k:02d}" * 20]]):
            r.young[x] = b""
    assert len(r.young) + len(r.old) <= 4


def test_recent_entries():
    r = tokenizing.Recent(4)
    for row in ("abc", "ad", "ea", "fg", "ab"):
        for x in r.missing([list(row)]):
            r.young[x] = x.upper()
        assert all(r.young[x] == x.upper() for x in row)
        assert len(r.young) + len(r.old) <= 4 + 4


def test_forgetting_pieces_changes_nothing(corpus):
    texts = [t for _, t in corpus[0]][:40]
    small = tokenizing.SpacePieces(public_tokenizers.path("byte_bpe_50k.json"), limit=50)
    assert [y for t in texts for y in small.encode([t])] == SPACES.encode(texts)
    few = tokenizing.WordPieces(public_tokenizers.path("word_bpe_49k.json"), limit=50)
    assert [y for t in texts for y in few.encode([t.encode()])] == WORDS.encode([t.encode() for t in texts])


def test_round_trip_query(frame, odd_pairs):
    got = sorted(map(tuple, bpe_codec.round_trip(frame(odd_pairs), VOCABULARY).collect()), key=str)
    want = []
    for i, t in odd_pairs:
        ids = REFERENCE.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_and_decode_tables(frame, odd_pairs):
    coded = bpe_codec.encode(frame(odd_pairs), VOCABULARY)
    texts = sorted(bytes(r["data"]) for r in bpe_codec.decode(coded, VOCABULARY).collect())
    assert texts == sorted((t or "").encode() for _, t in odd_pairs)
    assert bpe_codec.encode(frame([]), VOCABULARY).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**40), max_size=80) | st.lists(st.integers(0, 5), max_size=200))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.uint64))
    coded = elias_fano.EliasFano.of(values)
    assert coded.all().tolist() == values.tolist()
    some = np.arange(0, len(values), 3)
    assert coded.select(some).tolist() == values[some].tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 2000, 10_000))
    coded = elias_fano.EliasFano.of(values)
    size = len(coded.low) + len(coded.high) + len(coded.directory)
    assert 8 * size < len(values) * (3 + np.log2(values[-1] / len(values)))
    assert 4 * size < 8 * len(values)


def written(spark, df, **more):
    from runlens.session import new_table_path

    path = new_table_path(spark)
    elias_fano.write_ids(df, path, elias_fano.Format(public_tokenizers.path("word_bpe_49k.json"), **more))
    return path


def test_id_files(spark, frame, odd_pairs):
    path = written(spark, frame(odd_pairs), block_tokens=3_000, block_docs=3)
    got = [tuple(r) for r in elias_fano.read_documents(spark, path).collect()]
    spans = {}
    for i, t in odd_pairs:
        ids = np.array(WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        spans.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    by_id = defaultdict(list)
    for doc, start, n, crc in got:
        by_id[doc].append((n, crc))
    assert {k: sorted(v) for k, v in by_id.items()} == {k: sorted(v) for k, v in spans.items()}
    at = 0
    for doc, start, n, _ in sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        assert start == at
        at += n
    row = spark.read.parquet(path).where("docs > 1").first().asDict()
    total = np.concatenate([elias_fano.document_ids(row, i) for i in range(row["docs"])])
    assert total.tobytes() == bytes(row["ids"])
    assert elias_fano.read_documents(spark, written(spark, frame([]))).count() == 0


def check_packing(rows, want, capacity=1024):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    tokens = sum(r["length"] for r in rows)
    assert tokens == sum(len(x) for _, x in want)
    left = defaultdict(int)
    for i, ids in want:
        left[i, len(ids)] += 1
    for (i, n), parts in pieces.items():
        assert sum(r["length"] for r in parts) == n * left[i, n]
    crcs = {(i, len(x), s, n): zlib.crc32(x[s : s + n].tobytes()) for i, x in want for s, n in {(r["start"], r["length"]) for r in pieces[i, len(x)]}}
    if all(v == 1 for v in left.values()):
        assert all(crcs[r["doc_id"], r["doc_tokens"], r["start"], r["length"]] == r["ids_crc32"] for r in rows)
    return tokens, len(sequences)


def token_ids(pairs):
    return [(i, np.array(BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids + [0], "<u4")) for i, t in pairs]


def test_packing(frame, odd_pairs, corpus):
    check_packing(harmonic_packing.pack(frame(odd_pairs), queries.packing()).collect(), token_ids(odd_pairs))
    tokens, n = check_packing(harmonic_packing.pack(frame(corpus[0]), queries.packing()).collect(), token_ids(corpus[0]))
    assert n * 1024 - tokens < 0.03 * tokens
    assert harmonic_packing.pack(frame([]), queries.packing()).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 5000), st.integers(2, 1100))
def test_classes_hold_what_they_promise(length, capacity):
    parts = harmonic_packing.pieces_of(length, capacity, 1 / 128)
    assert sum(n for n, _ in parts) == length
    assert all(n * k <= capacity and n > 0 for n, k in parts)


def test_first_fit():
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(300)]
    bins = defaultdict(list)
    for n, (b, at) in zip(lengths, harmonic_packing.first_fit(lengths, 100)):
        bins[b].append((at, n))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100


@pytest.mark.parametrize("kind, file", [(tokenizing.SpacePieces, "byte_bpe_50k.json"), (tokenizing.WordPieces, "word_bpe_49k.json")])
def test_words_are_encoded_once_whatever_mark_follows(kind, file):
    class Counting:
        def __init__(self, inner):
            self.inner, self.seen = inner, []

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def encode_batch_fast(self, texts, **more):
            self.seen += texts
            return self.inner.encode_batch_fast(texts, **more)

    e = kind(public_tokenizers.path(file))
    plain, e.tokenizer = e.tokenizer, Counting(e.tokenizer)
    text = "so oftionnten oftionnten. oftionnten, oftionnten; oftionnten"
    text = text + "\nthen oftionnten's" if kind is tokenizing.SpacePieces else text + " Oftionnten"
    got = e.encode([text if kind is tokenizing.SpacePieces else text.encode()])[0]
    assert np.frombuffer(got, np.uint16).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert sum(t.lower().count("oftionnten") for t in e.tokenizer.seen) == 1


def test_marks_take_no_room_of_letters():
    """Letters are known again behind any mark and in any later call, in an encoder that keeps few texts."""
    from unittest import mock

    e = tokenizing.SpacePieces(public_tokenizers.path("byte_bpe_50k.json"), limit=1_000)
    plain, seen = e.tokenizer, []
    e.tokenizer = mock.Mock(wraps=plain)
    e.tokenizer.encode_batch_fast = lambda texts, **more: seen.extend(texts) or plain.encode_batch_fast(texts, **more)
    words = [f"éof{a}t{b}nt" for a in "abcdefghijklmnopq" for b in "abcdefghijklmnopq"]
    texts = ["so " + " ".join(w + mark for w in words) for mark in (",", ".\nThen", ";", "'s", "!", "", "(7)", " \t")]
    got = [np.frombuffer(e.encode([t])[0], np.uint16).tolist() for t in texts[:-1]]
    assert sum(t.count(words[100]) for t in seen) == 1
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts[:-1]]
    both = [np.frombuffer(x, np.uint16).tolist() for x in e.encode(texts)]
    assert both == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_what_tasks_of_another_operator_kept_goes():
    from runlens.llm import common

    made = []
    kept, other = common.lasting(lambda x: made.append(x) or [x]), common.lasting(lambda x: [x])
    first = kept(1)
    common.drop_lasting(kept)  # a task of the same operator
    assert kept(1) is first and made == [1]
    common.drop_lasting(other)
    assert kept(1) is not first and made == [1, 1]
    assert {tokenizing.space_pieces, tokenizing.word_pieces} <= set(common._LASTING)
    common._LASTING[:] = [x for x in common._LASTING if x not in (kept, other)]


def test_workers_drop_the_pieces_of_an_operator_that_has_ended(spark, frame):
    from runlens.llm import common

    def held(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [sum(x.cache_info().currsize for x in common._LASTING)] * b.num_rows})

    pairs = [(i, "some words") for i in range(40)]
    harmonic_packing.cut_documents(frame(pairs), queries.packing()).collect()
    docs = frame(pairs).select("text")
    assert {r["n"] for r in common.map_arrow(docs, held, "n long").collect()} == {0}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=2, max_size=bpe_codec.SHORT) | st.sampled_from([b"a" * k for k in range(2, 34)]), max_size=60))
def test_short_pieces_are_merged_together(pieces):
    got = [np.frombuffer(x, np.uint32).tolist() for x in CODEC.short.encode(pieces)]
    assert got == [plain_merges(p, CODEC.ranks) for p in pieces]


def test_pieces_are_cut_and_merged_many_at_once(monkeypatch):
    """Of new pieces none is cut or merged by itself."""
    codec = bpe_codec.Codec(VOCABULARY)
    words = [f"{a}{b}{c}" for a in ("Qu", "str", "éz") for b in ("ioux", "anv", "日") for c in (",", "ly!!", "'s", " z")]
    texts = [" ".join(words), " ".join(reversed(words)) + " ", "two  blanks " + " ".join(words), "a\n " + words[0]]
    monkeypatch.setattr(bpe_codec, "merge_pairs", None)
    assert [np.frombuffer(x, np.uint32).tolist() for x in codec.encode_many(texts)] == [REFERENCE.encode_ordinary(t) for t in texts]


MARKED = st.lists(st.tuples(st.sampled_from(["ab", "Ab", "ΣΑΣ", "İx", "étion", "EZCIÓN", "a1", "", "日本", "ªb", "é", "ǅa"]), st.text(alphabet=list(tokenizing.MARKS + "'sﬁ̸"), max_size=5)), max_size=30)


@settings(max_examples=300, deadline=None)
@given(MARKED)
def test_letters_with_marks_behind_them(words):
    text = " ".join(a + b for a, b in words)
    fresh = np.frombuffer(WORDS.encode([text.encode()])[0], np.uint16).tolist()
    assert fresh == WORD_LIBRARY.encode(text, add_special_tokens=False).ids


def test_letters_are_encoded_once_whatever_marks_follow():
    encoder, given_to = tokenizing.WordPieces(public_tokenizers.path("word_bpe_49k.json")), []
    whole = encoder._whole
    encoder._whole = lambda texts: given_to.extend(texts) or whole(texts)
    text = "étiontrere###, atndwh$$$ atndwh EZCIÓN!! Onorou*** (so)"
    assert np.frombuffer(encoder.encode([text.encode()])[0], np.uint16).tolist() == WORD_LIBRARY.encode(text, add_special_tokens=False).ids
    assert [x for x in given_to if any(c.isalpha() for c in x)] == ["(so)"]
