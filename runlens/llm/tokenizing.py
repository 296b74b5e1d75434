"""Exact token ids from the tokenizers library, encoding each distinct piece of text once.

Both vocabularies cut text before merging, and never across certain white space, so a text's ids are the ids of its pieces in a
row. A worker process keeps the ids of the pieces it has seen lately (two bytes each), and hands new pieces to the library many at a
time. Forgetting pieces does not change results.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from runlens.llm.common import lasting

#: New pieces are joined to texts of so many; the library takes longer for each where there are more.
GROUP = 200
#: Pieces remembered by a worker.
LIMIT = 800_000


def load(path: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads keep memory of their own
    t = Tokenizer.from_file(path)
    if hasattr(t.model, "_resize_cache"):
        t.model._resize_cache(0)  # what it is given is new to it
    if t.get_vocab_size() > 65_536:
        raise ValueError("ids do not fit in two bytes")
    return t


#: Entry of a piece behind which no cut is safe; no ids have one byte.
UNSAFE = b"?"


def special_strings(t: Tokenizer) -> tuple[str, ...]:
    """Strings that the library turns into one id wherever they stand; texts that hold one are encoded whole."""
    return tuple(x.content for x in t.get_added_tokens_decoder().values())


def groups(items: list, size: int = GROUP) -> Iterator[list]:
    for i in range(0, len(items), size):
        yield items[i : i + size]


def cut_at(data: bytes, ends: list[int]) -> list[bytes]:
    """``data`` cut behind each of the rising ``ends``."""
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def two_bytes(ids: list[int]) -> bytes:
    return np.array(ids, np.uint16).tobytes()


class Recent:
    """A dictionary that keeps between half and all of ``limit`` entries, or of ``most`` characters: those used last."""

    def __init__(self, limit: int, most: int = 64_000_000):
        self.limit, self.most, self.held, self.young, self.old = limit, most, 0, {}, {}

    def _turn(self) -> None:
        if len(self.young) > self.limit // 2 or self.held > self.most // 2:
            self.old, self.young, self.held = self.young, {}, 0

    def _unknown(self, new: set) -> set:
        """Those of the items missing in ``young`` that are not known from before either."""
        self.held += sum(map(len, new))
        known = new & self.old.keys()
        for x in known:
            self.young[x] = self.old[x]
        return new - known

    def missing(self, rows: list[list]) -> set:
        """The items of ``rows`` without an entry; all others are in ``young`` afterwards."""
        self._turn()
        new: set = set()
        for row in rows:
            new.update(filterfalse(self.young.__contains__, row))
        return self._unknown(new)

    def entries(self, items: list, learn: Callable[[set], None]) -> list:
        """The entry of each item, looked up once; ``learn`` puts those of the items it is given into ``young``."""
        self._turn()
        get = self.young.get
        found = list(map(get, items))
        at = [i for i, entry in enumerate(found) if entry is None]
        if at:
            new = [items[i] for i in at]
            learn(self._unknown(set(new)))
            for i, x in zip(at, new):
                found[i] = get(x)
        return found


class Known:
    """Ids of the distinct texts met lately, as rows of arrays; at most ``limit`` texts, or ``most`` bytes of them, beside those of one call."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int, most: int = 64_000_000):
        self.learn, self.limit, self.most = learn, limit, most
        self.texts, self.ids, self.ends = pa.array([], pa.string()), np.empty(0, np.uint16), np.zeros(1, np.int64)

    def places(self, items: pa.Array) -> np.ndarray:
        """The row of each of the distinct ``items``; ``learn`` gives the ids of new ones, in a row, and how many each has."""
        at = pc.index_in(items, value_set=self.texts)
        unknown = at.is_null()
        new = items.filter(unknown)
        if not len(new):
            return at.to_numpy()
        found = at.fill_null(-1).to_numpy()
        if len(self.texts) + len(new) > self.limit or self.texts.nbytes + new.nbytes > self.most:
            used = np.sort(found[found >= 0])
            self.texts = self.texts.take(pa.array(used))
            sizes = np.diff(self.ends)[used]
            self.ids = self.ids[spans(self.ends[used], sizes)]
            self.ends = np.concatenate([[0], np.cumsum(sizes)])
            found = np.where(found < 0, found, np.searchsorted(used, found))
        ids, sizes = self.learn(new.to_pylist())
        places = found.astype(np.int64)
        places[unknown.to_numpy(zero_copy_only=False)] = len(self.texts) + np.arange(len(new))
        self.texts = pa.concat_arrays([self.texts, new])
        self.ids = np.concatenate([self.ids, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        return places


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each span, one span after another."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


#: Marks that may end a word of letters, one after another, and are one match for both patterns. An apostrophe may start another match.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters and what follows them from the first other ASCII character on.
LETTERS_AND_REST = r"(?s)^(?P<letters>\pL+)(?P<rest>[\x00-\x40\x5B-\x60\x7B-\x7F].*)$"

#: All that Python counts as white space.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


class SpacePieces:
    """Byte-level vocabularies whose pattern gives one blank to the word behind it.

    A text is cut before each blank. That cut is safe where the character before the blank is no white space: no match reaches
    over it. A text with another kind of cut (two blanks in a row, a blank after a line end) is encoded whole. Letters are a match
    of their own, so what follows them in a piece is the same behind any others.
    """

    def __init__(self, path: str, limit: int = LIMIT):
        self.tokenizer = load(path)
        self.inner, self.alone, self.special = Known(self._learn_joined, limit), Known(self._learn_alone, limit // 4), special_strings(self.tokenizer)
        # One character of a byte-level token's name stands for one byte.
        self.widths = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(self.tokenizer.get_vocab_size())])

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces behind a blank."""
        found = [np.array(self._whole([" " + " ".join(group)])[0], np.uint16) for group in groups(parts)]
        ids = np.concatenate(found)
        text = np.frombuffer((" " + " ".join(parts)).encode(), np.uint8)
        # Pieces hold no blank, so each ends before the next one.
        ends = np.append(np.flatnonzero(text == 32)[1:], len(text))
        return ids, np.diff(np.searchsorted(np.cumsum(self.widths[ids]), ends) + 1, prepend=0)

    def _learn_alone(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [ids for group in groups(texts) for ids in self._whole(group)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint16, sizes.sum()), sizes

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of each text."""
        whole = {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        if whole:
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in whole]))
            return [two_bytes(self._whole([t])[0]) if i in whole else next(rest) for i, t in enumerate(texts)]
        if not texts:
            return []
        # Each distinct piece is looked up once. The first of a text has no blank before it, and nothing is cut off one that ends it
        # in white space.
        parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
        coded = parts.flatten().dictionary_encode()
        pieces, which = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        starts, stops = parts.offsets.to_numpy()[:-1], parts.offsets.to_numpy()[1:]
        bare = pc.utf8_rtrim(pieces, WHITE)
        unsafe = (pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)) | pc.not_equal(bare, pieces).to_numpy(zero_copy_only=False)
        last, several = which[stops - 1], stops - starts > 1
        closing = np.flatnonzero(several & unsafe[last])
        firsts = pieces.take(pa.array(which[starts]))
        ends = pc.binary_join_element_wise("", pieces.take(pa.array(last[closing])), " ")
        stray = several & unsafe[which[starts]] & (pc.binary_length(firsts).to_numpy() > 0)
        # Each piece is two spans of ids, of its letters and of what follows them.
        safe = np.flatnonzero(~unsafe)
        cut = pc.extract_regex(pieces.take(pa.array(safe)), LETTERS_AND_REST)
        marked = cut.is_valid()
        tails = cut.filter(marked).field("rest").dictionary_encode()
        stems = pc.if_else(marked, cut.field("letters"), pieces.take(pa.array(safe))).dictionary_encode()
        alone = pa.concat_arrays([firsts, ends, tails.dictionary]).dictionary_encode()
        apart = self.alone.places(alone.dictionary)[alone.indices.to_numpy()]
        met = self.inner.places(stems.dictionary)[stems.indices.to_numpy()]
        # Rows of both tables, those alone behind the others; the row after all has no ids.
        sizes = np.concatenate([np.diff(self.inner.ends), np.diff(self.alone.ends), [0]])
        begins = np.concatenate([self.inner.ends[:-1], len(self.inner.ids) + self.alone.ends[:-1], [0]])
        ids = np.concatenate([self.inner.ids, self.alone.ids])
        apart, none = apart + len(self.inner.texts), len(sizes) - 1
        spells = np.full((len(pieces) + len(texts) + len(closing), 2), none)
        spells[safe, 0] = met
        spells[safe[marked.to_numpy(zero_copy_only=False)], 1] = apart[len(texts) + len(closing) :][tails.indices.to_numpy()]
        spells[len(pieces) :, 0] = apart[: len(texts) + len(closing)]
        which[starts] = len(pieces) + np.arange(len(texts))
        which[stops[closing] - 1] = len(pieces) + len(texts) + np.arange(len(closing))
        # First the ids of each distinct piece in a row, then those of the texts.
        spelled = ids[spans(begins[spells].ravel(), sizes[spells].ravel())]
        long = sizes[spells].sum(axis=1)
        own = long[which]
        out = cut_at(spelled[spans((np.cumsum(long) - long)[which], own)].tobytes(), (2 * np.cumsum(own)[stops - 1]).tolist())
        strange = np.append(unsafe, np.zeros(len(texts) + len(closing), bool))
        strange[len(pieces) : len(pieces) + len(texts)] = stray
        for i in np.flatnonzero(np.logical_or.reduceat(strange[which], starts)).tolist():
            out[i] = two_bytes(self._whole([texts[i]])[0])
        return out


class WordPieces:
    """Vocabularies that drop white space and mark the last token of each word: texts are cut at ASCII white space."""

    def __init__(self, path: str, suffix: str = "</w>", limit: int = LIMIT):
        self.tokenizer, self.seen = load(path), Recent(limit)
        self.special = [x.encode() for x in special_strings(self.tokenizer)]
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.closes = np.array([n.endswith(suffix) for n in names])

    def _learn(self, words: set[str]) -> None:
        """Pieces of letters are one word for the pattern, with marks behind them two; others are encoded one by one."""
        entries, before = self.seen.young, self.seen.old
        bare, marked, rest = [], [], []
        for w in words:
            body = w.rstrip(MARKS)
            # Lower case may take letters apart.
            if body.isascii() and body.isalpha():
                body = body.lower()
            elif not (body.isalpha() and body.lower().isalpha()):
                rest.append(w)
                continue
            if body == w:
                bare.append(w)
            else:
                marked.append((w, body, w[len(body) :]))
        # Letters that were met alone serve with any marks.
        known: dict[str, bytes] = {}
        new = set(bare)
        for _, body, _ in marked:
            if body not in new and body not in known:
                ids = entries.get(body) or before.get(body)
                if ids is None:
                    new.add(body)
                else:
                    known[body] = ids
        for group in groups(list(new)):
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, np.uint16)
            closing = np.flatnonzero(self.closes[ids])
            if len(closing) != len(group):
                raise AssertionError("a piece was cut in another way than its letters say")
            known.update(zip(group, cut_at(ids.tobytes(), (2 * (closing + 1)).tolist())))
        tails = list({tail for _, _, tail in marked})
        ends = dict(zip(tails, self._whole(tails)))
        entries.update((w, known[w]) for w in bare)
        entries.update((w, known[body] + ends[tail]) for w, body, tail in marked)
        for group in groups(rest):
            entries.update(zip(group, self._whole(group)))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [two_bytes(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of each UTF-8 text."""
        whole = {i for i, t in enumerate(texts) if any(x in t for x in self.special)}
        if whole:
            rest = iter(self.encode([t for i, t in enumerate(texts) if i not in whole]))
            ready = iter(self._whole([texts[i].decode() for i in sorted(whole)]))
            return [next(ready) if i in whole else next(rest) for i in range(len(texts))]
        # Each distinct word of the texts is looked up once; an empty one stands at either end of a text with white space there.
        words = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
        coded = words.flatten().dictionary_encode()
        entries = self.seen.entries(coded.dictionary.to_pylist(), self._learn)
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // 2
        which = coded.indices.to_numpy()
        own = sizes[which]
        ends = np.concatenate([[0], np.cumsum(own)])
        at = np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], own)
        ids = np.frombuffer(b"".join(entries), np.uint16)[at]
        return cut_at(ids.tobytes(), (2 * ends[words.offsets.to_numpy()[1:]]).tolist())


@lasting
def space_pieces(path: str) -> SpacePieces:
    """One encoder for all tasks of a worker process."""
    return SpacePieces(path)


@lasting
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)
