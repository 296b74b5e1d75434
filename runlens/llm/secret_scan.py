"""Secret scans: three fixed patterns, and values in a credential context judged by how many guesses they would take.

The guess cost of a value is the cheapest way to build it from segments: words (by rank), dates, repeats, keyboard walks and
brute force, found by dynamic programming over its positions (``guess_cost.py``). A value after words like "pwd:" or "passphrase
is" counts as secret from ``least_cost`` on, so placeholders and ordinary words ("password is required") are left alone. Where a
fixed pattern matches only part of such a value, the whole of it is a secret too, whatever its cost, and has a span beside the
pattern's.

Texts are scanned as UTF-8 bytes after a search for the literal words that every match must hold; places are given in code points.

Defined results: null and empty texts have no spans. A row keeps its spans whatever other rows hold. Extra columns are ignored
by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import as_bytes, few_rows, map_arrow, sql_schema
from runlens.llm.guess_cost import guess_cost as guess_cost_of

# Fixed patterns of the contract.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")  # shorter runs would be dropped
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ("assign", "access", "hex", "password")

# The wider credential context of the method.
CONTEXT = re.compile(
    rb"""(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|(?:api|access|private|secret)[_ -]?key)"""
    rb"""["']?(?:\x20*(?:=>|->|:=|[:=])\x20*|\x20is:?\x20)["'`]?([^\s"'`,;<>(){}\[\]]+)""",
    re.IGNORECASE,
)
CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"key")


@dataclass(frozen=True)
class Scanner:
    #: Rank file whose entries, in order, are the word list; None: no words.
    words: str | None
    least_cost: float = 9.0
    #: Charge for each further segment.
    segment_cost: float = 0.7


@lru_cache(maxsize=4)
def word_ranks(path: str | None) -> dict[str, int]:
    """Lower-case words of three letters and more with their rank, from a tokenizer's rank file."""
    ranks: dict[str, int] = {}
    if path:
        with open(path, "rb") as f:
            for line in f:
                word = base64.b64decode(line.split()[0]).strip().lower()
                if len(word) >= 3 and word.isalpha():
                    ranks.setdefault(word.decode(), len(ranks) + 1)
    return ranks


def guess_cost(value: str, s: Scanner) -> float:
    return guess_cost_of(value, word_ranks(s.words), s.segment_cost)


def spans_of(data: bytes, s: Scanner) -> list[tuple[str, int, int, int, int, float]]:
    """(kind, start, end, value start, value end, guess cost), in bytes, by start and then kind."""
    found: list[tuple[str, int, int, int, int]] = []
    low = data.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(data):
            if m.end(2) - m.start(2) >= 6:
                found.append(("assign", m.start(), m.end(), m.start(2), m.end(2)))
    if b"AKIA" in data:
        found += [("access", m.start(), m.end(), m.start(), m.end()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), m.start(), m.end()) for m in HEX.finditer(data)]
    out = [(*f, guess_cost(data[f[3] : f[4]].decode("utf-8", "replace"), s)) for f in found]
    if any(w in low for w in CONTEXT_WORDS):
        for m in CONTEXT.finditer(data):
            a, b = m.span(1)
            while b > a and data[b - 1] in b".:!?":
                b -= 1
            if b <= a:
                continue
            # Values of fixed patterns that overlap this one, and how far they cover it.
            inside = sorted((f[3], f[4]) for f in found if f[3] < b and a < f[4])
            reach = a
            for start, end in inside:
                if start <= reach:
                    reach = max(reach, end)
            if reach < b:
                cost = guess_cost(data[a:b].decode("utf-8", "replace"), s)
                if inside or cost >= s.least_cost:
                    out.append(("password", a, b, a, b, cost))
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def in_code_points(data: bytes, spans: list[tuple]) -> list[tuple]:
    if not spans or data.isascii():
        return spans
    return [(f[0], *(len(data[:x].decode("utf-8", "replace")) for x in f[1:5]), f[5]) for f in spans]


SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("guess_log10", pa.float64())]
)
SPAN_SQL = "array<struct<kind: string, start: long, end: long, value_start: long, value_end: long, guess_log10: double>>"


def scan(docs: DataFrame, s: Scanner) -> DataFrame:
    """(doc_id, found) for each row: all spans by start and kind, in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in SPAN]
        for rows in few_rows(batches):
            found = [[dict(zip(names, f)) for f in in_code_points(t, spans_of(t, s))] for t in as_bytes(rows.column(1))]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(found, pa.list_(SPAN))], names=["doc_id", "found"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found {SPAN_SQL}")


def redacted(data: bytes, s: Scanner, mark: bytes = b"[REDACTED]") -> bytes:
    """The text with every secret value replaced by ``mark``."""
    out, at = [], 0
    spans = sorted((f[3], f[4]) for f in spans_of(data, s))
    for a, b in spans:
        if a >= at:
            out += [data[at:a], mark]
        at = max(at, b)
    return b"".join([*out, data[at:]]) if spans else data


def redact(docs: DataFrame, s: Scanner) -> DataFrame:
    """All rows and columns of ``docs``, with secret values in ``text`` replaced; a null text stays null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in few_rows(batches):
            at = rows.schema.get_field_index("text")
            clean = [None if t is None else redacted(t, s).decode() for t in rows.column(at).cast(pa.binary()).to_pylist()]
            columns = [pa.array(clean, pa.string()) if i == at else c for i, c in enumerate(rows.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=rows.schema.names)

    return map_arrow(docs, run, sql_schema(docs))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns of a scan."""
    base = F.filter("found", lambda f: f["kind"] != "password")

    def joined(column):
        return F.concat_ws(",", F.transform(column, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))))

    def count(kind):
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), count("password"), F.array_max(F.transform("found", lambda f: f["guess_log10"])).alias("max_guess_log10"),
    )
