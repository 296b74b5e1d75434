"""Cheapest repair of damaged conversations by a grammar-compressed dynamic program.

Each row of a conversation becomes one symbol: its role's initial (s, u, a, other) and its first fault (none, blank, duplicate,
truncated). Edits keep, delete or rerole rows and insert empty ones, until the initials read ``(s?(ua)+)?``. One row is a min-plus
matrix over the four states of that expression; its entries hold a cost and the audit (initials of the edits) that reaches it.

* **Re-Pair** replaces frequent pairs of neighbouring symbols by rules, trained by Spark on all distinct sequences. A rule's matrix
  is the product of its halves, made once and used by every conversation. A rule's audit is a rope: the entry names the middle state,
  so the text is only spelled out where it is wanted. The number of rules is bounded; what no rule covers is multiplied as it is,
  so the grammar decides the cost of the work, never the result.
* **Ties** go to the ASCII-least audit. Insertions belong to the row that follows, so an audit over n rows has n letters other than I
  and ends in one: no audit over the same rows is the beginning of another, and the order of joined audits follows from the
  order of their parts. Each matrix keeps the rank of its four audits in every line; no text is ever compared.
* **Long conversations** are cut: a range partitioning by (conversation, turn, hash) deals a conversation of a third of all rows to
  many tasks, blocks of at most ``block_rows`` rows become one matrix each, and only 4 x 4 numbers a block meet to
  choose the states between blocks. Texts are shuffled once, to be hashed in order; SHA-256 has to read a conversation
  in one piece, which goes by as a sorted stream in constant memory.

Defined cases: a null role or text is one space (so null text is blank); a null turn sorts first and is one space in the damage
key; rows of one turn are ordered by a hash of role and text, so repeated rows are neighbours and all but the first are duplicates; a null
conversation id is a conversation of its own; an unknown or empty role can be reroled or deleted, not kept; conversations without
rows after damage have zeros and the hash of the empty text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import batch, map_arrow, stored

ROLES, FAULTS = "sua?", ("ok", "truncated", "blank", "duplicate")
SYMBOLS = len(ROLES) * len(FAULTS)
#: Letter of symbol 0; the rules' letters follow those of the symbols.
FIRST = ord("a")
SPACE = " \t\n\x0b\x0c\r"

#: States: nothing yet, after s, after u, after a. NEXT[state][role] is the state after a row of that role.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Cost and audit of what must be inserted at the end.
ENDING = ((0, ""), (6, "II"), (3, "I"), (0, ""))
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 3, 4, 3, 3
FAR = 1 << 40


@dataclass(frozen=True)
class Repair:
    block_rows: int = 1_024
    #: Bound of the grammar; it travels to every task.
    max_rules: int = 2_048
    #: Training ends when a round's pairs cover less than this share of the symbols left.
    least_gain: float = 0.02
    max_rounds: int = 12


# ---- the matrices ----


def _wanted_role(state: int) -> str:
    """The only role that an inserted or reroled row can have in a state."""
    return "a" if state == 2 else "u"


def _row_edits(symbol: int) -> dict[tuple[int, int], tuple[int, str]]:
    """Cheapest (cost, audit) of one row between two states, with up to two rows inserted before it (more never pay)."""
    role, fault = ROLES[symbol // len(FAULTS)], FAULTS[symbol % len(FAULTS)]
    late = UNFINISHED if fault == "truncated" else 0
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, n in itertools.product(range(4), range(3)):
        at = start
        for _ in range(n):
            at = NEXT[at][_wanted_role(at)]
        ends = [(at, DELETE, "D")]
        if fault in ("ok", "truncated"):
            ends.append((NEXT[at][_wanted_role(at)], REROLE + late, "R"))
            if role in NEXT[at]:
                ends.append((NEXT[at][role], KEEP + late, "K"))
        for end, cost, letter in ends:
            option = (cost + n * INSERT, "I" * n + letter)
            best[start, end] = min(best.get((start, end), option), option)
    return best


def _ranks(value: np.ndarray) -> np.ndarray:
    """Place of each of the last axis's four values among them."""
    return (value[..., :, None] > value[..., None, :]).sum(-1).astype(np.int64)


@dataclass
class Matrices:
    """cost, rank of the audit within its line, and the middle state of the product (for rows: unused); each (n, 4, 4)."""

    cost: np.ndarray
    rank: np.ndarray
    mid: np.ndarray

    def __getitem__(self, i) -> Matrices:
        return Matrices(self.cost[i], self.rank[i], self.mid[i])


def product(a: Matrices, b: Matrices) -> Matrices:
    """Min-plus product with audits: of equal costs, the least audit of the left half decides, then that of the right."""
    cost = a.cost[..., :, :, None] + b.cost[..., None, :, :]
    mid = np.argmin(cost * 4 + a.rank[..., :, :, None], axis=-2)
    best = np.minimum(np.take_along_axis(cost, mid[..., None, :], -2)[..., 0, :], FAR)
    left = np.take_along_axis(a.rank, mid, -1)
    right = np.take_along_axis(b.rank, mid, -2)
    return Matrices(best, _ranks(np.where(best < FAR, left * 4 + right, 16 + np.arange(4))), mid)


class Grammar:
    """Symbols and rules with their matrices; rules are pairs of earlier letters."""

    def __init__(self, rules: list[tuple[int, int]] = ()):
        self.rules: list[tuple[int, int]] = []
        edits = [_row_edits(s) for s in range(SYMBOLS)]
        self.texts = {(s, p, q): audit for s, e in enumerate(edits) for (p, q), (_, audit) in e.items()}
        cost = np.full((SYMBOLS, 4, 4), FAR, np.int64)
        rank = np.zeros((SYMBOLS, 4, 4), np.int64)
        for s, e in enumerate(edits):
            for p in range(4):
                # Unreachable ends come last.
                line = sorted(range(4), key=lambda q: (0, e[p, q][1]) if (p, q) in e else (1, str(q)))
                for place, q in enumerate(line):
                    rank[s, p, q] = place
            for (p, q), (c, _) in e.items():
                cost[s, p, q] = c
        self.matrices = Matrices(cost, rank, np.zeros_like(rank))
        self.extend(rules)

    def extend(self, rules) -> None:
        """Add rules over letters known so far; all their products are taken at once."""
        rules = list(rules)
        if not rules:
            return
        left, right = (np.array(x) for x in zip(*rules))
        new = product(self.matrices[left], self.matrices[right])
        self.matrices = Matrices(*(np.concatenate([getattr(self.matrices, k), getattr(new, k)]) for k in ("cost", "rank", "mid")))
        self.rules += rules

    def compress(self, sequences: list[str]) -> list[str]:
        joined = "\n".join(sequences)
        for i, (a, b) in enumerate(self.rules):
            joined = joined.replace(chr(FIRST + a) + chr(FIRST + b), chr(FIRST + SYMBOLS + i))
        return joined.split("\n")

    def audit(self, letter: int, p: int, q: int) -> str:
        """The rope of one entry, spelled out; remembered for all conversations of the task."""
        found = self.texts.get((letter, p, q))
        if found is None:
            a, b = self.rules[letter - SYMBOLS]
            m = int(self.matrices.mid[letter, p, q])
            found = self.texts[letter, p, q] = self.audit(a, p, m) + self.audit(b, m, q)
        return found

    def __getstate__(self):
        return self.rules

    def __setstate__(self, rules):
        # The rules of one round only use letters of earlier ones, so the levels can be found again.
        self.__init__()
        level: list[tuple[int, int]] = []
        for rule in rules:
            if max(rule) >= SYMBOLS + len(self.rules):
                self.extend(level)
                level = []
            level.append(rule)
        self.extend(level)


class Chains:
    """Products of whole sequences, all of a batch at once, letter by letter."""

    def __init__(self, grammar: Grammar, sequences: list[str]):
        self.grammar = grammar
        letters = [np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.int64) - FIRST for s in grammar.compress(sequences)]
        order = sorted(range(len(letters)), key=lambda i: -len(letters[i]))
        self.place = {i: k for k, i in enumerate(order)}
        self.letters = [letters[i] for i in order]
        lengths = np.array([len(x) for x in self.letters])
        now = grammar.matrices[np.array([x[0] for x in self.letters])]
        self.mids = []
        for t in range(1, int(lengths.max())):
            n = int((lengths > t).sum())
            step = product(now[slice(n)], grammar.matrices[np.array([x[t] for x in self.letters[:n]])])
            self.mids.append(step.mid.astype(np.int8))
            for k in ("cost", "rank"):
                getattr(now, k)[:n] = getattr(step, k)
        self.total = now

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.total.cost[self.place[i]], self.total.rank[self.place[i]]

    def audit(self, i: int, p: int, q: int) -> str:
        k = self.place[i]
        parts = []
        for t in range(len(self.letters[k]) - 1, 0, -1):
            m = int(self.mids[t - 1][k, p, q])
            parts.append(self.grammar.audit(int(self.letters[k][t]), m, q))
            q = m
        parts.append(self.grammar.audit(int(self.letters[k][0]), p, q))
        return "".join(reversed(parts))


def columns(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return batch({k: pa.array(x, t) for (k, t), x in zip(kinds.items(), zip(*rows))}, kinds)


# ---- rows of the conversations ----


def damage(conversations: DataFrame) -> DataFrame:
    """(key, turn, role, text) after the damage; ``key`` stands for the conversation's id and is never null."""
    text = F.coalesce(F.col("text"), F.lit(" "))
    turn = F.col("turn").cast("long")
    name = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit(" ")) for c in (F.col("conv_id"), F.col("turn"))])
    kind = F.crc32(name.cast("binary")) % 20
    rows = conversations.select(
        conversation_key().alias("key"), turn.alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
    ).where("kind <> 0")
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", copies).drop("copy", "kind")


def conversation_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def _with_hash(rows: DataFrame) -> DataFrame:
    """h1, h2: 128 bits that stand for (role, text)."""
    return rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64("text", F.lit(1), "role")})


def _symbols(rows: DataFrame) -> DataFrame:
    """One row per distinct (key, turn, hash) with its number of copies ``n``, its symbol and that of further copies."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    end = F.right(bare, F.lit(1))
    role = F.position(F.substring("role", 1, 1), F.lit("sua"))
    state = F.when(bare == "", FAULTS.index("blank")).when(~end.isin(".", "!", "?"), FAULTS.index("truncated")).otherwise(0)
    keys = _with_hash(rows).select(
        "key", "turn", "h1", "h2", state.cast("tinyint").alias("fault"),
        # position() finds an empty role at once, which is no role.
        F.when((role > 0) & (F.col("role") != ""), role - 1).otherwise(3).cast("tinyint").alias("role_at"),
    )
    # Repeated rows become counts before anything is shuffled.
    merged = keys.groupBy("key", "turn", "h1", "h2", "fault", "role_at").agg(F.count(F.lit(1)).alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    first = merged.where(F.col("fault") != FAULTS.index("blank")).groupBy("key", "h1", "h2").agg(F.min(when).alias("first"))
    seen = when > F.col("first")
    at = F.col("role_at") * len(FAULTS)
    again = F.when(F.col("fault") == FAULTS.index("blank"), F.col("fault")).otherwise(FAULTS.index("duplicate"))
    return merged.join(first, ["key", "h1", "h2"], "left").select(
        "key", "turn", "h1", "h2", "n",
        (at + F.when(seen, FAULTS.index("duplicate")).otherwise(F.col("fault"))).cast("int").alias("symbol"),
        (at + again).cast("int").alias("again"),
    )


BLOCK = {
    "key": pa.string(), "block": pa.int64(), "sequence": pa.string(), "turns": pa.list_(pa.int64()),
    "h1s": pa.list_(pa.int64()), "h2s": pa.list_(pa.int64()),
}
BLOCK_SQL = "key string, block long, sequence string, turns array<bigint>, h1s array<bigint>, h2s array<bigint>"


def _blocks(symbols: DataFrame, most: int) -> DataFrame:
    """Sequences of at most ``most`` rows in order; ``block`` grows along a conversation.

    The range partitioning cuts by (key, turn, hash), so a conversation may lie in many tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 40
        now, rows, done, held = None, [], [], 0
        for b in batches:
            for key, turn, h1, h2, n, symbol, again in zip(*(b.column(k).to_pylist() for k in range(7))):
                for i in range(n):
                    if rows and (key != now or len(rows) == most):
                        letters, *lists = zip(*rows)
                        done.append((now, number + len(done), "".join(letters), *map(list, lists)))
                        held, rows = held + len(rows), []
                    if held >= 65_536:
                        number += len(done)
                        yield columns(done, BLOCK)
                        done, held = [], 0
                    now = key
                    rows.append((chr(FIRST + (again if i else symbol)), turn, h1, h2))
        if rows:
            letters, *lists = zip(*rows)
            done.append((now, number + len(done), "".join(letters), *map(list, lists)))
        if done:
            yield columns(done, BLOCK)

    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2")]
    dealt = symbols.repartitionByRange(*order).sortWithinPartitions(*order)
    return map_arrow(dealt.select("key", "turn", "h1", "h2", "n", "symbol", "again"), run, BLOCK_SQL)


# ---- Re-Pair ----


def _pair_counts(sequences: DataFrame, grammar: Grammar) -> DataFrame:
    """(pair, n) over all sequences as the grammar leaves them; the pair -1 counts symbols."""
    kinds = {"pair": pa.int64(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            short = grammar.compress(b.column(0).to_pylist())
            codes = np.frombuffer("\n".join(short).encode("utf-32-le"), np.uint32).astype(np.int64)
            times = np.repeat(b.column(1).to_numpy(zero_copy_only=False), [len(s) + 1 for s in short])[: len(codes)]
            inner = (codes[:-1] != 10) & (codes[1:] != 10)
            pairs, at = np.unique(((codes[:-1] - FIRST) << 16 | (codes[1:] - FIRST))[inner], return_inverse=True)
            counts = np.bincount(at, times[:-1][inner], len(pairs)).astype(np.int64)
            yield batch({"pair": np.append(pairs, -1), "n": np.append(counts, times[codes != 10].sum())}, kinds)

    return map_arrow(sequences, run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def train(sequences: DataFrame, repair: Repair) -> Grammar:
    """Re-Pair in rounds over sequences (sequence, n): of the most frequent pairs, those that share no letter become rules together.

    A round brings at most ``max_rules`` counts to the driver.
    """
    grammar = Grammar()
    for _ in range(repair.max_rounds):
        room = repair.max_rules - len(grammar.rules)
        if room <= 0:
            break
        found = _pair_counts(sequences, grammar).where("n > 1").orderBy(F.desc("n"), "pair").limit(repair.max_rules).collect()
        symbols = sum(r["n"] for r in found if r["pair"] == -1)
        rules, used, covered = [], set(), 0
        for r in found:
            rule = (r["pair"] >> 16, r["pair"] & 0xFFFF)
            if r["pair"] >= 0 and len(rules) < room and not used & set(rule):
                rules.append(rule)
                used |= set(rule)
                covered += r["n"]
        if covered < max(2, repair.least_gain * symbols):
            break
        grammar.extend(rules)
    return grammar


# ---- states between blocks, edits, texts ----


def _block_matrices(blocks: DataFrame, grammar: Grammar) -> DataFrame:
    """(key, block, costs, ranks): sixteen numbers each."""
    kinds = {"key": pa.string(), "block": pa.int64(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                rows = part.column(2).to_pylist()
                distinct = {s: i for i, s in enumerate(dict.fromkeys(rows))}
                chains = Chains(grammar, list(distinct))
                found = [chains.of(i) for i in range(len(distinct))]
                yield batch({
                    "key": part.column(0), "block": part.column(1),
                    "costs": [found[distinct[s]][0].ravel() for s in rows], "ranks": [found[distinct[s]][1].ravel() for s in rows],
                }, kinds)

    return map_arrow(blocks.select("key", "block", "sequence"), run, "key string, block long, costs array<bigint>, ranks array<bigint>")


def _paths(matrices: DataFrame) -> DataFrame:
    """(key, block, enter, leave, cost, ending): the states around each block of the cheapest repair.

    Blocks of a conversation go by in order; only four bytes a block are kept until its end is known. cost and ending
    are those of the whole conversation, on its last block (null on the others).
    """
    kinds = {
        "key": pa.string(), "block": pa.int64(), "enter": pa.int32(), "leave": pa.int32(), "cost": pa.int64(), "ending": pa.string(),
    }

    def path(key: str, numbers: list[int], middles: list[np.ndarray], cost: np.ndarray, rank: np.ndarray) -> list[tuple]:
        total, _, leave = min((int(cost[q]) + ENDING[q][0], int(rank[q]), q) for q in range(4))
        whole, out = (total, ENDING[leave][1]), []
        for number, m in zip(reversed(numbers), reversed(middles)):
            out.append((key, number, int(m[leave]), leave, *whole))
            leave, whole = int(m[leave]), (None, None)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, numbers, middles, cost, rank, done = None, [], [], None, None, []
        for b in batches:
            costs = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4)
            ranks = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4)
            for i, (k, number) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if k != key:
                    if key is not None:
                        done += path(key, numbers, middles, cost, rank)
                    key, numbers, middles = k, [], []
                    cost, rank = np.array([0, FAR, FAR, FAR]), np.arange(4)
                step = product(Matrices(cost[None], rank[None], rank[None]), Matrices(costs[i], ranks[i], ranks[i]))
                cost, rank = step.cost[0], step.rank[0]
                numbers.append(number)
                middles.append(step.mid[0].astype(np.int8))
            if done:
                yield columns(done, kinds)
                done = []
        if key is not None:
            yield columns(path(key, numbers, middles, cost, rank), kinds)

    dealt = matrices.repartition("key").sortWithinPartitions("key", "block")
    return map_arrow(dealt, run, "key string, block long, enter int, leave int, cost long, ending string")


KEPT_SQL = "key string, block long, audit string, counts array<bigint>, kept array<struct<turn:bigint,h1:bigint,h2:bigint,before:string,role:string>>"
_KEPT = pa.list_(pa.struct([("turn", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("before", pa.string()), ("role", pa.string())]))
NAMES = {"u": "user", "a": "assistant"}
AFTER = "+"


def _edited(blocks: DataFrame, grammar: Grammar) -> DataFrame:
    """Audit, fault counts (blank, duplicate, truncated, illegal, first role, last role) and kept rows of each block with its states.

    A kept row has the lines inserted before it, and its new role (null: its own). Lines after the last kept row of a block
    are a row of their own with the key of the block's last row and the role AFTER.
    """
    kinds = {"key": pa.string(), "block": pa.int64(), "audit": pa.string(), "counts": pa.list_(pa.int64()), "kept": _KEPT}

    def kept_rows(state: int, audit: str, sequence: str, turns: list, h1s: list, h2s: list) -> list[tuple]:
        out, before, i = [], "", 0
        for letter in audit:
            role = _wanted_role(state)
            if letter == "I":
                before += NAMES[role] + ":\n"
                state = NEXT[state][role]
                continue
            if letter != "D":
                if letter == "K":
                    role = ROLES[(ord(sequence[i]) - FIRST) // len(FAULTS)]
                out.append((turns[i], h1s[i], h2s[i], before, NAMES[role] if letter == "R" else None))
                before, state = "", NEXT[state][role]
            i += 1
        if before:
            out.append((turns[-1], h1s[-1], h2s[-1], before, AFTER))
        return [dict(zip(("turn", "h1", "h2", "before", "role"), x)) for x in out]

    def counted(sequence: str) -> list[int]:
        codes = np.frombuffer(sequence.encode(), np.uint8).astype(np.int64) - FIRST
        role, fault = codes // len(FAULTS), codes % len(FAULTS)
        a, b = role[:-1], role[1:]
        legal = ((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))
        faults = [int((fault == FAULTS.index(x)).sum()) for x in ("blank", "duplicate", "truncated")]
        return [*faults, int((~legal).sum()), int(role[0]), int(role[-1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256).to_pylist()
                distinct = {s: i for i, s in enumerate(dict.fromkeys(r["sequence"] for r in part))}
                chains = Chains(grammar, list(distinct))
                audits: dict[tuple, str] = {}
                out = []
                for r in part:
                    how = r["sequence"], r["enter"], r["leave"]
                    if how not in audits:
                        audits[how] = chains.audit(distinct[how[0]], how[1], how[2])
                    rows = kept_rows(r["enter"], audits[how], r["sequence"], r["turns"], r["h1s"], r["h2s"])
                    out.append((r["key"], r["block"], audits[how], counted(r["sequence"]), rows))
                yield columns(out, kinds)

    return map_arrow(blocks.select("key", "block", "sequence", "turns", "h1s", "h2s", "enter", "leave"), run, KEPT_SQL)


def _hashed(kept: DataFrame, rows: DataFrame) -> DataFrame:
    """(key, repaired_sha256): what is kept of each conversation, joined with its texts in one sorted stream.

    kept: key, turn, h1, h2, kind, block, before, role. A kind 0 precedes the texts (kind 1) of its key, kind 2 follows them, and
    kind 3 ends the conversation.
    """
    kinds = {"key": pa.string(), "repaired_sha256": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, empty, wanted = None, None, True, None
        done: list[tuple] = []

        def line(text: str) -> None:
            nonlocal empty
            digest.update(text.encode() if empty else b"\n" + text.encode())
            empty = False

        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(8)))
            for k, turn, h1, h2, kind, before, role, text in rows:
                if k != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest, empty, wanted = k, hashlib.sha256(), True, None
                if kind != 1:
                    for inserted in before.split("\n")[:-1]:
                        line(inserted)
                    wanted = (turn, h1, h2, role) if kind == 0 else None
                elif wanted is not None and wanted[:3] == (turn, h1, h2):
                    line(f"{wanted[3] or role}:{text}")
                    wanted = None
            if done:
                yield batch({"key": [x[0] for x in done], "repaired_sha256": [x[1] for x in done]}, kinds)
                done = []
        if key is not None:
            yield batch({"key": [key], "repaired_sha256": [digest.hexdigest()]}, kinds)

    none = F.lit(None).cast("string")
    texts = _with_hash(rows).select("key", "turn", "h1", "h2", F.lit(1).alias("kind"), none.alias("before"), "role", "text")
    texts = texts.withColumn("block", F.lit(0).cast("long"))
    marks = kept.select("key", "turn", "h1", "h2", "kind", "before", "role", none.alias("text"), "block")
    order = ["key", F.col("kind") == 3, F.col("turn").asc_nulls_first(), "h1", "h2", "kind", "block"]
    dealt = marks.unionByName(texts).repartition("key").sortWithinPartitions(*order)
    return map_arrow(dealt, run, "key string, repaired_sha256 string")


def repair_conversations(conversations: DataFrame, repair: Repair = Repair()) -> DataFrame:
    """One row per conv_id: gaps, fault counts, cost and audit of the cheapest repair, and the hash of the repaired text."""
    rows = damage(conversations)
    blocks = stored(_blocks(_symbols(rows), repair.block_rows))
    sequences = stored(blocks.groupBy("sequence").agg(F.count(F.lit(1)).alias("n")))
    grammar = train(sequences, repair)
    paths = stored(_paths(_block_matrices(blocks, grammar)))
    edited = stored(_edited(blocks.join(paths, ["key", "block"]), grammar))

    kept = edited.select("key", "block", F.explode("kept").alias("k")).select(
        "key", "k.turn", "k.h1", "k.h2", F.when(F.col("k.role") == AFTER, 2).otherwise(0).alias("kind"), "block", "k.before", "k.role"
    )
    endings = paths.where(F.length("ending") > 0).select(
        "key", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"),
        F.lit(3).alias("kind"), "block",
        F.when(F.col("ending") == "II", "user:\nassistant:\n").otherwise("assistant:\n").alias("before"),
        F.lit(None).cast("string").alias("role"),
    )
    hashes = _hashed(kept.unionByName(endings), rows)

    # Blocks of a conversation meet as numbers, and as the audit, which is one text by its contract.
    whole = edited.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("block", "audit", F.col("counts")[4].alias("first"), F.col("counts")[5].alias("last")))).alias("parts"),
        *[F.sum(F.col("counts")[i]).alias(name) for i, name in enumerate(("blank", "duplicate", "truncated", "inside"))],
    )
    seam = F.aggregate(
        F.sequence(F.lit(1), F.size("parts") - 1), F.lit(0).cast("long"),
        lambda n, i: n + F.when(
            F.concat(F.get(F.col("parts.last"), i - 1), F.lit("-"), F.get(F.col("parts.first"), i)).isin("0-1", "1-2", "2-1"), 0
        ).otherwise(1),
    )
    whole = whole.select(
        "key", "blank", "duplicate", "truncated", F.array_join("parts.audit", "").alias("audit"),
        (F.col("inside") + F.when(F.size("parts") > 1, seam).otherwise(0)).alias("illegal"),
    )
    ends = paths.where("cost is not null").select("key", "cost", "ending")
    turns = rows.where("turn is not null").select("key", "turn").distinct()
    gaps = turns.groupBy("key").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    ids = conversations.select("conv_id", conversation_key().alias("key")).distinct()
    found = ids
    for part in (whole, ends, gaps, hashes):
        found = found.join(part, "key", "left")
    zero = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(
        "conv_id", *zero, F.concat(F.coalesce("audit", F.lit("")), F.coalesce("ending", F.lit(""))).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
