"""The grammar-compressed repair against a plain dynamic program over whole audits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from runlens.llm import conversation_repair as cr

LEGAL = re.compile(r"(s?(ua)+)?")
STEP = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
SCHEMA = "conv_id long, turn long, role string, text string, n long, key string"


def plain_repair(rows):
    """rows: (role, text, fault) in order. Cheapest (cost, audit), and the repaired lines."""
    best = {}
    for i in range(len(rows), -1, -1):
        for inserted in (2, 1, 0):
            for state in range(4):
                options = []
                if i == len(rows) and state in (0, 3):
                    options.append((0, ""))
                if inserted < 2:
                    for role, nxt in STEP[state].items():
                        if role != "s":
                            c, a = best[i, inserted + 1, nxt]
                            options.append((c + 3, "I" + a))
                if i < len(rows):
                    role, _, fault = rows[i]
                    late = 3 if fault == "truncated" else 0
                    c, a = best[i + 1, 0, state]
                    options.append((c + 4, "D" + a))
                    if fault not in ("blank", "duplicate"):
                        for other, nxt in STEP[state].items():
                            c, a = best[i + 1, 0, nxt]
                            if role[:1] == other:
                                options.append((c + late, "K" + a))
                            if other != "s":
                                options.append((c + 3 + late, "R" + a))
                best[i, inserted, state] = min(options, default=(10**9, ""))
    cost, audit = best[0, 0, 0]
    lines, i, state = [], 0, 0
    for letter in audit:
        wanted = "a" if state == 2 else "u"
        if letter == "I":
            lines.append(({"u": "user", "a": "assistant"}[wanted], ""))
            state = STEP[state][wanted]
            continue
        role, text, _ = rows[i]
        i += 1
        if letter == "R":
            role = {"u": "user", "a": "assistant"}[wanted]
        if letter != "D":
            lines.append((role, text))
            state = STEP[state][role[:1]]
    assert LEGAL.fullmatch("".join(r[:1] for r, _ in lines))
    return cost, audit, [f"{r}:{t}" for r, t in lines]


def plain(table, order):
    """The contract row by row; ``order`` sorts rows of one turn."""
    found = {}
    for conv, turn, role, text in table:
        rows = found.setdefault(conv, [])
        text = " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        role = "user" if kind == 4 else " " if role is None else role
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, rows in found.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, order[r[1:]]))
        seen, marked = set(), []
        for turn, role, text in rows:
            bare = text.rstrip("\x20\t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "ok"
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        count = [sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, lines = plain_repair(marked)
        out[conv] = (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def hash_order(spark, table):
    """The operator's order inside a turn."""
    pairs = {(role, text) for _, _, r, t in table for role in (r, "user", " ") for text in (t, " ", "", re.sub("[.!?]", "", t or "")) if role is not None and text is not None}
    df = cr._with_hash(spark.createDataFrame(sorted(pairs), "role string, text string"))
    return {(r["role"], r["text"]): (r["h1"], r["h2"]) for r in df.collect()}


def check(spark, table, **settings):
    df = spark.createDataFrame([(*r, 1, "x") for r in table], SCHEMA).repartition(3)
    got = cr.repair_conversations(df, cr.Repair(**settings)).collect()
    rows = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(rows) == len(got)
    assert rows == plain(table, hash_order(spark, table))


def random_table(seed, conversations=60, longest=14):
    rng = random.Random(seed)
    table = []
    for conv in [None, *range(conversations)]:
        for turn in rng.choices([None, *range(longest)], k=rng.randint(1, longest)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "maybe", " ", None, "", f"w{rng.random()}.", f"w{rng.random()}?\n", "日本 🙂"])
            table.append((conv, turn, role, text))
    return table


@pytest.mark.parametrize("settings", [{}, {"block_rows": 3, "max_rules": 5}, {"block_rows": 1, "max_rules": 0}])
def test_random_conversations(spark, settings):
    check(spark, random_table(7), **settings)


def test_a_long_conversation_in_many_blocks(spark):
    rng = random.Random(5)
    table = [(1, t, rng.choice(["user", "assistant"]), rng.choice([f"w{t}.", f"w{t}", "same.", ""])) for t in range(700)]
    table += [(2, 4, "user", "hot row.")] * 300 + [(3, None, "user", "Hi."), (3, None, "assistant", "Ho.")]
    check(spark, table, block_rows=16)


def test_the_tables_of_the_smallest_size(spark):
    import duckdb

    table = duckdb.sql("select conv_id, turn, role, text from '/root/testdata/sf0.001/conversations.parquet'").fetchall()
    check(spark, table)


def test_no_rows(spark):
    assert cr.repair_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products_agree_with_joined_audits():
    """Every rule's entries are the least (cost, audit) over all middle states, and ranks order the audits of a line."""
    rng = random.Random(2)
    grammar = cr.Grammar()
    for _ in range(4):
        n = cr.SYMBOLS + len(grammar.rules)
        grammar.extend([(rng.randrange(n), rng.randrange(n)) for _ in range(20)])
    copy = cr.Grammar()
    copy.__setstate__(grammar.__getstate__())
    for a, b in zip((grammar.matrices.cost, grammar.matrices.rank), (copy.matrices.cost, copy.matrices.rank)):
        assert (a == b).all()
    for r, (left, right) in enumerate(grammar.rules):
        letter = r + cr.SYMBOLS
        for p in range(4):
            line = {}
            for q in range(4):
                options = [
                    (int(grammar.matrices.cost[left, p, m] + grammar.matrices.cost[right, m, q]), grammar.audit(left, p, m) + grammar.audit(right, m, q))
                    for m in range(4)
                    if grammar.matrices.cost[left, p, m] < cr.FAR and grammar.matrices.cost[right, m, q] < cr.FAR
                ]
                if options:
                    assert min(options) == (grammar.matrices.cost[letter, p, q], grammar.audit(letter, p, q))
                    line[q] = grammar.audit(letter, p, q)
                else:
                    assert grammar.matrices.cost[letter, p, q] == cr.FAR
            by_rank = [line[q] for q in sorted(line, key=lambda q: grammar.matrices.rank[letter, p, q])]
            assert by_rank == sorted(line.values())
