import hashlib
import random
import re
from functools import cache

import pytest

from sensorloom.llm import turn_repair as repair

KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
EMITTED = (2, 2, 3, 2)


def cheapest(turns):
    """(cost, initials) over all edits; turns are (initial, fault)."""

    @cache
    def best(i, q, inserted):
        options = [(0, "")] if i == len(turns) and q in (0, 3) else []
        moves = [(i, EMITTED[q], inserted + 1, 3, "I")] if inserted < 3 else []
        if i < len(turns):
            initial, fault = turns[i]
            moves.append((i + 1, q, 0, 4, "D"))
            if fault not in ("blank", "duplicate"):
                late = 3 * (fault == "truncated")
                moves.append((i + 1, EMITTED[q], 0, 3 + late, "R"))
                if (q, initial) in KEPT:
                    moves.append((i + 1, KEPT[q, initial], 0, late, "K"))
        for j, state, more, cost, letter in moves:
            if rest := best(j, state, more):
                options.append((cost + rest[0], letter + rest[1]))
        return min(options, default=None)

    return best(0, 0, 0)


def brute(rows):
    """The report of one conversation's (turn, role, text)."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]

    def key(row):
        _, r, x = row
        return (row[0] is not None, row[0] or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest())

    rows.sort(key=key)
    turns, seen = [], set()
    for _, r, x in rows:
        shown = x.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (r, x) in seen else None if shown[-1] in ".!?" else "truncated"
        seen.add((r, x))
        turns.append((r[:1], fault))
    cost, audit = cheapest(tuple(turns))
    out, q, at = [], 0, 0
    for letter in audit:
        _, r, x = rows[min(at, len(rows) - 1)]
        if letter in "IR":
            q = EMITTED[q]
            out.append(f"{('user', 'assistant')[q - 2]}:{x if letter == 'R' else ''}")
        elif letter == "K":
            q = KEPT[q, r[:1]]
            out.append(f"{r}:{x}")
        at += letter != "I"
    roles = "".join(o[0] for o in out)
    assert re.fullmatch("(s?(ua)+)?", roles)
    numbers = [t for t, *_ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    count = [sum(f == k for _, f in turns) for k in ("blank", "duplicate", "truncated")]
    illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(turns, turns[1:]))
    return (gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def test_blocks_equal_all_edits():
    rng = random.Random(1)
    kinds = (None, "blank", "duplicate", "truncated")
    for _ in range(3000):
        codes = bytes(rng.randrange(16) if rng.random() < 0.5 else rng.choice([1, 2]) for _ in range(rng.randint(0, 9)))
        cuts = sorted(rng.randint(0, len(codes)) for _ in range(rng.randint(0, 3)))
        blocks = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)]) if b > a]
        after, checkpoints = repair._END, []
        for block in reversed(blocks):
            checkpoints.append(after)
            after = repair.block_before(repair.block_matrix(block), after)
        audit, state = "", 0
        for block, checkpoint in zip(blocks, reversed(checkpoints)):
            letters, state = repair.block_walks(block, checkpoint)[state]
            audit += letters
        audit += repair.last_insertions(state)
        assert (after[0], audit) == cheapest(tuple(("sua?"[c & 3], kinds[c >> 2]) for c in codes))


def conversations():
    rng = random.Random(7)
    texts = ["Hi.", "Yes!", "cut off", "", None, " \t\n", "Why? ", "é 🙂.", "Hi."]
    out = {None: [(None, None, None), (1, "user", "Hi."), (2, "assistant", "Yes!")], -1: [(None, "user", "a.")] * 3}
    out[-2] = [(5, "user", "same.")] * 40
    out[-3] = [(0, "", "x."), (9, "system", "y."), (4, "tool", "z."), (2**40, "assistant", "x" * 100_000 + ".")]
    for conv in range(60):
        roles = ["user", "assistant"] * 3 + ["system", "s", "ü", "", None]
        turns = [rng.choice([*range(8), None]) for _ in range(rng.randint(1, 9))]
        out[conv] = [(t, rng.choice(roles), rng.choice(texts)) for t in turns]
    # Long enough for many blocks and for several partitions.
    out[100] = [(t, rng.choice(["user", "assistant"]), f"{t}{rng.choice(['.', ''])}") for t in range(700)]
    return out


@pytest.mark.parametrize("least", [1, 64])
def test_report_equals_brute_force(spark, least):
    rows = conversations()
    flat = [(c, *r, "x", 1) for c, own in rows.items() for r in own]
    table = spark.createDataFrame(flat, "conv_id long, turn long, role string, text string, audit string, cost int")
    got = repair.report(table.repartition(5), least).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    import sys

    sys.setrecursionlimit(20_000)
    assert {r.conv_id: tuple(r[n] for n in names) for r in got} == {c: brute(own) for c, own in rows.items()}
    assert len(got) == len(rows)


def test_damage_and_empty_tables(spark):
    import zlib

    schema = "conv_id long, turn long, role string, text string"
    rows = [(c, t, "assistant", "A. b!") for c in range(40) for t in [0, 1, None]] + [(None, None, None, None)]
    want = []
    for c, t, r, x in rows:
        shown = ":".join(" " if v is None else str(v) for v in (c, t))
        fate = zlib.crc32(shown.encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        one = (c, t, "user" if fate == 4 else r, {1: "", 2: "A b"}.get(fate, x))
        want += [one] * {0: 0, 3: 2}.get(fate, 1)
    got = [tuple(r) for r in repair.damaged(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert repair.report(spark.createDataFrame([], schema)).count() == 0
