"""Repair of conversation structure by a square-root checkpointed dynamic program.

A conversation's turns are edited into ``(system? (user assistant)+)?`` at the least cost: Keep 0,
Rerole to user or assistant 3, Delete 4, Insert an empty turn of user or assistant 3; a turn that is
kept or reroled although truncated adds 3; blank and duplicate turns must be deleted.  Of the
cheapest edits those whose initials ``D I K R`` are the ASCII-least are taken.

The program's states are what the last emitted turn was: nothing, system, user or assistant.

* Turns are range-partitioned by conversation and place and cut into blocks, the k-th of a
  conversation (in a partition) ``LEAST + k`` turns long.  So n turns make at most about
  sqrt(2n) blocks of at most about sqrt(2n) turns, without n being known.  Each block has a cost
  matrix from its entry states to its exit states.
* Backward: the matrices of a conversation are chained from its end.  Only the cost vectors at block
  ends, the checkpoints, are stored.
* Forward: every block recomputes its own cost vectors from its checkpoint and walks forward, at
  each turn taking the least initial that stays tight.  It does so from each entry state, so that
  blocks need not wait for one another; chaining the exits then names the entry state.

Only the chains pass a conversation through one task, as a stream of one small row per block; the
digest of the repaired text, which is one hash over the whole conversation, streams the pieces.

Order: by turn, nulls first, then by a digest of role and text, then by a row number, so that turns
of one conversation with equal numbers, even repeated rows, are in a fixed order and a conversation
of any size and make-up is spread over tasks.

Defined cases: a null conv_id is a conversation of its own; a null role or text is one space; a role
other than system, user and assistant (told by its first character) cannot be kept; turns without
number come first and do not count as gaps; a conversation of which no turn is left has zeros and
empty edits; an empty table gives an empty table; further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.tables import stage

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
LEAST = 64
BLOCK_CHARS = 1 << 22
NAMES = ("user", "assistant")

START, SYSTEM, USER, ASSISTANT = range(4)
_NEVER = 1 << 40
#: State after a user or assistant turn that is inserted or reroled.
_NEXT = (USER, USER, ASSISTANT, USER)
#: State after a kept turn by (state, initial s, u, a or other); -1 where it cannot be kept.
_KEPT = ((SYSTEM, USER, -1, -1), (-1, USER, -1, -1), (-1, -1, ASSISTANT, -1), (-1, USER, -1, -1))
_INITIALS = "sua"
_LEGAL = ("su", "ua", "au")
CLEAN, BLANK, DUPLICATE, TRUNCATED_KIND = range(4)

#: After the last turn: cost of the insertions that complete the dialogue.
_END = (0, 2 * INSERT, INSERT, 0)


def _inserted(cost: list[int]) -> tuple[int, ...]:
    """Costs when turns may be inserted before; the longest useful insertion has two turns."""
    for _ in range(2):
        cost = [min(c, INSERT + cost[_NEXT[q]]) for q, c in enumerate(cost)]
    return tuple(min(c, _NEVER) for c in cost)


def _before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs before a turn with this code from those after it."""
    initial, kind = code & 3, code >> 2
    late = TRUNCATED * (kind == TRUNCATED_KIND)
    cost = []
    for q in range(4):
        best = DELETE + after[q]
        if kind not in (BLANK, DUPLICATE):
            best = min(best, REROLE + late + after[_NEXT[q]])
            if (kept := _KEPT[q][initial]) >= 0:
                best = min(best, late + after[kept])
        cost.append(best)
    return _inserted(cost)


@lru_cache(maxsize=1 << 16)
def _step(code: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...], tuple[tuple[str, int], ...]]:
    """For costs less their minimum: the growth of the minimum, the costs before the turn less it,
    and for each state the initials and the state after the turn.

    Costs less their minimum take few different values, so almost every call is a look-up.
    """
    initial, kind = code & 3, code >> 2
    late = TRUNCATED * (kind == TRUNCATED_KIND)
    cost = _before(code, after)
    moves = []
    for q in range(4):
        letters = ""
        while True:
            if cost[q] >= _NEVER:
                break
            if DELETE + after[q] == cost[q]:
                letters += "D"
                break
            if INSERT + cost[_NEXT[q]] == cost[q]:
                letters, q = letters + "I", _NEXT[q]
                continue
            kept = _KEPT[q][initial]
            if kept >= 0 and late + after[kept] == cost[q]:
                letters, q = letters + "K", kept
            else:
                letters, q = letters + "R", _NEXT[q]
            break
        moves.append((letters, q))
    least = min(cost)
    return least, tuple(c - least for c in cost), tuple(moves)


@lru_cache(maxsize=1 << 16)
def _matrix_step(code: int, after: tuple[tuple[int, ...], ...]) -> tuple[int, tuple[tuple[int, ...], ...]]:
    """The same for the four cost vectors that end in one state each."""
    cost = [_before(code, column) for column in after]
    least = min(min(column) for column in cost)
    return least, tuple(tuple(c - least if c < _NEVER else _NEVER for c in column) for column in cost)


def block_matrix(codes: bytes) -> list[int]:
    """Least cost from entry state q to exit state r of a block, at 4 * r + q."""
    total = 0
    columns = tuple(tuple(0 if q == r else _NEVER for q in range(4)) for r in range(4))
    for code in reversed(codes):
        grown, columns = _matrix_step(code, columns)
        total += grown
    return [c + total if c < _NEVER else _NEVER for column in columns for c in column]


def block_before(matrix: list[int], after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(matrix[4 * r + q] + after[r] for r in range(4)) for q in range(4))


def block_walks(codes: bytes, after: tuple[int, ...]) -> list[tuple[str, int]]:
    """Initials and exit state of the ASCII-least cheapest edits of a block, from each entry state.

    The initials of one turn are its insertions and then its own edit.
    """
    least = min(after)
    vector = tuple(c - least for c in after)
    moves = []
    for code in reversed(codes):
        _, vector, here = _step(code, vector)
        moves.append(here)
    moves.reverse()
    out = []
    for state in range(4):
        letters = []
        for here in moves:
            more, state = here[state]
            letters.append(more)
        out.append(("".join(letters), state))
    return out


def last_insertions(state: int) -> str:
    """Initials after the last turn."""
    return "I" * (_END[state] // INSERT)


# -- turns to blocks -----------------------------------------------------------------------------

_BLOCK = pa.schema(
    [
        ("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("codes", pa.binary()),
        ("matrix", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
    ]
)
_BLOCK_TYPE = (
    "conv_id bigint, part int, block bigint, codes binary, matrix array<bigint>, roles array<string>, texts array<string>"
)


def _blocks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Cuts the sorted turns of a partition into blocks, one row each."""
    part, number = TaskContext.get().partitionId(), 0
    rows: list[tuple] = []
    codes, roles, texts = bytearray(), [], []
    conv, own, chars, held = None, 0, 0, 0

    def close() -> None:
        nonlocal number, own, chars
        if codes:
            rows.append((conv, part, number, bytes(codes), block_matrix(bytes(codes)), roles[:], texts[:]))
            number, own, chars = number + 1, own + 1, 0
            codes.clear(), roles.clear(), texts.clear()

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _BLOCK)], schema=_BLOCK)
        rows.clear()
        return out

    for batch in batches:
        for name, code, role, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if name != conv:
                close()
                conv, own = name, 0
            codes.append(code)
            roles.append(role)
            texts.append(text)
            chars += len(text)
            held += len(text) + 100
            if len(codes) >= least + own or chars >= BLOCK_CHARS:
                close()
            if held >= BLOCK_CHARS and rows:
                yield emit()
                held = 0
    close()
    if rows:
        yield emit()


def _first(text: Column) -> Column:
    return F.substring(text, 1, 1)


def _blocked(turns: DataFrame, least: int) -> DataFrame:
    """Staged blocks of ``conv_id``, ``turn``, ``role``, ``text`` (the latter two not null)."""
    filled = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        "role",
        "text",
        F.sha2(F.concat_ws("", F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("_digest"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Row numbers are drawn once, for the repeats and for the order.
    rows = stage(filled)
    repeats = (
        rows.groupBy("conv_id", "_digest")
        .agg(F.min(F.struct("turn", "_row")).alias("_first"), F.count("*").alias("_n"))
        .where(F.col("_n") > 1)
        .select(F.col("conv_id").alias("_conv"), F.col("_digest").alias("_repeated"), F.col("_first._row").alias("_original"))
    )
    marked = rows.join(
        repeats, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_digest") == F.col("_repeated")), "left"
    )
    shown = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    kind = (
        F.when(shown == "", BLANK)
        .when(F.col("_original") != F.col("_row"), DUPLICATE)
        .when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED_KIND)
        .otherwise(CLEAN)
    )
    initial = F.coalesce(*(F.when(_first("role") == c, k) for k, c in enumerate(_INITIALS)), F.lit(3))
    code = (initial + 4 * kind).cast("int").alias("_code")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "_digest", "_row"]
    placed = marked.select("conv_id", "turn", "_digest", "_row", code, "role", "text")
    sorted_rows = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(sorted_rows.select("conv_id", "_code", "role", "text").mapInArrow(partial(_blocks, least=least), _BLOCK_TYPE))


# -- chains --------------------------------------------------------------------------------------


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*held), schema)], schema=schema)


def _by_conversation(df: DataFrame, *order: Column) -> DataFrame:
    """Rows of a conversation together and in order; a conversation of many blocks stays a stream."""
    return df.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


_CHECKPOINT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("after", pa.list_(pa.int64()))])


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs at the end of each block, from rows in descending order."""

    def rows():
        for _, blocks in groupby(_records(batches), key=lambda r: r[0]):
            after = _END
            for _, part, block, matrix in blocks:
                yield part, block, after
                after = block_before(matrix, after)

    return _batches(rows(), _CHECKPOINT)


_WALKS = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()),
     ("walks", pa.list_(pa.string())), ("exits", pa.list_(pa.int32()))]
)


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv, part, block, codes, after in _records(batches):
            walks, exits = zip(*block_walks(codes, tuple(after)))
            yield conv, part, block, walks, exits

    return _batches(rows(), _WALKS, 256)


_ENTRY = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("entry", pa.int32()), ("audit", pa.string())])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry state and edits of each block, from rows in ascending order."""

    def rows():
        for _, blocks in groupby(_records(batches), key=lambda r: r[0]):
            state, held = START, None
            for _, part, block, walks, exits in blocks:
                if held:
                    yield held
                held = (part, block, state, walks[state])
                state = exits[state]
            yield (*held[:3], held[3] + last_insertions(state))

    return _batches(rows(), _ENTRY, 256)


# -- edited turns --------------------------------------------------------------------------------


def _edited(codes: bytes, roles: list[str], texts: list[str], entry: int, audit: str) -> tuple[list[str], list[str], int]:
    """Roles and texts of the repaired turns of a block, and the cost of its edits."""
    out_roles, out_texts = [], []
    state, at, cost = entry, 0, 0
    for letter in audit:
        if letter == "I":
            state = _NEXT[state]
            out_roles.append(NAMES[state - USER])
            out_texts.append("")
            cost += INSERT
            continue
        if letter == "D":
            cost += DELETE
        else:
            cost += TRUNCATED * (codes[at] >> 2 == TRUNCATED_KIND)
            if letter == "R":
                state = _NEXT[state]
                cost += REROLE
                out_roles.append(NAMES[state - USER])
            else:
                state = _KEPT[state][codes[at] & 3]
                out_roles.append(roles[at])
            out_texts.append(texts[at])
        at += 1
    return out_roles, out_texts, cost


_PIECE = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("block", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()),
     ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
)
_PIECE_TYPE = (
    "conv_id bigint, part int, block bigint, audit string, cost bigint, codes binary, roles array<string>, texts array<string>"
)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv, part, block, codes, roles, texts, entry, audit in _records(batches):
            own_roles, own_texts, cost = _edited(codes, roles, texts, entry, audit)
            yield conv, part, block, audit, cost, codes, own_roles, own_texts

    return _batches(rows(), _PIECE, 64)


def repaired(turns: DataFrame, least: int = LEAST) -> DataFrame:
    """Repaired blocks of ``conv_id``, ``turn``, ``role``, ``text``: ``conv_id``, ``part`` and
    ``block`` (their order), ``audit`` and ``cost`` of the edits, ``codes`` of the turns before
    (initial + 4 * fault) and the ``roles`` and ``texts`` of the turns after."""
    space = F.lit(" ")
    filled = turns.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")
    )
    blocks = _blocked(filled, least)
    last = [F.desc("part"), F.desc("block")]
    checkpoints = _by_conversation(blocks.select("conv_id", "part", "block", "matrix"), *last).mapInArrow(
        _checkpoints, "part int, block bigint, after array<bigint>"
    )
    walks = (
        blocks.select("conv_id", "part", "block", "codes")
        .join(checkpoints, ["part", "block"])
        .select("conv_id", "part", "block", "codes", "after")
        .mapInArrow(_walked, "conv_id bigint, part int, block bigint, walks array<string>, exits array<int>")
    )
    entries = _by_conversation(walks, F.asc("part"), F.asc("block")).mapInArrow(
        _entries, "part int, block bigint, entry int, audit string"
    )
    edits = blocks.drop("matrix").join(entries, ["part", "block"])
    columns = ["conv_id", "part", "block", "codes", "roles", "texts", "entry", "audit"]
    return edits.select(*columns).mapInArrow(_pieces, _PIECE_TYPE)


def faults(codes: bytes) -> tuple[int, int, int]:
    """Blank, duplicate and truncated turns."""
    kinds = np.bincount(np.frombuffer(codes, np.uint8) >> 2, minlength=4)
    return int(kinds[BLANK]), int(kinds[DUPLICATE]), int(kinds[TRUNCATED_KIND])


_LEGAL_STEP = np.zeros((4, 4), bool)
for _pair in _LEGAL:
    _LEGAL_STEP[_INITIALS.index(_pair[0]), _INITIALS.index(_pair[1])] = True

_REPORT = pa.schema(
    [("conv_id", pa.int64()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")),
     ("audit", pa.string()), ("repaired_sha256", pa.string())]
)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for conv, blocks in groupby(_records(batches), key=lambda r: r[0]):
            counts, illegal, cost = np.zeros(3, int), 0, 0
            audits, digest, last, between = [], hashlib.sha256(), None, ""
            for _, _, _, audit, own_cost, codes, roles, texts in blocks:
                counts += faults(codes)
                initials = np.frombuffer(codes, np.uint8) & 3
                if last is not None:
                    illegal += not _LEGAL_STEP[last, initials[0]]
                illegal += int((~_LEGAL_STEP[initials[:-1], initials[1:]]).sum())
                last = initials[-1]
                audits.append(audit)
                cost += own_cost
                for role, text in zip(roles, texts):
                    digest.update(f"{between}{role}:{text}".encode())
                    between = "\n"
            yield conv, *map(int, counts), int(illegal), cost, "".join(audits), digest.hexdigest()

    return _batches(rows(), _REPORT, 256)


def report(turns: DataFrame, least: int = LEAST) -> DataFrame:
    """Per conversation of ``turns``: ``gaps`` in the turn numbers, faults, cost, edits and a digest
    of the repaired turns (``role:text``, joined by line feeds)."""
    pieces = _by_conversation(repaired(turns, least), F.asc("part"), F.asc("block"))
    kinds = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    found = pieces.mapInArrow(_reports, f"conv_id bigint, {kinds}, audit string, repaired_sha256 string")
    span = F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn")
    gaps = turns.groupBy(F.col("conv_id").cast("long").alias("_conv")).agg(F.coalesce(span, F.lit(0)).cast("long").alias("gaps"))
    return found.join(gaps, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by a checksum of conversation and number modulo 20: 0 drops a turn, 1 empties
    its text, 2 removes its ``.!?``, 3 repeats it, 4 sets its role to user.  Nulls are one space."""

    def shown(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(fate == 4, "user").otherwise(shown("role"))
    times = F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.where(fate != 0).select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_copy")
    ).drop("_copy")
