"""A range coder for token ids that mixes order-0 to order-2 predictions.

A segment of ids is cut into blocks, each coded on its own from the same initial state and
protected by a CRC-32 of its ids, so a damaged block spoils no other and the blocks of a chunk are
coded in lockstep as lanes of array operations.  For each id three predictions share the code space:

* order 2: the id that followed the last two ids before, with a confidence of 0 to 3;
* order 1: the id that followed the last id before, likewise;
* order 0: the id frequencies of the segment, stored in its header, on what the others leave.

The shares of order 2 and order 1 are weights that adapt per block, one pair for each state of both
confidences and of their agreement.  The coder has 64 bits of state and emits 32 bits whenever its
range falls below 2**32; a range that reaches over a multiple of 2**32 is cut there, so carries
never occur.

Order 0 is learnt from the whole segment, orders 1 and 2 and all weights inside a block.  What the
blocks share, head and id table, is written twice with a CRC-32 each, so that no single damage
spoils more than one block.

A segment is a row of chunks of up to ``MAX_BLOCKS`` blocks, so its ids are not limited in number.
Chunk: ``frame, frame, head, head, units``.  Frame: bytes of the units, bytes of a head, and the CRC
of both (little-endian ``Q I I``).  Head: ``magic, block length, ids, table bytes`` (``4s I Q I``),
the zlib-packed id table (ids and frequencies as unsigned 32-bit), per block its CRC and number of
32-bit units (``I I``), and the CRC of all this (``I``).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

MAGIC = b"CMR4"
BLOCK = 512
#: Blocks of a chunk; lane numbers have 16 bits.
MAX_BLOCKS = 1 << 14
_HEAD = struct.Struct("<4sIQI")
_FRAME, _WORD = struct.Struct("<QII"), struct.Struct("<I")

_U = np.uint64
_BOTTOM, _SHIFT = _U(1) << _U(32), _U(32)
#: Bits of the shares of the orders, and of the id frequencies below them.
_MIX, _ZERO = 12, 17
_WHOLE = 1 << _MIX
_BITS = _U(_MIX + _ZERO)
_SLOTS = 256
#: Weights, in 65536ths: bounds that leave every order a share, and the first ones by confidence.
_LEAST, _MOST = 256, 61440
_FIRST2 = np.array([12000, 26000, 40000, 50000])
_FIRST1 = np.array([3000, 6000, 10000, 14000])


class DamagedBlock(ValueError):
    """A block whose ids do not agree with its checksum."""


class _Model:
    """Predictions and weights of all lanes."""

    def __init__(self, lanes: int) -> None:
        self.base = np.arange(lanes) * _SLOTS
        self.state_base = np.arange(lanes) * 32
        # A slot holds an id and its confidence; -4 is no id.
        self.after1 = np.full(lanes * _SLOTS, -4, np.int32)
        self.after2 = np.full(lanes * _SLOTS, -4, np.int32)
        state = np.arange(32)
        self.weights = np.tile(_FIRST2[state // 4 % 4] << 16 | _FIRST1[state % 4], lanes)

    def predict(self, m: int, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Both predicted ids, the share of order 2 and that of both orders, for the first m lanes."""
        slot1 = last * 40503
        slot2 = before * 30011
        slot2 += slot1
        for slot, shift in ((slot1, 5), (slot2, 4)):
            slot >>= shift
            slot &= _SLOTS - 1
            slot += self.base[:m]
        self.slot1, self.slot2 = slot1, slot2
        self.entry1, self.entry2 = self.after1.take(slot1), self.after2.take(slot2)
        one, two = self.entry1 >> 2, self.entry2 >> 2
        self.sure1, self.sure2 = self.entry1 & 3, self.entry2 & 3
        state = (one == two).astype(np.int32)
        state <<= 2
        state += self.sure2
        state <<= 2
        state += self.sure1
        self.state = self.state_base[:m] + state
        own = self.weights.take(self.state)
        self.own2, self.own1 = own >> 16, own & 65535
        share2 = self.own2 >> 16 - _MIX
        share1 = _WHOLE - share2
        share1 *= self.own1
        share1 >>= 16
        return two, one, share2, share1 + share2

    def learn(self, ids: np.ndarray, same2: np.ndarray, same1: np.ndarray, hit1: np.ndarray) -> None:
        for own, hit in ((self.own2, same2), (self.own1, hit1)):
            aim = hit * (_MOST - _LEAST)
            aim += _LEAST
            aim -= own
            aim >>= 4
            own += aim
        self.own2 <<= 16
        self.own2 |= self.own1
        self.weights[self.state] = self.own2
        fresh = (ids << 2).astype(np.int32)
        for table, slot, entry, sure, same in (
            (self.after1, self.slot1, self.entry1, self.sure1, same1),
            (self.after2, self.slot2, self.entry2, self.sure2, same2),
        ):
            entry += sure < 3
            table[slot] = np.where(same, entry, fresh)


def _frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur and their shares of 2**17, each at least 1."""
    counts = np.bincount(ids)
    known = np.flatnonzero(counts)
    total = 1 << _ZERO
    if len(known) > total // 2:
        raise ValueError("more distinct ids in a segment than the coder provides for")
    share = 1 + counts[known] * (total - len(known)) // counts.sum()
    share[np.argmax(share)] += total - share.sum()
    return known, share


def _active(n: int, block: int) -> np.ndarray:
    """Lanes with an id left in each step; only the last lane may be shorter."""
    lanes = -(-n // block)
    return np.where(np.arange(block) < n - (lanes - 1) * block, lanes, lanes - 1)


def _rows(values: np.ndarray, block: int) -> np.ndarray:
    """Values as a matrix (step, lane), filled up with zeros."""
    full = np.zeros(-(-len(values) // block) * block, np.int32)
    full[: len(values)] = values
    return np.ascontiguousarray(full.reshape(-1, block).T)


def _cut(low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The range up to the next multiple of _BOTTOM."""
    return np.minimum(width, (_U(0) - low - _U(1) & _BOTTOM - _U(1)) + _U(1))


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The segment for any number of non-negative ids under 2**28."""
    ids = np.asarray(ids, np.int64)
    size = block * min(MAX_BLOCKS, 1 << 16)
    return b"".join(_encode_chunk(ids[at : at + size], block) for at in range(0, len(ids), size))


def _encode_chunk(ids: np.ndarray, block: int) -> bytes:
    known, share = _frequencies(ids)
    table = zlib.compress(np.concatenate([known, share]).astype("<u4").tobytes(), 6)
    first = np.zeros(known[-1] + 1, np.int64)
    size = np.zeros(known[-1] + 1, np.int64)
    first[known], size[known] = np.cumsum(share) - share, share
    steps = _rows(ids, block)
    lanes = steps.shape[1]
    last = before = np.zeros(lanes, np.int64)
    model = _Model(lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
    out_lanes: list[np.ndarray] = []
    out_units: list[np.ndarray] = []
    for t, m in enumerate(_active(len(ids), block)):
        now = steps[t, :m].astype(np.int64)
        two, one, share2, both = model.predict(m, last[:m], before[:m])
        same2, same1 = two == now, one == now
        hit1 = same1 > same2
        rest = _WHOLE - both
        begin = np.where(hit1, share2 << _ZERO, (both << _ZERO) + rest * first.take(now))
        begin *= ~same2
        extent = np.where(same2, share2 << _ZERO, np.where(hit1, both - share2 << _ZERO, rest * size.take(now)))
        l, w = low[:m], width[:m]
        w >>= _BITS
        l += w * begin.view(_U)
        w *= extent.view(_U)
        todo = np.flatnonzero(w < _BOTTOM)
        a = l.take(todo)
        out_lanes.append(todo.astype(np.uint16))
        out_units.append((a >> _SHIFT).astype(np.uint32))
        w[todo] = _cut(a, w.take(todo)) << _SHIFT
        l[todo] = a << _SHIFT
        model.learn(now, same2, same1, hit1)
        last, before = now, last
    for unit in (low >> _SHIFT, low & _BOTTOM - _U(1)):
        out_lanes.append(np.arange(lanes, dtype=np.uint16))
        out_units.append(unit.astype(np.uint32))
    place = np.concatenate(out_lanes)
    units = np.concatenate(out_units)[np.argsort(place, kind="stable")]
    sums = [zlib.crc32(ids[k : k + block].astype("<u4").tobytes()) for k in range(0, len(ids), block)]
    index = np.stack([np.array(sums, np.uint32), np.bincount(place, minlength=lanes).astype(np.uint32)], 1)
    head = _HEAD.pack(MAGIC, block, len(ids), len(table)) + table + index.astype("<u4").tobytes()
    head += _WORD.pack(zlib.crc32(head))
    body = units.astype("<u4").tobytes()
    frame = _FRAME.pack(len(body), len(head), zlib.crc32(_FRAME.pack(len(body), len(head), 0)))
    return b"".join([frame, frame, head, head, body])


def _sound(copies: list[memoryview], is_sound: Callable[[memoryview], bool]) -> memoryview:
    for copy in copies:
        if is_sound(copy):
            return copy
    raise ValueError("not a segment of this format, or both copies of a head are damaged")


def _frame_is_sound(frame: memoryview) -> bool:
    body, head, crc = _FRAME.unpack(frame)
    return crc == zlib.crc32(_FRAME.pack(body, head, 0))


def _head_is_sound(head: memoryview) -> bool:
    at = len(head) - _WORD.size
    return bytes(head[:4]) == MAGIC and zlib.crc32(head[:at]) == _WORD.unpack_from(head, at)[0]


def decode(data: bytes | memoryview, damaged: list[int] | None = None) -> np.ndarray:
    """The ids of a segment as unsigned 32-bit numbers.

    A block whose checksum fails raises DamagedBlock; if a list is given, its number goes there
    instead, and its ids are what could be read.
    """
    data, at, blocks = memoryview(data), 0, 0
    parts = [np.zeros(0, np.uint32)]
    while at < len(data):
        frames = [data[at + k * _FRAME.size : at + (k + 1) * _FRAME.size] for k in range(2)]
        body, size, _ = _FRAME.unpack(_sound(frames, _frame_is_sound))
        at += 2 * _FRAME.size
        head = _sound([data[at : at + size], data[at + size : at + 2 * size]], _head_is_sound)
        at += 2 * size
        ids, bad, lanes = _decode_chunk(head, data[at : at + body])
        if bad and damaged is None:
            raise DamagedBlock(f"block {blocks + bad[0]}")
        if damaged is not None:
            damaged += [blocks + b for b in bad]
        parts.append(ids)
        at, blocks = at + body, blocks + lanes
    return np.concatenate(parts)


def _decode_chunk(head: memoryview, body: memoryview) -> tuple[np.ndarray, list[int], int]:
    """The ids, the numbers of damaged blocks, and the number of blocks."""
    _, block, n, packed = _HEAD.unpack_from(head)
    at = _HEAD.size
    table = np.frombuffer(zlib.decompress(head[at : at + packed]), "<u4").astype(np.int64)
    known, share = table[: len(table) // 2], table[len(table) // 2 :]
    place = np.repeat(np.arange(len(known), dtype=np.int32), share)
    first = np.cumsum(share) - share
    lanes = -(-n // block)
    at += packed
    index = np.frombuffer(head[at : at + 8 * lanes], "<u4").reshape(lanes, 2)
    units = np.frombuffer(body, "<u4")
    # Damaged blocks may read on; a few zeros follow, and reading stays inside.
    units = np.concatenate([units, np.zeros(2, np.uint32)]).astype(_U)
    counts = index[:, 1].astype(np.int64)
    at = np.cumsum(counts) - counts
    code = np.zeros(lanes, _U)
    for _ in range(2):
        code = code << _SHIFT | units.take(at, mode="clip")
        at += 1
    low, width = np.zeros(lanes, _U), np.full(lanes, ~_U(0), _U)
    last = before = np.zeros(lanes, np.int64)
    model = _Model(lanes)
    out = np.zeros((block, lanes), np.int32)
    for t, m in enumerate(_active(n, block)):
        two, one, share2, both = model.predict(m, last[:m], before[:m])
        l, w = low[:m], width[:m]
        w >>= _BITS
        value = ((code[:m] - l) // w).view(np.int64)
        # What rounding leaves at the end of the range is never coded.
        np.minimum(value, (1 << _MIX + _ZERO) - 1, out=value)
        order = value >> _ZERO
        hit2 = order < share2
        hit1 = (order < both) > hit2
        rest = _WHOLE - both
        k = place.take((value - (both << _ZERO)) // rest, mode="clip")
        ids = np.where(hit2, two, np.where(hit1, one, known.take(k)))
        begin = np.where(hit1, share2 << _ZERO, (both << _ZERO) + rest * first.take(k))
        begin *= ~hit2
        extent = np.where(hit2, share2 << _ZERO, np.where(hit1, both - share2 << _ZERO, rest * share.take(k)))
        l += w * begin.view(_U)
        w *= extent.view(_U)
        todo = np.flatnonzero(w < _BOTTOM)
        a = l.take(todo)
        w[todo] = _cut(a, w.take(todo)) << _SHIFT
        l[todo] = a << _SHIFT
        where = at.take(todo)
        code[todo] = code.take(todo) << _SHIFT | units.take(where, mode="clip")
        at[todo] = where + 1
        out[t, :m] = ids
        # An id may also be coded by order 0 although an order predicts it; learn as the encoder does.
        same2, same1 = two == ids, one == ids
        model.learn(ids, same2, same1, same1 > same2)
        last, before = ids, last
    whole = out.T.reshape(-1)[:n].astype(np.uint32)
    raw = memoryview(whole.astype("<u4").tobytes())
    sums = [zlib.crc32(raw[4 * k * block : 4 * (k + 1) * block]) for k in range(lanes)]
    return whole, np.flatnonzero(np.array(sums, np.uint32) != index[:, 0]).tolist(), lanes
