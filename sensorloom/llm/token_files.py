"""Token files: documents as ids in ascending doc_id order, coded in segments, and read back.

Documents are range-partitioned by id, encoded, and gathered into segments of at least
``SEGMENT_IDS`` ids (``id_coder``).  A segment row holds its place (part and ids before it in the
part), the ids and lengths of its documents, and the coded ids; segments are written as Parquet
in the shared folder and are decoded one by one.

Equal texts between spaces encode to equal ids, because the tokenizer of the ``word_bpe`` file
drops white space and never joins across it.  So a worker encodes a distinct piece once and looks
it up afterwards; the cache is emptied when it is full.

Defined cases: a null or empty text is only its end id; rows without an id come first; equal ids
are ordered by a hash of the text; repeated rows are repeated documents; empty tables give empty
files; further columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm import id_coder
from sensorloom.llm.tables import stage, with_key

END_ID = 2
SEGMENT_IDS = 1 << 21
CACHED_PIECES = 1_000_000


#: A word of lower-case Latin letters, or marks, or both: units of the tokenizer, whose pattern splits
#: between letters and other characters and whose normaliser keeps both as they are.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([.,;:!?]*)")
#: Characters of texts that are encoded together, and units of one call of the library.
_TOGETHER = 1 << 21
_UNITS = 2048


def _is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class _Pool:
    """Id sequences in one array, by number; number 0 is the empty sequence.  Arrays grow by halves."""

    def __init__(self) -> None:
        self.ids, self.first, self.count = np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.used = 0

    def put(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if not len(numbers):
            return
        most = int(numbers.max()) + 1
        for name, need in (("ids", self.used + len(ids)), ("first", most), ("count", most)):
            have = getattr(self, name)
            if need > len(have):
                setattr(self, name, np.concatenate([have, np.zeros(need // 2 + need - len(have), have.dtype)]))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[numbers] = self.used + np.cumsum(counts) - counts
        self.count[numbers] = counts
        self.used += len(ids)

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequences one after the other, and their lengths."""
        count = self.count[at]
        end = np.cumsum(count)
        total = int(end[-1]) if len(end) else 0
        return self.ids[np.arange(total) + np.repeat(self.first[at] - end + count, count)], count


class _Numbers(dict):
    """Numbers of strings in the order of their first use; unsettled ones stand in ``fresh``."""

    def __init__(self) -> None:
        super().__init__({"": 0})
        self.fresh: list[str] = []

    def __missing__(self, text: str) -> int:
        self[text] = number = len(self)
        self.fresh.append(text)
        return number

    def of(self, texts: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, texts), np.int64, len(texts))

    def settle(self) -> list[str]:
        fresh, self.fresh = self.fresh, []
        return fresh


class TextEncoder:
    """Encodes whole texts with a ``word_bpe`` file of the tokenizers library.

    Texts are cut into pieces at spaces and line feeds.  The pieces that a batch of texts brings up
    for the first time are encoded together.  A plain word and the marks after it are two pieces, each
    a unit of the tokenizer; a unit's last token is marked as the end of a word in the vocabulary, so
    the units of one call of the library are told apart by their ids.  Any other piece is encoded on
    its own.
    """

    def __init__(self, path: str, limit: int = CACHED_PIECES) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        vocabulary = self.tokenizer.get_vocab()
        self.ends_unit = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_unit[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        self.pieces, self.pool = _Numbers(), _Pool()

    def _learn_units(self, units: list[tuple[int, str]]) -> None:
        for at in range(0, len(units), _UNITS):
            numbers, some = zip(*units[at : at + _UNITS])
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.ends_unit[ids])
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not end each word with a token of its own")
            self.pool.put(np.array(numbers), ids, np.diff(ends, prepend=-1))

    def _learn_pieces(self) -> None:
        units: list[tuple[int, str]] = []
        others: list[tuple[int, str]] = []
        joined: list[tuple[int, int, int]] = []
        # Parts of joined pieces may be new as well.
        while fresh := self.pieces.settle():
            for number, piece in enumerate(fresh, len(self.pieces) - len(fresh)):
                plain = _PLAIN.fullmatch(piece)
                if not plain:
                    others.append((number, piece))
                elif plain[1] and plain[2]:
                    joined.append((number, plain[1], plain[2]))
                else:
                    units.append((number, piece))
            joined = [(n, *(self.pieces[p] if isinstance(p, str) else p for p in parts)) for n, *parts in joined]
        self._learn_units(units)
        for at in range(0, len(others), _UNITS):
            numbers, some = zip(*others[at : at + _UNITS])
            encoded = [e.ids for e in self.tokenizer.encode_batch(list(some), add_special_tokens=False)]
            sizes = np.array([len(e) for e in encoded], np.int64)
            self.pool.put(np.array(numbers), np.array([i for e in encoded for i in e], np.int32), sizes)
        if joined:
            numbers = np.array(joined)
            ids, counts = self.pool.gather(numbers[:, 1:].ravel())
            self.pool.put(numbers[:, 0], ids, counts[::2] + counts[1::2])

    def batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for some in _together(texts):
            numbers = []
            for text in some:
                if _is_latin(text) and "<|" not in text:
                    # The library lower-cases these characters in the same way; only the strings of
                    # special tokens, which are lower case, must not come about.
                    text = text.lower()
                # A line feed is white space to the tokenizer as a space is.
                numbers.append(self.pieces.of(text.replace("\n", " ").split(" ")))
            self._learn_pieces()
            for at in numbers:
                yield self.pool.gather(at)[0]
            if len(self.pieces) > self.limit:
                self._reset()

    def ids(self, text: str | None) -> np.ndarray:
        (found,) = self.batch([text])
        return found


def _together(texts: list[str | None]) -> Iterator[list[str]]:
    """The texts in lists of bounded length, a long one on its own; null is empty."""
    some: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if some and size + len(text) > _TOGETHER:
            yield some
            some, size = [], 0
        some.append(text)
        size += len(text)
    if some:
        yield some


@lru_cache(maxsize=1)
def _encoder(path: str) -> TextEncoder:
    """One for all tasks of a worker process, so that its cache stays warm."""
    return TextEncoder(path)


_SEGMENT = pa.schema(
    [
        ("part", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary()),
    ]
)
_SEGMENT_TYPE = (
    "part int, before bigint, n_ids bigint, doc_ids array<bigint>, lengths array<bigint>, data binary"
)


def write(docs: DataFrame, tokenizer_file: str, segment_ids: int = SEGMENT_IDS) -> DataFrame:
    """Writes the files and returns the table of their segments."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        part, before = TaskContext.get().partitionId(), 0
        names: list[int | None] = []
        kept: list[np.ndarray] = []
        size = 0

        def closed() -> pa.RecordBatch:
            lengths = [len(x) for x in kept]
            data = id_coder.encode(np.concatenate(kept))
            row = [[part], [before], [size], [names], [lengths], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _SEGMENT)], schema=_SEGMENT)

        for batch in batches:
            encoded = encoder.batch(batch.column("text").to_pylist())
            for name, ids in zip(batch.column("doc_id").to_pylist(), encoded):
                own = np.append(ids, END_ID)
                names.append(name)
                kept.append(own)
                size += len(own)
                if size >= segment_ids:
                    yield closed()
                    names, kept, before, size = [], [], before + size, 0
        if kept:
            yield closed()

    placed = with_key(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_text_hash")]
    ranged = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.select("doc_id", "text").mapInArrow(segments, _SEGMENT_TYPE))


def read(segments: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` of every document, from the files."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, before, _, names, lengths, data = (batch.column(c)[row] for c in range(6))
                ids = id_coder.decode(data.as_buffer()).astype("<u4")
                size = np.array(lengths.as_py(), np.int64)
                end = np.cumsum(size)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(end, size)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.as_py()] * len(size), pa.int32()),
                        names.values,
                        pa.array(before.as_py() + end - size),
                        pa.array(size),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    ids = segments.select(*_SEGMENT.names).mapInArrow(
        documents, "part int, doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )
    # One row per part, not per document, is put in order.
    sums = segments.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("_ids").over(earlier), F.lit(0)).alias("_base"))
    return ids.join(bases, "part").select(
        "doc_id", (F.col("start") + F.col("_base")).alias("start"), "n_tokens", "ids_crc32"
    )
