"""Bounded-space online packing of tokenised documents into fixed windows."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinseg.llm.shared import whole, written
from kinseg.llm.wordids import KEPT, word_ids

WINDOW = 2048
OPEN = 64
#: Leftovers of so many partitions meet in one of the next round.
FAN_IN = 16
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"
TYPES = [*[pa.int64()] * 7, pa.bool_()]


class Windows:
    """At most `limit` open windows; a piece goes where the least room is left over.

    Where it fits nowhere and all windows are in use, the fullest is emitted.
    """

    def __init__(self, size: int, limit: int, first_id: int):
        self.size, self.limit, self.next = size, limit, first_id
        self.free: list[tuple[int, int]] = []
        self.pieces: dict[int, list] = {}
        self.out: list[tuple] = []

    def _emit(self, number: int, still_open: bool = False) -> None:
        offset = 0
        for piece in self.pieces.pop(number):
            self.out.append((*piece, number, offset, still_open))
            offset += piece[2]

    def add(self, piece: tuple) -> None:
        length = piece[2]
        at = bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, number = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                self._emit(self.free.pop(0)[1])
            room, number = self.size, self.next
            self.next += 1
            self.pieces[number] = []
        self.pieces[number].append(piece)
        if room > length:
            insort(self.free, (room - length, number))
        else:
            self._emit(number)

    def close(self, still_open: bool) -> None:
        for _, number in self.free:
            self._emit(number, still_open)
        self.free = []

    def batches(self, least: int = 0) -> Iterator[pa.RecordBatch]:
        if len(self.out) > least:
            columns = [pa.array(c, t) for c, t in zip(zip(*self.out), TYPES)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCHEMA.split(", ")])
            self.out = []


def _first_id(level: int) -> int:
    """Sequence ids that no other partition or round gives: round, partition, then a count."""
    return level << 58 | TaskContext.get().partitionId() << 32


def pack(docs: DataFrame, path: str, window: int = WINDOW, open_windows: int = OPEN, fan_in: int = FAN_IN, kept: int = KEPT) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids by the word-level BPE file at `path`, then id 1. Every
    full window of a long document is a sequence of its own; what remains is one
    piece, placed best-fit among `open_windows` windows of its partition. Windows
    still open at the end of a partition leave as leftovers: `fan_in` partitions'
    leftovers are packed again together, round by round, until one partition is
    left, whose few windows are the last sequences. A round is written to the
    shared folder, so that ids and offsets stay the same when tasks run again.

    A worker keeps the ids of `kept` distinct words, twice over. A null or empty text is the id 1 alone; null and repeated doc_ids are packed
    as they come; an empty table gives no rows. Other columns are ignored.
    """

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, words = Windows(window, open_windows, _first_id(0)), word_ids(path, kept)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.ids(text.as_py()) + b"\x01\0\0\0"
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[start * 4 : (start + window) * 4]
                    windows.add((doc, start, len(part) // 4, crc32(part), total))
            yield from windows.batches(20_000)
        windows.close(True)
        yield from windows.batches()

    def again(level: int, last: bool):
        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(window, open_windows, _first_id(level))
            for batch in batches:
                for piece in sorted(zip(*(c.to_pylist() for c in batch.columns)), key=lambda p: -p[2]):
                    windows.add(piece)
                yield from windows.batches(20_000)
            windows.close(not last)
            yield from windows.batches()

        return packed

    placed = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text")).mapInArrow(tokenised, SCHEMA), "packed")
    done, level = [placed.filter("not open")], 1
    left = placed.filter("open").select(*PIECE)
    tasks = left.rdd.getNumPartitions()
    while True:
        tasks = max(1, tasks // fan_in)
        last = tasks == 1
        placed = written(left.coalesce(tasks).mapInArrow(again(level, last), SCHEMA), "leftovers")
        done.append(placed.filter("not open"))
        if last:
            break
        left, level = placed.filter("open").select(*PIECE), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("open")
