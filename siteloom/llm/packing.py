"""Bounded-space online packing of token sequences.

Each task encodes its documents and keeps a fixed number of open windows. A document longer than a window is
cut at whole windows, which are full sequences at once; its remainder, like a short document, goes to the open
window where it leaves the least room (best fit). Where none has room and all are in use, the fullest is
emitted and a new one opened. Windows that are open when a task ends are leftovers: their pieces are packed
again, by the same rule, in ever fewer tasks, until one level has a single task.

Only the pieces' places are kept, not their ids. Sequence ids are unique: they hold the level, the task and a
running number. A level's rows are written to the shared folder before the next level reads them, so that a
lost executor cannot change what is already placed.

Edge cases: a null text is an empty one and takes the end id alone; null doc_ids are kept; rows that share a
doc_id are packed each on its own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, small_batches, table
from siteloom.llm.tokens import END_ID, encoder, vocabulary

WINDOW = 2048
#: Open windows of a task.
OPEN = 256
#: So many tasks' leftovers meet in one task of the next level.
FAN_IN = 32
#: Levels are bits 58 and up of a sequence id, tasks bits 32 to 57.
LEVEL_BIT, TASK_BIT = 58, 32
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open"]


class Packer:
    """Places pieces (doc_id, start, length, crc, doc_tokens) in windows, by best fit within bounded space."""

    def __init__(self, first: int, window: int, most: int):
        self.next, self.window, self.most = first, window, most
        self.rooms: list[tuple[int, int]] = []  # (room, sequence), sorted
        self.held: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _emit(self, seq: int, is_open: bool) -> None:
        offset = 0
        for piece in self.held.pop(seq):
            self.done.append((*piece, seq, offset, is_open))
            offset += piece[2]

    def add(self, piece: tuple) -> None:
        n = piece[2]
        k = bisect.bisect_left(self.rooms, (n, -1))
        if k < len(self.rooms):
            room, seq = self.rooms.pop(k)
        else:
            if len(self.rooms) >= self.most:
                self._emit(self.rooms.pop(0)[1], False)
            room, seq = self.window, self.next
            self.next += 1
            self.held[seq] = []
        self.held[seq].append(piece)
        if room == n:
            self._emit(seq, False)
        else:
            bisect.insort(self.rooms, (room - n, seq))

    def finish(self, is_open: bool) -> None:
        for _, seq in self.rooms:
            self._emit(seq, is_open)
        self.rooms.clear()

    def batch(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [()] * 8
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], NAMES)


def _first(level: int) -> int:
    return (level << LEVEL_BIT) | (TaskContext.get().partitionId() << TASK_BIT)


def place(docs: DataFrame, vocab: str, window: int = WINDOW, most: int = OPEN, end_id: int = END_ID) -> DataFrame:
    """Level 0: pieces of docs(doc_id, text), those of windows that are still open marked."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, packer = encoder(vocab), np.array([end_id], dtype="<u4").tobytes(), Packer(_first(0), window, most)
        for b in batches:
            for i, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist()), strict=True):
                data = ids + end
                total = len(data) // 4
                for at in range(0, total, window):
                    n = min(window, total - at)
                    packer.add((i, at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), total))
            yield packer.batch()
        packer.finish(True)
        yield packer.batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, PIECE)


def merge(pieces: DataFrame, level: int, last: bool, window: int = WINDOW, most: int = OPEN) -> DataFrame:
    """A later level: leftover pieces packed again. At the last level nothing stays open."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(_first(level), window, most)
        for b in batches:
            for piece in zip(*(b.column(c).to_pylist() for c in NAMES[:5]), strict=True):
                packer.add(piece)
            yield packer.batch()
        packer.finish(not last)
        yield packer.batch()

    return pieces.mapInArrow(pack, PIECE)


def pack(docs: DataFrame, vocab: str, window: int = WINDOW, most: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    small_batches(docs.sparkSession)
    rows = materialize(place(docs, vocab, window, most), "packed")
    tasks, level = max(1, docs.rdd.getNumPartitions()), 0
    out = rows.where("not open")
    while True:
        tasks, level = -(-tasks // fan_in), level + 1
        rows = materialize(merge(rows.where("open").repartition(tasks), level, tasks == 1, window, most), "packed")
        out = out.union(rows.where("not open"))
        if tasks == 1:
            return out.drop("open")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the last one, with the places of all remaining documents' pieces.

    A null text takes the end id alone; repeated rows are packed each; an empty table gives no pieces; columns
    other than doc_id and text are left out.
    """
    return pack(docs, vocabulary("byte_bpe_50k.json"))
