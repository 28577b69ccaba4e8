"""Best-fit decreasing packing of whole token sequences, exact over all documents.

Best fit decreasing takes documents from the longest to the shortest and puts each into the open bin that it
leaves the least room in. Documents of one length are alike, so the packing follows from the number of pieces of
each length alone: a histogram of at most as many rows as a window has tokens, whatever the input. The bins are
kept in runs of equal bins; a segment tree over remaining capacities finds the tightest run that a length fits
in, in logarithmic time. What comes out is a bounded table of moves (length, ranks of its pieces, bins, offset).

Spark does the rest: tasks encode texts and number their pieces of each length; prefix sums over the tasks'
counts turn these numbers into ranks over the whole table; a piece finds its move by binary search of its
(length, rank). No document, piece or bin passes through the driver, and a length that a third of all pieces
have is spread like any other.

A document longer than a window is cut into full windows; its first piece is what is left over and takes part
in the packing like a short document.

Edge cases: a null text is an empty one and takes the end id alone; null doc_ids are kept; rows that share a
doc_id are packed each on its own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_broadcast, materialize, small_batches, table
from siteloom.llm.tokens import encoder, vocabulary

WINDOW, END_ID = 2048, 0
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
#: Ranks take the bits below a length.
RANK_BITS = 48
#: Rows of the table of counts by task and length that may be broadcast.
MAX_BASES = 300_000


class Capacities:
    """A segment tree over remaining capacities 1..most: which of them some open bin has."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.filled = [0] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(most + 1)]

    def put(self, room: int, first: int, bins: int) -> None:
        """Opens a run of bins with so much room each."""
        self.runs[room].append((first, bins))
        if len(self.runs[room]) == 1:
            self._mark(room, 1)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        if not self.runs[room]:
            self._mark(room, -1)
        return run

    def _mark(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.filled[node] += by
            node //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least `need` that an open bin has."""
        node = need + self.size
        if self.filled[node]:
            return need
        while node > 1:  # up to a right sibling that holds one, then down its left edge
            if node % 2 == 0 and self.filled[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node + (not self.filled[2 * node])
                return node - self.size
            node //= 2
        return None


def moves(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Best fit decreasing of so many pieces of each length.

    A row for each run of bins that takes pieces of a length: length, first rank, first bin, pieces a bin, offset.
    Rows ascend by (length, first rank).
    """
    open_bins, bins, out = Capacities(window), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_bins.tightest(length)
            if room is None:
                room, each = window, window // length
                first, run = bins, max(1, left // each)
                bins += run
            else:
                each = room // length
                first, run = open_bins.take(room)
            each = min(each, left)
            used = min(run, left // each)
            if used < run:
                open_bins.put(room, first + used, run - used)
            out.append((length, rank, first, each, window - room))
            if room > each * length:
                open_bins.put(room - each * length, first, used)
            rank, left = rank + used * each, left - used * each
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def cut(total: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full windows after a first one that may be shorter."""
    first = total % window or window
    return [(0, first), *((at, window) for at in range(first, total, window))]


def encoded(docs: DataFrame, vocab: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs(doc_id, text), numbered by length in each task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocab), np.array([end_id], dtype="<u4").tobytes()
        part, seen = TaskContext.get().partitionId(), [0] * (window + 1)
        for b in batches:
            rows = []
            for i, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist()), strict=True):
                data = ids + end
                for k, (at, n) in enumerate(cut(len(data) // 4, window)):
                    rows.append((i, k, at, n, zlib.crc32(data[4 * at : 4 * (at + n)]), part, seen[n]))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECE)


def place(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each of the pieces (length, part, number, ...) with its sequence_id and offset."""
    counts = materialize(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts")
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    found = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(moves(found, window))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, ranks, bins, each, offsets = plan.value.T
        keys = (plan.value[:, 0] << RANK_BITS) | ranks
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            k = np.searchsorted(keys, (length << RANK_BITS) | rank, "right") - 1
            bin_no, at = np.divmod(rank - ranks[k], each[k])
            columns = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(bins[k] + bin_no), pa.array(offsets[k] + at * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(bounded_broadcast(bases, MAX_BASES), ["part", "length"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("number")).alias("rank")).mapInArrow(put, PLACED)


def pack_decreasing(docs: DataFrame, vocab: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of docs(doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    small_batches(docs.sparkSession)
    return place(materialize(encoded(docs, vocab, window, end_id), "pieces"), window)


def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_decreasing(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
