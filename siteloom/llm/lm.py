"""Stupid-backoff language-model scores, computed relationally.

S(w | context) = c(context w) / c(context) if the n-gram occurs elsewhere, else 0.4 S(w | a context shorter by a
word); a single word's score is c(w) / N. A document's own occurrences are left out of all counts, so that no
document is scored by itself; a word that occurs nowhere else counts once. A text's first words have shorter
contexts. The order is a parameter; three, the usual one, is the default.

How it is computed. Texts are coded into chunks of many documents (a dictionary of word hashes and the words'
places in it), dealt by chunk. A chunk asks for the counts of its distinct n-grams once, whatever the number of
its documents: one row for each part of the hash space, with arrays of n-grams and their numbers in the chunk. The
rows are dealt by part; there the count table of that part is summed by n-gram and joined to the arrays that
asked, in Arrow batches of one part, whose size is bounded as the number of parts grows with the corpus. So only
one shuffle moves n-grams, and a pair that all documents hold comes once for each chunk, not for each document.
The counts return by chunk as arrays, where logarithms are summed by document.

An n-gram can occur in another document only if both n-grams inside it do. So orders one and two are counted
first, and of a higher order only what its lower orders leave possible; counts of what is asked stay exact.

Edge cases: null texts and texts without words have n_words 0 and null scores; every row is a document, so
repeated rows and rows that share a doc_id count for each other; null doc_ids are kept; words longer than
others are no matter, as only 64-bit hashes travel; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import hash_words, ngram_hashes, small_batches, table

BACKOFF = 0.4
#: A chunk is closed at so many words, or at so many for each part of the hash space if that is more.
CHUNK_WORDS, WORDS_A_PART = 1 << 20, 16
#: Parts of the hash space: so many for each shuffle partition, for even ones, and more if a part would hold more words.
PARTS, PART_WORDS = 8, 1 << 22
#: A count from which on a byte does not hold it.
LARGE = 255
CHUNK = "chunk long, ids array<long>, lens array<int>, words array<long>, codes binary"
#: An n-gram travels as 48 bits of its hash beside the part, which tells more bits the more data there is. Numbers
#: above 1 come first, so that ones need not be sent.
ASKED = "chunk long, part int, first int, high array<int>, low array<short>, own array<int>"


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else [], kind))


def pack_codes(codes: np.ndarray) -> bytes:
    """Small numbers first are cheap: the upper halves of frequent words' codes are zeros."""
    halves = codes.astype("<u4").view("<u2").reshape(-1, 2).T
    return zlib.compress(np.ascontiguousarray(halves).tobytes(), 1)


def unpack_codes(data: bytes) -> np.ndarray:
    halves = np.frombuffer(zlib.decompress(data), "<u2").reshape(2, -1)
    return halves[0].astype(np.int64) | halves[1].astype(np.int64) << 16


def coded(docs: DataFrame, chunk_words: int) -> DataFrame:
    """Chunks of docs(doc_id, text): the ids, the texts' lengths in words, a dictionary of word hashes and the words' places."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        ids, hashes, held = [], [], 0

        def chunk() -> pa.RecordBatch:
            lens = [len(h) for h in hashes]
            words, codes, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            words, codes = words[order], pack_codes(np.argsort(order)[codes])
            columns = [pa.array([at], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int32())), _lists([words.view(np.int64)], pa.int64()), pa.array([codes], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "lens", "words", "codes"])

        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(i)
                hashes.append(hash_words((text or "").encode("utf-8", "surrogatepass").lower().split()))
                held += len(hashes[-1]) + 1
                if held >= chunk_words:
                    yield chunk()
                    at, ids, hashes, held = at + 1, [], [], 0
        if ids:
            yield chunk()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(code, CHUNK)


class Positions:
    """A chunk's word positions: for each order the n-gram that ends there, and what is known of its count."""

    def __init__(self, lens: np.ndarray, words: np.ndarray, codes: bytes):
        self.words = words.view(np.uint64)
        self.hashes = self.words[unpack_codes(codes)]
        self.doc = np.repeat(np.arange(len(lens)), lens)
        self.place = np.arange(len(self.doc)) - np.repeat(np.cumsum(lens) - lens, lens)
        #: Occurrences elsewhere of the n-gram of each order that ends at a position; 0 also where there is none.
        self.elsewhere: dict[int, np.ndarray] = {}

    def asked(self, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
        """The distinct n-grams of these orders whose counts matter, in order, their numbers here, and who asks."""
        grams, where = [], []
        for n in orders:
            can = self.place >= n - 1
            if n > 2:
                below = self.elsewhere[n - 1] > 0
                can &= below & np.concatenate([[False], below[:-1]])
            ends = np.flatnonzero(can)
            grams.append(ngram_hashes(self.hashes, n)[ends - (n - 1)])
            where.append(ends)
        every, at, n = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        cuts = np.cumsum([len(g) for g in grams])[:-1]
        return every, n, list(zip(orders, where, np.split(at, cuts), strict=True))

    def answer(self, asked: list[tuple[int, np.ndarray, np.ndarray]], counts: np.ndarray) -> None:
        """Takes the corpus counts of what was asked and leaves out each document's own."""
        for n, ends, at in asked:
            _, same, own = np.unique(self.doc[ends] * max(1, len(counts)) + at, return_inverse=True, return_counts=True)
            rest = np.zeros(len(self.doc), np.int64)
            rest[ends] = counts[at] - own[same]
            self.elsewhere[n] = rest

    def scores(self, order: int, total: int) -> np.ndarray:
        """The logarithm of each position's score."""
        lens = np.bincount(self.doc)[self.doc] if len(self.doc) else self.doc
        out = np.log(np.maximum(self.elsewhere[1], 1) / np.maximum(total - lens, 1))
        for n in range(2, order + 1):
            here = np.flatnonzero(self.place >= n - 1)
            up = self.elsewhere[n][here]
            context = np.maximum(self.elsewhere[n - 1][here - 1], 1)
            out[here] = np.where(up > 0, np.log(np.maximum(up, 1) / context), np.log(BACKOFF) + out[here])
        return out


def parts_of(grams: np.ndarray, own: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which distinct n-grams travel - by part, then numbers above 1 first - and their parts in it."""
    part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.lexsort((own == 1, part))
    return order, part[order]


def _rounds(order: int) -> list[tuple[int, ...]]:
    """Orders that are counted together."""
    return [(1, 2) if order > 1 else (1,), *((n,) for n in range(3, order + 1))]


def _known(b: pa.RecordBatch, k: int, order: int, done: int, parts: int) -> Positions:
    """Row k of a batch of chunks with the answers of the first `done` rounds."""
    p = Positions(*(b.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("lens", "words")), b.column("codes")[k].as_py())
    for r, orders in enumerate(_rounds(order)[:done]):
        every, own, who = p.asked(orders)
        values = read_counts(b.column(f"answers{r}")[k])
        if len(values) != len(every):
            raise ValueError("a chunk's counts don't fit its n-grams")
        counts = np.zeros(len(every), np.int64)
        counts[parts_of(every, own, parts)[0]] = values
        p.answer(who, counts)
    return p


def ask(chunks: DataFrame, order: int, done: int, parts: int) -> DataFrame:
    """The next round's n-grams of chunks that have the answers of the rounds before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                grams, own, _ = _known(b, k, order, done, parts).asked(_rounds(order)[done])
                way, part = parts_of(grams, own, parts)
                grams, own = grams[way], own[way]
                held, first, size = np.unique(part, return_index=True, return_counts=True)
                many = np.add.reduceat(own > 1, first) if len(first) else first
                high, low = (grams >> np.uint64(16)).astype(np.uint32).view(np.int32), grams.astype(np.uint16).view(np.int16)
                columns = [pa.array(np.full(len(held), b.column("chunk")[k].as_py(), np.int64)), pa.array(held.astype(np.int32)), pa.array(first.astype(np.int32))]
                for x, n in ((high, size), (low, size), (own[own > 1].astype(np.int32), many)):
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(x)))
                if len(held):
                    yield pa.RecordBatch.from_arrays(columns, ["chunk", "part", "first", "high", "low", "own"])

    return chunks.mapInArrow(run, ASKED)


def count_part(asked: pa.Table) -> pa.Table:
    """The count table of one part of the hash space, read out for all chunks that asked: a byte a count, and the large ones."""
    size, many = (pc.list_value_length(asked.column(c)).to_numpy() for c in ("high", "own"))
    high, low, more = (pc.list_flatten(asked.column(c)).to_numpy() for c in ("high", "low", "own"))
    first = np.cumsum(size) - size
    own = np.ones(len(high), np.int64)
    own[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(more))] = more
    _, at = np.unique(high.astype(np.int64) << 16 | low.astype(np.int64) & 0xFFFF, return_inverse=True)
    n = np.bincount(at, weights=own).astype(np.int64)[at]
    small = np.minimum(n, LARGE).astype(np.uint8)
    large = [n[i:j][small[i:j] == LARGE] for i, j in zip(first, first + size, strict=True)]
    counts = [small[i:j].tobytes() for i, j in zip(first, first + size, strict=True)]
    return pa.table([asked.column("chunk"), asked.column("first"), pa.array(counts, pa.binary()), pa.array(large, pa.list_(pa.int64()))], ["chunk", "first", "counts", "large"])


def counted(asked: DataFrame, partitions: int) -> DataFrame:
    """(chunk, answers): the corpus counts of what each chunk asked, by the place where a part begins in its order."""
    answers = asked.repartition(partitions, "part").groupBy("part").applyInArrow(count_part, "chunk long, first int, counts binary, large array<long>")
    return answers.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("first", "counts", "large"))).alias("answers"))


def read_counts(answers: pa.ListScalar) -> np.ndarray:
    if not answers.is_valid:
        return np.zeros(0, np.int64)
    parts = answers.as_py()
    counts = np.frombuffer(b"".join(x["counts"] for x in parts), np.uint8).astype(np.int64)
    counts[counts == LARGE] = [n for x in parts for n in x["large"]]
    return counts


def stupid_backoff(docs: DataFrame, order: int = 3) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, log_score (a sum of natural logarithms) and mean_log_score."""
    spark = docs.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 0
    parts = max(PARTS * partitions, total // PART_WORDS)
    chunks = coded(docs, max(CHUNK_WORDS, WORDS_A_PART * parts)).repartition(partitions, "chunk")
    rounds = _rounds(order)
    known = chunks
    for done in range(len(rounds)):
        answers = counted(ask(known, order, done, parts), partitions).withColumnRenamed("answers", f"answers{done}")
        known = known.join(answers.hint("merge"), "chunk", "left")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                p = _known(b, k, order, len(rounds), parts)
                lens = b.column("lens")[k].values.to_numpy(zero_copy_only=False)
                sums = np.bincount(p.doc, weights=p.scores(order, total), minlength=len(lens))
                yield pa.RecordBatch.from_arrays([b.column("ids")[k].values, pa.array(lens.astype(np.int64)), pa.array(sums, mask=lens == 0)], ["doc_id", "n_words", "log_score"])

    out = known.mapInArrow(score, "doc_id long, n_words long, log_score double")
    return out.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round(F.col("log_score") / F.col("n_words"), 6).alias("mean_log_score"))


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS n_words, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d),
g AS (SELECT *, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
c AS (
  SELECT *, count(*) OVER () AS total,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
    count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
    count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) AS c3
  FROM g),
b AS (SELECT *, lag(c1) OVER p AS b1, lag(c2) OVER p AS b2 FROM c WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
s AS (
  SELECT doc_id, n_words, sum(CASE
    WHEN i > 2 AND c3 > 0 THEN ln(CAST(c3 AS DOUBLE) / CAST(b2 AS DOUBLE))
    WHEN i > 1 AND c2 > 0 THEN ln(CAST(c2 AS DOUBLE) / CAST(b1 AS DOUBLE)) + CASE WHEN i > 2 THEN ln(0.4::DOUBLE) ELSE 0 END
    ELSE ln(CAST(greatest(c1, 1) AS DOUBLE) / CAST(greatest(total - n_words, 1) AS DOUBLE)) + (least(i, 3) - 1) * ln(0.4::DOUBLE) END) AS x
  FROM b GROUP BY 1, 2)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, round(s.x, 4) AS log_score, round(s.x / s.n_words, 6) AS mean_log_score
FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
