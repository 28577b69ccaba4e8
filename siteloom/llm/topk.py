"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension's sign. Equal codes collapse to one entry that keeps the k + 1
smallest ids (more can never be among the nearest, as ties go to the smaller id). Entries are dealt by code
into blocks, queries into chunks, and every chunk meets every block. In a block, codes are indexed by each of
their 16-bit segments. A query's segments are looked up at radius 0, 1, 2, ... one after the other; once all
segments are done at radius r - 1 and j of them at r, every code within distance m r + j - 1 of m segments has
been verified (pigeonhole), so the search ends when the kth verified distance is within that, and no sooner.
The blocks' answers are merged into the k nearest of each query; a block or a chunk has a bounded size, and an
answer k rows, whatever the number of rows with one code.

Radius 0 goes over the whole table first, as a join by segment: the kth distance among some codes that share a
segment with a query is an upper bound for its kth distance. A block's search ends at the bound at the latest, so
a query whose neighbours lie in other blocks does not grow its radii in vain. Any sample of codes gives a valid
bound, so a segment value that many codes share sends SEEDS of them; what is found stays exact.

Edge cases: null, empty or other-sized vectors than the code's length, and null ids, are neither searched nor
found; a null or NaN element counts as not positive; a query does not find its own id; ties in distance go to
the smaller id; repeated ids count once for each distinct code; with fewer than k others all are returned; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.llm.common import materialize, small_batches, table

SEGMENT = 16
BLOCK_CODES = 16_384
CHUNK_QUERIES = 1_024
#: Codes of one segment value that are compared for the bound.
SEEDS = 64


def codes(vectors: DataFrame, bits: int = 64) -> DataFrame:
    """(id, code) of vectors(id, vector): the signs of the vector's elements as a long."""
    sign = lambda i: F.when(F.coalesce(F.col("vector")[i], F.lit(0.0)) > 0, F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    code = sign(0)
    for i in range(1, bits):
        code = code.bitwiseOR(sign(i))
    clean = F.transform("vector", lambda x: F.when(F.isnan(x), F.lit(None)).otherwise(x))
    kept = vectors.where((F.size("vector") == bits) & F.col("id").isNotNull()).withColumn("vector", clean)
    return kept.select(F.col("id").cast("long").alias("id"), code.alias("code")).distinct()


def masks(radius: int) -> np.ndarray:
    """All 16-bit numbers with so many bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT), radius)], dtype=np.int64)


class SegmentIndex:
    """A block's codes, found by the value of any of their segments."""

    def __init__(self, code: np.ndarray, bits: int):
        self.code, self.m = code, bits // SEGMENT
        self.order, self.starts = [], []
        for j in range(self.m):
            value = self.segment(code, j)
            order = np.argsort(value, kind="stable")
            self.order.append(order)
            self.starts.append(np.searchsorted(value[order], np.arange((1 << SEGMENT) + 1)))

    @staticmethod
    def segment(code: np.ndarray, j: int) -> np.ndarray:
        return ((code >> np.uint64(SEGMENT * j)) & np.uint64(0xFFFF)).astype(np.int64)

    def search(self, query: np.uint64, has: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and distances within the kth distance, at most the bound; `has` tells for how many ids an entry counts."""
        seen = np.zeros(len(self.code), dtype=bool)
        at, dist, reach = [], [], bound
        for r in range(SEGMENT + 1):
            flips = MASKS[r]
            for j in range(self.m):
                values = flips ^ int(self.segment(np.array([query]), j)[0])
                lo, hi = self.starts[j][values], self.starts[j][values + 1]
                full = hi > lo
                if full.any():
                    lo, n = lo[full], (hi - lo)[full]
                    spots = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    new = self.order[j][spots]
                    new = new[~seen[new]]
                    if len(new):
                        seen[new] = True
                        at.append(new)
                        dist.append(np.bitwise_count(self.code[new] ^ query).astype(np.int64))
                        d = np.concatenate(dist)
                        order = np.argsort(d, kind="stable")
                        enough = np.searchsorted(np.cumsum(has[np.concatenate(at)][order]), k)
                        reach = min(bound, int(d[order][enough])) if enough < len(order) else bound
                if reach <= self.m * r + j:
                    if not at:
                        return np.zeros(0, np.int64), np.zeros(0, np.int64)
                    d = np.concatenate(dist)
                    keep = d <= reach
                    return np.concatenate(at)[keep], d[keep]
        return (np.concatenate(at), np.concatenate(dist)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


MASKS = [masks(r) for r in range(SEGMENT + 1)]


def by_segment(codes: DataFrame, bits: int) -> DataFrame:
    """codes with one row for each segment j and its value."""
    values = [F.struct(F.lit(j).alias("j"), F.shiftrightunsigned("code", SEGMENT * j).bitwiseAND(F.lit((1 << SEGMENT) - 1)).alias("value")) for j in range(bits // SEGMENT)]
    return codes.select("*", F.inline(F.array(*values)))


def bounds(entries: DataFrame, asked: DataFrame, k: int, bits: int) -> DataFrame:
    """(code, bound): for each distinct code of asked, a distance within which k + 1 entries lie for certain."""
    first = Window.partitionBy("j", "value").orderBy(F.xxhash64("code"), "code")
    seeds = by_segment(entries.select("code"), bits).withColumn("n", F.row_number().over(first)).where(F.col("n") <= SEEDS).select("j", "value", F.col("code").alias("near"))
    met = by_segment(asked.select("code").distinct(), bits).join(seeds, ["j", "value"])
    distance = F.bit_count(F.col("code").bitwiseXOR(F.col("near")))
    ranked = met.groupBy("code").agg(F.array_sort(F.collect_set(F.struct(distance.alias("d"), "near"))).alias("best"))
    return ranked.select("code", F.coalesce(F.get("best", F.lit(k))["d"], F.lit(bits)).cast("int").alias("bound"))


def nearest(found: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, block: int = BLOCK_CODES, chunk: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) of queries(id, code) against found(id, code)."""
    small_batches(found.sparkSession)
    spread = F.pmod(F.xxhash64("code", F.lit(17)), F.lit(1 << 20))
    # The smallest ids of a code: first within salted parts, then over them.
    part = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64))).groupBy("code", "salt").agg(F.slice(F.array_sort(F.collect_set("id")), 1, k + 1).alias("ids"))
    entries = part.groupBy("code").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))
    n_blocks, n_chunks = max(1, -(-found.select("code").distinct().count() // block)), max(1, -(-queries.count() // chunk))
    entries = materialize(entries, "codes")
    queries = queries.join(bounds(entries, queries, k, bits), "code", "left").withColumn("bound", F.coalesce("bound", F.lit(bits)))
    left = queries.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_chunks)).cast("long")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = entries.withColumn("block", F.pmod(spread, F.lit(n_blocks)).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_chunks - 1).cast("long"))))

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if asked.num_rows and held.num_rows:
            ids = held.column("ids").to_pylist()
            index = SegmentIndex(held.column("code").to_numpy().view(np.uint64), bits)
            has = np.array([len(x) for x in ids])
            for q, code, bound in zip(asked.column("id").to_pylist(), asked.column("code").to_numpy().view(np.uint64), asked.column("bound").to_pylist(), strict=True):
                at, dist = index.search(code, has, k + 1, bound)
                rows = sorted((int(d), i) for a, d in zip(at, dist, strict=True) for i in ids[a] if i != q)[:k]
                out[0] += [q] * len(rows)
                out[1] += [i for _, i in rows]
                out[2] += [d for d, _ in rows]
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], ["query_id", "neighbour_id", "distance"])

    pairs = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(search, "query_id long, neighbour_id long, distance int")
    best = pairs.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_set(F.struct("distance", "neighbour_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "x")).select("query_id", F.col("x.neighbour_id").alias("neighbour_id"), F.col("x.distance").cast("long").alias("distance"), (F.col("pos") + 1).cast("long").alias("rank"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest codes of every embedding whose id is divisible by 20."""
    found = codes(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return nearest(found, found.where("id % 20 = 0"))


OP4_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS b FROM embeddings WHERE len(embedding) = 64 AND vec_id IS NOT NULL),
u AS (SELECT vec_id, generate_subscripts(b, 1) AS i, unnest(b) AS b FROM c),
p AS (SELECT q.vec_id AS query_id, o.vec_id AS neighbour_id, sum(CASE WHEN q.b <> o.b THEN 1 ELSE 0 END) AS distance
  FROM u q JOIN u o ON q.i = o.i WHERE q.vec_id % 20 = 0 AND q.vec_id <> o.vec_id GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM p)
SELECT query_id, neighbour_id, CAST(distance AS BIGINT) AS distance, rank FROM r WHERE rank <= 10
"""
