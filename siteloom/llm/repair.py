"""Repair of conversations' structure by cheapest edits, over conversations of any length.

Role initials must give `(s?(ua)+)?`, read by an automaton of four states (START, after s, after u, after a). A
row is kept, given another role or deleted; empty rows are inserted. In each state one of u and a is allowed, so
that every arc out of a state has its own letter.

1. Cost DP. Rows lie in order in blocks of one conversation. A block's costs from each state before it to each
   state behind it are a 4 x 4 matrix, computed for all blocks at once; a backward pass over the matrices, in
   order, hands each block the costs to the conversation's end from the states behind it.
2. Prefix-doubling path ranking, for each block by itself. Nodes are (row, state) and their optimal arcs those that
   agree with the costs. Ranks of nodes by the least audit of length 1 are the arcs' letters (the end's is least);
   ranks by length 2k come from pairs (rank by length k, rank by length k of the node that lies k letters ahead),
   pointers are doubled alongside. A node's arc is the one of the least letter, and of the target with the least
   rank; the path from each state before the block is then read off the doubled pointers.
3. A forward pass over the blocks, in order, picks each block's path by the state that the one before it ends in,
   and writes audit and repaired rows as it meets them.

Rows reach blocks by a range partitioning, so a conversation that holds a third of all rows spreads over tasks for
ranking. The two passes hold one block's matrices or one row at a time. What stays with one task is what is one
value by the contract: a conversation's audit, and SHA-256 of its repaired text, which can only be fed in order.

Edge cases: null roles and texts are one space, as are null ids and turns where rows are damaged; null turns come
first; rows with the same turn are ordered by role and text; a null conv_id is a conversation; repeated rows are
duplicates; a role without characters, or one that begins with another letter, can't be kept; conversations
without rows after damage have zeros, an empty audit and the hash of nothing; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import BATCH_BYTES, BATCH_ROWS, crc32_sql, materialize, small_batches, table
from siteloom.ranks import ORDER, in_order

#: Costs of edits, and of leaving a truncated row in.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows of a block are at most two to this power.
BLOCK_BITS = 8
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where u or a, whichever is allowed, and s lead from each state; -1: nowhere.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ADDED = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: A row's code: its initial (s, u, a, other) times four, plus its fault.
INITIALS, FINE, CUT_OFF, MUST_GO = "sua", 0, 1, 2
#: The code of a conversation's end; a block's filler.
END, NONE = 16, 17
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
BLANK, LAST = r"[^\x20\x09-\x0D]", r"[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*\z"
#: Adjacent role initials that are legal.
PAIRS = {"su", "ua", "au"}
#: A conversation's counts come before its blocks; a block that is its end comes last; a block's paths before its rows.
COUNTS, LAST_BLOCK, PATHS = -1, 1 << 60, -1
#: Rows of blocks that are ranked at once.
CELLS = 1 << 14
RECORD = "conv long, block long, at long, role string, text string, paths array<string>, exits array<int>, cost long, gaps long, blank long, duplicate long, truncated long"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def spaced(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as (conv, turn, role, text, there) after damage; dropped rows stay, with `there` false."""
    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(spaced("role")).alias("role"), text.alias("text"), (kind != 0).alias("there"), F.explode(copies).alias("copy")
    ).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows in order, each with its first fault (blank, duplicate, truncated), its code and its block."""
    ordered = in_order(rows.withColumn("digest", F.sha2(F.col("text"), 256)), "damaged", "conv", "turn", "role", "digest")
    first = ordered.where("there").groupBy("conv", "role", "digest").agg(F.min(ORDER).alias(ORDER)).select(ORDER, F.lit(True).alias("first"))
    met = ordered.join(first, ORDER, "left")
    fault = F.when(~F.col("text").rlike(BLANK), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("text").rlike(LAST), "truncated")
    worst = F.when(F.col("fault").isin("blank", "duplicate"), MUST_GO).when(F.col("fault") == "truncated", CUT_OFF).otherwise(FINE)
    initial = F.col("role").substr(1, 1)
    place = F.when(initial == "", 3).otherwise(F.coalesce(F.nullif(F.instr(F.lit(INITIALS), initial), F.lit(0)) - 1, F.lit(3)))
    coded = met.withColumn("fault", F.when(F.col("there"), fault)).withColumn("code", F.when(F.col("there"), place * 4 + worst))
    return materialize(coded.select("conv", "turn", "role", "text", "there", "fault", "code", F.col(ORDER).alias("at"), F.shiftright(ORDER, BLOCK_BITS).alias("block")), "coded-rows")


def arcs(codes: np.ndarray, behind: np.ndarray) -> np.ndarray:
    """Costs of deleting, inserting, keeping and giving a role at rows of these codes: (rows, state, edit, ...).

    behind: costs from the states behind the rows, (rows, state, ...). An insertion's are those of the state it
    leads to, at the same row, so they are found last.
    """
    n, rest = len(codes), behind.shape[2:]
    wide = (slice(None), *[None] * len(rest))
    initial, fault = codes // 4, codes % 4
    out = np.full((n, 4, 4, *rest), FAR, np.int64)
    own = np.where(fault == MUST_GO, FAR, np.where(fault == CUT_OFF, TRUNCATED, 0))
    out[:, :, 0] = behind + DELETE
    for q in range(4):
        to = np.where((initial == 0) & (q == START), SYSTEM, np.where((initial == 1) & (NEXT[q] == USER), USER, np.where((initial == 2) & (q == USER), ASSISTANT, -1)))
        out[:, q, 2] = np.where((to >= 0)[wide], behind[np.arange(n), to] + own[wide], FAR)
        out[:, q, 3] = behind[:, NEXT[q]] + (own + REROLE)[wide]
    end = codes == END
    if end.any():
        out[end] = FAR
        out[end, START, 0] = out[end, ASSISTANT, 0] = behind[end, START]
    base = out.min(axis=2)
    user = np.minimum(base[:, USER], base[:, ASSISTANT] + INSERT)
    assistant = np.minimum(base[:, ASSISTANT], base[:, USER] + INSERT)
    for q in range(4):
        out[:, q, 1] = (assistant if NEXT[q] == ASSISTANT else user) + INSERT
    return np.minimum(out, FAR)


def layers(codes: np.ndarray, exits: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Backward over the columns of codes (blocks, rows), NONE is skipped: (column, costs by edit, costs) with costs from exits on."""
    costs = exits
    for j in range(codes.shape[1] - 1, -1, -1):
        some = codes[:, j] != NONE
        by_edit = arcs(np.where(some, codes[:, j], END), costs)
        costs = np.where(some.reshape(-1, *[1] * (costs.ndim - 1)), by_edit.min(axis=2), costs)
        yield j, by_edit, costs


def padded(codes: list[str]) -> np.ndarray:
    """Blocks of codes, one row each, as letters from A on."""
    widest = max(map(len, codes))
    text = "".join(c.ljust(widest, chr(65 + NONE)) for c in codes)
    return (np.frombuffer(text.encode(), np.uint8) - 65).reshape(len(codes), widest).astype(np.int64)


def matrices(codes: np.ndarray) -> np.ndarray:
    """Costs from each state before each block to each state behind it: (blocks, 4, 4)."""
    costs = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, FAR), (len(codes), 4, 4))
    for _, _, costs in layers(codes, costs):  # noqa: B007
        pass
    return costs


def least_paths(codes: np.ndarray, exits: np.ndarray) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """For each block and each state before it: the least of the cheapest audits, the state behind it, and the cost.

    exits: (blocks, 4) costs from the states behind each block to the end of its conversation. A filler column
    hands on state and cost.
    """
    blocks, width = codes.shape
    depth = width + 1
    node = np.arange(blocks * depth * 4).reshape(blocks, depth, 4)  # (block, column, state)
    targets, letters = np.repeat(node[..., None], 4, axis=3), np.zeros((blocks, depth, 4, 4), np.int64)
    optimal = np.zeros((blocks, depth, 4, 4), bool)
    optimal[:, -1] = True
    costs = exits
    for j, by_edit, costs in layers(codes, exits):  # noqa: B007
        some = (codes[:, j] != NONE)[:, None, None]
        ends = (codes[:, j] == END)[:, None]
        optimal[:, j] = np.where(some, by_edit == costs[..., None], np.arange(4) == 0)
        letters[:, j] = np.where(some, np.arange(1, 5), 0)
        letters[:, j, :, 0] = np.where(ends, 0, letters[:, j, :, 0])
        initial = codes[:, j] // 4
        kept = np.array([[SYSTEM] * 4, [USER] * 4, [ASSISTANT] * 4])[np.minimum(initial, 2)]
        for q in range(4):
            targets[:, j, q, 0] = node[:, j + 1, q]
            targets[:, j, q, 1] = node[:, j, NEXT[q]]
            targets[:, j, q, 2] = node[np.arange(blocks), j + 1, kept[:, q]]
            targets[:, j, q, 3] = node[:, j + 1, NEXT[q]]
    flat, letter, optimal = targets.reshape(-1, 4), letters.reshape(-1, 4), optimal.reshape(-1, 4)
    here = np.arange(len(flat))
    order = np.where(optimal, letter, len(LETTERS))
    rank, pointer = order.min(axis=1), flat[here, order.argmin(axis=1)]  # by audits of length 1; letters out of a node differ
    while True:
        _, rank = np.unique(rank * len(flat) + rank[pointer], return_inverse=True)
        ahead = pointer[pointer]
        if (ahead == pointer).all():
            break
        pointer = ahead
    pick = np.where(optimal, letter * len(flat) + rank[flat], len(LETTERS) * len(flat)).argmin(axis=1)
    pointers = [flat[here, pick]]
    while not ((ahead := pointers[-1][pointers[-1]]) == pointers[-1]).all():
        pointers.append(ahead)
    at = node[:, 0].reshape(-1, 1)  # all nodes of the paths, from doubled pointers: the longest step first
    for pointer in reversed(pointers):
        at = np.stack([at, pointer[at]], axis=2).reshape(len(at), -1)
    last, spelled = pointers[-1][at[:, -1]], LETTERS[letter[here, pick]]
    words = [spelled[nodes].tobytes().replace(b"\0", b"").decode() for nodes in at]
    return [words[k : k + 4] for k in range(0, len(words), 4)], (last % 4).reshape(-1, 4), costs


def alike(codes: list[str]) -> Iterator[list[int]]:
    """Places of blocks, those of like lengths together, so many that arrays stay small."""
    order, begin = sorted(range(len(codes)), key=lambda k: len(codes[k])), 0
    for end in range(1, len(order) + 1):
        if end == len(order) or (end + 1 - begin) * len(codes[order[end]]) > CELLS:
            yield order[begin:end]
            begin = end


def block_matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = b.column("codes").to_pylist()
        found: list = [None] * len(codes)
        for places in alike(codes):
            for k, m in zip(places, matrices(padded([codes[k] for k in places])).reshape(-1, 16).tolist(), strict=True):
                found[k] = m
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "block", "codes")), pa.array(found, pa.list_(pa.int64()))], ["conv", "block", "codes", "matrix"])


def hand_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in descending order by conversation: the costs from the states behind each to the conversation's end."""
    behind, conv, begun = [0, FAR, FAR, FAR], None, False
    for b in batches:
        out = []
        for c, m in zip(b.column("conv").to_pylist(), b.column("matrix").to_pylist(), strict=True):
            if c != conv or not begun:
                behind, conv, begun = [0, FAR, FAR, FAR], c, True
            out.append(behind)
            behind = [min(FAR, *(x + y for x, y in zip(m[4 * q : 4 * q + 4], behind, strict=True))) for q in range(4)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("conv", "block", "codes")), pa.array(out, pa.list_(pa.int64()))], ["conv", "block", "codes", "behind"])


def block_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes, behind = b.column("codes").to_pylist(), b.column("behind").to_pylist()
        paths, exits, cost = ([None] * len(codes) for _ in range(3))
        for places in alike(codes):
            found = least_paths(padded([codes[k] for k in places]), np.array([behind[k] for k in places], np.int64))
            for k, words, to, costs in zip(places, found[0], found[1].tolist(), found[2].tolist(), strict=True):
                paths[k], exits[k], cost[k] = words, to, costs[START]
        kinds = pa.list_(pa.string()), pa.list_(pa.int32()), pa.int64()
        yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("block"), *(pa.array(c, t) for c, t in zip((paths, exits, cost), kinds, strict=True))], ["conv", "block", "paths", "exits", "cost"])


class Repaired:
    """A conversation's repaired text, hashed as it comes, and its audit."""

    def __init__(self):
        self.hash, self.audit, self.state, self.empty = sha256(), [], START, True

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.empty = False

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.add(ADDED[self.state], "")

    def edit(self, letter: str, role: str, text: str) -> None:
        if letter == "D":
            return
        self.state = SYSTEM if letter == "K" and role[0] == "s" else NEXT[self.state]
        self.add(role if letter == "K" else ADDED[self.state], text)


def write_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of conversations in order, first its counts, then each block's paths and rows: the results."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    records = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in names), strict=True))
    kinds, held, size = [pa.int64()] * 7 + [pa.string()] * 2, [], 0
    out = [f.split()[0] for f in RESULT.split(", ")]
    for conv, group in groupby(records, key=lambda r: r[0]):
        done, counts, cost, before, illegal, letters, entry = Repaired(), (0, 0, 0, 0), None, None, 0, iter(()), START
        for _, block, at, role, text, paths, exits, costs, *found in group:
            if block == COUNTS:
                counts = found
            elif at == PATHS:
                cost = costs if cost is None else cost
                path, entry = paths[entry], exits[entry]
                done.audit.append(path)
                letters = iter(path)
                for _ in path if block == LAST_BLOCK else ():
                    done.insert()
            else:
                illegal += before is not None and before + role[:1] not in PAIRS
                before = role[:1]
                while (letter := next(letters)) == "I":
                    done.insert()
                done.edit(letter, role, text)
        held.append((conv, *counts, illegal, cost, "".join(done.audit), done.hash.hexdigest()))
        size += len(held[-1][7])
        if len(held) >= BATCH_ROWS or size > BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], out)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], out)


def repair(rows: DataFrame) -> DataFrame:
    """Every conv_id of rows(conv_id, turn, role, text) with its faults, the cheapest repair's cost and audit, and the repaired text's hash."""
    small_batches(rows.sparkSession)
    coded = with_faults(damaged(rows))
    kind = lambda *names: F.count(F.when(F.col("fault").isin(*names), 1))
    turn = F.when(F.col("there"), F.col("turn"))
    counts = coded.groupBy("conv").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).alias("gaps"), kind("blank").alias("blank"), kind("duplicate").alias("duplicate"), kind("truncated").alias("truncated")
    )
    letter = lambda x: F.char(x["code"] + 65)
    own = coded.where("there").groupBy("conv", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), letter), "").alias("codes"))
    ends = coded.select("conv").distinct().select("conv", F.lit(LAST_BLOCK).alias("block"), F.lit(chr(65 + END)).alias("codes"))
    blocks = materialize(own.union(ends).mapInArrow(block_matrices, "conv long, block long, codes string, matrix array<long>"), "block-matrices")
    behind = blocks.repartition("conv").sortWithinPartitions("conv", F.desc("block")).mapInArrow(hand_back, "conv long, block long, codes string, behind array<long>")
    paths = materialize(materialize(behind, "block-costs").mapInArrow(block_paths, "conv long, block long, paths array<string>, exits array<int>, cost long"), "block-paths")
    records = [
        counts.withColumns({"block": F.lit(COUNTS), "at": F.lit(0).cast("long")}),
        paths.withColumn("at", F.lit(PATHS)),
        coded.where("there").select("conv", "block", "at", "role", "text"),
    ]
    every = records[0]
    for more in records[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    every = every.select(*(f.split()[0] for f in RECORD.split(", ")))
    return every.repartition("conv").sortWithinPartitions("conv", "block", "at").mapInArrow(write_out, RESULT)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: The DP goes forward, one row and state at a time; a pair (cost, audit) is as good a key as a cost.
OP12_SQL = f"""
WITH RECURSIVE
k AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) FROM k WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, {_BLANKS}) AS cut FROM d),
p AS MATERIALIZED (SELECT *, CASE WHEN cut = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT contains('.!?', right(cut, 1)) THEN 't' ELSE '' END AS fault,
  left(role, 1) AS a, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS b FROM o),
step(q, a, r, role) AS (VALUES (0, 's', 1, ''), (0, 'u', 2, 'user'), (1, 'u', 2, 'user'), (2, 'a', 3, 'assistant'), (3, 'u', 2, 'user')),
ins AS MATERIALIZED (SELECT q, 0 AS n, q AS r, CAST([] AS VARCHAR[]) AS added FROM (VALUES (0), (1), (2), (3)) v(q)
  UNION ALL SELECT q, 1, r, [role || ':'] FROM step WHERE a <> 's'
  UNION ALL SELECT x.q, 2, y.r, [x.role || ':', y.role || ':'] FROM step x JOIN step y ON y.q = x.r WHERE x.a <> 's' AND y.a <> 's'),
ids AS (SELECT DISTINCT conv_id FROM conversations),
w AS (SELECT conv_id, CAST(1 AS BIGINT) AS i, r AS q, {{'cost': CAST(5 * n AS BIGINT), 'audit': repeat('I', n), 'rows': added}} AS best FROM ids, ins WHERE q = 0
  UNION ALL
  SELECT e.conv_id, e.i + 1, ins.r, min({{'cost': CAST(e.cost + 5 * ins.n AS BIGINT), 'audit': e.audit || repeat('I', ins.n), 'rows': list_concat(e.lines, ins.added)}})
  FROM (SELECT w.conv_id, w.i, w.q, w.best.cost + 2 AS cost, w.best.audit || 'D' AS audit, w.best.rows AS lines FROM w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i
    UNION ALL SELECT w.conv_id, w.i, s.r, w.best.cost + m.extra + 5 * CAST(p.fault = 't' AS INT), w.best.audit || m.letter, list_append(w.best.rows, CASE m.letter WHEN 'K' THEN p.role ELSE s.role END || ':' || p.text)
    FROM w JOIN p ON p.conv_id IS NOT DISTINCT FROM w.conv_id AND p.i = w.i AND p.fault NOT IN ('b', 'd') JOIN step s ON s.q = w.q, (VALUES ('K', 0), ('R', 1)) m(letter, extra)
    WHERE (m.letter = 'K' AND s.a = p.a) OR (m.letter = 'R' AND s.a <> 's')) e JOIN ins ON ins.q = e.q
  GROUP BY e.conv_id, e.i, ins.r),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (i > 1 AND b || a NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM p GROUP BY conv_id),
z AS (SELECT w.conv_id, min(w.best) AS best FROM w LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.q IN (0, 3) AND w.i = coalesce(c.n, 0) + 1 GROUP BY w.conv_id)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  z.best.cost AS cost, z.best.audit AS audit, sha256(array_to_string(z.best.rows, chr(10))) AS repaired_sha256
FROM z LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM z.conv_id
"""
