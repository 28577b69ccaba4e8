"""A Merkle manifest of a table: leaf digests, a tree for each language, one over their roots, and proofs.

Time-forward processing. The trees' nodes are labelled so that children come before parents: a node's label is
(end of its range of leaves, level). In label order a node's digest is computed from what a priority queue holds
for it and delivered, through the queue, to its parent. A second sweep goes through the labels in reverse and
delivers proof suffixes, the siblings from a node up to the root, from parents to children, until each leaf
has its own.

The queue is external: a band of LEVELS levels is cut into blocks of 2^LEVELS nodes. Messages inside a block go
through a heap, which with these labels holds a few entries a level; messages between bands go through
Spark's sort by (tree, label), so that a tree of any size is spread over blocks, and a block's row is bounded.
What parents received is kept with a block, in order, for the reverse sweep to read from its end.

Ranks of leaves in their tree come from a range partitioning and prefix sums (`siteloom.ranks`), never from a
window over a language.

Edge cases: null columns are hashed as `-`; a null language is a tree of its own, before all others; null
doc_ids come first in their tree; rows that share a doc_id are leaves of their own, in the order of their digests;
empty and long texts are hashed whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import crc32_sql, materialize, small_batches, table
from siteloom.ranks import numbered

#: Levels of a band; a block has up to 2^LEVELS nodes.
LEVELS = 8
#: Where a divisor of the id's crc32, a row is tampered with for the proofs to show it.
TAMPERED = 7
#: How a proof names the place of a node's sibling.
ALONE, RIGHT, LEFT = 0, 1, 2
BLOCK = "tree string, block long, n long, levels int, inbox binary, top binary, doc_ids array<long>, leaves array<binary>, changed array<binary>"
MESSAGE = "tree string, index long, suffix binary, subroot binary, root binary"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    """A column as hashed: `-` for null, else its length in bytes, a colon, and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digests(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, changed) of documents; changed is the digest after tampering, null where none took place."""
    n_chars = F.col("n_chars").cast("decimal(20,0)")

    def digest(n: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*map(field, (F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text")))), 256))

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest(n_chars).alias("digest"), F.when(hit, digest(n_chars + 1)).alias("changed"))


def placed(nodes: DataFrame, name: str, tree: str, *keys: str) -> DataFrame:
    """nodes with `index`, their place in their tree by keys from 0, and `n`, the tree's number of nodes."""
    return numbered(nodes, name, [tree], list(keys), "index", "n").withColumn("index", F.col("index") - 1)


def joined(a: bytes, b: bytes = b"") -> bytes:
    """The digest of a run of one or two nodes; digests are hashed as hex text."""
    return sha256((a.hex() + b.hex()).encode()).digest()


def levels_of(n: int, most: int) -> int:
    """Levels of a band above n nodes: up to the tree's root, or as many as a band has."""
    return min(most, (n - 1).bit_length())


def climb(digests: list[bytes], first: int, levels: int) -> tuple[bytes, bytes]:
    """Forward sweep of a block whose nodes have these digests, from index `first`: what its parents received, in label order, and its top's digest."""
    queue: list[tuple[int, int, int, bytes]] = []  # (end, level) of the receiver, sender's index, digest
    inbox: list[bytes] = []
    top = digests[0]

    def deliver(level: int, index: int, digest: bytes) -> None:
        nonlocal top
        if level == levels:
            top = digest
        else:
            heapq.heappush(queue, ((index // 2 + 1) << (level + 1), level + 1, index, digest))

    def settle(end: int | None) -> None:
        while queue and (end is None or queue[0][0] <= end):
            at, level, index, digest = heapq.heappop(queue)
            inbox.append(digest)
            if queue and queue[0][:2] == (at, level):
                other = heapq.heappop(queue)[3]
                inbox.append(other)
                deliver(level, index // 2, joined(digest, other))
            else:
                deliver(level, index // 2, joined(digest))

    for i, digest in enumerate(digests, first):
        deliver(0, i, digest)
        settle(i + 1)
    settle(None)
    return b"".join(inbox), top


def descend(inbox: bytes, block: int, n: int, levels: int, suffix: bytes) -> Iterator[tuple[int, bytes]]:
    """Reverse sweep of a block: (index, proof suffix) of its nodes, the last one first."""
    queue = [(-((block + 1) << levels), -levels, block, suffix)]
    end = len(inbox)
    while queue:
        _, level, index, suffix = heapq.heappop(queue)
        level = -level
        if not level:
            yield index, suffix
            continue
        left, right = 2 * index, 2 * index + 1
        below = -(-n >> (level - 1))  # nodes of the level below in the whole tree
        if right < below:
            a, b = inbox[end - 64 : end - 32], inbox[end - 32 : end]
            end -= 64
            heapq.heappush(queue, (-((right + 1) << (level - 1)), 1 - level, right, bytes([LEFT]) + a + suffix))
            heapq.heappush(queue, (-((left + 1) << (level - 1)), 1 - level, left, bytes([RIGHT]) + b + suffix))
        else:
            end -= 32
            heapq.heappush(queue, (-((left + 1) << (level - 1)), 1 - level, left, bytes([ALONE]) + suffix))


def steps(suffix: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(suffix):
        side = suffix[at]
        size = 32 if side else 0
        yield side, suffix[at + 1 : at + 1 + size]
        at += 1 + size


def fold(digest: bytes, suffix: bytes) -> bytes:
    """The root that follows from a leaf's digest and its proof."""
    for side, other in steps(suffix):
        digest = joined(other, digest) if side == LEFT else joined(digest, other)
    return digest


def blocks_of(nodes: DataFrame, most: int) -> DataFrame:
    """The blocks of nodes(tree, index, n, digest, doc_id, changed), each with its forward sweep."""

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("tree", "block", "index", "n", "digest", "doc_id", "changed")
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in names), strict=True))
        for (tree, block), group in groupby(rows, key=lambda r: r[:2]):
            _, _, index, n, digests, ids, changed = zip(*group, strict=True)
            levels = levels_of(n[0], most)
            inbox, top = climb(list(digests), index[0], levels)
            own = ids, digests, changed
            columns = [[tree], [block], [n[0]], [levels], [inbox], [top], *([list(c)] for c in own)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in BLOCK.split(", ")])

    keyed = nodes.withColumn("block", F.shiftright("index", most))
    return keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", "index").mapInArrow(sweep, BLOCK)


def rise(nodes: DataFrame, levels: int = LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """Forward sweep of trees of nodes(tree, index, n, digest, doc_id, changed), band by band.

    Returns the bands' blocks and (tree, band, digest) of the roots.
    """
    most, bands, tops = nodes.agg(F.max("n")).first()[0] or 0, [], None
    while True:
        blocks = materialize(blocks_of(nodes, levels), "merkle-band")
        ended = blocks.where(F.col("n") <= 1 << levels).select("tree", F.lit(len(bands)).alias("band"), F.col("top").alias("digest"))
        tops = ended if tops is None else tops.union(ended)
        bands.append(blocks)
        if most <= 1 << levels:
            return bands, tops
        most = -(-most >> levels)
        upper = F.shiftright(F.col("n") + (1 << levels) - 1, levels)
        nodes = blocks.where(F.col("n") > 1 << levels).select(
            "tree", F.col("block").alias("index"), upper.alias("n"), F.col("top").alias("digest"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed")
        )


def met(blocks: DataFrame, messages: DataFrame) -> DataFrame:
    """Blocks with the messages of their tops."""
    sent = messages.select(F.col("tree").alias("to_tree"), F.col("index").alias("to_index"), "suffix", "subroot", "root")
    return blocks.join(sent, F.col("tree").eqNullSafe(F.col("to_tree")) & (F.col("block") == F.col("to_index"))).drop("to_tree", "to_index")


def received(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[tuple[int, bytes]]]]:
    for b in batches:
        for k in range(b.num_rows):
            r = {c: b.column(c)[k].as_py() for c in b.schema.names}
            yield r, list(descend(r["inbox"], r["block"], r["n"], r["levels"], r["suffix"]))


def passed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages to the nodes of blocks that have received theirs."""
    for r, nodes in received(batches):
        n = len(nodes)
        columns = [pa.array([r["tree"]] * n, pa.string()), pa.array([i for i, _ in nodes], pa.int64()), pa.array([s for _, s in nodes], pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array([r[c]] * n, pa.binary()) for c in ("subroot", "root"))], [f.split()[0] for f in MESSAGE.split(", ")])


def proven(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The results of leaves: proof digests, and the roots that follow from tampered leaves."""
    for r, nodes in received(batches):
        rows = []
        for k, (_, suffix) in enumerate(reversed(nodes)):
            leaf, changed = r["leaves"][k], r["changed"][k]
            folded = fold(changed or leaf, suffix)
            proof = sha256("".join(other.hex() for _, other in steps(suffix)).encode()).hexdigest()
            rows.append((r["doc_ids"][k], leaf.hex(), r["subroot"].hex(), r["root"].hex(), proof, folded.hex(), folded == r["root"]))
        kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in RESULT.split(", ")])


def fall(bands: list[DataFrame], starts: DataFrame, last: Callable, schema: str) -> DataFrame:
    """Reverse sweep: starts(tree, band, suffix, subroot, root) go to the roots, and what leaves receive to `last`."""
    messages = None
    for band in range(len(bands) - 1, -1, -1):
        own = starts.where(F.col("band") == band).select("tree", F.lit(0).cast("long").alias("index"), "suffix", "subroot", "root")
        messages = own if messages is None else messages.union(own)
        ready = met(bands[band], messages)
        if band:
            messages = materialize(ready.mapInArrow(passed_on, MESSAGE), "merkle-messages")
    return ready.mapInArrow(last, schema)


def manifest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Every row of documents with its leaf, its tree's and the whole manifest's root, and its proof's digest and outcome."""
    small_batches(docs.sparkSession)
    leaves = placed(leaf_digests(docs), "merkle-leaves", "tree", "doc_id", "digest")
    bands, subroots = rise(leaves, levels)
    trees = materialize(placed(subroots.withColumn("all", F.lit("")), "merkle-subroots", "all", "tree"), "merkle-trees")
    upper, root = rise(trees.select(F.col("all").alias("tree"), "index", "n", "digest", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("changed")), levels)
    begin = root.select("tree", "band", F.lit(b"").alias("suffix"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    sent = fall(upper, begin, passed_on, MESSAGE).select("index", "suffix", "root")
    starts = materialize(trees.join(sent, "index").select("tree", "band", "suffix", F.col("digest").alias("subroot"), "root"), "merkle-starts")
    return fall(bands, starts, proven, RESULT)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _field(column: str) -> str:
    return f"coalesce(CAST(strlen(CAST({column} AS VARCHAR)) AS VARCHAR) || ':' || CAST({column} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


OP13_SQL = f"""
WITH RECURSIVE
l AS MATERIALIZED (SELECT doc_id, lang, coalesce('1' || lang, '0') AS tree, {_leaf("n_chars")} AS leaf,
  CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % {TAMPERED} = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS held FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l),
t AS (SELECT tree, 0 AS level, i, n, leaf AS d FROM r
  UNION ALL SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY tree, level, i // 2, n),
tm AS MATERIALIZED (SELECT * FROM t),
s AS MATERIALIZED (SELECT tree, d, level AS height, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM tm WHERE n = 1),
u AS (SELECT 0 AS level, i, n, d FROM s UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY level, i // 2, n),
um AS MATERIALIZED (SELECT * FROM u),
path AS MATERIALIZED (
  SELECT r.tree, r.i AS leaf_no, k.level AS level, (r.i >> k.level) AS own, tm.i AS other, tm.d FROM r JOIN (SELECT DISTINCT tree, level FROM tm WHERE n > 1) k USING (tree)
    LEFT JOIN tm ON tm.tree = r.tree AND tm.level = k.level AND tm.i = xor(r.i >> k.level, 1)
  UNION ALL SELECT r.tree, r.i, s.height + k.level, s.i >> k.level, um.i, um.d FROM r JOIN s USING (tree) JOIN (SELECT DISTINCT level FROM um WHERE n > 1) k ON true
    LEFT JOIN um ON um.level = k.level AND um.i = xor(s.i >> k.level, 1)),
f AS (SELECT tree, i, 0 AS level, held AS d FROM r
  UNION ALL SELECT f.tree, f.i, f.level + 1, sha256(CASE WHEN p.d IS NULL THEN f.d WHEN p.other < p.own THEN p.d || f.d ELSE f.d || p.d END)
  FROM f JOIN path p ON p.tree = f.tree AND p.leaf_no = f.i AND p.level = f.level),
folded AS (SELECT tree, i, arg_max(d, level) AS d FROM f GROUP BY tree, i),
proof AS (SELECT tree, leaf_no AS i, sha256(string_agg(coalesce(d, ''), '' ORDER BY level)) AS d FROM path GROUP BY tree, leaf_no),
top AS (SELECT d FROM um WHERE n = 1)
SELECT r.doc_id, r.leaf, s.d AS subroot, top.d AS root, coalesce(proof.d, sha256('')) AS proof_sha256, folded.d AS folded_root, folded.d = top.d AS verified
FROM r JOIN s ON s.tree = r.tree JOIN folded ON folded.tree = r.tree AND folded.i = r.i LEFT JOIN proof ON proof.tree = r.tree AND proof.i = r.i, top
"""
