"""Exact n-gram Jaccard join by prefix filtering with set-relation skipping.

Each text becomes a set of 64-bit shingle hashes. Equal sets collapse to one representative before any join.
Shingles are ordered from rare to frequent by a sketch of all texts' counts (any order gives the same links;
this one keeps lists short), and a set enters the index lists of its prefix: two sets that reach the
threshold share a prefix shingle. Relations between sets then skip most of the work:

- Index level: lists are cut into blocks by set size and carry positions. A set meets the blocks of its own
  and the next size only, and skips entries whose position leaves too few shingles to share. Entries that have
  no other set in these blocks enter no list: tasks send 32 bits for each block, those sent twice return as a
  filter of bits (at most 128 MB). Pairs that are left must share so many shingles of their prefixes as the
  threshold implies.
- Answer level: each list has a pivot set, to which all its sets of like size are compared first (one comparison
  a set). As 1 - Jaccard is a metric, the pivot's answers give those of the sets near it: two sets whose distances
  to the pivot differ by more than the limit cannot link, and those that the pivots' links connect, in whatever
  list, are connected already. Only pairs that neither decides are compared.
- Set level: a set carries the parities of its shingles in 512 places. Two sets differ in at least as many
  shingles as their parities differ in places, so that pairs of texts that share a common passage only are told
  apart where lists are joined; none that links is lost. Sets too large for that are compared to the pivots of
  long lists whatever their size.

Comparisons are exact intersections of whole sets. Components come from iterated smallest labels. The links
found are enough to connect what is linked, not all of them: sets that are connected over pivots need no own link.
Keys that hold a large share of a join's rows (a much copied text, a pivot, a hub) are salted. The join deals
no texts by a shuffle: ids choose them by a broadcast or, where there are too many, by a filter of bits. Tables that
have been read for the last time are deleted.

Edge cases: null texts and texts without words have an empty set and link with nothing; a text with fewer
words than a shingle is one shingle; rows that share a doc_id are one node; rows with a null doc_id get their
shingle count and a null component, and link with nothing; repeated rows are kept; extra columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_broadcast, hash_words, materialize, mix, ngram_hashes, passing, salted_join, small_batches, spent, table, without
from siteloom.llm.decontaminate import share_filter

#: The sketch: counts of 2^20 buckets in 16 blocks.
SKETCH_BITS, SKETCH_BLOCKS = 20, 16
BLOCK = (1 << SKETCH_BITS) // SKETCH_BLOCKS
#: Places of the parities, in words of 64 bits.
PARITY_BITS, PARITY_WORDS = 512, 8
#: Ids that may be broadcast; more choose texts by a filter of bits.
MAX_BROADCAST = 500_000
#: Lists of so many sets and more have all their distances to the pivot measured, where parities tell little.
LONG_LIST = 16
#: Blocks' hashes that one task compares.
HELD_BLOCKS = 4_000_000
EPS = 1e-9


def shingles(text: str | None, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text; words lie between ASCII white space, A-Z in lower case."""
    h = hash_words((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not len(h):
        return h
    return np.unique(ngram_hashes(h, min(k, len(h))))


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """Per row doc_id, n and sig (128 bits of the set), and per task the sketch's blocks with a null sig and n."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        names = ["doc_id", "n", "sig", "block", "counts"]
        for b in batches:
            n, sig, every = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, k)
                n.append(len(s))
                sig.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                every.append(s)
            found = np.concatenate(every) if every else np.zeros(0, np.uint64)
            counts += np.bincount((found >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            rows = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), pa.array(sig, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if counts.any():
            parts = [counts[i * BLOCK : (i + 1) * BLOCK].tobytes() for i in range(SKETCH_BLOCKS)]
            yield pa.RecordBatch.from_arrays([pa.nulls(SKETCH_BLOCKS, pa.int64()), pa.nulls(SKETCH_BLOCKS, pa.int32()), pa.nulls(SKETCH_BLOCKS, pa.binary()), pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, n int, sig binary, block int, counts binary")


def sketch(signed: DataFrame) -> np.ndarray:
    """All tasks' counts summed, first within runs of tasks, then over them; 8 MB whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for block, counts in zip(b.column("block").to_pylist(), b.column("counts").to_pylist(), strict=True):
                got = np.frombuffer(counts, dtype=np.uint32 if len(counts) == 4 * BLOCK else np.uint64).astype(np.uint64)
                total[block] = total.get(block, 0) + got
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "counts"])

    parts = signed.where("block is not null").select("block", "counts")
    few = max(1, math.isqrt(max(1, signed.rdd.getNumPartitions())))
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint64)
    summed = parts.coalesce(few).mapInArrow(add, "block int, counts binary").repartition(SKETCH_BLOCKS, "block").mapInArrow(add, "block int, counts binary")
    for r in summed.toLocalIterator():
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] += np.frombuffer(r["counts"], dtype=np.uint64)
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """The parities of how many shingles fall into each place, as words."""
    counts = np.bincount((s & np.uint64(PARITY_BITS - 1)).astype(np.int64), minlength=PARITY_BITS)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def prefixes(sets: DataFrame, counts: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(node, n, tokens, parity) of each (node, text): the set's size, its rarest n - ceil(t n) + 1 shingles in order, and its parities."""
    share = sets.sparkSession.sparkContext.broadcast(counts)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = share.value
        for b in batches:
            size, rare, bits = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, k)
                n = len(s)
                m = n - -(-num * n // den) + 1 if n else 0
                size.append(n)
                bits.append(parity(s))
                rare.append(s[np.lexsort((s, freq[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:m]].view(np.int64))
            ends = np.cumsum([0, *map(len, rare)]).astype(np.int32)
            tokens = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rare) if rare else np.zeros(0, np.int64)))
            words = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(bits) + 1) * PARITY_WORDS, PARITY_WORDS, dtype=np.int32)), pa.array(np.concatenate(bits) if bits else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(size, pa.int32()), tokens, words], ["node", "n", "tokens", "parity"])

    return sets.mapInArrow(index, "node long, n int, tokens array<long>, parity array<long>").where("n > 0")


def block_hashes(tokens: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Hashes of (token, block of sizes); the first 32 bits and those that deal them lie at the top, the last is free."""
    return mix(mix(tokens.view(np.uint64)) + blocks.astype(np.int64).view(np.uint64))


def size_blocks(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """The block of each size: of two sets that can link the larger lies in the smaller's block or the next."""
    return np.floor(np.log(n) / math.log(den / num) + EPS).astype(np.int64)


def met_blocks(index: DataFrame, num: int, den: int) -> DataFrame:
    """(token): the hashes' first bits of blocks of lists in which a set may meet another.

    An entry lies in the block of its own size, and waits in the one before for smaller sets. A block counts if it
    has two entries, one of them of its own size. Hashes travel in packed runs; the few that are equal by chance
    let some entries through, no more.
    """
    entries = index.agg(F.sum(F.size("tokens")).alias("n")).collect()[0]["n"] or 0
    bits = max(4, (2 * entries // HELD_BLOCKS).bit_length())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("tokens")
            tokens, blocks = lists.flatten().to_numpy(), np.repeat(size_blocks(b.column("n").to_numpy(), num, den), np.diff(lists.offsets.to_numpy()))
            own, before = block_hashes(tokens, blocks), block_hashes(tokens, blocks - 1)
            every = np.concatenate([own, before])
            part = (every >> np.uint64(64 - bits)).astype(np.int32)
            rest = ((every >> np.uint64(64 - bits - 31)) & np.uint64((1 << 31) - 1)).astype(np.uint32) << np.uint32(1)
            rest[: len(own)] |= np.uint32(1)
            order = np.lexsort((rest, part))
            part, rest = part[order], rest[order]
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            runs = [rest[i:j].tobytes() for i, j in zip(starts, [*starts[1:], len(rest)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[starts], pa.int32()), pa.array(runs, pa.binary())], ["part", "run"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for part, run in zip(b.column("part").to_pylist(), b.column("run").to_pylist(), strict=True):
                runs.setdefault(part, []).append(np.frombuffer(run, np.uint32))
        for part, found in runs.items():
            every = np.sort(np.concatenate(found))
            # Entries of a block lie together, those of its own size last.
            twice = (every[1:] >> 1 == every[:-1] >> 1) & (every[1:] & 1 == 1)
            met = np.unique(every[1:][twice] >> 1).astype(np.uint64)
            out = (np.uint64(part) << np.uint64(64 - bits)) | (met << np.uint64(64 - bits - 31))
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64), pa.int64())], ["token"])

    sent = index.select("n", "tokens").mapInArrow(send, "part int, run binary")
    return sent.repartition(1 << bits, "part").mapInArrow(compare, "token long")


def entries(index: DataFrame, num: int, den: int) -> DataFrame:
    """(token, node, n, pos): the entries of lists, but for those that meet no other set there."""
    blocks = materialize(met_blocks(index, num, den), "blocks")
    known = share_filter(blocks)
    spent(blocks)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists, n = b.column("tokens"), b.column("n").to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            tokens, blocks = lists.flatten().to_numpy(), np.repeat(size_blocks(n, num, den), sizes)
            stays = known.value.passes(block_hashes(tokens, blocks)) | known.value.passes(block_hashes(tokens, blocks - 1))
            pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [tokens, np.repeat(b.column("node").to_numpy(), sizes), np.repeat(n, sizes), pos.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c[stays]) for c in columns], ["token", "node", "n", "pos"])

    return index.select("node", "n", "tokens").mapInArrow(keep, "token long, node long, n int, pos int")


def whole_sets(sets: DataFrame, k: int) -> DataFrame:
    """(node, shingles): the whole sets of (node, text)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, k).view(np.int64) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["node", "shingles"])

    return sets.mapInArrow(build, "node long, shingles array<long>")


def intersections(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, inter, total) of pairs (a, b): sizes of the intersection and of the union."""
    left = passing(sets, "node", pairs.select("a"), MAX_BROADCAST).select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    right = passing(sets, "node", pairs.select("b"), MAX_BROADCAST).select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = salted_join(pairs, right, "b").join(left.hint("merge"), "a")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), inter.alias("inter")).select("a", "b", "inter", (F.col("na") + F.col("nb") - F.col("inter")).alias("total"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b). Nodes without edges are left out.

    Each round every node takes the smallest label around it and then that label's own label, so the number of
    rounds grows with the logarithm of a component's length. A hub's edges are dealt over salted copies of its label.
    """
    edges = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        around = salted_join(edges, label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(around, "node").select("node", "component", F.least("component", "near").alias("low"))
        hop = label.select(F.col("node").alias("low"), F.col("component").alias("jump"))
        new = salted_join(materialize(low, "lows"), hop, "low").select("node", F.least("low", "jump").alias("component"), (F.least("low", "jump") < F.col("component")).alias("moved"))
        new = materialize(new, "labels")
        label = new.select("node", "component")
        if not new.where("moved").limit(1).count():
            return label


def differing(x: str, y: str) -> Column:
    """In how many places two parities differ; two sets differ in as many shingles at least."""
    return sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(PARITY_WORDS)), F.lit(0))


def plausible(pairs: DataFrame, index: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose prefixes share enough shingles for the sets to reach the threshold, and whose parities let them.

    Of two prefixes take the one that ends first in the common order: shared shingles up to there are in both
    prefixes, and the set has n - m others. So the intersection is at most the prefixes' plus the larger n - m.
    """
    pairs = materialize(pairs, "candidates")
    side = lambda at: passing(index, "node", pairs.select(at), MAX_BROADCAST).select(F.col("node").alias(at), F.col("n").alias(f"n{at}"), F.col("tokens").alias(f"t{at}"), F.col("parity").alias(f"p{at}"))
    both = salted_join(pairs, side("b"), "b").join(side("a").hint("merge"), "a")
    most = F.size(F.array_intersect("ta", "tb")) + F.greatest(F.col("na") - F.size("ta"), F.col("nb") - F.size("tb"))
    total = (F.col("na") + F.col("nb")).cast("long")
    return both.where((differing("pa", "pb") * (num + den) <= total * (den - num)) & (most.cast("long") * (num + den) >= total * num)).select("a", "b")


def linked_components(docs: DataFrame, index: DataFrame, k: int, num: int, den: int, more: DataFrame) -> DataFrame:
    """(node, component) of all nodes that are linked, by sets or by the edges `more` (a, b).

    Links to pivots make first components. Whatever lies in one of these is connected already, so that pairs are
    formed only between different ones, in the lists that hold several; a group of near copies, whose lists lie
    within it, forms none. Further links then join whole components.
    """
    lists = materialize(entries(index, num, den), "entries")
    shared = lists.groupBy("token").agg(F.count("*").alias("entries"), F.min(F.struct("node", "n")).alias("p")).where("entries > 1")
    shared = materialize(lists.join(shared.select("token", F.col("p.node").alias("pivot"), F.col("p.n").alias("pivot_n"), "entries"), "token"), "lists")
    spent(lists)

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialize(pairs, name)
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
        sets = materialize(whole_sets(passing(docs, "doc_id", nodes, MAX_BROADCAST).select(F.col("doc_id").alias("node"), "text"), k), "sets")
        out = materialize(intersections(pairs, sets).withColumn("linked", F.col("inter").cast("long") * den >= F.col("total").cast("long") * num), f"{name}-verified")
        spent(pairs, sets)
        return out

    limit = 1 - num / den
    close = (F.col("n") * den >= F.col("pivot_n") * num) & (F.col("pivot_n") * den >= F.col("n") * num)
    to_pivot = shared.where((F.col("node") != F.col("pivot")) & close).select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    # In long lists the distance to the pivot is worth knowing whatever it is: it keeps far pairs apart below. Parities
    # do that unless the sets are so large that they may differ in more places than unrelated parities do.
    large = (F.col("n") + F.col("pivot_n")) * (den - num) >= F.lit((num + den) * PARITY_BITS // 4)
    long = shared.where((F.col("node") != F.col("pivot")) & (F.col("entries") >= LONG_LIST) & large).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    near = verified(plausible(to_pivot, index, num, den).union(long).distinct(), "pivot-pairs")
    first = components(near.where("linked").select("a", "b").union(more))
    dist = near.select(F.col("a").alias("node"), F.col("b").alias("pivot"), (1 - F.col("inter") / F.col("total")).alias("d"))
    known = shared.join(first, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = known.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    known = salted_join(materialize(known, "labelled-lists"), mixed, "token").join(dist.hint("merge"), ["node", "pivot"], "left")
    known = known.withColumn("bucket", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + EPS))
    known = salted_join(materialize(known, "mixed-lists"), index.select("node", "parity"), "node")
    names = ("node", "n", "pos", "d", "component", "parity")
    x = known.select("token", "bucket", *[F.col(c).alias(f"x_{c}") for c in names])
    y = known.select("token", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"), *[F.col(c).alias(f"y_{c}") for c in names])
    need = (F.col("x_n") + F.col("y_n")) * F.lit(num / (num + den)) - EPS
    # A pair is met at the first shingle that its prefixes share; what follows must suffice from there.
    undecided = (
        (F.col("x_component") != F.col("y_component"))
        & ((F.col("x_n") < F.col("y_n")) | ((F.col("x_n") == F.col("y_n")) & (F.col("x_node") < F.col("y_node"))))
        & (F.col("x_n") * den >= F.col("y_n") * num)
        & (F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) >= need)
        & (differing("x_parity", "y_parity") * (num + den) <= (F.col("x_n") + F.col("y_n")) * (den - num))
        & F.coalesce(F.abs(F.col("x_d") - F.col("y_d")) <= limit + EPS, F.lit(True))
    )
    pairs = x.join(y.hint("merge"), ["token", "bucket"]).where(undecided).select(F.col("x_node").alias("a"), F.col("y_node").alias("b")).distinct()
    far = verified(plausible(pairs, index, num, den), "other-pairs").where("linked").select("a", "b")
    label = lambda edges, at: edges.join(first.select(F.col("node").alias(at), F.col("component").alias(f"{at}_label")), at, "left").withColumn(at, F.coalesce(f"{at}_label", at)).drop(f"{at}_label")
    whole = components(label(label(far, "a"), "b"))
    nodes = first.union(whole.select("node", "node")).groupBy("node").agg(F.min("component").alias("component"))
    return nodes.join(whole.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left").select("node", F.coalesce("joined", "component").alias("component"))


def near_duplicate_classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_shingles and component_id, for k-word shingles and Jaccard >= num/den."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(signatures(docs, k), "signatures")
    rows = signed.where("n is not null")
    group = rows.where("sig is not null and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("node"))
    copies = rows.where("doc_id is not null").select("doc_id").distinct().join(group.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_anti")
    texts = docs.where("doc_id is not null")
    # A copy that a filter of bits lets pass does no harm: it links to its like, whose id is smaller.
    reps = texts.join(F.broadcast(copies), "doc_id", "left_anti") if copies.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else passing(texts, "doc_id", group.select("node"), MAX_BROADCAST)
    index = materialize(prefixes(reps.select(F.col("doc_id").alias("node"), "text"), sketch(signed), k, num, den), "index")
    repeats = rows.where("sig is not null and doc_id is not null").groupBy("doc_id").agg(F.min("sig").alias("lo"), F.max("sig").alias("hi")).where("lo <> hi").select("doc_id")
    same = rows.join(repeats, "doc_id", "left_semi").join(group, "sig").where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = linked_components(docs, index, k, num, den, same)
    classes = group.join(found, "node", "left").select("sig", F.coalesce("component", "node").alias("class"))
    out = salted_join(rows, classes, "sig", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class", "doc_id")).alias("component_id"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"), k=3, num=9, den=10)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class (five words, 0.8) one row stays, that with the smallest doc_id.

    Rows are told apart by doc_id and text: repeated rows are copies of each other, texts that share an id are
    judged each on its own, and rows with a null id count like all others (the class's other ids come first).
    Null texts and texts without words are no copies of anything and stay, but for repeated rows. An empty table
    gives an empty one; all columns come back as they are.
    """
    row, kind = "_siteloom_row", "_siteloom_class"
    known = docs.withColumn(row, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text").isNull(), F.coalesce("text", F.lit(""))))
    classes = near_duplicate_classes(known.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias(row), F.col("component_id").alias(kind))
    ids = known.groupBy(row).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    found = materialize(classes.distinct().join(ids, row), "classes")
    best = found.groupBy(kind).agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", row)).alias("best"), F.count("*").alias("rows")).where("rows > 1")
    gone = salted_join(found, best.select(kind, F.col(f"best.{row}").alias("kept")), kind).where(F.col(row) != F.col("kept")).select(row)
    alone = without(known, row, materialize(gone, "copies"), MAX_BROADCAST)
    repeated = found.where("n > 1").select(row)
    if not repeated.limit(1).count():
        return alone.select(docs.columns)
    once = bounded_broadcast(repeated, MAX_BROADCAST)
    return alone.join(once, row, "left_anti").select(docs.columns).union(alone.join(once, row, "left_semi").dropDuplicates([row]).select(docs.columns))


OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 90 * (nx.n + ny.n - i)),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
