"""Benchmark decontamination by a prefix-filtered join of item windows with document shingles.

A window is `size` consecutive words of a benchmark item (a shorter item is one window); it must occur whole. Its
tokens are its shingles of three words (of all its words if it has fewer), ordered by rarity over all documents.
Containment of the whole window leaves a prefix of one token, so a window is joined under its rarest token alone.
A document sends a row for each of its shingles that may be such a token, with the words around it; a filter of
bits, whose size is bounded, keeps nearly all others at home. Rows and windows meet by token. The token's place in
the window and the window's length must fit into the document (positional and length bounds), and the words there
must equal the window's (exact verification). What is found is grouped by row and joined back to the documents.

Nothing but the filter passes through the driver. Tokens that many documents hold, as passages that are copied
around do, are salted.

Edge cases: null and empty texts have no words and are not contaminated; items without words are ignored;
repeated items count by distinct item_id; repeated rows are reported each; an empty benchmark gives zeros; an
empty table gives no rows; extra columns pass through, but for those named as the new ones in any case, which are
replaced; a null item_id is ignored in the item list but its windows still mark words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.llm.common import bounded_broadcast, hash_words, materialize, ngram_hashes, others, salted_join, small_batches, table

#: Columns that are added.
FOUND = ("n_words", "spans", "items")
#: Words of a token.
TOKEN_WORDS = 3
#: The filter has so many bits for each token, between these powers of two: at most 128 MB.
BITS_A_TOKEN, LEAST_BITS, MOST_BITS = 64, 20, 30
#: A task hands on its counts and its probes when it holds so many.
HELD_COUNTS, HELD_PROBES = 200_000, 4_000
#: Ids that may be broadcast; more are joined by a shuffle.
MAX_BROADCAST = 500_000
#: ASCII letters (in lower case), digits and all bytes above ASCII make words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
ROW = "_siteloom_row"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def benchmark_windows(items: DataFrame, size: int) -> DataFrame:
    """Distinct windows of items(item_id, text): window long, words array<binary>, tokens array<long>, items array<long>."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, wins, tokens = [], [], []
            for i, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ws = words(text)
                n, t = min(size, len(ws)), min(TOKEN_WORDS, len(ws))
                every = ngram_hashes(hash_words(ws), t).view(np.int64).tolist() if ws else []
                for k in range(len(ws) - n + 1 if ws else 0):
                    ids.append(i)
                    wins.append(ws[k : k + n])
                    tokens.append(every[k : k + n - t + 1])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(wins, pa.list_(pa.binary())), pa.array(tokens, pa.list_(pa.int64()))], ["item_id", "words", "tokens"])

    cuts = items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(cut, "item_id long, words array<binary>, tokens array<long>")
    each = cuts.groupBy("words").agg(F.first("tokens").alias("tokens"), F.sort_array(F.collect_set("item_id")).alias("items"))
    return each.select(F.monotonically_increasing_id().alias("window"), "words", "tokens", "items")


class TokenFilter:
    """Bits of the tokens' first hash bits: it may let others pass, but stops none of them."""

    def __init__(self, tokens: DataFrame):
        bits = min(MOST_BITS, max(LEAST_BITS, (tokens.count() * BITS_A_TOKEN).bit_length()))
        place = F.shiftrightunsigned("token", 64 - bits)
        blocks = tokens.select(place.alias("place")).groupBy(F.shiftright("place", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("place") % (1 << 15)).alias("set"))
        self.shift, self.set = np.uint64(64 - bits), np.zeros(1 << (bits - 3), np.uint8)
        for r in blocks.toLocalIterator():
            self.set[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["set"], np.uint8)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> self.shift
        return (self.set[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def share_filter(tokens: DataFrame) -> Broadcast:
    return tokens.sparkSession.sparkContext.broadcast(TokenFilter(tokens))


def token_counts(docs: DataFrame, known: Broadcast, sizes: list[int]) -> DataFrame:
    """(token, n): how often all documents hold each token that the filter lets pass; partly summed in the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[int] = Counter()

        def sums() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.int64()), pa.array(list(n.values()), pa.int64())], ["token", "n"])

        for b in batches:
            for text in b.column("text").to_pylist():
                h = hash_words(words(text))
                for t in sizes:
                    tokens = ngram_hashes(h, t)
                    n.update(tokens[known.value.passes(tokens)].view(np.int64).tolist())
            if len(n) > HELD_COUNTS:
                yield sums()
                n.clear()
        yield sums()

    return docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def rarest_tokens(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """windows with their rarest token and its place in them."""
    each = materialize(windows.select("window", F.posexplode("tokens").alias("at", "token")), "window-tokens")
    known = salted_join(each, counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = known.groupBy("window").agg(F.min(F.struct("n", "token", "at")).alias("best"))
    return windows.join(best, "window").select(F.col("best.token").alias("token"), F.col("best.at").alias("at"), "words", "items")


def probes(docs: DataFrame, known: Broadcast, sizes: list[int], size: int) -> DataFrame:
    """(row, n_words, probes) of docs(row, text): the row's shingles that the filter lets pass, with the words around.

    A probe has the shingle's place and token, up to size - 1 words before it, `left` of them, and as many after it
    as a window can have.
    """
    probe = pa.struct([("place", pa.int32()), ("token", pa.int64()), ("left", pa.int32()), ("around", pa.list_(pa.binary()))])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n_words, found, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(n_words, pa.int32()), pa.array(found, pa.list_(probe))], ["row", "n_words", "probes"])

        for b in batches:
            for row, text in zip(b.column(ROW).to_pylist(), b.column("text").to_pylist(), strict=True):
                ws = words(text)
                h, got = hash_words(ws), []
                for t in sizes:
                    tokens = ngram_hashes(h, t)
                    for p in np.flatnonzero(known.value.passes(tokens)).tolist():
                        left = min(p, size - t)
                        got.append({"place": p, "token": int(tokens[p].view(np.int64)), "left": left, "around": ws[p - left : p + size]})
                rows.append(row)
                n_words.append(len(ws))
                found.append(got)
                held += len(got) + 1
                if held > HELD_PROBES:
                    yield flush()
                    rows, n_words, found, held = [], [], [], 0
        yield flush()

    return docs.mapInArrow(look, "row long, n_words int, probes array<struct<place:int,token:long,left:int,around:array<binary>>>")


def merged_spans(spans: Column) -> Column:
    """Sorted [start, end) structs united where they meet, as arrays of two numbers."""
    span = lambda s: F.array(s["start"], s["end"])

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        widened = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.array(last[0], F.greatest(last[1], s["end"]))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(last, F.lit(2))), widened).otherwise(F.concat(acc, F.array(span(s))))

    return F.aggregate(F.sort_array(spans), F.array().cast("array<array<int>>"), add)


def row_of(docs: DataFrame) -> Column:
    """A row's own number by its id and text; equal rows share it and what is found in them."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit("")))


def found_rows(docs: DataFrame, items: DataFrame, size: int = 13) -> DataFrame:
    """(row, n_words, spans, items) of the rows of docs(doc_id, text); spans and items are null where none is found."""
    small_batches(docs.sparkSession)
    texts = docs.select(row_of(docs).alias(ROW), "text")
    windows = materialize(benchmark_windows(items, size), "windows")
    sizes = sorted(r["t"] for r in windows.select(F.least(F.size("words"), F.lit(TOKEN_WORDS)).alias("t")).distinct().collect())
    every = share_filter(windows.select(F.explode("tokens").alias("token")).distinct())
    keyed = materialize(rarest_tokens(windows, token_counts(docs, every, sizes)), "keyed-windows")
    looked = materialize(probes(texts, share_filter(keyed.select("token").distinct()), sizes, size), "probes")
    asked = looked.select("row", F.explode("probes").alias("x")).select("row", "x.*")
    met = salted_join(asked, keyed, "token").where(F.col("left") >= F.col("at"))
    start = F.col("place") - F.col("at")
    hits = met.where(F.slice("around", F.col("left") - F.col("at") + 1, F.size("words")) == F.col("words"))
    hits = hits.select("row", F.struct(start.alias("start"), (start + F.size("words")).alias("end")).alias("span"), "items")
    spans, names = merged_spans(F.collect_set("span")), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items"))))
    return looked.select("row", "n_words").distinct().join(hits.groupBy("row").agg(spans.alias("spans"), names.alias("items")), "row", "left")


def contaminated_spans(docs: DataFrame, items: DataFrame, size: int = 13, names: tuple[str, str, str] = FOUND) -> DataFrame:
    """Every row of docs with its number of words, the spans of hit words (disjoint, in order) and the items found."""
    spans = F.coalesce("spans", F.array().cast("array<array<int>>"))
    found = found_rows(docs, items, size).select(F.col("row").alias(ROW), F.struct("n_words", spans.alias("spans"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items")).alias("_siteloom_found"))
    keep = others(docs, *names)
    out = docs.select(*keep, row_of(docs).alias(ROW)).join(found, ROW)
    return out.select(*keep, *(F.col(f"_siteloom_found.{c}").alias(n) for c, n in zip(FOUND, names, strict=True)))


def hit_words(spans: str | Column) -> Column:
    return F.aggregate(spans, F.lit(0), lambda n, s: n + s[1] - s[0]).cast("long")


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words contaminates."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def summary(found: DataFrame) -> DataFrame:
    """Counts of hit words and of items, and whether they contaminate."""
    return (
        found.withColumn("n_hit", hit_words("spans"))
        .withColumn("names", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
        .select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("n_words").cast("long").alias("n_words"),
            "n_hit",
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("names", ","), 256).alias("items_sha256"),
            is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
        )
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(contaminated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that aren't contaminated.

    Null and empty texts stay; equal rows are judged alike; an empty table gives an empty one; all columns come
    back as they are.
    """
    found = found_rows(docs, table(spark, sf_dir, "benchmark"))
    bad = found.where(is_contaminated(hit_words("spans"), F.col("n_words"))).select(F.col("row").alias(ROW))
    return docs.withColumn(ROW, row_of(docs)).join(bounded_broadcast(materialize(bad, "contaminated"), MAX_BROADCAST), ROW, "left_anti").select(docs.columns)


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 13 THEN [ws]
  ELSE list_transform(range(1, len(ws) - 11), lambda i: ws[i:i + 12]) END) AS g FROM b),
lens AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (SELECT doc_id, unnest(range(1, len(ws) - n + 2)) AS p, n, ws FROM d, lens WHERE len(ws) >= n),
m AS (SELECT dw.doc_id, dw.p, dw.n, bw.item_id FROM dw JOIN bw ON bw.g = dw.ws[dw.p:dw.p + dw.n - 1] AND len(bw.g) = dw.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN i ON i.doc_id = d.doc_id
"""
