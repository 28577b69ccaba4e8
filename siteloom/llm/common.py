"""Helpers shared by the training-data operators; their tables lie in the application's folder (siteloom.tables)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.tables import cut as materialize
from siteloom.tables import shared_folder as shared_dir
from siteloom.tables import spent

#: Rows and bytes in one Arrow batch. Texts can be long, so batches stay short.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that Python workers hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id's decimal text is divisible by 5; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample_rows(df: DataFrame, key: str, limit: int) -> DataFrame:
    """At most `limit` rows, the same ones each time: those of the smallest key hashes."""
    return df.orderBy(F.xxhash64(key), key).limit(limit)


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of a sequence of word hashes, in order; empty if it is shorter."""
    if len(h) < n:
        return h[:0]
    out = mix(h[: len(h) - n + 1])
    for i in range(1, n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def texts(column: pa.ChunkedArray | pa.Array) -> Iterator[str | None]:
    """Python strings of an Arrow column, one at a time."""
    for x in column:
        yield x.as_py()


def bounded_broadcast(df: DataFrame, limit: int) -> DataFrame:
    """Marks df for broadcast if it has at most `limit` rows, else leaves the join to a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


#: A filter has so many bits for each id, between these powers of two (at most 128 MB), in blocks of 2^15 bits.
BITS_AN_ID, LEAST_BITS, MOST_BITS, BLOCK_BITS = 16, 20, 30, 15


def sieved(rows: DataFrame, key: str, ids: DataFrame, flag: str) -> DataFrame:
    """rows with a flag that is true wherever the key is among ids (one column), and by chance elsewhere."""
    bits = min(MOST_BITS, max(LEAST_BITS, (ids.count() * BITS_AN_ID).bit_length()))
    place = lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits)
    block, at, found = "_siteloom_block", "_siteloom_at", "_siteloom_bits"
    blocks = ids.select(place(F.col(ids.columns[0]).cast("long")).alias(at)).groupBy(F.shiftright(at, BLOCK_BITS).alias(block)).agg(F.bitmap_construct_agg(F.col(at) % (1 << BLOCK_BITS)).alias(found))
    placed = rows.withColumn(at, place(F.col(key).cast("long"))).withColumn(block, F.shiftright(at, BLOCK_BITS)).withColumn(at, (F.col(at) % (1 << BLOCK_BITS)).cast("int"))
    byte = F.conv(F.hex(F.substring(found, F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col(key).isNotNull() & F.coalesce(F.getbit(byte, F.col(at) % 8) == 1, F.lit(False))
    return placed.join(F.broadcast(blocks), block, "left").select(*rows.columns, hit.alias(flag))


def passing(rows: DataFrame, key: str, ids: DataFrame, limit: int) -> DataFrame:
    """The rows whose key is among ids (one column, repeats are fine), with at most `limit` distinct ids; with more,
    a few others too: a filter of bits decides, so that rows are never shuffled."""
    ids = ids.toDF("_siteloom_id").distinct()
    if ids.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(ids), F.col(key) == F.col("_siteloom_id"), "left_semi")
    return sieved(rows, key, ids, "_siteloom_hit").where("_siteloom_hit").drop("_siteloom_hit")


def without(rows: DataFrame, key: str, ids: DataFrame, limit: int) -> DataFrame:
    """The rows whose key is not among ids (one column); with more than `limit` ids only rows that a filter of bits
    takes for theirs are shuffled."""
    ids = ids.toDF(key)
    if ids.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(ids), key, "left_anti").select(rows.columns)
    told = sieved(rows, key, ids, "_siteloom_hit")
    return told.where("not _siteloom_hit").select(rows.columns).union(told.where("_siteloom_hit").join(ids.hint("merge"), key, "left_anti").select(rows.columns))


#: A key that holds more than one of so many rows is hot; there are fewer hot keys than that, so they can be broadcast.
HOT_SHARE = 1000
#: What keys are joined by when they are hot, beside the key itself.
SALT, SALTS = "_siteloom_salt", 32


def salted_join(rows: DataFrame, looked_up: DataFrame, key: str, how: str = "inner", least: int = 1000) -> DataFrame:
    """rows joined with a table of unique keys, the rows of hot keys dealt over salted copies of their one row there.

    rows should be a written table, as it is read twice. Hot keys have more than `least` rows and a share of all
    rows above 1 / HOT_SHARE. Rows with a null key find nothing; with how="left" they stay, spread like hot ones.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_siteloom_n"))
    hot = counts.where((F.col("_siteloom_n") > least) & (F.col("_siteloom_n") * HOT_SHARE > rows.count())).select(key, F.lit(True).alias("_siteloom_hot"))
    rest = [c for c in rows.columns if c != key]
    spread = F.pmod(F.xxhash64(*rest) if rest else F.lit(0), F.lit(SALTS)).cast("int")
    left = rows.join(F.broadcast(hot), key, "left").withColumn(SALT, F.when(F.col("_siteloom_hot") | F.col(key).isNull(), spread).otherwise(0)).drop("_siteloom_hot")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    right = looked_up.join(F.broadcast(hot), key, "left").withColumn(SALT, F.explode(F.when(F.col("_siteloom_hot"), every).otherwise(F.array(F.lit(0))))).drop("_siteloom_hot")
    return left.join(right.hint("merge"), [key, SALT], how).drop(SALT)


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but for these; names differ in more than case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of ASCII text."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: {bits}), 4294967295)"
