"""A table that streams upsert into: hash parts by key, rewritten only where a batch hits them.

Under the table's folder, `data/v=<batch>/part=<k>` holds what a batch made of part k, and `manifest/<batch>` says
which version of each part is current after it. A part that a batch does not hit keeps its files. A batch that is
run again starts from the manifest before its own and writes the same version anew, so it changes nothing; what a
lost batch left has no finished manifest and is never read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.operators.runs import latest_wins_upsert, unsettled
from siteloom.tables import cut

PART = "_siteloom_part"


class KeyedTable:
    """A table of schema (DDL text) under path, in so many hash parts of key; the number of parts never changes."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], parts: int = 64):
        self.spark, self.path, self.key, self.parts = spark, path.rstrip("/"), key, parts
        self.schema = T.StructType.fromDDL(schema)

    def part(self) -> F.Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.parts)).cast("int")

    def _batches(self) -> list[int]:
        """The batches whose manifests are complete, in order."""
        jvm = self.spark._jvm.org.apache.hadoop.fs
        found = jvm.Path(f"{self.path}/manifest/*/_SUCCESS")
        states = found.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(found)
        return sorted(int(s.getPath().getParent().getName()) for s in states or ())

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The current version of each part that has rows, or what it was before a batch."""
        done = [b for b in self._batches() if before is None or b < before]
        if not done:
            return {}
        rows = self.spark.read.schema("part int, version long").parquet(f"{self.path}/manifest/{done[-1]}").collect()
        return {r["part"]: r["version"] for r in rows}

    def read(self, before: int | None = None, parts: list[int] | None = None) -> DataFrame:
        held = self.versions(before)
        paths = [f"{self.path}/data/v={v}/{PART}={k}" for k, v in held.items() if parts is None or k in parts]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, incoming: DataFrame, batch: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Replaces the parts that incoming's keys fall in by combine(their rows, incoming)."""
        rows = cut(incoming.withColumn(PART, self.part()), "incoming")
        hit = sorted(r[0] for r in rows.select(PART).distinct().collect())
        made = combine(self.read(batch, hit), rows.drop(PART)).select(self.schema.fieldNames())
        made.withColumn(PART, self.part()).repartition(PART).write.partitionBy(PART).mode("overwrite").parquet(f"{self.path}/data/v={batch}")
        now = self.versions(batch) | dict.fromkeys(hit, batch)
        self.spark.createDataFrame(list(now.items()), "part int, version long").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/{batch}")


def latest_wins(table: KeyedTable, updates: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: upserts the last row of each key by `order`; present rows take the `updates` columns."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        names = [c for c in rows.columns if c != order]
        last = rows.groupBy(*table.key).agg(F.max_by(F.struct(*names), order).alias("r")).select("r.*")
        table.merge(last, batch_id, lambda held, new: latest_wins_upsert(held, new, table.key, updates))

    return batch


def idempotent_publish(table: KeyedTable) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function over pairs (run_id, target_id): publishes those that have no publication but failed ones.

    It reads the parts that its pairs fall in, as they were before the batch, not all publications.
    """

    def batch(pairs: DataFrame, batch_id: int) -> None:
        fresh = lambda held, new: held.unionByName(unsettled(new, held).withColumn("status", F.lit("published")))
        table.merge(pairs.select(table.key).distinct(), batch_id, fresh)

    return batch
