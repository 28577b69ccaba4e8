"""Structured Streaming forms of the run operators: hourly series, dedup, policy and page changes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siteloom.functions import urls as U
from siteloom.operators import policy


def hourly_run_stats(runs: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Tumbling half-open hours per website by start; rows later than the watermark are dropped."""
    rows = runs.withColumn("started_at", F.col("started_at").cast("timestamp")).withWatermark("started_at", delay)
    grouped = rows.groupBy("website_id", F.window("started_at", "1 hour").alias("w")).agg(F.count("*").alias("runs"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"))
    return grouped.select("website_id", F.col("w.start").alias("bucket_start"), "runs", "completed", "failed")


def url_dedup(candidates: DataFrame, time: str = "seen_at", delay: str = "1 hour") -> DataFrame:
    """The first row of each normalised URL of a site within the watermark."""
    rows = candidates.withColumn("norm_url", U.normalize_url("url")).where("norm_url is not null")
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(["site", "norm_url"])


def policy_filter(stream: DataFrame, rules: DataFrame, url: str = "norm_url") -> DataFrame:
    """A stream joined with the static rules of its sites; no state."""
    return policy.robots_allowed(stream, rules, url).where("allowed")


def filled_hours(sites: DataFrame, made: DataFrame, start: Column, end: Column) -> DataFrame:
    """What hourly_run_stats has put out, with every website's every hour of [start, end): zero where nothing ran."""
    hour = F.expr("interval 1 hour")
    series = sites.select("website_id", F.explode(F.sequence(start, end - hour, hour)).alias("bucket_start"))
    out = series.join(made, ["website_id", "bucket_start"], "left")
    return out.select("website_id", "bucket_start", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "completed", "failed")))


def late_rows(arrived: DataFrame, made: DataFrame, settled: Column) -> DataFrame:
    """(website_id, bucket_start, late): the rows of hours that ended by `settled` which the stream came too late to count."""
    hours = arrived.groupBy("website_id", F.window("started_at", "1 hour")["start"].alias("bucket_start")).agg(F.count("*").alias("n"))
    ended = hours.where(F.col("bucket_start") + F.expr("interval 1 hour") <= settled)
    late = F.col("n") - F.coalesce("runs", F.lit(0))
    return ended.join(made.select("website_id", "bucket_start", "runs"), ["website_id", "bucket_start"], "left").select("website_id", "bucket_start", late.alias("late")).where("late > 0")


class Dropped(StreamingQueryListener):
    """Counts what the watermark dropped, by query run and batch: rows, or groups of them where a batch's late rows of
    one key were added up before they met the watermark. table() holds the counts so far."""

    def __init__(self) -> None:
        self.counts: dict[tuple[str, int], tuple[str | None, int]] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        n = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        if n:
            self.counts[str(p.runId), p.batchId] = (p.name, n)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(run, batch, name, n) for (run, batch), (name, n) in self.counts.items()], "run string, batch long, name string, dropped long")


#: A key's state goes when it has seen no row for so long (milliseconds). A stream that is run to its end and
#: stopped, with an availableNow trigger, takes None: its clock only stands while it runs, and Spark would wait for it.
PAGE_TTL = 90 * 24 * 3_600_000


def stateful(rows: DataFrame, key: str, order: list[str], out: str, state: str, ttl: int | None, step: Callable[[object, pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]) -> DataFrame:
    """step(key, a micro-batch's rows in order, state) by key, with a state that is dropped after `ttl` milliseconds, or never."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        made, new = step(k[0], rows, tuple(held.get) if held.exists else None)
        held.update(new)
        if ttl:
            held.setTimeoutDuration(ttl)
        yield made

    clock = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    return rows.groupBy(key).applyInPandasWithState(run, out, state, "append", clock)


def page_changes(pages: DataFrame, ttl: int | None = PAGE_TTL) -> DataFrame:
    """(norm_url, seen_id, hash, change) of pages(norm_url, seen_id, hash): a row where a page is new or its hash differs."""

    def step(key: object, rows: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        before = rows["hash"].shift(1, fill_value=state[0] if state else "")
        moved = rows["hash"] != before
        if not state:
            moved.iloc[0] = True
        found = rows.loc[moved, ["norm_url", "seen_id", "hash"]].assign(change="changed")
        if not state:
            found.iloc[0, 3] = "new"
        return found, (rows["hash"].iloc[-1],)

    return stateful(pages, "norm_url", ["seen_id"], "norm_url string, seen_id long, hash string, change string", "hash string", ttl, step)
