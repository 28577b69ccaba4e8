"""Registered queries of run analytics, schedules, sinks and streams, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.functions import urls as U
from siteloom.operators import diff as D
from siteloom.operators import frontier as FR
from siteloom.operators import index as IX
from siteloom.operators import pages as PG
from siteloom.operators import policy as PO
from siteloom.operators import runs as R
from siteloom.plans import crawl_queries as CQ
from siteloom.plans import inputs
from siteloom.tables import cut, shared_folder
from siteloom.plans.crawl_queries import _CAND, _NORM, _bodies
from siteloom.sources import crawl as S
from siteloom.streaming import event_time as ET
from siteloom.streaming import keyed as K
from siteloom.streaming import runs as ST

START, END, NOW = "2024-01-10 00:00:00", "2024-01-13 00:00:00", "2024-01-20 12:34:56"

_NUM = "CASE WHEN json_valid(stats) AND json_type(stats, '{0}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN CAST(json_extract_string(stats, '{0}') AS DOUBLE) END"
_RUNS = f"""runs AS ({inputs.RUNS_DUCKDB}),
st AS (SELECT *, {_NUM.format('$.pages_crawled')} AS pages_crawled, CASE WHEN status = 'completed' THEN CAST({_NUM.format('$.links_emitted')} + coalesce({_NUM.format('$.links_optional')}, 0) AS BIGINT) END AS index_pages,
  CASE WHEN status = 'completed' THEN CAST({_NUM.format('$.llms_txt_bytes')} AS BIGINT) END AS index_bytes, CASE WHEN status = 'completed' THEN CAST({_NUM.format('$.index_diff.pages_added')} AS BIGINT) END AS pages_added,
  CASE WHEN status = 'completed' THEN CAST({_NUM.format('$.index_diff.pages_removed')} AS BIGINT) END AS pages_removed FROM runs)"""
_IN = f"started_at >= TIMESTAMP '{START}' AND started_at < TIMESTAMP '{END}'"
_SITES = "sites AS (SELECT DISTINCT user_id AS website_id, user_id % 40 AS user_id, TIMESTAMP '2024-01-01' + to_hours(CAST(user_id AS INT)) AS created_at FROM events)"
_SCHED = f"""sched AS (SELECT user_id AS schedule_id, user_id AS website_id, user_id % 5 <> 0 AS active, CASE user_id % 4 WHEN 0 THEN 60 WHEN 1 THEN 360 WHEN 2 THEN 1440 ELSE 10080 END AS interval_minutes,
  CASE WHEN user_id % 5 <> 0 AND user_id % 7 <> 0 THEN TIMESTAMP '{NOW}' + to_minutes(CAST(user_id % 60 - 30 AS INT)) END AS next_run_at FROM (SELECT DISTINCT user_id FROM events))"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def ts(text: str) -> F.Column:
    return F.lit(text).cast("timestamp")


def _sites(spark: SparkSession, d: str) -> DataFrame:
    users = spark.read.parquet(f"{d}/events.parquet").select("user_id").distinct()
    return users.select(F.col("user_id").alias("website_id"), (F.col("user_id") % 40).alias("user_id"), F.timestamp_micros(F.unix_micros(ts("2024-01-01")) + F.col("user_id") * R.HOUR_US).alias("created_at"))


def _schedules(spark: SparkSession, d: str) -> DataFrame:
    u = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("u")).distinct()
    at = F.timestamp_micros(F.unix_micros(ts(NOW)) + (F.col("u") % 60 - 30) * 60_000_000)
    return u.select(F.col("u").alias("schedule_id"), F.col("u").alias("website_id"), (F.col("u") % 5 != 0).alias("active"), F.expr("CASE u % 4 WHEN 0 THEN 60 WHEN 1 THEN 360 WHEN 2 THEN 1440 ELSE 10080 END").alias("interval_minutes"), F.when((F.col("u") % 5 != 0) & (F.col("u") % 7 != 0), at).alias("next_run_at"))


# ---------------------------------------------------------------- stats and series
@query("s07_stats_json_scan", f"WITH {_RUNS} SELECT id, pages_crawled, index_pages, index_bytes, pages_added, pages_removed, took_ms AS duration_ms FROM st")
def s07(spark: SparkSession, d: str) -> DataFrame:
    return R.with_stats(inputs.runs(spark, d)).select("id", "pages_crawled", "index_pages", "index_bytes", "pages_added", "pages_removed", "duration_ms")


@query(
    "s08_public_stats",
    f"""WITH {_RUNS}, o AS (SELECT id, CASE WHEN json_valid(stats) AND json_type(stats) = 'OBJECT' THEN stats END AS o FROM runs)
SELECT id, json_extract_string(o, '$.pages_crawled') AS pages_crawled, array_to_string(list_sort(list_filter(json_keys(o), lambda k: k <> 'content_hashes')), ',') AS keys FROM o""",
)
def s08(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.runs(spark, d).select("id", R.public_stats(F.when(F.try_parse_json("stats").isNotNull() & F.col("stats").startswith("{"), F.col("stats"))).alias("m"))
    return rows.select("id", F.try_element_at("m", F.lit("pages_crawled")).alias("pages_crawled"), F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"))


_BUCKET = f"""b AS (SELECT website_id, date_trunc('hour', started_at) AS bucket_start, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  avg(coalesce(pages_crawled, 0)) AS avg_pages, avg(CASE WHEN status = 'completed' THEN took_ms END) AS avg_duration_ms, count(pages_added) AS runs_compared, CAST(sum(pages_added) AS BIGINT) AS pages_added, CAST(sum(pages_removed) AS BIGINT) AS pages_removed,
  arg_max(index_pages, (started_at, id)) FILTER (index_pages IS NOT NULL) AS index_pages, arg_max(index_bytes, (started_at, id)) FILTER (index_bytes IS NOT NULL) AS index_bytes FROM st WHERE {_IN} GROUP BY 1, 2)"""


@query("a07_bucket_stats", f"WITH {_RUNS}, {_BUCKET} SELECT * REPLACE (round(avg_pages, 6) AS avg_pages, round(avg_duration_ms, 6) AS avg_duration_ms) FROM b")
def a07(spark: SparkSession, d: str) -> DataFrame:
    out = R.bucket_stats(inputs.runs(spark, d), ts(START), ts(END))
    return out.withColumn("avg_pages", F.round("avg_pages", 6)).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query(
    "a17_trend_points",
    f"WITH {_RUNS}, {_BUCKET} SELECT website_id, bucket_start, runs, runs_compared, index_bytes / 1024.0::DOUBLE AS index_kb, index_pages, pages_added AS added, pages_removed AS removed, -pages_removed AS removed_negative FROM b",
)
def a17_trend(spark: SparkSession, d: str) -> DataFrame:
    return R.trend_points(R.bucket_stats(inputs.runs(spark, d), ts(START), ts(END)))


@query("j07_bucket_fill", f"""WITH {_RUNS}, {_SITES}, {_BUCKET}, h AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS bucket_start)
SELECT sites.website_id, h.bucket_start, coalesce(runs, 0) AS runs, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed, round(coalesce(avg_pages, 0), 6) AS avg_pages, round(coalesce(avg_duration_ms, 0), 6) AS avg_duration_ms,
coalesce(runs_compared, 0) AS runs_compared, coalesce(pages_added, 0) AS pages_added, coalesce(pages_removed, 0) AS pages_removed, index_pages, index_bytes FROM sites CROSS JOIN h LEFT JOIN b ON b.website_id = sites.website_id AND b.bucket_start = h.bucket_start""")  # fmt: skip
def j07(spark: SparkSession, d: str) -> DataFrame:
    stats = R.bucket_stats(inputs.runs(spark, d), ts(START), ts(END))
    out = R.bucket_fill(_sites(spark, d), stats, ts(START), ts(END))
    return out.withColumn("avg_pages", F.round("avg_pages", 6)).withColumn("avg_duration_ms", F.round("avg_duration_ms", 6))


@query("a09_window_totals", f"""WITH {_RUNS} SELECT website_id, count(*) AS total_runs, count(*) FILTER (status = 'completed') AS total_completed, count(*) FILTER (status = 'failed') AS total_failed, round(avg(coalesce(pages_crawled, 0)), 6) AS total_avg_pages,
round(count(*) FILTER (status = 'completed')::DOUBLE / nullif(count(*) FILTER (status IN ('completed', 'failed')), 0), 9) AS success_rate, max(started_at) AS last_run_at, count(pages_added) AS total_runs_compared FROM st WHERE {_IN} GROUP BY 1""")  # fmt: skip
def a09(spark: SparkSession, d: str) -> DataFrame:
    return R.window_totals(inputs.runs(spark, d), ts(START), ts(END)).withColumn("total_avg_pages", F.round("total_avg_pages", 6)).withColumn("success_rate", F.round("success_rate", 9))


@query("w14_latest_completed", f"WITH {_RUNS} SELECT website_id, id, started_at FROM runs WHERE status = 'completed' AND {_IN} QUALIFY row_number() OVER (PARTITION BY website_id ORDER BY started_at DESC, id DESC) = 1")
def w14(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_completed_in_window(inputs.runs(spark, d), ts(START), ts(END))


@query("w16_resolve_window", f"WITH {_RUNS} SELECT website_id, count(*) AS runs FROM runs WHERE started_at >= TIMESTAMP '2024-01-19 13:00:00' AND started_at < TIMESTAMP '2024-01-20 13:00:00' GROUP BY 1")
def w16(spark: SparkSession, d: str) -> DataFrame:
    start, end = R.resolve_window(NOW, "1d")
    return inputs.runs(spark, d).where((F.col("started_at") >= ts(start)) & (F.col("started_at") < ts(end))).groupBy("website_id").agg(F.count("*").alias("runs"))


# ---------------------------------------------------------------- lists and joins
_LAST = "last AS (SELECT website_id, id, started_at, status, stats, pages_crawled FROM st QUALIFY row_number() OVER (PARTITION BY website_id ORDER BY started_at DESC, id DESC) = 1)"


@query("j05_latest_run", f"WITH {_RUNS}, {_LAST} SELECT website_id, id, started_at, status FROM last")
def j05(spark: SparkSession, d: str) -> DataFrame:
    return R.latest_run(inputs.runs(spark, d)).select("website_id", "id", "started_at", "status")


_LIST = f"{_RUNS}, {_SITES}, {_SCHED}, {_LAST}, lst AS (SELECT sites.website_id, last.id AS run_id, last.status, CAST(floor(last.pages_crawled) AS BIGINT) AS pages_crawled, sched.active, sched.interval_minutes, coalesce(last.started_at, created_at) AS activity, last.started_at FROM sites LEFT JOIN last USING (website_id) LEFT JOIN sched USING (website_id))"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return R.site_list(_sites(spark, d), inputs.runs(spark, d).where("website_id % 11 <> 0"), _schedules(spark, d))


@query("j06_site_list", f"WITH {_LIST.replace('USING (website_id) LEFT JOIN sched', 'ON last.website_id = sites.website_id AND sites.website_id % 11 <> 0 LEFT JOIN sched').replace('LEFT JOIN sched USING (website_id)', 'LEFT JOIN sched ON sched.website_id = sites.website_id')} SELECT website_id, run_id, status, pages_crawled, active, interval_minutes, activity FROM lst")
def j06(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d).select("website_id", "run_id", "status", "pages_crawled", "active", "interval_minutes", "activity")


@query("p26_row_status", f"""WITH {_LIST.replace('USING (website_id) LEFT JOIN sched', 'ON last.website_id = sites.website_id AND sites.website_id % 11 <> 0 LEFT JOIN sched').replace('LEFT JOIN sched USING (website_id)', 'LEFT JOIN sched ON sched.website_id = sites.website_id')}
SELECT website_id, CASE WHEN status IS NULL THEN CASE WHEN active THEN 'scheduled' ELSE 'never_run' END WHEN status IN ('pending', 'processing') THEN 'running' ELSE status END AS row_status, CASE WHEN NOT active THEN 'Off' WHEN interval_minutes = 60 THEN 'Hourly' WHEN interval_minutes = 360 THEN 'Every 6 hours' WHEN interval_minutes = 1440 THEN 'Daily' ELSE 'Weekly' END AS label FROM lst""")  # fmt: skip
def p26(spark: SparkSession, d: str) -> DataFrame:
    rows = _listed(spark, d).withColumn("row_status", R.row_status(F.col("status"), F.col("active")))
    rows = rows.withColumn("label", R.schedule_label(F.col("active"), F.col("interval_minutes")))
    return R.sort_sites(rows, "last_run", True).select("website_id", "row_status", "label")


@query("j08_sites_with_active_runs", f"WITH {_RUNS} SELECT DISTINCT website_id FROM runs WHERE status IN ('pending', 'processing') AND {_IN}")
def j08(spark: SparkSession, d: str) -> DataFrame:
    runs = inputs.runs(spark, d).where((F.col("started_at") >= ts(START)) & (F.col("started_at") < ts(END)))
    return R.sites_with_active_runs(_sites(spark, d), runs).select("website_id")


_DUE = f"due AS (SELECT * FROM sched WHERE active AND next_run_at <= TIMESTAMP '{NOW}' ORDER BY next_run_at, schedule_id LIMIT 50), busy AS (SELECT DISTINCT website_id FROM runs WHERE status IN ('pending', 'processing') AND {_IN} AND id % 9 = 0)"


def _due(spark: SparkSession, d: str) -> DataFrame:
    busy = inputs.runs(spark, d).where((F.col("started_at") >= ts(START)) & (F.col("started_at") < ts(END)) & (F.col("id") % 9 == 0))
    return R.due_split(R.due_schedules(_schedules(spark, d), ts(NOW)), busy)


@query("w13_due_split", f"WITH {_RUNS}, {_SCHED}, {_DUE} SELECT schedule_id, next_run_at, website_id NOT IN (SELECT website_id FROM busy) AS ran FROM due")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return _due(spark, d).select("schedule_id", "next_run_at", "ran")


@query("a19_tick_summary", f"WITH {_RUNS}, {_SCHED}, {_DUE} SELECT count(*) AS due, count(*) FILTER (website_id NOT IN (SELECT website_id FROM busy)) AS started, count(*) FILTER (website_id IN (SELECT website_id FROM busy)) AS skipped FROM due")
def a19(spark: SparkSession, d: str) -> DataFrame:
    return R.tick_summary(_due(spark, d))


@query(
    "p23_advance",
    f"""WITH {_SCHED} SELECT schedule_id, interval_minutes AS minutes, interval_minutes * 57 AS earliest_s, interval_minutes * 63 AS latest_s, true AS within FROM sched""",
)
def p23(spark: SparkSession, d: str) -> DataFrame:
    """The jitter is drawn from Spark's hash, so SQL can tell its bounds only, from each schedule's own interval."""
    at = R.advance_next_run_at(ts(NOW), F.col("interval_minutes"), F.col("schedule_id"))
    took = (F.unix_micros(at) - F.unix_micros(ts(NOW))) / 1_000_000
    low, high = F.col("interval_minutes") * 57, F.col("interval_minutes") * 63
    rows = _schedules(spark, d).select("schedule_id", F.col("interval_minutes").alias("minutes"), low.alias("earliest_s"), high.alias("latest_s"), took.between(low, high).alias("within"))
    return rows


@query("p22_next_run_at", f"""WITH {_SCHED} SELECT schedule_id, CASE WHEN schedule_id % 6 = 0 THEN NULL WHEN active AND schedule_id % 3 <> 1 AND next_run_at IS NOT NULL THEN next_run_at
ELSE TIMESTAMP '{NOW}' + to_minutes(CAST(CASE WHEN schedule_id % 3 = 1 THEN interval_minutes + 5 ELSE interval_minutes END AS INT)) END AS next_run_at FROM sched""")  # fmt: skip
def p22(spark: SparkSession, d: str) -> DataFrame:
    s = _schedules(spark, d)
    wanted = F.when(F.col("schedule_id") % 3 == 1, F.col("interval_minutes") + 5).otherwise(F.col("interval_minutes"))
    got = R.compute_next_run_at(F.col("active"), F.col("interval_minutes"), F.col("next_run_at"), F.col("schedule_id") % 6 != 0, wanted, ts(NOW))
    return s.select("schedule_id", got.alias("next_run_at"))


@query("j09_previous_completed", f"""WITH {_RUNS} SELECT website_id, id, lag(status) OVER w AS previous_status, last_value(CASE WHEN status = 'completed' THEN id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_completed_id FROM runs WINDOW w AS (PARTITION BY website_id ORDER BY started_at, id)""")
def j09(spark: SparkSession, d: str) -> DataFrame:
    return R.previous_completed(inputs.runs(spark, d)).drop("previous_completed_at")


_PUB = "tg AS (SELECT DISTINCT user_id AS website_id, user_id + 1000 AS target_id, user_id % 7 AS installation_id FROM events WHERE user_id % 3 <> 0), inst AS (SELECT DISTINCT user_id % 7 AS installation_id, 'acc' || (user_id % 7) AS account FROM events WHERE user_id % 7 <> 5), pub AS (SELECT id AS publication_id, id - id % 4 AS run_id, website_id + 1000 AS target_id, CASE id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'published' END AS status, started_at AS created_at FROM runs)"


def _targets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    u = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("u")).distinct()
    targets = u.where("u % 3 <> 0").select(F.col("u").alias("website_id"), (F.col("u") + 1000).alias("target_id"), (F.col("u") % 7).alias("installation_id"))
    inst = u.where("u % 7 <> 5").select((F.col("u") % 7).alias("installation_id"), F.concat(F.lit("acc"), F.col("u") % 7).alias("account")).distinct()
    pubs = inputs.runs(spark, d).select(F.col("id").alias("publication_id"), (F.col("id") - F.col("id") % 4).alias("run_id"), (F.col("website_id") + 1000).alias("target_id"), F.expr("CASE id % 3 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'published' END").alias("status"), F.col("started_at").alias("created_at"))
    return targets, inst, pubs


@query("j10_publish_target", f"WITH {_RUNS}, {_PUB} SELECT id AS run_id, target_id, installation_id, account FROM runs JOIN tg USING (website_id) JOIN inst USING (installation_id)")
def j10(spark: SparkSession, d: str) -> DataFrame:
    targets, inst, _ = _targets(spark, d)
    return R.publish_target_for_run(inputs.runs(spark, d), targets, inst)


@query("j11_publication_history", f"WITH {_RUNS}, {_PUB} SELECT runs.website_id, publication_id, row_number() OVER (PARTITION BY runs.website_id ORDER BY created_at DESC, publication_id DESC) AS rank FROM pub JOIN runs ON runs.id = pub.run_id QUALIFY rank <= 50")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return R.publication_history(_targets(spark, d)[2], inputs.runs(spark, d)).select("website_id", "publication_id", F.col("rank").cast("long").alias("rank"))


@query("j12_unsettled", f"WITH {_RUNS}, {_PUB} SELECT id AS run_id, target_id FROM runs JOIN tg USING (website_id) WHERE NOT EXISTS (SELECT 1 FROM pub WHERE pub.run_id = runs.id AND pub.target_id = tg.target_id AND pub.status <> 'failed')")
def j12(spark: SparkSession, d: str) -> DataFrame:
    targets, _, pubs = _targets(spark, d)
    pairs = inputs.runs(spark, d).join(targets, "website_id").select(F.col("id").alias("run_id"), "target_id")
    return R.unsettled(pairs, pubs)


@query("a13_active_manual", f"WITH {_RUNS}, {_SITES} SELECT user_id, count(*) AS active_manual FROM runs JOIN sites USING (website_id) WHERE status IN ('pending', 'processing') AND run_trigger = 'manual' GROUP BY 1")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return R.active_manual_per_user(inputs.runs(spark, d), _sites(spark, d))


@query("a14_rolling_usage", f"""WITH {_RUNS}, {_SITES}, u AS (SELECT user_id, id, epoch_us(started_at) AS us FROM runs JOIN sites USING (website_id)), w AS (SELECT *, count(*) OVER q AS used, min(us) OVER q AS oldest FROM u WINDOW q AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW))
SELECT user_id, id, used, make_timestamp(oldest + 86400000000) AS resets_at, used > 50 AS over FROM w""")  # fmt: skip
def a14(spark: SparkSession, d: str) -> DataFrame:
    return R.rolling_usage(inputs.runs(spark, d), _sites(spark, d))


@query("w12_history_page", f"WITH {_RUNS} SELECT id, website_id, started_at FROM runs WHERE status = 'completed' AND (started_at, id) < (TIMESTAMP '{END}', 5000) ORDER BY started_at DESC, id DESC LIMIT 101")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return R.history_page(inputs.runs(spark, d), ts(END), 5000, 100, "completed").select("id", "website_id", "started_at")


@query("x03_stuck_runs", f"""WITH {_RUNS} SELECT id, CASE WHEN attempts < 3 THEN 'requeue' ELSE 'fail' END AS action FROM runs WHERE (status = 'processing' AND started_at < TIMESTAMP '{START}' - INTERVAL 900 SECOND - INTERVAL 60 SECOND) OR (status = 'pending' AND started_at < TIMESTAMP '{START}' - INTERVAL 600 SECOND) ORDER BY started_at, id LIMIT 100""")
def x03(spark: SparkSession, d: str) -> DataFrame:
    runs = inputs.runs(spark, d).withColumn("claimed_at", F.timestamp_micros(F.unix_micros("started_at") + 60_000_000))
    return R.stuck_runs(runs, ts(START)).select("id", "action")


@query("s11_latest_wins_upsert", f"""WITH {_SCHED}, inc AS (SELECT schedule_id + 20 AS schedule_id, 99 AS interval_minutes, CAST(NULL AS TIMESTAMP) AS next_run_at FROM sched WHERE schedule_id % 2 = 0)
SELECT coalesce(s.schedule_id, i.schedule_id) AS schedule_id, s.website_id, s.active, CASE WHEN i.schedule_id IS NOT NULL THEN i.interval_minutes ELSE s.interval_minutes END AS interval_minutes, CASE WHEN i.schedule_id IS NOT NULL THEN i.next_run_at ELSE s.next_run_at END AS next_run_at FROM sched s FULL OUTER JOIN inc i ON i.schedule_id = s.schedule_id""")  # fmt: skip
def s11(spark: SparkSession, d: str) -> DataFrame:
    s = _schedules(spark, d)
    incoming = s.where("schedule_id % 2 = 0").select((F.col("schedule_id") + 20).alias("schedule_id"), F.lit(99).alias("interval_minutes"), F.lit(None).cast("timestamp").alias("next_run_at"))
    return R.latest_wins_upsert(s, incoming, ["schedule_id"], ["interval_minutes", "next_run_at"])


@query(
    "a19_reaper_summary",
    f"""WITH {_RUNS}, s AS (SELECT *, started_at < TIMESTAMP '{START}' - INTERVAL 960 SECOND AS claim_old, started_at < TIMESTAMP '{START}' - INTERVAL 600 SECOND AS old FROM runs),
t AS (SELECT * FROM s WHERE status = 'processing' AND claim_old OR status = 'pending' AND old ORDER BY started_at, id LIMIT 100)
SELECT count(*) AS examined, count(*) FILTER (status = 'processing' AND attempts < 3) AS requeued, count(*) FILTER (status = 'pending') AS orphans_swept,
  count(*) FILTER (status = 'processing' AND attempts >= 3) AS failed, count(*) FILTER ((attempts < 3 OR status = 'pending') AND id % 7 <> 0) AS enqueued,
  count(*) FILTER ((attempts < 3 OR status = 'pending') AND id % 7 = 0) AS already_queued, count(*) >= 100 AS limit_reached FROM t""",
)
def a19(spark: SparkSession, d: str) -> DataFrame:
    runs = inputs.runs(spark, d).withColumn("claimed_at", F.timestamp_micros(F.unix_micros("started_at") + 60_000_000))
    return R.reaper_summary(R.stuck_runs(runs, ts(START)).withColumn("queued", F.col("id") % 7 == 0))


@query(
    "a17_outcome_breakdown",
    f"""WITH {_RUNS} SELECT website_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
  count(*) FILTER (status IN ('pending', 'processing')) AS in_progress, count(*) AS total FROM runs GROUP BY 1""",
)
def a17(spark: SparkSession, d: str) -> DataFrame:
    done = lambda s: F.count_if(F.col("status") == s)
    return R.outcome_breakdown(inputs.runs(spark, d).groupBy("website_id").agg(F.count("*").alias("total_runs"), done("completed").alias("completed"), done("failed").alias("failed")))


@query(
    "a14_run_caps",
    f"""WITH {_RUNS}, {_SITES}, u AS (SELECT user_id, status IN ('pending', 'processing') AND run_trigger = 'manual' AS active,
  started_at > TIMESTAMP '{END}' - INTERVAL 24 HOUR AND started_at <= TIMESTAMP '{END}' AS recent, started_at FROM runs JOIN sites USING (website_id)),
g AS (SELECT user_id, count(*) FILTER (active) AS concurrent, count(*) FILTER (recent) AS used, min(started_at) FILTER (recent) AS oldest FROM u GROUP BY 1)
SELECT user_id, concurrent, used, CASE WHEN concurrent >= 2 THEN 'concurrent' WHEN used >= 5 THEN 'daily' END AS refused,
  CASE WHEN concurrent < 2 AND used >= 5 THEN oldest + INTERVAL 24 HOUR END AS resets_at FROM g""",
)
def a14_caps(spark: SparkSession, d: str) -> DataFrame:
    return R.run_caps(inputs.runs(spark, d), _sites(spark, d), ts(END), daily=5)


@query(
    "j14_artifact_with_origin",
    f"""WITH {_RUNS}, {_SITES}, a AS (SELECT id AS run_id, website_id, 'index ' || id AS llms_txt, CASE WHEN id % 4 <> 0 THEN 'full ' || id END AS llms_full_txt FROM runs),
o AS (SELECT DISTINCT website_id, 'https://site-' || website_id || '.example' AS origin FROM sites)
SELECT run_id, 'llms_txt' AS kind, llms_txt AS content, origin FROM a JOIN o USING (website_id)
UNION ALL SELECT run_id, 'llms_full_txt', llms_full_txt, origin FROM a JOIN o USING (website_id)""",
)
def j14(spark: SparkSession, d: str) -> DataFrame:
    runs = inputs.runs(spark, d).select("id", "website_id", F.concat(F.lit("index "), "id").alias("llms_txt"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("full "), "id")).alias("llms_full_txt"))
    sites = _sites(spark, d).withColumn("origin", F.concat(F.lit("https://site-"), "website_id", F.lit(".example")))
    kinds = [R.artifact_with_origin(runs, sites, k).select("run_id", F.lit(k).alias("kind"), "content", "origin") for k in ("llms_txt", "llms_full_txt")]
    return kinds[0].union(kinds[1])


# ---------------------------------------------------------------- sinks
@query("s06_payload_round_trip", "SELECT page_id, url, length(html) AS n, 200 + page_id % 2 AS status FROM pages")
def s06(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet")
    path = shared_folder(spark, "payload")
    tagged = p.select("page_id", "url", "html").select((F.col("page_id") % 5).cast("string").alias("website_id"), (F.col("page_id") % 3).cast("string").alias("run_id"), "url", (200 + F.col("page_id") % 2).cast("int").alias("status"), F.col("page_id").cast("string").alias("title"), F.lit(None).cast("string").alias("description"), F.col("html").alias("content"), F.lit("m").alias("markdown"), ts(NOW).alias("fetched_at"), F.length("html").cast("long").alias("bytes"))
    S.payload_sink(tagged, path)
    return S.payload_scan(spark, path).select(F.col("title").cast("long").alias("page_id"), "url", F.length("content").cast("long").alias("n"), F.col("status").cast("long").alias("status"))


def _stored_snapshots(spark: SparkSession, d: str, parts: int) -> str:
    """Snapshots of three runs, written as pages_sink lays them out."""
    path = shared_folder(spark, "pages")
    rows = inputs.snapshots(spark, d).withColumn("run_id", F.col("page_id") % 3)
    S.pages_sink(rows.select([F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(S.SNAPSHOT)]), path, parts)
    return path


@query(
    "s05_pages_scan",
    f"""WITH snap0 AS ({inputs.for_duckdb(inputs.SNAPSHOTS)}), sn AS (SELECT *, page_id % 3 AS run FROM snap0), r AS (SELECT site, run, max(content_bytes) AS most FROM sn GROUP BY 1, 2),
c AS (SELECT site, max(run) AS run FROM r WHERE most > 1500 GROUP BY site) SELECT run, url, status, title, length(markdown) AS n, content_bytes FROM sn JOIN c USING (site, run)""",
)
def s05(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each site's last run that fetched a page of over 1500 characters."""
    path = _stored_snapshots(spark, d, 8)
    runs = S.pages_scan(spark, path).groupBy("site", "run_id").agg(F.max("content_bytes").alias("most"))
    chosen = runs.where("most > 1500").groupBy("site").agg(F.max("run_id").alias("run_id"))
    got = S.pages_scan(spark, path, chosen, 8)
    return got.select(F.col("run_id").alias("run"), "url", F.col("status").cast("int").alias("status"), "title", F.length("markdown").cast("long").alias("n"), F.col("content_bytes").cast("long").alias("content_bytes"))


@query("s09_artifact_files", f"WITH {_CAND} SELECT DISTINCT trim(regexp_replace(site, '[^a-z0-9]+', '-', 'g'), '-') || '-llms.txt' AS filename, site AS text FROM cand")
def s09(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.candidates(spark, d).select("site").distinct().select(S.artifact_filename(F.concat(F.lit("https://"), F.col("site"))).alias("filename"), F.col("site").alias("text"))
    path = shared_folder(spark, "artifacts")
    S.artifact_sink(rows, path)
    return spark.read.option("wholetext", True).text(path).select("filename", F.regexp_replace("value", "\n$", "").alias("text"))


# ---------------------------------------------------------------- streams, run to their end over files
#: Parts of a table that arrive one after the other.
ARRIVALS = 4


def _arrival(order: str, lo: int, hi: int) -> F.Column:
    width = max(1, -(-(hi - lo + 1) // ARRIVALS))
    return F.floor((F.col(order) - lo) / width)


def _arriving(spark: SparkSession, df: DataFrame, order: str, catch_up: Callable[[DataFrame], None]) -> None:
    """df's rows arrive in a folder in parts by the order of a column; after each part the stream catches up.

    A part has as many files as it has partitions, and is one micro-batch; the query resumes from its checkpoint.
    """
    df = cut(df, "arriving")  # the parts are read one by one, and no two of them may see different rows
    path = shared_folder(spark, "stream")
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None:
        lo = hi = 0
    for k in range(ARRIVALS):
        df.where(_arrival(order, lo, hi) == k).write.mode("append").parquet(path)
        catch_up(spark.readStream.schema(df.schema).parquet(path))


def _to_end(spark: SparkSession, df: DataFrame, order: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over df's arriving parts has put out when it has caught up with the last one."""
    out, at, schemas = shared_folder(spark, "out"), shared_folder(spark, "at"), []

    def catch_up(stream: DataFrame) -> None:
        made = make(stream)
        schemas.append(made.schema)
        made.writeStream.format("parquet").option("checkpointLocation", at).trigger(availableNow=True).start(out).awaitTermination()

    _arriving(spark, df, order, catch_up)
    return spark.read.schema(schemas[-1]).parquet(out)


def _each_batch(spark: SparkSession, df: DataFrame, order: str, batch: Callable[[DataFrame, int], None]) -> None:
    """A stream over df's arriving parts that hands each of its micro-batches to a function."""
    at = shared_folder(spark, "at")
    _arriving(spark, df, order, lambda stream: stream.writeStream.foreachBatch(batch).option("checkpointLocation", at).trigger(availableNow=True).start().awaitTermination())


@query("x01_hourly_run_stats", f"""WITH {_RUNS}, h AS (SELECT website_id, date_trunc('hour', started_at) AS bucket_start, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1, 2)
SELECT * FROM h WHERE bucket_start + INTERVAL 1 HOUR <= (SELECT max(started_at) FROM runs) - INTERVAL 2 HOUR""")  # fmt: skip
def x01(spark: SparkSession, d: str) -> DataFrame:
    runs = inputs.runs(spark, d).select("id", "website_id", "started_at", "status")
    return _to_end(spark, runs, "id", ST.hourly_run_stats)


@query(
    "x01_filled_hours",
    f"""WITH {_RUNS}, {_SITES}, hr AS (SELECT website_id, unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{END}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS bucket_start FROM sites),
h AS (SELECT website_id, date_trunc('hour', started_at) AS bucket_start, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed FROM runs GROUP BY 1, 2)
SELECT website_id, bucket_start, coalesce(runs, 0) AS runs, coalesce(completed, 0) AS completed, coalesce(failed, 0) AS failed FROM hr LEFT JOIN h USING (website_id, bucket_start)""",
)
def x01b(spark: SparkSession, d: str) -> DataFrame:
    """Runs reach the stream up to six hours out of order; the window read is behind its watermark."""
    runs = inputs.runs(spark, d).select("website_id", "started_at", "status")
    made = _to_end(spark, _shuffled(runs, "started_at"), "arrival", lambda s: ST.hourly_run_stats(s, f"{DISORDER_S + 1} seconds"))
    return ST.filled_hours(_sites(spark, d), made, ts(START), ts(END))


@query("x05_url_dedup", f"WITH {_NORM} SELECT DISTINCT site, norm_url FROM k WHERE norm_url IS NOT NULL")
def x05(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.candidates(spark, d).select("site", "url", "page_id", F.timestamp_micros(F.unix_micros(ts(NOW)) + F.col("page_id") * 1000).alias("seen_at"))
    return _to_end(spark, rows, "page_id", lambda s: ST.url_dedup(s, delay="2 days")).select("site", "norm_url")


@query("x08_policy_filter", f"WITH {_NORM} SELECT DISTINCT site, norm_url FROM k WHERE norm_url IS NOT NULL AND NOT starts_with(path, '/fr/') AND NOT contains(norm_url, '?page=') AND (starts_with(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, '/en/2') AND NOT regexp_matches(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, '^/en/.*5$') OR NOT starts_with(path, '/en/') OR NOT regexp_matches(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, '5$'))")
def x08(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.candidates(spark, d).select("site", U.normalize_url("url").alias("norm_url"), "page_id").where("norm_url is not null").groupBy("site", "norm_url").agg(F.min("page_id").alias("page_id"))
    rules, _ = PO.robots_rules(_bodies(spark, d), "siteloom")
    return _to_end(spark, rows, "page_id", lambda s: ST.policy_filter(s, rules)).select("site", "norm_url")


@query("x09_idempotent_publish", f"WITH {_RUNS}, {_PUB} SELECT DISTINCT id AS run_id, target_id FROM runs JOIN tg USING (website_id)")
def x09(spark: SparkSession, d: str) -> DataFrame:
    """Every pair comes twice, in different batches, and each batch is run again after it has written."""
    targets, _, _ = _targets(spark, d)
    pairs = inputs.runs(spark, d).join(targets, "website_id").select(F.col("id").alias("run_id"), "target_id")
    twice = pairs.withColumn("o", F.lit(0)).union(pairs.withColumn("o", F.lit(1)))
    table = K.KeyedTable(spark, shared_folder(spark, "published"), "run_id long, target_id long, status string", ["run_id", "target_id"], 8)
    publish = K.idempotent_publish(table)

    def twice_over(rows: DataFrame, batch_id: int) -> None:
        publish(rows, batch_id)
        publish(rows, batch_id)

    _each_batch(spark, twice, "o", twice_over)
    return table.read().select("run_id", "target_id")


@query(
    "s11_upsert_in_stream",
    f"""WITH {_SCHED}, inc AS (SELECT user_id + 20 AS schedule_id, arg_max(CAST(round(value * 10) AS BIGINT), event_id) AS interval_minutes, arg_max(event_type <> 'error', event_id) AS active FROM events GROUP BY 1)
SELECT coalesce(s.schedule_id, i.schedule_id) AS schedule_id, s.website_id, CASE WHEN i.schedule_id IS NOT NULL THEN i.active ELSE s.active END AS active, CASE WHEN i.schedule_id IS NOT NULL THEN i.interval_minutes ELSE s.interval_minutes END AS interval_minutes, s.next_run_at FROM sched s FULL JOIN inc i ON i.schedule_id = s.schedule_id""",
)
def s11b(spark: SparkSession, d: str) -> DataFrame:
    """A change for every event, in the order of their ids; the table is there before the stream begins."""
    table = K.KeyedTable(spark, shared_folder(spark, "schedules"), "schedule_id long, website_id long, active boolean, interval_minutes long, next_run_at timestamp", ["schedule_id"], 8)
    table.merge(_schedules(spark, d), -1, lambda held, new: new)
    changes = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") + 20).alias("schedule_id"), "event_id", F.round(F.col("value") * 10).cast("long").alias("interval_minutes"), (F.col("event_type") != "error").alias("active"))
    _each_batch(spark, changes, "event_id", K.latest_wins(table, ["interval_minutes", "active"], "event_id"))
    return table.read()


_EVENT = "CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'claimed' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'returned' END"


#: Rows arrive up to six hours out of order, and their time order is told from what the watermark has passed.
DISORDER_S = 6 * 3600
_SETTLED = f"(SELECT (epoch_ms(max(ts)) - {DISORDER_S * 1000 + 1000}) * 1000 FROM events)"


def _shuffled(rows: DataFrame, time: str) -> DataFrame:
    """rows with `arrival`: their time in microseconds and a delay of up to DISORDER_S."""
    return rows.withColumn("arrival", F.unix_micros(time) + F.pmod(F.xxhash64(*rows.columns), F.lit(DISORDER_S * 1_000_000)))


def _by_time(spark: SparkSession, rows: DataFrame, time: str, make: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    with ET.ordered_state(spark):
        return _to_end(spark, _shuffled(rows, time), "arrival", lambda s: make(s, f"{DISORDER_S + 1} seconds"))


_LIFE = f"""e AS MATERIALIZED (
  SELECT user_id AS run_id, event_id, {_EVENT} AS event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) AS at_us FROM events),
t(before, event, after) AS (VALUES ('new', 'created', 'pending'), ('pending', 'claimed', 'processing'), ('processing', 'returned', 'pending'),
  ('processing', 'completed', 'completed'), ('processing', 'failed', 'failed'), ('pending', 'failed', 'failed')),
r AS (
  SELECT DISTINCT run_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS event, 'new' AS status, 0 AS attempts, false AS accepted, CAST(NULL AS BIGINT) AS at_us FROM e
  UNION ALL
  SELECT r.run_id, e.i, e.event_id, e.event, coalesce(t.after, r.status), r.attempts + CASE WHEN t.after IS NOT NULL AND e.event = 'claimed' THEN 1 ELSE 0 END, t.after IS NOT NULL, e.at_us
  FROM r JOIN e ON e.run_id = r.run_id AND e.i = r.i + 1 LEFT JOIN t ON t.before = r.status AND t.event = e.event)"""


@query("x02_run_lifecycle", f"WITH RECURSIVE {_LIFE} SELECT run_id, event_id, event, status, attempts, accepted FROM r WHERE i > 0 AND at_us <= {_SETTLED}")
def x02(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), F.expr(_EVENT).alias("event"))
    return _by_time(spark, e, "at", lambda s, delay: ET.run_lifecycle(s, delay, 400 * ET.DAY))


@query(
    "x03_stuck_in_stream",
    f"""WITH RECURSIVE {_LIFE}, c AS (SELECT *, lead(at_us) OVER (PARTITION BY run_id ORDER BY i) AS until FROM r WHERE accepted),
d AS (SELECT *, at_us + CASE status WHEN 'processing' THEN 900000001 WHEN 'pending' THEN 600000001 END AS due FROM c)
SELECT run_id, make_timestamp(due) AS at, status, attempts, CASE WHEN attempts < 3 THEN 'requeue' ELSE 'fail' END AS action FROM d WHERE due <= {_SETTLED} AND (until IS NULL OR until > due)""",
)
def x03b(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("run_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), F.expr(_EVENT).alias("event"))
    return _by_time(spark, e, "at", lambda s, delay: ET.stuck_in_stream(s, delay, 400 * ET.DAY))


@query("x07_page_changes", "SELECT url AS norm_url, event_id AS seen_id, hash, CASE WHEN before IS NULL THEN 'new' ELSE 'changed' END AS change FROM (SELECT 'u' || user_id AS url, event_id, event_type AS hash, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE before IS NULL OR before <> hash")
def x07(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select(F.concat(F.lit("u"), "user_id").alias("norm_url"), F.col("event_id").alias("seen_id"), F.col("event_type").alias("hash"))
    return _to_end(spark, e, "seen_id", lambda s: ST.page_changes(s, ttl=None))


@query(
    "x06_quota",
    f"""WITH RECURSIVE e AS MATERIALIZED (
  SELECT user_id, event_id AS id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS id, CAST([] AS BIGINT[]) AS held, false AS accepted FROM e
  UNION ALL
  SELECT r.user_id, e.i, e.id, CASE WHEN len(list_filter(r.held, lambda t: t > e.us - 86400000000)) < 2
    THEN list_append(list_filter(r.held, lambda t: t > e.us - 86400000000), e.us) ELSE list_filter(r.held, lambda t: t > e.us - 86400000000) END,
    len(list_filter(r.held, lambda t: t > e.us - 86400000000)) < 2
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, id, CAST(len(held) AS INTEGER) AS used, accepted FROM r WHERE i > 0 AND id IN (SELECT event_id FROM events WHERE epoch_us(ts) <= {_SETTLED})""",
)
def x06(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("started_at"))
    return _by_time(spark, e, "started_at", lambda s, delay: ET.quota(s, 2, delay))


@query("u01_union_candidates", f"WITH {_CAND}, x AS (SELECT site, url FROM cand WHERE page_id % 2 = 0 UNION ALL SELECT site, url FROM cand WHERE page_id % 3 = 0) SELECT site, count(*) AS n FROM x GROUP BY 1")
def u01(spark: SparkSession, d: str) -> DataFrame:
    c = inputs.candidates(spark, d).select("site", "url", "page_id")
    return S.union_candidates(c.where("page_id % 2 = 0"), c.where("page_id % 3 = 0")).groupBy("site").agg(F.count("*").alias("n"))


#: Summaries of the pages in the index: none is asked for where a page has no body, some answers are no JSON or have no text.
_ANSWERED = f"ans AS (SELECT e.site, snap.page_id, CASE WHEN trim(markdown) = '' OR page_id % 5 = 4 THEN NULL ELSE page_id % 5 IN (0, 3) END AS ok, length(markdown) // 4 AS asked, length({CQ._RESPONSE}) AS said FROM (SELECT DISTINCT site, url FROM ({CQ.ORACLES['w07_artifact_order']})) e JOIN (SELECT * FROM ({inputs.for_duckdb(inputs.SNAPSHOTS)})) snap USING (site, url))"
_TOTALS = f"""WITH {_ANSWERED} SELECT site, count(*) FILTER (ok) AS pages_enriched, count(*) FILTER (NOT ok) AS enrich_failures, CAST(coalesce(sum(asked) FILTER (ok IS NOT NULL), 0) AS BIGINT) AS enrich_input_tokens,
  CAST(coalesce(sum(said) FILTER (ok), 0) AS BIGINT) AS enrich_output_tokens, CASE WHEN count(*) FILTER (ok) = 0 AND count(*) FILTER (NOT ok) > 0 THEN 'no_summary' END AS enrich_unavailable_reason FROM ans GROUP BY site"""


def _enrichment(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """Totals of the index's summaries, as their answers are parsed."""
    rows = entries.select("site", "url").distinct().join(pages, ["site", "url"]).withColumn("response", F.when(F.trim("markdown") != "", F.expr(CQ._RESPONSE)))
    parsed = IX.parse_summaries(rows.select("site", F.col("page_id").alias("url"), "response")).select("site", F.col("url").alias("page_id"), F.col("title").alias("new_title"), F.col("description").alias("new_description"))
    ok = F.when(F.col("response").isNotNull(), F.col("new_title").isNotNull() | F.col("new_description").isNotNull())
    out = rows.join(parsed, ["site", "page_id"]).withColumn("summary_ok", ok)
    asked = F.when(ok.isNotNull(), F.floor(F.length("markdown") / 4))
    return R.enrichment_totals(out.select("site", "summary_ok", asked.alias("input_tokens"), F.length("response").alias("output_tokens"), F.when(~ok, "no_summary").alias("unavailable_reason")))


@query("a18_enrichment_totals", _TOTALS)
def a18(spark: SparkSession, d: str) -> DataFrame:
    pages = CQ._snap(spark, d)
    return _enrichment(pages, IX.ordered_entries(pages))


_FUNNEL = f"""SELECT site, CAST(sum(n) AS BIGINT) AS urls_discovered, CAST(coalesce(sum(n) FILTER (rule = 'selected'), 0) AS BIGINT) AS urls_selected, CAST(coalesce(sum(n) FILTER (rule = 'robots_disallowed'), 0) AS BIGINT) AS urls_robots_disallowed,
  CAST(coalesce(sum(n) FILTER (rule = 'duplicate'), 0) AS BIGINT) AS duplicate, CAST(coalesce(sum(n) FILTER (rule = 'over_limit'), 0) AS BIGINT) AS over_limit FROM ({CQ.ORACLES['a02_drop_funnel']}) GROUP BY site"""
_PARTS = f"""f AS ({_FUNNEL}), c AS ({CQ.ORACLES['a03_crawl_stats']}), i AS ({CQ.ORACLES['a05_index_counts']}), e AS ({_TOTALS}),
t AS (SELECT * FROM ({CQ.ORACLES['t08_build_index_diff']}) QUALIFY row_number() OVER (PARTITION BY site ORDER BY run_id DESC) = 1), hs AS (SELECT site, count(DISTINCT key) AS n FROM ({CQ.ORACLES['a12_content_hashes']}) GROUP BY site)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    """(site, stats): each site's record, out of the funnel, the pages' outcomes, the index, its summaries and its diff."""
    c, pages = inputs.candidates(spark, d), CQ._snap(spark, d)
    entries = cut(IX.ordered_entries(pages), "entries")
    frontier = R.dropped_by_rule(FR.drop_funnel(c, FR.select_urls(c, CQ.LIMIT))).select("*", F.lit("sitemap").alias("discovery_source"), F.when(F.length("site") % 2 == 0, CQ.LIMIT + 1).alias("max_pages"), F.lit(200).alias("crawl_delay_ms"))
    crawl = PG.crawl_stats(CQ._classified(spark, d)).select("*", F.lit(None).cast("long").alias("duration_ms"), F.lit(None).cast("string").alias("cap_hit"))
    none = F.lit(None).cast("long")
    index = IX.index_counts(entries).select("site", F.col("links_main").alias("links_emitted"), "links_optional", "links_duplicate", none.alias("full_txt_truncated"), none.alias("llms_txt_bytes"))
    enrichment = _enrichment(pages, entries).select("*", F.lit(True).alias("enrich_requested"), (F.col("pages_enriched") > 0).alias("enrich_applied"))
    runs, listed = inputs.history(spark, d)
    diffs = D.history_diffs(runs, listed.select("site", "run_id", U.normalize_url("url").alias("key"), "hash"))
    names = [n for n in diffs.columns if n not in ("site", "run_id")]
    last = diffs.groupBy("site").agg(F.max_by(F.struct(*names), "run_id").alias("index_diff"))
    hashes = D.content_hashes(pages.where("page_id % 29 <> 0"), keys=("site",), ordinal="page_id").groupBy("site").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "hash")))).alias("content_hashes"))
    return cut(R.run_stats_assemble(frontier, crawl, index, enrichment, last.join(hashes, "site", "full_outer")), "records")


@query(
    "a15_run_stats_assemble",
    f"""WITH {_PARTS} SELECT f.site, 32 AS n_keys, 13 AS version, f.urls_discovered, f.urls_selected, f.urls_robots_disallowed, f.duplicate, f.over_limit, coalesce(c.pages_crawled, 0) AS pages_crawled, coalesce(c.pages_failed, 0) AS pages_failed, coalesce(c.bytes_fetched, 0) AS bytes_fetched,
  coalesce(c.pages_blocked, 0) AS pages_blocked, c.blocked_reason, coalesce(i.links_main, 0) AS links_emitted, coalesce(i.links_optional, 0) AS links_optional, coalesce(e.pages_enriched, 0) AS pages_enriched, coalesce(e.enrich_input_tokens, 0) AS enrich_input_tokens, e.enrich_unavailable_reason,
  t.state AS diff_state, CAST(t.pages_added AS BIGINT) AS pages_added, CAST(t.content_changed AS BIGINT) AS content_changed, hs.n AS n_hashes
FROM f LEFT JOIN c ON c.site = f.site LEFT JOIN i ON i.site = f.site LEFT JOIN e ON e.site = f.site LEFT JOIN t ON t.site = f.site LEFT JOIN hs ON hs.site = f.site""",
)
def a15(spark: SparkSession, d: str) -> DataFrame:
    """The record of each site's run, read back out of its JSON text."""
    made = _records(spark, d)
    number = lambda k: R.json_number(F.col("stats"), f"$.{k}").cast("long")
    text = lambda k: F.get_json_object("stats", f"$.{k}")
    counts = ["urls_discovered", "urls_selected", "urls_robots_disallowed", "pages_crawled", "pages_failed", "bytes_fetched", "pages_blocked", "links_emitted", "links_optional", "pages_enriched", "enrich_input_tokens"]
    zero = lambda k: F.coalesce(number(k), F.lit(0).cast("long"))
    return made.select(
        "site", F.size(F.json_object_keys("stats")).alias("n_keys"), number("version").cast("int").alias("version"), *(number(k).alias(k) for k in counts), zero("dropped.duplicate").alias("duplicate"), zero("dropped.over_limit").alias("over_limit"),
        text("blocked_reason").alias("blocked_reason"), text("enrich_unavailable_reason").alias("enrich_unavailable_reason"), text("index_diff.state").alias("diff_state"), number("index_diff.pages_added").alias("pages_added"),
        number("index_diff.content_changed").alias("content_changed"), F.size(F.json_object_keys(text("content_hashes"))).cast("long").alias("n_hashes"),
    )


@query(
    "a16_provenance_funnel",
    f"""WITH f AS ({_FUNNEL}), c AS ({CQ.ORACLES['a03_crawl_stats']}), g AS (SELECT f.*, coalesce(pages_crawled, 0) AS crawled, coalesce(c.pages_failed, 0) AS failed, CASE WHEN length(f.site) % 2 = 0 THEN {CQ.LIMIT + 1} END AS most FROM f LEFT JOIN c ON c.site = f.site)
SELECT site, urls_discovered AS discovered, urls_selected AS selected, urls_discovered - urls_selected AS dropped, greatest(urls_selected + 1 - crawled - failed, 0) AS not_attempted, crawled AS pages_crawled, failed AS pages_failed,
  CASE WHEN urls_discovered = 0 THEN 'none' WHEN urls_selected = 0 THEN 'all_dropped' WHEN crawled = 0 THEN 'all_failed' ELSE 'ok' END AS state,
  CAST(CASE WHEN most >= 1 THEN most WHEN over_limit > 0 THEN urls_selected + 1 END AS BIGINT) AS max_pages, CAST(CASE WHEN most >= 1 THEN most - 1 WHEN over_limit > 0 THEN urls_selected END AS BIGINT) AS frontier_limit,
  CASE WHEN most >= 1 THEN 'recorded' WHEN over_limit > 0 THEN 'derived' END AS budget_source FROM g""",
)
def a16(spark: SparkSession, d: str) -> DataFrame:
    """The funnel out of the sites' records."""
    number = lambda k: R.json_number(F.col("stats"), f"$.{k}").cast("long")
    names = {"urls_discovered": "discovered", "urls_selected": "selected", "pages_crawled": "pages_crawled", "pages_failed": "pages_failed", "max_pages": "max_pages", "dropped.over_limit": "over_limit"}
    g = _records(spark, d).select("site", *(number(k).alias(n) for k, n in names.items()))
    return R.provenance_funnel(g).select("*", "budget.max_pages", "budget.frontier_limit", F.col("budget.source").alias("budget_source")).drop("budget")
