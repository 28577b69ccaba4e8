"""Run analytics: typed reads of JSON stats, hourly series, latest runs, lists, quotas, schedules and publications.

Runs have id, website_id, started_at, completed_at, status, run_trigger, attempts and stats (JSON text).
Unknown is null and zero is a measurement. Every operator takes `now` as a parameter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.ranks import carried, running
from siteloom.tables import cut

ACTIVE = ["pending", "processing"]
MAX_ATTEMPTS, STUCK_S, ORPHANED_S, REAP_LIMIT, DUE_LIMIT = 3, 900, 600, 100, 50
DAY_LIMIT, CONCURRENT_LIMIT = 50, 2
WORKER_KEYS = ["content_hashes"]
HOUR_US = 3_600_000_000


def json_number(stats: Column, path: str) -> Column:
    """A value of JSON text as double if its JSON type is number, else null; text is never coerced."""
    v = F.try_variant_get(F.try_parse_json(stats), path, "variant")
    kind = F.schema_of_variant(v)
    return F.when(kind.startswith("BIGINT") | kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT"), F.try_variant_get(v, "$", "double"))


def with_stats(runs: DataFrame) -> DataFrame:
    """Adds pages_crawled, index_pages, index_bytes, pages_added, pages_removed and duration_ms of each run."""
    done = F.col("status") == "completed"
    s = F.col("stats")
    return (
        runs.withColumn("pages_crawled", json_number(s, "$.pages_crawled"))
        .withColumn("index_pages", F.when(done, json_number(s, "$.links_emitted") + F.coalesce(json_number(s, "$.links_optional"), F.lit(0.0))).cast("long"))
        .withColumn("index_bytes", F.when(done, json_number(s, "$.llms_txt_bytes")).cast("long"))
        .withColumn("pages_added", F.when(done, json_number(s, "$.index_diff.pages_added")).cast("long"))
        .withColumn("pages_removed", F.when(done, json_number(s, "$.index_diff.pages_removed")).cast("long"))
        .withColumn("duration_ms", F.when(F.col("completed_at").isNotNull(), run_duration_ms(F.col("started_at"), F.col("completed_at"))))
    )


def run_duration_ms(started: Column, completed: Column) -> Column:
    return F.floor((F.unix_micros(completed) - F.unix_micros(started)) / 1000).cast("long")


def public_stats(stats: Column) -> Column:
    """The stats object without the keys that only workers need, as a map of JSON texts."""
    return F.map_filter(F.from_json(stats, "map<string,string>"), lambda k, _: ~k.isin(WORKER_KEYS))


def bucket_start(at: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(at) - F.pmod(F.unix_micros(at), F.lit(HOUR_US)))


def bucket_stats(runs: DataFrame, start: Column, end: Column) -> DataFrame:
    """Per website and hour of [start, end): counts, averages, changes and the last known index size."""
    done = F.col("status") == "completed"
    newest = F.struct("started_at", "id")
    scoped = with_stats(runs.where((F.col("started_at") >= start) & (F.col("started_at") < end)))
    return scoped.groupBy("website_id", bucket_start(F.col("started_at")).alias("bucket_start")).agg(
        F.count("*").alias("runs"),
        F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg(F.coalesce("pages_crawled", F.lit(0.0))).alias("avg_pages"),
        F.avg(F.when(done, (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1000)).alias("avg_duration_ms"),
        F.count("pages_added").alias("runs_compared"),
        F.sum("pages_added").alias("pages_added"),
        F.sum("pages_removed").alias("pages_removed"),
        F.max_by("index_pages", F.when(F.col("index_pages").isNotNull(), newest)).alias("index_pages"),
        F.max_by("index_bytes", F.when(F.col("index_bytes").isNotNull(), newest)).alias("index_bytes"),
    )


def bucket_fill(sites: DataFrame, stats: DataFrame, start: Column, end: Column) -> DataFrame:
    """Every website with every hour of the window; counts are zero and index sizes null where nothing ran."""
    series = sites.select("website_id", F.explode(F.sequence(start, end - F.expr("interval 1 hour"), F.expr("interval 1 hour"))).alias("bucket_start"))
    out = series.join(stats, ["website_id", "bucket_start"], "left")
    zero = ["runs", "completed", "failed", "avg_pages", "avg_duration_ms", "runs_compared", "pages_added", "pages_removed"]
    return out.select("website_id", "bucket_start", *[F.coalesce(c, F.lit(0)).alias(c) for c in zero], "index_pages", "index_bytes")


def window_totals(runs: DataFrame, start: Column, end: Column) -> DataFrame:
    scoped = with_stats(runs.where((F.col("started_at") >= start) & (F.col("started_at") < end)))
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("status") == "failed")
    return scoped.groupBy("website_id").agg(
        F.count("*").alias("total_runs"), done.alias("total_completed"), failed.alias("total_failed"),
        F.avg(F.coalesce("pages_crawled", F.lit(0.0))).alias("total_avg_pages"),
        F.when(done + failed > 0, done / (done + failed)).alias("success_rate"),
        F.max("started_at").alias("last_run_at"),
        F.count("pages_added").alias("total_runs_compared"),
    )


def resolve_window(now: str, name: str) -> tuple[str, str]:
    """Start and end of a window of 12, 24 or 72 whole hours whose last hour holds `now` (ISO text in UTC)."""
    from datetime import datetime, timedelta

    hours = {"12h": 12, "1d": 24, "3d": 72}[name]
    end = datetime.fromisoformat(now).replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
    return (end - timedelta(hours=hours)).isoformat(sep=" "), end.isoformat(sep=" ")


def latest_run(runs: DataFrame) -> DataFrame:
    """Each website's newest run by start, then id: one aggregate, no sort."""
    best = F.max(F.struct("started_at", "id", "status", "completed_at", "stats")).alias("r")
    return runs.groupBy("website_id").agg(best).select("website_id", "r.id", "r.started_at", "r.status", "r.completed_at", "r.stats")


def site_list(sites: DataFrame, runs: DataFrame, schedules: DataFrame) -> DataFrame:
    """Sites with their latest run and schedule, latest activity first."""
    last = latest_run(runs).select("website_id", F.col("id").alias("run_id"), "started_at", "status", F.floor(json_number(F.col("stats"), "$.pages_crawled")).cast("long").alias("pages_crawled"))
    out = sites.join(last, "website_id", "left").join(schedules.select("website_id", "active", "interval_minutes"), "website_id", "left")
    return out.withColumn("activity", F.coalesce("started_at", "created_at"))


def sites_with_active_runs(sites: DataFrame, runs: DataFrame) -> DataFrame:
    return sites.join(runs.where(F.col("status").isin(ACTIVE)), "website_id", "left_semi")


def due_schedules(schedules: DataFrame, now: Column, limit: int = DUE_LIMIT) -> DataFrame:
    return schedules.where(F.col("active") & (F.col("next_run_at") <= now)).orderBy("next_run_at", "schedule_id").limit(limit)


def due_split(due: DataFrame, runs: DataFrame) -> DataFrame:
    """Due schedules with `ran`: those whose website has an active run are skipped."""
    busy = runs.where(F.col("status").isin(ACTIVE)).select("website_id").distinct()
    ran = due.join(busy, "website_id", "left_anti").withColumn("ran", F.lit(True))
    return ran.unionByName(due.join(busy, "website_id", "left_semi").withColumn("ran", F.lit(False)))


def reaper_summary(stuck: DataFrame, limit: int = REAP_LIMIT) -> DataFrame:
    """One row of counts over stuck_runs: requeued claims, swept orphans, failures, and whether the batch was full.

    A run goes back to the queue only if its job is not there already (`queued`, null for no).
    """
    again = (F.col("action") == "requeue") | (F.col("status") == "pending")
    held = F.coalesce("queued", F.lit(False)) if "queued" in stuck.columns else F.lit(False)
    return stuck.agg(
        F.count("*").alias("examined"),
        F.count_if((F.col("status") == "processing") & (F.col("action") == "requeue")).alias("requeued"),
        F.count_if(F.col("status") == "pending").alias("orphans_swept"),
        F.count_if((F.col("status") == "processing") & (F.col("action") == "fail")).alias("failed"),
        F.count_if(again & ~held).alias("enqueued"),
        F.count_if(again & held).alias("already_queued"),
        (F.count("*") >= limit).alias("limit_reached"),
    )


def artifact_with_origin(runs: DataFrame, sites: DataFrame, artifact: str) -> DataFrame:
    """(run_id, content, origin) of one artifact column of runs, with the origin of the run's website."""
    return runs.join(sites.select("website_id", "origin"), "website_id").select(F.col("id").alias("run_id"), F.col(artifact).alias("content"), "origin")


def outcome_breakdown(totals: DataFrame) -> DataFrame:
    """Window totals as the parts of an outcome bar; what has not ended yet is the remainder, never below zero."""
    running = F.greatest(F.col("total_runs") - F.col("completed") - F.col("failed"), F.lit(0))
    return totals.select("website_id", "completed", "failed", running.alias("in_progress"), F.col("total_runs").alias("total"))


def trend_points(buckets: DataFrame) -> DataFrame:
    """Buckets as chart points: the index in KB (a gap stays null), and removals below the axis."""
    return buckets.select(
        "website_id", "bucket_start", "runs", "runs_compared", (F.col("index_bytes") / 1024).alias("index_kb"), "index_pages",
        F.col("pages_added").alias("added"), F.col("pages_removed").alias("removed"), (-F.col("pages_removed")).alias("removed_negative"),
    )


def run_caps(runs: DataFrame, sites: DataFrame, now: Column, daily: int = DAY_LIMIT, concurrent: int = CONCURRENT_LIMIT) -> DataFrame:
    """Per user with runs: active manual runs, runs in the 24 hours before now, and the limit that refuses another.

    The concurrent limit is judged first; resets_at is the earliest time at which the daily one can let a run in.
    """
    rows = runs.join(sites.select("website_id", "user_id"), "website_id")
    active = F.col("status").isin(ACTIVE) & (F.col("run_trigger") == "manual")
    recent = (F.unix_micros("started_at") > F.unix_micros(now) - 24 * HOUR_US) & (F.col("started_at") <= now)
    out = rows.groupBy("user_id").agg(F.count_if(active).alias("concurrent"), F.count_if(recent).alias("used"), F.min(F.when(recent, F.unix_micros("started_at"))).alias("oldest"))
    reason = F.when(F.col("concurrent") >= concurrent, "concurrent").when(F.col("used") >= daily, "daily")
    resets = F.when(reason == "daily", F.timestamp_micros(F.col("oldest") + 24 * HOUR_US))
    return out.select("user_id", "concurrent", "used", reason.alias("refused"), resets.alias("resets_at"))


def tick_summary(split: DataFrame) -> DataFrame:
    return split.agg(F.count("*").alias("due"), F.count_if("ran").alias("started"), F.count_if(~F.col("ran")).alias("skipped"))


def previous_completed(runs: DataFrame) -> DataFrame:
    """Each run with the status of the run before it and the latest earlier completed run of its website.

    What a website's runs carry forward passes between parts of its history, so that a long one stays spread.
    """
    done = F.when(F.col("status") == "completed", F.struct("id", "completed_at"))
    out = carried(runs.select("website_id", "id", "started_at", "completed_at", "status"), "history", ["website_id"], ["started_at", "id"], {"s": F.struct("status"), "p": done})
    return out.select("website_id", "id", F.col("s.status").alias("previous_status"), F.col("p.id").alias("previous_completed_id"), F.col("p.completed_at").alias("previous_completed_at"))


def publish_target_for_run(runs: DataFrame, targets: DataFrame, installations: DataFrame) -> DataFrame:
    return runs.join(targets, "website_id").join(installations, "installation_id").select(F.col("id").alias("run_id"), "target_id", "installation_id", "account")


def publication_history(publications: DataFrame, runs: DataFrame, limit: int = 50) -> DataFrame:
    rows = publications.join(runs.select(F.col("id").alias("run_id"), "website_id"), "run_id")
    order = Window.partitionBy("website_id").orderBy(F.desc("created_at"), F.desc("publication_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def unsettled(pairs: DataFrame, publications: DataFrame) -> DataFrame:
    """Pairs (run_id, target_id) without a publication that isn't failed."""
    return pairs.join(publications.where("status <> 'failed'"), ["run_id", "target_id"], "left_anti")


def active_manual_per_user(runs: DataFrame, sites: DataFrame) -> DataFrame:
    rows = runs.where(F.col("status").isin(ACTIVE) & (F.col("run_trigger") == "manual")).join(sites.select("website_id", "user_id"), "website_id")
    return rows.groupBy("user_id").agg(F.count("*").alias("active_manual"))


def rolling_usage(runs: DataFrame, sites: DataFrame) -> DataFrame:
    """Per run: how many of the user's runs lie in the 24 hours up to it, when the oldest of them leaves, and whether it is over a limit.

    A start counts from its time on and no more a day later, so the number in force is a running sum over both
    kinds of times, and the oldest start in force is found by its place in the user's order. A user's runs never
    meet in one task.
    """
    day = 24 * HOUR_US
    rows = runs.join(sites.select("website_id", "user_id"), "website_id").select("user_id", "id", F.unix_micros("started_at").alias("us"))
    times = rows.groupBy("user_id", "us").agg(F.count("*").alias("n"))
    marks = times.select("user_id", F.col("us").alias("at"), F.col("n").alias("begun"), F.col("n").alias("change")).union(times.select("user_id", F.col("us") + day, F.lit(0).cast("long"), -F.col("n")))
    marks = marks.groupBy("user_id", "at").agg(F.sum("begun").alias("begun"), F.sum("change").alias("change"))
    sums = running(marks, "usage", ["user_id"], ["at"], {"begun_before": F.col("begun"), "held_before": F.col("change")}).where("begun > 0")
    used = F.col("held_before") + F.col("change")
    sums = cut(sums.select("user_id", "at", used.alias("used"), (F.col("begun_before") + 1).alias("first"), (F.col("begun_before") + F.col("begun") - used + 1).alias("oldest")), "usage-sums")
    starts = sums.select("user_id", F.col("first").alias("oldest"), F.col("at").alias("oldest_us"))
    out = rows.join(sums.join(starts, ["user_id", "oldest"]).withColumnRenamed("at", "us"), ["user_id", "us"])
    return out.select("user_id", "id", "used", F.timestamp_micros(F.col("oldest_us") + day).alias("resets_at"), (F.col("used") > DAY_LIMIT).alias("over"))


def history_page(runs: DataFrame, cursor_at: Column, cursor_id: int, limit: int, status: str | None = None) -> DataFrame:
    """Per call one page of runs older than the cursor, newest first, with one row more than the limit."""
    older = (F.col("started_at") < cursor_at) | ((F.col("started_at") == cursor_at) & (F.col("id") < cursor_id))
    rows = runs.where(older) if status is None else runs.where(older & (F.col("status") == status))
    return rows.orderBy(F.desc("started_at"), F.desc("id")).limit(limit + 1)


def latest_completed_in_window(runs: DataFrame, start: Column, end: Column) -> DataFrame:
    rows = runs.where((F.col("status") == "completed") & (F.col("started_at") >= start) & (F.col("started_at") < end))
    return latest_run(rows).select("website_id", "id", "started_at")


def stuck_runs(runs: DataFrame, now: Column, limit: int = REAP_LIMIT) -> DataFrame:
    """Runs that stand still, oldest first, with what becomes of them: requeued below three attempts, else failed."""
    age = (F.unix_micros(now) - F.unix_micros(F.coalesce("claimed_at", "started_at"))) / 1e6
    stuck = ((F.col("status") == "processing") & (age > STUCK_S)) | ((F.col("status") == "pending") & ((F.unix_micros(now) - F.unix_micros("started_at")) / 1e6 > ORPHANED_S))
    rows = runs.where(stuck).orderBy("started_at", "id").limit(limit)
    return rows.withColumn("action", F.when(F.col("attempts") < MAX_ATTEMPTS, "requeue").otherwise("fail"))


def compute_next_run_at(cur_active: Column, cur_interval: Column, cur_next: Column, new_active: Column, new_interval: Column, now: Column) -> Column:
    """When a schedule next runs after a change: unchanged active schedules keep their time."""
    fresh = F.timestamp_micros(F.unix_micros(now) + new_interval.cast("long") * 60_000_000)
    keeps = F.coalesce(cur_active, F.lit(False)) & (cur_interval == new_interval) & cur_next.isNotNull()
    return F.when(new_active, F.when(keeps, cur_next).otherwise(fresh))


def advance_next_run_at(now: Column, interval: Column, key: Column, fraction: float = 0.05) -> Column:
    """now + interval with up to 5 % jitter either way, drawn from a hash so that a job can be run again."""
    unit = F.pmod(F.xxhash64(key, now), F.lit(1_000_001)) / 500_000 - 1
    us = interval.cast("long") * 60_000_000
    return F.timestamp_micros(F.unix_micros(now) + us + (us * fraction * unit).cast("long"))


def row_status(status: Column, active: Column) -> Column:
    return F.when(status.isNull(), F.when(active, "scheduled").otherwise("never_run")).when(status.isin(ACTIVE), "running").otherwise(status)


def schedule_label(active: Column, minutes: Column) -> Column:
    return F.when(~F.coalesce(active, F.lit(False)), "Off").when(minutes == 60, "Hourly").when(minutes == 360, "Every 6 hours").when(minutes == 1440, "Daily").when(minutes == 10080, "Weekly").otherwise(F.concat(F.lit("Every "), minutes.cast("string"), F.lit(" min")))


def sort_sites(rows: DataFrame, by: str, descending: bool) -> DataFrame:
    """Ordered by site, last run (never-run sites last either way) or severity of status; the site breaks ties."""
    severity = F.array_position(F.array(*map(F.lit, ["failed", "running", "never_run", "scheduled", "completed"])), F.col("row_status"))
    key = {"site": F.col("website_id"), "last_run": F.col("started_at"), "status": severity}[by]
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "website_id")


def latest_wins_upsert(table: DataFrame, incoming: DataFrame, key: list[str], updates: list[str]) -> DataFrame:
    """table with incoming's rows: a present row's `updates` take the incoming values, nulls too; others stay."""
    new = incoming.select(*key, F.lit(True).alias("_in"), *[F.col(c).alias(f"_new_{c}") for c in incoming.columns if c not in key])
    out = table.withColumn("_old", F.lit(True)).join(new, key, "full_outer")
    columns = []
    for c in table.columns:
        fresh = F.col(f"_new_{c}") if c in incoming.columns and c not in key else F.lit(None)
        columns.append(F.col(c) if c in key else F.when(F.col("_in").isNotNull() & (F.col("_old").isNull() | F.lit(c in updates)), fresh).otherwise(F.col(c)).alias(c))
    return out.select(columns)


def enrichment_totals(pages: DataFrame) -> DataFrame:
    """Per site of pages(site, summary_ok, tokens, unavailable_reason): totals, and why summaries could not be had.

    A page without a request (summary_ok null) is no failure. The reason is there only if nothing was summarised.
    """
    ok = F.col("summary_ok")
    reason = F.min("unavailable_reason") if "unavailable_reason" in pages.columns else F.lit(None).cast("string")
    out = pages.groupBy("site").agg(
        F.count_if(ok).alias("pages_enriched"),
        F.count_if(~ok).alias("enrich_failures"),
        F.coalesce(F.sum("input_tokens"), F.lit(0)).alias("enrich_input_tokens"),
        F.coalesce(F.sum(F.when(ok, F.col("output_tokens"))), F.lit(0)).alias("enrich_output_tokens"),
        reason.alias("reason"),
    )
    return out.withColumn("enrich_unavailable_reason", F.when(F.col("pages_enriched") == 0, F.col("reason"))).drop("reason")


def page_budget(max_pages: Column, selected: Column, over_limit: Column) -> Column:
    """struct(max_pages, frontier_limit, source): a run's recorded page limit, else the one its full frontier tells."""
    known = F.struct(max_pages.cast("long").alias("max_pages"), (max_pages - 1).cast("long").alias("frontier_limit"), F.lit("recorded").alias("source"))
    told = F.struct((selected + 1).cast("long").alias("max_pages"), selected.cast("long").alias("frontier_limit"), F.lit("derived").alias("source"))
    return F.when(max_pages >= 1, known).when(selected.isNotNull() & (over_limit > 0), told)


def provenance_funnel(stats: DataFrame) -> DataFrame:
    """Where a site's URLs went: discovered, selected, not attempted, fetched, failed, indexed and their remainder.

    The page budget comes from max_pages, else from the over_limit rule; without either it is null.
    """
    attempted = F.col("pages_crawled") + F.col("pages_failed")
    optional = lambda c: F.col(c) if c in stats.columns else F.lit(None).cast("long")
    return stats.select(
        "site", "discovered", "selected", (F.col("discovered") - F.col("selected")).alias("dropped"),
        F.greatest(F.col("selected") + 1 - attempted, F.lit(0)).alias("not_attempted"), "pages_crawled", "pages_failed",
        F.when(F.col("discovered") == 0, "none").when(F.col("selected") == 0, "all_dropped").when(F.col("pages_crawled") == 0, "all_failed").otherwise("ok").alias("state"),
        page_budget(optional("max_pages"), F.col("selected"), optional("over_limit")).alias("budget"),
    )


#: The version and the keys of a run's record, in their order.
RUN_STATS_VERSION = 13
CRAWL_KEYS = ["pages_crawled", "pages_failed", "bytes_fetched", "duration_ms", "cap_hit", "pages_empty_content", "pages_blocked", "pages_http_error", "pages_off_origin", "blocked_reason"]
INDEX_KEYS = ["links_emitted", "links_optional", "links_duplicate", "full_txt_truncated", "llms_txt_bytes"]
FRONTIER_KEYS = ["discovery_source", "urls_discovered", "urls_selected", "urls_robots_disallowed", "dropped", "max_pages", "crawl_delay_ms"]
ENRICH_KEYS = ["pages_enriched", "enrich_failures", "enrich_input_tokens", "enrich_output_tokens", "enrich_requested", "enrich_applied", "enrich_unavailable_reason"]
DIFF_KEYS = ["index_diff", "content_hashes"]
#: What is a count: zero where its part has no row.
COUNTED = {"pages_crawled", "pages_failed", "bytes_fetched", "pages_empty_content", "pages_blocked", "pages_http_error", "pages_off_origin", *INDEX_KEYS, "urls_discovered", "urls_selected", "urls_robots_disallowed", "pages_enriched", "enrich_failures", "enrich_input_tokens", "enrich_output_tokens"}


def run_stats_assemble(frontier: DataFrame, crawl: DataFrame, index: DataFrame, enrichment: DataFrame, diff: DataFrame) -> DataFrame:
    """(site, stats): a run's record of 32 keys as JSON text, joined by site from its parts.

    Each part has `site` and the keys that bear its name above. A site that a part lacks counts zero there;
    anything else unknown is null, and stays in the record as null.
    """
    out = frontier.select("site", *FRONTIER_KEYS)
    for part, keys in ((crawl, CRAWL_KEYS), (index, INDEX_KEYS), (enrichment, ENRICH_KEYS), (diff, DIFF_KEYS)):
        out = out.join(part.select("site", *keys), "site", "left")
    every = [*CRAWL_KEYS, *INDEX_KEYS, *FRONTIER_KEYS, *ENRICH_KEYS, *DIFF_KEYS]
    fields = [(F.coalesce(F.col(k), F.lit(0)) if k in COUNTED else F.col(k)).alias(k) for k in every]
    return out.select("site", F.to_json(F.struct(F.lit(RUN_STATS_VERSION).alias("version"), *fields), {"ignoreNullFields": "false"}).alias("stats"))


def dropped_by_rule(funnel: DataFrame) -> DataFrame:
    """(site, urls_discovered, urls_selected, urls_robots_disallowed, dropped) of a drop funnel; dropped maps rules to counts."""
    n = lambda rule: F.coalesce(F.sum(F.when(F.col("rule") == rule, F.col("n"))), F.lit(0))
    rules = F.collect_list(F.when(F.col("rule") != "selected", F.struct("rule", "n")))
    return funnel.groupBy("site").agg(F.sum("n").alias("urls_discovered"), n("selected").alias("urls_selected"), n("robots_disallowed").alias("urls_robots_disallowed"), F.map_from_entries(F.sort_array(rules)).alias("dropped"))
