"""Inputs of the site-index operators, derived from the given tables by plain SQL that DuckDB reads alike.

`{pages}` and `{events}` stand for the tables. Only the derivation is shared with the oracles; what the
operators do with it is written twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = """
SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site,
  'https://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' AS seed,
  CASE WHEN page_id % 4 <> 0 THEN CAST(DATE '2024-01-01' + CAST(page_id % 30 AS INT) AS TIMESTAMP) END AS lastmod,
  CASE WHEN page_id % 3 <> 0 THEN CAST(page_id % 11 AS DOUBLE) / 10 END AS priority
FROM {pages}
"""


def _row(url: str, where: str) -> str:
    return f"SELECT page_id, site, seed, {url} AS url, lastmod, priority FROM b WHERE {where}"


_ID = "CAST(page_id AS VARCHAR(20))"
#: Every page, and variants that meet each rule: duplicates, tracking, archives, other hosts, locale copies, junk.
CANDIDATES = f"WITH b AS ({_BASE}) " + " UNION ALL ".join(
    [
        _row("url", "true"),
        _row("url || '/'", "page_id % 5 = 0"),
        _row(f"seed || 'en/' || {_ID} || '?utm_source=x&b=2&a=1'", "page_id % 4 = 1"),
        _row(f"seed || 'en/' || {_ID} || '/?a=1&b=2&ref=z'", "page_id % 4 = 1"),
        _row(f"seed || 'tag/t' || {_ID}", "page_id % 6 = 1"),
        _row(f"seed || 'blog/2023/p' || {_ID}", "page_id % 6 = 2"),
        _row("seed || 'Changelog'", "page_id % 6 = 3"),
        _row("seed || 'news/feed'", "page_id % 6 = 4"),
        _row(f"seed || 'docs/guide-' || {_ID}", "page_id % 6 = 5"),
        _row(f"seed || 'fr/docs/guide-' || {_ID}", "page_id % 6 = 5"),
        _row(f"seed || 'de/fr/docs/guide-' || {_ID}", "page_id % 12 = 5"),
        _row(f"seed || 'list/page/' || {_ID}", "page_id % 9 = 1"),
        _row("seed", "page_id % 8 = 0"),
        _row("'::nope'", "page_id % 25 = 0"),
        _row(f"'https://other.example.net/x' || {_ID}", "page_id % 13 = 0"),
    ]
)

#: Snapshots of the pages: status, title, body, and what the crawler saw.
SNAPSHOTS = f"""
WITH b AS ({_BASE})
SELECT page_id, site, 'https://' || site AS origin, 'https://' || site || '/' || CASE WHEN page_id % 29 = 0 THEN '' WHEN page_id % 7 = 1 THEN 'docs/' WHEN page_id % 7 = 2 THEN 'blog/' WHEN page_id % 7 = 3 THEN 'case-study/'
    WHEN page_id % 7 = 4 THEN 'privacy/' WHEN page_id % 7 = 5 THEN 'widgets/2021/' ELSE 'en/' END || CASE WHEN page_id % 29 = 0 THEN '' ELSE 'api-page_' || {_ID} END AS url,
  CASE WHEN page_id % 37 = 0 THEN 404 WHEN page_id % 41 = 0 THEN 403 ELSE 200 END AS status,
  CASE WHEN page_id % 10 = 0 THEN NULL ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS title,
  CASE WHEN page_id % 6 = 0 THEN 'A site about shared things. More here.' WHEN page_id % 6 = 1 THEN 'Cut off text…' WHEN page_id % 6 = 2 THEN NULL
    ELSE 'Page ' || {_ID} || ' says one thing. And another.' END AS description,
  CASE WHEN page_id % 19 = 0 THEN '' ELSE regexp_replace(html, '<[^>]*>', ' ', 'g') END AS markdown, lastmod, priority, page_id % 5 = 0 AS linked_from_seed, length(html) AS content_bytes
FROM b
"""

#: Five runs of every site, and what each lists of its pages: titles, sections and bodies move between runs.
HISTORY = f"""
WITH b AS ({_BASE}), k AS (SELECT unnest_or_explode AS run_id FROM five)
SELECT site, run_id, 'https://' || site || '/p/' || {_ID} AS url, CASE WHEN page_id % 4 = 0 AND run_id > 2 THEN 'Guides' WHEN page_id % 7 = 0 THEN 'Optional' ELSE 'Docs' END AS section,
  coalesce(regexp_extract(html, '<title>([^<]*)', 1), '') || ' [' || {_ID} || CASE WHEN page_id % 3 = run_id % 3 THEN '] v' || CAST(run_id AS VARCHAR(20)) ELSE ']' END AS title,
  CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 11 = 0 THEN 'Text of run ' || CAST(run_id AS VARCHAR(20)) || ': (see) [there]' ELSE 'Page ' || {_ID} || ' says one thing.' END AS description,
  CASE WHEN page_id % 4 = run_id % 4 THEN CAST(length(html) AS VARCHAR(20)) || '-' || CAST(run_id AS VARCHAR(20)) ELSE CAST(length(html) AS VARCHAR(20)) END AS hash
FROM b, k WHERE page_id % (run_id + 2) <> 0 AND run_id <> 3
""".replace("unnest_or_explode AS run_id FROM five", "run_id FROM (VALUES (1), (2), (3), (4), (5)) f(run_id)")
#: The runs themselves: some fail, some complete without an index, some did not record what later ones compare.
HISTORY_RUNS = f"""
WITH b AS ({_BASE}), k AS (SELECT run_id FROM (VALUES (1), (2), (3), (4), (5)) f(run_id))
SELECT site, run_id, 1700000000 + 3600 * CASE run_id WHEN 4 THEN 6 ELSE run_id END AS at_s,
  CASE WHEN run_id = 3 OR (run_id = 1 AND length(site) % 5 = 0) OR (run_id = 4 AND length(site) % 3 = 0) THEN 'failed' ELSE 'completed' END AS status, NOT (run_id = 2 AND length(site) % 4 = 1) AS has_index,
  CASE WHEN run_id = 1 AND length(site) % 7 = 0 THEN NULL ELSE run_id >= 4 AND length(site) % 2 = 0 END AS enrich_applied, CASE WHEN run_id = 2 AND length(site) % 6 = 0 THEN NULL ELSE count(*) + run_id * run_id END AS urls_discovered, NOT (run_id = 1 AND length(site) % 3 = 1) AS hashed
FROM b, k GROUP BY site, run_id
"""

#: Runs: an event each. Stats are JSON text with numbers, and in some rows nulls, text or junk where numbers belong.
RUNS = """
SELECT event_id AS id, user_id AS website_id, ts AS started_at,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'click' THEN 'processing' ELSE 'pending' END AS status,
  CASE WHEN event_type IN ('purchase', 'view', 'error') THEN CAST(floor(value * 1000) AS BIGINT) END AS took_ms,
  CASE WHEN event_id % 4 = 0 THEN 'manual' ELSE 'scheduled' END AS run_trigger, event_id % 3 + 1 AS attempts, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '[1]' WHEN event_id % 31 = 0 THEN '{{bad' ELSE
    '{{"pages_crawled": ' || CASE WHEN event_id % 17 = 0 THEN '"7"' ELSE regexp_extract(props, '([0-9]+)', 1) END
    || ', "links_emitted": ' || CASE WHEN event_id % 13 = 0 THEN 'null' ELSE CAST(event_id % 31 AS VARCHAR(20)) END
    || CASE WHEN event_id % 2 = 0 THEN ', "links_optional": ' || CAST(event_id % 5 AS VARCHAR(20)) ELSE '' END
    || ', "llms_txt_bytes": ' || CAST(event_id * 7 % 5000 AS VARCHAR(20))
    || ', "content_hashes": {{"a": "b"}}, "index_diff": {{"state": "compared", "pages_added": ' || CAST(event_id % 3 AS VARCHAR(20)) || ', "pages_removed": ' || CASE WHEN event_id % 11 = 0 THEN 'true' ELSE CAST(event_id % 2 AS VARCHAR(20)) END || '}}}}' END AS stats
FROM {events}
"""


def for_duckdb(sql: str) -> str:
    return sql.format(pages="pages", events="events")


def for_spark(sql: str) -> str:
    """Spark replaces all matches without a flag, and doesn't know the flag."""
    return sql.replace(", ' ', 'g')", ", ' ')")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(for_spark(CANDIDATES), pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(for_spark(SNAPSHOTS), pages=spark.read.parquet(f"{sf_dir}/pages.parquet"))


def history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(site, run_id, started_at, status, llms_txt, ...) of runs whose artifacts are written here, and the entries in them."""
    from pyspark.sql import functions as F

    from siteloom.operators.index import bullet

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = spark.sql(HISTORY, pages=pages)
    lines = rows.groupBy("site", "run_id", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("url", "title", "description"))), lambda e: bullet(e["title"], e["url"], e["description"])), "\n").alias("lines"))
    whole = lines.groupBy("site", "run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "lines"))), lambda x: F.concat(F.lit("## "), x["section"], F.lit("\n\n"), x["lines"], F.lit("\n"))), "\n").alias("text"))
    made = spark.sql(HISTORY_RUNS, pages=pages).join(whole, ["site", "run_id"], "left")
    text = F.when((F.col("status") == "completed") & F.col("has_index"), F.concat(F.lit("# "), F.col("site"), F.lit("\n\n> An index.\n\n"), F.coalesce("text", F.lit(""))))
    return made.select("site", "run_id", F.timestamp_seconds("at_s").alias("started_at"), "status", text.alias("llms_txt"), "urls_discovered", "enrich_applied", "hashed"), rows


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, website_id, started_at, completed_at, status, stats and what decides on them."""
    from pyspark.sql import functions as F

    got = spark.sql(RUNS, events=spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("started_at", F.col("started_at").cast("timestamp"))
    return got.withColumn("completed_at", F.timestamp_micros(F.unix_micros("started_at") + F.col("took_ms") * 1000))


RUNS_DUCKDB = f"SELECT *, started_at + to_microseconds(took_ms * 1000) AS completed_at FROM ({for_duckdb(RUNS)})"
