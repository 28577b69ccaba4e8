"""Sources and sinks: sitemaps, robots targets, page snapshots, payload archives and artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.operators.pages import resolve
from siteloom.operators.policy import robots_lines

URLSET = "url array<struct<loc:string,lastmod:string,priority:string>>"
INDEX = "sitemap array<struct<loc:string>>"
PAYLOAD = "url string, status int, title string, description string, content string, markdown string, fetched_at timestamp, bytes long"
MAX_DOCUMENTS, MAX_URLS = 5, 50_000
#: Parts of the sites by hash in a folder of snapshots.
SITE_PARTS = 32
SNAPSHOT = "site string, run_id long, url string, status int, title string, description string, content string, markdown string, fetched_at timestamp, content_bytes long, is_empty boolean, blocked_reason string"


def plain_xml(body: Column) -> Column:
    """A body without namespaces and prefixes; null if it has a DOCTYPE."""
    text = F.regexp_replace(F.regexp_replace(body, r"\sxmlns(:\w+)?\s*=\s*(\"[^\"]*\"|'[^']*')", ""), r"<(/?)[\w.-]+:([\w.-]+)", "<$1$2")
    return F.when(~body.rlike(r"(?i)<!DOCTYPE"), F.regexp_replace(text, r"\s[\w.-]+:[\w.-]+\s*=\s*(\"[^\"]*\"|'[^']*')", ""))


def root_name(body: Column) -> Column:
    return F.lower(F.regexp_extract(body, r"(?s)^\s*(?:\x{FEFF})?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*)*<(?:[\w.-]+:)?([\w.-]+)", 1))


def sitemap_urls(docs: DataFrame, most: int = MAX_URLS) -> DataFrame:
    """(site, doc_url, pos, url, lastmod, priority) of docs(site, doc_url, body) that are url sets.

    A site's first `most` entries stay, by document and place; whole documents before the one that reaches the
    limit are counted, not ranked, so that no window holds more than one document's entries.

    Entries without a location or of another origin are dropped; a body with a DOCTYPE or bad XML has no rows.
    """
    rows = docs.where(root_name(F.col("body")) == "urlset").withColumn("x", F.from_xml(plain_xml(F.col("body")), URLSET))
    rows = rows.select("site", "doc_url", F.posexplode("x.url").alias("pos", "u")).withColumn("url", F.regexp_replace("u.loc", r"(?U)^\s+|\s+$", ""))
    rows = rows.where((F.col("url") != "") & (U.origin_key("url", "sitemap") == U.origin_key("doc_url", "sitemap")))
    rows = rows.select("site", "doc_url", "pos", "url", U.parse_lastmod("u.lastmod").alias("lastmod"), U.parse_priority("u.priority").alias("priority"))
    sizes = rows.groupBy("site", "doc_url").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("site").orderBy("doc_url").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.withColumn("before", before).where(F.col("before") < most)
    place = F.row_number().over(Window.partitionBy("site", "doc_url").orderBy("pos"))
    kept = rows.join(sizes, ["site", "doc_url"]).withColumn("place", F.col("before") + place).where(F.col("place") <= most)
    return kept.drop("n", "before", "place")


def sitemap_index_expand(docs: DataFrame, most: int = MAX_DOCUMENTS) -> DataFrame:
    """Children of index documents that are url sets, at most `most` documents a site with the index itself."""
    index = docs.where(root_name(F.col("body")) == "sitemapindex").withColumn("x", F.from_xml(plain_xml(F.col("body")), INDEX))
    locs = index.select("site", F.posexplode("x.sitemap").alias("pos", "s")).select("site", "pos", F.trim("s.loc").alias("doc_url"))
    first = locs.groupBy("site", "doc_url").agg(F.min("pos").alias("pos")).withColumn("visit", F.row_number().over(Window.partitionBy("site").orderBy("pos", "doc_url"))).where(F.col("visit") < most)
    return first.select("site", "doc_url", "visit").join(docs.where(root_name(F.col("body")) == "urlset"), ["site", "doc_url"])


def robots_sitemap_targets(bodies: DataFrame) -> DataFrame:
    """(site, pos, target): Sitemap lines of bodies(site, robots_url, body), resolved, of the same origin, once each."""
    lines = robots_lines(bodies).where("field = 'sitemap' AND value <> ''")
    rows = lines.join(bodies.select("site", "robots_url"), "site").withColumn("target", resolve(F.col("robots_url"), F.col("value")))
    rows = rows.where(U.origin_key("target", "sitemap") == U.origin_key("robots_url", "sitemap"))
    return rows.groupBy("site", "target").agg(F.min("pos").alias("pos"))


def union_candidates(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def site_part(site: Column | str, parts: int = SITE_PARTS) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(parts)).cast("int")


def pages_sink(pages: DataFrame, path: str, parts: int = SITE_PARTS) -> None:
    """Snapshots in a folder for each run and part of the sites: their number grows with runs, not with sites."""
    rows = pages.withColumn("site_part", site_part("site", parts))
    rows.repartition("run_id", "site_part").write.partitionBy("run_id", "site_part").mode("append").parquet(path)


def pages_scan(spark: SparkSession, path: str, runs: DataFrame | None = None, parts: int = SITE_PARTS) -> DataFrame:
    """Snapshots; with runs(site, run_id), those of these runs alone.

    The join is on the folders' columns as well, so that Spark reads only the folders of the runs that are found
    while the query runs (dynamic partition pruning, where the runs are few enough to be broadcast).
    """
    if runs is None:
        return spark.read.schema(SNAPSHOT).parquet(path)
    rows = spark.read.schema(f"{SNAPSHOT}, site_part int").parquet(path)
    chosen = runs.select("site", F.col("run_id").cast("long").alias("run_id"), site_part("site", parts).alias("site_part")).distinct()
    return rows.join(chosen, ["run_id", "site_part", "site"]).drop("site_part")


def payload_sink(pages: DataFrame, path: str) -> None:
    """Gzip JSON lines of eight keys, a folder for each website and run; nulls are written."""
    pages.select("website_id", "run_id", "url", "status", "title", "description", "content", "markdown", "fetched_at", "bytes").write.partitionBy("website_id", "run_id").json(path, compression="gzip", ignoreNullFields=False)


def payload_scan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{PAYLOAD}, website_id string, run_id string").json(path)


def artifact_filename(origin: Column, kind: str = "llms") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(origin, "^[a-z]+://", "")), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(slug == "", F.lit("site")).otherwise(slug), F.lit(f"-{kind}.txt"))


def artifact_sink(artifacts: DataFrame, path: str) -> None:
    """One folder for each artifact's file name, of artifacts(filename, text); a text ends in one newline."""
    artifacts.select("filename", F.regexp_replace("text", "\n$", "").alias("value")).write.partitionBy("filename").text(path)
