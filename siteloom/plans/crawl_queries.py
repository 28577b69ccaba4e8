"""Registered queries of the crawl side, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siteloom.functions import sql as SQL
from siteloom.functions import text as T
from siteloom.functions import urls as U
from siteloom.operators import diff as D
from siteloom.operators import frontier as FR
from siteloom.operators import index as IX
from siteloom.operators import pages as PG
from siteloom.operators import policy as PO
from siteloom.plans import inputs
from siteloom.tables import cut
from siteloom.sources import crawl as S

LIMIT = 20
ROBOTS = "User-agent: *\nDisallow: /fr/\nDisallow: /*?page=\nDisallow: /en/*5$\nAllow: /en/2\n# note\nCrawl-delay: 2.5\n\nUser-agent: other\nDisallow: /\n"

# ---------------------------------------------------------------- DuckDB building blocks
_LANG = "|".join(U.LANGUAGES)
_CAND = f"cand AS ({inputs.for_duckdb(inputs.CANDIDATES)})"
_NORM = (
    _CAND
    + r""", n AS (SELECT *, regexp_extract(url, '^(https?)://', 1) AS scheme, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host,
  regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path0, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS q0 FROM cand),
m AS (SELECT *, CASE WHEN regexp_full_match(path0, '/*') THEN '/' ELSE rtrim(path0, '/') END AS path,
  array_to_string(list_sort(list_filter(string_split(q0, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)'))), '&') AS query FROM n),
k AS (SELECT *, CASE WHEN scheme <> '' AND host <> '' THEN scheme || '://' || host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS norm_url FROM m)"""
)
_WWW = "CASE WHEN regexp_matches({0}, '^www[.].*[.]') THEN substr({0}, 5) ELSE {0} END"
_RULES = rf"""CASE WHEN norm_url = seed THEN 'seed' WHEN scheme <> 'https' OR {_WWW.format('host')} <> {_WWW.format('site')} THEN 'off_origin'
  WHEN regexp_matches(path, '/(199[0-9]|20[0-9][0-9])(/|$)') THEN 'dated_archive' WHEN regexp_matches(lower(path), '/(tags?|category|categories|authors?)(/|$)') THEN 'taxonomy'
  WHEN regexp_matches(lower(query), '(^|&)page=') OR regexp_matches(lower(path), '/page/+[0-9]+(/|$)') THEN 'pagination'
  WHEN regexp_matches(lower(path), '/(feed|[^/]*[.](rss|atom|xml))$') THEN 'feed' WHEN regexp_matches(lower(path), '/(changelog|change-log|release-notes)(/|$)') THEN 'changelog' END"""
_DEPTH = "len(list_filter(string_split(path, '/'), lambda s: s <> ''))"
_JUDGED = f"""{_NORM}, g AS (SELECT site, seed, norm_url, max(priority) AS priority, max(lastmod) AS lastmod, count(*) - 1 AS duplicates,
  any_value(scheme) AS scheme, any_value(host) AS host, any_value(path) AS path, any_value(query) AS query FROM k WHERE norm_url IS NOT NULL GROUP BY 1, 2, 3),
r AS MATERIALIZED (SELECT *, {_RULES} AS rule FROM g),
sp AS (SELECT site, min(lastmod) AS lo, max(lastmod) AS hi FROM r WHERE rule IS NULL GROUP BY site),
s AS (SELECT r.*, CASE WHEN rule IS NULL THEN -1.0::DOUBLE * {_DEPTH} + CASE WHEN regexp_matches(lower(path), '/(docs?|guides?|reference|api|getting-started)(/|$)') THEN 4.0 ELSE 0.0 END
  + CASE WHEN {_DEPTH} = 0 THEN 6.0 ELSE 0.0 END + 2.0 * coalesce(priority - 0.5, 0.0)
  + 0.4 * CASE WHEN lastmod IS NOT NULL AND epoch_us(hi) > epoch_us(lo) THEN (epoch_us(lastmod) - epoch_us(lo))::DOUBLE / (epoch_us(hi) - epoch_us(lo)) - 0.5 ELSE 0.0 END END AS score FROM r LEFT JOIN sp USING (site))"""
_SELECT = (
    f"""{_JUDGED}, a AS MATERIALIZED (SELECT site, norm_url, row_number() OVER (PARTITION BY site ORDER BY score DESC, norm_url) AS place,
  CASE WHEN regexp_matches(lower(path), '^/({_LANG})(-[a-z]{{2,4}})?(/|$)') THEN scheme || '://' || host || CASE WHEN regexp_matches(path, '^/[^/]+/') THEN regexp_replace(path, '^/[^/]+', '') ELSE '/' END || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS base FROM s WHERE rule IS NULL),
v0 AS MATERIALIZED (SELECT *, false AS dup FROM a), """
    + ", ".join(f"v{i + 1} AS MATERIALIZED (SELECT a.*, coalesce(b.place < a.place AND NOT b.dup, false) AS dup FROM a LEFT JOIN v{i} b ON b.site = a.site AND b.norm_url = a.base)" for i in range(3))
    + f""", q AS MATERIALIZED (SELECT *, CASE WHEN NOT dup THEN row_number() OVER (PARTITION BY site, dup ORDER BY place) END AS rk FROM v3),
e AS (SELECT q.site, q.norm_url, q.rk, CASE WHEN q.dup AND b.norm_url IS NOT NULL THEN 'localized_duplicate' WHEN q.dup OR q.rk > {LIMIT} THEN 'over_limit' END AS late
  FROM q LEFT JOIN q b ON b.site = q.site AND b.norm_url = q.base AND NOT b.dup AND b.rk <= {LIMIT}),
sel AS (SELECT s.site, s.norm_url, s.duplicates, coalesce(s.rule, e.late) AS rule, s.score, CASE WHEN s.rule IS NULL AND e.late IS NULL THEN e.rk END AS rank FROM s LEFT JOIN e USING (site, norm_url))"""
)
_SNAP = f"snap0 AS ({inputs.for_duckdb(inputs.SNAPSHOTS)}), snap AS (SELECT *, length(markdown) < 200 AS is_empty FROM snap0)"
_PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


# ---------------------------------------------------------------- URLs and frontier
@query("p01_normalize_url", f"WITH {_NORM} SELECT DISTINCT url, norm_url FROM k")
def p01(spark: SparkSession, d: str) -> DataFrame:
    return inputs.candidates(spark, d).select("url", U.normalize_url("url").alias("norm_url")).distinct()


@query("p02_origin_key", f"""WITH {_NORM} SELECT DISTINCT url, CASE WHEN norm_url IS NOT NULL THEN scheme || '|' || {_WWW.format('host')} || '|' || CASE scheme WHEN 'https' THEN '443' ELSE '80' END END AS selection,
  CASE WHEN norm_url IS NOT NULL THEN scheme || '|' || host || '|' || CASE scheme WHEN 'https' THEN '443' ELSE '80' END END AS links, CASE WHEN norm_url IS NOT NULL THEN scheme || '://' || {_WWW.format('host')} END AS indexed,
  CASE WHEN norm_url IS NOT NULL THEN {_WWW.format('host')} END AS bare_host FROM k""")  # fmt: skip
def p02(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.candidates(spark, d).select("url").distinct()
    host = U.candidate("url")["host"]
    return rows.select("url", U.origin_key("url").alias("selection"), U.origin_key("url", "links").alias("links"), U.origin_key("url", "index").alias("indexed"), U.strip_www(host).alias("bare_host"))


@query("p01_sql_functions", f"""WITH {_NORM} SELECT DISTINCT url, norm_url, CASE WHEN norm_url IS NOT NULL THEN scheme || '|' || {_WWW.format('host')} || '|' || CASE scheme WHEN 'https' THEN '443' ELSE '80' END END AS origin FROM k""")
def p01b(spark: SparkSession, d: str) -> DataFrame:
    SQL.register(spark)
    return spark.sql("SELECT DISTINCT url, normalize_url(url) AS norm_url, origin_key(url) AS origin FROM {rows}", rows=inputs.candidates(spark, d))


@query("p04_validate_site_url", f"""WITH {_CAND}, u AS (SELECT DISTINCT CASE page_id % 5 WHEN 0 THEN '  ' || url WHEN 1 THEN replace(url, '://', '://u@') WHEN 2 THEN url || ' x' WHEN 3 THEN seed || '' ELSE url END AS raw FROM cand), t AS (SELECT raw, trim(raw) AS s FROM u)
SELECT raw, CASE WHEN s = '' THEN 'empty' WHEN contains(s, ' ') THEN 'whitespace' WHEN NOT regexp_matches(s, '^https?://') THEN 'scheme' WHEN contains(regexp_extract(s, '://([^/?#]*)', 1), '@') THEN 'credentials' END AS reject_reason,
  CASE WHEN NOT contains(s, ' ') AND regexp_matches(s, '^https?://[^/?#@]+([/?#]|$)') THEN regexp_extract(s, '^(https?://)', 1) || {_WWW.format("regexp_extract(s, '://([^/?#]*)', 1)")} END AS origin FROM t""")  # fmt: skip
def p04(spark: SparkSession, d: str) -> DataFrame:
    pick = F.expr("CASE page_id % 5 WHEN 0 THEN '  ' || url WHEN 1 THEN replace(url, '://', '://u@') WHEN 2 THEN url || ' x' WHEN 3 THEN seed || '' ELSE url END")
    rows = inputs.candidates(spark, d).select(pick.alias("raw")).distinct()
    rows = U.validate_sites(rows, "raw", "v")
    return rows.select("raw", "v.reject_reason", "v.origin")


@query("p05_path_rules", f"""WITH {_NORM} SELECT DISTINCT norm_url, regexp_matches(path, '/(199[0-9]|20[0-9][0-9])(/|$)') AS dated, regexp_matches(lower(path), '/(tags?|category|categories|authors?)(/|$)') AS taxonomy,
  regexp_matches(lower(query), '(^|&)page=') OR regexp_matches(lower(path), '/page/+[0-9]+(/|$)') AS pagination, regexp_matches(lower(path), '/(feed|[^/]*[.](rss|atom|xml))$') AS feed, regexp_matches(lower(path), '/(changelog|change-log|release-notes)(/|$)') AS changelog FROM k WHERE norm_url IS NOT NULL""")  # fmt: skip
def p05(spark: SparkSession, d: str) -> DataFrame:
    c = FR.normalized(inputs.candidates(spark, d)).where("c is not null").select("c").distinct()
    path, q = F.col("c.path"), F.col("c.query")
    return c.select(F.col("c.url").alias("norm_url"), U.is_dated_archive(path).alias("dated"), U.is_taxonomy(path).alias("taxonomy"), U.is_pagination(path, q).alias("pagination"), U.is_feed(path).alias("feed"), U.is_changelog(path).alias("changelog"))


@query("p06_delocalized_url", f"""WITH {_NORM} SELECT DISTINCT norm_url, CASE WHEN regexp_matches(lower(path), '^/({_LANG})(-[a-z]{{2,4}})?(/|$)') THEN scheme || '://' || host || CASE WHEN regexp_matches(path, '^/[^/]+/') THEN regexp_replace(path, '^/[^/]+', '') ELSE '/' END || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS base FROM k WHERE norm_url IS NOT NULL""")
def p06(spark: SparkSession, d: str) -> DataFrame:
    return FR.normalized(inputs.candidates(spark, d)).where("c is not null").select(F.col("c.url").alias("norm_url"), U.delocalized_url(F.col("c")).alias("base")).distinct()


@query("p07_segments", f"""WITH {_NORM}, v AS (SELECT DISTINCT norm_url, list_filter(string_split(path, '/'), lambda s: s <> '') AS segs FROM k WHERE norm_url IS NOT NULL)
SELECT norm_url, len(segs)::BIGINT AS depth, array_to_string(list_sort(list_distinct(list_concat(list_transform(segs, lambda s: lower(s)), flatten(list_transform(segs, lambda s: string_split(lower(s), '-')))))), ' ') AS vocabulary FROM v""")  # fmt: skip
def p07(spark: SparkSession, d: str) -> DataFrame:
    rows = FR.normalized(inputs.candidates(spark, d)).where("c is not null").select("c").distinct()
    return rows.select(F.col("c.url").alias("norm_url"), U.depth(F.col("c.path")).cast("long").alias("depth"), F.array_join(F.array_sort(T.vocabulary(F.col("c.path"))), " ").alias("vocabulary"))


@query("a01_merge_duplicates", f"WITH {_NORM} SELECT site, norm_url, max(priority) AS priority, max(lastmod) AS lastmod, count(*) - 1 AS duplicates FROM k WHERE norm_url IS NOT NULL GROUP BY 1, 2")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return FR.merge_duplicates(inputs.candidates(spark, d)).drop("seed")


@query("w01_url_score", f"WITH {_JUDGED} SELECT site, norm_url, rule, round(score, 9) AS score FROM s")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return FR.judged(inputs.candidates(spark, d)).select("site", "norm_url", "rule", (F.round("score", 9) + 0.0).alias("score"))


@query("w02_select_urls", f"WITH {_SELECT} SELECT site, norm_url, duplicates, rule, round(score, 9) + 0.0 AS score, rank FROM sel")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return FR.select_urls(inputs.candidates(spark, d), LIMIT).withColumn("score", F.round("score", 9) + 0.0)


@query("a02_drop_funnel", f"""WITH {_SELECT} SELECT site, rule, CAST(sum(n) AS BIGINT) AS n FROM (SELECT site, 'unparseable' AS rule, count(*) AS n FROM k WHERE norm_url IS NULL GROUP BY 1 UNION ALL
SELECT site, 'duplicate', sum(duplicates) FROM sel GROUP BY 1 HAVING sum(duplicates) > 0 UNION ALL SELECT site, coalesce(rule, 'selected'), count(*) FROM sel GROUP BY 1, 2) GROUP BY 1, 2""")  # fmt: skip
def a02(spark: SparkSession, d: str) -> DataFrame:
    c = inputs.candidates(spark, d)
    return FR.drop_funnel(c, FR.select_urls(c, LIMIT))


@query("w10_first_occurrence", f"WITH {_CAND}, f AS (SELECT site, url, min(page_id) AS page_id FROM cand GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id, url) AS rank FROM f) SELECT * FROM r WHERE rank <= 15")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return FR.first_occurrence_capped(inputs.candidates(spark, d), ["site"], "url", "page_id", 15)


_ENTRIES = "ent AS (SELECT *, CASE WHEN page_id % 3 = 0 THEN 'links' WHEN page_id % 7 = 0 THEN 'sitemap' WHEN page_id % 2 = 0 THEN 'robots' ELSE 'sitemap_index' END AS entry_source FROM cand)"


@query("s10_discovery_precedence", f"WITH {_CAND}, {_ENTRIES}, o AS (SELECT *, CASE entry_source WHEN 'sitemap' THEN 1 WHEN 'sitemap_index' THEN 2 WHEN 'robots' THEN 3 ELSE 4 END AS o FROM ent) SELECT site, url, entry_source FROM o QUALIFY o = min(o) OVER (PARTITION BY site)")
def s10(spark: SparkSession, d: str) -> DataFrame:
    source = F.when(F.col("page_id") % 3 == 0, "links").when(F.col("page_id") % 7 == 0, "sitemap").when(F.col("page_id") % 2 == 0, "robots").otherwise("sitemap_index")
    return FR.discovery_precedence(inputs.candidates(spark, d).withColumn("entry_source", source)).select("site", "url", "entry_source")


@query("w11_fetch_plan", f"""WITH {_SELECT}, p AS (SELECT site, norm_url, rank, length(norm_url) * 1000 AS bytes FROM sel WHERE rank IS NOT NULL),
b AS (SELECT *, (rank - 1) * 2500 AS slot_ms, coalesce(sum(bytes) OVER (PARTITION BY site ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bytes_before FROM p)
SELECT site, norm_url, rank, CAST(slot_ms AS BIGINT) AS slot_ms, CAST(bytes_before AS BIGINT) AS bytes_before, CASE WHEN rank > 15 THEN 'max_pages' WHEN bytes_before >= 400000 THEN 'max_bytes' WHEN slot_ms >= 30000 THEN 'max_duration' END AS cap_hit FROM b""")  # fmt: skip
def w11(spark: SparkSession, d: str) -> DataFrame:
    picked = FR.select_urls(inputs.candidates(spark, d), LIMIT).where("rank is not null").withColumn("bytes", F.length("norm_url") * 1000)
    delay = FR.effective_crawl_delay_ms(200, F.lit(2.5))
    return FR.fetch_plan(picked, 15, 400_000, delay, 30_000).select("site", "norm_url", "rank", "slot_ms", "bytes_before", "cap_hit")


# ---------------------------------------------------------------- robots
def _bodies(spark: SparkSession, d: str) -> DataFrame:
    return inputs.candidates(spark, d).select("site", F.concat(F.col("seed"), F.lit("robots.txt")).alias("robots_url")).distinct().withColumn("body", F.concat(F.lit(ROBOTS), F.lit("Sitemap: /sitemap.xml\nsitemap: https://elsewhere.example/s.xml\nSitemap: /sitemap.xml # again\n")))


def _own_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Robots files that differ by site: its name and length are in rules, delays, a group of our own and sitemaps."""
    n = F.length("site")
    named = F.when(n % 3 == 0, F.concat(F.lit("User-agent: SiteLoom\nDisallow: /named/"), n, F.lit("\n"))).otherwise("")
    rules = F.concat(F.lit("User-agent: *\nDisallow: /only-for-"), "site", F.lit("/ # note\n"), F.when(n % 2 == 1, F.concat(F.lit("Allow: /docs/"), n, F.lit("\n"))).otherwise(""))
    delay = F.concat(F.lit("Crawl-delay: "), n % 5 * 4, F.lit(".5\n"))
    maps = F.concat(F.lit("Sitemap: /s"), n, F.lit(".xml\nsitemap: https://elsewhere.example/s.xml\nSitemap: /s"), n, F.lit(".xml # again\n"))
    sites = inputs.candidates(spark, d).select("site", F.concat(F.col("seed"), F.lit("robots.txt")).alias("robots_url")).distinct()
    return sites.withColumn("body", F.concat(rules, delay, named, maps))


_OWN_SITES = f"{_CAND}, s AS (SELECT DISTINCT site, seed, length(site) AS n FROM cand)"


@query(
    "s04_robots_rules",
    f"""WITH {_OWN_SITES}, r AS (
  SELECT site, 1 AS ord, 'disallow' AS kind, CASE WHEN n % 3 = 0 THEN '/named/' || n ELSE '/only-for-' || site || '/' END AS pattern FROM s
  UNION ALL SELECT site, 2, 'allow', '/docs/' || n FROM s WHERE n % 3 <> 0 AND n % 2 = 1)
SELECT DISTINCT site, CAST(ord AS BIGINT) AS ord, kind, pattern, CAST(length(pattern) AS BIGINT) AS pattern_len FROM r""",
)
def s04(spark: SparkSession, d: str) -> DataFrame:
    return PO.robots_rules(_own_bodies(spark, d), "siteloom")[0]


@query(
    "p17_crawl_delay",
    f"""WITH {_OWN_SITES} SELECT DISTINCT site, (n % 5 * 4 + 0.5)::DOUBLE AS crawl_delay_s,
  CAST(greatest(200, least((n % 5 * 4 + 0.5) * 1000, 10000)) AS BIGINT) AS delay_ms FROM s WHERE n % 3 <> 0""",
)
def p17(spark: SparkSession, d: str) -> DataFrame:
    return PO.robots_rules(_own_bodies(spark, d), "siteloom")[1].withColumn("delay_ms", FR.effective_crawl_delay_ms(200, F.col("crawl_delay_s")))


@query("j02_robots_allowed", rf"""WITH {_NORM}, t AS (SELECT DISTINCT site, norm_url, path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS target FROM k WHERE norm_url IS NOT NULL)
SELECT site, norm_url, CASE WHEN starts_with(target, '/en/2') THEN 5 ELSE -1 END >= greatest(CASE WHEN starts_with(target, '/fr/') THEN 4 ELSE -1 END, CASE WHEN contains(target, '?page=') THEN 8 ELSE -1 END, CASE WHEN regexp_matches(target, '^/en/.*5$') THEN 7 ELSE -1 END) AS allowed FROM t""")  # fmt: skip
def j02(spark: SparkSession, d: str) -> DataFrame:
    rules, _ = PO.robots_rules(_bodies(spark, d), "siteloom")
    urls = FR.merge_duplicates(inputs.candidates(spark, d)).select("site", "norm_url")
    return PO.robots_allowed(urls, rules)


@query("s03_robots_sitemap_targets", f"WITH {_OWN_SITES} SELECT DISTINCT site, seed || 's' || n || '.xml' AS target FROM s")
def s03(spark: SparkSession, d: str) -> DataFrame:
    return S.robots_sitemap_targets(_own_bodies(spark, d)).select("site", "target")


def _sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """A sitemap per site in one of three spellings, and an index document that names it."""
    rows = inputs.candidates(spark, d).where("url like 'http%'")
    prio, mod = F.coalesce(F.format_string("<priority>%.1f</priority>", "priority"), F.lit("")), F.coalesce(F.concat(F.lit("<lastmod>"), F.date_format("lastmod", "yyyy-MM-dd"), F.lit("</lastmod>")), F.lit(""))
    entry = F.concat(F.lit("<url><loc> "), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit(" </loc>"), mod, prio, F.lit("<changefreq>daily</changefreq></url>"))
    sites = rows.groupBy("site", "seed").agg(F.array_join(F.array_sort(F.collect_list(entry)), "\n").alias("x"))
    body = F.concat(F.lit('<?xml version="1.0"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.col("x"), F.lit("</urlset>"))
    prefixed = F.regexp_replace(F.regexp_replace(body, "xmlns=", "xmlns:sm="), r"<(/?)(urlset|url|loc|lastmod|priority)\b", "<$1sm:$2")
    kind = F.length("site") % 4
    maps = sites.select("site", F.concat("seed", F.lit("sitemap.xml")).alias("doc_url"), F.when(kind == 1, prefixed).when(kind == 2, F.concat(F.lit("<!DOCTYPE x>"), body)).when(kind == 3, F.regexp_replace(body, "</urlset>", "</oops>")).otherwise(body).alias("body"))
    index = sites.select("site", F.concat("seed", F.lit("index.xml")).alias("doc_url"), F.concat(F.lit("<sitemapindex><sitemap><loc>"), F.col("seed"), F.lit("sitemap.xml</loc></sitemap><sitemap><loc>"), F.col("seed"), F.lit("index.xml</loc></sitemap></sitemapindex>")).alias("body"))
    return maps.union(index)


_SITEMAP_ROWS = f"""{_CAND} , ok AS (SELECT * FROM cand WHERE url LIKE 'http%' AND length(site) % 4 IN (0, 1))"""


@query("s01_sitemap_urls", f"""WITH {_SITEMAP_ROWS} SELECT site, url, lastmod, priority FROM ok WHERE starts_with(url, 'https://') AND {_WWW.format("regexp_extract(url, '^https://([^/?#]+)', 1)")} = {_WWW.format('site')}""")
def s01(spark: SparkSession, d: str) -> DataFrame:
    return S.sitemap_urls(_sitemaps(spark, d)).select("site", "url", "lastmod", "priority")


@query("s02_sitemap_index_expand", f"WITH {_CAND} SELECT DISTINCT site, seed || 'sitemap.xml' AS doc_url, 1::BIGINT AS visit FROM cand WHERE url LIKE 'http%' AND length(site) % 4 <> 2")
def s02(spark: SparkSession, d: str) -> DataFrame:
    docs = _sitemaps(spark, d).where("body not like '<!DOCTYPE%'")
    got = S.sitemap_index_expand(docs)
    return got.select("site", "doc_url", F.col("visit").cast("long").alias("visit"))


@query("f01_lastmod_priority", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN TIMESTAMP '2024-03-05' WHEN 1 THEN TIMESTAMP '2024-03-05 08:30:00' END AS lastmod, CASE page_id % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 END AS priority FROM pages""")
def f01(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet")
    mod = F.expr("CASE page_id % 4 WHEN 0 THEN '2024-03-05' WHEN 1 THEN ' 2024-03-05T10:30:00+02:00 ' WHEN 2 THEN '2024-03' ELSE 'soon' END")
    pri = F.expr("CASE page_id % 3 WHEN 0 THEN '0.5' WHEN 1 THEN ' 1.0 ' ELSE CASE page_id % 2 WHEN 0 THEN '1.5' ELSE '0.5f' END END")
    return p.select("page_id", U.parse_lastmod(mod).alias("lastmod"), U.parse_priority(pri).alias("priority"))


@query("f03_percent_normalize", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/a b+c/' WHEN 1 THEN '/x%2Fy%3Fz' WHEN 2 THEN '/50%/é' ELSE '/~u%23%25' END || page_id AS target FROM pages")
def f03(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet")
    raw = F.expr("CASE page_id % 4 WHEN 0 THEN '/a%20b+c/' WHEN 1 THEN '/x%2fy%3fz' WHEN 2 THEN '/50%/%C3%A9' ELSE '/%7Eu%23%25' END || page_id")
    return p.select("page_id", U.percent_normalize(raw).alias("target"))


# ---------------------------------------------------------------- pages
_HEADERS = "CASE WHEN page_id % 5 = 0 THEN map('Server', 'cloudflare') WHEN page_id % 7 = 0 THEN map('CF-Mitigated', 'challenge') ELSE map('server', 'nginx') END"
_STATUS = "CASE WHEN page_id % 3 = 0 THEN 403 WHEN page_id % 11 = 0 THEN 503 WHEN page_id % 13 = 0 THEN 404 ELSE 200 END"
_BODY = "CASE WHEN page_id % 2 = 0 THEN '<html><title>Just a moment... | x</title>' ELSE html END"
_BLOCK = f"blk AS (SELECT page_id, url, {_STATUS} AS status, CASE WHEN {_STATUS} = 200 THEN NULL WHEN page_id % 7 = 0 AND page_id % 5 <> 0 THEN 'challenge' WHEN {_STATUS} IN (403, 503) AND page_id % 5 = 0 AND page_id % 2 = 0 THEN 'challenge' WHEN {_STATUS} = 403 THEN 'denied' END AS blocked_reason, CASE WHEN page_id % 17 = 0 THEN 'https://away.example.org/' ELSE url END AS final_url, length(html) AS content_bytes, length(html) % 3 = 0 AS is_empty FROM pages)"


def _classified(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet")
    rows = p.select("page_id", "url", F.expr(_STATUS).alias("status"), F.expr(_HEADERS).alias("headers"), F.expr(_BODY).alias("body"), F.expr("CASE WHEN page_id % 17 = 0 THEN 'https://away.example.org/' ELSE url END").alias("final_url"), F.length("html").alias("content_bytes"), (F.length("html") % 3 == 0).alias("is_empty"))
    rows = rows.withColumn("blocked_reason", PG.classify_block(F.col("status"), F.col("headers"), F.col("body")))
    return rows.withColumn("outcome", PG.page_outcome(F.col("status"), F.col("blocked_reason"), F.col("url"), F.col("final_url"))).withColumn("site", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))


_OUTCOME = "CASE WHEN blocked_reason IS NOT NULL THEN 'blocked' WHEN status <> 200 THEN 'http_error' WHEN page_id % 17 = 0 THEN 'off_origin_redirect' ELSE 'ok' END"


@query("p10_classify_block", f"WITH {_BLOCK} SELECT page_id, status, blocked_reason FROM blk")
def p10(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("page_id", "status", "blocked_reason")


@query("p11_page_outcome", f"WITH {_BLOCK} SELECT page_id, {_OUTCOME} AS outcome FROM blk")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).select("page_id", "outcome")


@query("a03_crawl_stats", f"""WITH {_BLOCK}, o AS (SELECT *, {_OUTCOME} AS outcome, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site FROM blk)
SELECT site, count(*) FILTER (outcome = 'ok') AS pages_crawled, count(*) FILTER (outcome <> 'ok') AS pages_failed, CAST(sum(content_bytes) AS BIGINT) AS bytes_fetched, count(*) FILTER (outcome = 'ok' AND is_empty) AS pages_empty_content,
count(*) FILTER (outcome = 'blocked') AS pages_blocked, count(*) FILTER (outcome = 'http_error') AS pages_http_error, count(*) FILTER (outcome = 'off_origin_redirect') AS pages_off_origin,
CASE WHEN bool_or(blocked_reason = 'challenge') THEN 'challenge' WHEN bool_or(blocked_reason = 'denied') THEN 'denied' END AS blocked_reason FROM o GROUP BY site""")  # fmt: skip
def a03(spark: SparkSession, d: str) -> DataFrame:
    return PG.crawl_stats(_classified(spark, d))


@query("p12_looks_like_html", "SELECT page_id, page_id % 4 <> 2 AS is_html FROM pages")
def p12(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("CASE page_id % 4 WHEN 0 THEN 'Text/HTML; charset=utf-8' WHEN 1 THEN NULL WHEN 2 THEN 'application/json' ELSE ' application/xhtml+xml' END")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", PG.looks_like_html(kind).alias("is_html"))


@query("p13_redirect_chain", """WITH RECURSIVE h AS (SELECT DISTINCT 'https://r.example/' || page_id AS url, CASE WHEN page_id % 9 = 4 THEN '' WHEN page_id % 10 = 7 THEN 'http://r.example/x' ELSE 'https://r.example/' || (page_id + 1) END AS location, page_id % 8 <> 0 AS go FROM pages),
c AS (SELECT url AS start, url, 0 AS n, NULL::VARCHAR AS outcome FROM h UNION ALL SELECT c.start, CASE WHEN h.location <> '' AND NOT starts_with(h.location, 'http:') AND c.n < 5 THEN h.location ELSE c.url END,
  CASE WHEN h.location <> '' AND NOT starts_with(h.location, 'http:') AND c.n < 5 THEN c.n + 1 ELSE c.n END, CASE WHEN h.location = '' THEN 'missing_location' WHEN starts_with(h.location, 'http:') THEN 'https_downgrade' WHEN c.n >= 5 THEN 'too_many' END FROM c JOIN h ON h.url = c.url AND h.go WHERE c.outcome IS NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY n DESC, outcome NULLS LAST) AS rn FROM c)
SELECT start AS url, url AS final_url, n AS n_hops, coalesce(outcome, 'ok') AS outcome FROM z WHERE rn = 1""")  # fmt: skip
def p13(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/pages.parquet").select("page_id").distinct()
    hops = p.select(F.expr("'https://r.example/' || page_id").alias("url"), F.expr("CASE WHEN page_id % 9 = 4 THEN '' WHEN page_id % 10 = 7 THEN 'http://r.example/x' ELSE 'https://r.example/' || (page_id + 1) END").alias("location"), F.expr("page_id % 8 <> 0").alias("is_redirect"))
    return PG.redirect_chain(hops.select("url"), hops)


#: What hosts resolve to: addresses made of the pages' own bytes, a hundredth of them in special blocks; every seventh site has none.
_RESOLVED = """SELECT site, CAST(n % 223 + 1 AS VARCHAR(9)) || '.' || CAST(n / 223 % 256 AS VARCHAR(9)) || '.' || CAST(k % 256 AS VARCHAR(9)) || '.' || CAST(n % 251 AS VARCHAR(9)) AS ip, n % 223 + 1 AS a, n / 223 % 256 AS b, k % 256 AS c, n % 251 AS d
FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site, length(html) AS n, length(url) * 37 AS k FROM {pages}) p WHERE length(site) % 7 <> 0"""


@query(
    "p14_blocked_address",
    f"""WITH r AS ({_RESOLVED.format(pages="pages").replace(" / ", " // ")}), j AS (SELECT site, a = 0 OR a = 10 OR a = 127 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168)
  OR (a = 192 AND b = 0 AND c IN (0, 2) AND NOT (c = 0 AND d IN (9, 10))) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113) OR a >= 240 AS bad, a BETWEEN 224 AND 239 AS cast, (a = 169 AND b = 254 AND c = 169 AND d = 254) OR (a = 100 AND b = 100 AND c = 100 AND d = 200) OR (a = 192 AND b = 0 AND c = 0 AND d = 192) AS meta FROM r),
w AS (SELECT site, bool_or(bad) AS bad, bool_or(meta) AS meta FROM j GROUP BY site)
SELECT DISTINCT url, CASE WHEN w.site IS NULL THEN 'unresolved' WHEN meta THEN 'metadata' WHEN bad THEN 'non_global' END AS reason FROM (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS site FROM pages) p LEFT JOIN w USING (site)""",
)
def p14(spark: SparkSession, d: str) -> DataFrame:
    """Every page's host by the addresses that it resolves to."""
    pages = spark.read.parquet(f"{d}/pages.parquet")
    resolved = spark.sql(_RESOLVED.replace(" / ", " div "), pages=pages).select(F.col("site").alias("host"), "ip")
    return PG.blocked_addresses(pages.select("url"), resolved)


@query(
    "p14_longest_prefix",
    f"""WITH r AS ({_RESOLVED.format(pages="pages").replace(" / ", " // ")}), n AS (SELECT DISTINCT ip, a * 16777216 + b * 65536 + c * 256 + d AS v FROM r),
k AS (SELECT DISTINCT a * 16777216 + b * 65536 + c * 256 + d AS v, 8 + (a + b + c + d) % 24 AS len FROM r), bl AS (SELECT DISTINCT v - v % CAST(power(2, 32 - len) AS BIGINT) AS lo, len FROM k)
SELECT ip, max(len) AS len FROM n JOIN bl ON n.v >= lo AND n.v < lo + CAST(power(2, 32 - len) AS BIGINT) GROUP BY ip""",
)
def p14b(spark: SparkSession, d: str) -> DataFrame:
    """Addresses against as many blocks as there are, each with its own prefix length."""
    rows = spark.sql(_RESOLVED.replace(" / ", " div "), pages=spark.read.parquet(f"{d}/pages.parquet"))
    length = (8 + (F.col("a") + F.col("b") + F.col("c") + F.col("d")) % 24).cast("string")
    blocks = PG.address_blocks(rows.select(F.concat("ip", F.lit("/"), length).alias("cidr"), length.alias("reason")))
    asked = rows.select("ip").distinct().select("ip", F.explode(PG.address_bits(F.col("ip"))).alias("x")).select("ip", "x.family", "x.bits")
    return asked.join(PG.longest_prefix(asked, blocks), ["family", "bits"]).select("ip", F.col("reason").cast("long").alias("len"))


@query("p15_redact", r"""SELECT doc_id, regexp_replace(regexp_replace(t, '(?i)\b(bearer)\s+[A-Za-z0-9._~+/=-]{12,}', '\1 [REDACTED]', 'g'), '(?i)(token\s*[:=]\s*)(tk_[0-9]+)', '\1[REDACTED]', 'g') AS redacted FROM (SELECT doc_id, 'x Bearer abcdefgh1234' || doc_id || ' token=tk_' || doc_id AS t FROM documents)""")
def p15(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", T.redact(F.expr("'x Bearer abcdefgh1234' || doc_id || ' token=tk_' || doc_id")).alias("redacted"))


@query("p15_redact_documents")
def p15b(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", T.redact("text").alias("redacted"))


@query("p16_attempt_outcome", """SELECT event_id, kind = 'network' OR (kind = 'http' AND (status >= 500 OR status = 429)) AS retryable, CASE WHEN (kind = 'network' OR (kind = 'http' AND (status >= 500 OR status = 429))) AND attempt < 3 THEN CASE attempt WHEN 1 THEN 10 ELSE 60 END END AS delay_s
FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'http' ELSE 'other' END AS kind, CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 429 WHEN 2 THEN 404 ELSE 403 END AS status, event_id % 3 + event_id % 2 AS a, greatest(event_id % 5, 1) AS attempt FROM events)""")  # fmt: skip
def p16(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.expr("CASE event_id % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'http' ELSE 'other' END").alias("kind"), F.expr("CASE event_id % 4 WHEN 0 THEN 500 WHEN 1 THEN 429 WHEN 2 THEN 404 ELSE 403 END").alias("status"), F.expr("greatest(event_id % 5, 1)").alias("attempt"))
    return e.withColumn("o", PG.attempt_outcome(F.col("kind"), F.col("status"), F.col("attempt"))).select("event_id", "o.retryable", "o.delay_s")


@query("t05_extract_links", r"""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, unnest(regexp_extract_all(html, '<a href="(/[^"#]*)', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="(/[^"#]*)', 1), 1) AS pos FROM pages),
f AS (SELECT page_id, origin || href AS link, min(pos) AS pos FROM a GROUP BY 1, 2) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rank, link FROM f""")  # fmt: skip
def t05(spark: SparkSession, d: str) -> DataFrame:
    return PG.extract_links(spark.read.parquet(f"{d}/pages.parquet"))


@query("t06_extract_content")
def t06(spark: SparkSession, d: str) -> DataFrame:
    return PG.extract_content(spark.read.parquet(f"{d}/pages.parquet"))


# ---------------------------------------------------------------- index
def _snap(spark: SparkSession, d: str) -> DataFrame:
    return cut(inputs.snapshots(spark, d).withColumn("is_empty", F.length("markdown") < 200), "snapshots")


_WORDS = f"list_distinct(list_concat(list_transform(sg, lambda s: lower(s)), flatten(list_transform(sg, lambda s: string_split(lower(s), '-')))))"
_SECTION = (
    "CASE WHEN len(sg) = 0 THEN 'Overview' "
    + " ".join(f"WHEN list_has_any(vocab, [{', '.join(repr(w) for w in words.split())}]) THEN '{name}'" for name, words in T.SECTION_WORDS)
    + " WHEN contains(lower(sg[1]), '.') THEN 'Other' ELSE array_to_string(list_transform(list_filter(string_split(replace(lower(sg[1]), '_', '-'), '-'), lambda w: w <> ''), lambda w: CASE WHEN w IN ("
    + ", ".join(repr(a) for a in T.ACRONYMS)
    + ") THEN upper(w) ELSE upper(w[1]) || w[2:] END), ' ') END"
)
_OPT = f"list_has_any(vocab, [{', '.join(repr(w) for w in T.OPTIONAL_WORDS)}]) OR len(list_filter(sg, lambda s: regexp_full_match(s, '(19|20)[0-9][0-9]'))) > 0"
_WEIGHT = "CASE section " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in T.SECTION_WEIGHTS.items()) + " ELSE 0.0 END"
_SRANK = "CASE section " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(T.SECTION_ORDER)) + f" WHEN 'Other' THEN {len(T.SECTION_ORDER) + 1} ELSE {len(T.SECTION_ORDER)} END"
_SCORED = f"""{_SNAP}, c0 AS (SELECT *, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS sg FROM snap WHERE status BETWEEN 200 AND 299 AND NOT is_empty),
c1 AS (SELECT *, {_WORDS} AS vocab FROM c0), c2 AS (SELECT *, {_SECTION} AS section, {_OPT} AS always_optional, sha256(substr(markdown, 1, 2000)) AS fp FROM c1),
c3 AS (SELECT *, min(lastmod) OVER (PARTITION BY site) AS lo, max(lastmod) OVER (PARTITION BY site) AS hi FROM c2),
c4 AS (SELECT site, url, section, always_optional, fp, len(sg) AS depth, 4.0::DOUBLE / (1 + len(sg)) + CASE WHEN linked_from_seed THEN 8.0 ELSE 0.0 END + {_WEIGHT}
  + 2.0 * (((length(markdown) >= 500)::INT + (length(markdown) >= 2000)::INT + (length(markdown) >= 8000)::INT)::DOUBLE / 3) + 2.0 * coalesce(priority - 0.5, 0.0)
  + 0.4 * CASE WHEN lastmod IS NOT NULL AND epoch_us(hi) > epoch_us(lo) THEN (epoch_us(lastmod) - epoch_us(lo))::DOUBLE / (epoch_us(hi) - epoch_us(lo)) - 0.5 ELSE 0.0 END - CASE WHEN always_optional THEN 1000.0 ELSE 0.0 END AS score FROM c3)"""
_ORDERED = f"""{_SCORED}, d1 AS (SELECT *, row_number() OVER (PARTITION BY site, fp ORDER BY score DESC, depth, url) AS rn, count(*) OVER (PARTITION BY site, fp) AS copies FROM c4),
d2 AS (SELECT *, row_number() OVER (PARTITION BY site, always_optional ORDER BY score DESC, url, fp) AS rk, bool_or(NOT always_optional) OVER (PARTITION BY site) AS has_main FROM d1 WHERE rn = 1),
d3 AS (SELECT *, rk > 30 OR (always_optional AND has_main) AS optional FROM d2),
d4 AS (SELECT *, sum(CASE WHEN optional THEN 0 ELSE 1 END) OVER (PARTITION BY site, section) AS size FROM d3),
d5 AS (SELECT * REPLACE (CASE WHEN optional THEN 'Optional' WHEN section NOT IN ({', '.join(repr(x) for x in [*T.SECTION_ORDER, 'Other'])}) AND size < 2 THEN 'Other' ELSE section END AS section) FROM d4),
ent AS (SELECT site, row_number() OVER (PARTITION BY site ORDER BY optional, CASE WHEN optional THEN 99 ELSE {_SRANK} END, section, score DESC, url, fp) AS ord, section, url, optional, score, copies FROM d5)"""


@query("p08_section_for", f"WITH {_SNAP}, c0 AS (SELECT DISTINCT url, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS sg FROM snap), c1 AS (SELECT *, {_WORDS} AS vocab FROM c0) SELECT url, {_SECTION} AS section, {_OPT} AS always_optional FROM c1")
def p08(spark: SparkSession, d: str) -> DataFrame:
    return _snap(spark, d).select("url", T.section_for(F.col("url"), F.col("origin")).alias("section"), T.is_always_optional(F.col("url")).alias("always_optional")).distinct()


@query("p08_sql_section_for", f"WITH {_SNAP}, c0 AS (SELECT DISTINCT url, list_filter(string_split({_PATH}, '/'), lambda s: s <> '') AS sg FROM snap), c1 AS (SELECT *, {_WORDS} AS vocab FROM c0) SELECT url, {_SECTION} AS section FROM c1")
def p08b(spark: SparkSession, d: str) -> DataFrame:
    SQL.register(spark)
    return spark.sql("SELECT DISTINCT url, section_for(url, origin) AS section FROM {rows}", rows=_snap(spark, d))


@query("w03_page_score", f"WITH {_SCORED} SELECT site, url, section, always_optional, round(score, 9) AS score FROM c4")
def w03(spark: SparkSession, d: str) -> DataFrame:
    return IX.scored(_snap(spark, d)).select("site", "url", "section", "always_optional", (F.round("score", 9) + 0.0).alias("score"))


@query("w07_artifact_order", f"WITH {_ORDERED} SELECT site, ord, section, url, optional, round(score, 9) AS score, copies FROM ent")
def w07(spark: SparkSession, d: str) -> DataFrame:
    return IX.ordered_entries(_snap(spark, d)).withColumn("score", F.round("score", 9) + 0.0)


@query("a05_index_counts", f"WITH {_ORDERED} SELECT site, count(*) FILTER (NOT optional) AS links_main, count(*) FILTER (optional) AS links_optional, CAST(sum(copies - 1) AS BIGINT) AS links_duplicate FROM ent GROUP BY site")
def a05(spark: SparkSession, d: str) -> DataFrame:
    return IX.index_counts(IX.ordered_entries(_snap(spark, d)))


_DETAIL = f"{_ORDERED}, det AS (SELECT DISTINCT ON (site, url) site, url, title, description, markdown FROM snap), bp AS (SELECT e.site, lower(trim(regexp_replace(description, '\\s+', ' ', 'g'))) AS norm, count(*) AS n FROM ent e JOIN det USING (site, url) WHERE trim(description) <> '' GROUP BY 1, 2 HAVING count(*) >= 3)"


@query("a06_boilerplate", f"WITH {_DETAIL} SELECT site, norm FROM bp")
def a06(spark: SparkSession, d: str) -> DataFrame:
    pages = _snap(spark, d)
    return IX.boilerplate(IX.ordered_entries(pages), pages)


def _described(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    header = cut(IX.site_header(pages), "headers")
    entries = cut(IX.ordered_entries(pages), "entries")
    return cut(IX.described_entries(entries, pages, header), "described"), header


@query("p21_described_entries", f"""WITH {_DETAIL}, rootp AS (SELECT site, min(description) AS description FROM snap WHERE {_PATH} IN ('', '/') GROUP BY site)
SELECT e.site, ord, section, e.url, optional, CASE WHEN description IS NULL OR description LIKE '%…' OR bp.norm IS NOT NULL OR (description LIKE 'Page %' AND false) THEN NULL ELSE regexp_extract(description, '^(.*?[.!?])(\\s|$)', 1) END AS description
FROM ent e JOIN det USING (site, url) LEFT JOIN bp ON bp.site = e.site AND bp.norm = lower(trim(regexp_replace(det.description, '\\s+', ' ', 'g')))""")  # fmt: skip
def p21(spark: SparkSession, d: str) -> DataFrame:
    """The SQL twin has no site sentence to compare with, so the header's is left out here; T04 has its own tests."""
    pages = _snap(spark, d)
    header = IX.site_header(pages).withColumn("site_sentence", F.lit(None).cast("string"))
    return IX.described_entries(IX.ordered_entries(pages), pages, header).drop("label")


def _cleaned(column: str) -> str:
    text = f"trim(regexp_replace({column}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({text}) > {T.MAX_TEXT} THEN rtrim(left({text}, {T.MAX_TEXT})) || '…' ELSE nullif({text}, '') END"


_SENTENCE = "trim(coalesce(nullif(regexp_extract({0}, '(?s)^(.*?([.!?](\\s|$)|[。！？]))', 1), ''), {0}))"
_WORDCOUNT = "len(string_split({0}, ' '))"
_PLAIN = "trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _same(a: str, b: str) -> str:
    x, y = _PLAIN.format(a), _PLAIN.format(b)
    return f"coalesce({x} <> '' AND {y} <> '' AND (starts_with({x}, {y}) OR starts_with({y}, {x})), false)"


_HEADER = f"""rt AS (SELECT site, min({{'url': url, 'title': coalesce(title, ''), 'description': coalesce(description, ''), 'markdown': markdown}}) AS r FROM snap WHERE {_PATH} IN ('', '/') AND url LIKE origin || '%' GROUP BY site),
st AS (SELECT site, min(origin) AS origin FROM snap GROUP BY site),
h0 AS (SELECT st.site, origin, r, trim(regexp_replace(r.description, '\\s+', ' ', 'g')) AS de, list_filter(list_transform(string_split(r.markdown, chr(10) || chr(10)), lambda b: trim(regexp_replace(b, '\\s+', ' ', 'g'))), lambda b: b <> '' AND NOT regexp_matches(b, '^#{{1,6}}(\\s|$)')) AS blocks FROM st LEFT JOIN rt USING (site)),
h1 AS (SELECT *, CASE WHEN {_WORDCOUNT.format(_SENTENCE.format("de"))} <= {T.SITE_WORDS} THEN nullif({_SENTENCE.format("de")}, '') END AS d1, CASE WHEN {_WORDCOUNT.format(_SENTENCE.format("blocks[1]"))} <= {T.SITE_WORDS} THEN nullif({_SENTENCE.format("blocks[1]")}, '') END AS b1 FROM h0),
h2 AS (SELECT *, coalesce({_cleaned("d1")}, {_cleaned("b1")}) AS sentence FROM h1),
h3 AS (SELECT site, b, i, sentence AS sn, CASE WHEN {_WORDCOUNT.format("b")} <= {T.PROSE_WORDS} THEN b WHEN {_WORDCOUNT.format(_SENTENCE.format("b"))} <= {T.PROSE_WORDS} THEN {_SENTENCE.format("b")} END AS p FROM (SELECT site, sentence, unnest(blocks) AS b, generate_subscripts(blocks, 1) AS i FROM h2) WHERE regexp_matches(b, '[.!?](\\s|$)|[。！？]') AND {_WORDCOUNT.format("b")} >= {T.PROSE_LEAST}),
h4 AS (SELECT site, arg_min({_cleaned("p")}, i) AS prose FROM h3 WHERE p IS NOT NULL AND NOT {_same(_cleaned("p"), "sn")} GROUP BY site),
hd AS MATERIALIZED (SELECT h2.site, origin, coalesce({_cleaned("r.title")}, origin) AS project_name, sentence AS site_sentence, prose FROM h2 LEFT JOIN h4 USING (site))"""


_LAST = f"regexp_replace(coalesce(list_filter(string_split({_PATH}, '/'), lambda s: s <> '')[-1], ''), '[.][^.]*$', '')"
_HUMAN = f"array_to_string(list_transform(list_filter(string_split(replace({_LAST}, '_', '-'), '-'), lambda w: w <> ''), lambda w: CASE WHEN w IN ({', '.join(repr(a) for a in T.ACRONYMS)}) THEN upper(w) ELSE upper(w[1]) || lower(w[2:]) END), ' ')"
_HOST = "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"
_FIRST = _SENTENCE.format("trim(description)")
#: Entries with their labels and descriptions (des), and the sites' headers (hd).
_DESCRIBED = f"""{_DETAIL}, {_HEADER}, des0 AS (SELECT e.site, ord, section, e.url, optional, markdown, description, site_sentence, bp.norm IS NOT NULL AS plate, coalesce({_cleaned("title")}, {_cleaned(_HUMAN.replace("url", "e.url"))}, {_HOST.replace("url", "e.url")}) AS label, CASE WHEN {_WORDCOUNT.format(_FIRST)} <= {T.DESCRIPTION_WORDS} THEN {_FIRST} END AS s0
  FROM ent e JOIN det USING (site, url) JOIN hd ON hd.site = e.site LEFT JOIN bp ON bp.site = e.site AND bp.norm = lower(trim(regexp_replace(det.description, '\\s+', ' ', 'g')))),
des AS MATERIALIZED (SELECT site, ord, section, url, optional, markdown, label, CASE WHEN NOT coalesce(trim(description) = '' OR regexp_matches(trim(description), '(…|[.][.][.])$') OR plate OR s IS NULL OR {_PLAIN.format("s")} = {_PLAIN.format("label")} OR {_same("s", "site_sentence")}, true) THEN s END AS description FROM (SELECT *, {_cleaned("s0")} AS s FROM des0))"""
_COUNTED = "CASE WHEN {0} = 1 THEN '1 page' ELSE {0} || ' pages' END"
_OPENING = "'# ' || project_name || chr(10) || chr(10) || '> ' || {0} || chr(10) || coalesce(chr(10) || prose || chr(10), '')"
_LINE = "'- [' || replace(replace(replace(label, '\\', '\\\\'), '[', '\\['), ']', '\\]') || '](' || " + "".join("replace(" for _ in T.TARGET_ESCAPES) + "url" + "".join(f", '{a}', '{b}')" for a, b in T.TARGET_ESCAPES) + " || ')' || coalesce(': ' || description, '')"


def _sections(page_bytes: int, full_bytes: int) -> str:
    """The sections of full texts (pl) with their sizes and whether they are kept, and the texts before them (fh)."""
    cut_at = f"list_max(list_filter(range(1, {page_bytes + 1}), lambda n: strlen(left(markdown, n)) <= {page_bytes}))"
    body = f"CASE WHEN strlen(markdown) > {page_bytes} THEN left(markdown, {cut_at}) || chr(10) || chr(10) || '{IX.PAGE_NOTICE.strip()}' ELSE markdown END"
    quote = f"concat_ws(' ', site_sentence, 'The full text of ' || {_COUNTED.format('n')} || ' from ' || origin || '.')"
    return f"""{_DESCRIBED}, fh AS (SELECT site, {_OPENING.format(quote)} AS head FROM (SELECT hd.*, coalesce(n, 0) AS n FROM hd LEFT JOIN (SELECT site, count(*) AS n FROM des GROUP BY site) USING (site))),
b0 AS (SELECT site, ord, label, strlen(markdown) > {page_bytes} AS trimmed, {body} AS body FROM des), b1 AS (SELECT site, ord, trimmed, chr(10) || '## ' || label || chr(10) || chr(10) || CASE WHEN trim(body) = '' THEN '{IX.EMPTY_NOTICE}' ELSE body END || chr(10) AS sec FROM b0),
pl AS (SELECT site, ord, trimmed, sec, strlen(sec) AS size, strlen(head) + sum(strlen(sec)) OVER (PARTITION BY site ORDER BY ord) AS used FROM b1 JOIN fh USING (site)), kp AS (SELECT *, used <= {full_bytes - IX.RESERVE_BYTES} AS kept FROM pl)"""


@query(
    "t01_render_index",
    f"""WITH {_DESCRIBED}, ls AS (SELECT site, ord, CASE WHEN lag(section) OVER (PARTITION BY site ORDER BY ord) IS DISTINCT FROM section THEN chr(10) || '## ' || section || chr(10) || chr(10) ELSE '' END || {_LINE} AS line FROM des),
bd AS (SELECT site, count(*) AS n, string_agg(line, chr(10) ORDER BY ord) AS body FROM ls GROUP BY site), q AS (SELECT hd.*, body, coalesce(site_sentence, 'An index of ' || {_COUNTED.format('coalesce(n, 0)')} || ' from ' || origin || '.') AS quote FROM hd LEFT JOIN bd USING (site))
SELECT site, {_OPENING.format('quote')} || coalesce(body || chr(10), '') AS llms_txt FROM q""",
)
def t01(spark: SparkSession, d: str) -> DataFrame:
    pages = _snap(spark, d)
    described, header = _described(pages)
    sites = pages.select("site", "origin").distinct()
    return IX.empty_documents(sites, IX.render_index(described, header))


@query(
    "t02_render_full_text",
    f"""WITH {_sections(IX.PAGE_BYTES, IX.FULL_BYTES)}, g AS (SELECT site, coalesce(string_agg(sec, '' ORDER BY ord) FILTER (kept), '') AS body, count(*) FILTER (NOT kept) AS omitted, count(*) FILTER (kept AND trimmed) AS cut FROM kp GROUP BY site)
SELECT site, head || coalesce(body, '') || CASE WHEN omitted > 0 THEN chr(10) || '_[Truncated: ' || {_COUNTED.format('omitted')} || ' omitted at the {IX.FULL_BYTES // (1024 * 1024)} MB per-run limit.]_' || chr(10) ELSE '' END AS llms_full_txt, coalesce(omitted + cut, 0) AS truncated FROM fh LEFT JOIN g USING (site)""",
)
def t02(spark: SparkSession, d: str) -> DataFrame:
    pages = _snap(spark, d)
    described, header = _described(pages)
    return IX.render_full_text(IX.full_text_plan(described, pages, header), described, header)


@query("t04_site_header", f"WITH {_SNAP}, {_HEADER} SELECT * FROM hd")
def t04(spark: SparkSession, d: str) -> DataFrame:
    return IX.site_header(_snap(spark, d))


@query("w08_byte_budget", f"WITH {_sections(4096, 40_000)} SELECT site, ord, CAST(size AS BIGINT) AS size, trimmed, CAST(used AS BIGINT) AS used, kept FROM kp")
def w08(spark: SparkSession, d: str) -> DataFrame:
    pages = _snap(spark, d)
    described, header = _described(pages)
    return IX.full_text_plan(described, pages, header, page_bytes=4096, full_bytes=40_000).select("site", "ord", "size", "trimmed", "used", "kept")


@query("j01_page_signals", f"""WITH {_NORM}, mg AS (SELECT site, norm_url, max(priority) AS priority, max(lastmod) AS lastmod FROM k WHERE norm_url IS NOT NULL GROUP BY 1, 2), pg AS (SELECT DISTINCT site, url FROM cand WHERE url LIKE 'http%')
SELECT pg.site, pg.url, mg.priority, mg.lastmod, contains(pg.url, '/docs/') AS linked_from_seed FROM pg JOIN (SELECT DISTINCT site, url, norm_url FROM k) x USING (site, url) LEFT JOIN mg ON mg.site = pg.site AND mg.norm_url = x.norm_url""")  # fmt: skip
def j01(spark: SparkSession, d: str) -> DataFrame:
    c = inputs.candidates(spark, d)
    pages = c.where("url like 'http%'").select("site", "url").distinct()
    links = c.where("url like '%/docs/%'").select("site", F.concat("url", F.lit("#x")).alias("link"))
    return IX.page_signals(pages, FR.merge_duplicates(c), links)


@query(
    "t09_enrich_requests",
    f"""WITH {_DETAIL} SELECT e.site, ord, e.url, sha256('URL: ' || e.url || chr(10) || 'Title: ' || coalesce({_cleaned("title")}, '') || chr(10) || 'Description: ' || coalesce({_cleaned("description")}, '') || chr(10) || chr(10) || left(markdown, 4000)) AS prompt
FROM ent e JOIN det USING (site, url) WHERE trim(markdown) <> ''""",
)
def t09(spark: SparkSession, d: str) -> DataFrame:
    """Of several pages with one URL the first by page_id that has a body; the SQL leaves it open which."""
    pages = _snap(spark, d)
    return IX.enrich_requests(IX.ordered_entries(pages), pages).withColumn("prompt", F.sha2("prompt", 256))


_RESPONSE = "CASE page_id % 5 WHEN 0 THEN '{\"title\": \" T' || page_id || ' \", \"description\": \"D\"}' WHEN 1 THEN '{\"title\": 7, \"description\": \"\"}' WHEN 2 THEN 'not json' WHEN 3 THEN '{\"description\": \"only\"}' ELSE NULL END"


@query("t10_parse_summaries", "SELECT page_id AS url, CASE page_id % 5 WHEN 0 THEN 'T' || page_id END AS title, CASE page_id % 5 WHEN 0 THEN 'D' WHEN 3 THEN 'only' END AS description FROM pages")
def t10(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/pages.parquet").select(F.lit("s").alias("site"), F.col("page_id").alias("url"), F.expr(_RESPONSE).alias("response"))
    return IX.parse_summaries(rows).drop("site")


@query("j15_apply_summaries", f"WITH {_SNAP} SELECT DISTINCT site, url, CASE WHEN page_id % 5 = 0 THEN 'T' || page_id ELSE title END AS title, CASE page_id % 5 WHEN 0 THEN 'D' WHEN 3 THEN 'only' ELSE description END AS description FROM snap WHERE page_id % 29 <> 0")
def j15(spark: SparkSession, d: str) -> DataFrame:
    pages = inputs.snapshots(spark, d).where("page_id % 29 <> 0")
    summaries = IX.parse_summaries(pages.select("site", "url", F.expr(_RESPONSE).alias("response")))
    return IX.apply_summaries(pages.select("site", "url", "title", "description"), summaries).distinct()


# ---------------------------------------------------------------- diffs
def _two_runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Artifacts of two runs: the first lacks every seventh page, the second every fifth and has other titles."""
    pages = _snap(spark, d)
    out = []
    for run in (1, 2):
        rows = pages.where("page_id % 7 <> 0") if run == 1 else pages.where("page_id % 5 <> 0").withColumn("title", F.when(F.col("page_id") % 3 == 0, F.concat("title", F.lit(" [new]"))).otherwise(F.col("title")))
        described, header = _described(rows)
        out.append(cut(IX.render_index(described, header), "artifacts"))
    return out[0], out[1]


@query("t07_parse_index", f"WITH {_DESCRIBED} SELECT site, section, url, label AS title, description, optional FROM des")
def t07(spark: SparkSession, d: str) -> DataFrame:
    pages = _snap(spark, d)
    described, header = _described(pages)
    return D.parse_index(IX.render_index(described, header), keys=("site",)).select("site", "section", "url", "title", "description", "optional")


def _diff_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old, new = _two_runs(spark, d)
    return cut(D.parse_index(old, keys=("site",)), "old"), cut(D.parse_index(new, keys=("site",)), "new")


def _entries_of(where: str) -> str:
    """The index entries of the pages that a condition leaves, as a query of its own."""
    some = _ORDERED.replace("FROM snap0)", f"FROM snap0 WHERE {where})")
    return f"(WITH {some} SELECT site, section, url FROM ent)"


_OLD_NEW = f"""o AS {_entries_of("page_id % 7 <> 0")}, n AS {_entries_of("page_id % 5 <> 0")}"""


@query(
    "u02_key_set_ops",
    f"""WITH {_OLD_NEW}, ok AS (SELECT DISTINCT site, url FROM o), nk AS (SELECT DISTINCT site, url FROM n)
SELECT site, count(*) AS n, 'added' AS kind FROM (SELECT * FROM nk EXCEPT SELECT * FROM ok) GROUP BY site
UNION ALL SELECT site, count(*), 'removed' FROM (SELECT * FROM ok EXCEPT SELECT * FROM nk) GROUP BY site
UNION ALL SELECT site, count(*), 'common' FROM (SELECT * FROM nk INTERSECT SELECT * FROM ok) GROUP BY site
UNION ALL SELECT site, count(*), 'union' FROM (SELECT * FROM nk UNION SELECT * FROM ok) GROUP BY site""",
)
def u02(spark: SparkSession, d: str) -> DataFrame:
    old, new = (x.select("site", "key").distinct() for x in _diff_sides(spark, d))
    parts = [("added", new.exceptAll(old)), ("removed", old.exceptAll(new)), ("common", new.intersect(old)), ("union", new.union(old).distinct())]
    out = None
    for name, part in parts:
        rows = part.groupBy("site").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "a10_sections_delta",
    f"""WITH {_OLD_NEW}, b AS (SELECT site, section, count(*) AS k FROM n GROUP BY ALL UNION ALL SELECT site, section, -count(*) FROM o GROUP BY ALL)
SELECT site, section, CAST(sum(k) AS BIGINT) AS delta FROM b GROUP BY 1, 2 HAVING sum(k) <> 0""",
)
def a10(spark: SparkSession, d: str) -> DataFrame:
    old, new = _diff_sides(spark, d)
    return D.sections_delta(new, old)


_HISTORY = f"""h AS MATERIALIZED ({inputs.for_duckdb(inputs.HISTORY)}), hr AS MATERIALIZED ({inputs.for_duckdb(inputs.HISTORY_RUNS)}),
done AS (SELECT *, CASE WHEN lag(status) OVER w IS NULL THEN NULL ELSE lag(status) OVER w = 'completed' END AS previous_run_completed,
  last_value(CASE WHEN status = 'completed' THEN run_id END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM hr WINDOW w AS (PARTITION BY site ORDER BY at_s, run_id)),
pr AS MATERIALIZED (SELECT c.*, CASE WHEN p.has_index THEN p.run_id END AS compared_to_run_id, p.has_index AND p.enrich_applied IS NOT NULL AND p.enrich_applied <> c.enrich_applied AS flip, CASE WHEN p.has_index THEN p.hashed END AS was_hashed, CASE WHEN p.has_index THEN p.urls_discovered END AS was_discovered
  FROM done c LEFT JOIN hr p ON p.site = c.site AND p.run_id = c.prev WHERE c.status = 'completed' AND c.has_index),
cu AS (SELECT pr.site, pr.run_id, h.url, h.title, h.description, h.section, h.hash FROM pr JOIN h ON h.site = pr.site AND h.run_id = pr.run_id WHERE compared_to_run_id IS NOT NULL),
pv AS (SELECT pr.site, pr.run_id, h.url, h.title, h.description, h.section, h.hash FROM pr JOIN h ON h.site = pr.site AND h.run_id = pr.compared_to_run_id),
df AS MATERIALIZED (SELECT coalesce(cu.site, pv.site) AS site, coalesce(cu.run_id, pv.run_id) AS run_id, coalesce(cu.url, pv.url) AS url, coalesce(cu.title, pv.title) AS title, CASE WHEN pv.url IS NULL THEN 'added' WHEN cu.url IS NULL THEN 'removed' WHEN cu.title IS DISTINCT FROM pv.title OR cu.description IS DISTINCT FROM pv.description THEN 'changed' ELSE 'same' END AS change,
  cu.hash <> pv.hash AS moved, cu.section AS cs, pv.section AS ps FROM cu FULL JOIN pv ON pv.site = cu.site AND pv.run_id = cu.run_id AND pv.url = cu.url)"""


def _sample_sql(where: str) -> str:
    return f"(SELECT string_agg(url || ' ' || left(title, 120), '|' ORDER BY url) FROM (SELECT * FROM df WHERE df.site = pr.site AND df.run_id = pr.run_id AND {where} ORDER BY url LIMIT 10))"


def _count_sql(where: str) -> str:
    return f"CASE WHEN compared_to_run_id IS NOT NULL THEN (SELECT count(*) FROM df WHERE df.site = pr.site AND df.run_id = pr.run_id AND {where}) END"


def _shown(sample: str) -> F.Column:
    return F.array_join(F.transform(sample, lambda x: F.concat_ws(" ", x["url"], x["title"])), "|")


@query(
    "t08_build_index_diff",
    f"""WITH {_HISTORY}, r AS (SELECT site, run_id, CASE WHEN compared_to_run_id IS NULL THEN 'first_run' ELSE 'compared' END AS state, previous_run_completed, compared_to_run_id, {_count_sql("change = 'added'")} AS pages_added, {_count_sql("change = 'removed'")} AS pages_removed,
  CASE WHEN NOT coalesce(flip, false) THEN {_count_sql("change = 'changed'")} END AS metadata_changed, CASE WHEN flip THEN CASE WHEN enrich_applied THEN 'enrichment_enabled' ELSE 'enrichment_disabled' END END AS metadata_not_comparable_reason,
  CASE WHEN was_hashed THEN {_count_sql("moved")} END AS content_changed, {_count_sql("change IN ('added', 'removed')")} AS selection_churn, {_count_sql("true")} AS n_keys, urls_discovered - was_discovered AS urls_discovered_delta,
  (SELECT string_agg(section || '=' || n, ',' ORDER BY section) FROM (SELECT section, sum(n) AS n FROM (SELECT cs AS section, 1 AS n FROM df WHERE df.site = pr.site AND df.run_id = pr.run_id AND cs IS NOT NULL UNION ALL SELECT ps, -1 FROM df WHERE df.site = pr.site AND df.run_id = pr.run_id AND ps IS NOT NULL) GROUP BY section HAVING sum(n) <> 0)) AS sections_delta,
  {_sample_sql("change = 'added'")} AS added, {_sample_sql("change = 'removed'")} AS removed, CASE WHEN NOT coalesce(flip, false) THEN {_sample_sql("change = 'changed'")} END AS changed, CASE WHEN was_hashed THEN {_sample_sql("moved")} END AS moved FROM pr)
SELECT * EXCLUDE (n_keys), round(selection_churn::DOUBLE / nullif(n_keys, 0), 4) AS selection_churn_ratio,
  state = 'first_run' OR coalesce(pages_added, 0) + coalesce(pages_removed, 0) + coalesce(metadata_changed, 0) + coalesce(content_changed, 0) > 0 AS index_changed FROM r""",
)
def t08(spark: SparkSession, d: str) -> DataFrame:
    """The record of every completed run of a history of five runs a site."""
    runs, entries = inputs.history(spark, d)
    out = D.history_diffs(runs, entries.select("site", "run_id", U.normalize_url("url").alias("key"), "hash"))
    counts = [F.col(c) for c in ("pages_added", "pages_removed", "metadata_changed", "content_changed")]
    deltas = F.array_join(F.transform(F.map_entries("sections_delta"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select(
        "site", "run_id", "state", "previous_run_completed", "compared_to_run_id", "pages_added", "pages_removed", "metadata_changed", "metadata_not_comparable_reason", "content_changed", "selection_churn", "selection_churn_ratio", "urls_discovered_delta",
        deltas.alias("sections_delta"), _shown("added_sample").alias("added"), _shown("removed_sample").alias("removed"), _shown("metadata_changed_sample").alias("changed"), _shown("content_changed_sample").alias("moved"),
        D.index_changed(F.col("state"), *counts).alias("index_changed"),
    )


@query(
    "p25_change_summary",
    f"""WITH {_HISTORY}, c AS (SELECT site, run_id, compared_to_run_id, {_count_sql("change = 'added'")} AS a, {_count_sql("change = 'removed'")} AS r, CASE WHEN NOT coalesce(flip, false) THEN {_count_sql("change = 'changed'")} END AS m, CASE WHEN was_hashed THEN {_count_sql("moved")} END AS x FROM pr),
s AS (SELECT *, list_filter([CASE WHEN a > 0 THEN a || ' page' || CASE WHEN a = 1 THEN '' ELSE 's' END || ' added' END, CASE WHEN r > 0 THEN r || ' page' || CASE WHEN r = 1 THEN '' ELSE 's' END || ' removed' END,
  CASE WHEN m > 0 THEN 'titles or descriptions changed' END, CASE WHEN x > 0 THEN 'page content changed' END], lambda y: y IS NOT NULL) AS p FROM c)
SELECT site, run_id, CASE WHEN compared_to_run_id IS NULL THEN 'First generated index for this site.' WHEN len(p) = 0 THEN 'The generated index changed.'
  ELSE upper(left(t, 1)) || substr(t, 2) || '.' END AS summary FROM (SELECT *, CASE WHEN len(p) > 1 THEN array_to_string(p[:-2], ', ') || ' and ' || p[-1] ELSE p[1] END AS t FROM s)""",
)
def p25(spark: SparkSession, d: str) -> DataFrame:
    runs, entries = inputs.history(spark, d)
    out = D.history_diffs(runs, entries.select("site", "run_id", U.normalize_url("url").alias("key"), "hash"))
    return out.select("site", "run_id", D.change_summary(*(F.col(c) for c in ("state", "pages_added", "pages_removed", "metadata_changed", "content_changed"))).alias("summary"))


@query("j03_index_diff", f"WITH {_HISTORY} SELECT site, run_id, url AS key, change, title, cs AS c_section, ps AS p_section FROM df")
def j03(spark: SparkSession, d: str) -> DataFrame:
    """Each run's index joined with the completed one's before it, key by key."""
    runs, _ = inputs.history(spark, d)
    pairs = cut(D.history_pairs(runs).where("previous is not null"), "pairs")
    sides = [D.last_by_key(D.parse_index(pairs.select("site", "run_id", F.col(c).alias("t")), "t")) for c in ("llms_txt", "previous.llms_txt")]
    return D.index_diff_join(*sides, keys=("site", "run_id")).select("site", "run_id", "key", "change", "title", "c_section", "p_section")


_HASHED = f"hs AS (SELECT site, url, page_id, substr(sha256(markdown), 1, 16) AS h1, substr(sha256(CASE WHEN page_id % 11 = 0 THEN markdown || '!' ELSE markdown END), 1, 16) AS h2 FROM snap WHERE regexp_matches(markdown, '[^\\s]') AND page_id % 29 <> 0)"


@query("a12_content_hashes", f"WITH {_SNAP}, {_HASHED} SELECT site, url AS key, h1 AS hash FROM hs")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return D.content_hashes(_snap(spark, d).where("page_id % 29 <> 0"), keys=("site",), ordinal="page_id")


@query("j04_content_changed", f"WITH {_SNAP}, {_HASHED} SELECT site, url AS key FROM hs WHERE h1 <> h2")
def j04(spark: SparkSession, d: str) -> DataFrame:
    pages = _snap(spark, d).where("page_id % 29 <> 0")
    later = pages.withColumn("markdown", F.when(F.col("page_id") % 11 == 0, F.concat("markdown", F.lit("!"))).otherwise(F.col("markdown")))
    hashes, before = (D.content_hashes(x, keys=("site",), ordinal="page_id") for x in (later, pages))
    same = hashes.select("site", "key", F.lit("same").alias("change"))
    return D.content_changed(same, hashes, before)
