"""Curated-index construction: page scores, dedup, main and optional parts, order, descriptions and artifacts.

Pages have site, origin, url, status, title, description, markdown, is_empty and the signals linked_from_seed,
priority and lastmod. Selection reads URLs, markdown and signals only, never titles or descriptions. Ranking
runs on narrow rows: bodies stay out of the windows and are joined back by (site, url) for the artifacts. Of
several pages with one URL the first by page_id (if pages have one) gives its title, description and body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import urls as U
from siteloom.operators.frontier import recency
from siteloom.ranks import numbered, running, top
from siteloom.tables import cut

#: Fixed values.
MAIN_LINKS, SECTION_LEAST, BOILERPLATE_PAGES, FINGERPRINT_CHARS = 30, 2, 3, 2000
PAGE_BYTES, FULL_BYTES, RESERVE_BYTES = 50 * 1024, 5 * 1024 * 1024, 256
PAGE_NOTICE = f"\n\n_[Truncated: this page exceeded the {PAGE_BYTES // 1024} KB per-page limit.]_"
EMPTY_NOTICE = "_[No page content was extracted.]_"


def page_score(path: Column, section: Column, length: Column, optional: Column, seed_link: Column, priority: Column, lastmod: Column, earliest: Column, latest: Column) -> Column:
    buckets = sum(((length >= n).cast("int") for n in (500, 2000, 8000)), F.lit(0))
    score = 4.0 / (1 + U.depth(path)) + F.when(seed_link, 8.0).otherwise(0.0) + T.section_weight(section) + 2.0 * (buckets / 3) + 2.0 * F.coalesce(priority - 0.5, F.lit(0.0)) + 0.4 * recency(lastmod, earliest, latest)
    return F.when(optional, score - 1000.0).otherwise(score)


def scored(pages: DataFrame) -> DataFrame:
    """The candidates among the pages (2xx, not empty, on their origin) with section, optional, depth, fp, score."""
    path = U.with_parts("url", lambda p: p["path"])
    rows = pages.where((F.col("status") >= 200) & (F.col("status") < 300) & ~F.col("is_empty") & U.origin_key("url", "index").eqNullSafe(U.origin_key("origin", "index")))
    rows = rows.select(
        "site", "origin", "url", "lastmod", "priority", "linked_from_seed",
        F.length("markdown").alias("length"),
        F.sha2(F.substring("markdown", 1, FINGERPRINT_CHARS), 256).alias("fp"),
        T.section_for(F.col("url"), F.col("origin")).alias("section"),
        T.is_always_optional(F.col("url")).alias("always_optional"),
        path.alias("path"),
    )
    rows = cut(rows, "candidates").withColumn("depth", U.depth(F.col("path")))
    spans = rows.groupBy("site").agg(F.min("lastmod").alias("earliest"), F.max("lastmod").alias("latest"))
    rows = rows.join(spans, "site")
    score = page_score(F.col("path"), F.col("section"), F.col("length"), F.col("always_optional"), F.coalesce("linked_from_seed", F.lit(False)), F.col("priority"), F.col("lastmod"), F.col("earliest"), F.col("latest"))
    return rows.withColumn("score", score).select("site", "origin", "url", "fp", "section", "always_optional", "depth", "score")


def dedupe(rows: DataFrame) -> DataFrame:
    """The best page of each fingerprint of a site, with how many it stands for."""
    best = F.min(F.struct((-F.col("score")).alias("s"), "depth", "url", "origin", "section", "always_optional")).alias("best")
    firsts = rows.groupBy("site", "fp").agg(best, F.count("*").alias("copies"))
    return firsts.select("site", "fp", "best.url", "copies", "best.origin", "best.section", "best.always_optional", "best.depth", (-F.col("best.s")).alias("score"))


def ordered_entries(pages: DataFrame) -> DataFrame:
    """Index entries: site, ord, section, url, optional, score, copies - main by section, then optional by rank."""
    kept = cut(dedupe(scored(pages)), "deduped")
    first = top(kept, ["site", "always_optional"], [F.desc("score"), F.asc("url"), F.asc("fp")], MAIN_LINKS, ["fp"]).select("site", "fp", F.lit(True).alias("first"))
    kept = kept.join(first, ["site", "fp"], "left")
    has_main = kept.where("not always_optional").select("site").distinct().withColumn("has_main", F.lit(True))
    kept = kept.join(has_main, "site", "left")
    optional = F.col("first").isNull() | (F.col("always_optional") & F.coalesce("has_main", F.lit(False)))
    kept = kept.withColumn("optional", optional)
    sizes = kept.where("not optional").groupBy("site", "section").agg(F.count("*").alias("size"))
    kept = kept.join(sizes, ["site", "section"], "left")
    folds = ~F.col("section").isin([*T.SECTION_ORDER, T.OTHER]) & (F.col("size") < SECTION_LEAST)
    section = F.when(F.col("optional"), T.OPTIONAL).when(folds, T.OTHER).otherwise(F.col("section"))
    kept = kept.withColumn("section", section).withColumn("srank", F.when(F.col("optional"), 99).otherwise(T.section_rank(section)))
    order = ["optional", "srank", "section", F.desc("score"), "url", "fp"]
    return numbered(kept, "entry-order", ["site"], order, "ord").select("site", "ord", "section", "url", "optional", "score", "copies")


def index_counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("site").agg(F.count_if(~F.col("optional")).alias("links_main"), F.count_if("optional").alias("links_optional"), F.sum(F.col("copies") - 1).alias("links_duplicate"))


def first_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """(site, url, *columns): one page of each URL of a site, the first by page_id where the pages have one.

    What equal ids leave open the columns decide, so that every reading takes the same page.
    """
    order = [c for c in ("page_id",) if c in pages.columns]
    return pages.groupBy("site", "url").agg(F.min(F.struct(*order, *columns)).alias("first")).select("site", "url", *(f"first.{c}" for c in columns))


def _plates(rows: DataFrame) -> DataFrame:
    """(site, norm) of rows(site, norm), one an entry, where three or more have it."""
    return rows.where("norm <> ''").groupBy("site", "norm").agg(F.count("*").alias("n")).where(F.col("n") >= BOILERPLATE_PAGES).select("site", "norm")


def boilerplate(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """(site, norm): normalised descriptions on three or more entries of a site.

    Of several pages with one URL the first that has a description gives it.
    """
    norm = F.lower(T.collapse(F.col("description")))
    return _plates(entries.join(first_pages(pages.withColumn("norm", norm).where("norm <> ''"), "norm"), ["site", "url"]))


def site_header(pages: DataFrame) -> DataFrame:
    """(site, project_name, site_sentence, prose): of each site's first root page, or the origin alone.

    Of root pages that are alike in URL, title and description one that has a body comes before one that has none.
    """
    root = pages.where(T.is_root(F.col("url"), F.col("origin"))).groupBy("site").agg(F.min(F.struct("url", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), F.isnull("markdown").alias("bare"), "markdown")).alias("root"))
    sites = pages.groupBy("site").agg(F.min("origin").alias("origin")).join(root, "site", "left")
    blocks = F.filter(F.transform(F.split("root.markdown", "\n\n"), T.collapse), lambda b: (b != "") & ~b.rlike(r"^#{1,6}(\s|$)"))
    sites = cut(sites.withColumn("blocks", blocks), "roots")
    described = T.clean_text(T.whole_sentence(T.collapse(F.nullif(F.trim("root.description"), F.lit(""))), T.SITE_WORDS))
    first = T.clean_text(T.whole_sentence(F.try_element_at("blocks", F.lit(1)), T.SITE_WORDS))
    sites = sites.withColumn("site_sentence", F.coalesce(described, first))
    prose = F.transform(F.filter("blocks", T.qualifies_as_prose), lambda b: T.clean_text(T.whole_paragraph_or_sentence(b, T.PROSE_WORDS)))
    prose = F.filter(prose, lambda b: b.isNotNull() & ~T.near_identical(b, F.col("site_sentence")))
    return sites.select("site", "origin", F.coalesce(T.clean_text(F.nullif(F.col("root.title"), F.lit(""))), "origin").alias("project_name"), "site_sentence", F.try_element_at(prose, F.lit(1)).alias("prose"))


def described_entries(entries: DataFrame, pages: DataFrame, header: DataFrame) -> DataFrame:
    """Entries with label and description; bodies are left out."""
    details = first_pages(pages, "title", "description")
    rows = entries.join(details, ["site", "url"]).withColumn("norm", F.lower(T.collapse(F.col("description"))))
    plate = _plates(rows).withColumn("plate", F.lit(True))
    rows = rows.join(plate, ["site", "norm"], "left").join(header.select("site", "site_sentence"), "site", "left")
    label = T.label_for(F.col("title"), F.col("url"))
    rows = cut(rows.withColumn("label", label), "labelled")
    text = T.describe(F.col("description"), F.col("label"), F.coalesce("plate", F.lit(False)), F.col("site_sentence"))
    return rows.select("site", "ord", "section", "url", "optional", "label", text.alias("description"))


def page_count(n: Column) -> Column:
    return F.when(n == 1, F.lit("1 page")).otherwise(F.concat(n.cast("string"), F.lit(" pages")))


def bullet(label: Column, url: Column, description: Column) -> Column:
    return F.concat(F.lit("- ["), T.escape_label(label), F.lit("]("), T.escape_target(url), F.lit(")"), F.when(description.isNotNull(), F.concat(F.lit(": "), description)).otherwise(F.lit("")))


def render_index(described: DataFrame, header: DataFrame) -> DataFrame:
    """(site, llms_txt): H1, blockquote, prose, then sections of bullets. A site has at most its page cap of entries."""
    order = Window.partitionBy("site").orderBy("ord")
    heading = F.when(~F.lag("section").over(order).eqNullSafe(F.col("section")), F.concat(F.lit("\n## "), F.col("section"), F.lit("\n\n"))).otherwise(F.lit(""))
    lines = described.withColumn("line", F.concat(heading, bullet(F.col("label"), F.col("url"), F.col("description"))))
    body = lines.groupBy("site").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("body"))
    rows = header.join(body, "site", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    quote = F.coalesce("site_sentence", F.concat(F.lit("An index of "), page_count(F.col("n")), F.lit(" from "), F.col("origin"), F.lit(".")))
    text = F.concat(F.lit("# "), F.col("project_name"), F.lit("\n\n> "), quote, F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), F.col("prose"), F.lit("\n")), F.lit("")), F.coalesce(F.concat(F.col("body"), F.lit("\n")), F.lit("")))
    return rows.select("site", text.alias("llms_txt"))


def empty_documents(sites: DataFrame, rendered: DataFrame, column: str = "llms_txt") -> DataFrame:
    """Every site of sites(site, origin) with its artifact, or the document that says that no page was fetched."""
    text = F.concat(F.lit("# "), F.col("origin"), F.lit("\n\n> No pages were fetched from "), F.col("origin"), F.lit(" during this run.\n"))
    return sites.join(rendered, "site", "left").select("site", F.coalesce(column, text).alias(column))


def cut_bytes(text: Column, most: int) -> Column:
    """The longest prefix of at most `most` UTF-8 bytes that ends between characters."""
    data = F.encode(text, "UTF-8")
    tries = [F.try_validate_utf8(F.substring(data, 1, most - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries))


def full_text_plan(described: DataFrame, pages: DataFrame, header: DataFrame, page_bytes: int = PAGE_BYTES, full_bytes: int = FULL_BYTES, reserve: int = RESERVE_BYTES) -> DataFrame:
    """Sections of the full-text artifact: site, ord, body_section, size, trimmed, used, kept.

    A page is cut at page_bytes. The document keeps the longest run of first sections within its budget.
    Bodies come from the pages that the labels come from, also where ids repeat: the same columns decide.
    """
    rows = described.join(first_pages(pages, "title", "description", "markdown").drop("title", "description"), ["site", "url"])
    trimmed = F.octet_length("markdown") > page_bytes
    body = F.when(trimmed, F.concat(cut_bytes(F.col("markdown"), page_bytes), F.lit(PAGE_NOTICE))).otherwise(F.col("markdown"))
    body = F.when(F.trim(body) == "", F.lit(EMPTY_NOTICE)).otherwise(body)
    rows = rows.withColumn("trimmed", trimmed).withColumn("body_section", F.concat(F.lit("\n## "), F.col("label"), F.lit("\n\n"), body, F.lit("\n"))).withColumn("size", F.octet_length("body_section").cast("long"))
    heads = full_header(described, header)
    narrow = rows.select("site", "ord", "size").join(heads.select("site", F.octet_length("head").alias("head_size")), "site")
    used = F.col("head_size") + F.col("before") + F.col("size")
    plan = running(narrow, "section-sizes", ["site"], ["ord"], {"before": F.col("size")}).withColumn("used", used).select("site", "ord", "used", (F.col("used") <= full_bytes - reserve).alias("kept"))
    return rows.select("site", "ord", "body_section", "size", "trimmed").join(plan, ["site", "ord"])


def full_header(described: DataFrame, header: DataFrame) -> DataFrame:
    n = described.groupBy("site").agg(F.count("*").alias("n"))
    rows = header.join(n, "site", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    quote = F.concat_ws(" ", "site_sentence", F.concat(F.lit("The full text of "), page_count(F.col("n")), F.lit(" from "), F.col("origin"), F.lit(".")))
    head = F.concat(F.lit("# "), F.col("project_name"), F.lit("\n\n> "), quote, F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), F.col("prose"), F.lit("\n")), F.lit("")))
    return rows.select("site", "n", head.alias("head"))


def render_full_text(plan: DataFrame, described: DataFrame, header: DataFrame, full_bytes: int = FULL_BYTES) -> DataFrame:
    """(site, llms_full_txt, truncated). The plan bounds what a site's row gathers."""
    kept = plan.where("kept").groupBy("site").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body_section"))), lambda x: x["body_section"]), "").alias("body"))
    cut = plan.groupBy("site").agg(F.count_if(~F.col("kept")).alias("omitted"), F.count_if(F.col("kept") & F.col("trimmed")).alias("trimmed"))
    rows = full_header(described, header).join(kept, "site", "left").join(cut, "site", "left")
    notice = F.when(F.col("omitted") > 0, F.concat(F.lit("\n_[Truncated: "), page_count(F.col("omitted")), F.lit(f" omitted at the {full_bytes // (1024 * 1024)} MB per-run limit.]_\n"))).otherwise(F.lit(""))
    text = F.concat(F.col("head"), F.coalesce("body", F.lit("")), F.coalesce(notice, F.lit("")))
    return rows.select("site", text.alias("llms_full_txt"), F.coalesce(F.col("omitted") + F.col("trimmed"), F.lit(0)).alias("truncated"))


def page_signals(pages: DataFrame, merged: DataFrame, seed_links: DataFrame) -> DataFrame:
    """pages(site, url) with the merged candidates' priority and lastmod, and whether the seed links there."""
    key = pages.withColumn("norm_url", U.normalize_url("url"))
    links = seed_links.select("site", U.normalize_url("link").alias("norm_url")).distinct().withColumn("hit", F.lit(True))
    out = key.join(merged.select("site", "norm_url", "priority", "lastmod"), ["site", "norm_url"], "left").join(links, ["site", "norm_url"], "left")
    return out.select(*pages.columns, "priority", "lastmod", F.coalesce("hit", F.lit(False)).alias("linked_from_seed"))


def apply_summaries(pages: DataFrame, summaries: DataFrame) -> DataFrame:
    """Titles and descriptions replaced where a summary row of the same URL has them."""
    s = summaries.select("site", "url", F.col("title").alias("new_title"), F.col("description").alias("new_description"))
    out = pages.join(s, ["site", "url"], "left").withColumn("title", F.coalesce("new_title", "title")).withColumn("description", F.coalesce("new_description", "description"))
    return out.select(pages.columns)


def enrich_requests(entries: DataFrame, pages: DataFrame, most: int = 4000) -> DataFrame:
    """(site, ord, url, prompt) for entries with a body, in artifact order.

    Of several pages with one URL the first that has a body is asked about.
    """
    details = first_pages(pages.where(F.trim("markdown") != ""), "title", "description", "markdown")
    rows = entries.join(details, ["site", "url"])
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(T.clean_text(F.col(c)), F.lit("")))
    prompt = F.concat_ws("\n", F.concat(F.lit("URL: "), F.col("url")), part("Title", "title"), part("Description", "description"), F.lit(""), F.substring("markdown", 1, most))
    return rows.select("site", "ord", "url", prompt.alias("prompt"))


def parse_summaries(responses: DataFrame) -> DataFrame:
    """(site, url, title, description) of JSON responses; values that aren't text, or are blank, are null."""
    v = F.try_parse_json("response")
    text = lambda k: F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{k}", "variant")) == "STRING", F.nullif(F.trim(F.try_variant_get(v, f"$.{k}", "string")), F.lit("")))
    return responses.select("site", "url", text("title").alias("title"), text("description").alias("description"))
