"""Frontier operators: candidates merged, judged by ordered rules, scored, ranked and cut at a limit per site.

Candidates have site, seed, url, lastmod and priority. All joins and groupings are on the site or on the site
and a normalised URL, after duplicates are merged, so that a large site's rows are small and few by then. Ranks
are total orders that end in the URL: results do not depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteloom.functions import urls as U
from siteloom.ranks import running, top
from siteloom.tables import cut

#: The drop rules in their order, and the score's weights.
RULES = ["unparseable", "duplicate", "seed", "off_origin", "robots_disallowed", "dated_archive", "taxonomy", "pagination", "feed", "changelog", "localized_duplicate", "over_limit"]
DEPTH, DOC, ROOT, PRIORITY, LASTMOD, DEFAULT_PRIORITY = 1.0, 4.0, 6.0, 2.0, 0.4, 0.5


def normalized(candidates: DataFrame) -> DataFrame:
    """Adds c, the struct of the normalised candidate (null if the URL cannot be parsed).

    A generator's row is computed once; filters on c do not parse the URL again below it.
    """
    return candidates.select("*", F.explode(F.array(U.candidate("url"))).alias("c"))


def merge_duplicates(candidates: DataFrame) -> DataFrame:
    """One row per site and normalised URL: the largest priority, the latest lastmod and how many rows were merged."""
    return merged_candidates(candidates).drop("c", "s")


def merged_candidates(candidates: DataFrame) -> DataFrame:
    """merge_duplicates with the structs of the candidate (c) and of its site's seed (s)."""
    rows = normalized(candidates).withColumn("norm_url", F.col("c.url")).where("norm_url is not null")
    merged = rows.groupBy("site", "seed", "norm_url").agg(F.max("priority").alias("priority"), F.max("lastmod").alias("lastmod"), (F.count("*") - 1).alias("duplicates"), F.first("c").alias("c"))
    seeds = candidates.select("site", "seed").distinct().select("site", "seed", F.explode(F.array(U.candidate("seed"))).alias("s"))
    return merged.join(seeds, (merged["site"] == seeds["site"]) & merged["seed"].eqNullSafe(seeds["seed"])).drop(seeds["site"], seeds["seed"])


def pre_filter_rule(c: Column, seed: Column, allowed: Column) -> Column:
    """The first rule that drops a merged candidate before ranking, or null."""
    return (
        F.when(c["url"] == seed["url"], "seed")
        .when(seed.isNull() | (U.candidate_origin(c) != U.candidate_origin(seed)), "off_origin")
        .when(~allowed, "robots_disallowed")
        .when(U.is_dated_archive(c["path"]), "dated_archive")
        .when(U.is_taxonomy(c["path"]), "taxonomy")
        .when(U.is_pagination(c["path"], c["query"]), "pagination")
        .when(U.is_feed(c["path"]), "feed")
        .when(U.is_changelog(c["path"]), "changelog")
    )


def recency(lastmod: Column, earliest: Column, latest: Column) -> Column:
    span = F.unix_micros(latest) - F.unix_micros(earliest)
    return F.when(lastmod.isNotNull() & (span > 0), (F.unix_micros(lastmod) - F.unix_micros(earliest)) / span - 0.5).otherwise(0.0)


def url_score(path: Column, priority: Column, lastmod: Column, earliest: Column, latest: Column) -> Column:
    depth = U.depth(path)
    return -DEPTH * depth + F.when(U.has_doc_segment(path), DOC).otherwise(0.0) + F.when(depth == 0, ROOT).otherwise(0.0) + PRIORITY * F.coalesce(priority - DEFAULT_PRIORITY, F.lit(0.0)) + LASTMOD * recency(lastmod, earliest, latest)


def judged(candidates: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Merged candidates with c, rule (null for survivors) and score (null for dropped ones).

    allowed: (site, norm_url) pairs with a boolean `allowed`, from the robots join; missing pairs are allowed.
    The survivors' range of lastmod is grouped by site and joined, instead of a window over whole sites.
    """
    merged = merged_candidates(candidates)
    merged = merged.join(allowed.select("site", "norm_url", "allowed"), ["site", "norm_url"], "left") if allowed is not None else merged.withColumn("allowed", F.lit(True))
    merged = merged.withColumn("rule", pre_filter_rule(F.col("c"), F.col("s"), F.coalesce("allowed", F.lit(True)))).drop("allowed", "s")
    spans = merged.where("rule is null").groupBy("site").agg(F.min("lastmod").alias("earliest"), F.max("lastmod").alias("latest"))
    scored = merged.join(spans, "site", "left")
    score = url_score(F.col("c.path"), F.col("priority"), F.col("lastmod"), F.col("earliest"), F.col("latest"))
    return scored.withColumn("score", F.when(F.col("rule").isNull(), score)).drop("earliest", "latest")


def select_urls(candidates: DataFrame, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """One row per merged candidate: site, norm_url, duplicates, rule (null if selected), score and rank.

    A locale variant goes if its base is selected. In set terms: a survivor is a variant if its base survives,
    ranks earlier and is no variant itself. So it is one if an odd number of links to earlier bases follow one
    another from it. Links are counted by doubling: a round joins each URL with the one that its counted links
    lead to, and as many rounds are run as the most language segments at the front of a survivor's path need.
    The first `limit` others of a site are selected; a variant counts as localized_duplicate if its base is
    selected, else as over_limit. Rows are compared by score and URL where their order matters, and only the
    first `limit` are ranked, in two steps, so that a site's rows never meet in one task.
    """
    alive = F.col("rule").isNull()
    rows = judged(candidates, allowed).withColumn("base", F.when(alive, U.delocalized_url(F.col("c")))).withColumn("languages", F.when(alive, U.leading_languages(F.col("c.path")))).drop("c")
    rows = cut(rows, "judged")
    ranked = rows.where(alive).select("site", "norm_url", "score", "base")
    longest = rows.agg(F.max("languages")).first()[0] or 0
    bases = ranked.select("site", F.col("norm_url").alias("base"), F.col("score").alias("base_score"))
    earlier = (F.col("base_score") > F.col("score")) | ((F.col("base_score") == F.col("score")) & (F.col("base") < F.col("norm_url")))
    linked = F.coalesce(earlier, F.lit(False))
    variants = ranked.join(bases, ["site", "base"], "left").select("site", "norm_url", "score", "base", linked.alias("dup"), F.when(linked, F.col("base")).alias("to"))
    for _ in range(max(longest - 1, 0).bit_length()):
        variants = cut(variants, "links")
        ends = variants.where("dup or to is not null").select("site", F.col("norm_url").alias("to"), F.col("dup").alias("to_dup"), F.col("to").alias("next"))
        variants = variants.join(ends, ["site", "to"], "left").select("site", "norm_url", "score", "base", (F.col("dup") != F.coalesce("to_dup", F.lit(False))).alias("dup"), F.col("next").alias("to"))
    kept = cut(variants.select("site", "norm_url", "score", "base", "dup"), "variants")
    chosen = top(kept.where("not dup"), ["site"], [F.desc("score"), F.asc("norm_url")], limit, ["norm_url"]).select("site", "norm_url", "rank")
    bases = chosen.select("site", F.col("norm_url").alias("base"), F.lit(True).alias("base_chosen"))
    late = kept.join(chosen, ["site", "norm_url"], "left").join(bases, ["site", "base"], "left")
    rule = F.when(F.col("dup") & F.col("base_chosen").isNotNull(), "localized_duplicate").when(F.col("rank").isNull(), "over_limit")
    out = rows.join(late.select("site", "norm_url", rule.alias("late_rule"), "rank"), ["site", "norm_url"], "left").withColumn("rule", F.coalesce("rule", "late_rule"))
    return out.select("site", "norm_url", "duplicates", "rule", "score", F.when(F.col("rule").isNull(), F.col("rank")).cast("long").alias("rank"))


def drop_funnel(candidates: DataFrame, selected: DataFrame) -> DataFrame:
    """(site, rule, n) for every rule that dropped something, and `selected`: their sum is what was discovered."""
    broken = normalized(candidates).where("c is null").groupBy("site").agg(F.count("*").alias("n")).select("site", F.lit("unparseable").alias("rule"), "n")
    doubled = selected.groupBy("site").agg(F.sum("duplicates").alias("n")).where("n > 0").select("site", F.lit("duplicate").alias("rule"), "n")
    judged_rows = selected.groupBy("site", F.coalesce("rule", F.lit("selected")).alias("rule")).agg(F.count("*").alias("n"))
    return broken.unionByName(doubled).unionByName(judged_rows)


def first_occurrence_capped(rows: DataFrame, key: list[str], value: str, pos: str, cap: int) -> DataFrame:
    """Each value's first place within its key, in order, at most cap of them."""
    first = rows.groupBy(*key, value).agg(F.min(pos).alias(pos))
    return top(first, key, [F.asc(pos), F.asc(value)], cap, [value])


def discovery_precedence(entries: DataFrame) -> DataFrame:
    """Rows of the first entry point of a site that yielded any: sitemap, sitemap_index, robots, links."""
    rank = F.array_position(F.array(*map(F.lit, ["sitemap", "sitemap_index", "robots", "links"])), F.col("entry_source"))
    best = entries.groupBy("site").agg(F.min(F.when(rank > 0, rank)).alias("best"))
    return entries.join(best, "site").where(rank == F.col("best")).drop("best")


def effective_crawl_delay_ms(configured: int, delay_s: Column, most: int = 10_000) -> Column:
    return F.greatest(F.lit(configured).cast("long"), F.coalesce(F.least((delay_s * 1000).cast("long"), F.lit(most).cast("long")), F.lit(0).cast("long")))


def fetch_plan(selected: DataFrame, max_pages: int, max_bytes: int, delay_ms: Column, max_ms: int) -> DataFrame:
    """Selected rows (site, norm_url, rank, bytes) with slot_ms, cumulative bytes and the cap that stops them, if any."""
    out = running(selected, "fetch-order", ["site"], ["rank"], {"bytes_before": F.col("bytes")}).withColumn("slot_ms", (F.col("rank") - 1) * delay_ms)
    cap = F.when(F.col("rank") > max_pages, "max_pages").when(F.col("bytes_before") >= max_bytes, "max_bytes").when(F.col("slot_ms") >= max_ms, "max_duration")
    return out.withColumn("cap_hit", cap)
