"""Index diffs: entries parsed back out of artifacts, and what changed between consecutive runs of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import urls as U
from siteloom.ranks import carried, top
from siteloom.tables import cut

SAMPLE, TITLE_CHARS, HASH_CHARS = 10, 120, 16
BULLET = r"^- \[((?:\\.|[^\]])*)\]\(([^)]*)\)(?:: (.*))?$"


def parse_index(artifacts: DataFrame, text: str = "llms_txt", keys: tuple[str, ...] = ("site", "run_id")) -> DataFrame:
    """(keys, pos, section, url, key, title, description, optional) of artifact texts; other lines are ignored."""
    lines = artifacts.select(*keys, F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("pos", "line"))
    section = F.when(F.col("line").startswith("## "), F.substr("line", F.lit(4)))
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.where(F.col("line").startswith("## ") | F.col("line").startswith("- [")).withColumn("section", F.coalesce(F.last(section, ignorenulls=True).over(order), F.lit("")))
    rows = rows.where(F.col("line").rlike(BULLET))
    url = T.unescape_target(F.regexp_extract("line", BULLET, 2))
    has_text = F.col("line").rlike(r"^- \[(?:\\.|[^\]])*\]\([^)]*\): ")
    return rows.select(
        *keys, "pos", "section", url.alias("url"), F.coalesce(U.normalize_url(url), url).alias("key"),
        T.unescape_label(F.regexp_extract("line", BULLET, 1)).alias("title"), F.when(has_text, F.regexp_extract("line", BULLET, 3)).alias("description"),
        (F.col("section") == T.OPTIONAL).alias("optional"),
    )


def last_by_key(entries: DataFrame, keys: tuple[str, ...] = ("site", "run_id")) -> DataFrame:
    """The last entry of each key in an artifact."""
    best = F.max(F.struct("pos", "section", "url", "title", "description")).alias("e")
    return entries.groupBy(*keys, "key").agg(best).select(*keys, "key", "e.section", "e.url", "e.title", "e.description")


def content_hash(markdown: Column) -> Column:
    return F.substring(F.sha2(markdown, 256), 1, HASH_CHARS)


def content_hashes(pages: DataFrame, keys: tuple[str, ...] = ("site", "run_id"), ordinal: str = "ord") -> DataFrame:
    """(keys, key, hash) of pages with a body; the last row of a key wins."""
    rows = pages.where(F.col("markdown").rlike(r"(?U)\S")).withColumn("key", F.coalesce(U.normalize_url("url"), F.col("url")))
    return rows.groupBy(*keys, "key").agg(F.max_by(content_hash(F.col("markdown")), ordinal).alias("hash"))


def index_diff_join(current: DataFrame, previous: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, key, change, title, url, ...) over the union of both sides' keys: added, removed, changed or same."""
    c = current.select(*keys, "key", *[F.col(x).alias(f"c_{x}") for x in ("section", "url", "title", "description")], F.lit(True).alias("in_c"))
    p = previous.select(*keys, "key", *[F.col(x).alias(f"p_{x}") for x in ("section", "url", "title", "description")], F.lit(True).alias("in_p"))
    same = F.col("c_title").eqNullSafe(F.col("p_title")) & F.col("c_description").eqNullSafe(F.col("p_description"))
    change = F.when(F.col("in_p").isNull(), "added").when(F.col("in_c").isNull(), "removed").when(~same, "changed").otherwise("same")
    return c.join(p, [*keys, "key"], "full_outer").select(*keys, "key", change.alias("change"), F.coalesce("c_title", "p_title").alias("title"), F.coalesce("c_url", "p_url").alias("url"), "c_section", "p_section")


def sections_delta(current: DataFrame, previous: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, section, delta) where an artifact's section gained or lost entries. Takes all entries, repeats too."""
    c = current.groupBy(*keys, "section").agg(F.count("*").alias("c"))
    p = previous.groupBy(*keys, "section").agg(F.count("*").alias("p"))
    delta = F.coalesce("c", F.lit(0)) - F.coalesce("p", F.lit(0))
    return c.join(p, [*keys, "section"], "full_outer").select(*keys, "section", delta.alias("delta")).where("delta <> 0")


def churn(diff: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, pages_added, pages_removed, metadata_changed, selection_churn, n_keys): counts over the union of keys."""
    n = lambda c: F.count_if(F.col("change") == c)
    return diff.groupBy(*keys).agg(n("added").alias("pages_added"), n("removed").alias("pages_removed"), n("changed").alias("metadata_changed"), (n("added") + n("removed")).alias("selection_churn"), F.count("*").alias("n_keys"))


def sample_top(diff: DataFrame, change: str, most: int = SAMPLE, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, sample): the first `most` keys' (url, title), titles cut."""
    rows = top(diff.where(F.col("change") == change), list(keys), [F.asc("key")], most, ["key"], "rn")
    item = F.struct("rn", "url", F.substring("title", 1, TITLE_CHARS).alias("title"))
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"))).alias(f"{change}_sample"))


def content_changed(diff: DataFrame, hashes: DataFrame, before: DataFrame, keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """(keys, key) of common keys whose hash differs between runs."""
    common = diff.where(F.col("change").isin("changed", "same")).select(*keys, "key")
    return common.join(hashes.select(*keys, "key", "hash"), [*keys, "key"]).join(before.select(*keys, "key", F.col("hash").alias("old")), [*keys, "key"]).where("hash <> old").select(*keys, "key")


def build_index_diff(runs: DataFrame) -> DataFrame:
    """The diff record of each site's newest run against the last completed one before it.

    runs has site, current and previous text, urls_discovered and previous_urls_discovered, enrich_applied and
    previous_enrich_applied; previous is null for a first run.
    """
    both = runs.where("previous is not null")
    sides = (parse_index(both.select("site", F.col(c).alias("t")), "t", ("site",)) for c in ("current", "previous"))
    return diff_records(runs, *sides, ("site",)).drop("content_changed", "content_changed_sample")


def history_pairs(runs: DataFrame) -> DataFrame:
    """Completed runs of a history (site, run_id, started_at, status, ...), each with the latest completed one before it.

    Adds previous_run_completed (null for a site's first run, else whether the run just before it completed) and
    previous, the struct of the earlier completed run, null if there is none or if it has no index.
    """
    held = [c for c in runs.columns if c not in ("site", "started_at", "status")]
    done = F.when(F.col("status") == "completed", F.struct(*held))
    pairs = carried(runs, "run-history", ["site"], ["started_at", "run_id"], {"before": F.struct("status"), "previous": done}).where("status = 'completed' and llms_txt is not null")
    previous = F.when(F.col("previous.llms_txt").isNotNull(), F.col("previous"))
    return pairs.select("site", *held, (F.col("before.status") == "completed").alias("previous_run_completed"), previous.alias("previous"))


def history_diffs(runs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The diff record of every completed run of every site against the completed run before it.

    runs: (site, run_id, started_at, status, llms_txt, urls_discovered, enrich_applied, hashed); hashed says
    whether the run's content hashes were kept. hashes: (site, run_id, key, hash). Each artifact is parsed once;
    a run's entries stand under its own number and, as the other side, under the next completed run's. So do its
    hashes, which are derived once.
    """
    pairs = cut(history_pairs(runs), "pairs")
    entries = cut(parse_index(pairs.select("site", "run_id", "llms_txt")), "entries")
    as_previous = pairs.where("previous is not null").select("site", F.col("previous.run_id").alias("run_id"), F.col("run_id").alias("next"))
    carry = lambda rows: rows.join(as_previous, ["site", "run_id"]).drop("run_id").withColumnRenamed("next", "run_id")
    compared = pairs.where("previous is not null").select("site", "run_id")
    hashes = cut(hashes, "hashes")
    now = entries.join(compared, ["site", "run_id"], "left_semi")
    flat = pairs.select(
        "site", "run_id", F.col("llms_txt").alias("current"), F.col("previous.llms_txt").alias("previous"), "urls_discovered", F.col("previous.urls_discovered").alias("previous_urls_discovered"),
        "enrich_applied", F.col("previous.enrich_applied").alias("previous_enrich_applied"), "previous_run_completed", F.col("previous.run_id").alias("compared_to_run_id"), F.col("previous.hashed").alias("previous_hashed"),
    )
    keys = ("site", "run_id")
    out = diff_records(flat, now, carry(entries), keys, hashes, carry(hashes))
    return out.join(flat.select(*keys, "previous_run_completed", "compared_to_run_id"), list(keys))


def diff_records(runs: DataFrame, now: DataFrame, old: DataFrame, keys: tuple[str, ...], hashes: DataFrame | None = None, before: DataFrame | None = None) -> DataFrame:
    """Diff records by keys out of both sides' entries and, if given, content hashes."""
    now, old = cut(now, "now"), cut(old, "old")
    diff = cut(index_diff_join(last_by_key(now, keys), last_by_key(old, keys), keys), "diff")
    delta = sections_delta(now, old, keys).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "delta")))).alias("sections_delta"))
    out = runs.join(churn(diff, keys), list(keys), "left").join(delta, list(keys), "left")
    for change in ("added", "removed", "changed"):
        out = out.join(sample_top(diff, change, keys=keys), list(keys), "left")
    compared = F.col("previous").isNotNull()
    zero = lambda c: F.when(compared, F.coalesce(c, F.lit(0)))
    content, shown = F.lit(None).cast("long"), F.lit(None).cast("array<struct<url:string,title:string>>")
    if hashes is not None:
        moved = content_changed(diff, hashes, before, keys).join(diff.select(*keys, "key", "url", "title"), [*keys, "key"]).withColumn("change", F.lit("content"))
        moved = cut(moved, "moved")
        out = out.join(moved.groupBy(*keys).agg(F.count("*").alias("moved")), list(keys), "left").join(sample_top(moved, "content", keys=keys), list(keys), "left")
        content, shown = F.when(F.col("previous_hashed"), zero("moved")), F.when(F.col("previous_hashed"), F.col("content_sample"))
    flip = compared & F.col("previous_enrich_applied").isNotNull() & (F.col("previous_enrich_applied") != F.col("enrich_applied"))
    return out.select(
        *keys,
        F.when(compared, "compared").otherwise("first_run").alias("state"),
        zero("pages_added").alias("pages_added"),
        zero("pages_removed").alias("pages_removed"),
        F.when(~flip, zero("metadata_changed")).alias("metadata_changed"),
        F.when(flip, F.when(F.col("enrich_applied"), "enrichment_enabled").otherwise("enrichment_disabled")).alias("metadata_not_comparable_reason"),
        content.alias("content_changed"),
        zero("selection_churn").alias("selection_churn"),
        F.bround(F.col("selection_churn") / F.col("n_keys"), 4).alias("selection_churn_ratio"),
        (F.col("urls_discovered") - F.col("previous_urls_discovered")).alias("urls_discovered_delta"),
        F.when(compared, F.octet_length("current") - F.octet_length("previous")).alias("llms_txt_bytes_delta"),
        "sections_delta", "added_sample", "removed_sample",
        F.when(~flip, F.col("changed_sample")).alias("metadata_changed_sample"),
        shown.alias("content_changed_sample"),
    )


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def index_changed(state: Column, added: Column, removed: Column, metadata: Column, content: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0)) > 0
    return ~F.coalesce(state == "compared", F.lit(False)) | zero(added) | zero(removed) | zero(metadata) | zero(content)


def change_summary(state: Column, added: Column, removed: Column, metadata: Column, content: Column, first_run: str = "First generated index for this site.") -> Column:
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    parts = F.filter(
        F.array(
            F.when(some(added), F.concat(plural(added, "page"), F.lit(" added"))),
            F.when(some(removed), F.concat(plural(removed, "page"), F.lit(" removed"))),
            F.when(some(metadata), F.lit("titles or descriptions changed")),
            F.when(some(content), F.lit("page content changed")),
        ),
        lambda x: x.isNotNull(),
    )
    joined = F.when(F.size(parts) > 1, F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ", "), F.lit(" and "), F.element_at(parts, -1))).when(F.size(parts) == 1, parts[0])
    joined = F.concat(F.upper(F.substring(joined, 1, 1)), F.lower(F.substr(joined, F.lit(2))))
    return F.when(~F.coalesce(state == "compared", F.lit(False)), first_run).otherwise(F.coalesce(F.concat(joined, F.lit(".")), F.lit("The generated index changed.")))
