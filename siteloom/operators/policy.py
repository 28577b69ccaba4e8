"""Robots policies: rules out of robots.txt bodies, and the longest-match join of targets with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteloom.functions import urls as U

MAX_RULES, MAX_LINES = 1000, 50_000


def robots_lines(bodies: DataFrame) -> DataFrame:
    """(site, pos, field, value) of bodies(site, body), comments and lines without a field left out."""
    lines = bodies.select("site", F.posexplode(F.slice(F.split("body", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), 1, MAX_LINES)).alias("pos", "line"))
    line = F.trim(F.regexp_replace("line", "(?s)#.*$", ""))
    return lines.select("site", "pos", F.lower(F.trim(F.regexp_extract(line, "^([^:]*):", 1))).alias("field"), F.trim(F.regexp_extract(line, "^[^:]*:(.*)$", 1)).alias("value"), line.contains(":").alias("ok")).where("ok").drop("ok")


def robots_rules(bodies: DataFrame, token: str) -> tuple[DataFrame, DataFrame]:
    """Rules (site, ord, kind, pattern, pattern_len) and delays (site, crawl_delay_s) for a product token.

    User-agent lines in a row share a group. Groups that name the token are merged, else those of `*`. A
    robots file has at most 50,000 lines, so a window by site holds no more.
    """
    fields = robots_lines(bodies).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    order = Window.partitionBy("site").orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    starts = F.coalesce(is_agent & (F.lag("field").over(order).isNull() | (F.lag("field").over(order) != "user-agent")), F.lit(False))
    grouped = fields.withColumn("starts", starts.cast("int")).withColumn("g", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("g > 0")
    agents = grouped.where(is_agent).select("site", "g", F.lower("value").alias("agent"))
    wanted = agents.where(F.col("agent").isin(token.lower(), "*")).groupBy("site", "g").agg(F.max((F.col("agent") == token.lower()).cast("int")).alias("named"), F.max((F.col("agent") == "*").cast("int")).alias("star"))
    named = wanted.groupBy("site").agg(F.max("named").alias("any_named"))
    winning = wanted.join(named, "site").where(F.when(F.col("any_named") == 1, F.col("named") == 1).otherwise(F.col("star") == 1)).select("site", "g")
    rules = grouped.where(~is_agent).join(winning, ["site", "g"], "left_semi")
    kept = rules.withColumn("good", F.col("field").isin("allow", "disallow") & F.col("value").rlike("^[/*]"))
    kept = kept.withColumn("n", F.sum(F.col("good").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pattern = U.percent_normalize(F.col("value"))
    rows = kept.where(F.col("good") & (F.col("n") <= MAX_RULES)).select("site", F.col("n").cast("long").alias("ord"), F.col("field").alias("kind"), pattern.alias("pattern"), F.length(pattern).cast("long").alias("pattern_len"))
    delay = F.when(F.col("value").rlike(r"^\+?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.col("value").try_cast("double"))
    delays = kept.where((F.col("field") == "crawl-delay") & (F.col("n") < MAX_RULES)).withColumn("d", delay).where("d is not null").groupBy("site").agg(F.max_by("d", "pos").alias("crawl_delay_s"))
    return rows, delays


def glob_parts(pattern: Column) -> Column:
    """A robots pattern as struct(prefix, starred, middle, last, anchored).

    The prefix is what stands before the first `*`; middle has the other literals in order; where a final `$`
    anchors a starred pattern, last is the literal that must end the target, and middle goes without it.
    """
    anchored = pattern.endswith("$")
    body = F.when(anchored, F.substring(pattern, F.lit(1), F.length(pattern) - 1)).otherwise(pattern)

    def split(x: Column) -> Column:
        starred = F.size(x) > 1
        rest = F.slice(x, F.lit(2), F.greatest(F.size(x) - 1 - (anchored & starred).cast("int"), F.lit(0)))
        return F.struct(x[0].alias("prefix"), starred.alias("starred"), F.filter(rest, lambda y: y != "").alias("middle"), F.when(anchored & starred, F.element_at(x, -1)).alias("last"), anchored.alias("anchored"))

    return U.bind(F.split(body, r"\*"), split)


def glob_matches(target: Column, glob: Column) -> Column:
    """Whether a target that begins with the glob's prefix matches it.

    Each literal is looked for once, from where the one before it ended, and none is tried again; the leftmost
    place leaves most room for the others.
    """

    def after(pos: Column, part: Column) -> Column:
        return F.when(pos == 0, 0).otherwise(U.bind(F.position(part, target, pos), lambda at: F.when(at == 0, 0).otherwise(at + F.length(part))))

    end = F.aggregate(glob["middle"], F.length(glob["prefix"]) + 1, after)
    ends_right = lambda pos: F.when(glob["anchored"], (F.length(target) - F.length(glob["last"]) + 1 >= pos) & F.endswith(target, glob["last"])).otherwise(True)
    whole = ~glob["anchored"] | (F.length(target) == F.length(glob["prefix"]))
    return F.when(glob["starred"], U.bind(end, lambda pos: (pos > 0) & ends_right(pos))).otherwise(whole)


def target_of(url: Column) -> Column:
    """The path and query by which robots rules judge a URL."""

    def target(p: Column) -> Column:
        path = F.when(p["path"] == "", F.lit("/")).otherwise(p["path"])
        return U.percent_normalize(F.concat(path, F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise(F.lit(""))))

    return U.with_parts(url, target)


def rule_index(rules: DataFrame) -> DataFrame:
    """(site, lengths, slots): a hash table of a site's rules by their literal prefix, and the prefixes' lengths.

    A site has at most 1000 rules and as many slots as rules, so a slot holds about one.
    """
    cut = rules.withColumn("glob", glob_parts(F.col("pattern"))).withColumn("n", F.count("*").over(Window.partitionBy("site")))
    slot = F.pmod(F.xxhash64("glob.prefix"), F.col("n")).cast("int")
    rule = F.struct(F.col("pattern_len"), (F.col("kind") == "allow").alias("allow"), F.col("glob"))
    slots = cut.groupBy("site", "n", slot.alias("slot")).agg(F.collect_set(rule).alias("held"), F.collect_set(F.length("glob.prefix")).alias("lengths"))
    whole = slots.groupBy("site", "n").agg(F.map_from_entries(F.collect_list(F.struct("slot", "held"))).alias("by_slot"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lengths")))).alias("lengths"))
    every = F.sequence(F.lit(0), F.col("n").cast("int") - 1)
    return whole.select("site", "lengths", F.transform(every, lambda k: F.coalesce(F.try_element_at("by_slot", k), F.array())).alias("slots"))


def robots_allowed(urls: DataFrame, rules: DataFrame, url: str = "norm_url") -> DataFrame:
    """urls(site, url) with `allowed`: the longest matching pattern wins, allow wins ties, no match allows.

    A site's rules come as one row, so that URLs don't multiply; it holds for streams as well. A URL meets
    only the rules whose literal prefix is one of its own, looked up by hash.
    """
    joined = urls.withColumn("target", target_of(F.col(url))).join(rule_index(rules), "site", "left")
    target = F.col("target")

    def met(prefix: Column) -> Column:
        slot = F.element_at("slots", (F.pmod(F.xxhash64(prefix), F.size("slots")) + 1).cast("int"))
        found = F.filter(slot, lambda r: (r["glob"]["prefix"] == prefix) & glob_matches(target, r["glob"]))
        return F.array_max(F.transform(found, lambda r: F.struct(r["pattern_len"].alias("n"), r["allow"].alias("allow"))))

    fitting = F.filter("lengths", lambda n: n <= F.length(target))
    best = F.array_max(F.transform(fitting, lambda n: U.bind(F.substring(target, F.lit(1), n), met)))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("target", "lengths", "slots")
