"""Page operators: block classes, outcomes, redirects, address checks, links and content out of HTML."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siteloom.functions import text as T
from siteloom.functions import urls as U
from siteloom.tables import cut

#: Fixed values.
CHALLENGE_TITLES = ["just a moment", "attention required", "checking your browser"]
MIN_BODY_CHARS, MAX_REDIRECTS, MAX_LINKS = 200, 5, 10_000
#: Address blocks of the IANA special-purpose registries and metadata services, and why a crawl must
#: not reach them; `global` marks blocks inside others that it may. The longest prefix counts. IPv6 is public in
#: 2000::/3 alone; a mapped address is as public as its IPv4 one.
BLOCKS4 = {
    "169.254.169.254/32": "metadata", "100.100.100.200/32": "metadata", "192.0.0.192/32": "metadata",
    "0.0.0.0/8": "non_global", "10.0.0.0/8": "non_global", "100.64.0.0/10": "non_global", "127.0.0.0/8": "non_global",
    "169.254.0.0/16": "non_global", "172.16.0.0/12": "non_global", "192.0.0.0/24": "non_global", "192.0.0.9/32": "global",
    "192.0.0.10/32": "global", "192.0.2.0/24": "non_global", "192.168.0.0/16": "non_global", "198.18.0.0/15": "non_global",
    "198.51.100.0/24": "non_global", "203.0.113.0/24": "non_global", "224.0.0.0/4": "multicast", "240.0.0.0/4": "non_global",
}
BLOCKS6 = {
    "fd00:ec2::254/128": "metadata", "::/0": "non_global", "::ffff:0:0/96": "global", "2000::/3": "global",
    "2001::/23": "non_global", "2001:1::1/128": "global", "2001:1::2/128": "global", "2001:3::/32": "global",
    "2001:4:112::/48": "global", "2001:20::/28": "global", "2001:30::/28": "global", "2001:db8::/32": "non_global",
    "2002::/16": "non_global", "3fff::/20": "non_global", "fec0::/10": "site_local", "ff00::/8": "multicast",
}

#: Elements that are no content, which may be nested.
HIDDEN = ("nav", "header", "footer", "aside", "form")
#: Types of JSON-LD objects whose name is a page's title.
LD_TYPES = r"(Article|Posting|Page)\b"


def header_value(headers: Column, name: str) -> Column:
    return F.try_element_at(F.transform(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name), lambda e: e["value"]), F.lit(1))


def classify_block(status: Column, headers: Column, body: Column) -> Column:
    """challenge, denied or null of a response."""
    raw = F.regexp_extract(F.substring(body, 1, 4096), r"(?is)<title[^>]*>(.*?)</title>", 1)
    title = F.lower(F.trim(F.regexp_replace(F.trim(F.regexp_extract(raw, r"(?s)^([^|]*)", 1)), "[.…!?]+$", "")))
    challenge = status.isin(403, 503) & F.coalesce(F.lower(header_value(headers, "server")).contains("cloudflare"), F.lit(False)) & (F.length(body) <= 65_536) & title.isin(CHALLENGE_TITLES)
    return F.when((status >= 200) & (status < 300), None).when(header_value(headers, "cf-mitigated").isNotNull() | challenge, "challenge").when(status.isin(401, 403), "denied")


def page_outcome(status: Column, blocked: Column, requested: Column, final: Column) -> Column:
    off = ~U.origin_key(requested, "redirect").eqNullSafe(U.origin_key(final, "redirect"))
    return F.when(blocked.isNotNull(), "blocked").when(~status.between(200, 299), "http_error").when(off, "off_origin_redirect").otherwise("ok")


def looks_like_html(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1)))).isin("", "text/html", "application/xhtml+xml")


def crawl_stats(pages: DataFrame) -> DataFrame:
    """Per site: counts of outcomes, bytes, and the worst block reason (challenge before denied)."""
    ok = F.col("outcome") == "ok"
    worst = F.max(F.when(F.col("blocked_reason") == "challenge", 2).when(F.col("blocked_reason") == "denied", 1).otherwise(0))
    out = pages.groupBy("site").agg(
        F.count_if(ok).alias("pages_crawled"),
        F.count_if(~ok).alias("pages_failed"),
        F.sum("content_bytes").alias("bytes_fetched"),
        F.count_if(ok & F.col("is_empty")).alias("pages_empty_content"),
        F.count_if(F.col("outcome") == "blocked").alias("pages_blocked"),
        F.count_if(F.col("outcome") == "http_error").alias("pages_http_error"),
        F.count_if(F.col("outcome") == "off_origin_redirect").alias("pages_off_origin"),
        worst.alias("w"),
    )
    return out.withColumn("blocked_reason", F.when(F.col("w") == 2, "challenge").when(F.col("w") == 1, "denied")).drop("w")


def redirect_chain(requests: DataFrame, hops: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """(url, final_url, n_hops, outcome) of requests(url) over hops(url, location, is_redirect).

    So many joins follow a chain; an https page may not lead to http.
    """
    step = hops.select(F.col("url").alias("at"), "location", "is_redirect")
    rows = requests.select("url", F.col("url").alias("at"), F.lit(0).alias("n_hops"), F.lit(None).cast("string").alias("outcome"))
    for i in range(most + 1):
        rows = rows.join(step, "at", "left")
        go = F.col("outcome").isNull() & F.coalesce("is_redirect", F.lit(False))
        stop = F.when(~go, F.col("outcome")).when(F.coalesce("location", F.lit("")) == "", "missing_location").when(F.col("at").startswith("https:") & F.col("location").startswith("http:"), "https_downgrade").when(F.lit(i == most), "too_many")
        moves = go & stop.isNull()
        rows = rows.select("url", F.when(moves, F.col("location")).otherwise(F.col("at")).alias("at"), (F.col("n_hops") + moves.cast("int")).alias("n_hops"), stop.alias("outcome"))
    return rows.select("url", F.col("at").alias("final_url"), "n_hops", F.coalesce("outcome", F.lit("ok")).alias("outcome"))


def embedded_ip4(hex32: Column) -> Column:
    """The IPv4 addresses that a mapped, 6to4, Teredo (server and client) or NAT64 address holds, as numbers."""
    part = lambda at: F.conv(F.substring(hex32, at, 8), 16, 10).cast("long")
    return (
        F.when(hex32.startswith("0" * 20 + "ffff") | hex32.startswith("0064ff9b" + "0" * 16), F.array(part(25)))
        .when(hex32.startswith("2002"), F.array(part(5)))
        .when(hex32.startswith("20010000"), F.array(part(9), F.lit(0xFFFFFFFF) - part(25)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def address_bits(host: Column) -> Column:
    """Addresses that a host stands for, itself and those inside it, as array<struct<family, bits>>; empty for a name.

    bits are text of 32 or 128 digits, so that a prefix is a substring.
    """
    word = lambda n: F.lpad(F.bin(n), 32, "0")
    four = lambda n: F.struct(F.lit(4).alias("family"), word(n).alias("bits"))

    def six(x: Column) -> Column:
        bits = F.concat(*(word(F.conv(F.substring(x, at, 8), 16, 10).cast("long")) for at in (1, 9, 17, 25)))
        return F.concat(F.array(F.struct(F.lit(6).alias("family"), bits.alias("bits"))), F.transform(embedded_ip4(x), four))

    none = F.array().cast("array<struct<family:int,bits:string>>")
    plain = U.bind(U.ip4_number(host), lambda n: F.when(n.isNotNull(), F.array(four(n))).otherwise(none))
    return F.when(host.startswith("["), U.bind(U.ip6_text(host), lambda x: F.when(x.isNotNull(), six(x)).otherwise(none))).otherwise(plain)


def address_blocks(blocks: DataFrame) -> DataFrame:
    """blocks(cidr, reason) as (family, prefix, reason), prefix being the bits that addresses inside begin with."""
    host, length = F.regexp_extract("cidr", "^([^/]*)/", 1), F.regexp_extract("cidr", "/([0-9]+)$", 1).cast("int")
    first = address_bits(F.when(host.contains(":"), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host))[0]
    rows = blocks.select(F.explode(F.array(first)).alias("a"), length.alias("length"), "reason")
    return rows.select("a.family", F.substring(F.col("a.bits"), F.lit(1), F.col("length")).alias("prefix"), "reason").dropDuplicates(["family", "prefix"])


def special_blocks(spark: SparkSession) -> DataFrame:
    """The fixed blocks that a crawl must not reach, or may inside others, as blocks(cidr, reason)."""
    return spark.createDataFrame([*BLOCKS4.items(), *BLOCKS6.items()], "cidr string, reason string")


def longest_prefix(addresses: DataFrame, blocks: DataFrame) -> DataFrame:
    """addresses(family, bits) with the reason of the longest block of address_blocks that holds each, if any.

    A block is found by equality: an address asks for its own prefix of each length that blocks of its family have.
    """
    lengths = blocks.groupBy("family").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    asked = addresses.select("family", "bits").distinct().join(F.broadcast(lengths), "family")
    asked = asked.select("family", "bits", F.explode("lengths").alias("n")).withColumn("prefix", F.substring(F.col("bits"), F.lit(1), F.col("n")))
    return asked.join(blocks, ["family", "prefix"]).groupBy("family", "bits").agg(F.max_by("reason", "n").alias("reason"))


def blocked_addresses(targets: DataFrame, resolved: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """targets(url) with reason: an address of the host isn't public, as such or inside an IPv6 one.

    resolved(host, ip) holds what names resolve to; with it, a name that has no address there is `unresolved`.
    One address that isn't public is enough, and metadata addresses come first. blocks(cidr, reason) default to the
    special ones; the reason `global` marks blocks inside others that may be reached.
    """
    table = address_blocks(special_blocks(targets.sparkSession) if blocks is None else blocks)
    rows = targets.select("url").distinct().select("url", F.explode(F.array(U.host_of("url"))).alias("host"))
    hosts = rows.select("host").distinct().select("host", F.explode(F.array(address_bits(F.col("host")))).alias("own"))
    found = hosts.select("host", F.explode("own").alias("a"))
    if resolved is not None:
        ip = F.regexp_replace("ip", "%.*$", "")
        bracketed = F.when(ip.contains(":"), F.concat(F.lit("["), ip, F.lit("]"))).otherwise(ip)
        names = hosts.where(F.size("own") == 0).select("host").join(resolved.select(F.lower("host").alias("host"), bracketed.alias("ip")), "host")
        found = found.union(names.select("host", F.explode(address_bits(F.col("ip"))).alias("a")))
    found = cut(found.select("host", "a.family", "a.bits").distinct(), "addresses")
    judged = found.join(longest_prefix(found, table).where("reason <> 'global'"), ["family", "bits"], "left")
    first = F.min(F.when(F.col("reason").isNotNull(), F.struct((F.col("reason") != "metadata").alias("late"), "family", "reason", "bits")))
    worst = judged.groupBy("host").agg(first["reason"].alias("reason"))
    out = rows.join(worst.withColumn("known", F.lit(True)), "host", "left")
    reason = F.col("reason") if resolved is None else F.when(F.col("known").isNull(), "unresolved").otherwise(F.col("reason"))
    return out.select("url", reason.alias("reason"))


def attempt_outcome(kind: Column, status: Column, attempt: Column) -> Column:
    """struct(retryable, delay_s, final): whether and when a failed attempt is tried again, at most three times."""
    transient = (kind == "network") | ((kind == "http") & ((status >= 500) | (status == 429)))
    again = transient & (attempt < 3)
    return F.struct(transient.alias("retryable"), F.when(again, F.element_at(F.array(F.lit(10), F.lit(60), F.lit(300)), F.least(F.greatest(attempt, F.lit(1)), F.lit(3)).cast("int"))).alias("delay_s"), (~again).alias("final"))


def remove_dot_segments(path: Column) -> Column:
    """RFC 3986, 5.2.4."""
    parts = F.split(path, "/")

    def keep(acc: Column, s: Column) -> Column:
        up = F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)
        return F.when(s == ".", acc).when(s == "..", up).otherwise(F.concat(acc, F.array(s)))

    def joined(p: Column) -> Column:
        kept = F.aggregate(p, F.array().cast("array<string>"), keep)
        return F.concat(F.array_join(kept, "/"), F.when(F.element_at(p, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))

    return U.bind(parts, joined)


def resolve(base: Column, ref: Column) -> Column:
    """RFC 3986, 5.2: a reference against an absolute base, without fragment."""

    def split(r: Column) -> Column:
        return F.struct(
            r.alias("whole"),
            F.regexp_extract(r, "^([A-Za-z][A-Za-z0-9+.-]*):", 1).alias("scheme"),
            F.regexp_extract(r, "^(?:[^:/?#]+:)?(//[^/?#]*)", 1).alias("place"),
            F.regexp_extract(r, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
            F.regexp_extract(r, r"(\?.*)$", 1).alias("query"),
        )

    def joined(b: Column, r: Column) -> Column:
        root = F.concat(b["scheme"], F.lit("://"), b["netloc"])
        own_query = F.when(b["query"] != "", F.concat(F.lit("?"), b["query"])).otherwise(F.lit(""))
        folder = F.regexp_extract(F.when(b["path"] == "", F.lit("/")).otherwise(b["path"]), "^(.*/)", 1)
        path = remove_dot_segments(F.when((r["place"] != "") | r["path"].startswith("/"), r["path"]).otherwise(F.concat(folder, r["path"])))
        return (
            F.when((r["scheme"] != "") & (r["place"] == ""), r["whole"])
            .when(r["scheme"] != "", F.concat(r["scheme"], F.lit(":"), r["place"], path, r["query"]))
            .when(r["place"] != "", F.concat(b["scheme"], F.lit(":"), r["place"], path, r["query"]))
            .when(r["path"] == "", F.concat(root, b["path"], F.when(r["query"] != "", r["query"]).otherwise(own_query)))
            .otherwise(F.concat(root, path, r["query"]))
        )

    clean = F.regexp_replace(F.trim(ref), "#.*$", "")
    return U.with_parts(base, lambda b: U.bind(clean, lambda r: U.bind(split(r), lambda x: joined(b, x))))


#: All names of character references; those without a semicolon also count in front of other letters.
LEGACY = {name: text for name, text in html5.items() if not name.endswith(";")}
#: What numbers from 0x80 to 0x9F stand for: Windows-1252 where it has a character.
WINDOWS = [bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(0x80, 0xA0)]


def unescape(text: Column) -> Column:
    """Character references decoded once by HTML's rules, without Python: decimal, hexadecimal, named, and names that lack a semicolon."""
    table = lambda names: F.from_json(F.lit(json.dumps(names)), "map<string,string>")
    names, legacy, longest = table(html5), table(LEGACY), max(map(len, LEGACY))

    def character(n: Column) -> Column:
        unknown = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        nothing = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
        windows = F.element_at(F.array(*map(F.lit, WINDOWS)), (n - 0x7F).cast("int"))
        return F.when(unknown, "\ufffd").when(n.between(0x80, 0x9F), windows).when(nothing, "").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))

    def value(found: Column) -> Column:
        digits = F.regexp_replace(found, "^#[xX]?0*|;$", "")
        short = F.length(digits) <= 7
        number = F.when(short & found.rlike("^#[xX]"), F.conv(F.concat(F.lit("0"), digits), 16, 10)).when(short, F.concat(F.lit("0"), digits)).cast("long")
        begun = [F.when(F.length(found) > n, F.concat(F.try_element_at(legacy, F.substring(found, 1, n)), F.substr(found, F.lit(n + 1)))) for n in range(longest, 1, -1)]
        named = F.coalesce(F.try_element_at(names, found), *begun, F.concat(F.lit("&"), found))
        return F.when(found == "", "&").when(found.startswith("#"), U.bind(number, character)).otherwise(named)

    def decoded(part: Column) -> Column:
        found = F.regexp_extract(part, r"^(#[xX][0-9a-fA-F]+;?|#[0-9]+;?|[^\t\n\f <&#;]{1,32};?)", 1)
        return U.bind(found, lambda f: F.concat(value(f), F.substr(part, F.length(f) + 1)))

    whole = lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), decoded), ""))
    return F.when(text.contains("&"), U.bind(F.split(text, "&"), whole)).otherwise(text)


def scanned(values: Column, combine: Callable[[Column, Column], Column], back: bool = False) -> Column:
    """An array's running combinations, from its end if `back`, by doubling: a round for each power of two below its size."""

    def doubled(a: Column, k: Column) -> Column:
        step = F.call_function("shiftleft", F.lit(1), k)
        other = lambda i: i + step if back else i - step
        return F.transform(a, lambda x, i: F.when((other(i) >= 0) & (other(i) < F.size(a)), combine(x, F.get(a, other(i)))).otherwise(x))

    def whole(a: Column) -> Column:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a))).cast("int") - 1)
        return F.when(F.size(a) > 1, F.aggregate(rounds, a, doubled)).otherwise(a)

    return U.bind(values, whole)


def without_elements(html: Column, names: tuple[str, ...] = HIDDEN) -> Column:
    """html less its elements of these names, each up to the end tag that matches it; of tags that don't match, only the tags go.

    A tag's depth is the number of elements open behind it. Those that never end are open to the end of the page:
    their number is the least depth from there on. What is deeper than that is inside an element that ends.
    """
    tag = rf"(?i)</?(?:{'|'.join(names)})\b[^>]*>"
    signs = F.transform(F.regexp_extract_all(html, F.lit(tag), 0), lambda t: F.when(t.startswith("</"), -1).otherwise(1))
    depth = U.bind(scanned(signs, lambda a, b: a + b), lambda s: F.zip_with(s, scanned(s, F.least), lambda x, low: x - F.least(low, F.lit(0))))
    inside = U.bind(depth, lambda d: F.zip_with(d, scanned(d, F.least, back=True), lambda x, open_: x > open_))
    texts = U.bind(inside, lambda hidden: F.filter(F.split(html, tag), lambda _, i: ~F.coalesce(F.get(hidden, i - 1), F.lit(False))))
    return F.when(html.rlike(tag), F.array_join(texts, "\n")).otherwise(html)


def extract_links(pages: DataFrame, cap: int = MAX_LINKS) -> DataFrame:
    """(page_id, rank, link): same-origin links of pages(page_id, url, html), by first place in the page.

    What concerns a page (its base, its origin) is computed once a page, before its links are rows.
    """
    html = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")
    anchors = r"(?is)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
    base = F.regexp_extract("clean", r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)", 1)
    rows = pages.select("page_id", "url", F.explode(F.array(html)).alias("clean"))
    unquoted = F.transform(F.regexp_extract_all("clean", F.lit(anchors), 1), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    rows = rows.select("page_id", "url", F.transform(F.concat(F.array(base), unquoted), unescape).alias("refs"))
    own = F.when(F.col("refs")[0] == "", F.col("url")).otherwise(resolve(F.col("url"), F.col("refs")[0]))
    page = F.struct(own.alias("base"), U.origin_key("url", "links").alias("origin"))
    rows = rows.select("page_id", F.explode(F.array(page)).alias("page"), F.slice("refs", F.lit(2), F.size("refs") - 1).alias("refs"))
    rows = rows.select("page_id", "page", F.posexplode("refs").alias("pos", "raw")).withColumn("ref", F.trim("raw"))
    rows = rows.where((F.col("ref") != "") & ~F.col("ref").startswith("#"))
    rows = rows.select("page_id", "page", "pos", F.explode(F.array(resolve(F.col("page.base"), F.col("ref")))).alias("link"))
    rows = rows.where(U.origin_key("link", "links") == F.col("page.origin"))
    first = rows.groupBy("page_id", "link").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("long")
    return first.withColumn("rank", rank).where(F.col("rank") <= cap).select("page_id", "rank", "link")


def meta(html: Column, name: str) -> Column:
    return F.regexp_extract(html, rf"(?is)<meta\b(?=[^>]*\b(?:name|property)\s*=\s*[\"']{name}[\"'])[^>]*?\bcontent\s*=\s*[\"']([^\"']*)", 1)


def ld_title(html: Column) -> Column:
    """The first headline of a page's JSON-LD objects (alone, in an array or in a @graph), else the first name of an article or page."""
    plain = F.when(F.lower(html).contains("ld+json"), F.regexp_replace(html, "(?s)<!--.*?-->", ""))
    scripts = F.regexp_extract_all(plain, F.lit(r"(?is)<script\b[^>]*?\btype\s*=\s*[\"']?application/ld\+json\b[^>]*>(.*?)</script>"), 1)
    many = lambda s, path: F.from_json(F.get_json_object(s, path), "array<string>")
    one = lambda s: F.when(F.trim(s).startswith("["), many(s, "$")).otherwise(F.array(s))
    items = F.flatten(F.transform(F.flatten(F.transform(scripts, one)), lambda s: F.concat(F.array(s), F.coalesce(many(s, "$['@graph']"), F.array().cast("array<string>")))))

    def first(key: str, kept: Column) -> Column:
        values = F.transform(kept, lambda s: F.when(F.schema_of_variant(F.try_variant_get(F.try_parse_json(s), f"$.{key}", "variant")) == "STRING", F.get_json_object(s, f"$.{key}")))
        return F.try_element_at(F.filter(values, lambda v: F.trim(v) != ""), F.lit(1))

    return F.coalesce(first("headline", items), first("name", F.filter(items, lambda s: F.get_json_object(s, "$['@type']").rlike(LD_TYPES))))


def extract_content(pages: DataFrame, common_pages: int = 3) -> DataFrame:
    """(page_id, url, site, title, description, markdown, is_empty) of pages(page_id, url, html).

    Blocks of text, less scripts, navigation and the like with all that is nested in them; a block that common_pages pages of a site hold is
    left out. Only hashes of blocks are grouped by site, and joined back by hash.
    """
    html = F.coalesce("html", F.lit(""))
    h1 = F.regexp_extract_all(html, F.lit(r"(?is)<h1\b[^>]*>(.*?)</h1>"), 1)
    raw = F.array(ld_title(html), meta(html, "og:title"), F.when(F.size(h1) == 1, F.try_element_at(h1, F.lit(1))), F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1), meta(html, "og:description"), meta(html, "description"))
    names = F.transform(raw, lambda x: F.regexp_replace(x, "<[^>]*>", ""))
    first = lambda x: F.try_element_at(F.filter(F.transform(x, T.collapse), lambda t: t != ""), F.lit(1))
    body = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|head|noscript|svg)\b.*?</\1\s*>", "\n")
    shown = U.bind(body, lambda x: without_elements(x))
    marked = F.regexp_replace(shown, r"(?is)</?(p|div|h[1-6]|li|ul|ol|tr|td|table|article|section|main|blockquote|pre|body|html|hr)\b[^>]*>", "\x01")
    blocks = F.transform(F.split(marked, "\x01"), lambda b: F.regexp_replace(b, "<[^>]*>", " "))
    rows = pages.select("page_id", "url", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("site"), F.transform(names, unescape).alias("names"), F.transform(blocks, unescape).alias("blocks"))
    rows = rows.select("page_id", "url", "site", first(F.slice("names", 1, 4)).alias("title"), first(F.slice("names", 5, 2)).alias("description"), F.filter(F.transform("blocks", T.collapse), lambda b: b != "").alias("blocks"))
    hashed = rows.select("page_id", "site", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.xxhash64(b)))).alias("h"))
    common = hashed.groupBy("site", "h").agg(F.count("*").alias("n")).where(F.col("n") >= common_pages)
    drop = hashed.join(common.select("site", "h"), ["site", "h"]).groupBy("page_id").agg(F.collect_set("h").alias("drop"))
    out = rows.join(drop, "page_id", "left").withColumn("drop", F.coalesce("drop", F.array().cast("array<bigint>")))
    out = out.withColumn("markdown", F.array_join(F.filter("blocks", lambda b: ~F.array_contains("drop", F.xxhash64(b))), "\n\n"))
    return out.select("page_id", "url", "site", "title", "description", "markdown", (F.length("markdown") < MIN_BODY_CHARS).alias("is_empty"))
