"""URL columns: parts, normal forms, origins and the predicates on paths."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
TRACKING = ["ref", "fbclid", "gclid", "mc_cid", "mc_eid"]
DOC_SEGMENTS = ["docs", "doc", "guide", "guides", "reference", "api", "getting-started"]
TAXONOMY_SEGMENTS = ["tag", "tags", "category", "categories", "author", "authors"]
CHANGELOG_SEGMENTS = ["changelog", "change-log", "release-notes"]
LANGUAGES = "en es fr de it pt ru zh ja ko ar nl pl tr sv da no nb nn fi cs sk hu el he th vi id uk ro bg hr sl et lv lt fa hi".split()
MAX_URL, MAX_HOST = 2048, 253


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: inside the lambda every mention of it is a variable, not a copy."""
    return F.transform(F.array(value), use)[0]


def with_parts(url: Column | str, use: Callable[[Column], Column]) -> Column:
    """use(parts), where parts has the scheme, userinfo, netloc, host, port_text, path and query of a URL by RFC
    3986's appendix B; the host is in lower case. The URL is parsed once, however often parts is mentioned."""

    def split(s: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)).alias("scheme"),
            F.regexp_extract(s, r"^[^:/?#]+://([^/?#]*)", 1).alias("netloc"),
            F.regexp_extract(s, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
            F.regexp_extract(s, r"^[^?#]*\?([^#]*)", 1).alias("query"),
        )

    def host(x: Column) -> Column:
        place = F.regexp_replace(x["netloc"], "^.*@", "")
        return F.struct(
            x["scheme"].alias("scheme"),
            F.regexp_extract(x["netloc"], "^(.*)@", 1).alias("userinfo"),
            x["netloc"].alias("netloc"),
            F.lower(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1)).alias("host"),
            F.regexp_extract(place, r"^(?:\[[^\]]*\]|[^:]*):(.*)$", 1).alias("port_text"),
            x["path"].alias("path"),
            x["query"].alias("query"),
        )

    clean = F.regexp_replace(F.regexp_replace(_c(url), r"[\t\r\n]", ""), r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return bind(clean, lambda s: bind(split(s), lambda x: bind(host(x), use)))


def host_of(url: Column | str) -> Column:
    return with_parts(url, lambda p: p["host"])


def port(parts: Column) -> Column:
    return F.when(parts["port_text"] != "", parts["port_text"].try_cast("int"))


def is_valid(parts: Column) -> Column:
    """An http or https URL with a host and, if any, a decimal port up to 65535."""
    text = parts["port_text"]
    good_port = (text == "") | (text.rlike("^[0-9]{1,9}$") & (F.coalesce(text.try_cast("int"), F.lit(99999)) <= 65535))
    return parts["scheme"].isin("http", "https") & ~parts["host"].isin("", "[]") & ~parts["host"].rlike(r"^[^\[].*[\[\]]") & good_port


def decode_form(x: Column) -> Column:
    """Form decoding of a query's name or value; a stray percent sign stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25")), x)


def encode_form(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_query(query: Column) -> Column:
    """Query pairs without tracking parameters, sorted by decoded name and value, encoded again."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.struct(decode_form(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decode_form(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.filter(pairs, lambda p: ~(F.lower(p["k"]).isin(TRACKING) | F.lower(p["k"]).startswith("utm_")))
    return F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(encode_form(p["k"]), F.lit("="), encode_form(p["v"]))), "&")


def normalize_path(path: Column) -> Column:
    return F.when(path.rlike("^/*$"), F.lit("/")).otherwise(F.regexp_replace(path, "/+$", ""))


def authority(parts: Column) -> Column:
    p = port(parts)
    return F.concat(parts["host"], F.when(p.isNotNull(), F.concat(F.lit(":"), p.cast("string"))).otherwise(F.lit("")))


def _with_query(query: Column) -> Column:
    return F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))


def candidate(url: Column | str) -> Column:
    """struct(url, scheme, host, port, path, query) of a normalised URL, null if it isn't a valid one."""

    def whole(p: Column) -> Column:
        pair = F.struct(normalize_path(p["path"]).alias("path"), normalize_query(p["query"]).alias("query"))
        text = lambda n: F.concat(p["scheme"], F.lit("://"), authority(p), n["path"], _with_query(n["query"]))
        fields = lambda n: F.struct(text(n).alias("url"), p["scheme"].alias("scheme"), p["host"].alias("host"), port(p).alias("port"), n["path"].alias("path"), n["query"].alias("query"))
        return F.when(is_valid(p), bind(pair, fields))

    return with_parts(url, whole)


def normalize_url(url: Column | str) -> Column:
    return candidate(url)["url"]


def candidate_origin(c: Column) -> Column:
    """The selection origin of a normalised candidate."""
    return F.concat_ws("|", c["scheme"], strip_www(c["host"]), F.coalesce(c["port"], F.when(c["scheme"] == "https", F.lit(443)).otherwise(F.lit(80))).cast("string"))


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.(?=[^.]*\.)", "")


def origin_key(url: Column | str, preset: str = "selection") -> Column:
    """A comparable origin. Presets: selection and sitemap fold www and default ports, links keeps www,
    redirect compares the host and port text alone, index is the scheme and the network location less www."""
    if preset not in ("selection", "sitemap", "links", "redirect", "index"):
        raise ValueError(preset)

    def key(p: Column) -> Column:
        number = F.coalesce(port(p), F.when(p["scheme"] == "https", F.lit(443)).otherwise(F.lit(80))).cast("string")
        if preset == "index":
            return F.when(p["scheme"] != "", F.concat(p["scheme"], F.lit("://"), strip_www(p["netloc"])))
        if preset == "redirect":
            return F.when(is_valid(p), F.concat_ws("|", strip_www(p["host"]), p["port_text"]))
        host = p["host"] if preset == "links" else strip_www(p["host"])
        return F.when(is_valid(p), F.concat_ws("|", p["scheme"], host, number))

    return with_parts(url, key)


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def lower_segments(path: Column) -> Column:
    return F.transform(segments(path), F.lower)


def depth(path: Column) -> Column:
    return F.size(segments(path))


def _overlap(path: Column, names: list[str]) -> Column:
    return F.arrays_overlap(lower_segments(path), F.array(*map(F.lit, names)))


def is_dated_archive(path: Column) -> Column:
    return F.exists(segments(path), lambda s: s.rlike("^(199[0-9]|20[0-9]{2})$"))


def is_taxonomy(path: Column) -> Column:
    return _overlap(path, TAXONOMY_SEGMENTS)


def is_pagination(path: Column, query: Column) -> Column:
    return query.rlike("(?i)(^|&)page=") | path.rlike("(?i)(^|/)page/+[0-9]+(/|$)")


def is_feed(path: Column) -> Column:
    return F.coalesce(F.lower(F.try_element_at(segments(path), F.lit(-1))).rlike(r"^feed$|\.(rss|atom|xml)$"), F.lit(False))


def is_changelog(path: Column) -> Column:
    return _overlap(path, CHANGELOG_SEGMENTS)


def has_doc_segment(path: Column) -> Column:
    return _overlap(path, DOC_SEGMENTS)


def delocalized_url(c: Column) -> Column:
    """A candidate's URL without its leading language segment, null if it has none."""
    first = F.coalesce(F.try_element_at(segments(c["path"]), F.lit(1)), F.lit(""))
    language = F.lower(F.regexp_extract(first, "^(?i)([a-z]{2,3})(-[a-z]{2,4})?$", 1))
    rest = F.concat(F.lit("/"), F.array_join(F.slice(segments(c["path"]), F.lit(2), F.greatest(depth(c["path"]), F.lit(1))), "/"))
    place = F.concat(c["host"], F.when(c["port"].isNotNull(), F.concat(F.lit(":"), c["port"].cast("string"))).otherwise(F.lit("")))
    text = F.concat(c["scheme"], F.lit("://"), place, rest, F.when(c["query"] != "", F.concat(F.lit("?"), c["query"])).otherwise(F.lit("")))
    return F.when(language.isin(LANGUAGES), text)


def leading_languages(path: Column) -> Column:
    """How many segments at the front of a path are language codes."""
    flags = F.transform(segments(path), lambda s: F.lower(F.regexp_extract(s, "^(?i)([a-z]{2,3})(-[a-z]{2,4})?$", 1)).isin(LANGUAGES))
    stop = F.array_position(flags, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(flags)).cast("int")


def percent_normalize(value: Column) -> Column:
    """A robots path or target with all escapes decoded but those of / ? # and %."""
    kept = F.regexp_replace(F.replace(value, F.lit("+"), F.lit("%2B")), "%(?=2[fF]|3[fF]|23|25)", "%25")
    kept = F.replace(F.replace(kept, F.lit("%252f"), F.lit("%252F")), F.lit("%253f"), F.lit("%253F"))
    return F.coalesce(F.try_url_decode(F.regexp_replace(kept, "%(?![0-9A-Fa-f]{2})", "%25")), value)


def parse_lastmod(text: Column | str) -> Column:
    """A sitemap's lastmod: a full ISO date, with or without a time; without an offset it is in UTC."""
    s = F.trim(_c(text))
    full = s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d{1,6})?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$")
    return F.when(full, F.replace(s, F.lit(","), F.lit(".")).try_cast("timestamp"))


def parse_priority(text: Column | str) -> Column:
    """A sitemap's priority, null unless a decimal number from 0 to 1."""
    s = F.trim(_c(text))
    x = F.when(s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
    return F.when((x >= 0) & (x <= 1), x)


@F.pandas_udf(StringType())
def _to_ascii(host: pd.Series) -> pd.Series:
    """IDNA of non-ASCII hosts; null where it is impossible."""

    def one(h: str | None) -> str | None:
        try:
            return None if h is None else h.encode("idna").decode("ascii")
        except UnicodeError:
            return None

    return host.map(one)


def _site(raw: Column, ascii_host: Column | None) -> Column:
    """struct(url, origin, reject_reason) of a URL that a user typed; the first rule broken gives the reason."""

    def judge(s: Column, p: Column) -> Column:
        host = p["host"] if ascii_host is None else ascii_host
        number = port(p)
        default = F.when(p["scheme"] == "https", F.lit(443)).otherwise(F.lit(80))
        is_v6 = host.rlike(r"^\[.*\]$")
        name = r"^(?!-)[a-z0-9-]{1,63}(?<!-)(\.(?!-)[a-z0-9-]{1,63}(?<!-))*\.?$"
        reason = (
            F.when(raw.isNull() | (s == ""), "empty")
            .when(F.length(s) > MAX_URL, "too_long")
            .when(s.rlike(r"(?U)[\s\x00-\x1F]"), "whitespace")
            .when(~p["scheme"].isin("http", "https") | ~s.contains("://"), "scheme")
            .when(F.regexp_extract(s, "^[^:/?#]+://([^/?#]*)", 1).contains("@"), "credentials")
            .when((p["port_text"] != "") & ~(p["port_text"].rlike("^[0-9]{1,9}$") & (F.coalesce(number, F.lit(99999)) <= 65535)), "port")
            .when(p["host"] == "", "no_host")
            .when(host.isNull() | (F.length(host) > MAX_HOST), "host")
            .when(is_v6 & ~host.rlike(r"^\[(?=.*:)[0-9a-f:.]+\]$"), "host")
            .when(~is_v6 & ~host.rlike(name), "host")
        )
        shown = F.when(number.isNotNull() & (number != default), F.concat(F.lit(":"), number.cast("string"))).otherwise(F.lit(""))
        origin = F.concat(p["scheme"], F.lit("://"), strip_www(host), shown)
        ok = lambda r, x: F.when(r.isNull(), x)
        return bind(reason, lambda r: F.struct(ok(r, s).alias("url"), ok(r, origin).alias("origin"), r.alias("reject_reason")))

    return bind(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), lambda s: with_parts(s, lambda p: judge(s, p)))


def validate_sites(rows: DataFrame, url: str, out: str = "site") -> DataFrame:
    """rows with `out`, a struct(url, origin, reject_reason) of the URLs that users typed.

    Only rows whose host is outside ASCII go to the Python codec; all others stay in Spark's own functions.
    """
    raw = F.col(url)
    foreign = F.coalesce(host_of(F.regexp_replace(raw, r"(?U)^\s+|\s+$", "")).rlike(r"[^\x00-\x7F]"), F.lit(False))
    plain = rows.where(~foreign).withColumn(out, _site(raw, None))
    name = "_siteloom_host"
    other = rows.where(foreign).withColumn(name, _to_ascii(host_of(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""))))
    return plain.unionByName(other.withColumn(out, _site(raw, F.col(name))).drop(name))


def ip4_number(host: Column) -> Column:
    """The IPv4 address that resolvers read in a host as a number, else null.

    One to four parts in decimal, octal or hexadecimal notation; the last part fills what is left of four bytes.
    """

    def part(x: Column) -> Column:
        digits = F.when(x.rlike("^0[xX][0-9a-fA-F]{1,8}$"), F.conv(F.substring(x, 3, 8), 16, 10))
        return digits.when(x.rlike("^0[0-7]{1,11}$"), F.conv(x, 8, 10)).when(x.rlike("^(0|[1-9][0-9]{0,9})$"), x).cast("long")

    def whole(parts: Column) -> Column:
        n, last = F.size(parts), F.element_at(parts, -1)
        front = F.slice(parts, F.lit(1), n - 1)
        good = (n <= 4) & F.forall(parts, lambda x: x.isNotNull()) & F.forall(front, lambda x: x <= 255)
        value = F.aggregate(front, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
        room = F.pow(F.lit(256), 5 - n).cast("long")
        return F.when(good & (last < room), value * room + last)

    return bind(F.transform(F.split(F.regexp_replace(host, r"\.$", ""), r"\."), part), whole)


def ip6_text(host: Column) -> Column:
    """The 32 hexadecimal digits of a bracketed IPv6 literal, whose last four bytes may be dotted; else null."""
    literal = F.lower(F.regexp_extract(host, r"^\[([0-9a-fA-F:.]+)\]$", 1))
    byte = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    tail = F.regexp_extract(literal, rf":({byte}(?:\.{byte}){{3}})$", 1)
    low = F.lpad(F.lower(F.hex(ip4_number(tail))), 8, "0")
    plain = F.when(tail == "", literal).otherwise(F.concat(F.regexp_replace(literal, r"[0-9.]+$", ""), F.substring(low, 1, 4), F.lit(":"), F.substring(low, 5, 4)))

    def fill(h: Column) -> Column:
        left = F.filter(F.split(F.regexp_extract(h, "^(.*?)(::|$)", 1), ":"), lambda x: x != "")
        right = F.filter(F.split(F.regexp_extract(h, "::(.*)$", 1), ":"), lambda x: x != "")
        zeros = lambda x, y: F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - F.size(x) - F.size(y), F.lit(0)))
        groups = bind(left, lambda x: bind(right, lambda y: F.when(h.contains("::"), F.concat(x, zeros(x, y), y)).otherwise(x)))
        good = lambda g: (h != "") & ~h.rlike("::.*::") & (F.size(g) == 8) & F.forall(g, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        return bind(groups, lambda g: F.when(good(g), F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")))

    return bind(plain, fill)
