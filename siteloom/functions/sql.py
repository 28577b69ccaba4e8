"""SQL functions for sessions that work in SQL: normalize_url, origin_key and section_for, as the column functions give them.

`register(spark)` makes temporary functions whose bodies are SQL, so that Catalyst inlines them; helpers begin with
siteloom_. The fixed values are those of the column functions.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from siteloom.functions import text as T
from siteloom.functions import urls as U


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(words: list[str]) -> str:
    return ", ".join(map(quoted, words))


PARTS = "STRUCT<scheme: STRING, netloc: STRING, host: STRING, port_text: STRING, path: STRING, query: STRING>"
SPLIT = "STRUCT<scheme: STRING, netloc: STRING, path: STRING, query: STRING>"


def _decoded(x: str) -> str:
    return f"coalesce(try_url_decode(regexp_replace({x}, '%(?![0-9A-Fa-f]{{2}})', '%25')), {x})"


def _encoded(x: str) -> str:
    return f"replace(replace(url_encode({x}), '*', '%2A'), '%7E', '~')"


def definitions() -> list[tuple[str, str, str, str]]:
    """(name, parameters, type, body), helpers first."""
    extract = lambda of, pattern: f"regexp_extract({of}, {quoted(pattern)}, 1)"
    place = "regexp_replace(s.netloc, '^.*@', '')"
    default_port = "CASE WHEN p.scheme = 'https' THEN 443 ELSE 80 END"
    port = "CASE WHEN p.port_text <> '' THEN try_cast(p.port_text AS INT) END"
    www = quoted(r"^www\.(?=[^.]*\.)")
    pair = f"named_struct('k', {_decoded(extract('x', '^([^=]*)'))}, 'v', {_decoded(extract('x', '^[^=]*=(.*)$'))})"
    kept = f"filter(transform(filter(split(q, '&'), x -> x <> ''), x -> {pair}), x -> NOT (lower(x.k) IN ({listed(U.TRACKING)}) OR startswith(lower(x.k), 'utm_')))"
    sections = " ".join(f"WHEN arrays_overlap(words, array({listed(terms.split())})) THEN {quoted(name)}" for name, terms in T.SECTION_WORDS)
    slug = "filter(split(replace(slug, '_', '-'), '-'), w -> w <> '')"
    return [
        ("siteloom_clean", "url STRING", "STRING", f"regexp_replace(regexp_replace(url, {quoted('[\\t\\r\\n]')}, ''), {quoted('^[\\x00-\\x20]+|[\\x00-\\x20]+$')}, '')"),
        (
            "siteloom_split", "s STRING", SPLIT,
            f"named_struct('scheme', lower({extract('s', r'^([A-Za-z][A-Za-z0-9+.\-]*):')}), 'netloc', {extract('s', '^[^:/?#]+://([^/?#]*)')}, 'path', {extract('s', '^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)')}, 'query', {extract('s', r'^[^?#]*\?([^#]*)')})",
        ),
        ("siteloom_place", f"s {SPLIT}", PARTS, f"named_struct('scheme', s.scheme, 'netloc', s.netloc, 'host', lower({extract(place, r'^(\[[^\]]*\]|[^:]*)')}), 'port_text', {extract(place, r'^(?:\[[^\]]*\]|[^:]*):(.*)$')}, 'path', s.path, 'query', s.query)"),
        ("siteloom_parts", "url STRING", PARTS, "siteloom_place(siteloom_split(siteloom_clean(url)))"),
        (
            "siteloom_valid", f"p {PARTS}", "BOOLEAN",
            f"p.scheme IN ('http', 'https') AND p.host NOT IN ('', '[]') AND NOT p.host RLIKE {quoted(r'^[^\[].*[\[\]]')} AND (p.port_text = '' OR (p.port_text RLIKE '^[0-9]{{1,9}}$' AND coalesce(try_cast(p.port_text AS INT), 99999) <= 65535))",
        ),
        ("siteloom_query", "q STRING", "STRING", f"array_join(transform(array_sort({kept}), x -> concat({_encoded('x.k')}, '=', {_encoded('x.v')})), '&')"),
        (
            "siteloom_whole", f"p {PARTS}, q STRING", "STRING",
            f"CASE WHEN siteloom_valid(p) THEN concat(p.scheme, '://', p.host, coalesce(concat(':', CAST({port} AS STRING)), ''), CASE WHEN p.path RLIKE '^/*$' THEN '/' ELSE regexp_replace(p.path, '/+$', '') END, CASE WHEN q <> '' THEN concat('?', q) ELSE '' END) END",
        ),
        ("siteloom_normal", f"p {PARTS}", "STRING", "siteloom_whole(p, siteloom_query(p.query))"),
        ("normalize_url", "url STRING", "STRING", "siteloom_normal(siteloom_parts(url))"),
        ("siteloom_origin", f"p {PARTS}", "STRING", f"CASE WHEN siteloom_valid(p) THEN concat_ws('|', p.scheme, regexp_replace(p.host, {www}, ''), CAST(coalesce({port}, {default_port}) AS STRING)) END"),
        ("origin_key", "url STRING", "STRING", "siteloom_origin(siteloom_parts(url))"),
        ("siteloom_segments", "path STRING", "ARRAY<STRING>", "transform(filter(split(path, '/'), x -> x <> ''), x -> lower(x))"),
        ("siteloom_words", "s ARRAY<STRING>", "ARRAY<STRING>", "array_distinct(concat(s, flatten(transform(s, x -> split(x, '-')))))"),
        ("siteloom_human", "slug STRING", "STRING", f"array_join(transform({slug}, w -> CASE WHEN w IN ({listed(T.ACRONYMS)}) THEN upper(w) ELSE concat(upper(substring(w, 1, 1)), lower(substr(w, 2))) END), ' ')"),
        ("siteloom_root", f"url STRING, origin STRING, p {PARTS}", "BOOLEAN", f"{extract('url', '^([^:/?#]+://[^/?#]*)')} = origin AND p.path RLIKE '^/*$' AND p.query = ''"),
        ("siteloom_other", "name STRING, first STRING", "STRING", f"CASE WHEN first IS NULL OR contains(first, '.') OR name IN ('', {quoted(T.OPTIONAL)}) THEN {quoted(T.OTHER)} ELSE name END"),
        ("siteloom_section", "root BOOLEAN, words ARRAY<STRING>, first STRING", "STRING", f"CASE WHEN root THEN 'Overview' {sections} ELSE siteloom_other(siteloom_human(coalesce(first, '')), first) END"),
        ("siteloom_section_of", f"url STRING, origin STRING, p {PARTS}, s ARRAY<STRING>", "STRING", "siteloom_section(siteloom_root(url, origin, p), siteloom_words(s), try_element_at(s, 1))"),
        ("siteloom_section_in", f"url STRING, origin STRING, p {PARTS}", "STRING", "siteloom_section_of(url, origin, p, siteloom_segments(p.path))"),
        ("section_for", "url STRING, origin STRING", "STRING", "siteloom_section_in(url, origin, siteloom_parts(url))"),
    ]


def register(spark: SparkSession) -> None:
    """Makes the functions in this session; those of the same names are replaced."""
    for name, parameters, kind, body in definitions():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
