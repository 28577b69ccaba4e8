"""Main text of web pages by consensus host paths.

First, every page is read once: its container elements are scored by the text of the blocks right inside them
(length, less what stands in links), and each page votes for all its containers by generalised tag-class
paths, such as `html/body/div.main/article`. Digits in classes are folded, so numbered variants agree. Spark
sums the proposals of a host's pages, and the path with the largest sum wins the host. Then every page is
read again with its host's winning path; a page without that path uses its own best container.

An article may be split over several containers: the winner is widened to the `article` or `main` around it;
without one, every level above it gives the containers and text beside it that are not mostly links (right
inside body, where legal lines and the like stand too, only those of at least BESIDE unlinked characters).

What is left out everywhere: menus, headers and footers outside the article, sidebars, notices, adverts,
forms, scripts, styles and reader comments, by tag, role or names: a class or id that has a word for clutter and
no word for anything else. Such an element ends where HTML ends it: by its end tag, by that of an element around
it, or by a new element that implies its end. Three kinds are content all the same: a form with an article inside, a block
that has no end tag of its own, and a form with more unlinked words of its own than all the page has outside of
clutter, such as the one around a page that a server makes (ten times as many where only a name like menu-item
marks an element).

Edge cases: a null html is an empty one and gives empty text; a page without containers uses its body or the
whole page; pages with a null or odd url share the null host; tags may stay open or close out of order;
repeated rows are kept; extra columns pass through `extract_pages` unchanged, but for one named text, which is
replaced; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import bounded_broadcast, materialize, others, small_batches, table

#: HTML's elements by their part in the layout.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea title select svg".split())
BLOCKS = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = set("html body main article section div td blockquote center".split())
CLUTTER_TAGS = set("nav aside footer form button dialog menu head iframe".split())
CLUTTER_ROLES = set("navigation banner contentinfo complementary search alert dialog form menu menubar".split())
CLUTTER_WORDS = set("ad ads adv advert adverts advertisement advertisements advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay subscribe newsletter signup share sharing social related recommended comment comments reply replies disqus respond widget toolbar pagination pager login search skip hidden".split())
#: Those that can have much text and are never content.
CERTAIN_WORDS = set("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored cookie cookies consent gdpr comment comments reply replies disqus respond hidden".split())
#: So many times the text of all that shows makes an element content that is clutter by another name.
MOST_OF = 10.0
#: Words that may stand beside them in a class or id; any other, as in social-science, makes it content.
NEUTRAL_WORDS = set("a aria area articles background bar block bottom box btn button buttons container content cta dialog div footer form global header holder icon icons in inline inner item items js left link links list main media message modal module mobile nav new off on outer page panel placeholder policy popular post posts primary right row secondary section site slot sticky the top unit up user widgets wrap wrapper".split())
#: Elements that a new one closes if they stand open in its scope.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}} | dict.fromkeys(("thead", "tbody", "tfoot"), {"thead", "tbody", "tfoot", "tr", "td", "th", "caption"})
#: Elements that make a form around them content.
ARTICLE_TAGS = set("article main h1".split())
#: Parts of a table, whose scope is the table; a cell is the scope of all else.
TABLE, CELLS = set("table thead tbody tfoot tr td th caption".split()), set("td th caption table".split())
#: Unlinked characters from which text in another part of the body counts as the article's.
BESIDE = 80

#: Columns of the join, by names that no table is likely to have.
HOST, PATH, SALT = "_siteloom_host", "_siteloom_path", "_siteloom_salt"

#: A quote opens a value only right after an equals sign; elsewhere it is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")


def is_clutter_name(name: str) -> bool:
    """A class or id that names clutter and nothing else but a part of a layout."""
    found = [w.lower() for w in SPLIT.findall(name)]
    return any(w in CLUTTER_WORDS for w in found) and all(w in CLUTTER_WORDS or w in NEUTRAL_WORDS for w in found)


class Block:
    """A run of text between block boundaries: its container's place, the clutter it is in, its text, and how much of it is linked."""

    __slots__ = ("clutter", "linked", "node", "parts")

    def __init__(self, node: int, clutter: int):
        self.node, self.clutter, self.parts, self.linked = node, clutter, [], 0


class Page:
    """Nodes (parent, path) and blocks of one page, read once.

    Clutter is read like all else, and its blocks are marked with the innermost clutter element around them. What
    was taken for clutter by mistake is content in the end: a form around an article, a block that has no end tag
    of its own, and an element that holds most of the text that is left when all other clutter is out.

    A node's path, the generalised tags and classes from the root, is held as a hash of its parent's path and its
    own name, so that deep pages cost no more than flat ones.
    """

    def __init__(self, html: str):
        self.parents: list[int] = [-1]
        self.paths: list[int] = [0]
        self.tags: list[str] = [""]
        self.blocks: list[Block] = []
        #: Clutter elements: the one around each (0: none), and whether it is content after all.
        self.around: list[int] = [0]
        self.content: list[bool] = [True]
        #: How many times as much text as all that shows makes it content.
        self.least: list[float] = [0.0]
        self._read(html)
        self._restore()

    def _restore(self) -> None:
        """Decides from the outside in what is content: a form with more unlinked text of its own than all that shows,
        and what is clutter by a vague name alone if it has MOST_OF times as much."""
        own = [0] * len(self.around)
        for b in self.blocks:
            size = len("".join(b.parts).split())
            own[b.clutter] += size if b.linked * 2 < sum(map(len, b.parts)) else 0
        shown = [self.content[0]] + [False] * (len(own) - 1)
        visible = own[0]
        for k in range(1, len(own)):
            if not shown[self.around[k]]:
                continue
            if self.content[k] or own[k] > self.least[k] * visible:
                shown[k] = True
                visible += own[k]
        self.content = shown

    def _attributes(self, text: str) -> dict[str, str]:
        return {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(text)} if "=" in text or "hidden" in text else {}

    def _read(self, html: str) -> None:
        # Open elements: tag, place of the container, articles around, innermost clutter; those from `skip` on are clutter, if it isn't 0.
        stack: list[tuple[str, int, int, int]] = [("", 0, 0, 0)]
        skip, links, at = 0, 0, 0
        block = Block(0, 0)
        endless: set[str] = set()

        def end_block() -> Block:
            if block.parts:
                self.blocks.append(block)
            return Block(stack[-1][1], stack[-1][3])

        def shorten(height: int) -> int:
            """The open elements from a height on end; returns what becomes of skip."""
            del stack[height:]
            return skip if skip < height else 0

        def text(piece: str) -> None:
            if piece:
                block.parts.append(piece)
                if links:
                    block.linked += len(piece)

        size, find = len(html), TOKEN.search
        while at < size:
            m = find(html, at)
            if not m:
                text(html[at:])
                break
            text(html[at : m.start()])
            at = m.end()
            close, tag = m[1], (m[2] or "").lower()
            if not tag:
                continue
            if not close:
                if tag in RAW:
                    end = None if tag in endless else re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                    if not end:
                        endless.add(tag)
                    at = end.end() if end else (size if tag in ("script", "style", "textarea", "title") else at)
                    if tag != "title":
                        block = block if tag == "svg" else end_block()
                    continue
                if tag in BLOCKS and (height := self._implied_end(tag, stack)) < len(stack):
                    skip = shorten(height)
                    block = end_block()
                _, node, articles, clutter = stack[-1]
                if tag in ARTICLE_TAGS:
                    self._found_article(stack)
                attrs = self._attributes(m[3])
                if self._is_clutter(tag, attrs, articles):
                    if tag not in VOID:
                        self.around.append(clutter)
                        self.content.append(False)
                        self.least.append(self._least(tag, attrs, articles))
                        skip = skip or len(stack)
                        clutter = len(self.around) - 1
                    else:
                        continue
                if tag == "br":
                    text(" ")
                    continue
                if tag == "a":
                    links += 1
                if tag in CONTAINERS and tag in BLOCKS:
                    name = tag
                    if cls := attrs.get("class"):
                        name += "." + DIGITS.sub("0", cls.split()[0].lower()) if cls.split() else ""
                    self.parents.append(node)
                    self.paths.append(xxhash.xxh3_64_intdigest(name, self.paths[node]) >> 1)
                    self.tags.append(tag)
                    node = len(self.paths) - 1
                fresh = tag in BLOCKS or clutter != stack[-1][3]
                stack.append((tag, node, articles + (tag in ("article", "main")), clutter))
                if fresh:
                    block = end_block()
                if tag in VOID:
                    stack.pop()
                elif m[3].endswith("/") and skip and tag not in BLOCKS:
                    stack.pop()
                continue
            height = self._open(tag, stack, skip)
            if tag == "a":
                links = max(0, links - 1)
            if height:
                self._left_open(stack, height)
                was, skip = skip, shorten(height)
                if tag in BLOCKS and not was:
                    links = 0
                if tag in BLOCKS or block.clutter != stack[-1][3]:
                    block = end_block()
            elif tag in BLOCKS:
                block = end_block()
        self._left_open(stack, 0)
        end_block()

    def _found_article(self, stack: list[tuple[str, int, int, int]]) -> None:
        """Forms around an article are content."""
        for tag, _, _, clutter in reversed(stack):
            if not clutter or self.content[clutter]:
                return
            if tag == "form":
                self.content[clutter] = True

    def _left_open(self, stack: list[tuple[str, int, int, int]], height: int) -> None:
        """Clutter above an element that ends lacks its own end tag: blocks of that kind are content."""
        for k in range(height + 1, len(stack)):
            tag, _, _, clutter = stack[k]
            if clutter and clutter != stack[k - 1][3] and self._must_close(tag):
                self.content[clutter] = True

    @staticmethod
    def _must_close(tag: str) -> bool:
        return tag in BLOCKS and tag != "p" and tag not in CLOSES

    @staticmethod
    def _implied_end(tag: str, stack: list[tuple[str, int, int, int]]) -> int:
        """The height to which a new block element ends open ones whose end tag may be left out."""
        closes, height = CLOSES.get(tag, ()), len(stack)
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k][0]
            if name == "p" or name in closes:
                height = k
            elif name == "table" or tag not in TABLE and (name == "button" or name in BLOCKS and not (closes and name in ("address", "div"))):
                break
        return height

    @staticmethod
    def _open(tag: str, stack: list[tuple[str, int, int, int]], skip: int) -> int:
        """The height of the element that an end tag ends, 0 if there is none: any inside clutter, else one in scope."""
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k][0]
            if name == tag:
                return k
            if (not skip or k < skip) and (name == "table" or name in CELLS and tag not in TABLE or tag not in BLOCKS and name in BLOCKS) and tag not in ("body", "html"):
                return 0
        return 0

    def _is_clutter(self, tag: str, attrs: dict[str, str], in_article: int) -> bool:
        if tag in CLUTTER_TAGS or tag == "header" and not in_article:
            return True
        if not attrs:
            return False
        if attrs.get("role", "").lower() in CLUTTER_ROLES or attrs.get("aria-hidden") == "true" or "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", ""):
            return tag not in ("html", "body")
        return tag not in ("html", "body", "article", "main") and any(map(is_clutter_name, f"{attrs.get('class', '')} {attrs.get('id', '')}".split()))

    @staticmethod
    def _least(tag: str, attrs: dict[str, str], in_article: int) -> float:
        if tag == "form":
            return 1.0
        named = {w.lower() for w in SPLIT.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
        certain = tag in CLUTTER_TAGS or tag == "header" and not in_article or not any(map(is_clutter_name, f"{attrs.get('class', '')} {attrs.get('id', '')}".split()))
        return math.inf if certain or named & CERTAIN_WORDS else MOST_OF

    def clean(self) -> list[tuple[int, str, int]]:
        """(node, text, linked) of the blocks with text."""
        out = []
        for b in self.blocks:
            if not self.content[b.clutter]:
                continue
            t = " ".join(entities.unescape("".join(b.parts)).split())
            if t:
                out.append((b.node, t, b.linked))
        return out

    def scores(self) -> dict[int, float]:
        """Each container path's score: the unlinked characters of blocks below it, by half for every level between."""
        gained: dict[int, float] = defaultdict(float)
        for node, t, linked in self.clean():
            gain, k = float(len(t) - min(len(t), 2 * linked)), node
            while k > 0 and gain >= 1:
                gained[self.paths[k]] += gain * (2.0 if self.tags[k] in ("article", "main") else 1.0)
                k, gain = self.parents[k], gain / 2
        return gained

    def inside(self, path: int) -> str:
        """The blocks in containers of that path, widened to their article, in page order, one on a line."""
        found, parents = self.clean(), self.parents
        size = len(self.paths)
        chosen, around, beside = [False] * size, [False] * size, [False] * size
        levels: list[int] = []
        for k in range(1, size):
            if self.paths[k] != path:
                continue
            chain = [k]
            while parents[chain[-1]] > 0:
                chain.append(parents[chain[-1]])
            whole = [a for tag in ("article", "main") for a in reversed(chain) if self.tags[a] == tag]
            chosen[whole[0] if whole else k] = True
            for a in chain[1:] if not whole else ():
                if not around[a]:
                    around[a] = True
                    levels.append(a)
        if levels:
            own = [[0, 0] for _ in range(size)]
            for node, t, linked in found:
                own[node][0] += len(t)
                own[node][1] += min(len(t), linked)
            below = [x[:] for x in own]
            for k in range(size - 1, 0, -1):
                below[parents[k]][0] += below[k][0]
                below[parents[k]][1] += below[k][1]

            def same(level: int, n: list[int]) -> bool:
                return n[0] >= 2 * n[1] and (self.tags[level] not in ("html", "body") or n[0] - n[1] >= BESIDE)

            for a in levels:
                beside[a] = same(a, own[a])
            for k in range(1, size):
                if around[parents[k]] and not around[k] and not chosen[k]:
                    chosen[k] = same(parents[k], below[k])
        for k in range(1, size):
            chosen[k] = chosen[k] or chosen[parents[k]]
        return "\n".join(t for node, t, _ in found if chosen[node] or beside[node])


def host(url: str = "url") -> F.Column:
    return F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's winner. A page votes for its containers' paths by their share of its score."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple[str | None, int], float] = defaultdict(float)
            for name, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                got = Page(html or "").scores()
                whole = sum(got.values())
                for path, v in got.items():
                    total[name, path] += v / whole if whole else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in total], pa.string()), pa.array([k[1] for k in total], pa.int64()), pa.array(list(total.values()), pa.float64())], ["host", "path", "votes"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path long, votes double").groupBy("host", "path").agg(F.sum(F.round("votes", 6).cast("decimal(28,6)")).alias("votes"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract_pages(pages: DataFrame, most_hosts: int = 20_000) -> DataFrame:
    """Adds `text` to every row of a table with `url` and `html`.

    The winners are broadcast where there are at most most_hosts of them; else they are joined by host, with
    the hosts' pages dealt over 16 salted copies of the winner.
    """
    small_batches(pages.sparkSession)
    keep = others(pages, "text")
    pages = pages.select(keep)
    key = F.coalesce(host(), F.lit(""))
    best = materialize(host_paths(pages.select(key.alias("host"), "html")).select(F.col("host").alias(HOST), F.col("path").alias(PATH)), "host-paths")
    known = pages.withColumn(HOST, key)
    small = bounded_broadcast(best, most_hosts)
    if small is not best:
        joined = known.join(small, HOST, "left")
    else:
        salted = best.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(15))))
        joined = known.withColumn(SALT, F.pmod(F.xxhash64("html"), F.lit(16)).cast("int")).join(salted, [HOST, SALT], "left")
    schema = T.StructType([*pages.schema, T.StructField("text", T.StringType(), False)])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, html in zip(b.column(PATH).to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(html or "")
                got = page.inside(path) if path is not None else ""
                if not got:
                    scores = page.scores()
                    got = page.inside(min(scores, key=lambda p: (-scores[p], p))) if scores else "\n".join(t for _, t, _ in page.clean())
                out.append(got)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(out, pa.string())], [*keep, "text"])

    return joined.select(*keep, PATH).mapInArrow(extract, schema)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
