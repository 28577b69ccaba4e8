"""The training-data operators against brute force, round trips and held-out rows, with their edge cases."""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("siteloom.llm")

from siteloom.llm import decontaminate, html, jaccard, language, lm, packing, tokens, topk, toxicity, warc
from siteloom.llm import queries as registered
from siteloom.llm.common import passing, salted_join, shared_dir, without
from siteloom.tables import application_folder

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names could clash."""
    rng = random.Random(3)
    base = prose(rng, 60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (5, "one TWO"), (6, base), (7, base), (7, base), (8, base + " omega"), (9, prose(rng, 5000)), (None, base), (10, "Ärger ÉTÉ x"), (11, prose(rng, 40) + " <|endoftext|>\n\n  end "), (12, "a\tb  c\r\nd \n")]
    frame = spark.createDataFrame([(*r, "en", "s", 1, 1) for r in rows], "doc_id long, text string, lang string, source string, n long, row long")
    return frame, rows


def blank_words(text):
    return [w for w in re.split(r"[ \t-\r]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if w]


def brute_classes(rows, k, num, den):
    sets = {}
    for i, text in rows:
        ws = blank_words(text)
        sets.setdefault(i, set()).update(tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)) if len(ws) >= k else sets.setdefault(i, set()).update([tuple(ws)] if ws else [])
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations([i for i in sets if i is not None and sets[i]], 2):
        if len(sets[a] & sets[b]) * den >= num * len(sets[a] | sets[b]):
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {i: (len(s), root(i) if i is not None else None) for i, s in sets.items()}


def test_jaccard_edges(spark, odd_docs):
    frame, rows = odd_docs
    got = jaccard.near_duplicate_classes(frame, 3, 9, 10).collect()
    assert len(got) == len(rows)
    want = brute_classes(rows, 3, 9, 10)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
    assert jaccard.near_duplicate_classes(frame.limit(0)).collect() == []


@pytest.mark.parametrize(("k", "num", "den"), [(3, 9, 10), (5, 4, 5), (2, 1, 2)])
def test_jaccard_random_families(spark, k, num, den):
    rng = random.Random(k)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    for _ in range(12):
        origin = [rng.choice(vocab) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = [rng.choice(vocab) if rng.random() < rng.choice([0, 0.005, 0.02, 0.05]) else w for w in origin]
            rows.append((i, " ".join(copy)))
            i += 7
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
    assert got == brute_classes(rows, k, num, den)


def test_components_of_a_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in jaccard.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {100: 100, 101: 100}


def brute_contamination(text, items, size=13):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for item, t in items:
        iw = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        n = min(size, len(iw))
        for k in range(len(iw) - n + 1) if iw else ():
            for p in range(len(ws) - n + 1):
                if ws[p : p + n] == iw[k : k + n]:
                    hit.update(range(p, p + n))
                    names.add(str(item))
    return len(ws), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


def test_decontamination_against_brute_force(spark, odd_docs):
    rng = random.Random(5)
    items = [(1, prose(rng, 30)), (2, "One, TWO!"), (10, None), (11, "..."), (12, prose(rng, 13)), (13, prose(rng, 20))]
    rows = [*odd_docs[1], (20, prose(rng, 50) + " " + items[0][1] + " " + prose(rng, 30)), (21, items[4][1].upper() + "; " + items[4][1]), (22, " ".join(items[5][1].split()[2:16])), (23, prose(rng, 400) + " " + " ".join(items[0][1].split()[:13]))]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, *brute_contamination(t, items)) for i, t in rows], key=str)
    got = decontaminate.summary(decontaminate.contaminated_spans(docs, bench)).collect()
    assert sorted(map(tuple, got), key=str) == want
    none = decontaminate.summary(decontaminate.contaminated_spans(docs, bench.limit(0))).collect()
    assert not any(r["contaminated"] for r in none)


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plain_ids(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name, monkeypatch):
    path = tokens.vocabulary(name)
    encode = tokens.encoder(path)
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "e\u0301", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2028", "'s", "'", "1", "20", "0", "!", "--", ",", ".", "a,", "b. ", "_", "\u4e2d", "\u0130", "\u03a3", "\u03c2", "\u0391\u03a3", "\x00", "\x1c", "\x85", "\u200b", "\U0001f600", "<|endoftext|>", "<|", "word", "The", "\u00d6", "\u00b2", "\u00bd", "\u0663", "\u0101", "\u0416", "\u02bc", "\u0374", "\u212b", "\u017f", "\u01c5", "\u00ab", "!!", "(2)", "\u65e5\u672c\u8a9e" * 9, "\u0e20\u0e32\u0e29\u0e32", "\ud55c\uad6d", "'LL", "\u00ad"]
    every = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(900)]
    every += [f"{a}{chr(c)}{b}" for c in range(1, 0x600) for a, b in (("", ""), ("a", "b"), (" ", "1"))]
    monkeypatch.setattr(tokens, "MEMO_CUTS", 700)
    batches = [every[k : k + 500] for k in range(0, len(every), 500)]
    for text, got in zip([*every, None], [x for b in [*batches, [None]] for x in encode(b)], strict=True):
        assert np.frombuffer(got, dtype="<u4").tolist() + [1] == plain_ids(path, text), repr(text)


def test_tokens_round_trip(spark, odd_docs):
    frame, rows = odd_docs
    path, uri = tokens.vocabulary("word_bpe_49k.json"), shared_dir(spark, "t")
    manifest = tokens.write_tokens(frame, uri, path, parts=3)
    got = tokens.read_tokens(manifest, uri).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: -1 if i is None else i)
    want = defaultdict(Counter)
    for i, t in rows:
        ids = plain_ids(path, t)
        want[i][len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += 1
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]][r["n_tokens"], r["ids_crc32"]] -= 1
    assert not any(v for c in want.values() for v in c.values())
    empty = tokens.write_tokens(frame.limit(0), shared_dir(spark, "t"), path)
    assert tokens.read_tokens(empty, uri).collect() == []


def check_packing(rows, pieces, path, window):
    bounds, filled = defaultdict(list), defaultdict(list)
    for p in pieces:
        bounds[p["doc_id"]].append(p)
        filled[p["sequence_id"]].append((p["offset"], p["length"]))
    for spans in filled.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= window
    for i, copies in Counter(rows).items():
        if Counter(x for x, _ in rows)[i[0]] > 1:
            continue
        ids = plain_ids(path, i[1])
        spans = sorted(bounds[i[0]], key=lambda p: p["start"])
        assert sum(p["length"] for p in spans) == len(ids) * copies
        at = 0
        for p in spans:
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], dtype="<u4").tobytes())
            at += p["length"]
    return filled


def test_packing(spark, odd_docs):
    frame, rows = odd_docs
    path = tokens.vocabulary("byte_bpe_50k.json")
    got = packing.pack(frame.repartition(3), path, window=64, most=2, fan_in=2).collect()
    check_packing(rows, got, path, 64)
    assert packing.pack(frame.limit(0), path).collect() == []


def test_packing_pads_little(spark, sf_dir):
    got = packing.op10_packing(spark, sf_dir).collect()
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    filled = check_packing(rows, got, tokens.vocabulary("byte_bpe_50k.json"), 2048)
    used = sum(n for spans in filled.values() for _, n in spans)
    assert used >= 0.95 * 2048 * len(filled) - 2048


def test_best_fit_within_bounded_space():
    p = packing.Packer(0, 10, 2)
    for n in (6, 7, 3, 5, 9):
        p.add((n, 0, n, 0, n))
    p.finish(False)
    by = defaultdict(list)
    for row in p.done:
        by[row[5]].append(row[2])
    assert sorted(map(sorted, by.values())) == [[3, 7], [5], [6], [9]]


def test_warc_round_trip(spark):
    rng = random.Random(9)
    long = prose(rng, 9000)
    rows = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (5, None, "x"), (3, "http://a/3", None), (4, "http://a/ 4", ""), (6, "http://b", long), (7, "http://b", "Ärger\r\n\r\n0\r\n\r\n"), (None, "http://c", "x"), (8, "http://d", "y"), (8, "http://d", "y"), (9, "http://e", long + "!")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, file int")
    uri = shared_dir(spark, "w")
    files = warc.write_archives(frame.repartition(2), uri)
    records = warc.read_records(files, uri)
    assert records.where("number > 1").count() > 3
    got = warc.reassemble(records).collect()
    last = {}
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        revisit = i is None and (h or "") in last or i is not None and i < last[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[h or ""] if revisit else None, None if revisit else data))
    assert sorted([(*tuple(r)[:5], None if r["payload"] is None else bytes(r["payload"])) for r in got], key=str) == sorted(want, key=str)
    lost = records.where("number <> 2")
    with pytest.raises(Exception, match="segments are missing"):
        warc.reassemble(lost).collect()
    none = warc.write_archives(frame.limit(0), uri)
    assert warc.reassemble(warc.read_records(none, uri)).collect() == []


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 20000])
def test_chunks(size):
    data = random.Random(size).randbytes(size)
    assert warc.decode_chunks(warc.encode_chunks(data)) == data


def test_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    vectors = [base[rng.integers(40)] + rng.normal(size=64) * rng.choice([0, 0.1, 1.0]) for _ in range(600)]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(700, None), (701, [1.0]), (None, vectors[0].tolist()), (5, vectors[5].tolist()), (702, [float("nan")] * 64), (720, [None] * 64)]
    found = topk.codes(spark.createDataFrame(rows, "id long, vector array<double>"))
    bits = {i: tuple(x is not None and x > 0 for x in v) for i, v in rows if i is not None and v is not None and len(v) == 64}
    got = defaultdict(list)
    for r in topk.nearest(found, found.where("id % 20 = 0"), block=100, chunk=10).collect():
        got[r["query_id"]].append((r["rank"], r["distance"], r["neighbour_id"]))
    for q in [i for i in bits if i % 20 == 0]:
        want = sorted((sum(a != b for a, b in zip(bits[q], bits[i], strict=True)), i) for i in bits if i != q)[:10]
        assert sorted(got[q]) == [(k, d, i) for k, (d, i) in enumerate(want, 1)]
    assert topk.nearest(found.limit(0), found).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header>Top</header><nav><ul><li><a href="/">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="content{k}"><article><header><h1>Head &amp; tail {k}</h1></header><p>First <b>bold</b>text,   with
space<p>Second&nbsp;one &lt;tag&gt; number {k} of many words that make it long enough<ul><li>A<li>B</ul><div class="ad">Buy</div>
<form><input value="x">Send</form><!-- note <p>hidden</p> --><section id="comments"><p>Reader says</p></section></article></div>
<aside>Side</aside><footer>&copy; Foot</footer></body></html>"""


def test_html_article_alone(spark):
    rows = [(k, f"https://h.example/{k}", PAGE.format(k=k)) for k in range(6)] + [(10, "https://h.example/x", None), (11, None, ""), (12, "odd", "plain &amp; simple"), (13, "https://q.example/", "<p>one<p>two<br>three")]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, path string")).collect()}
    for k in range(6):
        assert got[k] == f"Head & tail {k}\nFirst boldtext, with space\nSecond one <tag> number {k} of many words that make it long enough\nA\nB"
    assert got[10] == got[11] == "" and got[12] == "plain & simple" and got[13] == "one\ntwo three"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<article><p>A<p class="ad">Buy<p>B</p><p>C</p></article>', "A B C"),
        ("<article><ul><li>A<li class=share>S<li>B</ul><p>C</article>", "A B C"),
        ("<article><dl><dt>A<dd class=ad>S<dt>B</dl><p>C</article>", "A B C"),
        ("<article><table><tr><td>A<td class=sidebar><div>S<td>B<tr class=ad><td>S<tr><td>C</table>D</article>", "A B C D"),
        ("<main><div><p>A<div class=ad><p>S<ul><li>S</div>B</div><p>C <span class=share>S</p><p>D</main>", "A B C D"),
        ("<article>A<div class=one>" + "B" * 200 + "</div><div class=two>C</div>D</article>", "A " + "B" * 200 + " C D"),
        ('<article><section id="discussion">A</section><p class="social-science">B</p><div class="social-links">S</div><div id=commentsSection>S</div></article>', "A B"),
        ("<body><form action=x><div><article><p>A<p>B</article></div><input></form></body>", "A B"),
        ("<body><form><input>S</form><nav><a>N</a><article><p>A</article><nav>S</nav></body>", "A"),
        ("<body><nav>S<main><p>A <math><mi>x</mi></math><p>B", "A_x B"),
        ("<article><p title=it's>A</p><p title='b>c' x=d\"e>B</p></article>", "A B"),
        ("<body><div class=w><h1>A</h1><div class=one>" + "B" * 200 + "</div><div class=two>C</div><div class=m><a>S S</a></div></div><div class=legal>S</div>", "A " + "B" * 200 + " C"),
    ],
)
def test_html_whole_article(spark, page, want):
    got = html.extract_pages(spark.createDataFrame([("https://h.example/", page)], "url string, html string")).first()["text"]
    assert got == want.replace(" ", "\n").replace("_", " ")


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body><form action='/x'><div id=m><p>Server pages put all in a form.</p><nav><a href=a>Menu</a></nav><p>Short.</p></div><input name=q></form></body>", "Server pages put all in a form.\nShort."),
        ("<body><div class='menu-item'><p>" + "The only long paragraph of the page. " * 4 + "</p></div></body>", ("The only long paragraph of the page. " * 4).strip()),
        ("<body><article><p>A short article.</p></article><div class='comments'>" + "<p>A reader says a lot about it all.</p>" * 9 + "</div></body>", "A short article."),
        ("<body><article><p>A short article.</p></article><div class='cookie-consent'>" + "We keep things on your machine. " * 30 + "</div></body>", "A short article."),
        ("<body><main>" + "".join(f"<form><h1>Title {k}</h1><p>Text {k}.</p></form>" for k in range(12)) + "</main></body>", "\n".join(f"Title {k}\nText {k}." for k in range(12))),
        ("<body><article><h1>T</h1><form><p>Sign up here, it is free.</p></form><p>Text of the article, longer than the form's.</p></article></body>", "T\nText of the article, longer than the form's."),
    ],
)
def test_html_mistaken_clutter(spark, page, want):
    got = html.extract_pages(spark.createDataFrame([("https://h.io/a", page)], "url string, html string")).first()
    assert got["text"] == want


def test_html_tags_that_never_close_take_linear_time():
    began = time.monotonic()
    for tag in ("select", "svg", "noscript", "form", "div class=ad", "nav"):
        html.Page(f"<p>x</p>{f'<{tag}>' * 20_000}<p>end</p>")
    assert time.monotonic() - began < 20


def test_html_deep_long_and_clashing(spark):
    deep = "<div>" * 20_000 + "deep text here" + "</div>" * 20_000
    long = "<article>" + "".join(f"<p>line {k} of a very long page</p>" for k in range(60_000)) + "</article>"
    rows = [("u", deep, "own", 1, "h"), ("u", long, "own", 2, "h"), ("u", long, "own", 2, "h"), (None, "<nav>" * 3000 + "x", "own", 3, None)]
    frame = spark.createDataFrame(rows, "url string, html string, TEXT string, path int, host string")
    got = html.extract_pages(frame).select("path", "host", "text").collect()
    assert sorted((r["path"], len(r["text"].split("\n"))) for r in got) == [(1, 1), (2, 60_000), (2, 60_000), (3, 1)]
    assert html.extract_pages(frame.limit(0)).collect() == []


def test_html_given_pages(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html as entities

    for r in html.op5_html(spark, sf_dir).collect():
        inner = re.search(r"<article>(.*)</article>", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|li|ul)>", inner.replace("<br>", " "))]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_toxicity_learns_a_pair(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        docs.append((i, " ".join([prose(rng, 20), *(["fool"] if insult else []), *(["people"] if group else [])])))
        labels.append((i, int(insult and group)))
    docs += [(5000, None), (5001, ""), (None, "fool people")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    machine = toxicity.train_toxicity(frame, spark.createDataFrame([*labels, (7000, None), (7001, 1)], "doc_id long, toxic int"), max_rows=1000)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(frame, machine).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, y in labels[1000:]]) > 0.97
    assert 0 <= got[5000] == got[5001] < 0.5 < got[None]
    none = toxicity.train_toxicity(frame, spark.createDataFrame([], "doc_id long, toxic int"))
    assert max(r["toxicity"] for r in toxicity.score_toxicity(frame, none).collect()) < 0.01


def test_toxicity_of_exactly_one_of_two_words(spark):
    """Neither word alone tells anything; only their pair does."""
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(1500):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        docs.append((i, " ".join([prose(rng, 20), *(["fool"] if one else []), *(["people"] if two else [])])))
        labels.append((i, int(one != two)))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Toxicity", F.lit("own"))
    machine = toxicity.train_toxicity(frame, spark.createDataFrame([*labels, *labels[:50]], "doc_id long, toxic int"), max_rows=1000)
    got = {r["doc_id"]: r["toxicity"] for r in toxicity.score_toxicity(frame.union(frame.limit(3)), machine).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, y in labels[1000:]]) > 0.95


def test_factorization_machine_by_hand():
    rng = np.random.default_rng(3)
    fm = toxicity.FactorizationMachine(np.arange(9), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    ids = np.array([1, 4, 5, 8])
    pairs = sum(float(fm.factors[a] @ fm.factors[b]) for a, b in itertools.combinations(ids, 2))
    assert fm.margin(ids) == pytest.approx(0.3 + fm.weights[ids].sum() + pairs)
    assert fm.margin(ids[:0]) == 0.3


def test_toxicity_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == r["toxic"] for r in got]) > 0.9


def test_language(spark, odd_docs):
    sf = "/root/testdata/sf0.01"
    net = language.learn(spark, sf)
    got = language.predict_language(spark.read.parquet(f"{sf}/documents.parquet"), net).collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95 and all(0 <= r["lang_score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in language.predict_language(odd_docs[0], net).collect()}
    assert odd[1] == odd[2] == odd[3] == "und" and odd[10] in net.langs
    empty = language.train_language(odd_docs[0].limit(0))
    assert {r["lang_pred"] for r in language.predict_language(odd_docs[0], empty).collect()} == {"und"}


def test_unsure_languages_go(spark, sf_dir):
    """The stage keeps what one language has the majority of: by the network's score, not by the letters alone."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.union(spark.createDataFrame([(-1, "12 34", None), (-2, None, None), (-3, "Re.", None)], docs.schema))
    net = language.learn(spark, sf_dir)
    scores = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in language.predict_language(docs, net).collect()}
    middle = sorted(s for _, s in scores.values())[len(scores) // 2]
    for least in (language.MAJORITY, middle):
        kept = {r["doc_id"] for r in language.known_language(spark, docs, sf_dir, least).collect()}
        assert kept == {i for i, (lang, score) in scores.items() if lang != "und" and score > least}
    assert not kept & {-1, -2} and len(kept) < len(scores)


def test_convolution_equals_a_plain_one():
    rng = np.random.default_rng(5)
    n = 4
    net = language.ByteNet(["a", "b", "c"], rng.normal(size=(256, 3)).astype(np.float32), [rng.normal(size=(w, 3, n)).astype(np.float32) for w in language.WIDTHS], [rng.normal(size=n).astype(np.float32) for _ in language.WIDTHS], rng.normal(size=(n * len(language.WIDTHS), 3)).astype(np.float32), rng.normal(size=3).astype(np.float32))
    x = rng.integers(0, 256, (3, language.WINDOW)).astype(np.uint8)
    got = language.log_probabilities(net, net.folded(), x)
    for row, out in zip(x, got, strict=True):
        emb, pooled = net.embed[row], []
        for w, f, b in zip(language.WIDTHS, net.filters, net.biases, strict=True):
            every = [sum(emb[p + j] @ f[j] for j in range(w)) + b for p in range(len(row) - w + 1)]
            pooled.append(np.maximum(np.max(every, axis=0), 0))
        z = np.concatenate(pooled) @ net.dense + net.offset
        assert out == pytest.approx(z - np.log(np.exp(z - z.max()).sum()) - z.max(), abs=1e-3)


def test_windows_cover_the_text():
    for n in (0, 1, 255, 256, 257, 512, 1000):
        data = random.Random(n).randbytes(n)
        got = language.windows(data)
        assert all(len(w) == language.WINDOW for w in got)
        if n >= language.WINDOW:
            assert b"".join(got[:-1]) + got[-1][-(n % language.WINDOW or language.WINDOW) :] == data


def brute_backoff(rows, order):
    """(n_words, log score) of each row by the definition, counting over all other rows."""
    texts = [blank_words(t) for _, t in rows]
    grams = lambda ws, n: Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))
    every = {n: sum((grams(ws, n) for ws in texts), Counter()) for n in range(1, order + 1)}
    out = []
    for ws in texts:
        rest = {n: every[n] - grams(ws, n) for n in every}
        total = max(1, sum(every[1].values()) - len(ws))

        def score(context, w, rest=rest, total=total):
            if not context:
                return max(1, rest[1][w,]) / total
            if found := rest[len(context) + 1][(*context, w)]:
                return found / rest[len(context)][context]
            return 0.4 * score(context[1:], w)

        out.append((len(ws), sum(np.log(score(tuple(ws[max(0, k - order + 1) : k]), w)) for k, w in enumerate(ws)) if ws else None))
    return out


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_stupid_backoff_against_brute_force(spark, odd_docs, order, monkeypatch):
    rng = random.Random(8)
    rows = [*odd_docs[1], *((100 + k, prose(rng, rng.randint(1, 30))) for k in range(40)), (3, "a b a b a b")]
    monkeypatch.setattr(lm, "CHUNK_WORDS", 50)
    monkeypatch.setattr(lm, "WORDS_A_PART", 1)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, chunk string")
    got = sorted(((r["doc_id"], r["n_words"], r["log_score"]) for r in lm.stupid_backoff(frame, order).collect()), key=str)
    want = sorted(((i, n, s) for (i, _), (n, s) in zip(rows, brute_backoff(rows, order), strict=True)), key=str)
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=lambda r: (str(r[:2]), r[2] or 0)), sorted(want, key=lambda r: (str(r[:2]), r[2] or 0)), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None) and (a[2] is None or a[2] == pytest.approx(b[2], abs=1e-3))
    if order == 3:
        assert lm.stupid_backoff(frame.limit(0)).collect() == []


def test_codes_of_many_words():
    codes = np.random.default_rng(1).integers(0, 200_000, 5000)
    assert (lm.unpack_codes(lm.pack_codes(codes)) == codes).all()
    assert len(lm.unpack_codes(lm.pack_codes(codes[:0]))) == 0


def test_stages_leave_columns_and_odd_rows(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(12)
    base, other = prose(rng, 60), " ".join(rng.choice("den haus und der mit aus".split()) for _ in range(40))
    rows = [(5, base), (5, base), (5, base + " omega"), (7, base), (None, base), (None, None), (8, None), (8, None), (9, ""), (9, other), (10, prose(rng, 9000)), (11, other + " x")]
    frame = spark.createDataFrame([(*r, "own", 7, "keep", "k", 0.5, "z") for r in rows], "doc_id long, text string, toxicity string, n_words int, items string, Lang_Pred string, row double, source string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (frame, frame.limit(0)):
            got = stage(spark, docs, sf_dir)
            assert got.columns == frame.columns, name
            kept = [tuple(r) for r in got.collect()]
            assert not Counter(kept) - Counter(tuple(r) for r in docs.collect()), name
            if name == "near_duplicates" and docs is frame:
                assert sorted(((r[0], r[1]) for r in kept), key=str) == sorted([(5, base), (8, None), (None, None), (9, ""), (9, other), (10, rows[10][1])], key=str)
    assert corpus_pipeline.STAGES[-1][1](spark, frame.limit(0), sf_dir).collect() == []


def test_hot_keys_are_salted(spark):
    rows = spark.createDataFrame([(1, k) for k in range(300)] + [(k, k) for k in range(2, 40)] + [(None, 1), (99, 2)], "key long, v long")
    names = spark.createDataFrame([(k, f"n{k}") for k in range(60)], "key long, name string")
    for how in ("inner", "left"):
        got = sorted(map(tuple, salted_join(rows, names, "key", how, least=10).select("key", "v", "name").collect()), key=str)
        assert got == sorted(map(tuple, rows.join(names, "key", how).select("key", "v", "name").collect()), key=str)


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    pieces = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_registered_queries_run(spark, sf_dir):
    for name, query in registered.queries().items():
        assert query(spark, sf_dir).limit(1).count() == 1, name


def test_parities_tell_far_sets_apart_and_no_near_ones():
    rng = np.random.default_rng(3)
    apart = lambda a, b: sum(int(x).bit_count() for x in jaccard.parity(a).view(np.uint64) ^ jaccard.parity(b).view(np.uint64))
    for n in (3, 40, 300, 900):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        other = np.concatenate([base[: n // 3], rng.integers(0, 1 << 63, n - n // 3, dtype=np.uint64)])
        assert apart(base, other) * 9 > 2 * n or n < 10
        for gone in range(0, n // 2, max(1, n // 7)):
            near = base[gone:]
            assert apart(base, near) <= gone


def test_jaccard_without_broadcasts_keeps_no_spent_tables(spark, monkeypatch):
    """Where ids are too many for a broadcast a filter of bits chooses texts; tables read for the last time are gone."""
    monkeypatch.setattr(jaccard, "MAX_BROADCAST", 0)
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(8):
        origin = [rng.choice(vocab) for _ in range(rng.randint(20, 90))]
        for _ in range(6):
            rows.append((3 * len(rows), " ".join(rng.choice(vocab) if rng.random() < rng.choice([0, 0.01, 0.03]) else w for w in origin)))
    rows += [(1000 + i, rows[i][1]) for i in range(0, 40, 3)] + [(2000, None), (2001, " ")]
    folder = Path(application_folder(spark).removeprefix("file://"))
    before = {p.name for p in folder.glob("*")}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10).collect()}
    assert got == brute_classes(rows, 3, 9, 10)
    kept = {p.name.rpartition("-")[0] for p in folder.glob("*") if p.name not in before}
    assert "index" in kept and not kept & {"sets", "entries", "blocks", "pivot-pairs", "other-pairs"}
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    ids = frame.where("doc_id % 2 = 0").select("doc_id")
    assert {r["doc_id"] for r in without(frame, "doc_id", ids, 0).collect()} == {i for i, _ in rows if i % 2}
    assert {r["doc_id"] for r in passing(frame, "doc_id", ids, 0).collect()} >= {i for i, _ in rows if i % 2 == 0}


def test_entries_that_meet_no_set_of_like_size_enter_no_list(spark):
    sets = [(1, 10, [7]), (2, 11, [7]), (3, 30, [7]), (4, 90, [5]), (5, 100, [5, 9]), (6, 400, [9]), (7, 50, [6]), (8, 50, [6])]
    index = spark.createDataFrame([(*s, [0] * 8) for s in sets], "node long, n int, tokens array<long>, parity array<long>")
    got = {(r["token"], r["node"], r["pos"]) for r in jaccard.entries(index, 9, 10).collect()}
    assert got == {(7, 1, 0), (7, 2, 0), (5, 4, 0), (5, 5, 0), (6, 7, 0), (6, 8, 0)}
