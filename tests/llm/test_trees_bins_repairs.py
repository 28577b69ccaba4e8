"""Best-fit decreasing packing, conversation repair and the Merkle manifest against brute force."""

from __future__ import annotations

import bisect
import functools
import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("siteloom.llm")

from siteloom.llm import best_fit, merkle, repair, tokens


def plain_bins(lengths, window):
    """Bins of a plain best-fit decreasing."""
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, n)
        bins += k == len(rooms)
        bisect.insort(rooms, (rooms.pop(k) if k < len(rooms) else window) - n)
    return bins


@pytest.mark.parametrize(("window", "seed"), [(10, 1), (64, 2), (100, 3), (2048, 4)])
def test_moves_are_best_fit_decreasing(window, seed):
    rng = random.Random(seed)
    for spread in (window, window // 2, window // 5):
        lengths = [rng.randint(1, max(1, spread)) for _ in range(rng.randint(1, 3000))]
        counts = defaultdict(int)
        for n in lengths:
            counts[n] += 1
        bins = defaultdict(list)
        plan = best_fit.moves(counts, window)
        seen = defaultdict(int)
        for row in range(len(plan)):
            length, rank, first, each, offset = plan[row].tolist()
            end = plan[row + 1][1] if row + 1 < len(plan) and plan[row + 1][0] == length else counts[length]
            assert rank == seen[length]
            seen[length] = end
            for k in range(end - rank):
                bins[first + k // each].append((offset + k % each * length, length))
        assert seen == counts and len(bins) == plain_bins(lengths, window)
        for held in bins.values():
            at = 0
            for offset, n in sorted(held):
                assert offset == at
                at += n
            assert at <= window


def test_many_lengths_need_few_moves():
    counts = {n: 10**9 + 7 * n for n in range(1, 2049)}
    plan = best_fit.moves(counts)
    assert len(plan) < 100_000


def test_tightest_capacity():
    rng = random.Random(9)
    tree, held = best_fit.Capacities(77), set()
    for _ in range(3000):
        room = rng.randint(1, 77)
        if room in held and rng.random() < 0.6:
            tree.take(room)
            held.discard(room)
        elif room not in held:
            tree.put(room, 0, 1)
            held.add(room)
        need = rng.randint(1, 77)
        assert tree.tightest(need) == min((r for r in held if r >= need), default=None)


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def odd_documents():
    rng = random.Random(3)
    words = "alpha beta gamma, delta. Epsilon\n zeta".split(" ")
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(60)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One two"), (6, base), (7, base), (7, base), (8, base + " omega"), (9, prose(9000)), (None, base), (None, None), (10, "Ärger ÉTÉ x <|endoftext|>")]
    return rows + [(k, prose(rng.randint(1, 900))) for k in range(20, 90)]


@pytest.mark.parametrize("window", [2048, 100])
def test_best_fit_places_every_piece(spark, window):
    rows, path = odd_documents(), tokens.vocabulary("byte_bpe_50k.json")
    frame = spark.createDataFrame([(*r, "x", 5, 1) for r in rows], "doc_id long, text string, Piece string, part int, rank int").repartition(3)
    got = best_fit.pack_decreasing(frame, path, window).collect()
    want, lengths = defaultdict(int), []
    for i, text in rows:
        ids = np.array([*tokenizer(path).encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for k in range(-(-len(ids) // window)):
            n = (len(ids) % window or window) if k == 0 else window
            want[i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            lengths.append(n)
            at += n
    for r in got:
        want[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] -= 1
    assert not any(want.values())
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= window
    assert len(bins) == plain_bins(lengths, window)
    assert best_fit.pack_decreasing(frame.limit(0), path, window).collect() == []


def brute_repair(rows):
    """Dijkstra over (cost, audit), on rows of (conv_id, turn, role, text)."""
    spaced = lambda v: " " if v is None else str(v)
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        kind, role, text = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20, spaced(role), spaced(text)
        held = by[conv]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}
    for conv, held in by.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        turns, seen, faults = [r[0] for r in held if r[0] is not None], set(), []
        for _, role, text in held:
            solid = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not solid else "d" if (role, text) in seen else "t" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(held, held[1:], strict=False))
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, state, out = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(held) and state in (0, 3):
                break
            for initial in "ua":
                if (state, initial) in step:
                    heapq.heappush(heap, (cost + 5, audit + "I", i, step[state, initial], (*out, f"{names[initial]}:")))
            if i < len(held):
                _, role, text = held[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
                extra = 5 * (faults[i] == "t")
                if faults[i] not in ("b", "d"):
                    if (state, role[:1]) in step:
                        heapq.heappush(heap, (cost + extra, audit + "K", i + 1, step[state, role[:1]], (*out, f"{role}:{text}")))
                    for initial in "ua":
                        if (state, initial) in step:
                            heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, step[state, initial], (*out, f"{names[initial]}:{text}")))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def repaired(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, conv string, block int, code int")
    return sorted(map(tuple, repair.repair(frame).collect()), key=str)


def test_repair_of_odd_conversations(spark):
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "uno"]
    texts = ["Hi.", "Hello there", "ok!", "  ", "", None, "Yes?", "no", "a b c.  \n", "x ", "y. ", "z." * 40000]
    rows = []
    for conv in range(150):
        for turn in range(rng.randint(1, 14)):
            text = f"t{rng.random()}{rng.choice(['.', '', ' ?'])}" if rng.random() < 0.6 else rng.choice(texts)
            rows.append((conv or None, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(roles), text))
    rows += rows[:40]
    assert repaired(spark, rows) == sorted(brute_repair(rows), key=str)
    assert repaired(spark, []) == []


@pytest.mark.parametrize("bits", [2, 8])
def test_repair_of_long_conversations(spark, monkeypatch, bits):
    """One conversation with most rows lies in many blocks, over several tasks."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rng = random.Random(bits)
    rows = [(5, t, rng.choice(["user", "assistant", "system", "tool"]), f"t{rng.random()}{rng.choice(['.', '', '!'])}") for t in range(1200)]
    rows += [(6, t, "user", "a.") for t in range(300)] + [(7, t, "ua"[t % 2], f"{t}.") for t in range(300)]
    assert repaired(spark, rows) == sorted(brute_repair(rows), key=str)


def test_conversations_without_rows_after_damage(spark):
    dropped = [(c, t) for c in range(300) for t in range(3) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = repaired(spark, [(c, t, "user", "x.") for c, t in dropped if sum(c == d for d, _ in dropped) == 1])
    assert got and {r[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def hexed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for i, source, lang, n, text in rows:
        leaf, hit = (hexed("".join(map(field, (i, source, lang, m, text)))) for m in (n, n if n is None else n + 1))
        by[lang].append((i, leaf, hit if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else leaf))

    def tree(level):
        levels = [level]
        while len(level) > 1:
            level = [hexed("".join(level[k : k + 2])) for k in range(0, len(level), 2)]
            levels.append(level)
        return levels

    def siblings(levels, i):
        for level in levels[:-1]:
            yield i, [(j, level[j]) for j in range(i // 2 * 2, min(i // 2 * 2 + 2, len(level))) if j != i]
            i //= 2

    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for held in by.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [tree([leaf for _, leaf, _ in by[lang]]) for lang in langs]
    top = tree([t[-1][0] for t in trees])
    for k, lang in enumerate(langs):
        for at, (i, leaf, digest) in enumerate(by[lang]):
            proof = [*siblings(trees[k], at), *siblings(top, k)]
            for own, others in proof:
                digest = hexed("".join(d for _, d in sorted([(own, digest), *others])))
            yield i, leaf, trees[k][-1][0], top[-1][0], hexed("".join(d for _, o in proof for _, d in o)), digest, digest == top[-1][0]


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_manifest_against_brute_force(spark, levels):
    """Bands of one level send every message through Spark; one language has most rows, others few."""
    rng = random.Random(levels)
    langs = ["en"] * 6 + ["de", "é", "z", None, ""]
    rows = [(k, rng.choice(["s", None]), rng.choice(langs), rng.choice([None, 3, 10**15]), rng.choice(["", None, "text é", "x" * 50_000])) for k in range(0, 260)]
    rows += [(3, "s", "en", 1, "tie"), (3, "s", "en", 1, "tie"), (3, "s", "en", 2, "tie"), (None, "s", "en", 1, "a"), (None, None, None, None, None), (-5, "s", "lone", 1, "a")]
    frame = spark.createDataFrame([(*r, "t", 1, 2, "d") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, index long, n long, digest string")
    got = sorted(map(tuple, merkle.manifest(frame, levels).collect()), key=str)
    assert got == sorted(brute_manifest(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, "s", "en", 1, "alone")], [(14, None, None, 1, "a"), (15, None, "b", 1, "c")]])
def test_manifest_of_few_rows(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(tuple, merkle.manifest(frame).collect())) == sorted(brute_manifest(rows))
