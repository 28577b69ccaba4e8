"""Token ids of whole texts, and their flat binary files.

Encoding. Both tokenizers split texts before they merge bytes, and a text may be cut between two of those
pieces without a change to its ids. So the texts of a batch are cut at single spaces, line ends, commas and full
stops, the distinct cuts that the worker doesn't hold yet are encoded by the tokenizers library (words of plain
letters, digits and marks piece by piece by its model, the others as they are), and a text's ids are the concatenation. Texts in which white space meets white space are cut with a regular
expression that leaves such runs whole.

Files. Rows are put in ascending doc_id order over range partitions. Each partition writes one set of flat
files: `.tok` (unsigned ids), `.off` (64-bit token offsets, one more than documents), `.doc` (64-bit ids) and
`.set` (a byte that is 0 for a null id). A partition's base, the number of ids before it, is the prefix sum of
the partitions' counts; a reader adds it to the local offsets. A file gets its name when it is complete, so
that a task that is run again replaces what a lost one left.

Edge cases: a null text is an empty one and has the end id alone; rows with a null doc_id come first and keep
their null; rows that share a doc_id are ordered by a hash of the text, then by the text; an empty table gives files without documents; extra
columns are ignored.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyarrow import fs as pafs

from siteloom.llm.common import materialize, shared_dir, small_batches, table

END_ID = 1
#: A task's memo is cut down to its last batch's entries beyond so many cuts, or so many characters in them.
MEMO_CUTS, MEMO_CHARS = 250_000, 16_000_000
#: A place between two pieces: before a single space, with no other white space around it.
CUT = re.compile(r"(?<=\S)(?= \S)")
RUNS = re.compile(r"\s\s")
#: A comma or a full stop after anything but a plain letter or digit; elsewhere a cut may end before it.
BEFORE_MARK = re.compile(r"[^A-Za-z0-9\u00df-\u00f6\u00f8-\u00ff][.,]")
#: Characters below this have the same properties in every Unicode version in use.
OLD_LETTERS = "\u0530"
#: Letters, digits, or other marks but apostrophes: such runs are pieces.
PIECE = re.compile(r"[^\W\d_]+|\d+|(?:[^\w\s']|_)+")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Numbers cuts in the order in which they are first asked for; `fresh` are those not encoded yet."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, cut: str) -> int:
        self.fresh.append(cut)
        self[cut] = n = len(self)
        return n


class Encoder:
    """Texts to their ids as little-endian unsigned 32-bit integers, without the end id."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.path, self.memo, self.chars = path, Memo(), 0
        self.ids, self.ends = np.zeros(1 << 16, "<u4"), np.zeros(1, np.int64)
        ids = lambda text: self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids
        self.drops_space = ids("a b") == ids("a") + ids("b") and ids(" a") == ids("a")
        self.lowers = ids("A") == ids("a")
        self.glue = " 0 " if self.drops_space else "\n"
        between = ids(self.glue)
        if ids(f"a{self.glue}b") != ids("a") + between + ids("b") or len(between) != 1:
            raise ValueError(f"{path}: this tokenizer's pieces can't be told apart")
        self.between = between[0]
        self.odd = re.compile(r"(?s).\s|^[^\S ]|^ $|<\||" + self.glue.strip(" "))
        # Byte-level vocabularies spell each byte as a letter of its own; learned here from the library.
        spelled = self.tok.pre_tokenizer.pre_tokenize_str
        self.letters = {pair[k]: "".join(x for x, _ in spelled(pair.decode()))[k] for pair, k in self._high_bytes()}
        self.space = "" if self.drops_space else spelled(" a")[0][0][0]

    @staticmethod
    def _high_bytes() -> Iterator[tuple[bytes, int]]:
        """Characters of two bytes that hold all high bytes of characters below OLD_LETTERS, each with a byte's place."""
        seen: set[int] = set()
        for c in map(chr, range(0x80, ord(OLD_LETTERS))):
            pair = c.encode()
            for k in range(0 if c.isspace() else 2):
                if pair[k] not in seen:
                    seen.add(pair[k])
                    yield pair, k

    def _cuts(self, text: str) -> list[str]:
        commas = not BEFORE_MARK.search(text)
        if self.drops_space:
            if self.lowers and "<|" not in text:
                text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            text = text.replace(",", " ,").replace(".", " .") if commas else text
            return text.replace("\n", " ").split(" ")
        if RUNS.search(text) or "\0" in text:
            return CUT.split(text)
        text = text.replace(",", "\0,").replace(".", "\0.") if commas else text
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _pieces(self, cut: str) -> list[str] | None:
        """A cut's pieces, spelled for the library's model, if all its characters are old and plain; else None."""
        w = cut[1:] if cut[:1] == " " and not self.drops_space else cut
        if not w.isascii() and (max(w) >= OLD_LETTERS or not is_normalized("NFC", w) or "\u03a3" in w):
            return None
        w = w.lower() if self.lowers else w
        if w.isalpha():
            found = [w]
        else:
            found = PIECE.findall(w)
            if not found or "<|" in w or not w.isprintable() or sum(map(len, found)) < len(w) or not all(x.isalpha() for x in found if x[0].isalnum() and not x[0].isdecimal()):
                return None
            if self.drops_space:
                found = [y for x in found for y in (x if x[0].isdecimal() else (x,))]
        if not w.isascii():
            found = [x.encode().decode("latin-1").translate(self.letters) for x in found]
        if cut[0] == " " and not self.drops_space:
            found[0] = self.space + found[0]
        return found

    def _learn(self, new: list[str]) -> None:
        found: list = [()] * len(new)
        plain, rest = [], []
        model = self.tok.model.tokenize
        for k, x in enumerate(new):
            if not x:
                continue
            pieces = self._pieces(x)
            if pieces is not None:
                found[k] = [t.id for piece in pieces for t in model(piece)]
            else:
                (rest if self.odd.search(x) else plain).append(k)
        if plain:
            got = np.array(self.tok.encode_batch_fast([self.glue.join(new[k] for k in plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.append(np.flatnonzero(got == self.between), len(got)).tolist()
            if len(ends) != len(plain):
                raise ValueError("a piece holds the separator's id")
            start = 0
            for k, end in zip(plain, ends, strict=True):
                found[k] = got[start:end].tolist()
                start = end + 1
        for k, e in zip(rest, self.tok.encode_batch_fast([new[k] for k in rest], add_special_tokens=False), strict=True):
            found[k] = e.ids
        ends = self.ends[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        if ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(ends[-1], len(self.ids)), "<u4")])
        self.ids[self.ends[-1] : ends[-1]] = np.fromiter(chain.from_iterable(found), "<u4", ends[-1] - self.ends[-1])
        self.ends = np.concatenate([self.ends, ends])
        self.chars += sum(map(len, new))

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the cuts at these places, one after the other, and where each cut ends."""
        start, size = self.ends[places], self.ends[places + 1] - self.ends[places]
        ends = np.cumsum(size)
        return self.ids[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], ends

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        parts = [self._cuts(t) if t else [] for t in texts]
        memo = self.memo
        places = np.fromiter(map(memo.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        fresh, memo.fresh = memo.fresh, []
        gc.disable()  # many small lists and no cycles
        for at in range(0, len(fresh), 20_000):
            self._learn(fresh[at : at + 20_000])
        gc.enable()
        flat, ends = self._gather(places)
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, parts)])].tolist()
        if len(memo) > MEMO_CUTS or self.chars > MEMO_CHARS:
            self._forget(places)
        return [flat[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def _forget(self, places: np.ndarray) -> None:
        """Keeps the cuts at these places only."""
        kept = np.unique(places)
        names = list(self.memo)
        ids, ends = self._gather(kept)
        self.memo = Memo()
        self.chars = sum(len(names[k]) for k in kept.tolist())
        self.memo.update((names[k], i) for i, k in enumerate(kept.tolist()))
        self.ids, self.ends = ids, np.concatenate([[0], ends])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process: later tasks find its memo filled."""
    return Encoder(path)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_flat(store: pafs.FileSystem, path: str, data: bytes | memoryview) -> None:
    """Under another name first: a reader never meets half a file."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, path)


def map_flat(store: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """Memory-mapped: the file itself where the folder is a file system's, else a copy in the task's own temp folder.

    The copy has no name any more when this returns; its space is given back with the map.
    """
    if not store.get_file_info(path).size:
        return np.zeros(0, dtype)
    if isinstance(store, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with store.open_input_stream(path) as f, tempfile.TemporaryFile() as copy:
        while data := f.read(1 << 22):
            copy.write(data)
        copy.flush()
        return np.memmap(copy, dtype=dtype, mode="r")


def write_tokens(docs: DataFrame, uri: str, vocab: str, width: str = "<u2", end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Writes docs(doc_id, text) to flat files under uri and returns the manifest: part, docs, tokens, base.

    width is the ids' type; `<u2` holds vocabularies of up to 65,536 ids.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = docs.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocab), np.array([end_id], dtype=width).tobytes()
        part = TaskContext.get().partitionId()
        store, path = open_store(uri)
        name, temp = f"{path}/part-{part:06d}", uuid.uuid4().hex
        ids, known, sizes = [], [], []
        with store.open_output_stream(f"{name}.tok.{temp}.part") as out:
            for b in batches:
                for i, ids_of in zip(b.column("doc_id").to_pylist(), encode(b.column("text").to_pylist()), strict=True):
                    data = np.frombuffer(ids_of, dtype="<u4").astype(width).tobytes() + end
                    out.write(data)
                    sizes.append(len(data) // len(end))
                    ids.append(i or 0)
                    known.append(i is not None)
        if sizes:
            store.move(f"{name}.tok.{temp}.part", f"{name}.tok")
            write_flat(store, f"{name}.off", np.cumsum([0, *sizes], dtype="<u8").tobytes())
            write_flat(store, f"{name}.doc", np.array(ids, dtype="<i8").tobytes())
            write_flat(store, f"{name}.set", np.array(known, dtype="u1").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], ["part", "docs", "tokens"])
        else:
            store.delete_file(f"{name}.tok.{temp}.part")

    counts = materialize(dealt.mapInArrow(write, "part int, docs long, tokens long"), "token-manifest")
    base, rows = 0, []
    for r in sorted(counts.collect(), key=lambda r: r["part"]):
        rows.append((r["part"], r["docs"], r["tokens"], base))
        base += r["tokens"]
    return spark.createDataFrame(rows, "part int, docs long, tokens long, base long")


def read_tokens(manifest: DataFrame, uri: str, width: str = "<u2", chunk: int = 5000) -> DataFrame:
    """Documents of flat files, read back by memory map: doc_id, start, n_tokens and ids_crc32."""
    n = max(1, manifest.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(uri)
        for b in batches:
            for part, base in zip(b.column("part").to_pylist(), b.column("base").to_pylist(), strict=True):
                name = f"{path}/part-{part:06d}"
                tok, off = map_flat(store, f"{name}.tok", width), map_flat(store, f"{name}.off", "<u8").astype(np.int64)
                ids, known = map_flat(store, f"{name}.doc", "<i8"), map_flat(store, f"{name}.set", "u1")
                for at in range(0, len(ids), chunk):
                    rows = range(at, min(at + chunk, len(ids)))
                    crc = [zlib.crc32(tok[off[k] : off[k + 1]].astype("<u4").tobytes()) for k in rows]
                    here = slice(rows.start, rows.stop)
                    columns = [pa.array(ids[here], mask=known[here] == 0), pa.array(base + off[here]), pa.array(off[rows.start + 1 : rows.stop + 1] - off[here]), pa.array(crc, pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = shared_dir(spark, "tokens")
    manifest = write_tokens(table(spark, sf_dir, "documents"), uri, vocabulary("word_bpe_49k.json"))
    return read_tokens(manifest, uri)
