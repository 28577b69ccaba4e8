"""Language identification by a byte-level convolutional network.

Texts are cut into fixed-length byte windows. The network embeds bytes, runs filters of several widths over a
window, keeps each filter's maximum, and ends in a softmax; a text's languages are the mean log-probabilities
of all its windows. It is trained in numpy on windows of a bounded sample of labelled rows. To predict, the
embedding and the filters are folded into tables over byte pairs, so that a window costs a few table reads
and one matrix product; windows of many texts go through together.

Edge cases: null texts, empty texts and texts without a letter give `und` with score 0; a text shorter than
a window is padded with zero bytes; repeated rows are predicted alike; extra columns pass through, but
for those named lang_pred and lang_score, which are replaced; with no
labelled rows every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siteloom.llm.common import held_out, materialize, others, small_batches, table

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"
#: A language is known if it is likelier than all others together.
MAJORITY = 0.5
#: Windows that go through the network at once.
CHUNK = 512


@dataclass
class ByteNet:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def folded(self) -> list[list[np.ndarray]]:
        """For each width, tables over byte pairs (and one over single bytes for an odd width)."""
        out = []
        for w, f in zip(WIDTHS, self.filters, strict=True):
            one = [(self.embed @ f[j]).astype(np.float32) for j in range(w)]
            tables = [(one[j][:, None, :] + one[j + 1][None, :, :]).reshape(65536, -1) for j in range(0, w - 1, 2)]
            out.append(tables + ([one[-1]] if w % 2 else []))
        return out


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """All of a text's windows: side by side, the last one ending with the text."""
    if len(data) <= size:
        return [data.ljust(size, b"\0")]
    out = [data[i : i + size] for i in range(0, len(data) - size + 1, size)]
    return [*out, data[-size:]] if len(data) % size else out


def log_probabilities(net: ByteNet, tables: list[list[np.ndarray]], x: np.ndarray) -> np.ndarray:
    """x: windows as rows of bytes."""
    pairs = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    pooled = []
    for w, parts, b in zip(WIDTHS, tables, net.biases, strict=True):
        n = x.shape[1] - w + 1
        act = parts[0][pairs[:, :n]]
        for k, t in enumerate(parts[1:], 1):
            act += t[pairs[:, 2 * k : 2 * k + n]] if len(t) == 65536 else t[x[:, w - 1 : w - 1 + n]]
        pooled.append(np.maximum(act.max(axis=1) + b, 0))
    z = np.concatenate(pooled, axis=1) @ net.dense + net.offset
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def fit_net(x: np.ndarray, y: np.ndarray, langs: list[str], dim: int = 8, width_filters: int = 12, epochs: int = 4, min_steps: int = 800, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> ByteNet:
    """Adam on the cross-entropy. Gradients reach only the positions where a filter has its maximum."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.5, (256, dim)), "d": rng.normal(0, 0.1, (len(WIDTHS) * width_filters, len(langs))), "o": np.zeros(len(langs))}
    for w in WIDTHS:
        p[f"f{w}"], p[f"b{w}"] = rng.normal(0, (1 / (w * dim)) ** 0.5, (w, dim, width_filters)), np.zeros(width_filters)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(max(epochs, -(-min_steps * batch // len(x))) if len(x) else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            bx, n = x[rows], len(rows)
            emb, where, pooled = p["e"][bx], {}, []
            for w in WIDTHS:
                k = bx.shape[1] - w + 1
                act = sum(emb[:, j : j + k] @ p[f"f{w}"][j] for j in range(w))
                where[w] = act.argmax(axis=1)
                pooled.append(np.take_along_axis(act, where[w][:, None, :], 1)[:, 0] + p[f"b{w}"])
            raw = np.concatenate(pooled, axis=1)
            hid = np.maximum(raw, 0)
            z = hid @ p["d"] + p["o"]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(n), y[rows]] -= 1
            z /= n
            g = {"d": hid.T @ z, "o": z.sum(axis=0), "e": np.zeros_like(p["e"])}
            back = (z @ p["d"].T) * (raw > 0)
            for i, w in enumerate(WIDTHS):
                gb = back[:, i * width_filters : (i + 1) * width_filters]
                g[f"b{w}"], gf = gb.sum(axis=0), np.zeros_like(p[f"f{w}"])
                for j in range(w):
                    byte = bx[np.arange(n)[:, None], where[w] + j]
                    gf[j] = np.einsum("nfd,nf->df", p["e"][byte], gb)
                    np.add.at(g["e"], byte, gb[:, :, None] * p[f"f{w}"][j].T[None])
                g[f"f{w}"] = gf
            step += 1
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return ByteNet(langs, p["e"], [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["d"], p["o"])


def train_language(docs: DataFrame, max_rows: int = 12_000, seed: int = 5) -> ByteNet:
    """Fits the network on docs(doc_id, text, lang) where neither is null.

    The bound is on labelled windows: of all windows of all labelled texts, at most max_rows are used, drawn by a
    hash of their bytes and their place. The tasks keep back what is far from being drawn.
    """
    small_batches(docs.sparkSession)
    known = docs.where("text is not null and lang is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    total = known.agg(F.sum(F.ceil(F.octet_length("text") / WINDOW))).first()[0] or 1
    below = min(1.0, 1.5 * max_rows / total) * 2.0**64

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, lang in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                for k, w in enumerate(windows(text.encode("utf-8", "surrogatepass"))):
                    h = xxhash.xxh3_64_intdigest(w, (k + (i or 0)) % (1 << 63))
                    if h < below and any(c >= 65 for c in w):
                        out.append((h - (1 << 63), lang, w))
            h, langs, data = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(langs, pa.string()), pa.array(data, pa.binary())], ["h", "lang", "data"])

    drawn = known.mapInArrow(cut, "h long, lang string, data binary").orderBy("h", "lang", "data").limit(max_rows)
    got = materialize(drawn, "language-sample").orderBy("h", "lang", "data").toPandas()
    langs = sorted(got["lang"].unique())
    x = np.frombuffer(b"".join(got["data"]), dtype=np.uint8).reshape(-1, WINDOW)
    return fit_net(x, np.array([langs.index(v) for v in got["lang"]], dtype=np.int64), langs, seed=seed)


def predict_language(docs: DataFrame, net: ByteNet, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """Adds two columns to every row of a table with `text`: the language, and its score double (0 to 1)."""
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(net)
    keep = others(docs, *names)
    docs = docs.select(keep)
    schema = T.StructType([*docs.schema, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = share.value
        tables = net.folded()
        for b in batches:
            sums = np.zeros((b.num_rows, max(1, len(net.langs))))
            count = np.zeros(b.num_rows)
            held: list[bytes] = []
            owner: list[int] = []

            def flush() -> None:
                if held:
                    x = np.frombuffer(b"".join(held), dtype=np.uint8).reshape(-1, WINDOW)
                    at = np.array(owner)
                    np.add.at(sums, at, log_probabilities(net, tables, x))
                    np.add.at(count, at, 1)
                    held.clear()
                    owner.clear()

            for i, text in enumerate(b.column("text").to_pylist()):
                if net.langs and text and (text[:64].isalpha() or any(map(str.isalpha, text))):
                    for w in windows(text.encode("utf-8", "surrogatepass")):
                        held.append(w)
                        owner.append(i)
                        if len(held) >= CHUNK:
                            flush()
            flush()
            mean = sums / np.maximum(count, 1)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            langs = [net.langs[k] if n else UNKNOWN for k, n in zip(best, count, strict=True)]
            score = np.where(count > 0, p[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(score)], [*keep, *names])

    return docs.mapInArrow(predict, schema)


def learn(spark: SparkSession, sf_dir: str) -> ByteNet:
    return train_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where(~held_out()))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = predict_language(table(spark, sf_dir, "documents").select("doc_id", "text"), learn(spark, sf_dir))
    return got.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = MAJORITY) -> DataFrame:
    """Pipeline stage: documents of which the network is surer than not that they are in one learned language.

    Texts that no language has a share above `least` of go (fragments of a word or two, mixtures without a majority),
    and so do null texts and texts without letters. Repeated rows are judged alike; an empty table gives an empty
    one; all columns come back as they are.
    """
    names = ("_siteloom_lang", "_siteloom_lang_score")
    found = predict_language(docs, learn(spark, sf_dir), names)
    return found.where((F.col(names[0]) != UNKNOWN) & (F.col(names[1]) > least)).select(docs.columns)
