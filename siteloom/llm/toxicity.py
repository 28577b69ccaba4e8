"""Toxicity scores from a factorization machine over hashed terms.

A document's terms are the 64-bit hashes of its distinct words and of the words' first four and five
letters. The machine scores w0 + sum w_i + sum_{i<j} <v_i, v_j> over the terms present, so a pair such as an
insult and a group mention can weigh more than both words alone. It is fitted in numpy on a bounded,
documented sample of labelled rows; scoring is one map over all rows, without a shuffle.

Edge cases: null and empty texts have no terms and get the score of the bias alone; repeated rows are scored
alike, and an id's repeated rows or labels train once; extra columns pass through `score_toxicity` unchanged, but
for one named toxicity in any case, which is replaced; an empty labelled set gives a machine that scores every
text 0; an empty table gives an empty one.
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

from siteloom.llm.common import held_out, materialize, others, sample_rows, small_batches, table

#: Letters stay (lower-case), every other ASCII byte ends a word.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MEMO_WORDS = 100_000


def word_terms(word: bytes) -> list[int]:
    """Signed 64-bit hashes of a word and of its two prefixes."""
    found = [word]
    found += [b"^" + word[:n] for n in (4, 5) if len(word) >= n]
    return [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in found]


def words(text: str | None) -> set[bytes]:
    return set((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())


@dataclass
class FactorizationMachine:
    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, ids: np.ndarray) -> float:
        if not len(ids):
            return self.bias
        v = self.factors[ids]
        s = v.sum(axis=0)
        return float(self.bias + self.weights[ids].sum() + 0.5 * ((s * s).sum() - (v * v).sum()))


def fit_machine(terms: np.ndarray, rows: list[np.ndarray], y: np.ndarray, rank: int = 8, epochs: int = 6, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
    """Adagrad on the logistic loss, one example at a time, classes weighted alike."""
    rng = np.random.default_rng(seed)
    k = len(terms)
    fm = FactorizationMachine(terms, -20.0 if not len(y) else 0.0, np.zeros(k), rng.normal(0, 0.01, (k, rank)))
    if not len(y):
        return fm
    gw, gv, gb = np.full(k, 1e-3), np.full((k, rank), 1e-3), 1e-3
    pos = max(1.0, float(y.sum()))
    up = min(20.0, max(1.0, (len(y) - pos) / pos)) ** 0.5
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            ids = rows[i]
            v = fm.factors[ids]
            s = v.sum(axis=0)
            z = fm.bias + fm.weights[ids].sum() + 0.5 * ((s * s).sum() - (v * v).sum())
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * (up if y[i] else 1.0)
            gb += g * g
            fm.bias -= rate * g / gb**0.5
            if len(ids):
                dw = g + decay * fm.weights[ids]
                gw[ids] += dw * dw
                fm.weights[ids] -= rate * dw / np.sqrt(gw[ids])
                dv = g * (s - v) + decay * v
                gv[ids] += dv * dv
                fm.factors[ids] -= 0.3 * rate * dv / np.sqrt(gv[ids])
    return fm


def _ids(text: str | None, index: dict[int, int], memo: dict[bytes, tuple]) -> np.ndarray:
    found: set[int] = set()
    for w in words(text):
        got = memo.get(w)
        if got is None:
            if len(memo) >= MEMO_WORDS:
                memo.clear()
            got = memo[w] = tuple(index[t] for t in word_terms(w) if t in index)
        if got:
            found.update(got)
    return np.array(sorted(found), dtype=np.int64)


def chi_squared(n, pos, rows: float, positives: float):  # noqa: ANN001, ANN201
    """How much the share of positives among n rows differs from that of all rows; numbers, arrays or columns."""
    gap = pos * rows - n * positives
    return gap * gap * rows / (n * (rows - n + 1) * max(1.0, positives * (rows - positives)))


def interacting(rows: list[np.ndarray], y: np.ndarray, k: int, least: float, block: int = 500) -> np.ndarray:
    """Of k terms, those of pairs that tell the classes apart better than either term alone does, by `least`."""
    n, pos = np.zeros((k, k), np.float32), np.zeros((k, k), np.float32)
    for at in range(0, len(rows), block):
        x = np.zeros((len(rows[at : at + block]), k), np.float32)
        for i, ids in enumerate(rows[at : at + block]):
            x[i, ids] = 1
        hit = x[y[at : at + block] > 0]
        n += x.T @ x
        pos += hit.T @ hit
    found = np.zeros(k, bool)
    alone = chi_squared(np.maximum(np.diag(n), 1), np.diag(pos), float(len(y)), float(y.sum()))
    for i in range(k):
        chi = chi_squared(np.maximum(n[i], 1), pos[i], float(len(y)), float(y.sum()))
        found[i] = ((n[i] >= 5) & (chi >= np.maximum(alone[i], alone) + least)).any()
    return np.flatnonzero(found)


def encoded(picked: DataFrame, terms: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The bounded sample's rows as places in `terms`, in order of doc_id, and their labels."""
    share = picked.sparkSession.sparkContext.broadcast(terms)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, memo = {int(t): i for i, t in enumerate(share.value)}, {}
        for b in batches:
            ids = [_ids(t, index, memo).astype("<i4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), b.column("toxic")], ["doc_id", "ids", "toxic"])

    got = picked.mapInArrow(encode, "doc_id long, ids binary, toxic int").orderBy("doc_id", "ids").toPandas()
    return [np.frombuffer(x, dtype="<i4") for x in got["ids"]], got["toxic"].to_numpy(dtype=np.float64)


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 16_000, min_rows: int = 2, min_chi2: float = 6.63, screened: int = 1_024, min_pair: float = 40.0) -> FactorizationMachine:
    """Fits a machine on docs(doc_id, text) and labels(doc_id, toxic), null labels left out.

    At most max_rows labelled rows are used, those with the smallest hashes of their ids. Of their texts' terms
    the machine gets all that at least min_rows rows hold and that differ between the classes (chi-squared of at
    least min_chi2), and of the `screened` most frequent ones also those that only differ in pairs (by min_pair
    more than either alone), as in labels that hold for exactly one of two words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    chosen = sample_rows(labels.where("toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"]), "doc_id", max_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    picked = materialize(texts.dropDuplicates(["doc_id"]), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each, label = [], []
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                got = {t for w in words(text) for t in word_terms(w)}
                each.append(np.fromiter(got, dtype=np.int64, count=len(got)))
                label.append(np.full(len(got), y))
            t, where = np.unique(np.concatenate(each), return_inverse=True)
            pos = np.bincount(where, weights=np.concatenate(label), minlength=len(t))
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.bincount(where, minlength=len(t))), pa.array(pos.astype(np.int64))], ["term", "n", "pos"])

    counts = materialize(picked.mapInArrow(count, "term long, n long, pos long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")), "toxicity-terms")
    size = picked.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    rows, pos = float(size["n"]), float(size["pos"])
    if not rows:
        return fit_machine(np.zeros(0, np.int64), [], np.zeros(0))
    known = counts.where(F.col("n") >= min_rows)
    best = known.where(chi_squared(F.col("n"), F.col("pos"), rows, pos) >= min_chi2)
    frequent = known.where(F.col("n") < rows).orderBy(F.desc("n"), "term").limit(screened)
    gathered = lambda df: np.sort(np.array([r["term"] for r in df.select("term").toLocalIterator()], dtype=np.int64))
    terms, common = gathered(best), gathered(frequent)
    paired = interacting(*encoded(picked, common), len(common), min_pair)
    terms = np.union1d(terms, common[paired])
    return fit_machine(terms, *encoded(picked, terms))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, name: str = "toxicity") -> DataFrame:
    """Adds a double, 0 to 1, to every row of a table with `text`."""
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast(machine)
    keep = others(docs, name)
    docs = docs.select(keep)
    schema = T.StructType([*docs.schema, T.StructField(name, T.DoubleType(), False)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fm = share.value
        index, memo = {int(t): i for i, t in enumerate(fm.terms)}, {}
        for b in batches:
            z = np.array([fm.margin(_ids(t, index, memo)) for t in b.column("text").to_pylist()], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + [pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], [*keep, name])

    return docs.mapInArrow(score, schema)


def learn(spark: SparkSession, sf_dir: str) -> FactorizationMachine:
    """The machine learned from the given tables' labelled rows that aren't held out."""
    return train_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), learn(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = 0.5) -> DataFrame:
    """Pipeline stage: documents that score below the threshold.

    Null and empty texts score as the bias alone does; repeated rows are judged alike; an empty table gives an
    empty one; all columns come back as they are.
    """
    name = "_siteloom_toxicity"
    return score_toxicity(docs, learn(spark, sf_dir), name).where(F.col(name) < threshold).select(docs.columns)
