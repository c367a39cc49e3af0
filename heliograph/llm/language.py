"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are folded to lower-case letters with single spaces between words; their n-grams of 1 to 3 characters are hashed into a
fixed number of features, counted over the whole text. Document frequencies come from all training texts. Weights are
learned by follow-the-regularised-leader with elastic-net penalties (L1 leaves most of them zero) on a sample of
a bounded number of texts per language: shards of the sample learn on executors from the shared state, whose sums and
squared gradients are averaged between epochs. A part of the sample that didn't train sets the temperature of
the scores.

Defined results: null and letterless texts are ``und`` with score 0, as is everything if there are no training texts; empty
tables give no rows; repeated rows count as often as they occur; texts of any length are read whole. A prediction reads nothing
but the text.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
#: Odd multipliers that spread n-grams of 1, 2 and 3 characters over the features.
SPREAD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a blank if it isn't one (marks count, as parts of letters)."""
    out = np.full(sys.maxunicode + 1, 32, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if unicodedata.category(x)[0] in "LM":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def folded(text: str) -> np.ndarray:
    """Letters of the text in lower case, a blank before, after and between words; empty without letters."""
    points = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate(([32], points, [32])).astype(np.uint32)
    blank = points == 32
    kept = points[~(blank & np.concatenate(([False], blank[:-1])))]
    return kept if len(kept) > 1 else kept[:0]


def counts(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of a text, ascending, and how often each occurs."""
    p = folded(text) if text else np.zeros(0, np.uint32)
    if not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = [p[p != 32] * SPREAD[0], (p[:-1] * SPREAD[0] + p[1:]) * SPREAD[1], ((p[:-2] * SPREAD[0] + p[1:-1]) * SPREAD[1] + p[2:]) * SPREAD[2]]
    at = np.concatenate(grams)
    at = (at ^ (at >> np.uint32(15))) * SPREAD[1] >> np.uint32(32 - bits)
    if len(at) < 2**bits // 8:
        return np.unique(at.astype(np.int64), return_counts=True)
    n = np.bincount(at, minlength=2**bits)
    there = np.flatnonzero(n)
    return there, n[there]


def tfidf(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(n)) * idf
    size = np.sqrt((x * x).sum())
    return x / size if size > 0 else x


def weights_of(z: np.ndarray, n: np.ndarray, rate: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """The leader's weights for sums of gradients z and of their squares n."""
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / rate + l2))


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Model:
    """Learned languages, document frequencies as weights, sparse weights (feature by language) and the temperature."""

    def __init__(self, langs: list[str], bits: int, idf: np.ndarray, w: np.ndarray, temperature: float = 1.0):
        self.langs, self.bits, self.idf, self.w, self.temperature = langs, bits, idf, w, temperature

    def logits(self, text: str | None) -> np.ndarray | None:
        at, n = counts(text, self.bits)
        return tfidf(n, self.idf[at]) @ self.w[at] if len(at) else None

    def predict(self, text: str | None) -> tuple[str, float]:
        s = self.logits(text) if self.langs else None
        if s is None:
            return UNKNOWN, 0.0
        p = softmax(s / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def document_frequencies(texts: DataFrame, bits: int) -> DataFrame:
    """feature and the number of texts with it; tasks add up what they have read."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2**bits, np.int64)
        for b in batches:
            for text in b["text"].to_pylist():
                total[counts(text, bits)[0]] += 1
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["feature", "n"])

    return common.map_arrow(texts.select("text"), count, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))


def learn(sample: DataFrame, langs: list[str], bits: int, idf: np.ndarray, epochs: int, rate: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights from a bounded sample with columns shard, at, x (features and their values) and y (number of the language).

    In each epoch every shard goes through its texts in order, from the state that all share; states are averaged by blocks of features.
    The driver holds one state, 2 * languages * 2**bits numbers.
    """
    spark, k, block = sample.sparkSession, len(langs), min(1024, 2**bits)
    z, n = np.zeros((2**bits, k)), np.zeros((2**bits, k))
    for _ in range(epochs):
        state = spark.sparkContext.broadcast((z, n))

        def shard(t: pa.Table) -> pa.Table:
            z, n = (x.copy() for x in state.value)  # noqa: B023  used within this round
            for at, x, y in zip(*(t.sort_by([("turn", "ascending"), ("y", "ascending")])[c].to_pylist() for c in ("at", "x", "y")), strict=True):
                at, x = np.array(at, np.int64), np.array(x)[:, None]
                w = weights_of(z[at], n[at], rate, beta, l1, l2)
                p = softmax((x * w).sum(0))
                p[y] -= 1
                g = x * p
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate * w
                n[at] += g * g
            blocks = range(0, 2**bits, block)
            return pa.table({"shard": pa.array([t["shard"][0].as_py()] * len(blocks), pa.int32()), "block": pa.array(list(blocks), pa.int32()), "z": pa.array([z[b : b + block].ravel() for b in blocks], pa.list_(pa.float64())), "n": pa.array([n[b : b + block].ravel() for b in blocks], pa.list_(pa.float64()))})

        def average(t: pa.Table) -> pa.Table:
            t = t.sort_by("shard")
            return pa.table({"block": t["block"][:1], **{c: pa.array([np.mean(np.array(t[c].to_pylist()), 0)], pa.list_(pa.float64())) for c in ("z", "n")}})

        states = sample.groupBy("shard").applyInArrow(shard, "shard int, block int, z array<double>, n array<double>")
        for r in states.groupBy("block").applyInArrow(average, "block int, z array<double>, n array<double>").collect():
            for held, c in ((z, "z"), (n, "n")):
                held[r["block"] : r["block"] + block] = np.array(r[c]).reshape(-1, k)
        state.destroy()
    return weights_of(z, n, rate, beta, l1, l2)


def temperature(sample: DataFrame, model: Model, steps: int = 33) -> float:
    """The temperature of least log loss on texts that didn't train: a wide grid, then a fine one around its best."""
    low, high = 0.05, 20.0
    for _ in range(2):
        grid = np.geomspace(low, high, steps)

        def loss(batches: Iterator[pa.RecordBatch], grid=grid) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(grid))
            for b in batches:
                for at, x, y in zip(*(b[c].to_pylist() for c in ("at", "x", "y")), strict=True):
                    s = np.array(x) @ model.w[at]
                    p = softmax(s[None, :] / grid[:, None])[:, y]
                    total -= np.log(np.maximum(p, 1e-300))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(grid)), pa.int32()), pa.array(total)], names=["t", "loss"])

        found = common.map_arrow(sample.select("at", "x", "y"), loss, "t int, loss double").groupBy("t").agg(F.sum("loss").alias("loss")).collect()
        if not found or not sample.take(1):
            return 1.0
        best = min(found, key=lambda r: (round(r["loss"], 6), r["t"]))["t"]
        low, high = grid[max(0, best - 1)], grid[min(steps - 1, best + 1)]
    return float(np.sqrt(low * high))


def fit(texts: DataFrame, per_language: int = 2000, bits: int = 15, shards: int = 8, epochs: int = 3, rate: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, calibration: int = 5) -> Model:
    """Learn from columns text and lang (null: not used). Weights are learned from about ``per_language`` texts of each language, one in
    ``calibration`` of which sets the temperature instead; which ones follows from a hash of the text. Everything else covers all texts."""
    spark = texts.sparkSession
    known = texts.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    langs = sorted(sizes)
    total = sum(sizes.values())
    idf = np.full(2**bits, np.log(1 + total) + 1)
    for r in document_frequencies(known, bits).collect():  # 2**bits rows at most
        idf[r["feature"]] = np.log((1 + total) / (1 + r["n"])) + 1
    if len(langs) < 2:
        return Model(langs, bits, idf, np.zeros((2**bits, len(langs))))
    hashed = known.withColumn("h", F.xxhash64("text"))
    share = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, per_language / sizes[lang])))))
    place = lambda seed: F.pmod(F.xxhash64("h", F.lit(seed)), F.lit(1_000_000))
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    chosen = hashed.where(place(1) < share[F.col("lang")] * 1_000_000)
    chosen = chosen.select("text", number.alias("y"), F.col("h").alias("turn"), F.pmod(F.xxhash64("h", F.lit(2)), F.lit(shards)).cast("int").alias("shard"), (place(3) % calibration == 0).alias("aside"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, ats, xs = [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                at, n = counts(text, bits)
                if len(at):
                    keep.append(i)
                    ats.append(at)
                    xs.append(tfidf(n, idf[at]))
            rest = [b[c].take(pa.array(keep, pa.int64())) for c in ("y", "turn", "shard", "aside")]
            yield pa.RecordBatch.from_arrays([pa.array(ats, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float64())), *rest], names=["at", "x", "y", "turn", "shard", "aside"])

    sample = common.written(common.map_arrow(chosen, features, "at array<int>, x array<double>, y int, turn long, shard int, aside boolean"), "features")
    model = Model(langs, bits, idf, learn(sample.where("NOT aside"), langs, bits, idf, epochs, rate, beta, l1, l2))
    model.temperature = temperature(sample.where("aside"), model)
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", *keep: Column) -> DataFrame:
    """The columns ``keep`` with lang_pred and score (calibrated probability) of each text."""
    read = docs.select(*keep, F.col(text_col).alias("_text"))
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = read.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [held.value.predict(t) for t in b["_text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields[:-1]), "lang_pred string", "score double"]
    return common.map_arrow(read, run, ", ".join(kinds))
