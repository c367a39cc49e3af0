"""Evaluation of probabilities, classes and rankings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import scores

#: Pairs of texts whose words are Python objects at once.
ROWS = 256


def ece(df: DataFrame, p: str, y: str, bins: int) -> DataFrame:
    """Expected calibration error over half-open bins: p = 1 is in no bin but counts in the total."""
    b = df.groupBy(F.when(F.col(p) < 1, F.floor(F.col(p) * bins)).alias("b")).agg(F.avg(y).alias("acc"), F.avg(p).alias("conf"), F.count("*").alias("n"))
    gap = F.when(F.col("b").isNotNull(), F.abs(F.col("acc") - F.col("conf")) * F.col("n")).otherwise(0.0)
    return b.agg((F.sum(gap) / F.sum("n")).alias("ece"))


def per_class(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """label, support, precision and recall of each class, 0 where undefined; the confusion counts are made once."""
    cells = df.groupBy(truth, guess).agg(F.count("*").alias("n"))
    hit = F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0)
    each = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), hit.cast("long").alias("hit")), F.struct(F.col(guess).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")))).alias("x")).select("x.*")
    g = each.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    ratio = lambda of: F.coalesce(F.col("hit") / F.nullif(F.col(of), F.lit(0)), F.lit(0.0))
    return g.select("label", "support", ratio("guessed").alias("precision"), ratio("support").alias("recall"))


def ranking(df: DataFrame, keys: Sequence[str], order: Sequence[Column], relevance: str, k: int) -> DataFrame:
    """nDCG against the best order of the top k, and precision over the rows of the top k."""
    top = df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("k") <= k)
    top = top.withColumn("ideal", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(relevance), "k")))
    gain = lambda place: F.sum(F.col(relevance) / F.log2(F.col(place) + 1))
    return top.groupBy(*keys).agg(F.coalesce(gain("k") / F.nullif(gain("ideal"), F.lit(0.0)), F.lit(0.0)).alias("ndcg"), F.avg(F.when(F.col(relevance) > 0, 1.0).otherwise(0.0)).alias("precision_at_k"))


def first_hit(df: DataFrame, keys: Sequence[str], order: Sequence[Column], relevance: str, k: int) -> DataFrame:
    """Whether the top k hold a relevant row, the reciprocal rank of the first one (0 if there is none), and nDCG at k.

    A row is relevant or not; the ideal order has as many relevant rows in front as the group has. Without any, nDCG is 0.
    """
    ranked = df.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    found = F.col(relevance) > 0
    first = F.min(F.when(found, F.col("k")))
    gain = F.sum(F.when(found & (F.col("k") <= k), 1 / F.log2(F.col("k") + 1)))
    each = ranked.groupBy(*keys).agg(F.coalesce(first <= k, F.lit(False)).alias("hit"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"), gain.alias("_gain"), F.count_if(found).alias("_n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("_n"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return each.withColumn("ndcg", F.coalesce(F.col("_gain") / ideal, F.lit(0.0))).drop("_gain", "_n")


def fit_temperature(df: DataFrame, p: str, y: str, rate: float, steps: int, start: float = 1.0) -> float:
    """Temperature after steps of ``T -= rate * mean((sigmoid(logit / T) - y) * logit / T^2)``, the sign as stated, within .1 and 100."""
    z = df.select(scores.logit(F.col(p)).alias("z"), F.col(y).alias("y")).persist()
    t = start
    for _ in range(steps):
        g = z.agg(F.avg((scores.sigmoid(F.col("z") / t) - F.col("y")) * F.col("z") / (t * t))).first()[0] or 0.0
        t = min(100.0, max(0.1, t - rate * g))
    z.unpersist()
    return t


def matches(guess: list[str], truth: list[str], n: int) -> tuple[int, int, int]:
    """Numbers of n-grams of both and of their matches, counted no oftener than in the other one."""
    g, t = (Counter(zip(*(words[k:] for k in range(n)), strict=False)) for words in (guess, truth))
    return g.total(), t.total(), (g & t).total()


def overlaps(pairs: DataFrame, keys: Sequence[str], guess: str, truth: str, orders: Sequence[int], subsequence: bool = False) -> DataFrame:
    """keys and for each pair of texts (arrays of words, null as empty) and each n of ``orders`` guessed, true and hit with that n behind; ng and nt, the numbers of words; with ``subsequence`` lcs.

    A pair's n-grams are counted in its row, so that they are neither shuffled nor sorted.
    """
    kept = pairs.select(*keys, F.coalesce(guess, F.array().cast("array<string>")).alias("_g"), F.coalesce(truth, F.array().cast("array<string>")).alias("_t"))
    names = [*(f"{c}{n}" for n in orders for c in ("guessed", "true", "hit")), "ng", "nt", *(["lcs"] if subsequence else [])]
    schema = StructType([*kept.select(*keys).schema.fields, *(StructField(c, LongType()) for c in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                found = []
                for g, t in zip(b["_g"].to_pylist(), b["_t"].to_pylist(), strict=True):
                    found.append([*(x for n in orders for x in matches(g, t, n)), len(g), len(t), *([common_subsequence(g, t)] if subsequence else [])])
                yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names=[*keys, *names])

    return kept.mapInArrow(run, schema)


def f_measure(hit: Column, guessed: Column, true: Column) -> Column:
    p, r = hit / F.nullif(guessed, F.lit(0)), hit / F.nullif(true, F.lit(0))
    return F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0))


def common_subsequence(guess: list[str], truth: list[str]) -> int:
    """Length of the longest common subsequence: a bit for each word of the truth, a fold over the words of the guess."""
    places: dict[str, int] = {}
    for i, w in enumerate(truth):
        places[w] = places.get(w, 0) | 1 << i
    row, full = (1 << len(truth)) - 1, (1 << len(truth)) - 1
    for w in guess:
        at = row & places.get(w, 0)
        row = ((row + at) | (row - at)) & full
    return len(truth) - row.bit_count()


def rouge(pairs: DataFrame, keys: Sequence[str], guess: str, truth: str) -> DataFrame:
    """keys, rouge1, rouge2 and rougeL: F-measures of shared words, word pairs and the longest common subsequence."""
    found = overlaps(pairs, keys, guess, truth, (1, 2), True)
    each = [f_measure(F.col(f"hit{n}"), F.col(f"guessed{n}"), F.col(f"true{n}")).alias(f"rouge{n}") for n in (1, 2)]
    return found.select(*keys, *each, f_measure(F.col("lcs"), F.col("ng"), F.col("nt")).alias("rougeL"))


def bleu(pairs: DataFrame, keys: Sequence[str], guess: str, truth: str, most: int = 4) -> DataFrame:
    """One row: BLEU (0 to 100) of all pairs, brevity penalty and lengths; orders without a match are smoothed exponentially."""
    orders = range(1, most + 1)
    none = F.lit(0).cast("long")
    sums = [F.coalesce(F.sum(f"{of}{n}"), none).alias(f"{name}{n}") for n in orders for of, name in (("hit", "hit"), ("guessed", "all"))]
    out = overlaps(pairs, keys, guess, truth, orders).agg(F.sum("ng").alias("guess_length"), F.sum("nt").alias("true_length"), *sums)
    smooth, logs = F.lit(1.0), F.lit(0.0)
    for n in range(1, most + 1):
        hit, total = F.col(f"hit{n}"), F.col(f"all{n}")
        smooth = F.when((hit == 0) & (total > 0), smooth * 2).otherwise(smooth)
        logs = logs + F.when(total == 0, F.lit(None)).when(hit == 0, F.log(100.0 / (smooth * total))).otherwise(F.log(100.0 * hit / total))
    short = F.when(F.col("guess_length") >= F.col("true_length"), 1.0).when(F.col("guess_length") == 0, 0.0).otherwise(F.exp(1 - F.col("true_length") / F.nullif(F.col("guess_length"), F.lit(0))))
    return out.select(F.coalesce(short * F.exp(logs / most), F.lit(0.0)).alias("bleu"), short.alias("brevity"), "guess_length", "true_length")


def regressions(before: DataFrame, now: DataFrame, threshold: float = 0.05, rising: Sequence[str] = ("perplexity", "latency")) -> DataFrame:
    """metric, before, now and regressed, of tables (metric, value): a fall by more than ``threshold``, or a rise for metrics whose name holds one of ``rising``."""
    both = before.select("metric", F.col("value").alias("before")).join(now.select("metric", F.col("value").alias("now")), "metric").where("before IS NOT NULL AND now IS NOT NULL")
    change = (F.col("now") - F.col("before")) / F.nullif(F.col("before"), F.lit(0.0))
    worse = F.when(F.col("metric").rlike("|".join(rising)), change).otherwise(-change)
    return both.select("metric", "before", "now", F.coalesce(worse > threshold, F.lit(False)).alias("regressed"))
