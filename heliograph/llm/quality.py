"""Quality rules with risk-controlled cutoffs, on DataFrame functions only.

Each rule is a rate of a text; a text whose rate is above the rule's cutoff is rejected. Cutoffs are chosen for each
stratum on labelled texts so that, with probability ``1 - delta`` for all strata together, the verdict of all rules falsely
rejects at most a share ``alpha`` of a stratum's good texts. Each rule may use up an equal part of ``alpha``, so that whatever
rules reject together stays within it:

* candidates are tested from the most lenient one down, each by the exact binomial probability of at most so many false
  rejections if the true share were ``alpha / rules``; the first that fails ends the row of tests (a fixed sequence needs no
  further correction), and each row gets ``delta / (rules * strata)`` (Bonferroni);
* of the candidates that passed, the one that rejects most bad less good texts is taken, of equals the most lenient. A
  row without a passed candidate has no cutoff: the rule rejects nothing there.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is a stratum of its own; a
null doc_id has no label; labels that repeat count once per row, null qualities not at all; an empty table gives no
rows; without labels all texts that pass the base rule are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .common import let

SPACE = r"[\x20\x09-\x0D]"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Rules (rates) with their candidate cutoffs, most lenient first.
RATES = {
    "symbols": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "repeats": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1],
    "shouts": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "duplicate_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
}


def repeated_words(words: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more.

    Windows are hashed, and hashes and places sorted together as one number each: the top of the hash and, in as few low
    bits as the text needs, the place. Equal neighbours, whose full hashes are compared, are repeated windows.
    """

    def of_sorted(s: Column, h: Column, m: Column) -> Column:
        def same(a: Column, b: Column) -> Column:
            return (a - F.pmod(a, m) == b - F.pmod(b, m)) & (h[F.pmod(a, m).cast("int")] == h[F.pmod(b, m).cast("int")])

        twice = F.filter(s, lambda x, i: ((i > 0) & same(x, F.get(s, i - 1))) | ((i < F.size(s) - 1) & same(x, F.get(s, i + 1))))
        places = F.transform(twice, lambda x: F.pmod(x, m))
        return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.array(p, p + 1, p + 2)))))

    def of_hashes(h: Column) -> Column:
        return let(
            F.pow(F.lit(2.0), F.length(F.bin(F.size(h)))).cast("long"),
            lambda m: let(F.sort_array(F.transform(h, lambda x, i: x - F.pmod(x, m) + i)), lambda s: of_sorted(s, h, m)),
        )

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(hashes, of_hashes)).cast("long")


def counted(text: Column) -> list[Column]:
    """The counts of a text that isn't null, as columns w and l (structs), n_symbols and n_shouts."""
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return [
        of_words.alias("w"), of_lines.alias("l"), F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
    ]


def layer(stratum: str) -> Column:
    return F.coalesce(F.col(stratum).cast("string"), F.lit("")).alias("stratum")


def features(df: DataFrame, stratum: str = "lang") -> DataFrame:
    """doc_id, stratum and the counts of every row."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), layer(stratum), *counted(F.coalesce(F.col("text"), F.lit(""))))
    return rows.select("doc_id", "stratum", "w.*", "l.*", "n_symbols", "n_shouts")


def judged(counts: DataFrame) -> DataFrame:
    """Adds base_failed and the rates."""
    n = F.col("n_words")
    failed = (n < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n)
    rate = lambda c, of: F.when(F.col(of) > 0, F.col(c) / F.col(of)).otherwise(F.lit(0.0))
    return counts.withColumns({"base_failed": failed, "symbols": rate("n_symbols", "n_words"), "repeats": rate("n_repeat_words", "n_words"), "shouts": rate("n_shouts", "n_words"), "duplicate_lines": rate("n_dup_lines", "n_lines")})


def binomial_tail(k: Column, n: Column, alpha: float) -> Column:
    """P(X <= k) for X ~ Binomial(n, alpha), from the logarithms of its terms."""
    log_odds = F.log(F.lit(alpha / (1 - alpha)))
    first = F.struct((n * F.log(F.lit(1 - alpha))).alias("term"), F.exp(n * F.log(F.lit(1 - alpha))).alias("total"))

    def step(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j) + log_odds
        return F.struct(term.alias("term"), (acc["total"] + F.exp(term)).alias("total"))

    return F.when(k == 0, F.exp(n * F.log(F.lit(1 - alpha)))).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(k.cast("int"), F.lit(1))), first, step, lambda acc: acc["total"]))


def cutoffs(rates: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """stratum and ``limits`` (map of rule to cutoff), for strata with any certified cutoff."""
    alpha = alpha / len(RATES)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good")).where("good IS NOT NULL")
    seen = rates.where("NOT base_failed").join(known, "doc_id")
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("rate"), F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("cutoff")) for i, c in enumerate(cs))).alias("candidates")) for r, cs in RATES.items()))
    each = seen.select("stratum", "good", F.explode(rules).alias("r")).select("stratum", "good", "r.rule", "r.rate", F.explode("r.candidates").alias("c"))
    above = F.col("rate") > F.col("c.cutoff")
    counts = each.groupBy("stratum", "rule", F.col("c.place").alias("place"), F.col("c.cutoff").alias("cutoff")).agg(
        F.count_if("good").alias("n"), F.count_if(F.col("good") & above).alias("wrong"), F.count_if(~F.col("good") & above).alias("right")
    )
    strata = F.count("stratum").over(Window.partitionBy("rule", "place"))
    tested = counts.withColumn("level", delta / (len(RATES) * strata)).withColumn(
        "passed", F.when((F.col("n") > 0) & (F.col("wrong") <= alpha * F.col("n")), binomial_tail(F.col("wrong"), F.col("n"), alpha) <= F.col("level")).otherwise(F.lit(False))
    )
    row = Window.partitionBy("stratum", "rule").orderBy("place")
    certified = tested.withColumn("held", F.min("passed").over(row)).where("held AND right > wrong")
    chosen = certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct((F.col("right") - F.col("wrong")).alias("gain"), (-F.col("place")).alias("lenient"))).alias("cutoff"))
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))


def verdicts(df: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The counts of every row with base_failed and kept. Counts are written once and serve both the choice of cutoffs and the verdicts."""
    counts = common.written(features(df, stratum), "quality")
    rates = judged(counts)
    limits = cutoffs(rates, labels, alpha, delta)
    return with_verdict(rates, limits).drop(*RATES)


def with_verdict(rates: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds kept."""
    over = [F.coalesce(F.col(r) > F.col("limits")[r], F.lit(False)) for r in RATES]
    rejected = over[0]
    for x in over[1:]:
        rejected = rejected | x
    return rates.join(limits, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~rejected).drop("limits")


def keep(df: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """The kept rows with all their columns.

    Counts are made once for the cutoffs, of which only ids and numbers are written, and once more in each row, so that
    texts needn't be shuffled and rows needn't have unique ids. The cutoffs are one small row per stratum.
    """
    limits = common.written(cutoffs(judged(common.written(features(df, stratum), "quality")), labels, alpha, delta), "cutoffs")
    # a generator, through which the filter isn't pushed down: it would make the counts anew for each of its conditions
    made = F.explode(F.array(F.struct(*counted(F.coalesce(F.col("text"), F.lit(""))))))
    whole = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), layer(stratum), made.alias("c"))
    rates = judged(whole.select("row", "stratum", "c.w.*", "c.l.*", "c.n_symbols", "c.n_shouts"))
    return with_verdict(rates, limits).where("kept").select("row.*")


def oracle_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    """DuckDB SQL for the verdicts over documents and labels."""
    alpha = alpha / len(RATES)
    rules = ", ".join(f"('{r}', {i}, {c})" for r, cs in RATES.items() for i, c in enumerate(cs))
    score = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in RATES) + " END"
    return rf"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
  [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents),
places AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM places) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM twice) GROUP BY doc_id),
c AS (SELECT doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, length(text) - length(replace(text, '!', '')) AS n_shouts FROM w LEFT JOIN repeated r USING (doc_id)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeats,
  CASE WHEN n_words > 0 THEN n_shouts / n_words ELSE 0 END AS shouts, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS duplicate_lines FROM c),
rules(rule, place, cutoff) AS (VALUES {rules}),
counts AS (SELECT stratum, rule, place, cutoff, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND {score} > cutoff) AS wrong, count(*) FILTER (quality <> 1 AND {score} > cutoff) AS "right"
  FROM f JOIN labels USING (doc_id), rules WHERE NOT base_failed AND quality IS NOT NULL GROUP BY ALL),
tested AS (SELECT *, n > 0 AND wrong <= {alpha} * n AND list_sum([exp(lgamma(n + 1) - CASE WHEN j > 0 THEN lgamma(j + 1) ELSE 0 END - lgamma(n - j + 1) + j * ln({alpha}) + (n - j) * ln({1 - alpha})) FOR j IN range(0, wrong + 1)]) <= {delta} / ({len(RATES)} * count(*) OVER (PARTITION BY rule, place)) AS passed FROM counts),
held AS (SELECT * FROM (SELECT *, min(passed) OVER (PARTITION BY stratum, rule ORDER BY place) AS held FROM tested) WHERE held AND "right" > wrong),
chosen AS (SELECT stratum, rule, cutoff FROM held QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY "right" - wrong DESC, place) = 1),
rejected AS (SELECT DISTINCT doc_id FROM f JOIN chosen USING (stratum) WHERE {score} > cutoff)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.doc_id IS NULL AS kept FROM f LEFT JOIN rejected r USING (doc_id)"""
