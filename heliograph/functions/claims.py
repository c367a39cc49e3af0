"""Contradictions between two claims: negation, numbers, antonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FINGERPRINT_STOP_WORDS, words

#: Words that negate, and pairs of opposite words.
NEGATIONS = "not no never neither nor cannot can't won't isn't aren't doesn't didn't hasn't haven't hadn't wouldn't shouldn't couldn't".split()
ANTONYMS = [
    ("increase", "decrease"), ("rise", "fall"), ("approve", "reject"), ("accept", "decline"), ("open", "closed"), ("confirmed", "denied"),
    ("support", "oppose"), ("expand", "shrink"), ("launch", "cancel"), ("succeed", "fail"), ("positive", "negative"), ("gain", "loss"),
]
NUMBER = r"^[0-9]+(?:\.[0-9]+)?(?:m|b|k|million|billion|thousand)?$"


def negated(text: Column) -> Column:
    return F.lower(text).rlike(rf"(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(NEGATIONS)})(?:[^\p{{L}}\p{{N}}_]|$)")


def content(text: Column) -> Column:
    """Words of three characters or more without stop words."""
    stop = F.array(*map(F.lit, FINGERPRINT_STOP_WORDS))
    return F.filter(words(text), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


def numbers(text: Column) -> Column:
    """(anchor, value) of each number: the nearest of the three words before it that is all letters and no stop word. An anchor's last number counts."""
    parts = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    stop = F.array(*map(F.lit, FINGERPRINT_STOP_WORDS))

    def at(ws: Column) -> Column:
        bare = F.transform(ws, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
        good = F.transform(bare, lambda w: F.when(w.rlike(r"^\p{L}+$") & ~F.array_contains(stop, w), w))
        back = lambda i, k: F.when(i >= k, good[i - k])
        found = F.transform(ws, lambda w, i: F.when(w.rlike(NUMBER), F.struct(F.coalesce(*(back(i, k) for k in (1, 2, 3))).alias("anchor"), w.alias("value"))))
        found = F.filter(found, lambda x: x.isNotNull() & x["anchor"].isNotNull())
        return F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda y: y["anchor"] == x["anchor"]))

    return F.transform(F.array(parts), at)[0]


def conflict(a: dict[str, Column], b: dict[str, Column], least: int = 2) -> Column:
    """pattern of the first conflict of two claims, given as columns negated, content and numbers; null if there is none.

    negation_conflict (major): one is negated, ``least`` words are shared. number_conflict (moderate): another number behind the same word.
    antonym_conflict (minor): opposite words, and ``least`` - 1 shared words besides, one at least.
    """
    shared = F.size(F.array_intersect(a["content"], b["content"]))
    number = F.exists(a["numbers"], lambda x: F.exists(b["numbers"], lambda y: (x["anchor"] == y["anchor"]) & (x["value"] != y["value"])))
    pairs = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for p in ANTONYMS for x, y in (p, p[::-1])))
    both = F.array_intersect(a["content"], b["content"])
    antonym = F.exists(pairs, lambda p: F.array_contains(a["content"], p["x"]) & F.array_contains(b["content"], p["y"]) & (F.size(F.array_except(both, F.array(p["x"], p["y"]))) >= max(1, least - 1)))
    return F.when((a["negated"] != b["negated"]) & (shared >= least), "negation_conflict").when(number, "number_conflict").when(antonym, "antonym_conflict")


def severity(pattern: Column) -> Column:
    return F.when(pattern == "negation_conflict", "MAJOR").when(pattern == "number_conflict", "MODERATE").when(pattern == "antonym_conflict", "MINOR")
