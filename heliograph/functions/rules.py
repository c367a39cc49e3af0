"""Column functions of the rule-based scorers."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scores import clamp


def pseudonym(value: Column) -> Column:
    """anon_ and 16 digits of the SHA-256; a pseudonym stays itself."""
    return F.when(value.rlike("^anon_[0-9a-f]{16}$"), value).otherwise(F.concat(F.lit("anon_"), F.substring(F.sha2(value, 256), 1, 16)))


def sanitized(text: Column, patterns: Sequence[str], most: int = 50_000) -> Column:
    """The first ``most`` characters, as far as a prompt takes them, with each pattern blanked out in order."""
    out = F.substring(text, 1, most)
    for p in patterns:
        out = F.regexp_replace(out, f"(?i){p}", "[removed]")
    return out


def engagement(props: Column, keys: Sequence[str]) -> Column:
    """The first of the keys of a JSON object that holds a whole number, commas dropped, else 0."""
    return F.coalesce(*(F.replace(F.get_json_object(props, f"$.{k}"), F.lit(","), F.lit("")).try_cast("bigint") for k in keys), F.lit(0).cast("long"))


def velocity_virality(likes: Column, shares: Column, comments: Column, hours: Column) -> tuple[Column, Column]:
    """Engagement per hour, and shares / (likes + comments + 1) up to 1; null where nothing happened."""
    some = (likes != 0) | (shares != 0) | (comments != 0)
    return F.when(some & (hours > 0), (likes + comments + shares) / hours), F.when(some & (shares > 0), F.least(shares / (likes + comments + 1), F.lit(1.0)))


def quality_completeness(body: Column, title: Column, author: Column, metadata: Column, media: Column) -> tuple[Column, Column]:
    """Quality .5 + .2 (over 100 characters) + .2 (over 500) + .1 (media); completeness .3 title + .4 text + .1 author + .2 metadata."""
    part = lambda c, w: F.when(c, w).otherwise(0.0)
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    n = F.length(body)
    return F.least(0.5 + part(n > 100, 0.2) + part(n > 500, 0.2) + part(media, 0.1), F.lit(1.0)), F.least(part(has(title), 0.3) + part(has(body), 0.4) + part(has(author), 0.1) + part(metadata, 0.2), F.lit(1.0))


def sentiment(text: Column, lexicon: dict[str, float], cut: float = 0.2) -> Column:
    """Sum of the words' values over the root of their number, cut at +- ``cut``. Values (up to nine decimals) are summed exactly, so that sums on a cut fall on its side."""
    exact = lambda x: F.lit(str(x)).cast("decimal(38,9)")
    table = F.create_map(*(x for word, value in lexicon.items() for x in (F.lit(word), exact(value))))
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    total = F.aggregate(words, exact(0), lambda a, w: (a + F.coalesce(F.element_at(table, w), exact(0))).cast("decimal(38,9)"))
    s = total.cast("double") / F.sqrt(F.greatest(F.size(words), F.lit(1)))
    return F.when(s >= cut, "positive").when(s <= -cut, "negative").otherwise("neutral")


#: Frequent words of each language.
FUNCTION_WORDS = {"en": ["the", "and", "of", "to", "in", "is", "that", "it"], "fr": ["le", "la", "de", "et", "les", "des", "que", "un"], "de": ["der", "die", "und", "das", "ein", "nicht", "zu", "sich"], "es": ["el", "los", "por", "con", "para", "una", "que", "y"]}


def language(text: Column) -> Column:
    """The language with most function words in the text, the first of equals; null without any."""
    words = F.split(F.lower(text), r"[\s.,;:!?]+")
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(*known)))
    hits = [count(known) for known in FUNCTION_WORDS.values()]
    best = F.greatest(*hits)
    out = F.when(best == 0, F.lit(None))
    for name, n in zip(FUNCTION_WORDS, hits, strict=True):
        out = out.when(n == best, name)
    return out


def hashed_words(text: Column, size: int) -> Column:
    """Hashed bag of words with length 1 as a map of bucket to weight; the hash is the same in every process."""
    buckets = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    counts = F.transform(F.array_sort(F.array_distinct(buckets)), lambda b: F.struct(b.alias("bucket"), F.size(F.filter(buckets, lambda x: x == b)).cast("double").alias("n")))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, c: s + c["n"] * c["n"]))
    return F.transform(counts, lambda c: F.struct(c["bucket"].alias("bucket"), (c["n"] / norm).alias("weight")))


def weighted(parts: Sequence[tuple[float, Column]]) -> Column:
    """Weighted mean over the parts that aren't null."""
    total, weight = F.lit(0.0), F.lit(0.0)
    for w, c in parts:
        total, weight = total + w * F.coalesce(c, F.lit(0.0)), weight + F.when(c.isNull(), 0.0).otherwise(w)
    return total / F.nullif(weight, F.lit(0.0))


def boosted(base: Column, boost: Column, watch: Column, w1: float = 0.1, w2: float = 0.1) -> Column:
    """Two convex boosts, one after the other, each at most 1."""
    first = F.least(F.lit(1.0), base * (1 - w1) + boost * w1)
    return F.least(F.lit(1.0), first * (1 - w2) + watch * w2)


def trust(primary: Column, latency_share: Column, confirmed: Column, total: Column, authority: Column) -> Column:
    """.35 primacy, .20 recency, .30 accuracy (of ten observations or more) and .15 authority."""
    accuracy = F.when(total >= 10, confirmed / total).otherwise(F.lit(0.5))
    return clamp(0.35 * F.when(primary, 1.0).otherwise(0.3) + 0.20 * F.greatest(F.lit(0.0), 1 - latency_share) + 0.30 * accuracy + 0.15 * authority)


def action_priority(opportunity: Column, urgency: Column, risk: Column, trending: Column) -> Column:
    """.35 opportunity, .30 urgency (.15 more when trending) and .35 risk."""
    return 0.35 * opportunity + 0.30 * F.least(F.lit(1.0), urgency + F.when(trending, 0.15).otherwise(0.0)) + 0.35 * risk


def priority_level(p: Column) -> Column:
    return F.when(p >= 0.8, "CRITICAL").when(p >= 0.6, "HIGH").when(p >= 0.4, "MEDIUM").when(p >= 0.2, "LOW").otherwise("MONITOR")


def repo_health(days: Column, stars: Column, issues: Column, ci: Column, licensed: Column, star_scale: float = 10_000.0, issue_scale: float = 20.0) -> Column:
    """.30 recency, .25 community, .20 issues, .15 tests and .10 licence."""
    community = F.least(F.log1p(stars) / F.log1p(F.lit(star_scale)), F.lit(1.0))
    return clamp(0.30 * F.exp(-days / 120.0) + 0.25 * community + 0.20 * (1 - F.least(issues / issue_scale, F.lit(1.0)) * 0.7) + 0.15 * ci + 0.10 * F.when(licensed, 1.0).otherwise(0.0))


def page_bounds(page: int, size: int, most: int = 100) -> tuple[int, int]:
    """Limit and offset of a page, numbered from 1; a ValueError says what is out of range."""
    if page < 1:
        raise ValueError(f"pages are numbered from 1, not {page}")
    if not 1 <= size <= most:
        raise ValueError(f"a page has 1 to {most} rows, not {size}")
    return size, (page - 1) * size


def date_range(start: str | None, end: str | None) -> tuple[datetime | None, datetime | None]:
    """Both ends of a range of ISO times, open where one is missing; times without a zone are read as UTC."""
    read = lambda t: datetime.fromisoformat(t) if t else None
    first, last = (t.replace(tzinfo=t.tzinfo or timezone.utc) if t else None for t in (read(start), read(end)))
    if first and last and first > last:
        raise ValueError(f"{start} is after {end}")
    return first, last
