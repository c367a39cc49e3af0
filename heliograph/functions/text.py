"""Column functions on texts and token sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that title comparison leaves out.
STOP_WORDS = (
    "a an the and or but in on at to for of with is are was were be been being have has had do does did will would could should may might must "
    "this that these those it its by from as into"
).split()

#: URL parameters that say nothing about content.
TRACKING_PARAMS = "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_source_platform fbclid gclid msclkid ref source s via _hsenc _hsmi mc_eid".split()


#: URL parameters that normalisation of posts drops, and words that fingerprints of texts leave out.
CLEANED_PARAMS = "utm_source utm_medium utm_campaign utm_term utm_content fbclid gclid msclkid _ga mc_cid mc_eid".split()
FINGERPRINT_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did "
    "will would could should may might shall can this that these those "
    "it its and or but if in on at to for of from with by about"
).split()


def filled(*columns: Column) -> Column:
    """The first column that is neither null nor empty, else the empty string."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns), F.lit(""))


def words(text: Column) -> Column:
    """Distinct lower-case words: letters, digits and underscore, other characters as separators."""
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != ""))


def title_tokens(text: Column) -> Column:
    """Words of a title without stop words and words of one or two letters."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets, 0 where one is empty or null."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def recall(query: Column, document: Column) -> Column:
    """Share of the query's tokens that the document has, 0 for an empty query."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, document)) / F.size(F.array_distinct(query))).otherwise(F.lit(0.0))


def clean(html: Column) -> Column:
    """Markup out, white space collapsed, trimmed, NULs out, in this order."""
    return F.replace(F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " ")), F.lit("\x00"), F.lit(""))


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def normal_url(url: Column, drop: list[str] | None = None, fold_host: bool = True) -> Column:
    """Canonical URL: lower-case scheme and host without www., no trailing slash, tracking parameters or fragment."""
    url = F.trim(url)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: (p != "") & F.contains(p, F.lit("=")) & ~p.endswith("=") & ~F.array_contains(F.array(*map(F.lit, drop or TRACKING_PARAMS)), F.lower(F.substring_index(p, "=", 1))))
    host = url_host(url)
    host = F.when(host.startswith("www."), F.substr(host, F.lit(5))).otherwise(host) if fold_host else host
    path = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    kept = F.concat_ws("&", pairs)
    out = F.concat(F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lit("://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), out).otherwise(url)


def cleaned_url(url: Column) -> Column:
    """The URL without fragment, tracking parameters and parameters without value; the host stays as it is."""
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.contains(p, F.lit("=")) & ~p.endswith("=") & ~F.lower(F.substring_index(p, "=", 1)).isin(*CLEANED_PARAMS))
    kept = F.concat_ws("&", pairs)
    return F.concat(F.regexp_extract(url, "^([^?#]*)", 1), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def semver(version: Column) -> Column:
    """major, minor and patch of a version such as v1.2.3-rc1 or 1.2; zeros if it can't be read.

    What follows the first - or + is its suffix. The rest, without a leading v, is two numbers with a dot between, and maybe a third.
    """
    whole = F.trim(version)
    core = F.substring_index(F.substring_index(whole, "-", 1), "+", 1)
    numbers = F.split(F.when(core.startswith("v"), F.substring(core, 2, 1_000_000)).otherwise(core), "[.]")
    last = F.element_at(numbers, -1)
    counted = F.when((F.size(numbers) == 3) & (last == ""), F.slice(numbers, 1, 2)).otherwise(numbers)
    suffix = F.length(whole) - F.length(core)
    good = F.size(counted).between(2, 3) & F.forall(counted, lambda x: (x != "") & (F.translate(x, "0123456789", "") == "")) & (suffix != 1)
    part = lambda i: F.coalesce(F.when(good, F.get(counted, i).try_cast("int")), F.lit(0))
    return F.struct(part(F.lit(0)).alias("major"), part(F.lit(1)).alias("minor"), part(F.lit(2)).alias("patch"))


def version_change(before: Column, after: Column, breaking: Column) -> Column:
    """breaking, or the highest part of two versions that differs; unknown if none does."""
    a, b = semver(before), semver(after)
    return F.when(breaking, "breaking").when(a["major"] != b["major"], "major").when(a["minor"] != b["minor"], "minor").when(a["patch"] != b["patch"], "patch").otherwise("unknown")


#: Upgrade urgency by kind of change, and what security fixes and critical changes add.
URGENCY = {"breaking": 0.80, "major": 0.65, "minor": 0.40, "patch": 0.20, "unknown": 0.30}
SECURITY_BONUS, CRITICAL_BONUS = 0.3, 0.15


def upgrade_urgency(change: Column, security: Column, critical: Column) -> Column:
    base = F.create_map(*(F.lit(x) for pair in URGENCY.items() for x in pair))[change]
    secured = F.when(security, F.least(base + SECURITY_BONUS, F.lit(1.0))).otherwise(base)
    return F.when(critical, F.least(secured + CRITICAL_BONUS, F.lit(1.0))).otherwise(secured)


def fingerprint(url: Column, platform: Column, author: Column, body: Column) -> Column:
    """SHA-1 of the canonical URL, or without one of platform, author and the body's first 64 characters."""
    return F.sha1(F.when(F.coalesce(url, F.lit("")) != "", normal_url(url)).otherwise(F.concat_ws("|", platform, F.coalesce(author, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, 64))))


def caps_ratio(text: Column) -> Column:
    """Share of capitals among letters, 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(letters > 0, F.regexp_count(text, F.lit(r"\p{Lu}")) / letters).otherwise(F.lit(0.0))


def url_density(text: Column) -> Column:
    """URLs per 100 characters, 0 for an empty text."""
    return F.when(F.length(text) > 0, F.regexp_count(text, F.lit(r"https?://\S+")) / (F.length(text) / 100)).otherwise(F.lit(0.0))


def likely_bot(text: Column, caps: float = 0.7, urls: float = 3.0) -> Column:
    return (caps_ratio(text) >= caps) | (url_density(text) >= urls)


def sentences(text: Column) -> Column:
    """Sentences, cut at white space after a full stop, exclamation or question mark."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: s != "")


#: Verbs that make a sentence a claim.
CLAIM_VERBS = "announce release launch publish report find introduce reveal confirm state claim show demonstrate prove support reject deprecate".split()


def claims(text: Column, most: int = 10) -> Column:
    """Up to ``most`` sentences with a claim verb."""
    verbs = F.array(*map(F.lit, CLAIM_VERBS))
    return F.slice(F.filter(sentences(text), lambda s: F.arrays_overlap(words(s), verbs)), 1, most)
