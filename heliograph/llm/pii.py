"""Personal data by weak supervision, on DataFrame functions only.

Candidates are the matches of base patterns, checked or not, and of further patterns for what the base ones lose (a
number that runs into its neighbour, a phone number without its plus sign, other kinds). Five labelers vote on each one
(1, 0 for none, -1): the strict form, checksum or range, gazetteers, the words before it, and the characters around it.
For each kind, expectation-maximisation over the counts of vote patterns estimates how reliable its labelers are and how
likely each pattern is personal data, starting from what is known of the labelers (a checksum hardly ever fails true numbers);
a logistic span classifier is then fitted to these probabilities, on the votes and on features that no labeler sees, and
scores each candidate. A base span that passes its check stays in any case; other candidates are added if their score is high enough and
they touch no base span.

The rows that are counted on the driver are distinct patterns of votes and features, at most 3^5 * 2^4 for each kind, whatever the input.

Defined results: null and empty texts have no spans; a null doc_id is kept; repeated rows give repeated results; an
empty table gives no rows. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import let

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban")
LABELERS = ("form", "check", "gazetteer", "context", "edges")
#: Features of a candidate besides the votes, each 0 or 1: a base pattern's match, parted by signs, long for its kind, and right behind a line's begin or a label.
FEATURES = ("own", "parted", "long", "labelled")
#: Characters (digits of numbers) from which a candidate is long.
LONG = {"email": 24, "ip": 13, "card": 16, "phone": 11, "ssn": 12, "iban": 20}
#: What is known of the labelers before any count: votes of 1, 0 and -1 for true and false candidates, as so many candidates seen.
PRIORS = {
    "form": ((14, 4, 2), (6, 7, 7)), "check": ((17, 2, 1), (10, 5, 5)), "gazetteer": ((15, 4, 1), (8, 6, 6)),
    "context": ((120, 76, 4), (15, 105, 80)), "edges": ((16, 3, 1), (9, 5, 6)),
}
#: The same for a check that true ones pass by rule: a checksum, a range, a length.
BY_RULE, RULED = ((190, 8, 2), (30, 20, 150)), {"email", "ip", "card", "phone"}
#: Characters before a candidate that the context labeler sees.
REACH = 40
#: Stands for a single separator between digits; texts that hold it get another control in its place first.
JOINER = "\x01"

#: Base patterns, written so that long runs of their characters take linear time and no recursion: starts inside a run,
#: other than right after a match, can't match; see the docstring of ``base_candidates`` for cards.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.(?=[A-Za-z0-9-])(?:(?!\.(?![A-Za-z0-9-]))[A-Za-z0-9.-])++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = rf"(?<![0-9{JOINER}])[0-9][0-9{JOINER}]{{11,}}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Further patterns.
CARD_TOO = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])"
PHONE_TOO = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|(?<=[ +0-9][ .-])[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"

#: Gazetteers and cue words.
TOP_DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|io|co|me|dev|app|de|fr|es|uk|us|eu|it|nl|ch|at|be|ca|au|jp|cn|in|br|ru|pl|se|no|dk|fi|pt|mx|ie|nz"
CALLING_CODES = "1|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|7|81|82|84|86|90|91|92|98"
IBAN_COUNTRIES = "AD|AE|AT|BE|BG|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|TR"
CUES = {
    "email": "mail|contact|write|reach|from:|to:|cc:|address",
    "ip": r"\bip\b|host|server|address|from|client|login|logged",
    "card": "card|visa|master|amex|credit|debit|pay|cvv|account",
    "phone": "phone|tel\\b|tel[.:]|call|mobile|cell|fax|contact|whatsapp|dial",
    "ssn": "ssn|social|security",
    "iban": "iban|account|bank|konto|compte|cuenta|transfer",
}
CUES_AGAINST = r"version|\bv$|build|release|chapter|section|isbn|issn|sku|order|invoice no|part no|doi|serial|issue"


def matches(text: Column, pattern: str, block: int = 256) -> Column:
    """start, end, value, before (REACH characters) and after (one) of each match, in order.

    Places are added up in blocks of matches, which keeps the copying of results low when there are very many.
    """
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def of(values: Column, between: Column) -> Column:
        def one(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(between[i])
            end = start + F.length(values[i])
            found = F.struct(start.alias("start"), end.alias("end"), values[i].alias("value"), F.right(between[i], F.lit(REACH)).alias("before"), F.left(between[i + 1], F.lit(1)).alias("after"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

        def many(acc: Column, first: Column) -> Column:
            got = F.aggregate(F.sequence(first, F.least(first + block, F.size(values)) - 1), F.struct(acc["at"].alias("at"), none.alias("out")), one)
            return let(got, lambda g: F.struct(g["at"].alias("at"), F.concat(acc["out"], F.array(g["out"])).alias("out")))

        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int,value:string,before:string,after:string>>>").alias("out"))
        return F.when(F.size(values) > 0, F.aggregate(F.sequence(F.lit(0), F.size(values) - 1, F.lit(block)), begin, many, lambda acc: F.flatten(acc["out"]))).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda values: let(F.split(text, pattern, -1), lambda between: of(values, between)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), add) % 10 == 0


def small_parts(ip: Column) -> Column:
    """Whether all parts are at most 255."""
    return F.forall(F.split(ip, "\\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (F.coalesce(q.cast("int"), F.lit(999)) <= 255)))


def checked(kind: str, value: Column) -> Column:
    """The base check of a kind."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return small_parts(value)
    n = F.length(digits(value))
    if kind == "card":
        return F.when(n.between(12, 19), luhn(digits(value))).otherwise(F.lit(False))
    return n.between(9, 15)


def vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.when(no, -1) if no is not None else out).otherwise(0).cast("tinyint")


def votes(kind: str, s: Column) -> dict[str, Column]:
    """What each labeler says about a candidate."""
    value, before, after = s["value"], s["before"], s["after"]
    number = digits(value)
    form = {
        # the group in this pattern takes stack for each label, so that an address of any length isn't for it
        "email": (F.when(F.length(value) <= 254, value.rlike(r"^[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,24}$")).otherwise(F.lit(False)), value.rlike(r"\.\.|@-|^[.]")),
        "ip": (value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), value.rlike(r"[0-9]{4}|(?:^|\.)0[0-9]")),
        "card": (value.rlike(rf"^(?:[0-9]{{13,16}}|[0-9]{{4}}(?:[ {JOINER}-][0-9]{{4}}){{3}})$"), F.length(number).isin(12, 18)),
        "phone": (value.rlike(r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}$|^\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}$"), value.rlike(r"  |\.\.|--")),
        "ssn": (F.lit(False), F.lit(False)),  # the pattern is the form
        "iban": (F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34), F.lit(False)),
    }[kind]
    check = {
        "email": (F.length(value) <= 254, F.length(value) > 254),
        "ip": (small_parts(value), ~small_parts(value)),
        "card": (checked("card", value), ~checked("card", value)),
        "phone": (F.length(number).between(10, 15), ~F.length(number).between(9, 15)),
        "ssn": (~value.rlike("-00-|-0000$"), value.rlike("-00-|-0000$")),
        "iban": (F.length(number) >= 10, F.length(number) < 8),
    }[kind]
    gazetteer = {
        "email": (value.rlike(rf"(?i)\.(?:{TOP_DOMAINS})$"), ~value.rlike(r"\.[A-Za-z-]{2,}$")),
        "ip": (~value.rlike(r"^(?:0|22[4-9]|2[3-5][0-9])\.") & ~value.rlike(r"\.0\.0$"), value.rlike(r"^0\.")),
        "card": (number.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"), number.rlike("^[01789]")),
        "phone": (value.rlike(rf"^\+(?:{CALLING_CODES})|^\([2-9]"), value.rlike(r"^\+0|^\([01]")),
        "ssn": (~value.rlike("^(?:000|666|9)"), value.rlike("^(?:000|666|9)")),
        "iban": (value.rlike(f"^(?:{IBAN_COUNTRIES})"), ~value.rlike(f"^(?:{IBAN_COUNTRIES})")),
    }[kind]
    return {
        "form": vote(*form), "check": vote(*check), "gazetteer": vote(*gazetteer),
        "context": vote(before.rlike(f"(?i)(?:{CUES[kind]})"), before.rlike(f"(?i)(?:{CUES_AGAINST})[^a-z]*$")),
        "edges": vote((F.right(before, F.lit(1)).rlike(r"^[\s\"'(<\[:,;]?$")) & after.rlike(r"^[\s\"')>\].,;:!?]?$"), F.right(before, F.lit(1)).rlike("^[A-Za-z0-9_]$") | after.rlike("^[A-Za-z0-9_]$")),
    }


CANDIDATE = "array<struct<kind:string,start:int,end:int,base:boolean,votes:array<tinyint>,features:array<tinyint>>>"


def features(kind: str, own: bool, s: Column) -> dict[str, Column]:
    value = s["value"]
    size = F.length(value) if kind in ("email", "iban") else F.length(digits(value))
    flag = lambda c: c.cast("tinyint")
    return {
        "own": F.lit(int(own)).cast("tinyint"), "parted": flag(value.rlike(rf"[ ()+{JOINER}-]|[0-9A-Za-z]\.[A-Za-z0-9.]*@")),
        "long": flag(size >= LONG[kind]), "labelled": flag(s["before"].rlike(r"(?:^|\n|[A-Za-z][:=#] ?)$")),
    }


def candidates_of(text: Column, kind: str, pattern: str, base: bool, when: Column) -> Column:
    none = F.array().cast(CANDIDATE)

    def made(s: Column) -> Column:
        says, has = votes(kind, s), features(kind, base, s)
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), (checked(kind, s["value"]) if base else F.lit(False)).alias("base"), F.array(*(says[x] for x in LABELERS)).alias("votes"), F.array(*(has[x] for x in FEATURES)).alias("features"))

    return F.when(when, F.transform(matches(text, pattern), made).cast(CANDIDATE)).otherwise(none)


def candidates(df: DataFrame) -> DataFrame:
    """doc_id and found: candidates with kind, start, end, base (a base span that passed its check), votes and features.

    Cards: single separators between digits are first replaced by JOINER, so that a card is a run of two classes.
    """
    docs = common.texts(df)
    text = F.col("text")
    numbers = text.rlike("[0-9](?:[ -]?[0-9]){8}")
    cards = F.when(numbers, F.regexp_replace(F.replace(text, F.lit(JOINER), F.lit("\x02")), "(?<=[0-9])[ -](?=[0-9])", JOINER)).otherwise(F.lit(""))
    docs = docs.select("doc_id", "text", numbers.alias("numbers"), cards.alias("cards"))
    parts = [
        candidates_of(text, "email", EMAIL, True, F.contains(text, F.lit("@"))),
        candidates_of(text, "ip", IP, True, text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]")),
        candidates_of(F.col("cards"), "card", CARD, True, F.col("numbers")),
        candidates_of(text, "phone", PHONE, True, text.rlike(r"\+[0-9]")),
        candidates_of(text, "card", CARD_TOO, False, F.col("numbers")),
        candidates_of(text, "phone", PHONE_TOO, False, text.rlike(r"[0-9]{3}[.-][0-9]{4}")),
        candidates_of(text, "ssn", SSN, False, text.rlike("[0-9]{3}-[0-9]{2}-[0-9]{4}")),
        candidates_of(text, "iban", IBAN, False, text.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}")),
    ]
    return docs.select("doc_id", F.concat(*parts).alias("found"))


Pattern = tuple[int, ...]


def reliabilities(patterns: dict[Pattern, float], kind: str = "card", rounds: int = 200) -> tuple[dict[Pattern, float], np.ndarray, float]:
    """Expectation-maximisation over one kind's weighted vote patterns.

    Returns each pattern's probability, the vote rates (labeler, true or false, vote + 1) and the share of true candidates.
    """
    votes = np.array(list(patterns), int).reshape(-1, len(LABELERS)) + 1
    weight = np.array(list(patterns.values()))
    priors = PRIORS | ({"check": BY_RULE} if kind in RULED else {})
    known = np.array([[side[::-1] for side in priors[x]] for x in LABELERS], float)
    rates, share, labeler = known / known.sum(axis=2, keepdims=True), 0.5, np.arange(len(LABELERS))
    p = np.zeros(len(votes))
    for _ in range(rounds):
        z = np.log(share / (1 - share)) + np.log(rates[labeler, 0, votes] / rates[labeler, 1, votes]).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        share = (weight @ new + 1) / (weight.sum() + 2)
        said = known.copy()
        for j in labeler:
            np.add.at(said[j, 0], votes[:, j], weight * new)
            np.add.at(said[j, 1], votes[:, j], weight * (1 - new))
        rates = said / said.sum(axis=2, keepdims=True)
        moved, p = np.abs(new - p).max(initial=0.0), new
        if moved < 1e-9:
            break
    return dict(zip(patterns, p.tolist(), strict=True)), rates, float(share)


def classifier(patterns: dict[tuple[Pattern, Pattern], float], p: dict[Pattern, float], rounds: int = 25, ridge: float = 0.1) -> list[float]:
    """Logistic weights (the constant, the votes, the features) fitted by Newton's method to the probabilities of (votes, features) patterns.

    A pattern counts for as much as its probability is sure, so that unsure ones are judged by what sure ones have taught.
    """
    x = np.array([(1, *v, *f) for v, f in patterns], float).reshape(-1, 1 + len(LABELERS) + len(FEATURES))
    y = np.array([p[v] for v, _ in patterns])
    n = np.array(list(patterns.values())) * (2 * y - 1) ** 2
    w = np.zeros(x.shape[1])
    for _ in range(rounds if len(x) else 0):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve((x.T * (n * q * (1 - q))) @ x + ridge * np.eye(len(w)), x.T @ (n * (q - y)) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def fitted(counts: list[tuple[str, Pattern, Pattern, float]]) -> dict[str, list[float]]:
    """The classifier of each kind, from counts of (kind, votes, features)."""
    weights = {}
    for kind in KINDS:
        whole = {(v, f): n for k, v, f, n in counts if k == kind}
        by_votes: dict[Pattern, float] = {}
        for (v, _), n in whole.items():
            by_votes[v] = by_votes.get(v, 0.0) + n
        weights[kind] = classifier(whole, reliabilities(by_votes, kind)[0])
    return weights


def score(s: Column, weights: dict[str, list[float]]) -> Column:
    """A candidate's probability, from its kind's classifier."""
    of_kind = F.create_map(*(x for k, w in weights.items() for x in (F.lit(k), F.array(*map(F.lit, w)))))

    def z(w: Column) -> Column:
        seen = [s["votes"][j] for j in range(len(LABELERS))] + [s["features"][j] for j in range(len(FEATURES))]
        total = w[0]
        for j, x in enumerate(seen, 1):
            total = total + w[j] * x
        return 1 / (1 + F.exp(-total))

    return let(of_kind[s["kind"]], z)


def scan(df: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id and spans: kind, start, end, base and score, by start, then kind. Candidates are written once; no value is."""
    found = common.written(candidates(df), "pii")
    counted = found.select(F.explode("found").alias("c")).groupBy("c.kind", "c.votes", "c.features").count().orderBy("kind", "votes", "features").collect()
    weights = fitted([(r["kind"], tuple(r["votes"]), tuple(r["features"]), float(r["count"])) for r in counted])

    def choose(cands: Column) -> Column:
        scored = F.transform(cands, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), score(s, weights).alias("score")))
        return let(scored, lambda c: let(F.filter(c, lambda s: s["base"]), lambda b: in_order(F.concat(b, F.filter(c, lambda s: ~s["base"] & (s["score"] >= least) & ~F.exists(b, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"])))))))

    def in_order(spans: Column) -> Column:
        rank = F.create_map(*(x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))))
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base"), s["score"].alias("score")))
        return F.transform(F.array_sort(F.array_distinct(keyed)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["base"].alias("base"), s["score"].alias("score")))

    return found.select("doc_id", choose(F.col("found")).alias("spans"))
