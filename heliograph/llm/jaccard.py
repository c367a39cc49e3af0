"""N-gram Jaccard join by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

A text's set holds its distinct word n-grams. Two sets link if ``100 * intersection >= percent * union``, that is, if
their symmetric difference has at most ``(100 - percent) / (100 + percent)`` of the sum of their sizes.

* Sets are banded by size, each band reaching ``100 / percent`` times as far as it begins, so that sets that link lie in the same or in
  neighbouring bands. Each set has signatures for its own band and for the next one, hence two linked sets meet in one.
* A band's feature domain is cut by hash into first-level partitions and each of those into two second-level ones. If
  there are more than ``k`` second-level partitions, ``k`` being the largest difference of linked sets in that band, one
  first-level partition holds at most one difference, and one of its subsets of one part none. The hash of each such
  subset's features is a signature. Empty subsets say nothing and are left out as long as the set fills more than ``k``
  others, which makes some shared one a filled one; otherwise they are kept.
* Sets that share a signature are compared with the smallest of them. Where that leaves several components around a
  smallest set, all pairs across them are compared in blocks, which end as soon as nothing is apart, and give only links
  that join components. A pair first has its parity sketches compared: the bits in which they differ are never more than
  the difference of the sets, hence no link is lost; what passes is verified on the sets themselves, which are made again from the texts.

Equal sets are one class, by a 64-bit hash, from the start, so that copies aren't compared. Groups are read as sorted streams;
the pairwise step splits groups of more than ``BLOCK`` features into pairs of blocks. No pair across components is left out.

Defined results: a null or empty text has an empty set and links with nothing; a text with fewer words than ``n`` has one
feature, its words; repeated rows are copies; rows with the same id are one document; a null id has no component; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import apart, components

#: Features (8 bytes each) in a block of a group, about.
BLOCK = 1_000_000
#: Keys of sets that a task has already sent; when full it is emptied, and a set may be sent again.
SENT_KEPT = 500_000

U = np.uint64
#: Multipliers, all odd.
PRIMES = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BASE = U(0x9E6C63D0876A9A47)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


LETTERS = mixed(np.arange(1, 257, dtype=U) * PRIMES[6])


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as a text has needed them."""

    up, down = np.ones(1, U), np.ones(1, U)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            steps = np.empty((2, 1 << (n - 1).bit_length()), U)
            steps[0], steps[1], steps[:, 0] = BASE, U(pow(int(BASE), -1, 1 << 64)), 1
            cls.up, cls.down = np.cumprod(steps, axis=1, dtype=U)
        return cls.up[:n], cls.down


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z as a-z: polynomials over random letter values, from one running sum."""
    letters = np.frombuffer(text.encode().lower(), np.uint8)
    space = np.ones(len(letters) + 2, np.int8)
    space[1:-1] = SPACES[letters]
    edges = np.flatnonzero(np.diff(space))
    starts, ends = edges[::2], edges[1::2]
    up, down = Powers.to(len(letters) + 1)
    sums = np.zeros(len(letters) + 1, U)
    np.cumsum(LETTERS[letters] * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def shingles(text: str, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of a text; with fewer words, of all of them."""
    h = word_hashes(text)
    if not len(h):
        return np.empty(0, U)
    m = min(n, len(h))
    total = np.full(len(h) - m + 1, m, U)
    for i in range(m):
        total += mixed(h[i : len(h) - m + 1 + i] + U(i)) if i >= len(PRIMES) else h[i : len(h) - m + 1 + i] * PRIMES[i] + U(i)
    total = np.sort(mixed(total))
    first = np.ones(len(total), bool)
    first[1:] = total[1:] != total[:-1]
    return total[first]


class PartEnum:
    """Signatures for sets that link at ``percent``."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]
        self.plans: dict[int, tuple[int, int]] = {}

    def band(self, size: int) -> int:
        while self.starts[-1] <= size:
            b = self.starts[-1]
            self.starts.append(max(b + 1, -(-b * 100 // self.percent)))
        return int(np.searchsorted(self.starts, size, "right")) - 1

    def plan(self, band: int) -> tuple[int, int]:
        """The largest difference of linked sets that meet in a band, and the number of second-level partitions."""
        if band not in self.plans:
            while len(self.starts) <= band + 1:
                self.band(self.starts[-1])
            least, most = self.starts[max(0, band - 1)], self.starts[band + 1] - 1
            k = 2 * most * (100 - self.percent) // (100 + self.percent)
            parts = k + 1
            while parts < 4 * most:  # until even the smallest sets most likely fill more than k
                empty = parts * math.exp(-least / parts)
                if parts - empty - 4 * math.sqrt(empty) >= k + 1:
                    break
                parts += 1
            self.plans[band] = k, 2 * -(-parts // 2)
        return self.plans[band]

    def signatures(self, features: np.ndarray) -> np.ndarray:
        if not len(features):
            return np.empty(0, U)
        own, out = self.band(len(features)), []
        for band in (own, own + 1):
            k, parts = self.plan(band)
            part = (features % U(parts)).astype(np.int64)
            sums = np.zeros(parts, U)
            np.add.at(sums, part, mixed(features ^ PRIMES[5]))
            filled = np.flatnonzero(np.bincount(part, minlength=parts))
            subsets = filled if len(filled) > k else np.arange(parts)
            seed = U((band * 0x9E3779B97F4A7C15 + 0x1234567) & 0xFFFFFFFFFFFFFFFF)
            out.append(mixed(sums[subsets] + mixed(subsets.astype(U) + seed)))
        return np.concatenate(out)


def sketch(features: np.ndarray) -> bytes:
    """Parities of the numbers of features by cell, in at least four cells a feature, a power of two."""
    cells = 64
    while cells < 4 * len(features):
        cells *= 2
    odd = np.bincount((features >> U(20)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(data: bytes, size: int) -> np.ndarray:
    """A sketch with fewer cells."""
    x = np.frombuffer(data, U)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def possible(a: np.ndarray, rows: np.ndarray, n: int, ns: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of sketches may link with the sketch ``a`` of a set of size ``n``."""
    differ = np.bitwise_count(rows ^ a).sum(axis=1, dtype=np.int64)
    return (100 - percent) * (n + ns) >= (100 + percent) * differ


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def described(df: DataFrame, n: int) -> DataFrame:
    """doc_id, n (set size), key (hash of the set, null if empty) and sketch (null if this task has already sent the set's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            sizes, keys, sketches = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = shingles(text, n)
                key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                sizes.append(len(s))
                keys.append(key)
                if key is None or doc_id is None or key in sent:
                    sketches.append(None)
                else:
                    if len(sent) >= SENT_KEPT:
                        sent.clear()
                    sent.add(key)
                    sketches.append(sketch(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "n", "key", "sketch"])

    return common.map_arrow(df, run, "doc_id long, n long, key long, sketch binary")


def signature_rows(df: DataFrame, n: int, percent: int) -> DataFrame:
    """signature and key of every set, sent once per task at best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        scheme = PartEnum(percent)
        for batch in batches:
            found, keys, held = [], [], 0
            for text in batch.column("text").to_pylist():
                s = shingles(text, n)
                if not len(s):
                    continue
                key = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                if key in sent:
                    continue
                if len(sent) >= SENT_KEPT:
                    sent.clear()
                sent.add(key)
                found.append(scheme.signatures(s))
                keys.append(np.full(len(found[-1]), key, np.int64))
                held += len(found[-1])
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found))), pa.array(np.concatenate(keys))], names=["signature", "key"])
                    found, keys, held = [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found))), pa.array(np.concatenate(keys))], names=["signature", "key"])

    return common.map_arrow(df.select("text"), run, "signature long, key long")


def shared(rows: DataFrame) -> DataFrame:
    """signature, key and first (the smallest key) of the signatures that several sets have, from rows sorted by signature and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row of a batch waits for the next, as does the first key of the group that it ends
        tail = np.empty((2, 0), np.int64)
        first_of_tail, told = 0, False
        for batch in (*batches, None):
            sig, key = tail if batch is None else (np.concatenate([tail[i], batch.column(i).to_numpy()]) for i in (0, 1))
            if not len(sig):
                continue
            new = np.ones(len(sig), bool)
            new[1:] = sig[1:] != sig[:-1]
            start = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            first = key[start]
            if tail.shape[1]:
                first[0] = first_of_tail
            keep = np.ones(len(sig), bool)
            keep[1:] = new[1:] | (key[1:] != key[:-1])
            many = np.bincount(group, weights=keep) > 1
            if tail.shape[1]:
                many[0] |= told
            out = keep & many[group]
            if tail.shape[1] and told:
                out[0] = False  # it has been sent
            last = len(sig) - 1
            if batch is not None and not many[group[last]]:
                out[last] = False
            told = bool(many[group[last]])
            first_of_tail = first[group[last]]
            tail = np.array([sig[last:], key[last:]]) if batch is not None else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(key[out]), pa.array(first[group[out]])], names=["signature", "key", "first"])

    return common.map_arrow(rows, run, "signature long, key long, first long")


def promising(pairs: DataFrame, percent: int) -> DataFrame:
    """a and b of the pairs (a, b, n_a, n_b, sketch_a, sketch_b) that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")), strict=True)
            keep = []
            for a, b, n_a, n_b, s_a, s_b in rows:
                if 100 * min(n_a, n_b) >= percent * max(n_a, n_b):
                    size = min(len(s_a), len(s_b)) // 8
                    if possible(folded(s_a, size), folded(s_b, size)[None, :], n_a, np.array([n_b]), percent)[0]:
                        keep.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return common.map_arrow(pairs, run, "a long, b long")


def others(i: int, label: np.ndarray, side: np.ndarray, n: np.ndarray, bits: np.ndarray, percent: int) -> np.ndarray:
    """Places of the rows that row i is to be compared with and may link with: still apart, of the right side and size, with a sketch near enough."""
    at = np.flatnonzero((label != label[i]) & ((side == 2) if side[i] == 1 else (np.arange(len(n)) > i)) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
    return at[possible(bits[i], bits[at], n[i], n[at], percent)] if len(at) else at


def grouped_rows(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """The rows of each group, the hub first, then those that share most signatures, from rows sorted by group (the first column)."""

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in names), strict=True)

    for _, same in groupby(rows(), key=lambda r: r[0]):
        yield sorted(same, key=lambda r: (r[4] != 3, -r[3], r[1]))


def compared(rows: list[tuple], n: list[int], sketches: list[bytes]) -> tuple[np.ndarray, ...]:
    """label, side, n and sketches of a group's rows, as ``others`` takes them."""
    size = min(len(x) for x in sketches) // 8
    return np.unique([r[2] for r in rows], return_inverse=True)[1], np.array([r[4] for r in rows]), np.array(n), np.stack([folded(x, size) for x in sketches])


def with_partner(members: DataFrame, percent: int) -> DataFrame:
    """The rows (group, rep, root, weight, side, n, sketch), sorted by group, that may link with a row of another component, without n and sketch."""
    names = ("group", "rep", "root", "weight", "side", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_rows(batches, names):
            label, side, n, bits = compared(rows, [r[5] for r in rows], [r[6] for r in rows])
            found = np.zeros(len(rows), bool)
            for i in np.flatnonzero(side != 2):
                at = others(i, label, side, n, bits, percent)
                found[at] = True
                found[i] |= len(at) > 0
            if found.any():
                kept = [rows[i] for i in np.flatnonzero(found)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in kept], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=list(names[:5]))

    return common.map_arrow(members, run, "group long, rep long, root long, weight long, side int")


def across(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components, from rows (group, rep, root, weight, side, features) sorted by group.

    side tells which pairs to make: 0 with 0, 1 with 2, and 3, the hub, with all. The rows of a group start as the
    components they are in; a pair is compared only while its two rows are still apart, and a link is emitted only if it
    joins two components, hence a group gives fewer links than it has components.
    """

    def of_group(rows: list[tuple]) -> Iterator[tuple[int, int]]:
        sets = [np.frombuffer(r[5], U) for r in rows]
        label, side, n, bits = compared(rows, [len(x) for x in sets], [sketch(x) for x in sets])
        for i in np.flatnonzero(side != 2):
            for j in others(i, label, side, n, bits, percent):
                if label[j] != label[i] and linked(sets[i], sets[j], percent):
                    yield rows[i][1], rows[j][1]
                    label[label == label[j]] = label[i]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped_rows(batches, ("group", "rep", "root", "weight", "side", "features")):
            if found := list(of_group(rows)):
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return common.map_arrow(members, run, "a long, b long")


def features_of(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """id and features (bytes of the sorted hashes) of the wanted ids, from their texts."""
    texts = docs.where("doc_id IS NOT NULL").join(wanted, docs["doc_id"] == F.col("id"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([shingles(t, n).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "features"])

    return common.map_arrow(texts.select("id", "text"), sets, "id long, features binary")


def verified(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs of ids (a, b) whose texts' sets link. Texts are read again for the ids in question only."""
    pairs = common.written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "pairs")
    made = features_of(docs, common.written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted"), n)
    left, right = (made.select(F.col("id").alias(c), F.col("features").alias(f"features_{c}")) for c in ("a", "b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [
                (a, b)
                for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "features_a", "features_b")), strict=True)
                if linked(np.frombuffer(x, U), np.frombuffer(y, U), percent)
            ]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keep], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return common.map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "features_a", "features_b"), check, "a long, b long")


def in_blocks(placed: DataFrame, roots: DataFrame, classes: DataFrame) -> DataFrame:
    """group, key, rep, root, weight and side of the sets of every group that still holds several components.

    A group is cut into blocks of about BLOCK features, and goes once to each pair of blocks; its hub, the set that
    shares most signatures with the group's smallest set, goes to all of them.
    """
    narrow = classes.select("key", "rep", "n").join(roots, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("root", "rep").alias("root"))
    members = common.written(placed.join(narrow, "key"), "members")
    hub = F.max(F.when(F.col("key") != F.col("first"), F.struct("weight", "key")))["key"].alias("hub")
    still_open = members.groupBy("first").agg(F.sum("n").alias("size"), hub, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")
    every = F.sequence(F.lit(0), blocks - 1)
    own = F.array(F.struct(mine.alias("i"), mine.alias("j"), F.lit(0).alias("side")))
    with_others = F.transform(F.filter(every, lambda b: b != mine), lambda b: F.struct(F.least(b, mine).alias("i"), F.greatest(b, mine).alias("j"), F.when(mine < b, 1).otherwise(2).alias("side")))
    with_all = F.flatten(F.transform(every, lambda i: F.transform(F.sequence(i, blocks - 1), lambda j: F.struct(i.alias("i"), j.alias("j"), F.lit(3).alias("side")))))
    g = F.explode(F.when(F.col("key") == F.col("hub"), with_all).otherwise(F.concat(own, with_others))).alias("g")
    return apart(members, still_open.select("first", "size", "hub"), "first").select("first", "key", "rep", "root", "weight", g).select(F.xxhash64("first", "g.i", "g.j").alias("group"), "key", "rep", "root", "weight", "g.side")


def similarity_groups(df: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    docs = common.texts(df)
    listed = common.written(described(docs, n), "sets")
    classes = common.written(
        listed.where("key IS NOT NULL AND doc_id IS NOT NULL").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch")).where("sketch IS NOT NULL"), "classes"
    )
    rows = signature_rows(docs.where("doc_id IS NOT NULL"), n, percent)
    # the sets that share signatures with the smallest one of these, and how many each shares: near copies share many
    groups = shared(rows.repartition("signature").sortWithinPartitions("signature", "key"))
    placed = common.written(groups.groupBy("first", "key").agg(F.count("*").alias("weight")), "signatures")

    # each set with the smallest of its group
    side = lambda c: classes.select(F.col("key").alias(f"key_{c}"), F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    stars = placed.where("key <> first").select(F.col("first").alias("key_a"), F.col("key").alias("key_b"))
    near = promising(stars.join(side("a"), "key_a").join(side("b"), "key_b").select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b"), percent)
    links = verified(near, docs, n, percent)
    roots = common.written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")

    # Where the sets around one smallest set are still in several components: all pairs across these, in blocks. Sketches
    # tell which sets may link at all; only these have their features made again and carried.
    sketched = in_blocks(placed, roots, classes).join(classes.select("key", "n", "sketch"), "key").select("group", "rep", "root", "weight", "side", "n", "sketch")
    unresolved = common.written(with_partner(sketched.repartition("group").sortWithinPartitions("group"), percent), "unresolved")
    made = features_of(docs, unresolved.select(F.col("rep").alias("id")).distinct(), n)
    whole = unresolved.join(made, F.col("rep") == F.col("id")).select("group", "rep", "root", "weight", "side", "features")
    joins = common.written(across(whole.repartition("group").sortWithinPartitions("group"), percent), "links")
    final = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(joins.select(F.col("a").alias("u"), F.col("b").alias("v"))))

    keyed = classes.select(F.col("key").alias("class"), "rep").join(final, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("root", "rep").alias("root"))
    out = listed.join(keyed, F.when(F.col("doc_id").isNotNull(), F.col("key")) == F.col("class"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def keep_one(df: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of each component's smallest document, with all their columns, and rows without id."""
    groups = similarity_groups(df, n, percent)
    kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    return df.join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi").unionByName(df.where("doc_id IS NULL"))


def oracle_sql(n: int = 5, percent: int = 80) -> str:
    """DuckDB SQL for the groups over documents."""
    gram = " || ' ' || ".join(f"words[i + {k}]" if k else "words[i]" for k in range(n))
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < {n} THEN array_to_string(words, ' ') ELSE {gram} END AS s FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - {n - 1}, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, reach.r FROM reach JOIN edges e ON e.x = reach.doc_id WHERE reach.r < e.y)
SELECT d.doc_id, coalesce(max(s.n), 0) AS n_shingles, coalesce(min(r.r), d.doc_id) AS component_id FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""
