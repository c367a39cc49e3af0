"""Phrase collocations: multikey three-way quicksort of suffix pointers, routed by leading words.

A pointer to each word stands for the words from there to the end of its piece, read to a maximum depth. Tasks merge equal
pointers of what they have read, then pointers are routed through the cluster: those to be counted by one word by that
word, those to be read further by their first two words, so that no frequent first word meets in one place. Each
routed bucket is sorted by multikey three-way quicksort: pointers are parted into less, equal and greater by their word at
one depth; what is equal goes on at the next. The size of an equal part is the count of its words. Parts that are smaller
than the least count are abandoned, with everything below them.

Defined results: null texts have no words, a null language is ``und``, repeated rows count again, an empty table gives no
rows. Words are exact byte strings whatever their length; columns besides ``lang`` and ``text`` aren't read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Bytes that end a piece, bytes that end a word.
PIECE_END, WORD_END = b".,;:!?\n\x0b\x0c\r", b" \t"
CLASS = np.zeros(256, np.uint8)
CLASS[list(PIECE_END)] = 2
CLASS[list(WORD_END)] = 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

SCHEMA_ROUTED = "lang string, depth int, bucket long, phrases binary, sizes binary"
SCHEMA_COUNTED = "lang string, phrase string, words int, f long"


def words_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of the texts, the number of the text of each, and the number of its piece."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = CLASS[data]
    inside = kind == 0
    start = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    end = np.flatnonzero(~inside & np.concatenate(([False], inside[:-1])))
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    held = LOWER[data[inside]].tobytes()
    words = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(held)])
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    text = np.searchsorted(np.cumsum(lengths), start, "right")
    return words, text, np.cumsum(kind == 2)[start]


def merged(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of the key columns (numbers >= -1), and how often each occurs."""
    bits = [int(k.max() + 2).bit_length() if len(k) else 1 for k in keys]
    if sum(bits) <= 63:
        packed = np.zeros(len(keys[0]), np.int64)
        for k, b in zip(keys, bits, strict=True):
            packed = (packed << b) | (k + 1)
        packed, n = np.unique(packed, return_counts=True)
        out = []
        for b in reversed(bits):
            out.append((packed & ((1 << b) - 1)) - 1)
            packed = packed >> b
        return out[::-1], n
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    return [k[order][at] for k in keys], np.diff(np.append(at, len(order)))


def suffixes(codes: np.ndarray, group: np.ndarray, depth: int) -> list[np.ndarray]:
    """The next ``depth`` words from each word on, -1 behind the end of its piece. ``group`` differs between pieces."""
    out = [codes]
    for d in range(1, depth):
        k = np.full(len(codes), -1, np.int64)
        if len(codes) > d:
            k[:-d] = np.where(group[d:] == group[:-d], codes[d:], -1)
        out.append(k)
    return out


def routed(names: list[str | None], texts: list[bytes], most: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """What has been read as merged pointers, one row for each language, depth and bucket."""
    words, text, piece = words_of(texts)
    if not len(words):
        return
    coded = words.dictionary_encode()
    codes, known = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    sure = np.fromiter((zlib.crc32(w) for w in known.to_pylist()), np.uint64, len(known))
    langs = sorted({"und" if n is None else n for n in names})
    where = {n: i for i, n in enumerate(langs)}
    lang = np.array([where["und" if n is None else n] for n in names], np.int64)[text]
    keys = suffixes(codes, piece, most)
    for depth, given in ((1, keys[:1]), (most, keys)):
        if depth > 1:  # what ends after its first word has been counted by it
            given = [k[keys[1] >= 0] for k in given]
        (of, *parts), n = merged([lang if depth == 1 else lang[keys[1] >= 0], *given])
        if not len(n):
            continue
        mix = sure[parts[0]] * np.uint64(0x9E3779B97F4A7C15)
        if depth > 1:
            mix = (mix ^ sure[parts[1]]) * np.uint64(0xC2B2AE3D27D4EB4F)
        bucket = ((mix >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((bucket, of))
        edges = np.flatnonzero(np.concatenate(([True], (np.diff(bucket[order]) != 0) | (np.diff(of[order]) != 0))))
        bounds = np.append(edges, len(order))
        columns = [known.take(pa.array(p[order], mask=p[order] < 0)) for p in parts]
        phrases = columns[0] if depth == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.large_binary()), null_handling="skip")
        phrases = pc.binary_join_element_wise(phrases, *(pa.scalar(x, pa.large_binary()) for x in (b"", b"\n")))
        held, at = phrases.buffers()[2].to_pybytes(), np.frombuffer(phrases.buffers()[1], np.int64)[: len(order) + 1]
        sizes = n[order].astype("<u4")
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([langs[of[order[i]]] for i in edges], pa.string()),
                pa.array(np.full(len(edges), depth), pa.int32()),
                pa.array(bucket[order][edges], pa.int64()),
                pa.array([held[at[a] : at[b] - 1] for a, b in itertools.pairwise(bounds)], pa.binary()),
                pa.array([sizes[a:b].tobytes() for a, b in itertools.pairwise(bounds)], pa.binary()),
            ],
            names=["lang", "depth", "bucket", "phrases", "sizes"],
        )


def multikey_quicksort(keys: list[np.ndarray], sizes: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of equal beginnings: for each depth, a pointer of every equal part and the part's size, parts below ``least`` left out.

    All open parts are divided at once by three-way partition, each around the word of its middle pointer. Keys below
    0 stand behind a suffix' end: such parts are done.
    """
    pointer = np.arange(len(sizes))
    part = np.zeros(len(sizes), np.int64)  # of each pointer, ascending
    depth = np.zeros(min(1, len(sizes)), np.int64)  # of each part
    found: list[list] = [[] for _ in keys]
    while len(pointer):
        first = np.flatnonzero(np.concatenate(([True], np.diff(part) != 0)))
        width = np.diff(np.append(first, len(part)))
        now = depth[part]
        key = np.empty(len(pointer), np.int64)
        for d, k in enumerate(keys):
            at = now == d
            key[at] = k[pointer[at]]
        side = np.sign(key - np.repeat(key[first + width // 2], width)) + 1
        # stable three-way partition of every part by counting
        place = np.empty(len(pointer), np.int64)
        base = first.copy()
        begins = np.repeat(first, width)
        weights = []
        for s in range(3):
            here = side == s
            before = np.cumsum(here) - here
            place[here] = (np.repeat(base, width) + before - before[begins])[here]
            base = base + np.add.reduceat(here.astype(np.int64), first)
            weights.append(np.add.reduceat(np.where(here, sizes[pointer], 0), first))
        moved, sides, parts = np.empty_like(pointer), np.empty_like(side), np.repeat(np.arange(len(first)), width)
        moved[place], sides[place] = pointer, side
        weight, deep = np.stack(weights, 1).ravel(), np.repeat(depth[part[first]], 3)
        equal = np.tile([False, True, False], len(first))
        held = weight >= least
        new = parts * 3 + sides  # ascending
        heads = np.full(len(weight), -1)
        heads[new[::-1]] = moved[::-1]
        for d, k in enumerate(keys):
            done = np.flatnonzero(equal & held & (deep == d))
            done = done[k[heads[done]] >= 0]
            found[d].append((heads[done], weight[done]))
        ended = equal & (heads >= 0)
        for d, k in enumerate(keys):
            at = np.flatnonzero(ended & (deep == d))
            held[at[k[heads[at]] < 0]] = False
        deep = deep + equal
        held &= deep < len(keys)
        stay = held[new]
        pointer, part = moved[stay], new[stay]
        names, part = np.unique(part, return_inverse=True)
        depth = deep[names]
    return [tuple(np.concatenate([f[i] for f in each]) if each else np.zeros(0, np.int64) for i in range(2)) for each in found]


def counted(lang: str, depth: int, rows: list[tuple[bytes, bytes]], least: int) -> Iterator[pa.RecordBatch]:
    """Phrases of one routed bucket that occur ``least`` times or more; of buckets of single words also the sum, as a phrase of 0 words."""
    phrases = pc.list_flatten(pc.split_pattern(pa.array([p for p, _ in rows], pa.large_binary()).cast(pa.large_string()), "\n"))
    sizes = np.concatenate([np.frombuffer(s, "<u4") for _, s in rows]).astype(np.int64)
    lists = pc.split_pattern(phrases, " ")
    flat = lists.flatten().dictionary_encode()
    at, codes = lists.offsets.to_numpy(), flat.indices.to_numpy().astype(np.int64)
    keys = []
    for d in range(depth):
        there = at[:-1] + d < at[1:]
        k = np.full(len(there), -1, np.int64)
        k[there] = codes[at[:-1][there] + d]
        keys.append(k)
    out = [([None], [0], [int(sizes.sum())])] if depth == 1 else []
    for d, (heads, weight) in enumerate(multikey_quicksort(keys, sizes, least)):
        if depth == 1 or d > 0:
            columns = [flat.dictionary.take(pa.array(k[heads])) for k in keys[: d + 1]]
            out.append((pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if d else columns[0], np.full(len(heads), d + 1), weight))
    for phrase, words, f in out:
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(f), pa.string()), pa.array(phrase, pa.string()) if isinstance(phrase, list) else phrase.cast(pa.string()), pa.array(words, pa.int32()), pa.array(f, pa.int64())], names=["lang", "phrase", "words", "f"])


def phrase_counts(docs: DataFrame, least: int = 10, most: int = 3, text_col: str = "text", lang_col: str = "lang", flush: int = 5_000_000, bucket_bytes: int = 4_000_000) -> DataFrame:
    """lang, phrase, words, f: phrases of 1 to ``most`` (2 or more) words that occur ``least`` times; ``words`` 0 has the number of all words in parts.

    Tasks merge pointers over ``flush`` bytes of text at a time. A bucket stands for about ``bucket_bytes`` of text, so that its
    memory doesn't grow with the table; equal pointers of it come at most once from each flush.
    """
    spark = docs.sparkSession
    read = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    held = read.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = 1 + held // bucket_bytes

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, size = [], [], 0
        for batch in batches:
            for name, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                names.append(name)
                texts.append(text)
                size += len(text) + 1
                if size >= flush:
                    yield from routed(names, texts, most, buckets)
                    names, texts, size = [], [], 0
                    pa.default_memory_pool().release_unused()
        if texts:
            yield from routed(names, texts, most, buckets)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("lang", "depth", "bucket", "phrases", "sizes")), strict=True):
                if row[:3] != key:
                    if rows:
                        yield from counted(*key[:2], rows, least)
                        pa.default_memory_pool().release_unused()
                    key, rows = row[:3], []
                rows.append(row[3:])
        if rows:
            yield from counted(*key[:2], rows, least)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(buckets, 20_000))
    routes = common.map_arrow(read, local, SCHEMA_ROUTED).repartition(parts, "lang", "depth", "bucket")
    return common.map_arrow(routes.sortWithinPartitions("depth", "lang", "bucket"), sort, SCHEMA_COUNTED)


def collocations(docs: DataFrame, least: int = 10, most: int = 3, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of a occurrences, cut into parts of l and r, scores floor(1000000 a a / (l r)); its lowest cut counts, of equals the
    first. Phrases inside a longer one with ``share`` percent of their occurrences or more are left out. Counts below 10^15 are exact.
    """
    counts = common.written(phrase_counts(docs, least, most, text_col, lang_col), "phrases")
    known = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("n_part"))
    candidates = counts.where("words > 1").select("lang", "phrase", F.split("phrase", " ").alias("w"), F.col("f").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    part = lambda at, n: F.concat_ws(" ", F.slice("w", at, n))
    sides = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.size("w") - F.col("k")).alias("right"))
    of = lambda df, side, name: df.join(known.withColumnsRenamed({"part": side, "n_part": name}), ["lang", side])
    scored = of(of(sides, "left", "l"), "right", "r")
    scored = scored.withColumn("score", F.expr("CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))").cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b")).select("lang", "phrase", "b.*")
    w = F.col("w")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.concat_ws(" ", F.slice(w, i, n)))))
    around = candidates.where(F.size("w") > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(16))
    few = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = counts.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle_sql(least: int = 10, share: int = 50, top: int = 2000) -> str:
    """DuckDB SQL for phrases of two and three words."""
    return rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS t, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, t, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
q AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS MATERIALIZED (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM q WHERE len(w) > 0),
g AS (SELECT lang, w[i] AS phrase, 1 AS words FROM s UNION ALL SELECT lang, w[i] || ' ' || w[i + 1], 2 FROM s WHERE i < len(w)
 UNION ALL SELECT lang, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2], 3 FROM s WHERE i + 1 < len(w)),
f AS MATERIALIZED (SELECT lang, phrase, words, count(*) AS f FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT lang, phrase, words, f AS a, string_split(phrase, ' ') AS w FROM f WHERE words > 1 AND f >= {least}),
e AS (SELECT lang, phrase, a, unnest(range(1, words)) AS k, w FROM c),
k AS MATERIALIZED (SELECT lang, phrase, a, k, lang || ' ' || array_to_string(w[1:k], ' ') AS u, lang || ' ' || array_to_string(w[k + 1:], ' ') AS v FROM e),
x AS MATERIALIZED (SELECT lang || ' ' || phrase AS u, f FROM f WHERE f >= {least}),
h AS (SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, CAST(1000000::HUGEINT * k.a * k.a // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM k JOIN x ON x.u = k.u JOIN x y ON y.u = k.v),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM c WHERE words = 3 UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM c WHERE words = 3) GROUP BY ALL),
t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE words = 1 GROUP BY lang)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase JOIN t ON t.lang = b.lang
WHERE longer IS NULL OR 100 * longer < {share} * a QUALIFY rank <= {top}
"""
