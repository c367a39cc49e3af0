"""DataFrame operators of the query and digest paths."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text
from .folds import ordered_fold


def acquisition_filter(df: DataFrame, platforms: Sequence[str] = (), block: Sequence[str] = (), allow: Sequence[str] = (), least_engagement: int = 0, least_length: int = 20, trending_only: bool = False, window_hours: float = 24.0, ties: Sequence[str] = (), keep: Sequence[str] | None = None) -> DataFrame:
    """Adds drop_stage: the first of eight stages that drops a post, null if it is taken.

    Columns: user_id, platform, author, url, title, raw_text, engagement, is_trending, seen_at. A post is a duplicate if
    its fingerprint came up for the same user since the last ``window_hours`` began counting; dropping one doesn't start the time anew.
    Posts that an earlier stage drops aren't remembered, later stages don't matter. Of posts seen at one time the first by ``ties`` counts; without that any.
    With ``keep`` only these columns come back, so that texts aren't moved.
    """
    body = text.filled(F.col("raw_text"), F.col("title"))
    low = F.lower(body)
    has = lambda ws: F.exists(F.array(*(F.lit(w.lower()) for w in ws)), lambda w: F.contains(low, w))
    early = F.when(F.lit(bool(platforms)) & ~F.col("platform").isin(*platforms), "platform_gate")
    early = early.when(has(block) if block else F.lit(False), "keyword_blocklist").when(~has(allow) if allow else F.lit(False), "keyword_allowlist")
    early = early.when(F.lit(least_engagement > 0) & (F.coalesce("engagement", F.lit(0)) < least_engagement), "engagement_threshold")
    late = F.coalesce(F.when(text.likely_bot(F.coalesce("raw_text", F.lit(""))), "bot_detection"), F.when(F.length(body) < least_length, "min_text_length"), F.when(F.lit(trending_only) & ~F.coalesce("is_trending", F.lit(False)), "trending_gate"))
    marked = df.withColumns({"_early": early, "_fp": text.fingerprint(F.col("url"), F.col("platform"), F.col("author"), body), "_at": F.unix_micros("seen_at"), "_late": late})
    if keep is not None:
        marked = marked.select(*dict.fromkeys([*keep, *ties, "user_id"]), "_early", "_fp", "_at", "_late")

    def step(kept, row: dict):
        if row["_early"] is not None:
            return kept, {"_again": False}
        again = kept is not None and row["_at"] - kept < window_hours * 3.6e9
        return (kept if again else row["_at"]), {"_again": again}

    marked = ordered_fold(marked, ["user_id", "_fp"], ["_at", *ties], lambda: None, step, "_again boolean")
    stage = F.coalesce("_early", F.when(F.col("_again"), "deduplication"), "_late")
    out = marked.withColumn("drop_stage", stage).drop("_early", "_fp", "_at", "_again", "_late")
    return out if keep is None else out.select(*keep, "drop_stage")


def char_budget(df: DataFrame, keys: Sequence[str], order: Sequence[str], chars: str, most: int) -> DataFrame:
    """Adds taken: whether a row still fits its key's budget. Rows are tried in order; one that doesn't fit is skipped and uses nothing up."""

    def step(used: int, row: dict):
        size = row[chars] or 0
        fits = used + size <= most
        return used + (size if fits else 0), {"taken": fits}

    return ordered_fold(df, keys, order, lambda: 0, step, "taken boolean")


def connector_filter(df: DataFrame, order: Sequence[str], most_chars: int, keep: Sequence[str] | None = None, **stages) -> DataFrame:
    """Adds drop_stage as ``acquisition_filter`` does for what a connector fetched, then ``char_budget`` for posts that their user's budget has no room for.

    ``engagement`` and ``is_trending`` are taken as 0 and false where they are missing; image and video captions
    (``visual_text``, where there is such a column) are read behind a post's own text. With ``keep`` only these columns come back: a user's
    posts are tried in one task, which then reads no texts.
    """
    made = df
    for name, default in (("engagement", F.lit(0)), ("is_trending", F.lit(False))):
        made = made.withColumn(name, F.coalesce(name, default) if name in df.columns else default)
    if "visual_text" in df.columns:
        made = made.withColumn("raw_text", F.nullif(F.concat_ws("\n", "raw_text", "visual_text"), F.lit("")))
    made = made.withColumn("_chars", F.length(text.filled(F.col("raw_text"), F.col("title"))))
    marked = acquisition_filter(made, keep=keep if keep is None else [*dict.fromkeys([*keep, *order, "user_id"]), "_chars"], **stages)
    marked = marked.withColumn("_chars", F.when(F.col("drop_stage").isNull(), F.col("_chars")).otherwise(0))
    tried = char_budget(marked, ["user_id"], order, "_chars", most_chars)
    out = tried.withColumn("drop_stage", F.coalesce("drop_stage", F.when(~F.col("taken"), "char_budget"))).drop("_chars", "taken")
    return out if keep is None else out.select(*keep, "drop_stage")


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows of each group, with their rank. Spark limits each partition before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def page(df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(limit)


def anti_new(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key isn't there yet, once per key."""
    return df.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")


def trending_topics(df: DataFrame, topics: str, platform: str, at: str, n: int | None = None) -> DataFrame:
    """Explode topics: mentions, distinct platforms and last time, most mentioned first."""
    out = df.select(F.explode(topics).alias("topic"), platform, at).groupBy("topic").agg(F.count("*").alias("mentions"), F.countDistinct(platform).alias("platforms"), F.max(at).alias("latest"))
    out = out.orderBy(F.desc("mentions"), F.desc("latest"), "topic")
    return out.limit(n) if n else out


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float], parts: int = 16) -> DataFrame:
    """Nearest-rank percentiles of each group: the value at place ceil(p / 100 * n); nulls don't count.

    Values are counted first, and the counts cut into ``parts`` squared ranges, so that a large group isn't one task's. The cuts come from
    a sketch and only decide where values are ranked; the ranges' exact sizes tell which of them holds a place, and only those are ranked.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    every = parts * parts
    cuts = counts.agg(F.percentile_approx("_v", [i / every for i in range(1, every)], 100 * every).alias("_cuts"))
    below = lambda xs: F.size(F.filter(xs, lambda x: x < F.col("_v")))
    coarse = counts.join(F.broadcast(cuts)).withColumn("_at", below(F.array(*(F.col("_cuts")[i * parts - 1] for i in range(1, parts)))))  # one row of cuts
    dealt = coarse.withColumn("_part", F.col("_at") * parts + below(F.slice("_cuts", F.col("_at") * parts + 1, parts - 1))).drop("_at", "_cuts")
    group = Window.partitionBy(*keys)
    sizes = dealt.groupBy(*keys, "_part").agg(F.sum("_n").alias("_size")).withColumns({"_to": F.sum("_size").over(group.orderBy("_part")), "_all": F.sum("_size").over(group)})
    places = F.array(*(F.struct(F.lit(i).alias("_i"), F.greatest(F.ceil(F.col("_all") * (x / 100)), F.lit(1)).alias("_place")) for i, x in enumerate(percents)))
    asked = sizes.select("*", F.explode(places).alias("_p")).where("_p._place <= _to AND _p._place > _to - _size").groupBy(*keys, "_part").agg(F.first(F.col("_to") - F.col("_size")).alias("_before"), F.collect_list("_p").alias("_ps"))
    asked = asked.toDF(*(f"_key{i}" for i in range(len(keys))), "_of", "_before", "_ps")
    held = dealt.join(asked, [F.col("_part") == F.col("_of"), *(F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys))])
    ranked = held.withColumn("_to", F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy("_v")))
    hit = ranked.select(*keys, "_v", "_n", "_to", F.explode("_ps").alias("_p")).where("_p._place <= _to AND _p._place > _to - _n").select(*keys, "_v", "_p._i")
    groups = df.select(*keys).distinct().select(*keys, F.lit(None).cast(counts.schema["_v"].dataType).alias("_v"), F.lit(-1).alias("_i"))
    return hit.unionByName(groups).groupBy(*keys).agg(*(F.max(F.when(F.col("_i") == i, F.col("_v"))).alias(f"p{x:g}") for i, x in enumerate(percents)))


def runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """Adds run: the number of rows in a row, up to this one, for which the flag holds (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    island = F.sum(F.when(flag, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = df.withColumns({"_flag": flag, "_island": island})
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("run", F.sum(F.when(F.col("_flag"), 1).otherwise(0)).over(inside)).drop("_flag", "_island")


def trailing_counts(df: DataFrame, keys: Sequence[str], at: str, spans: dict[str, int], width: int) -> DataFrame:
    """Adds for each name in ``spans`` the number of the key's rows from ``span`` before a row up to it, equal times included.

    ``at`` is a whole number such as microseconds; a row without one counts 0. A key's rows are cut into slices of ``width``, so that a
    hot key isn't one task's: a row enters at its time and leaves a span later, running sums of both run within a slice,
    and what came before a slice is a running sum over one row a slice. Ties go to one task.
    """
    names = list(spans)
    leaves = [F.struct((F.col(at) + s + 1).alias("_at"), F.lit(False).alias("_own"), *(F.lit(-1 if m == n else 0).alias(f"_{m}") for m in names)) for n, s in spans.items()]
    enters = F.struct(F.col(at).alias("_at"), F.lit(True).alias("_own"), *(F.lit(1).alias(f"_{n}") for n in names))
    marks = df.select("*", enters.alias("_m")).unionByName(df.select(*keys, F.explode(F.array(*leaves)).alias("_m")), allowMissingColumns=True)
    marks = marks.select(*df.columns, "_m.*").withColumn("_slice", F.expr(f"(_at - pmod(_at, {width}L)) div {width}L"))
    inside = Window.partitionBy(*keys, "_slice").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    running = marks.withColumns({f"_{n}": F.sum(f"_{n}").over(inside) for n in names}).where("_own")
    per = marks.groupBy(*keys, "_slice").agg(*(F.sum(f"_{n}").alias(f"_{n}") for n in names))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_slice").alias("_of"), *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_base_{n}") for n in names))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    out = running.join(base, [F.col("_slice").eqNullSafe(F.col("_of")), *same])
    return out.select(*df.columns, *((F.col(f"_{n}") + F.col(f"_base_{n}")).alias(n) for n in names))


def frequent_words(df: DataFrame, lowered: str, added: str, most: int, least_length: int, stop: Sequence[str]) -> DataFrame:
    """Adds the ``most`` frequent words ``[a-z0-9]+`` of a text, of equals the first ones, sorted and joined by commas; null for null. A text is counted in its row."""
    schema, left_out = StructType([*df.schema.fields, StructField(added, StringType())]), frozenset(stop)

    def found(text: str | None) -> str | None:
        if text is None:
            return None
        # of equal counts most_common gives the word that came first
        counts = Counter(w for w in re.findall("[a-z0-9]+", text) if len(w) >= least_length and w not in left_out)
        return ",".join(sorted(w for w, _ in counts.most_common(most)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = pa.array((found(x.as_py()) for x in b[lowered]), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, words], names=schema.names)

    return df.mapInArrow(run, schema)
