"""Mixing sources to target weights by hash-random keys and distributed prefix sums.

Each document gets a random key from its id and text. Within its source, keys are cut into
ranges of equal width (about ``ROWS_PER_RANGE`` documents each, so a hot source is
many ranges and no task holds more), sorted inside each range, and a document's
prefix sum is the total of the earlier ranges plus the running sum in its own. A
source takes whole epochs while its budget lasts and then the documents, in key
order, up to the exact word at which the budget ends.

Sources are ranked, and their targets found, in one small window of one row per source (a few million sources at
most; a column of urls is no source).

Edge cases: a null text has size 0, one of any length is counted whole; null is a source of its own, ordered last; an
empty source or corpus takes nothing; any number of documents may have a null or the same id, as their texts
part their keys; rows equal in id and text, of which there may be any number, share the budget in either order. Extra
columns are not read, or carried, but for those named size, source_size, target or taken, which the
mix's own replace. Reruns agree because nothing depends on partition numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, rekeyed, table, word_count

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2
ROWS_PER_RANGE = 4096
#: Source statistics are broadcast up to this many rows (about 100 bytes each), and joined by a shuffle beyond.
BROADCAST_SOURCES = 50_000


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """One row per source: sid (its rank by code point, null last), total, target, ranges.

    Water filling: targets are ``level * weight`` except where that exceeds
    ``epochs`` times the source; with sources ordered by cap over weight, the level
    is that of the first source which stays under its cap.
    """
    w = F.lit(None).cast("double")
    for i, x in enumerate(weights):
        w = F.when((F.col("sid") - 1) % len(weights) == i, F.lit(float(x))).otherwise(w)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    stats = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
        .withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
        .withColumn("w", w)
        .withColumn("cap", (F.col("source_size") * epochs).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("w"))
    )
    levels = (
        stats.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(every) * F.lit(share) - F.col("cap_before")) / (F.sum("w").over(every) - F.col("w_before")))
        .withColumn("level", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "sid", "level"))).over(every)["level"])
    )
    return levels.select(
        "source", "sid", "source_size",
        F.when(F.col("ratio") > F.col("level"), F.col("level") * F.col("w")).otherwise(F.col("cap")).alias("target"),
        F.ceil(F.col("docs") / rows_per_range).cast("long").alias("ranges"),
    )


def taken_words(size: Column, prefix: Column, budget: Column, source_size: Column) -> Column:
    """Whole epochs, then what the rest of the budget reaches of this document."""
    turns = F.when(source_size > 0, F.floor(budget / F.greatest(source_size, F.lit(1)))).otherwise(F.lit(0))
    return (turns * size + F.greatest(F.lit(0), F.least(size, budget - turns * source_size - prefix))).cast("long")


def random_key(seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def mix(docs: DataFrame, seed: str = "mix-1", weights=WEIGHTS, share: float = SHARE, epochs: int = MAX_EPOCHS, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document, and the source and random key."""
    sizes = checkpointed(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(seed).alias("key")))
    stats = checkpointed(source_targets(sizes, weights, share, epochs, rows_per_range))
    small = stats.count() <= BROADCAST_SOURCES
    s = (F.broadcast if small else lambda x: x)(stats.withColumnRenamed("source", "__s"))
    unit = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    keyed = (
        sizes.join(s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
        .withColumn("rng", F.floor(unit * F.col("ranges") / F.lit(1 << 32)).cast("long"))
    )
    totals = keyed.groupBy("sid", "rng").agg(F.sum("size").alias("t"))
    earlier = totals.select("sid", "rng", (F.sum("t").over(Window.partitionBy("sid").orderBy("rng")) - F.col("t")).alias("earlier"))
    inside = Window.partitionBy("sid", "rng").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.withColumn("run", F.sum("size").over(inside) - F.col("size"))
        .join(earlier, ["sid", "rng"])
        .select(
            "doc_id", "source", "key", "size", "source_size", "target",
            taken_words(F.col("size"), F.col("earlier") + F.col("run"), F.floor("target"), F.col("source_size")).alias("taken"),
        )
    )


def in_the_mix(docs: DataFrame, seed: str = "mix-1", **options) -> DataFrame:
    """The rows of ``docs`` of which the mix takes something, with size, source_size, target and taken."""
    own = ["size", "source_size", "target", "taken"]
    carried = [c for c in docs.columns if c not in own]
    # rows that are equal in id, text and source stand together in the order, so few different numbers of words are taken of them:
    # those of whole epochs, one more at most, and what the budget's last document gives. Each is one element here, with the rows that it holds for.
    counts = mix(docs, seed, **options).groupBy("key", "source", "taken").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in own[:3]])
    takes = (
        counts.groupBy("key", "source").agg(F.sort_array(F.collect_list(F.struct("taken", "n")), asc=False).alias("takes"), *[F.first(c).alias(c) for c in own[:3]])
        .filter(F.col("takes")[0]["taken"] > 0).select("key", F.col("source").alias("s"), "takes", *own[:3])
    )
    # the row travels as one column, so its columns may have any name
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), random_key(seed).alias("k"), F.col("source").alias("o"))
    joined = rows.join(rekeyed(takes, "key"), (F.col("k") == F.col("key")) & F.col("o").eqNullSafe(F.col("s")))
    alone = joined.filter(F.size("takes") == 1).withColumn("taken", F.col("takes")[0]["taken"])
    # only where a source's budget ends inside a run of equal rows, so for one key of a source, are these numbered
    nth = F.row_number().over(Window.partitionBy("k", "s").orderBy(F.col("size")))
    place = lambda a, x: F.struct((a["left"] - x["n"]).alias("left"), F.when((a["left"] > 0) & (a["left"] <= x["n"]), x["taken"]).otherwise(a["taken"]).alias("taken"))
    start = F.struct(F.col("nth").cast("long").alias("left"), F.lit(0).cast("long").alias("taken"))
    several = joined.filter(F.size("takes") > 1).withColumn("nth", nth).withColumn("taken", F.reduce("takes", start, place)["taken"]).drop("nth").filter("taken > 0")
    return alone.unionByName(several).select(*[F.col("row")[c].alias(c) for c in carried], *own)


def op7_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
stats AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM sizes GROUP BY source),
weighed AS (
  SELECT *, CASE (sid - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM stats),
ranked AS (
  SELECT *, cap / w AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
         coalesce(sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before,
         sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS wanted, sum(w) OVER () AS all_w FROM weighed),
filled AS (
  SELECT *, (wanted - cap_before) / (all_w - w_before) AS own FROM ranked),
leveled AS (
  SELECT *, (SELECT own FROM filled WHERE ratio > own ORDER BY ratio, sid LIMIT 1) AS level FROM filled),
targets AS (
  SELECT source, source_size, CASE WHEN ratio > level THEN level * w ELSE cap END AS target FROM leveled),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         (sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) - s.size)::BIGINT AS prefix
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
turned AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS turns FROM placed)
SELECT doc_id, size, source_size, target,
       (turns * size + greatest(0, least(size, budget - turns * source_size - prefix)))::BIGINT AS taken
FROM turned
"""
