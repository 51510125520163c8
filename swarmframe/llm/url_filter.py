"""URL filtering by Bloom filter cascades.

A rule is ``host/path``; it fits the host and its subdomains where the url's
path starts with the rule's. Every url has a handful of candidate keys (a host
suffix of as many labels as some rule has, a path prefix as long as some rule's),
so the keys of a corpus are a known universe and list membership can be stored
exactly in alternating Bloom filters: level 1 holds the listed keys, level 2
those unlisted keys of the corpus that level 1 lets through, level 3 the listed
keys that level 2 lets through, until a level lets nothing through. Looking a key
up touches only literals inside a projection: no join, no shuffle. A list whose cascades would be
larger than ``MAX_FILTER_BYTES`` is cut into parts by a hash of its rules, and the rows are judged by one part after another.

The urls are read twice: once for the distinct candidate keys, which are kept, and once to be judged.

Edge cases: a null url, or one without ``://``, has an empty host and path and
fits no rule; it gets the default verdict ``allow`` of a key that no list holds.
Urls of any length are taken whole. Repeated rows, and rows whose id is null, each get their row. An empty table gives an
empty result. Columns other than the id and the url are not read.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: action, rule
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: What a plan carries of cascades, about; a longer list is judged in parts.
MAX_FILTER_BYTES = 32 << 20
LN2 = math.log(2)


def url_host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def shapes(rules: list[str]) -> list[tuple[int, int]]:
    """Distinct (host labels, path characters) of the rules: at most as many as rules, and as labels times characters of the longest ones."""
    return sorted({(r.partition("/")[0].count(".") + 1, len(r) - len(r.partition("/")[0])) for r in rules})


def candidate_keys(host: Column, path: Column, rules: list[str]) -> Column:
    """Keys of a url that a rule of the list's shapes could equal: one expression over the shapes, however many there are."""
    known = F.split(F.lit(",".join(f"{k} {m}" for k, m in shapes(rules))), ",") if rules else F.array().cast("array<string>")
    labels, length = F.size(F.split(host, r"\.")), F.char_length(path)
    part = lambda s, i: F.split(s, " ")[i].cast("int")
    listed = F.transform(known, lambda s: F.struct(part(s, 0).alias("k"), part(s, 1).alias("m")))
    fits = F.filter(listed, lambda s: (s["k"] <= labels) & (s["m"] <= length))
    return F.transform(fits, lambda s: F.concat(F.call_function("substring_index", host, F.lit("."), -s["k"]), F.substring(path, F.lit(1), s["m"])))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``words`` of 64 bits, ``bits`` of them in use, ``hashes`` positions a key."""

    number: int
    words: tuple[int, ...]
    bits: int
    hashes: int

    def positions(self, key: Column) -> Column:
        h1 = F.xxhash64(F.lit(2 * self.number), key).bitwiseAND(F.lit(0x7FFFFFFF))
        h2 = F.xxhash64(F.lit(2 * self.number + 1), key).bitwiseAND(F.lit(0x7FFFFFFF))
        return F.array(*[(h1 + F.lit(i) * h2) % F.lit(self.bits) for i in range(self.hashes)])

    def lets_through(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        return F.forall(self.positions(key), lambda p: F.getbit(F.get(words, (p / 64).cast("int")), (p % 64).cast("int")) == 1)


def filter_bits(n: int, rate: float) -> int:
    return max(64, -(-math.ceil(n * -math.log(rate) / LN2**2) // 64) * 64)


def build_level(keys: DataFrame, n: int, rate: float, number: int) -> Level:
    """Set bits by an aggregate; what comes to the driver is the filter, of checked size."""
    bits = filter_bits(n, rate)
    shell = Level(number, (), bits, max(1, round(-math.log2(rate))))
    rows = (
        keys.select(F.explode(shell.positions(F.col("key"))).alias("p"))
        .groupBy((F.col("p") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("b"))
        .collect()
    )
    words = [0] * (bits // 64)
    for w, b in rows:
        words[w] = b
    return Level(number, tuple(words), bits, shell.hashes)


def first_rate(n: int, total: int) -> float:
    """False positives of the first level such that about as many unlisted keys pass as there are listed ones."""
    return min(0.5, n / (math.sqrt(2) * max(total, n)))


def build_cascade(listed: DataFrame, universe: DataFrame) -> list[Level]:
    """Levels that answer exactly for every key of ``universe`` (distinct keys).

    Level 1 lets about as many unlisted keys through as there are listed ones, so
    the whole cascade is a few bits times the list's length, whatever the corpus.
    """
    n = listed.count()
    if not n:
        return []
    levels = [build_level(listed, n, first_rate(n, universe.count()), 1)]
    inside, outside = stored(universe.filter(levels[0].lets_through(F.col("key"))).join(listed, "key", "left_anti")), listed
    while n := inside.count():
        levels.append(build_level(inside, n, 0.5, len(levels) + 1))
        inside, outside = stored(outside.filter(levels[-1].lets_through(F.col("key")))), inside
    return levels


def parts_of(rules: list[tuple[str, str]], total: int, max_bytes: int) -> int:
    """Parts of a list such that each one's cascades are about ``max_bytes`` at most; all levels are less than twice the first and some bits a rule."""
    n = len(rules)
    return max(1, -(-2 * (filter_bits(n, first_rate(n, total)) + 2 * n) // 8 // max_bytes)) if n else 1


def member(key: Column, levels: list[Level]) -> Column:
    found = F.lit(True)
    for level in reversed(levels):
        found = level.lets_through(key) & (found if level is levels[-1] else ~found)
    return found if levels else F.lit(False)


def in_part(key: Column, part: int, parts: int) -> Column:
    return F.crc32(key) % parts == part if parts > 1 else F.lit(True)


def longest_member(levels: list[Level], part: int, parts: int) -> Column:
    """Struct (n, k) of the longest of a row's keys that a part of a list holds."""
    found = F.filter("keys", lambda k: in_part(k, part, parts) & member(k, levels))
    return F.array_max(F.transform(found, lambda k: F.struct(F.char_length(k).alias("n"), k.alias("k"))))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """id, host, path, rule, verdict of each row: the longest listed candidate key decides, else ``default``."""
    spark = pages.sparkSession
    texts = [r for _, r in rules]
    if any("/" not in r for r in texts) or len(set(texts)) < len(texts):
        raise ValueError("a rule is host/path, and is listed once")
    url = F.col(f"`{url_col}`")
    out = pages.select(F.col(f"`{id_col}`").alias(id_col), url_host(url).alias("host"), url_path(url).alias("path"))
    hit = out.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), texts))
    universe = stored(hit.select(F.explode("keys").alias("key")).distinct())
    parts = parts_of(rules, universe.count(), max_bytes)
    best = F.lit(None).cast("struct<n:int,k:string>")
    hit = hit.withColumn("a", best).withColumn("b", best)
    for i in range(parts):
        keys = universe.filter(in_part(F.col("key"), i, parts))
        for action, column in (("allow", "a"), ("block", "b")):
            listed = [(r,) for a, r in rules if a == action and zlib.crc32(r.encode()) % parts == i]
            if listed:
                levels = build_cascade(spark.createDataFrame(listed, "key string"), keys)
                hit = hit.withColumn(column, F.greatest(column, longest_member(levels, i, parts)))
        # a plan carries one part's cascades
        hit = stored(hit) if i + 1 < parts else hit
    blocks = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b.n") > F.col("a.n")))
    return hit.select(
        id_col, "host", "path",
        F.when(blocks, F.col("b.k")).otherwise(F.col("a.k")).alias("rule"),
        F.when(blocks, F.lit("block")).when(F.col("a").isNotNull(), F.lit("allow")).otherwise(F.lit(default)).alias("verdict"),
    )


def op5_url_filter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


OP5_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
