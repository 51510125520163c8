"""Near-duplicate classes by DartMinHash signatures, banding and an exact check.

A text is the multiset of its five-word shingles (the whole text if it has fewer
words). Every unit of weight of every shingle is a region into which darts are
thrown: a Poisson process whose arrivals are ranks, drawn by hashing the region, so
equal regions of different texts receive the same darts. A text keeps the darts
below a rank at which it expects k (ln k + 2) of them; each dart falls on one of k
coordinates, and the earliest per coordinate is the signature. Two signatures agree in a
coordinate with a probability equal to the texts' weighted Jaccard similarity.

1. Copies of a text are folded into one, by partial aggregates.
2. Texts that share a band of the signature meet the band's least text, and each pair is compared exactly
   before anything is joined up: that is linear in a bucket's size, a text with many partners is dealt to
   several tasks, and a task holds one text and streams its partners.
3. Buckets that true links (components of them) do not yet hold together are begun again from the least text that the
   first one left out. What is still apart after that is compared bucket by bucket, in pairs of
   blocks of bounded size: texts of a block meet where they share one of their rarest shingles, so many that
   no pair of similarity 0.8 can do without (exact for groups of any size), and pairs that are connected already are skipped.
4. Components of the verified links are the classes; a class is named by its least doc_id.

A pair of similarity 0.8 shares no band with probability 7e-6; nothing else is left to chance.

Edge cases: a text without words is a class of its own (with its exact copies);
rows that share a doc_id are one document with several texts, and fall in one
class; rows whose doc_id is null are documents of their own, named by the least doc_id among their near copies and
null where there is none; ties go to the least id; texts of any length are compared whole; an empty table gives an
empty result; doc_id is of an integer type, others are refused. Extra columns are not read, or carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_ids, rekeyed, stored, table
from .components import components
from .url_filter import build_level, filter_bits

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 5
COORDINATES = BANDS * ROWS
#: A bucket's text meets at most so many others in one task.
STAR = 128
#: A block of a bucket holds about this many texts and shingles; a task holds two blocks.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 22
#: Texts whose band keys a worker remembers, for their copies.
SIGNED = 4096
REMEMBERED = 100_000
#: Texts that are in no bucket are left out before their shuffle by a Bloom filter of at most so many bits (2 MB). It only saves work: where candidates are many more, the join alone decides.
FILTER_BITS, FILTER_RATE = 1 << 24, 0.01
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def regions(text: str | None) -> np.ndarray:
    """Sorted hashes of a text's weight units: one for each time that a shingle occurs."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, U)
    h = np.fromiter(map(_hashes.__getitem__, words), U, len(words))
    n = max(len(h) - WORDS + 1, 1)
    with np.errstate(over="ignore"):
        s = np.full(n, U(len(h) if len(h) < WORDS else WORDS))
        for i in range(min(WORDS, len(h))):
            s = mixed(s * U(0x9E3779B97F4A7C15) + h[i : i + n])
        s.sort()
        again = np.flatnonzero(s[1:] == s[:-1]) + 1
        if len(again):
            start = np.ones(n, bool)
            start[again] = False
            first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
            s = np.sort(np.where(start, s, mixed(s + (np.arange(n) - first).astype(U))))
    return s


def dart_signature(units: np.ndarray, k: int = COORDINATES) -> np.ndarray:
    """Earliest dart per coordinate, as 64-bit dart names."""
    reach = k * (np.log(k) + 2) / len(units)
    with np.errstate(over="ignore"):
        first = mixed(units + U(0xA0761D6478BD642F))
        arrival = -np.log(((first >> U(11)).astype(float) + 0.5) * 2.0**-53)
        while True:
            hit = np.flatnonzero(arrival < reach)
            if len(hit):
                throws = int(reach + 8 * np.sqrt(reach) + 16)
                seeds = units[hit, None] + np.arange(1, throws, dtype=U) * U(0xE7037ED1A0B428DB)
                gaps = -np.log(((mixed(seeds) >> U(11)).astype(float) + 0.5) * 2.0**-53)
                ranks = np.concatenate([arrival[hit, None], gaps], axis=1).cumsum(1)
                row, throw = np.nonzero(ranks < reach)
                names = mixed(units[hit[row]] ^ mixed(throw.astype(U) + U(0x8EBC6AF09C88C6E3)))
                order = np.argsort(ranks[row, throw])[::-1]
                names = names[order]
                at = ((names >> U(20)) % U(k)).astype(np.int64)
                signature, full = np.zeros(k, U), np.zeros(k, bool)
                signature[at] = names  # the last assignment stays: the earliest dart
                full[at] = True
                if full.all():
                    return signature
            reach *= 2


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS)
    with np.errstate(over="ignore"):
        key = np.arange(BANDS, dtype=U)
        for i in range(ROWS):
            key = mixed(key * U(0x9E3779B97F4A7C15) + rows[:, i])
    return key.view(np.int64)


class Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def similar(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether the weighted Jaccard similarity of two sorted unit arrays is ``similarity`` or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


def meeting(units: list[np.ndarray], similarity: float = SIMILARITY) -> list[np.ndarray]:
    """Groups of texts (positions) that share one of their rarest shingles, at least one for each pair of ``similarity`` or more.

    Such a pair shares so much that one of the first n - ceil(similarity n) + 1 shingles of each text, in one order for all, is common to both.
    """
    every, owner = np.concatenate(units), np.repeat(np.arange(len(units)), [len(u) for u in units])
    _, number, count = np.unique(every, return_inverse=True, return_counts=True)
    order = np.lexsort((number, count[number], owner))
    size = np.array([len(u) for u in units])
    first = np.cumsum(size) - size
    place = np.arange(len(every)) - np.repeat(first, size)
    prefix = np.repeat(size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, size)
    taken = order[place < prefix]
    taken = taken[count[number[taken]] > 1]
    taken = taken[np.lexsort((owner[taken], number[taken]))]
    n = number[taken]
    cuts = np.flatnonzero(n[1:] != n[:-1]) + 1
    return [g for g in np.split(owner[taken], cuts) if len(g) > 1]


def linked(ids: list[int], units: list[np.ndarray], side: list[int], labels: list[int]) -> list[tuple[int, int]]:
    """Spanning links among similar pairs of different labels; with two sides, of pairs from different sides only (each side alone is another task's work)."""
    sets, out, tried = Sets(len(ids)), [], set()
    two = len(set(side)) > 1
    first: dict[int, int] = {}
    for i, x in enumerate(labels):
        sets.join(first.setdefault(x, i), i)
    for group in meeting(units):
        group = group.tolist()
        roots = [sets.find(i) for i in group]
        if min(roots) == max(roots):
            continue
        for at, i in enumerate(group):
            for j in group[:at]:
                if (two and side[i] == side[j]) or (j, i) in tried or sets.find(i) == sets.find(j):
                    continue
                tried.add((j, i))
                if similar(units[i], units[j]):
                    sets.join(i, j)
                    out.append((ids[i], ids[j]))
    return out


def signed(docs: DataFrame) -> DataFrame:
    """id, digest, number of shingles and band keys of every row; no keys where a text has no words."""

    def run(batches):
        known: dict[str, tuple[int, list[int]]] = {}
        for b in batches:
            keys, sizes = [], []
            for d, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                found = known.get(d)
                if found is None:
                    u = regions(t)
                    if len(known) >= SIGNED:
                        known.clear()
                    found = known[d] = (len(u), band_keys(dart_signature(u)).tolist() if len(u) else [])
                sizes.append(found[0])
                keys.append(found[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "digest", "size", "bands"])

    return docs.mapInArrow(run, "id bigint, digest string, size bigint, bands array<bigint>")


def shingled(rows: DataFrame) -> DataFrame:
    """node and its sorted units as bytes. rows: node, text."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([regions(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["node", "units"])

    return rows.select("node", "text").mapInArrow(run, "node bigint, units binary")


def links_batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])


def verified(links: DataFrame, held: DataFrame) -> DataFrame:
    """The links a, b whose texts are similar. A ``b`` with many links is dealt to tasks of ``STAR`` at most; each holds it and streams the others."""

    def run(batches):
        key, one = None, None
        for b in batches:
            out = []
            for center, part, a, units in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
                u = np.frombuffer(units.as_buffer(), U)
                if (center, part) != key:
                    key, one = (center, part), u.copy()  # the center itself comes first
                elif similar(u, one):
                    out.append((a, center))
            yield links_batch(out)

    centers = links.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    around = links.join(rekeyed(centers, "b"), "b").select("b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a")
    around = around.join(held.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "units")
    middle = centers.join(held.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("a"), "units")
    return stored(around.unionByName(middle).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first()).mapInArrow(run, "a bigint, b bigint"))


def inside_buckets(members: DataFrame, held: DataFrame) -> DataFrame:
    """Verified links a, b inside buckets. members: node, label, grp, blocks, block; texts of equal labels are connected already."""
    pairs = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(o, F.col("block")) * F.col("blocks") + F.greatest(o, F.col("block")))
    )

    def run(batches):
        key, kept = None, ([], [], [], [])

        def done():
            found = linked(*kept) if len(kept[0]) > 1 else []
            for part in kept:
                part.clear()
            return found

        for b in batches:
            out = []
            for g, p, side, i, label, u in zip(*(c.to_pylist() for c in b.columns[:5]), b.column(5), strict=True):
                if (g, p) != key:
                    out += done()
                    key = (g, p)
                for part, x in zip(kept, (i, np.frombuffer(u.as_buffer(), U).copy(), side, label), strict=True):
                    part.append(x)
            yield links_batch(out)
        yield links_batch(done())

    # side 0 and 1 of a pair of two blocks; both 0 where a block meets itself
    low, high = F.floor(F.col("pair") / F.col("blocks")), F.col("pair") % F.col("blocks")
    side = F.when((low < high) & (high == F.col("block")), 1).otherwise(0)
    dealt = (
        members.withColumn("pair", F.explode(pairs)).select("grp", "pair", side.alias("side"), "node", "label")
        .join(held, "node").select("grp", "pair", "side", "node", "label", "units")
        .repartition("grp", "pair").sortWithinPartitions("grp", "pair", "side", "node")
    )
    return stored(dealt.mapInArrow(run, "a bigint, b bigint"))


def likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose digest may be in ``wanted``, and few others: no row that is in it is left out."""
    n = wanted.count()
    fits = min(n, int(FILTER_BITS / filter_bits(1 << 20, FILTER_RATE) * (1 << 20)))
    return rows.filter(build_level(wanted.select(F.col("digest").alias("key")), fits, FILTER_RATE, 1).lets_through(F.col("digest"))) if n else rows.limit(0)


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with ``label``: the root of their node, itself if it has no links."""
    return rows.join(rekeyed(roots, "node").withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def similar_roots(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """node, root by verified links that connect all similar pairs which share a band. texts: node, digest, size, bands; rows: digest, text."""
    banded = texts.select("node", F.explode("bands").alias("band"))
    least = banded.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    crowded = stored(banded.join(rekeyed(least, "band"), "band").select("node", "band", "first"))
    wanted = stored(texts.select("node", "digest").join(crowded.select("node").distinct(), "node"))
    one = likely(rows, wanted).join(wanted, "digest").dropDuplicates(["node"])
    held = stored(shingled(one))
    links = verified(crowded.filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct(), held)
    roots = stored(components(links))
    # buckets in several components: members that the first text's component leaves out
    labelled = rooted(crowded, roots)
    torn = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max(F.when(F.col("node") == F.col("first"), F.col("label"))).alias("of_first")).filter("low <> high").select("band", "of_first")
    rest = stored(labelled.join(rekeyed(torn, "band"), "band").filter("node <> first"))
    second = rest.filter("label <> of_first").groupBy("band").agg(F.min("node").alias("second"))
    rest = rest.drop("label", "of_first").join(rekeyed(second, "band"), "band").filter("node <> second")
    if not rest.limit(1).count():
        return roots
    more = verified(rest.select(F.col("node").alias("a"), F.col("second").alias("b")).distinct(), held)
    if more.count():
        links = links.union(more)
        roots = stored(components(links))
    # what is apart still
    labelled = stored(rooted(rest.select("node", "band"), roots).join(texts.select("node", "size"), "node"))
    torn = (
        labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("units"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
        .filter("low <> high").groupBy("n", "units", "who").agg(F.min("band").alias("band"))  # the same texts in several buckets are one group
    )
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("units") / BLOCK_SHINGLES)).cast("int")
    groups = torn.select("band", blocks.alias("blocks"))
    members = stored(labelled.join(rekeyed(groups, "band"), "band").select("node", "label", F.col("band").alias("grp"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")))
    if not members.count():
        return roots
    more = inside_buckets(members, held)
    return stored(components(links.union(more))) if more.count() else roots


def class_rows(docs: DataFrame) -> DataFrame:
    """id, digest, class_id, n_copies, chosen of every row: chosen is whether the text stands for a class without any id."""
    integer_ids(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.md5(text).alias("digest"), text.alias("text"))
    signs = stored(signed(rows))
    # copies meet by partial aggregates; band keys are the same for all of them
    texts = stored(
        signs.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.min("bands").alias("bands"), F.min("size").alias("size"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    placed = rooted(texts.select("node", "digest", "least", "n_copies"), similar_roots(texts, rows.select("digest", "text")))
    placed = stored(placed)
    names = placed.groupBy("label").agg(F.min("least").alias("class_id"))
    named = placed.join(rekeyed(names, "label"), "label").select("digest", "class_id", "n_copies", (F.col("class_id").isNull() & (F.col("node") == F.col("label"))).alias("chosen"))
    return one_class_each(stored(signs.select("id", "digest").join(rekeyed(named, "digest"), "digest").select("id", "digest", "class_id", "n_copies", "chosen")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of its class), n_copies (rows of the same text, this one included) of every row."""
    return class_rows(docs).select(F.col("id").alias("doc_id"), "class_id", "n_copies")


def one_class_each(placed: DataFrame) -> DataFrame:
    """Classes that share a doc_id (its rows have different texts) become one; nothing is done where there are none."""
    torn = stored(placed.filter("id is not null").groupBy("id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).filter("low <> high"))
    if not torn.count():
        return placed
    merged = components(placed.join(rekeyed(torn, "id"), "id").select("class_id", "low").distinct())
    moved = placed.join(rekeyed(merged.withColumnRenamed("node", "class_id"), "class_id"), "class_id", "left")
    return moved.withColumn("class_id", F.coalesce("root", "class_id")).select(*placed.columns)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id names their class, one row per doc_id (of several texts the one of least hash); of a class without any doc_id one row."""
    classes = stored(class_rows(docs))
    gone = classes.filter("id <> class_id").select(F.col("id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("bigint").alias("i"), F.md5(F.coalesce("text", F.lit(""))).alias("d"))
    kept = rows.filter("i is not null").join(gone, F.col("i") == F.col("gone"), "left_anti")
    several = stored(classes.filter("id = class_id").groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("digest").alias("digest")).filter("n > 1"))
    if several.count():
        marked = kept.join(rekeyed(several, "id"), F.col("i") == F.col("id"), "left")
        kept = marked.filter("id is null").select("row").union(marked.filter("d = digest").dropDuplicates(["i"]).select("row"))
    kept = kept.select("row")
    nameless = classes.filter("id is null and chosen").select("digest").distinct()
    if classes.filter("id is null").limit(1).count():
        kept = kept.union(rows.filter("i is null").join(rekeyed(nameless, "digest"), F.col("d") == F.col("digest")).dropDuplicates(["d"]).select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op8_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
