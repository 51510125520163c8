"""Components of documents whose sets of four-word shingles have a Jaccard similarity of 0.85 or more, by trees over count vectors.

Shingles are hashed into groups; how many of a set's shingles each group has makes the set a point. Two sets share at most the sum of
their points' coordinate minima, and a box of points shares with a point at most the sum of the minima with its upper corner. Sets that link
share 85/185 of their sizes' sum, so they differ in at most D = 15/185 of it, rounded down.

1. Equal sets are one node, named by a digest of their shingles.
2. The top of the index: sizes fall into strata, and in each stratum the groups are dealt into more blocks than the D of its largest sets. Each
   difference falls in one block, so two sets that link have equal counts in all groups of some block, D being less than the blocks: a cell of the index is
   all sets with the same counts in one block. (Here every hash value is a group, so that cells are as small as they can be.) A set enters the cells of its own stratum and of those that a larger
   partner can be in. Blocks that are empty say nothing: there are as many blocks more as a set may have empty; a set that has more than that enters the
   cells of another dealing too, and of the last one with its empty blocks. No pair is lost to chance.
3. Sets that share a cell meet its least set: a task's sets those of the task first, then these each other, so that a cell of any size is
   dealt to many tasks. Pairs whose points allow it (sums of minima over ``GROUPS`` coarser groups) are compared exactly, before anything is joined up.
4. Cells that true links do not hold together are packed into pages by size and counts. Pages are paired where their boxes allow a link; a task packs one page of a pair
   into an R-tree and searches it with the other's points; what survives the bound and is not connected yet is compared exactly.
5. Components of all links, named by their least doc_id.

Shingles are 64-bit hashes: two of a set's or pair's n shingles are taken for one with probability n^2 / 2^65.

Edge cases: a null text, or one without words, has an empty set, links with nothing and is a component of its own; of one to three words the whole is the only shingle; rows that share a
doc_id are one document with several texts and fall in one component; rows whose doc_id is null are documents of their own, named by the least doc_id they
reach, null if there is none; texts of any length are taken whole; an empty table gives an empty result; doc_id is of an integer type, others are refused; extra columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, integer_ids, rekeyed, stored, table
from .components import components
from .filter_audit import BASE, CLASSES, SEPARATOR, VALUES, _powers, next_blank, words_of
from .near_dup import Sets, likely, mixed, one_class_each

#: Sets link when OF * shared >= SHARE * all.
WORDS, SHARE, OF = 4, 85, 100
#: Coordinates of a point. Blocks use the upper half of a shingle's hash, these its lowest bits.
GROUPS = 64
#: A stratum's largest size over its least; dealings that a set tries before its empty blocks count.
RATIO, DEALINGS = 1.4, 4
#: Cell entries of a task that are sorted at once; texts that a task remembers, for their copies; sets that one task compares with one of them.
ENTRIES, REMEMBERED, STAR = 1 << 19, 20_000, 128
#: Texts whose sets are in memory at once.
SCANNED = 256
#: Texts and shingles of a page; branches of a tree's box.
PAGE, PAGE_SHINGLES, FAN = 256, 1 << 22, 16
BLOCK = 1 << 20
LOWER = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)

STRATA = [1]
while STRATA[-1] < 1 << 40:
    STRATA.append(max(STRATA[-1] + 1, int(RATIO * STRATA[-1])))


def word_hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words that lie in a block of lower-cased bytes: of all at once, by prefix sums of values times powers."""
    up, down = _powers.upto(len(raw) + 1)
    run = np.zeros(len(raw) + 1, U)
    np.cumsum(VALUES[raw] * up[:-1], out=run[1:])
    return (run[starts + lengths] - run[starts]) * down[starts]


def long_word_hash(raw: np.ndarray) -> int:
    """The same of one word of any length."""
    total = 0
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK]
        total += int((VALUES[part] * _powers.upto(len(part))[0]).sum()) * pow(BASE, at, 1 << 64)
    return total % (1 << 64)


def long_text_hashes(raw: np.ndarray) -> np.ndarray:
    """Hashes of all words of one text of any length, in blocks of whole words."""
    out, at = [], 0
    while at < len(raw):
        block = raw[at : at + BLOCK]
        if at + len(block) < len(raw):
            blanks = np.flatnonzero(CLASSES[block] & SEPARATOR)
            if not len(blanks):
                end = next_blank(raw, at)
                out.append(np.array([long_word_hash(raw[at:end])], U))
                at = end
                continue
            block = block[: blanks[-1] + 1]
        starts, lengths, _ = words_of(block, np.array([0, len(block)]))
        out.append(word_hashes(block, starts, lengths))
        at += len(block)
    return np.concatenate(out) if out else np.zeros(0, U)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words."""
    n = max(len(h) - k + 1, 0)
    s = np.full(n, U(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            s = mixed(s * ODD + h[i : i + n])
    return s


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text. Texts are read where they lie in Arrow's buffer, many at once."""
    texts = pc.fill_null(texts, "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1)
        raw = LOWER[everything[ends[i] : ends[j]]]
        if len(raw) > BLOCK:
            h = long_text_hashes(raw)
            n = np.array([len(h)])
        else:
            starts, lengths, owner = words_of(raw, ends[i : j + 1] - ends[i])
            h, n = word_hashes(raw, starts, lengths), np.bincount(owner, minlength=j - i)
        upto = np.concatenate([[0], np.cumsum(n)])
        every = shingles(h, WORDS)
        for a, b in itertools.pairwise(upto.tolist()):
            out.append(np.unique(every[a : b - WORDS + 1] if b - a >= WORDS else shingles(h[a:b], max(b - a, 1))))
        i = j
    return out


def name_of(units: np.ndarray) -> bytes:
    return hashlib.blake2b(units.tobytes(), digest_size=16).digest()


def links(a: np.ndarray, b: np.ndarray) -> bool:
    if SHARE * max(len(a), len(b)) > OF * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARE * (len(a) + len(b) - both)


def most_apart(sizes: int) -> int:
    """In how many shingles two sets that link differ at most, by the sum of their sizes."""
    return (OF - SHARE) * sizes // (OF + SHARE)


def stratum(size: int) -> int:
    return bisect.bisect_right(STRATA, size) - 1


def dealing(k: int) -> tuple[int, int]:
    """Blocks of a stratum, and how many of them may be empty in a set."""
    apart = most_apart(2 * (STRATA[k + 1] - 1))
    if not apart:
        return 0, 0
    spare, least = 0, SHARE * STRATA[k] / OF
    for _ in range(3):
        empty = (apart + 1 + spare) * math.exp(-least / (apart + 1 + spare))
        spare = math.ceil(empty + 2 * math.sqrt(empty))
    return apart + 1 + spare, spare


DEALINGS_OF = [dealing(k) for k in range(len(STRATA) - 1)]


def cells_of(units: np.ndarray) -> np.ndarray:
    """Names of the cells that a set enters."""
    out = []
    for k in range(stratum(len(units)), stratum(OF * len(units) // SHARE) + 1) if len(units) else ():
        blocks, spare = DEALINGS_OF[k]
        if not blocks:
            continue
        with np.errstate(over="ignore"):
            for attempt in range(DEALINGS):
                s = units if not attempt else np.sort(mixed(units + U(attempt) * ODD))
                block = (s >> U(32)) * U(blocks) >> U(32)
                first = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                dealt = U(k * DEALINGS + attempt + 1) * ODD
                out.append(mixed(mixed(np.add.reduceat(mixed(s), first) + dealt) + block[first]))
                if blocks - len(first) <= spare:
                    break
            else:
                empty = np.setdiff1d(np.arange(blocks, dtype=U), block[first])
                out.append(mixed(mixed(empty + ODD) + dealt))
    return np.concatenate(out) if out else np.zeros(0, U)


SETS = "row bigint, id bigint, digest string, name binary, size bigint, cells array<bigint>"


def signed(rows: DataFrame) -> DataFrame:
    """row (a number of its own), id, digest, name, size and cells of every row; of copies that a task meets one after the other, only the first has cells."""

    def run(batches):
        row, known = TaskContext.get().partitionId() << 33, {}
        for b in batches:
            names, sizes, cells, first = [], [], [], row
            for at in range(0, len(b), SCANNED):
                if len(known) >= REMEMBERED:
                    known.clear()
                digests = b.column(1).slice(at, SCANNED).to_pylist()
                new = [k for k, d in enumerate(digests) if d not in known]
                found = dict(zip(new, shingle_sets(b.column(2).slice(at, SCANNED).take(pa.array(new, pa.int64()))), strict=True))
                for k, d in enumerate(digests):
                    units = found.pop(k, None)
                    if units is None or d in known:
                        cells.append(None)
                    else:
                        known[d] = name_of(units), len(units)
                        cells.append(cells_of(units).view(np.int64))
                    names.append(known[d][0])
                    sizes.append(known[d][1])
            row += len(b)
            columns = [pa.array(np.arange(first, row)), b.column(0), b.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), pa.array(cells, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "digest", "name", "size", "cells"])

    return rows.mapInArrow(run, SETS)


def entries(sets: DataFrame) -> DataFrame:
    """cell, row, center. Of a task's sets in one cell the first has no center, to meet other tasks' first ones; the others name it as theirs."""

    def run(batches):
        for b in batches:
            rows, lists = np.asarray(b.column(0)), b.column(1)
            ends = np.concatenate([[0], np.cumsum(np.asarray(lists.value_lengths()))])
            cells, at = np.asarray(lists.flatten()), 0
            while at < len(rows):
                upto = max(at + 1, int(np.searchsorted(ends, ends[at] + ENTRIES, "right")) - 1)
                cell, owner = cells[ends[at] : ends[upto]], np.repeat(rows[at:upto], np.diff(ends[at : upto + 1]))
                at = upto
                if not len(cell):
                    continue
                order = np.argsort(cell, kind="stable")  # rows ascend already
                cell, owner = cell[order], owner[order]
                first = np.append(True, cell[1:] != cell[:-1])
                center = owner[np.maximum.accumulate(np.where(first, np.arange(len(cell)), 0))]
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(owner), pa.array(center, mask=first)], names=["cell", "row", "center"])

    return sets.filter(F.size("cells") > 0).select("row", "cells").mapInArrow(run, "cell bigint, row bigint, center bigint")


def crowded(entered: DataFrame) -> DataFrame:
    """cell, row, center of every set that is not alone in its cell, but for the center itself. What has a center already is dealt anywhere."""

    def run(batches):
        last = middle = None
        for b in batches:
            cell, row, center = np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2)
            placed = np.asarray(center.is_null())
            yield b.filter(pa.array(~placed))
            c, r = cell[placed], row[placed]
            if not len(c):
                continue
            new = np.append(c[0] != last, c[1:] != c[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(c)), -1))
            middles = np.where(start < 0, middle or 0, r[np.maximum(start, 0)])
            yield pa.RecordBatch.from_arrays([pa.array(c[~new]), pa.array(r[~new]), pa.array(middles[~new])], names=["cell", "row", "center"])
            last, middle = int(c[-1]), int(middles[-1])

    dealt = F.when(F.col("center").isNull(), F.col("cell")).otherwise(F.col("row"))
    return entered.repartition(dealt).sortWithinPartitions("cell", "row").mapInArrow(run, "cell bigint, row bigint, center bigint")


def point(units: np.ndarray) -> np.ndarray:
    return np.bincount((units % U(GROUPS)).astype(np.int64), minlength=GROUPS)


def points(rows: DataFrame) -> DataFrame:
    """node, size, counts and the sorted shingles as bytes. rows: node, text."""

    def run(batches):
        for b in batches:
            for i in range(len(b)):
                units = shingle_sets(b.column(1).slice(i, 1))[0]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([len(units)], pa.int64()), pa.array([point(units)], pa.list_(pa.int32())), pa.array([units.tobytes()], pa.binary())], names=["node", "size", "counts", "units"])

    return rows.select("node", "text").mapInArrow(run, "node bigint, size bigint, counts array<int>, units binary")


def allowed(counts_a: Column, counts_b: Column, size_a: Column, size_b: Column) -> Column:
    """Whether the sum of coordinate minima reaches what sets of these sizes share if they link."""
    shared = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return (SHARE * size_a <= OF * size_b) & (SHARE * size_b <= OF * size_a) & ((OF + SHARE) * shared >= SHARE * (size_a + size_b))


def pairs_batch(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["node", "center"])


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs node, center that link. The bound comes first; of the rest a task holds one center and streams at most ``STAR`` others or so."""
    seen = held.select("node", "size", "counts")
    of_center = seen.select(F.col("node").alias("center"), F.col("size").alias("size_c"), F.col("counts").alias("counts_c"))
    likely_pairs = stored(pairs.join(seen, "node").join(of_center, "center").filter(allowed(F.col("counts"), F.col("counts_c"), F.col("size"), F.col("size_c"))).select("node", "center"))

    def run(batches):
        key, one = None, None
        for b in batches:
            out = []
            for center, part, node, units in zip(*(c.to_pylist() for c in b.columns[:3]), b.column(3), strict=True):
                u = np.frombuffer(units.as_buffer(), U)
                if (center, part) != key:
                    key, one = (center, part), u.copy()  # the center itself comes first
                elif links(u, one):
                    out.append((node, center))
            yield pairs_batch(out)

    centers = likely_pairs.groupBy("center").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("parts"))
    around = likely_pairs.join(rekeyed(centers, "center"), "center").select("center", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), "node")
    around = around.join(held.select("node", "units"), "node").select("center", "part", "node", "units")
    middle = centers.join(held.select(F.col("node").alias("center"), "units"), "center").select("center", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("node"), "units")
    return stored(around.unionByName(middle).repartition("center", "part").sortWithinPartitions("center", "part", F.col("node").asc_nulls_first()).mapInArrow(run, "node bigint, center bigint"))


class CountTree:
    """An R-tree over count vectors, packed bottom up: points in order of size, then of the most varied coordinate within ``FAN`` leaves, ``FAN`` to a box.

    A box keeps its upper corner and its least and greatest size; that is all that the bound of a shared sum needs.
    """

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        order = np.argsort(sizes, kind="stable")
        for a in range(0, len(order), FAN * FAN):
            tile = order[a : a + FAN * FAN]
            order[a : a + FAN * FAN] = tile[np.argsort(counts[tile, counts[tile].var(axis=0).argmax()], kind="stable")]
        self.order = order
        self.levels = [(counts[order], sizes[order], sizes[order])]
        while len(self.levels[-1][0]) > 1:
            high, low, most = self.levels[-1]
            at = np.arange(0, len(high), FAN)
            self.levels.append((np.maximum.reduceat(high, at), np.minimum.reduceat(low, at), np.maximum.reduceat(most, at)))

    def search(self, counts: np.ndarray, size: int) -> np.ndarray:
        """Positions of the points that may link with this one."""
        found = np.zeros(1, np.int64)
        for level, (high, low, most) in reversed([*enumerate(self.levels)]):
            if level < len(self.levels) - 1:
                found = (found[:, None] * FAN + np.arange(FAN)).ravel()
                found = found[found < len(high)]
            fits = (SHARE * size <= OF * most[found]) & (SHARE * low[found] <= OF * size)
            found = found[fits]
            shared = np.minimum(high[found], counts).sum(axis=1)
            found = found[(OF + SHARE) * shared >= SHARE * (size + low[found])]
        return self.order[found]


def tree_pairs(counts: np.ndarray, sizes: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each point that searches and those that may link with it: of one page (all of side 0) the points before it, of two pages those of the first."""
    packed, asking = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(packed):
        return
    tree, alone = CountTree(counts[packed], sizes[packed]), not len(asking)
    for i in packed if alone else asking:
        found = packed[tree.search(counts[i], int(sizes[i]))]
        yield int(i), found[found < i] if alone else found


def may_link(side: np.ndarray, node: np.ndarray, label: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the points that may link with one of another label."""
    hit = np.zeros(len(node), bool)
    for i, found in tree_pairs(counts, sizes, side):
        others = found[label[found] != label[i]]
        if len(others):
            hit[others] = hit[i] = True
    return np.flatnonzero(hit)


def tree_links(nodes: list[int], units: list[np.ndarray], side: list[int], labels: list[int]) -> list[tuple[int, int]]:
    """Spanning links among sets of different labels: the first page is packed into a tree, the other's points search it."""
    sets, out, first = Sets(len(nodes)), [], {}
    for i, x in enumerate(labels):
        sets.join(first.setdefault(x, i), i)
    for i, found in tree_pairs(np.stack([point(u) for u in units]), np.array([len(u) for u in units]), np.array(side)):
        for j in found.tolist():
            if sets.find(i) != sets.find(j) and links(units[i], units[j]):
                sets.join(i, j)
                out.append((nodes[i], nodes[j]))
    return out


def paged(members: DataFrame) -> DataFrame:
    """members (cell, apart, size, node, label, counts) with a page each: those of a cell, and of a label that is apart, in order of size, in stretches of bounded size."""
    columns = ["cell", "apart", "size", "node", "label", "counts"]

    def run(batches):
        page, last, texts, shingles = TaskContext.get().partitionId() << 32, None, 0, 0
        for b in batches:
            out = []
            for c, a, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (c, a) != last or texts >= PAGE or shingles + n > PAGE_SHINGLES:
                    page, last, texts, shingles = page + 1, (c, a), 0, 0
                texts, shingles = texts + 1, shingles + n
                out.append(page)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*columns, "page"])

    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "apart", "size", "node"]
    placed = members.select(*columns).repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return stored(placed.mapInArrow(run, "cell bigint, apart bigint, size bigint, node bigint, label bigint, counts array<int>, page bigint"))


def inside_cells(members: DataFrame, held: DataFrame) -> DataFrame:
    """Links node, center inside cells, as far as they join sets of different labels."""
    pages = paged(members)
    corner = [F.max(F.col("counts")[g]).alias(f"g{g}") for g in range(GROUPS)]
    boxes = pages.groupBy("cell", "page").agg(F.min("size").alias("low"), F.max("size").alias("most"), F.min("label").alias("one"), F.max("label").alias("other"), *corner)
    boxes = stored(boxes.select("cell", "page", "low", "most", "one", "other", F.array(*[f"g{g}" for g in range(GROUPS)]).alias("high")))
    second = boxes.select("cell", *[F.col(c).alias(f"{c}_2") for c in boxes.columns if c != "cell"])
    shared = F.aggregate(F.zip_with("high", "high_2", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, x: s + x)
    may = (
        (F.col("page") <= F.col("page_2")) & (SHARE * F.greatest("low", "low_2") <= OF * F.least("most", "most_2")) & ((OF + SHARE) * shared >= SHARE * (F.col("low") + F.col("low_2")))
        & ~((F.col("one") == F.col("other")) & (F.col("one") == F.col("one_2")) & (F.col("one") == F.col("other_2")))
    )
    meeting = stored(boxes.join(second, "cell").filter(may).select(F.col("page").alias("p"), F.col("page_2").alias("q")))
    sides = meeting.select("p", "q", F.lit(0).alias("side"), F.col("p").alias("page")).unionByName(meeting.filter("p <> q").select("p", "q", F.lit(1).alias("side"), F.col("q").alias("page")))
    met = sides.join(pages.select("page", "node", "label", "size", "counts"), "page").select("p", "q", "side", "node", "label", "size", "counts")

    def bounded(batches):
        """The points that some other of another label may link with."""
        rows = []

        def done():
            if len(rows) > 1:
                found = may_link(*map(np.array, zip(*(r[2:] for r in rows), strict=True)))
                if len(found):
                    kept = [rows[i][:5] for i in found]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept, strict=True)], names=["p", "q", "side", "node", "label"])
            rows.clear()

        key = None
        for b in batches:
            counts = np.asarray(b.column(6).flatten()).reshape(-1, GROUPS)
            for r, c in zip(zip(*(b.column(i).to_pylist() for i in range(6)), strict=True), counts, strict=True):
                if r[:2] != key:
                    yield from done()
                    key = r[:2]
                rows.append((*r, c))
        yield from done()

    def run(batches):
        key, kept = None, ([], [], [], [])

        def done():
            found = tree_links(*kept) if len(kept[0]) > 1 else []
            for part in kept:
                part.clear()
            return found

        for b in batches:
            out = []
            for p, q, side, node, label, u in zip(*(c.to_pylist() for c in b.columns[:5]), b.column(5), strict=True):
                if (p, q) != key:
                    out += done()
                    key = (p, q)
                for part, x in zip(kept, (node, np.frombuffer(u.as_buffer(), U).copy(), side, label), strict=True):
                    part.append(x)
            yield pairs_batch(out)
        yield pairs_batch(done())

    by_pair = lambda df: df.repartition("p", "q").sortWithinPartitions("p", "q", "side", "node")
    near = stored(by_pair(met).mapInArrow(bounded, "p bigint, q bigint, side bigint, node bigint, label bigint"))
    return stored(by_pair(near.join(held.select("node", "units"), "node").select("p", "q", "side", "node", "label", "units")).mapInArrow(run, "node bigint, center bigint"))


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(rekeyed(roots, "node").withColumnRenamed("root", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def merged(torn: DataFrame, rounds: int = 2) -> DataFrame:
    """cell, node, label, apart with cells that have sets in common made one where that sends fewer rows. torn: cell, node, label.

    Long sets share hundreds of cells, each of them with a few of their near copies: together they are sent once. Any way to merge is right, as sets of one cell stay together.
    ``apart`` is the label where it has more sets in the cell than a page: these get pages of their own, which need not meet each other.
    """
    of = torn.select("cell", "node", F.col("cell").alias("grp"))
    for _ in range(rounds):
        for end in ("node", "cell"):
            least = rekeyed(of.groupBy(end).agg(F.min("grp").alias("least")), end)
            of = of.join(least, end).select("cell", "node", F.col("least").alias("grp"))
        of = stored(of)
    rows = stored(torn.join(of, ["cell", "node"]).groupBy("grp", "node", "label").agg(F.count(F.lit(1)).alias("times"), F.min("cell").alias("cell")))
    sizes = rows.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("times").alias("times")).groupBy("grp").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("times").alias("times"))
    fits = sizes.filter(F.col("n") * F.ceil((F.col("n") - F.col("most") + 1) / PAGE) <= F.col("times")).select("grp", F.lit(True).alias("fits"))
    one = rows.join(rekeyed(fits, "grp"), "grp", "left_semi").select(F.col("grp").alias("cell"), "node", "label")
    several = torn.join(of, ["cell", "node"]).join(rekeyed(fits, "grp"), "grp", "left_anti").select("cell", "node", "label")
    out = stored(one.unionByName(several))
    large = out.groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > PAGE).select("cell", "label", F.col("label").alias("apart"))
    return out.join(F.broadcast(large) if large.count() <= 10_000 else large, ["cell", "label"], "left").select("cell", "node", "label", F.coalesce("apart", F.lit(-1).cast("long")).alias("apart"))


def linked_roots(rows: DataFrame, sets: DataFrame, named: DataFrame) -> DataFrame:
    """node, root of all sets that link with another. named: row, node, digest of every row with shingles."""
    found = stored(crowded(entries(sets)))
    ends = [F.col("row").alias("row"), F.col("row").alias("center")]
    nodes = [named.select(e, F.col("node").alias(n)) for e, n in zip(ends, ("node", "middle"), strict=True)]
    met = stored(found.join(nodes[0], "row").join(nodes[1], "center").filter("node <> middle").select("cell", "node", F.col("middle").alias("center")))
    discard(found)
    pairs = met.select("node", "center").distinct()
    both = pairs.select("node").union(pairs.select("center")).distinct()
    wanted = stored(named.groupBy("node").agg(F.min("digest").alias("digest")).join(both, "node"))
    held = stored(points(likely(rows.select("digest", "text"), wanted).dropDuplicates(["digest"]).join(wanted, "digest")))  # copies go before they are dealt
    true = verified(pairs, held)
    roots = stored(components(true))
    members = met.select("cell", "node").union(met.select("cell", F.col("center").alias("node"))).distinct()
    labelled = stored(rooted(members, roots))
    torn = (
        labelled.groupBy("cell").agg(F.min("label").alias("one"), F.max("label").alias("other"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who"))
        .filter("one <> other and n > 2").groupBy("n", "who").agg(F.min("cell").alias("cell"))  # two sets have met; the same sets in several cells are one cell
    )
    torn = stored(labelled.join(rekeyed(torn.select("cell"), "cell"), "cell"))
    left = merged(torn).join(held.select("node", "size", "counts"), "node")
    more = inside_cells(left, held)
    if more.limit(1).count():
        roots = stored(components(true.union(more)))
    discard(met, wanted, held, labelled, torn)
    return roots


def linked_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    integer_ids(docs)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.md5(text).alias("digest"), text.alias("text"))
    sets = stored(signed(rows))
    full = sets.filter("size > 0")
    # equal sets are one node, named by one of their rows
    folded = stored(full.groupBy("name").agg(F.min("row").alias("node"), F.min("id").alias("least")))
    named = stored(full.select("row", "name", "digest").join(rekeyed(folded.select("name", "node"), "name"), "name").select("row", "node", "digest"))
    labelled = stored(rooted(folded.select("node", "least"), linked_roots(rows, sets, named)))
    classes = labelled.groupBy("label").agg(F.min("least").alias("class_id"))
    classes = labelled.join(rekeyed(classes, "label"), "label").select("node", "class_id")
    of_row = named.select("row", "node").join(rekeyed(classes, "node"), "node").select("row", "class_id")
    placed = full.select("row", "id", "size").join(of_row, "row").select("id", "size", "class_id")
    placed = stored(placed.unionByName(sets.filter("size = 0").select("id", "size", F.col("id").alias("class_id"))))
    discard(sets, folded, named, labelled)
    return one_class_each(placed).select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("class_id").alias("component_id"))


def op11_ngram_join(spark, sf_dir):
    return linked_components(table(spark, sf_dir, "documents"))
