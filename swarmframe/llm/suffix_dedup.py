"""Removal of repeated byte strings by a logarithmic family of suffix arrays.

Texts are UTF-8 bytes; every byte goes that lies in a string of ``LENGTH`` bytes which
also starts earlier (in a smaller document, or earlier in the same one).

Suffixes are indexed sparsely. A window of ``LENGTH`` bytes is represented by the
anchor in it: the ``GRAM``-byte string of least hash. Equal windows have equal anchors
at equal places, and an anchor represents a run of windows, so one suffix per anchor
(about one for 35 bytes) stands for all of them.

1. Anchors whose hash occurs once cannot repeat anything. Hashes are dealt to buckets,
   those that occur twice are told to the documents that have them. A batch of texts
   sends a hash once however often it has it, so a passage that all documents
   share is as many entries as there are batches.
   A hash that is hot in the whole corpus is split: its windows go one by one, by 128 bits of
   their own hash, each once per group of documents.
2. Repeated anchors travel with their surroundings (what their windows cover) to the
   bucket of their hash, where all equal windows meet.
3. In a bucket, anchors come in document order, batch by batch. A batch gets a suffix array
   (bytes from the anchor on) and one of what lies before the anchors, read backwards. It is
   merged in order with each level of the index; long common prefixes of neighbours give
   classes of equal right and left surroundings of every length, and windows of
   equal classes are equal. Levels of equal size merge, so there are
   logarithmically many.
4. Runs of repeated windows go back to their documents, which are cut.

Copies of a whole text are recognised beforehand: only the first is indexed.
Documents go by the hash of their id and text into groups, and hashes into buckets, of so many bytes that their number follows from
the corpus's size: one group or bucket is in a task's memory at a time, whatever ``spark.sql.shuffle.partitions`` says. The texts are shuffled
once for steps 2 and 4; only hot hashes, ``MOST_HOT`` at most, are collected and broadcast.
Windows of hot hashes are told apart by two independent 64-bit hashes of their bytes: among n such windows two different ones are taken for equal
with a probability under n * n / 2**129. All other windows are compared byte by byte.

Edge cases: a null text is empty; texts under ``LENGTH`` bytes lose nothing and go into no group, so there may be any number of equal ones; rows that
share a doc_id are ordered by their texts' hash, equal rows one after the other (rows equal in id and text are in one group); a
null doc_id counts as the least, for any number of rows; a text of any length is worked on in blocks; an empty table gives an empty result; doc_id is of an integer type,
others are refused. Extra columns are carried where texts are rewritten, or not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, integer_ids, rekeyed, stored, table

LENGTH, GRAM = 100, 32
#: Bytes of text to a group of documents, and to a bucket of hashes, on average; there are ``GROUPS`` groups and one bucket per shuffle partition at least.
GROUP_BYTES, BUCKET_BYTES, GROUPS = 16 << 20, 32 << 20, 4
#: A hash is hot, and split by the window, if its anchors are more than this part of a bucket's share of all anchors, more than ``Sizes.often``, and more
#: than one in ``MOST_HOT`` of all anchors. So at most ``MOST_HOT`` hashes, of 8 bytes, are broadcast.
HOT, MOST_HOT = 1 / 8, 1 << 22
NULL_ID = -(1 << 63)
U = np.uint64


@dataclass(frozen=True)
class Sizes:
    """Bytes of text worked on at a time, bytes of text after which a task hands out its hashes, anchors per batch of the index, anchors from which a hash may be hot."""

    block: int = 1 << 19
    flush: int = 16 << 20
    batch: int = 1 << 16
    often: int = 1024


POSITION = U((1 << 24) - 1)
NONE = np.zeros(0, np.int64)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on."""
    n = len(buf) - GRAM + 1
    with np.errstate(over="ignore"):
        w = np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,)).astype(U)
        w *= U(0x9E3779B97F4A7C15)
        w ^= w >> U(29)
        h = w[: len(w) - 8] * U(0xBF58476D1CE4E5B9) + w[8:]
        h ^= h >> U(32)
        g = h[:n] * U(0x94D049BB133111EB) + h[16 : 16 + n]
        g ^= g >> U(31)
        g *= U(0xD6E8FEB86659FD93)
        g ^= g >> U(32)
    return g


def anchors(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, position, first window, last window, and the hashes of all grams) of the anchors of windows that lie within one text; ``ends`` of the texts in ``buf``."""
    if len(buf) < LENGTH:
        return np.zeros(0, U), NONE, NONE, NONE, np.zeros(0, U)
    g = gram_hashes(buf)
    key = (g & ~POSITION) | np.arange(len(g), dtype=U)
    width = 1
    while 2 * width <= LENGTH - GRAM + 1:
        key = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    rest = LENGTH - GRAM + 1 - width
    if rest:
        key = np.minimum(key[: len(key) - rest], key[rest:])
    at = (key & POSITION).astype(np.int64)
    for e in ends.tolist():  # windows that reach over the end of a text
        at[max(0, e - LENGTH + 1) : e] = -1
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    stop = np.append(start[1:], len(at)) - 1
    real = at[start] >= 0
    start, stop = start[real], stop[real]
    return g[at[start]], at[start], start, stop, g


def blocks(offsets: np.ndarray, block: int):
    """(first text, after the last, from byte, to byte) of stretches of about ``block`` bytes; a longer text is cut into stretches that overlap by what a window can reach."""
    i = 0
    while i < len(offsets) - 1:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + block, "right")) - 1)
        low, high = int(offsets[i]), int(offsets[j])
        while high - low > 8 * block:
            yield i, j, low, low + 4 * block + LENGTH
            low += 4 * block + 1
        yield i, j, low, high
        i = j


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and offsets of its rows."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[int(offsets[0]) if len(offsets) else 0 : int(offsets[-1]) if len(offsets) else 0]
    return data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def anchored(data: np.ndarray, offsets: np.ndarray, block: int):
    """Per stretch: (hash, position, first and last window) in ``data``, where the stretch begins, and its gram hashes."""
    for i, j, low, high in blocks(offsets, block):
        ends = offsets[i + 1 : j + 1]
        h, a, p, q, g = anchors(data[low:high], ends[(ends > low) & (ends <= high)] - low)
        yield h, a + low, p + low, q + low, low, g


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, distinct keys, their first places in the order)."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else NONE
    return order, s[first], first


def in_rows(kind: int, key: np.ndarray, *columns: np.ndarray):
    """Record batch of one row per key: kind, key, and each column's values of that key as bytes."""
    order, keys, first = grouped(key)
    cuts = np.append(first, len(order))
    sorted_columns = [c[order] for c in columns]
    blobs = [pa.array([c[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()) for c in sorted_columns]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.astype(np.int64)), *blobs], names=["kind", "key", *"abcdefg"[: len(columns)]])


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(2, n): two independent hashes of the bytes of the windows that begin at ``at``."""
    words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    out = []
    with np.errstate(over="ignore"):
        for seed, factor in ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)):
            h = np.full(len(at), U(seed))
            for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
                h = (h ^ words[at + k]) * U(factor)
                h ^= h >> U(32)
                h *= U(0xE7037ED1A0B428DB)
                h ^= h >> U(29)
            out.append(h.view(np.int64))
    return np.stack(out)


QUERY, TELL, REPEATED, COPY, TOTAL, OFTEN, PIECE = range(7)


def ask(buckets: Keys, sizes: Sizes):
    """Step 1, map side: texts with their group to hash entries per bucket, and what a batch knows to be repeated by itself."""

    def flush(hashes, groups):
        h, g = np.concatenate(hashes), np.concatenate(groups)
        order, distinct, first = grouped(h)
        count = np.diff(np.append(first, len(h)))
        g = g[order]
        once = count == 1
        # a hash met twice here is known to be repeated: other batches are told by an entry without a group
        owner = np.where(once, g[first], np.int32(-1))
        yield in_rows(QUERY, buckets.of(distinct), distinct.view(np.int64), owner, count.astype(np.int32))
        many = np.repeat(~once, count)
        if many.any():
            pair = np.unique(np.stack([g[many].astype(np.int64), h[order][many].view(np.int64)]), axis=1)
            none = np.zeros(pair.shape[1], np.int8)
            yield in_rows(TELL, pair[0], pair[1], none, none)

    def run(batches):
        hashes, groups, size = [], [], 0
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            of = np.asarray(b.column(0)).astype(np.int32)
            for h, a, *_ in anchored(data, offsets, sizes.block):
                hashes.append(h)
                groups.append(of[np.searchsorted(offsets, a, "right") - 1])
            size += len(data)
            if size >= sizes.flush:
                yield from flush(hashes, groups)
                hashes, groups, size = [], [], 0
        if hashes:
            yield from flush(hashes, groups)

    return run


def by_key(batches, column: str):
    """(key, its part of a batch, whether the key ends there) of batches sorted by key; None for the key's last part if it ended with the batch before."""
    before = None
    for b in batches:
        key = np.asarray(b.column(column))
        if not len(key):
            continue
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        if before is not None and key[0] != before:
            yield before, None, True
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(key[i]), b.slice(i, j - i), j < len(key)
        before = int(key[-1])
    if before is not None:
        yield before, None, True


def answer(sizes: Sizes):
    """Step 1, reduce side: hashes that occur twice, told to the groups that have them; how many anchors there are, and which hashes occur often."""

    def told(hashes, owners, counts):
        h, g, n = np.concatenate(hashes), np.concatenate(owners), np.concatenate(counts).astype(np.int64)
        order, distinct, first = grouped(h)
        size = np.diff(np.append(first, len(h)))
        total = np.add.reduceat(n[order], first)
        out = np.repeat(total > 1, size) & (g[order] >= 0)
        if out.any():
            yield in_rows(TELL, g[order][out].astype(np.int64), h[order][out], np.zeros(int(out.sum()), np.int8))
        yield in_rows(TOTAL, np.array([total.sum()]), np.zeros(1, np.int8), np.zeros(1, np.int8))
        often = total > sizes.often
        if often.any():
            yield in_rows(OFTEN, np.zeros(int(often.sum()), np.int64), distinct[often], total[often])

    def run(batches):
        held = ([], [], [])
        for _, b, ends in by_key(batches, "key"):
            if b is not None:
                kind = np.asarray(b.column(0))
                yield b.filter(pa.array(kind == TELL)).select(["kind", "key", "a", "b"])
                for row in zip(*(c.to_pylist() for c in b.filter(pa.array(kind == QUERY)).select(["a", "b", "c"]).columns), strict=True):
                    for part, x, t in zip(held, row, (np.int64, np.int32, np.int32), strict=True):
                        part.append(np.frombuffer(x, t))
            if ends and held[0]:
                yield from told(*held)
                held = ([], [], [])

    return run


def hot_hashes(told: DataFrame, often: int, buckets: int) -> np.ndarray:
    """Hashes of so many anchors that their surroundings would overload a bucket; at most ``MOST_HOT`` of them."""
    total = told.filter(F.col("kind") == TOTAL).agg(F.sum("key")).first()[0] or 0
    least = max(often, HOT * total / buckets, total / MOST_HOT)

    def run(batches):
        for b in batches:
            kept = [np.frombuffer(h, np.int64)[np.frombuffer(n, np.int64) > least].tobytes() for h, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.binary())], names=["a"])

    rows = told.filter(F.col("kind") == OFTEN).select("a", "b").mapInArrow(run, "a binary").collect()
    return np.sort(np.frombuffer(b"".join(bytes(r[0]) for r in rows), np.int64))


@dataclass(frozen=True)
class Keys:
    """``count`` shuffle keys. While they are few per partition, ``table`` has numbers that Spark's hash partitioning deals evenly; many fall evenly by themselves."""

    count: int
    table: np.ndarray | None

    def of(self, hashes: np.ndarray) -> np.ndarray:
        number = (hashes % U(self.count)).astype(np.int64)
        return number if self.table is None else self.table[number]

    def column(self, *values) -> Column:
        number = F.pmod(F.xxhash64(*values), F.lit(self.count)).cast("bigint")
        return number if self.table is None else F.get(F.split(F.lit(",".join(map(str, self.table))), ",").cast("array<bigint>"), number.cast("int"))


def shuffle_keys(spark, partitions: int, least: int) -> Keys:
    """Keys of ``least`` kinds at least, as many for each partition."""
    each = -(-least // partitions)
    if each > 16:
        return Keys(least, None)
    size = 8 * each * partitions
    while True:
        at = spark.range(size).select(F.pmod(F.hash("id"), F.lit(partitions)).alias("p")).toPandas()["p"].to_numpy()
        order = np.argsort(at, kind="stable")
        nth = np.arange(size) - np.searchsorted(at[order], at[order])
        keys = order[nth < each]
        if len(keys) == each * partitions:
            return Keys(len(keys), keys.reshape(partitions, each).T.ravel().astype(np.int64))
        size *= 2


def spans_of(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All indices of ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Group:
    """Texts of a group of documents, each (id, tie) once, without those that are copies of earlier texts."""

    def __init__(self, docs: pa.Table, copies: set):
        self.ids, self.ties = np.asarray(docs["id"].combine_chunks(), np.int64), np.asarray(docs["tie"].combine_chunks(), np.int64)
        pairs = list(zip(self.ids.tolist(), self.ties.tolist(), strict=True))
        seen = set(copies)
        self.copy = np.zeros(len(pairs), bool)
        for i, p in enumerate(pairs):
            self.copy[i] = p in seen
            seen.add(p)
        texts = docs["text"]
        self.data, self.offsets = text_bytes(texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0))


def copies_in(told: pa.Table) -> set:
    rows = told.filter(pa.array(np.asarray(told["kind"].combine_chunks()) == COPY)) if told.num_rows else told
    return set(zip(rows["id"].to_pylist(), rows["tie"].to_pylist(), strict=True))


PIECES = "kind int, key bigint, a binary, b binary, c binary"


def is_in(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def earliest(windows: np.ndarray) -> np.ndarray:
    """Whether each row (two hashes, id, tie, group, place) is the first of its hash in document order."""
    order = np.lexsort((windows[:, 5], windows[:, 3], windows[:, 2], windows[:, 1], windows[:, 0]))
    w = windows[order]
    first = np.ones(len(w), bool)
    first[1:] = (w[1:, :2] != w[:-1, :2]).any(axis=1)
    out = np.zeros(len(w), bool)
    out[order[first]] = True
    return out


def runs_of(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeated windows as (group of each run, id, tie, from, to of it)."""
    w = windows[np.lexsort((windows[:, 5], windows[:, 3], windows[:, 2]))]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:, 2:4] != w[:-1, 2:4]).any(1) | (w[1:, 5] > w[:-1, 5] + 1)
    start = np.flatnonzero(new)
    last = np.append(start[1:], len(w)) - 1
    return w[start, 4], np.stack([w[start, 2], w[start, 3], w[start, 5], w[last, 5] + LENGTH], axis=1)


def carve(buckets: Keys, hot, sizes: Sizes):
    """Step 2: the repeated anchors of a group's texts with their surroundings, per bucket of their hash.

    Windows of hot hashes go one by one, by their own hash, and each once per group: what repeats inside the group is known at once.
    """

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        group = Group(docs, copies_in(told))
        kinds = np.asarray(told["kind"].combine_chunks()) if told.num_rows else NONE
        blobs = [b for k, b in zip(kinds.tolist(), told["a"].to_pylist(), strict=True) if k == TELL]
        wanted = np.unique(np.frombuffer(b"".join(blobs), np.int64))
        key = int(docs["key"][0].as_py()) if docs.num_rows else 0
        hashes, metas, bodies, windows = [np.zeros(0, U)], [np.zeros((0, 7), np.int64)], [np.zeros(0, np.uint8)], [np.zeros((0, 6), np.int64)]
        for h, a, p, q, low, g in anchored(group.data, group.offsets, sizes.block) if len(wanted) else ():
            row = np.searchsorted(group.offsets, a, "right") - 1
            take = is_in(h.view(np.int64), wanted) & ~group.copy[row]
            often = take & is_in(h.view(np.int64), hot.value)
            if often.any():
                at, r = spans_of(p[often], (q - p)[often] + 1), np.repeat(row[often], (q - p)[often] + 1)
                windows.append(np.stack([*window_hashes(group.data, at), group.ids[r], group.ties[r], np.full(len(r), key), at - group.offsets[r]], axis=1))
            take &= ~often
            h, a, p, q, row = h[take], a[take], p[take], q[take], row[take]
            size = q - p + LENGTH
            # id, tie, group, place of the anchor in its text, bytes before it, bytes of the last window before it, size of the piece
            metas.append(np.stack([group.ids[row], group.ties[row], np.full(len(row), key), a - group.offsets[row], a - p, a - q, size], axis=1))
            bodies.append(group.data[spans_of(p, size)])
            hashes.append(h)
        h, meta, body = np.concatenate(hashes), np.concatenate(metas), np.concatenate(bodies)
        order, keys, first = grouped(buckets.of(h))
        cuts = np.append(first, len(order)).tolist()
        starts, size = (np.cumsum(meta[:, 6]) - meta[:, 6])[order], meta[order, 6]
        body, meta = body[spans_of(starts, size)], np.ascontiguousarray(meta[order])
        ends = np.concatenate([[0], np.cumsum(size)])
        # one row for a bucket: pieces, their bytes, windows of hot hashes
        rows = {k: [meta[i:j].tobytes(), body[ends[i] : ends[j]].tobytes(), None] for k, i, j in zip(keys.tolist(), cuts[:-1], cuts[1:], strict=True)}
        single = np.concatenate(windows)
        new = earliest(single)
        mine = single[new]
        order, keys, first = grouped(buckets.of(np.ascontiguousarray(mine[:, 0]).view(U)))
        cuts = np.append(first, len(order)).tolist()
        for k, i, j in zip(keys.tolist(), cuts[:-1], cuts[1:], strict=True):
            rows.setdefault(k, [None, None, None])[2] = mine[order[i:j]].tobytes()
        columns = [pa.array([PIECE] * len(rows), pa.int32()), pa.array(list(rows), pa.int64()), *(pa.array([r[c] for r in rows.values()], pa.binary()) for c in range(3))]
        out = [pa.RecordBatch.from_arrays(columns, names=["kind", "key", "a", "b", "c"])]
        if not new.all():
            to, found = runs_of(single[~new])
            none = np.zeros(len(found), np.int8)
            out.append(in_rows(TELL, to, found, none, none))
        return pa.Table.from_batches(out)

    return run


class Level:
    """Suffixes in document order with the sorted order of what follows (right) and, backwards, of what precedes (left) their anchors."""

    def __init__(self, right: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, orders=None):
        self.right, self.left, self.low, self.high = right, left, low, high
        self.orders = orders or (np.argsort(right, kind="stable"), np.argsort(left, kind="stable"))

    def __len__(self) -> int:
        return len(self.right)

    def merged(self, new: Level) -> Level:
        """Both levels in one; sorted orders are merged, not sorted again."""
        columns = [np.concatenate([getattr(self, c), getattr(new, c)]) for c in ("right", "left", "low", "high")]
        orders = []
        for mine, its, rows, more in ((self.orders[0], new.orders[0], self.right, new.right), (self.orders[1], new.orders[1], self.left, new.left)):
            place = np.searchsorted(rows[mine], more[its], "right") + np.arange(len(its))
            order = np.empty(len(mine) + len(its), np.int64)
            order[place] = its + len(mine)
            rest = np.ones(len(order), bool)
            rest[place] = False
            order[rest] = mine
            orders.append(order)
        return Level(*columns, tuple(orders))


def common_prefixes(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row has in common with the one before it in sorted order."""
    raw = rows.view(np.uint8).reshape(len(rows), -1)
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 14):
        i = order[at - 1 : at + (1 << 14)]
        differ = raw[i[1:]] != raw[i[:-1]]
        out[at : at + len(i) - 1] = np.where(differ.any(1), differ.argmax(1), raw.shape[1])
    return out


def scan(level: Level, since: int) -> np.ndarray:
    """(rows from ``since`` on, LENGTH - GRAM + 1): whether the window that has so many bytes before the anchor equals one of an earlier row."""
    n = len(level)
    right, left = (common_prefixes(r, o) for r, o in zip((level.right, level.left), level.orders, strict=True))
    out = np.zeros((n - since, LENGTH - GRAM + 1), bool)
    rc, lc = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(LENGTH - GRAM + 1):
        rows = np.flatnonzero((level.low <= before) & (before <= level.high))
        if len(rows) < 2:
            continue
        rc[level.orders[0]] = np.cumsum(right < LENGTH - before)
        lc[level.orders[1]] = np.cumsum(left < before) if before else 0
        key = rc[rows] * (n + 1) + lc[rows]
        order = np.argsort(key, kind="stable")
        k = key[order]
        again = rows[order[1:][k[1:] == k[:-1]]]
        again = again[again >= since]
        out[again - since, before] = True
    return out


class Family:
    """A logarithmic family of suffix arrays. Batches must come in document order."""

    def __init__(self):
        self.levels: list[Level] = []

    def add(self, new: Level) -> np.ndarray:
        """Windows of the batch that occur earlier, in the batch or in a level; then the batch becomes a level."""
        hit = scan(new, 0)
        for level in self.levels:
            hit |= scan(level.merged(new), len(level))
        while self.levels and len(self.levels[-1]) <= len(new):
            new = self.levels.pop().merged(new)
        self.levels.append(new)
        return hit


def surroundings(meta: np.ndarray, body: np.ndarray, ends: np.ndarray) -> Level:
    """Level of a batch of pieces: fixed-width rows of the bytes after and, backwards, before each anchor (zeros where the piece ends)."""
    start, size, before = ends - meta[:, 6], meta[:, 6], meta[:, 4]
    padded = np.concatenate([body, np.zeros(1, np.uint8)])
    i = np.arange(LENGTH)
    at = (start + before)[:, None] + i
    right = padded[np.where(i < (size - before)[:, None], at, len(body))]
    i = np.arange(LENGTH - GRAM)
    left = padded[np.where(i < before[:, None], (start + before)[:, None] - 1 - i, len(body))]
    fixed = lambda x: np.ascontiguousarray(x).view(f"S{x.shape[1]}").ravel()
    return Level(fixed(right), fixed(left), meta[:, 5], before)


def index(sizes: Sizes):
    """Step 3: pieces of a bucket, through the family, to runs of repeated windows (id, tie, from, to) per group of documents."""

    def repeated(metas, bodies, windows):
        out = []
        if windows:
            single = np.concatenate(windows)
            again = ~earliest(single)
            if again.any():
                out.append(runs_of(single[again]))
        if metas:
            out += indexed(np.concatenate(metas), np.concatenate(bodies), sizes)
        if out:
            # one row per group of documents
            yield in_rows(REPEATED, *(np.concatenate(x) for x in zip(*out, strict=True))).select(["key", "a"])

    def run(batches):
        metas, bodies, windows = [], [], []
        for _, b, ends in by_key(batches, "key"):
            if b is not None:
                yield b.filter(pa.array(np.asarray(b.column(0)) == TELL)).select(["key", "a"])
                for kind, m, t, w in zip(*(c.to_pylist() for c in (b.column(0), *b.columns[2:])), strict=True):
                    if kind == PIECE and m:
                        metas.append(np.frombuffer(m, np.int64).reshape(-1, 7))
                        bodies.append(np.frombuffer(t, np.uint8))
                    if kind == PIECE and w:
                        windows.append(np.frombuffer(w, np.int64).reshape(-1, 6))
            if ends:
                yield from repeated(metas, bodies, windows)
                metas, bodies, windows = [], [], []

    return run


def indexed(meta: np.ndarray, body: np.ndarray, sizes: Sizes):
    """Pieces through the family, a batch at a time: (group, and id, tie, from, to) of runs of repeated windows."""
    ends = np.cumsum(meta[:, 6])
    order = np.lexsort((meta[:, 3], meta[:, 1], meta[:, 0]))
    family = Family()
    for at in range(0, len(order), sizes.batch):
        rows = order[at : at + sizes.batch]
        part = meta[rows]
        size = part[:, 6]
        hit = family.add(surroundings(part, body[spans_of(ends[rows] - size, size)], np.cumsum(size)))
        # windows with more bytes before the anchor start earlier: read backwards, runs are runs of starts
        edge = np.diff(np.pad(hit[:, ::-1].astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, first = np.nonzero(edge == 1)
        _, last = np.nonzero(edge == -1)
        if len(row):
            base = part[row, 3] - (LENGTH - GRAM)
            yield part[row, 2], np.stack([part[row, 0], part[row, 1], base + first, base + last - 1 + LENGTH], axis=1)


def cut(with_text: bool):
    """Step 4: what is left of each document of a group."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        group = Group(docs, copies_in(told))
        kinds = told["kind"].to_pylist()
        found = np.frombuffer(b"".join(b for k, b in zip(kinds, told["a"].to_pylist(), strict=True) if k == REPEATED), np.int64).reshape(-1, 4)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        of: dict[tuple[int, int], tuple[int, int]] = {}
        if len(found):
            change = np.flatnonzero(np.concatenate([[True], (found[1:, :2] != found[:-1, :2]).any(1)]))
            for i, j in zip(change.tolist(), [*change[1:].tolist(), len(found)], strict=True):
                of[int(found[i, 0]), int(found[i, 1])] = (i, j)
        sizes, removed, spans, hashes, texts = [], [], [], [], []
        raw = group.data.tobytes()
        for r, p in enumerate(zip(group.ids.tolist(), group.ties.tolist(), strict=True)):
            low, high = int(group.offsets[r]), int(group.offsets[r + 1])
            n = high - low
            if group.copy[r]:
                runs = [(0, n)] if n >= LENGTH else []
            else:
                i, j = of.get(p, (0, 0))
                runs = []
                for a, b in found[i:j, 2:].tolist():
                    if runs and a <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
                    else:
                        runs.append((a, b))
            left, at = [], 0
            for a, b in runs:
                left.append(raw[low + at : low + a])
                at = b
            left.append(raw[low + at : high])
            kept = b"".join(left)
            sizes.append(n)
            removed.append(n - len(kept))
            spans.append(len(runs))
            hashes.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode("utf-8", "ignore"))
        out = {"id": pa.array(group.ids), "tie": pa.array(group.ties), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())}
        if with_text:
            out |= {"row": docs["row"], "kept": pa.array(texts, pa.string())}
        return pa.table(out)

    return run


RESULT = "id bigint, tie bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def remove_repeats(docs: DataFrame, with_text: bool = False, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with text also ``row`` (all columns but the text) and ``kept``.

    Kept bytes that no longer form a character are left out of ``kept``, not out of the hash.
    """
    integer_ids(docs)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    digest, tie_of = F.md5(text), lambda d: F.conv(F.substring(d, 1, 15), 16, 10).cast("bigint")
    ident = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID))
    # copies, and how much text there is: digests in small rows only
    ids = stored(docs.select(ident.alias("id"), digest.alias("digest"), F.octet_length(text).alias("bytes")).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("bytes")))
    total = ids.agg(F.sum(F.col("bytes") * F.col("n"))).first()[0] or 0
    buckets = shuffle_keys(docs.sparkSession, partitions, max(partitions, -(-total // BUCKET_BYTES)))
    groups = shuffle_keys(docs.sparkSession, partitions, max(GROUPS * partitions, -(-total // GROUP_BYTES)))
    rows = docs.select(ident.alias("id"), tie_of(digest).alias("tie"), text.alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")] if with_text else []))
    # what is too short to lose anything meets no other text, and is not shuffled
    short = F.octet_length("text") < LENGTH
    same = rows.filter(short).select(
        "id", F.octet_length("text").cast("bigint").alias("n_bytes"), *[F.lit(0).cast("bigint").alias(c) for c in ("n_removed", "n_spans")], F.sha2("text", 256).alias("kept_sha256"),
        *(["row", F.col("text").alias("kept")] if with_text else []),
    )
    rows = rows.filter(~short).withColumn("key", groups.column("id", "tie"))
    firsts = ids.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    copies = (
        ids.filter(F.col("bytes") >= LENGTH).join(rekeyed(firsts, "digest"), "digest").filter("id <> first")
        .select("id", tie_of(F.col("digest")).alias("tie")).select(groups.column("id", "tie").alias("key"), F.lit(COPY).alias("kind"), "id", "tie", F.lit(None).cast("binary").alias("a"))
    )
    # 1
    asked = rows.select("key", "text").mapInArrow(ask(buckets, sizes), "kind int, key bigint, a binary, b binary, c binary")
    told = checkpointed(asked.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(answer(sizes), "kind int, key bigint, a binary, b binary"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_hashes(told, sizes.often, buckets.count))
    message = lambda df, kind: df.select("key", F.lit(kind).alias("kind"), F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("tie"), "a")
    # 2
    pieces = rows.groupBy("key").cogroup(message(told.filter(F.col("kind") == TELL), TELL).union(copies).groupBy("key")).applyInArrow(carve(buckets, hot, sizes), PIECES)
    # 3
    found = pieces.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(index(sizes), "key bigint, a binary")
    # 4
    schema = T.StructType.fromDDL(RESULT)
    if with_text:
        schema = schema.add("row", rows.schema["row"].dataType).add("kept", "string")
    out = rows.groupBy("key").cogroup(message(found, REPEATED).union(copies).groupBy("key")).applyInArrow(cut(with_text), schema)
    return out.drop("tie").unionByName(same).select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["row", "kept"] if with_text else []))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with what repeats cut out of ``text``, and ``n_chars``, where there is one, counted again. A null text becomes empty."""
    out = remove_repeats(docs, with_text=True)
    new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def op9_suffix_dedup(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
