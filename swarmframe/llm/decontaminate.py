"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised (lower case, ASCII punctuation and white space
are one space) and taken as UTF-8 bytes. A document is contaminated by an item if any
``WINDOW`` bytes of the item (the whole item, if shorter), wherever they begin, align to some
place in the document with at most ``RATE`` edits a byte.

A window of n bytes that aligns with at most e edits shares at least n + 1 - q (e + 1)
q-grams with its counterpart, on at most e + 1 neighbouring diagonals. Shared q-grams are dealt to
bands of diagonals that overlap by half, so some band holds all of them. In a band, sorted by place in the
item, they show the stretches of window starts that reach the count; only these are aligned,
within the band. Windows that begin one byte apart differ by one edit at most, so
a window of d edits too many rules out d - 1 on either side, and few alignments settle a stretch.

Nothing is shuffled: the benchmark's texts go to the documents, up to ``PASS_BYTES`` in one pass, and are
indexed there in blocks. Shared q-grams are worked on ``HITS`` at a time, however often a text repeats itself.

Edge cases: a null or empty text holds nothing; items that normalise to under ``MIN_ITEM`` bytes say too
little to tell a quote from chance and match nothing (``short_items`` lists them); equal items are each reported, rows that
share an item_id (of an integer type, others are refused) are one item with several texts, which go in one pass; a null item_id or text is no item; repeated rows of documents each get their rows,
whatever the type of doc_id; texts of any length are matched whole; an empty table on either side gives an empty
result. Extra columns are carried when documents are filtered, or not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import integer_ids, table

#: Q-grams of 7 bytes: at ``RATE`` edits the lemma's count is positive for every length from ``MIN_ITEM`` on.
Q, WINDOW, RATE, MIN_ITEM = 7, 96, 0.1, 24
GRAM = np.uint64((1 << 8 * Q) - 1)
#: A longer item is cut into pieces of so many bytes, which overlap so that every window lies in one.
PIECE = 4096
#: Bytes of benchmark text per index (a few MB each); times that one q-gram may stand in an index.
BLOCK_BYTES, OFTEN = 1 << 18, 8192
#: Bytes of benchmark text that are broadcast for one pass over the documents.
PASS_BYTES = 32 << 20
#: Bytes of documents that are matched at a time, and shared q-grams that are held at a time.
CHUNK, HITS = 1 << 21, 1 << 20
#: What a window's counterpart and the bands around it can cover of a text.
REACH = WINDOW + 2 * (int(WINDOW * RATE) + 1)
TABLE_BITS, COUNT_BITS = 22, 20
U = np.uint64
BLANK = bytes(ord(" ") if not chr(i).isalnum() else i for i in range(128)) + bytes(range(128, 256))
OUTSIDE = 255  # no byte of UTF-8


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(BLANK).split())


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes from each position on; different bytes have different hashes."""
    if len(buf) < Q:
        return np.zeros(0, U)
    padded = np.append(buf, np.zeros(8 - Q, np.uint8))
    with np.errstate(over="ignore"):
        g = (np.ndarray((len(buf) - Q + 1,), "<u8", padded, strides=(1,)) & GRAM) * U(0x9E3779B97F4A7C15)
    return g ^ (g >> U(32))


def allowed_edits(size: np.ndarray) -> np.ndarray:
    return np.floor(np.minimum(size, WINDOW) * RATE + 1e-9).astype(np.int64)


@dataclass
class Items:
    """Pieces of a block of items, and their q-grams sorted by hash."""

    item: np.ndarray
    offset: np.ndarray  # of a piece in its item
    letters: np.ndarray  # of all pieces, with WINDOW bytes to spare
    begin: np.ndarray  # of a piece in the letters
    size: np.ndarray
    window: np.ndarray
    edits: np.ndarray
    need: np.ndarray
    hashes: np.ndarray  # distinct, sorted
    first: np.ndarray  # where a hash's places begin; one more at the end
    piece: np.ndarray  # of each place
    at: np.ndarray  # of each place, in the piece
    seen: np.ndarray  # by the low bits of a hash
    owner: np.ndarray  # the item that all places of a hash are in, -1 if several
    least: np.ndarray  # least place of a hash in its items


def pieces_of(item: int, text: bytes) -> list[tuple[int, int, bytes]]:
    """(item, offset, bytes)."""
    if len(text) < MIN_ITEM:
        return []
    last = max(len(text) - PIECE, 0)
    return [(item, a, text[a : a + PIECE]) for a in sorted({*range(0, last + 1, PIECE - WINDOW + 1), last})]


def index_of(pieces: list[tuple[int, int, bytes]]) -> Items:
    texts = [t for _, _, t in pieces]
    size = np.array([len(t) for t in texts], np.int64)
    edits = allowed_edits(size)
    window = np.minimum(size, WINDOW)
    grams = [gram_hashes(np.frombuffer(t, np.uint8)) for t in texts]
    h = np.concatenate([np.zeros(0, U), *grams])
    piece = np.repeat(np.arange(len(texts)), [len(g) for g in grams])
    at = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(g)) for g in grams)])
    order = np.argsort(h, kind="stable")
    hashes, first = np.unique(h[order], return_index=True)
    seen = np.zeros(1 << TABLE_BITS, bool)
    seen[(hashes & U((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
    piece, at = piece[order], at[order]
    item, offset = np.array([p[0] for p in pieces], np.int64), np.array([p[1] for p in pieces], np.int64)
    per_hash = lambda f, x: f.reduceat(x, first) if len(first) else x
    low, high = per_hash(np.minimum, item[piece]), per_hash(np.maximum, item[piece])
    return Items(
        item, offset, np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8), np.cumsum(size) - size,
        size, window, edits, window + 1 - Q * (edits + 1), hashes, np.append(first, len(h)), piece, at, seen,
        np.where(low == high, low, -1), per_hash(np.minimum, offset[piece] + at),
    )


@lru_cache(maxsize=8)
def opened(block: bytes) -> Items:
    """The index of a block, kept by a worker while few are in use."""
    return index_of(pickle.loads(block))


def known_grams(buf: np.ndarray, s: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, number of its hash, how many places have it) of every q-gram of the text that some item has."""
    h = gram_hashes(buf)
    i = np.flatnonzero(s.seen[h & U((1 << TABLE_BITS) - 1)])
    k = np.minimum(np.searchsorted(s.hashes, h[i]), len(s.hashes) - 1)
    real = s.hashes[k] == h[i]
    i, k = i[real], k[real]
    return i, k, s.first[k + 1] - s.first[k]


def slices(i: np.ndarray, count: np.ndarray):
    """Ranges of about ``HITS`` shared q-grams. They overlap by ``REACH`` bytes of text, so all of a window's are in one."""
    ends = np.cumsum(count)
    a = 0
    while a < len(i):
        b = int(max(np.searchsorted(ends, ends[a] - count[a] + HITS, "right"), np.searchsorted(i, i[a] + 2 * REACH, "right")))
        yield a, b
        if b >= len(i):
            return
        a = int(np.searchsorted(i, i[b] - REACH))


def stretches(position: np.ndarray, piece: np.ndarray, at: np.ndarray, offsets: np.ndarray, s: Items):
    """Stretches of window starts that reach the count: (text, piece, first diagonal, first start, last start). A diagonal is a position less the place in the piece."""
    diagonal = position - at + PIECE  # not negative
    step = s.edits[piece] + 1
    # bands of twice the step, one set begun half a band later than the other
    for shift in (0, 1):
        band = (diagonal + shift * step) // (2 * step)
        key = (piece << 40) | band
        # counts by a hash of the band come first: they are never too low
        with np.errstate(over="ignore"):
            bucket = ((key.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - COUNT_BITS)).astype(np.int64)
        near = np.flatnonzero(np.bincount(bucket, minlength=1 << COUNT_BITS)[bucket] >= s.need[piece])
        if not len(near):
            continue
        k, a = key[near], at[near]
        t = np.searchsorted(offsets, position[near], "right") - 1
        order = np.lexsort((a, t, k))
        k, a, t = k[order], a[order], t[order]
        # a q-gram of the item counts once however many places of the band share it
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1])
        k, a, t = k[new], a[new], t[new]
        p = k >> 40
        last = np.arange(len(k)) + s.need[p] - 1
        there = np.minimum(last, len(k) - 1)
        low = np.maximum(a[there] - (s.window[p] - Q), 0)
        high = np.minimum(a, s.size[p] - s.window[p])
        full = np.flatnonzero((last < len(k)) & (k[there] == k) & (t[there] == t) & (low <= high))
        if not len(full):
            continue
        k, t, low, high = k[full], t[full], low[full], high[full]
        begins = np.ones(len(k), bool)
        begins[1:] = (k[1:] != k[:-1]) | (t[1:] != t[:-1]) | (low[1:] > high[:-1] + 1)
        b = np.flatnonzero(begins)
        e = np.append(b[1:], len(k)) - 1
        p = k[b] >> 40
        step_b = s.edits[p] + 1
        yield t[b], p, (k[b] & ((1 << 40) - 1)) * 2 * step_b - shift * step_b - PIECE, low[b], high[e]


def banded_distance(buf: np.ndarray, low: np.ndarray, width: int, rows: np.ndarray, size: np.ndarray, floor: np.ndarray, ceil: np.ndarray) -> np.ndarray:
    """Least edits between each row of bytes and any stretch of its text on ``width`` diagonals from ``low`` on.

    Row i of the table is the first i bytes; column d is a diagonal, so the text's byte beside (i, d) is low + i + d.
    floor and ceil bound a text. Bytes outside it equal nothing, and putting one against a byte costs what leaving that out does.
    """
    n, d = len(low), np.arange(width, dtype=np.int16)
    cost = np.zeros((n, width), np.int16)
    best = np.full(n, 1 << 14, np.int16)
    beside = low[:, None] + d
    for i in range(rows.shape[1]):
        at = beside + i
        letter = np.where((at >= floor[:, None]) & (at < ceil[:, None]), buf[np.clip(at, 0, len(buf) - 1)], OUTSIDE)
        new = cost + (letter != rows[:, i, None])
        # a byte of the row without counterpart comes from the next diagonal
        np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
        # a byte of the text without counterpart comes from the diagonal before, along the same row
        cost = (np.minimum.accumulate(new - d, axis=1) + d).astype(np.int16)
        best = np.where(size == i + 1, cost.min(1), best)
    return best


def align(buf: np.ndarray, offsets: np.ndarray, s: Items, found: dict, text: np.ndarray, piece: np.ndarray, low: np.ndarray, start: np.ndarray, last: np.ndarray) -> None:
    """Each stretch's first window within its edits, into ``found``: (text, item) to the least (start in the item, edits)."""
    item = s.item[piece]
    while len(text):
        edits = np.empty(len(text), np.int64)
        for e in np.unique(s.edits[piece]):
            of = np.flatnonzero(s.edits[piece] == e)
            for c in range(0, len(of), 4096):
                r = of[c : c + 4096]
                p, t = piece[r], text[r]
                size = s.window[p]
                rows = s.letters[(s.begin[p] + start[r])[:, None] + np.arange(size.max())]
                edits[r] = banded_distance(buf, low[r] + start[r], 2 * (int(e) + 1), rows, size, offsets[t], offsets[t + 1] - 1)
        over = edits - s.edits[piece]
        for r in np.flatnonzero(over <= 0).tolist():
            k, v = (int(text[r]), int(item[r])), (int(s.offset[piece[r]] + start[r]), int(edits[r]))
            found[k] = min(found.get(k, v), v)
        # windows nearer than what is too much cannot do
        start = start + np.maximum(over, 1)
        live = (over > 0) & (start <= last)
        if found:
            live[live] &= np.array([found.get((a, b), (1 << 62,))[0] >= o + x for a, b, o, x in zip(text[live].tolist(), item[live].tolist(), s.offset[piece[live]].tolist(), start[live].tolist(), strict=True)], bool)
        text, piece, low, start, last, item = (x[live] for x in (text, piece, low, start, last, item))


def chunks(texts: list[str | None]):
    """(number of the first text, all bytes, where the texts begin) of stretches of about ``CHUNK`` bytes; texts lie one byte apart."""
    parts, size, first = [], 0, 0
    for i, t in enumerate(texts):
        parts.append(normalise(t))
        size += len(parts[-1]) + 1
        if size >= CHUNK or i == len(texts) - 1:
            yield first, np.frombuffer(b"\n".join(parts) + b"\n", np.uint8), np.cumsum([0, *(len(p) + 1 for p in parts)])
            parts, size, first = [], 0, i + 1


class Settled:
    """Places of items that can no longer change what is found: those past every window that begins before the one found."""

    def __init__(self, found: dict[tuple[int, int], tuple[int, int]]):
        rows = np.array([(t, item, 0 if v == (0, 0) else v[0] + WINDOW) for (t, item), v in found.items()], np.int64).reshape(-1, 3)
        self.items = np.unique(rows[:, 1])
        key = rows[:, 0] * len(self.items) + np.searchsorted(self.items, rows[:, 1])
        order = np.argsort(key)
        self.key, self.limit = key[order], rows[order, 2]

    def __call__(self, text: np.ndarray, item: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(text), bool)
        number = np.minimum(np.searchsorted(self.items, item), len(self.items) - 1)
        key = text * len(self.items) + number
        k = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.items[number] == item) & (self.key[k] == key) & (at >= self.limit[k])


def found_in(texts: list[str | None], blocks: list[bytes]) -> list[tuple[int, int, int, int]]:
    """(text, item, least start of a window of the item that aligns, its edits) for a batch of texts."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    for first, buf, offsets in chunks(texts):
        for block in blocks:
            s, found = opened(block), {}
            i, k, count = known_grams(buf, s)
            text = np.searchsorted(offsets, i, "right") - 1
            for a, b in slices(i, count):
                settled = Settled(found)
                r = np.arange(a, b)
                r = r[~settled(text[r], s.owner[k[r]], s.least[k[r]])]
                n = count[r]
                ends = np.cumsum(n)
                place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(s.first[k[r]] - (ends - n), n)
                r = np.repeat(r, n)
                if len(found):
                    piece = s.piece[place]
                    open_ = ~settled(text[r], s.item[piece], s.offset[piece] + s.at[place])
                    r, place = r[open_], place[open_]
                for some in stretches(i[r], s.piece[place], s.at[place], offsets, s):
                    align(buf, offsets, s, found, *some)
            for (t, item), v in found.items():
                at = (first + t, item)
                out[at] = min(out.get(at, v), v)
    return [(*k, *v) for k, v in sorted(out.items())]


def blocks_of(items: list[tuple[int, str]], block_bytes: int = BLOCK_BYTES) -> list[bytes]:
    """Items as blocks of bounded size, in which no q-gram stands more than about ``OFTEN`` times."""
    blocks, held, size, often = [], [], 0, 0
    for number, text in items:
        for p in pieces_of(number, normalise(text)):
            most = int(np.unique(gram_hashes(np.frombuffer(p[2], np.uint8)), return_counts=True)[1].max())
            if held and (size + len(p[2]) > block_bytes or often + most > OFTEN):
                blocks.append(pickle.dumps(held))
                held, size, often = [], 0, 0
            held.append(p)
            size, often = size + len(p[2]), often + most
    return [*blocks, pickle.dumps(held)] if held else blocks


def known_items(benchmark: DataFrame) -> DataFrame:
    integer_ids(benchmark, "item_id")
    return benchmark.filter(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")


def short_items(benchmark: DataFrame) -> DataFrame:
    """item_id, text of the items that are too short to be looked for."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([len(normalise(t)) < MIN_ITEM for t in b.column(1).to_pylist()], pa.bool_()))

    known = known_items(benchmark)
    return known.mapInArrow(run, known.schema)


def passes(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES):
    """The benchmark as broadcast lists of blocks, one for each pass over the documents."""
    known = known_items(benchmark)
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // pass_bytes)
    for i in range(parts):
        # all texts of an item go in one pass, so that no document has an item twice
        part = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i) if parts > 1 else known
        yield benchmark.sparkSession.sparkContext.broadcast(blocks_of(sorted((r[0], r[1]) for r in part.collect()), block_bytes))


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """doc_id, item_id, item_from, edits: the items that each document holds (no row for a clean one), where in the normalised item the first window that aligns begins, and its edits."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id bigint, item_from bigint, edits bigint"
    out = None
    for sent in passes(benchmark, block_bytes, pass_bytes):

        def run(batches, sent=sent):
            for b in batches:
                found = found_in(b.column(1).to_pylist(), sent.value)
                columns = list(zip(*found, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "item_id", "item_from", "edits"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, all columns as they are."""
    at = docs.columns.index("text")
    for sent in passes(benchmark, block_bytes, pass_bytes):

        def run(batches, sent=sent):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[f[0] for f in found_in(b.column(at).to_pylist(), sent.value)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op1_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
