"""How five filters interact: what each removes in every order, what it alone catches, what it costs.

Texts are scanned in Arrow's own buffers. A table gives each byte its classes (separator, capital, symbol, first byte of a
code point); prefix sums of a class, taken at a text's two ends, give its count. Words begin and end where the separator
class changes. A word's hash is a difference of prefix sums of byte values times powers of an odd number, moved to the
origin by the inverse power, so that all words of a block are hashed at once; the hashes are sorted per document, neighbours of
equal hash are compared byte by byte, and what differs from its neighbour is a distinct word. (Where the bytes differ in spite of
the hash, that document's words are put into a set.) Each document keeps a mask of the filters that it fails, and
everything after that is sums over masks: 32 rows a part, whatever the order of the filters.

A text is identical to an earlier one if a smaller doc_id has it: the least doc_id of a text is found by partial
aggregates of digests (SHA-256), so that a text with many copies is no task's own.

Edge cases: a null text is empty; a null source is the part ``""``; a null doc_id is not smaller than any and has none smaller, so such rows
never fail E; rows that share a doc_id and a text are no copies of each other; several labels of one doc_id count as good (or toxic)
if any of them is; a text without words fails A only; texts of any length are scanned whole, in blocks of ``BLOCK`` bytes;
an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, rekeyed, stored, table

#: Filters in the order of their bits.
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 2
#: Bytes and texts scanned at once. Hashes are sorted with the text's number in their upper 16 bits.
BLOCK, BLOCK_TEXTS = 1 << 20, 1 << 16
SEPARATOR, CAPITAL, SYMBOL, FOLLOWS = 1, 2, 4, 8
U = np.uint64

CLASSES = np.zeros(256, np.uint8)
CLASSES[[0x20, *range(0x09, 0x0E)]] |= SEPARATOR
CLASSES[65:91] |= CAPITAL
CLASSES[list(b"#$%&*|")] |= SYMBOL
CLASSES[0x80:0xC0] |= FOLLOWS

VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=U) | U(1)
BASE = 0x9E3779B97F4A7C15


class Powers:
    """Powers of ``BASE`` and of its inverse modulo 2^64, as many as have been asked for."""

    def __init__(self):
        self.up = self.down = np.ones(0, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                steps = np.full(n, U(BASE))
                steps[0] = 1
                self.up = np.cumprod(steps)
                steps[1:] = U(pow(BASE, -1, 1 << 64))
                self.down = np.cumprod(steps)
        return self.up[:n], self.down[:n]


_powers = Powers()


def sums(hits: np.ndarray) -> np.ndarray:
    """Prefix sums with a zero in front."""
    out = np.zeros(len(hits) + 1, np.int64)
    np.cumsum(hits, out=out[1:])
    return out


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each stretch, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def words_of(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of all words of texts that lie end to end in ``raw``, text i from ends[i] to ends[i + 1]."""
    blank = (CLASSES[raw] & SEPARATOR).astype(bool)
    cut = np.ones(len(raw) + 1, bool)
    cut[1:-1] = blank[:-1]
    cut[ends] = True
    starts = np.flatnonzero(~blank & cut[:-1])
    cut[1:-1] = blank[1:]
    cut[ends] = True
    stops = np.flatnonzero(~blank & cut[1:]) + 1
    return starts, stops - starts, np.searchsorted(ends, starts, "right") - 1


def first_of_each(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of one word of each kind of each owner, and the owners for which hashes do not tell: words of equal hash and other bytes."""
    up, down = _powers.upto(len(raw) + 1)
    with np.errstate(over="ignore"):
        run = np.zeros(len(raw) + 1, U)
        np.cumsum(VALUES[raw] * up[:-1], out=run[1:])
        hashes = (run[starts + lengths] - run[starts]) * down[starts]
    key = (owner.astype(U) << U(48)) | (hashes >> U(16))
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    a, b = order[same], order[same + 1]
    unlike = lengths[a] != lengths[b]
    n = np.where(unlike, 0, lengths[a])
    wrong = raw[spread(starts[a], n)] != raw[spread(starts[b], n)]
    if wrong.any():
        unlike |= np.bincount(np.repeat(np.arange(len(n)), n)[wrong], minlength=len(n)) > 0
    new = np.ones(len(order), bool)
    new[same + 1] = False
    return order[new], np.unique(owner[a[unlike]])


def block_counts(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words, distinct words, capitals, symbols and code points (columns) of texts that lie end to end."""
    kinds = CLASSES[raw]
    between = lambda hits: np.diff(sums(hits)[ends])
    starts, lengths, owner = words_of(raw, ends)
    n = len(ends) - 1
    chosen, doubtful = first_of_each(raw, starts, lengths, owner)
    distinct = np.bincount(owner[chosen], minlength=n)
    for i in doubtful:
        distinct[i] = len(set(raw[ends[i] : ends[i + 1]].tobytes().split()))
    return np.stack([np.bincount(owner, minlength=n), distinct, between(kinds & CAPITAL > 0), between(kinds & SYMBOL > 0), between(kinds & FOLLOWS == 0)], axis=1)


def next_blank(raw: np.ndarray, at: int) -> int:
    """The first separator from ``at`` on, or the end."""
    for start in range(at, len(raw), BLOCK):
        found = np.flatnonzero(CLASSES[raw[start : start + BLOCK]] & SEPARATOR)
        if len(found):
            return start + int(found[0])
    return len(raw)


def long_counts(raw: np.ndarray) -> np.ndarray:
    """The same of one text of any length, in blocks of whole words. It keeps its distinct words; of a word that fills a block, length and digest."""
    total, seen, at = np.zeros(5, np.int64), set(), 0
    for start in range(0, len(raw), BLOCK):
        kinds = CLASSES[raw[start : start + BLOCK]]
        total[2:] += [np.count_nonzero(kinds & CAPITAL), np.count_nonzero(kinds & SYMBOL), np.count_nonzero(kinds & FOLLOWS == 0)]
    known = lambda word: word if len(word) < BLOCK else (len(word), hashlib.sha256(word).digest())
    while at < len(raw):
        block = raw[at : at + BLOCK]
        if at + len(block) < len(raw):
            blanks = np.flatnonzero(CLASSES[block] & SEPARATOR)
            if not len(blanks):
                end = next_blank(raw, at)
                seen.add(known(memoryview(raw[at:end])))
                total[0] += 1
                at = end
                continue
            block = block[: blanks[-1] + 1]
        starts, lengths, owner = words_of(block, np.array([0, len(block)]))
        total[0] += len(starts)
        chosen, doubtful = first_of_each(block, starts, lengths, owner)
        if len(doubtful):
            chosen = np.arange(len(starts))
        whole = block.tobytes()
        seen.update(known(whole[s : s + n]) for s, n in zip(starts[chosen].tolist(), lengths[chosen].tolist(), strict=True))
        at += len(block)
    total[1] = len(seen)
    return total


def counts(texts: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """One row of counts for each text, as in ``block_counts``, and the texts' digests."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    out, view, i = np.zeros((len(texts), 5), np.int64), memoryview(raw), 0
    while i < len(texts):
        if ends[i + 1] - ends[i] > BLOCK:
            out[i] = long_counts(raw[ends[i] : ends[i + 1]])
            i += 1
            continue
        j = min(int(np.searchsorted(ends, ends[i] + BLOCK, "right")) - 1, i + BLOCK_TEXTS)
        out[i:j] = block_counts(raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
        i = j
    return out, [hashlib.sha256(view[a:b]).digest() for a, b in itertools.pairwise(ends.tolist())]


def masks(found: np.ndarray) -> np.ndarray:
    """Bits of A to D that each row of counts fails."""
    words, distinct, capitals, symbols, points = found.T
    fails = (words < MIN_WORDS, 100 * distinct < MIN_DISTINCT_PERCENT * words, 100 * capitals > MAX_CAPITAL_PERCENT * points, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (of A to D), digest of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            found, digests = counts(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks(found), pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text").mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (of all filters), n, n_good, n_toxic: documents by what they fail."""
    one = lambda c: F.coalesce(F.max(F.when(F.col(c) == 1, 1)), F.lit(0))
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = stored(scanned(docs).groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n")))
    known = rows.filter("doc_id is not null").join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    known = known.unionByName(rows.filter("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    # of each text: how many rows there are by part and marks, and how many of these have the least id of their kind
    kinds = known.groupBy("digest", "part", "mask", "good", "toxic", F.col("doc_id").isNull().alias("nameless")).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least")
    )
    kinds = stored(kinds)
    discard(rows)
    least = kinds.filter("not nameless").groupBy("digest").agg(F.min("least").alias("first"), F.sum("n").alias("copies")).filter("copies > 1").drop("copies")
    judged = kinds.join(rekeyed(least, "digest"), "digest", "left")
    first = F.when(F.col("nameless") | F.col("first").isNull(), F.col("n")).when(F.col("least") == F.col("first"), F.coalesce("n_least", F.lit(0))).otherwise(0)
    both = judged.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask"), first.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - first).alias("n")))).alias("x"))
    both = both.select("part", "good", "toxic", "x.mask", "x.n").filter("n > 0")
    return both.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def steps() -> list[tuple[str, int, int, int]]:
    """filter_order, step, the bit of its filter and those of the filters before it, for all orders."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[k] for k in order), 0
        for step, k in enumerate(order, 1):
            out.append((name, step, 1 << k, before))
            before |= 1 << k
    return out


def interactions(found: DataFrame) -> DataFrame:
    """What every filter does at every step of every order. found: part, mask, n, n_good, n_toxic; at most 32 rows a part meet 600 steps."""
    every = F.explode(F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(w).alias("before")) for o, s, b, w in steps()])).alias("s")
    rows = found.select("*", every).select("part", "mask", "n", "n_good", "n_toxic", "s.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda value, when: F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")
    done = rows.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~fails & ~earlier).alias("kept"), total("n", fails & ~earlier).alias("removed"), total("n", fails & earlier).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"), total("n_good", fails & ~earlier).alias("good_lost"), total("n_toxic", fails & ~earlier).alias("toxic_lost"),
    )
    shares = done.groupBy("part", "bit").agg(F.sum("removed").alias("shapley"))
    return done.join(shares, ["part", "bit"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_filter_audit(spark, sf_dir):
    return interactions(stored(mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))))


OP13_SQL = r"""
with words as (
  select doc_id, coalesce(source, '') part, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), firsts as (select text, min(doc_id) least from words group by text),
marks as (select doc_id, max(case when quality = 1 then 1 else 0 end) good, max(case when toxic = 1 then 1 else 0 end) toxic from labels group by doc_id),
failed as (
  select part, coalesce(good, 0) good, coalesce(toxic, 0) toxic,
    (case when len(w) < 200 then 1 else 0 end) + (case when 100 * len(list_distinct(w)) < 50 * len(w) then 2 else 0 end)
    + (case when 100 * length(regexp_replace(words.text, '[^A-Z]', '', 'g')) > 2 * length(words.text) then 4 else 0 end)
    + (case when regexp_matches(words.text, '[#$%&*|]') then 8 else 0 end) + (case when words.doc_id > least then 16 else 0 end) mask
  from words join firsts on words.text = firsts.text left join marks on words.doc_id = marks.doc_id
), found as (select part, mask, count(*) n, sum(good) n_good, sum(toxic) n_toxic from failed group by part, mask),
letters(l, b) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders as (
  select p.l || q.l || r.l || s.l || t.l filter_order, [p.b, q.b, r.b, s.b, t.b] bits
  from letters p, letters q, letters r, letters s, letters t where p.b + q.b + r.b + s.b + t.b = 31 and len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5
), steps as (
  select filter_order, cast(step as integer) step, bits[step] bit, cast(coalesce(list_sum(bits[1:step - 1]), 0) as integer) "before"
  from orders, (select unnest(range(1, 6)) step)
), done as (
  select part, filter_order, step, bit,
    sum(case when (mask & (bit | "before")) = 0 then n else 0 end) kept, sum(case when (mask & bit) <> 0 and (mask & "before") = 0 then n else 0 end) removed,
    sum(case when (mask & bit) <> 0 and (mask & "before") <> 0 then n else 0 end) redundant, sum(case when mask = bit then n else 0 end) unique_fails,
    sum(case when (mask & bit) <> 0 and (mask & "before") = 0 then n_good else 0 end) good_lost, sum(case when (mask & bit) <> 0 and (mask & "before") = 0 then n_toxic else 0 end) toxic_lost
  from found, steps group by part, filter_order, step, bit
)
select part, filter_order, step, cast(kept as bigint) kept, cast(removed as bigint) removed, cast(redundant as bigint) redundant, cast(unique_fails as bigint) unique_fails,
  cast(good_lost as bigint) good_lost, cast(toxic_lost as bigint) toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) shapley
from done
"""
