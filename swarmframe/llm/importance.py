"""Importance resampling towards a target, by hashed n-grams and an external sort-count.

Features of a text are its runs of one and of two words; a feature is the CRC-32 of its bytes modulo ``BUCKETS``, which fits 16 bits.

1. Every text's buckets are written once, as packed streams of uint16: a row holds many documents and the offsets where each begins.
2. Streams are sorted and run-length encoded block by block; the runs of a task are merged there and tasks meet in one
   aggregate of ``BUCKETS`` keys. The same is done with the target's texts.
3. Gains, one integer per bucket, go to all tasks (``BUCKETS`` numbers, whatever the input), are looked up for whole streams, and ``np.add.reduceat`` sums them
   between document offsets. Texts are not read again.
4. The Gumbel-perturbed scores are ranked by a range sort: each range's rows are counted, and a row's rank is its place in its
   range plus the rows of the ranges before.

A bigram's CRC is not computed from its bytes: that of a concatenation is a linear map (as many zero bytes as the second word and the blank have) of the first
word's, xor the second's, so that all bigrams of a piece of text are four table look-ups.

Edge cases: a null text has no words, no features and a weight of 0; rows that share a doc_id are scored each; a null doc_id is hashed as the empty
string and comes after all others of its score; equal rows keep the order in which they were written; texts of any length are taken whole, in pieces of ``PIECE`` bytes that
end between words; without a target's texts all gains are those of empty counts; an empty table gives an empty result; extra columns are not read; doc_id is of an integer type, others are refused.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import discard, integer_ids, stored, table

BUCKETS = 10_000
MIN_WORDS, DRAWN_PERCENT, SEED = 20, 25, 7
#: Features of a row of streams, about; a document is in one row. Bytes of text that are split at once.
STREAM, PIECE = 1 << 20, 1 << 20
#: Words longer than this have no shift table; their bigrams are hashed as bytes.
LONGEST = 64
REMEMBERED = 200_000

#: ASCII letters to lower case, other ASCII but digits to blanks.
FOLD = bytes(c if c > 127 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def _shifts() -> np.ndarray:
    """shifts[n, k, b]: what a CRC whose k-th byte is b, and others 0, becomes after n zero bytes."""
    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    v = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = [v]
    for _ in range(LONGEST + 1):
        v = (v >> np.uint32(8)) ^ step[v & np.uint32(255)]
        out.append(v)
    return np.stack(out)


SHIFTS = _shifts()


class WordCodes(dict):
    """Word to (CRC of the word, CRC of a blank and the word, bytes of both or 0 if they are too many)."""

    def __missing__(self, word: bytes) -> tuple[int, int, int]:
        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = (zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1 if len(word) <= LONGEST else 0)
        return found


_codes = WordCodes()


def piece_buckets(words: list[bytes], before: bytes | None) -> np.ndarray:
    """Buckets of the words and of the pairs that end in them; ``before`` is the word that precedes them."""
    if not words:
        return np.zeros(0, np.uint16)
    codes = np.array([_codes[w] for w in words], np.uint32).reshape(-1, 3)
    first = codes[:-1, 0]
    if before is not None:
        first = np.concatenate([np.array([_codes[before][0]], np.uint32), first])
        second = codes
    else:
        second = codes[1:]
    n = second[:, 2]
    pairs = second[:, 1] ^ SHIFTS[n, 0, first & 255] ^ SHIFTS[n, 1, first >> 8 & 255] ^ SHIFTS[n, 2, first >> 16 & 255] ^ SHIFTS[n, 3, first >> 24]
    skip = 0 if before is not None else 1
    for i in np.flatnonzero(n == 0):
        pairs[i] = zlib.crc32(b" " + words[i + skip], int(first[i]))
    return (np.concatenate([codes[:, 0], pairs]) % BUCKETS).astype(np.uint16)


def pieces(raw: bytes):
    """Words of a folded text in pieces that end between words."""
    at = 0
    while at < len(raw):
        end = at + PIECE
        if end < len(raw):
            end = raw.find(b" ", end)
            end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def text_buckets(text: str | None) -> tuple[int, np.ndarray]:
    """How many words a text has, and the buckets of its features."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(FOLD)
    n, before, out = 0, None, []
    for words in pieces(raw):
        out.append(piece_buckets(words, before))
        if words:
            n, before = n + len(words), words[-1]
    return n, np.concatenate(out) if out else np.zeros(0, np.uint16)


STREAMS = "ids array<bigint>, n_words array<bigint>, offsets array<bigint>, stream binary"


def streams(docs: DataFrame, key: str) -> DataFrame:
    """Rows of many documents each: their ids, numbers of words, offsets (in features) and the packed stream of their buckets."""

    def run(batches):
        ids, words, offsets, parts, size = [], [], [], [], 0

        def row():
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([words], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64())), pa.array([b"".join(p.tobytes() for p in parts)], pa.binary())]
            for kept in (ids, words, offsets, parts):
                kept.clear()
            return pa.RecordBatch.from_arrays(columns, names=["ids", "n_words", "offsets", "stream"])

        for b in batches:
            texts = b.column(1)
            for i, ident in enumerate(b.column(0).to_pylist()):
                n, found = text_buckets(texts[i].as_py())
                if ids and (size + len(found) > STREAM or len(ids) >= STREAM // 8):
                    yield row()
                    size = 0
                ids.append(ident)
                words.append(n)
                offsets.append(size)
                parts.append(found)
                size += len(found)
        if ids:
            yield row()

    return docs.select(F.col(key).cast("bigint").alias("id"), "text").mapInArrow(run, STREAMS)


def run_lengths(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur and how often, by sorting."""
    s = np.sort(stream, kind="stable")  # a radix sort of 16-bit numbers
    ends = np.append(np.flatnonzero(s[1:] != s[:-1]) + 1, len(s)) if len(s) else np.zeros(0, np.int64)
    return s[ends - 1], np.diff(ends, prepend=0)


def bucket_counts(packed: DataFrame) -> DataFrame:
    """bucket, n: features of all streams."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for x in b.column(0):
                buckets, n = run_lengths(np.frombuffer(x.as_buffer(), np.uint16))
                total[buckets] += n
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return packed.select("stream").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame) -> list[int]:
    """floor(1000 ln ((t + 1) (S + BUCKETS) / ((s + 1) (T + BUCKETS)))) of every bucket. At most ``BUCKETS`` rows of each table come to the driver."""
    s, t = (dict(x.select("bucket", "n").collect()) for x in (source, target))
    all_s, all_t = sum(s.values()) + BUCKETS, sum(t.values()) + BUCKETS
    return [math.floor(1000 * math.log((t.get(b, 0) + 1) * all_s / ((s.get(b, 0) + 1) * all_t))) for b in range(BUCKETS)]


def weights(packed: DataFrame, gain: list[int]) -> DataFrame:
    """id, n_words, n_features, weight of every document of the streams: the floored mean of its features' gains."""
    held = packed.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def run(batches):
        for b in batches:
            for ids, words, offsets, x in zip(b.column(0), b.column(1), b.column(2), b.column(3), strict=True):
                stream, starts = np.frombuffer(x.as_buffer(), np.uint16), np.asarray(offsets.values).astype(np.int64)
                n = np.diff(starts, append=len(stream))
                total = np.zeros(len(starts), np.int64)
                full = n > 0
                if full.any():
                    total[full] = np.add.reduceat(held.value[stream], starts[full])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return packed.mapInArrow(run, "id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int):
    """Gumbel noise of an id, in thousandths: from the first 32 bits of SHA-256 of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resampled(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row: rank is its place among those drawn, null for others.

    ``percent`` of the documents of ``min_words`` words or more are drawn, those of greatest score: without replacement, in proportion to exp(weight / 1000).
    """
    integer_ids(docs)
    packed, wanted = stored(streams(docs, "doc_id")), stored(streams(target.withColumn("none", F.lit(None).cast("bigint")), "none"))
    gain = gains(bucket_counts(packed), bucket_counts(wanted))
    scored = stored(weights(packed, gain).withColumn("score", F.col("weight") + noise(seed)).withColumn("row", F.monotonically_increasing_id()))
    discard(packed, wanted)
    may = scored.filter(F.col("n_words") >= min_words)
    drawn = may.count() * percent // 100
    placed = numbered(may, [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")], "place")
    ranked = placed.select("id", "n_features", "weight", "score", F.when(F.col("place") < drawn, F.col("place") + 1).alias("rank"))
    rest = scored.filter(F.col("n_words") < min_words).select("id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return ranked.unionByName(rest).withColumnRenamed("id", "doc_id")


def op12_importance_resampling(spark, sf_dir):
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
