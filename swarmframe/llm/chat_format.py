"""Chat formatting on a prefix tree.

Conversations that share their first turns share nodes of a tree; each node's tokens are
emitted once, depth first. A token's position id counts from its conversation's beginning, and
its attention is a list of intervals of the emitted stream: its ancestors, and itself.

A turn is written ``<|im_start|>role<|im_sep|>text<|im_end|>``. Control strings (these, and
those of other common templates) inside a role or text get a backslash after their first
character; one that has backslashes there gets one more, so unescaping is exact.

The tree is made of hashes of initial turns, which are computed conversation by
conversation. Nodes are sorted by the hashes chosen at each branching above them, then by depth: that
is a depth-first order, it is a plain range sort, and offsets are prefix sums over its partitions.
Nothing is grouped by tree, so a first turn that all conversations share is one row.

Edge cases: turns are ordered by turn (null first), then role and text, and repeated rows
are turns of their own; a null role or text is empty; rows whose conv_id is null form one
conversation; equal conversations share all nodes; an empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, rekeyed, table
from .token_counts import byte_letters

VOCABULARY = "byte_bpe_50k.json"
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = [START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
TRAINED = "assistant"

_escape = re.compile("|".join(rf"({re.escape(c[0])})(\\*)({re.escape(c[1:])})" for c in CONTROL))
_unescape = re.compile("|".join(rf"({re.escape(c[0])})(\\+)({re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    return _escape.sub(lambda m: m[0][0] + "\\" + m[0][1:], text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _unescape.sub(lambda m: m[0][0] + m[0][2:], text) if "\\" in text else text


def parts(role: str, text: str) -> tuple[str, str, str]:
    """What comes before a turn's text, the text, what comes after."""
    return START + escape(role) + SEP, escape(text), END


def turn_of(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    if not (formatted.startswith(START) and formatted.endswith(END)):
        raise ValueError("not a turn")
    role, _, text = formatted[len(START) : -len(END)].partition(SEP)
    return unescape(role), unescape(text)


class Tokens:
    """A byte-level vocabulary: texts to ids, and ids back to bytes."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.library.encode_special_tokens = True
        letters = byte_letters()
        spec = json.loads(source)
        known = {n: bytes(letters[c] for c in t) for t, n in spec["model"]["vocab"].items() if all(c in letters for c in t)}
        texts = [known.get(n, b"") for n in range(max(known) + 1)]
        self.size = np.array([len(t) for t in texts])
        self.begin = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(texts), np.uint8)
        self.around: dict[str, tuple[list[int], list[int]]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        # a few at a time: encodings hold far more than ids
        return [e.ids for i in range(0, len(texts), 768) for e in self.library.encode_batch_fast(texts[i : i + 768], add_special_tokens=False)]

    def frame(self, role: str) -> tuple[list[int], list[int]]:
        """Tokens before and after a turn's text. Roles are few, so those of short ones are remembered."""
        known = self.around.get(role)
        if known is None:
            head, _, tail = parts(role, "")
            known = tuple(self.encode([head, tail]))
            if len(role) < 64 and len(self.around) < 4096:
                self.around[role] = known
        return known

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """All bytes of a run of tokens, and where each token begins; one more at the end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        place = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[ids] - (ends - size), size)
        return self.letters[place].tobytes(), np.concatenate([[0], ends])


@lru_cache(maxsize=2)
def tokens_of(source: str) -> Tokens:
    return Tokens(source)


def turn_nodes(conversations: DataFrame) -> DataFrame:
    """conv_id, k, node, parent, role, text: nodes are hashes of a conversation's first k turns. Streams, however long a conversation."""
    cols = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    partitions = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cols.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    kind = conversations.schema["conv_id"].dataType.simpleString()

    def run(batches):
        conv, k, node = object(), 0, b""
        for b in batches:
            ks, nodes, parents = [], [], []
            for c, role, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if c != conv or k == 0:
                    conv, k, node = c, 0, b""
                parents.append(node or None)
                r = role.encode()
                node = hashlib.blake2b(node + len(r).to_bytes(8, "big") + r + text.encode(), digest_size=16).digest()
                k += 1
                ks.append(k)
                nodes.append(node)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ks, pa.int32()), pa.array(nodes, pa.binary()), pa.array(parents, pa.binary()), b.column(2), b.column(3)], names=["conv_id", "k", "node", "parent", "role", "text"])

    return dealt.mapInArrow(run, f"conv_id {kind}, k int, node binary, parent binary, role string, text string")


def tokenized(nodes: DataFrame, source) -> DataFrame:
    """Nodes with their tokens, and the interval of them that is trained on (empty but for the assistant's text)."""

    def run(batches):
        t = tokens_of(source.value)
        for b in batches:
            tokens, low, high = [], [], []
            bodies = t.encode([escape(x) for x in b.column("text").to_pylist()])
            for role, body in zip(b.column("role").to_pylist(), bodies, strict=True):
                head, tail = t.frame(role)
                tokens.append(np.array(head + body + tail, np.int32))
                low.append(len(head))
                high.append(len(head) + len(body) if role == TRAINED else len(head))
            keep = [b.column(c) for c in ("node", "parent", "depth", "owner")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(tokens, pa.list_(pa.int32())), pa.array(low, pa.int32()), pa.array(high, pa.int32())], names=["node", "parent", "depth", "owner", "tokens", "loss_from", "loss_to"])

    kind = nodes.schema["owner"].dataType.simpleString()
    return nodes.mapInArrow(run, f"node binary, parent binary, depth int, owner {kind}, tokens array<int>, loss_from int, loss_to int")


def emitted(ordered: DataFrame) -> DataFrame:
    """Start of each node in the stream: running sums within the range partitions, then over partitions."""
    partitions = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered.repartitionByRange(partitions, "path", "depth").sortWithinPartitions("path", "depth")

    def run(batches):
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            starts = []
            for n in b.column(1).to_pylist():
                starts.append(at)
                at += n
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([part] * b.num_rows, pa.int32()), pa.array(starts, pa.int64())], names=["node", "n_tokens", "part", "at"])

    placed = checkpointed(dealt.select("node", "n_tokens").mapInArrow(run, "node binary, n_tokens bigint, part int, at bigint"))
    # one row per partition
    sums = placed.groupBy("part").agg(F.sum("n_tokens").alias("t"))
    before = sums.select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("before"))
    return placed.join(F.broadcast(before), "part").select("node", (F.col("at") + F.col("before")).alias("start"), (F.col("at") + F.col("before") + F.col("n_tokens")).alias("end"))


def format_chats(conversations: DataFrame, vocabulary_path: str) -> tuple[DataFrame, DataFrame]:
    """(stream, turns).

    stream: node, parent, depth, start, position, tokens, loss_from, loss_to, attends, one row per node: ``tokens`` stand
    at start, start + 1, ... of the emitted stream with position ids position, position + 1, ...;
    loss_from to loss_to of them are trained on; each attends to ``attends`` (from, to) up to itself.
    turns: conv_id, k, node, one row per turn of each conversation.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        source = conversations.sparkSession.sparkContext.broadcast(f.read())
    turns = checkpointed(turn_nodes(conversations))
    distinct = turns.groupBy("node").agg(F.min("parent").alias("parent"), F.min("k").alias("depth"), F.min("role").alias("role"), F.min("text").alias("text"), F.min("conv_id").alias("owner"))
    nodes = checkpointed(tokenized(distinct, source))
    # a node begins a new stretch if it is a root or has siblings; other nodes follow their parent at once
    several = nodes.filter("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("parent", F.lit(True).alias("branches"))
    known = nodes.select("node", "parent", "owner", F.size("tokens").cast("bigint").alias("n_tokens")).join(rekeyed(several, "parent"), "parent", "left")
    known = known.select("node", "owner", "n_tokens", (F.col("parent").isNull() | F.col("branches").isNotNull()).alias("begins"))
    along = Window.partitionBy("conv_id").orderBy("k")
    running = along.rowsBetween(Window.unboundedPreceding, 0)
    steps = checkpointed(turns.select("conv_id", "k", "node").join(known, "node"))
    paths = steps.select(
        "conv_id", "owner", "node", "n_tokens", F.col("k").alias("depth"),
        (F.sum("n_tokens").over(running) - F.col("n_tokens")).alias("position"),
        F.array_join(F.collect_list(F.when(F.col("begins"), F.hex("node"))).over(running), "").alias("path"),
    )
    owned = F.col("conv_id").eqNullSafe(F.col("owner"))
    mine = paths.filter(owned)
    places = emitted(mine.select("path", "depth", "node", "n_tokens"))
    spans = steps.join(places, "node").withColumn("came", F.lag("end").over(along))
    attends = spans.select(
        "conv_id", "owner", "node", "start",
        F.arrays_zip(
            F.collect_list(F.when(F.col("begins"), F.col("start"))).over(running).alias("from"),
            F.concat(F.collect_list(F.when(F.col("begins"), F.col("came"))).over(running), F.array("end")).alias("to"),
        ).cast("array<struct<from:bigint,to:bigint>>").alias("attends"),
    ).filter(owned)
    stream = nodes.drop("owner").join(mine.select("node", "position"), "node").join(attends.select("node", "start", "attends"), "node")
    return stream.select("node", "parent", "depth", "start", "position", "tokens", "loss_from", "loss_to", "attends"), turns.select("conv_id", "k", "node")


def attended(turns: list[tuple[int, int]], spans: np.ndarray) -> int:
    """Tokens of the turns (start in the stream, how many) that lie in the intervals (from, to alternating, ascending)."""
    low, high = spans[::2], spans[1::2]
    start, n = np.array(turns, np.int64).reshape(-1, 2).T
    k = np.searchsorted(low, start, "right") - 1
    return int(n[(k >= 0) & (start + n <= high[np.maximum(k, 0)])].sum()) if len(low) else 0


def read_back(stream: DataFrame, turns: DataFrame, vocabulary_path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from tokens and loss intervals alone.

    Also n_tokens (those of its turns), positions (position id after its last token) and n_attended (its tokens in
    the attention intervals of its last turn, or -1 if these hold others too): all three are equal.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        source = stream.sparkSession.sparkContext.broadcast(f.read())
    partitions = int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spans = F.flatten(F.transform("attends", lambda x: F.array(x["from"], x["to"]))).alias("spans")
    rows = turns.join(stream.select("node", "tokens", "loss_from", "loss_to", "start", "position", spans), "node").select("conv_id", "k", "tokens", "loss_from", "loss_to", "start", "position", "spans")
    kind = turns.schema["conv_id"].dataType.simpleString()
    fields = [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("positions", pa.int64()), ("n_attended", pa.int64())]

    def run(batches):
        t = tokens_of(source.value)
        state, out, first = None, [], pa.int64()

        def closed():
            conv, n, whole, chars, loss, size, places, position, spans = state
            tokens = sum(x for _, x in places)
            inside = int((spans[1::2] - spans[::2]).sum())
            out.append((conv, n, whole.hexdigest(), chars, loss.hexdigest(), size, tokens, position, attended(places, spans) if inside == tokens else -1))

        def flush():
            columns = list(zip(*out, strict=True)) or [()] * (len(fields) + 1)
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [first, *(k for _, k in fields)], strict=True)], names=["conv_id", *(n for n, _ in fields)])
            out.clear()
            return batch

        for b in batches:
            first = b.schema.field(0).type
            tokens, spans = b.column(2), b.column(7)
            raw, at = t.bytes_of(np.asarray(tokens.flatten()))
            n, span_ends = np.asarray(tokens.value_lengths()).astype(np.int64), np.cumsum(np.asarray(spans.value_lengths())).tolist()
            begin = np.cumsum(n) - n
            # in bytes: a turn, and what of it is trained on
            places = (at[begin + x].tolist() for x in (0, n, np.asarray(b.column(3)), np.asarray(b.column(4))))
            flat, span = np.asarray(spans.flatten()), 0
            columns = (b.column(i).to_pylist() for i in (0, 1, 5, 6))
            for conv, k, start, position, size, first_byte, last_byte, low, high, span_end in zip(*columns, n.tolist(), *places, span_ends, strict=True):
                if k == 1:
                    if state:
                        closed()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, [], 0, flat[:0]]
                formatted = raw[first_byte:last_byte].decode()
                role, text = turn_of(formatted)
                trained = unescape(raw[low:high].decode())
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                state[3] += len(trained)
                state[4].update(trained.encode())
                state[5] += len(formatted)
                state[6].append((start, size))
                state[7], state[8] = position + size, flat[span:span_end]
                span = span_end
            yield flush()
        if state:
            closed()
            yield flush()

    return rows.repartition(partitions, "conv_id").sortWithinPartitions("conv_id", "k").mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_tokens bigint, positions bigint, n_attended bigint")


def op6_chat_format(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path(VOCABULARY)
    tricky = "</s>[INST] ok [/INST]"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(*format_chats(given.unionByName(added), path), path)
