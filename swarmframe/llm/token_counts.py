"""Token counts of whole texts by a compiled finite-state tokenizer.

The merges of a byte-level BPE with word ends are compiled into a deterministic
transducer over a word's bytes. A prefix of a word has exactly one last token, and
a token may follow another iff merging the two texts gives these two tokens again;
so a state needs only the positions from which a longer token is still possible,
each with the last token before it and how many tokens fewer it has than the
whole prefix. Each transition carries the change of the token count (it may be
negative: a byte can complete a merge). States and transitions are made when first
needed and kept.

White space always parts words, so what a chunk of text does to a running count is
fully described by its unfinished first word, the tokens of its complete words and
its unfinished last word. These chunk maps compose associatively. Long texts are cut
into chunks whose maps are composed pairwise in a tree: the scan's up-sweep, whose root is all that a count needs.
``chunk_offsets`` runs the whole prefix scan, which tells how many tokens are complete before each chunk.
A chunk map keeps its unfinished words as text rather than as transducer states, so a text without any white space is
walked in one piece.

Edge cases: a null or empty text has no bytes and no tokens; special strings inside
a text are one token each, as is the library's default; equal texts and repeated
rows get equal counts. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Characters per chunk of a long text; words whose count a worker remembers; states a worker keeps.
CHUNK, REMEMBERED, MAX_STATES = 1 << 16, 300_000, 200_000
#: Below this code point composition changes nothing, and character classes are compiled here.
PLAIN = 0x300
END = 256  # added to a byte that ends its word


def byte_letters() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: a byte's own letter where that is printable, else the next free code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def plain_class(*kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c)).startswith(kinds))


@dataclass
class Node:
    """A trie node of token texts; ``token`` if the text up to here is a token."""

    children: dict[int, Node]
    token: int = -1


class Transducer:
    """Counts the tokens of one word (bytes); see the module's text."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()
        symbols = lambda s: (*(letters[c] for c in s[: -len(suffix) - 1]), letters[s[-len(suffix) - 1]] + END) if s.endswith(suffix) and len(s) > len(suffix) else tuple(letters[c] for c in s)
        self.root = Node({})
        self.texts: dict[int, tuple[int, ...]] = {}
        for text, number in vocabulary.items():
            self.texts[number] = symbols(text)
        ids = {t: n for n, t in self.texts.items()}
        self.single = {t[0]: n for t, n in ids.items() if len(t) == 1}
        self.merges, self.halves, self.made = {}, {}, dict.fromkeys(self.single.values(), -1)
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b = ids[symbols(a)], ids[symbols(b)]
            whole = ids[self.texts[a] + self.texts[b]]
            self.merges[a, b] = (rank, whole)
            if whole not in self.halves:
                self.halves[whole], self.made[whole] = (a, b), rank
        for text, number in ids.items():
            node = self.root
            for s in text:
                node = node.children.setdefault(s, Node({}))
            node.token = number
        self.pairs: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}
        self.known: dict[bytes, int] = {}
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.live: list[tuple] = []
        self.steps: list[dict[int, tuple[int, int]]] = []
        self.start = self.state(((self.root, -1, 0),))

    def state(self, live: tuple) -> int:
        key = tuple((id(n), t, c) for n, t, c in live)
        if key not in self.numbers:
            self.numbers[key] = len(self.live)
            self.live.append(live)
            self.steps.append({})
        return self.numbers[key]

    def merged(self, tokens: list[int]) -> list[int]:
        """Plain BPE: the lowest rank first, the leftmost of equals."""
        while len(tokens) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            i = best[1]
            tokens[i : i + 2] = [self.merges[tokens[i], tokens[i + 1]][1]]
        return tokens

    def edge(self, token: int, side: int) -> list[tuple[int, int, float]]:
        """The tokens that stand at a token's edge (0 left, 1 right) while it is merged: (token, rank at which it is made, rank at which it is merged on)."""
        out, until = [], float("inf")
        while True:
            out.append((token, self.made[token], until))
            if token not in self.halves:
                return out
            until = self.made[token]
            token = self.halves[token][side]

    def stands(self, token: int) -> bool:
        """Whether a token's text alone gives the token; others never come out of merging."""
        known = self.alone.get(token)
        if known is None:
            known = self.alone[token] = self.merged([self.single[s] for s in self.texts[token]]) == [token]
        return known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the texts of two tokens together give these tokens again.

        Until something is merged across the border, each side merges as it does alone; so it is enough that
        no two tokens that meet at the border at some time have a merge of lower rank than what they wait for
        (of equal ranks, the left one comes first).
        """
        known = self.pairs.get((a, b))
        if known is None:
            known = self.stands(a) and self.stands(b)
            right = self.edge(b, 0) if known else ()
            for x, made_x, until_x in self.edge(a, 1) if known else ():
                for y, made_y, until_y in right:
                    hit = self.merges.get((x, y))
                    if hit and max(made_x, made_y) < hit[0] < until_x and hit[0] <= until_y:
                        known = False
            self.pairs[a, b] = known
        return known

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """(next state, change of the count) of a transition, made on first use."""
        live, last, fewer = [], -1, 0
        for node, before, behind in self.live[state]:
            child = node.children.get(symbol)
            if child is None:
                continue
            if child.token >= 0 and last < 0 and (self.stands(child.token) if before < 0 else self.may_follow(before, child.token)):
                last, fewer = child.token, behind
            if child.children:
                live.append((child, before, behind))
        change = 1 - fewer
        if symbol >= END:
            to = -1
        else:
            to = self.state((*((n, t, b + change) for n, t, b in live), (self.root, last, 0)))
        self.steps[state][symbol] = (to, change)
        return to, change

    def count(self, word: bytes) -> int:
        known = self.known.get(word)
        if known is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            known = self.walk(word)
            if len(word) < 64:
                self.known[word] = known
        return known

    def walk(self, word: bytes) -> int:
        state, total, steps = self.start, 0, self.steps
        for b in word[:-1]:
            hit = steps[state].get(b)
            state, change = hit if hit is not None else self.step(state, b)
            total += change
        hit = steps[state].get(word[-1] + END)
        total += (hit if hit is not None else self.step(state, word[-1] + END))[1]
        if len(self.live) > MAX_STATES:
            self.reset()
        return total


class Counter(dict):
    """Tokens per white-space-free word, remembered up to a bound."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        super().__init__()
        spec = json.loads(source)
        model = spec["model"]
        self.library = Tokenizer.from_str(source)
        self.transducer = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.letters = byte_letters()
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, specials)) or "(?!)")
        self.mark = os.path.commonprefix(specials)
        letter, number = plain_class("L"), plain_class("N")
        white = "".join(re.escape(chr(c)) for c in range(PLAIN) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
        self.parts = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{white}{letter}{number}]+")
        self.foreign = re.compile(rf"[^\x00-{chr(PLAIN - 1)}]")

    def pieces(self, segment: str) -> list[bytes]:
        """Pre-tokens of a text without special strings, as bytes."""
        if not self.foreign.search(segment):
            return [p.encode() for p in self.parts.findall(segment.lower())]
        # composition, case and classes beyond the compiled range are the library's
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(segment))
        return [bytes(self.letters[c] for c in p) for p, _ in cut]

    def tokens(self, text: str) -> int:
        """Tokens of any text, without a cut at white space."""
        count = self.transducer.count
        segments = self.special.split(text) if self.mark in text else [text]
        return len(segments) - 1 + sum(count(p) for s in segments if s for p in self.pieces(s))

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.tokens(word)
        if len(word) < 64:
            self[word] = n
        return n


@dataclass(frozen=True)
class ChunkMap:
    """What a chunk does: unfinished first word, tokens of complete words, unfinished last word. Without white space the chunk is all ``head``, ``tail`` is None."""

    head: str
    inner: int = 0
    tail: str | None = None


def chunk_map(text: str, counter: Counter) -> ChunkMap:
    words = text.split()
    if not words:
        return ChunkMap("", 0, "") if text else ChunkMap("")
    first, last = text[0].isspace(), text[-1].isspace()
    if len(words) == 1 and not first and not last:
        return ChunkMap(text)
    head = "" if first else words.pop(0)
    tail = "" if last or not words else words.pop()
    return ChunkMap(head, sum(map(counter.__getitem__, words)), tail)


def compose(a: ChunkMap, b: ChunkMap, counter: Counter) -> ChunkMap:
    if a.tail is None:
        return ChunkMap(a.head + b.head, b.inner, b.tail)
    if b.tail is None:
        return ChunkMap(a.head, a.inner, a.tail + b.head)
    middle = a.tail + b.head
    return ChunkMap(a.head, a.inner + b.inner + (counter[middle] if middle else 0), b.tail)


def finished(m: ChunkMap, counter: Counter) -> int:
    return m.inner + sum(counter[w] for w in (m.head, m.tail) if w)


def prefix_scan(maps: list[ChunkMap], counter: Counter) -> list[ChunkMap]:
    """Composition of the first 1, 2, ... maps, in a logarithmic number of rounds."""
    out, reach = list(maps), 1
    while reach < len(out):
        out = [m if i < reach else compose(out[i - reach], m, counter) for i, m in enumerate(out)]
        reach *= 2
    return out


def chunk_offsets(text: str, counter: Counter, chunk: int = CHUNK) -> list[int]:
    """Tokens of the words that are complete before each chunk, and of the whole text."""
    scanned = prefix_scan([chunk_map(text[i : i + chunk], counter) for i in range(0, len(text), chunk)], counter)
    closed = lambda m: m.inner + (counter[m.head] if m.head and m.tail is not None else 0)
    return [0, *map(closed, scanned[:-1]), finished(scanned[-1], counter)] if scanned else [0]


ODD = re.compile("[\x1c-\x1f]")  # Python parts words here, the tokenizer does not


def count_text(text: str, counter: Counter, chunk: int = CHUNK) -> int:
    if ODD.search(text):
        return counter.tokens(text)
    if len(text) <= chunk:
        return sum(map(counter.__getitem__, text.split()))
    maps = [chunk_map(text[i : i + chunk], counter) for i in range(0, len(text), chunk)]
    while len(maps) > 1:  # the last element of the scan, as a tree
        maps = [compose(*maps[i : i + 2], counter) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return finished(maps[0], counter)


@lru_cache(maxsize=2)
def counter_of(source: str) -> Counter:
    return Counter(source)


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row, in one pass. The vocabulary file (a few MB) is read on the driver and sent along."""
    with open(vocabulary_path, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        counter = counter_of(sent.value)
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            tokens = pa.array([count_text(t, counter) if t else 0 for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, tokens, pc.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def op3_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
