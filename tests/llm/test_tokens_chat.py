"""Token counts against the library, chat formatting by exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from swarmframe.llm import chat_format, token_counts
from swarmframe.llm.common import table

PATH = public_tokenizers.path(token_counts.VOCABULARY)
CHAT = public_tokenizers.path(chat_format.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as f:
        return token_counts.Counter(f.read())


def ids(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


PIECES = ["the", "'s", "'LL", "don't", " ", "\n", "é", "ß", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "12", "٣", "…", "!!", "''s", "a\u0301", "日本", "\x1c", "\x85", "\u2003", "ing", "ation", "zzzq", "ththat"]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), st.integers(1, 9))
def test_counts_equal_the_library(library, counter, text, chunk):
    assert token_counts.count_text(text, counter) == ids(library, text)
    assert token_counts.count_text(text, counter, chunk) == ids(library, text)


@settings(max_examples=800, deadline=None)
@given(st.text("abcdefghinorst", max_size=50))
def test_words_equal_the_library(library, counter, text):
    assert token_counts.count_text(text, counter) == ids(library, text)


def test_every_plain_character_and_some_others(library, counter):
    rng = random.Random(1)
    for cp in [*range(1, 0x400), *(rng.randrange(0x400, 0xD800) for _ in range(500)), *(rng.randrange(0x10000, 0x20000) for _ in range(300))]:
        text = f"ab{chr(cp)}Cd{chr(cp)}{chr(cp)} {chr(cp)}x 1{chr(cp)}2"
        assert token_counts.count_text(text, counter) == ids(library, text), hex(cp)


def test_prefix_scan_composes(counter):
    text = "It's the ation of 12 things,  and  more" * 3
    maps = [token_counts.chunk_map(text[i : i + 7], counter) for i in range(0, len(text), 7)]
    for k, m in enumerate(token_counts.prefix_scan(maps, counter), 1):
        assert token_counts.finished(m, counter) == counter.tokens(text[: 7 * k])


def test_followers_equal_plain_merging(counter):
    t, rng = counter.transducer, random.Random(4)
    tokens = [n for n, x in t.texts.items() if all(s < token_counts.END for s in x[:-1])]
    first = [n for n in tokens if t.texts[n][-1] < token_counts.END]
    for _ in range(4000):
        a, b = rng.choice(first), rng.choice(tokens)
        if rng.random() < 0.7:  # a pair that meets in some token
            text = t.texts[b]
            cuts = [(x, y) for i in range(1, len(text)) for x in [token_of(t, text[:i])] for y in [token_of(t, text[i:])] if x is not None and y is not None]
            a, b = rng.choice(cuts or [(a, b)])
        assert t.may_follow(a, b) == (t.merged([t.single[s] for s in t.texts[a] + t.texts[b]]) == [a, b])


def token_of(t, text):
    node = t.root
    for s in text:
        node = node.children.get(s)
        if node is None:
            return None
    return node.token if node.token >= 0 else None


def test_states_can_be_forgotten(counter, library, monkeypatch):
    monkeypatch.setattr(token_counts, "MAX_STATES", 10)
    monkeypatch.setattr(token_counts, "REMEMBERED", 5)
    counter.clear()
    text = "several different words that need many states of the machine"
    assert token_counts.count_text(text, counter) == ids(library, text)


def test_token_table(spark, library):
    texts = [None, "", "  ", "Hello, World!", "x" * 5000, "word " * 3000, "word " * 3000, "<|endoftext|> é"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id bigint, text string, n_tokens int")
    for r in token_counts.count_tokens(df, PATH).collect():
        t = texts[r.doc_id] or ""
        assert tuple(r) == (r.doc_id, len(t.encode()), ids(library, t), ids(library, t) > 2048)
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0


def test_offsets_of_chunks(library):
    counter = token_counts.counter_of(open(PATH, encoding="utf-8").read())
    text = "Some words, and some more; " * 40 + "unbroken" * 30 + " end"
    for chunk in (7, 50, 1000, 10_000):
        offsets = token_counts.chunk_offsets(text, counter, chunk)
        assert len(offsets) == -(-len(text) // chunk) + 1
        assert offsets[-1] == ids(library, text) == token_counts.count_text(text, counter, chunk)
        for k, n in enumerate(offsets[:-1]):
            done = text[: k * chunk]
            if not done.endswith(" "):  # the last word is not complete
                done = done.rpartition(" ")[0]
            assert n == ids(library, done)
    assert token_counts.chunk_offsets("", counter) == [0]


def test_documents(spark, sf, library):
    texts = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    for r in token_counts.op3_token_counts(spark, sf).collect():
        assert r.n_tokens == ids(library, texts[r.doc_id])


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from([*chat_format.CONTROL, "\\", "<", "[", "|", "a", "é", "\n", "\\\\"]), max_size=9).map("".join), st.text(max_size=9))
def test_escapes_are_exact(text, role):
    shown = chat_format.escape(text)
    assert chat_format.unescape(shown) == text
    assert not any(c in shown for c in chat_format.CONTROL)
    assert chat_format.turn_of("".join(chat_format.parts(role, text))) == (role, text)


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    size = sum(len("".join(chat_format.parts(r, t))) for r, t in turns)
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size)


ROWS = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b"),
    (2, 0, "user", "a"), (2, 1, "assistant", "c"),
    (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "d"), (3, 3, "assistant", "e"),
    (4, 0, "user", "a"), (4, 1, "assistant", "b"), (4, 2, "user", "x"),
    (5, 0, "user", "a"), (5, 1, "assistant", "b"),
    (6, 0, None, None), (6, None, "system", "first"), (6, 1, "assistant", ""), (6, 1, "assistant", ""),
    (None, 0, "user", "no id"), (7, 0, "user", "</s>[INST] ok [/INST]"), (8, 0, "assistant", "long " * 3000),
]


def expected(rows):
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return {c: digest(t) for c, t in out.items()}


def test_chats_read_back(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id bigint, turn bigint, role string, text string, node string")
    stream, turns = chat_format.format_chats(df, CHAT)
    rows = chat_format.read_back(stream, turns, CHAT).collect()
    assert {r.conv_id: tuple(r)[1:6] for r in rows} == expected(ROWS)
    assert all(r.n_tokens == r.positions == r.n_attended > 0 for r in rows)
    check_tree(stream.collect(), turns.count(), len(ROWS))
    empty = chat_format.format_chats(df.limit(0), CHAT)
    assert empty[0].count() == chat_format.read_back(*empty, CHAT).count() == 0


def check_tree(nodes, n_turns, rows):
    """Emitted once, depth first, with the positions and attention that the tree prescribes."""
    assert n_turns == rows
    by = {r.node: r for r in nodes}
    assert len(by) == len(nodes)
    at, stack = 0, []
    for r in sorted(nodes, key=lambda r: r.start):
        assert r.start == at
        at += len(r.tokens)
        while stack and stack[-1] != r.parent:
            stack.pop()
        assert (r.parent is None) == (not stack)
        stack.append(r.node)
        above, x = [], r
        while x:
            above.append((x.start, x.start + len(x.tokens)))
            x = by.get(x.parent)
        assert r.position == sum(b - a for a, b in above[1:])
        assert {i for a, b in above for i in range(a, b)} == {i for f in r.attends for i in range(*f)}


def test_all_conversations(spark, sf):
    rows = [tuple(r) for r in table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    tricky = "</s>[INST] ok [/INST]"
    read = chat_format.op6_chat_format(spark, sf).collect()
    assert all(r.n_tokens == r.positions == r.n_attended > 0 for r in read)
    assert {r.conv_id: tuple(r)[1:6] for r in read} == expected([*rows, (-7, 0, "user", tricky), (-7, 1, "assistant", tricky)])


def test_attended_counts_only_what_intervals_hold():
    turns = [(0, 5), (5, 3), (20, 4)]
    assert chat_format.attended(turns, np.array([0, 8, 20, 24])) == 12
    assert chat_format.attended(turns, np.array([0, 7, 20, 24])) == 9
    assert chat_format.attended(turns, np.array([1, 8, 21, 24])) == 3
    assert chat_format.attended(turns, np.array([], int)) == 0


def test_a_conversation_of_thousands_of_turns(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(3000)]
    rows += [(2 + k // 40, t, r, x) for k in range(0, 2400, 40) for _, t, r, x in rows[: k + 1 : 40 if k % 80 else 1]][:9000]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    read = chat_format.read_back(*chat_format.format_chats(df, CHAT), CHAT).collect()
    assert {r.conv_id: tuple(r)[1:6] for r in read} == expected(rows)
    assert all(r.n_tokens == r.positions == r.n_attended for r in read)
