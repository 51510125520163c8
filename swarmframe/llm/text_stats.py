"""Counts and ratios of a whole text, shared by the quality operators.

A null text counts as empty. Words are ``[^\\x20\\x09-\\x0D]+``; a UTF-8 text splits
into the same words as bytes, since every separator is one ASCII byte.
"""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np

SEPARATORS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
ASCII_UPPER = bytes(range(65, 91))
ASCII_LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
STOPS = b".,;:"

#: Words a block in which distinct words are counted.
BLOCK = 200

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("word_len", "symbol", "dup_line", "repeat", "upper", "bang", "bar", "digit", "stop", "single", "line", "distinct", "other")


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of three that the text holds twice or more, the first time included."""
    triples = list(zip(words, islice(words, 1, None), islice(words, 2, None), strict=False))
    found = Counter(triples)
    if len(found) == len(triples):
        return 0
    covered, end = 0, 0
    for i, t in enumerate(triples):
        if found[t] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def distinct_share(words: list[bytes]) -> float:
    """Distinct words in consecutive blocks of ``BLOCK`` words, summed up over the whole text, by all words."""
    return sum(len(set(words[i : i + BLOCK])) for i in range(0, len(words), BLOCK)) / max(len(words), 1)


def text_stats(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(COUNTS, RATIOS) of a text. No ratio grows with the text's length."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in SEPARATORS)
    symbols = sum(raw.count(c) for c in SYMBOLS.encode()) if n else 0
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    rep = repeated_words(words)
    left = lambda drop: len(raw) - len(raw.translate(None, drop))
    upper, lower = left(ASCII_UPPER), left(ASCII_LOWER)
    w, c = max(n, 1), max(chars, 1)
    digits, stops = left(DIGITS), left(STOPS)
    bangs = raw.count(b"!") + raw.count(b"?")
    high = len(raw) - len(text)  # about one a letter outside ASCII
    ratios = (
        chars / w, symbols / w, dup / max(len(lines), 1), rep / w, upper / max(upper + lower, 1), bangs / w, raw.count(b"|") / w,
        digits / c, stops / w, sum(len(x) == 1 for x in words) / w, min(len(lines) / w, 1.0), distinct_share(words),
        max(chars - upper - lower - digits - stops - bangs - symbols - high, 0) / c,
    )
    return (n, chars, symbols, dup, rep), ratios


def batch_stats(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (n, 5) as int64 and ratios (n, 13) as float64."""
    both = [text_stats(t) for t in texts]
    return np.array([x for x, _ in both], np.int64).reshape(len(both), len(COUNTS)), np.array([x for _, x in both], np.float64).reshape(len(both), len(RATIOS))
