"""Counts over one whole text, as UTF-8 bytes. Words are runs outside ASCII white space; null counts as an empty text."""

from __future__ import annotations

import string

import numpy as np

UPPER, LOWER = string.ascii_uppercase.encode(), string.ascii_lowercase.encode()
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
DIGITS = string.digits.encode()
#: Words of a block: how many of a block's words differ does not depend on the text's length, as it does for whole texts.
BLOCK = 50
#: In this order in FEATURES; the first five are counts, the rest are ratios.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (*COUNTS, "symbols_per_word", "dup_line_share", "repeat_share", "mean_word_chars", "upper_share", "block_distinct_share", "bang_words_share", "digit_share", "mark_words_share", "words_per_line")


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows that the text holds twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    first: dict[bytes, int] = {}
    ids = np.array([first.setdefault(w, len(first)) for w in words], np.int64)
    size = len(first)
    if size == len(ids):
        return 0
    # Windows as exact integers: ranks are taken anew whenever the next factor would leave 63 bits.
    key, top = ids[:n], size
    for k in range(1, window):
        if top * size >= 1 << 62:
            seen, key = np.unique(key, return_inverse=True)
            top = len(seen)
        key = key * size + ids[k : k + n]
        top *= size
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def stats(text: bytes | None) -> list[float]:
    """FEATURES of a text. Ratios of an empty text are 0."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    without = lambda chars: size - len(text.translate(None, chars))  # noqa: E731  how many bytes are among chars
    chars = len(text.translate(None, CONTINUATION + SPACE))
    symbols = without(SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    upper, lower = without(UPPER), without(LOWER)
    bangs = text.count(b"! ") + text.count(b"!\n") + text.endswith(b"!")
    marks = sum(text.count(m) for m in (b"# ", b"$ ", b"% ", b"& ", b"* ", b"| ", b"> "))
    return [
        n, chars, symbols, dup, repeats,
        symbols / n, dup / len(lines), repeats / n, chars / n, upper / max(1, upper + lower), sum(len(set(words[i : i + BLOCK])) for i in range(0, n, BLOCK)) / n, bangs / n, without(DIGITS) / chars, marks / n, n / len(lines),
    ]
