"""Statistics of one text, on its UTF-8 bytes and in memory linear in its length."""

from __future__ import annotations

import numpy as np

SPACES = bytes([*range(0x09, 0x0E), 0x20])
_CONTINUED = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGITS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
_LOWER, _HIGH = bytes(range(0x61, 0x7B)), bytes(range(0x80, 0x100))
WINDOW = 8


def word_chars(text: bytes) -> int:
    """Code points outside white space."""
    return len(text.translate(None, SPACES + _CONTINUED))


def n_symbols(text: bytes) -> int:
    return len(text) - len(text.translate(None, _SYMBOLS))


def n_dup_lines(text: bytes) -> int:
    r"""\n-split lines with a word that equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(SPACES):
            seen.add(line)
    return n


def word_ids(words: list[bytes]) -> np.ndarray:
    ids: dict[bytes, int] = {}
    return np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))


def n_repeat_words(words: list[bytes], ids: np.ndarray | None = None) -> int:
    """Words in 8-word windows found twice or more, first ones included.

    Windows of 2, 4 and 8 words are numbered in turn from pairs of the windows of half their length.
    Numbers are exact: no two windows share one.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    ids = word_ids(words) if ids is None else ids
    width = 1
    while width < WINDOW:
        _, ids = np.unique(ids[:-width] * (ids.max() + 1) + ids[width:], return_inverse=True)
        width *= 2
    again = np.bincount(ids)[ids] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    edge[: n - WINDOW + 1] += again
    edge[WINDOW:] -= again
    return int((np.cumsum(edge[:n]) > 0).sum())


#: What the quality classifier looks at; each is a number for every text, empty ones included.
FEATURES = ("n_words", "mean_len", "sym_rate", "upper_rate", "digit_rate", "mark_rate", "repeat_rate", "distinct_rate", "top_rate", "run_rate", "dup_line_rate", "words_a_line", "pipe_rate", "other_rate")


def features(text: bytes | None) -> tuple[float, ...]:
    b = text or b""
    words = b.split()
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    chars = word_chars(b)
    ids = word_ids(words)
    count = np.bincount(ids)
    lines = [x for x in b.split(b"\n") if x.strip(SPACES)]
    low, up, digits = (len(b) - len(b.translate(None, x)) for x in (_LOWER, _UPPER, _DIGITS))
    beyond = chars - len(b.translate(None, SPACES + _HIGH))
    symbols = n_symbols(b)
    marks = chars - low - up - digits - beyond - symbols
    return (
        float(n),
        chars / n,
        symbols / chars,
        up / max(1, low + up),
        digits / chars,
        marks / chars,
        n_repeat_words(words, ids) / n,
        len(count) / n,
        float(count.max()) / n,
        float((ids[1:] == ids[:-1]).sum()) / n,
        n_dup_lines(b) / len(lines),
        n / len(lines),
        b.count(b"|") / n,
        beyond / chars,
    )
