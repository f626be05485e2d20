"""Words of texts counted in Arrow batches: a row for each word of a document, so a document's repeats never meet in a hash table.

Equal to functions.text (tests hold the two together). Texts come as bytes: UTF-8 keeps ASCII below 128, so what is beyond
it is dropped byte by byte, once the two quotation marks that separate words have become spaces.
"""

from __future__ import annotations

from collections import Counter

#: Those of functions.text. The rest of its separators and edges are single bytes.
LONG_SEPARATORS = (b"[newline]", b"[NEWLINE]", "“".encode(), "”".encode())
BEYOND_ASCII = bytes(range(128, 256))
STRIPPED = b".#@:"
TO_SPACE = b',"?!\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f'
PLAIN = bytes(32 if c in TO_SPACE else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in lower case and in order, with the signs at their ends."""
    if not text:
        return []
    for s in LONG_SEPARATORS:
        if s in text:
            text = text.replace(s, b" ")
    return text.translate(PLAIN, BEYOND_ASCII).split()


def counted(text: bytes | None) -> dict[bytes, int]:
    """How often a text has each term."""
    n = Counter(words(text))
    for raw in [t for t in n if t.strip(STRIPPED) != t]:
        term, more = raw.strip(STRIPPED), n.pop(raw)
        n[term] = n.get(term, 0) + more
    return n


def placed(text: bytes | None) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """How often a text has each term, and the place of the first (keys in the same order)."""
    found = words(text)
    n, at = Counter(found), dict(zip(reversed(found), range(len(found) - 1, -1, -1)))
    at = {t: at[t] for t in n}
    for raw in [t for t in n if t.strip(STRIPPED) != t]:
        term, more, place = raw.strip(STRIPPED), n.pop(raw), at.pop(raw)
        n[term] = n.get(term, 0) + more
        at[term] = min(at.get(term, place), place)
    return n, at
