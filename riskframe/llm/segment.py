"""Cutting texts into the pieces that BPE merges within, vectorised over code points.

Both rules are those of public tokenizer files: ``byte`` cuts like the byte-level pattern (a space joins the run after it),
``word`` like the word-end pattern (white space is dropped, digits stand alone). Characters are letters, numbers, white
space or others by their Unicode category.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
# fixed values: code points with the Unicode property White_Space
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# fixed values: what may follow an apostrophe as one piece
TAILS = ["s", "t", "re", "ve", "m", "ll", "d"]


def kinds(cache: dict) -> np.ndarray:
    """The kind of every code point."""
    if "kinds" not in cache:
        out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
        first = {"L": LETTER, "N": NUMBER}
        for c in range(sys.maxunicode + 1):
            k = first.get(unicodedata.category(chr(c))[0])
            if k:
                out[c] = k
        out[WHITE] = SPACE
        cache["kinds"] = out
    return cache["kinds"]


def _tails(cp: np.ndarray, kind: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """(position, length) of the apostrophes at ``at`` that take a tail."""
    found = []
    for i in at.tolist():
        after = "".join(map(chr, cp[i + 1:i + 3].tolist()))
        for tail in TAILS:
            if after.startswith(tail):
                found.append((i, 1 + len(tail)))
                break
    return found


def cut(text: str, kind_of: np.ndarray, rule: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the pieces of a text."""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    n = len(cp)
    if not n:
        return [], []
    kind = kind_of[cp]
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    white = kind == SPACE
    quote = change & (cp == 39)
    if rule == "byte":
        blank = cp == 32
        after_blank = np.zeros(n, bool)
        after_blank[1:] = blank[:-1]
        start = change & (white | ~after_blank)
        start[:-1] |= white[:-1] & ~white[1:]
        quote &= ~after_blank
    else:
        start = ~white & (change | (kind == NUMBER))
    at = np.flatnonzero(quote)
    if len(at):
        # an apostrophe alone in its run, before a letter
        at = at[at + 1 < n]
        at = at[kind[at + 1] == LETTER]
        for i, length in _tails(cp, kind, at):
            start[i + 1] = False
            if i + length < n and kind[i + length] == LETTER:
                start[i + length] = True
    starts = np.flatnonzero(start)
    if rule == "byte":
        ends = np.append(starts[1:], n)
    else:
        edge = start.copy()
        edge[1:] |= white[1:] & ~white[:-1]
        marks = np.append(np.flatnonzero(edge), n)
        ends = marks[np.searchsorted(marks, starts, side="right")]
    return starts.tolist(), ends.tolist()


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + extra))
        extra += b not in plain
    return out
