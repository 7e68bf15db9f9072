"""Cutting of text into the pre-tokens of byte-level BPE, by array operations on a batch of texts at once.

The rule is the published pattern
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
read as: maximal runs of letters, numbers, other signs and white space; the last white space before another run
stands alone, or, if it is U+0020, opens that run; an apostrophe that opens a run takes one of the endings with it.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa

#: The endings that an apostrophe takes, and the white space of Unicode.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
OTHER, LETTER, NUMBER, SPACE = range(4)


def class_table() -> np.ndarray:
    """The class of every code point."""
    t = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    t[WHITE_SPACE] = SPACE
    return t


def _starts(cp: np.ndarray, doc_starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pre-tokens start among the code points `cp` of texts laid end to end."""
    n = len(cp)
    cls = table[cp]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(cls[1:], cls[:-1], out=edge[1:])
    edge[doc_starts] = True
    run = np.nonzero(edge)[0]  # the start of each run
    end = np.append(run[1:], n)
    kind = cls[run]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    follows = ~first[end]  # another run of the same text follows
    follows[-1] = False
    start = edge
    # White space before another run: its last character is a start; a U+0020 takes the next run's start.
    inner = (kind == SPACE) & follows
    last = end[inner] - 1
    start[last] = True
    joined = np.zeros(len(run), bool)
    joined[1:] = (inner & (cp[end - 1] == 0x20))[:-1]
    start[run[joined]] = False
    # An apostrophe alone in its run, not joined to a space, before letters of the same text.
    lone = np.nonzero((kind == OTHER) & ~joined & follows & (end - run == 1) & (cp[run] == 0x27))[0]
    lone = lone[kind[lone + 1] == LETTER]
    a, z = run[lone + 1], end[lone + 1]
    c1, c2 = cp[a], np.where(z - a > 1, cp[np.minimum(a + 1, n - 1)], 0)
    size = np.zeros(len(a), np.int64)
    for e in ENDINGS:
        hit = (c1 == ord(e[0])) & ((c2 == ord(e[1])) if len(e) == 2 else True)
        size[hit & (size == 0)] = len(e)
    hit = size > 0
    start[a[hit]] = False
    rest = a[hit] + size[hit]
    start[rest[rest < z[hit]]] = True
    return np.nonzero(start)[0]


def pretokens(texts: pa.Array, table: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """The pre-tokens of all texts end to end (sharing the texts' memory), and how many each text has (0 for null)."""
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    sizes = np.zeros(len(texts), np.int64)
    _, offs, data = texts.buffers()
    if data is None or len(texts) == 0:
        return pa.array([], pa.string()), sizes
    offs = np.frombuffer(offs, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    lo, hi = int(offs[0]), int(offs[-1])
    if lo == hi:
        return pa.array([], pa.string()), sizes
    raw = np.frombuffer(data, np.uint8)[lo:hi]
    lead = np.nonzero((raw & 0xC0) != 0x80)[0].astype(np.int32)  # the first byte of each code point
    cp = raw if len(lead) == len(raw) else np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    held = np.diff(offs) > 0
    doc = np.searchsorted(lead, offs[:-1][held] - lo)
    at = _starts(cp, doc, table)
    sizes[held] = np.diff(np.append(np.searchsorted(at, doc), len(at)))
    bounds = np.append(lead[at] + lo, hi).astype(np.int32)
    return pa.StringArray.from_buffers(len(at), pa.py_buffer(bounds), data), sizes
