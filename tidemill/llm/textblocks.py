"""Columnar work on blocks of texts: character classes, words and their bytes, without a loop over characters.

A block is a run of consecutive documents of one partition. Its UTF-8 bytes are
one buffer; everything is found with array operations over that buffer, and a
word is a slice of it, so distinct words come from Arrow's dictionary encoding
of the very buffer the texts came in.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3

#: The code points with the Unicode property White_Space.
WHITE_SPACE = [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005,
    0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


@cache
def class_table() -> np.ndarray:
    """Class of every code point: letter (L*), number (N*), white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE_SPACE] = SPACE
    return table


#: Code points below this one hold all letters that have an upper and a lower case.
CASED = 0x1F000
VOWELS = frozenset("aeiouyаеёиоуыэюяієї")


@cache
def lower_table() -> np.ndarray:
    """Lower case of every code point; one whose lower case is several stays."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(CASED):
        low = chr(c).lower()
        if len(low) == 1:
            table[c] = ord(low)
    return table


@cache
def vowel_table() -> np.ndarray:
    """Whether a code point is a vowel, with or without an accent."""
    table = np.zeros(sys.maxunicode + 1, bool)
    for c in range(0x2000):
        table[c] = unicodedata.normalize("NFD", chr(c).lower())[0] in VOWELS
    return table


class Block(NamedTuple):
    """Texts as code points. Document k holds the characters doc_start[k] to doc_start[k + 1]."""

    data: bytes
    cp: np.ndarray
    byte_at: np.ndarray | None  # byte position of each character and of the end; None: one byte a character
    doc_start: np.ndarray

    def bytes_of(self, at: np.ndarray) -> np.ndarray:
        return at if self.byte_at is None else self.byte_at[at]


def decode(texts: pa.Array) -> Block:
    """A block from a string array. Nulls count as empty; bytes that aren't UTF-8 become U+FFFD."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    raw = bytes(memoryview(data)[off[0] : off[-1]]) if data is not None and n else b""
    off = off - off[0]
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        parts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:])]
        raw = b"".join(parts)
        off = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        text = raw.decode("utf-8")
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(cp) == len(raw):
        return Block(raw, cp, None, off)
    width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
    byte_at = np.concatenate(([0], np.cumsum(width)))
    return Block(raw, cp, byte_at, np.searchsorted(byte_at, off))


def slices(texts: pa.Array, limit: int) -> list[tuple[int, int]]:
    """Row ranges holding about ``limit`` bytes of text each; a longer text is a range of its own."""
    lengths = np.asarray(pc.binary_length(texts).fill_null(0)).astype(np.int64)
    ends = np.cumsum(lengths)
    out, a = [], 0
    while a < len(lengths):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + limit, side="right")))
        out.append((a, b))
        a = b
    return out


def run_starts(block: Block, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a run of one class begins, and where a document begins (runs end with their document)."""
    n = len(cls)
    doc = np.zeros(n + 1, bool)
    doc[block.doc_start] = True
    doc[n] = True
    new = np.empty(n, bool)
    if n:
        new[0] = True
        np.not_equal(cls[1:], cls[:-1], out=new[1:])
        new |= doc[:n]
    return new, doc


def word_array(block: Block, starts: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """Slices of the block's bytes as a binary array; without ends the slices tile the block."""
    if ends is None:
        off = block.bytes_of(np.append(starts, len(block.cp)))
        kind, width = (pa.binary(), np.int32) if off[-1] < 2**31 else (pa.large_binary(), np.int64)
        return pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(off.astype(width)), pa.py_buffer(block.data)])
    # alternate word and gap, then keep the words
    off = np.empty(2 * len(starts) + 1, np.int64)
    off[0:-1:2], off[1::2] = block.bytes_of(starts), block.bytes_of(ends)
    off[-1] = off[-2] if len(starts) else 0
    both = pa.Array.from_buffers(pa.large_binary(), 2 * len(starts), [None, pa.py_buffer(off), pa.py_buffer(block.data)])
    return both.take(pa.array(np.arange(0, 2 * len(starts), 2)))
