"""Vectorised cutting of texts into repeating chunks, so that tokenizers see each distinct chunk of a batch once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Last bytes of white space beyond ASCII, and first bytes of such characters; no cut is made next to them.
_TAILS = np.zeros(256, bool)
_TAILS[[0x85, 0xA0, 0xA8, 0xA9, 0xAF, 0x9F, *range(0x80, 0x8B), *range(0x21)]] = True
_HEADS = np.zeros(256, bool)
_HEADS[[0xC2, 0xE1, 0xE2, 0xE3, *range(0x21)]] = True
#: ASCII letters, ASCII marks that are neither letters nor digits nor white space, and second bytes of letters that begin with 0xC3.
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False  # the signs for times and divided by


def blank_cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Chunk starts: each row's start and each blank U+0020; for tokenizers that drop white space between words."""
    cut = raw == 0x20
    cut[off[:-1][off[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)


def piece_cuts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Chunk starts where a pre-tokenizer of the kind `` ?letters| ?digits| ?others|spaces`` surely starts a piece.

    Those are single blanks and single line feeds between characters that are not white space, and ASCII marks after letters up
    to U+00FF; anything in doubt stays inside a chunk, which the real pattern then splits.
    """
    n = len(raw)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        lone = np.zeros(n, bool)
        mid = raw[1:-1]
        latin = np.zeros(n, bool)
        latin[1:] = (raw[:-1] == 0xC3) & _LATIN[raw[1:]]
        lone[1:-1] = ((mid == 0x20) | (mid == 0x0A)) & (~_TAILS[raw[:-2]] | latin[:-2]) & ~_HEADS[raw[2:]]
        edge = off[(off > 0) & (off < n)]
        lone[edge] = False
        lone[edge - 1] = False
        cut[:n] = lone
        cut[1:] |= np.append(lone & (raw == 0x0A), False)[:n]
        cut[1:n] |= (_LETTERS[raw[:-1]] | latin[:-1]) & _MARKS[raw[1:]]
    cut[off[:-1]] = True
    cut = cut[:n]
    return np.flatnonzero(cut)


def chunk_array(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The chunks raw[starts[k]:starts[k + 1]] as a binary array over the same bytes."""
    offsets = np.append(starts, len(raw)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])


def distinct_chunks(raw: np.ndarray, starts: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """(distinct chunks, index of each chunk's distinct one)."""
    if not len(starts):
        return [], np.zeros(0, np.int64)
    coded = chunk_array(raw, starts).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def row_of(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row of each chunk; empty rows own none."""
    return np.searchsorted(off, starts, "right") - 1


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, rows, values) if len(values) < 64 else out.__iadd__(np.bincount(rows, values, n).astype(np.int64))
    return out


def ragged_take(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenation of flat[start[k]:start[k] + length[k]] for all k."""
    ends = np.cumsum(length)
    shift = np.repeat(start - (ends - length), length)
    return flat[np.arange(ends[-1] if len(ends) else 0) + shift]
