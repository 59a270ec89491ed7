"""Vectorised text helpers used inside tasks: byte-wise lower case, words and their 64-bit hashes.

A word is a run of bytes other than space and 0x09-0x0D, after lower-casing A-Z only.  Words are told apart
by a 64-bit hash of all their bytes and their length: two given words collide once in 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
PIECE = 4 << 20  # bytes hashed at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_places(buffer: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and size of every word as it stands, eight bytes of all words at a time."""
    word = ~_SPACE[np.frombuffer(buffer, np.uint8)]
    edges = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts = np.flatnonzero(edges == 1)
    sizes = left = np.flatnonzero(edges == -1) - starts
    eights = np.ndarray(len(buffer) + 1, "<u8", buffer + bytes(8), strides=(1,))
    out, at, open_words = left.astype(np.uint64) * _BASE, starts.copy(), slice(None)
    while len(at):
        part = eights[at] & _MASKS[np.minimum(left, 8)]
        out[open_words] = mix(out[open_words] * _BASE + part)
        more = np.flatnonzero(left > 8)
        open_words = more if isinstance(open_words, slice) else open_words[more]
        at, left = at[more] + 8, left[more] - 8
    return out, starts, sizes


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (one more entry than texts)."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    buffer = b" ".join(texts).translate(LOWER) + b" " if texts else b""
    hashes, starts, at = [], [], 0
    while at < len(buffer):
        end = min(at + PIECE, len(buffer))
        while end < len(buffer) and not _SPACE[buffer[end - 1]]:  # a piece ends behind white space
            end += 1
        h, s, _ = word_places(buffer[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; a shorter text is one run; no words, none."""
    if not len(hashes):
        return hashes
    size_here = min(size, len(hashes))
    n = len(hashes) - size_here + 1
    out = np.full(n, np.uint64(size_here))
    for k in range(size_here):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
    return np.unique(out)


def binaries(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def portions(batch: pa.RecordBatch, text: str, most: int = 16 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """A batch in slices of at most ``most`` bytes of text (or one row), each with its texts.

    Only the texts of one slice are Python objects at a time.
    """
    column = batch.column(batch.schema.get_field_index(text))
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(begin, end - begin), binaries(column.slice(begin, end - begin))
        begin = end


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
