"""Sets of word shingles as arrays of 64-bit keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from .batches import joined

#: Odd constants, one for each place of a word; the last is for texts of fewer words than a shingle.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], dtype=np.uint64)
TOO_FEW = np.uint64(0xA0761D6478BD642F)
#: Bits of a sketch, at most (8 KB).
SKETCH_BITS = 1 << 16


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (null: none), one text after another, and the number of each text's words; each distinct word is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    filled = pc.greater(pc.binary_length(words), 0)  # nothing stands before and behind white space at the ends
    bounds = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])[lists.offsets.to_numpy()]
    coded = words.filter(filled).dictionary_encode()
    # words hold no blank, so one text of them all is a quick way to Python's
    distinct = joined(coded.dictionary, " ").encode().split(b" ")
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), dtype=np.uint64, count=len(distinct))
    return hashes[coded.indices.to_numpy()], np.diff(bounds)


def shingle_sets(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys of every text, one after another, and the number of each text's keys.

    Letters A-Z are lower-cased, words are runs of characters other than blank and 09-0D; a text of fewer
    words than ``width`` has one shingle, of them all; one without words has none. Keys are 64-bit hashes.
    """
    hashes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    starts = ends - counts
    total = len(hashes)
    keys = np.zeros(total, dtype=np.uint64)
    short = np.repeat(counts < width, counts)
    place = np.arange(total) - np.repeat(starts, counts)
    with np.errstate(over="ignore"):
        if total >= width:
            keys[: total - width + 1] = sum(hashes[j : total - width + 1 + j] * PLACES[j] for j in range(width))
        if short.any():
            at = np.flatnonzero(short & (place == 0))
            for n in at.tolist():
                words = int(counts[np.searchsorted(ends, n, side="right")])
                keys[n] = (hashes[n : n + words] * PLACES[:words]).sum(dtype=np.uint64) + TOO_FEW * np.uint64(words)
        keep = np.where(short, place == 0, place <= np.repeat(counts, counts) - width)
        keys = keys[keep]
        keys ^= keys >> np.uint64(31)
        keys *= PLACES[1]
        keys ^= keys >> np.uint64(29)
    sizes = np.where(counts < width, np.minimum(counts, 1), counts - width + 1)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        keys[a:b].sort()
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    new[bounds[:-1][sizes > 0]] = True
    held = np.concatenate([[0], np.cumsum(new)])
    return keys[new], held[bounds[1:]] - held[bounds[:-1]]


def set_digest(keys: np.ndarray) -> tuple[int, int]:
    """63 bits that name a set in lists, and 64 more; sets are equal if both are."""
    digest = xxhash.xxh3_128_intdigest(keys.tobytes())
    return digest & (1 << 63) - 1, (digest >> 64) - (1 << 63)


def sketch(keys: np.ndarray) -> bytes:
    """Parities of a set's distinct keys, dealt by their lowest bits to as many places as the power of two from its size on (64 to SKETCH_BITS).

    Sets that differ in d keys have sketches that differ in d bits at most; a sketch's halves, combined by exclusive or, are that of half the places.
    """
    places = min(SKETCH_BITS, max(64, 1 << (len(keys) - 1).bit_length()))
    return np.packbits(np.bincount((keys & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1 == 1).tobytes()


def sketches_allow(left: list[bytes], right: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m keys with these sketches may be similar: false only where more bits differ than keys of similar sets can."""
    widths = np.array([[len(a), len(b)] for a, b in zip(left, right)], dtype=np.int64).reshape(-1, 2)
    most, differ = n + m - 2 * least_overlap(n, m, percent), np.zeros(len(widths), dtype=np.int64)
    for pair in np.unique(widths, axis=0):
        at = np.flatnonzero((widths == pair).all(axis=1))
        # so many at once as fill 16 MB
        step = max(1, (16 << 20) // int(pair.sum()))
        for part in (at[a : a + step] for a in range(0, len(at), step)):
            x, y = (np.frombuffer(b"".join([side[k] for k in part.tolist()]), dtype=np.uint8).reshape(len(part), -1) for side in (left, right))
            while x.shape[1] != y.shape[1]:
                x, y = sorted((x, y), key=lambda side: side.shape[1])
                half = y.shape[1] // 2
                y = y[:, :half] ^ y[:, half:]
            differ[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return differ <= most


def least_overlap(n: int | np.ndarray, m: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Smallest intersection of sets of n and m with 100 * intersection >= percent * union."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """So many keys that come first in an order common to all sets: similar sets share one of them."""
    return n - (-(-percent * n // 100)) + 1
