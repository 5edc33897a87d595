"""Words and word hashes of whole Arrow batches, without a Python step per word.

Texts of a batch lie end to end in one buffer; starts, ends and owners of all words come from comparisons
over that buffer. Work goes through the buffer in slices, so memory doesn't follow the batch's size.
"""

import ctypes
import functools
import gc
import hashlib

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on together; a longer document is a slice by itself.
SLICE = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The first 0 to 8 bytes of a number.
MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def task(run):
    """A function of Arrow batches that gives memory back when its task ends.

    Workers live on between tasks, and what a task has freed would stay with the allocators.
    """

    @functools.wraps(run)
    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return tidy


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def randoms(seed: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x1000193 & (2**64 - 1)))


class Words:
    """The words of texts lying end to end: data, the texts' bounds, starts, ends, owner and count per text."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, self.bounds, n = data, bounds, len(data)
        word = ~IS_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[bounds] = True
        before = np.ones(n, bool)
        if n:
            before[1:] = ~word[:-1]
        self.starts = np.flatnonzero(word & (before | edge[:-1])) if n else np.zeros(0, np.int64)
        after = np.ones(n, bool)
        if n:
            after[:-1] = ~word[1:]
        self.ends = np.flatnonzero(word & (after | edge[1:])) + 1 if n else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.starts, bounds)  # of each text, the first word; at the end, all words
        self.counts = np.diff(self.first)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 1, fold=None, key: bytes = b"") -> np.ndarray:
        """A 64-bit hash of each word; fold maps bytes first, as LOWER does."""
        return hashes_of(self.data, self.starts, self.ends, seed, fold, key)


def eights(data: np.ndarray, more: int = 8) -> np.ndarray:
    """The eight bytes from each place of data on, as one number; past the end stand zeros."""
    padded = np.zeros(len(data) + more + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + more + 1,), "<u8", padded, strides=(1,))


def hashes_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1, fold=None, key: bytes = b"") -> np.ndarray:
    """A 64-bit hash of ranges of bytes, by seed and key; fold maps bytes first.

    A range goes by its identity: its bytes, or 120 bits of BLAKE2 if it is long. The two halves of that are scrambled
    beside secret numbers and added, one of them times a secret odd number. Halves that are equal in one place can't
    collide at all, others do for one in some 2**60 keys, whoever wrote them; so what is told apart by
    combinations of these hashes (shingles, windows) can't be made to collide as long as the key isn't known.
    """
    one, two = identities(data if fold is None else fold[data], starts, ends)
    k = np.frombuffer(hashlib.blake2b(seed.to_bytes(8, "little"), digest_size=32, key=key).digest(), "<u8")
    with np.errstate(over="ignore"):
        return mix(mix(one + k[0]) + mix(two + k[1]) * (k[2] | np.uint64(1)) + k[3])


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell ranges of bytes apart: up to 15 bytes and their count, or 120 bits of a BLAKE2 digest."""
    size, view = ends - starts, eights(data, 16)
    one = view[starts] & MASK[np.minimum(size, 8)]
    two = (view[starts + 8] & MASK[np.clip(size - 8, 0, 7)]) | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))
    long = np.flatnonzero(size > 15)
    if len(long):
        raw = data.tobytes()
        sums = np.frombuffer(b"".join([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]), "<u8").reshape(-1, 2)
        one[long], two[long] = sums[:, 0], sums[:, 1] | np.uint64(255 << 56)
    return one, two


def distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of identities, the place of the first of each, and for all of them which of those they are."""
    _, first, place = np.unique(mix(one ^ mix(two)), return_index=True, return_inverse=True)
    if (one != one[first][place]).any() or (two != two[first][place]).any():  # two that differ have one hash
        _, first, place = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, place.reshape(-1)


def buffers(texts: pa.Array):
    """(first row, bytes, bounds of the texts in them) for consecutive rows; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if not n:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLICE, "right")) - 1)
        yield i, data[ends[i] : ends[j]], (ends[i : j + 1] - ends[i]).astype(np.int64)
        i = j


def slices(texts: pa.Array):
    """(first row, Words) for consecutive rows."""
    for row, data, bounds in buffers(texts):
        yield row, Words(data, bounds)


def chained(parts: list[np.ndarray], seed: int) -> np.ndarray:
    """A hash of aligned hashes, in their order."""
    keys = randoms(seed, len(parts)) | np.uint64(1)
    with np.errstate(over="ignore"):
        total = parts[0] * keys[0]
        for p, k in zip(parts[1:], keys[1:], strict=True):
            total = total + mix(p) * k
    return mix(total)


def grams(hashes: np.ndarray, first: np.ndarray, counts: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, for those that lie within one text; (hashes, word index, how many per text)."""
    have = np.maximum(counts - (n - 1), 0)
    total = len(hashes) - (n - 1)
    if total <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), have
    every = chained([hashes[k : k + total] for k in range(n)], seed)
    offset = np.cumsum(have) - have
    at = np.arange(int(have.sum())) - np.repeat(offset - first[:-1], have)
    return every[at], at, have
