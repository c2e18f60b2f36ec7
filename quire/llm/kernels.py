"""Vectorised byte kernels that run inside Spark tasks.

Everything here works on one Arrow batch at a time: a flat ``uint8`` buffer
with document offsets.  Word and window hashes are polynomial hashes modulo
2**64 over a table of random byte values.  The multiplier is odd, so it has an
inverse and a hash of any slice comes from two prefix sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
#: Bytes hashed at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20

# Worker processes give memory of large batches back at once.
pa.set_memory_pool(pa.system_memory_pool())

#: Multiplier of a second, independent hash.
OTHER_MULTIPLIER = 0xD6E8FEB86659FD93
_powers: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}


def byte_values(seed: int, fold_case: bool = False) -> np.ndarray:
    """256 random odd 64-bit values; A-Z share the values of a-z if folded."""
    values = np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
    if fold_case:
        values[65:91] = values[97:123]
    return values


def powers(n: int, multiplier: int = MULTIPLIER) -> tuple[np.ndarray, np.ndarray]:
    """``multiplier**i`` and its inverse for i < n, grown on demand."""
    size = 1 << max(16, int(n).bit_length())
    if multiplier not in _powers or _powers[multiplier][0] != size:
        pair = []
        for base in (multiplier, pow(multiplier, -1, 2**64)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        _powers[multiplier] = (size, pair[0], pair[1])
    return _powers[multiplier][1:]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and document offsets of a string column; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Document ranges [i, j) of at most ``most`` bytes, or of one document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_WORD = byte_values(11, fold_case=True)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space separated word (A-Z folded), word count per document."""
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(0, U64), np.zeros(n, np.int64)
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cuts = offsets[1:-1][offsets[1:-1] < len(raw)]
    begins[cuts] = inside[cuts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(n, np.int64)
    up, down = powers(len(raw))
    values = _WORD[raw]
    values *= up[: len(raw)]
    values[~inside] = 0
    hashes = mix(np.add.reduceat(values, starts) * down[starts])
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


_LANES = [U64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD)]


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document.

    A document of fewer words has its whole sequence as one shingle; one
    without words has none.
    """
    out: list[np.ndarray] = []
    lanes = [_LANES[i % 5] * U64(2 * (i // 5) + 1) for i in range(words)]
    for i, j in chunks(offsets):
        own = offsets[i : j + 1]
        hashes, counts = word_hashes(raw[own[0] : own[-1]], own - own[0])
        rolled = np.zeros(max(0, len(hashes) - words + 1), U64)
        for k, lane in enumerate(lanes):
            rolled += hashes[k : k + len(rolled)] * lane
        rolled = mix(rolled)
        at = 0
        for n in counts.tolist():
            if n >= words:
                out.append(np.unique(rolled[at : at + n - words + 1]))
            elif n:
                few = hashes[at : at + n]
                with np.errstate(over="ignore"):
                    out.append(mix(np.array([sum((int(h) * int(lane) for h, lane in zip(few, lanes)), n) & (2**64 - 1)], dtype=U64)))
            else:
                out.append(np.zeros(0, U64))
            at += n
    return out


_BYTE = byte_values(23)
_OTHER_BYTE = byte_values(29)
_POSITION_BITS = 20
#: Bytes of one scan; longer buffers are scanned in overlapping segments.
SEGMENT = (1 << _POSITION_BITS) - 2


def segments(offsets: np.ndarray, window: int):
    """(from, to, first document, last document): stretches of the buffer that hold every window once."""
    for i, j in chunks(offsets, SEGMENT):
        low, high = int(offsets[i]), int(offsets[j])
        if high - low <= SEGMENT:
            yield low, high, i, j
        else:
            for at in range(low, max(low + 1, high - window + 1), SEGMENT - window + 1):
                yield at, min(at + SEGMENT, high), i, j


def prefix_sums(raw: np.ndarray, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which :func:`slice_hash` takes the hash of any slice; ``other``: of the second hash."""
    up, down = powers(len(raw) + 1, OTHER_MULTIPLIER if other else MULTIPLIER)
    sums = np.zeros(len(raw) + 1, dtype=U64)
    np.cumsum((_OTHER_BYTE if other else _BYTE)[raw] * up[: len(raw)], out=sums[1:])
    return sums, down


def heads(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number that sorts like them."""
    eight = raw[at[:, None] + np.arange(8)]
    return (np.ascontiguousarray(eight).view(">u8").ravel().astype(U64) ^ U64(1 << 63)).view(np.int64)


def slice_hash(sums: np.ndarray, down: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    return (sums[end] - sums[begin]) * down[begin]


def anchors(raw: np.ndarray, cuts: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of ``window`` bytes that do not cross a cut.

    A window's anchor is its ``gram``-byte string with the least hash, the
    leftmost of equals, so equal windows have equal anchors at equal places.
    Returns per run of windows with one anchor: hash of the anchor, its place,
    first window, number of windows.  ``window - gram + 1`` must be a power of
    two.
    """
    none = tuple(np.zeros(0, t) for t in (U64, np.int64, np.int64, np.int64))
    if len(raw) < window:
        return none
    sums, down = prefix_sums(raw)
    grams = mix((sums[gram:] - sums[:-gram]) * down[: len(sums) - gram])
    least = (grams >> U64(_POSITION_BITS) << U64(_POSITION_BITS)) | np.arange(len(grams), dtype=U64)
    step, width = 1, window - gram + 1
    while step < width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    windows = len(raw) - window + 1
    at = (least[:windows] & U64((1 << _POSITION_BITS) - 1)).astype(np.int64)
    # windows that cross a cut (a border between documents) are nobody's
    crossing = np.zeros(windows + 1, dtype=np.int32)
    np.add.at(crossing, np.clip(cuts - window + 1, 0, windows), 1)
    np.add.at(crossing, np.clip(cuts, 0, windows), -1)
    inside = np.cumsum(crossing[:-1]) == 0
    fresh = inside.copy()
    fresh[1:] &= (at[1:] != at[:-1]) | ~inside[:-1]
    first = np.flatnonzero(fresh)
    if not len(first):
        return none
    return grams[at[first]], at[first], first, np.add.reduceat(inside.astype(np.int64), first)
