"""Words of many texts at once, as 64-bit hashes, without a Python loop over words.

A word is a maximal run of bytes other than space and 0x09 to 0x0D. Its hash is multilinear: the sum, modulo 2^64, of a
random number for each place in the word times a random number for each byte (A-Z have those of a-z if asked), passed
through a mixing function; words of more than PLACES bytes are hashed by xxh3. Different words, of whatever letters and
lengths, share a hash by a chance of about 2^-60 a pair. There are two such hashes (lanes), which share nothing.

What must be exact doesn't rest on one hash: `distinct` and `same` compare bytes, what is told apart across a whole corpus
has both lanes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from arrayloom.llm.common import text_buffer

U = np.uint64
_M1, _M2, _STEP = U(0xFF51AFD7ED558CCD), U(0xC4CEB9FE1A85EC53), 0x9E3779B97F4A7C15
PLACES = 4096
_BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """MurmurHash3's finaliser."""
    x = x ^ (x >> U(33))
    x *= _M1
    x ^= x >> U(33)
    x *= _M2
    x ^= x >> U(33)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n random 64-bit values that depend on seed alone (splitmix64)."""
    return mix((np.arange(1, n + 1, dtype=U) * U(_STEP)) + U(seed * 0x5851F42D4C957F2D % 2**64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
_PLACE = [stream(31 + lane, PLACES) | U(1) for lane in (0, 1)]


def _tables(lane: int) -> dict[str, np.ndarray]:
    exact, raw = stream(11 + 20 * lane, 256), stream(12 + 20 * lane, 256)
    exact[SPACE] = 0
    return {"exact": exact, "lower": exact[FOLD], "raw": raw}


_BYTE = [_tables(lane) for lane in (0, 1)]


def spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in buf, and len(offsets) bounds: text d has the words bounds[d] to bounds[d + 1]."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str = "lower", lane: int = 0) -> np.ndarray:
    """A hash for each word, in blocks of words that span a bounded number of bytes.

    kind: "lower" or "exact", or "raw" for spans that tile the buffer, in which white space counts as any other byte.
    """
    table, place = _BYTE[lane][kind], _PLACE[lane]
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):
        at = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, at + _BLOCK, "right")))
        if b == a + 1 and ends[a] - at > PLACES:
            out[a] = _long(buf[at : ends[a]], kind, lane)
            a = b
            continue
        first = (starts[a:b] - at).astype(np.int32)
        n = int(ends[b - 1]) - at
        where = np.arange(n, dtype=np.int32)
        where -= np.repeat(first, np.diff(first, append=np.int32(n)))
        where &= PLACES - 1
        weighted = table[buf[at : at + n]]
        weighted *= place[where]
        out[a:b] = np.add.reduceat(weighted, first)
        for i in np.flatnonzero(ends[a:b] - starts[a:b] > PLACES) + a:
            out[i] = _long(buf[starts[i] : ends[i]], kind, lane)
        a = b
    return mix(out)


def _long(word: np.ndarray, kind: str, lane: int) -> np.uint64:
    return U(xxhash.xxh3_64_intdigest((FOLD[word] if kind == "lower" else word).tobytes(), 41 + lane))


def same(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray, lower: bool = False) -> np.ndarray:
    """Whether word i[n] and word j[n] have the same bytes, for each n."""
    size = ends[i] - starts[i]
    out = size == ends[j] - starts[j]
    pairs = np.flatnonzero(out & (starts[i] != starts[j]))
    a = 0
    while a < len(pairs):
        upto = np.cumsum(size[i_ := pairs[a : a + (1 << 18)]])
        b = max(1, int(np.searchsorted(upto, 1 << 22, "right")))
        n, some = size[i_[:b]], i_[:b]
        first = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(first, n)
        x, y = buf[np.repeat(starts[i[some]], n) + step], buf[np.repeat(starts[j[some]], n) + step]
        if lower:
            x, y = FOLD[x], FOLD[y]
        out[some] = np.logical_and.reduceat(x == y, first)
        a += b
    return out


def distinct(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: str = "lower") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different words: their sorted hashes, where each stands first; and which of them each word is. Bytes are compared."""
    keys, first, which = np.unique(hashes(buf, starts, ends, kind), return_index=True, return_inverse=True)
    if same(buf, starts, ends, np.arange(len(starts)), first[which], kind == "lower").all():
        return keys, first, which
    number: dict[bytes, int] = {}  # different words share a hash: number them by their bytes; keys aren't unique any more
    data = (FOLD[buf] if kind == "lower" else buf).tobytes()
    which = np.array([number.setdefault(data[a:b], len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    _, first = np.unique(which, return_index=True)
    found = hashes(buf, starts[first], ends[first], kind) if kind != "raw" else hashes(buf, starts, ends, kind)[first]
    order = np.argsort(found, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found[order], first[order], rank[which]


def hashed(column: pa.Array, kind: str = "lower", lane: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and len + 1 bounds: text d has the words bounds[d] to bounds[d + 1]."""
    buf, offsets = text_buffer(column)
    starts, ends, bounds = spans(buf, offsets)
    return hashes(buf, starts, ends, kind, lane), bounds


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """The hash of words[i : i + k] for each i; the caller drops those that cross from one text into the next."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = words[:n].copy()
    for j in range(1, k):
        out *= U(_STEP)
        out += words[j : j + n]
    return mix(out)


def whole(words: np.ndarray) -> np.uint64:
    """The hash of a sequence of fewer words than a shingle has; it depends on their number."""
    out = U(len(words) + 1)
    for x in words:
        out = U((int(out) * _STEP + int(x)) % 2**64)
    return mix(np.array([out], U))[0]


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text, sorted; of a shorter text its words as one; of no words none."""
    if not len(words):
        return np.zeros(0, U)
    if len(words) < k:
        return np.array([whole(words)], U)
    return np.unique(grams(words, k))
