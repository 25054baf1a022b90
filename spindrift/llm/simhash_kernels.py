"""NumPy kernels of SimHash: fingerprints of texts, links inside index buckets.

Short fingerprints have 64 bits and count every shingle; wide ones have several
times 64 bits and count each distinct shingle once, so that their differing bits
estimate the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Shingle hashes turned into bits at a time; bounds memory for texts of any length.
_SLAB = 1 << 15


def fingerprint(text: str | None, k: int = 4, seed: int = 42) -> int:
    """64-bit SimHash of a text by its word ``k``-shingles, repeats included.

    A-Z is lower-cased; words are maximal runs without U+0020/U+0009..U+000D.  A
    text of fewer than ``k`` words is one shingle, a text of none is zero.  A bit
    is 1 if it is set in over half of the shingle hashes.
    """
    # bytes.lower and bytes.split know ASCII only, exactly the contract's classes
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    total = len(words) - k + 1
    lows, highs = starts[:total].tolist(), ends[k - 1 :].tolist()
    tally = np.zeros(64, np.int64)
    for at in range(0, total, _SLAB):
        hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(lows[at : at + _SLAB], highs[at : at + _SLAB], strict=True)), np.uint64)
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        tally += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * tally > total).tobytes(), "big")


#: Increments that make one shingle hash into those of several lanes.
_LANE, _MIX = 0x9E3779B97F4A7C15, (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
#: Buckets of up to so many fingerprints are compared many at a time.
SMALL = 32
#: Uncertain neighbours of other clusters that a fingerprint of a larger bucket names at first; what is left follows in a pass of its own.
NEAREST = 3


def shingle_set(text: str | None, k: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted distinct hashes of a text's word ``k``-shingles; words as in ``fingerprint``, one shingle for fewer than ``k``."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    k = min(k, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], np.uint64))


def wide_fingerprint(text: str | None, k: int = 5, lanes: int = 8) -> bytes:
    """SimHash of ``64 * lanes`` bits of a text's set of word ``k``-shingles; all bits are zero without a word."""
    hashes = shingle_set(text, k)
    steps = np.array([_LANE * (i + 1) & (1 << 64) - 1 for i in range(lanes)], np.uint64)
    tally = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), _SLAB >> 3):
        x = hashes[at : at + (_SLAB >> 3), None] + steps[None, :]
        x = (x ^ (x >> np.uint64(30))) * _MIX[0]
        x = (x ^ (x >> np.uint64(27))) * _MIX[1]
        x ^= x >> np.uint64(31)
        tally += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * tally > len(hashes)).tobytes()


def _pairs(x: np.ndarray, y: np.ndarray, tally_at_least: int, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two tables of words are candidates that differ in few bits, and their differing bits."""
    differ = x ^ y
    bits = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
    near = np.flatnonzero(bits <= max_bits)
    near = near[(differ[near].view(np.uint8) == 0).sum(axis=1) >= tally_at_least]
    return near, bits[near]


def small_bucket_links(group: np.ndarray, prints: np.ndarray, side: np.ndarray, tally_at_least: int, max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, differing bits) of all links inside groups; rows of a ``group`` stand together."""
    out = []
    across = np.zeros(int(group[-1]) + 1, bool)
    np.logical_or.at(across, group, side > 0)
    for step in range(1, len(group)):
        rows = np.flatnonzero(group[step:] == group[:-step])
        if not len(rows):
            break
        rows = rows[~across[group[rows]] | (side[rows] != side[rows + step])]
        near, bits = _pairs(prints[rows], prints[rows + step], tally_at_least, max_bits)
        out.append((rows[near], rows[near] + step, bits))
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*out, strict=True) if out else ((), (), ())))  # type: ignore[return-value]


def large_bucket_links(
    prints: np.ndarray, side: np.ndarray, tally_at_least: int, sure_bits: int, max_bits: int, most: int = NEAREST, root: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, row, differing bits) of links of one bucket, or of a pair of its blocks: a spanning forest of the sure ones, and uncertain ones between its trees.

    Each row that is reached is compared with those not reached yet, so a group of near
    copies takes steps in proportion to its size.  Uncertain links join different
    clusters, of sure links and of ``root`` (known components); a row names its nearest
    ``most``.  One that names fewer has no others; for the rest there is ``verified_links``.
    Two blocks (``side``) are compared only across.
    """
    n, across, out = len(prints), bool(side.any()), []
    cluster, rest = np.full(n, -1), np.arange(n)
    while len(rest):
        first, rest = int(rest[0]), rest[1:]
        cluster[first], queue = first, [first]
        while queue and len(rest):
            at = queue.pop()
            other = rest[side[rest] != side[at]] if across else rest
            near, bits = _pairs(prints[other], prints[at], tally_at_least, sure_bits)
            found = other[near]
            if len(found):
                out.append((np.full(len(found), at), found, bits))
                cluster[found] = first
                queue.extend(found.tolist())
                rest = np.setdiff1d(rest, found, assume_unique=True)
    if root is not None:
        cluster = _merged(cluster, np.unique(root, return_inverse=True)[1])
    for at in range(n):
        other = np.flatnonzero((cluster != cluster[at]) & ((side != side[at]) | (not across)))
        near, bits = _pairs(prints[other], prints[at], tally_at_least, max_bits)
        chosen = np.argsort(bits, kind="stable")[:most]
        out.append((np.full(len(chosen), at), other[near[chosen]], bits[chosen]))
    return tuple(np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*out, strict=True) if out else ((), (), ())))  # type: ignore[return-value]


def verified_links(prints: np.ndarray, side: np.ndarray, root: np.ndarray, sets: list[np.ndarray | None], tally_at_least: int, sure_bits: int, max_bits: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, row) of a spanning forest of all links of one bucket, or of a pair of its blocks, between the components ``root``.

    Every pair of different components whose bits leave it open is decided, by the exact
    similarity of its ``sets``; one with an unknown set by its bits.  Only links leave,
    at most one a row.
    """
    across, out = bool(side.any()), []
    cluster = np.unique(root, return_inverse=True)[1]
    known = np.array([x is not None for x in sets])
    size = np.array([0 if x is None else len(x) for x in sets])
    ends = np.cumsum(size)
    words, word = np.unique(np.concatenate([np.zeros(0, np.int32), *(x for x in sets if x is not None)]), return_inverse=True)
    held = np.zeros(len(words), bool)
    for at in range(len(prints)):
        other = at + 1 + np.flatnonzero((cluster[at + 1 :] != cluster[at]) & ((side[at + 1 :] != side[at]) | (not across)))
        near, bits = _pairs(prints[other], prints[at], tally_at_least, max_bits)
        if not len(near):
            continue
        other = other[near]
        own, n = word[ends[at] - size[at] : ends[at]], size[other]
        held[own] = True
        stop = np.cumsum(n)
        seen = np.concatenate(([0], np.cumsum(held[word[np.repeat(ends[other] - stop, n) + np.arange(int(n.sum()))]])))
        held[own] = False
        shared = seen[stop] - seen[stop - n]
        linked = (bits <= sure_bits) | ~(known[at] & known[other]) | (shared >= similarity * (size[at] + n - shared))
        for to in other[linked].tolist():
            if cluster[to] != cluster[at]:
                out.append((at, to))
                cluster[cluster == cluster[to]] = cluster[at]
    return tuple(np.array(out, np.int64).reshape(-1, 2).T)  # type: ignore[return-value]


def _merged(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels that rows share if a chain of equal ``x`` or equal ``y`` joins them; both hold numbers below their length."""
    label = x
    while True:
        before = label
        for part in (x, y):
            low = np.full(len(x), len(x))
            np.minimum.at(low, part, label)
            label = low[part]
        if np.array_equal(label, before):
            return label


def spanning(a: np.ndarray, b: np.ndarray, root_a: np.ndarray, root_b: np.ndarray, sure: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same classes by fewer links (a, b, sure): a star forest over the roots that sure links join, and each uncertain pair between different trees once."""
    names, at = np.unique(np.concatenate((root_a, root_b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    parent = np.arange(len(names))
    u, v = x[sure], y[sure]
    while len(u):
        ru, rv = parent[u], parent[v]
        apart = ru != rv
        u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
        if len(u):
            np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
            parent = _roots(parent)
    moved = np.flatnonzero(parent != np.arange(len(names)))
    left = ~sure & (parent[x] != parent[y])
    pairs = np.unique(np.stack((np.maximum(a, b)[left], np.minimum(a, b)[left]), axis=1), axis=0)
    return np.concatenate((names[moved], pairs[:, 0])), np.concatenate((names[parent[moved]], pairs[:, 1])), np.arange(len(moved) + len(pairs)) < len(moved)


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        nxt = parent[parent]
        if np.array_equal(nxt, parent):
            return parent
        parent = nxt


def bucket_forest(prints: np.ndarray, side: np.ndarray, tally_at_least: int, max_bits: int, tile: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Star forest over the linked fingerprints of one bucket (or of one pair of its blocks).

    ``side`` splits the bucket in two blocks; two blocks are compared only across,
    a single block (all zero) with itself.  A pair is a candidate if at least
    ``tally_at_least`` of its 8 positional bytes agree and a link if at most
    ``max_bits`` bits differ.  Returns (fingerprint, smallest linked fingerprint
    of the bucket); at most one edge a fingerprint leaves, never all pairs.
    """
    order = np.argsort(prints, kind="stable")
    prints, side = prints[order], side[order]
    n = len(prints)
    parent = np.arange(n)
    lanes = prints.view(np.uint8).reshape(n, 8)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    for i in range(0, len(left), tile):
        a = left[i : i + tile]
        for j in range(0, len(right), tile):
            b = right[j : j + tile]
            tally = np.zeros((len(a), len(b)), np.uint8)
            for lane in range(8):
                tally += lanes[a, lane][:, None] == lanes[b, lane][None, :]
            x, y = np.nonzero(tally >= tally_at_least)
            x, y = a[x], b[y]
            near = (x != y) & (np.bitwise_count(prints[x] ^ prints[y]) <= max_bits)
            x, y = x[near], y[near]
            while len(x):
                rx, ry = parent[x], parent[y]
                apart = rx != ry
                x, y, rx, ry = x[apart], y[apart], rx[apart], ry[apart]
                if not len(x):
                    break
                np.minimum.at(parent, np.maximum(rx, ry), np.minimum(rx, ry))
                parent = _roots(parent)
    moved = np.flatnonzero(parent != np.arange(n))
    return prints[moved], prints[parent[moved]]
