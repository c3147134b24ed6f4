"""Words, shingles and BagMinHash signatures of an Arrow column of texts, over numpy arrays.

Everything works on the column's bytes at once: no Python object per word. Words are maximal runs
without white space, A-Z folded to a-z; white space is space and bytes 9 to 13. A text's bytes are
taken in blocks that end between words, so the memory in use doesn't grow with a text.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _fold() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


FOLD = _fold()
GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: For tokens of letters and digits: every other ASCII byte separates.
NOT_ALNUM = ~(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123)]) | (np.arange(256) >= 128))
BYTE = mix(FOLD.astype(U) + U(0x1234567))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def powers(n: int, base: int = _BASE) -> np.ndarray:
    return _powers(1 << max(20, int(n).bit_length()), base)[:n]


class Words(NamedTuple):
    doc: np.ndarray  # of each word: its text
    hash: np.ndarray
    line: np.ndarray  # line feeds before it, over the whole column
    count: np.ndarray  # of each text: its words


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def words(column: pa.Array, separators: np.ndarray = GAP) -> Words:
    data, at = buffers(column)
    n, lo, lines = len(data), 0, 0
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    inverse = pow(_BASE, -1, 1 << 64)
    while lo < n:
        hi = min(n, lo + BLOCK)
        if hi < n:
            back = np.flatnonzero(separators[data[lo:hi]])
            if len(back):
                hi = lo + int(back[-1]) + 1
            else:  # one word longer than a block
                while hi < n and not separators[data[hi]]:
                    hi += 1
        b = data[lo:hi]
        gap = separators[b]
        first = np.zeros(len(b) + 1, bool)
        first[0] = first[-1] = True
        first[at[(at >= lo) & (at < hi)] - lo] = True
        before = np.concatenate(([True], gap[:-1])) | first[:-1]
        after = np.concatenate((gap[1:], [True])) | first[1:]
        s, e = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
        sums = np.zeros(len(b) + 1, U)
        np.cumsum(BYTE[b] * powers(len(b)), out=sums[1:])
        h = mix((sums[e] - sums[s]) * powers(len(b), inverse)[s] + (e - s).astype(U))
        feeds = np.cumsum(b == 10)
        parts.append((np.searchsorted(at, s + lo, "right") - 1, h, feeds[s] + lines if len(b) else feeds))
        lines += int(feeds[-1])
        lo = hi
    doc, h, line = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))
    return Words(doc, h, line, np.bincount(doc, minlength=len(at) - 1) if len(at) > 1 else np.zeros(0, np.int64))


def places(group: np.ndarray) -> np.ndarray:
    """Of each element of a sorted array: its place in its run of equal values."""
    if not len(group):
        return np.zeros(0, np.int64)
    new = np.concatenate(([True], group[1:] != group[:-1]))
    starts = np.flatnonzero(new)
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))


def run_hash(group: np.ndarray, h: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """The groups of a sorted array, and a hash of each one's sequence of h."""
    if not len(group):
        return group, h
    at = places(group)
    starts = np.flatnonzero(at == 0)
    sums = np.add.reduceat(h * powers(int(at.max()) + 1, base)[at], starts)
    return group[starts], mix(sums + np.diff(np.append(starts, len(group))).astype(U))


def shingles(group: np.ndarray, h: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(group, hash) of every run of k words of a group; a group of fewer words is one shingle."""
    n = len(h)
    if not n:
        return group, h
    p = powers(k, 0xD1342543DE82EF95)
    if n >= k:
        g = sum((h[j : n - k + 1 + j] * p[j] for j in range(1, k)), h[: n - k + 1] * p[0])
        whole = group[: n - k + 1] == group[k - 1 :]
        out_g, out_h = group[: n - k + 1][whole], mix(g[whole])
    else:
        out_g, out_h = group[:0], h[:0]
    at = places(group)
    sizes = np.diff(np.append(np.flatnonzero(at == 0), n))
    short = np.repeat(sizes < k, sizes)
    if short.any():
        sg, sh = run_hash(group[short], h[short], 0xA0761D6478BD642F)
        out_g, out_h = np.concatenate((out_g, sg)), np.concatenate((out_h, sh))
        order = np.argsort(out_g, kind="stable")
        out_g, out_h = out_g[order], out_h[order]
    return out_g, out_h


def counted(group: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, g) in order, and how often each comes."""
    if not len(g):
        return group, g, np.zeros(0, np.int64)
    order = np.lexsort((g, group))
    group, g = group[order], g[order]
    starts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (g[1:] != g[:-1]))))
    return group[starts], g[starts], np.diff(np.append(starts, len(g)))


def occurrences(group: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multiset as a set: the i-th copy of an element becomes an element of its own, so that overlap
    of such sets is multiset overlap. In order by group."""
    if not len(g):
        return group, g
    order = np.lexsort((g, group))
    group, g = group[order], g[order]
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (g[1:] != g[:-1])))
    starts = np.flatnonzero(new)
    at = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return group, np.where(at > 0, mix(g + at.astype(U) * U(_BASE)), g)


def bag_minhash(group: np.ndarray, g: np.ndarray, weight: np.ndarray, groups: int, m: int, seed: int = 7) -> np.ndarray:
    """BagMinHash: m slots a group, equal between two groups with the chance of their weighted Jaccard.

    An element's weight axis is cut into dyadic levels [0,1), [1,2), [2,4), ...; each level is a Poisson
    process of its length as rate, seeded by element and level, whose points carry a uniform mark on
    the level and a uniform slot. Points marked below the weight count, so the points of a smaller
    weight are a subset of those of a larger one. A slot keeps its earliest time. Points are drawn in
    order of time, and a process stops once it is later than all slots of its group.
    """
    best = np.full((groups, m), np.inf)
    flat = best.reshape(-1)
    left: list[tuple[np.ndarray, ...]] = []
    level = 0
    while True:
        low = 0.0 if level == 0 else 2.0 ** (level - 1)
        length = 1.0 if level == 0 else low
        in_level = weight > low
        if not in_level.any():
            break
        key = mix(g[in_level] ^ mix(np.full(1, seed * 1000 + level, U)))
        ones = np.ones(len(key))
        left.append((group[in_level].astype(np.int64), key, weight[in_level].astype(float), low * ones, length * ones, 0 * ones))
        level += 1
    if not left:
        return best
    grp, key, w, low, length, t = (np.concatenate(x) for x in zip(*left, strict=True))
    step = 0
    while len(grp):
        u = mix(key + U((step * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        t = t - np.log(((u >> U(11)).astype(float) + 0.5) * 2.0**-53) / length
        v = mix(u ^ U(0x2545F4914F6CDD1D))
        slot = ((v >> U(32)) % U(m)).astype(np.int64)
        counts = low + (v & U(0xFFFFFFFF)).astype(float) * (2.0**-32) * length < w
        np.minimum.at(flat, (grp * m + slot)[counts], t[counts])
        live, where = np.unique(grp, return_inverse=True)
        on = t < best[live].max(axis=1)[where]
        grp, key, w, low, length, t = (x[on] for x in (grp, key, w, low, length, t))
        step += 1
    return best


def minhash(group: np.ndarray, g: np.ndarray, groups: int, m: int, seed: int = 11) -> np.ndarray:
    """m plain MinHash slots of sets of sorted groups 0..groups-1, each with an element at least."""
    starts = np.flatnonzero(places(group) == 0)
    keys = mix(np.arange(1, m + 1, dtype=U) * U(seed * 0x9E3779B9 | 1))
    out = np.empty((groups, m), U)
    for j in range(m):
        out[:, j] = np.minimum.reduceat(mix(g ^ keys[j]), starts)
    return out


def bands(signature: np.ndarray, b: int, r: int) -> np.ndarray:
    """b keys a row, each a hash of r slots and of the band's number."""
    bits = np.ascontiguousarray(signature).view(U).reshape(len(signature), -1)[:, : b * r].reshape(-1, b, r)
    keys = (mix(bits) * powers(r, 0xD6E8FEB86659FD93)).sum(axis=2, dtype=U) + np.arange(1, b + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)
    return mix(keys)


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` words, wherever groups end."""
    n = max(len(h) - size + 1, 0)
    sums = np.zeros(len(h) + 1, U)
    np.cumsum(h * powers(len(h)), out=sums[1:])
    return mix((sums[size : size + n] - sums[:n]) * powers(n, pow(_BASE, -1, 1 << 64)))


def windows(group: np.ndarray, h: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of winnowed runs of `size` words: a run is picked if its hash is least among some
    `reach` neighbouring runs of its group. Equal spans of size + reach - 1 words pick an equal run."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U)
    g = runs(h, size)
    g[group[:n] != group[size - 1 :]] = U(2**64 - 1)

    def slide(x: np.ndarray, width: int, f) -> np.ndarray:
        done = 1
        while done < width:
            step = min(done, width - done)
            x = f(x[:-step], x[step:])
            done += step
        return x

    pad = np.full(reach - 1, U(2**64 - 1))
    least = slide(np.concatenate((pad, g, pad)), reach, np.minimum)
    picked = (slide(least, reach, np.maximum) == g) & (g != U(2**64 - 1))
    # A window that reaches past a group's end isn't one of its windows; it can only add picks.
    return np.flatnonzero(picked), g[picked]


def lists(group: np.ndarray, values: np.ndarray, groups: int) -> pa.Array:
    """Values of sorted groups as an Arrow list a group."""
    at = np.zeros(groups + 1, np.int32)
    np.cumsum(np.bincount(group, minlength=groups), out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int64) if values.dtype != U else values.view(np.int64)))


def tuned(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band with which no more than `most` slots find a pair at the
    threshold with at least this chance."""
    for r in range(most, 0, -1):
        b = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**r)))
        if b * r <= most:
            return b, r
    raise ValueError("too few slots for this recall")
