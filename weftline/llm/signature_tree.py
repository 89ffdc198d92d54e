"""Signature trees over token sets, and the join that walks two of them at once.

A leaf stands for one set; it holds the set's tokens as a bitmap and its size.  A
node holds its children's bitmaps combined by OR, the range of their sizes, and
the most tokens that any set below it lost to shared bits.  A pair of nodes is
dropped when no pair of sets below it can overlap enough: the common bits plus what
sharing may hide, or the smaller size, fall short of the overlap that the smallest
sizes would need.  What survives down to leaves is compared exactly.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8
#: Similarity 75 / 100, in whole numbers.
NUM, DEN = 75, 100


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest intersection with which sets of sizes a and b link."""
    return -(-NUM * (a + b) // (NUM + DEN))


def bitmap(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Tokens' low bits, as 64-bit words."""
    out = np.zeros(bits, bool)
    out[(tokens & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view("<u8")


def folded(words: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap that ``bits`` bits would have given."""
    return np.bitwise_or.reduce(words.reshape(-1, bits // 64), axis=0)


class SignatureTree:
    """Over bitmaps (one row a set), sizes and labels: sets of one label need no link. ``order`` lays like sets side by side."""

    def __init__(self, maps: np.ndarray, sizes: np.ndarray, labels: np.ndarray, order: np.ndarray):
        self.order = order
        maps, s, lab = maps[order], sizes[order], labels[order]
        lost = s - np.bitwise_count(maps).sum(1, dtype=np.int64)
        #: From the leaves up: (bitmaps, least size, largest size, most lost, label or -1 if several).
        self.levels = [(maps, s, s, lost, lab)]
        while len(self.levels[-1][0]) > 1:
            m, lo, hi, lost, lab = self.levels[-1]
            at = np.arange(0, len(m), FANOUT)
            one = np.minimum.reduceat(lab, at)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(lost, at), np.where(one == np.maximum.reduceat(lab, at), one, -1)))

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], labels: np.ndarray, bits: int) -> SignatureTree:
        heads = np.array([np.pad(s[:4], (0, 4 - len(s[:4])), mode="edge") for s in sets], np.uint64)
        order = np.lexsort((heads[:, 3], heads[:, 2], heads[:, 1], heads[:, 0]))
        return cls(np.array([bitmap(s, bits) for s in sets]), np.array([len(s) for s in sets], np.int64), labels, order)


def width(size: int) -> int:
    """Bits of a set's bitmap: four times its size, a power of two between 256 and 65536."""
    return min(65536, max(256, 1 << (4 * size - 1).bit_length()))


def possible(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray, step: int = 4096) -> np.ndarray:
    """Which node pairs may hold a link between sets of different labels."""
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), step):
        x, y = i[at : at + step], j[at : at + step]
        lo_a, hi_a, lo_b, hi_b = a[1][x], a[2][x], b[1][y], b[2][y]
        ok = (DEN * hi_a >= NUM * lo_b) & (DEN * hi_b >= NUM * lo_a)
        ok &= ~((a[4][x] == b[4][y]) & (a[4][x] >= 0))
        k = np.flatnonzero(ok)
        if len(k):
            x, y = x[k], y[k]
            bound = np.bitwise_count(a[0][x] & b[0][y]).sum(1, dtype=np.int64) + np.minimum(a[3][x], b[3][y])
            bound = np.minimum(bound, np.minimum(hi_a[k], hi_b[k]))
            ok[k] = bound >= least_overlap(lo_a[k], lo_b[k])
        keep[at : at + step] = ok
    return keep


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    same = int((large[at] == small).sum())
    return DEN * same >= NUM * (len(a) + len(b) - same)


def dual_walk(a: SignatureTree, b: SignatureTree) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of leaves (by their place in ``order``) that no bound rules out; a tree against itself gives each pair once."""
    la, lb = len(a.levels) - 1, len(b.levels) - 1
    i = j = np.zeros(1, np.int64)
    spread = np.arange(FANOUT)
    while True:
        keep = possible(a.levels[la], b.levels[lb], i, j)
        i, j = i[keep], j[keep]
        if not len(i) or (la == 0 and lb == 0):
            break
        down_a, down_b = la > 0 and la >= lb, lb > 0 and lb >= la
        if down_a:
            la -= 1
            i, j = (i[:, None] * FANOUT + spread).ravel(), np.repeat(j, FANOUT)
        if down_b:
            lb -= 1
            i, j = np.repeat(i, FANOUT), (j[:, None] * FANOUT + spread).ravel()
        ok = (i < len(a.levels[la][0])) & (j < len(b.levels[lb][0]))
        if a is b:
            ok &= i <= j
        i, j = i[ok], j[ok]
    if a is b:
        i, j = i[i != j], j[i != j]
    return a.order[i], b.order[j]


def tree_links(left: tuple[list[np.ndarray], np.ndarray], right: tuple[list[np.ndarray], np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join sets of different labels, as far as they are needed to tell components.

    Indices count the left sets, then the right ones; with no ``right``, the left
    tree is walked against itself.  Sets that links found so far have brought together are
    not compared again.
    """
    sets = left[0] + (right[0] if right else [])
    labels = np.concatenate([left[1], right[1]]) if right else left[1]
    bits = width(max(len(s) for s in sets))
    a = SignatureTree.of_sets(*left, bits)
    i, j = dual_walk(a, SignatureTree.of_sets(*right, bits) if right else a)
    if right:
        j = j + len(left[0])
    union, first, out = Union(len(sets)), {}, []
    for k, label in enumerate(labels.tolist()):
        union.join(first.setdefault(label, k), k)
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        if union.find(x) != union.find(y) and linked(sets[x], sets[y]):
            union.join(x, y)
            out.append((x, y))
    return out


def possible_groups(maps: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, right: np.ndarray | None = None) -> list[list[int]]:
    """Sets that may be linked across labels, by bitmaps alone, brought together in groups.

    ``right`` marks the sets of the other side; without it all meet all.  Bitmaps
    have the width of their set's size: linked sets differ by one step at most, so each
    width is walked with the next one folded to it.
    """
    bits = np.array([64 * len(m) for m in maps])
    union, hit = Union(len(maps)), np.zeros(len(maps), bool)
    for w in sorted(set(bits.tolist())):
        own = np.flatnonzero((bits == w) | (bits == 2 * w))
        if len(own) < 2:
            continue
        rows = np.array([folded(maps[k], w) for k in own])
        trees = []
        for side in (None,) if right is None else (False, True):
            k = np.arange(len(own)) if side is None else np.flatnonzero(right[own] == side)
            if len(k):
                # Like sets side by side: by label, then bitmap.
                order = np.lexsort((rows[k, 0], sizes[own[k]], labels[own[k]]))
                trees.append((k, SignatureTree(rows[k], sizes[own[k]], labels[own[k]], order)))
        if right is not None and len(trees) < 2:
            continue
        i, j = dual_walk(trees[0][1], trees[-1][1])
        for x, y in zip(own[trees[0][0]][i].tolist(), own[trees[-1][0]][j].tolist(), strict=True):
            union.join(x, y)
            hit[x] = hit[y] = True
    groups: dict[int, list[int]] = {}
    for k in np.flatnonzero(hit).tolist():
        groups.setdefault(union.find(k), []).append(k)
    return list(groups.values())
