"""Deep-shallow sorting of suffixes by their first ``width`` bytes.

Shallow part: multikey quicksort whose characters are eight bytes, sorted one character at a time within
groups that agree so far. Deep part: groups that still agree at the shallow depth and have at most ``blind``
members are ordered by blind tries (a trie over bit positions that keeps no text: an insertion walks down by
the tested bits alone, compares with the one suffix it arrives at, and branches at their first difference).
Larger groups go on with multikey quicksort until they are small enough. Tries of all groups grow together,
one member each per step, so the work is done on whole arrays.
"""

from __future__ import annotations

import numpy as np

SHALLOW, BLIND = 24, 512


def chars(text: np.ndarray, at: np.ndarray, depth: int, width: int) -> np.ndarray:
    """The eight bytes from ``depth`` of the suffixes at ``at``, big end first; none beyond ``width``."""
    n = min(8, width - depth)
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out |= text[at + (depth + k)].astype(np.uint64) << np.uint64(56 - 8 * k)
    return out


def leading_zeros(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x | (x >> np.uint64(s))
    return 64 - np.bitwise_count(x).astype(np.int64)


def bit_at(text: np.ndarray, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (text[at + (bit >> 3)] >> (7 - (bit & 7)).astype(np.uint8)) & 1


def first_difference(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int, width: int) -> np.ndarray:
    """The first bit in which suffixes a and b differ, 8 * width if none."""
    out = np.full(len(a), 8 * width, np.int64)
    todo = np.arange(len(a))
    for d in range(depth, width, 8):
        x = chars(text, a[todo], d, width) ^ chars(text, b[todo], d, width)
        differs = x != 0
        out[todo[differs]] = 8 * d + leading_zeros(x[differs])
        todo = todo[~differs]
        if not len(todo):
            break
    return out


def blind_tries(text: np.ndarray, at: np.ndarray, sizes: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix its rank among the leaves of its group's trie; ``at`` holds the groups one after another.
    Equal suffixes share a leaf. Also the member that stands for the leaf."""
    first = np.cumsum(sizes) - sizes
    n = len(at)
    bit, low, high, leaves = (np.zeros(n, np.int64) for _ in range(4))
    root, made, stands = -1 - first, np.zeros(len(sizes), np.int64), np.arange(n)
    order = np.argsort(-sizes, kind="stable")
    # A child below zero is leaf -1 - member; other children are nodes, kept where the group's members are.
    for step in range(1, int(sizes.max(initial=1))):
        group = order[: np.searchsorted(-sizes[order], -step, "left")]
        new = first[group] + step

        def walk(limit):
            here, parent, side = root[group].copy(), np.full(len(group), -1), np.zeros(len(group), np.int64)
            going = np.flatnonzero(here >= 0)
            while len(going):
                node = here[going]
                if limit is not None:
                    under = bit[node] < limit[going]
                    going, node = going[under], node[under]
                    leaves[node] += 1
                turn = bit_at(text, at[new[going]], bit[node])
                parent[going], side[going] = node, turn
                here[going] = np.where(turn == 1, high[node], low[node])
                going = going[here[going] >= 0]
            return here, parent, side

        leaf = -1 - walk(None)[0]
        differs = first_difference(text, at[new], at[leaf], depth, width)
        equal = differs >= 8 * width
        stands[new[equal]] = leaf[equal]
        if equal.all():
            continue
        group, new, differs = group[~equal], new[~equal], differs[~equal]
        below, parent, side = walk(differs)
        node = first[group] + made[group]
        made[group] += 1
        bit[node] = differs
        leaves[node] = 1 + np.where(below < 0, 1, leaves[np.maximum(below, 0)])
        up = bit_at(text, at[new], differs) == 1
        high[node], low[node] = np.where(up, -1 - new, below), np.where(up, below, -1 - new)
        top = parent < 0
        root[group[top]] = node[top]
        left, right = ~top & (side == 0), ~top & (side == 1)
        low[parent[left]], high[parent[right]] = node[left], node[right]
    rank = np.zeros(n, np.int64)
    here, base = root, np.zeros(len(sizes), np.int64)
    while len(here):
        leaf = here < 0
        rank[-1 - here[leaf]] = base[leaf]
        node, base = here[~leaf], base[~leaf]
        under = np.where(low[node] < 0, 1, leaves[np.maximum(low[node], 0)])
        here, base = np.concatenate([low[node], high[node]]), np.concatenate([base, base + under])
    return rank[stands], stands


def sort_suffixes(text: np.ndarray, at: np.ndarray, width: int, shallow: int = SHALLOW, blind: int = BLIND) -> tuple[np.ndarray, np.ndarray]:
    """``order`` sorts the suffixes at ``at`` by ``width`` bytes; ``new`` marks, along it, those that differ
    from the one before."""
    n = len(at)
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    for depth in range(0, width, 8):
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        if depth >= shallow:
            small = (sizes > 1) & (sizes <= blind)
            if small.any():
                many = sizes[small]
                where = np.repeat(starts[small], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                rank, _ = blind_tries(text, at[order[where]], many, depth, width)
                group = np.repeat(np.arange(len(many)), many)
                by = np.lexsort((rank, group))
                order[where] = order[where][by]
                rank, group = rank[by], group[by]
                new[where] |= np.concatenate([[True], (rank[1:] != rank[:-1]) | (group[1:] != group[:-1])])
                sizes = np.where(small, 1, sizes)  # done
        active = np.repeat(sizes > 1, np.diff(np.append(starts, n)))
        where = np.flatnonzero(active)
        if not len(where):
            if depth >= shallow or not (sizes > 1).any():
                break
            continue
        group = (np.cumsum(new) - 1)[where]
        key = chars(text, at[order[where]], depth, width)
        by = np.lexsort((key, group))
        order[where] = order[where][by]
        key, group = key[by], group[by]
        new[where] |= np.concatenate([[True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])])
    return order, new
