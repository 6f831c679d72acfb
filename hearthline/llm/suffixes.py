"""Deep-shallow sorting of suffixes.

Multikey quicksort takes suffixes apart by words of eight bytes down to a shallow depth, all
groups of a block at once: each has a pivot of its own and falls into what is below, like
and above it.  What is still alike at that depth tends to stay alike for long.  Groups of few such
suffixes, and most are of two or three, are ordered by the words that follow, all groups of a block at once.
In a larger group that would read the same bytes again and again.  It is
ordered by a blind trie: a suffix descends by its branching bytes alone, is compared
once with the leaf it reaches, and goes where the two part.
"""

from __future__ import annotations

import numpy as np

WORD = 8  # bytes that the quicksort compares at once
SHALLOW = 16  # bytes; a multiple of WORD
FEW = 64  # suffixes alike at that depth that do not need a trie


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as numbers in the order of the bytes."""
    return np.ndarray(len(text) - WORD + 1, ">u8", text, strides=(1,))[at].astype(np.uint64)


def shallow_sort(
    text: np.ndarray, starts: np.ndarray, groups: np.ndarray, shallow: int = SHALLOW
) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by (group, first ``shallow`` bytes), and where it sees a new beginning.

    ``groups`` ascends; every suffix has ``shallow`` bytes at least."""
    order = np.arange(len(starts))
    fresh = np.ones(len(starts), bool)
    fresh[1:] = groups[1:] != groups[:-1]
    depth = np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))  # places in the order whose group is not done
    while len(live):
        new = fresh[live]
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(live)))
        keep = np.repeat((size > 1) & (depth[live[begin]] < shallow), size)
        live = live[keep]
        if not len(live):
            break
        begin = np.flatnonzero(fresh[live])
        size = np.diff(np.append(begin, len(live)))
        word = _words(text, starts[order[live]] + depth[live])
        one, two, three = word[begin], word[begin + size // 2], word[begin + size - 1]
        pivot = np.maximum(np.minimum(one, two), np.minimum(np.maximum(one, two), three))
        own = np.repeat(pivot, size)
        side = np.where(word < own, 0, np.where(word > own, 2, 1))
        key = np.repeat(np.arange(len(begin)), size) * 3 + side
        moved = np.argsort(key, kind="stable")
        key = key[moved]
        order[live] = order[live][moved]
        depth[live] += WORD * (key % 3 == 1)
        fresh[live[1:]] = key[1:] != key[:-1]
    return order, fresh


class BlindTrie:
    """Strings of equal length, told apart at their branching bytes only."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.root: list | None = None  # [depth, {byte: node}], or a leaf [size, string, number, members]

    def add(self, string: bytes, member: int) -> None:
        node = self.root
        if node is None:
            self.root = self._leaf(string, member)
            return
        while node[0] < self.size:  # blind: a byte that is missing may lead anywhere
            below = node[1]
            node = below.get(string[node[0]]) or next(iter(below.values()))
        if node[1] == string:
            node[3].append(member)
            return
        number = int.from_bytes(string, "big")
        part = self.size - 1 - ((number ^ node[2]).bit_length() - 1) // 8
        other = node[1][part]
        above, node = None, self.root
        while node[0] < part:
            above, node = node, node[1][string[node[0]]]
        leaf = [self.size, string, number, [member]]
        if node[0] == part:
            node[1][string[part]] = leaf
            return
        fork = [part, {other: node, string[part]: leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][string[above[0]]] = fork

    def _leaf(self, string: bytes, member: int) -> list:
        return [self.size, string, int.from_bytes(string, "big"), [member]]

    def classes(self) -> list[list[int]]:
        """Members of equal strings, in the order of the strings."""
        out, todo = [], [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] == self.size:
                out.append(node[3])
            else:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
        return out


def deep_shallow_sort(
    text: np.ndarray, starts: np.ndarray, groups: np.ndarray, depth: int, shallow: int = SHALLOW
) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes by (group, first ``depth`` bytes), and where in it they differ from the one before.

    ``groups`` ascends; every suffix has ``depth`` bytes at least."""
    order, fresh = shallow_sort(text, starts, groups, shallow)
    begin = np.flatnonzero(fresh)
    size = np.diff(np.append(begin, len(order)))
    many = size > FEW
    few = np.repeat((size > 1) & ~many, size)
    if few.any():
        live = np.flatnonzero(few)
        at = starts[order[live]]
        # The last word ends where the depth does, so it may repeat some bytes.
        words = [_words(text, at + k) for k in [*range(shallow, depth - WORD, WORD), depth - WORD]]
        moved = np.lexsort([*words[::-1], np.cumsum(fresh[live])])
        order[live] = order[live][moved]
        for word in words:
            word = word[moved]
            fresh[live[1:]] |= word[1:] != word[:-1]
    raw, rest = text.tobytes() if many.any() else b"", depth - shallow
    for a, n in zip(begin[many].tolist(), size[many].tolist(), strict=True):
        members = order[a : a + n].tolist()
        trie = BlindTrie(rest)
        for m, s in zip(members, (starts[order[a : a + n]] + shallow).tolist(), strict=True):
            trie.add(raw[s : s + rest], m)
        k = a
        for same in trie.classes():
            order[k : k + len(same)] = same
            fresh[k] = True
            k += len(same)
    return order, fresh
