"""Deep-shallow sorting of suffixes: multikey quicksort first, blind tries where common prefixes are long.

Suffixes come as byte strings cut at the depth that matters. Multikey quicksort (Bentley and Sedgewick, 1997) compares
eight bytes at a time down to SHALLOW bytes; groups that still agree there are ordered by a blind trie (Manzini and
Ferragina, 2004), which looks at single branching bytes on the way down and compares a suffix with one leaf only.
"""

from __future__ import annotations

import numpy as np

#: Bytes that quicksort looks at, a multiple of 8; and the size below which a part is sorted at once.
SHALLOW, SMALL = 16, 64


class BlindTrie:
    """Distinct byte strings; a node knows its depth and its children by their byte there (-1: the string's end)."""

    def __init__(self, first: bytes):
        self.root: bytes | tuple[int, dict] = first

    @staticmethod
    def _byte(text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1

    def add(self, text: bytes) -> None:
        node = self.root
        while not isinstance(node, bytes):  # blindly to a leaf that shares the longest prefix
            node = node[1].get(self._byte(text, node[0])) or next(iter(node[1].values()))
        short = min(len(text), len(node))
        differ = int.from_bytes(text[:short], "big") ^ int.from_bytes(node[:short], "big")
        depth = short - (differ.bit_length() + 7) // 8
        leaf, parent, node = node, None, self.root
        while not isinstance(node, bytes) and node[0] < depth:
            parent, node = node, node[1][self._byte(text, node[0])]
        if not isinstance(node, bytes) and node[0] == depth:
            node[1][self._byte(text, depth)] = text
            return
        fork = (depth, {self._byte(text, depth): text, self._byte(leaf, depth): node})
        if parent is None:
            self.root = fork
        else:
            parent[1][self._byte(text, parent[0])] = fork

    def ordered(self) -> list[tuple[bytes, int]]:
        """The strings in order, each with the bytes it shares with the one before (0 for the first)."""
        out, stack = [], [(self.root, 0)]
        while stack:
            node, shared = stack.pop()
            if isinstance(node, bytes):
                out.append((node, shared))
                continue
            depth, children = node
            keys = sorted(children)
            stack.extend((children[key], depth) for key in reversed(keys[1:]))
            stack.append((children[keys[0]], shared))
        return out


def _quicksort(words: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """rows in the order of their words (columns of words), as groups that agree in all of them."""
    out, stack = [], [(rows, 0)]
    while stack:
        part, column = stack.pop()
        if column == words.shape[1] or len(part) == 1:
            out.append(part)
            continue
        key = words[part, column]
        if len(part) <= SMALL:
            order = np.argsort(key, kind="stable")
            part, key = part[order], key[order]
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            stack.extend((piece, column + 1) for piece in reversed(np.split(part, cuts)))
            continue
        pivot = np.sort(key[:: max(1, len(key) // 15)])[min(7, len(key) // 2)]
        less, more = key < pivot, key > pivot
        for piece, at in ((part[more], column), (part[~less & ~more], column + 1), (part[less], column)):
            if len(piece):
                stack.append((piece, at))
    return out


def sort(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the suffixes in order, and the bytes each shares with the one before it (0 for the first)."""
    if not suffixes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    head = b"".join([s[:SHALLOW].ljust(SHALLOW, b"\0") for s in suffixes])
    sizes = np.array(list(map(len, suffixes)), np.int64)
    # The last column tells a short suffix from a longer one that goes on with zero bytes.
    words = np.column_stack((np.frombuffer(head, ">u8").reshape(len(suffixes), -1).astype(np.uint64), np.minimum(sizes, SHALLOW).astype(np.uint64)))
    order, shared, starts = [], [], []
    for group in _quicksort(words, np.arange(len(suffixes))):
        starts.append(len(order))
        if len(group) == 1:
            order.append(int(group[0]))
            shared.append(0)
            continue
        equal: dict[bytes, list[int]] = {}
        for k in group.tolist():
            equal.setdefault(suffixes[k], []).append(k)
        texts = iter(equal)
        trie = BlindTrie(next(texts))
        for text in texts:
            trie.add(text)
        for text, common in trie.ordered():
            same = equal[text]
            order += same
            shared += [common, *[len(text)] * (len(same) - 1)]
    order, shared, starts = np.array(order), np.array(shared, np.int64), np.array(starts[1:], np.int64)
    if len(starts):  # between groups: the leading bytes that both have
        raw = np.frombuffer(head, np.uint8).reshape(len(suffixes), SHALLOW)
        a, b = order[starts - 1], order[starts]
        differ = np.column_stack((raw[a] != raw[b], np.ones(len(a), bool))).argmax(1)
        shared[starts] = np.minimum(differ, np.minimum(sizes[a], sizes[b]))
    return order, shared
