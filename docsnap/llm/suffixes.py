"""Deep-shallow sorting of byte strings of one width, as needed for suffixes cut to a length."""

from __future__ import annotations

import numpy as np

SHALLOW = 16


class BlindTrie:
    """Orders strings with long common prefixes, looking at few of their bytes.

    An inner node is ``[depth, {byte: child}]``, a leaf the list of equal strings. A new string
    goes down blindly by the bytes at the nodes' depths; one comparison with the leaf it meets
    gives the true common prefix, and the string is hung there.
    """

    def __init__(self, rows: list[bytes]) -> None:
        self.rows = rows
        self.bits = 8 * len(rows[0])
        self.numbers = [int.from_bytes(r) for r in rows]
        self.root: list = [0]
        for row in range(1, len(rows)):
            self._insert(row)

    @staticmethod
    def _inner(node: list) -> bool:
        return len(node) == 2 and isinstance(node[1], dict)

    def _insert(self, row: int) -> None:
        text, node = self.rows[row], self.root
        while self._inner(node):
            children = node[1]
            node = children.get(text[node[0]]) or next(iter(children.values()))
        differing = self.numbers[row] ^ self.numbers[node[0]]
        if not differing:
            node.append(row)
            return
        depth = (self.bits - differing.bit_length()) >> 3
        other = self.rows[node[0]][depth]
        parent, node = None, self.root
        while self._inner(node) and node[0] < depth:
            parent, node = node, node[1][text[node[0]]]
        if self._inner(node) and node[0] == depth:
            node[1][text[depth]] = [row]
            return
        split = [depth, {other: node, text[depth]: [row]}]
        if parent is None:
            self.root = split
        else:
            parent[1][text[parent[0]]] = split

    def order(self) -> list[int]:
        found, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if self._inner(node):
                stack += [node[1][byte] for byte in sorted(node[1], reverse=True)]
            else:
                found += node
        return found


def deep_shallow_order(strings: np.ndarray, first: int) -> np.ndarray:
    """The sorted order of the rows of a byte matrix that agree before column ``first``.

    Multikey quicksort on words of eight bytes parts the rows by their next ``SHALLOW`` bytes;
    rows that agree there share a long prefix, and a blind trie orders them.
    """
    last = min(strings.shape[1], first + SHALLOW)
    words = {
        at: np.ascontiguousarray(strings[:, at : at + 8]).view(">u8").ravel()
        for at in range(first, last - 7, 8)
    }
    done: list[np.ndarray] = []
    stack = [(np.arange(len(strings)), first)]
    while stack:
        rows, depth = stack.pop()
        if len(rows) <= 1:
            done.append(rows)
        elif depth not in words:
            trie = BlindTrie([strings[r, first:].tobytes() for r in rows.tolist()])
            done.append(rows[trie.order()])
        else:
            word = words[depth][rows]
            pivot = word[len(word) // 2]
            below, above = word < pivot, word > pivot
            stack += [(rows[above], depth), (rows[~(below | above)], depth + 8), (rows[below], depth)]
    return np.concatenate(done)


def common_prefixes(strings: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Of each row in the order, the bytes shared with the row before it; 0 for the first."""
    found = np.zeros(len(order), np.int64)
    differ = strings[order[1:]] != strings[order[:-1]]
    found[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    return found
