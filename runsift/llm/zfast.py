"""A z-fast trie over sequences of turns.

A sequence is the bytes of its prefix digests, 16 for each depth: equal digests mean
equal prefixes. A compacted node stands for the prefixes of depths top + 1 to deep of
the sequence that it keeps; its handle is the digest at the two-fattest depth of these.
Fat binary search finds where a sequence leaves the trie in about log2(length) look-ups
of handles.
"""

from __future__ import annotations

WIDTH = 16
ROOT = b""


def fattest(low: int, high: int) -> int:
    """The number in (low, high] that the highest power of two divides."""
    return high & (-1 << ((low ^ high).bit_length() - 1))


def digest(sequence: bytes, depth: int) -> bytes:
    return sequence[WIDTH * (depth - 1) : WIDTH * depth]


def shared(a: bytes, b: bytes, low: int, high: int) -> int:
    """The largest depth in [low, high] to which both agree; they do at low."""
    while low < high:
        middle = (low + high + 1) // 2
        if digest(a, middle) == digest(b, middle):
            low = middle
        else:
            high = middle - 1
    return low


class ZFastTrie:
    """Compacted nodes by handle and by name (the digest one below the parent's depth).

    All sequences share the prefix of depth `base`, which is the trie's root.
    """

    def __init__(self, base: int):
        self.base = base
        self.top: list[int] = []
        self.deep: list[int] = []
        self.kept: list[bytes] = []
        self.label: list[object] = []
        self.handles: dict[bytes, int] = {}
        self.names: dict[bytes, int] = {}

    def add(self, top: int, deep: int, sequence: bytes, label: object) -> None:
        node = len(self.top)
        self.top.append(top)
        self.deep.append(deep)
        self.kept.append(sequence)
        self.label.append(label)
        self.names[digest(sequence, top + 1)] = node
        self.handles[digest(sequence, fattest(top, deep))] = node

    def exit(self, sequence: bytes) -> tuple[int | None, int]:
        """Where a sequence leaves the trie: (the node in whose edge that is, depth), or (None, depth) at a node's end."""
        n = len(sequence) // WIDTH
        low, high = self.base, n
        while low < high:
            depth = fattest(low, high)
            node = self.handles.get(digest(sequence, depth))
            if node is None:
                high = depth - 1
                continue
            deep = self.deep[node]
            if deep <= n and digest(sequence, deep) == digest(self.kept[node], deep):
                low = deep
            else:
                return node, shared(sequence, self.kept[node], depth, min(deep, n))
        if low < n and (node := self.names.get(digest(sequence, low + 1))) is not None:
            return node, shared(sequence, self.kept[node], low + 1, min(self.deep[node], n))
        return None, low

    def insert(self, sequence: bytes, label: object) -> None:
        """Adds a sequence that is not in the trie as a whole: its own node, and one where it leaves an edge."""
        node, depth = self.exit(sequence)
        n = len(sequence) // WIDTH
        if node is not None:
            kept, top = self.kept[node], self.top[node]
            del self.handles[digest(kept, fattest(top, self.deep[node]))]
            self.top[node] = depth
            self.names[digest(kept, depth + 1)] = node
            self.handles[digest(kept, fattest(depth, self.deep[node]))] = node
            self.add(top, depth, kept, self.label[node])
        if depth < n:
            self.add(depth, n, sequence, label)
