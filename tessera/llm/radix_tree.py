"""An adaptive radix tree over byte strings: inner nodes grow from 4 to 16, 48 and 256 places, and one-way paths are kept as bytes.

Keys are rows of fixed-width ids. A node of the tree may end anywhere inside an id; what the callers get are the depths where
an id ends, whether they lie on a branching or inside a compressed path.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

_NONE = 255


class Node:
    """`path`: the bytes between the parent's branching and this one. Up to 16 children stand beside their sorted bytes; up to 48 behind an index of 256 bytes; more in 256 places."""

    __slots__ = ("path", "value", "marks", "index", "kids")

    def __init__(self, path: bytes, value=None):
        self.path, self.value = path, value
        self.marks: bytearray | None = bytearray()
        self.index: bytearray | None = None
        self.kids: list = []

    @property
    def places(self) -> int:
        """4, 16, 48 or 256: the layout's size."""
        if self.marks is not None:
            return 4 if len(self.kids) <= 4 else 16
        return 48 if self.index is not None else 256

    def child(self, mark: int) -> Node | None:
        if self.marks is not None:
            at = bisect_left(self.marks, mark)
            return self.kids[at] if at < len(self.marks) and self.marks[at] == mark else None
        if self.index is None:
            return self.kids[mark]
        at = self.index[mark]
        return None if at == _NONE else self.kids[at]

    def put(self, mark: int, kid: Node) -> None:
        """Adds or replaces the child behind a byte; a full layout grows to the next."""
        if self.marks is not None:
            at = bisect_left(self.marks, mark)
            if at < len(self.marks) and self.marks[at] == mark:
                self.kids[at] = kid
            elif len(self.kids) < 16:
                self.marks.insert(at, mark)
                self.kids.insert(at, kid)
            else:
                self.index = bytearray([_NONE]) * 256
                for slot, m in enumerate(self.marks):
                    self.index[m] = slot
                self.marks = None
                self.put(mark, kid)
        elif self.index is not None:
            if self.index[mark] != _NONE:
                self.kids[self.index[mark]] = kid
            elif len(self.kids) < 48:
                self.index[mark] = len(self.kids)
                self.kids.append(kid)
            else:
                wide: list = [None] * 256
                for m, slot in enumerate(self.index):
                    if slot != _NONE:
                        wide[m] = self.kids[slot]
                self.kids, self.index = wide, None
                self.kids[mark] = kid
        else:
            self.kids[mark] = kid

    def children(self) -> Iterator[Node]:
        """In the order of their bytes."""
        if self.marks is not None:
            return iter(self.kids)
        if self.index is not None:
            return (self.kids[slot] for slot in self.index if slot != _NONE)
        return (kid for kid in self.kids if kid is not None)


class RadixTree:
    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        """Keys are told apart by their bytes; a second value for a key replaces the first."""
        node, at = self.root, 0
        while at < len(key):
            kid = node.child(key[at])
            if kid is None:
                node.put(key[at], Node(key[at:], value))
                return
            path = kid.path
            if key.startswith(path, at):
                node, at = kid, at + len(path)
                continue
            same = _common(path, key, at)
            fork = Node(path[:same])
            node.put(key[at], fork)
            kid.path = path[same:]
            fork.put(kid.path[0], kid)
            node, at = fork, at + same
        node.value = value

    def walk(self) -> Iterator[tuple[Node, int, bool]]:
        """(node, depth in bytes at its end, whether its children are done): each node before and after its children, in key order."""
        stack = [(self.root, 0, False)]
        while stack:
            node, depth, done = stack.pop()
            yield node, depth, done
            if not done:
                stack.append((node, depth, True))
                stack.extend((kid, depth + len(kid.path), False) for kid in reversed(list(node.children())))


def _common(path: bytes, key: bytes, at: int) -> int:
    """How many bytes of the path stand in the key from `at` on, by halving."""
    low, high = 0, min(len(path), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if path[:mid] == key[at : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low
