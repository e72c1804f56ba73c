"""Deep-shallow sorting of byte strings: multikey quicksort down to a shallow depth, blind tries below it.

Both parts also give the length of the common prefix of neighbours in sorted order.
"""

from __future__ import annotations

#: Bytes compared by multikey quicksort before a group goes to a blind trie.
SHALLOW = 16


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix of two strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return n - ((int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length() + 7) // 8


class BlindTrie:
    """A trie of branch depths only. A string is inserted by walking down blindly, comparing it once with the leaf found
    there, and placing the new branch at their common prefix."""

    def __init__(self, strings: list[bytes], members: list[int]):
        self.strings = strings
        self.root: list | None = None
        for member in members:
            self._insert(member)

    @staticmethod
    def _byte(text: bytes, depth: int) -> int:
        return text[depth] if depth < len(text) else -1  # an end sorts before every byte

    def _insert(self, member: int) -> None:
        # Nodes are [depth, {byte: node}]; leaves are [-1, [members that are equal]].
        if self.root is None:
            self.root = [-1, [member]]
            return
        text, node = self.strings[member], self.root
        while node[0] >= 0:
            node = node[1].get(self._byte(text, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        depth = common_prefix(text, other)
        if depth == len(text) == len(other):
            node[1].append(member)
            return
        leaf, above, node = [-1, [member]], None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][self._byte(text, node[0])]
        if node[0] == depth:
            node[1][self._byte(text, depth)] = leaf
            return
        branch = [depth, {self._byte(other, depth): node, self._byte(text, depth): leaf}]
        if above is None:
            self.root = branch
        else:
            above[1][self._byte(text, above[0])] = branch

    def walk(self) -> tuple[list[int], list[int]]:
        """(members in sorted order, common prefix of each with the one before; the first has -1)."""
        order: list[int] = []
        lcp: list[int] = []
        todo: list[tuple[list, int]] = [(self.root, -1)] if self.root else []
        while todo:
            node, before = todo.pop()
            if node[0] < 0:
                order += node[1]
                lcp += [before, *[len(self.strings[node[1][0]])] * (len(node[1]) - 1)]
                continue
            below = [node[1][b] for b in sorted(node[1])]
            todo += [(child, node[0]) for child in reversed(below[1:])]
            todo.append((below[0], before))
        return order, lcp


def deep_shallow(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """(order, lcp): indices in sorted order, and the common prefix of each string with the one before it (0 for the first).
    All strings are known to agree up to `depth`."""
    order: list[int] = []
    lcp: list[int] = []
    limit = depth + shallow
    # Groups still to be sorted: members, depth up to which they agree, common prefix with what stands before.
    todo = [(list(range(len(strings))), depth, 0)]
    while todo:
        members, at, before = todo.pop()
        if not members:
            continue
        if len(members) == 1:
            order += members
            lcp.append(before)
            continue
        if at >= limit:
            sorted_, common = BlindTrie(strings, members).walk()
            order += sorted_
            lcp += [before, *common[1:]]
            continue
        byte = [strings[m][at] if at < len(strings[m]) else -1 for m in members]
        pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
        low = [m for m, b in zip(members, byte, strict=True) if b < pivot]
        same = [m for m, b in zip(members, byte, strict=True) if b == pivot]
        high = [m for m, b in zip(members, byte, strict=True) if b > pivot]
        parts = [(low, at), (same, at if pivot < 0 else at + 1), (high, at)]
        parts = [(group, start, group is same) for group, start in parts if group]
        heads = [before, *[at] * (len(parts) - 1)]
        for (group, start, is_same), head in reversed(list(zip(parts, heads, strict=True))):
            if is_same and pivot < 0:  # ended here: all equal
                todo.append((group[:1], start, head) if len(group) == 1 else (group, limit, head))
            else:
                todo.append((group, start, head))
    return order, lcp
